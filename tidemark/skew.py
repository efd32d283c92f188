"""Join helper that keeps hot keys spread over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SALT = "_salt"


def spread_join(
    big: DataFrame,
    small: DataFrame,
    key: str,
    how: str = "inner",
    spread_by: list[str] | None = None,
    where: Column | None = None,
    salts: int = 8,
) -> DataFrame:
    """Join ``big`` to ``small``, which holds one row per ``key``, without piling up a hot key.

    Rows of one key go to ``salts`` groups chosen by a hash of ``spread_by`` (content, so a
    re-run task repeats the choice) and ``small`` is copied once per group; ``salts`` is a power
    of two. The salt is never null, so the planner adds no filter for it below. The salt also
    gives both sides a shuffle of their own, which lets adaptive execution broadcast
    ``small`` once its real size is known, or split a group that is still too large.
    ``how`` may be inner, left, left_semi or left_anti. ``where`` is a residual predicate over
    the joined row, for inner joins.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    if salts & (salts - 1):
        raise ValueError("salts must be a power of two")
    spread_by = spread_by or [c for c in big.columns if c != key]
    if not spread_by or salts < 2:
        joined = big.join(small, key, how)
    else:
        copies = F.explode(F.array(*[F.lit(s).cast("bigint") for s in range(salts)]))
        salted = big.withColumn(_SALT, F.xxhash64(*spread_by).bitwiseAND(salts - 1))
        joined = salted.join(small.withColumn(_SALT, copies), [key, _SALT], how).drop(_SALT)
    return joined if where is None else joined.filter(where)
