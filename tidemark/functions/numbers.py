"""Numbers hidden in text."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _guarded(text: Column) -> Column:
    """Cast only what is a number: a pattern test is far cheaper than a cast that fails."""
    return F.when(text.rlike(NUMBER), text.cast("double"))


def number_or_null(text: Column) -> Column:
    """The double a text spells, else null. Words such as ``nan`` or ``inf`` are not numbers."""
    return _guarded(F.trim(text))


def mean_dose(text: Column) -> Column:
    """Mean of a dose text such as ``5-10``, ``>3`` or ``1,000 mg``.

    Letters, commas, angle brackets and blanks go; the rest is split on ``-`` and averaged.
    A missing text counts as 0; one unreadable part makes the dose null.
    """
    bare = F.translate(text, string.ascii_letters + ",>< ", "")
    parts = F.transform(F.split(bare, "-"), _guarded)
    total = F.aggregate(parts, F.lit(0.0), lambda acc, part: acc + part)
    # most doses are one number and need no array
    return (
        F.when(~F.contains(bare, F.lit("-")), _guarded(bare))
        .when(text.isNull(), F.lit(0.0))
        .otherwise(total / F.size(parts))
    )
