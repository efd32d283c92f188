"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def day(df: DataFrame, name: str) -> Column:
    """The calendar day of a column: a cast, or the first ten characters when it is text.

    Text that is no date is null and does not stop the job.
    """
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.try_to_date(F.substring(F.col(name), 1, 10))
    return F.col(name).cast("date")


def hours_between(later: str, earlier: str) -> Column:
    """Elapsed hours, to the second."""
    seconds = F.unix_timestamp(F.col(later).try_cast("timestamp")) - F.unix_timestamp(F.col(earlier).try_cast("timestamp"))
    return seconds / F.lit(3600.0)
