"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace, Unicode spaces included."""
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def contains_ci(c: Column, needle: str) -> Column:
    """Case-insensitive substring test on the text form of any column."""
    return F.contains(F.lower(c.cast("string")), F.lit(needle.lower()))


def to_double(c: Column) -> Column:
    """Number or null; never fails under ANSI mode."""
    return c.try_cast("double")


def iso_utc(c: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` text of an instant (session zone UTC)."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def pinned(c: Column) -> Column:
    """The same value, but later filters stay above the step that computes it.

    Pushing a filter on a costly column below its step would compute it again,
    once per mention. A filter never moves past an expression that is not
    deterministic; the partition id is the cheapest such expression. Filters on
    plain columns are held back too, so apply those first.
    """
    return F.when(F.spark_partition_id() >= 0, c)
