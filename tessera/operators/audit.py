"""Entries of an audit log, cleaned: normalised names, usable times, each entry once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Times before this come from an unset clock.
FIRST_USABLE = "2000-01-01 00:00:00"


def name_of(c: str | Column) -> Column:
    """A name in lower case without outer white space; null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))


def usable(c: str | Column) -> Column:
    """Whether a time is not null and not before 2000."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & (c >= F.lit(FIRST_USABLE).cast("timestamp_ntz"))


def micros(c: str | Column) -> Column:
    """Microseconds since 1970 of a time without zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def entries_once(audit: DataFrame, keep: list[Column], entry_id: str = "entry_id", received_at: str = "received_at") -> DataFrame:
    """One row per entry_id with the columns of ``keep``, those of the copy received first.

    Copies received at one time are told apart by the kept columns in their order, so the result doesn't depend on row order. Rows with a null entry_id
    are left out, as they can't be told apart.
    """
    row = F.struct(F.col(received_at), *keep)
    once = audit.where(F.col(entry_id).isNotNull()).groupBy(entry_id).agg(F.min(row).alias("_row"))
    return once.select(entry_id, "_row.*").drop(received_at)
