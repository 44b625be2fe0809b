"""Column expressions over single bars and objects: validity, identity, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHECKS = [("high", "<", "low"), ("high", "<", "open"), ("high", "<", "close"), ("low", ">", "open"), ("low", ">", "close")]


def validation_errors() -> Column:
    """Names of the failed price checks; a price that is null, NaN or infinite is an error of its own."""
    tests = [F.when(F.expr(f"{a} {op} {b} and not isnan({a}) and not isnan({b})"), F.lit(f"{a}{op}{b}")) for a, op, b in CHECKS]
    missing = [F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(f"{c} missing")) for c in ("open", "high", "low", "close")]
    return F.filter(F.array(*tests, *missing), lambda e: e.isNotNull())


def text(c: str) -> Column:
    """Canonical text for hashes: numbers as scaled integers, so that no float formatting matters."""
    return F.coalesce(F.round(F.col(c) * 1_000_000).cast("long").cast("string"), F.lit(""))


def short_hash(*parts: Column, length: int = 16) -> Column:
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(length))


def bar_hash() -> Column:
    # of the wall clock, so that no session time zone matters
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(timestamp as timestamp_ntz))").cast("string")
    return short_hash(F.col("bar_index").cast("string"), at, *[text(c) for c in ("open", "high", "low", "close", "volume")])


def active() -> Column:
    """Whether an object is still in force."""
    return F.col("status").isin("CANDIDATE", "PROVISIONAL", "CONFIRMED")


def includes_raw_bar(bar_id: Column) -> Column:
    return F.array_contains("source_raw_bar_ids", bar_id)


def numbered(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), 6, "0"))


def merged_logical(n: Column) -> Column:
    return F.concat(F.lit("mbar:idx_"), n.cast("string"))
