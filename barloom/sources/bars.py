"""Bars from tables, row lists and CSV files; ticks to bars; sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.quality import with_ordinals
from barloom.sources.rejects import ALIASES


def resample(df: DataFrame, symbol: Column, ts: Column, value: Column, tie: list[Column], every: str) -> DataFrame:
    """OHLCV bars of ticks: first, highest, lowest, last value and count of each period.

    ``every`` is a unit of date_trunc. Rows without symbol, time or value are left out.
    """
    x = df.select(symbol.alias("symbol"), ts.cast("timestamp_ntz").alias("_t"), value.cast("double").alias("_v"), F.struct(ts, *tie).alias("_k"))
    x = x.where("symbol is not null and _t is not null and _v is not null").withColumn("timestamp", F.date_trunc(every, "_t").cast("timestamp_ntz"))
    x = x.groupBy("symbol", "timestamp").agg(F.min_by("_v", "_k").alias("open"), F.max("_v").alias("high"), F.min("_v").alias("low"), F.max_by("_v", "_k").alias("close"), F.count("*").cast("double").alias("volume"))
    return with_ordinals(x, ["timestamp"])


def resolve_columns(names: list[str]) -> dict[str, str]:
    """Field to column name: aliases without case and outer blanks, the first alias present wins."""
    lower = [n.removeprefix("﻿").strip().lower() for n in names]
    found = {f: names[lower.index(a)] for f, aliases in ALIASES.items() for a in [next((a for a in aliases if a in lower), None)] if a}
    missing = [f for f in ("timestamp", "open", "high", "low", "close") if f not in found]
    if missing:
        raise ValueError(f"missing columns {missing} among {names}")
    return found


def parse_timestamp(c: Column) -> Column:
    """Local time of the six plain notations, else of ISO text; null if there is none."""
    c = F.trim(c)
    plain = F.regexp_replace(c, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    eight = F.when(c.rlike(r"^\d{8}$"), F.concat_ws("-", c.substr(1, 4), c.substr(5, 2), c.substr(7, 2)))
    fourteen = F.when(c.rlike(r"^\d{14}$"), F.concat(F.concat_ws("-", c.substr(1, 4), c.substr(5, 2), c.substr(7, 2)), F.lit(" "), F.concat_ws(":", c.substr(9, 2), c.substr(11, 2), c.substr(13, 2))))
    return F.coalesce(eight, fourteen, F.when(plain.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), plain)).try_cast("timestamp_ntz")


def from_rows(df: DataFrame, symbol: Column, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Bars of any table with OHLC columns under their usual names, and parse errors by symbol.

    Every row takes a number in the given order; rows that don't parse are counted and dropped.
    A missing or blank volume is 0.
    """
    cols = resolve_columns(df.columns)
    blank = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    x = with_ordinals(df.withColumn("_symbol", symbol), order, "_symbol")
    ts = F.col(cols["timestamp"]).cast("timestamp_ntz") if dict(df.dtypes)[cols["timestamp"]] != "string" else parse_timestamp(F.col(cols["timestamp"]))
    price = [blank(cols[f]).try_cast("double").alias(f) for f in ("open", "high", "low", "close")]
    volume = F.coalesce(blank(cols["volume"]).try_cast("double"), F.when(blank(cols["volume"]).isNull(), 0.0)) if "volume" in cols else F.lit(0.0)
    x = x.select(F.col("_symbol").alias("symbol"), "bar_id", "bar_index", ts.alias("timestamp"), *price, volume.alias("volume"))
    ok = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(False)) for c in ("timestamp", "open", "high", "low", "close", "volume")], F.lit(True))
    return x.where(ok), x.groupBy("symbol").agg(F.count_if(~ok).alias("parse_errors"))


def read_csv(spark: SparkSession, path: str, symbol: str) -> tuple[DataFrame, DataFrame]:
    """Bars of one symbol's CSV file; for files with broken records use ``load_csv_records``."""
    df = spark.read.option("header", True).csv(path)
    return from_rows(df.withColumn("_seq", F.monotonically_increasing_id()), F.lit(symbol), ["_seq"])


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Each table under its name, partitioned by symbol where it has one."""
    for name, df in tables.items():
        w = df.write.mode("overwrite").format(fmt)
        (w.partitionBy("symbol") if "symbol" in df.columns else w).save(f"{path}/{name}")


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
