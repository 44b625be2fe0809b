"""Validation and quality flags of ordered bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.bars import bar_hash, numbered, validation_errors


def with_ordinals(df: DataFrame, order: list[str], key: str = "symbol") -> DataFrame:
    """bar_index from 0 in the given order and bar_id, over all rows, valid or not."""
    i = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    x = df.withColumn("bar_index", i.cast("long"))
    return x.withColumn("bar_id", numbered("bar_", F.col("bar_index") + 1))


def flag_bars(bars: DataFrame, key: str = "symbol") -> DataFrame:
    """Adds validation_errors and is_valid: price checks, repeated and non-rising timestamps.

    Rows keep the order of bar_index; of equal timestamps the first is good. A null timestamp is an
    error of its own and is no predecessor.
    """
    before = F.last("timestamp", ignorenulls=True).over(Window.partitionBy(key).orderBy("bar_index").rowsBetween(Window.unboundedPreceding, -1))
    nth = F.row_number().over(Window.partitionBy(key, "timestamp").orderBy("bar_index"))
    more = F.filter(
        F.array(
            F.when(F.col("timestamp").isNull(), "timestamp missing"),
            F.when(F.col("timestamp").isNotNull() & (F.col("_nth") > 1), "duplicate timestamp"),
            F.when(F.col("timestamp") <= F.col("_before"), "non-monotonic timestamp"),
        ),
        lambda e: e.isNotNull(),
    )
    x = bars.withColumns({"_before": before, "_nth": nth})
    x = x.withColumn("validation_errors", F.concat(validation_errors(), more)).drop("_before", "_nth")
    return x.withColumn("is_valid", F.size("validation_errors") == 0)


def quality_report(flagged: DataFrame, key: str = "symbol") -> DataFrame:
    """One row a series: counts of raw, valid, repeated and missing bars, order and status."""
    prev = F.lag("bar_index").over(Window.partitionBy(key).orderBy("bar_index"))
    gaps = flagged.where("is_valid").withColumn("_gap", F.greatest(F.col("bar_index") - prev - 1, F.lit(0))).groupBy(key).agg(F.sum("_gap").alias("_gaps"))
    has = lambda e: F.array_contains("validation_errors", e)
    base = flagged.groupBy(key).agg(
        F.count("*").alias("raw_bar_count"),
        F.count_if("is_valid").alias("valid_bar_count"),
        F.count_if(has("duplicate timestamp")).alias("duplicate_count"),
        (F.count_if(has("non-monotonic timestamp")) == 0).alias("monotonic_timestamp"),
    )
    gaps = gaps.withColumnRenamed(key, "_key")
    x = base.join(gaps, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    status = F.when(F.col("valid_bar_count") == 0, "ERROR").when((F.col("duplicate_count") == 0) & F.col("monotonic_timestamp") & (F.col("valid_bar_count") == F.col("raw_bar_count")), "OK").otherwise("WARNING")
    return x.select(key, "raw_bar_count", "valid_bar_count", "duplicate_count", F.coalesce("_gaps", F.lit(0)).cast("long").alias("missing_interval_count"), "monotonic_timestamp", status.alias("status"))


def ordered_digest(df: DataFrame, order: str, item: Column, name: str, key: str = "symbol", block: int = 4096) -> DataFrame:
    """SHA-256 digest of a series' items in order, by a tree: blocks of the order column first."""
    x = df.select(key, F.floor(F.col(order) / block).alias("_b"), F.struct(F.col(order).alias("i"), item.alias("h")).alias("_s"))
    join = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda s: s["h"]), "|")
    x = x.groupBy(key, "_b").agg(join("_s").alias("_h"))
    x = x.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_b").alias("i"), F.sha2("_h", 256).alias("h")))), lambda s: s["h"]), "|").alias("_h"))
    return x.select(key, F.left(F.sha2("_h", 256), F.lit(16)).alias(name))


def input_checksum(flagged: DataFrame) -> DataFrame:
    return ordered_digest(flagged.where("is_valid"), "bar_index", bar_hash(), "input_checksum")


def assert_append_order(old_last: Column, timestamp: Column) -> Column:
    """The timestamp, or an error that ends the query if it isn't later than the last stored one."""
    return F.when(old_last.isNotNull() & (timestamp <= old_last), F.raise_error(F.lit("appended bars must be later than stored ones"))).otherwise(timestamp)
