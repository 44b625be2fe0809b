"""Containment merge: ordered bars to merged bars."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.bars import merged_logical, numbered
from barloom.functions.kernels import merge_fold
from barloom.operators.folding import CHUNK, chunked_fold
from barloom.profile import Profile

FIELDS = "symbol string, chunk long, bar_id string, bar_index long, timestamp timestamp_ntz, open double, high double, low double, close double, volume double, new int, direction int"


def assign_merged(bars: DataFrame, profile: Profile = Profile(), chunk: int = CHUNK) -> DataFrame:
    """Valid bars with the number of the merged bar that each belongs to, and its direction.

    The fold returns where merged bars begin; numbers come from counts by chunk, so that chunks of
    one series are independent. Bars need unique, rising bar_index within a symbol.
    """
    strict = profile.equal_high_low_policy == "explicit"

    def fold(pdf: pd.DataFrame, state: list | None) -> tuple[pd.DataFrame, list | None]:
        new, dirs, end = merge_fold(pdf["high"].tolist(), pdf["low"].tolist(), state, strict)
        return pdf.assign(new=new, direction=dirs), end

    need = bars.select("symbol", "bar_id", F.col("bar_index").cast("long").alias("bar_index"), F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")])
    x = chunked_fold(need, "bar_index", fold, FIELDS, chunk=chunk)
    counts = x.groupBy("symbol", "chunk").agg(F.sum("new").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy("symbol").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("symbol").alias("_s"), F.col("chunk").alias("_c"), before.alias("_offset"))
    inner = F.sum("new").over(Window.partitionBy("symbol", "chunk").orderBy("bar_index"))
    x = x.withColumn("_n", inner).join(offsets, F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("chunk") == F.col("_c")))
    return x.withColumn("merged_index", (F.col("_offset") + F.col("_n") - 1).cast("long")).drop("_s", "_c", "_offset", "_n", "new", "chunk")


def merged_bars(assigned: DataFrame) -> DataFrame:
    """Merged bars with prices, provenance and visibility; all are CONFIRMED at once."""
    up = F.max("direction") == 1
    i = F.col("bar_index")
    x = assigned.groupBy("symbol", F.col("merged_index")).agg(
        F.max("timestamp").alias("timestamp"),
        F.min_by("open", i).alias("open"),
        F.when(up, F.max("high")).otherwise(F.min("high")).alias("high"),
        F.when(up, F.max("low")).otherwise(F.min("low")).alias("low"),
        F.max_by("close", i).alias("close"),
        F.sum("volume").alias("volume"),
        F.array_sort(F.collect_list(F.struct("bar_index", "bar_id"))).alias("_s"),
        F.when(up, "UP").otherwise("DOWN").alias("merge_direction"),
    )
    bar_id = numbered("mbar_", F.col("merged_index") + 1)
    return x.select(
        "symbol", bar_id.alias("bar_id"), F.col("merged_index").alias("bar_index"), "timestamp", "open", "high", "low", "close", "volume",
        F.col("_s.bar_id").alias("source_raw_bar_ids"), F.col("_s.bar_index").alias("source_raw_bar_indices"),
        F.array_max("_s.bar_index").alias("visible_at_raw_bar_index"), "merge_direction",
        F.concat(bar_id, F.lit("_r1")).alias("object_id"), merged_logical(F.col("merged_index")).alias("logical_id"), F.lit(1).alias("revision"), F.lit("CONFIRMED").alias("status"),
    )


def provenance_errors(merged: DataFrame, bars: DataFrame) -> DataFrame:
    """Sources that are missing, repeated or can't be resolved: none in a sound result."""
    src = merged.select("symbol", F.explode_outer("source_raw_bar_ids").alias("source"))
    src = src.groupBy("symbol", "source").agg(F.count("*").alias("n"))
    known = bars.select(F.col("symbol").alias("_s"), F.col("bar_id").alias("_b")).distinct()
    x = src.join(known, F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("source") == F.col("_b")), "left")
    reason = F.when(F.col("source").isNull(), "SOURCE_MISSING").when(F.col("n") > 1, "SOURCE_REPEATED").when(F.col("_b").isNull(), "SOURCE_UNKNOWN")
    return x.select("symbol", "source", reason.alias("reason_code")).where("reason_code is not null")


def registry_errors(bars: DataFrame) -> DataFrame:
    """(symbol, bar_id, bar_index, reason_code) of bars that can't be told apart: no id, an id or an
    index that another bar of the symbol has. None are allowed before the merge.
    """
    n = lambda c: F.count("*").over(Window.partitionBy("symbol", c))
    first = F.row_number().over(Window.partitionBy("symbol", "bar_id").orderBy("bar_index"))
    x = bars.select("symbol", "bar_id", "bar_index", n("bar_id").alias("_ids"), n("bar_index").alias("_at"), first.alias("_k"))
    reason = (
        F.when(F.coalesce(F.col("bar_id") == "", F.lit(True)), "RAW_BAR_ID_REQUIRED").when(F.coalesce(F.col("bar_index") < 0, F.lit(True)), "RAW_BAR_INDEX_INVALID")
        .when((F.col("_ids") > 1) & (F.col("_k") > 1), "RAW_BAR_ID_DUPLICATE").when(F.col("_at") > 1, "RAW_BAR_INDEX_DUPLICATE")
    )
    return x.select("symbol", "bar_id", "bar_index", reason.alias("reason_code")).where("reason_code is not null")
