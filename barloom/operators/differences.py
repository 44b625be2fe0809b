"""Differences between two copies of a dataset, by content-defined chunking.

Both sides are spread over the same shards by their key, sorted by key, and cut into chunks where a
rolling hash over the last keys meets a condition, so that cuts move with the content and a missing
row disturbs one or two chunks. Chunks whose fingerprint the other side has too are dropped by an
anti-join; only rows of the remaining chunks are compared, field by field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import stash

TOLERANCE = 0.00005
CHUNK = 16  # mean rows of a chunk
ROLL = 3  # keys in the rolling hash
SHARD_ROWS = 20_000


def _clean(c: str) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _side(df: DataFrame, side: int) -> DataFrame:
    price = lambda c: F.col(c).cast("double").alias(c)
    return df.where(F.col("logical_id").isNotNull() & (_clean("logical_id") != "")).select(
        F.lit(side).alias("side"), "symbol", _clean("logical_id").alias("logical_id"), F.coalesce("revision", F.lit(-1)).alias("revision"),
        price("start_price"), price("end_price"), F.upper(_clean("status")).alias("status"),
    )


def stroke_differences(left: DataFrame, right: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(symbol, logical_id, difference) between two copies of the strokes.

    The highest revision stands for an object on each side (of equal ones the greatest row); rows
    with a null or blank logical_id are left out. Prices differ if more than 0.00005 apart or only
    one is null; two nulls agree, and so do two NaN. Blanks around logical_id and status and the
    case of status don't matter. A null symbol is a symbol of its own. Exact repeats count once;
    other columns are ignored; two empty tables give no difference.
    """
    n = left.count() + right.count()  # from the Parquet footers
    shards = max(8, n // shard_rows)
    rows = _side(left, 0).unionByName(_side(right, 1))
    rows = rows.groupBy("symbol", "logical_id", "side").agg(F.max(F.struct("revision", "start_price", "end_price", "status")).alias("s"))
    rows = rows.select("side", "symbol", "logical_id", "s.start_price", "s.end_price", "s.status", F.pmod(F.xxhash64("symbol", "logical_id"), F.lit(shards)).alias("shard"))

    # equal cells of half the tolerance mean that prices agree; unequal ones only cost a comparison
    cell = lambda c: F.when(F.col(c).isNotNull(), F.round(F.col(c) / TOLERANCE))
    order = Window.partitionBy("shard", "side").orderBy("symbol", "logical_id")
    rows = rows.withColumn("roll", F.sum(F.shiftright(F.xxhash64("symbol", "logical_id"), 8)).over(order.rowsBetween(1 - ROLL, 0)))
    rows = rows.withColumn("chunk", F.sum(F.when(F.pmod("roll", F.lit(CHUNK)) == 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = stash(rows.drop("roll"), "chunked")
    # a hash passes over nulls, so that which facts are null is a fact of its own
    facts = ("symbol", "logical_id", cell("start_price"), cell("end_price"), "status")
    facts = (*facts, *(F.isnull(c) for c in ("symbol", "start_price", "end_price", "status")))
    prints = rows.groupBy("shard", "side", "chunk").agg(
        F.struct(F.count("*"), F.bit_xor(F.xxhash64(*facts)), F.bit_xor(F.xxhash64(F.lit(7), *facts))).alias("print")
    )
    one, two = prints.where("side = 0"), prints.where("side = 1")
    open_ = one.join(two.select("shard", "print"), ["shard", "print"], "left_anti").unionByName(two.join(one.select("shard", "print"), ["shard", "print"], "left_anti"))
    rest = rows.join(open_.select("shard", "side", "chunk"), ["shard", "side", "chunk"], "left_semi")

    kept = F.struct("start_price", "end_price", "status")
    both = rest.groupBy("symbol", "logical_id").agg(F.max(F.when(F.col("side") == 0, kept)).alias("a"), F.max(F.when(F.col("side") == 1, kept)).alias("b"))
    apart = lambda c: ~F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= TOLERANCE, F.lit(False)) & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    found = F.when(F.col("b").isNull(), F.array(F.lit("missing_in_copy"))).when(F.col("a").isNull(), F.array(F.lit("missing_in_strokes"))).otherwise(
        F.filter(
            F.array(
                F.when(apart("start_price"), F.lit("start_price")),
                F.when(apart("end_price"), F.lit("end_price")),
                F.when(~F.col("a.status").eqNullSafe(F.col("b.status")), F.lit("status")),
            ),
            lambda d: d.isNotNull(),
        )
    )
    return both.select("symbol", "logical_id", F.explode(found).alias("difference"))
