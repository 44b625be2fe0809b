"""Three-bar turning points over merged bars, by windows only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.bars import merged_logical, numbered
from barloom.profile import Profile

BUCKET = 8192


def _with_neighbours(merged: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """prev and next (high, low) of each merged bar, in buckets of bar numbers: numbers have no
    gaps, so a bucket needs just one bar of its neighbours on either side.
    """
    x = merged.select("symbol", "bar_index", "high", "low", F.floor(F.col("bar_index") / bucket).alias("own"))
    at = F.col("bar_index") % bucket
    places = F.filter(F.array(F.col("own"), F.when(at == 0, F.col("own") - 1), F.when(at == bucket - 1, F.col("own") + 1)), lambda b: b.isNotNull())
    x = x.withColumn("bucket", F.explode(places))
    w = Window.partitionBy("symbol", "bucket").orderBy("bar_index")
    bar = F.struct("high", "low")
    return x.withColumns({"prev": F.lag(bar).over(w), "next": F.lead(bar).over(w)}).where("bucket = own").drop("bucket", "own")


def fractal_candidates(merged: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """(symbol, merged_bar_index, fractal_type, price): TOP and BOTTOM may both fall on one bar."""
    x = _with_neighbours(merged).where("prev is not null and next is not null")
    if profile.allow_equal_high:
        top = F.expr("(high >= prev.high and high > next.high and low >= prev.low and low > next.low) or (high > prev.high and high >= next.high and low > prev.low and low >= next.low)")
    else:
        top = F.expr("high > prev.high and high > next.high")
    if profile.allow_equal_low:
        bottom = F.expr("(low <= prev.low and low < next.low and high <= prev.high and high < next.high) or (low < prev.low and low <= next.low and high < prev.high and high <= next.high)")
    else:
        bottom = F.expr("low < prev.low and low < next.low")
    kinds = F.filter(F.array(F.when(top, F.struct(F.lit("TOP").alias("t"), F.col("high").alias("p"))), F.when(bottom, F.struct(F.lit("BOTTOM").alias("t"), F.col("low").alias("p")))), lambda k: k.isNotNull())
    return x.select("symbol", F.col("bar_index").alias("merged_bar_index"), F.explode(kinds).alias("k")).select("symbol", "merged_bar_index", F.col("k.t").alias("fractal_type"), F.col("k.p").alias("price"))


def _ranked(candidates: DataFrame) -> DataFrame:
    """Adds the run of equal types, the best earlier price of the run, and whether a row wins it."""
    order = [F.col("merged_bar_index"), F.col("fractal_type").desc()]  # TOP before BOTTOM on one bar
    w = Window.partitionBy("symbol").orderBy(*order)
    x = candidates.withColumn("new", F.when(F.col("fractal_type") == F.lag("fractal_type").over(w), 0).otherwise(1))
    x = x.withColumn("run", F.sum("new").over(w)).drop("new")
    x = x.withColumn("sign", F.when(F.col("fractal_type") == "TOP", 1.0).otherwise(-1.0))
    run = Window.partitionBy("symbol", "run")
    best = F.row_number().over(run.orderBy((F.col("price") * F.col("sign")).desc(), "merged_bar_index"))
    earlier = run.orderBy("merged_bar_index").rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumns({"rank": best, "before": F.max(F.struct(F.col("price") * F.col("sign"), -F.col("merged_bar_index"))).over(earlier)})


def identity(kind: str, index: str) -> dict:
    """Columns of a fractal's names, from its type and merged bar number."""
    i, t = F.col(index), F.col(kind)
    fid = F.concat(numbered("fx_", i + 1), F.lit("_"), F.left(t, F.lit(1)))
    return {"fractal_id": fid, "logical_id": F.concat(F.lit("fractal:"), F.lower(t), F.lit(":"), merged_logical(i))}


def fractals(candidates: DataFrame) -> DataFrame:
    """Winners of runs of equal types: the most extreme, the earliest of ties. All but the last of
    a series are CONFIRMED at their own right bar, the last is PROVISIONAL.
    """
    x = _ranked(candidates).where("rank = 1")
    last = F.lead("run").over(Window.partitionBy("symbol").orderBy("run")).isNull()
    names = identity("fractal_type", "merged_bar_index")
    i = F.col("merged_bar_index")
    return x.select(
        "symbol", names["fractal_id"].alias("fractal_id"), "fractal_type", numbered("mbar_", i + 1).alias("merged_bar_id"), i, "price",
        numbered("mbar_", i).alias("left_bar_id"), numbered("mbar_", i + 2).alias("right_bar_id"), F.array(i - 1, i, i + 1).alias("window_indices"),
        F.concat(names["fractal_id"], F.lit("_r1")).alias("object_id"), names["logical_id"].alias("logical_id"), F.lit(1).alias("revision"),
        F.when(last, "PROVISIONAL").otherwise("CONFIRMED").alias("status"), (i + 1).alias("created_at_bar"), F.when(~last, i + 1).alias("confirmed_at_bar"),
        F.when(last, "HIGH").otherwise("NONE").alias("repaint_risk"),
    )


def fractal_replacements(candidates: DataFrame) -> DataFrame:
    """A row for each loser of a run: (symbol, loser and winner number, type, number that showed it)."""
    x = _ranked(candidates).where("before is not null")
    mine = F.col("price") * F.col("sign")
    wins = mine > F.col("before.col1")
    rival = -F.col("before.col2")
    i = F.col("merged_bar_index")
    return x.select("symbol", "fractal_type", F.when(wins, rival).otherwise(i).alias("loser_index"), F.when(wins, i).otherwise(rival).alias("winner_index"), i.alias("seen_at_index"))
