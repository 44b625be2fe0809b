"""Strict swing legs over fractals and merged bars."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.bars import numbered
from barloom.functions.kernels import stroke_fold
from barloom.operators.folding import CHUNK, chunked_fold
from barloom.operators.fractals import identity
from barloom.profile import Profile

DECISIONS = "symbol string, chunk long, start_bar_index long, start_type string, start_price double, end_bar_index long, end_type string, end_price double, outcome string, max_price double, min_price double"


def stroke_decisions(merged: DataFrame, selected: DataFrame, profile: Profile = Profile(), chunk: int = CHUNK) -> DataFrame:
    """Every decision of the stroke fold: accepted strokes, collapsed anchors and rejections.

    The fold reads merged bars in order with their turning points beside them, and keeps running
    extremes since the anchor, so that its state is small whatever the length of a leg.
    """
    points = selected.groupBy(F.col("symbol").alias("_s"), F.col("merged_bar_index").alias("_i")).agg(F.max(F.when(F.col("fractal_type") == "TOP", F.col("price"))).alias("top"), F.max(F.when(F.col("fractal_type") == "BOTTOM", F.col("price"))).alias("bottom"))
    rows = merged.select("symbol", "bar_index", "high", "low").join(points, F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("bar_index") == F.col("_i")), "left").drop("_s", "_i")
    least, extreme = profile.minimum_merged_bar_count, profile.endpoint_extreme_required
    columns = [c.split()[0] for c in DECISIONS.split(", ")][2:]

    def fold(pdf: pd.DataFrame, state: list | None) -> tuple[pd.DataFrame, list | None]:
        price = lambda c: [None if v != v or v is None else float(v) for v in pdf[c].tolist()]
        out, end = stroke_fold(list(zip(pdf["bar_index"].tolist(), pdf["high"].tolist(), pdf["low"].tolist(), price("top"), price("bottom"))), state, least, extreme)
        made = pd.DataFrame(out, columns=columns)
        made.insert(0, "symbol", pdf["symbol"].iloc[0] if len(pdf) else None)
        made.insert(1, "chunk", pdf["chunk"].iloc[0] if len(pdf) else None)
        return made, end

    return chunked_fold(rows, "bar_index", fold, DECISIONS, chunk=chunk).drop("chunk")


def strokes(decisions: DataFrame, merged: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Strokes with status and both time axes.

    A stroke is CONFIRMED if the next one starts where it ends, else PROVISIONAL. Raw visibility is
    that of the merged bar right of an end. Without allow_unconfirmed_tail only CONFIRMED ones stay.
    """
    w = Window.partitionBy("symbol").orderBy("end_bar_index")
    nxt = F.struct("start_bar_index", "start_type", "end_bar_index")
    x = decisions.where("outcome = 'STROKE'").withColumn("_n", F.lead(nxt).over(w))
    x = x.withColumn("_ok", F.coalesce((F.col("_n.start_bar_index") == F.col("end_bar_index")) & (F.col("_n.start_type") == F.col("end_type")), F.lit(False)))
    seen = merged.select(F.col("symbol").alias("_s"), (F.col("bar_index") - 1).alias("_i"), F.col("visible_at_raw_bar_index").alias("_v"))
    x = x.join(seen, F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("end_bar_index") == F.col("_i")), "left").drop("_s", "_i")
    x = x.withColumn("_nv", F.lead("_v").over(w))
    up = F.col("end_type") == "TOP"
    a, b = identity("start_type", "start_bar_index"), identity("end_type", "end_bar_index")
    sid = F.concat(numbered("stroke_", F.col("start_bar_index") + 1), F.lit("_"), numbered("", F.col("end_bar_index") + 1), F.when(up, "_U").otherwise("_D"))
    x = x.select(
        "symbol", sid.alias("stroke_id"), F.when(up, "UP").otherwise("DOWN").alias("direction"),
        a["fractal_id"].alias("start_fractal_id"), b["fractal_id"].alias("end_fractal_id"), "start_price", "end_price", "start_bar_index", "end_bar_index",
        (F.col("end_bar_index") - F.col("start_bar_index") + 1).cast("int").alias("merged_bar_count"), "max_price", "min_price", F.abs(F.col("end_price") - F.col("start_price")).alias("price_range"),
        F.concat(sid, F.lit("_r1")).alias("object_id"), F.concat(F.lit("stroke:"), a["logical_id"], F.lit("->"), b["logical_id"]).alias("logical_id"), F.lit(1).alias("revision"),
        F.when(F.col("_ok"), "CONFIRMED").otherwise("PROVISIONAL").alias("status"), (F.col("end_bar_index") + 1).alias("created_at_bar"), F.when(F.col("_ok"), F.col("_n.end_bar_index")).alias("confirmed_at_bar"),
        F.when(F.col("_ok"), "NONE").otherwise("HIGH").alias("repaint_risk"), F.col("_v").alias("created_at_raw_bar_index"), F.when(F.col("_ok"), F.col("_nv")).alias("confirmed_at_raw_bar_index"),
    )
    return x if profile.allow_unconfirmed_tail else x.where("status = 'CONFIRMED'")


def stroke_sequences(strokes_: DataFrame) -> DataFrame:
    """Confirmed strokes with the islands of contiguous ones that they form (sequence_id)."""
    w = Window.partitionBy("symbol").orderBy("end_bar_index")
    x = strokes_.where("status = 'CONFIRMED'")
    x = x.withColumn("_new", F.when(F.col("start_fractal_id") == F.lag("end_fractal_id").over(w), 0).otherwise(1))
    x = x.withColumn("_i", F.sum("_new").over(w))
    return x.withColumn("sequence_id", F.concat(F.lit("seq:"), F.col("symbol"), F.lit(":"), F.col("_i").cast("string"))).drop("_new", "_i")
