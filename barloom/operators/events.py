"""Lifecycle events of all structures, their numbering, and idempotent appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.bars import numbered
from barloom.operators.fractals import fractal_replacements, identity

COLUMNS = ["symbol", "stage", "ord", "sub", "event_type", "object_type", "object_id", "logical_id", "occurred_at_bar_id", "reason_code", "replaced_by"]


def _events(df: DataFrame, stage: int, order: Column, kinds: list[tuple[Column | None, str, str, str | Column]], object_id: Column, logical_id: Column, at: Column, replaced_by: Column | None = None) -> DataFrame:
    rows = [F.when(F.lit(True) if when is None else when, F.struct(F.lit(k).alias("sub"), F.lit(e).alias("event_type"), F.lit(o).alias("object_type"), (r if isinstance(r, Column) else F.lit(r)).alias("reason_code"))) for k, (when, e, o, r) in enumerate(kinds)]
    x = df.select("symbol", F.lit(stage).alias("stage"), order.cast("long").alias("ord"), object_id.alias("object_id"), logical_id.alias("logical_id"), at.alias("occurred_at_bar_id"), (replaced_by if replaced_by is not None else F.lit(None).cast("string")).alias("replaced_by"), F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("e"))
    return x.select("*", "e.*").select(*COLUMNS)


def structure_events(merged: DataFrame, candidates: DataFrame, selected: DataFrame, decisions: DataFrame, strokes: DataFrame) -> DataFrame:
    """All events of a batch run, unnumbered: stage (merged, fractal, stroke), then emission order."""
    out = _events(
        merged, 1, F.col("bar_index"), [(None, "OBJECT_CREATED", "merged_bar", "INCLUSION_NORMALIZED"), (None, "OBJECT_CONFIRMED", "merged_bar", "MERGED_BAR_FINALIZED")],
        F.col("object_id"), F.col("logical_id"), F.element_at("source_raw_bar_ids", -1),
    )
    i = F.col("merged_bar_index")
    second = F.when(F.col("fractal_type") == "BOTTOM", 1).otherwise(0)
    names = identity("fractal_type", "merged_bar_index")
    out = out.unionByName(_events(candidates, 2, i * 2 + second, [(None, "OBJECT_CREATED", "fractal", "THREE_BAR_PATTERN_DETECTED")], F.concat(names["fractal_id"], F.lit("_r1")), names["logical_id"], numbered("mbar_", i + 2)))
    lost, won = identity("fractal_type", "loser_index"), identity("fractal_type", "winner_index")
    out = out.unionByName(_events(fractal_replacements(candidates), 3, F.col("seen_at_index") * 2 + second, [(None, "STRUCTURE_REPLACED", "fractal", "SAME_TYPE_MORE_EXTREME")], F.concat(lost["fractal_id"], F.lit("_r1")), lost["logical_id"], numbered("mbar_", F.col("seen_at_index") + 2), F.concat(won["fractal_id"], F.lit("_r1"))))
    done = F.col("status") == "CONFIRMED"
    out = out.unionByName(_events(selected, 4, i * 2 + second, [(done, "OBJECT_CONFIRMED", "fractal", "NEXT_ACTIVE_FRACTAL_OBSERVED"), (~done, "STATUS_CHANGED", "fractal", "TAIL_FRACTAL_PROVISIONAL")], F.col("object_id"), F.col("logical_id"), F.col("right_bar_id")))
    # a decision that isn't a stroke rejects a candidate, or the weaker of two anchors
    end = F.col("end_bar_index")
    place = end * 2 + F.when(F.col("end_type") == "BOTTOM", 1).otherwise(0)
    a, b = identity("start_type", "start_bar_index"), identity("end_type", "end_bar_index")
    collapsed = F.col("outcome") == "SAME_TYPE_ANCHOR_COLLAPSED"
    wins = F.when(F.col("end_type") == "TOP", F.col("end_price") > F.col("start_price")).otherwise(F.col("end_price") < F.col("start_price"))
    loser = F.when(collapsed & wins, a["logical_id"]).otherwise(b["logical_id"])
    rejected = decisions.where("outcome <> 'STROKE'").select("*", loser.alias("_l"), F.when(collapsed, F.when(wins, b["fractal_id"]).otherwise(a["fractal_id"])).alias("_w"))
    out = out.unionByName(_events(rejected, 5, place, [(None, "CANDIDATE_REJECTED", "stroke_candidate", F.col("outcome"))], F.concat(F.lit("stroke_anchor:"), F.col("_l")), F.concat(F.lit("stroke_candidate:"), F.col("_l")), numbered("mbar_", end + 2), F.concat("_w", F.lit("_r1"))))
    after = F.lead("end_bar_index").over(Window.partitionBy("symbol").orderBy("end_bar_index"))
    s = strokes.withColumn("_after", after)
    seen = numbered("mbar_", end + 2)
    out = out.unionByName(_events(s, 5, place.cast("long") if "end_type" in s.columns else end * 2 + F.when(F.col("direction") == "UP", 0).otherwise(1), [(None, "OBJECT_CREATED", "stroke", "STRICT_STROKE_VALID")], F.col("object_id"), F.col("logical_id"), seen))
    confirmed = s.where(done)
    later = F.col("confirmed_at_bar") * 2 + F.when(F.col("direction") == "UP", 1).otherwise(0)
    return out.unionByName(_events(confirmed, 5, later, [(None, "OBJECT_CONFIRMED", "stroke", "NEXT_STRICT_STROKE_CONFIRMED")], F.col("object_id"), F.col("logical_id"), numbered("mbar_", F.col("confirmed_at_bar") + 2)).withColumn("sub", F.lit(1)))


def number_events(events: DataFrame) -> DataFrame:
    """event_id in stage-major emission order, from 1 for each symbol."""
    stage = F.when(F.col("stage") <= 1, 1).when(F.col("stage") <= 4, 2).otherwise(3)
    w = Window.partitionBy("symbol").orderBy(stage, "stage", "ord", "sub", "event_type", "object_id")
    n = F.row_number().over(w)
    return events.select("symbol", F.concat(F.lit("evt_"), F.lpad(n.cast("string"), 8, "0")).alias("event_id"), *[c for c in COLUMNS if c not in ("symbol", "stage", "ord", "sub")])


def events_of(log: DataFrame, object_id: str | None = None, logical_id: str | None = None, event_type: str | None = None) -> DataFrame:
    """Events of one object, of all revisions of one, or of one type; several conditions must all hold."""
    for c, v in (("object_id", object_id), ("logical_id", logical_id), ("event_type", event_type)):
        if v is not None:
            log = log.where(F.col(c) == v)
    return log


def rebuild_events(bounds: DataFrame) -> DataFrame:
    """The pair of events of each local rebuild (symbol, from_bar, to_bar, affected array of ids)."""
    pair = F.array(
        F.struct(F.lit("LOCAL_REBUILD_START").alias("event_type"), F.lit("DEPENDENCY_INVALIDATION").alias("reason_code"), numbered("bar_", F.col("from_bar") + 1).alias("occurred_at_bar_id"), F.to_json(F.struct(F.col("affected").alias("affected_objects"), F.col("from_bar").alias("rebuild_from_bar"), F.col("to_bar").alias("rebuild_to_bar"))).alias("detail")),
        F.struct(F.lit("LOCAL_REBUILD_END").alias("event_type"), F.lit("REBUILD_COMPLETE").alias("reason_code"), numbered("bar_", F.col("to_bar") + 1).alias("occurred_at_bar_id"), F.to_json(F.struct(F.col("from_bar").alias("rebuild_from_bar"), F.col("to_bar").alias("rebuild_to_bar"))).alias("detail")),
    )
    return bounds.select("symbol", F.lit("engine").alias("object_type"), F.lit("incremental_engine").alias("object_id"), F.explode(pair).alias("e")).select("symbol", "object_type", "object_id", "e.*")
