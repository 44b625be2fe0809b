"""Lifecycle of segments: intents, binding to strokes, history, idempotent emission, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.bars import numbered, short_hash, text
from barloom.functions.second_case import content_key
from barloom.operators.audit import stroke_hash
from barloom.operators.segments import PROFILE, VERSION, primary_segments

# Outcomes that carry no event, event types, and reasons of the two that a first case has.
ZERO = ["SEGMENT_FEATURE_WINDOW_INCOMPLETE", "SEGMENT_PRIMARY_FRACTAL_NOT_FOUND", "SEGMENT_SECOND_CASE_PENDING"]
FIRST_CASE = "SEGMENT_FIRST_CASE_CONFIRMED"
PAIR = [("OBJECT_CREATED", "SEGMENT_FIRST_CASE_CREATED"), ("OBJECT_CONFIRMED", "SEGMENT_FIRST_CASE_CONFIRMED")]
EVENT = ["event_type", "object_type", "object_id", "logical_id", "occurred_at_bar_id", "reason_code", "rule_profile", "rule_version"]


def segment_hash() -> Column:
    return short_hash(
        "direction", "start_stroke_id", "end_stroke_id", *(F.array_join(c, ",") for c in ("stroke_ids", "feature_stroke_ids", "destruction_stroke_ids")), text("start_price"), text("end_price"),
        F.col("start_bar_index").cast("string"), F.col("end_bar_index").cast("string"), F.lit(PROFILE), F.lit(VERSION),
    )


def binding_key() -> Column:
    """Content address of what ties a segment to its sequence: ids, evidence and strokes."""
    return content_key(F.struct(*[F.col(c) for c in ("destruction_stroke_ids", "element_ids", "evidence_key", "feature_stroke_ids", "logical_id", "sequence_id", "stroke_logical_ids", "symbol")]))


def first_case_intents(segments: DataFrame) -> DataFrame:
    """The two ordered, content-addressed intents of each first case: symbol, sequence_id, place (1, 2),
    the event's fields, detail as JSON, intent_key and binding_key. Other outcomes have none.
    """
    detail = F.struct(
        F.col("destruction_stroke_ids").alias("destruction_evidence_stroke_ids"), F.col("direction"), F.col("end_stroke_id"), F.col("endpoint"), F.col("feature_stroke_ids").alias("feature_sequence_stroke_ids"),
        F.col("fractal_type").alias("feature_fractal_type"), F.col("element_ids").alias("primary_element_logical_ids"), F.col("evidence_key").alias("primary_evidence_key"), F.col("sequence_id").alias("primary_sequence_id"),
        F.col("segment_id"), F.col("start_stroke_id"), F.col("stroke_ids"),
    )
    pair = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(e).alias("event_type"), F.lit(r).alias("reason_code")) for k, (e, r) in enumerate(PAIR, 1)])
    x = segments.where(F.col("outcome") == FIRST_CASE).select(
        "symbol", "sequence_id", "object_id", "logical_id", F.lit("segment").alias("object_type"), numbered("bar_", F.col("confirmed_at_bar") + 1).alias("occurred_at_bar_id"),
        F.lit(PROFILE).alias("rule_profile"), F.lit(VERSION).alias("rule_version"), detail.alias("d"), binding_key().alias("binding_key"), F.explode(pair).alias("e"),
    ).select("*", "e.*")
    body = F.struct(F.col("d").alias("detail"), *[F.col(c) for c in sorted(EVENT)])
    return x.select("symbol", "sequence_id", "place", *EVENT, F.to_json("d", {"ignoreNullFields": "false"}).alias("detail"), F.concat(F.lit("segment_lifecycle:"), F.left(content_key(body), F.lit(24))).alias("intent_key"), "binding_key")


def binding_errors(segments: DataFrame, sequences: DataFrame) -> DataFrame:
    """(symbol, sequence_id, field): what of a first case isn't what its strokes give."""
    fields = ["outcome", "direction", "segment_id", "object_id", "logical_id", "start_price", "end_price", "start_bar_index", "end_bar_index", "stroke_ids", "stroke_logical_ids", "feature_stroke_ids", "destruction_stroke_ids", "confirmed_at_bar", "confirmed_at_raw_bar_index", "evidence_key", "element_ids"]
    fresh = primary_segments(sequences).select(F.col("symbol").alias("_s"), F.col("sequence_id").alias("_q"), F.struct(*fields).alias("_f"))
    x = segments.where(F.col("outcome") == FIRST_CASE).join(fresh, F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("sequence_id") == F.col("_q")), "left")
    bad = F.filter(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_f.{f}")), F.lit(f)) for f in fields]), lambda f: f.isNotNull())
    return x.select("symbol", "sequence_id", F.explode(bad).alias("field"))


def history_errors(history: DataFrame, intents: DataFrame) -> DataFrame:
    """(symbol, logical_id, reason_code): the first reason why kept events of an object contradict its
    intents. History has symbol, seq (order of the log), the event's fields, intent_key, binding_key and
    detail. An event belongs to an object if its key is one of the object's, or if its logical_id or
    object_id matches and it carries a lifecycle reason, key or binding.
    """
    marked = F.col("reason_code").isin([r for _, r in PAIR]) | F.col("intent_key").isNotNull() | F.col("binding_key").isNotNull()
    h = history.where(marked).select(F.col("symbol").alias("h_symbol"), *[F.col(c).alias(f"h_{c}") for c in ("seq", "intent_key", "binding_key", "detail", *EVENT)])
    keys = intents.groupBy("symbol", "logical_id", "object_id").agg(F.map_from_entries(F.collect_list(F.struct("intent_key", F.struct("place", "binding_key", "detail", *EVENT)))).alias("known"))
    same = F.col("symbol").eqNullSafe(F.col("h_symbol"))
    # three equi-joins instead of one with alternatives
    by_key = keys.select("*", F.explode(F.map_keys("known")).alias("k")).join(h, same & (F.col("k") == F.col("h_intent_key"))).drop("k")
    by_id = [keys.join(h, same & (F.col(c) == F.col(f"h_{c}"))) for c in ("logical_id", "object_id")]
    x = by_key.unionByName(by_id[0]).unionByName(by_id[1]).dropDuplicates(["symbol", "logical_id", "h_seq"])
    hit = F.try_element_at("known", F.col("h_intent_key"))
    order = Window.partitionBy("symbol", "logical_id").orderBy("h_seq")
    x = x.withColumns({"hit": hit, "n": F.row_number().over(order), "times": F.row_number().over(Window.partitionBy("symbol", "logical_id", "h_intent_key").orderBy("h_seq"))})
    reason = F.when(F.col("h_detail").isNull(), "SEGMENT_LIFECYCLE_HISTORY_DETAIL_INVALID").when(F.coalesce(F.col("h_intent_key") == "", F.lit(True)), "SEGMENT_LIFECYCLE_HISTORY_INTENT_KEY_MISSING")
    reason = reason.when(F.col("hit").isNull(), "SEGMENT_LIFECYCLE_HISTORY_INTENT_KEY_UNKNOWN").when(F.col("times") > 1, "SEGMENT_LIFECYCLE_HISTORY_INTENT_KEY_DUPLICATE")
    for c in EVENT:
        reason = reason.when(~F.col(f"h_{c}").eqNullSafe(F.col(f"hit.{c}")), f"SEGMENT_LIFECYCLE_HISTORY_CONFLICT:{c}")
    reason = reason.when(~F.col("h_detail").eqNullSafe(F.col("hit.detail")) | ~F.col("h_binding_key").eqNullSafe(F.col("hit.binding_key")), "SEGMENT_LIFECYCLE_HISTORY_CONFLICT:detail")
    reason = reason.when(F.col("hit.place") != F.col("n"), "SEGMENT_LIFECYCLE_HISTORY_NOT_CANONICAL_PREFIX")
    x = x.select("symbol", "logical_id", "h_seq", reason.alias("reason_code")).where("reason_code is not null")
    # of the same object: conflicts come before the order of the whole
    last = F.col("reason_code") == "SEGMENT_LIFECYCLE_HISTORY_NOT_CANONICAL_PREFIX"
    return x.groupBy("symbol", "logical_id").agg(F.min_by("reason_code", F.struct(last, "h_seq")).alias("reason_code"))


def emit(segments: DataFrame, sequences: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events to append and the objects refused (symbol, logical_id, reason_code). Emitting again what
    was emitted appends nothing; an object whose binding or history is unsound appends nothing either.
    """
    intents = first_case_intents(segments)
    loose = binding_errors(segments, sequences).select("symbol", "sequence_id").distinct()
    unbound = intents.join(loose, ["symbol", "sequence_id"], "left_semi").select("symbol", "logical_id").distinct().withColumn("reason_code", F.lit("SEGMENT_LIFECYCLE_SEGMENT_BINDING_MISMATCH"))
    refused = unbound.unionByName(history_errors(history, intents)).groupBy("symbol", "logical_id").agg(F.max("reason_code").alias("reason_code"))
    known = history.where("intent_key is not null").select("symbol", "intent_key").distinct()
    new = intents.join(refused.select("symbol", "logical_id"), ["symbol", "logical_id"], "left_anti").join(known, ["symbol", "intent_key"], "left_anti")
    return new.select(*intents.columns), refused


STATE = [
    "outcome_code", "candidate_direction", "source_stroke_logical_ids", "source_stroke_object_ids", "source_stroke_content_hashes", "source_stroke_semantic_hashes", "segment_id", "segment_object_id",
    "segment_logical_id", "segment_revision", "segment_content_hash", "segment_semantic_hash", "segment_created_at_bar", "segment_confirmed_at_bar", "lifecycle_intent_keys", "lifecycle_binding_key",
    "lifecycle_event_semantic_hashes",
]


def checkpoint_states(segments: DataFrame, sequences: DataFrame, events: DataFrame) -> DataFrame:
    """A semantic envelope for each sequence: symbol, sequence_id, the 17 fields of STATE, state_key over
    them, and refusal. ``events`` are the emitted lifecycle events (as ``first_case_intents``).

    Refused are outcomes without segment that have events, and first cases without both of theirs.
    """
    semantic = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("object_id", "status", "created_at_bar", "confirmed_at_bar", "created_at_raw_bar_index", "confirmed_at_raw_bar_index")]), 256)
    rows = F.array_sort(F.collect_list(F.struct(F.col("start_bar_index").alias("i"), "logical_id", "object_id", stroke_hash().alias("c"), semantic.alias("m"), "direction")))
    src = sequences.groupBy(F.col("symbol").alias("_s"), F.col("sequence_id").alias("_q")).agg(rows.alias("r"))
    ev = events.groupBy(F.col("symbol").alias("_es"), F.col("sequence_id").alias("_eq")).agg(
        F.array_sort(F.collect_list(F.struct("place", "event_type", "intent_key", "binding_key", F.sha2(F.concat_ws("|", *EVENT, "detail", "intent_key", "binding_key"), 256).alias("h")))).alias("e"),
    )
    x = segments.join(src, F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("sequence_id") == F.col("_q"))).join(ev, F.col("symbol").eqNullSafe(F.col("_es")) & (F.col("sequence_id") == F.col("_eq")), "left")
    first = F.col("outcome") == FIRST_CASE
    made = lambda c: F.when(first, c)
    none = F.array().cast("array<string>")
    pair = F.col("e.event_type") == F.array(*[F.lit(t) for t, _ in PAIR])
    refusal = (
        F.when(~first & ~F.col("outcome").isin(ZERO), "SEGMENT_CHECKPOINT_OUTCOME_UNSUPPORTED")
        .when(~F.col("direction").eqNullSafe(F.col("r")[0]["direction"]), "SEGMENT_CHECKPOINT_CANDIDATE_SOURCE_DIRECTION_MISMATCH")
        .when(~first & F.col("segment_id").isNotNull(), "SEGMENT_CHECKPOINT_ZERO_EVENT_OUTCOME_HAS_SEGMENT")
        .when(~first & F.col("e").isNotNull(), "SEGMENT_CHECKPOINT_ZERO_EVENT_OUTCOME_HAS_EVENTS")
        .when(first & ~F.coalesce(pair, F.lit(False)), "SEGMENT_CHECKPOINT_LIFECYCLE_INCOMPLETE")
    )
    fields = {
        "outcome_code": F.col("outcome"), "candidate_direction": F.col("direction"), "source_stroke_logical_ids": F.col("r.logical_id"), "source_stroke_object_ids": F.col("r.object_id"),
        "source_stroke_content_hashes": F.col("r.c"), "source_stroke_semantic_hashes": F.col("r.m"), "segment_id": F.col("segment_id"), "segment_object_id": made(F.col("object_id")), "segment_logical_id": made(F.col("logical_id")),
        "segment_revision": made(F.lit(1)), "segment_content_hash": made(segment_hash()), "segment_semantic_hash": made(binding_key()), "segment_created_at_bar": made(F.col("confirmed_at_bar")),
        "segment_confirmed_at_bar": made(F.col("confirmed_at_bar")), "lifecycle_intent_keys": F.coalesce(F.col("e.intent_key"), none), "lifecycle_binding_key": F.col("e")[0]["binding_key"],
        "lifecycle_event_semantic_hashes": F.coalesce(F.col("e.h"), none),
    }
    x = x.select("symbol", "sequence_id", refusal.alias("refusal"), *[F.when(refusal.isNull(), fields[c]).alias(c) for c in STATE])
    return x.withColumn("state_key", F.when(F.col("refusal").isNull(), content_key(F.struct(*sorted(STATE)))))


def checkpoint_errors(stored: DataFrame, segments: DataFrame, sequences: DataFrame, events: DataFrame) -> DataFrame:
    """(symbol, sequence_id, reason_code, fields): stored envelopes that a fresh derivation doesn't give."""
    fields = [*STATE, "state_key"]
    fresh = checkpoint_states(segments, sequences, events).select(F.col("symbol").alias("_s"), F.col("sequence_id").alias("_q"), F.col("refusal").alias("_r"), F.struct(*fields).alias("_f"))
    x = stored.join(fresh, F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("sequence_id") == F.col("_q")), "left")
    bad = F.filter(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_f.{f}")), F.lit(f)) for f in fields]), lambda f: f.isNotNull())
    return x.select("symbol", "sequence_id", F.coalesce("_r", F.lit("SEGMENT_CHECKPOINT_STATE_MISMATCH")).alias("reason_code"), bad.alias("fields")).where("size(fields) > 0")
