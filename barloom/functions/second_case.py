"""Destruction evidence and the second case as columns over feature elements.

An element is a struct as ``feature_elements`` gives it: element_id, sequence_id, direction, low, high,
visible_at_bar, source_stroke_logical_ids, start, end, high_end, low_end (endpoints are structs
bar_index, defining_stroke_logical_ids, endpoint_id, price) and optionally normalized. Every function
gives a reason where it refuses; results are null then.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.kernels import RULES
from barloom.functions.rules import feature_gap, included, strict_fractal


def first_reason(checks: list[tuple[Column, str | Column]]) -> Column:
    out = F.lit(None).cast("string")
    for condition, code in reversed(checks):
        out = F.when(condition, code).otherwise(out)
    return out


def content_key(body: Column) -> Column:
    """SHA-256 of the JSON of a struct whose fields are in alphabetical order; nulls are kept."""
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)


def endpoint_errors(e: Column) -> Column:
    """Why an endpoint is unsound: ids present and unique, a finite price, a bar that isn't negative."""
    ids = e["defining_stroke_logical_ids"]
    return first_reason([
        (F.coalesce(e["endpoint_id"] == "", F.lit(True)), "ENDPOINT_ID_REQUIRED"),
        (F.coalesce(F.size(ids) < 1, F.lit(True)) | F.exists(ids, lambda x: x.isNull() | (x == "")), "ENDPOINT_PROVENANCE_REQUIRED"),
        (F.size(F.array_distinct(ids)) < F.size(ids), "ENDPOINT_PROVENANCE_DUPLICATE"),
        (~finite(e["price"]), "ENDPOINT_PRICE_INVALID"), (F.coalesce(e["bar_index"] < 0, F.lit(True)), "ENDPOINT_BAR_INVALID"),
    ])


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def interval_errors(low: Column, high: Column, sources: Column) -> Column:
    return first_reason([
        (~finite(low) | ~finite(high), "INTERVAL_NOT_FINITE"), (low > high, "INTERVAL_BOUNDS_INVERTED"),
        (F.coalesce(F.exists(sources, lambda x: x.isNull() | (x == "")), F.lit(False)), "INTERVAL_PROVENANCE_EMPTY"),
        (F.size(F.array_distinct(sources)) < F.size(sources), "INTERVAL_PROVENANCE_DUPLICATE"),
    ])


def element_errors(e: Column) -> Column:
    """Why a feature element is unsound: its interval, its four endpoints, their time and bounds."""
    ends = [e[k] for k in ("start", "end", "high_end", "low_end")]
    return first_reason([
        (F.coalesce((e["element_id"] == "") | (e["sequence_id"] == ""), F.lit(True)), "ELEMENT_ID_REQUIRED"),
        (~F.coalesce(e["direction"].isin("UP", "DOWN"), F.lit(False)), "ELEMENT_DIRECTION_INVALID"),
        (interval_errors(e["low"], e["high"], e["source_stroke_logical_ids"]).isNotNull(), interval_errors(e["low"], e["high"], e["source_stroke_logical_ids"])),
        *[(endpoint_errors(x).isNotNull(), endpoint_errors(x)) for x in ends],
        (e["start"]["bar_index"] > e["end"]["bar_index"], "ELEMENT_TIME_INVERTED"),
        ((e["high_end"]["price"] != e["high"]) | (e["low_end"]["price"] != e["low"]), "ELEMENT_BOUND_MISMATCH"),
        (F.coalesce(e["visible_at_bar"] < e["end"]["bar_index"], F.lit(True)), "ELEMENT_VISIBILITY_INVALID"),
    ])


def merge_refusal(a: Column, b: Column, seed: Column, directions: tuple[Column, Column], crosses: Column) -> Column:
    """Why two included elements can't be merged, in the order of the published guards."""
    shared = F.arrays_overlap(a["source_stroke_logical_ids"], b["source_stroke_logical_ids"])
    bare = (F.size(a["source_stroke_logical_ids"]) < 1) | (F.size(b["source_stroke_logical_ids"]) < 1)
    return first_reason([
        ((a["sequence_id"] != b["sequence_id"]) | (directions[0] != directions[1]), "FS_CROSS_SEQUENCE_REJECTED"), (crosses, "HYPOTHETICAL_BOUNDARY_DIFFERENT_NATURE"),
        (~included((a["low"], a["high"]), (b["low"], b["high"])), "FEATURE_INTERVALS_NOT_INCLUDED"), (seed == "UNSEEDED", "DIRECTION_UNSEEDED"),
        (bare, "FEATURE_PROVENANCE_REQUIRED"), (shared, "DUPLICATE_FEATURE_PROVENANCE"),
    ])


def window_refusal(w: list[Column], sequence_id: Column, provenance: Column, direction: Column, prefix: str) -> Column:
    """Why three elements are no standard window of a sequence; ``prefix`` is PRIMARY or SECOND_SEQUENCE."""
    a, b, c = w
    ids = F.array(*[e["element_id"] for e in w])
    ends = F.array(*[e[k] for e in w for k in ("start", "end", "high_end", "low_end")])
    sources = F.concat(*[e["source_stroke_logical_ids"] for e in w])
    return first_reason([
        (F.size(F.array_distinct(ids)) < 3, f"DUPLICATE_{prefix}_ELEMENT_ID"),
        (~F.forall(F.array(*[e["sequence_id"] for e in w]), lambda x: x.eqNullSafe(sequence_id)), f"{prefix}_ID_MISMATCH"),
        (~F.forall(F.array(*[e["direction"] for e in w]), lambda x: x.eqNullSafe(direction)), f"{prefix}_DIRECTION_MISMATCH"),
        (~F.forall(F.array(*[e["normalized"] for e in w]), lambda x: F.coalesce(x, F.lit(False))), f"{prefix}_NORMALIZATION_REQUIRED"),
        # an id must mean one endpoint: as many different endpoints as different ids
        (F.size(F.array_distinct(ends)) > F.size(F.array_distinct(F.transform(ends, lambda x: x["endpoint_id"]))), f"{prefix}_ENDPOINT_IDENTITY_MISMATCH"),
        (a["end"]["bar_index"] > b["start"]["bar_index"], f"{prefix}_LEFT_CENTER_TIME_OVERLAP"), (b["end"]["bar_index"] > c["start"]["bar_index"], f"{prefix}_CENTER_RIGHT_TIME_OVERLAP"),
        (F.exists(F.array(*[F.size(e["source_stroke_logical_ids"]) for e in w]), lambda n: n < 1), f"{prefix}_PROVENANCE_REQUIRED"),
        (F.size(F.array_distinct(sources)) < F.size(sources), f"DUPLICATE_{prefix}_PROVENANCE"), (sources != provenance, f"{prefix}_PROVENANCE_MISMATCH"),
    ])


def _interval(e: Column) -> tuple[Column, Column]:
    return e["low"], e["high"]


def other(direction: Column) -> Column:
    return F.when(direction == "UP", "DOWN").when(direction == "DOWN", "UP")


def primary_evidence(w: list[Column], direction: Column, sequence_id: Column, provenance: Column) -> Column:
    """Struct of refusal, case, reason_code, fractal_type, endpoint and evidence_key of a primary window."""
    a, b, c = w
    refusal = window_refusal(w, sequence_id, provenance, other(direction), "PRIMARY")
    fractal = strict_fractal(_interval(a), _interval(b), _interval(c))
    found = fractal == F.when(direction == "UP", "TOP").otherwise("BOTTOM")
    gap = feature_gap(_interval(a), _interval(b))
    case = F.when(~found, "NONE").when(gap, "SECOND_CASE_PENDING").otherwise("FIRST_CASE")
    reason = F.when(~found, "FEATURE_FRACTAL_REQUIRED").when(gap, "SECOND_CASE_GAP_PENDING").otherwise("FIRST_CASE_NO_GAP_CONFIRMED")
    end = F.when(found, F.when(direction == "UP", b["high_end"]).otherwise(b["low_end"]))
    body = F.struct(
        direction.alias("candidate_direction"), case.alias("case"), F.array(*[e["element_id"] for e in w]).alias("element_ids"), end.alias("endpoint"), fractal.alias("fractal_type"),
        F.lit("PRIMARY_DESTRUCTION_V1").alias("kind"), F.lit(RULES).alias("rule_version"), sequence_id.alias("sequence_id"),
    )
    ok = lambda x: F.when(refusal.isNull(), x)
    return F.struct(refusal.alias("refusal"), ok(case).alias("case"), ok(reason).alias("reason_code"), ok(fractal).alias("fractal_type"), ok(end).alias("endpoint"), ok(content_key(body)).alias("evidence_key"))


def pending_refusal(evidence: Column, secondary_sequence_id: Column) -> Column:
    """Why no second case can be pending on this evidence."""
    return first_reason([
        (~F.coalesce(evidence["case"] == "SECOND_CASE_PENDING", F.lit(False)), "SECOND_CASE_PENDING_EVIDENCE_REQUIRED"), (evidence["endpoint"].isNull(), "PENDING_ENDPOINT_REQUIRED"),
        (F.coalesce(secondary_sequence_id == "", F.lit(True)), "SECONDARY_SEQUENCE_ID_REQUIRED"),
    ])


def secondary_evidence(w: list[Column], pending: Column, provenance: Column) -> Column:
    """Struct of refusal, reason_code, fractal_type, confirmed_at_bar and evidence_key of a window of the
    second sequence; ``pending`` has evidence_key, endpoint, direction and secondary_sequence_id.
    """
    a, b, c = w
    direction = pending["direction"]
    window = window_refusal(w, pending["secondary_sequence_id"], provenance, direction, "SECOND_SEQUENCE")
    refusal = F.coalesce(window, F.when(~a["start"].eqNullSafe(pending["endpoint"]), "SECOND_SEQUENCE_ENDPOINT_NOT_ADJACENT"))
    fractal = strict_fractal(_interval(a), _interval(b), _interval(c))
    found = fractal == F.when(direction == "UP", "BOTTOM").otherwise("TOP")
    element = lambda e: F.struct(*[e[k].alias(k) for k in ("direction", "element_id", "end", "high", "high_end", "low", "low_end", "normalized", "sequence_id", "source_stroke_logical_ids", "start", "visible_at_bar")])
    body = F.struct(
        c["visible_at_bar"].alias("confirmed_at_bar"), F.array(*map(element, w)).alias("elements"), fractal.alias("fractal_type"), F.lit("SECONDARY_CONFIRMATION_V1").alias("kind"),
        provenance.alias("normalized_source_logical_ids"), pending["endpoint"]["endpoint_id"].alias("pending_endpoint_id"), pending["evidence_key"].alias("primary_evidence_key"),
        F.lit(RULES).alias("rule_version"), pending["secondary_sequence_id"].alias("sequence_id"),
    )
    done = lambda x: F.when(refusal.isNull() & found, x)
    reason = F.when(refusal.isNull(), F.when(found, "SECOND_SEQUENCE_FRACTAL_CONFIRMED").otherwise("SECOND_SEQUENCE_FRACTAL_PENDING"))
    return F.struct(refusal.alias("refusal"), reason.alias("reason_code"), F.when(refusal.isNull(), fractal).alias("fractal_type"), done(c["visible_at_bar"]).alias("confirmed_at_bar"), done(content_key(body)).alias("evidence_key"))


def second_case_outcome(pending: Column, secondary: Column, extreme: Column) -> Column:
    """Struct of refusal, state and reason_code of a pending second case, whatever the order in which
    evidence arrived. ``secondary`` (primary_evidence_key, pending_endpoint_id, secondary_sequence_id,
    fractal_type, confirmed_at_bar) and ``extreme`` (primary_evidence_key, pending_endpoint_id,
    observed_at_bar, price) are null where there is none; both must be bound to the pending evidence.
    """
    end, up = pending["endpoint"], pending["direction"] == "UP"
    has, seen = secondary.isNotNull(), extreme.isNotNull()
    differs = lambda a, b: ~a.eqNullSafe(b)
    refusal = first_reason([
        (has & differs(secondary["primary_evidence_key"], pending["evidence_key"]), "SECONDARY_PRIMARY_EVIDENCE_KEY_MISMATCH"),
        (has & differs(secondary["pending_endpoint_id"], end["endpoint_id"]), "SECONDARY_PENDING_ENDPOINT_MISMATCH"),
        (has & differs(secondary["secondary_sequence_id"], pending["secondary_sequence_id"]), "SECONDARY_SEQUENCE_ID_MISMATCH"),
        (has & differs(secondary["fractal_type"], F.when(up, "BOTTOM").otherwise("TOP")), "SECONDARY_CONFIRMATION_FRACTAL_MISMATCH"),
        (has & F.coalesce(secondary["confirmed_at_bar"] < end["bar_index"], F.lit(True)), "secondary confirmation precedes pending endpoint"),
        (seen & differs(extreme["primary_evidence_key"], pending["evidence_key"]), "EXTREME_PRIMARY_EVIDENCE_KEY_MISMATCH"),
        (seen & differs(extreme["pending_endpoint_id"], end["endpoint_id"]), "EXTREME_PENDING_ENDPOINT_MISMATCH"),
        (seen & F.coalesce(extreme["observed_at_bar"] <= end["bar_index"], F.lit(True)), "extreme evidence must follow pending endpoint"),
    ])
    strict = F.coalesce(F.when(up, extreme["price"] > end["price"]).otherwise(extreme["price"] < end["price"]), F.lit(False))
    wins = has & (~strict | (secondary["confirmed_at_bar"] <= extreme["observed_at_bar"]))
    state = F.when(wins, "SECOND_CASE_CONFIRMED").when(strict, "INVALIDATED").otherwise("SECOND_CASE_PENDING")
    reason = F.when(wins, "SECOND_SEQUENCE_FRACTAL_CONFIRMED").when(strict, "PENDING_DESTRUCTION_INVALIDATED").when(seen, "ORIGINAL_DIRECTION_EXTREME_NOT_STRICT").otherwise("SECOND_CASE_EVIDENCE_PENDING")
    return F.struct(refusal.alias("refusal"), F.when(refusal.isNull(), state).alias("state"), F.when(refusal.isNull(), reason).alias("reason_code"))


def settle(pending, evidence):
    """Outcome of every pending case from a table of evidence in any order: kind (SECONDARY or EXTREME)
    and one of the structs ``secondary`` and ``extreme``, by primary_evidence_key. Two of a kind refuse.

    ``pending`` has evidence_key, endpoint, direction, secondary_sequence_id; evidence is aggregated by
    key first, so that the join is one row to one row.
    """
    by = evidence.groupBy(F.col("primary_evidence_key").alias("_k")).agg(
        F.max("secondary").alias("secondary"), F.max("extreme").alias("extreme"), F.count("secondary").alias("_s"), F.count("extreme").alias("_e"),
    )
    x = pending.join(by, pending["evidence_key"] == F.col("_k"), "left")
    out = second_case_outcome(F.struct(*[F.col(c) for c in ("evidence_key", "endpoint", "direction", "secondary_sequence_id")]), F.col("secondary"), F.col("extreme"))
    doubled = first_reason([(F.coalesce(F.col("_s"), F.lit(0)) > 1, "duplicate secondary confirmation evidence"), (F.coalesce(F.col("_e"), F.lit(0)) > 1, "duplicate original-direction extreme evidence")])
    x = x.withColumn("_o", out).withColumn("refusal", F.coalesce(doubled, F.col("_o.refusal")))
    return x.select(*pending.columns, "refusal", *(F.when(F.col("refusal").isNull(), F.col(f"_o.{c}")).alias(c) for c in ("state", "reason_code")))
