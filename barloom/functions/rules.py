"""Interval and segment rules as column expressions. Intervals are closed: (low, high) columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Interval = tuple[Column, Column]


def interval_relation(a: Interval, b: Interval) -> Column:
    (al, ah), (bl, bh) = a, b
    return (
        F.when((al == bl) & (ah == bh), "EQUAL")
        .when((al <= bl) & (ah >= bh), "CONTAINS")
        .when((bl <= al) & (bh >= ah), "CONTAINED_BY")
        .when((ah == bl) | (bh == al), "TOUCHING")
        .when((ah < bl) | (bh < al), "DISJOINT")
        .otherwise("OVERLAP")
    )


def feature_gap(a: Interval, b: Interval) -> Column:
    return (a[1] < b[0]) | (b[1] < a[0])


def included(a: Interval, b: Interval) -> Column:
    return interval_relation(a, b).isin("EQUAL", "CONTAINS", "CONTAINED_BY")


def inclusion_seed(a: Interval, b: Interval) -> Column:
    up, down = (b[1] > a[1]) & (b[0] > a[0]), (b[1] < a[1]) & (b[0] < a[0])
    return F.when(up, "UP").when(down, "DOWN").otherwise("UNSEEDED")


def merge_intervals(a: Interval, b: Interval, seed: Column) -> tuple[Column, Column, Column]:
    """Merged low and high, and the reason why there are none."""
    reason = F.when(~included(a, b), "FEATURE_INTERVALS_NOT_INCLUDED").when(seed == "UNSEEDED", "DIRECTION_UNSEEDED")
    low = F.when(reason.isNull(), F.when(seed == "UP", F.greatest(a[0], b[0])).otherwise(F.least(a[0], b[0])))
    high = F.when(reason.isNull(), F.when(seed == "UP", F.greatest(a[1], b[1])).otherwise(F.least(a[1], b[1])))
    return low, high, reason


def strict_fractal(a: Interval, b: Interval, c: Interval) -> Column:
    top = (b[1] > a[1]) & (b[1] > c[1]) & (b[0] > a[0]) & (b[0] > c[0])
    bottom = (b[1] < a[1]) & (b[1] < c[1]) & (b[0] < a[0]) & (b[0] < c[0])
    return F.when(top, "TOP").when(bottom, "BOTTOM").otherwise("NONE")


def primary_destruction(direction: Column, a: Interval, b: Interval, c: Interval) -> tuple[Column, Column]:
    """Case of a window of three standard elements, and the price where the segment would end."""
    found = strict_fractal(a, b, c) == F.when(direction == "UP", "TOP").otherwise("BOTTOM")
    case = F.when(~found, "NONE").when(feature_gap(a, b), "SECOND_CASE_PENDING").otherwise("FIRST_CASE")
    return case, F.when(found, F.when(direction == "UP", b[1]).otherwise(b[0]))


def second_case_state(confirmed_at: Column, strict_extreme: Column, observed_at: Column) -> tuple[Column, Column]:
    """State and reason of a pending second case from bound evidence; ``second_case`` checks the binding."""
    extreme = F.coalesce(strict_extreme, F.lit(False))
    wins = confirmed_at.isNotNull() & (~extreme | (confirmed_at <= observed_at))
    state = F.when(wins, "SECOND_CASE_CONFIRMED").when(extreme, "INVALIDATED").otherwise("SECOND_CASE_PENDING")
    reason = (
        F.when(wins, "SECOND_SEQUENCE_FRACTAL_CONFIRMED").when(extreme, "PENDING_DESTRUCTION_INVALIDATED")
        .when(strict_extreme.isNotNull(), "ORIGINAL_DIRECTION_EXTREME_NOT_STRICT").otherwise("SECOND_CASE_EVIDENCE_PENDING")
    )
    return state, reason


def confirmation_bar(endpoint: Column, visible: Column) -> tuple[Column, Column]:
    """Bar of confirmation from an array of visibility bars, and the reason why there is none."""
    last = F.array_max(visible)
    reason = F.when(F.size(visible) < 1, "VISIBILITY_REQUIRED").when((endpoint < 0) | (F.array_min(visible) < 0), "NEGATIVE_BAR").when(last < endpoint, "CONFIRMATION_TIME_BACKFILL_FORBIDDEN")
    return F.when(reason.isNull(), last), reason


def lifecycle(window: Column, provisional: Column, previously: Column, complete: Column, invalidated: Column, reverse_id: Column, reverse: Column) -> tuple[Column, Column]:
    """State of a candidate from its evidence flags, and the reason for contradictory flags."""
    has = reverse_id.isNotNull()
    any_ = provisional | complete | invalidated | previously | reverse | has
    reason = (
        F.when(has & ~reverse, "REVERSE_NOT_CONFIRMED")
        .when(~window, F.when(any_, "LIFECYCLE_EVIDENCE_WITHOUT_CANDIDATE").otherwise("NO_CANDIDATE_LIFECYCLE_FORBIDDEN"))
        .when((provisional & complete) | (complete & invalidated) | (provisional & invalidated), "CONTRADICTORY_EVIDENCE")
        .when(reverse & ~has, "REVERSE_ID_REQUIRED")
        .when(previously & (~complete | provisional), "CONFIRMED_REQUIRES_COMPLETE_EVIDENCE")
        .when(~previously & has, "REPLACED_REQUIRES_CONFIRMED")
    )
    state = (
        F.when(previously, F.when(has, "REPLACED").otherwise("CONFIRMED"))
        .when(invalidated, "INVALIDATED")
        .when(complete, "CONFIRMED")
        .when(provisional, "PROVISIONAL")
        .otherwise("CANDIDATE")
    )
    return F.when(reason.isNull(), state), reason


def failed_pen_break(observed: Column, formed: Column, countered: Column) -> tuple[Column, Column]:
    state = F.when(~observed, "NONE").when(formed, F.lit(None)).when(countered, "INVALIDATED").otherwise("NONE")
    reason = F.when(~observed, "PEN_BREAK_NOT_OBSERVED").when(formed, "COMPLETED_FRACTAL").when(countered, "PEN_BREAK_EVIDENCE_INVALIDATED").otherwise("PEN_BREAK_PROVISIONAL")
    return state, reason


def arbitrate(candidates: DataFrame, group: str = "pool") -> DataFrame:
    """Outcome of each candidate (endpoint, start, logical_id, exclusivity) of a pool: the earliest
    endpoint, start and id wins; others of its exclusivity group are invalidated, the rest remain.
    """
    first = Window.partitionBy(group)
    key = F.struct("endpoint", "start", "logical_id", "exclusivity")
    x = candidates.withColumn("_w", F.min(key).over(first))
    outcome = F.when(F.col("_w.logical_id") == F.col("logical_id"), "WINNER").when(F.col("_w.exclusivity").eqNullSafe(F.col("exclusivity")), "INVALIDATED").otherwise("REMAINS")
    return x.withColumn("outcome", outcome).drop("_w")


# The profile that keys of candidates name, and the schemes of their identity.
CONTRACT = ["minimal_segment_contract_v1", "0.1.0", "CONTRACT_ONLY", "logical_id_and_content_hash"]


def _records(strokes: list[Column], prefix: str) -> list[tuple[Column, str]]:
    checks = []
    for s in strokes:
        checks.append((F.coalesce(s["stroke_id"] == "", F.lit(True)), f"{prefix}_STROKE_ID_REQUIRED"))
        checks.append((F.coalesce(s["logical_id"] == "", F.lit(True)), f"{prefix}_LOGICAL_ID_REQUIRED"))
        checks.append((F.coalesce((s["start_bar_index"] < 0) | (s["end_bar_index"] <= s["start_bar_index"]), F.lit(True)), f"{prefix}_STROKE_BAR_RANGE_INVALID"))
    if len(strokes) > 1:
        checks.append((F.size(F.array_distinct(F.array(*[s["logical_id"] for s in strokes]))) < len(strokes), f"{prefix}_DUPLICATE_STROKE_ID"))
    return checks


def _sequence(strokes: list[Column], prefix: str) -> list[tuple[Column, str]]:
    checks = []
    for a, b in zip(strokes, strokes[1:]):
        checks.append((a["direction"] == b["direction"], f"{prefix}_DIRECTION_NOT_ALTERNATING"))
        checks.append((~a["end_fractal_id"].eqNullSafe(b["start_fractal_id"]) | ~a["end_bar_index"].eqNullSafe(b["start_bar_index"]), f"{prefix}_ENDPOINT_NOT_CONTIGUOUS"))
        checks.append((b["end_bar_index"] <= a["end_bar_index"], f"{prefix}_BAR_ORDER_INVALID"))
    return checks


def candidate_contract(w: list[Column], target: str, evidence: list[Column] = (), identity: tuple[str, ...] = tuple(CONTRACT)) -> Column:
    """Struct of reason_code, accepted, candidate_key, evidence_key, direction, feature_stroke_ids and
    earliest_bar of a window of strokes (structs with stroke_id, logical_id, direction, fractal ids, bars,
    status and content hash) for a target status. It never makes a segment. A null evidence stroke
    stands for evidence that is missing.
    """
    confirmed = target == "CONFIRMED"
    given = F.lit(bool(evidence)) if not evidence else evidence[0].isNotNull()
    sure = lambda s: F.coalesce(s["status"] == "CONFIRMED", F.lit(False))
    if target not in ("CANDIDATE", "PROVISIONAL", "CONFIRMED"):
        checks = [(F.lit(True), "SEGMENT_TARGET_STATUS_UNSUPPORTED")]
    else:
        checks = [(given & F.lit(not confirmed), "SEGMENT_DESTRUCTION_EVIDENCE_NOT_ALLOWED_FOR_TARGET"), (F.lit(len(w) < 3), "SEGMENT_MINIMUM_STROKES"), (F.lit(len(w) % 2 == 0), "SEGMENT_ODD_STROKE_COUNT_REQUIRED")]
        checks += _records(w, "SEGMENT") + _sequence(w, "SEGMENT_STROKE") + [(w[0]["direction"] != w[-1]["direction"], "SEGMENT_FIRST_LAST_DIRECTION_MISMATCH")]
        if confirmed:
            checks += [(~sure(s), "SEGMENT_UNCONFIRMED_WINDOW_STROKE") for s in w] + [(~given, "SEGMENT_DESTRUCTION_EVIDENCE_REQUIRED")]
            if evidence:
                own = F.array(*[s["logical_id"] for s in w])
                checks += _records(evidence, "SEGMENT_DESTRUCTION_EVIDENCE")
                for e in evidence:
                    checks += [(F.array_contains(own, e["logical_id"]), "SEGMENT_DESTRUCTION_EVIDENCE_REUSES_WINDOW"), (~sure(e), "SEGMENT_DESTRUCTION_EVIDENCE_UNCONFIRMED")]
                checks += [(evidence[0]["start_bar_index"] < w[-1]["end_bar_index"], "SEGMENT_DESTRUCTION_EVIDENCE_TOO_EARLY")] + _sequence([w[-1], *evidence], "SEGMENT_DESTRUCTION_EVIDENCE")
        else:
            checks += [(~sure(s), "SEGMENT_ONLY_TAIL_MAY_BE_PROVISIONAL") for s in w[:-1]] + [(~sure(w[-1]) & ~F.coalesce(w[-1]["status"] == "PROVISIONAL", F.lit(False)), "SEGMENT_TAIL_STATUS_INVALID")]
    reason = F.lit("SEGMENT_CONTRACT_ELIGIBLE")
    for condition, code in reversed(checks):
        reason = F.when(condition, code).otherwise(reason)
    named = lambda s: F.concat(s["logical_id"], F.lit(":"), s["content_hash"])
    key = F.left(F.sha2(F.concat_ws("|", *map(F.lit, identity), *map(named, w)), 256), F.lit(20))
    proof = F.left(F.sha2(F.concat_ws("|", key, F.lit("destruction_evidence_content_hash"), *map(named, evidence)), 256), F.lit(20))
    ok = reason == "SEGMENT_CONTRACT_ELIGIBLE"
    return F.struct(
        reason.alias("reason_code"), ok.alias("accepted"), F.when(ok, key).alias("candidate_key"), F.when(ok & F.lit(confirmed), proof).alias("evidence_key"), F.when(ok, w[0]["direction"]).alias("direction"),
        F.when(ok, F.array(*[s["stroke_id"] for s in w[1::2]])).alias("feature_stroke_ids"), F.when(ok & F.lit(confirmed), (evidence[-1] if evidence else w[-1])["end_bar_index"]).alias("earliest_bar"),
    )


def boundary_errors(segments: DataFrame) -> DataFrame:
    """Adds reason_code: why a confirmed segment can't follow the one before it in its symbol, null
    if it can. Needs logical_id, direction, start and end endpoint ids, and start_bar_index; where the
    column destroyer_direction is given, what destroys a segment must run against it.
    """
    w = Window.partitionBy("symbol").orderBy("start_bar_index", "logical_id")
    x = segments.withColumn("_p", F.lag(F.struct("logical_id", "direction", "end_endpoint_id")).over(w))
    filled = [F.coalesce(F.col(c) != "", F.lit(False)) for c in ("logical_id", "start_endpoint_id", "end_endpoint_id")]
    sound = filled[0] & filled[1] & filled[2] & F.coalesce(F.col("direction").isin("UP", "DOWN"), F.lit(False))
    reason = (
        F.when(~sound, "SG_DIRECTION_OR_ENDPOINT_INVALID")
        .when(F.col("_p.logical_id") == F.col("logical_id"), "SG_DUPLICATE_ADJACENT_LOGICAL_ID")
        .when(F.col("_p.direction") == F.col("direction"), "SG_ADJACENT_DIRECTION_NOT_ALTERNATING")
        .when(F.col("_p.end_endpoint_id") != F.col("start_endpoint_id"), "SG_ADJACENT_ENDPOINT_NOT_SHARED")
    )
    if "destroyer_direction" in segments.columns:
        reason = reason.when(F.col("destroyer_direction") == F.col("direction"), "SG_DESTROYER_DIRECTION_INVALID")
    return x.withColumn("reason_code", reason).drop("_p")


def prefix_transition(before_hash: Column, after_hash: Column, before_n: Column, after_n: Column, was: Column, now: Column, corrected: Column) -> Column:
    """Why a later snapshot of a frozen prefix is not allowed, null if it is."""
    present = F.coalesce((before_hash != "") & (after_hash != ""), F.lit(False))
    counts = F.coalesce(F.least(before_n, after_n, was, now) >= 0, F.lit(False)) & before_n.isNotNull() & after_n.isNotNull() & was.isNotNull() & now.isNotNull()
    return (
        F.when(~present, "FROZEN_PREFIX_HASH_REQUIRED")
        .when(~counts, "FROZEN_PREFIX_COUNTERS_INVALID")
        .when(before_hash != after_hash, "FROZEN_PREFIX_REWRITE_FORBIDDEN")
        .when(after_n < before_n, "LIFECYCLE_EVENT_DELETION_FORBIDDEN")
        .when(now < was, "CONFIRMATION_TIME_BACKFILL_FORBIDDEN")
        .when((now != was) & ~corrected, "CORRECTION_FLAG_REQUIRED")
        .when(corrected & (after_n <= before_n), "CORRECTION_EVENT_APPEND_REQUIRED")
    )
