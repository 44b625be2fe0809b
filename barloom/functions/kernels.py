"""The sequential folds, without Spark: containment merge, strokes and feature normalisation.

Each takes the state where a stretch of a series begins and returns the state where it ends, so
that batch chunks and streaming batches run the same code.
"""

from __future__ import annotations

import hashlib
import json

UP, DOWN = 1, -1


def merge_fold(high: list[float], low: list[float], state: list | None, strict: bool = True) -> tuple[list[int], list[int], list | None]:
    """Flags of bars that begin a merged bar, directions, and the end state [high, low, direction].

    Bars are compared with the last merged bar only. A contained bar joins it in the direction at
    hand; another one sets the direction, if both bounds moved the same way, and begins a new one.
    """
    n = len(high)
    new, dirs = [1] * n, [UP] * n
    if state is None:
        d = DOWN if n > 1 and high[1] < high[0] and low[1] < low[0] else UP
        h = l = None
    else:
        h, l, d = state
    for i in range(n):
        bh, bl = high[i], low[i]
        if h is not None:
            if (bh < h and bl > l) or (h < bh and l > bl) if strict else (bh <= h and bl >= l) or (h <= bh and l >= bl):
                new[i], dirs[i] = 0, d
                h, l = (max(h, bh), max(l, bl)) if d == UP else (min(h, bh), min(l, bl))
                continue
            if bh > h and bl > l:
                d = UP
            elif bh < h and bl < l:
                d = DOWN
        h, l, dirs[i] = bh, bl, d
    return new, dirs, state if not n else [h, l, d]


def stroke_fold(rows: list[tuple], state: list | None, least: int = 5, extreme: bool = True) -> tuple[list[tuple], list | None]:
    """Decisions over merged bars (index, high, low, top price or None, bottom price or None).

    A decision is (anchor index, anchor type, anchor price, index, type, price, outcome, high, low),
    where outcome is STROKE, SAME_TYPE_ANCHOR_COLLAPSED or the reason of a rejection. The state is
    [anchor index, type, price, highest high and lowest low since the anchor].
    """
    out = []
    anchor = None if state is None else tuple(state[:3])
    hi, lo = (None, None) if state is None else state[3:]
    for i, h, l, top, bottom in rows:
        if anchor is not None:
            hi, lo = max(hi, h), min(lo, l)
        for kind, price in (("TOP", top), ("BOTTOM", bottom)):
            if price is None:
                continue
            move = anchor is None
            if not move:
                j, was, at = anchor
                outcome = "STROKE"
                if was == kind:
                    outcome = "SAME_TYPE_ANCHOR_COLLAPSED"
                    move = price > at if kind == "TOP" else price < at
                elif i - j + 1 < least:
                    outcome = "INSUFFICIENT_MERGED_BARS"
                elif kind == "TOP" and price <= at:
                    outcome = "NON_POSITIVE_UP_RANGE"
                elif kind == "BOTTOM" and price >= at:
                    outcome = "NON_POSITIVE_DOWN_RANGE"
                elif extreme and ((kind == "TOP" and (price != hi or at != lo)) or (kind == "BOTTOM" and (price != lo or at != hi))):
                    outcome = "ENDPOINT_NOT_INTERVAL_EXTREME"
                out.append((j, was, at, i, kind, price, outcome, hi, lo))
                move = move or outcome == "STROKE"
            if move:
                anchor, hi, lo = (i, kind, price), h, l
    return out, state if anchor is None else [*anchor, hi, lo]


def relation(a: dict, b: dict) -> str:
    if a["low"] == b["low"] and a["high"] == b["high"]:
        return "EQUAL"
    if a["low"] <= b["low"] and a["high"] >= b["high"]:
        return "CONTAINS"
    if b["low"] <= a["low"] and b["high"] >= a["high"]:
        return "CONTAINED_BY"
    return "APART"


def canonical_key(kind: str, **content) -> str:
    """Content address of a record: SHA-256 of its JSON with sorted keys."""
    return hashlib.sha256(json.dumps({"kind": kind, **content}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _element(sequence: str, low: float, high: float, sources: list, ends: dict[str, dict], visible: int) -> dict:
    """A feature element with its content-addressed id; ``ends`` are its start, end, high and low."""
    body = "|".join([sequence, ",".join(s["logical_id"] for s in sources), repr(low), repr(high), *(ends[k]["endpoint_id"] for k in ("start", "end", "high", "low"))])
    return {"id": "feature:" + hashlib.sha256(body.encode()).hexdigest()[:20], "low": low, "high": high, "sources": sources, "ends": ends, "visible": visible}


def normalise_features(strokes: list[dict], sequence: str = "") -> tuple[list[dict], str | None]:
    """Standard elements of the feature strokes of a sequence, or the reason why there are none.

    Of two ends at the same price the one with the earlier bar stands, then the smaller id.
    """
    out: list[dict] = []
    seed = None
    for s in strokes:
        end = lambda side: {"endpoint_id": s[f"{side}_fractal_id"], "price": s[f"{side}_price"], "bar_index": s[f"{side}_bar_index"], "defining_stroke_logical_ids": [s["logical_id"]]}  # noqa: B023, E731
        ends = {"start": end("start"), "end": end("end")}
        down = s["start_price"] > s["end_price"]
        ends |= {"high": ends["start" if down else "end"], "low": ends["end" if down else "start"]}
        e = _element(sequence, ends["low"]["price"], ends["high"]["price"], [s], ends, s["confirmed_at_bar"])
        last = out[-1] if out else None
        if last and relation(last, e) != "APART":
            if seed is None:
                return [], "SEGMENT_FEATURE_INCLUSION_UNSEEDED"
            pick = max if seed == UP else min
            low, high = pick(last["low"], e["low"]), pick(last["high"], e["high"])
            bound = lambda k, v: min((x["ends"][k] for x in (last, e) if x["ends"][k]["price"] == v), key=lambda p: (p["bar_index"], p["endpoint_id"], p["defining_stroke_logical_ids"]))  # noqa: B023, E731
            ends = {"start": last["ends"]["start"], "end": e["ends"]["end"], "high": bound("high", high), "low": bound("low", low)}
            out[-1] = _element(sequence, low, high, last["sources"] + e["sources"], ends, max(last["visible"], e["visible"]))
            continue
        if last:
            seed = UP if e["high"] > last["high"] else DOWN
        out.append(e)
    return out, None


# The rules that keys of evidence name.
RULES = "minimal_segment_canonical_rules_v1@1.0.1"


def primary_segment(strokes: list[dict], sequence: str = "") -> dict:
    """Outcome of one sequence of sound strokes, with its evidence and the segment it confirms."""
    direction = strokes[0]["direction"]
    elements, reason = normalise_features([s for s in strokes if s["direction"] != direction], sequence)
    result = {"direction": direction, "outcome": reason, "elements": len(elements), "evidence": None, "segment": None}
    if reason:
        return result
    if len(elements) < 3:
        return result | {"outcome": "SEGMENT_FEATURE_WINDOW_INCOMPLETE"}
    for window in zip(elements, elements[1:], elements[2:]):
        a, b, c = window
        if direction == "UP":
            found = b["high"] > max(a["high"], c["high"]) and b["low"] > max(a["low"], c["low"])
        else:
            found = b["high"] < min(a["high"], c["high"]) and b["low"] < min(a["low"], c["low"])
        if not found:
            continue
        gap = a["high"] < b["low"] or b["high"] < a["low"]
        case, fractal = "SECOND_CASE_PENDING" if gap else "FIRST_CASE", "TOP" if direction == "UP" else "BOTTOM"
        end = b["ends"]["high" if direction == "UP" else "low"]
        key = canonical_key("PRIMARY_DESTRUCTION_V1", case=case, candidate_direction=direction, sequence_id=sequence, element_ids=[e["id"] for e in window], fractal_type=fractal, endpoint=end, rule_version=RULES)
        result["evidence"] = {"key": key, "case": case, "fractal": fractal, "endpoint": end, "elements": [e["id"] for e in window]}
        if gap:
            second = hashlib.sha256(f"{sequence}|{key}|{end['endpoint_id']}".encode()).hexdigest()[:20]
            result["evidence"]["secondary"] = f"secondary:{second}"
            return result | {"outcome": "SEGMENT_SECOND_CASE_PENDING"}
        ends = [i for i, s in enumerate(strokes) if s["direction"] == direction and (s["end_fractal_id"], s["end_bar_index"], s["end_price"]) == (end["endpoint_id"], end["bar_index"], end["price"])]
        if len(ends) != 1:
            return result | {"outcome": "SEGMENT_FIRST_CASE_BOUNDARY_NOT_UNIQUE"}
        prefix = strokes[: ends[0] + 1]
        if len(prefix) < 3 or len(prefix) % 2 == 0:
            return result | {"outcome": "SEGMENT_FIRST_CASE_WINDOW_INVALID"}
        confirmed = max(x["visible"] for x in window)
        if confirmed < end["bar_index"]:
            return result | {"outcome": "CONFIRMATION_TIME_BACKFILL_FORBIDDEN"}
        sources = [s for x in window for s in x["sources"]]
        return result | {"outcome": "SEGMENT_FIRST_CASE_CONFIRMED", "segment": {
            "start": prefix[0], "end": prefix[-1], "strokes": prefix, "features": sources, "destruction": [s for s in sources if s["end_bar_index"] > end["bar_index"]],
            "confirmed_at_bar": confirmed, "end_price": end["price"], "end_bar_index": end["bar_index"],
        }}
    return result | {"outcome": "SEGMENT_PRIMARY_FRACTAL_NOT_FOUND"}
