"""Segments from sequences of confirmed, contiguous strokes: validation, features, first case."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.kernels import normalise_features, primary_segment
from barloom.session import spread

NEED = [
    "stroke_id", "logical_id", "object_id", "direction", "start_price", "end_price", "start_bar_index", "end_bar_index", "confirmed_at_bar", "start_fractal_id", "end_fractal_id",
    "confirmed_at_raw_bar_index",
]
# The profile that confirmed segments name.
PROFILE, VERSION = "minimal_segment_engine_core_v1", "0.1.0"
ENDPOINT = "struct<bar_index: long, defining_stroke_logical_ids: array<string>, endpoint_id: string, price: double>"
SEGMENTS = (
    "symbol string, sequence_id string, outcome string, elements int, direction string, segment_id string, object_id string, logical_id string, start_stroke_id string, end_stroke_id string, "
    "start_price double, end_price double, start_bar_index long, end_bar_index long, stroke_ids array<string>, stroke_logical_ids array<string>, feature_stroke_ids array<string>, "
    "destruction_stroke_ids array<string>, confirmed_at_bar long, confirmed_at_raw_bar_index long, evidence_key string, destruction_case string, fractal_type string, "
    f"element_ids array<string>, endpoint {ENDPOINT}, secondary_sequence_id string"
)


def _first(checks: list[tuple[Column, str]]) -> Column:
    """The code of the first check that holds; a null condition doesn't hold."""
    out = F.lit(None).cast("string")
    for condition, code in reversed(checks):
        out = F.when(condition, code).otherwise(out)
    return out


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c) == "", F.lit(True))


def with_source_errors(sequences: DataFrame) -> DataFrame:
    """Adds ``reason_code`` (of the stroke) and ``refused`` (of its sequence): why no segment may be
    built from it. Codes in order: of single strokes by place, of doubles, of neighbours by place,
    of the raw axis, which all strokes of a sequence must have, or none.
    """
    order = Window.partitionBy("symbol", "sequence_id").orderBy("start_bar_index", "end_bar_index", "stroke_id")
    whole = Window.partitionBy("symbol", "sequence_id")
    up = F.col("direction") == "UP"
    prev = F.lag(F.struct("direction", "end_fractal_id", "end_price", "end_bar_index")).over(order)
    raw = (F.col("created_at_raw_bar_index").isNotNull(), F.col("confirmed_at_raw_bar_index").isNotNull())
    x = sequences.withColumns({
        "_p": prev, "_i": F.row_number().over(order),
        "_logical": F.count("*").over(Window.partitionBy("symbol", "sequence_id", "logical_id")), "_stroke": F.count("*").over(Window.partitionBy("symbol", "sequence_id", "stroke_id")),
        "_raws": F.count_if(raw[0]).over(whole), "_n": F.count("*").over(whole),
    })
    low, high = F.when(up, F.col("start_price")).otherwise(F.col("end_price")), F.when(up, F.col("end_price")).otherwise(F.col("start_price"))
    bounds = (low < high) & (F.coalesce("min_price", low) == low) & (F.coalesce("max_price", high) == high) if "min_price" in sequences.columns else low < high
    no = lambda c: ~F.coalesce(c, F.lit(False))
    single = _first([
        (_empty("sequence_id"), "SEGMENT_SEQUENCE_ID_REQUIRED"),
        (_empty("logical_id"), "SEGMENT_SOURCE_LOGICAL_ID_REQUIRED"), (_empty("stroke_id"), "SEGMENT_SOURCE_STROKE_ID_REQUIRED"), (_empty("object_id"), "SEGMENT_SOURCE_OBJECT_ID_REQUIRED"),
        (_empty("start_fractal_id") | _empty("end_fractal_id"), "SEGMENT_SOURCE_ENDPOINT_ID_REQUIRED"), (no(F.col("direction").isin("UP", "DOWN")), "SEGMENT_SOURCE_DIRECTION_REQUIRED"),
        (no((F.col("start_bar_index") >= 0) & (F.col("end_bar_index") > F.col("start_bar_index"))), "SEGMENT_SOURCE_BAR_RANGE_INVALID"),
        (no(F.col("status") == "CONFIRMED"), "SEGMENT_SOURCE_STROKE_NOT_CONFIRMED"), (no(F.col("confirmed_at_bar") >= F.col("end_bar_index")), "SEGMENT_SOURCE_CONFIRMATION_VISIBILITY_INVALID"),
        (no(bounds), "SEGMENT_SOURCE_ENDPOINT_EXTREME_MISMATCH"),
    ])
    double = _first([(F.col("_logical") > 1, "SEGMENT_SOURCE_DUPLICATE_LOGICAL_ID"), (F.col("_stroke") > 1, "SEGMENT_SOURCE_DUPLICATE_STROKE_ID")])
    beside = _first([
        (F.col("_p.direction") == F.col("direction"), "SEGMENT_SOURCE_DIRECTION_NOT_ALTERNATING"),
        ((F.col("_p.end_fractal_id") != F.col("start_fractal_id")) | (F.col("_p.end_bar_index") != F.col("start_bar_index")), "SEGMENT_SOURCE_ENDPOINT_NOT_CONTIGUOUS"),
        (F.col("_p.end_price") != F.col("start_price"), "SEGMENT_SOURCE_ENDPOINT_PRICE_NOT_CONTIGUOUS"),
    ])
    partial = _first([(raw[0] != raw[1], "SEGMENT_SOURCE_RAW_VISIBILITY_PARTIAL")])
    mixed = _first([((F.col("_raws") > 0) & (F.col("_raws") < F.col("_n")), "SEGMENT_SOURCE_RAW_VISIBILITY_PARTIAL")])
    axis = _first([(no((F.col("created_at_raw_bar_index") >= 0) & (F.col("confirmed_at_raw_bar_index") >= F.col("created_at_raw_bar_index"))) & raw[0], "SEGMENT_SOURCE_RAW_VISIBILITY_INVALID")])
    phases = [single, double, beside, partial, mixed, axis]
    x = x.withColumn("reason_code", F.coalesce(*phases))
    at = F.coalesce(*[F.when(p.isNotNull(), F.struct(F.lit(k).alias("phase"), (F.when(p == "SEGMENT_SOURCE_DUPLICATE_LOGICAL_ID", 0).otherwise(1) if k == 1 else F.col("_i")).alias("at"), p.alias("code"))) for k, p in enumerate(phases)])
    return x.withColumn("refused", F.min(at).over(whole)["code"]).drop("_p", "_i", "_logical", "_stroke", "_raws", "_n")


def source_errors(sequences: DataFrame) -> DataFrame:
    """(symbol, sequence_id, stroke_id, reason_code) of strokes that no segment may be built from."""
    return with_source_errors(sequences).where("reason_code is not null").select("symbol", "sequence_id", "stroke_id", "reason_code")


def refused_sequences(sequences: DataFrame) -> DataFrame:
    """(symbol, sequence_id, reason_code): the first reason against each sequence that has one."""
    return with_source_errors(sequences).where("refused is not null").select("symbol", "sequence_id", F.col("refused").alias("reason_code")).distinct()


def _records(pdf: pd.DataFrame) -> list[dict]:
    return pdf.sort_values(["start_bar_index", "end_bar_index"])[NEED].to_dict("records")


def _grouped(sequences: DataFrame) -> DataFrame:
    """Sequences with their reason for refusal, each in one task: they are short by nature."""
    x = with_source_errors(spread(sequences, "symbol", "sequence_id"))
    return x.select("symbol", "sequence_id", "refused", *NEED)


def feature_sequence(sequences: DataFrame) -> DataFrame:
    """Strokes that run against the first stroke of their sequence, numbered."""
    w = Window.partitionBy("symbol", "sequence_id").orderBy("start_bar_index")
    x = sequences.withColumn("_d", F.first("direction").over(w)).where(F.col("direction") != F.col("_d"))
    return x.select("symbol", "sequence_id", F.row_number().over(w).alias("feature_index"), "stroke_id", F.least("start_price", "end_price").alias("low"), F.greatest("start_price", "end_price").alias("high"), F.col("confirmed_at_bar").alias("visible_at_bar"))


ELEMENTS = (
    "symbol string, sequence_id string, element_index int, element_id string, direction string, low double, high double, visible_at_bar long, stroke_ids array<string>, "
    f"source_stroke_logical_ids array<string>, start {ENDPOINT}, end {ENDPOINT}, high_end {ENDPOINT}, low_end {ENDPOINT}, reason_code string"
)


def feature_elements(sequences: DataFrame) -> DataFrame:
    """Standard elements after normalisation; a sequence that is refused or can't be normalised
    gives its reason in one row.
    """
    names = [c.split()[0] for c in ELEMENTS.replace(ENDPOINT, "x").split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        base = dict.fromkeys(names) | {"symbol": pdf["symbol"].iloc[0], "sequence_id": pdf["sequence_id"].iloc[0]}
        reason, elements = pdf["refused"].iloc[0], []
        if not isinstance(reason, str):
            rows = _records(pdf)
            elements, reason = normalise_features([r for r in rows if r["direction"] != rows[0]["direction"]], base["sequence_id"])
        if isinstance(reason, str):
            return pd.DataFrame([base | {"reason_code": reason}])
        out = [
            base | {
                "element_index": i, "element_id": e["id"], "direction": e["sources"][0]["direction"], "low": e["low"], "high": e["high"], "visible_at_bar": e["visible"],
                "stroke_ids": [s["stroke_id"] for s in e["sources"]], "source_stroke_logical_ids": [s["logical_id"] for s in e["sources"]],
                "start": e["ends"]["start"], "end": e["ends"]["end"], "high_end": e["ends"]["high"], "low_end": e["ends"]["low"],
            } for i, e in enumerate(elements)
        ]
        return pd.DataFrame(out, columns=names)

    return _grouped(sequences).groupBy("symbol", "sequence_id").applyInPandas(run, ELEMENTS)


def primary_segments(sequences: DataFrame) -> DataFrame:
    """One row a sequence: the outcome of the primary scan with its evidence, and the segment of a
    first case. A sequence with an unsound stroke is refused whole, with its reason as outcome.
    """
    names = [c.split()[0] for c in SEGMENTS.replace(ENDPOINT, "x").split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = dict.fromkeys(names) | {"symbol": pdf["symbol"].iloc[0], "sequence_id": pdf["sequence_id"].iloc[0]}
        if isinstance(pdf["refused"].iloc[0], str):
            return pd.DataFrame([out | {"outcome": pdf["refused"].iloc[0], "elements": 0}])
        r = primary_segment(_records(pdf), out["sequence_id"])
        out |= {"outcome": r["outcome"], "elements": r["elements"], "direction": r["direction"]}
        e, s = r["evidence"], r["segment"]
        if e:
            out |= {"evidence_key": e["key"], "destruction_case": e["case"], "fractal_type": e["fractal"], "element_ids": e["elements"], "endpoint": e["endpoint"], "secondary_sequence_id": e.get("secondary")}
        if s:
            a, b = s["start"], s["end"]
            ids = lambda rows, c="stroke_id": [r[c] for r in rows]
            raw = ids(s["features"], "confirmed_at_raw_bar_index")
            name = f"segment_{a['start_bar_index'] + 1:06d}_{s['end_bar_index'] + 1:06d}_{r['direction'][0]}"
            out |= {
                "segment_id": name, "object_id": f"{name}_r1", "logical_id": f"segment:{a['logical_id']}->{b['logical_id']}",
                "start_stroke_id": a["stroke_id"], "end_stroke_id": b["stroke_id"], "start_price": a["start_price"], "end_price": s["end_price"], "start_bar_index": a["start_bar_index"], "end_bar_index": s["end_bar_index"],
                "stroke_ids": ids(s["strokes"]), "stroke_logical_ids": ids(s["strokes"], "logical_id"), "feature_stroke_ids": ids(s["features"]), "destruction_stroke_ids": ids(s["destruction"]), "confirmed_at_bar": s["confirmed_at_bar"],
                "confirmed_at_raw_bar_index": int(max(raw)) if all(v == v and v is not None for v in raw) else None,
            }
        return pd.DataFrame([out])

    return _grouped(sequences).groupBy("symbol", "sequence_id").applyInPandas(run, SEGMENTS)
