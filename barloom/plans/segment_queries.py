"""Queries of segments, their evidence and their lifecycle, and their SQL.

Zigzag cases join points by strokes one bar apart; what must come of them is known, and stated in the
SQL as rows. Planted faults show that each guard refuses. Windows over the table of strokes show the
same rules at scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import second_case as second
from barloom.functions.rules import interval_relation
from barloom.operators import audit, lifecycle
from barloom.operators.fractals import fractal_candidates, fractal_replacements, fractals
from barloom.operators.inclusion import provenance_errors, registry_errors
from barloom.operators.segments import feature_elements, primary_segments, refused_sequences
from barloom.profile import Profile
from barloom.session import read_table

STROKES = (
    "symbol string, sequence_id string, stroke_id string, logical_id string, object_id string, direction string, start_fractal_id string, end_fractal_id string, start_price double, end_price double, "
    "start_bar_index long, end_bar_index long, min_price double, max_price double, status string, created_at_bar long, confirmed_at_bar long, created_at_raw_bar_index long, confirmed_at_raw_bar_index long"
)
# Points of the cases, and strokes that are seen late.
CASES = {
    "incomplete": [0, 10, 4, 12, 6], "merged": [0, 9, 4, 10, 5, 10, 6], "unseeded": [0, 10, 4, 9, 5, 11, 6], "first_up": [0, 10, 4, 12, 6, 11, 5], "late": [0, 10, 4, 12, 6, 11, 5],
    "first_down": [12, 2, 8, 0, 6, 1, 7], "pending": [0, 3, 1, 8, 5, 7, 4], "none": [0, 10, 4, 11, 5, 12, 6],
}
LATE = {("late", 3): 9}


def _rows(name: str, points: list[int]) -> list[dict]:
    out = []
    for i, (a, b) in enumerate(zip(points, points[1:])):
        out.append({
            "symbol": name, "sequence_id": "seq", "stroke_id": f"stroke_{i:06d}", "logical_id": f"stroke:{i}", "object_id": f"stroke_{i:06d}_r1", "direction": "UP" if b > a else "DOWN",
            "start_fractal_id": f"fx:{i}", "end_fractal_id": f"fx:{i + 1}", "start_price": float(a), "end_price": float(b), "start_bar_index": i, "end_bar_index": i + 1, "min_price": float(min(a, b)), "max_price": float(max(a, b)),
            "status": "CONFIRMED", "created_at_bar": i + 1, "confirmed_at_bar": LATE.get((name, i), i + 1), "created_at_raw_bar_index": i + 11, "confirmed_at_raw_bar_index": i + 11,
        })
    return out


def zigzags(s: SparkSession) -> DataFrame:
    rows = [r for name, points in CASES.items() for r in _rows(name, points)]
    names = [c.split()[0] for c in STROKES.split(", ")]
    return s.createDataFrame([tuple(r[n] for n in names) for r in rows], STROKES)


# What is changed in which stroke of the up case, and the reason that must be given.
FAULTS = [
    ("logical_id", 2, "", "SEGMENT_SOURCE_LOGICAL_ID_REQUIRED"), ("stroke_id", 2, None, "SEGMENT_SOURCE_STROKE_ID_REQUIRED"), ("object_id", 0, "", "SEGMENT_SOURCE_OBJECT_ID_REQUIRED"),
    ("end_fractal_id", 5, "", "SEGMENT_SOURCE_ENDPOINT_ID_REQUIRED"), ("direction", 1, "SIDEWAYS", "SEGMENT_SOURCE_DIRECTION_REQUIRED"), ("start_bar_index", 0, -1, "SEGMENT_SOURCE_BAR_RANGE_INVALID"),
    ("status", 4, "PROVISIONAL", "SEGMENT_SOURCE_STROKE_NOT_CONFIRMED"), ("confirmed_at_bar", 3, 2, "SEGMENT_SOURCE_CONFIRMATION_VISIBILITY_INVALID"), ("max_price", 2, 13.0, "SEGMENT_SOURCE_ENDPOINT_EXTREME_MISMATCH"),
    ("logical_id", 3, "stroke:2", "SEGMENT_SOURCE_DUPLICATE_LOGICAL_ID"), ("stroke_id", 3, "stroke_000002", "SEGMENT_SOURCE_DUPLICATE_STROKE_ID"), ("end_fractal_id", 2, "fx:x", "SEGMENT_SOURCE_ENDPOINT_NOT_CONTIGUOUS"),
    ("created_at_raw_bar_index", 1, None, "SEGMENT_SOURCE_RAW_VISIBILITY_PARTIAL"), ("created_at_raw_bar_index", 1, 99, "SEGMENT_SOURCE_RAW_VISIBILITY_INVALID"),
]


def source_faults(s: SparkSession, d: str) -> DataFrame:
    names = [c.split()[0] for c in STROKES.split(", ")]
    rows = []
    for k, (field, at, value, _) in enumerate(FAULTS):
        made = _rows(f"fault_{k:02d}", CASES["first_up"])
        made[at][field] = value
        rows += [tuple(r[n] for n in names) for r in made]
    x = s.createDataFrame(rows, STROKES)
    out = refused_sequences(x).select("symbol", "reason_code")
    # fail closed: none of them has a segment
    return out.join(primary_segments(x).where("segment_id is null").select("symbol", F.col("outcome").alias("outcome")), "symbol")


def cases(s: SparkSession, d: str) -> DataFrame:
    return primary_segments(zigzags(s)).select(
        "symbol", "outcome", "elements", "direction", "segment_id", "logical_id", "end_price", "end_bar_index", F.array_join("stroke_ids", ",").alias("strokes"), F.array_join("feature_stroke_ids", ",").alias("features"),
        F.array_join("destruction_stroke_ids", ",").alias("destruction"), "confirmed_at_bar", "confirmed_at_raw_bar_index", "destruction_case", "fractal_type", F.col("endpoint.endpoint_id").alias("endpoint_id"),
    )


def case_elements(s: SparkSession, d: str) -> DataFrame:
    return feature_elements(zigzags(s)).select("symbol", "element_index", "low", "high", "visible_at_bar", F.array_join("stroke_ids", ",").alias("strokes"), F.col("high_end.endpoint_id").alias("high_id"), F.col("low_end.endpoint_id").alias("low_id"), "reason_code")


def _intents(s: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    z = zigzags(s)
    seg = primary_segments(z)
    return z, seg, lifecycle.first_case_intents(seg)


def intents(s: SparkSession, d: str) -> DataFrame:
    return _intents(s)[2].select("symbol", "place", "event_type", "reason_code", "object_id", "logical_id", "occurred_at_bar_id", F.length("intent_key").alias("key_length"))


HISTORIES = ["empty", "created", "both", "confirmed_only", "twice", "unknown_key", "changed", "other_binding", "unbound"]


def emission(s: SparkSession, d: str) -> DataFrame:
    """What is appended and what refused, over nine histories of the same segment, each a symbol."""
    names = F.explode(F.array(*map(F.lit, HISTORIES))).alias("symbol")
    z = zigzags(s).where("symbol = 'first_up'").select(names, *[c.split()[0] for c in STROKES.split(", ")][1:])
    seg = primary_segments(z)
    kept = lifecycle.first_case_intents(seg).withColumn("seq", F.col("place").cast("long"))
    of = F.col("symbol")
    kept = kept.where(~of.isin("empty", "unbound") & ~((of == "created") & (F.col("place") == 2)) & ~((of == "confirmed_only") & (F.col("place") == 1)))
    kept = kept.unionByName(kept.where("symbol = 'twice' and place = 1").withColumn("seq", F.lit(9).cast("long")))
    change = lambda name, c, v: F.when(of == name, v).otherwise(F.col(c))
    kept = kept.withColumns({"intent_key": change("unknown_key", "intent_key", "segment_lifecycle:x"), "occurred_at_bar_id": change("changed", "occurred_at_bar_id", "bar_000001"), "binding_key": change("other_binding", "binding_key", "x")})
    seg = seg.withColumn("end_price", change("unbound", "end_price", 99.0))  # a segment that its strokes don't give
    new, refused = lifecycle.emit(seg, z, kept)
    return new.select(of.alias("history"), F.lit("append").alias("what"), F.col("event_type").alias("detail")).unionByName(refused.select(of.alias("history"), F.lit("refuse").alias("what"), F.col("reason_code").alias("detail")))


def checkpoints(s: SparkSession, d: str) -> DataFrame:
    z, seg, made = _intents(s)
    return lifecycle.checkpoint_states(seg, z, made).select("symbol", "refusal", "outcome_code", F.size("source_stroke_content_hashes").alias("sources"), "segment_object_id", F.size("lifecycle_intent_keys").alias("intents"), F.length("state_key").alias("key_length"))


def checkpoint_faults(s: SparkSession, d: str) -> DataFrame:
    """Stored envelopes against changed fields, missing events and events of an outcome without any."""
    z, seg, made = _intents(s)
    stored = lifecycle.checkpoint_states(seg, z, made)
    parts = {
        "sound": (stored, made), "status": (stored.withColumn("segment_confirmed_at_bar", F.lit(1).cast("long")), made), "key": (stored.withColumn("state_key", F.lit("x")), made), "half": (stored, made.where("place = 1")),
        "stray": (stored, made.unionByName(made.where("symbol = 'first_up'").withColumn("symbol", F.lit("pending")))),
    }
    out = None
    for name, (kept, events) in parts.items():
        part = lifecycle.checkpoint_errors(kept, seg, z, events).where("symbol in ('first_up', 'pending')").select(F.lit(name).alias("what"), "symbol", "reason_code", F.when(F.lit(name).isin("status", "key"), F.array_join("fields", ",")).alias("fields"))
        out = part if out is None else out.unionByName(part)
    return out


def second_chain(s: SparkSession, d: str) -> DataFrame:
    """The pending case settled by evidence of every kind and order."""
    pending = primary_segments(zigzags(s)).where("symbol = 'pending'").select("evidence_key", "endpoint", "direction", "secondary_sequence_id")
    # name: (confirmed_at or None, observed_at or None, price, what is wrong)
    kinds = [
        ("nothing", None, None, None, ""), ("confirmed", 60, None, None, ""), ("confirmed_first", 60, 70, 9.0, ""), ("extreme_first", 70, 60, 9.0, ""), ("same_bar", 60, 60, 9.0, ""), ("extreme_only", None, 60, 9.0, ""),
        ("touch_only", None, 60, 8.0, ""), ("touch_and_confirmed", 70, 60, 8.0, ""), ("other_key", 60, None, None, "key"), ("other_endpoint", 60, None, None, "endpoint"), ("other_sequence", 60, None, None, "sequence"),
        ("wrong_fractal", 60, None, None, "fractal"), ("too_early", 2, None, None, ""), ("extreme_too_early", None, 3, 9.0, ""), ("doubled", 60, None, None, "double"),
    ]
    table = F.array(*[F.struct(F.lit(n).alias("evidence"), F.lit(c).cast("long").alias("confirmed"), F.lit(o).cast("long").alias("observed"), F.lit(p).cast("double").alias("price"), F.lit(w).alias("wrong")) for n, c, o, p, w in kinds])
    x = pending.select("*", F.explode(table).alias("k")).select("endpoint", "direction", "secondary_sequence_id", "k.*", F.concat_ws(":", "evidence_key", "k.evidence").alias("evidence_key"))
    pick = lambda kind, good, bad: F.when(F.col("wrong") == kind, bad).otherwise(good)
    sec = F.struct(
        pick("fractal", F.lit("BOTTOM"), "TOP").alias("fractal_type"), F.col("confirmed").alias("confirmed_at_bar"), pick("endpoint", F.col("endpoint.endpoint_id"), "x").alias("pending_endpoint_id"),
        pick("key", F.col("evidence_key"), "x").alias("primary_evidence_key"), pick("sequence", F.col("secondary_sequence_id"), "x").alias("secondary_sequence_id"),
    )
    ext = F.struct(F.col("observed").alias("observed_at_bar"), F.col("endpoint.endpoint_id").alias("pending_endpoint_id"), "price", F.col("evidence_key").alias("primary_evidence_key"))
    one = lambda a, b, keep: x.where(keep).select(F.col("evidence_key").alias("primary_evidence_key"), F.when(F.lit(a), sec).alias("secondary"), F.when(F.lit(b), ext).alias("extreme"))
    rows = one(False, True, "observed is not null").unionByName(one(True, False, "confirmed is not null")).unionByName(one(True, False, "wrong = 'double'"))
    return second.settle(x.select("evidence_key", "endpoint", "direction", "secondary_sequence_id", "evidence"), rows).select("evidence", "refusal", "state", "reason_code")


def _elements(s: SparkSession, d: str) -> DataFrame:
    """Feature elements of the table of strokes, unmerged, with the two that follow them."""
    newest = Window.partitionBy("symbol", "sequence_id", "stroke_id").orderBy(F.col("revision").desc())
    need = ["symbol", "sequence_id", "stroke_id", "direction", "start_fractal_id", "end_fractal_id", "start_price", "end_price", "start_bar_index", "end_bar_index", "confirmed_at_bar"]
    x = read_table(s, d, "strokes").withColumn("k", F.row_number().over(newest)).where("k = 1").select(*need).dropna()
    end = lambda side: F.struct(F.col(f"{side}_bar_index").alias("bar_index"), F.array("stroke_id").alias("defining_stroke_logical_ids"), F.col(f"{side}_fractal_id").alias("endpoint_id"), F.col(f"{side}_price").alias("price"))
    up = F.col("start_price") < F.col("end_price")
    e = F.struct(
        F.col("stroke_id").alias("element_id"), "sequence_id", "direction", F.least("start_price", "end_price").alias("low"), F.greatest("start_price", "end_price").alias("high"), F.col("confirmed_at_bar").alias("visible_at_bar"),
        F.array("stroke_id").alias("source_stroke_logical_ids"), end("start").alias("start"), end("end").alias("end"), F.when(up, end("end")).otherwise(end("start")).alias("high_end"), F.when(up, end("start")).otherwise(end("end")).alias("low_end"), F.lit(True).alias("normalized"),
    )
    w = Window.partitionBy("symbol", "sequence_id", "direction").orderBy("start_bar_index", "stroke_id")
    return x.select("symbol", "sequence_id", "direction", "start_bar_index", "stroke_id", e.alias("a")).withColumns({"b": F.lead("a", 1).over(w), "c": F.lead("a", 2).over(w)}).where("c is not null")


def evidence_windows(s: SparkSession, d: str) -> DataFrame:
    """Primary evidence of every three successive strokes of one direction."""
    w = [F.col(c) for c in "abc"]
    provenance = F.concat(*[e["source_stroke_logical_ids"] for e in w])
    x = _elements(s, d).withColumn("e", second.primary_evidence(w, second.other(F.col("direction")), F.col("sequence_id"), provenance))
    return x.select("symbol", "stroke_id", "e.refusal", "e.case", "e.reason_code", F.col("e.endpoint.price").alias("price"), F.col("e.endpoint.bar_index").alias("bar"), F.length("e.evidence_key").alias("key_length"))


def element_checks(s: SparkSession, d: str) -> DataFrame:
    """Unsound elements, and why neighbours can't be merged."""
    a, b = F.col("a"), F.col("b")
    seed = F.when((b["high"] > a["high"]) & (b["low"] > a["low"]), "UP").when((b["high"] < a["high"]) & (b["low"] < a["low"]), "DOWN").otherwise("UNSEEDED")
    x = _elements(s, d)
    return x.select("symbol", "stroke_id", second.element_errors(a).alias("unsound"), second.merge_refusal(a, b, seed, (F.lit("UP"), F.lit("UP")), F.lit(False)).alias("no_merge"), interval_relation((a["low"], a["high"]), (b["low"], b["high"])).alias("relation"))


BARS = {  # (high, low) of merged bars
    "top": [(103, 98), (108, 101), (106, 100)], "bottom": [(105, 100), (102, 95), (101, 97)], "short": [(1, 0), (2, 1)], "equal_high": [(105, 98), (105, 99), (104, 97)],
    "collapse": [(103, 98), (108, 101), (106, 103), (111, 102), (107, 101)], "equal_low": [(105, 98), (104, 98), (106, 99)], "tie": [(103, 98), (108, 101), (106, 103), (108, 102), (107, 101)],
}


def _merged(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(name, i, float(h), float(l)) for name, bars in BARS.items() for i, (h, l) in enumerate(bars)], "symbol string, bar_index long, high double, low double")


def fractal_cases(s: SparkSession, d: str) -> DataFrame:
    """Turning points by the strict and the relaxed rule, those that remain, and those replaced."""
    m = _merged(s)
    strict, relaxed = fractal_candidates(m), fractal_candidates(m, Profile(allow_equal_high=True, allow_equal_low=True))
    pick = lambda x, what: x.select("symbol", F.lit(what).alias("what"), "fractal_type", F.col("merged_bar_index").alias("bar"))
    lost = fractal_replacements(strict).select("symbol", F.lit("replaced").alias("what"), "fractal_type", F.col("loser_index").alias("bar"))
    return pick(strict, "strict").unionByName(pick(relaxed, "relaxed")).unionByName(pick(fractals(strict), "kept")).unionByName(lost)


def planted_provenance(s: SparkSession, d: str) -> DataFrame:
    """Merged bars whose sources are missing, repeated or unknown."""
    m = s.createDataFrame([("S", ["a", "b"]), ("S", ["b"]), ("S", ["x"]), ("S", []), ("T", ["a"])], "symbol string, source_raw_bar_ids array<string>")
    return provenance_errors(m, s.createDataFrame([("S", "a"), ("S", "b"), ("T", "a")], "symbol string, bar_id string")).select("symbol", F.coalesce("source", F.lit("")).alias("source"), "reason_code")


def planted_registry(s: SparkSession, d: str) -> DataFrame:
    rows = [("S", "a", 0), ("S", "b", 1), ("S", "a", 2), ("S", "", 3), ("S", None, 4), ("S", "c", -1), ("S", "d", 6), ("S", "e", 6), ("T", "a", 0)]
    return registry_errors(s.createDataFrame(rows, "symbol string, bar_id string, bar_index long")).select("symbol", F.coalesce("bar_id", F.lit("null")).alias("bar_id"), "bar_index", "reason_code")


def planted_consistency(s: SparkSession, d: str) -> DataFrame:
    """A second run with a changed price, a lost bar, a lost turning point and a bar too many."""
    one = {
        "merged": s.createDataFrame([("S", i, 1.0, 2.0 + i, 0.5, 1.5) for i in range(5)], "symbol string, bar_index long, open double, high double, low double, close double"),
        "fractals": s.createDataFrame([("S", 1, "TOP", 3.0, "f1", "CONFIRMED"), ("S", 3, "BOTTOM", 0.5, "f3", "CONFIRMED"), ("S", 4, "TOP", 6.0, "f4", "PROVISIONAL")], "symbol string, merged_bar_index long, fractal_type string, price double, logical_id string, status string"),
        "strokes": s.createDataFrame([("S", "s1", "DOWN", 3.0, 0.5, 1, 3, "CONFIRMED")], "symbol string, logical_id string, direction string, start_price double, end_price double, start_bar_index long, end_bar_index long, status string"),
    }
    two = dict(one)
    two["merged"] = one["merged"].withColumn("high", F.when(F.col("bar_index") == 2, 9.0).otherwise(F.col("high"))).where("bar_index <> 4").unionByName(one["merged"].where("bar_index = 4").withColumn("bar_index", F.lit(7).cast("long")))
    two["fractals"] = one["fractals"].where("merged_bar_index <> 3")
    two["strokes"] = one["strokes"].withColumns({"end_price": F.lit(0.25), "direction": F.lit("UP")})
    return audit.consistency(one, two)


QUERIES = {
    "fractal_cases": fractal_cases, "planted_provenance": planted_provenance, "planted_registry": planted_registry, "planted_consistency": planted_consistency,
    "segment_cases": cases, "segment_case_elements": case_elements, "segment_source_faults": source_faults, "segment_intents": intents, "segment_emission": emission, "segment_checkpoints": checkpoints,
    "segment_checkpoint_faults": checkpoint_faults, "second_case_chain": second_chain, "primary_evidence_windows": evidence_windows, "feature_element_checks": element_checks,
}


def _values(columns: str, rows: list[str]) -> str:
    return f"select * from (values {', '.join(rows)}) t({columns})"


_UP = "'UP','segment_000001_000004_U','segment:stroke:0->stroke:2',12.0::double,3::bigint,'stroke_000000,stroke_000001,stroke_000002','stroke_000001,stroke_000003,stroke_000005','stroke_000003,stroke_000005'"
_NONE = "null,null,null,null,null,null,null"
_WINDOW = """e as (
  select symbol, sequence_id, stroke_id, direction, start_fractal_id sf, end_fractal_id ef, start_bar_index sb, end_bar_index eb, start_price sp, end_price ep, least(start_price, end_price) lo, greatest(start_price, end_price) hi, confirmed_at_bar vis
  from strokes where symbol is not null and sequence_id is not null and stroke_id is not null and direction is not null and start_fractal_id is not null and end_fractal_id is not null and start_price is not null
    and end_price is not null and start_bar_index is not null and end_bar_index is not null and confirmed_at_bar is not null
    and not exists (select 1 from strokes o where o.symbol is not distinct from strokes.symbol and o.sequence_id is not distinct from strokes.sequence_id and o.stroke_id is not distinct from strokes.stroke_id and o.revision > strokes.revision)),
f as (select distinct * from e),
w as (select *, lead({'i': stroke_id, 'lo': lo, 'hi': hi, 'sb': sb, 'eb': eb, 'sf': sf, 'ef': ef, 'sp': sp, 'ep': ep}) over v b, lead({'i': stroke_id, 'lo': lo, 'hi': hi, 'sb': sb, 'eb': eb, 'sf': sf, 'ef': ef, 'sp': sp, 'ep': ep}, 2) over v c
  from f window v as (partition by symbol, sequence_id, direction order by sb, stroke_id)),
x as (select *, lo a_lo, hi a_hi from w where c is not null)"""

SQL = {
    "fractal_cases": _values("symbol, what, fractal_type, bar", [
        "('top','strict','TOP',1)", "('top','relaxed','TOP',1)", "('top','kept','TOP',1)", "('bottom','strict','BOTTOM',1)", "('bottom','kept','BOTTOM',1)", "('equal_high','relaxed','TOP',1)", "('equal_low','relaxed','BOTTOM',1)",
        "('collapse','strict','TOP',1)", "('collapse','strict','TOP',3)", "('collapse','kept','TOP',3)", "('collapse','replaced','TOP',1)",
        "('tie','strict','TOP',1)", "('tie','strict','TOP',3)", "('tie','kept','TOP',1)", "('tie','replaced','TOP',3)",
    ]),
    "planted_provenance": _values("symbol, source, reason_code", ["('S','b','SOURCE_REPEATED')", "('S','x','SOURCE_UNKNOWN')", "('S','','SOURCE_MISSING')"]),
    "planted_registry": _values("symbol, bar_id, bar_index, reason_code", ["('S','a',2,'RAW_BAR_ID_DUPLICATE')", "('S','',3,'RAW_BAR_ID_REQUIRED')", "('S','null',4,'RAW_BAR_ID_REQUIRED')", "('S','c',-1,'RAW_BAR_INDEX_INVALID')", "('S','d',6,'RAW_BAR_INDEX_DUPLICATE')", "('S','e',6,'RAW_BAR_INDEX_DUPLICATE')"]),
    "planted_consistency": _values("symbol, kind, place, difference", [
        "('S','merged_bar','2','high')", "('S','merged_bar','4','missing_in_second')", "('S','merged_bar','7','missing_in_first')", "('S','fractal','3:BOTTOM','missing_in_second')", "('S','stroke','s1','direction')", "('S','stroke','s1','end_price')",
    ]),
    "segment_cases": _values(
        "symbol, outcome, elements, direction, segment_id, logical_id, end_price, end_bar_index, strokes, features, destruction, confirmed_at_bar, confirmed_at_raw_bar_index, destruction_case, fractal_type, endpoint_id",
        [
            f"('incomplete','SEGMENT_FEATURE_WINDOW_INCOMPLETE',2,'UP',{_NONE},null,null,null,null,null)", f"('merged','SEGMENT_FEATURE_WINDOW_INCOMPLETE',2,'UP',{_NONE},null,null,null,null,null)",
            f"('unseeded','SEGMENT_FEATURE_INCLUSION_UNSEEDED',0,'UP',{_NONE},null,null,null,null,null)", f"('first_up','SEGMENT_FIRST_CASE_CONFIRMED',3,{_UP},6::bigint,16::bigint,'FIRST_CASE','TOP','fx:3')",
            f"('late','SEGMENT_FIRST_CASE_CONFIRMED',3,{_UP},9,16,'FIRST_CASE','TOP','fx:3')",
            "('first_down','SEGMENT_FIRST_CASE_CONFIRMED',3,'DOWN','segment_000001_000004_D','segment:stroke:0->stroke:2',0.0,3,'stroke_000000,stroke_000001,stroke_000002','stroke_000001,stroke_000003,stroke_000005','stroke_000003,stroke_000005',6,16,'FIRST_CASE','BOTTOM','fx:3')",
            f"('pending','SEGMENT_SECOND_CASE_PENDING',3,'UP',{_NONE},null,null,'SECOND_CASE_PENDING','TOP','fx:3')", f"('none','SEGMENT_PRIMARY_FRACTAL_NOT_FOUND',3,'UP',{_NONE},null,null,null,null,null)",
        ],
    ),
    "segment_case_elements": """
with p(symbol, pts) as (values ('incomplete', [0,10,4,12,6]), ('first_up', [0,10,4,12,6,11,5]), ('late', [0,10,4,12,6,11,5]), ('first_down', [12,2,8,0,6,1,7]), ('pending', [0,3,1,8,5,7,4]), ('none', [0,10,4,11,5,12,6])),
s as (select symbol, unnest(range(1, len(pts) - 1, 2)) i, pts from p),
plain as (select symbol, ((i - 1) / 2)::int element_index, least(pts[i + 1], pts[i + 2])::double low, greatest(pts[i + 1], pts[i + 2])::double high, case when symbol = 'late' and i = 3 then 9 else i + 1 end visible_at_bar,
  'stroke_' || lpad(i::varchar, 6, '0') strokes, 'fx:' || (case when pts[i + 1] > pts[i + 2] then i else i + 1 end) high_id, 'fx:' || (case when pts[i + 1] > pts[i + 2] then i + 1 else i end) low_id, null::varchar reason_code from s)
select symbol, element_index, low, high, visible_at_bar::bigint visible_at_bar, strokes, high_id, low_id, reason_code from plain
union all values ('merged', 0, 4.0, 9.0, 2, 'stroke_000001', 'fx:1', 'fx:2', null), ('merged', 1, 6.0, 10.0, 6, 'stroke_000003,stroke_000005', 'fx:3', 'fx:6', null), ('unseeded', null, null, null, null, null, null, null, 'SEGMENT_FEATURE_INCLUSION_UNSEEDED')""",
    "segment_source_faults": _values("symbol, reason_code, outcome", [f"('fault_{k:02d}','{code}','{code}')" for k, (_, _, _, code) in enumerate(FAULTS)]),
    "segment_intents": _values(
        "symbol, place, event_type, reason_code, object_id, logical_id, occurred_at_bar_id, key_length",
        [
            f"('{case}',{place},'{event}','{reason}','segment_000001_000004_{side}_r1','segment:stroke:0->stroke:2','bar_{bar:06d}',42)"
            for case, side, bar in (("first_up", "U", 7), ("late", "U", 10), ("first_down", "D", 7))
            for place, (event, reason) in enumerate(lifecycle.PAIR, 1)
        ],
    ),
    "segment_emission": _values("history, what, detail", [
        "('empty','append','OBJECT_CREATED')", "('empty','append','OBJECT_CONFIRMED')", "('created','append','OBJECT_CONFIRMED')", "('confirmed_only','refuse','SEGMENT_LIFECYCLE_HISTORY_NOT_CANONICAL_PREFIX')",
        "('twice','refuse','SEGMENT_LIFECYCLE_HISTORY_INTENT_KEY_DUPLICATE')", "('unknown_key','refuse','SEGMENT_LIFECYCLE_HISTORY_INTENT_KEY_UNKNOWN')",
        "('changed','refuse','SEGMENT_LIFECYCLE_HISTORY_CONFLICT:occurred_at_bar_id')", "('other_binding','refuse','SEGMENT_LIFECYCLE_HISTORY_CONFLICT:detail')", "('unbound','refuse','SEGMENT_LIFECYCLE_SEGMENT_BINDING_MISMATCH')",
    ]),
    "segment_checkpoints": _values("symbol, refusal, outcome_code, sources, segment_object_id, intents, key_length", [
        "('incomplete',null,'SEGMENT_FEATURE_WINDOW_INCOMPLETE',4,null,0,64)", "('merged',null,'SEGMENT_FEATURE_WINDOW_INCOMPLETE',6,null,0,64)", "('unseeded','SEGMENT_CHECKPOINT_OUTCOME_UNSUPPORTED',null,null,null,null,null)",
        "('first_up',null,'SEGMENT_FIRST_CASE_CONFIRMED',6,'segment_000001_000004_U_r1',2,64)", "('late',null,'SEGMENT_FIRST_CASE_CONFIRMED',6,'segment_000001_000004_U_r1',2,64)",
        "('first_down',null,'SEGMENT_FIRST_CASE_CONFIRMED',6,'segment_000001_000004_D_r1',2,64)", "('pending',null,'SEGMENT_SECOND_CASE_PENDING',6,null,0,64)", "('none',null,'SEGMENT_PRIMARY_FRACTAL_NOT_FOUND',6,null,0,64)",
    ]),
    "segment_checkpoint_faults": _values("what, symbol, reason_code, fields", [
        "('status','first_up','SEGMENT_CHECKPOINT_STATE_MISMATCH','segment_confirmed_at_bar')", "('status','pending','SEGMENT_CHECKPOINT_STATE_MISMATCH','segment_confirmed_at_bar')",
        "('key','first_up','SEGMENT_CHECKPOINT_STATE_MISMATCH','state_key')", "('key','pending','SEGMENT_CHECKPOINT_STATE_MISMATCH','state_key')", "('half','first_up','SEGMENT_CHECKPOINT_LIFECYCLE_INCOMPLETE',null)",
        "('stray','pending','SEGMENT_CHECKPOINT_ZERO_EVENT_OUTCOME_HAS_EVENTS',null)",
    ]),
    "second_case_chain": _values("evidence, refusal, state, reason_code", [
        "('nothing',null,'SECOND_CASE_PENDING','SECOND_CASE_EVIDENCE_PENDING')", "('confirmed',null,'SECOND_CASE_CONFIRMED','SECOND_SEQUENCE_FRACTAL_CONFIRMED')", "('confirmed_first',null,'SECOND_CASE_CONFIRMED','SECOND_SEQUENCE_FRACTAL_CONFIRMED')",
        "('extreme_first',null,'INVALIDATED','PENDING_DESTRUCTION_INVALIDATED')", "('same_bar',null,'SECOND_CASE_CONFIRMED','SECOND_SEQUENCE_FRACTAL_CONFIRMED')", "('extreme_only',null,'INVALIDATED','PENDING_DESTRUCTION_INVALIDATED')",
        "('touch_only',null,'SECOND_CASE_PENDING','ORIGINAL_DIRECTION_EXTREME_NOT_STRICT')", "('touch_and_confirmed',null,'SECOND_CASE_CONFIRMED','SECOND_SEQUENCE_FRACTAL_CONFIRMED')",
        "('other_key','SECONDARY_PRIMARY_EVIDENCE_KEY_MISMATCH',null,null)", "('other_endpoint','SECONDARY_PENDING_ENDPOINT_MISMATCH',null,null)", "('other_sequence','SECONDARY_SEQUENCE_ID_MISMATCH',null,null)",
        "('wrong_fractal','SECONDARY_CONFIRMATION_FRACTAL_MISMATCH',null,null)", "('too_early','secondary confirmation precedes pending endpoint',null,null)", "('extreme_too_early','extreme evidence must follow pending endpoint',null,null)",
        "('doubled','duplicate secondary confirmation evidence',null,null)",
    ]),
    "primary_evidence_windows": f"""
with {_WINDOW},
r as (select *, case
    when stroke_id = b.i or stroke_id = c.i or b.i = c.i then 'DUPLICATE_PRIMARY_ELEMENT_ID'
    when (select count(distinct p) from unnest([{{'f': sf, 'b': sb, 'p': sp, 'i': stroke_id}}, {{'f': ef, 'b': eb, 'p': ep, 'i': stroke_id}}, {{'f': b.sf, 'b': b.sb, 'p': b.sp, 'i': b.i}}, {{'f': b.ef, 'b': b.eb, 'p': b.ep, 'i': b.i}}, {{'f': c.sf, 'b': c.sb, 'p': c.sp, 'i': c.i}}, {{'f': c.ef, 'b': c.eb, 'p': c.ep, 'i': c.i}}]) u(p))
      > (select count(distinct p) from unnest([sf, ef, b.sf, b.ef, c.sf, c.ef]) u(p)) then 'PRIMARY_ENDPOINT_IDENTITY_MISMATCH'
    when eb > b.sb then 'PRIMARY_LEFT_CENTER_TIME_OVERLAP' when b.eb > c.sb then 'PRIMARY_CENTER_RIGHT_TIME_OVERLAP' end refusal,
  case when direction = 'DOWN' then b.hi > greatest(hi, c.hi) and b.lo > greatest(lo, c.lo) else b.hi < least(hi, c.hi) and b.lo < least(lo, c.lo) end found, hi < b.lo or b.hi < lo gap from x)
select symbol, stroke_id, refusal, case when refusal is null then case when not found then 'NONE' when gap then 'SECOND_CASE_PENDING' else 'FIRST_CASE' end end "case",
  case when refusal is null then case when not found then 'FEATURE_FRACTAL_REQUIRED' when gap then 'SECOND_CASE_GAP_PENDING' else 'FIRST_CASE_NO_GAP_CONFIRMED' end end reason_code,
  case when refusal is null and found then case when direction = 'DOWN' then b.hi else b.lo end end price,
  case when refusal is null and found then case when (direction = 'DOWN') = (b.sp < b.ep) then b.eb else b.sb end end bar, case when refusal is null then 64 end key_length from r""",
    "feature_element_checks": f"""
with {_WINDOW}
select symbol, stroke_id, case when stroke_id = '' or sequence_id = '' then 'ELEMENT_ID_REQUIRED' when direction not in ('UP', 'DOWN') then 'ELEMENT_DIRECTION_INVALID' when sb > eb then 'ELEMENT_TIME_INVERTED' when vis < eb then 'ELEMENT_VISIBILITY_INVALID' end unsound,
  case when not (lo <= b.lo and hi >= b.hi) and not (b.lo <= lo and b.hi >= hi) then 'FEATURE_INTERVALS_NOT_INCLUDED' else 'DIRECTION_UNSEEDED' end no_merge,
  case when lo = b.lo and hi = b.hi then 'EQUAL' when lo <= b.lo and hi >= b.hi then 'CONTAINS' when b.lo <= lo and b.hi >= hi then 'CONTAINED_BY' when hi = b.lo or b.hi = lo then 'TOUCHING' when hi < b.lo or b.hi < lo then 'DISJOINT' else 'OVERLAP' end relation from x""",
}
