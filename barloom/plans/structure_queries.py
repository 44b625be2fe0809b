"""Queries of the structure operators over bars made of the test tables, and their SQL.

H: hourly bars of events by type; Q: four successive values of a user as open, high, low, close;
X: line items in order with their ship date as time.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import rules
from barloom.functions.bars import validation_errors
from barloom.operators import audit, events, lifecycle, quality, segments as seg
from barloom.operators.fractals import fractal_candidates, fractal_replacements, fractals
from barloom.operators.inclusion import assign_merged, merged_bars, provenance_errors
from barloom.operators.quality import flag_bars, input_checksum, quality_report, with_ordinals
from barloom.operators.strokes import strokes
from barloom.plans.structure import event_log, parse, segments
from barloom.profile import Profile
from barloom.session import read_table
from barloom.sources.bars import resample


def hourly(s: SparkSession, d: str) -> DataFrame:
    e = read_table(s, d, "events")
    return resample(e, F.col("event_type"), F.col("ts"), F.col("value"), [F.col("event_id")], "hour")


def quads(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = read_table(s, d, "events").select("user_id", "ts", "event_id", "value").withColumn("i", F.row_number().over(w) - 1)
    g = x.groupBy("user_id", F.floor(F.col("i") / 4).alias("bar_index")).agg(*[F.max(F.when(F.col("i") % 4 == k, F.col("value"))).alias(c) for k, c in enumerate(("open", "high", "low", "close"))], F.count("*").alias("n"))
    return g.where("n = 4").select(F.col("user_id").alias("symbol"), "bar_index", "open", "high", "low", "close")


def items(s: SparkSession, d: str) -> DataFrame:
    x = read_table(s, d, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("timestamp"), F.col("l_extendedprice").cast("double").alias("p"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    x = with_ordinals(x, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"])
    return flag_bars(x.select("symbol", "bar_id", "bar_index", "timestamp", *[F.col("p").alias(c) for c in ("open", "high", "low", "close")]))


def _tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return parse(hourly(s, d))


def _prices(df: DataFrame) -> DataFrame:
    return df.select("symbol", "bar_index", "timestamp", "open", "high", "low", "close", "volume", "merge_direction", F.size("source_raw_bar_ids").alias("sources"), "visible_at_raw_bar_index", "logical_id")


def _legs(df: DataFrame) -> DataFrame:
    return df.select("symbol", "stroke_id", "direction", "start_fractal_id", "end_fractal_id", "start_price", "end_price", "start_bar_index", "end_bar_index", "merged_bar_count", "max_price", "min_price", "status", "confirmed_at_bar", "created_at_raw_bar_index", "confirmed_at_raw_bar_index")


def _triples(merged: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("bar_index")
    bar = F.struct("low", "high")
    x = merged.select("symbol", "bar_index", bar.alias("a"), F.lead(bar).over(w).alias("b"), F.lead(bar, 2).over(w).alias("c"))
    return x.where("c is not null")


def interval_rules(s: SparkSession, d: str) -> DataFrame:
    x = _triples(_tables(s, d)["merged"])
    a, b, c = ((F.col(f"{k}.low"), F.col(f"{k}.high")) for k in "abc")
    low, high, reason = rules.merge_intervals(a, b, rules.inclusion_seed(a, c))
    case, price = rules.primary_destruction(F.when(F.col("bar_index") % 2 == 0, "UP").otherwise("DOWN"), a, b, c)
    return x.select(
        "symbol", "bar_index", rules.interval_relation(a, b).alias("relation"), rules.feature_gap(a, b).alias("gap"), rules.inclusion_seed(a, b).alias("seed"),
        rules.strict_fractal(a, b, c).alias("fractal"), case.alias("destruction"), price.alias("endpoint"), low.alias("merged_low"), high.alias("merged_high"), reason.alias("merge_reason"),
    )


def _flags(s: SparkSession, names: list[str]) -> DataFrame:
    return s.createDataFrame(list(product([False, True], repeat=len(names))), ", ".join(f"{n} boolean" for n in names))


def lifecycle_resolution(s: SparkSession, d: str) -> DataFrame:
    names = ["has_window", "provisional", "previously", "complete", "invalidated", "has_reverse", "reverse"]
    x = _flags(s, names)
    state, reason = rules.lifecycle(*[F.col(n) for n in names[:5]], F.when(F.col("has_reverse"), F.lit("segment:r")), F.col("reverse"))
    return x.select(*names, state.alias("state"), reason.alias("reason_code"))


def pen_break(s: SparkSession, d: str) -> DataFrame:
    names = ["observed", "formed", "countered"]
    state, reason = rules.failed_pen_break(*[F.col(n) for n in names])
    return _flags(s, names).select(*names, state.alias("state"), reason.alias("reason_code"))


def second_case(s: SparkSession, d: str) -> DataFrame:
    x = _tables(s, d)["strokes"].select("symbol", "stroke_id", F.when(F.col("end_bar_index") % 3 > 0, F.col("end_bar_index")).alias("confirmed_at"), F.when(F.col("start_bar_index") % 4 > 0, F.col("price_range") > 100).alias("strict_extreme"), (F.col("start_bar_index") + 7).alias("observed_at"))
    state, reason = rules.second_case_state(F.col("confirmed_at"), F.col("strict_extreme"), F.col("observed_at"))
    return x.select("symbol", "stroke_id", state.alias("state"), reason.alias("reason_code"))


def arbitration(s: SparkSession, d: str) -> DataFrame:
    x = _tables(s, d)["strokes"].select("symbol", F.col("end_bar_index").alias("endpoint"), F.col("start_bar_index").alias("start"), "logical_id", "direction")
    x = x.select(F.concat_ws(":", "symbol", F.floor(F.col("endpoint") / 40).cast("string")).alias("pool"), "endpoint", "start", "logical_id", F.col("direction").alias("exclusivity"))
    return rules.arbitrate(x)


def window_contract(s: SparkSession, d: str) -> DataFrame:
    """Every three successive strokes as a candidate, and with the stroke after them as a segment."""
    w = Window.partitionBy("symbol").orderBy("end_bar_index")
    one = F.struct("stroke_id", "logical_id", "direction", "start_fractal_id", "end_fractal_id", "start_bar_index", "end_bar_index", "status", audit.stroke_hash().alias("content_hash"))
    x = _tables(s, d)["strokes"]
    x = x.select("symbol", "stroke_id", *[F.lead(one, k).over(w).alias(f"s{k}") for k in range(4)]).where("s2 is not null")
    window = [F.col(f"s{k}") for k in range(3)]
    x = x.select("symbol", "stroke_id", rules.candidate_contract(window, "PROVISIONAL").alias("p"), rules.candidate_contract(window, "CONFIRMED", [F.col("s3")]).alias("c"))
    return x.select("symbol", "stroke_id", F.col("p.reason_code").alias("provisional"), F.col("c.reason_code").alias("confirmed"), F.length("p.candidate_key").alias("key_length"), F.length("c.evidence_key").alias("proof_length"), F.array_join("p.feature_stroke_ids", ",").alias("features"), F.col("c.earliest_bar").alias("earliest_bar"))


def boundary_contract(s: SparkSession, d: str) -> DataFrame:
    """Strokes stand in for segments: their ends are the endpoints."""
    x = _tables(s, d)["strokes"].select("symbol", F.col("stroke_id").alias("logical_id"), "direction", F.col("start_fractal_id").alias("start_endpoint_id"), F.col("end_fractal_id").alias("end_endpoint_id"), "start_bar_index")
    return rules.boundary_errors(x).select("symbol", "logical_id", "reason_code")


def prefix_contract(s: SparkSession, d: str) -> DataFrame:
    """Each bar against the one before it, as two snapshots of a prefix."""
    w = Window.partitionBy("symbol").orderBy("bar_index")
    x = hourly(s, d).select("symbol", "bar_index", F.when(F.col("bar_index") % 5 > 0, F.floor(F.col("bar_index") / 3).cast("string")).alias("h"), F.floor("volume").alias("n"), (F.col("bar_index") % 7).alias("t"), (F.col("bar_index") % 2 == 0).alias("c"))
    x = x.withColumns({k: F.lag(v).over(w) for k, v in (("h0", "h"), ("n0", "n"), ("t0", "t"))}).where("n0 is not null")
    return x.select("symbol", "bar_index", rules.prefix_transition(*[F.col(k) for k in ("h0", "h", "n0", "n", "t0", "t", "c")]).alias("reason_code"))


def confirmation_bars(s: SparkSession, d: str) -> DataFrame:
    x = _tables(s, d)["strokes"]
    bar, reason = rules.confirmation_bar(F.col("end_bar_index"), F.filter(F.array("created_at_bar", "confirmed_at_bar", F.col("start_bar_index")), lambda v: v.isNotNull() & (v % 2 == 0)))
    return x.select("symbol", "stroke_id", bar.alias("confirmed_at"), reason.alias("reason_code"))


def retention(s: SparkSession, d: str) -> DataFrame:
    n = Profile().snapshot_retention
    w = Window.partitionBy("symbol").orderBy(F.col("bar_index").desc())
    return hourly(s, d).withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).select("symbol", "bar_id", F.col("k").cast("int").alias("k"))


def consistency_diff(s: SparkSession, d: str) -> DataFrame:
    bars = hourly(s, d)
    return audit.consistency(parse(bars), parse(bars, chunk=97))


def lineage(s: SparkSession, d: str) -> DataFrame:
    t = _tables(s, d)
    return audit.lineage_edges(t["merged"], t["fractals"], t["strokes"], segments(t))


def envelope(s: SparkSession, d: str) -> DataFrame:
    t = _tables(s, d)
    seg_ = segments(t)
    return _flat(lifecycle.checkpoint_states(seg_, t["sequences"], lifecycle.first_case_intents(seg_)).select("symbol", "sequence_id", "refusal", "outcome_code", "candidate_direction", F.size("source_stroke_content_hashes").alias("sources"), F.length("state_key").alias("key_length")))


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*[F.array_join(c, ",").alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes])


RELAXED = Profile(allow_equal_high=True, allow_equal_low=True)

QUERIES = {
    "resample_ohlcv": lambda s, d: hourly(s, d),
    "validation_errors": lambda s, d: quads(s, d).select("symbol", "bar_index", F.array_join(validation_errors(), ",").alias("errors")),
    "bar_flags": lambda s, d: items(s, d).select("symbol", "bar_index", F.array_join("validation_errors", ",").alias("errors"), "is_valid"),
    "quality_report": lambda s, d: quality_report(items(s, d)),
    "input_checksum": lambda s, d: input_checksum(flag_bars(hourly(s, d))),
    "merged_bars": lambda s, d: _prices(merged_bars(assign_merged(hourly(s, d)))),
    "merged_relaxed": lambda s, d: _prices(merged_bars(assign_merged(hourly(s, d), Profile(equal_high_low_policy="inclusive")))),
    "merged_provenance": lambda s, d: assign_merged(hourly(s, d)).select("symbol", "bar_id", "merged_index"),
    "provenance_errors": lambda s, d: provenance_errors(merged_bars(assign_merged(hourly(s, d))), hourly(s, d)),
    "fractal_candidates": lambda s, d: fractal_candidates(_tables(s, d)["merged"]),
    "fractals_allow_equal": lambda s, d: fractal_candidates(_tables(s, d)["merged"], RELAXED),
    "fractals": lambda s, d: _tables(s, d)["fractals"].select("symbol", "fractal_id", "fractal_type", "merged_bar_index", "price", "status", "confirmed_at_bar", "logical_id"),
    "fractal_replacements": lambda s, d: fractal_replacements(_tables(s, d)["candidates"]),
    "strokes": lambda s, d: _legs(_tables(s, d)["strokes"]),
    "strokes_no_tail": lambda s, d: _legs(parse(hourly(s, d), Profile(allow_unconfirmed_tail=False))["strokes"]),
    "stroke_rejections": lambda s, d: _tables(s, d)["decisions"].where("outcome <> 'STROKE'").select("symbol", "start_bar_index", "start_type", "end_bar_index", "end_type", "outcome"),
    "stroke_summary": lambda s, d: _tables(s, d)["strokes"].groupBy("symbol", "direction", "status").agg(F.count("*").alias("n"), F.max("price_range").alias("largest"), F.sum("merged_bar_count").alias("bars")),
    "stroke_sequences": lambda s, d: _tables(s, d)["sequences"].select("symbol", "stroke_id", "sequence_id"),
    "interval_rules": interval_rules,
    "feature_sequence": lambda s, d: seg.feature_sequence(_tables(s, d)["sequences"]),
    "feature_elements": lambda s, d: seg.feature_elements(_tables(s, d)["sequences"]).select("symbol", "sequence_id", "element_index", "low", "high", "visible_at_bar", F.array_join("stroke_ids", ",").alias("strokes"), "reason_code"),
    "segment_source_errors": lambda s, d: seg.source_errors(_tables(s, d)["sequences"]),
    "segments": lambda s, d: segments(_tables(s, d)).select("symbol", "sequence_id", "outcome", "elements", "direction", "segment_id", "destruction_case"),
    "second_case_resolution": second_case,
    "winner_arbitration": arbitration,
    "lifecycle_resolution": lifecycle_resolution,
    "failed_pen_break": pen_break,
    "window_contract": window_contract,
    "boundary_contract": boundary_contract,
    "prefix_contract": prefix_contract,
    "confirmation_bar": confirmation_bars,
    "event_log": lambda s, d: event_log(_tables(s, d)),
    "event_counts": lambda s, d: event_log(_tables(s, d)).groupBy("symbol", "object_type", "event_type", "reason_code").agg(F.count("*").alias("n")),
    "consistency_diff": consistency_diff,
    "lineage_edges": lineage,
    "lineage_closure": lambda s, d: audit.ancestors(lineage(s, d)),
    "state_envelope": envelope,
    "retention_topn": retention,
}

_H = """hb as (
  select *, row_number() over (partition by symbol order by timestamp) - 1 bar_index from (
    select event_type symbol, date_trunc('hour', ts)::timestamp "timestamp", arg_min(value, ts) "open", max(value) high, min(value) low, arg_max(value, ts) "close", count(*)::double volume
    from events group by all))"""


def _merged(inc: str) -> str:
    return f"""{_H}, fold as (
  select b.symbol, b.bar_index i, b.high h, b.low l, case when n.high < b.high and n.low < b.low then -1 else 1 end d, 0::bigint m
  from hb b left join hb n on n.symbol = b.symbol and n.bar_index = 1 where b.bar_index = 0
  union all
  select symbol, i, case when inc then case when d = 1 then greatest(h, bh) else least(h, bh) end else bh end, case when inc then case when d = 1 then greatest(l, bl) else least(l, bl) end else bl end,
    case when inc then d when bh > h and bl > l then 1 when bh < h and bl < l then -1 else d end, case when inc then m else m + 1 end
  from (select f.symbol, b.bar_index i, f.h, f.l, f.d, f.m, b.high bh, b.low bl, ({inc}) inc from fold f join hb b on b.symbol = f.symbol and b.bar_index = f.i + 1)),
mb as (
  select symbol, m bar_index, max("timestamp") "timestamp", arg_min("open", i) "open", arg_max(h, i) high, arg_max(l, i) low, arg_max("close", i) "close", sum(volume) volume,
    case when max(d) = 1 then 'UP' else 'DOWN' end merge_direction, count(*)::int sources, max(i) visible_at_raw_bar_index, 'mbar:idx_' || m logical_id
  from fold f join (select symbol, bar_index, "timestamp", "open", "close", volume from hb) b using (symbol) where b.bar_index = f.i group by symbol, m)"""


_MERGED = _merged("(b.high < f.h and b.low > f.l) or (f.h < b.high and f.l > b.low)")
_FRACTALS = f"""{_MERGED}, nb as (select *, lag(high) over w ph, lag(low) over w pl, lead(high) over w nh, lead(low) over w nl from mb window w as (partition by symbol order by bar_index)),
fc as (
  select symbol, bar_index merged_bar_index, 'TOP' fractal_type, high price from nb where high > ph and high > nh
  union all select symbol, bar_index, 'BOTTOM', low from nb where low < pl and low < nl),
fr as (
  select *, sum(new) over (partition by symbol order by merged_bar_index, fractal_type desc) run from (
    select *, case when fractal_type = lag(fractal_type) over (partition by symbol order by merged_bar_index, fractal_type desc) then 0 else 1 end new from fc)),
fs as (
  select *, row_number() over (partition by symbol order by run) k, lead(run) over (partition by symbol order by run) is null tail from (
    select *, row_number() over (partition by symbol, run order by case when fractal_type = 'TOP' then price else -price end desc, merged_bar_index) r from fr) where r = 1)"""
_NAME = "'fx_' || lpad(({0} + 1)::varchar, 6, '0') || '_' || left({1}, 1)"
_STROKES = f"""{_FRACTALS}, hl as (select symbol, list(high order by bar_index) hs, list(low order by bar_index) ls from mb group by symbol),
walk as (
  select symbol, 1::bigint k, merged_bar_index ai, fractal_type aty, price ap, null::bigint si, null::varchar st, null::double sp, null::bigint ei, null::varchar et, null::double ep, null::varchar outcome from fs where k = 1
  union all
  select symbol, k, case when moves then ei else ai end, case when moves then et else aty end, case when moves then ep else ap end, ai, aty, ap, ei, et, ep, outcome from (
    select *, outcome = 'STROKE' or (outcome = 'SAME_TYPE_ANCHOR_COLLAPSED' and case when et = 'TOP' then ep > ap else ep < ap end) moves from (
      select w.symbol, f.k, w.ai, w.aty, w.ap, f.merged_bar_index ei, f.fractal_type et, f.price ep,
        case when w.aty = f.fractal_type then 'SAME_TYPE_ANCHOR_COLLAPSED' when f.merged_bar_index - w.ai + 1 < 5 then 'INSUFFICIENT_MERGED_BARS'
          when f.fractal_type = 'TOP' and f.price <= w.ap then 'NON_POSITIVE_UP_RANGE' when f.fractal_type = 'BOTTOM' and f.price >= w.ap then 'NON_POSITIVE_DOWN_RANGE'
          when (f.fractal_type = 'TOP' and (list_max(list_slice(hs, w.ai + 1, f.merged_bar_index + 1)) > f.price or list_min(list_slice(ls, w.ai + 1, f.merged_bar_index + 1)) < w.ap))
            or (f.fractal_type = 'BOTTOM' and (list_min(list_slice(ls, w.ai + 1, f.merged_bar_index + 1)) < f.price or list_max(list_slice(hs, w.ai + 1, f.merged_bar_index + 1)) > w.ap)) then 'ENDPOINT_NOT_INTERVAL_EXTREME'
          else 'STROKE' end outcome
      from walk w join fs f on f.symbol = w.symbol and f.k = w.k + 1 join hl on hl.symbol = w.symbol))),
st as (
  select symbol, si start_bar_index, st start_type, sp start_price, ei end_bar_index, et end_type, ep end_price,
    lead(si) over w = ei and lead(st) over w = et ok, lead(ei) over w nei
  from walk where outcome = 'STROKE' window w as (partition by symbol order by ei)),
legs as (
  select s.symbol, 'stroke_' || lpad((start_bar_index + 1)::varchar, 6, '0') || '_' || lpad((end_bar_index + 1)::varchar, 6, '0') || case when end_type = 'TOP' then '_U' else '_D' end stroke_id,
    case when end_type = 'TOP' then 'UP' else 'DOWN' end direction, {_NAME.format("start_bar_index", "start_type")} start_fractal_id, {_NAME.format("end_bar_index", "end_type")} end_fractal_id,
    start_price, end_price, start_bar_index, end_bar_index, (end_bar_index - start_bar_index + 1)::int merged_bar_count,
    list_max(list_slice(hs, start_bar_index + 1, end_bar_index + 1)) max_price, list_min(list_slice(ls, start_bar_index + 1, end_bar_index + 1)) min_price,
    case when coalesce(ok, false) then 'CONFIRMED' else 'PROVISIONAL' end status, case when ok then nei end confirmed_at_bar,
    v.visible_at_raw_bar_index created_at_raw_bar_index, case when ok then lead(v.visible_at_raw_bar_index) over (partition by s.symbol order by end_bar_index) end confirmed_at_raw_bar_index
  from st s join hl on hl.symbol = s.symbol left join mb v on v.symbol = s.symbol and v.bar_index = s.end_bar_index + 1),
seqs as (
  select *, 'seq:' || symbol || ':' || sum(new) over (partition by symbol order by end_bar_index) sequence_id from (
    select *, case when start_fractal_id = lag(end_fractal_id) over (partition by symbol order by end_bar_index) then 0 else 1 end new from legs where status = 'CONFIRMED'))"""

_FLAGS = "(values (false), (true))"
_COLS = "symbol, bar_index, \"timestamp\", \"open\", high, low, \"close\", volume, merge_direction, sources, visible_at_raw_bar_index, logical_id"
_ITEMS = """x as (
  select l_returnflag symbol, l_shipdate::timestamp t, row_number() over (partition by l_returnflag order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 bar_index from lineitem),
y as (
  select *, row_number() over (partition by symbol, t order by bar_index) > 1 dup, coalesce(t <= lag(t) over (partition by symbol order by bar_index), false) mono from x)"""
_ERRORS = "array_to_string(list_filter([case when {0} then '{1}' end for_, null], lambda e: e is not null), ',')"
_FRACTAL_LOGICAL = "'fractal:' || lower({1}) || ':mbar:idx_' || {0}"
_LINEAGE = f"""{_STROKES}, edges as (
  select f.symbol, 'mbar:idx_' || m child, 'merged_bar' child_type, 'bar_' || lpad((i + 1)::varchar, 6, '0') parent from fold f
  union all select symbol, {_FRACTAL_LOGICAL.format("merged_bar_index", "fractal_type")}, 'fractal', 'mbar:idx_' || (merged_bar_index + o) from fs, (values (-1), (0), (1)) v(o)
  union all select symbol, 'stroke:' || {_FRACTAL_LOGICAL.format("start_bar_index", "start_type")} || '->' || {_FRACTAL_LOGICAL.format("end_bar_index", "end_type")}, 'stroke', case when o = 0 then {_FRACTAL_LOGICAL.format("start_bar_index", "start_type")} else {_FRACTAL_LOGICAL.format("end_bar_index", "end_type")} end from st, (values (0), (1)) v(o))"""

SQL = {
    "resample_ohlcv": f"with {_H} select symbol, \"timestamp\", \"open\", high, low, \"close\", volume, bar_index::bigint bar_index, 'bar_' || lpad((bar_index + 1)::varchar, 6, '0') bar_id from hb",
    "validation_errors": """
with x as (select user_id symbol, value, row_number() over (partition by user_id order by ts, event_id) - 1 i from events),
q as (select symbol, i // 4 bar_index, max(value) filter (where i % 4 = 0) o, max(value) filter (where i % 4 = 1) h, max(value) filter (where i % 4 = 2) l, max(value) filter (where i % 4 = 3) c from x group by 1, 2 having count(*) = 4)
select symbol, bar_index, concat_ws(',', case when h < l then 'high<low' end, case when h < o then 'high<open' end, case when h < c then 'high<close' end, case when l > o then 'low>open' end, case when l > c then 'low>close' end) errors from q""",
    "bar_flags": f"with {_ITEMS} select symbol, bar_index, concat_ws(',', case when dup then 'duplicate timestamp' end, case when mono then 'non-monotonic timestamp' end) errors, not (dup or mono) is_valid from y",
    "quality_report": f"""with {_ITEMS}, g as (select symbol, greatest(bar_index - lag(bar_index) over (partition by symbol order by bar_index) - 1, 0) gap from y where not (dup or mono))
select symbol, count(*) raw_bar_count, count(*) filter (where not (dup or mono)) valid_bar_count, count(*) filter (where dup) duplicate_count,
  (select coalesce(sum(gap), 0)::bigint from g where g.symbol = y.symbol) missing_interval_count, not bool_or(mono) monotonic_timestamp,
  case when bool_or(dup or mono) then 'WARNING' else 'OK' end status from y group by symbol""",
    "input_checksum": f"""with {_H}, h as (select symbol, bar_index, left(sha256(concat_ws('|', bar_index::varchar, epoch_us("timestamp")::varchar, round("open" * 1000000)::bigint::varchar, round(high * 1000000)::bigint::varchar, round(low * 1000000)::bigint::varchar, round("close" * 1000000)::bigint::varchar, round(volume * 1000000)::bigint::varchar)), 16) x from hb)
select symbol, left(sha256(sha256(string_agg(x, '|' order by bar_index))), 16) input_checksum from h group by symbol""",
    "merged_bars": f"with recursive {_MERGED} select {_COLS} from mb",
    "merged_relaxed": f"with recursive {_merged('(b.high <= f.h and b.low >= f.l) or (f.h <= b.high and f.l >= b.low)')} select {_COLS} from mb",
    "merged_provenance": f"with recursive {_MERGED} select symbol, 'bar_' || lpad((i + 1)::varchar, 6, '0') bar_id, m merged_index from fold",
    "provenance_errors": "select event_type symbol, '' source, '' reason_code from events where false",
    "fractal_candidates": f"with recursive {_FRACTALS} select symbol, merged_bar_index, fractal_type, price from fc",
    "fractals_allow_equal": f"""with recursive {_FRACTALS}
select symbol, bar_index merged_bar_index, 'TOP' fractal_type, high price from nb where (high >= ph and high > nh and low >= pl and low > nl) or (high > ph and high >= nh and low > pl and low >= nl)
union all select symbol, bar_index, 'BOTTOM', low from nb where (low <= pl and low < nl and high <= ph and high < nh) or (low < pl and low <= nl and high < ph and high <= nh)""",
    "fractals": f"with recursive {_FRACTALS} select symbol, {_NAME.format('merged_bar_index', 'fractal_type')} fractal_id, fractal_type, merged_bar_index, price, case when tail then 'PROVISIONAL' else 'CONFIRMED' end status, case when not tail then merged_bar_index + 1 end confirmed_at_bar, {_FRACTAL_LOGICAL.format('merged_bar_index', 'fractal_type')} logical_id from fs",
    "strokes": f"with recursive {_STROKES} select symbol, stroke_id, direction, start_fractal_id, end_fractal_id, start_price, end_price, start_bar_index, end_bar_index, merged_bar_count, max_price, min_price, status, confirmed_at_bar, created_at_raw_bar_index, confirmed_at_raw_bar_index from legs",
    "strokes_no_tail": f"with recursive {_STROKES} select symbol, stroke_id, direction, start_fractal_id, end_fractal_id, start_price, end_price, start_bar_index, end_bar_index, merged_bar_count, max_price, min_price, status, confirmed_at_bar, created_at_raw_bar_index, confirmed_at_raw_bar_index from legs where status = 'CONFIRMED'",
    "stroke_rejections": f"with recursive {_STROKES} select symbol, si start_bar_index, st start_type, ei end_bar_index, et end_type, outcome from walk where outcome <> 'STROKE'",
    "stroke_summary": f"with recursive {_STROKES} select symbol, direction, status, count(*) n, max(abs(end_price - start_price)) largest, sum(merged_bar_count)::bigint bars from legs group by all",
    "stroke_sequences": f"with recursive {_STROKES} select symbol, stroke_id, sequence_id from seqs",
    "interval_rules": f"""with recursive {_MERGED}, t as (
  select symbol, bar_index, low al, high ah, lead(low) over w bl, lead(high) over w bh, lead(low, 2) over w cl, lead(high, 2) over w ch from mb window w as (partition by symbol order by bar_index)),
r as (
  select *, case when al = bl and ah = bh then 'EQUAL' when al <= bl and ah >= bh then 'CONTAINS' when bl <= al and bh >= ah then 'CONTAINED_BY' when ah = bl or bh = al then 'TOUCHING' when ah < bl or bh < al then 'DISJOINT' else 'OVERLAP' end relation,
    ah < bl or bh < al gap, case when bh > ah and bl > al then 'UP' when bh < ah and bl < al then 'DOWN' else 'UNSEEDED' end seed,
    case when bh > ah and bh > ch and bl > al and bl > cl then 'TOP' when bh < ah and bh < ch and bl < al and bl < cl then 'BOTTOM' else 'NONE' end fractal,
    case when ch > ah and cl > al then 'UP' when ch < ah and cl < al then 'DOWN' else 'UNSEEDED' end ms, case when bar_index % 2 = 0 then 'UP' else 'DOWN' end dir from t where cl is not null),
z as (select *, fractal = case when dir = 'UP' then 'TOP' else 'BOTTOM' end fnd, case when relation not in ('EQUAL', 'CONTAINS', 'CONTAINED_BY') then 'FEATURE_INTERVALS_NOT_INCLUDED' when ms = 'UNSEEDED' then 'DIRECTION_UNSEEDED' end merge_reason from r)
select symbol, bar_index, relation, gap, seed, fractal, case when not fnd then 'NONE' when gap then 'SECOND_CASE_PENDING' else 'FIRST_CASE' end destruction, case when fnd then case when dir = 'UP' then bh else bl end end endpoint,
  case when merge_reason is null then case when ms = 'UP' then greatest(al, bl) else least(al, bl) end end merged_low, case when merge_reason is null then case when ms = 'UP' then greatest(ah, bh) else least(ah, bh) end end merged_high, merge_reason from z""",
    "feature_sequence": f"""with recursive {_STROKES}, d as (select *, first_value(direction) over (partition by symbol, sequence_id order by start_bar_index) fd from seqs)
select symbol, sequence_id, row_number() over (partition by symbol, sequence_id order by start_bar_index)::int feature_index, stroke_id, least(start_price, end_price) low, greatest(start_price, end_price) high, confirmed_at_bar visible_at_bar from d where direction <> fd""",
    "segment_source_errors": "select event_type symbol, '' sequence_id, '' stroke_id, '' reason_code from events where false",
    "second_case_resolution": f"""with recursive {_STROKES}, e as (
  select symbol, stroke_id, case when end_bar_index % 3 > 0 then end_bar_index end c, case when start_bar_index % 4 > 0 then abs(end_price - start_price) > 100 end x, start_bar_index + 7 o from legs),
w as (select *, c is not null and (not coalesce(x, false) or c <= o) wins from e)
select symbol, stroke_id, case when wins then 'SECOND_CASE_CONFIRMED' when coalesce(x, false) then 'INVALIDATED' else 'SECOND_CASE_PENDING' end state,
  case when wins then 'SECOND_SEQUENCE_FRACTAL_CONFIRMED' when coalesce(x, false) then 'PENDING_DESTRUCTION_INVALIDATED' when x is not null then 'ORIGINAL_DIRECTION_EXTREME_NOT_STRICT' else 'SECOND_CASE_EVIDENCE_PENDING' end reason_code from w""",
    "winner_arbitration": f"""with recursive {_STROKES}, c as (
  select l.symbol || ':' || (l.end_bar_index // 40) pool, l.end_bar_index endpoint, l.start_bar_index "start", 'stroke:' || {_FRACTAL_LOGICAL.format("s.start_bar_index", "s.start_type")} || '->' || {_FRACTAL_LOGICAL.format("s.end_bar_index", "s.end_type")} logical_id, l.direction exclusivity
  from legs l join st s on s.symbol = l.symbol and s.end_bar_index = l.end_bar_index and s.start_bar_index = l.start_bar_index),
w as (select *, row_number() over w r, first_value(exclusivity) over w fx from c window w as (partition by pool order by endpoint, "start", logical_id))
select pool, endpoint, "start", logical_id, exclusivity, case when r = 1 then 'WINNER' when fx = exclusivity then 'INVALIDATED' else 'REMAINS' end outcome from w""",
    "lifecycle_resolution": f"""with f as (select a.v has_window, b.v provisional, c.v previously, d.v complete, e.v invalidated, g.v has_reverse, h.v reverse from {_FLAGS} a(v), {_FLAGS} b(v), {_FLAGS} c(v), {_FLAGS} d(v), {_FLAGS} e(v), {_FLAGS} g(v), {_FLAGS} h(v)),
r as (select *, case when has_reverse and not reverse then 'REVERSE_NOT_CONFIRMED'
    when not has_window then case when provisional or complete or invalidated or previously or reverse or has_reverse then 'LIFECYCLE_EVIDENCE_WITHOUT_CANDIDATE' else 'NO_CANDIDATE_LIFECYCLE_FORBIDDEN' end
    when (provisional and complete) or (complete and invalidated) or (provisional and invalidated) then 'CONTRADICTORY_EVIDENCE'
    when reverse and not has_reverse then 'REVERSE_ID_REQUIRED' when previously and (not complete or provisional) then 'CONFIRMED_REQUIRES_COMPLETE_EVIDENCE' when not previously and has_reverse then 'REPLACED_REQUIRES_CONFIRMED' end reason_code from f)
select *, case when reason_code is null then case when previously then case when has_reverse then 'REPLACED' else 'CONFIRMED' end when invalidated then 'INVALIDATED' when complete then 'CONFIRMED' when provisional then 'PROVISIONAL' else 'CANDIDATE' end end state from r""",
    "failed_pen_break": f"""select a.v observed, b.v formed, c.v countered, case when not a.v then 'NONE' when b.v then null when c.v then 'INVALIDATED' else 'NONE' end state,
  case when not a.v then 'PEN_BREAK_NOT_OBSERVED' when b.v then 'COMPLETED_FRACTAL' when c.v then 'PEN_BREAK_EVIDENCE_INVALIDATED' else 'PEN_BREAK_PROVISIONAL' end reason_code from {_FLAGS} a(v), {_FLAGS} b(v), {_FLAGS} c(v)""",
    "window_contract": f"""with recursive {_STROKES}, w as (
  select symbol, stroke_id, direction d0, lead(direction) over w d1, lead(direction, 2) over w d2, lead(direction, 3) over w d3, end_fractal_id e0, lead(start_fractal_id) over w s1, lead(end_fractal_id) over w e1, lead(start_fractal_id, 2) over w s2, lead(end_fractal_id, 2) over w e2,
    lead(start_fractal_id, 3) over w s3, status t0, lead(status) over w t1, lead(status, 2) over w t2, lead(status, 3) over w t3, lead(stroke_id) over w i1, lead(start_bar_index, 3) over w b3, lead(end_bar_index, 2) over w x2, lead(end_bar_index, 3) over w x3
  from legs window w as (partition by symbol order by end_bar_index)),
p as (select *, case when d0 = d1 then 'SEGMENT_STROKE_DIRECTION_NOT_ALTERNATING' when e0 <> s1 then 'SEGMENT_STROKE_ENDPOINT_NOT_CONTIGUOUS' when d1 = d2 then 'SEGMENT_STROKE_DIRECTION_NOT_ALTERNATING' when e1 <> s2 then 'SEGMENT_STROKE_ENDPOINT_NOT_CONTIGUOUS'
  when d0 <> d2 then 'SEGMENT_FIRST_LAST_DIRECTION_MISMATCH' end f from w where t2 is not null),
q as (select *, coalesce(f, case when t0 <> 'CONFIRMED' or t1 <> 'CONFIRMED' then 'SEGMENT_ONLY_TAIL_MAY_BE_PROVISIONAL' when t2 not in ('CONFIRMED', 'PROVISIONAL') then 'SEGMENT_TAIL_STATUS_INVALID' end, 'SEGMENT_CONTRACT_ELIGIBLE') provisional,
  coalesce(f, case when t0 <> 'CONFIRMED' or t1 <> 'CONFIRMED' or t2 <> 'CONFIRMED' then 'SEGMENT_UNCONFIRMED_WINDOW_STROKE' when t3 is null then 'SEGMENT_DESTRUCTION_EVIDENCE_REQUIRED' when t3 <> 'CONFIRMED' then 'SEGMENT_DESTRUCTION_EVIDENCE_UNCONFIRMED'
    when b3 < x2 then 'SEGMENT_DESTRUCTION_EVIDENCE_TOO_EARLY' when d3 = d2 then 'SEGMENT_DESTRUCTION_EVIDENCE_DIRECTION_NOT_ALTERNATING' when e2 <> s3 then 'SEGMENT_DESTRUCTION_EVIDENCE_ENDPOINT_NOT_CONTIGUOUS' end, 'SEGMENT_CONTRACT_ELIGIBLE') confirmed from p)
select symbol, stroke_id, provisional, confirmed, case when provisional = 'SEGMENT_CONTRACT_ELIGIBLE' then 20 end key_length, case when confirmed = 'SEGMENT_CONTRACT_ELIGIBLE' then 20 end proof_length, case when provisional = 'SEGMENT_CONTRACT_ELIGIBLE' then i1 end features,
  case when confirmed = 'SEGMENT_CONTRACT_ELIGIBLE' then x3 end earliest_bar from q""",
    "boundary_contract": f"""with recursive {_STROKES}, w as (select *, lag(stroke_id) over w pid, lag(direction) over w pd, lag(end_fractal_id) over w pe from legs window w as (partition by symbol order by start_bar_index, stroke_id))
select symbol, stroke_id logical_id, case when pid = stroke_id then 'SG_DUPLICATE_ADJACENT_LOGICAL_ID' when pd = direction then 'SG_ADJACENT_DIRECTION_NOT_ALTERNATING' when pe <> start_fractal_id then 'SG_ADJACENT_ENDPOINT_NOT_SHARED' end reason_code from w""",
    "prefix_contract": f"""with {_H}, x as (select symbol, bar_index::bigint bar_index, case when bar_index % 5 > 0 then (bar_index // 3)::varchar end h, volume::bigint n, bar_index % 7 t, bar_index % 2 = 0 c from hb),
w as (select *, lag(h) over w h0, lag(n) over w n0, lag(t) over w t0 from x window w as (partition by symbol order by bar_index))
select symbol, bar_index, case when h0 is null or h is null then 'FROZEN_PREFIX_HASH_REQUIRED' when h0 <> h then 'FROZEN_PREFIX_REWRITE_FORBIDDEN' when n < n0 then 'LIFECYCLE_EVENT_DELETION_FORBIDDEN' when t < t0 then 'CONFIRMATION_TIME_BACKFILL_FORBIDDEN'
  when t <> t0 and not c then 'CORRECTION_FLAG_REQUIRED' when c and n <= n0 then 'CORRECTION_EVENT_APPEND_REQUIRED' end reason_code from w where n0 is not null""",
    "confirmation_bar": f"""with recursive {_STROKES}, v as (select *, list_filter([end_bar_index + 1, confirmed_at_bar, start_bar_index], lambda x: x is not null and x % 2 = 0) l from legs)
select symbol, stroke_id, case when len(l) > 0 and list_max(l) >= end_bar_index then list_max(l) end confirmed_at, case when len(l) = 0 then 'VISIBILITY_REQUIRED' when list_max(l) < end_bar_index then 'CONFIRMATION_TIME_BACKFILL_FORBIDDEN' end reason_code from v""",
    "event_counts": f"""with recursive {_STROKES}, e as (
  select symbol, 'merged_bar' object_type, unnest(['OBJECT_CREATED', 'OBJECT_CONFIRMED']) event_type, unnest(['INCLUSION_NORMALIZED', 'MERGED_BAR_FINALIZED']) reason_code from mb
  union all select symbol, 'fractal', 'OBJECT_CREATED', 'THREE_BAR_PATTERN_DETECTED' from fc
  union all select symbol, 'fractal', 'STRUCTURE_REPLACED', 'SAME_TYPE_MORE_EXTREME' from fr where new = 0
  union all select symbol, 'fractal', case when tail then 'STATUS_CHANGED' else 'OBJECT_CONFIRMED' end, case when tail then 'TAIL_FRACTAL_PROVISIONAL' else 'NEXT_ACTIVE_FRACTAL_OBSERVED' end from fs
  union all select symbol, 'stroke_candidate', 'CANDIDATE_REJECTED', outcome from walk where outcome <> 'STROKE'
  union all select symbol, 'stroke', 'OBJECT_CREATED', 'STRICT_STROKE_VALID' from legs
  union all select symbol, 'stroke', 'OBJECT_CONFIRMED', 'NEXT_STRICT_STROKE_CONFIRMED' from legs where status = 'CONFIRMED')
select symbol, object_type, event_type, reason_code, count(*) n from e group by all""",
    "consistency_diff": "select event_type symbol, '' kind, '' place, '' difference from events where false",
    "lineage_edges": f"with recursive {_LINEAGE} select * from edges",
    "lineage_closure": f"""with recursive {_LINEAGE}, e1 as (select distinct symbol, child node, parent ancestor from edges), s as (select symbol, child, parent from edges),
e2 as (select distinct e1.symbol, node, parent ancestor from e1 join s on s.symbol = e1.symbol and s.child = e1.ancestor), e3 as (select distinct e2.symbol, node, parent ancestor from e2 join s on s.symbol = e2.symbol and s.child = e2.ancestor)
select symbol, node, ancestor, min(depth)::int depth from (select *, 1 depth from e1 union all select *, 2 from e2 union all select *, 3 from e3) group by all""",
    "retention_topn": f"with {_H}, r as (select symbol, 'bar_' || lpad((bar_index + 1)::varchar, 6, '0') bar_id, row_number() over (partition by symbol order by bar_index desc)::int k from hb) select * from r where k <= 20",
}
