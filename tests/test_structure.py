"""The structure parser: literal cases, invariants, and chunked folds against one pass."""

import datetime as dt
import random

import pytest

from barloom.functions.kernels import merge_fold, normalise_features, primary_segment, stroke_fold
from barloom.operators.lifecycle import emit, first_case_intents
from barloom.operators.inclusion import assign_merged, merged_bars
from barloom.operators.quality import flag_bars, quality_report
from barloom.operators.segments import primary_segments, source_errors
from barloom.plans.structure import event_log, parse
from barloom.profile import Profile
from barloom.sources.bars import from_rows, resolve_columns
from barloom.streaming.incremental import RebuildBoundaryExceeded, _fractal_id, advance, empty_state


@pytest.mark.parametrize(
    "bars, new",
    [
        ([(105, 98)], [1]), ([(105, 98), (108, 102)], [1, 1]), ([(105, 98), (104, 100)], [1, 0]), ([(105, 98), (105, 97)], [1, 1]),
    ],
)
def test_merge_cases(bars, new):
    assert merge_fold([b[0] for b in bars], [b[1] for b in bars], None)[0] == new


def test_merge_direction_is_carried_over_an_equal_bound():
    high, low = [101, 100, 100, 99], [96, 95, 94, 95]
    _, dirs, state = merge_fold(high[:3], low[:3], None)
    new, dirs, state = merge_fold(high[3:], low[3:], state)
    assert new == [0] and state == [99, 94, -1]


def test_relaxed_policy_merges_equal_bars():
    assert merge_fold([5, 5], [1, 1], None)[0] == [1, 1] and merge_fold([5, 5], [1, 1], None, strict=False)[0] == [1, 0]


def rows(points, flat=(105, 98), last=20, **special):
    out = []
    for i in range(last):
        h, l = special.get(f"b{i}", flat)
        top = next((p for k, j, p in points if j == i and k == "T"), None)
        bottom = next((p for k, j, p in points if j == i and k == "B"), None)
        out.append((i, h if top is None else top, l if bottom is None else bottom, top, bottom))
    return out


@pytest.mark.parametrize(
    "points, special, outcomes",
    [
        ([("B", 1, 97), ("T", 8, 108)], {}, ["STROKE"]),
        ([("T", 1, 108), ("B", 8, 95)], {}, ["STROKE"]),
        ([("B", 0, 97), ("T", 3, 108)], {}, ["INSUFFICIENT_MERGED_BARS"]),
        ([("B", 1, 97), ("T", 8, 108), ("B", 15, 95)], {}, ["STROKE", "STROKE"]),
        ([("B", 1, 97), ("B", 5, 95), ("T", 12, 110)], {}, ["SAME_TYPE_ANCHOR_COLLAPSED", "STROKE"]),
        ([("B", 1, 97), ("T", 8, 108)], {"b4": (110, 98)}, ["ENDPOINT_NOT_INTERVAL_EXTREME"]),
        ([("B", 1, 97), ("T", 8, 90)], {}, ["NON_POSITIVE_UP_RANGE"]),
    ],
)
def test_stroke_cases(points, special, outcomes):
    made, _ = stroke_fold(rows(points, **special), None)
    assert [d[6] for d in made] == outcomes
    for cut in range(1, 19):  # any two chunks give the same
        a, state = stroke_fold(rows(points, **special)[:cut], None)
        b, _ = stroke_fold(rows(points, **special)[cut:], state)
        assert a + b == made


def zigzag(points, confirmed=None):
    out = []
    for i, (a, b) in enumerate(zip(points, points[1:])):
        out.append({"stroke_id": f"stroke_{i:06d}", "logical_id": f"stroke:{i}", "object_id": f"stroke_{i:06d}_r1", "direction": "UP" if b > a else "DOWN", "start_price": float(a), "end_price": float(b), "start_bar_index": i, "end_bar_index": i + 1, "start_fractal_id": f"fx:{i}", "end_fractal_id": f"fx:{i + 1}", "confirmed_at_bar": (confirmed or {}).get(i, i + 1), "created_at_raw_bar_index": i + 11, "confirmed_at_raw_bar_index": i + 11, "status": "CONFIRMED"})
    return out


@pytest.mark.parametrize(
    "points, outcome, elements",
    [
        ([0, 10, 4, 12, 6], "SEGMENT_FEATURE_WINDOW_INCOMPLETE", 2), ([0, 10, 4, 9, 5, 11, 6], "SEGMENT_FEATURE_INCLUSION_UNSEEDED", 0),
        ([0, 10, 4, 12, 6, 11, 5], "SEGMENT_FIRST_CASE_CONFIRMED", 3), ([12, 2, 8, 0, 6, 1, 7], "SEGMENT_FIRST_CASE_CONFIRMED", 3),
        ([0, 3, 1, 8, 5, 7, 4], "SEGMENT_SECOND_CASE_PENDING", 3), ([0, 10, 4, 11, 5, 12, 6], "SEGMENT_PRIMARY_FRACTAL_NOT_FOUND", 3),
    ],
)
def test_segment_outcomes(points, outcome, elements):
    r = primary_segment(zigzag(points))
    assert (r["outcome"], r["elements"]) == (outcome, elements)


def test_segment_details(spark):
    s = primary_segment(zigzag([0, 10, 4, 12, 6, 11, 5]))["segment"]
    n = lambda rows: [int(r["stroke_id"][-1]) for r in rows]
    assert (n(s["strokes"]), n(s["features"]), n(s["destruction"]), s["end_bar_index"], s["end_price"], s["confirmed_at_bar"]) == ([0, 1, 2], [1, 3, 5], [3, 5], 3, 12.0, 6)
    assert primary_segment(zigzag([0, 10, 4, 12, 6, 11, 5], {3: 9}))["segment"]["confirmed_at_bar"] == 9
    merged, _ = normalise_features([x for x in zigzag([0, 9, 4, 10, 5, 10, 6]) if x["direction"] == "DOWN"])
    assert (merged[1]["low"], merged[1]["high"], n(merged[1]["sources"]), merged[1]["ends"]["high"]["endpoint_id"]) == (6.0, 10.0, [3, 5], "fx:3")
    df = spark.createDataFrame([r | {"symbol": "S", "sequence_id": "q"} for r in zigzag([0, 10, 4, 12, 6, 11, 5])])
    seg = primary_segments(df)
    row = seg.first()
    assert row.segment_id == "segment_000001_000004_U" and row.logical_id == "segment:stroke:0->stroke:2" and row.stroke_ids == ["stroke_000000", "stroke_000001", "stroke_000002"] and row.confirmed_at_raw_bar_index == 16
    assert source_errors(df).count() == 0
    made = first_case_intents(seg).selectExpr("*", "cast(place as long) as seq")
    for kept, new in ((made.where("false"), 2), (made.where("place = 1"), 1), (made, 0)):
        fresh, refused = emit(seg, df, kept)
        assert fresh.count() == new and refused.count() == 0


def test_hashes_and_registry(spark):
    from pyspark.sql import functions as F

    from barloom.functions.bars import bar_hash
    from barloom.operators.audit import confirmed_hash, log_hash, merged_hash, result_hash, revisions
    from barloom.operators.inclusion import registry_errors

    data = spark.createDataFrame(walk(3, 60), BARS)
    before = spark.conf.get("spark.sql.session.timeZone")
    seen = set()
    for zone in ("UTC", "America/New_York"):  # a bar's hash doesn't depend on the session
        spark.conf.set("spark.sql.session.timeZone", zone)
        seen.add(tuple(r.h for r in data.select(bar_hash().alias("h")).orderBy("bar_index").collect()))
    spark.conf.set("spark.sql.session.timeZone", before)
    assert len(seen) == 1
    t = parse(data)
    assert result_hash(t).first() == result_hash(parse(data, chunk=7)).first()
    assert result_hash(t).first() != result_hash(parse(data.where("bar_index < 50"))).first()
    assert t["merged"].select(merged_hash().alias("h")).distinct().count() == t["merged"].count()
    log = event_log(t)
    assert log_hash(log).first() == log_hash(log.repartition(5)).first() != log_hash(log.where("event_id <> 'evt_00000001'")).first()
    x = t["strokes"].withColumn("engine_version", F.lit("1"))
    assert confirmed_hash(x, "stroke_id").first() == confirmed_hash(x.withColumn("engine_version", F.lit("2")), "stroke_id").first()
    bad = data.where("bar_index < 4").withColumn("bar_id", F.expr("case bar_index when 1 then '' when 2 then 'bar_000001' else bar_id end")).unionByName(data.where("bar_index = 3").withColumn("bar_id", F.lit("z")))
    assert {(r.bar_id, r.reason_code) for r in registry_errors(bad).collect()} == {("", "RAW_BAR_ID_REQUIRED"), ("bar_000001", "RAW_BAR_ID_DUPLICATE"), ("bar_000004", "RAW_BAR_INDEX_DUPLICATE"), ("z", "RAW_BAR_INDEX_DUPLICATE")}
    assert registry_errors(data).count() == 0
    rev = spark.createDataFrame([("S", "a", 2, "a_r2"), ("S", "a", 1, "a_r1"), ("S", "b", 1, "b_r1"), ("S", "a", 2, "a_r2")], "symbol string, logical_id string, revision int, object_id string")
    assert {(r.logical_id, tuple(r.chain), r.latest) for r in revisions(rev).collect()} == {("a", ("a_r1", "a_r2"), "a_r2"), ("b", ("b_r1",), "b_r1")}


BARS = "symbol string, bar_id string, bar_index long, timestamp timestamp_ntz, open double, high double, low double, close double, volume double"


def walk(seed, n, symbol="S"):
    rnd, c, out = random.Random(seed), 100.0, []
    for i in range(n):
        o, c = c, round(c + rnd.gauss(0, 2), 2)
        out.append((symbol, f"bar_{i + 1:06d}", i, dt.datetime(2020, 1, 1) + dt.timedelta(minutes=30 * i), o, round(max(o, c) + abs(rnd.gauss(0, 1)), 2), round(min(o, c) - abs(rnd.gauss(0, 1)), 2), c, 1.0))
    return out


def test_chunked_folds_equal_one_pass_and_invariants(spark):
    data = walk(42, 300) + walk(43, 120, "T")
    df = spark.createDataFrame(data, BARS)
    one, many = parse(df), parse(df, chunk=37)
    for name in ("merged", "fractals", "strokes"):
        assert sorted(map(str, one[name].collect())) == sorted(map(str, many[name].collect())), name
    merged = one["merged"].collect()
    covered = sorted((m.symbol, i) for m in merged for i in m.source_raw_bar_indices)
    assert covered == sorted((r[0], r[2]) for r in data)
    for s in one["strokes"].collect():
        assert s.merged_bar_count >= 5 and (s.start_price < s.end_price) == (s.direction == "UP") and s.confirmed_at_bar is None or s.confirmed_at_bar > s.end_bar_index
    ids = [r.event_id for r in event_log(one).where("symbol = 'S'").collect()]
    assert len(ids) == len(set(ids)) and max(ids) == f"evt_{len(ids):08d}"


def test_top_and_bottom_on_one_bar(spark):
    hl = [(9, 4), (10, 5), (10, 4), (11, 3), (10.5, 4), (10, 4.5)]
    df = spark.createDataFrame([("S", f"b{i}", i, dt.datetime(2020, 1, 1, i), float(l), float(h), float(l), float(h), 1.0) for i, (h, l) in enumerate(hl)], BARS)
    t = parse(df)
    assert [(m.high, m.low) for m in t["merged"].orderBy("bar_index").collect()] == [(9, 4), (10, 5), (11, 4), (10.5, 4.5)]
    assert sorted((f.fractal_type, f.price, f.merged_bar_index) for f in t["candidates"].collect()) == [("BOTTOM", 4, 2), ("TOP", 11, 2)]


def test_empty_tables(spark):
    t = parse(spark.createDataFrame([], BARS))
    assert all(df.count() == 0 for df in t.values()) and event_log(t).count() == 0
    assert merged_bars(assign_merged(spark.createDataFrame([], BARS), Profile())).count() == 0


def test_quality_flags(spark):
    day = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([("S", "a", 0, day, 1.0, 2.0, 0.5, 1.0, 1.0), ("S", "b", 1, day, 1.0, 2.0, 0.5, 1.0, 1.0), ("S", "c", 3, day + dt.timedelta(1), 1.0, 0.9, 1.5, float("nan"), 1.0), ("S", "d", 5, None, 1.0, 2.0, 0.5, None, 1.0), ("S", "e", 6, day + dt.timedelta(2), 1.0, 2.0, 0.5, 1.0, 1.0)], BARS)
    flagged = flag_bars(df)
    got = {r.bar_id: r.validation_errors for r in flagged.collect()}
    assert got == {"a": [], "b": ["duplicate timestamp", "non-monotonic timestamp"], "c": ["high<low", "high<open", "low>open", "close missing"], "d": ["close missing", "timestamp missing"], "e": []}
    r = quality_report(flagged).first()
    assert (r.raw_bar_count, r.valid_bar_count, r.duplicate_count, r.missing_interval_count, r.status) == (5, 2, 1, 5, "WARNING")


def test_row_source(spark):
    df = spark.createDataFrame([("2020/1/2", "1", "2", "0.5", "1", ""), ("20200103", "1", "x", "1", "1", "5"), ("20200104101500", "1", "2", "1", "1", "7"), ("2020-01-05T10:00:00", "1", "2", "1", "1", None)], "Date string, O string, h string, LOW string, Close string, vol string")
    from pyspark.sql import functions as F

    bars, errors = from_rows(df.withColumn("_seq", F.monotonically_increasing_id()), F.lit("S"), ["_seq"])
    got = {r.bar_index: (r.timestamp, r.volume) for r in bars.collect()}
    assert got == {0: (dt.datetime(2020, 1, 2), 0.0), 2: (dt.datetime(2020, 1, 4, 10, 15), 7.0), 3: (dt.datetime(2020, 1, 5, 10), 0.0)}
    assert errors.first().parse_errors == 1
    with pytest.raises(ValueError):
        resolve_columns(["date", "open", "high"])


def test_profile_refuses_unknown_settings():
    for bad in ({"window_size": 5}, {"equal_high_low_policy": "maybe"}, {"colour": 1}, {"allow_equal_high": 1}):
        with pytest.raises(ValueError):
            Profile.from_mapping(bad)


@pytest.mark.parametrize("step", [1, 2, 7, 250])
def test_incremental_equals_batch(step):
    data = [(r[2], r[5], r[6]) for r in walk(12, 250)]
    whole, _ = advance(empty_state(), data)
    state, seen = empty_state(), {}
    for k in range(0, len(data), step):
        state, events = advance(state, data[k : k + step])
        for e in events:
            if e["status"] == "INVALIDATED":
                seen.pop(e["logical_id"], None)
            else:
                seen[e["logical_id"]] = e["status"]
    new, dirs, _ = merge_fold([d[1] for d in data], [d[2] for d in data], None)
    assert {k: v for k, v in seen.items()} == _batch(data)
    assert len(state["bars"]) < 60


def _batch(data):
    state, events = advance(empty_state(), data)
    return {e["logical_id"]: e["status"] for e in events}


def test_late_bars_and_boundary():
    state, _ = advance(empty_state(), [(1, 5.0, 1.0)])
    _, events = advance(state, [(1, 6.0, 2.0)])
    assert [e["reason_code"] for e in events] == ["APPEND_ORDER"]
    with pytest.raises(RebuildBoundaryExceeded):
        s = empty_state()
        for i in range(60):  # a rising series never makes a turning point
            s, _ = advance(s, [(i, 10.0 + i, 9.0 + i)], Profile(max_rebuild_distance=20))
    assert _fractal_id("TOP", 3) == "fractal:top:mbar:idx_3"


def test_planted_cases_give_the_stated_rows(spark):
    import duckdb

    from barloom.plans.segment_queries import QUERIES, SQL

    for name in ("fractal_cases", "planted_provenance", "planted_registry", "planted_consistency", "segment_cases", "segment_source_faults", "segment_intents", "segment_checkpoints", "second_case_chain"):
        got = QUERIES[name](spark, "")
        r = duckdb.sql(SQL[name])
        assert set(got.columns) == set(r.columns), name
        assert sorted(map(str, (tuple(x[c] for c in r.columns) for x in got.collect()))) == sorted(map(str, r.fetchall())), name


def test_snapshots_and_restore(spark):
    from barloom.streaming.incremental import OUT, checkpoint_bars, current, restored, snapshot_at, snapshot_bars

    data = [(r[2], r[5], r[6]) for r in walk(12, 250)]
    names = [c.split()[0] for c in OUT.split(", ")]
    state, rows, at = empty_state(), [], {}
    for k in range(0, 250, 10):
        state, events = advance(state, data[k : k + 10])
        rows += [tuple({**e, "symbol": "S", "at_bar_index": k + 9, "ord": k}[c] for c in (*names, "ord")) for e in events]
        at[k + 9] = _batch(data[: k + 10])
    changes = spark.createDataFrame(rows, OUT + ", ord long")
    kept = sorted(r.at_bar_index for r in snapshot_bars(changes).collect())
    assert len(kept) <= 20
    for bar in (kept[0], kept[-1]):
        assert {r.logical_id: r.status for r in snapshot_at(changes, "S", bar).collect()} == at[bar]
    with pytest.raises(KeyError):
        snapshot_at(changes, "S", 9, Profile(snapshot_retention=2))
    point = sorted(r.at_bar_index for r in checkpoint_bars(changes).collect())[-2]
    back = restored(changes, "S", point)
    assert {r.logical_id: r.status for r in current(back).collect()} == at[point]
    assert back.where("event_type = 'CHECKPOINT_RESTORED'").count() == 1 and max(r.at_bar_index for r in checkpoint_bars(back).collect()) == point
    with pytest.raises(KeyError):
        restored(changes, "S", 3)
