"""The general data operators against brute force and on odd input."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest

from barloom.operators.differences import stroke_differences
from barloom.operators.history import version_history
from barloom.operators.spikes import implausible_bars
from barloom.operators.timestamps import normalise_timestamps
from barloom.sources.rejects import load_csv_records

FEEDS = [("ny", "America/New_York", "MDY"), ("be", "Europe/Berlin", "DMY"), ("no", None, "YMD"), ("in", "Asia/Kolkata", "DMY")]


def us(*a, tz="UTC"):
    t = dt.datetime(*a, tzinfo=ZoneInfo(tz))
    return round(t.timestamp() * 1_000_000)


def stamps(spark, rows):
    bars = spark.createDataFrame([(i, f, "S", k, t, "x") for i, (f, k, t) in enumerate(rows)], "row_id long, feed string, symbol string, bar_index long, timestamp string, utc_us string")
    return {r.row_id: r.utc_us for r in normalise_timestamps(bars, spark.createDataFrame(FEEDS, "feed string, venue_zone string, date_order string")).collect()}


def test_timestamps_notations(spark):
    cases = [
        ("ny", "2020-01-05 10:00:00", us(2020, 1, 5, 15)), ("be", "05.01.2020 10:00:00", us(2020, 1, 5, 9)), ("ny", "05/01/2020 10:00", us(2020, 5, 1, 14)),
        ("ny", "05/01/2020 12:30:00 AM", us(2020, 5, 1, 4, 30)), ("be", "2020-01-05T10:00Z", us(2020, 1, 5, 10)), ("no", "20200105T100000z", us(2020, 1, 5, 10)),
        ("no", "1578218400", us(2020, 1, 5, 10)), ("no", "1578218400123", us(2020, 1, 5, 10) + 123000), ("no", "1578218400000007", us(2020, 1, 5, 10) + 7),
        ("be", "\t2020-02-29 ", us(2020, 2, 28, 23)), ("be", "20200105100000", us(2020, 1, 5, 9)), ("in", "5 Jan 2020 10:00:00", us(2020, 1, 5, 4, 30)),
        ("no", "Sun, 05 Jan 2020 10:00:00 -0330", us(2020, 1, 5, 13, 30)), ("be", "2020-01-05T10:00:00+05:45[Asia/Kathmandu]", us(2020, 1, 5, 4, 15)),
        ("no", "2020-01-05 10:00:00 Europe/London", us(2020, 1, 5, 10)), ("in", "2020-07-05 10:00:00 IST", us(2020, 7, 5, 4, 30)), ("no", "2020-01-05 10:00:00,208", None),
        ("be", "2020-01-05 10:00:00,208", us(2020, 1, 5, 9) + 208000), ("be", "2020-01-05T10:00:00.123456789Z", us(2020, 1, 5, 10) + 123456),
        ("be", "2020-13-05", None), ("be", "2021-02-29", None), ("be", "0000-00-00 00:00:00", None), ("be", "2020-03-29 02:30:00", None), ("be", "1970", None), ("be", "", None), ("be", None, None),
        ("be", "2020-01-05 10:00:00 XYZ", None), ("be", "2020-01-05 10:00:00 No/Where", None), ("be", "2020-01-05 24:00:00", None), ("zz", "2020-01-05 10:00:00", None), (None, "2020-01-05T10:00:00Z", us(2020, 1, 5, 10)),
    ]
    got = stamps(spark, [(f, 0, t) for f, t, _ in cases])
    assert {i: got.get(i) for i in range(len(cases))} == {i: w for i, (_, _, w) in enumerate(cases)}


def test_timestamps_twice_shown_hour(spark):
    # 15-minute bars of Berlin through the end of summer time, with bars missing and one repeated
    start = us(2021, 10, 30, 23)
    want, rows = {}, []
    for k in range(20):
        t = start + k * 900_000_000
        local = dt.datetime.fromtimestamp(t / 1e6, ZoneInfo("Europe/Berlin"))
        if k in (6, 9):
            continue
        want[len(rows)] = t
        rows.append(("be", k, local.strftime("%Y-%m-%d %H:%M:%S")))
    want[len(rows)] = start + 10 * 900_000_000
    rows.append(("be", 10, rows[[k for _, k, _ in rows].index(10)][2]))
    assert stamps(spark, rows) == want


def test_timestamps_empty(spark):
    assert stamps(spark, []) == {}


SNAP = "ingest_seq long, symbol string, snapshot_bar long, logical_id string, revision int, status string, confirmed_at_bar long, digest string, leaf int"


def brute_history(rows):
    best, bars = {}, {}
    for r in rows:
        if r[1] is None or r[2] is None:
            continue
        bars.setdefault(r[1], set()).add(r[2])
        if r[3] is not None:
            v = (r[4], (r[5] or "").strip().upper() if r[5] is not None else None, -1 if r[6] is None else r[6])
            if (r[1], r[2], r[3]) not in best or best[r[1], r[2], r[3]][0] < r[0]:
                best[r[1], r[2], r[3]] = (r[0], v)
    out = set()
    for s, o in {(k[0], k[2]) for k in best}:
        order = sorted(bars[s])
        start, last = None, None
        for b in [*order, -1]:
            v = best.get((s, b, o), (0, None))[1]
            if v != last:
                if last is not None:
                    out.add((s, o, start, b, *last))
                start, last = b, v
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_history_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for b in range(0, 200, 10):
        for o in range(12):
            if rnd.random() < 0.9:
                rows.append((len(rows), rnd.choice("AB"), b, rnd.choice([f"o{o}", f"o{o}", f"o{o}", None]), rnd.choice([1, 1, 1, 2]), rnd.choice([" confirmed", "CONFIRMED ", "Candidate", None]), rnd.choice([None, None, 5]), "d", 1))
    rows += rows[:7]
    for shape in ((16, 32), (1, 2)):
        got = version_history(spark.createDataFrame(rows, SNAP), *shape).collect()
        assert {tuple(r) for r in got} == brute_history(rows) and len(got) == len(set(got))


def test_history_of_unchanged_and_vanishing_objects(spark):
    rows, seq = [], 0
    for b in range(60):
        for o in range(40):
            if (o, b // 20) != (3, 1):  # object 3 vanishes and returns
                seq += 1
                rows.append((seq, "S", b, f"o{o}", None if o == 5 and b >= 30 else 1, None if o == 6 and b < 10 else "X", b // 50 if o == 7 else None, "d", 1))
    for shape in ((16, 32), (2, 4)):
        got = version_history(spark.createDataFrame(rows, SNAP), *shape).collect()
        assert {tuple(r) for r in got} == brute_history(rows) and len(got) == 40 + 4


def test_history_empty_and_null(spark):
    assert version_history(spark.createDataFrame([], SNAP)).count() == 0
    assert version_history(spark.createDataFrame([(1, None, 1, "a", 1, "x", None, "", 0), (1, "S", 1, None, 1, "x", None, "", 0)], SNAP)).count() == 0


CSV = "line_id long, file_id string, line_no int, line string"


def test_csv_reasons(spark):
    lines = [
        ("﻿Date;o;h;LOW;Close;v;remark\r", None), ("2020-01-01;1;2;+.5;1.;;", None), ('2020-01-01;"1";2;1;1e0;3;"a;b"\r', None), ('x;1;2;1;1;3;"two\nlines"', None), ('x;1;2;1;1;3;"say ""hi"""', None),
        ('x;1;2;1;1;3;"open', "quoting"), ('x;1;2;1;1;3;a"b', "quoting"), ('x;1;2;1;1;3; "a"', "quoting"), ('x;1;2;1;1;3;"a"b', "quoting"), ('x";1;2', "quoting"),
        ("x;1;2;1;1;3", "columns"), ("x;1;2;1;1;3;;", "columns"), ("", "columns"), (None, "columns"), ("x;;2;1;1;3;", "open"), ("x;0;2;1;1;3;", "open"), ("x;1;inf;1;1;3;", "high"), ("x;1;2;-1;1;3;", "low"),
        ("x;1;2;1;１;3;", "close"), ("x;1;2;1;1;-3;", "volume"), ("x;1;2;1;1; ;", None), ("x;1;2;1;1;n/a;", "volume"), ("x; 1 ;2;1;1;-0;", None), ("x;1_0;2;1;1;3;", "open"),
    ]
    df = spark.createDataFrame([(i, "f", i + 1, x) for i, (x, _) in enumerate(lines)], CSV)
    for chunk in (20_000, 5):
        got = {r.line_id: r for r in load_csv_records(df, chunk).collect()}
        assert {i: got[i].reason for i in range(1, len(lines))} == {i: w for i, (_, w) in enumerate(lines) if i}
        assert got[1].low == 0.5 and got[1].volume is None and got[2].volume == 3.0 and got[2].bar_time == "2020-01-01"


def test_csv_without_header_and_empty(spark):
    got = load_csv_records(spark.createDataFrame([(1, "f", 2, "a,1"), (2, None, 3, "b")], CSV)).collect()
    assert {r.reason for r in got} == {"columns"}
    assert load_csv_records(spark.createDataFrame([], CSV)).count() == 0


STROKES = "symbol string, logical_id string, revision int, start_price double, end_price double, status string, side string, chunk string"


def test_differences_against_brute_force(spark):
    rnd = random.Random(3)
    a, b = [], []
    for i in range(600):
        row = ("S" if i % 3 else "T", f"id{i}", 1, rnd.choice([1.5, 2.25, None]), 10.0 + i, rnd.choice(["CONFIRMED", None]), "x", "y")
        if rnd.random() < 0.97:
            a.append(row)
        if rnd.random() < 0.1:
            a.append((*row[:2], 0, 99.0, 99.0, "X", "x", "y"))
        other = list(row)
        if rnd.random() < 0.05:
            other[3] = rnd.choice([None, 1.5001, 1.50004])
        if rnd.random() < 0.05:
            other[5] = "replaced "
        other[1] = f" {row[1]} "
        other[4] += 1e-12
        if rnd.random() < 0.97:
            b.append(tuple(other))
    b += b[:20] + [(None, None, 1, 1.0, 1.0, "x", "", "")]

    def top(rows):
        out = {}
        for r in rows:
            if r[1] is not None:
                k = (r[0], r[1].strip())
                if k not in out or out[k][2] < r[2]:
                    out[k] = r
        return out

    want, x, y = set(), top(a), top(b)
    up = lambda s: s.strip().upper() if s is not None else None
    apart = lambda p, q: (p is None) != (q is None) or (p is not None and abs(p - q) > 0.00005)
    for k in x.keys() | y.keys():
        if k not in y:
            want.add((*k, "missing_in_copy"))
        elif k not in x:
            want.add((*k, "missing_in_strokes"))
        else:
            want |= {(*k, n) for n, bad in (("start_price", apart(x[k][3], y[k][3])), ("end_price", apart(x[k][4], y[k][4])), ("status", up(x[k][5]) != up(y[k][5]))) if bad}
    got = stroke_differences(spark.createDataFrame(a, STROKES), spark.createDataFrame(b, STROKES), shard_rows=100)
    assert {tuple(r) for r in got.collect()} == want
    empty = spark.createDataFrame([], STROKES)
    assert stroke_differences(empty, empty).count() == 0


def test_differences_of_swapped_nulls(spark):
    a = [("S" if i % 2 else None, f"id{i}", 1, None, 5.0, None if i % 3 else "X", "", "") for i in range(40)]
    b = [(s, o, r, 5.0, None, t, "", "") for s, o, r, _, _, t, _, _ in a]
    got = {tuple(r) for r in stroke_differences(spark.createDataFrame(a, STROKES), spark.createDataFrame(b, STROKES)).collect()}
    assert got == {(r[0], r[1], d) for r in a for d in ("start_price", "end_price")}
    nan = [(*r[:3], float("nan"), *r[4:]) for r in a]
    got = stroke_differences(spark.createDataFrame(nan, STROKES), spark.createDataFrame(nan, STROKES))
    assert got.count() == 0


RAW = "symbol string, feed string, bar_index long, timestamp timestamp_ntz, open double, high double, low double, close double, volume double, received_at timestamp_ntz, bucket string, me string"


@pytest.mark.parametrize("bucket", [4096, 16])
def test_implausible_bars(spark, bucket):
    rnd = random.Random(5)
    t0 = dt.datetime(2020, 1, 1)
    closes, c = [], 100.0
    for _ in range(300):
        c *= 1 + rnd.choice([-1, 1]) * rnd.uniform(0.0005, 0.0015)
        closes.append(c)
    rows = [["A", "f", i, t0 + dt.timedelta(hours=i), x, x * 1.0002, x * 0.9998, x, 1.0, t0 + dt.timedelta(hours=i), "", ""] for i, x in enumerate(closes)]
    put = lambda i, **v: [rows[i].__setitem__({"high": 5, "low": 6, "close": 7}[k], x) for k, x in v.items()]
    put(20, high=closes[20] * 1.2)
    put(31, close=closes[31] * 1.3, high=closes[31] * 1.31), put(32, close=closes[31] * 1.3, high=closes[31] * 1.31)
    for i in (60, 61, 62):  # a level that lasts is no spike
        put(i, close=closes[i] * 1.3, high=closes[i] * 1.31, low=closes[i] * 1.29)
    put(80, low=closes[80] * 1.5), put(90, close=-1.0), put(95, high=None)
    for i in range(125, 133):
        put(i, close=closes[125], high=closes[125], low=closes[125])
    late = list(rows[20])
    late[5], late[9] = closes[20], late[9] - dt.timedelta(hours=1)  # an earlier delivery doesn't count
    df = spark.createDataFrame([tuple(r) for r in [*rows, late]], RAW)
    got = {(r.bar_index, r.kind) for r in implausible_bars(df, bucket).collect()}
    assert got == {(20, "spike"), (31, "spike"), (32, "spike"), (80, "impossible"), (90, "impossible"), *((i, "stuck") for i in range(125, 133))}


def test_the_forest_selects(spark, monkeypatch):
    """Two ways of scoring give the same rows, which match the plain rule; another forest gives others."""
    import barloom.operators.spikes as spikes

    rnd = random.Random(11)
    t0 = dt.datetime(2020, 1, 1)
    rows = []
    for symbol, feed, scale in (("A", "f", 0.001), ("B", "f", 0.001), ("C", None, 0.01), (None, "g", 0.005)):
        c = 100.0
        for i in range(1500):
            c *= 1 + rnd.choice([-1, 1]) * rnd.uniform(0.5, 1.5) * scale * (rnd.random() < 0.9)
            x = c * (1 + rnd.choice([-1, 1]) * rnd.uniform(20, 60) * scale) if rnd.random() < 0.01 else c
            rows.append((symbol, feed, i, t0 + dt.timedelta(hours=i), x, x * 1.0001, x * 0.9999, x, 1.0, t0, "", ""))
    df = spark.createDataFrame(rows, RAW).persist()
    got = {tuple(r) for r in implausible_bars(df, 256).collect()}
    want = set()
    for symbol in ("A", "B", "C", None):
        mine = [r for r in rows if r[0] == symbol]
        feed = [r for r in rows if r[1] == mine[0][1]]
        steps = sorted(abs(b[7] / a[7] - 1) for a, b in zip(feed, feed[1:]) if a[0] == b[0] and a[7] != b[7])
        limit = 25 * steps[(len(steps) - 1) // 2]
        off = lambda k, a, b: min(abs(mine[k][7] / mine[a][7] - 1), abs(mine[k][7] / mine[b][7] - 1)) if 0 <= a and b < len(mine) else 0
        for k in range(len(mine)):
            if max(off(k, k - 1, k + 1), min(off(k, k - 1, k + 2), off(k + 1, k - 1, k + 2) if k + 2 < len(mine) else 0), min(off(k, k - 2, k + 1), off(k - 1, k - 2, k + 1))) > limit * 1.001:
                want.add((symbol, k, "spike"))
    spikes_ = {g for g in got if g[2] == "spike"}
    assert want and want <= spikes_ and len(spikes_ - want) <= 0.02 * len(want)
    monkeypatch.setattr(spikes, "SENT", 0)
    monkeypatch.setattr(spikes, "SHARD", 700)
    assert {tuple(r) for r in implausible_bars(df, 256).collect()} == got
    monkeypatch.undo()
    monkeypatch.setattr(spikes, "limit_score", lambda forest, x, k: 2.0)  # a forest that selects nothing
    assert {r.kind for r in implausible_bars(df, 256).collect()} <= {"impossible"}


def test_the_forest_rejects_most_readings():
    import numpy as np
    import pandas as pd

    from barloom.operators.spikes import flag, score, train, features

    rng = np.random.default_rng(1)
    n = 2048
    p = pd.DataFrame({"symbol": "A", "bar_index": range(n), "hour": 0, "excess": rng.exponential(0.3, n) * 1e-3, "step": rng.exponential(1, n) * 1e-3, "run": rng.integers(1, 3, n), "usual": 1e-3, "run95": 2, "luck": range(n)})
    model = train(p)
    s = score(model["forest"], features(p, model))
    assert (s < model["cut"]["spike"]).mean() > 0.9 and (s < model["cut"]["stuck"]).mean() > 0.9
    p.loc[7, "excess"], p.loc[9, "run"] = 0.026, 9
    assert set(zip(flag(p, model)["bar_index"], flag(p, model)["kind"])) == {(7, "spike"), (9, "stuck")}


def test_the_model_counts_every_reading():
    """Also readings beyond the first 2,048 by luck, in whatever order they come."""
    import numpy as np
    import pandas as pd

    from barloom.operators.spikes import features, flag, score, train

    rng = np.random.default_rng(2)
    n = 6000
    p = pd.DataFrame({"symbol": "A", "bar_index": range(n), "hour": 0, "excess": rng.exponential(0.3, n) * 1e-3, "step": rng.exponential(1, n) * 1e-3, "run": rng.integers(1, 3, n), "usual": 1e-3, "run95": 2, "luck": range(n)})
    p.loc[5000:, "hour"], p.loc[5000:, "step"] = 5, 4e-3
    p.loc[5500:5509, "excess"], p.loc[5600:5620, "run"] = 0.0251, 9
    model = train(p)
    assert abs(model["season"][5] - 4) < 0.01
    assert abs(model["forest"]["norm"] - (2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n)) < 1e-6  # of trees over n readings
    s = score(model["forest"], features(p, model))
    for kind, true in (("spike", p["excess"] > 0.025), ("stuck", p["run"] > 8)):
        assert model["cut"][kind] <= s[true].min() and (s < model["cut"][kind]).mean() > 0.9
    got = flag(p, model)
    assert set(zip(got["bar_index"], got["kind"])) == {(i, "spike") for i in range(5500, 5510)} | {(i, "stuck") for i in range(5600, 5621)}
    other = train(p.assign(luck=-p["luck"]).sample(frac=1, random_state=1))
    assert other["cut"] == model["cut"] and all(np.array_equal(other["forest"][k], model["forest"][k]) for k in "ftab")


def test_the_query_learns_from_every_reading(spark, monkeypatch):
    """Models counted by cells in Spark are those of all readings in one frame."""
    import pickle

    import numpy as np

    import barloom.operators.spikes as spikes

    rnd = random.Random(3)
    t0 = dt.datetime(2020, 1, 1)
    rows = []
    for symbol, feed, n, hours in (("A", "f", 2500, 24), ("B", "f", 1500, 24), ("C", None, 300, 5), ("D", "still", 9, 24)):
        c = 100.0
        for i in range(n):
            c *= 1 + rnd.choice([-1, 1]) * rnd.uniform(0.5, 1.5) * 0.001 * (1 + i % hours / 6) * (rnd.random() < 0.9) * (feed != "still")
            rows.append((symbol, feed, i, t0 + dt.timedelta(hours=i % hours), c, c * 1.0001, c * 0.9999, c, 1.0, t0, "", ""))
    seen = []
    scored = spikes._scored
    monkeypatch.setattr(spikes, "_scored", lambda readings, models, size: seen.append((readings, models)) or scored(readings, models, size))
    df = spark.createDataFrame(rows, RAW)
    spikes.implausible_bars(df, 256).collect()
    readings = seen[0][0].toPandas().assign(luck=0)
    models = {r["feed"]: pickle.loads(bytes(r["model"])) for r in seen[0][1].collect()}
    assert set(models) == {"f", None, "still"}
    for feed, p in readings.groupby("feed", dropna=False):
        model = models[feed if isinstance(feed, str) else None]
        whole = spikes.train(p.assign(usual=model["usual"], run95=model["run95"]))
        assert np.allclose(whole["season"], model["season"], rtol=1e-12) and whole["cut"] == model["cut"]
        assert all(np.array_equal(whole["forest"][k], model["forest"][k]) for k in "ftab") and whole["forest"]["norm"] == model["forest"]["norm"]
    assert models[None]["season"][5:] == [1.0] * 19 and min(models["f"]["season"]) < 0.9


def test_implausible_bars_empty_and_null(spark):
    assert implausible_bars(spark.createDataFrame([], RAW)).count() == 0
    nulls = [(None, None, i, None, None, None, None, None, None, None, "", "") for i in range(3)]
    assert implausible_bars(spark.createDataFrame(nulls, RAW)).count() == 0
