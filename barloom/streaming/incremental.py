"""Incremental parsing: appended bars against small state, a changelog of structures as output.

The state of a series is a bounded tail: merged bars from the last turning point that nothing can
change any more (the fourth from the end), the state of the stroke fold there, the last stroke
before it, and the revisions of tail objects. Batch and streaming run the same kernels, so confirmed structures agree whatever the
batches. ``advance`` is plain Python; ``changelog`` runs it inside Structured Streaming.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.functions.kernels import merge_fold, stroke_fold
from barloom.profile import Profile

OUT = "symbol string, event_type string, object_type string, logical_id string, revision int, status string, detail string, at_bar_index long, reason_code string"


class RebuildBoundaryExceeded(RuntimeError):
    """A tail that must be recomputed is longer than the profile allows."""


def _fractal_id(kind: str, i: int) -> str:
    return f"fractal:{kind.lower()}:mbar:idx_{i}"


def empty_state() -> dict:
    return {"last_ts": None, "raw": 0, "merge": None, "bars": [], "head": None, "cut": -1, "fold": None, "last": None, "known": {}, "largest": 0}


def _stroke_id(a: list) -> str:
    return f"stroke:{_fractal_id(a[1], a[0])}->{_fractal_id(a[4], a[3])}"


def _tail_fractals(bars: list[list], profile: Profile, head: list | None = None) -> list[list]:
    """Selected turning points [type, index, price] of the tail's merged bars, after ``head``."""
    picked: list[list] = [head] if head else []
    for a, b, c in zip(bars, bars[1:], bars[2:]):
        top, bottom = b[1] > a[1] and b[1] > c[1], b[2] < a[2] and b[2] < c[2]
        if profile.allow_equal_high:
            top = (b[1] >= a[1] and b[1] > c[1] and b[2] >= a[2] and b[2] > c[2]) or (b[1] > a[1] and b[1] >= c[1] and b[2] > a[2] and b[2] >= c[2])
        if profile.allow_equal_low:
            bottom = (b[2] <= a[2] and b[2] < c[2] and b[1] <= a[1] and b[1] < c[1]) or (b[2] < a[2] and b[2] <= c[2] and b[1] < a[1] and b[1] <= c[1])
        for kind, hit, price in (("TOP", top, b[1]), ("BOTTOM", bottom, b[2])):
            if not hit:
                continue
            if picked and picked[-1][0] == kind:
                if (price > picked[-1][2]) if kind == "TOP" else (price < picked[-1][2]):
                    picked[-1] = [kind, b[0], price]
            else:
                picked.append([kind, b[0], price])
    return picked


def advance(state: dict, rows: list[tuple], profile: Profile = Profile()) -> tuple[dict, list[dict]]:
    """The state after appended bars (timestamp, high, low), and the changes of structures.

    Bars must be later than all before, else they become DATA_ERROR rows and change nothing.
    """
    events: list[dict] = []
    good = []
    for ts, high, low in rows:
        if state["last_ts"] is not None and ts <= state["last_ts"]:
            events.append({"event_type": "DATA_ERROR", "object_type": "raw_bar", "logical_id": None, "revision": None, "status": None, "detail": str(ts), "reason_code": "APPEND_ORDER"})
            continue
        state["last_ts"] = ts
        good.append((high, low))
    if not good:
        return state, events
    # merged bars: the open one goes on, all before it are final
    new, dirs, merge = merge_fold([g[0] for g in good], [g[1] for g in good], state["merge"], profile.equal_high_low_policy == "explicit")
    bars = state["bars"]
    for (high, low), begins, d in zip(good, new, dirs):
        if begins or not bars:
            bars.append([bars[-1][0] + 1 if bars else 0, high, low])
        else:
            b = bars[-1]
            b[1], b[2] = (max(b[1], high), max(b[2], low)) if d == 1 else (min(b[1], high), min(b[2], low))
    state["merge"], state["raw"] = merge, state["raw"] + len(good)
    cut = state["cut"]
    picked = _tail_fractals(bars, profile, state["head"])
    points = {(i, kind): price for kind, i, price in picked if i > cut}
    rest = [(i, h, l, points.get((i, "TOP")), points.get((i, "BOTTOM"))) for i, h, l in bars if i > cut]
    decisions, _ = stroke_fold(rest, state["fold"], profile.minimum_merged_bar_count, profile.endpoint_extreme_required)
    chain = [*([state["last"]] if state["last"] else []), *([list(d[:6]) for d in decisions if d[6] == "STROKE"])]
    found: dict[str, list] = {}
    for k, (kind, i, price) in enumerate(picked):
        if i > cut:
            found[_fractal_id(kind, i)] = ["fractal", "CONFIRMED" if k + 1 < len(picked) else "PROVISIONAL", json.dumps([kind, i, price])]
    for a, b in zip(chain, [*chain[1:], None]):
        ok = b is not None and a[3] == b[0] and a[4] == b[1]
        found[_stroke_id(a)] = ["stroke", "CONFIRMED" if ok else "PROVISIONAL", json.dumps(a)]
    window = len(bars)
    state["largest"] = max(state["largest"], window)
    if window > profile.max_rebuild_distance + len(good):
        raise RebuildBoundaryExceeded(f"{window} merged bars in the tail")
    known = state["known"]
    fresh: dict[str, list] = {}
    for name in sorted(known.keys() - found.keys()):
        kind, status, detail, revision = known[name]
        events.append({"event_type": "OBJECT_INVALIDATED", "object_type": kind, "logical_id": name, "revision": revision, "status": "INVALIDATED", "detail": detail, "reason_code": "TAIL_REBUILD_REMOVED"})
    for name in sorted(found):
        kind, status, detail = found[name]
        old = known.get(name)
        revision = 1 if old is None else old[3] + (old[2] != detail)
        fresh[name] = [kind, status, detail, revision]
        if old is None:
            change = ("OBJECT_CREATED", "TAIL_REBUILD_CREATED")
        elif old[2] != detail:
            change = ("STRUCTURE_REPLACED", "TAIL_REBUILD_REVISION")
        elif old[1] != status:
            change = ("OBJECT_CONFIRMED" if status == "CONFIRMED" else "STATUS_CHANGED", "TAIL_REBUILD_STATE_TRANSITION")
        else:
            continue
        events.append({"event_type": change[0], "object_type": kind, "logical_id": name, "revision": revision, "status": status, "detail": detail, "reason_code": change[1]})
    # What can't change leaves the state. The open bar decides on two turning points at most, and
    # without them the third's run is open again; the fourth's run was ended by the third.
    state["known"] = fresh
    if len(picked) > 3 and picked[-3][1] > picked[-4][1] > cut:
        head = picked[-4]
        place = head[1]
        _, state["fold"] = stroke_fold([r for r in rest if r[0] <= place], state["fold"], profile.minimum_merged_bar_count, profile.endpoint_extreme_required)
        settled = [a for a in chain if a[3] <= place]
        state["head"], state["cut"], state["last"] = head, place, settled[-1] if settled else None
        state["bars"] = [b for b in bars if b[0] >= place]
        keep = {_fractal_id(k, i) for k, i, _ in picked if i > place} | {_stroke_id(a) for a in chain[max(0, len(settled) - 1) :]}
        state["known"] = {n: v for n, v in fresh.items() if n in keep}
    return state, events


def changelog(bars: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Append-only changes of a stream of valid bars (symbol, bar_index, timestamp, high, low).

    The engine's checkpoint keeps the state; replaying a batch after a failure gives the same rows.
    """
    settings = asdict(profile)

    def step(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(group.get[0]) if group.exists else empty_state()
        pdf = pd.concat(list(batches)).sort_values(["bar_index"])
        rows = list(zip((int(t.value // 1000) for t in pdf["timestamp"]), pdf["high"].tolist(), pdf["low"].tolist()))
        try:
            state, events = advance(state, rows, Profile(**settings))
            group.update((json.dumps(state),))
        except RebuildBoundaryExceeded as error:  # this symbol stands still from here on; the others go on
            events = [{"event_type": "DATA_ERROR", "object_type": "raw_bar", "logical_id": f"bar:{rows[0][0]}", "revision": 1, "status": "INVALIDATED", "detail": str(error), "reason_code": "REBUILD_BOUNDARY_EXCEEDED"}]
            if not group.exists:
                group.update((json.dumps(empty_state()),))
        if events:
            out = pd.DataFrame(events)
            out.insert(0, "symbol", key[0])
            out["at_bar_index"] = int(pdf["bar_index"].max())
            yield out[[c.split()[0] for c in OUT.split(", ")]]

    return bars.select("symbol", "bar_index", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "high", "low").groupBy("symbol").applyInPandasWithState(step, OUT, "state string", "append", GroupStateTimeout.NoTimeout)


def current(changes: DataFrame) -> DataFrame:
    """The latest state of each object of a changelog read as a table (``ord`` orders the changes)."""
    x = changes.where("object_type in ('fractal', 'stroke')").groupBy("symbol", "object_type", "logical_id").agg(F.max_by(F.struct("status", "revision", "detail"), "ord").alias("s"))
    return x.select("symbol", "object_type", "logical_id", "s.*").where("status <> 'INVALIDATED'")


def checkpoint_bars(changes: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """(symbol, at_bar_index): where each symbol can be restored, the newest ``checkpoint_retention`` of
    the first batch ends at or after every ``checkpoint_interval`` bars.
    """
    x = changes.select("symbol", "at_bar_index").distinct()
    x = x.groupBy("symbol", F.floor(F.col("at_bar_index") / profile.checkpoint_interval).alias("_k")).agg(F.min("at_bar_index").alias("at_bar_index"))
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("at_bar_index").desc()))
    return x.withColumn("_n", newest).where(F.col("_n") <= profile.checkpoint_retention).select("symbol", "at_bar_index")


def snapshot_bars(changes: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """(symbol, at_bar_index): the newest ``snapshot_retention`` batch ends, of which states are kept."""
    x = changes.select("symbol", "at_bar_index").distinct()
    return x.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("at_bar_index").desc()))).where(F.col("_n") <= profile.snapshot_retention).select("symbol", "at_bar_index")


def _kept(points: DataFrame, symbol: str, bar: int, what: str) -> None:
    if points.where((F.col("symbol") == symbol) & (F.col("at_bar_index") == bar)).isEmpty():
        raise KeyError(f"no {what} of {symbol} at bar {bar}")


def snapshot_at(changes: DataFrame, symbol: str, bar: int, profile: Profile = Profile()) -> DataFrame:
    """The state of a symbol as it was after the batch that ended at ``bar``; KeyError if it isn't kept."""
    _kept(snapshot_bars(changes, profile), symbol, bar, "snapshot")
    return current(changes.where((F.col("symbol") == symbol) & (F.col("at_bar_index") <= bar)))


def restored(changes: DataFrame, symbol: str, bar: int, profile: Profile = Profile()) -> DataFrame:
    """The changelog with a symbol put back to a checkpoint: its later changes, and with them its later
    checkpoints and snapshots, are gone, and a CHECKPOINT_RESTORED row says so.
    """
    _kept(checkpoint_bars(changes, profile), symbol, bar, "checkpoint")
    back = F.col("symbol") == symbol
    kept = changes.where(~back | (F.col("at_bar_index") <= bar))
    note = kept.where(back).groupBy("symbol").agg(F.max("at_bar_index").alias("at_bar_index"), *([F.max("ord").alias("ord")] if "ord" in changes.columns else []))
    note = note.withColumns({"event_type": F.lit("CHECKPOINT_RESTORED"), "object_type": F.lit("engine"), "reason_code": F.lit("MANUAL_RESTORE")})
    return kept.unionByName(note.withColumn("logical_id", F.concat(F.lit("checkpoint:"), F.col("at_bar_index").cast("string"))), allowMissingColumns=True)


def write_snapshots(path: str):
    """A foreachBatch sink: each batch's changes under its number. Writing a batch again replaces
    it, so a replay leaves the same table.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("ord", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write
