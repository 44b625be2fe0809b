"""Consistency of two runs, lineage, retention and state envelopes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.bars import short_hash, text


def _zipped(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], kind: str) -> DataFrame:
    one = a.select(*[F.col(k).alias(f"a_{k}") for k in keys], F.struct(*values).alias("x"))
    two = b.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.struct(*values).alias("y"))
    both = one.join(two, [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys], "full_outer")
    fields = F.concat(*[F.when(~F.col(f"x.{v}").eqNullSafe(F.col(f"y.{v}")), F.array(F.lit(v))).otherwise(F.array().cast("array<string>")) for v in values])
    what = F.when(F.col("y").isNull(), F.array(F.lit("missing_in_second"))).when(F.col("x").isNull(), F.array(F.lit("missing_in_first"))).otherwise(fields)
    place = F.concat_ws(":", *[F.coalesce(f"a_{k}", f"b_{k}").cast("string") for k in keys[1:]])
    return both.select(F.coalesce(f"a_{keys[0]}", f"b_{keys[0]}").alias("symbol"), F.lit(kind).alias("kind"), place.alias("place"), F.explode(what).alias("difference"))


def consistency(first: dict[str, DataFrame], second: dict[str, DataFrame]) -> DataFrame:
    """Differences of two runs' merged bars, confirmed turning points and confirmed strokes."""
    done = lambda d, k: d[k].where("status = 'CONFIRMED'")
    parts = [
        _zipped(first["merged"], second["merged"], ["symbol", "bar_index"], ["open", "high", "low", "close"], "merged_bar"),
        _zipped(done(first, "fractals"), done(second, "fractals"), ["symbol", "merged_bar_index", "fractal_type"], ["price", "logical_id"], "fractal"),
        _zipped(done(first, "strokes"), done(second, "strokes"), ["symbol", "logical_id"], ["direction", "start_price", "end_price", "start_bar_index", "end_bar_index"], "stroke"),
    ]
    return reduce(DataFrame.unionByName, parts)


def lineage_edges(merged: DataFrame, fractals: DataFrame, strokes: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """(symbol, child, child_type, parent) between structures of neighbouring levels."""
    parts = [
        merged.select("symbol", F.col("logical_id").alias("child"), F.lit("merged_bar").alias("child_type"), F.explode("source_raw_bar_ids").alias("parent")),
        fractals.select("symbol", F.col("logical_id").alias("child"), F.lit("fractal").alias("child_type"), F.explode(F.transform("window_indices", lambda i: F.concat(F.lit("mbar:idx_"), i.cast("string")))).alias("parent")),
        strokes.select("symbol", F.col("logical_id").alias("child"), F.lit("stroke").alias("child_type"), F.explode(F.split(F.substring("logical_id", 8, 1_000_000), "->")).alias("parent")),
    ]
    if segments is not None:
        names = strokes.select(F.col("symbol").alias("_s"), "stroke_id", F.col("logical_id").alias("parent"))
        used = segments.where("segment_id is not null").select("symbol", F.col("logical_id").alias("child"), F.lit("segment").alias("child_type"), F.explode("stroke_ids").alias("_id"))
        parts.append(used.join(names, (F.col("symbol") == F.col("_s")) & (F.col("_id") == F.col("stroke_id"))).select("symbol", "child", "child_type", "parent"))
    return reduce(DataFrame.unionByName, parts)


def ancestors(edges: DataFrame, levels: int = 4) -> DataFrame:
    """(symbol, node, ancestor, depth), each pair once at its least depth. The levels are bounded:
    segment, stroke, turning point, merged bar, raw bar.
    """
    step = edges.select(F.col("symbol").alias("_s"), F.col("child").alias("_c"), F.col("parent").alias("_p"))
    front = edges.select("symbol", F.col("child").alias("node"), F.col("parent").alias("ancestor"))
    found = [front.withColumn("depth", F.lit(1))]
    for depth in range(2, levels + 1):
        front = front.join(step, F.col("symbol").eqNullSafe(F.col("_s")) & (F.col("ancestor") == F.col("_c"))).select("symbol", "node", F.col("_p").alias("ancestor")).distinct()
        found.append(front.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.unionByName, found).groupBy("symbol", "node", "ancestor").agg(F.min("depth").alias("depth"))


def descendants(edges: DataFrame, levels: int = 4) -> DataFrame:
    return ancestors(edges, levels).select("symbol", F.col("ancestor").alias("node"), F.col("node").alias("descendant"), "depth")


def stroke_hash():
    return short_hash("stroke_id", "direction", "start_fractal_id", "end_fractal_id", text("start_price"), text("end_price"), F.col("start_bar_index").cast("string"), F.col("end_bar_index").cast("string"))


def fractal_hash():
    return short_hash("fractal_id", "fractal_type", "merged_bar_id", F.col("merged_bar_index").cast("string"), text("price"))


def merged_hash():
    return short_hash("bar_id", *[text(c) for c in ("open", "high", "low", "close")], F.array_join(F.array_sort("source_raw_bar_ids"), "|"), "merge_direction")


# Fields that no hash of a result may depend on.
VOLATILE = ["generated_at", "engine_version", "profile_version"]


def _tree(rows: DataFrame, name: str, span: int = 10_000) -> DataFrame:
    """Digest of each symbol's rows (symbol, at, h) in the order of ``at``: of spans of places first, then
    of the spans' digests, so that no task holds all rows of a symbol.
    """
    part = rows.groupBy("symbol", F.floor(F.col("at") / span).alias("part")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), "|"), 256).alias("h"))
    return part.groupBy("symbol").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "|"), 256).alias(name))


def result_hash(tables: dict[str, DataFrame]) -> DataFrame:
    """(symbol, structure_hash) over the content of merged bars, turning points and strokes."""
    second = lambda c: F.when(F.col(c) == "BOTTOM", 1).otherwise(0)
    parts = [
        tables["merged"].select("symbol", F.col("bar_index").alias("at"), merged_hash().alias("h")), tables["fractals"].select("symbol", (F.col("merged_bar_index") * 2 + second("fractal_type")).alias("at"), fractal_hash().alias("h")),
        tables["strokes"].select("symbol", F.col("start_bar_index").alias("at"), stroke_hash().alias("h")),
    ]
    named = [_tree(p, "h").select("symbol", F.lit(k).alias("k"), "h") for k, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, named).groupBy("symbol").agg(F.left(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "|"), 256), F.lit(16)).alias("structure_hash"))


def log_hash(events: DataFrame) -> DataFrame:
    """(symbol, log_hash) over all numbered events, whatever the order of the rows."""
    body = F.sha2(F.to_json(F.struct(*sorted(c for c in events.columns if c not in ("symbol", *VOLATILE)))), 256)
    return _tree(events.select("symbol", F.regexp_extract("event_id", r"(\d+)$", 1).cast("long").alias("at"), body.alias("h")), "log_hash")


def confirmed_hash(objects: DataFrame, key: str) -> DataFrame:
    """(symbol, confirmed_hash) over the confirmed objects, without the fields that may change from run to run."""
    x = objects.where("status = 'CONFIRMED'")
    order = F.row_number().over(Window.partitionBy("symbol", F.pmod(F.xxhash64(key), F.lit(64))).orderBy(key))
    body = F.sha2(F.to_json(F.struct(*sorted(c for c in x.columns if c not in ("symbol", *VOLATILE)))), 256)
    # hash classes stand for spans: within one, rows are ordered by key
    return _tree(x.select("symbol", (F.pmod(F.xxhash64(key), F.lit(64)) * (1 << 40) + order).alias("at"), body.alias("h")), "confirmed_hash", 1 << 40)


def revisions(objects: DataFrame) -> DataFrame:
    """(symbol, logical_id, chain, latest): the object ids of each object in the order of its revisions."""
    x = objects.select("symbol", "logical_id", "revision", "object_id").distinct()
    chain = F.array_sort(F.collect_list(F.struct("revision", "object_id")))
    x = x.groupBy("symbol", "logical_id").agg(chain.alias("c"))
    return x.select("symbol", "logical_id", F.col("c.object_id").alias("chain"), F.element_at("c", -1)["object_id"].alias("latest"))
