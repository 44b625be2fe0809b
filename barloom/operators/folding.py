"""Sequential folds over long series in parallel chunks.

A series is cut into chunks of its order column. Every chunk is folded at once from a guessed
state, which gives its rows and the state at its end; then only chunks whose start differs from the
end of the chunk before are folded again from there, until none differs. The result is that of one
pass: the first chunk starts right, so each round settles at least one more chunk of a series, and
all of them as soon as the states meet, which they usually do within a chunk. A chunk that was
guessed right is folded once. Chunks are written in groups, and a later round reads the groups
that it needs only.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import spread, stash

CHUNK = 50_000
GROUP, GROUPS = "_group", 64  # chunks are written in so many groups
Fold = Callable[[pd.DataFrame, list | None], tuple[pd.DataFrame, list | None]]


def chunked_fold(df: DataFrame, order: str, fold: Fold, schema: str, key: str = "symbol", chunk: int = CHUNK) -> DataFrame:
    """Rows that ``fold`` makes of each series (``key``) in ``order``; the schema must name key and
    chunk, which are kept for further work within chunks. Rows with a null order are left out.
    """
    x = df.where(F.col(order).isNotNull()).withColumn("chunk", F.floor(F.col(order) / chunk).cast("long"))
    keys = [key, "chunk"]

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return fold(pdf.sort_values(order, kind="stable").reset_index(drop=True), None)[0]

    def both(pdf: pd.DataFrame) -> pd.DataFrame:
        """The rows of a chunk, and one more row with the states where it starts and ends."""
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        start = pdf["_start"].iloc[0]
        start = start if isinstance(start, str) else None
        rows, end = fold(pdf.drop(columns=["_start", GROUP], errors="ignore"), json.loads(start) if start else None)
        rows = rows.astype({c: "Int64" for c in rows.select_dtypes("int").columns})
        mark = pd.DataFrame({key: [pdf[key].iloc[0]], "chunk": [pdf["chunk"].iloc[0]], "_start": [start], "_end": [json.dumps(end) if end is not None else None], "_mark": [True]})
        if not len(rows):  # the mark alone; objects with None, so that each column is one array
            return mark.reindex(columns=[*rows.columns, "_start", "_end", "_mark"]).astype(object).replace({float("nan"): None})
        out = pd.concat([rows.assign(_start=None, _end=None, _mark=False), mark.astype({"chunk": "Int64"})], ignore_index=True)
        return out.astype({c: object for c in out.columns if pd.api.types.is_string_dtype(out[c])})

    many = x.groupBy(key).agg((F.max("chunk") > F.min("chunk")).alias("m")).where("m").limit(1).count()
    if not many:
        return spread(x, *keys).groupBy(*keys).applyInPandas(whole, schema)
    form = schema + ", _start string, _end string, _mark boolean"
    x = stash(x.withColumn(GROUP, F.pmod("chunk", F.lit(GROUPS))), "chunks", GROUP)
    rounds = [stash(spread(x.withColumn("_start", F.lit(None).cast("string")), *keys).groupBy(*keys).applyInPandas(both, form), "folded")]
    last = None  # round, start and end of each chunk
    while True:
        new = rounds[-1].where("_mark").select(*keys, "_start", "_end", F.lit(len(rounds) - 1).alias("_round"))
        if last is not None:
            old = last.join(new.select(F.col(key).alias("_k"), F.col("chunk").alias("_c")), [F.col(key).eqNullSafe(F.col("_k")), F.col("chunk") == F.col("_c")], "left_anti")
            new = old.unionByName(new)
        last = stash(new, "ends")
        before = F.lag("_end").over(Window.partitionBy(key).orderBy("chunk"))
        want = last.withColumn("_want", before)
        wrong = stash(want.where(~F.col("_want").eqNullSafe(F.col("_start"))).select(F.col(key).alias("_k"), F.col("chunk").alias("_c"), "_want"), "wrong")
        groups = [r[0] for r in wrong.select(F.pmod("_c", F.lit(GROUPS))).distinct().collect()]  # GROUPS at most
        if not groups:
            break
        again = x.where(F.col(GROUP).isin(groups)).join(wrong, [F.col(key).eqNullSafe(F.col("_k")), F.col("chunk") == F.col("_c")]).drop("_k", "_c").withColumnRenamed("_want", "_start")
        rounds.append(stash(spread(again, *keys).groupBy(*keys).applyInPandas(both, form), "folded"))
    names = [c.split()[0] for c in schema.split(", ")]
    out = None
    for k, made in enumerate(rounds):
        rows = made.where("not _mark").select(*names)
        if len(rounds) > 1:
            mine = last.where(F.col("_round") == k).select(F.col(key).alias("_k"), F.col("chunk").alias("_c"))
            rows = rows.join(mine, [F.col(key).eqNullSafe(F.col("_k")), F.col("chunk") == F.col("_c")], "left_semi")
        out = rows if out is None else out.unionByName(rows)
    return out
