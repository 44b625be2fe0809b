"""A query that feeds hourly bars to the incremental parser in batches and reads the state back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.plans.structure_queries import _FRACTAL_LOGICAL, _STROKES, hourly
from barloom.session import shared_dir
from barloom.streaming.incremental import changelog, current, write_snapshots

BATCHES = 4


def stream_structures(s: SparkSession, d: str) -> DataFrame:
    """Turning points and strokes after the last of several batches, from the changelog."""
    root = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    bars = hourly(s, d).select("symbol", "bar_index", "timestamp", "high", "low").cache()
    step = bars.agg(F.max("bar_index")).first()[0] // BATCHES + 1
    for k in range(BATCHES):
        bars.where((F.col("bar_index") >= k * step) & (F.col("bar_index") < (k + 1) * step)).coalesce(1).write.mode("append").parquet(f"{root}/in")
    source = s.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    query = changelog(source).writeStream.outputMode("append").foreachBatch(write_snapshots(f"{root}/out")).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    bars.unpersist()
    return current(s.read.parquet(f"{root}/out")).select("symbol", "object_type", "logical_id", "status")


QUERIES = {"stream_structures": stream_structures}

SQL = {
    "stream_structures": f"""with recursive {_STROKES}
select symbol, 'fractal' object_type, {_FRACTAL_LOGICAL.format("merged_bar_index", "fractal_type")} logical_id, case when tail then 'PROVISIONAL' else 'CONFIRMED' end status from fs
union all select symbol, 'stroke', 'stroke:' || {_FRACTAL_LOGICAL.format("start_bar_index", "start_type")} || '->' || {_FRACTAL_LOGICAL.format("end_bar_index", "end_type")}, case when coalesce(ok, false) then 'CONFIRMED' else 'PROVISIONAL' end from st""",
}
