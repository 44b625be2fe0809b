"""Full history of changing entities from periodic snapshots, by Merkle comparison.

Each snapshot of a symbol is summarised by a tree of digests: the root over all its objects,
branches of leaf buckets, and leaves. Successive snapshots are compared from the root down: rows of
snapshots whose root equals those before and after are dropped, then rows of branches that don't
differ, then rows of leaves that don't. Only objects of changed leaves are compared, and their new
versions appended. All levels below the root live in one partitioning by symbol and branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import stash

LEAF = 16  # objects of a leaf at most, on the average of the largest snapshot
FANOUT = 32  # leaves of a branch
STATE = ["revision", "status", "confirmed_at_bar"]


def _digest(*by: str) -> Column:
    """Order-free digest of the rows of a group, as a window: their number and two hashes."""
    w = Window.partitionBy(*by)
    return F.struct(F.count("*").over(w).alias("n"), F.bit_xor("h1").over(w).alias("a"), F.bit_xor("h2").over(w).alias("b"))


def _changed(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of the buckets ``by`` whose digest differs from that of the symbol's snapshot before
    (``came``) or after (``goes``), as far as the level above differs there: where it doesn't, the
    rows to compare with are gone already.
    """
    rows = rows.withColumn("digest", _digest(*by, "pos"))
    beside = Window.partitionBy(*by).orderBy("pos")
    rows = rows.withColumns({
        "came": F.col("came") & ~F.col("digest").eqNullSafe(F.first("digest").over(beside.rangeBetween(-1, -1))), "goes": F.col("goes") & ~F.col("digest").eqNullSafe(F.first("digest").over(beside.rangeBetween(1, 1))),
    })
    return rows.where("came or goes").drop("digest")


def version_history(snapshots: DataFrame, leaf: int = LEAF, fanout: int = FANOUT) -> DataFrame:
    """(symbol, logical_id, valid_from, valid_to, revision, status, confirmed_at_bar), a row for each version.

    A version is a longest stretch of successive snapshots of the symbol with the same revision,
    status and confirmed_at_bar. valid_to is the symbol's next snapshot after the version's last,
    -1 if there is none. Of several rows for an object and snapshot the highest ingest_seq holds
    (of equal ones the greatest row); status is upper-cased without outer blanks; a null
    confirmed_at_bar is -1; rows without logical_id belong to no object, yet their snapshot exists;
    rows without symbol or snapshot_bar are left out. Other columns don't matter. An empty table
    gives an empty history.
    """
    held = snapshots.where(F.col("symbol").isNotNull() & F.col("snapshot_bar").isNotNull())
    most = held.groupBy("symbol", "snapshot_bar").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    leaves = max(1, -(-most // leaf))
    branches = max(1, -(-leaves // fanout))
    place = F.pmod(F.xxhash64("logical_id"), F.lit(branches * fanout))
    rows = held.select(
        "symbol", "snapshot_bar", "logical_id", F.pmod(place, F.lit(branches)).cast("int").alias("branch"),
        F.struct("ingest_seq", "revision", F.upper(F.trim("status")).alias("status"), F.coalesce("confirmed_at_bar", F.lit(-1)).alias("confirmed_at_bar")).alias("s"),
    )
    rows = rows.groupBy("symbol", "branch", "snapshot_bar", "logical_id").agg(F.max("s").alias("s"))
    rows = stash(rows.select("symbol", "branch", "snapshot_bar", "logical_id", *(f"s.{c}" for c in STATE)), "snapshots")

    # a hash passes over nulls, so that which parts are null is hashed too
    facts = ["logical_id", *STATE, F.isnull("revision"), F.isnull("status")]
    known = rows.withColumns({"h1": F.xxhash64(*facts), "h2": F.xxhash64(F.lit(7), *facts)})
    of = lambda c: F.when(F.col("logical_id").isNotNull(), F.col(c))
    roots = known.groupBy("symbol", "snapshot_bar").agg(F.struct(F.count("logical_id"), F.bit_xor(of("h1")), F.bit_xor(of("h2"))).alias("root"))
    order = Window.partitionBy("symbol").orderBy("snapshot_bar")  # a row a snapshot, not a row an object
    steps = roots.withColumns({"pos": F.row_number().over(order), "next_bar": F.coalesce(F.lead("snapshot_bar").over(order), F.lit(-1)), "old": F.lag("root").over(order), "new": F.lead("root").over(order)})
    steps = steps.withColumns({"came": ~F.col("root").eqNullSafe(F.col("old")), "goes": ~F.col("root").eqNullSafe(F.col("new"))})
    steps = stash(steps.where("came or goes").select("symbol", "snapshot_bar", "pos", "next_bar", "came", "goes"), "steps")

    rows = known.where(F.col("logical_id").isNotNull()).join(steps, ["symbol", "snapshot_bar"])
    rows = rows.withColumn("leaf", F.floor(place / branches).cast("int")).repartition("symbol", "branch")
    rows = _changed(rows, "symbol", "branch") if branches > 1 else rows
    rows = _changed(rows, "symbol", "branch", "leaf").drop("h1", "h2")

    life = Window.partitionBy("symbol", "branch", "logical_id").orderBy("pos")
    state = F.struct(*STATE)
    same = lambda f, step: (f("pos").over(life) == F.col("pos") + step) & f("state").over(life).eqNullSafe(F.col("state"))
    rows = rows.withColumn("state", state)
    rows = rows.withColumns({"begins": F.col("came") & ~F.coalesce(same(F.lag, -1), F.lit(False)), "ends": F.col("goes") & ~F.coalesce(same(F.lead, 1), F.lit(False))})
    rows = rows.where("begins or ends")
    rows = rows.withColumn("valid_to", F.when(F.col("ends"), F.col("next_bar")).otherwise(F.lead("next_bar").over(life)))
    return rows.where("begins").select(
        "symbol", "logical_id", F.col("snapshot_bar").cast("long").alias("valid_from"), F.col("valid_to").cast("long").alias("valid_to"),
        F.col("revision").cast("int").alias("revision"), "status", F.col("confirmed_at_bar").cast("long").alias("confirmed_at_bar"),
    )
