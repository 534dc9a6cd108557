"""Fixpoints over DataFrames: cutting lineage in shared storage, connected components."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints; one of our own only where it names none."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="ledgerloom-ckpt-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)  # a folder of this process alone; a cluster's is its own affair
        sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage there."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of lineages that were cut: it acts on collected references only."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


HUB, HUBS = 1 << 10, 1 << 12  # edges from which a vertex may be a hub; a hub also has more than 1 / HUBS of all edges


def _with_low(rows: DataFrame, low: DataFrame, limit: int | None) -> DataFrame:
    """``rows(u, v)`` with m of ``low(u, m, held)``: the edges of hubs, of which there are fewer than HUBS, stay where they are."""
    if limit is None:
        return rows.join(low.select("u", "m"), "u")
    hubs = F.broadcast(low.where(F.col("held") > limit).select("u", "m"))
    others = low.where(F.col("held") <= limit).select("u", "m")
    return rows.join(hubs, "u").unionAll(rows.join(hubs, "u", "left_anti").join(others, "u"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(a, b)``: (node, component = smallest reachable node).

    Alternating large-star and small-star steps: every step only groups by node and takes minima, which Spark
    pre-aggregates before the shuffle. The minima of hubs are broadcast to their edges, so these never gather in one
    task; a vertex with no more than HUB edges, or 1 / HUBS of all, meets its minimum by shuffle.
    Self loops and nulls are ignored; an empty edge table gives an empty result.
    """
    def total(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    low_of = (F.min("v").alias("m"), F.count(F.lit(1)).alias("held"))
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = total(e)
    for _ in range(rounds):
        limit = max(HUB, 2 * before[0] // HUBS) if 2 * before[0] > HUB else None
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(*low_of).withColumn("m", F.least("m", "u"))
        large = _with_low(both, low, limit).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        if limit is not None:
            large = cut(large)
        low = large.groupBy("u").agg(*low_of)
        small = _with_low(large, low, limit).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
        now = total(e)
        if now == before:
            break
        before = now
        release(e.sparkSession)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
