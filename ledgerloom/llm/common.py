"""Helpers shared by the text operators: table access, scratch space, holdout rule, components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.fixpoint import components, cut, release, scratch_dir  # noqa: F401

WORKING_SET_MB = 48  # what one Python group may hold before the number of groups is raised


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python in batches of at most ``rows``: whole texts are large, and workers share an executor's memory.

    Left alone where the session has its own value already.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def held_out(doc_id) -> F.Column:
    """True for the fifth of documents that no model may learn from; null ids are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def scale_of(df: DataFrame) -> int:
    """Compressed bytes behind ``df`` as the optimizer estimates them (file sizes for scans)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def groups_for(df: DataFrame, bytes_each: int) -> int:
    """How many groups keep each near ``bytes_each`` of source files; where no size is known, a multiple of the shuffle partitions."""
    size, least = scale_of(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 4 * least if size > 1 << 55 else max(least, -(-size // bytes_each))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_MB = 32  # a side is broadcast only when it was measured to be smaller than this


def lower_ascii(text) -> F.Column:
    """Lower-case A-Z alone; texts of ASCII alone take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def measured_mb(df: DataFrame, bytes_each) -> float:
    """Size of a materialised frame, from its rows and not from the optimizer's guess."""
    return (df.agg(F.sum(bytes_each).alias("b")).first().b or 0) / 1e6


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, hash of text) is not in the materialised ``gone(doc_id, mark)``."""
    if measured_mb(gone, F.lit(64)) < BROADCAST_MB:
        gone = F.broadcast(gone)
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("mark").alias("_gone_mark"))
    mark = F.xxhash64(docs["text"])
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone_id"]) & (mark == gone["_gone_mark"]), "left_anti")


SLICED = "slice long, a binary, b binary, x binary"


def sliced(slices: int, a: np.ndarray, b: np.ndarray, *values: np.ndarray) -> pd.DataFrame:
    """Entries of documents (a, b), packed by slice of documents: rows do not grow as documents times buckets."""
    to = ((a.astype(np.uint64) ^ b.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)) % np.uint64(slices)
    by = np.argsort(to, kind="stable")
    x = np.stack([v.astype(np.int64) if v.dtype != np.uint64 else v.view(np.int64) for v in values], 1)
    parts = np.split(by, np.flatnonzero(np.diff(to[by])) + 1)
    rows = [(int(to[p[0]]), a[p].tobytes(), b[p].tobytes(), x[p].tobytes()) for p in parts if len(p)]
    return pd.DataFrame(rows, columns=["slice", "a", "b", "x"])


def unsliced(packed: pd.DataFrame, width: int):
    """(a, b, values of shape (n, width)) of each document in a slice."""
    a, b = (np.frombuffer(b"".join(packed[c]), np.int64) for c in ("a", "b"))
    x = np.frombuffer(b"".join(packed.x), np.int64).reshape(-1, width)
    order = np.lexsort((b, a))
    a, b, x = a[order], b[order], x[order]
    cuts = np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(a)]):
        if hi > lo:
            yield int(a[lo]), int(b[lo]), x[lo:hi]
