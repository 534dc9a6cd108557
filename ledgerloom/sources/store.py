"""Keyed tables that are updated in place: copy-on-write upserts into Parquet, dealt out by hash of the key.

A store is a folder. ``data/at=<commit>/bucket=<k>`` holds the rows of a bucket as one commit wrote them, ``log``
one row for each commit: which buckets there are and which commit's files are theirs. A commit writes the
buckets that its rows touch, and only these, into a folder of its own; its log row is one file that Spark
moves into place when it is complete. Readers take the last row of the log, so they see a commit whole or not at
all, and files that an earlier reader still uses stay where they are. Other buckets keep their files.

One writer at a time: a commit that finds its number taken is an error. Nothing but Spark reads or writes files.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.fixpoint import cut

BUCKETS = 64
LOG = "commit long, buckets int, key string, defaults string, files array<struct<bucket:int,commit:long>>"


@dataclass(frozen=True)
class Commit:
    number: int
    buckets: int
    key: str
    files: dict[int, int]  # bucket -> commit that wrote it
    defaults: dict[str, object]  # of columns that came with a commit, for rows in buckets it did not touch


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _last(self) -> Commit | None:
        try:
            log = self.spark.read.schema(LOG).parquet(f"{self.path}/log")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        row = log.orderBy(F.desc("commit")).first()
        return row and Commit(row["commit"], row["buckets"], row["key"], {f["bucket"]: f["commit"] for f in row["files"]}, json.loads(row["defaults"]))

    def _bucket(self, key: str, buckets: int):
        return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")

    def _commit(self, rows: DataFrame, before: Commit | None, key: str, buckets: int, touched: list[int], defaults: dict | None = None) -> None:
        number = before.number + 1 if before else 0
        rows = rows.withColumn("bucket", self._bucket(key, buckets)).repartition(buckets, "bucket")
        rows.write.mode("error").partitionBy("bucket").parquet(f"{self.path}/data/at={number}")
        files = {**(before.files if before else {}), **{b: number for b in touched}}
        defaults = {**(before.defaults if before else {}), **(defaults or {})}
        row = (number, buckets, key, json.dumps(defaults), sorted(files.items()))
        if (now := self._last()) and now.number >= number:
            raise RuntimeError(f"another writer made commit {now.number}")
        self.spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _files(self, last: Commit, only: set[int] | None = None) -> DataFrame:
        """Rows of some buckets: the partition columns pick folders before any file is opened."""
        by_commit: dict[int, list[int]] = {}
        for bucket, commit in last.files.items():
            if only is None or bucket in only:
                by_commit.setdefault(commit, []).append(bucket)
        parts = []
        for commit, buckets in sorted(by_commit.items()):
            d = self.spark.read.option("basePath", f"{self.path}/data/at={commit}").parquet(f"{self.path}/data/at={commit}")
            parts.append(d.where(F.col("bucket").isin(buckets)).drop("bucket"))
        d = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return d.withColumns({c: F.coalesce(c, F.lit(v)) if c in d.columns else F.lit(v) for c, v in last.defaults.items()})

    def create(self, rows: DataFrame, key: str = "id", buckets: int = BUCKETS) -> None:
        """The first commit. Keys are not null and stand once."""
        if self._last():
            raise ValueError(f"{self.path} is a store already")
        if "bucket" in rows.columns:
            raise ValueError("a column cannot be called bucket")
        rows = _keyed(rows, key)
        touched = [r[0] for r in rows.select(self._bucket(key, buckets)).distinct().collect()]  # as many as buckets
        self._commit(rows, None, key, buckets, touched)

    def read(self) -> DataFrame:
        if not (last := self._last()):
            raise ValueError(f"{self.path} is no store")
        return self._files(last)

    def upsert(self, changes: DataFrame, defaults: dict[str, object] | None = None) -> int:
        """Merge ``changes`` by key; returns how many buckets were rewritten.

        A value that is given replaces the stored one, a null leaves it. Keys that are not stored are added,
        ``defaults`` (column -> value) fill what they lack, and what stored rows lack of a new column, also those of
        buckets that are not rewritten.
        Changes that change nothing touch no bucket.
        """
        if not (last := self._last()):
            raise ValueError(f"{self.path} is no store")
        key, defaults = last.key, defaults or {}
        changes = cut(_keyed(changes, key))
        named = changes.select(*(F.col(c).alias(f"new_{c}") if c != key else F.col(c) for c in changes.columns), F.lit(True).alias("is_new"))
        mine = changes.select(self._bucket(key, last.buckets).alias("b")).distinct()
        only = {r.b for r in mine.collect()} & set(last.files)
        if only:
            stored = self._files(last, only)
        else:
            stored = self._files(last).limit(0) if last.files else changes.limit(0)
        added = [c for c in changes.columns if c not in stored.columns]
        both = stored.withColumn("is_old", F.lit(True)).join(named, key, "full")

        def value(c: str):
            new, old = F.col(f"new_{c}") if c in changes.columns else F.lit(None), F.col(c) if c in stored.columns else F.lit(None)
            return F.coalesce(new, old, F.lit(defaults.get(c))).alias(c)

        columns = [c for c in (*stored.columns, *added) if c != key]
        given = [c for c in changes.columns if c != key and c not in added]
        differs = F.lit(bool(added)) | F.col("is_old").isNull()
        for c in given:
            differs = differs | (~F.col(f"new_{c}").eqNullSafe(F.col(c)) & F.col(f"new_{c}").isNotNull())
        merged = both.select(key, *(value(c) for c in columns), (F.col("is_new").isNotNull() & differs).alias("is_changed"))
        touched = {r[0] for r in merged.where("is_changed").select(self._bucket(key, last.buckets)).distinct().collect()}
        if touched:
            rows = merged.where(self._bucket(key, last.buckets).isin(sorted(touched))).drop("is_changed")
            self._commit(rows, last, key, last.buckets, sorted(touched), defaults)
        return len(touched)


def _keyed(rows: DataFrame, key: str) -> DataFrame:
    """``rows``, or an error when they are read where a key is null or stands twice."""
    n = F.count(F.lit(1)).alias("same")
    whole = rows.groupBy(key).agg(n, *(F.first(c).alias(c) for c in rows.columns if c != key))
    bad = F.raise_error(F.concat(F.lit("a key is null or stands twice: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    checked = F.when(F.col(key).isNotNull() & (F.col("same") == 1), F.col(key)).otherwise(bad.cast(rows.schema[key].dataType))
    return whole.withColumn(key, checked).select(*rows.columns)
