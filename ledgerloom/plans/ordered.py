"""Running sums and ranks over one global order without one task that holds it.

Rows are dealt out by range, so each partition is a stretch of the order; sums run within the
stretches in parallel, and the totals of the stretches, one row each, give the offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.fixpoint import cut


def running(df: DataFrame, order: list, sums: dict[str, object]) -> DataFrame:
    """``df`` with a column for each of ``sums`` (name -> column): its sum over all rows up to this one, and name_all over all.

    Rows of equal order must be one row: order by a key. The ranges are fixed by a checkpoint, so a
    recomputed task sees the same stretch.
    """
    d = df.withColumns({f"_v_{k}": c for k, c in sums.items()}).repartitionByRange(*order)
    d = cut(d.withColumn("_stretch", F.spark_partition_id()))
    whole = d.groupBy("_stretch").agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums))
    before = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = whole.select(F.col("_stretch").alias("_s"), *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums), *(F.sum(f"_t_{k}").over(every).alias(f"{k}_all") for k in sums))
    own = Window.partitionBy("_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"_r_{k}": F.sum(f"_v_{k}").over(own) for k in sums}).join(F.broadcast(whole), F.col("_stretch") == F.col("_s"))
    return d.select(*df.columns, *((F.col(f"_r_{k}") + F.col(f"_b_{k}")).alias(k) for k in sums), *(f"{k}_all" for k in sums))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in the given order."""
    d = running(df, order, {name: F.lit(1).cast("long")})
    return d.select(*df.columns, (F.col(name) - 1).alias(name))
