"""Ledgers as streams: the binned flow of each pair, kept up to date under a watermark.

An extension beyond the batch engine; a finished stream gives the same bins as the batch operator
when bins are aligned to the same origin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import money


def stream_flow_bins(ledger: DataFrame, bin_days: int = 14, late: str = "1 day") -> DataFrame:
    """(src, dst, bin_start, amount, txns) over tumbling windows of a streaming ``ledger(src, dst, amount, at timestamp)``.

    Payments later than the watermark are dropped by the engine; state of closed bins is removed.
    """
    w = ledger.withWatermark("at", late).groupBy(F.window("at", f"{bin_days} days"), "src", "dst")
    return w.agg(F.sum(money("amount")).cast("double").alias("amount"), F.count(F.lit(1)).alias("txns")).select("src", "dst", F.col("window.start").alias("bin_start"), "amount", "txns")


def append_bins(ledger: DataFrame, path: str, checkpoint: str, bin_days: int = 14, late: str = "1 day"):
    """Write closed bins as Parquet, once each; restarts continue from the checkpoint."""
    return stream_flow_bins(ledger, bin_days, late).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
