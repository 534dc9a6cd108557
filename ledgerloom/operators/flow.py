"""From a ledger to flow edges, account edges, and what a flow says about an account."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import DAY, money

BIN_DAYS = 14


def _binned(ledger: DataFrame, bin_days: int) -> DataFrame:
    if bin_days < 1:
        raise ValueError("bin_days must be at least 1")
    span = ledger.agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    wide = span.select("t0", F.greatest(F.lit(1), F.expr(f"(t1 - t0) div {bin_days * 86400} + 1")).cast("int").alias("num_bins"))
    at = F.least(F.greatest(F.expr(f"(ts - t0) div {bin_days * 86400}"), F.lit(0)), F.col("num_bins") - 1).cast("int")
    # the one row of bounds is the only thing broadcast
    return ledger.join(F.broadcast(wide)).withColumn("bin", at)


def flow_bins(ledger: DataFrame, bin_days: int = BIN_DAYS) -> DataFrame:
    """(src, dst, bin, amount, txns): the non-empty bins of each directed pair; pre-aggregated before the shuffle."""
    return _binned(ledger, bin_days).groupBy("src", "dst", "bin").agg(F.sum(money("amount")).cast("double").alias("amount"), F.count(F.lit(1)).alias("txns"))


def flow_agg(ledger: DataFrame, bin_days: int = BIN_DAYS) -> DataFrame:
    """One edge per directed pair with totals, first and last time and dense zero-filled bins, oldest first.

    Payments to oneself are kept. An empty ledger gives no edges.
    """
    per_bin = _binned(ledger, bin_days).groupBy("src", "dst", "num_bins", "bin").agg(
        F.sum(money("amount")).alias("amount"), F.count(F.lit(1)).alias("txns"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    per_pair = per_bin.groupBy("src", "dst", "num_bins").agg(
        F.sum("amount").cast("double").alias("total_amount"), F.sum("txns").alias("txn_count"), F.min("t0").alias("first_ts"), F.max("t1").alias("last_ts"),
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct(F.col("amount").cast("double").alias("amount"), "txns")))).alias("m"))
    bins = F.sequence(F.lit(0), F.col("num_bins") - 1)
    get = lambda field, zero: F.transform(bins, lambda i: F.coalesce(F.try_element_at("m", i)[field], zero))
    return per_pair.select("src", "dst", "total_amount", "txn_count", "first_ts", "last_ts", ((F.col("last_ts") - F.col("first_ts")) / DAY).alias("span_days"),
                           "num_bins", F.lit(bin_days).alias("bin_days"), get("amount", F.lit(0.0)).alias("amount_bins"), get("txns", F.lit(0).cast("long")).alias("count_bins"))


def has_paid(ledger: DataFrame, bin_days: int = BIN_DAYS) -> DataFrame:
    """Flow edges between different accounts."""
    return flow_agg(ledger, bin_days).where("src <> dst")


def account_edges(flows: DataFrame, min_weight: int = 1, keep_self_loops: bool = False) -> DataFrame:
    """Undirected (a, b, weight = payments both ways). A kept self loop counts its payments twice."""
    e = flows if keep_self_loops else flows.where("src <> dst")
    n = F.when(F.col("src") == F.col("dst"), 2 * F.col("txn_count")).otherwise(F.col("txn_count"))
    return e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(n).alias("weight")).where(F.col("weight") >= min_weight)


def _both_ways(flows: DataFrame) -> DataFrame:
    """Each edge once for its payer and once for its payee: one shuffle serves both sides."""
    side = F.explode_outer(F.array(F.struct(F.col("src").alias("id"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("id"), F.lit(False).alias("out"))))
    return flows.withColumn("side", side).withColumns({"id": F.col("side.id"), "out": F.col("side.out")}).drop("side")


def money_flow(accounts: DataFrame, flows: DataFrame) -> DataFrame:
    """Degrees, amounts, counts and ratios of every account; zeros where there is no flow."""
    pick = lambda cond, x: F.sum(F.when(cond, x).otherwise(0))
    out, inn = F.col("out"), ~F.col("out")
    per = _both_ways(flows.select("src", "dst", money("total_amount").alias("amt"), "txn_count")).groupBy("id").agg(
        F.count_if(inn).alias("in_degree"), F.count_if(out).alias("out_degree"), pick(inn, F.col("amt")).cast("double").alias("in_amount"), pick(out, F.col("amt")).cast("double").alias("out_amount"),
        pick(inn, F.col("txn_count")).alias("in_txns"), pick(out, F.col("txn_count")).alias("out_txns"))
    d = accounts.select("id").join(per, "id", "left").na.fill(0)
    return d.select("id", "in_degree", "out_degree", "in_amount", "out_amount", "in_txns", "out_txns",
                    F.round(F.col("in_amount") - F.col("out_amount"), 2).alias("net_flow"),
                    (F.col("in_degree") / (F.col("out_degree") + 1)).alias("fan_in_ratio"), (F.col("out_degree") / (F.col("in_degree") + 1)).alias("fan_out_ratio"),
                    F.round(F.least("in_amount", "out_amount") / (F.greatest("in_amount", "out_amount") + 0.01), 6).alias("pass_through_ratio"))


def _part(where: str):
    """Payments of the bins of ``line`` that meet a condition on i and n_bins."""
    i, _, bound = where.split(" ", 2)
    late = where.startswith("i >=")
    return F.aggregate("line", F.lit(0).cast("long"), lambda a, x: a + F.when((x[i] >= F.expr(bound)) if late else (x[i] < F.expr(bound)), x["cnt"]).otherwise(0))


def temporal_features(accounts: DataFrame, flows: DataFrame, reference_ts: int | None = None) -> DataFrame:
    """Timing features of every account; accounts that never pay keep the defaults (-1 for the three day features)."""
    ref = F.broadcast(flows.agg(F.max("last_ts").alias("ref"))) if reference_ts is None else None
    both = _both_ways(flows.select("src", "dst", "first_ts", "last_ts", "txn_count")).groupBy("id").agg(
        F.min("first_ts").alias("t0"), F.max("last_ts").alias("t1"), F.sum(F.when(F.col("out"), F.col("txn_count")).otherwise(0)).alias("n"),
        F.max(F.when(F.col("out"), F.col("last_ts"))).alias("last_out"), F.min(F.when(~F.col("out"), F.col("first_ts"))).alias("first_in"))
    bins = flows.select("src", F.posexplode_outer(F.arrays_zip("amount_bins", "count_bins")).alias("i", "z")).groupBy("src", "i").agg(
        F.sum(money("z.amount_bins")).alias("amt"), F.sum("z.count_bins").alias("cnt")).groupBy("src").agg(
        F.count(F.lit(1)).alias("n_bins"), F.max("cnt").alias("peak_cnt"), F.max("amt").alias("peak_amt"), F.sum("amt").alias("all_amt"), F.count_if(F.col("cnt") > 0).alias("active"),
        F.collect_list(F.struct("i", "cnt")).alias("line")).select(
        F.col("src").alias("id"), "n_bins", "peak_cnt", "peak_amt", "all_amt", "active",
        _part("i < n_bins div 2").alias("early"), _part("i >= n_bins div 2").alias("late"))
    per = both.where("n > 0").join(bins, "id")
    per = per.join(ref) if ref is not None else per.withColumn("ref", F.lit(reference_ts).cast("long"))
    span = (F.col("t1") - F.col("t0")) / DAY
    peak = F.when(F.col("all_amt") == 0, 0.0).otherwise(F.col("peak_amt").cast("double") / F.col("all_amt").cast("double"))
    lag = F.when(F.col("last_out").isNotNull() & F.col("first_in").isNotNull(), (F.col("last_out") - F.col("first_in")) / DAY).otherwise(0.0)
    vals = {
        "days_since_last_txn": (F.col("ref") - F.col("t1")) / DAY, "account_age_days": (F.col("ref") - F.col("t0")) / DAY, "activity_span_days": span,
        "mean_inter_txn_days": F.when(F.col("n") > 1, span / (F.col("n") - 1)).otherwise(-1.0),
        "txn_per_active_day": F.when(span > 0, F.try_divide(F.col("n").cast("double"), span)).otherwise(F.col("n").cast("double")),
        "active_bin_count": F.col("active"), "burst_ratio": F.col("peak_cnt") / (F.col("n") / F.col("n_bins")),
        "peak_bin_fraction": peak, "activity_concentration": peak,
        "early_late_ratio": F.when(F.col("late") > 0, F.try_divide(F.col("early").cast("double"), F.col("late"))).when(F.col("early") > 0, 999.0).otherwise(0.0),
        "in_out_lag_days": lag, "total_txns": F.col("n")}
    default = {k: -1.0 if k in ("days_since_last_txn", "account_age_days", "mean_inter_txn_days") else 0 for k in vals}
    whole = ("active_bin_count", "total_txns")
    per = per.select("id", *(v.alias(k) for k, v in vals.items()))
    d = accounts.select("id").join(per, "id", "left")
    return d.select("id", *((F.coalesce(F.col(k), F.lit(default[k])).cast("long") if k in whole else F.round(F.coalesce(F.col(k), F.lit(float(default[k]))), 6)).alias(k) for k in vals))


def max_bins(flows: DataFrame) -> DataFrame:
    return flows.agg(F.max("num_bins").alias("max_num_bins"), F.max(F.size("amount_bins")).alias("max_amount_bins"), F.max(F.size("count_bins")).alias("max_count_bins"))


def temporal_spec(flows: DataFrame) -> dict[str, int]:
    """The bins and the width of an edge vector; an error where edges disagree or there are none."""
    row = max_bins(flows).first()
    if row.max_num_bins is None:
        raise ValueError("no flow edges to derive the bins from")
    if len(set(row)) != 1:
        raise ValueError(f"inconsistent bins: {row.asDict()}")
    return {"bins": row.max_num_bins, "edge_dim": 8 + 2 * row.max_num_bins}


def reference_epoch(flows: DataFrame) -> DataFrame:
    return flows.agg(F.max("last_ts").alias("reference_epoch"), F.when(F.count(F.lit(1)) > 0, "ok").otherwise("no edges").alias("status"))
