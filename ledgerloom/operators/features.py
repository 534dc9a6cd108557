"""Training features: account columns, their normalisation, and edge vectors."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import DAY, log1p0, symlog

# The model's account features, in column order, each with its transform.
ACCOUNT_FEATURES = {
    "pagerank": "identity", "com_size": "log1p", "aa_degree": "log1p", "triangle_count": "log1p", "clustering_coef": "identity",
    "in_degree": "log1p", "out_degree": "log1p", "in_amount": "log1p", "out_amount": "log1p", "in_txn_count": "log1p", "out_txn_count": "log1p",
    "fan_in_ratio": "identity", "fan_out_ratio": "identity", "pass_through_ratio": "identity", "net_flow": "symlog",
    "activity_span_days": "identity", "days_since_last_txn": "clamp", "account_age_days": "clamp", "mean_inter_txn_days": "clamp",
    "txn_per_active_day": "identity", "burst_ratio": "identity", "active_bin_count": "log1p", "activity_concentration": "identity",
    "peak_bin_fraction": "identity", "early_late_ratio": "symlog", "in_out_lag_days": "symlog",
    "device_share_cnt": "log1p", "ip_share_cnt": "log1p", "phone_share_cnt": "log1p", "email_share_cnt": "log1p", "is_external": "boolean",
}
LEAKY = {"com_id", "is_fraud", "fraud", "victim", "pu_label"}
_APPLY = {
    "identity": lambda c: c, "log1p": log1p0, "symlog": symlog, "clamp": lambda c: F.when(c == -1.0, 0.0).otherwise(c), "boolean": lambda c: F.when(c != 0.0, 1.0).otherwise(0.0),
}


def account_features(accounts: DataFrame, features: dict[str, str] = ACCOUNT_FEATURES) -> DataFrame:
    """(id, features in order): transformed; a missing column is an error, a missing value is 0."""
    missing = set(features) - set(accounts.columns)
    if missing or LEAKY & set(features):
        raise ValueError(f"missing columns {sorted(missing)}, leaking columns {sorted(LEAKY & set(features))}")
    return accounts.select("id", *(_APPLY[t](F.coalesce(F.col(k).cast("double"), F.lit(0.0))).alias(k) for k, t in features.items()))


def fit_normaliser(features: DataFrame, names: list[str], floor: float = 1e-6) -> DataFrame:
    """One row of means and population deviations, the latter at least ``floor``."""
    return features.agg(*(F.avg(k).alias(f"{k}_mean") for k in names), *(F.greatest(F.stddev_pop(k), F.lit(floor)).alias(f"{k}_std") for k in names))


def normalise(features: DataFrame, stats: DataFrame, names: list[str]) -> DataFrame:
    return features.join(F.broadcast(stats)).select("id", *(((F.col(k) - F.col(f"{k}_mean")) / F.col(f"{k}_std")).alias(k) for k in names))


def pad(bins, width: int):
    return F.slice(F.concat(bins, F.array_repeat(F.lit(0).cast("double"), width)), 1, width)


def edge_features(flows: DataFrame, reference_ts, width: int, check_width: bool = False) -> DataFrame:
    """(src, dst, 8 scalars, bins array): bins alternate log1p(amount) and count, cut or padded to ``width`` bins.

    With ``check_width`` one pass over the data warns where bins are cut or nearly so.
    """
    if width < 1:
        raise ValueError("width must be at least 1")
    if check_width:
        most = flows.agg(F.max(F.greatest(F.size("amount_bins"), F.size("count_bins")))).first()[0] or 0
        if most > width:
            warnings.warn(f"edges have up to {most} bins, {width} are kept: temporal data is cut", stacklevel=2)
        elif int(0.9 * width) <= most < width:
            warnings.warn(f"edges have up to {most} of {width} bins", stacklevel=2)
    ref = F.lit(reference_ts) if not hasattr(reference_ts, "columns") else None
    d = flows if ref is not None else flows.join(F.broadcast(reference_ts.toDF("_ref")))
    ref = ref if ref is not None else F.col("_ref")
    d = d.withColumns({"_a": pad(F.col("amount_bins").cast("array<double>"), width), "_c": pad(F.col("count_bins").cast("array<double>"), width)})
    active = F.size(F.filter("_c", lambda x: x > 0)).cast("double")
    zero = lambda c: F.greatest(c, F.lit(0.0))
    return d.select(
        "src", "dst", log1p0("total_amount").alias("log_amount"), log1p0("txn_count").alias("log_txns"), F.col("span_days").cast("double").alias("span_days"), active.alias("active_bins"),
        zero((ref - F.col("last_ts")) / DAY).alias("recency_days"), zero((F.col("last_ts") - F.col("first_ts")) / DAY).alias("duration_days"), (active / width).alias("active_fraction"),
        F.when(F.col("txn_count") > 0, F.try_divide(F.col("total_amount"), F.col("txn_count"))).otherwise(0.0).alias("amount_per_txn"),
        F.flatten(F.zip_with("_a", "_c", lambda a, c: F.array(log1p0(a), F.greatest(c, F.lit(0.0))))).alias("bins"))


def aligned(wanted: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """Features in the order of ``wanted``'s rows; a row without features is an error."""
    d = wanted.join(features.withColumn("_there", F.lit(1)), keys, "left")
    return d.withColumn("_there", F.coalesce("_there", F.raise_error(F.lit("a requested row has no features")).cast("int"))).where("_there = 1").drop("_there")


def sentinel_counts(accounts: DataFrame) -> DataFrame:
    n = F.col("in_txn_count") + F.col("out_txn_count")
    is_ = lambda c, v=-1.0: F.col(c) == v
    return accounts.agg(
        F.count(F.lit(1)).alias("total_accounts"), F.count_if(is_("days_since_last_txn")).alias("no_last_txn"), F.count_if(is_("account_age_days")).alias("no_age"), F.count_if(is_("mean_inter_txn_days")).alias("no_gap"),
        F.count_if(is_("days_since_last_txn") & (n == 0)).alias("no_last_and_no_txns"), F.count_if(is_("mean_inter_txn_days") & (n == 1)).alias("no_gap_and_one_txn"),
        F.count_if(is_("activity_span_days", 0.0)).alias("span_zero"), F.count_if(~is_("activity_span_days", 0.0)).alias("span_nonzero"), F.min("com_size").alias("min_com_size"), F.max("com_size").alias("max_com_size"))
