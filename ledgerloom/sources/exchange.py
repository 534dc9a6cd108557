"""The whole exchange folder: 17 vertex and 15 edge files, loaded by a declared schema, bad rows set aside.

Every file is a CSV with a header. A row that cannot be parsed, lacks an id or has a value of another type goes to the
quarantine with its file and reasons, as do edges whose ends are no loaded vertices; all others are loaded. Vertices
of one type may come from several files and become one row each: what a file gives stays, attributes that none
gives have the type's default. Files are read in parallel by Spark and each once; nothing passes through the driver but headers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.ledger import TIME, seconds, type_of, upsert

# Attributes of the vertex types with their defaults.
ATTRIBUTES: dict[str, dict[str, object]] = {
    "Account": {
        "is_fraud": 0, "fraud": 0, "victim": 0, "is_external": 0, "external_type": "", "category": "", "pagerank": 0.0, "com_size": 0, "com_id": 0,
        "aa_degree": 0, "triangle_count": 0, "clustering_coef": 0.0, "in_degree": 0, "out_degree": 0, "in_amount": 0.0, "out_amount": 0.0,
        "in_txn_count": 0, "out_txn_count": 0, "fan_in_ratio": 0.0, "fan_out_ratio": 0.0, "pass_through_ratio": 0.0, "net_flow": 0.0,
        "activity_span_days": 0.0, "days_since_last_txn": -1.0, "account_age_days": -1.0, "mean_inter_txn_days": -1.0, "txn_per_active_day": 0.0,
        "burst_ratio": 0.0, "active_bin_count": 0, "activity_concentration": 0.0, "peak_bin_fraction": 0.0, "early_late_ratio": 0.0,
        "in_out_lag_days": 0.0, "device_share_cnt": 0, "ip_share_cnt": 0, "phone_share_cnt": 0, "email_share_cnt": 0, "mule_cnt": 0, "fraud_ip": 0,
        "fraud_device": 0, "trans_in_mule_ratio": 0.0, "trans_out_mule_ratio": 0.0, "shortest_path_length": -1, "is_train": 0, "is_val": 0,
        "is_test": 0, "pu_label": 0},
    "Party": {"is_fraud": 0, "fraud": 0, "victim": 0},
    "Device": {"device_type": "", "is_blocked": 0},
    "IP": {"is_blocked": 0},
}


@dataclass(frozen=True)
class VertexFile:
    kind: str
    key: str
    columns: dict[str, str]  # attribute -> column
    flags: tuple[str, ...] = ()  # attributes that are 1 for the text True, else 0


@dataclass(frozen=True)
class EdgeFile:
    kind: str
    start: str
    end: str
    times: tuple[str, ...] = ()


# The files, what they hold, and their columns.
VERTEX_FILES = {
    "accountnumber": VertexFile("Account", "account_number", {"is_fraud": "mule", "fraud": "fraud", "victim": "victim", "is_external": "is_external"}),
    "external_accounts": VertexFile("Account", "account_id", {"external_type": "kind", "category": "category"}),
    "merchants": VertexFile("Account", "counterparty_acct", {"category": "category"}),
    "person": VertexFile("Party", "customer_id", {"is_fraud": "mule", "fraud": "fraud", "victim": "victim"}),
    "device": VertexFile("Device", "device_id", {"device_type": "device_type", "is_blocked": "flagged_device"}, ("is_blocked",)),
    "ipaddress": VertexFile("IP", "ip_address", {"is_blocked": "blacklisted_ip"}, ("is_blocked",)),
    **{kind.lower(): VertexFile(kind, f"{kind.lower()}_id", {}) for kind in (
        "Phone", "Email", "Name", "Birthdate", "Street_Address", "City", "State", "Postcode", "Name_Minhash", "Address_Minhash", "Street_Minhash")},
}
EDGE_FILES = {
    "HAS_ACCOUNT": EdgeFile("Party_Has_Account", "Party", "Account"),
    "HAS_USED": EdgeFile("Has_Device", "Party", "Device", ("first_seen", "last_seen")),
    "HAS_IP": EdgeFile("Has_IP", "Party", "IP", ("first_seen", "last_seen")),
    **{f"HAS_{kind.upper()}": EdgeFile(f"Has_{kind}", "Party", kind) for kind in (
        "Phone", "Email", "Name", "Birthdate", "Street_Address", "City", "State", "Postcode", "Name_Minhash", "Address_Minhash", "Street_Minhash")},
}
FLOWS = "ACCOUNT_FLOW_AGG"
FLOW_VALUES = {"total_amount": "double", "txn_count": "long", "span_days": "double", "num_bins": "int", "bin_days": "int"}
FLOW_LISTS = {"amount_bins": "double", "count_bins": "long"}


@dataclass(frozen=True)
class Loaded:
    vertices: dict[str, DataFrame]  # by type: (id, attributes)
    edges: dict[str, DataFrame]  # by type: (from_id, to_id, attributes)
    quarantine: DataFrame  # (file, line, reasons)


def _rows(spark: SparkSession, folder: str, name: str, wanted: list[str]) -> DataFrame:
    """The wanted columns as text, and ``line``: the whole line where it cannot be parsed, else its values joined."""
    path = f"{folder}/{name}.csv"
    header = spark.read.csv(path, header=True).columns
    if missing := [c for c in wanted if c not in header]:
        raise ValueError(f"{name}: missing columns {missing}")
    schema = ", ".join(f"`{c}` string" for c in (*header, "_broken"))
    d = spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken")
    line = F.coalesce("_broken", F.concat_ws(",", *(F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in header)))
    return d.select(*(F.col(f"`{c}`") for c in wanted), F.col("_broken").isNotNull().alias("_broken"), line.alias("line"))


def _checked(d: DataFrame, name: str, checks: list) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine) by ``checks``: (condition that a row is bad, reason); a line that is broken has no other reason."""
    found = [F.when(~F.col("_broken") & F.coalesce(bad, F.lit(False)), F.lit(why)) for bad, why in checks]
    reasons = F.array_compact(F.array(F.when(F.col("_broken"), F.lit("malformed line")), *found))
    d = d.withColumn("reasons", reasons)
    good = d.where(F.size("reasons") == 0).drop("reasons", "_broken", "line")
    return good, d.where(F.size("reasons") > 0).select(F.lit(name).alias("file"), "line", "reasons")


def _not(kind: str, column: str):
    c = F.col(column)
    return c.isNotNull() & c.try_cast(kind).isNull(), f"{column} is no {kind}"


def _vertices(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    f = VERTEX_FILES[name]
    d = _rows(spark, folder, name, [f.key, *f.columns.values()])
    types = {a: type_of(ATTRIBUTES[f.kind][a]) for a in f.columns}
    typed = [_not(types[a], c) for a, c in f.columns.items() if a not in f.flags and types[a] != "string"]
    good, bad = _checked(d, name, [(F.col(f.key).isNull(), "no id"), *typed])

    def value(a: str, c: str):
        return F.when(F.col(c) == "True", 1).otherwise(0).cast("long") if a in f.flags else F.col(c).try_cast(types[a])

    return good.select(F.col(f.key).alias("id"), *(value(a, c).alias(a) for a, c in f.columns.items())), bad


def _ends(d: DataFrame, start: DataFrame, end: DataFrame, kinds: tuple[str, str], name: str) -> tuple[DataFrame, DataFrame]:
    """(edges whose ends are loaded, quarantine)."""
    has = lambda v, c: v.select(F.col("id").alias(c), F.lit(True).alias(f"_{c}"))
    d = d.join(has(start, "from_id"), "from_id", "left").join(has(end, "to_id"), "to_id", "left")
    lost = [F.when(F.col(f"_{c}").isNull(), F.lit(f"{c} is no {k}")) for c, k in zip(("from_id", "to_id"), kinds)]
    d = d.withColumn("reasons", F.array_compact(F.array(*lost)))
    good = d.where(F.size("reasons") == 0).drop("_from_id", "_to_id", "reasons")
    line = F.concat_ws(",", "from_id", "to_id")
    return good, d.where(F.size("reasons") > 0).select(F.lit(name).alias("file"), line.alias("line"), "reasons")


def _edges(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    f = EDGE_FILES[name]
    d = _rows(spark, folder, name, ["FROM", "TO", *f.times]).withColumnsRenamed({"FROM": "from_id", "TO": "to_id"})
    good, bad = _checked(d, name, [*_no_ends(), *(_no_time(c) for c in f.times)])
    if f.times:  # one edge for each pair of ends: seen first and last in any row
        first, last = f.times
        return good.groupBy("from_id", "to_id").agg(F.min(seconds(first)).alias(first), F.max(seconds(last)).alias(last)), bad
    return good.distinct(), bad


def _no_ends() -> list:
    return [(F.col("from_id").isNull(), "no start"), (F.col("to_id").isNull(), "no end")]


def _no_time(c: str):
    return F.col(c).isNotNull() & F.expr(f"try_to_timestamp(trim({c}), '{TIME}')").isNull(), f"{c} is no time"


def _each(kind: str, fails: bool = False):
    """For each text of a list its value, or whether it has none."""
    return (lambda x: x.try_cast(kind).isNull()) if fails else (lambda x: x.try_cast(kind))


def _flows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Flow edges; the lists are split at ';'. Of repeated pairs of ends the largest row stays."""
    times = ["first_txn_date", "last_txn_date"]
    d = _rows(spark, folder, FLOWS, ["from_id", "to_id", *FLOW_VALUES, *times, *FLOW_LISTS])
    lists = [(F.exists(F.split(c, ";"), _each(kind, True)), f"{c} is no list of {kind}") for c, kind in FLOW_LISTS.items()]
    uneven = F.size(F.split("amount_bins", ";")) != F.size(F.split("count_bins", ";")), "lists of different length"
    good, bad = _checked(d, FLOWS, [*_no_ends(), *(_not(k, c) for c, k in FLOW_VALUES.items()), *map(_no_time, times), *lists, uneven])
    typed = good.select("from_id", "to_id", F.struct(
        *(F.col(c).try_cast(k).alias(c) for c, k in FLOW_VALUES.items()), *(seconds(c).alias(c) for c in times),
        *(F.transform(F.split(c, ";"), _each(kind)).alias(c) for c, kind in FLOW_LISTS.items())).alias("v"))
    return typed.groupBy("from_id", "to_id").agg(F.max("v").alias("v")).select("from_id", "to_id", "v.*"), bad


def load(spark: SparkSession, folder: str) -> Loaded:
    """All files of ``folder``; one that is missing, or lacks a column, is an error."""
    parts: dict[str, list[DataFrame]] = {}
    bad, edges = [], {}
    for name, f in VERTEX_FILES.items():
        good, rest = _vertices(spark, folder, name)
        parts.setdefault(f.kind, []).append(good)
        bad.append(rest)
    vertices = {kind: upsert(p, ATTRIBUTES[kind]) if kind in ATTRIBUTES else p[0].distinct() for kind, p in parts.items()}
    for name, f in EDGE_FILES.items():
        good, rest = _edges(spark, folder, name)
        edges[f.kind], lost = _ends(good, vertices[f.start], vertices[f.end], (f.start, f.end), name)
        bad += [rest, lost]
    good, rest = _flows(spark, folder)
    edges["HAS_PAID"], lost = _ends(good, vertices["Account"], vertices["Account"], ("Account", "Account"), FLOWS)
    return Loaded(vertices, edges, reduce(lambda a, b: a.unionByName(b), [*bad, rest, lost]))


def write(files: dict[str, DataFrame], folder: str) -> None:
    """A folder of CSV files with headers: name -> frame of text columns."""
    for name, rows in files.items():
        rows.write.csv(f"{folder}/{name}.csv", header=True)
