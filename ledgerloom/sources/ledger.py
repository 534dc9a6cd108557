"""File sources: the ledger, flow edges, vertices and edges of the exchange format."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import epoch

TIME = "yyyy-MM-dd HH:mm:ss"
#: Vertex files: file name -> (vertex type, id column). Fixed values of the exchange format.
VERTEX_FILES = {
    "accountnumber": ("Account", "account_number"), "external_accounts": ("Account", "account_id"), "merchants": ("Account", "counterparty_acct"), "person": ("Party", "customer_id"),
    "device": ("Device", "device_id"), "ipaddress": ("IP", "ip_address"), "phone": ("Phone", "phone_id"), "email": ("Email", "email_id"), "name": ("Name", "name_id"), "birthdate": ("Birthdate", "birthdate_id"),
    "street_address": ("Street_Address", "street_address_id"), "city": ("City", "city_id"), "state": ("State", "state_id"), "postcode": ("Postcode", "postcode_id"),
    "name_minhash": ("Name_Minhash", "name_minhash_id"), "address_minhash": ("Address_Minhash", "address_minhash_id"), "street_minhash": ("Street_Minhash", "street_minhash_id"),
}


def type_of(value) -> str:
    """The Spark type of a default value."""
    return {bool: "boolean", int: "long", float: "double"}.get(type(value), "string")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def seconds(column: str):
    """Seconds of a UTC time text, in whatever zone the session is; a malformed text is an error."""
    return epoch(f"to_timestamp_ntz(trim({column}), '{TIME}')")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, amount, ts[, ring_id]) of a CSV with a header; columns are checked before anything is read."""
    d = require(spark.read.csv(path, header=True), ["src_acct", "dst_acct", "amount", "ts"])
    ring = [F.col("ring_id").cast("long").alias("ring_id")] if "ring_id" in d.columns else []
    return d.select(F.col("src_acct").alias("src"), F.col("dst_acct").alias("dst"), F.col("amount").cast("double").alias("amount"), seconds("ts").alias("ts"), *ring)


def read_flow_edges(spark: SparkSession, path: str) -> DataFrame:
    d = require(spark.read.csv(path, header=True), ["from_id", "to_id", "total_amount", "txn_count", "first_txn_date", "last_txn_date", "span_days", "num_bins", "amount_bins", "count_bins"])
    bins = lambda c, kind: F.transform(F.split(c, ";"), lambda x: x.cast(kind))
    return d.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.col("total_amount").cast("double").alias("total_amount"), F.col("txn_count").cast("long").alias("txn_count"),
                    seconds("first_txn_date").alias("first_ts"), seconds("last_txn_date").alias("last_ts"), F.col("span_days").cast("double").alias("span_days"), F.col("num_bins").cast("int").alias("num_bins"),
                    bins("amount_bins", "double").alias("amount_bins"), bins("count_bins", "long").alias("count_bins"))


def read_vertices(spark: SparkSession, folder: str, name: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Vertices of one file with their id as ``id``; flags given as the text True become 1.

    ``defaults`` (attribute -> value) is the vertex type's schema: attributes that the file lacks or leaves empty get it.
    """
    _, key = VERTEX_FILES[name]
    d = require(spark.read.csv(f"{folder}/{name}.csv", header=True), [key]).withColumnRenamed(key, "id")
    for c in ("flagged_device", "blacklisted_ip"):
        if c in d.columns:
            d = d.withColumn(c, F.when(F.col(c) == "True", 1).otherwise(0))
    for c, v in (defaults or {}).items():
        d = d.withColumn(c, F.coalesce(F.col(c).try_cast(type_of(v)), F.lit(v)) if c in d.columns else F.lit(v))
    return d.dropDuplicates(["id"])


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(from_id, to_id, attributes) with one row for each pair of ends."""
    d = require(spark.read.csv(path, header=True), ["FROM", "TO"]).withColumnsRenamed({"FROM": "from_id", "TO": "to_id"})
    rest = [c for c in d.columns if c not in ("from_id", "to_id")]
    return d.groupBy("from_id", "to_id").agg(*(F.max(c).alias(c) for c in rest)) if rest else d.distinct()


def upsert(sources: list[DataFrame], defaults: dict[str, object], key: str = "id") -> DataFrame:
    """One vertex for each id of all sources; of the values that are given the largest stays, else the default."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    given = {c: F.max(c) if c in every.columns else F.lit(None) for c in defaults}
    return every.groupBy(key).agg(*(F.coalesce(given[c], F.lit(v)).alias(c) for c, v in defaults.items()))


def number(text, kind: str = "long"):
    """A JSON number as it stands in the text: true and false are an error, a whole double is a whole number, another one is not."""
    bad = F.raise_error(F.concat(F.lit("not a number: "), text)).cast(kind)
    value = text.try_cast("double")
    ok = value.isNotNull() if kind == "double" else value.isNotNull() & (value == F.floor(value))
    return F.when(text.isNull(), F.lit(None).cast(kind)).when(ok, F.coalesce(text.try_cast(kind), value.cast(kind))).otherwise(bad)


def parse_edges(results: DataFrame, attributes: dict[str, str] | None = None, column: str = "json") -> DataFrame:
    """(from_id, to_id, attributes) of JSON results {"edges": [{"from_id", "to_id", ...}]}; an edge without an end is an error."""
    attributes = attributes or {}
    shape = "edges array<struct<from_id: string, to_id: string" + "".join(f", {k}: string" for k in attributes) + ">>"
    e = results.select(F.explode(F.from_json(column, shape)["edges"]).alias("e")).select("e.*")
    end = lambda c: F.coalesce(c, F.raise_error(F.lit("an edge of the result lacks an end")).cast("string")).alias(c)
    return e.select(end("from_id"), end("to_id"), *(number(F.col(k), v).alias(k) for k, v in attributes.items()))
