"""Adapters that read the driver's tables as a payment graph; and the same as SQL, for the oracles.

The peer ledger pairs each purchase with the next one of the same day, so the adapter's window is
dealt out by day and not one global order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import epoch


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def peer_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, amount, ts seconds)"""
    e = read(spark, sf_dir, "events").where("event_type = 'purchase'")
    nxt = F.lead("user_id").over(Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("src"), nxt.alias("dst"), F.col("value").alias("amount"), epoch("ts").alias("ts")).where("dst is not null")


def flow_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The large bipartite ledger: customers pay suppliers."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount", "l_shipdate")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("dst"),
        (F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.5) / 100).alias("amount"), epoch("l_shipdate").alias("ts"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("id")).where("id is not null").distinct()


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(party, kind, value): a party's device, ip, phone and email, from its first event of a kind."""
    kinds = {"signup": "device", "error": "ip", "click": "phone", "view": "email"}
    e = read(spark, sf_dir, "events").where(F.col("event_type").isin(list(kinds)))
    first = e.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id", "props")).alias("f"))
    kind = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))[F.col("event_type")]
    return first.select(F.expr("user_id div 2").alias("party"), kind.alias("kind"), F.col("f.props").alias("value"))


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(account, party)"""
    return accounts(spark, sf_dir).select(F.col("id").alias("account"), F.expr("id div 2").alias("party"))


def party_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(party, kind, value) of the six kinds of party attributes."""
    c = read(spark, sf_dir, "customer")
    kinds = {"email": "cast(cast(floor(c_acctbal) as bigint) as string)", "phone": "cast((c_custkey * 7919) % 997 as string)",
             "birthdate": "concat(cast(c_nationkey as string), '-', c_mktsegment)", "postcode": "cast(cast(floor(c_acctbal / 50) as bigint) as string)",
             "city": "cast(c_nationkey as string)", "state": "cast(c_nationkey % 5 as string)"}
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.expr(v).alias("value")) for k, v in kinds.items()))
    return c.select(F.col("c_custkey").alias("party"), F.explode_outer(pairs).alias("p")).select("party", "p.kind", "p.value").where("value is not null")


def mules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, is_mule)"""
    return accounts(spark, sf_dir).select("id", F.expr("cast((id * 31 + 7) % 11 = 0 as int)").alias("is_mule"))


def ring_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peer_ledger(spark, sf_dir).withColumn("ring_id", F.expr("CASE WHEN src % 3 = 0 AND dst % 3 = 0 THEN src % 5 + 1 ELSE 0 END"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, score, label): a ranking with ties."""
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return read(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), F.col("toxic").alias("label"))


#: The same adapters as common table expressions.
SQL = {
    "ledger": """ledger AS (SELECT src, dst, amount, ts FROM (
  SELECT user_id AS src, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS dst, value AS amount, CAST(floor(epoch(ts)) AS BIGINT) AS ts
  FROM events WHERE event_type = 'purchase') WHERE dst IS NOT NULL)""",
    "accounts": "accounts AS (SELECT DISTINCT user_id AS id FROM events WHERE user_id IS NOT NULL)",
    "identities": """identities AS (SELECT user_id // 2 AS party, kind, props AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r,
    CASE event_type WHEN 'signup' THEN 'device' WHEN 'error' THEN 'ip' WHEN 'click' THEN 'phone' WHEN 'view' THEN 'email' END AS kind FROM events)
  WHERE r = 1 AND kind IS NOT NULL)""",
    "owners": "owners AS (SELECT id AS account, id // 2 AS party FROM accounts)",
    "pii": """pii AS (SELECT c_custkey AS party, 'email' AS kind, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS value FROM customer
  UNION ALL SELECT c_custkey, 'phone', CAST((c_custkey * 7919) % 997 AS VARCHAR) FROM customer
  UNION ALL SELECT c_custkey, 'birthdate', CAST(c_nationkey AS VARCHAR) || '-' || c_mktsegment FROM customer
  UNION ALL SELECT c_custkey, 'postcode', CAST(CAST(floor(c_acctbal / 50) AS BIGINT) AS VARCHAR) FROM customer
  UNION ALL SELECT c_custkey, 'city', CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL SELECT c_custkey, 'state', CAST(c_nationkey % 5 AS VARCHAR) FROM customer)""",
    "mules": "mules AS (SELECT id, CAST((id * 31 + 7) % 11 = 0 AS INT) AS is_mule FROM accounts)",
    "rings": "ring_ledger AS (SELECT *, CASE WHEN src % 3 = 0 AND dst % 3 = 0 THEN src % 5 + 1 ELSE 0 END AS ring_id FROM ledger)",
    "scores": "scores AS (SELECT doc_id AS id, CAST(n_chars AS DOUBLE) AS score, toxic AS label FROM labels JOIN documents USING (doc_id))",
}


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
