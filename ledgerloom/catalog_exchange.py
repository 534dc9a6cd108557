"""The exchange folder as a query: written from the driver's tables, loaded back, and counted."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ledgerloom.catalog_flow import GRAPH, hp
from ledgerloom.functions import scalar
from ledgerloom.operators import export, flow
from ledgerloom.plans.fixpoint import scratch_dir
from ledgerloom.sources import exchange
from ledgerloom.sources import fixtures as fx
from ledgerloom.sources import ledger as files
from ledgerloom.sources.fixtures import with_

QUERIES: dict = {}
ORACLES: dict = {}

#: Rows of each file, in SQL that both engines read. Mules have a fraud column that is no number, some addresses a time that is none.
_OWN = {"device": "HAS_USED", "ip": "HAS_IP", "phone": "HAS_PHONE", "email": "HAS_EMAIL"}
_PII = {"birthdate": "birthdate", "city": "city", "state": "state", "postcode": "postcode", "name": "phone", "street_address": "email",
        "name_minhash": "birthdate", "address_minhash": "city", "street_minhash": "postcode"}
FILES = {
    "accountnumber": "SELECT concat('a', id) AS account_number, concat(is_mule, '') AS mule, CASE WHEN is_mule = 1 THEN 'yes' ELSE '0' END AS fraud, '0' AS victim, '0' AS is_external FROM {mules}",
    "external_accounts": "SELECT concat('x', id) AS account_id, 'bank' AS kind, 'fin' AS category FROM {accounts}",
    "merchants": "SELECT concat('x', id) AS counterparty_acct, 'shop' AS category FROM {accounts} UNION ALL SELECT concat('m', id), 'shop' FROM {accounts}",
    "person": "SELECT DISTINCT concat('p', party) AS customer_id, '0' AS mule, '0' AS fraud, '1' AS victim FROM {owners} UNION ALL SELECT DISTINCT concat('c', party), '0', '1', '0' FROM {pii}",
    "device": "SELECT DISTINCT value AS device_id, 'phone' AS device_type, CASE WHEN value < 'k' THEN 'True' ELSE 'False' END AS flagged_device FROM {identities} WHERE kind = 'device'",
    "ipaddress": "SELECT DISTINCT value AS ip_address, 'False' AS blacklisted_ip FROM {identities} WHERE kind = 'ip'",
    **{k: f"SELECT DISTINCT value AS {k}_id FROM {{identities}} WHERE kind = '{k}'" for k in ("phone", "email")},
    **{k: f"SELECT DISTINCT value AS {k}_id FROM {{pii}} WHERE kind = '{v}'" for k, v in _PII.items()},
    "HAS_ACCOUNT": "SELECT concat('p', party) AS s, concat('a', account) AS e FROM {owners}",
    "HAS_USED": "SELECT concat('p', party) AS s, value AS e, '2025-01-01 00:00:00' AS first_seen, '2025-02-01 00:00:00' AS last_seen FROM {identities} WHERE kind = 'device'",
    "HAS_IP": "SELECT concat('p', party) AS s, value AS e, CASE WHEN party < 40 THEN 'soon' ELSE '2025-01-01 00:00:00' END AS first_seen, '' AS last_seen FROM {identities} WHERE kind = 'ip'",
    **{f"HAS_{k.upper()}": f"SELECT concat('p', party) AS s, value AS e FROM {{identities}} WHERE kind = '{k}'" for k in ("phone", "email")},
    **{f"HAS_{k.upper()}": f"SELECT concat('c', party) AS s, value AS e FROM {{pii}} WHERE kind = '{v}'" for k, v in _PII.items()},
}
_BAD = {"accountnumber": "fraud = 'yes'", "HAS_IP": "first_seen = 'soon'"}


def _sql() -> str:
    names = {k: k for k in ("mules", "accounts", "owners", "identities", "pii")}
    parts = [f"f_{name} AS ({q.format(**names)})" for name, q in FILES.items()]
    parts.append("f_flow AS (SELECT DISTINCT concat('a', src) AS s, concat('a', dst) AS e FROM hp)")
    kinds: dict[str, list[str]] = {}
    for name, f in exchange.VERTEX_FILES.items():
        kinds.setdefault(f.kind, []).append(f"SELECT {f.key} AS id FROM f_{name}" + (f" WHERE NOT {_BAD[name]}" if name in _BAD else ""))
    parts += [f"v_{k} AS ({' UNION '.join(q)})" for k, q in kinds.items()]
    out = [f"SELECT 'vertex' AS what, '{k}' AS name, count(*) AS n FROM v_{k}" for k in kinds]
    edges = {name: (f.kind, f.start, f.end, f"f_{name}") for name, f in exchange.EDGE_FILES.items()} | {exchange.FLOWS: ("HAS_PAID", "Account", "Account", "f_flow")}
    for name, (kind, start, end, at) in edges.items():
        bad = _BAD.get(name, "false")
        held = f"SELECT DISTINCT s, e, s IN (SELECT id FROM v_{start}) AND e IN (SELECT id FROM v_{end}) AS ok FROM {at} WHERE NOT ({bad})"
        out.append(f"SELECT 'edge', '{kind}', count(*) FROM ({held}) WHERE ok")
        out.append(f"SELECT * FROM (SELECT 'bad', '{name}', (SELECT count(*) FROM ({held}) WHERE NOT ok) + (SELECT count(*) FROM {at} WHERE {bad}) AS n) WHERE n > 0")
    out.append(f"SELECT 'bad', 'accountnumber', count(*) FROM f_accountnumber WHERE {_BAD['accountnumber']}")
    pii = fx.SQL["pii"]
    return f"{GRAPH},\n{pii},\n" + ",\n".join(parts) + "\n" + "\nUNION ALL ".join(out)


def exchange_load(spark, sf_dir):
    """All 32 files written into shared scratch storage and loaded: rows of each type, and of each file set aside."""
    at = f"{scratch_dir(spark)}/exchange-{uuid.uuid4().hex}"
    base = {"mules": fx.mules(spark, sf_dir), "accounts": fx.accounts(spark, sf_dir), "owners": fx.owners(spark, sf_dir),
            "identities": fx.identities(spark, sf_dir), "pii": fx.party_pii(spark, sf_dir)}
    frames = {}
    for name, q in FILES.items():
        frames[name] = spark.sql(q, **{k: v for k, v in base.items() if f"{{{k}}}" in q}).withColumnsRenamed({"s": "FROM", "e": "TO"})
    flows = export.flow_csv_lines(hp(spark, sf_dir))
    frames[exchange.FLOWS] = flows.withColumns({c: F.concat(F.lit("a"), F.col(c)) for c in ("from_id", "to_id")})
    exchange.write(frames, at)
    got = exchange.load(spark, at)
    counted = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), F.lit(name).alias("name"), "n")
               for what, parts in (("vertex", got.vertices), ("edge", got.edges)) for name, d in parts.items()]
    bad = got.quarantine.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select(F.lit("bad").alias("what"), F.col("file").alias("name"), "n")
    return reduce(lambda a, b: a.unionAll(b), [*counted, bad])


QUERIES["exchange_load"], ORACLES["exchange_load"] = exchange_load, _sql()


def ledger_csv(spark, sf_dir):
    """The ledger with its rings, written as CSV with UTC times and read again."""
    at = f"{scratch_dir(spark)}/ledger-{uuid.uuid4().hex}"
    d = fx.ring_ledger(spark, sf_dir)
    d.select(F.col("src").alias("src_acct"), F.col("dst").alias("dst_acct"), F.format_string("%.2f", "amount").alias("amount"),
             scalar.time_text("ts").alias("ts"), "ring_id").write.csv(at, header=True)
    return files.read_ledger(spark, at).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "amount", "ts", "ring_id")


def edges_csv(spark, sf_dir):
    """Account edges written as CSV, each twice, and read as one edge for each pair of ends."""
    at, e = f"{scratch_dir(spark)}/edges-{uuid.uuid4().hex}", flow.account_edges(hp(spark, sf_dir))
    e = e.select(F.col("a").alias("FROM"), F.col("b").alias("TO"), F.col("weight").cast("string").alias("weight"))
    e.unionAll(e).write.csv(at, header=True)
    d = files.read_edges(spark, at)
    return d.select("from_id", "to_id", F.col("weight").cast("long").alias("weight"))


QUERIES["ledger_csv"] = ledger_csv
ORACLES["ledger_csv"] = f"{with_('ledger', 'rings')} SELECT src, dst, CAST(printf('%.2f', amount) AS DOUBLE) AS amount, ts, CAST(ring_id AS BIGINT) AS ring_id FROM ring_ledger"
QUERIES["edges_csv"] = edges_csv
ORACLES["edges_csv"] = f"{GRAPH} SELECT CAST(a AS VARCHAR) AS from_id, CAST(b AS VARCHAR) AS to_id, weight FROM aa"
