"""Queries over ledgers, flows and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import flow, identity
from ledgerloom.sources import fixtures as fx
from ledgerloom.sources.fixtures import with_

QUERIES: dict = {}
ORACLES: dict = {}
BIN = flow.BIN_DAYS


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def flow_ctes(ledger: str = "ledger", days: int = BIN) -> str:
    return f"""bound AS (SELECT min(ts) AS g0, CAST(greatest(1, (max(ts) - min(ts)) // {days * 86400} + 1) AS INT) AS nb FROM {ledger}),
placed AS (SELECT l.*, nb, CAST(least(greatest((ts - g0) // {days * 86400}, 0), nb - 1) AS INT) AS bin FROM {ledger} l, bound),
binned AS (SELECT src, dst, nb, bin, sum(CAST(amount AS DECIMAL(18, 2))) AS dec, count(*) AS txns, min(ts) AS t0, max(ts) AS t1 FROM placed
    GROUP BY src, dst, nb, bin),
flow AS (SELECT src, dst, CAST(sum(dec) AS DOUBLE) AS total_amount, CAST(sum(txns) AS BIGINT) AS txn_count, min(t0) AS first_ts, max(t1) AS last_ts,
    nb AS num_bins, {days} AS bin_days,
  map_from_entries(list({{'k': bin, 'v': CAST(dec AS DOUBLE)}})) AS ma, map_from_entries(list({{'k': bin, 'v': txns}})) AS mc FROM binned
    GROUP BY src, dst, nb),
hp AS (SELECT * FROM flow WHERE src <> dst),
hp_bin AS (SELECT f.src, f.dst, CAST(i AS INT) AS i, coalesce(b.dec, 0) AS amt, coalesce(b.txns, 0) AS cnt
  FROM (SELECT src, dst, unnest(range(num_bins)) AS i FROM hp) f LEFT JOIN binned b ON f.src = b.src AND f.dst = b.dst AND f.i = b.bin)"""


LEDGER = with_("ledger") + ",\n" + flow_ctes()
GRAPH = with_("ledger", "accounts", "identities", "owners", "mules") + ",\n" + flow_ctes() + """,
aa AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(sum(txn_count) AS BIGINT) AS weight FROM hp GROUP BY ALL)"""


def hp(spark, sf_dir):
    return flow.has_paid(fx.peer_ledger(spark, sf_dir))


def joined(c):
    """Bins as text, so that values compare alike in any engine."""
    return F.array_join(F.transform(c, lambda x: F.format_string("%.2f", x.cast("double"))), ";")


_TEXT_BINS = """array_to_string(list_transform(range(num_bins), lambda i: printf('%.2f', CAST(coalesce(ma[CAST(i AS INT)], 0) AS DOUBLE))), ';') AS amount_bins,
  array_to_string(list_transform(range(num_bins), lambda i: printf('%.2f', CAST(coalesce(mc[CAST(i AS INT)], 0) AS DOUBLE))), ';') AS count_bins"""


def _flow_rows(d):
    return d.select("src", "dst", "total_amount", "txn_count", "first_ts", "last_ts", F.round("span_days", 6).alias("span_days"), "num_bins", joined("amount_bins").alias("amount_bins"), joined("count_bins").alias("count_bins"))


_FLOW_SQL = f"SELECT src, dst, total_amount, txn_count, first_ts, last_ts, round((last_ts - first_ts) / 86400.0, 6) AS span_days, num_bins, {_TEXT_BINS} FROM flow"


@query(f"{LEDGER} {_FLOW_SQL}")
def flow_agg(spark, sf_dir):
    return _flow_rows(flow.flow_agg(fx.peer_ledger(spark, sf_dir)))


_BIG = """WITH big AS (SELECT 'C' || o_custkey AS src, 'S' || l_suppkey AS dst, floor(l_extendedprice * (1 - l_discount) * 100 + CAST(0.5 AS DOUBLE)) / 100 AS amount, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
"""


@query(_BIG + flow_ctes("big", 90) + "\n" + _FLOW_SQL)
def flow_agg_large(spark, sf_dir):
    return _flow_rows(flow.flow_agg(fx.flow_ledger(spark, sf_dir), 90))


@query(f"{LEDGER} SELECT src, dst, bin, CAST(dec AS DOUBLE) AS amount, txns FROM binned")
def flow_bins_long(spark, sf_dir):
    return flow.flow_bins(fx.peer_ledger(spark, sf_dir))


@query(f"{GRAPH} SELECT a, b, weight FROM aa")
def account_edges(spark, sf_dir):
    return flow.account_edges(hp(spark, sf_dir))


@query(f"""{LEDGER} SELECT a, b, w AS weight FROM (SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(sum(CASE WHEN src = dst THEN 2 * txn_count ELSE txn_count END) AS BIGINT) AS w FROM flow GROUP BY ALL) WHERE w >= 2""")
def account_edges_with_loops(spark, sf_dir):
    return flow.account_edges(flow.flow_agg(fx.peer_ledger(spark, sf_dir)), 2, True)


MONEY_SQL = """money AS (SELECT a.id, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, coalesce(in_amount, 0.0) AS in_amount, coalesce(out_amount, 0.0) AS out_amount,
    CAST(coalesce(in_txns, 0) AS BIGINT) AS in_txns, CAST(coalesce(out_txns, 0) AS BIGINT) AS out_txns FROM accounts a
  LEFT JOIN (SELECT src AS id, count(*) AS out_degree, CAST(sum(CAST(total_amount AS DECIMAL(18, 2))) AS DOUBLE) AS out_amount,
    sum(txn_count) AS out_txns FROM hp GROUP BY 1) o USING (id)
  LEFT JOIN (SELECT dst AS id, count(*) AS in_degree, CAST(sum(CAST(total_amount AS DECIMAL(18, 2))) AS DOUBLE) AS in_amount,
    sum(txn_count) AS in_txns FROM hp GROUP BY 1) i USING (id)),
money_flow AS (SELECT *, round(in_amount - out_amount, 2) AS net_flow, in_degree / (out_degree + 1) AS fan_in_ratio,
    out_degree / (in_degree + 1) AS fan_out_ratio,
  round(least(in_amount, out_amount) / (greatest(in_amount, out_amount) + 0.01), 6) AS pass_through_ratio FROM money)"""


@query(f"{GRAPH},\n{MONEY_SQL} SELECT * FROM money_flow")
def money_flow(spark, sf_dir):
    return flow.money_flow(fx.accounts(spark, sf_dir), hp(spark, sf_dir))


TEMPORAL_SQL = """ref AS (SELECT max(last_ts) AS ref FROM hp),
own AS (SELECT id, min(first_ts) AS t0, max(last_ts) AS t1, sum(n) AS n, max(lo) AS last_out, min(fi) AS first_in FROM (
  SELECT src AS id, first_ts, last_ts, txn_count AS n, last_ts AS lo, NULL AS fi FROM hp UNION ALL SELECT dst, first_ts, last_ts, 0, NULL,
    first_ts FROM hp) GROUP BY id HAVING sum(n) > 0),
line AS (SELECT src AS id, i, sum(amt) AS amt, sum(cnt) AS cnt FROM hp_bin GROUP BY ALL),
shape AS (SELECT id, count(*) AS nb, max(cnt) AS pc, CAST(max(amt) AS DOUBLE) AS pa, CAST(sum(amt) AS DOUBLE) AS sa,
    count(*) FILTER (cnt > 0) AS active,
  sum(cnt) FILTER (i < n // 2) AS early, sum(cnt) FILTER (i >= n // 2) AS late FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n
    FROM line) GROUP BY id),
timed AS (SELECT o.id, (ref - t1) / 86400.0 AS dsl, (ref - t0) / 86400.0 AS age, (t1 - t0) / 86400.0 AS span, n, active, pc / (n / nb) AS burst,
    CASE WHEN sa = 0 THEN 0 ELSE pa / sa END AS peak,
  CASE WHEN coalesce(late, 0) > 0 THEN coalesce(early, 0) / late WHEN coalesce(early, 0) > 0 THEN 999.0 ELSE 0 END AS el,
  CASE WHEN last_out IS NOT NULL AND first_in IS NOT NULL THEN (last_out - first_in) / 86400.0 ELSE 0 END AS lag FROM own o JOIN shape USING (id),
    ref),
temporal AS (SELECT a.id, round(coalesce(dsl, -1.0), 6) AS days_since_last_txn, round(coalesce(age, -1.0), 6) AS account_age_days,
    round(coalesce(span, 0.0), 6) AS activity_span_days,
  round(CASE WHEN n > 1 THEN CAST(span AS DOUBLE) / CAST(n - 1 AS DOUBLE) ELSE -1.0 END, 6) AS mean_inter_txn_days,
  round(CAST(coalesce(CASE WHEN span > 0 THEN CAST(n AS DOUBLE) / CAST(span AS DOUBLE) ELSE n END, 0) AS DOUBLE), 6) AS txn_per_active_day,
    CAST(coalesce(active, 0) AS BIGINT) AS active_bin_count,
  round(coalesce(burst, 0.0), 6) AS burst_ratio, round(CAST(coalesce(peak, 0) AS DOUBLE), 6) AS peak_bin_fraction, round(CAST(coalesce(peak,
    0) AS DOUBLE), 6) AS activity_concentration,
  round(CAST(coalesce(el, 0) AS DOUBLE), 6) AS early_late_ratio, round(CAST(coalesce(lag, 0) AS DOUBLE), 6) AS in_out_lag_days, CAST(coalesce(n,
    0) AS BIGINT) AS total_txns
  FROM accounts a LEFT JOIN timed t USING (id))"""


@query(f"{GRAPH},\n{TEMPORAL_SQL} SELECT * FROM temporal")
def temporal_features(spark, sf_dir):
    return flow.temporal_features(fx.accounts(spark, sf_dir), hp(spark, sf_dir))


@query(f"{GRAPH} SELECT max(num_bins) AS max_num_bins, max(num_bins) AS max_amount_bins, max(num_bins) AS max_count_bins FROM hp")
def max_bins(spark, sf_dir):
    return flow.max_bins(hp(spark, sf_dir))


@query(f"{GRAPH} SELECT max(last_ts) AS reference_epoch, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'no edges' END AS status FROM hp")
def reference_epoch(spark, sf_dir):
    return flow.reference_epoch(hp(spark, sf_dir))


IDENTITY_SQL = """held AS (SELECT DISTINCT account, kind, value FROM owners JOIN identities USING (party)),
peer AS (SELECT DISTINCT x.account AS id, x.kind, y.account AS other FROM held x JOIN held y ON x.kind = y.kind AND x.value = y.value
    AND x.account <> y.account),
identity AS (SELECT a.id, count(*) FILTER (kind = 'device') AS device_share_cnt, count(*) FILTER (kind = 'ip') AS ip_share_cnt,
    count(*) FILTER (kind = 'phone') AS phone_share_cnt,
  count(*) FILTER (kind = 'email') AS email_share_cnt FROM accounts a LEFT JOIN peer USING (id) GROUP BY a.id)"""


@query(f"{GRAPH},\n{IDENTITY_SQL} SELECT * FROM identity")
def identity_sharing(spark, sf_dir):
    return identity.identity_sharing(fx.accounts(spark, sf_dir), fx.owners(spark, sf_dir), fx.identities(spark, sf_dir))


_W = " ".join(f"WHEN '{k}' THEN {v}" for k, v in identity.WEIGHTS.items())
RESOLVE_SQL = with_("pii") + f""",
deg AS (SELECT kind, value, count(DISTINCT party) AS d FROM pii WHERE value IS NOT NULL GROUP BY ALL),
rare AS (SELECT DISTINCT party, kind, value FROM pii JOIN deg USING (kind, value) WHERE d > 1 AND d < 100),
cand AS (SELECT DISTINCT x.party AS a, y.party AS b FROM rare x JOIN rare y ON x.kind = y.kind AND x.value = y.value AND x.party < y.party),
often AS (SELECT DISTINCT party, kind, value, CAST(CASE kind {_W} END AS DECIMAL(4, 2)) AS w FROM pii JOIN deg USING (kind, value) WHERE d > 1
    AND d < 25000),
scored AS (SELECT a, b, sum(x.w) AS score FROM cand JOIN often x ON x.party = a JOIN often y ON y.party = b AND x.kind = y.kind AND x.value = y.value GROUP BY ALL)"""


@query(f"{RESOLVE_SQL} SELECT a, b FROM cand")
def party_candidates(spark, sf_dir):
    return identity.party_candidates(fx.party_pii(spark, sf_dir))


@query(f"{RESOLVE_SQL} SELECT a, b, CAST(score AS DOUBLE) AS score FROM scored WHERE score >= 0.7")
def party_matches(spark, sf_dir):
    return identity.party_matches(fx.party_pii(spark, sf_dir), 0.7)


@query(f"""{RESOLVE_SQL}, per AS (
  SELECT a, b, sum(x.w) AS s FROM cand JOIN often x ON x.party = a JOIN often y ON y.party = b AND x.kind = y.kind AND x.value = y.value
  GROUP BY a, b, CAST('0x' || substr(md5(x.kind || '|' || x.value), 1, 8) AS BIGINT) % {identity.BATCHES})
SELECT a, b, CAST(max(s) AS DOUBLE) AS score FROM per GROUP BY a, b HAVING max(s) >= 0.3""")
def party_matches_batched(spark, sf_dir):
    """Pairs whose shared values of one batch alone reach the threshold: no batch holds all scores at once."""
    return identity.party_matches(fx.party_pii(spark, sf_dir), 0.3, num_value_batches=identity.BATCHES)


@query(f"""{RESOLVE_SQL} SELECT CAST(max(score) AS DOUBLE) AS max_score, CAST(min(score) AS DOUBLE) AS min_score, round(CAST(sum(score) AS DOUBLE) / count(*), 6) AS avg_score, count(*) AS scored_pairs,
  (SELECT count(*) FROM cand) AS candidate_pairs FROM scored""")
def match_stats(spark, sf_dir):
    return identity.match_stats(fx.party_pii(spark, sf_dir))


@query(f"""{RESOLVE_SQL.replace('WITH pii', 'WITH RECURSIVE pii')},
link AS (SELECT a, b FROM scored WHERE score >= 0.7), both_ AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT c_custkey AS p, c_custkey AS q FROM customer UNION SELECT r.p, l.b FROM reach r JOIN both_ l ON r.q = l.a)
SELECT p AS party, min(q) AS entity FROM reach GROUP BY p""")
def resolved_entities(spark, sf_dir):
    pii = fx.party_pii(spark, sf_dir)
    return identity.resolved_entities(fx.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("party")), identity.party_matches(pii, 0.7))
