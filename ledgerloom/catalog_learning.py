"""Queries over training features, masks, splits and rankings; sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom import catalog_flow as cf
from ledgerloom import catalog_graph as cg
from ledgerloom.catalog_flow import GRAPH, hp, joined
from ledgerloom.operators import evaluate, export, features, flow, identity, masking
from ledgerloom.plans.fixpoint import scratch_dir
from ledgerloom.sources import fixtures as fx
from ledgerloom.sources import ledger as files
from ledgerloom.sources import results as replies
from ledgerloom.sources.fixtures import with_
from ledgerloom.sources.store import Store

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


NAMES = list(features.ACCOUNT_FEATURES)
_WCC = cg.WCC_SQL
_PR = cg.CONVERGED
_TRI = cg._triangle_sql(1000)[len(GRAPH):].lstrip(",\n")
_TRI = _TRI[_TRI.index("deg AS"):]
_TRI_CTES, _TRI_SELECT = _TRI.rsplit("\nSELECT", 1)
RAW_SQL = f"""{_WCC},
{_PR}, {_TRI_CTES}, tri AS (SELECT{_TRI_SELECT}),
{cf.MONEY_SQL}, {cf.TEMPORAL_SQL}, {cf.IDENTITY_SQL},
raw AS (SELECT a.id, coalesce(pagerank, 0) AS pagerank, com_size, (SELECT count(*) FROM both_ WHERE src = a.id) AS aa_degree, triangle_count,
    clustering_coef,
  in_degree, out_degree, in_amount, out_amount, in_txns AS in_txn_count, out_txns AS out_txn_count, fan_in_ratio, fan_out_ratio, pass_through_ratio,
    net_flow,
  activity_span_days, days_since_last_txn, account_age_days, mean_inter_txn_days, txn_per_active_day, burst_ratio, active_bin_count,
    activity_concentration, peak_bin_fraction, early_late_ratio, in_out_lag_days,
  device_share_cnt, ip_share_cnt, phone_share_cnt, email_share_cnt, CAST(a.id % 9 = 0 AS INT) AS is_external
  FROM accounts a JOIN label USING (id) JOIN sized USING (com_id) JOIN tri USING (id) JOIN money_flow USING (id) JOIN temporal USING (id) JOIN identity USING (id) LEFT JOIN pr p ON p.id = a.id)"""
_FORM = {"identity": "{0}", "log1p": "ln(1 + greatest({0}, 0))", "symlog": "CASE WHEN {0} >= 0 THEN ln(1 + {0}) ELSE -ln(1 - {0}) END", "clamp": "CASE WHEN {0} = -1 THEN 0 ELSE {0} END", "boolean": "CASE WHEN {0} <> 0 THEN 1 ELSE 0 END"}
FEATURE_SQL = RAW_SQL + ",\nfeat AS (SELECT id, " + ", ".join("CAST(" + _FORM[t].format(f"CAST({k} AS DOUBLE)") + f" AS DOUBLE) AS {k}" for k, t in features.ACCOUNT_FEATURES.items()) + " FROM raw)"


def raw(spark, sf_dir):
    """All attributes of every account, written back to one frame by joins on the id."""
    ids, flows = fx.accounts(spark, sf_dir), hp(spark, sf_dir)
    edges = flow.account_edges(flows)
    d = ids.join(cg._ranks(spark, sf_dir), "id", "left").na.fill(0.0, ["pagerank"])
    for more in (cg.wcc(spark, sf_dir), cg.graph.aa_degree(ids, edges), cg.graph.triangles(ids, edges), flow.money_flow(ids, flows), flow.temporal_features(ids, flows), identity.identity_sharing(ids, fx.owners(spark, sf_dir), fx.identities(spark, sf_dir))):
        d = d.join(more, "id")
    return d.withColumnsRenamed({"in_txns": "in_txn_count", "out_txns": "out_txn_count"}).withColumn("is_external", F.expr("cast(id % 9 = 0 as int)"))


def _features(spark, sf_dir):
    return features.account_features(raw(spark, sf_dir))


def rounded(d, names, places=5):
    return d.select("id", *((F.round(k, places) + F.lit(0.0)).alias(k) for k in names))


@query(FEATURE_SQL + " SELECT id, " + ", ".join(f"round({k}, 6) + 0.0 AS {k}" for k in NAMES) + " FROM feat")
def account_features(spark, sf_dir):
    return rounded(_features(spark, sf_dir), NAMES, 6)


@query(FEATURE_SQL + ", train AS (SELECT * FROM feat WHERE id % 5 <> 0) SELECT id, " + ", ".join(f"round((f.{k} - s.{k}_m) / greatest(s.{k}_s, 1e-6), 4) + 0.0 AS {k}" for k in NAMES) + " FROM feat f, (SELECT " + ", ".join(f"avg({k}) AS {k}_m, stddev_pop({k}) AS {k}_s" for k in NAMES) + " FROM train) s")
def normalised_features(spark, sf_dir):
    d = _features(spark, sf_dir)
    return rounded(features.normalise(d, features.fit_normaliser(d.where("id % 5 <> 0"), NAMES), NAMES), NAMES, 4)


@query(RAW_SQL + """ SELECT count(*) AS total_accounts, count(*) FILTER (days_since_last_txn = -1) AS no_last_txn, count(*) FILTER (account_age_days = -1) AS no_age, count(*) FILTER (mean_inter_txn_days = -1) AS no_gap,
  count(*) FILTER (days_since_last_txn = -1 AND in_txn_count + out_txn_count = 0) AS no_last_and_no_txns,
    count(*) FILTER (mean_inter_txn_days = -1 AND in_txn_count + out_txn_count = 1) AS no_gap_and_one_txn,
  count(*) FILTER (activity_span_days = 0) AS span_zero, count(*) FILTER (activity_span_days <> 0) AS span_nonzero, min(com_size) AS min_com_size, max(com_size) AS max_com_size FROM raw""")
def sentinel_counts(spark, sf_dir):
    return features.sentinel_counts(raw(spark, sf_dir))


_LABELS = ", target AS (SELECT id, is_mule AS label FROM mules), fm AS MATERIALIZED (SELECT * FROM feat), long AS (" + " UNION ALL ".join(f"SELECT id, label, '{k}' AS feature, {k} AS score FROM fm JOIN target USING (id)" for k in NAMES) + ")"


def _target(spark, sf_dir):
    return fx.mules(spark, sf_dir).withColumnRenamed("is_mule", "label")


def _rounded(spark, sf_dir):
    return rounded(_features(spark, sf_dir), NAMES, 6)


@query(FEATURE_SQL + _LABELS + """, r AS (SELECT feature, label, round(score, 6) AS score, count(*) OVER (PARTITION BY feature) AS N, sum(label) OVER (PARTITION BY feature) AS P,
  rank() OVER (PARTITION BY feature ORDER BY round(score, 6)) + (count(*) OVER (PARTITION BY feature, round(score, 6)) - 1) / 2.0 AS mid FROM long),
auc AS (SELECT feature, round((sum(mid) FILTER (label = 1) - max(P) * (max(P) + 1) / 2.0) / (max(P) * (max(N) - max(P))), 6) AS auc FROM r
    GROUP BY feature)
SELECT feature, CAST(auc AS DOUBLE) AS auc, CAST(round(greatest(auc, 1 - auc), 6) AS DOUBLE) AS best_auc FROM auc""")
def feature_auc(spark, sf_dir):
    return evaluate.feature_auc(_rounded(spark, sf_dir), _target(spark, sf_dir), NAMES)


@query(FEATURE_SQL + _LABELS + """ SELECT feature, CASE WHEN stddev_pop(score) < 1e-12 OR stddev_pop(label) < 1e-12 THEN 0 ELSE round(corr(score, label), 5) END AS r FROM (SELECT feature, label, round(score, 6) AS score FROM long) GROUP BY feature""")
def feature_corr(spark, sf_dir):
    return evaluate.feature_corr(_rounded(spark, sf_dir), _target(spark, sf_dir), NAMES)


_EDGE_SQL = GRAPH + """, ref AS (SELECT max(last_ts) AS ref FROM hp),
edge AS (SELECT src, dst, round(ln(1 + total_amount), 6) AS log_amount, round(ln(1 + txn_count), 6) AS log_txns,
    round((last_ts - first_ts) / 86400.0, 6) AS span_days, CAST((SELECT count(*) FROM hp_bin b WHERE b.src = hp.src AND b.dst = hp.dst
    AND b.cnt > 0) AS DOUBLE) AS active_bins,
  round(greatest((ref - last_ts) / 86400.0, 0), 6) AS recency_days, round(greatest((last_ts - first_ts) / 86400.0, 0), 6) AS duration_days, round(total_amount / txn_count, 6) AS amount_per_txn FROM hp, ref)"""
WIDTH = "(SELECT max(num_bins) FROM hp)"


def _edges(spark, sf_dir):
    flows = hp(spark, sf_dir)
    return features.edge_features(flows, flows.agg(F.max("last_ts")), flow.temporal_spec(flows)["bins"])


@query(_EDGE_SQL + f" SELECT *, round(active_bins / {WIDTH}, 6) AS active_fraction FROM edge")
def edge_features(spark, sf_dir):
    return _edges(spark, sf_dir).select("src", "dst", *(F.round(k, 6).alias(k) for k in ("log_amount", "log_txns", "span_days", "active_bins", "recency_days", "duration_days", "active_fraction", "amount_per_txn")))


@query(f"""{GRAPH}, want AS (SELECT src, dst, unnest(range(num_bins)) AS i FROM hp)
SELECT w.src, w.dst, CAST(w.i AS INT) AS bin, round(ln(1 + CAST(coalesce(amt, 0) AS DOUBLE)), 6) AS log_amount, CAST(coalesce(cnt, 0) AS DOUBLE) AS txns FROM want w LEFT JOIN hp_bin b ON w.src = b.src AND w.dst = b.dst AND w.i = b.i""")
def edge_bin_features(spark, sf_dir):
    d = _edges(spark, sf_dir).select("src", "dst", "bins", F.explode_outer(F.sequence(F.lit(0), F.expr("size(bins) div 2 - 1"))).alias("bin"))
    return d.select("src", "dst", "bin", F.round(F.get("bins", 2 * F.col("bin")), 6).alias("log_amount"), F.get("bins", 2 * F.col("bin") + 1).alias("txns"))


MASK_SQL = with_("ledger", "accounts", "owners", "mules", "rings") + """,
ends AS (SELECT src AS id, * FROM ring_ledger WHERE ring_id > 0 UNION ALL SELECT dst, * FROM ring_ledger WHERE ring_id > 0),
ring AS (SELECT id, ring_id FROM (SELECT id, ring_id, row_number() OVER (PARTITION BY id ORDER BY ts, src, dst, amount, ring_id) AS r
    FROM ends) WHERE r = 1),
held AS (SELECT m.id, is_mule, coalesce(ring_id, 0) AS ring_id FROM mules m LEFT JOIN ring USING (id)),
mring AS (SELECT ring_id, row_number() OVER (ORDER BY md5('1337|ring|' || ring_id), ring_id) AS r FROM (SELECT DISTINCT ring_id FROM held
    WHERE is_mule = 1 AND ring_id > 0)),
dark AS (SELECT ring_id FROM mring WHERE r <= (SELECT round_even(count(*) * 0.4, 0) FROM mring)),
dealt AS (SELECT id, row_number() OVER (ORDER BY md5('1337|mule|' || id), id) AS r FROM held WHERE is_mule = 1
    AND ring_id NOT IN (SELECT ring_id FROM dark)),
shown AS (SELECT id FROM dealt WHERE r <= (SELECT round_even(sum(is_mule) * 0.3, 0) FROM held)),
mask AS (SELECT id, is_mule, ring_id, CAST(id IN (SELECT id FROM shown) AS INT) AS pu_label, CASE WHEN is_mule = 0 THEN 0 WHEN id IN (SELECT id
    FROM shown) THEN 1 ELSE 2 END AS bucket,
  CAST(ring_id IN (SELECT ring_id FROM dark) AS INT) AS forced_test FROM held),
input AS (SELECT a.id, max(party) AS party, max(party // 2) AS entity FROM accounts a LEFT JOIN owners ON a.id = account GROUP BY a.id),
member AS (SELECT m.*, CASE WHEN entity >= 0 THEN 'E:' || entity WHEN party IS NOT NULL THEN 'P:' || party ELSE 'solo:' || id END AS group_key
    FROM mask m JOIN input USING (id)),
grp AS (SELECT group_key, max(forced_test) AS forced, max(pu_label) AS pos FROM member GROUP BY 1),
free AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY md5('1337|group|' || group_key), group_key) AS r,
    count(*) OVER (PARTITION BY pos) AS k FROM grp WHERE forced = 0),
quota AS (SELECT *, CASE WHEN pos = 0 THEN round_even(k * 0.2, 0) WHEN k = 1 THEN 0 WHEN k = 2 THEN 1 ELSE greatest(round_even(k * 0.2, 0),
    1) END AS nv, greatest(round_even(k * 0.15, 0), 1) AS t1, round_even(k * 0.15, 0) AS t0 FROM free),
placed AS (SELECT group_key, CASE WHEN r <= nv THEN 1 WHEN r <= nv + (CASE WHEN pos = 0 THEN t0 WHEN k <= 2 THEN 0 WHEN nv + t1 >= k
    THEN greatest(k - nv - 1, 1) ELSE t1 END) THEN 2 ELSE 0 END AS split FROM quota
  UNION ALL SELECT group_key, 2 FROM grp WHERE forced = 1),
split AS (SELECT id, group_key, split FROM member JOIN placed USING (group_key))"""


def _mask(spark, sf_dir):
    return masking.pu_mask(fx.mules(spark, sf_dir), masking.account_rings(fx.ring_ledger(spark, sf_dir)), 0.3, 0.4)


def _split(spark, sf_dir):
    inputs = masking.masking_inputs(fx.accounts(spark, sf_dir), fx.owners(spark, sf_dir), cg.entities(spark, sf_dir))
    members = _mask(spark, sf_dir).join(inputs.select("id", masking.group_key().alias("group_key")), "id")
    return masking.split_accounts(members.select("id", "group_key", "pu_label", "forced_test"))


@query(f"{MASK_SQL} SELECT id, party, entity FROM input")
def masking_inputs(spark, sf_dir):
    return masking.masking_inputs(fx.accounts(spark, sf_dir), fx.owners(spark, sf_dir), cg.entities(spark, sf_dir))


@query(f"{MASK_SQL} SELECT id, ring_id FROM ring")
def account_rings(spark, sf_dir):
    return masking.account_rings(fx.ring_ledger(spark, sf_dir))


@query(f"{MASK_SQL} SELECT * FROM mask")
def pu_mask(spark, sf_dir):
    return _mask(spark, sf_dir)


@query(f"{MASK_SQL} SELECT sum(is_mule) / count(*) AS prior FROM mask")
def class_prior(spark, sf_dir):
    return cg.sampling.prior_of(_mask(spark, sf_dir))


@query(f"{MASK_SQL} SELECT * FROM split")
def split_accounts(spark, sf_dir):
    return _split(spark, sf_dir)


_MASKED_GRAPH = f"{MASK_SQL},\n{fx.SQL['identities']},\n{GRAPH[GRAPH.index('bound AS'):].replace('placed', 'in_bin')}"


@query(f"{cg._khop_sql('SELECT id FROM split WHERE split <> 0', _MASKED_GRAPH)} SELECT * FROM sampled")
def khop_gated(spark, sf_dir):
    """Samples that reach no account of the validation and test splits."""
    kept_out = _split(spark, sf_dir).where(F.col("split") != masking.TRAIN).select("id")
    return cg._khop(spark, sf_dir, kept_out)


@query(f"{MASK_SQL} SELECT split, bucket, count(*) AS n, CAST(sum(is_mule) AS BIGINT) AS n_mules FROM mask JOIN split USING (id) GROUP BY ALL")
def split_summary(spark, sf_dir):
    return masking.split_summary(_mask(spark, sf_dir), _split(spark, sf_dir))


@query(f"{MASK_SQL} SELECT id FROM split WHERE split = 1")
def split_accounts_scan(spark, sf_dir):
    return masking.accounts_of(masking.flags(_split(spark, sf_dir)), "val")


SCORES_SQL = with_("scores") + """,
tot AS (SELECT count(*) AS N, CAST(sum(label) AS BIGINT) AS P FROM scores),
g AS (SELECT score, count(*) AS n, sum(label) AS pos FROM scores GROUP BY score),
down AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS n_to, sum(pos) OVER (ORDER BY score DESC) AS pos_to FROM g),
rank_ AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place, sum(label) OVER (ORDER BY score DESC, id) AS pos_to FROM scores)"""
KS_SQL = "ks(k) AS (VALUES (100), (250), (500), (1000)), hit AS (SELECT k, CAST(coalesce(max(pos_to), 0) AS BIGINT) AS tp FROM ks LEFT JOIN rank_ ON place <= k GROUP BY k)"


@query(f"""{SCORES_SQL} SELECT max(tot.N) AS n, max(P) AS n_pos, round(sum((pos / P) * (pos_to / n_to)), 6) AS average_precision,
  round((sum(pos * (tot.N - n_to + (n + 1) / 2.0)) - max(P) * (max(P) + 1) / 2.0) / (max(P) * (max(tot.N) - max(P))), 6) AS roc_auc FROM down, tot""".replace("max(tot.N)", "max(tot.n)").replace("tot.N", "tot.n").replace("count(*) AS N, CAST(sum(label)", "count(*) AS n, CAST(sum(label)").replace("(n + 1)", "(down.n + 1)"))
def ranking_metrics(spark, sf_dir):
    return evaluate.ranking_metrics(fx.scores(spark, sf_dir))


@query(f"{SCORES_SQL}, {KS_SQL} SELECT CAST(k AS BIGINT) AS k, round(tp / least(k, N), 6) AS precision FROM hit, tot")
def precision_at_k(spark, sf_dir):
    return evaluate.precision_at_k(fx.scores(spark, sf_dir))


@query(f"{SCORES_SQL}, {KS_SQL} SELECT CAST(k AS BIGINT) AS k, tp AS hits, round(tp / P, 6) AS recall, round(least(1.0, k / P), 6) AS ceiling, round((tp / P) / least(1.0, k / P), 6) AS normalised FROM hit, tot")
def hidden_recall(spark, sf_dir):
    return evaluate.hidden_recall(fx.scores(spark, sf_dir))


@query(f"""{SCORES_SQL}, ks AS (SELECT CAST(rate AS DOUBLE) AS rate, CAST(greatest(1, least(round_even(CAST(rate AS DOUBLE) * N, 0), N)) AS BIGINT) AS k FROM (VALUES (0.0005), (0.001), (0.005), (0.01), (0.02)) v(rate), tot)
SELECT rate AS alert_rate, k, CAST(max(pos_to) AS BIGINT) AS tp, round(max(pos_to) / P, 6) AS recall, round(max(pos_to) / k, 6) AS precision, round((max(pos_to) / k) / (P / N), 6) AS lift FROM ks JOIN rank_ ON place <= k, tot GROUP BY rate, k, P, N""")
def gains_table(spark, sf_dir):
    return evaluate.gains_table(fx.scores(spark, sf_dir))


@query(f"{SCORES_SQL} SELECT score AS threshold, round(pos_to / n_to, 6) AS precision, round(pos_to / P, 6) AS recall FROM down, tot")
def pr_curve(spark, sf_dir):
    return evaluate.pr_curve(fx.scores(spark, sf_dir))


@query(f"{SCORES_SQL} SELECT label, CAST(least(floor((score / 40000) * 40), 39) AS INT) AS bin, count(*) AS n FROM scores GROUP BY ALL")
def score_hist(spark, sf_dir):
    return evaluate.score_histogram(fx.scores(spark, sf_dir).withColumn("score", F.col("score") / 40000))


def _logits(spark, sf_dir):
    return fx.scores(spark, sf_dir).select(((F.col("score") - 2500) / 1000).alias("logit"), F.col("label").alias("target"), "label")


_LOGITS = SCORES_SQL + ", lg AS (SELECT (score - 2500) / 1000 AS logit, label FROM scores), risk AS (SELECT 0.3 * avg(1 / (1 + exp(logit))) FILTER (label = 1) AS p, avg(1 / (1 + exp(-logit))) FILTER (label = 0) - 0.3 * avg(1 / (1 + exp(-logit))) FILTER (label = 1) AS q FROM lg)"


@query(f"{_LOGITS} SELECT round(p, 6) AS positive_risk, round(q, 6) AS negative_risk, round(CASE WHEN q < 0 THEN -q ELSE p + q END, 6) AS loss, q < 0 AS corrected FROM risk")
def nnpu_loss(spark, sf_dir):
    return evaluate.nnpu_loss(_logits(spark, sf_dir), 0.3)


@query(f"""{_LOGITS}, c AS (SELECT count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, avg(logit) FILTER (label = 1) AS pm, avg(logit) FILTER (label = 0) AS nm, stddev_pop(logit) FILTER (label = 1) AS ps, stddev_pop(logit) FILTER (label = 0) AS ns FROM lg)
SELECT n_pos, n_neg, round(pm, 6) AS pos_mean, round(nm, 6) AS neg_mean, round(ps, 6) AS pos_std, round(ns, 6) AS neg_std, round(pm - nm, 6) AS gap, CASE WHEN abs(pm - nm) < 0.05 THEN 'collapse' WHEN pm < nm THEN 'inversion' ELSE 'ok' END AS verdict FROM c""")
def class_logits(spark, sf_dir):
    return evaluate.class_logits(_logits(spark, sf_dir))


@query(f"""{cf.LEDGER} SELECT CAST(src AS VARCHAR) AS from_id, CAST(dst AS VARCHAR) AS to_id, printf('%.2f', total_amount) AS total_amount, txn_count, first_ts AS first_txn, last_ts AS last_txn,
  array_to_string(list_transform(range(num_bins), lambda i: printf('%.2f', CAST(coalesce(ma[CAST(i AS INT)], 0) AS DOUBLE))), ';') AS amount_bins, array_to_string(list_transform(range(num_bins), lambda i: CAST(coalesce(mc[CAST(i AS INT)], 0) AS VARCHAR)), ';') AS count_bins FROM flow""")
def csv_roundtrip(spark, sf_dir):
    """Flow edges written as the exchange CSV into shared scratch storage and loaded again."""
    at = f"{scratch_dir(spark)}/flow-csv-{uuid.uuid4().hex}"
    export.flow_csv_lines(flow.flow_agg(fx.peer_ledger(spark, sf_dir))).write.csv(at, header=True)
    d = files.read_flow_edges(spark, at)
    return d.select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"), F.format_string("%.2f", "total_amount").alias("total_amount"), "txn_count", F.col("first_ts").alias("first_txn"), F.col("last_ts").alias("last_txn"),
                    joined("amount_bins").alias("amount_bins"), F.array_join(F.transform("count_bins", lambda x: x.cast("string")), ";").alias("count_bins"))


@query("SELECT event_id, CAST(len(string_split(p, ';')) AS INT) AS n, list_sum(list_transform(string_split(p, ';'), lambda x: CAST(x AS DOUBLE))) AS total FROM (SELECT event_id, concat(CAST(event_id % 7 AS VARCHAR), ';', CAST(user_id AS VARCHAR), ';0.5') AS p FROM events)")
def list_split(spark, sf_dir):
    d = fx.read(spark, sf_dir, "events").select("event_id", F.concat_ws(";", (F.col("event_id") % 7).cast("string"), F.col("user_id").cast("string"), F.lit("0.5")).alias("p"))
    v = export.split_list(F.col("p"))
    return d.select("event_id", F.size(v).alias("n"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS flagged FROM events")
def conditional_load(spark, sf_dir):
    d = fx.read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "True").otherwise("False").alias("flagged_device"))
    return d.select("event_id", export.flag(F.col("flagged_device")).alias("flagged"))


@query(f"""{with_("accounts")}, up AS (SELECT id, id % 2 AS is_external, '' AS category FROM accounts UNION ALL SELECT id, 0, 'shop' FROM accounts WHERE id % 3 = 0 UNION ALL SELECT id + 100000, 0, 'bank' FROM accounts WHERE id % 5 = 0)
SELECT id, CAST(max(is_external) AS INT) AS is_external, max(category) AS category FROM up GROUP BY id""")
def vertex_upsert(spark, sf_dir):
    """Accounts from three sources become one vertex each; a default never hides a value."""
    a = fx.accounts(spark, sf_dir)
    own = a.select("id", F.expr("cast(id % 2 as int)").alias("is_external"))
    shops = a.where("id % 3 = 0").select("id", F.lit("shop").alias("category"))
    banks = a.where("id % 5 = 0").select((F.col("id") + 100000).alias("id"), F.lit("bank").alias("category"))
    return files.upsert([own, shops, banks], {"is_external": 0, "category": ""})


@query(f"""{SCORES_SQL}, ks AS (SELECT CAST(rate AS DOUBLE) AS rate, CAST(greatest(1, least(round_even(CAST(rate AS DOUBLE) * N, 0), N)) AS BIGINT) AS k FROM (VALUES (0.0005), (0.001), (0.005), (0.01), (0.02)) v(rate), tot),
gain AS (SELECT rate AS alert_rate, k, CAST(max(pos_to) AS BIGINT) AS tp, round(max(pos_to) / P, 6) AS recall, round(max(pos_to) / k,
    6) AS precision, round((max(pos_to) / k) / (P / N), 6) AS lift FROM ks JOIN rank_ ON place <= k, tot GROUP BY rate, k, P, N),
head AS (SELECT max(tot.N) AS n, max(P) AS n_pos, round(sum((pos / P) * (pos_to / n_to)), 6) AS average_precision,
  round((sum(pos * (tot.N - n_to + (down.n + 1) / 2.0)) - max(P) * (max(P) + 1) / 2.0) / (max(P) * (max(tot.N) - max(P))), 6) AS roc_auc FROM down,
    tot)
SELECT gain.*, head.*, round(n_pos / n, 6) AS base_rate, precision >= 0.45 AS beats_analyst FROM gain, head""")
def summary_report(spark, sf_dir):
    return evaluate.summary_report(fx.scores(spark, sf_dir))


@query(FEATURE_SQL + f", {cg.BATCH_SQL[cg.BATCH_SQL.index('pos AS'):]} SELECT batch_id, id, slot, " + ", ".join(f"round({k}, 6) + 0.0 AS {k}" for k in NAMES) + " FROM seeds JOIN feat USING (id)")
def batch_features(spark, sf_dir):
    """Features fetched for the accounts of every batch; one that has none is an error."""
    want = cg.seeds(spark, sf_dir).groupBy("batch_id", "id").agg(F.min("slot").alias("slot"))
    d = features.aligned(want, _features(spark, sf_dir), ["id"])
    return d.select("batch_id", "id", "slot", *((F.round(k, 6) + F.lit(0.0)).alias(k) for k in NAMES))


@query(f"""{cg._khop_sql()}, ref AS (SELECT max(last_ts) AS ref FROM hp) SELECT batch_id, src, dst, round(ln(1 + total_amount), 6) AS log_amount, round(greatest((ref - last_ts) / 86400.0, 0), 6) AS recency_days
FROM sampled JOIN hp ON e_type = 'HAS_PAID' AND src = from_id AND dst = to_id, ref""")
def batch_edge_features(spark, sf_dir):
    """One feature row for each sampled payment edge of every batch; one that has none is an error."""
    want = cg.khop_edges(spark, sf_dir).where("e_type = 'HAS_PAID'").select("batch_id", F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    d = features.aligned(want, _edges(spark, sf_dir), ["src", "dst"])
    return d.select("batch_id", "src", "dst", F.round("log_amount", 6).alias("log_amount"), F.round("recency_days", 6).alias("recency_days"))


@query(f"{MASK_SQL} SELECT id, is_mule, ring_id, pu_label, bucket, forced_test FROM mask")
def answer_key(spark, sf_dir):
    """The masks written as an artifact named by seed and prevalence, its summary beside it, and read by that name."""
    at, m = f"{scratch_dir(spark)}/artifacts-{uuid.uuid4().hex}", _mask(spark, sf_dir)
    export.write_masks(m, masking.split_summary(m, _split(spark, sf_dir)), at, 1337, 0.3)
    return export.read_answer_key(spark, at, 1337, 0.3)


#: As many again are revealed; who is dark stays as it was.
_AGAIN = "shown2 AS (SELECT id FROM dealt WHERE r <= (SELECT round_even(sum(is_mule) * 0.6, 0) FROM held))"


@query(f"""{MASK_SQL}, {_AGAIN}
SELECT id, CAST(id % 9 = 0 AS INT) AS is_external, CAST(split = 0 AS INT) AS is_train, CAST(split = 1 AS INT) AS is_val,
    CAST(split = 2 AS INT) AS is_test,
  CAST(id IN (SELECT id FROM shown2) AS INT) AS pu_label FROM split""")
def written_back(spark, sf_dir):
    """Accounts stored, split flags and labels merged into them, then the labels of another mask, and read again."""
    store = Store(spark, f"{scratch_dir(spark)}/accounts-{uuid.uuid4().hex}")
    store.create(fx.accounts(spark, sf_dir).withColumn("is_external", F.expr("cast(id % 9 = 0 as int)")), buckets=8)
    masking.write_back(store, _mask(spark, sf_dir), _split(spark, sf_dir))
    more = masking.pu_mask(fx.mules(spark, sf_dir), masking.account_rings(fx.ring_ledger(spark, sf_dir)), 0.6, 0.4)
    store.upsert(more.select("id", "pu_label"))
    return store.read().select("id", "is_external", "is_train", "is_val", "is_test", "pu_label")


_KEY_KS = (5, 10, 25, 50, 100, 1000)


@query(f"""{MASK_SQL},
{GRAPH[GRAPH.index("bound AS"):].replace("placed", "in_bin")},
{cf.MONEY_SQL},
ranking AS (SELECT m.id, CAST(in_degree * out_degree AS DOUBLE) AS score, is_mule AS label, bucket, forced_test FROM mask m
    JOIN money_flow USING (id)),
tot AS (SELECT count(*) AS n, sum(label) AS p, count(*) FILTER (bucket = 1) AS rev, count(*) FILTER (bucket = 2) AS hid,
    count(*) FILTER (forced_test = 1) AS drk FROM ranking),
place AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM ranking),
hit AS (SELECT k, sum(label) AS th, count(*) FILTER (bucket = 1) AS rh, count(*) FILTER (bucket = 2) AS hh, count(*) FILTER (forced_test = 1) AS dh,
    count(*) AS seen
  FROM (VALUES {", ".join(f"({k})" for k in _KEY_KS)}) v(k) JOIN place ON r <= k GROUP BY k),
g AS (SELECT score, count(*) AS c, sum(label) AS pos FROM ranking GROUP BY score),
down AS (SELECT *, sum(c) OVER (ORDER BY score DESC) AS c_to, sum(pos) OVER (ORDER BY score DESC) AS pos_to FROM g),
head AS (SELECT round(sum((pos / p) * (pos_to / c_to)), 6) AS ap,
    round((sum(pos * (n - c_to + (c + 1) / 2.0)) - max(p) * (max(p) + 1) / 2.0) / (max(p) * (max(n) - max(p))), 6) AS auc FROM down, tot)
SELECT CAST(k AS BIGINT) AS k, n AS accounts, p AS true_positives, rev AS revealed_positives, hid AS hidden_positives, drk AS dark_accounts,
    th AS true_hits, rh AS revealed_hits,
  hh AS hidden_hits, dh AS dark_hits, round(coalesce(hh / nullif(hid, 0), 0), 6) AS hidden_recall, round(least(1.0, coalesce(k / nullif(hid, 0),
    1.0)), 6) AS ceiling,
  round(coalesce((hh / nullif(hid, 0)) / least(1.0, k / hid), 0), 6) AS normalised, round(th / seen, 6) AS precision, ap AS average_precision,
    auc AS roc_auc, k = 10 AS is_primary
FROM hit, tot, head""")
def evaluate_hidden(spark, sf_dir):
    """A ranking of accounts against the answer key that a run of the masks stored."""
    key = answer_key(spark, sf_dir).select("id", F.col("is_mule").alias("true_label"), "bucket", F.col("forced_test").alias("dark"))
    scores = cf.money_flow(spark, sf_dir).select("id", (F.col("in_degree") * F.col("out_degree")).cast("double").alias("score"))
    return evaluate.evaluate_hidden(scores, key, _KEY_KS, 10)


@query(f"{cf.LEDGER} SELECT src || ',' || dst || ',' || txn_count AS line FROM flow")
def text_sink(spark, sf_dir):
    """Lines of text written to shared scratch storage and read again."""
    at = f"{scratch_dir(spark)}/text-{uuid.uuid4().hex}"
    export.write_lines(flow.flow_agg(fx.peer_ledger(spark, sf_dir)).select(F.concat_ws(",", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("txn_count").cast("string")).alias("line")), at)
    return spark.read.text(at).withColumnRenamed("value", "line")


@query(f"{GRAPH} SELECT CAST(src AS VARCHAR) AS from_id, CAST(dst AS VARCHAR) AS to_id, txn_count FROM hp")
def parsed_edges(spark, sf_dir):
    """Edges that came as a JSON result: one document with a block of edges for each source."""
    block = hp(spark, sf_dir).groupBy("src").agg(F.collect_list(F.struct(F.col("src").cast("string").alias("from_id"), F.col("dst").cast("string").alias("to_id"), F.col("txn_count").cast("double").alias("txn_count"))).alias("edges"))
    return files.parse_edges(block.select(F.to_json(F.struct("edges")).alias("json")), {"txn_count": "long"})


#: A run for each supplier and line number, an epoch for each month: what part of the largest orders was sold.
_EPOCHS = """epochs AS (SELECT l_suppkey * 10 + l_linenumber AS run, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS epoch,
  sum(l_quantity) / (50.0 * count(*)) AS primary_, sum(l_linenumber) / (10.0 * count(*)) + sum(l_quantity) / (100.0 * count(*)) AS second FROM lineitem GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_EPOCHS},
placed AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i FROM epochs),
state AS (SELECT DISTINCT run, CAST(0 AS BIGINT) AS i, CAST('-inf' AS DOUBLE) AS best, CAST('-inf' AS DOUBLE) AS sec, CAST('-inf' AS DOUBLE) AS mark,
    0 AS stale, CAST(NULL AS BIGINT) AS ep, CAST(NULL AS BIGINT) AS stop FROM epochs
  UNION ALL SELECT run, i, CASE WHEN wins THEN greatest(p, best) ELSE best END, CASE WHEN wins THEN greatest(second, sec) ELSE sec END,
    CASE WHEN rose THEN p ELSE mark END, CASE WHEN rose THEN 0 ELSE stale + 1 END,
    CASE WHEN wins THEN epoch ELSE ep END, CASE WHEN NOT rose AND stale + 1 >= 3 THEN epoch END
  FROM (SELECT s.run, p.i, s.best, s.sec, s.mark, s.stale, s.ep, p.epoch, p.primary_ AS p, p.second,
    p.primary_ > best + 0.05 OR (p.primary_ >= best - 0.05 AND p.second > sec) AS wins, p.primary_ > mark + 0.01 AS rose
    FROM state s JOIN placed p ON p.run = s.run AND p.i = s.i + 1 WHERE s.stop IS NULL)),
ended AS (SELECT * FROM state QUALIFY row_number() OVER (PARTITION BY run ORDER BY i DESC) = 1)
SELECT run, ep AS best_epoch, round(best, 6) AS best, round(sec, 6) AS second, stop AS stop_epoch, CAST(i AS INT) AS seen FROM ended""")
def model_selection(spark, sf_dir):
    """The best epoch and the one that ends training, of every run in a table of epochs."""
    d = fx.read(spark, sf_dir, "lineitem")
    run, epoch = (F.col("l_suppkey") * 10 + F.col("l_linenumber")), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long")
    q, n = F.sum("l_quantity"), F.count(F.lit(1))
    d = d.groupBy(run.alias("run"), epoch.alias("epoch")).agg((q / (50.0 * n)).alias("primary"), (F.sum("l_linenumber") / (10.0 * n) + q / (100.0 * n)).alias("second"))
    d = evaluate.select_epochs(d, 3, 0.01, 0.05)
    return d.select("run", "best_epoch", F.round("best", 6).alias("best"), F.round("second", 6).alias("second"), "stop_epoch", "seen")


@query(f"""{GRAPH},
{cg.BATCH_SQL}, mine AS (SELECT DISTINCT batch_id, id FROM seeds)
SELECT batch_id, 'Account' AS kind, CAST(id AS VARCHAR) AS a, '' AS b FROM mine
UNION ALL SELECT DISTINCT x.batch_id, 'HAS_PAID', CAST(src AS VARCHAR), CAST(dst AS VARCHAR) FROM hp JOIN mine x ON x.id = src JOIN mine y ON y.id = dst AND x.batch_id = y.batch_id""")
def parsed_sample(spark, sf_dir):
    """A sampler's results, one JSON list of blocks for each batch, as nodes and edges."""
    mine = cg.seeds(spark, sf_dir).select("batch_id", "id").distinct()
    pairs = cg.sampling.inbatch_edges(hp(spark, sf_dir), mine).select("batch_id", "src", "dst").distinct()
    ids = mine.groupBy("batch_id").agg(F.collect_list(F.col("id").cast("string")).alias("account_ids"))
    text = lambda c: F.col(c).cast("string")
    edge = F.struct(text("src").alias("from_id"), text("dst").alias("to_id"), F.lit("HAS_PAID").alias("e_type"))
    edges = pairs.groupBy("batch_id").agg(F.collect_list(edge).alias("edges"))
    blocks = [F.to_json(F.struct("account_ids")), F.lit('{"party_ids": []}'), F.to_json(F.struct("edges"))]
    results = ids.join(edges, "batch_id", "left").select("batch_id", F.concat(F.lit("["), F.concat_ws(",", *blocks), F.lit("]")).alias("json"))
    nodes, found = replies.sampled(results, keys=("batch_id",))
    return nodes.select("batch_id", F.col("node_type").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b")).unionAll(
        found.select("batch_id", F.col("e_type").alias("kind"), F.col("from_id").alias("a"), F.col("to_id").alias("b")))


def _reply(rows, name: str, item, per: int = 64):
    """(part, json): results {name: [item]} of some rows each."""
    d = rows.groupBy((F.crc32(F.col("id").cast("string").cast("binary")) % per).alias("part")).agg(F.collect_list(item).alias("items"))
    return d.select("part", F.concat(F.lit(f'[{{"{name}": '), F.to_json("items"), F.lit("}]")).alias("json"))


@query(f"{GRAPH},\n{cf.MONEY_SQL} SELECT CAST(id AS VARCHAR) AS id, in_degree, out_degree, round(in_amount, 2) AS in_amount FROM money_flow")
def parsed_accounts(spark, sf_dir):
    """Attributes fetched for accounts, nested under their ids."""
    d = cf.money_flow(spark, sf_dir).select("id", "in_degree", "out_degree", F.round("in_amount", 2).alias("in_amount"))
    own = F.struct(F.col("in_degree").cast("double").alias("in_degree"), "out_degree", "in_amount")  # whole numbers come as 3.0 too
    results = _reply(d, "Accounts", F.struct(F.col("id").cast("string").alias("v_id"), F.lit("Account").alias("v_type"), own.alias("attributes")))
    return replies.fetched_accounts(results, {"in_degree": "long", "out_degree": "long", "in_amount": "double"})


@query(f"{GRAPH} SELECT CAST(src AS VARCHAR) AS from_id, CAST(dst AS VARCHAR) AS to_id, txn_count, round(total_amount, 2) AS total_amount FROM hp")
def parsed_flows(spark, sf_dir):
    """Payment edges fetched, nested under the accounts that pay."""
    d = hp(spark, sf_dir).withColumn("id", F.col("src"))
    own = F.struct("txn_count", F.round("total_amount", 2).alias("total_amount")).alias("attributes")
    edge = F.struct(F.col("src").cast("string").alias("from_id"), F.col("dst").cast("string").alias("to_id"), own)
    d = d.groupBy("id").agg(F.struct(F.collect_list(edge).alias("out_edges")).alias("attributes"))
    results = _reply(d, "Collected", F.struct(F.col("id").cast("string").alias("v_id"), "attributes"))
    return replies.fetched_edges(results, {"txn_count": "long", "total_amount": "double"})


@query(f"{MASK_SQL} SELECT CAST(id AS VARCHAR) AS id, pu_label FROM mask")
def parsed_seeds(spark, sf_dir):
    """Accounts of a split with their labels, as a query returns them."""
    own = F.struct(F.col("id").cast("string").alias("account_id"), "pu_label")
    return replies.seeds(_reply(_mask(spark, sf_dir), "result", F.struct(own.alias("attributes"))))
