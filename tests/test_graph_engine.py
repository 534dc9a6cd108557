"""Micro graphs with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evaluate, export, features, flow, graph, identity, masking, sampling
from ledgerloom.plans import fixpoint
from ledgerloom.sources import ledger as files

DAY = 86400
T0 = 1735689600


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def edges(spark, rows):
    return spark.createDataFrame(rows, "a long, b long, weight long")


def ledger(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, amount double, ts long")


def rows(df, key="id"):
    return {r[key]: r for r in df.collect()}


def test_two_components(spark):
    e = edges(spark, [(1, 2, 2), (2, 3, 2), (4, 5, 2), (5, 6, 1)])
    got = rows(graph.wcc(ids(spark, range(1, 7)), e))
    assert {i: r.com_id for i, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6} and got[6].com_size == 1 and got[1].com_size == 3


def test_triangle_and_hub_cap(spark):
    e = edges(spark, [(1, 2, 1), (2, 3, 1), (1, 3, 1), (3, 4, 1)])
    got = rows(graph.triangles(ids(spark, range(1, 6)), e))
    assert [got[i].triangle_count for i in range(1, 6)] == [1, 1, 1, 0, 0]
    assert [round(got[i].clustering_coef, 6) for i in range(1, 5)] == [1, 1, 0.333333, 0]
    hub = edges(spark, [(1, 2, 1), (1, 9, 1), (2, 9, 1)] + [(k, 9, 1) for k in range(3, 9)])
    assert {r.triangle_count for r in graph.triangles(ids(spark, range(1, 10)), hub, 3).collect()} == {0}


def test_pagerank_keeps_its_sum(spark):
    e = edges(spark, [(1, 2, 3), (2, 3, 1), (3, 4, 2), (1, 4, 5)])
    got = graph.pagerank(e, max_change=1e-9, max_iter=60).collect()
    assert math.isclose(sum(r.pagerank for r in got), 4, abs_tol=1e-6)


def test_flow_edges_and_bins(spark):
    d = ledger(spark, [(1, 2, 5.0, T0), (1, 2, 2.5, T0 + 15 * DAY), (2, 2, 1.0, T0 + DAY)])
    r = rows(flow.flow_agg(d).where("dst = 2"), "src")
    assert r[1].amount_bins == [5.0, 2.5] and r[1].count_bins == [1, 1] and r[1].span_days == 15 and r[2].amount_bins == [1.0, 0.0]
    assert [tuple(x) for x in flow.account_edges(flow.flow_agg(d), keep_self_loops=True).orderBy("a").collect()] == [(1, 2, 2), (2, 2, 2)]
    assert flow.flow_agg(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        flow.flow_agg(d, 0)
    assert flow.temporal_spec(flow.has_paid(d)) == {"bins": 2, "edge_dim": 12}
    with pytest.raises(ValueError):
        flow.temporal_spec(flow.has_paid(d).limit(0))


def test_temporal_rules(spark):
    d = ledger(spark, [(1, 2, 5.0, T0), (2, 3, 4.0, T0 + 10 * DAY), (3, 9, 1.0, T0), (3, 9, 1.0, T0 + 30 * DAY)])
    got = rows(flow.temporal_features(ids(spark, [1, 2, 3, 9, 10]), flow.has_paid(d)))
    assert got[2].in_out_lag_days == 10 and got[1].mean_inter_txn_days == -1 and got[1].txn_per_active_day == 1 and got[1].activity_span_days == 0
    assert got[1].early_late_ratio == 999 and got[9].days_since_last_txn == -1 and got[9].total_txns == 0 and got[10].account_age_days == -1
    m = rows(flow.money_flow(ids(spark, [1, 2, 3, 9, 10]), flow.has_paid(d)))
    assert m[2].in_degree == 1 and m[2].out_amount == 4 and m[2].net_flow == 1 and m[10].in_txns == 0


def test_identity_and_entities(spark):
    own = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, 12)], "account long, party long")
    ident = spark.createDataFrame([(10, "device", "d"), (11, "device", "d"), (12, "ip", "x")], "party long, kind string, value string")
    got = rows(identity.identity_sharing(ids(spark, [1, 2, 3, 4]), own, ident))
    assert [got[i].device_share_cnt for i in (1, 2, 3, 4)] == [2, 2, 2, 0] and got[4].ip_share_cnt == 0
    pii = spark.createDataFrame([(1, "email", "e"), (2, "email", "e"), (1, "phone", "p"), (2, "phone", "p"), (3, "city", "c"), (2, "city", "c")], "party long, kind string, value string")
    assert [tuple(r) for r in identity.party_matches(pii).collect()] == [(1, 2, 1.0)]
    parties = pii.select("party").distinct()
    assert {r.party: r.entity for r in identity.resolved_entities(parties, identity.party_matches(pii)).collect()} == {1: 1, 2: 1, 3: 3}


def test_edge_and_account_features(spark):
    f = spark.createDataFrame([(1, 2, 22.99, 1, T0, T0 + 14 * DAY, 14.0, [22.99, 0.0], [1, 0])], "src long, dst long, total_amount double, txn_count long, first_ts long, last_ts long, span_days double, amount_bins array<double>, count_bins array<long>")
    r = features.edge_features(f, T0 + 180 * DAY, 13).first()
    assert math.isclose(r.log_amount, math.log1p(22.99)) and r.recency_days == 166 and r.duration_days == 14 and r.active_bins == 1 and len(r.bins) == 26 and math.isclose(r.active_fraction, 1 / 13)
    with pytest.warns(UserWarning):
        features.edge_features(f, T0, 1, check_width=True)
    with pytest.raises(ValueError):
        features.edge_features(f, T0, 0)
    a = spark.createDataFrame([(1, *[-1.0] * len(features.ACCOUNT_FEATURES)), (2, *[0.0] * len(features.ACCOUNT_FEATURES)), (3, *[None] * len(features.ACCOUNT_FEATURES))], "id long, " + ", ".join(f"{k} double" for k in features.ACCOUNT_FEATURES))
    got = rows(features.account_features(a))
    assert got[1].days_since_last_txn == 0 and got[1].in_degree == 0 and math.isclose(got[1].net_flow, -math.log(2)) and got[1].is_external == 1 and set(list(got[3])[1:]) == {0.0}
    with pytest.raises(ValueError):
        features.account_features(a.drop("pagerank"))


def test_seeds_first_and_local_edges(spark):
    nodes = spark.createDataFrame([("Account", x) for x in (1, 2, 3, 4, 5)], "node_type string, id long")
    index = sampling.local_index(nodes, ids(spark, [4, 2]))
    assert {r.id: r.local_id for r in index.collect()} == {2: 0, 4: 1, 1: 2, 3: 3, 5: 4}
    e = spark.createDataFrame([(2, 3, "HAS_PAID"), (1, 4, "HAS_PAID")], "from_id long, to_id long, e_type string")
    assert {tuple(r)[1:] for r in sampling.local_edges(e, index).collect()} == {(0, 3), (2, 1)}
    with pytest.raises(Exception):
        sampling.local_edges(spark.createDataFrame([(2, 99, "HAS_PAID")], "from_id long, to_id long, e_type string"), index).collect()
    with pytest.raises(ValueError):
        sampling.check_fanouts({**sampling.FANOUTS, "HAS_PAID": (5, 9)})


def test_batches_keep_seed_order(spark):
    nodes = spark.createDataFrame([(b, "Account", x) for b in (0, 1) for x in (1, 2, 3, 4)] + [(0, "Party", 9)], "batch_id long, node_type string, id long")
    seeds = spark.createDataFrame([(0, 4, 0), (0, 2, 1), (0, 4, 2), (1, 3, 0), (1, 77, 1)], "batch_id long, id long, slot int")
    got = {(r.batch_id, r.node_type, r.id): r.local_id for r in sampling.local_index(nodes, seeds).collect()}
    assert got == {(0, "Account", 4): 0, (0, "Account", 2): 1, (0, "Account", 1): 2, (0, "Account", 3): 3, (1, "Account", 3): 0, (1, "Account", 1): 1, (1, "Account", 2): 2, (1, "Account", 4): 3, (0, "Party", 9): 0}
    with pytest.raises(Exception, match="duplicate node id"):
        sampling.local_index(nodes.unionAll(nodes.limit(1)), seeds).collect()
    with pytest.raises(Exception, match="unknown edge type"):
        sampling.local_edges(spark.createDataFrame([(0, 1, 2, "NEW")], "batch_id long, from_id long, to_id long, e_type string"), sampling.local_index(nodes, seeds)).collect()
    flows = spark.createDataFrame([(1, 2), (1, 3), (3, 3)], "src long, dst long")
    both = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (1, 3)], "batch_id long, id long")
    assert sorted(map(tuple, sampling.inbatch_edges(flows, both).collect())) == [(0, 1, 2), (1, 3, 3)]


def test_batches_without_positives_priors_and_samples(spark):
    labels = spark.createDataFrame([(i, int(i < 3)) for i in range(40)], "id long, pu_label int")
    with pytest.raises(ValueError):
        sampling.epoch_batches(labels.where("pu_label = 0"))
    some = sampling.validation_sample(labels, 5).collect()
    assert sum(r.pu_label for r in some) == 3 and len(some) == 8
    assert sampling.class_prior(40, 3) == 3 / 40
    for bad in (0, 40):
        with pytest.raises(ValueError):
            sampling.class_prior(40, bad)


def test_shared_identities_equal_brute_force(spark):
    import random

    r = random.Random(6)
    own = [(a, a) for a in range(40)]
    held = sorted({(p, k, f"{k}{r.randrange(6)}") for p in range(40) for k in ("device", "ip") for _ in range(r.randint(0, 5))})
    want = {a: {k: len({b for b in range(40) if b != a and {v for p, q, v in held if p == a and q == k} & {v for p, q, v in held if p == b and q == k}}) for k in ("device", "ip")} for a in range(40)}
    frames = ids(spark, range(40)), spark.createDataFrame(own, "account long, party long"), spark.createDataFrame(held, "party long, kind string, value string")
    for few in (100, 4, 0):  # by pairs alone, by both, by bitmaps alone
        got = rows(identity.identity_sharing(*frames, few=few))
        assert {i: {"device": x.device_share_cnt, "ip": x.ip_share_cnt} for i, x in got.items()} == want


@pytest.mark.parametrize("few", [2, 50])
def test_accounts_with_many_values(spark, few):
    """Accounts with 11 and 200 values of a kind, and a value that a third of all hold."""
    import random

    r = random.Random(2)
    values = {a: {r.randrange(2000) for _ in range(r.choice([0, 1, 2, 11, 200] if a < 40 else [0, 1, 2]))} | ({-1} if a % 3 == 0 else set()) for a in range(400)}
    held = [(a, "email", str(v)) for a, own in values.items() for v in own]
    want = {a: len({b for b in values if b != a and values[a] & values[b]}) for a in values}
    own = spark.createDataFrame([(a, a) for a in values], "account long, party long")
    got = identity.identity_sharing(ids(spark, list(values)), own, spark.createDataFrame(held, "party long, kind string, value string"), few)
    assert {x.id: x.email_share_cnt for x in got.collect()} == want


def test_embedding_regions_and_scope(spark):
    e = edges(spark, [(1, 2, 1), (2, 3, 1), (8, 9, 1)])
    typed = e.withColumn("e_type", F.when(F.col("a") == 1, "x").otherwise("y"))
    plain = {(r.id, r.i): r.value for r in graph.fastrp(e, 4).collect()}
    assert plain == {(r.id, r.i): r.value for r in graph.fastrp(typed, 4, regions={"default": (0, 4, 1.0)}).collect()}
    got = {(r.id, r.i): r.value for r in graph.fastrp(typed, 4, regions={"x": (0, 2, 1.0), "y": (2, 2, 3.0)}).collect()}
    assert all(got[i, k] == 0 for i in (8, 9) for k in (0, 1)) and {k[0] for k in got} == {1, 2, 3, 8, 9}
    assert {r.id for r in graph.fastrp(e, 4, members=ids(spark, [8, 9])).collect()} == {8, 9}
    with pytest.raises(ValueError):
        graph.fastrp(typed, 4, regions={"x": (2, 4, 1.0)})


def test_large_components_get_their_size(spark, monkeypatch):
    monkeypatch.setattr(graph, "LARGE", 3)
    got = rows(graph.wcc(ids(spark, range(1, 9)), edges(spark, [(1, 2, 2), (2, 3, 2), (3, 4, 2), (5, 6, 2)])))
    assert [got[i].com_size for i in range(1, 9)] == [4, 4, 4, 4, 2, 2, 1, 1]


def test_pages_move_on_and_results_are_parsed(spark, tmp_path):
    e = spark.createDataFrame([(1, 5), (4, 5), (4, 5)], "from_id long, to_id long")
    every = ids(spark, [1, 2, 3, 4])
    assert [tuple(r) for r in export.edge_page(e, 1, 2, every).collect()] == [(None, None, 3)]
    assert [tuple(r) for r in export.edge_page(e, 3, 2, every).collect()] == [(4, 5, 4)] and export.edge_page(e, 4, 2, every).count() == 0
    js = spark.createDataFrame([('{"edges": [{"from_id": "a", "to_id": "b", "n": 3.0}]}',), ('{"edges": []}',)], "json string")
    assert [tuple(r) for r in files.parse_edges(js, {"n": "long"}).collect()] == [("a", "b", 3)]
    for bad in ('{"edges": [{"from_id": "a", "to_id": "b", "n": true}]}', '{"edges": [{"from_id": "a", "to_id": "b", "n": 1.5}]}', '{"edges": [{"from_id": "a"}]}'):
        with pytest.raises(Exception):
            files.parse_edges(spark.createDataFrame([(bad,)], "json string"), {"n": "long"}).collect()
    (tmp_path / "phone.csv").write_text("phone_id,risk\np,0.5\nq,\n")
    got = rows(files.read_vertices(spark, str(tmp_path), "phone", {"risk": 0.25, "country": "xx", "calls": 0}))
    assert got["p"].risk == 0.5 and got["q"].risk == 0.25 and got["q"].country == "xx" and got["q"].calls == 0


def test_ranking(spark):
    s = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 1), (3, 0.2, 0), (4, 0.1, 0)], "id long, score double, label int")
    r = evaluate.ranking_metrics(s).first()
    assert r.average_precision == 1 and r.roc_auc == 1
    assert evaluate.precision_at_k(s, [2]).first().precision == 1
    bad = s.withColumn("score", -F.col("score"))
    assert evaluate.ranking_metrics(bad).first().roc_auc == 0
    tied = s.withColumn("score", F.lit(0.5))
    assert evaluate.ranking_metrics(tied).first().roc_auc == 0.5 and evaluate.ranking_metrics(tied).first().average_precision == 0.5
    h = evaluate.hidden_recall(s, [1, 100]).orderBy("k").collect()
    assert h[0].recall == 0.5 and h[0].normalised == 1 and h[1].recall == 1
    with pytest.raises(ValueError):
        evaluate.gains_table(s, [0.0])
    with pytest.raises(ValueError):
        evaluate.two_classes(s.where("label = 1"))
    for one in (s.where("label = 1"), s.where("label = 0"), s.limit(0)):
        with pytest.raises(Exception, match="both classes"):
            evaluate.ranking_metrics(one).collect()
    with pytest.raises(ValueError):
        evaluate.hidden_recall(s, [0])
    assert "tp=1/2" in " ".join(r.line for r in evaluate.report_lines(evaluate.summary_report(s, [0.1])).collect())


def test_pu_loss(spark):
    d = spark.createDataFrame([(2.0, 1), (-1.0, 0), (0.5, 0), (-0.5, 1)], "logit double, target int")
    sig = lambda x: 1 / (1 + math.exp(-x))
    pos = 0.3 * (sig(-2) + sig(0.5)) / 2
    neg = (sig(-1) + sig(0.5)) / 2 - 0.3 * (sig(2) + sig(-0.5)) / 2
    r = evaluate.nnpu_loss(d, 0.3).first()
    assert math.isclose(r.loss, pos + neg, abs_tol=1e-6) and not r.corrected
    low = spark.createDataFrame([(5.0, 1), (-5.0, 0)], "logit double, target int")
    assert evaluate.nnpu_loss(low, 0.9).first().corrected
    with pytest.raises(ValueError):
        evaluate.nnpu_loss(d, 1.0)


@pytest.mark.parametrize("k,want", [(1, [0]), (2, [0, 1]), (3, [0, 1, 2]), (10, [0] * 6 + [1] * 2 + [2] * 2)])
def test_split_floor(spark, k, want):
    m = spark.createDataFrame([(i, f"P:{i}", 1, 0) for i in range(k)], "id long, group_key string, pu_label int, forced_test int")
    assert sorted(r.split for r in masking.split_accounts(m).collect()) == want


def test_split_fractions_are_checked(spark):
    m = spark.createDataFrame([(1, "P:1", 1, 0)], "id long, group_key string, pu_label int, forced_test int")
    for v, t in ((-0.1, 0.2), (0.2, -0.1), (0.6, 0.4)):
        with pytest.raises(ValueError):
            masking.split_accounts(m, v, t)


def test_mask_invariants(spark, sf_dir):
    from ledgerloom import catalog_learning as cl

    m, s = cl.pu_mask(spark, sf_dir).collect(), {r.id: r for r in cl.split_accounts(spark, sf_dir).collect()}
    assert all(s[r.id].split == masking.TEST for r in m if r.forced_test) and all(r.pu_label == 0 for r in m if r.forced_test)
    groups = {}
    for r in s.values():
        groups.setdefault(r.group_key, set()).add(r.split)
    assert all(len(v) == 1 for v in groups.values())


def test_best_epoch():
    b = evaluate.BestEpoch(patience=2)
    assert b.update(0.5, 0.1) and b.update(0.6, 0.1) and not b.update(0.55) and not b.done and not b.update(0.55) and b.done and b.epoch == 1
    assert b.update(0.601, 0.9)
    b = evaluate.BestEpoch(patience=2, min_delta=0.05)  # small gains are taken, patience counts from the last large one
    assert b.update(0.50) and b.update(0.52) and b.update(0.54) and b.done and b.update(0.56) and not b.done


def test_files(spark, tmp_path):
    (tmp_path / "l.csv").write_text("src_acct,dst_acct,amount,ts\na,b,1.5, 2025-01-01 00:00:00 \n")
    assert tuple(files.read_ledger(spark, str(tmp_path / "l.csv")).first()) == ("a", "b", 1.5, T0)
    (tmp_path / "bad.csv").write_text("src_acct,amount\na,1\n")
    with pytest.raises(ValueError):
        files.read_ledger(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "device.csv").write_text("device_id,device_type,flagged_device\nd,phone,True\ne,tv,False\n")
    assert {r.id: r.flagged_device for r in files.read_vertices(spark, str(tmp_path), "device").collect()} == {"d": 1, "e": 0}
    (tmp_path / "e.csv").write_text("FROM,TO,first_seen\na,b,1\na,b,2\n")
    assert [tuple(r) for r in files.read_edges(spark, str(tmp_path / "e.csv")).collect()] == [("a", "b", "2")]
    assert [len(p.collect()) for p in export.pages(ids(spark, range(7)), 3)] == [3, 3, 1]


def test_stream_bins(spark, tmp_path):
    from ledgerloom.streaming.flow import stream_flow_bins

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 2, 5.0, T0), (1, 2, 2.5, T0 + 60), (1, 2, 1.0, T0 + 20 * DAY)], "src long, dst long, amount double, ts long").withColumn("at", F.timestamp_seconds("ts")).drop("ts").write.parquet(src)
    s = stream_flow_bins(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src), 7)
    q = s.writeStream.outputMode("complete").format("memory").queryName("bins").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.amount, r.txns) for r in spark.table("bins").collect()) == [(1.0, 1), (7.5, 2)]


def test_catalog_is_complete():
    from ledgerloom import catalog

    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) >= 50
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_components_with_hubs_equal_union_find(spark):
    """Vertices with a third of all edges: as the least, as the greatest and in the middle of their component; a chain; a loop."""
    edges = [(0, i) for i in range(1000, 2500)] + [(9000, i) for i in range(3000, 4300)] + [(5000, i) for i in range(4400, 5600)]
    edges += [(i, i + 1) for i in range(6000, 6040)] + [(7000, 7000), (4299, 5599), (None, 3), (8, 8)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    got = fixpoint.components(spark.createDataFrame(edges * 2, "a long, b long")).collect()
    assert len(got) == len(root) and all(r.component == find(r.node) for r in got)


def test_page_index_covers_every_vertex_once(spark):
    vertices = ids(spark, [1, 2, 3, 5, 8, 13, 21, 34])
    index = export.page_index(vertices, 3).orderBy("page").collect()
    assert [tuple(r) for r in index] == [(0, None, 3, 3), (1, 3, 13, 3), (2, 13, 34, 2)]
    assert [[r.id for r in export.in_page(vertices, p.cursor, p.next_cursor).orderBy("id").collect()] for p in index] == [[1, 2, 3], [5, 8, 13], [21, 34]]
    assert [[r.id for r in p.collect()] for p in export.pages(vertices, 3)] == [[1, 2, 3], [5, 8, 13], [21, 34]]
    e = spark.createDataFrame([(1, 9), (1, 9), (13, 1), (99, 1)], "from_id long, to_id long")
    got = sorted(tuple(r) for r in export.edge_pages(e, vertices, 3).select("page", "next_cursor", "from_id", "to_id").collect())
    assert got[:2] == [(0, 3, 1, 9), (1, 13, 13, 1)] and got[2] == (2, 34, None, None) and len(got) == 3
    for p, page in enumerate(index):  # each page is what the paged query gives behind its cursor
        one = export.edge_page(e, page.cursor, 3, vertices).select("from_id", "to_id", "next_cursor").collect()
        assert sorted(map(str, ((p, r.next_cursor, r.from_id, r.to_id) for r in one))) == sorted(map(str, (g for g in got if g[0] == p)))
    assert export.page_index(vertices.limit(0)).collect() == [] and list(export.pages(vertices.limit(0))) == []
    with pytest.raises(ValueError):
        export.page_index(vertices, 0)
    assert [(r.id, r.next_cursor) for r in export.vertex_page(vertices, 5, 2).orderBy("id").collect()] == [(8, 13), (13, 13)]


def test_evaluation_by_answer_key(spark):
    scores = spark.createDataFrame([(i, s) for i, s in enumerate([.9, .8, .7, .6, .5, .4])], "id long, score double")
    key = spark.createDataFrame([(0, 1, 1, 0), (1, 0, 0, 0), (2, 1, 2, 1), (3, 0, 0, 1), (4, 1, 2, 0), (5, 0, 0, 0)], "id long, true_label int, bucket int, dark int")
    got = rows(evaluate.evaluate_hidden(scores, key, (1, 3, 50), 3), "k")
    assert [(got[k].true_hits, got[k].revealed_hits, got[k].hidden_hits, got[k].dark_hits) for k in (1, 3, 50)] == [(1, 1, 0, 0), (2, 1, 1, 1), (3, 1, 2, 2)]
    assert [(got[k].hidden_recall, got[k].ceiling, got[k].normalised) for k in (1, 3, 50)] == [(0, .5, 0), (.5, 1, .5), (1, 1, 1)]
    assert got[3].precision == 0.666667 and got[50].precision == 0.5 and [got[k].is_primary for k in (1, 3, 50)] == [False, True, False]
    assert got[1].accounts == 6 and got[1].hidden_positives == 2 and got[1].dark_accounts == 2 and got[1].average_precision == round((1 + 2 / 3 + 3 / 5) / 3, 6)
    none = rows(evaluate.evaluate_hidden(scores, key.withColumn("bucket", F.col("true_label")).drop("dark"), (3,)), "k")[3]
    assert (none.hidden_positives, none.hidden_recall, none.ceiling, none.dark_accounts) == (0, 0, 1, 0)
    for s, k, what in ((scores.where("id > 0"), key, "no score"), (scores, key.where("id > 0"), "no key"), (scores.unionAll(scores.limit(1)), key, "stands twice")):
        with pytest.raises(Exception, match=what):
            evaluate.evaluate_hidden(s, k, (3,)).collect()
    with pytest.raises(ValueError):
        evaluate.evaluate_hidden(scores, key, (3,), 4)
    with pytest.raises(Exception, match="both classes"):
        evaluate.evaluate_hidden(scores, key.withColumn("true_label", F.lit(0)), (3,)).collect()


def test_embedding_specs_from_text(spark):
    assert graph.regions_of(["HAS_PAID, 8,2.0,0", "X,4,1,8"], (12, 4, 0.5)) == {"HAS_PAID": (0, 8, 2.0), "X": (8, 4, 1.0), "default": (12, 4, 0.5)}
    assert graph.regions_of([]) == {"default": (0, 16, 1.0)} and graph.weights_of("1, 0.5,2") == (1.0, 0.5, 2.0)
    for bad in (["a,b"], [",1,1,1"], ["a,x,1,1"], ["a,1,1,0", "a,1,1,1"], ["default,1,1,1"]):
        with pytest.raises(ValueError):
            graph.regions_of(bad)
    with pytest.raises(ValueError):
        graph.weights_of("1,,2")
    e = edges(spark, [(1, 2, 1), (2, 3, 1)]).withColumn("e_type", F.when(F.col("a") == 1, "x").otherwise("y"))
    got = graph.fastrp(e, 4, graph.weights_of("1,1"), regions=graph.regions_of(["x,2,1.0,0"], (2, 2, 3.0)))
    want = graph.fastrp(e, 4, (1.0, 1.0), regions={"x": (0, 2, 1.0), "default": (2, 2, 3.0)})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_times_priors_and_batches(spark):
    import time

    from ledgerloom.functions import scalar

    r = spark.range(2).select(scalar.now().alias("n"), scalar.time_text(F.lit(T0)).alias("t"), scalar.days_between(F.lit(T0 + DAY), F.lit(T0)).alias("d")).collect()
    assert r[0].n == r[1].n and abs(r[0].n - time.time()) < 300 and r[0].t == "2025-01-01 00:00:00" and r[0].d == 1
    assert sampling.prior_of(spark.createDataFrame([(1,), (0,), (0,), (0,)], "is_mule int")).first().prior == 0.25
    for bad in ([(0,), (0,)], [(1,)], []):
        with pytest.raises(Exception, match="prior"):
            sampling.prior_of(spark.createDataFrame(bad, "is_mule int")).collect()
    pii = spark.createDataFrame([(p, "email", f"e{i}") for p in (1, 2) for i in range(12)], "party long, kind string, value string")
    whole, best = (identity.party_scores(pii, num_value_batches=n).first().score for n in (1, identity.BATCHES))
    assert whole == 6 and 1 <= best < 6  # a batch has one to all of the twelve values


@pytest.mark.parametrize("cap", [5, 40, 1000])
def test_triangles_of_a_skewed_graph_equal_brute_force(spark, cap):
    import random

    r = random.Random(cap)
    pairs = {tuple(sorted((int(80 * r.random() ** 3), r.randrange(80)))) for _ in range(700)}
    pairs = sorted((a, b) for a, b in pairs if a != b)
    near = {i: set() for i in range(80)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    credit = dict.fromkeys(near, 0)
    for a, b in pairs:
        if len(near[a]) <= cap and len(near[b]) <= cap:
            credit[a] += len(near[a] & near[b])
            credit[b] += len(near[a] & near[b])
    got = rows(graph.triangles(ids(spark, range(80)), edges(spark, [(a, b, 1) for a, b in pairs]), cap))
    assert {i: x.triangle_count for i, x in got.items()} == {i: c // 2 for i, c in credit.items()} and (cap == 5 or max(credit.values()) > 50)
