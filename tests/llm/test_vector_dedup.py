import numpy as np
import pandas as pd

from ledgerloom.llm import vector_dedup as v


def brute(rows):
    ok = [(i, np.asarray(x, float) / np.linalg.norm(np.asarray(x, float))) for i, x in rows if x is not None and len(x) and None not in x and np.isfinite(np.asarray(x, float)).all() and np.any(x)]
    links = {i: set() for i, _ in rows}
    for i, x in ok:
        for j, y in ok:
            if i != j and len(x) == len(y) and x @ y >= 0.9:
                links[i].add(j)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def test_equals_brute_force(spark):
    r = np.random.default_rng(4)
    rows, n = [], 0
    for size in [1] * 150 + [2] * 20 + [30, 700]:
        c = r.normal(size=32)
        c /= np.linalg.norm(c)
        for _ in range(size):
            rows.append((n, [float(x) for x in c + r.normal(size=32) * 0.2 / 32 ** 0.5 * (size > 1)]))
            n += 1
    rows += [(n, rows[5][1]), (n + 1, [2 * x for x in rows[5][1]]), (n + 2, None), (n + 3, [0.0] * 32), (n + 4, [None] + [1.0] * 31), (n + 5, [float("nan")] + [1.0] * 31), (n + 6, []), (n + 7, [1.0, 2.0]), (n + 8, [1.0, 2.0]), (n + 9, [1e308] * 32)]
    df = spark.createDataFrame([(*x, "e") for x in rows] + [(*rows[3], "e")], "vec_id long, embedding array<double>, node string")
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in v.link(df).collect()}
    want = brute(rows)
    found, true = sum(x[0] for x in got.values()), sum(x[0] for x in want.values())
    assert found <= true and found >= 0.98 * true
    assert {k: x[1:] for k, x in got.items()} == {k: x[1:] for k, x in want.items()}
    assert v.link(df.limit(0)).count() == 0


def test_isolated_pairs_that_no_order_brings_together(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = []
    for _ in range(150):
        c, d = r.normal(size=(2, 64))
        c /= np.linalg.norm(c)
        d -= (d @ c) * c
        d /= np.linalg.norm(d)
        rows += [(len(rows), c.tolist()), (len(rows) + 1, (0.91 * c + (1 - 0.91 ** 2) ** 0.5 * d).tolist())]
    monkeypatch.setattr(v, "BITS", 16)  # as in a large table: near vectors seldom stand in one block
    monkeypatch.setattr(v, "BLOCK", 2)
    monkeypatch.setattr(v, "SLAB_MB", 0.05)  # and several slabs
    monkeypatch.setattr(v, "TILE", (16, 32))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in v.link(df).collect()}
    assert got == brute(rows) and all(x[0] == 1 for x in got.values())


def test_large_group_is_counted_whole(spark, monkeypatch):
    r = np.random.default_rng(9)
    c = r.normal(size=32)
    c /= np.linalg.norm(c)
    rows = [(i, (c + r.normal(size=32) * 0.2 / 32 ** 0.5).tolist()) for i in range(500)]
    monkeypatch.setattr(v, "BLOCK", 8)
    monkeypatch.setattr(v, "LIST", 4)  # lists far shorter than the group, as in a group of a hundred thousand
    monkeypatch.setattr(v, "ROUNDS", 2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in v.link(df).collect()}
    assert got == brute(rows) and max(x[0] for x in got.values()) > 400


def test_large_ids_beside_null(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(big, [1.0, 0.0]), (big + 1, [1.0, 0.01]), (None, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [1.0, 0.0]), (9, None)], "vec_id long, embedding array<double>")
    got = {(x.vec_id, x.n_links, x.component_id, x.kept) for x in v.link(df).collect()}
    assert got == {(big, 2, 7, False), (big + 1, 2, 7, False), (7, 2, 7, True), (9, 0, 9, True), (None, 0, None, True)}


def test_audit_measures_recall_and_goes_on(spark, monkeypatch, caplog):
    """Near pairs no order shows: the audit sees that they are missed, and every node is compared in the end."""
    r = np.random.default_rng(12)
    rows = []
    for _ in range(120):
        c, e = r.normal(size=(2, 64))
        c /= np.linalg.norm(c)
        e -= (e @ c) * c
        e /= np.linalg.norm(e)
        rows += [(len(rows), c.tolist()), (len(rows) + 1, (0.91 * c + (1 - 0.91 ** 2) ** 0.5 * e).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(v, "AUDIT", 60)
    out, audit = v.link_audited(df)
    assert audit.recall == 1.0 and audit.links == 60 and audit.planted >= 0.97 and {x.vec_id: (x.n_links, x.component_id, x.kept) for x in out.collect()} == brute(rows)
    monkeypatch.setattr(v, "BITS", 20)
    monkeypatch.setattr(v, "BLOCK", 2)
    monkeypatch.setattr(v, "ATTEMPTS", 1)
    monkeypatch.setattr(v, "orders_for", lambda *_: 2)
    out, audit = v.link_audited(df)
    assert audit.recall < v.GOAL and audit.planted < 0.5 and {x.vec_id: (x.n_links, x.component_id, x.kept) for x in out.collect()} == brute(rows)
    assert "every node is compared" in caplog.text


def test_lone_pairs_in_a_large_table(spark, tmp_path):
    """Twelve pairs among 60,000 vectors, all constants as in production: the sample of the audit meets next to none of them."""
    r = np.random.default_rng(31)
    x = r.standard_normal((60_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:12] = v._twins(x[20_000:20_012], 0.91, r)
    pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}).to_parquet(tmp_path / "v.parquet")
    df = spark.read.parquet(str(tmp_path / "v.parquet")).repartition(8)
    out, audit = v.link_audited(df)
    assert {(i.vec_id, i.n_links, i.component_id) for i in out.where("n_links > 0").collect()} == {(k, 1, k % 20_000) for k in (*range(12), *range(20_000, 20_012))}
    assert audit.links < 10 and 0.97 <= audit.planted <= 1 and audit.recall <= audit.planted


def test_orders_follow_the_number_of_nodes():
    assert v.bits_for(1000) == 2 and v.bits_for(60_000) == 8 and v.bits_for(10 ** 9) == 22
    few, many = (v.orders_for(64, v.bits_for(n), 0.9) for n in (60_000, 10 ** 7))
    assert v.ORDERS <= few < many < 60 and v.orders_for(64, 8, 0.99) < few and v.orders_for(1, 3, 0.9) >= v.ORDERS
