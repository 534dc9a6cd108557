"""Graphs in which one vertex has half of all edges."""

import math
import random
from statistics import median

from pyspark.sql import functions as F

from ledgerloom.operators import graph
from ledgerloom.plans import messages as m


def star(spark):
    r = random.Random(4)
    rows = {(0, i) for i in range(1, 3001)} | {tuple(sorted((r.randrange(1, 3001), r.randrange(1, 3001)))) for _ in range(3000)}
    rows = sorted((a, b, (a + b) % 5 + 1) for a, b in rows if a != b)
    return rows, spark.createDataFrame(rows, "a long, b long, weight long")


def sizes(df):
    return [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_edges_of_a_hub_are_dealt_out(spark):
    _, edges = star(spark)
    both = graph.both_ways(edges)
    got = m.messages(both, hub=1000, hubs=100)
    assert got.many is not None and {r.src for r in got.hubs.collect()} == {0} and got.many.count() == 3000
    for part in (got.few, got.many):
        assert max(sizes(part)) <= 3 * median(sizes(part))
    values = spark.createDataFrame([(i, float(i)) for i in range(3001)], "id long, v double")
    sent = got.sent(values)
    assert sent.where("v <> src").count() == 0 and sent.count() == both.count() == got.edges().count()
    kept = got.kept(values, (F.col("v") * 2).alias("w"))
    assert kept.edges().where("w <> 2 * src").count() == 0 and kept.many.count() == 3000
    assert got.sent(values.where("id > 0")).count() == both.count() - 3000
    assert m.messages(both).many is not None  # also by the production limits
    assert m.messages(both.limit(0)).sent(values).count() == 0


def test_ranks_over_a_hub_equal_plain_python(spark):
    rows, edges = star(spark)
    out, rank = {}, {}
    for a, b, w in rows:
        out.setdefault(a, []).append((b, w))
        out.setdefault(b, []).append((a, w))
    rank = dict.fromkeys(out, 1.0)
    for _ in range(4):
        got = dict.fromkeys(out, 0.0)
        for a, to in out.items():
            total = sum(w for _, w in to)
            for b, w in to:
                got[b] += rank[a] * w / total
        rank = {i: 0.15 + 0.85 * x for i, x in got.items()}
    have = {r.id: r.pagerank for r in graph.pagerank(edges, max_change=-1, max_iter=4).collect()}
    assert have.keys() == rank.keys() and all(math.isclose(have[i], rank[i], rel_tol=1e-9) for i in rank)


def test_embeddings_do_not_depend_on_hubs(spark, monkeypatch):
    _, edges = star(spark)
    vectors = lambda: {(r.id, r.i): r.value for r in graph.fastrp(edges, 4).collect()}
    apart = vectors()
    monkeypatch.setattr(graph, "messages", lambda e: m.messages(e, hub=10 ** 9))
    together = vectors()
    assert apart.keys() == together.keys() and all(math.isclose(apart[k], together[k], abs_tol=1e-9) for k in apart)
