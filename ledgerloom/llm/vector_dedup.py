"""Near-duplicate vectors by NN-descent (operator 9).

Equal vectors are one node with a multiplicity. The neighbour graph starts from random orders: rows
sorted by a seeded code (the nearest of random directions) and one projection meet within overlapping blocks of
a sliding window. A pair without other neighbours can be found by these alone. So the bits of a code follow the
number of nodes, the number of orders follows what share of pairs at the threshold one code keeps together, and
twins planted at the threshold beside ``PLANTED`` nodes measure what the orders find, however few links a table has.
Then, round by round, each node joins a sample of its new neighbours with all sampled ones (neighbours of
neighbours), and the best ``LIST`` of a node stay in its list; a list that is full of links is saturated and grows to
twice and four times the size. Beside its list a node keeps its link of smallest name, so that a dense spot stays tied
to what lies around it. This goes on until a round finds next to nothing.

Lists name components. Nodes of a component larger than ``LIST`` get their links counted exactly, tile by
tile within the component, so a saturated list costs no rows by pairs. An audit then compares ``AUDIT`` nodes
(of least hash; all, where there are fewer) with every node: what it finds is kept, and the share of these links that were known before is
the recall. Below ``GOAL``, or below ``PLANTED_GOAL`` for planted twins, descent goes on from more orders; after ``ATTEMPTS`` the audit is extended to every node,
which is exact and quadratic, and is logged as a warning.

Links are pairs with cosine >= ``threshold`` in double precision. Null, zero or non-finite vectors, or
ones with null components, link with nothing; vectors of different length are never compared. Rows
of null vec_id link with nothing and have no component. Rows with equal vec_id and vector are one; a vec_id with several vectors is linked
through any of them. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import logging
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import BROADCAST_MB, components, cut, measured_mb

THRESHOLD, SLACK = 0.9, 0.1  # lists also hold neighbours down to threshold - slack, to walk along
ORDERS, BITS, BLOCK = 4, 2, 512  # least number of orders and of bits of a code; rows that meet
TARGET, PLANTED, PLANTED_GOAL = 0.995, 400, 0.97  # of lone pairs by the orders; twins that measure it; what they must show
LIST, ROUNDS = 24, 10
AUDIT, GOAL, ATTEMPTS, ENOUGH = 2048, 0.99, 3, 400
SLAB_MB, TILE = 24, (512, 4096)  # audited nodes broadcast at once; what is multiplied at once
PART = 1024  # nodes of a component in one tile

log = logging.getLogger(__name__)


@F.pandas_udf(T.BinaryType())
def _unit(raw: pd.Series) -> pd.Series:
    out = []
    for x in raw:
        v = None
        if x is not None and len(x) and not any(c is None for c in x):
            a = np.asarray(x, np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                top = np.abs(a).max()
                if np.isfinite(a).all() and top > 0:
                    a = a / top
                    v = (a / np.sqrt(a @ a)).tobytes()
        out.append(v)
    return pd.Series(out, dtype="object")


def nodes_of(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Distinct unit vectors (node, dim, unit binary, first, copies) and members (vec_id, node); invalid ones have no node."""
    raw = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("raw"))
    units = cut(raw.select("vec_id", _unit("raw").alias("unit")).distinct())
    good = units.where("unit is not null and vec_id is not null")
    nodes = good.groupBy("unit").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes = nodes.select(F.xxhash64("unit", "first").alias("node"), (F.length("unit") / 8).cast("int").alias("dim"), "unit", "first", "copies")
    nodes = cut(nodes)
    members = units.join(nodes.select("unit", "node"), "unit", "left").select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("node")).alias("node"))
    return nodes, members


def bits_for(n: int) -> int:
    """Bits of a code that leave about half a block of nodes to each."""
    return max(BITS, int(np.ceil(np.log2(max(1, 2 * n / BLOCK)))))


def _codes(x: np.ndarray, seed: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of ``bits`` bits: which of some random directions, taken both ways, is nearest; and one more projection."""
    dim, code = x.shape[1], np.zeros(len(x), np.int64)
    draws, rows = np.random.default_rng((seed, dim)), np.arange(len(x))
    while bits > 0:
        wide = min(bits - 1, int(np.log2(dim)))
        p = x @ draws.standard_normal((dim, 1 << wide))
        at = np.abs(p).argmax(1)
        code = (code << wide + 1) + 2 * at + (p[rows, at] > 0)
        bits -= wide + 1
    return code, x @ draws.standard_normal(dim)


def _twins(x: np.ndarray, cosine: float, draws: np.random.Generator) -> np.ndarray:
    """For each unit vector another one at that cosine, in a random direction."""
    e = draws.standard_normal(x.shape)
    e -= (e * x).sum(1, keepdims=True) * x
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    return cosine * x + np.sqrt(1 - cosine ** 2) * e


def orders_for(dim: int, bits: int, threshold: float) -> int:
    """Orders after which a lone pair at the threshold has shared a code with probability ``TARGET``; at least ORDERS."""
    if dim < 2:  # two directions, which one bit tells apart
        return ORDERS
    draws = np.random.default_rng((dim, bits))
    x = draws.standard_normal((2000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = _twins(x, threshold, draws)
    same = np.mean([(_codes(x, k, bits)[0] == _codes(y, k, bits)[0]).mean() for k in range(4)])
    return max(ORDERS, int(np.ceil(np.log(1 - TARGET) / np.log1p(-min(max(same, 0.001), 0.999)))))


def _block_pairs(nodes: DataFrame, orders: range, floor: float, bits: int) -> DataFrame:
    """Pairs (a, b, sim) above ``floor`` that stand within a block of one of the orders, all of them from one shuffle."""

    def place(batches):
        for b in batches:
            for k in orders:
                code, key = np.zeros(len(b), np.int64), np.zeros(len(b))
                for dim in b.dim.unique():
                    at = np.flatnonzero(b.dim == dim)
                    code[at], key[at] = _codes(np.stack([np.frombuffer(b.unit.iloc[i]) for i in at]), k, bits)
                yield b.assign(nth=k, code=code, key=key)

    def meet(held, last):
        while len(held) >= (1 if last else 2 * BLOCK):
            final = last and len(held) <= BLOCK
            yield _meet(held[:BLOCK], BLOCK if final else BLOCK // 2, floor)
            held[:] = [] if final else held[BLOCK // 2:]

    def pairs(batches):
        held, at = [], None
        for b in batches:
            for nth, own in b.groupby(["nth", "dim"], sort=True):
                if nth != at:
                    yield from meet(held, True)
                    at = nth
                held += list(zip(own.node, own.dim, own.unit))
                yield from meet(held, False)
        yield from meet(held, True)

    placed = nodes.select("node", "dim", "unit").mapInPandas(place, "node long, dim int, unit binary, nth int, code long, key double")
    order = ("nth", "dim", "code", "key", "node")
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(pairs, "a long, b long, sim double")


def _meet(held: list, first: int, floor: float) -> pd.DataFrame:
    """Pairs of the first ``first`` rows of a block with all its rows, each once: for each row the best it can keep."""
    out = []
    dims = np.array([h[1] for h in held])
    ids = np.array([h[0] for h in held], np.int64)
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        x = np.stack([np.frombuffer(held[i][2]) for i in at])
        head = at < first
        s = x[head] @ x.T
        out.append(_best(ids[at[head]], ids[at], s, s >= floor, 4 * LIST))
    return pd.concat(out)


def _best(left: np.ndarray, right: np.ndarray, s: np.ndarray, able: np.ndarray, most: int) -> pd.DataFrame:
    """Pairs (a, b, sim) of ``able`` places of s: of each row the ``most`` largest and the smallest name."""
    able &= left[:, None] != right
    if s.shape[1] > most:
        least = -np.partition(-np.where(able, s, -2), most - 1, 1)[:, most - 1:most]
        names = np.where(able, right, np.iinfo(np.int64).max)
        able &= (s >= least) | (names == names.min(1, keepdims=True))
    i, j = np.nonzero(able)
    a, b = np.minimum(left[i], right[j]), np.maximum(left[i], right[j])
    return pd.DataFrame({"a": a, "b": b, "sim": s[i, j]})


def _local_join(graph: DataFrame, nodes: DataFrame, floor: float, size: int, seed: int) -> DataFrame:
    """Pairs among sampled neighbours of each node that has new ones: at least one of each pair is new.

    A saturated list (longer than ``size``) is sampled at twice the size.
    """
    both = graph.select(F.col("a").alias("v"), F.col("b").alias("u"), "new").unionAll(graph.select(F.col("b").alias("v"), F.col("a").alias("u"), "new"))
    news = both.groupBy("v").agg(F.count_if("new").alias("n_new"), F.count(F.lit(1)).alias("n")).where("n_new > 0 and n > 1")
    rank = F.row_number().over(Window.partitionBy("v", "new").orderBy(F.xxhash64(F.lit(seed), "u", "v")))
    some = both.withColumn("r", rank).where(F.col("r") <= 2 * size).join(news, "v").where((F.col("r") <= size) | (F.col("n") > size))
    some = some.select("v", "new", F.col("u").alias("node")).join(nodes.select("node", "unit"), "node")

    def meet(rows):
        ids, new = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows])
        x = np.stack([np.frombuffer(r[2]) for r in rows])
        s = x[new] @ x.T
        return _best(ids[new], ids, s, s >= floor, max(1, LIST // 3))

    def pairs(batches):
        at, rows, out, n = None, [], [], 0
        for b in batches:
            for v, node, new, unit in zip(b.v, b.node, b.new, b.unit):
                if v != at:
                    if rows:
                        out.append(meet(rows))
                        n += len(out[-1])
                        if n > 50_000:
                            yield pd.concat(out).drop_duplicates(["a", "b"])
                            out, n = [], 0
                    at, rows = v, []
                rows.append((node, new, unit))
        if rows:
            out.append(meet(rows))
        if out:
            yield pd.concat(out).drop_duplicates(["a", "b"])

    return some.select("v", "node", "new", "unit").repartition("v").sortWithinPartitions("v").mapInPandas(pairs, "a long, b long, sim double")


def _merged(known: DataFrame | None, found: DataFrame, threshold: float) -> DataFrame:
    """The lists with ``found`` added: pairs (a, b, sim, new) that one end keeps; only pairs not known before are new."""
    rows = found.select("a", "b", "sim", F.lit(True).alias("new"))
    if known is not None:
        rows = rows.unionAll(known.select("a", "b", "sim", F.lit(False).alias("new")))
    pairs = rows.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    both = pairs.select(F.col("a").alias("v"), F.col("b").alias("u"), "sim", "new").unionAll(pairs.select(F.col("b").alias("v"), F.col("a").alias("u"), "sim", "new"))
    held = both.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))).where(F.col("r") <= 4 * LIST)
    held = held.withColumn("links", F.count_if(F.col("sim") >= threshold).over(Window.partitionBy("v")))
    size = F.when(F.col("links") < LIST, LIST).when(F.col("links") < 2 * LIST, 2 * LIST).otherwise(4 * LIST)
    lowest = both.where(F.col("sim") >= threshold).groupBy("v").agg(F.min(F.struct("u", "sim", "new")).alias("x")).select("v", "x.*")
    kept = held.where(F.col("r") <= size).select("v", "u", "sim", "new").unionAll(lowest)
    kept = kept.groupBy(F.least("v", "u").alias("a"), F.greatest("v", "u").alias("b")).agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    return cut(kept)


def _planted(nodes: DataFrame, seed: int, threshold: float) -> tuple[list, DataFrame]:
    """Twins at the threshold of ``PLANTED`` nodes: [(twin, node)], and the twins as nodes."""
    some = nodes.where("dim > 1").orderBy(F.xxhash64(F.lit(seed), "node")).limit(PLANTED).select("node", "dim", "unit").collect()
    draws = np.random.default_rng(seed)
    rows = [(-(1 << 62) - i, r.dim, _twins(np.frombuffer(r.unit)[None], threshold, draws)[0].tobytes()) for i, r in enumerate(some)]
    twins = nodes.sparkSession.createDataFrame([(t, d, bytearray(u)) for t, d, u in rows], "node long, dim int, unit binary")
    return [(t[0], r.node) for t, r in zip(rows, some)], twins


def first_pairs(nodes: DataFrame, orders: range, threshold: float, bits: int) -> tuple[DataFrame, float]:
    """Pairs that the orders show, and the share of planted twins that met their node in one.

    Twins with so many other neighbours that their best pairs had to be chosen do not count: there the walk along
    neighbours finds what the orders do not.
    """
    pairs, twins = _planted(nodes, orders.start, threshold)
    found = cut(_block_pairs(nodes.select("node", "dim", "unit").unionAll(twins), orders, threshold - SLACK, bits))
    lowest = -(1 << 62) - PLANTED
    real = found.where(f"NOT (a BETWEEN {lowest} AND {-(1 << 62)})")  # a twin has the smaller name in nearly every pair
    of = F.broadcast(nodes.sparkSession.createDataFrame(pairs or [(0, 0)], "a long, base long"))
    both = found.select("a", "b").unionAll(found.select("b", "a")).join(of, "a")
    met = both.groupBy("a").agg(F.max(F.col("b") == F.col("base")).alias("met"), F.count_distinct("b").alias("n")).collect()  # PLANTED rows
    full = sum(not r.met and r.n >= 4 * LIST for r in met)
    counted = len(pairs) - full
    names = F.broadcast(twins.select(F.col("node").alias("b")))
    return real.join(names, "b", "left_anti").select("a", "b", "sim"), sum(r.met for r in met) / counted if counted else 1.0


def descend(nodes: DataFrame, graph: DataFrame | None, found: DataFrame, threshold: float) -> DataFrame:
    """Neighbour lists (a, b, sim, new), sim >= threshold - SLACK, walked on from those of ``graph`` and ``found``."""
    floor = threshold - SLACK
    graph = _merged(graph, found, threshold)
    for r in range(ROUNDS):
        graph = _merged(graph, _local_join(graph, nodes, floor, LIST, r), threshold)
        now = graph.agg(F.count_if("new").alias("new"), F.count(F.lit(1)).alias("n")).first()
        if now.new <= 0.001 * now.n:
            break
    return graph


def _linked(x: np.ndarray, y: np.ndarray, threshold: float):
    """Places (i, j) of all pairs with x[i] . y[j] >= threshold, tile by tile.

    Single precision settles what its error cannot turn; the pairs within that error are multiplied again in double.
    """
    slack = (x.shape[1] + 4) * 2.0 ** -23
    x1, y1 = x.astype(np.float32), y.astype(np.float32)
    for top in range(0, len(x), TILE[0]):
        for left in range(0, len(y), TILE[1]):
            s = x1[top:top + TILE[0]] @ y1[left:left + TILE[1]].T
            at = np.flatnonzero(s >= threshold - slack)
            if not len(at):
                continue
            i, j = np.divmod(at, s.shape[1])
            i, j, keep = i + top, j + left, s.ravel()[at] >= threshold + slack
            close = np.flatnonzero(~keep)
            for k in range(0, len(close), 1 << 16):
                c = close[k:k + (1 << 16)]
                keep[c] = np.einsum("ij,ij->i", x[i[c]], y[j[c]]) >= threshold
            yield i[keep], j[keep]


def _counted(ids: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """Counts above zero; a count has a = b, a joined pair of labels never has."""
    at = np.flatnonzero(n)
    return pd.DataFrame({"a": ids[at], "b": ids[at], "n": n[at].astype(np.int64)})


def _within(named: DataFrame, threshold: float) -> DataFrame:
    """(node, n): links of the nodes of components larger than ``LIST``, in tiles of ``PART`` by ``PART`` nodes."""
    parts = named.groupBy("label").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > LIST).select("label", F.expr(f"(m + {PART - 1}) div {PART}").alias("parts"))
    parts = cut(parts)
    if measured_mb(parts, F.lit(32)) < BROADCAST_MB:
        parts = F.broadcast(parts)
    d = named.join(parts, "label").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("parts")))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    d = d.select("label", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "node", "unit", "copies").withColumn("key", F.xxhash64("label", "i", "j"))

    def meet(b: pd.DataFrame) -> pd.DataFrame:
        out, one = [], (b.tile == b.i).to_numpy()
        for _, at in b.groupby(b.unit.map(len)).indices.items():
            sides = [at[one[at]], at if b.i.iloc[0] == b.j.iloc[0] else at[~one[at]]]
            if not len(sides[0]) or not len(sides[1]):
                continue
            (ids, x, n), (others, y, m) = ((b.node.to_numpy(np.int64)[k], np.stack([np.frombuffer(b.unit.iloc[i]) for i in k]), b.copies.to_numpy(np.int64)[k]) for k in sides)
            own, back = np.zeros(len(ids)), np.zeros(len(others))
            for i, j in _linked(x, y, threshold):
                apart = ids[i] != others[j]
                own += np.bincount(i[apart], m[j[apart]], len(ids))
                back += np.bincount(j[apart], n[i[apart]], len(others))
            out.append(_counted(ids, own))
            if b.i.iloc[0] != b.j.iloc[0]:
                out.append(_counted(others, back))
        out = pd.concat(out) if out else _counted(np.zeros(0, np.int64), np.zeros(0))
        return out[["a", "n"]].rename(columns={"a": "node"})

    return d.groupBy("key").applyInPandas(meet, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def _stacked(rows: pd.DataFrame) -> dict[int, tuple]:
    """(ids, unit vectors, labels) by length of the vector."""
    return {size: (g.node.to_numpy(np.int64), np.stack([np.frombuffer(u) for u in g.unit]), g.label.to_numpy(np.int64)) for size, g in rows.groupby(rows.unit.map(len))}


def audited(named: DataFrame, asked: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``asked`` nodes against all: (node, n = vectors linked to it) and (a, b): labels that a link joins.

    Slabs of asked nodes of at most ``SLAB_MB`` are broadcast one after the other and compared in place with every node.
    """
    spark = named.sparkSession
    slabs = int(measured_mb(asked, F.length("unit") + 24) // SLAB_MB) + 1
    asked = asked.select("node", "unit", "label", F.pmod("node", F.lit(slabs)).cast("int").alias("slab"))

    def against(shared):
        def compare(batches):
            held = shared.value
            sums = {d: np.zeros(len(h[0])) for d, h in held.items()}
            for b in batches:
                for d, at in b.groupby(b.unit.map(len)).indices.items():
                    if d not in held:
                        continue
                    ids, copies, labels = (b[c].to_numpy(np.int64)[at] for c in ("node", "copies", "label"))
                    x = np.stack([np.frombuffer(b.unit.iloc[i]) for i in at])
                    for i, j in _linked(x, held[d][1], threshold):
                        apart = ids[i] != held[d][0][j]
                        i, j = i[apart], j[apart]
                        sums[d] += np.bincount(j, copies[i], len(sums[d]))
                        a, c = labels[i], held[d][2][j]
                        cross = a != c
                        if cross.any():
                            yield pd.DataFrame({"a": np.minimum(a, c)[cross], "b": np.maximum(a, c)[cross], "n": 0}).drop_duplicates()
            for d, n in sums.items():
                yield _counted(held[d][0], n)

        return compare

    parts = []
    for k in range(slabs):
        shared = spark.sparkContext.broadcast(_stacked(asked.where(F.col("slab") == k).select("node", "unit", "label").toPandas()))
        found = named.select("node", "unit", "copies", "label").mapInPandas(against(shared), "a long, b long, n long")
        parts.append(cut(found.groupBy("a", "b").agg(F.sum("n").alias("n"))))
        shared.destroy()
    found = parts[0]
    for more in parts[1:]:
        found = found.unionAll(more)
    return found.where("a = b").select(F.col("a").alias("node"), "n"), found.where("a <> b").select("a", "b").distinct()


class Audit(NamedTuple):
    recall: float  # of links of the asked nodes; where they have fewer than ENOUGH, not above what the planted twins show
    links: int  # that the asked nodes have in truth: what that figure rests on
    planted: float  # share of planted lone pairs at the threshold that the orders found


def link_audited(vectors: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, Audit]:
    """(vec_id, n_links, component_id, kept), and what the audit says of them."""
    nodes, members = nodes_of(vectors)
    members = cut(members)
    first = nodes.select("node", "first", "copies")
    common = nodes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    bits = bits_for(nodes.count())
    graph, begin, orders, unmet = None, 0, orders_for(common.dim, bits, threshold) if common else ORDERS, 1.0
    for attempt in range(ATTEMPTS):
        found, shown = first_pairs(nodes, range(begin, begin + orders), threshold, bits)
        unmet *= 1 - shown
        graph = descend(nodes, graph, found, threshold)
        links = graph.where(F.col("sim") >= threshold).select("a", "b")
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = cut(both.join(first.select(F.col("node").alias("b"), F.col("first").alias("y"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("n"), F.min("y").alias("y")))
        low = links.join(first.select(F.col("node").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("node").alias("b"), F.col("first").alias("y")), "b")
        comp = components(low.select(F.col("x").alias("a"), F.col("y").alias("b")))
        named = cut(nodes.join(comp.withColumnRenamed("node", "first"), "first", "left").withColumn("label", F.coalesce("component", "first")).select("node", "dim", "unit", "first", "copies", "label"))
        counts = named.select("node").join(ends.select("node", F.col("n").alias("listed")), "node", "left").join(_within(named, threshold).withColumnRenamed("n", "tiled"), "node", "left")
        counts = cut(counts.select("node", F.coalesce("tiled", "listed", F.lit(0)).alias("known")))
        asked = named.orderBy(F.xxhash64(F.lit(attempt), "node")).limit(AUDIT)
        truth, joins = audited(named, asked, threshold)
        seen = truth.join(counts, "node").agg(F.sum("n").alias("true"), F.sum("known").alias("known")).first()
        links, known = seen.true or 0, seen.known or 0
        recall = known / links if links else 1.0
        audit = Audit(recall if links >= ENOUGH else min(recall, 1 - unmet), links, 1 - unmet)
        log.info("attempt %d: recall of links %.4f over %d audited links; planted pairs %.4f", attempt + 1, recall, links, 1 - unmet)
        if recall >= GOAL and 1 - unmet >= PLANTED_GOAL:
            break
        begin, orders = begin + orders, 2 * orders
    else:
        log.warning("recall of links %.4f, of planted pairs %.4f: every node is compared with all", recall, 1 - unmet)
        truth, joins = audited(named, named, threshold)
    whole = components(joins).withColumnRenamed("node", "label").withColumnRenamed("component", "joined")
    per = named.select("node", "copies", "label").join(counts, "node").join(truth, "node", "left").join(whole, "label", "left")
    per = per.select("node", (F.coalesce("n", "known") + F.col("copies") - 1).alias("n"), F.coalesce("joined", "label").alias("c"))
    out = members.join(per, "node", "left").groupBy("vec_id").agg(F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.min("c"), F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), audit


def link(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept): links to other vectors and the smallest id reachable by them."""
    return link_audited(vectors, threshold)[0]
