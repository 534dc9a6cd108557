"""Iterative and structural operators over undirected account edges (a, b, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.fixpoint import components, cut
from ledgerloom.plans.messages import messages
from ledgerloom.plans.ordered import numbered


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) of each undirected edge in both directions, in one pass."""
    e = edges.select(F.explode_outer(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))).alias("e"))
    return e.select("e.*").dropna(subset=["src", "dst"])


LARGE = 10_000  # members from which a component's size is handed to its rows by broadcast


def wcc(accounts: DataFrame, edges: DataFrame, min_link_weight: int = 2) -> DataFrame:
    """(id, com_id, com_size) of every account; a component is named by its smallest id.

    Sizes of large components, at most one in ``LARGE`` rows, are broadcast; the others meet their rows by key. So a giant
    component is no hot key.
    """
    c = components(edges.where(F.col("weight") >= min_link_weight).select("a", "b"))
    d = cut(accounts.select("id").join(c, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("com_id")))
    sizes = cut(component_sizes(d))
    large = sizes.where(F.col("com_size") >= LARGE)
    few = large.count() < 1_000_000
    one = d.join(F.broadcast(large) if few else large, "com_id")
    rest = d.join(F.broadcast(large.select("com_id")) if few else large.select("com_id"), "com_id", "left_anti").join(sizes.where(F.col("com_size") < LARGE), "com_id")
    return one.select("id", "com_id", "com_size").unionAll(rest.select("id", "com_id", "com_size"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("com_id").agg(F.count(F.lit(1)).alias("com_size"))


def size_groups(labels: DataFrame, print_limit: int = 100) -> DataFrame:
    """(com_size, n_components, members): how many components have a size, and the first of them by id."""
    sizes = component_sizes(labels)
    rank = F.row_number().over(Window.partitionBy("com_size").orderBy("com_id"))
    first = sizes.withColumn("r", rank).where(F.col("r") <= print_limit).groupBy("com_size").agg(F.array_join(F.transform(F.sort_array(F.collect_list("com_id")), lambda x: x.cast("string")), ",").alias("first_components"))
    return sizes.groupBy("com_size").agg(F.count(F.lit(1)).alias("n_components")).join(first, "com_size")


def aa_degree(accounts: DataFrame, edges: DataFrame) -> DataFrame:
    d = both_ways(edges).groupBy("src").agg(F.count(F.lit(1)).alias("aa_degree"))
    return accounts.select("id").join(d, F.col("id") == F.col("src"), "left").select("id", F.coalesce("aa_degree", F.lit(0)).alias("aa_degree"))


def pagerank(edges: DataFrame, damping: float = 0.85, max_change: float = 0.001, max_iter: int = 25) -> DataFrame:
    """(id, pagerank) of accounts that have an edge; weighted, not normalised, start 1.

    Edges carry their share of the source's weight and are materialised once, those of hubs apart; each round
    sends ranks along them, sums what arrives (pre-aggregated), and cuts its lineage. ``max_change`` < 0 runs all rounds.
    """
    e = messages(both_ways(edges))
    total = e.edges().groupBy("src").agg(F.sum("weight").alias("all"))
    e = e.kept(total, (F.col("weight") / F.col("all")).alias("share"), key="src")
    rank = cut(total.select(F.col("src").alias("id"), F.lit(1.0).alias("pagerank")))
    for _ in range(max_iter):
        got = e.sent(rank).groupBy("dst").agg(F.sum(F.col("share") * F.col("pagerank")).alias("recv"))
        value = F.lit(1 - damping) + F.lit(damping) * F.coalesce("recv", F.lit(0.0))
        new = rank.join(got, F.col("id") == F.col("dst"), "left").select("id", F.col("pagerank").alias("old"), value.alias("pagerank"))
        new = cut(new)
        change = new.agg(F.max(F.abs(F.col("pagerank") - F.col("old")))).first()[0]
        rank = new.select("id", "pagerank")
        if change is None or (max_change >= 0 and change <= max_change):
            break
    return rank


def top_k(scores: DataFrame, k: int, score: str = "pagerank") -> DataFrame:
    return scores.orderBy(F.col(score).desc(), "id").limit(k)


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ``ids(id)``."""
    return edges.join(ids.select(F.col("id").alias("a")), "a", "left_semi").join(ids.select(F.col("id").alias("b")), "b", "left_semi").select(edges.columns)


def triangles(accounts: DataFrame, edges: DataFrame, max_degree: int = 1000) -> DataFrame:
    """(id, triangle_count, clustering_coef) of every account.

    Ends of an edge must be active, that is have a degree of at most ``max_degree``; the third corner
    need not be: a triangle over a hub gives each end of its far edge one credit, and counts are credits div 2.
    An active edge's third corners are what the neighbour lists of its ends share. Lists are at most ``max_degree``
    long; an edge sends that of its end of least (degree, id) to the other end, where both meet by ``array_intersect``.
    So an edge costs one row, whatever the degrees, and no wedge is ever a row.
    """
    both = both_ways(edges).select("src", "dst")
    deg = both.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    d = both.join(deg, "src").withColumnRenamed("deg", "src_deg").join(deg.select(F.col("src").alias("dst"), F.col("deg").alias("dst_deg")), "dst")
    active = F.col("src_deg") <= max_degree
    near = d.where(active).groupBy("src").agg(F.collect_set("dst").alias("near"))
    up = d.where(active & (F.col("dst_deg") <= max_degree) & (F.struct("src_deg", "src") < F.struct("dst_deg", "dst"))).select("src", "dst")
    sent = up.join(near, "src").join(near.select(F.col("src").alias("dst"), F.col("near").alias("other")), "dst")
    hits = sent.select("src", "dst", F.size(F.array_intersect("near", "other")).alias("n")).where("n > 0")
    credit = hits.select(F.explode(F.array("src", "dst")).alias("id"), "n").groupBy("id").agg(F.sum("n").alias("credit"))
    tri = accounts.select("id").join(credit, "id", "left").join(deg.withColumnRenamed("src", "id"), "id", "left")
    n = F.expr("coalesce(credit, 0) div 2")
    return tri.select("id", n.alias("triangle_count"), F.when(F.col("deg") > 1, F.round(2.0 * n / (F.col("deg") * (F.col("deg") - 1)), 6)).otherwise(0.0).alias("clustering_coef"))


LCG_MOD, LCG_MULT, LCG_INC = 2 ** 31 - 1, 1664525, 1013904223  # fixed values of the reference generator


def regions_of(specs: list[str], default: tuple[int, int, float] = (0, 16, 1.0)) -> dict[str, tuple[int, int, float]]:
    """``regions`` of ``fastrp`` from texts "type,length,weight,start"; edges of other types take ``default`` (start, length, weight)."""
    found = {}
    for spec in specs:
        parts = [x.strip() for x in spec.split(",")]
        if len(parts) != 4 or not parts[0]:
            raise ValueError(f"a region is 'type,length,weight,start': {spec!r}")
        if parts[0] in found or parts[0] == "default":
            raise ValueError(f"a type has one region: {parts[0]!r}")
        found[parts[0]] = int(parts[3]), int(parts[1]), float(parts[2])
    return {**found, "default": default}


def weights_of(text: str) -> tuple[float, ...]:
    """Weights of the hops from a text like "1.0,1.0,0.5"."""
    return tuple(float(x) for x in text.split(","))


def fastrp(edges: DataFrame, dim: int = 16, weights: tuple[float, ...] = (1.0, 1.0, 1.0), beta: float = -0.1, sampling: int = 3, seed: int = 42,
           regions: dict[str, tuple[int, int, float]] | None = None, members: DataFrame | None = None) -> DataFrame:
    """(id, i, value): random-projection embeddings in long form.

    Vertices get a dense id by order; each projects a sparse random vector, drawn by a linear congruential
    generator, onto its neighbours. Each hop adds the neighbours' vectors to the own one, divides by
    the degree, normalises, and adds the result by weight; the mean over hops is the embedding.
    ``regions`` (edge type -> start, length, weight) gives edges of a type, column e_type, their own places of the
    vector; "default" stands for the other types, without it they draw nothing. ``members(id)`` scopes all to one component.
    A vertex's vector is one row of ``dim`` sums, so an edge costs one row a hop.
    """
    regions = {"default": (0, dim, 1.0)} if regions is None else regions
    if any(start < 0 or length < 1 or start + length > dim for start, length, _ in regions.values()):
        raise ValueError("regions must lie within the embedding")
    kind = F.col("e_type") if "e_type" in edges.columns else F.lit("default")
    e = edges.withColumn("weight", kind)
    e = both_ways(induced(e, members) if members is not None else e).select("src", "dst", F.col("weight").alias("e_type"))
    deg = e.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    vid = numbered(deg, [F.col("src")], "vid").withColumn("vid", F.col("vid") + 1)
    m = deg.agg(F.sum("deg").alias("m"))
    base = vid.join(F.broadcast(m)).withColumn("inc", F.col("vid") + LCG_INC).withColumn("r0", (F.col("inc") + LCG_MULT * F.lit(seed)) % LCG_MOD)
    step = lambda rs, _: F.concat(rs, F.array((F.element_at(rs, -1) * LCG_MULT + F.col("inc")) % LCG_MOD))
    longest = max(length for _, length, _ in regions.values())
    base = base.withColumn("draw", F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(longest)), F.array("r0"), step), 2, longest))
    unit = F.pow(F.col("deg") / F.col("m"), F.lit(beta)) * F.sqrt(F.lit(float(sampling)))
    sign = F.transform("draw", lambda r: F.when(r / LCG_MOD <= 1 / (2 * sampling), unit).when(r / LCG_MOD <= 1 / sampling, -unit).otherwise(F.lit(0.0)))
    base = base.select("src", sign.alias("draw"))
    e = messages(e)
    sums = lambda v: F.array(*(F.sum(v[i]) for i in range(dim))).alias("val")

    def placed(start: int, length: int, weight: float):
        zeros = lambda n: F.array_repeat(F.lit(0.0), n)
        return F.concat(zeros(start), F.transform(F.slice("draw", 1, length), lambda x: x * weight), zeros(dim - start - length))

    first = F.array_repeat(F.lit(0.0), dim) if "default" not in regions else placed(*regions["default"])
    for name, region in regions.items():
        first = F.when(F.col("e_type") == name, placed(*region)).otherwise(first) if name != "default" else first
    own = cut(e.sent(base, "src").select("dst", first.alias("v")).groupBy(F.col("dst").alias("id")).agg(sums(F.col("v"))))
    total = None
    for w in weights:
        got = e.sent(own).select(F.col("dst").alias("id"), "val").unionAll(own.select("id", "val"))
        mean = got.groupBy("id").agg(sums(F.col("val"))).join(deg.withColumnRenamed("src", "id"), "id")
        mean = mean.select("id", F.transform("val", lambda x: x / F.greatest(F.lit(1), F.col("deg"))).alias("val"))
        norm = F.sqrt(F.aggregate("val", F.lit(0.0), lambda a, x: a + x * x))
        own = cut(mean.withColumn("norm", norm).select("id", F.when(F.col("norm") > 0, F.transform("val", lambda x: x / F.col("norm"))).otherwise(F.col("val")).alias("val")))
        part = own.select("id", F.transform("val", lambda x: x * (w / len(weights))).alias("v"))
        total = part if total is None else total.join(part.withColumnRenamed("v", "u"), "id").select("id", F.zip_with("v", "u", lambda a, b: a + b).alias("v"))
    return total.select("id", F.posexplode("v").alias("i", "value"))
