"""Neighbourhood sampling, local ids and training batches. Random choices are md5 orders, the same in any engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import shuffle_key
from ledgerloom.plans.fixpoint import cut
from ledgerloom.plans.ordered import numbered

# Default fan-outs of the two rounds.
FANOUTS = {"HAS_PAID": (15, 5), "Account_Account": (10, 5), "Account_Party": (5, 3), "Party_Entity": (5, 3), "Entity_Party": (10, 5), "Party_Account": (10, 5)}
TYPES = {"HAS_PAID": ("Account", "Account"), "Account_Account": ("Account", "Account"), "Account_Party": ("Account", "Party"),
         "Party_Entity": ("Party", "Entity"), "Entity_Party": ("Entity", "Party"), "Party_Account": ("Party", "Account")}


def check_fanouts(fanouts: dict[str, tuple[int, int]]) -> None:
    if set(fanouts) != set(TYPES):
        raise ValueError(f"fan-outs are needed for exactly {sorted(TYPES)}")
    for k, (one, two) in fanouts.items():
        if one < 1 or two < 1 or two > one:
            raise ValueError(f"{k}: fan-outs must be positive and the second at most the first")


def relations(flows: DataFrame, edges: DataFrame, owners: DataFrame, entities: DataFrame) -> dict[str, DataFrame]:
    """Edges by type as (from_id, to_id)."""
    pair = lambda d, a, b: d.select(F.col(a).alias("from_id"), F.col(b).alias("to_id")).distinct()
    return {"HAS_PAID": pair(flows, "src", "dst"), "Account_Account": pair(edges, "a", "b").unionAll(pair(edges, "b", "a")).distinct(),
            "Account_Party": pair(owners, "account", "party"), "Party_Entity": pair(entities, "party", "entity"),
            "Entity_Party": pair(entities, "entity", "party"), "Party_Account": pair(owners, "party", "account")}


BATCH = "batch_id"


def _keys(d: DataFrame) -> list[str]:
    return [BATCH] if BATCH in d.columns else []


def _step(frontier: DataFrame, edges: DataFrame, kind: str, n: int, seed: int, gate: DataFrame | None, gate_first: bool) -> DataFrame:
    """At most ``n`` sampled edges of each frontier vertex; the gate removes targets after (or before) the draw.

    A vertex is drawn for once, however many batches reach it.
    """
    e = edges
    if gate is not None and gate_first:
        e = e.join(gate.select(F.col("id").alias("to_id")), "to_id", "left_anti").select("from_id", "to_id")
    at = frontier.withColumnRenamed("id", "from_id")
    e = e.join(at.select("from_id").distinct(), "from_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("from_id").orderBy(shuffle_key(seed, F.lit(kind), "from_id", "to_id"), "to_id"))
    e = e.withColumn("r", rank).where(F.col("r") <= n)
    if gate is not None and not gate_first:
        e = e.join(gate.select(F.col("id").alias("to_id")), "to_id", "left_anti")
    if keys := _keys(frontier):
        e = e.join(at, "from_id")
    return e.select(*keys, "from_id", "to_id", F.lit(kind).alias("e_type"))


def khop(seeds: DataFrame, rel: dict[str, DataFrame], fanouts: dict[str, tuple[int, int]] = FANOUTS, seed: int = 7, gated: DataFrame | None = None, gate_first: bool = False) -> DataFrame:
    """([batch_id,] from_id, to_id, e_type): two rounds from ``seeds([batch_id,] id)``; ``gated(id)`` are accounts that may not be reached.

    With batch_id all batches are sampled at once; give each epoch another ``seed`` for other draws.
    """
    check_fanouts(fanouts)
    keys, gated = _keys(seeds), None if gated is None else cut(gated)  # read by every step
    out, frontier = None, seeds.select(*keys, "id").distinct()
    for r in range(2):
        step = lambda f, k: _step(f, rel[k], k, fanouts[k][r], seed, gated if TYPES[k][1] == "Account" else None, gate_first)
        ids = lambda d: d.select(*keys, F.col("to_id").alias("id")).distinct()
        paid, sim, party = step(frontier, "HAS_PAID"), step(frontier, "Account_Account"), cut(step(frontier, "Account_Party"))
        entity = step(ids(party), "Party_Entity")
        peers = cut(step(ids(entity), "Entity_Party"))
        acct = step(ids(peers), "Party_Account")
        # a round is read by the next one and by the result: materialised once
        done = cut(paid.unionAll(sim).unionAll(party).unionAll(entity).unionAll(peers).unionAll(acct))
        out = done if out is None else out.unionAll(done)
        frontier = ids(done.where(F.col("e_type").isin("HAS_PAID", "Account_Account", "Party_Account")))
    return out.distinct()


def _kind_of(end: int):
    """Node type at an end of an edge; an unknown edge type is an error."""
    known = F.create_map(*(x for k, v in TYPES.items() for x in (F.lit(k), F.lit(v[end]))))
    return F.coalesce(F.try_element_at(known, F.col("e_type")), F.raise_error(F.concat(F.lit("unknown edge type "), F.coalesce("e_type", F.lit("null")))))


def khop_nodes(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """([batch_id,] node_type, id): all vertices of a sampled neighbourhood, seeds included."""
    keys = _keys(edges)
    ends = edges.select(*keys, F.explode_outer(F.array(F.struct(_kind_of(0).alias("node_type"), F.col("from_id").alias("id")), F.struct(_kind_of(1).alias("node_type"), F.col("to_id").alias("id")))).alias("n")).select(*keys, "n.*")
    return ends.unionAll(seeds.select(*keys, F.lit("Account").alias("node_type"), "id")).distinct()


def inbatch_edges(flows: DataFrame, ids: DataFrame) -> DataFrame:
    """Flow edges with both ends in the id set, or in the id set of one batch (then with its batch_id)."""
    keys = _keys(ids)
    one = ids.select(*keys, "id").distinct()
    d = flows.join(one.withColumnRenamed("id", "src"), "src") if keys else flows.join(one.withColumnRenamed("id", "src"), "src", "left_semi")
    return d.join(one.withColumnRenamed("id", "dst"), [*keys, "dst"], "left_semi").select(*keys, *flows.columns)


def local_index(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """([batch_id,] node_type, id, local_id): contiguous per batch and type, seeds first in their order, the others by id.

    ``seeds([batch_id,] id[, slot])``: the order is slot, else id; a seed that stands twice has its first place, one that
    is not among the nodes has none. An id that stands twice among the nodes of a type is an error. Without batches
    places are counted in stretches of one order, so no task holds all nodes of a type.
    """
    keys = _keys(nodes)
    s = seeds.groupBy(*keys, "id").agg(F.min("slot" if "slot" in seeds.columns else "id").alias("_slot")).withColumn("node_type", F.lit("Account"))
    twice = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate node id "), F.col("id").cast("string")))).otherwise(F.col("id"))
    d = nodes.groupBy(*keys, "node_type", "id").agg(F.count(F.lit(1)).alias("_n")).withColumn("id", twice.cast(nodes.schema["id"].dataType)).drop("_n")
    d = d.join(s, [*keys, "node_type", "id"], "left").select(*keys, "node_type", "id", F.when(F.col("_slot").isNull(), 1).otherwise(0).alias("_last"), "_slot")
    order = ["_last", "_slot", "id"]
    if keys:
        place = F.row_number().over(Window.partitionBy(*keys, "node_type").orderBy(*order)) - 1
        return d.select(*keys, "node_type", "id", place.cast("long").alias("local_id"))
    d = cut(numbered(d, [F.col(c) for c in ("node_type", *order)], "_r"))
    base = d.groupBy("node_type").agg(F.min("_r").alias("_base"))
    return d.join(F.broadcast(base), "node_type").select("node_type", "id", (F.col("_r") - F.col("_base")).alias("local_id"))


def local_edges(edges: DataFrame, index: DataFrame) -> DataFrame:
    """([batch_id,] e_type, row, col): edges in local ids; an unknown type or an end that is not among the nodes is an error."""
    keys = _keys(edges)
    for end, key, name in ((0, "from_id", "row"), (1, "to_id", "col")):
        edges = edges.withColumn("node_type", _kind_of(end)).join(index.select(*keys, "node_type", F.col("id").alias(key), F.col("local_id").alias(name)), [*keys, "node_type", key], "left").drop("node_type")
    bad = F.raise_error(F.lit("an edge has an end that is not among the nodes"))
    return edges.select(*keys, "e_type", F.coalesce("row", bad.cast("long")).alias("row"), F.coalesce("col", bad.cast("long")).alias("col"))


def epoch_batches(labels: DataFrame, batch_size: int = 16, positives: int = 2, seed: int = 5, epoch: int = 0) -> DataFrame:
    """(batch, id, slot): every unlabelled account once, ``positives`` drawn with replacement for each batch.

    ``labels(id, pu_label)``. The order is a hash; places in it are counted in stretches.
    """
    if positives < 1 or positives >= batch_size:
        raise ValueError("positives must be at least 1 and less than the batch size")
    d = labels.withColumn("key", shuffle_key(f"{seed}|{epoch}", "id"))
    rest, pos = d.where("pu_label = 0"), d.where("pu_label = 1")
    if pos.isEmpty():
        raise ValueError("there is no positive account to draw")
    room = batch_size - positives
    un = numbered(rest.select("id", "key"), [F.col("key"), F.col("id")], "r").select(F.expr(f"cast(r div {room} as bigint)").alias("batch"), "id", F.expr(f"cast(r % {room} + {positives} as int)").alias("slot"))
    p = numbered(pos.select("id", "key"), [F.col("key"), F.col("id")], "r").select("id", "r")
    n = pos.agg(F.count(F.lit(1)).alias("n"))
    want = un.select("batch").distinct().select("batch", F.explode(F.sequence(F.lit(0), F.lit(positives - 1))).alias("slot")).join(F.broadcast(n))
    draw = F.conv(F.substring(shuffle_key(f"{seed}|{epoch}", "batch", "slot"), 1, 8), 16, 10).cast("long") % F.col("n")
    return un.unionByName(want.where("n > 0").withColumn("r", draw).join(p, "r").select("batch", "id", "slot"))


def class_prior(n_accounts: int, estimated: int) -> float:
    """Share of positives that the loss assumes: an estimate of their number over all accounts, within (0, 1)."""
    if not 1 <= estimated < n_accounts:
        raise ValueError(f"the estimate {estimated} must be at least 1 and less than the {n_accounts} accounts")
    return estimated / n_accounts


def prior_of(masked: DataFrame) -> DataFrame:
    """(prior) of ``masked(is_mule)``: the masks' own share of positives; one that is not within (0, 1) is an error when it is read."""
    n, p = F.count(F.lit(1)), F.coalesce(F.sum("is_mule"), F.lit(0))
    bad = F.raise_error(F.concat(F.lit("the prior is not within (0, 1): "), p.cast("string"), F.lit(" of "), n.cast("string"))).cast("double")
    return masked.agg(F.when((p >= 1) & (p < n), p / n).otherwise(bad).alias("prior"))


def validation_sample(labels: DataFrame, cap: int = 10_000, seed: int = 5) -> DataFrame:
    """(id, pu_label): all positives and at most ``cap`` unlabelled accounts, a seeded draw by a bounded top-n."""
    rest = labels.where("pu_label = 0").select("id", "pu_label", shuffle_key(seed, F.lit("val"), "id").alias("_key")).orderBy("_key", "id").limit(cap)
    return labels.where("pu_label = 1").select("id", "pu_label").unionAll(rest.select("id", "pu_label"))
