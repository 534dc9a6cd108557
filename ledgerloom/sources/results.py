"""Results of graph queries as they come back: JSON lists of blocks, whose shapes differ from block to block.

Blocks are read as VARIANT, so a result is parsed once, whatever its blocks hold, and attributes of any type are
taken from it by path. Malformed parts that the format forbids are errors when the rows are read; parts it
tells to skip (blocks that are no objects, edges without an end) are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The blocks of a sampler's result and the node types they hold.
ID_BLOCKS = {"account_ids": "Account", "party_ids": "Party", "entity_ids": "Resolved_Entity"}


def _parsed(results: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, blocks array<variant>) of every result; a result that is no list is an error."""
    d = results.select(*keys, F.parse_json(column).alias("result"))
    kind = F.schema_of_variant("result")
    bad = F.raise_error(F.concat(F.lit("a result is no list: "), kind)).cast("array<variant>")
    return d.select(*keys, F.when(kind.startswith("ARRAY"), F.variant_get("result", "$", "array<variant>")).otherwise(bad).alias("blocks"))


def _blocks(results: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """(keys, block variant): the blocks of every result."""
    return _parsed(results, column, keys).select(*keys, F.explode("blocks").alias("block"))


def _items(blocks: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """(keys, item variant, pos) of the list at ``path`` of each block; blocks without such a list have none."""
    d = blocks.withColumn("list", F.try_variant_get("block", path, "variant"))
    d = d.where("list IS NOT NULL AND startswith(schema_of_variant(list), 'ARRAY')")
    return d.lateralJoin(d.sparkSession.tvf.variant_explode(F.col("list").outer())).select(*keys, F.col("value").alias("item"), "pos")


def _text(item: str, path: str):
    return F.try_variant_get(item, path, "string")


def sampled(results: DataFrame, column: str = "json", keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Neighbourhoods: ((keys, node_type, id, place), (keys, from_id, to_id, e_type)) of a sampler's results.

    Ids keep their place in their block. Blocks of other names, and edges that lack an end or their type, are skipped.
    """
    keys = list(keys)
    blocks = _blocks(results, column, keys)
    nodes = None
    for name, kind in ID_BLOCKS.items():
        d = _items(blocks, f"$.{name}", keys).select(*keys, F.lit(kind).alias("node_type"), _text("item", "$").alias("id"), F.col("pos").alias("place"))
        nodes = d if nodes is None else nodes.unionAll(d)
    ends = [_text("item", f"$.{c}").alias(c) for c in ("from_id", "to_id", "e_type")]
    edges = _items(blocks, "$.edges", keys).select(*keys, *ends).dropna(subset=["from_id", "to_id", "e_type"])
    return nodes, edges


def _one_block(results: DataFrame, column: str, name: str, keys: list[str]) -> DataFrame:
    """(keys, item) of the block called ``name`` of each result; a result without it, or whose block is no list, is an error."""
    d = _parsed(results, column, keys).withColumn("block", F.get(F.filter("blocks", lambda x: F.try_variant_get(x, f"$.{name}", "variant").isNotNull()), F.lit(0)))
    d = d.withColumn("list", F.try_variant_get("block", f"$.{name}", "variant"))
    kind = F.coalesce(F.schema_of_variant("list"), F.lit("none"))
    bad = F.raise_error(F.concat(F.lit(f"no list '{name}' in a result: "), kind)).cast("array<variant>")
    return d.select(*keys, F.explode(F.when(kind.startswith("ARRAY"), F.variant_get("list", "$", "array<variant>")).otherwise(bad)).alias("item"))


def _typed(item: str, path: str, kind: str, what: str):
    """A number at ``path``: whole where it should be, never true or false; a missing one is an error."""
    value, found = F.try_variant_get(item, path, kind), F.schema_of_variant(F.try_variant_get(item, path, "variant"))
    double = F.try_variant_get(item, path, "double")
    fits = (found != "BOOLEAN") & (found != "VOID") & ((F.lit(kind) == "double") | (double == F.floor(double)))
    bad = F.raise_error(F.concat(F.lit(f"{what} is no {kind}: "), F.coalesce(found, F.lit("missing")))).cast(kind)
    return F.when(fits & double.isNotNull(), F.coalesce(value, double.cast(kind))).otherwise(bad)


def fetched_accounts(results: DataFrame, attributes: dict[str, str], column: str = "json", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, id, attributes) of the accounts that a fetch returns as {"Accounts": [{"v_id", "attributes"}]}."""
    items = _one_block(results, column, "Accounts", list(keys))
    lost = F.raise_error(F.lit("an account has no v_id")).cast("string")
    return items.select(*keys, F.coalesce(_text("item", "$.v_id"), lost).alias("id"),
                        *(_typed("item", f"$.attributes.{c}", k, c).alias(c) for c, k in attributes.items()))


def fetched_edges(results: DataFrame, attributes: dict[str, str], column: str = "json", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, from_id, to_id, attributes) of payment edges, nested under their sources as
    {"Collected": [{"attributes": {"out_edges": [...]}}]}; a source without that list is an error."""
    items = _one_block(results, column, "Collected", list(keys))
    d = items.withColumn("list", F.try_variant_get("item", "$.attributes.out_edges", "variant"))
    kind = F.coalesce(F.schema_of_variant("list"), F.lit("none"))
    bad = F.raise_error(F.concat(F.lit("'out_edges' is no list: "), kind)).cast("variant")
    d = d.withColumn("list", F.when(kind.startswith("ARRAY"), F.col("list")).otherwise(bad))
    e = d.lateralJoin(d.sparkSession.tvf.variant_explode(F.col("list").outer())).select(*keys, F.col("value").alias("edge"))
    lost = F.raise_error(F.lit("an edge lacks an end")).cast("string")
    return e.select(*keys, *(F.coalesce(_text("edge", f"$.{c}"), lost).alias(c) for c in ("from_id", "to_id")),
                    *(_typed("edge", f"$.attributes.{c}", k, c).alias(c) for c, k in attributes.items()))


def seeds(results: DataFrame, column: str = "json", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, id, pu_label) of a split's accounts, {"result": [{"attributes": {"account_id", "pu_label"}}]}.

    Blocks of other names and vertices without attributes are skipped; attributes without an id or label are an error.
    """
    items = _items(_blocks(results, column, list(keys)), "$.result", list(keys))
    items = items.withColumn("own", F.try_variant_get("item", "$.attributes", "variant")).where("startswith(schema_of_variant(own), 'OBJECT')")
    lost = F.raise_error(F.lit("a seed has no account_id")).cast("string")
    return items.select(*keys, F.coalesce(_text("own", "$.account_id"), lost).alias("id"), _typed("own", "$.pu_label", "int", "pu_label").alias("pu_label"))
