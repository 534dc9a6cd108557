"""Merkle manifest of a dataset (operator 11).

Every row is a leaf, the rows of a language are a tree in the order of doc_id, and the trees' roots in
the order of their languages are one more tree. Leaves are numbered in range-partitioned stretches and
laid in blocks of ``BLOCK`` places. One SQL expression with higher-order functions collapses ``DEPTH``
levels of a block (``sequence``, ``transform``, ``slice``, ``aggregate``); the roots of the blocks are
the nodes of the next round, until every tree has one node. Then the rounds are walked back: a block
gets the path of its root once, by a join of blocks and not of leaves, and its nodes put their own
siblings before it. No task holds more than a block, whatever the size of a language.

Defined results: a null field is ``-``, any other its count of UTF-8 bytes, ``:`` and its text; null
languages are a tree of their own, the first; null doc_ids come first and are never tampered with; rows
of equal doc_id are ordered by their leaf, so equal rows have equal places; extra columns are ignored;
an empty table gives an empty manifest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import BROADCAST_MB, cut, lower_ascii, measured_mb
from ledgerloom.plans.ordered import numbered

FAN, DEPTH = 8, 3  # children of a node; levels that a block collapses
BLOCK = FAN ** DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SIBLINGS = "array<struct<left:string,right:string>>"


def hashed(*parts) -> F.Column:
    """Lower-case hex sha256 of the parts one after another; digests go in as hex text."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value) -> F.Column:
    """A value with its length in front, so that no two rows give the same bytes."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(docs: DataFrame, **instead) -> F.Column:
    """The leaf of a row; ``instead`` gives other columns for some of its fields."""
    return hashed(*(field(instead.get(c, docs[c])) for c in FIELDS))


def is_tampered(doc_id) -> F.Column:
    """The third of rows whose text the query lower-cases behind the manifest's back."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def _tree_of(lang) -> F.Column:
    """A key that orders like the language, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def _placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with pos (0, 1, ... in their tree) and total (nodes of the tree)."""
    at = cut(numbered(nodes, ["tree", *order], "at"))
    trees = cut(at.groupBy("tree").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("total")))
    if measured_mb(trees, F.octet_length("tree") + 32) < BROADCAST_MB:
        trees = F.broadcast(trees)
    return at.join(trees, "tree").withColumn("pos", F.col("at") - F.col("first")).drop("at", "first")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(tree, block, total, height, items, levels) of ``nodes(tree, pos, total, h, ...)``.

    A tree that fits one block stops at one node; where there are more blocks, each goes up DEPTH levels.
    """
    kept = [c for c in nodes.columns if c not in ("tree", "total")]
    d = nodes.groupBy("tree", "total", F.floor(F.col("pos") / BLOCK).alias("block"))
    d = d.agg(F.sort_array(F.collect_list(F.struct("pos", *(c for c in kept if c != "pos")))).alias("items"))
    height = F.lit(DEPTH)
    for k in range(DEPTH - 1, -1, -1):
        height = F.when(F.col("total") <= FAN ** k, k).otherwise(height)
    d = d.withColumn("height", height)
    up = f"""
        aggregate(slice(sequence(1, {DEPTH}), 1, height), array(transform(items, x -> x.h)), (below, level) ->
          concat(below, array(transform(sequence(0, cast((size(element_at(below, -1)) - 1) div {FAN} as int)), run ->
            sha2(array_join(slice(element_at(below, -1), run * {FAN} + 1, {FAN}), ''), 256)))))"""
    return cut(d.withColumn("levels", F.expr(up)))


def _root(name: str) -> F.Column:
    return F.expr("element_at(element_at(levels, -1), 1)").alias(name)


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """The blocks of every round, the last of which has one block for each tree."""
    found = [_blocks(nodes)]
    while (found[-1].agg(F.max("total")).first()[0] or 0) > BLOCK:
        at = found[-1]
        found.append(_blocks(at.select("tree", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).alias("total"), _root("h"))))
    return found


def _unfolded(rounds: list[DataFrame]) -> DataFrame:
    """(tree, top, item, path) of every node of the first round: its tree's root, and its siblings from below."""
    powers = f"array({', '.join(str(FAN ** k) for k in range(DEPTH + 1))})"
    place = f"cast(i div {powers}[level] as int) % {FAN}"
    run = f"slice(levels[level], cast(i div {powers}[level + 1] as int) * {FAN} + 1, {FAN})"
    own = f"""
        transform(items, (item, i) -> named_struct('item', item, 'path', transform(
          slice(sequence(0, {DEPTH - 1}), 1, height), level -> named_struct(
            'left', array_join(slice({run}, 1, {place}), ''), 'right', array_join(slice({run}, {place} + 2, {FAN}), '')))))"""
    top = rounds[-1].select("tree", "block", _root("top"), F.array().cast(SIBLINGS).alias("up"))
    for blocks in reversed(rounds):
        d = blocks.withColumn("own", F.expr(own)).select("tree", "block", "own").join(top, ["tree", "block"])
        d = d.select("tree", "top", "up", F.explode("own").alias("x"))
        d = d.select("tree", "top", F.col("x.item").alias("item"), F.concat("x.path", "up").alias("path"))
        top = d.select("tree", F.col("item.pos").alias("block"), "top", F.col("path").alias("up"))
    return d


def proof(path: str) -> F.Column:
    """Hash of all siblings of a path, level by level, left to right."""
    return F.sha2(F.expr(f"array_join(transform({path}, p -> concat(p.left, p.right)), '')").cast("binary"), 256)


def folded(start: str, path: str) -> F.Column:
    """The root that a node and the siblings on its path give."""
    return F.expr(f"aggregate({path}, {start}, (h, p) -> sha2(concat(p.left, h, p.right), 256))")


def manifest(docs: DataFrame, tampered=None) -> DataFrame:
    """(doc_id, lang, leaf, subroot, root, path, claimed) of every row.

    ``path`` is an array of (left, right) siblings from the leaf to the root; ``claimed`` is the leaf of the row
    with ``tampered`` (a column) for its text where that is given and not null, else the leaf itself.
    """
    changed = F.lit(None).cast("string") if tampered is None else tampered
    claimed = F.when(changed.isNotNull(), leaf_of(docs, text=changed))
    leaves = docs.select(_tree_of(docs["lang"]).alias("tree"), "doc_id", "lang", leaf_of(docs).alias("h"), claimed.alias("other"))
    leaves = _placed(cut(leaves), ["doc_id", "h"])
    own = _rounds(leaves)
    subroots = own[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), _root("h"))
    above = _unfolded(_rounds(_placed(subroots, ["of"])))
    above = cut(above.select(F.col("item.of").alias("tree"), F.col("top").alias("root"), F.col("path").alias("above")))
    if measured_mb(above, F.octet_length("tree") + F.size("above") * FAN * 64 + 128) < BROADCAST_MB:
        above = F.broadcast(above)
    d = _unfolded(own).join(above, "tree")
    return d.select("item.doc_id", "item.lang", F.col("item.h").alias("leaf"), F.col("top").alias("subroot"), "root",
                    F.concat("path", "above").alias("path"), F.coalesce("item.other", "item.h").alias("claimed"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) with a third of the texts lower-cased."""
    d = manifest(docs, F.when(is_tampered(docs["doc_id"]), lower_ascii(docs["text"])))
    d = d.select("doc_id", "leaf", "subroot", "root", proof("path").alias("proof_sha256"), folded("claimed", "path").alias("folded_root"))
    return d.withColumn("verified", F.col("folded_root") == F.col("root"))
