"""Mixing sources to target weights by hierarchical budgeting (operator 6).

Documents are leaves' stock in a tree domain / language / source. A token budget flows from the root:
each node divides what it gets among its children by weight, no child getting more than its whole
subtree can give (tokens times ``max_epochs``); what a child cannot take goes to its siblings by weight
and only beyond their stock back to the parent's siblings. Each leaf then takes whole seeded epochs and
a token-prefix of one more: documents in the order md5(seed | epoch | doc_id), while the tokens before
them are less than what the leaf still owes.

A leaf's order is cut by the first two hex digits of the key; sums per piece are pre-aggregated, and only
the one piece in which the prefix ends is ordered, all leaves' together in range-partitioned stretches, so
neither a leaf with a third of all rows nor a key with many is a hot spot. Its last document, one row for
each leaf, is the bound up to which every row of the leaf is taken: texts are never shuffled.
Everything is DataFrame functions. Budgets are whole tokens; shares are rounded to 1e-6 before the floor.

Defined results: a token is a space-separated piece of the text, null and empty texts have none; null
lang or source counts as 'unknown'; documents of equal key are ordered by doc_id, then by text hash; null
doc_ids come first; repeated rows count as often as they stand; extra columns are carried along; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import BROADCAST_MB, cut, measured_mb
from ledgerloom.plans.ordered import running

LEVELS = ["_domain", "_lang", "_source"]
FRACTION, MAX_EPOCHS, SEED = 0.8, 2, 17
PIECE_DIGITS = 2
WEIGHTS = {"web": 3.0, "forum": 1.0, "curated": 2.0, "*/en": 4.0, "*/de": 1.5}  # by path or by "*/language"; others 1


def domain_of(source) -> F.Column:
    """Default domains: sources dealt out by the first hex digit of their md5."""
    digit = F.substring(F.md5(source.cast("binary")), 1, 1)
    return F.when(digit < "8", "web").when(digit < "c", "forum").otherwise("curated")


def n_tokens(text) -> F.Column:
    full = F.coalesce(text, F.lit(""))
    return F.when(full == "", 0).otherwise(F.octet_length(full) - F.octet_length(F.replace(full, F.lit(" "), F.lit(""))) + 1).cast("long")


def _tree(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` as one, ``row``, whatever they are called, and the operator's own beside it."""
    source = F.coalesce(docs["source"], F.lit("unknown"))
    own = {"_domain": domain_of(source), "_lang": F.coalesce(docs["lang"], F.lit("unknown")), "_source": source,
           "_t": n_tokens(docs["text"]), "_mark": F.xxhash64(docs["text"]), "doc_id": docs["doc_id"]}
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *(c.alias(k) for k, c in own.items()))


def _weight(level: int, weights: dict[str, float]) -> F.Column:
    path = F.concat_ws("/", *LEVELS[:level + 1])
    w = F.lit(1.0)
    for k, v in weights.items():
        hit = (F.col(LEVELS[level]) == k[2:]) if k.startswith("*/") and level == 1 else (path == k) if not k.startswith("*/") else F.lit(False)
        w = F.when(hit, F.lit(float(v))).otherwise(w)
    return w


def budgets(leaves: DataFrame, fraction: float, max_epochs: int, weights: dict[str, float]) -> DataFrame:
    """``leaves(_domain, _lang, _source, t)`` with the tokens each is to give, ``_due``.

    At each node the level L with sum(min(stock, L * weight)) = budget is found in one ordered pass: a
    child is exhausted if its stock per weight is at most the level reached without it and those before it.
    """
    up = leaves.agg(F.floor(F.coalesce(F.sum("t"), F.lit(0)) * F.lit(fraction)).cast("double").alias("b")).withColumn("one", F.lit(1))
    keys = ["one"]
    at = leaves.withColumn("one", F.lit(1))
    for level in range(3):
        here = ["one", *LEVELS[:level + 1]]
        nodes = at.groupBy(here).agg((F.sum("t") * max_epochs).cast("double").alias("c")).withColumn("w", _weight(level, weights))
        nodes = nodes.join(up, keys).withColumn("r", F.col("c") / F.col("w"))
        order = Window.partitionBy(keys).orderBy("r", LEVELS[level])
        before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(keys)
        lam = (F.col("b") - F.coalesce(F.sum("c").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        nodes = nodes.withColumn("lam", lam).withColumn("done", F.col("r") <= F.col("lam"))
        free = F.max(F.when(~F.col("done"), F.col("lam"))).over(whole)  # the level falls behind the first child that is not exhausted
        up = nodes.select(*here, F.when(F.col("done"), F.col("c")).otherwise(F.col("w") * free).alias("b"))
        keys = here
    return up.select(*LEVELS, F.floor(F.round("b", 6)).cast("long").alias("_due"))


def _chosen(docs: DataFrame, fraction: float, max_epochs: int, seed: int, weights: dict[str, float]) -> DataFrame:
    d = _tree(docs)
    leaves = cut(d.groupBy(LEVELS).agg(F.sum("_t").alias("t")))
    due = budgets(leaves, fraction, max_epochs, weights).join(leaves, LEVELS)
    full = F.when(F.col("t") > 0, F.least(F.expr("_due div t"), F.lit(max_epochs).cast("long"))).otherwise(F.lit(0).cast("long"))
    due = due.withColumn("_full", full).withColumn("_rest", F.when(F.col("_full") < max_epochs, F.col("_due") - F.col("_full") * F.col("t")).otherwise(0)).drop("t", "_due")
    due = cut(due)
    small = measured_mb(due, F.lit(128)) < BROADCAST_MB
    hint = F.broadcast if small else (lambda x: x)
    d = d.join(hint(due), LEVELS)
    d = d.withColumn("_key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
    d = d.withColumn("_piece", F.substring("_key", 1, PIECE_DIGITS))
    sums = d.where("_rest > 0").groupBy(*LEVELS, "_piece", "_rest").agg(F.sum("_t").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy(LEVELS).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = sums.withColumn("_before", before).where("_before < _rest").groupBy(LEVELS).agg(F.max(F.struct("_piece", "_before")).alias("m"))
    last = cut(last.select(*LEVELS, F.col("m._piece").alias("_last"), F.col("m._before").alias("_before")))
    place = ["_key", "doc_id", "_mark"]
    edge = d.join(hint(last), LEVELS).where("_piece = _last").groupBy(*LEVELS, *place, "_rest", "_before").agg(F.sum("_t").alias("_t"))
    edge = cut(running(edge, [*LEVELS, *place], {"_sum": F.col("_t")}).withColumn("_sum", F.col("_sum") - F.col("_t")))
    start = edge.groupBy(LEVELS).agg(F.min("_sum").alias("_start"))
    edge = edge.join(hint(start), LEVELS).where("_before + _sum - _start < _rest")
    bound = cut(edge.groupBy(LEVELS).agg(F.max(F.struct(*place)).alias("_bound")))
    d = d.join(hint(bound), LEVELS, "left")
    part = F.when(F.struct(*place) <= F.col("_bound"), 1).otherwise(0)
    return d.withColumn("_copies", F.col("_full") + part)


def mix(docs: DataFrame, fraction: float = FRACTION, max_epochs: int = MAX_EPOCHS, seed: int = SEED, weights: dict[str, float] | None = None) -> DataFrame:
    """Rows of ``docs`` that are taken, with n_tokens and n_copies (how many epochs take them) beside their columns."""
    d = _chosen(docs, fraction, max_epochs, seed, WEIGHTS if weights is None else weights).where("_copies > 0")
    keep = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_tokens", "n_copies")]
    return d.select(*keep, F.col("_t").alias("n_tokens"), F.col("_copies").cast("long").alias("n_copies"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, n_copies) of every row that is taken."""
    d = _chosen(docs.select("doc_id", "text", "lang", "source"), FRACTION, MAX_EPOCHS, SEED, WEIGHTS).where("_copies > 0")
    return d.select("doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"),
                    F.col("_t").alias("n_tokens"), F.col("_copies").cast("long").alias("n_copies"))
