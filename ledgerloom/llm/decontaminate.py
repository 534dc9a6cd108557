"""Benchmark decontamination by a prefix-filtered set join (operator 1), in DataFrame functions only.

A window is ``window`` consecutive words of an item (a shorter item is one window). A document holds
a window only if it holds all of the window's shingles, so one shingle is a sufficient prefix: the
one rarest over all documents. Documents meet windows on that shingle; the shingle's offset gives the
only possible place (positional bound), which must lie within the document (length bound), and there
the words are compared exactly. Windows with a shingle that no document holds are dropped before.

The window index is broadcast only when measured to be small; a larger one is joined by shuffle.
Words: runs of non-ASCII characters, digits and letters after lower-casing A-Z.

Defined results: rows with equal (doc_id, text) count once, rows with the same doc_id but other
texts are separate documents; null text or item text has no words; a null item_id is no item
(its windows still hit); item_ids may be of any type; an empty benchmark hits nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import BROADCAST_MB, cut, lower_ascii, measured_mb, without

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what separates words, after lower-casing
SHINGLE = 3
END = ""  # stands behind the last word of every document; no word is empty
END_KEY = 0


def words(text) -> F.Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def shingle(array, at, size: int) -> F.Column:
    return F.xxhash64(F.lit(size), *(F.get(array, at + i) for i in range(size)))


def windows_of(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct windows: (w words, k their number, items ids that hold them, g shingle size)."""
    items = benchmark.select("item_id", words(F.col("text")).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - window + 1, F.lit(1)))
    at = items.select("item_id", "all", F.explode(starts).alias("at"))
    at = at.select("item_id", F.slice("all", F.col("at"), window).alias("w"))
    return at.groupBy("w").agg(F.collect_set("item_id").alias("items")).select(
        "w", F.size("w").alias("k"), "items", F.least(F.lit(SHINGLE), F.size("w")).alias("g"))


def _window_shingles(wins: DataFrame) -> DataFrame:
    at = wins.select("w", "k", "items", "g", F.explode(F.sequence(F.lit(0), F.col("k") - F.col("g"))).alias("j"))
    key = F.when(F.col("g") == 1, shingle("w", F.col("j"), 1)).when(F.col("g") == 2, shingle("w", F.col("j"), 2)).otherwise(shingle("w", F.col("j"), 3))
    return at.withColumn("key", key)


def _places(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """Every word place of every document with its shingle's key, and one place behind the last word."""
    d = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.concat(words(F.col("text")), F.array(F.lit(END))).alias("all"))
    # the outer form: for the inner one the optimizer infers a filter that would split every text twice
    d = d.select("doc_id", "mark", "all", F.posexplode_outer("all").alias("pos", "word"))
    keys = [shingle("all", F.col("pos"), g) for g in sizes] or [F.lit(END_KEY).cast("long")]
    key = keys[0] if len(keys) == 1 else F.explode(F.array(*keys))
    d = d.select("doc_id", "mark", "all", "pos", "word", key.alias("key"))
    return d.withColumn("key", F.when(F.col("word") == END, F.lit(END_KEY).cast("long")).otherwise(F.col("key")))


def find(docs: DataFrame, benchmark: DataFrame, window: int = 13, broadcast_mb: float = BROADCAST_MB) -> DataFrame:
    """(doc_id, mark, n_words, n_hit, item_ids) per distinct (doc_id, text); ``mark`` is xxhash64(text)."""
    shingles = cut(_window_shingles(windows_of(benchmark, window)))
    ids = f"array<{benchmark.schema['item_id'].dataType.simpleString()}>"
    sizes = sorted(r.g for r in shingles.select("g").distinct().collect())
    size = measured_mb(shingles, F.lit(64) + F.size("items") * 8 + F.size("w") * 24)
    small = size < broadcast_mb
    hint = F.broadcast if small else (lambda x: x)

    places = _places(docs, sizes)
    wanted = hint(shingles.select("key").distinct())
    seen = places.select("key").join(wanted, "key").groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    rare = F.min(F.struct(F.col("df"), F.col("j"), F.col("key"))).alias("r")
    index = (shingles.join(seen, "key", "left").groupBy("w", "k", "items")
             .agg(rare, F.count("df").alias("held"), F.count(F.lit(1)).alias("all_"))
             .where("held = all_").select(F.col("r.key").alias("key"), F.col("r.j").alias("j"), "w", "k", "items"))
    end = docs.sparkSession.range(1).select(F.lit(END_KEY).cast("long").alias("key"), F.lit(0).alias("j"), F.lit(None).cast("array<string>").alias("w"), F.lit(0).alias("k"), F.lit(None).cast(ids).alias("items"))
    start = F.col("pos") - F.col("j")
    inside = (start >= 0) & (start + F.col("k") < F.size("all"))
    if small:
        index = cut(index.select("key", "j", "w", "k", "items").unionAll(end))
        found = places.join(hint(index), "key").where(F.col("w").isNull() | (inside & (F.slice("all", start + 1, F.col("k")) == F.col("w"))))
        found = found.select("doc_id", "mark", F.when(F.col("w").isNull(), F.col("pos")).alias("n"), start.alias("start"), "k", "items")
    else:
        index = cut(index)
        met = places.withColumn("last", F.size("all")).select("doc_id", "mark", "pos", "last", "key").join(index, "key")
        met = met.where((start >= 0) & (start + F.col("k") < F.col("last"))).select("doc_id", "mark", start.alias("start"), "k", "w", "items")
        whole = docs.select(F.col("doc_id").alias("id_"), F.xxhash64("text").alias("mark_"), words(F.col("text")).alias("all")).dropDuplicates(["id_", "mark_"])
        hit = met.join(whole, met["doc_id"].eqNullSafe(whole["id_"]) & (met["mark"] == whole["mark_"])).where(F.slice("all", F.col("start") + 1, F.col("k")) == F.col("w"))
        found = hit.select("doc_id", "mark", F.lit(None).cast("int").alias("n"), "start", "k", "items").unionAll(
            places.where(F.col("word") == END).select("doc_id", "mark", F.col("pos").alias("n"), F.lit(0), F.lit(0), F.lit(None).cast(ids)))
    span = F.when(F.col("n").isNull(), F.struct(F.col("start").cast("long").alias("s"), (F.col("start") + F.col("k")).cast("long").alias("e")))
    per = found.groupBy("doc_id", "mark").agg(F.max("n").cast("long").alias("n_words"), F.collect_set(span).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("item_ids"))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("hit"))
    covered = F.aggregate(F.array_sort("spans"), zero, lambda a, x: F.struct(
        F.greatest(a["end"], x["e"]).alias("end"), (a["hit"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).alias("hit")))
    return per.select("doc_id", "mark", "n_words", covered["hit"].alias("n_hit"), "item_ids")


def contaminated(n_hit, n_words, ratio: int = 20) -> F.Column:
    return (n_hit > 0) & (n_hit * ratio >= n_words)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest of ``find``: one row per distinct (doc_id, text)."""
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return find(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs``, with all their columns, that are not contaminated."""
    bad = find(docs, benchmark).where(contaminated(F.col("n_hit"), F.col("n_words"))).select("doc_id", "mark")
    return without(docs, cut(bad))
