"""Line deduplication by a deletion-neighbourhood join (operator 3), in DataFrame functions only.

A line goes when an earlier line, by (doc_id, hash of text, line number), is equal to it or, both
having ``min_chars`` code points or more, within one edit of it. All is judged on the input.

Equal lines meet in one pre-aggregated grouping. For one edit, of two lines whose shorter has m code
points either the first or the last m div 2 are equal; lines that share such a half with no other
line are set aside. The rest emit, for each half they share, all variants of the other half with one
deletion as hashed keys, and the other half itself. Lines that lost a character at the same place
and are of one length are one substitution apart; a line equal to another's variant is one insertion
away. So a group needs only its earliest members: minima, never pairs, and a group of any size is
pre-aggregated. The earliest neighbour found is verified with the edit distance itself.

Defined results: blank lines (spaces only) stay; null text stays null and has no lines; equal
(doc_id, text) rows are one document and get the same text; null doc_ids come first; other columns
are carried along (n_chars, where there is one, is set anew); empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import BROADCAST_MB, cut, measured_mb

MIN_CHARS = 20
LONG_REST = 256


def _small(df: DataFrame, bytes_each) -> DataFrame:
    return F.broadcast(df) if measured_mb(df, bytes_each) < BROADCAST_MB else df


def _lines(docs: DataFrame) -> DataFrame:
    """(h1, h2, pos, line) of every line that is not blank."""
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).where("text is not null")
    d = d.select("doc_id", "mark", F.posexplode_outer(F.split("text", "\n", -1)).alias("no", "line")).where("trim(line) <> ''")
    return d.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.struct("doc_id", "mark", "no").alias("pos"), "line")


def _shared(met: DataFrame) -> DataFrame:
    """Keys that two different lines hold; broadcast when measured to be few."""
    both = met.select("half", F.xxhash64("h1", "h2").alias("h")).groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    return _small(cut(both.where("a <> b").select("half")), F.lit(16))


def _shorten(rest: DataFrame) -> DataFrame:
    """Halve rests over ``LONG_REST`` by the same argument until none is left: variants cost the square of a rest's length."""
    done = None
    while True:
        rest = cut(rest)
        short, long = rest.where(f"m <= {LONG_REST}"), rest.where(f"m > {LONG_REST}")
        done = short if done is None else done.unionAll(short)
        if long.isEmpty():
            return done
        both = long.select("h1", "h2", "pos", "half", "m", "rest", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
        both = both.select("h1", "h2", "pos", F.expr("xxhash64(half, k, CASE WHEN k = 0 THEN left(rest, m div 2) ELSE right(rest, m div 2) END)").alias("half"),
                           F.expr("m - m div 2").alias("m"), F.expr("CASE WHEN k = 0 THEN substring(rest, m div 2 + 1) ELSE left(rest, char_length(rest) - m div 2) END").alias("rest"))
        both = cut(both)
        rest = both.join(_shared(both), "half").select(rest.columns)


def earliest_like(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, pos): for each line with an equal or near twin, the place after which it is a repeat."""
    # 0..3: first half for m = n - 1 and n, last half for m = n - 1 and n
    m = "(n - 1 + {k} % 2)"
    half = "CASE WHEN n >= {least} THEN xxhash64({m}, {k} div 2, {cut}) END"
    keys = [half.format(least=min_chars, k=k, m=m.format(k=k), cut=f"substring(line, 1, {m.format(k=k)} div 2)" if k < 2 else f"right(line, {m.format(k=k)} div 2)") for k in range(4)]
    seen = _lines(docs).withColumn("n", F.char_length("line")).select("h1", "h2", "pos", "n", *(F.expr(k).alias(f"k{i}") for i, k in enumerate(keys)))
    lines = cut(seen.groupBy("h1", "h2").agg(F.min("pos").alias("pos"), F.max("pos").alias("last"), F.min("n").alias("n"), *(F.min(f"k{i}").alias(f"k{i}") for i in range(4)))
                .select("h1", "h2", "pos", (F.col("pos") < F.col("last")).alias("again"), "n", *(f"k{i}" for i in range(4))))
    twice = lines.where("again").select("h1", "h2", "pos")

    met = lines.where(f"n >= {min_chars}").select("h1", "h2", F.posexplode_outer(F.array(*(f"k{i}" for i in range(4)))).alias("k", "half"))
    near = cut(met.join(_shared(met), "half").select("h1", "h2", "k", "half"))
    who = _small(near.select("h1", "h2").distinct(), F.lit(24))
    text = cut(lines.join(who, ["h1", "h2"], "left_semi").select("h1", "h2", "pos", "n")
               .join(_lines(docs).join(who, ["h1", "h2"], "left_semi"), ["h1", "h2", "pos"]).dropDuplicates(["h1", "h2"]))
    rest = F.expr(f"CASE WHEN k < 2 THEN substring(line, {m.format(k='k')} div 2 + 1) ELSE left(line, n - {m.format(k='k')} div 2) END")
    rest = near.join(text, ["h1", "h2"]).select("h1", "h2", "pos", "half", F.expr(m.format(k="k")).alias("m"), rest.alias("rest"))
    rest = _shorten(rest.withColumn("m", F.expr("m - m div 2")))
    whole = rest.select("h1", "h2", "pos", "half", F.lit(0).alias("at"), F.xxhash64("half", "rest").alias("key"))
    less = rest.select("h1", "h2", "pos", "half", "rest", F.explode(F.sequence(F.lit(1), F.char_length("rest"))).alias("at")).select(
        "h1", "h2", "pos", "half", "at", F.expr("xxhash64(half, concat(left(rest, at - 1), substring(rest, at + 1)))").alias("key"))
    variants = whole.unionAll(less.where("at > 0"))
    # first the keys alone, then the few variants that two lines share
    both = variants.select("key", F.xxhash64("h1", "h2").alias("h")).groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    variants = cut(variants.join(_small(cut(both.where("a <> b").select("key")), F.lit(16)), "key", "left_semi"))
    me = F.struct("pos", "h1", "h2")
    # one substitution: the same place deleted; one insertion: a whole rest equal to another's variant
    first = variants.groupBy("key", "at").agg(F.min(me).alias("f"), F.max(me).alias("l"))
    swaps = first.where("at > 0 and f <> l").select("key", "at", "f")
    whole_first = first.where("at = 0").select("key", F.col("f").alias("whole"))
    less_first = first.where("at > 0").groupBy("key").agg(F.min("f").alias("less"))
    grown = whole_first.join(less_first, "key")
    by_swap = variants.join(swaps, ["key", "at"]).select("h1", "h2", "pos", F.col("f").alias("twin"))
    by_growth = variants.join(grown, "key").select("h1", "h2", "pos", F.when(F.col("at") == 0, F.col("less")).otherwise(F.col("whole")).alias("twin"))
    found = by_swap.unionAll(by_growth).where("twin.pos < pos").groupBy("h1", "h2").agg(F.min("twin").alias("twin"))
    other = text.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("other"))
    checked = found.select("h1", "h2", "twin", F.col("twin.h1").alias("o1"), F.col("twin.h2").alias("o2")).join(other, ["o1", "o2"]).join(text.select("h1", "h2", "line"), ["h1", "h2"])
    checked = checked.where(F.levenshtein("line", "other", 1) >= 0).select("h1", "h2", F.col("twin.pos").alias("pos"))
    return twice.unionAll(checked).groupBy("h1", "h2").agg(F.min("pos").alias("pos"))


def removals(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, mark, gone): the line numbers that go, for documents that lose any."""
    after = cut(earliest_like(docs, min_chars)).withColumnRenamed("pos", "kept")
    gone = _lines(docs).drop("line").join(_small(after, F.lit(64)), ["h1", "h2"]).where("kept < pos")
    return gone.groupBy(F.col("pos.doc_id").alias("id"), F.col("pos.mark").alias("mark")).agg(F.collect_set("pos.no").alias("gone"))


def _with_kept(docs: DataFrame, min_chars: int) -> DataFrame:
    """(row: the columns of ``docs``, kept text, n lines, less: those that went); rows travel whole, whatever their columns are called."""
    gone = cut(removals(docs, min_chars)).withColumnRenamed("mark", "of")
    gone = _small(gone, F.lit(64) + F.size("gone") * 8)
    d = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    d = d.join(gone, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("of")), "left")
    lines = F.split("row.text", "\n", -1)
    left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")))
    kept = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    n = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    return d.select("row", kept.alias("kept"), n.alias("n"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("less"))


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with repeated lines taken out of their texts; every row stays."""
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
    return _with_kept(docs, min_chars).select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def report(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of every row."""
    d = _with_kept(docs.select("doc_id", "text"), min_chars)
    return d.select("row.doc_id", F.col("n").alias("n_lines"), F.col("less").alias("n_removed"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
