"""Secret scans with multipart credential linking (operator 2), in DataFrame functions only.

Base spans are regular-expression matches over whole texts, leftmost and non-overlapping per kind.
Weak parts (short access identifiers, login names, bare high-variety tokens, endpoints) mean
little alone. They are interval-joined with the other parts within a scope of ``REACH`` code points:
a weak identifier is reported when a secret lies in its scope, a weak secret when an identifier
does, an endpoint when both do. The interval join sweeps each document's parts in order and looks
at the nearest complementary part on either side, so no pairs are formed.

Offsets are code points, ends exclusive. Places come from the pieces between matches, whose lengths
add up. Defined results: null text is empty; rows with equal (doc_id, text) count once, the same
doc_id with other texts is another document; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REACH = 300
# Kinds in listing order: name, pattern, role, strength. Later kinds are the method's own.
KINDS = [
    ("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", "secret", "base"),
    ("access", r"AKIA[A-Z0-9]{16,}", "identifier", "base"),
    ("hex", r"[0-9a-f]{24,}", "secret", "base"),
    ("weak_identifier", r"""(?:[Uu][Ss][Ee][Rr](?:[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd])["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]+""", "identifier", "weak"),
    ("weak_secret", r"[A-Za-z0-9+/_-]{32,}={0,2}", "secret", "weak"),
    ("endpoint", r"""[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]+""", "endpoint", "weak"),
]
RANK = {k[0]: i for i, k in enumerate(KINDS)}
#: what stands before group 2 of an assign match, for its length
BEFORE_VALUE = r"""^[A-Za-z]+_?[A-Za-z]*["']?\x20*[:=]\x20*["']?"""


def _matches(rank: int, pattern: str, text) -> F.Column:
    """array<struct(rank, i, gap, size, keep)> of one kind: lengths of the gap before each match and of the match."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def part(pair, i):
        hit, keep = pair["hit"], F.lit(True)
        if KINDS[rank][0] == "assign":
            keep = F.char_length(F.regexp_replace(hit, BEFORE_VALUE, "")) >= 6
        if KINDS[rank][0] == "weak_secret":  # a bare token must mix digits with letters of both cases
            keep = hit.rlike("[0-9]") & hit.rlike("[a-z]") & hit.rlike("[A-Z]")
        return F.struct(F.lit(rank).alias("rank"), i.alias("i"), F.char_length(pair["gap"]).alias("gap"), F.char_length(hit).alias("size"), keep.alias("keep"))

    found = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit")), part)
    return F.when(text.rlike(pattern), found).otherwise(F.expr("array_repeat(struct(0 as rank, 0 as i, 0 as gap, 0 as size, true as keep), 0)"))


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, rank, s, e) of every match, and a part of rank -1 for every distinct row.

    Only matches are shuffled, once, by document; all that follows keeps that partitioning.
    """
    d = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("t"))
    every = F.concat(F.expr("array(struct(-1 as rank, 0 as i, 0 as gap, 0 as size, true as keep))"), *(_matches(r, k[1], F.col("t")) for r, k in enumerate(KINDS)))
    d = d.select("doc_id", "mark", F.explode_outer(every).alias("p")).select("doc_id", "mark", "p.*")
    d = d.repartition("doc_id", "mark").dropDuplicates(["doc_id", "mark", "rank", "i"])
    e = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("doc_id", "mark", "rank").orderBy("i")).cast("int")
    return d.withColumn("e", e).where("keep").select("doc_id", "mark", "rank", (F.col("e") - F.col("size")).alias("s"), "e")


def link(found: DataFrame, reach: int = REACH) -> DataFrame:
    """Parts that are reported: all base parts, and weak ones with their complements in scope."""
    role = {i: k[2] for i, k in enumerate(KINDS)}
    weak = [i for i, k in enumerate(KINDS) if k[3] == "weak"]
    order = Window.partitionBy("doc_id", "mark").orderBy("s", "rank", "e")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    near = {}
    for name in ("identifier", "secret"):
        own = F.col("rank").isin([i for i in role if role[i] == name])
        left = F.max(F.when(own, F.col("e"))).over(before)
        right = F.min(F.when(own, F.col("s"))).over(after)
        near[name] = F.coalesce(F.col("s") - left <= reach, F.lit(False)) | F.coalesce(right - F.col("e") <= reach, F.lit(False))
    d = found.select("*", near["identifier"].alias("by_identifier"), near["secret"].alias("by_secret"))
    is_ = lambda name: F.col("rank").isin([i for i in weak if role[i] == name])
    return d.where(~F.col("rank").isin(weak) | (is_("identifier") & F.col("by_secret")) | (is_("secret") & F.col("by_identifier"))
                   | (is_("endpoint") & F.col("by_secret") & F.col("by_identifier"))).drop("by_identifier", "by_secret")


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, mark, spans array<struct(s, rank, e)>) per distinct (doc_id, text), by start, then kind."""
    return link(parts(docs), reach).groupBy("doc_id", "mark").agg(
        F.array_sort(F.collect_list(F.when(F.col("rank") >= 0, F.struct("s", "rank", "e")))).alias("spans"))


def _digest(spans) -> F.Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """The contract's digest of ``scan``."""
    n = lambda k: F.size(F.filter("spans", lambda x: x["rank"] == RANK[k])).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["rank"] < 3)
    return scan(docs).select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"))
