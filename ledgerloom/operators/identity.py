"""Accounts that share an identity, and parties that are one person."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.fixpoint import components, cut
from ledgerloom.plans.ordered import numbered

KINDS = ["device", "ip", "phone", "email"]
# What one shared attribute adds to a pair's score.
WEIGHTS = {"email": "0.50", "phone": "0.50", "birthdate": "0.30", "street": "0.20", "postcode": "0.20", "city": "0.10", "state": "0.10",
           "name_minhash": "0.15", "address_minhash": "0.08", "street_minhash": "0.08"}


FEW = 256  # holders up to which those of a value are paired


def identity_sharing(accounts: DataFrame, owners: DataFrame, identities: DataFrame, few: int = FEW) -> DataFrame:
    """For each account and kind the number of other accounts whose party holds one of its values.

    Values with more than ``few`` holders are frequent. An account's peers are the holders of any of its frequent values,
    and beside them the holders of its other values who share none of the frequent ones. The former are counted once for
    each distinct set of frequent values: a single value by its degree, several by OR over bitmaps of the holders'
    dense ids, one bitmap for 32,768 accounts. The latter are pairs, ``few`` for each value that an account holds at most.
    So no count of rows grows with the square of the holders or the subsets of an account's values.
    """
    held = owners.join(identities, "party").select("account", "kind", "value").distinct()
    degree = held.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("deg"))
    held = cut(held.join(degree, ["kind", "value"]))
    often = held.where(F.col("deg") > few)
    sets = often.groupBy("account", "kind").agg(F.sort_array(F.collect_set("value")).alias("often"), F.max("deg").alias("deg"))
    one = sets.where(F.size("often") == 1).select("account", "kind", F.col("deg").alias("reach"))
    several = cut(sets.where(F.size("often") > 1).select("account", "kind", "often"))
    reach = one.unionByName(several.join(_union_sizes(often, several), ["kind", "often"]).select("account", "kind", "reach"))
    rare = held.where(F.col("deg") <= few).join(sets.select("account", "kind", "often"), ["account", "kind"], "left")
    x, y = rare.alias("x"), rare.alias("y")
    apart = ~F.coalesce(F.arrays_overlap("x.often", "y.often"), F.lit(False))
    pairs = x.join(y, (F.col("x.kind") == F.col("y.kind")) & (F.col("x.value") == F.col("y.value")) & (F.col("x.account") != F.col("y.account")) & apart)
    pairs = pairs.select("x.account", "x.kind", F.col("y.account").alias("peer")).distinct().groupBy("account", "kind").agg(F.count(F.lit(1)).alias("n"))
    n = reach.select("account", "kind", (F.col("reach") - 1).alias("n")).unionByName(pairs)
    each = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"{k}_share_cnt") for k in KINDS]
    n = n.groupBy(F.col("account").alias("id")).agg(*each)
    return accounts.select("id").join(n, "id", "left").na.fill(0)


def _union_sizes(held: DataFrame, sets: DataFrame) -> DataFrame:
    """(kind, often, reach): how many accounts hold any value of each distinct set in ``sets(account, kind, often)``."""
    wanted = sets.select("kind", "often").distinct()
    named = wanted.select("kind", "often", F.explode("often").alias("value"))
    ids = numbered(held.select("account").distinct(), [F.col("account")], "no").withColumn("no", F.col("no") + 1)
    bits = held.join(named.select("kind", "value").distinct(), ["kind", "value"], "left_semi").join(ids, "account")
    bits = bits.groupBy("kind", "value", F.bitmap_bucket_number("no").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("no")).alias("bits"))
    each = named.join(bits, ["kind", "value"]).groupBy("kind", "often", "part").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    return each.groupBy("kind", "often").agg(F.sum("n").alias("reach"))


def _banded(pii: DataFrame, below: int) -> DataFrame:
    deg = pii.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("deg")).where(f"deg > 1 and deg < {below}")
    return pii.join(deg, ["kind", "value"])


def party_candidates(pii: DataFrame, candidate_degree: int = 100) -> DataFrame:
    """(a, b), a < b: parties that share a rare value. The degree limit bounds every group's pairs."""
    p = _banded(pii.select("party", "kind", "value").distinct(), candidate_degree)
    return p.alias("x").join(p.alias("y"), (F.col("x.kind") == F.col("y.kind")) & (F.col("x.value") == F.col("y.value")) & (F.col("x.party") < F.col("y.party"))).select(
        F.col("x.party").alias("a"), F.col("y.party").alias("b")).distinct()


BATCHES = 8  # of values, where pairs are scored batch by batch


def _batch(batches: int):
    """The batch of a value: its hash, the same in any engine."""
    digits = F.substring(F.md5(F.concat_ws("|", "kind", "value").cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("long") % batches


def party_scores(pii: DataFrame, candidate_degree: int = 100, score_degree: int = 25_000, num_value_batches: int = 1, weights: dict[str, str] = WEIGHTS) -> DataFrame:
    """(a, b, score) of candidate pairs: weights of all shared values, also of frequent ones.

    Candidates fetch their own values, so a frequent value costs its candidates and not its square.
    With ``num_value_batches`` > 1 sums are tested per batch of values and the best batch counts.
    """
    p = _banded(pii.select("party", "kind", "value").distinct(), score_degree)
    w = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(Decimal(v)).cast("decimal(4,2)"))))
    p = p.select("party", "kind", "value", F.try_element_at(w, F.col("kind")).alias("w"), _batch(num_value_batches).alias("batch"))
    cand = party_candidates(pii, candidate_degree)
    left = cand.join(p.withColumnRenamed("party", "a"), "a")
    both = left.join(p.select(F.col("party").alias("b"), "kind", "value"), ["b", "kind", "value"])
    return both.groupBy("a", "b", "batch").agg(F.sum("w").alias("s")).groupBy("a", "b").agg(F.max("s").cast("decimal(12,2)").alias("score"))


def party_matches(pii: DataFrame, threshold: float = 1.0, **limits) -> DataFrame:
    return party_scores(pii, **limits).where(F.col("score") > F.lit(threshold - 1e-6)).select("a", "b", F.col("score").cast("double").alias("score"))


def match_stats(pii: DataFrame, **limits) -> DataFrame:
    s = party_scores(pii, **limits).agg(F.max("score").cast("double").alias("max_score"), F.min("score").cast("double").alias("min_score"),
                                        F.round(F.sum("score").cast("double") / F.count(F.lit(1)), 6).alias("avg_score"), F.count(F.lit(1)).alias("scored_pairs"))
    return s.join(party_candidates(pii, limits.get("candidate_degree", 100)).agg(F.count(F.lit(1)).alias("candidate_pairs")))


def resolved_entities(parties: DataFrame, matches: DataFrame) -> DataFrame:
    """(party, entity): the smallest party reachable over matches; singletons are their own entity."""
    c = components(matches.select("a", "b"))
    return parties.select("party").join(c, F.col("party") == F.col("node"), "left").select("party", F.coalesce("component", "party").alias("entity"))
