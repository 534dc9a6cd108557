"""Positive-unlabelled masks and leak-safe splits. Shuffles are md5 orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import shuffle_key
from ledgerloom.plans.ordered import numbered

TRAIN, VAL, TEST = 0, 1, 2
UNLABELLED, REVEALED, HIDDEN = 0, 1, 2


def account_rings(ledger: DataFrame) -> DataFrame:
    """(id, ring_id): the first positive ring of an account by time, then by the payment's ends; both ends count."""
    ends = ledger.where("ring_id > 0").select(F.explode_outer(F.array("src", "dst")).alias("id"), "ring_id", F.struct("ts", "src", "dst", "amount").alias("at"))
    return ends.groupBy("id").agg(F.min_by("ring_id", F.struct("at", "ring_id")).alias("ring_id"))


def masking_inputs(accounts: DataFrame, owners: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, party, entity): the largest of each where several match; null where none does."""
    d = accounts.select("id", *(c for c in accounts.columns if c != "id")).join(owners.join(entities, "party", "left"), F.col("id") == F.col("account"), "left")
    keep = [c for c in accounts.columns if c != "id"]
    return d.groupBy("id", *keep).agg(F.max("party").alias("party"), F.max("entity").alias("entity"))


def group_key(party="party", entity="entity", account="id"):
    """Entity, else party, else the account alone."""
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return F.when(F.col(entity) >= 0, s("E:", entity)).when(F.col(party).isNotNull(), s("P:", party)).otherwise(s("solo:", account))


def _placed(df: DataFrame, seed, name: str, key: str) -> DataFrame:
    """``df`` with ``r``, the place of each key in the seeded order, from 1."""
    d = numbered(df.withColumn("_key", shuffle_key(seed, F.lit(name), key)), [F.col("_key"), F.col(key)], "r")
    return d.withColumn("r", F.col("r") + 1).drop("_key")


def pu_mask(accounts: DataFrame, rings: DataFrame, reveal_prevalence: float = 0.10, dark_ring_fraction: float = 0.20, seed: int = 1337) -> DataFrame:
    """(id, is_mule, ring_id, pu_label, bucket, forced_test) of ``accounts(id, is_mule)``.

    A share of the rings that hold mules stays dark: none of their mules is revealed and all their
    accounts belong to the test split. Of the other mules as many are revealed as the share of all mules says.
    """
    for v in (reveal_prevalence, dark_ring_fraction):
        if not 0 <= v <= 1:
            raise ValueError("fractions lie between 0 and 1")
    d = accounts.select("id", "is_mule").join(rings, "id", "left").withColumn("ring_id", F.coalesce("ring_id", F.lit(0)))
    mule_rings = d.where("is_mule = 1 and ring_id > 0").select("ring_id").distinct()
    n = mule_rings.agg(F.bround(F.count(F.lit(1)) * F.lit(dark_ring_fraction), 0).alias("n_dark"))
    dark = _placed(mule_rings, seed, "ring", "ring_id").join(F.broadcast(n)).where("r <= n_dark").select("ring_id", F.lit(1).alias("dark"))
    d = d.join(dark, "ring_id", "left").withColumn("dark", F.coalesce("dark", F.lit(0)))
    want = d.agg(F.bround(F.sum("is_mule") * F.lit(reveal_prevalence), 0).alias("n_reveal"))
    shown = _placed(d.where("is_mule = 1 and dark = 0").select("id"), seed, "mule", "id").join(F.broadcast(want)).where("r <= n_reveal").select("id", F.lit(1).alias("shown"))
    d = d.join(shown, "id", "left")
    pu = F.coalesce("shown", F.lit(0))
    return d.select("id", "is_mule", "ring_id", pu.alias("pu_label"), F.when(F.col("is_mule") == 0, UNLABELLED).when(pu == 1, REVEALED).otherwise(HIDDEN).alias("bucket"), F.col("dark").alias("forced_test"))


def split_accounts(members: DataFrame, val_fraction: float = 0.20, test_fraction: float = 0.15, seed: int = 1337) -> DataFrame:
    """(id, group_key, split) of ``members(id, group_key, pu_label, forced_test)``: a group is never divided.

    Groups with a forced account are test. Groups with a revealed positive are dealt out first: with one it is
    train, with two val and train, with more at least one each of val and test. The others go by fraction.
    """
    if val_fraction < 0 or test_fraction < 0 or val_fraction + test_fraction >= 1:
        raise ValueError("fractions must not be negative and must leave something to train on")
    g = members.groupBy("group_key").agg(F.max("forced_test").alias("forced"), F.max("pu_label").alias("pos"))
    free = _placed(g.where("forced = 0 and pos = 1"), seed, "group", "group_key").unionAll(_placed(g.where("forced = 0 and pos = 0"), seed, "group", "group_key"))
    k = free.groupBy("pos").agg(F.count(F.lit(1)).alias("k"))
    n_val, n_test = F.bround(F.col("k") * F.lit(val_fraction), 0), F.bround(F.col("k") * F.lit(test_fraction), 0)
    low = lambda x: F.greatest(x, F.lit(1))
    k = k.withColumn("nv", F.when(F.col("pos") == 0, n_val).when(F.col("k") == 1, 0).when(F.col("k") == 2, 1).otherwise(low(n_val)))
    most = F.when(F.col("nv") + low(n_test) >= F.col("k"), low(F.col("k") - F.col("nv") - 1)).otherwise(low(n_test))
    k = k.withColumn("nt", F.when(F.col("pos") == 0, n_test).when(F.col("k") <= 2, 0).otherwise(most))
    free = free.join(F.broadcast(k), "pos").select("group_key", F.when(F.col("r") <= F.col("nv"), VAL).when(F.col("r") <= F.col("nv") + F.col("nt"), TEST).otherwise(TRAIN).alias("split"))
    every = free.unionAll(g.where("forced = 1").select("group_key", F.lit(TEST).alias("split")))
    return members.select("id", "group_key").join(every, "group_key").select("id", "group_key", "split")


def split_summary(masked: DataFrame, splits: DataFrame) -> DataFrame:
    return masked.join(splits, "id").groupBy("split", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("is_mule").alias("n_mules"))


def flags(splits: DataFrame) -> DataFrame:
    """The split as three flags, as accounts carry it."""
    return splits.select("id", *(F.when(F.col("split") == v, 1).otherwise(0).alias(k) for k, v in (("is_train", TRAIN), ("is_val", VAL), ("is_test", TEST))))


def write_back(store, masked: DataFrame, splits: DataFrame) -> int:
    """Split flags and pu_label merged into stored accounts; accounts the store lacks are added. Buckets rewritten.

    ``store`` is a ``sources.store.Store``; the label is a training target and no feature.
    """
    changes = flags(splits).join(masked.select("id", "pu_label"), "id")
    return store.upsert(changes, {"is_train": 0, "is_val": 0, "is_test": 0, "pu_label": 0})


def accounts_of(flagged: DataFrame, split: str) -> DataFrame:
    if split not in ("train", "val", "test"):
        raise ValueError("split is train, val or test")
    return flagged.where(F.col(f"is_{split}") == 1).select("id")
