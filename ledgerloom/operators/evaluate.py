"""Ranking evaluation over ``(id, score, label)``. Order is score descending, then id; AP and AUC respect ties.

Positions in a ranking need one order of all rows. They are found without one task holding them: rows, or
counts per distinct score, are dealt out by range and running sums are taken over stretches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import sigmoid
from ledgerloom.operators.masking import HIDDEN, REVEALED
from ledgerloom.plans.fixpoint import cut
from ledgerloom.plans.ordered import running

ALERT_RATES = (0.0005, 0.001, 0.005, 0.01, 0.02)
KS = (100, 250, 500, 1000)
ANALYST_PRECISION = 0.45  # fixed value: share of alerts a human review confirms


def by_score(scores: DataFrame) -> DataFrame:
    """(score, n, pos, n_to, pos_to, all_n, all_pos): counts of each score and running counts down the ranking."""
    g = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    d = running(g, [F.desc("score")], {"n_to": F.col("n"), "pos_to": F.col("pos")})
    return d.withColumnsRenamed({"n_to_all": "all_n", "pos_to_all": "all_pos"})


def ranked(scores: DataFrame) -> DataFrame:
    """(id, score, label, place, pos_to, all_n, all_pos): place from 1 and positives down to it, counted in stretches; ties go by id."""
    d = running(scores.select("id", "score", "label"), [F.desc("score"), F.col("id")], {"place": F.lit(1).cast("long"), "pos_to": F.col("label").cast("long")})
    return d.withColumnsRenamed({"place_all": "all_n", "pos_to_all": "all_pos"})


def two_classes(scores: DataFrame) -> None:
    row = scores.agg(F.min("label"), F.max("label")).first()
    if row[0] == row[1]:
        raise ValueError("both classes are needed")


def _both_classes(n, pos):
    """``pos``, or an error, when the query runs, where not both classes are there."""
    return F.when((pos > 0) & (pos < n), pos).otherwise(F.raise_error(F.lit("both classes are needed")).cast("long"))


def ranking_metrics(scores: DataFrame) -> DataFrame:
    """(n, n_pos, average_precision, roc_auc), with ties handled as one threshold each; one class alone is an error."""
    g = by_score(scores)
    ap = F.sum(F.try_divide(F.col("pos"), F.col("all_pos")) * (F.col("pos_to") / F.col("n_to")))
    # rank sum with mid ranks, counted from the lowest score
    mid = F.col("all_n") - F.col("n_to") + (F.col("n") + 1) / 2
    n, p = F.max("all_n"), F.max("all_pos")
    area = F.try_divide(F.sum(F.col("pos") * mid) - p * (p + 1) / 2, p * (n - p))
    d = g.agg(n.alias("n"), p.alias("n_pos"), F.round(ap, 6).alias("average_precision"), F.round(area, 6).alias("roc_auc"))
    return d.withColumn("n_pos", _both_classes(F.col("n"), F.col("n_pos")))


def _at(scores: DataFrame, ks: DataFrame) -> DataFrame:
    """``ks(k, ...)`` with tp: positives among the first k; a k beyond the end takes all."""
    n = scores.agg(F.count(F.lit(1)).alias("all_n"), F.coalesce(F.sum("label"), F.lit(0)).alias("all_pos"))
    ks = cut(ks.join(F.broadcast(n)).withColumn("_last", F.least("k", "all_n")))
    hits = ranked(scores).select("place", "pos_to").join(F.broadcast(ks.select("_last").distinct()), F.col("place") == F.col("_last"), "left_semi")
    return ks.join(hits, F.col("place") == F.col("_last"), "left").select(*(c for c in ks.columns if c != "_last"), F.coalesce("pos_to", F.lit(0)).alias("tp"))


def _ks(scores: DataFrame, ks) -> DataFrame:
    if not ks or not all(k > 0 for k in ks):
        raise ValueError("every k must be above 0")
    return scores.sparkSession.createDataFrame([(int(k),) for k in sorted(set(ks))], "k long")


def precision_at_k(scores: DataFrame, ks=KS) -> DataFrame:
    d = _at(scores, _ks(scores, ks))
    return d.select("k", F.round(F.col("tp") / F.least("k", "all_n"), 6).alias("precision"))


def hidden_recall(scores: DataFrame, ks=KS) -> DataFrame:
    """(k, hits, recall, ceiling, normalised) of hidden positives; ``label`` marks them."""
    d = _at(scores, _ks(scores, ks))
    recall, ceiling = F.col("tp") / F.col("all_pos"), F.least(F.lit(1.0), F.col("k") / F.col("all_pos"))
    return d.select("k", F.col("tp").alias("hits"), F.round(recall, 6).alias("recall"), F.round(ceiling, 6).alias("ceiling"), F.round(recall / ceiling, 6).alias("normalised"))


def keyed(scores: DataFrame, key: DataFrame) -> DataFrame:
    """(id, score, true_label, bucket, dark) of ``scores(id, score)`` and ``key(id, true_label, bucket[, dark])``.

    A score without a key, a key without a score, and an id that stands twice are errors when the rows are read.
    """
    dark = F.col("dark") if "dark" in key.columns else F.lit(0).alias("dark")
    mine = scores.groupBy("id").agg(F.first("score").alias("score"), F.count(F.lit(1)).alias("n_scores"))
    theirs = key.select("id", "true_label", "bucket", dark).groupBy("id").agg(
        *(F.first(c).alias(c) for c in ("true_label", "bucket", "dark")), F.count(F.lit(1)).alias("n_keys"))
    d = mine.join(theirs, "id", "full")

    def bad(what: str):
        return F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(F.col("id").cast("string"), F.lit("null")))).cast("double")

    score = F.when(F.col("n_scores").isNull(), bad("no score for")).when(F.col("n_keys").isNull(), bad("no key for")).when(
        (F.col("n_scores") > 1) | (F.col("n_keys") > 1), bad("stands twice")).otherwise(F.col("score"))
    return d.select("id", score.alias("score"), "true_label", "bucket", "dark")


def evaluate_hidden(scores: DataFrame, key: DataFrame, ks=KS, primary: int | None = None) -> DataFrame:
    """How a ranking does against the answer key, by bucket: one row for each review depth k.

    One ranking carries running counts of all positives, of those that were revealed and hidden, and of accounts in
    dark rings. Every k has the hits of each, the share of hidden positives found, the ceiling that k slots
    allow, and the share of that; the average precision and AUC against true labels stand beside. ``primary``
    (one of ks) marks the headline row; a k beyond the end takes all.
    """
    wanted = _ks(scores, ks)
    if primary is not None and primary not in ks:
        raise ValueError("primary is one of ks")
    d = cut(keyed(scores, key))
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    counts = {"place": F.lit(1).cast("long"), "true": F.col("true_label").cast("long"), "revealed": one(F.col("bucket") == REVEALED),
              "hidden": one(F.col("bucket") == HIDDEN), "dark_": one(F.col("dark") == 1)}
    r = cut(running(d, [F.desc("score"), F.col("id")], counts))
    totals = r.agg(*(F.coalesce(F.first(f"{c}_all"), F.lit(0)).alias(f"{c}_all") for c in counts))
    wanted = wanted.join(F.broadcast(totals)).withColumn("last", F.least("k", "place_all"))
    hits = r.select("place", *(F.col(c).alias(f"{c}_hits") for c in counts if c != "place"))
    at = hits.join(F.broadcast(wanted.select(F.col("last").alias("place")).distinct()), "place", "left_semi")
    quality = ranking_metrics(d.select("id", "score", F.col("true_label").alias("label")))
    out = wanted.join(at, F.col("last") == F.col("place"), "left").join(F.broadcast(quality.select("n_pos", "average_precision", "roc_auc")))
    recall = F.try_divide(F.col("hidden_hits"), F.col("hidden_all"))
    ceiling = F.least(F.lit(1.0), F.try_divide(F.col("k"), F.col("hidden_all")))
    six = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return out.select(
        "k", F.col("place_all").alias("accounts"), F.col("n_pos").alias("true_positives"), F.col("revealed_all").alias("revealed_positives"),
        F.col("hidden_all").alias("hidden_positives"), F.col("dark__all").alias("dark_accounts"), "true_hits", "revealed_hits", "hidden_hits",
        F.col("dark__hits").alias("dark_hits"), six(recall).alias("hidden_recall"), six(ceiling).alias("ceiling"),
        six(F.try_divide(recall, ceiling)).alias("normalised"), six(F.col("true_hits") / F.col("last")).alias("precision"),
        "average_precision", "roc_auc", (F.col("k") == F.lit(primary)).alias("is_primary") if primary is not None else F.lit(False).alias("is_primary"))


def gains_table(scores: DataFrame, rates=ALERT_RATES) -> DataFrame:
    """(alert_rate, k, tp, recall, precision, lift) at each share of the population that is reviewed."""
    if not rates or not all(0 < r <= 1 for r in rates):
        raise ValueError("alert rates lie in (0, 1]")
    r = scores.sparkSession.createDataFrame([(float(x),) for x in sorted(set(rates))], "alert_rate double")
    n = scores.agg(F.count(F.lit(1)).alias("n"))
    ks = r.join(F.broadcast(n)).select("alert_rate", F.greatest(F.lit(1), F.least(F.bround(F.col("alert_rate") * F.col("n"), 0).cast("long"), F.col("n"))).alias("k"))
    d = _at(scores, ks)
    p = F.col("tp") / F.col("k")
    return d.select("alert_rate", "k", "tp", F.round(F.col("tp") / F.col("all_pos"), 6).alias("recall"), F.round(p, 6).alias("precision"), F.round(p / (F.col("all_pos") / F.col("all_n")), 6).alias("lift"))


def summary_report(scores: DataFrame, rates=ALERT_RATES, analyst_precision: float = ANALYST_PRECISION) -> DataFrame:
    """The gains table with what stands above it: counts, base rate, AP and AUC, and whether a row's precision reaches an analyst's."""
    head = ranking_metrics(scores).withColumn("base_rate", F.round(F.col("n_pos") / F.col("n"), 6))
    return gains_table(scores, rates).join(F.broadcast(head)).withColumn("beats_analyst", F.col("precision") >= analyst_precision)


def report_lines(report: DataFrame) -> DataFrame:
    """(line): the report as text, one line for each alert rate, for a text sink."""
    return report.select(F.format_string("%.3f%% k=%d recall=%.4f precision=%.4f lift=%.1fx tp=%d/%d%s", F.col("alert_rate") * 100, "k", "recall", "precision", "lift", "tp", "n_pos",
                                         F.when(F.col("beats_analyst"), " *").otherwise("")).alias("line"))


def long_features(features: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    pairs = F.explode_outer(F.array(*(F.struct(F.lit(k).alias("feature"), F.col(k).cast("double").alias("score")) for k in names)))
    return features.join(labels, "id").select("id", "label", pairs.alias("p")).select("id", "label", "p.feature", "p.score")


def feature_auc(features: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """(feature, auc, best_auc): rank-sum AUC of each feature alone; best_auc is sign-corrected."""
    g = long_features(features, labels, names).groupBy("feature", "score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    g = running(g, [F.col("feature"), F.col("score")], {"to": F.col("n")})
    whole = g.groupBy("feature").agg(F.min(F.col("to") - F.col("n")).alias("base"), F.sum("n").alias("all_n"), F.sum("pos").alias("all_pos"))
    g = g.join(F.broadcast(whole), "feature").select("feature", "n", "pos", (F.col("to") - F.col("base")).alias("to"), "all_n", "all_pos")
    area = (F.sum(F.col("pos") * (F.col("to") - (F.col("n") - 1) / 2)) - F.max("all_pos") * (F.max("all_pos") + 1) / 2) / (F.max("all_pos") * (F.max("all_n") - F.max("all_pos")))
    return g.groupBy("feature").agg(F.round(area, 6).alias("auc")).select("feature", "auc", F.round(F.greatest("auc", 1 - F.col("auc")), 6).alias("best_auc"))


def feature_corr(features: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """(feature, r): Pearson correlation with the label, 0 for a constant feature."""
    d = long_features(features, labels, names)
    n, sx, sy = F.count(F.lit(1)), F.sum("score"), F.sum("label")
    cov = F.sum(F.col("score") * F.col("label")) / n - (sx / n) * (sy / n)
    flat = (F.stddev_pop("score") < 1e-12) | (F.stddev_pop("label") < 1e-12)
    return d.groupBy("feature").agg(F.when(flat, 0.0).otherwise(F.round(F.try_divide(cov, F.stddev_pop("score") * F.stddev_pop("label")), 5)).alias("r"))


def class_logits(logits: DataFrame) -> DataFrame:
    """(n_pos, n_neg, pos_mean, neg_mean, pos_std, neg_std, gap, verdict) of ``(logit, label)``."""
    p, u = F.when(F.col("label") == 1, F.col("logit")), F.when(F.col("label") == 0, F.col("logit"))
    d = logits.agg(F.count(p).alias("n_pos"), F.count(u).alias("n_neg"), F.avg(p).alias("pm"), F.avg(u).alias("nm"), F.stddev_pop(p).alias("ps"), F.stddev_pop(u).alias("ns"))
    gap = F.col("pm") - F.col("nm")
    return d.select("n_pos", "n_neg", F.round("pm", 6).alias("pos_mean"), F.round("nm", 6).alias("neg_mean"), F.round("ps", 6).alias("pos_std"), F.round("ns", 6).alias("neg_std"), F.round(gap, 6).alias("gap"),
                    F.when(F.abs(gap) < 0.05, "collapse").when(gap < 0, "inversion").otherwise("ok").alias("verdict"))


def nnpu_loss(logits: DataFrame, prior: float, pos_weight: float = 1.0, beta: float = 0.0, gamma: float = 1.0) -> DataFrame:
    """One row (positive_risk, negative_risk, loss, corrected) of ``(logit, target)``: non-negative PU risk.

    The positive side is weighted by prior * pos_weight; where the estimated negative risk falls below
    -beta the loss is gamma times its opposite.
    """
    if not 0 < prior < 1:
        raise ValueError("the prior lies in (0, 1)")
    p, u = F.col("target") == 1, F.col("target") == 0
    mean = lambda c, x: F.coalesce(F.avg(F.when(c, x)), F.lit(0.0))
    d = logits.agg((F.lit(prior * pos_weight) * mean(p, sigmoid(-F.col("logit")))).alias("pos"), (mean(u, sigmoid("logit")) - F.lit(prior) * mean(p, sigmoid("logit"))).alias("neg"))
    bad = F.col("neg") < -beta
    return d.select(F.round("pos", 6).alias("positive_risk"), F.round("neg", 6).alias("negative_risk"), F.round(F.when(bad, -F.lit(gamma) * F.col("neg")).otherwise(F.col("pos") + F.col("neg")), 6).alias("loss"), bad.alias("corrected"))


def pr_curve(scores: DataFrame) -> DataFrame:
    """(threshold, precision, recall) at each distinct score."""
    return by_score(scores).select(F.col("score").alias("threshold"), F.round(F.col("pos_to") / F.col("n_to"), 6).alias("precision"), F.round(F.col("pos_to") / F.col("all_pos"), 6).alias("recall"))


def score_histogram(scores: DataFrame, bins: int = 40) -> DataFrame:
    """(label, bin, n): scores in [0, 1] in equal bins, 1 in the last."""
    b = F.least(F.floor(F.col("score") * bins).cast("int"), F.lit(bins - 1))
    return scores.groupBy("label", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


class BestEpoch:
    """Model selection: the primary metric decides, the second breaks near ties; patience ends training.

    Two marks are kept: ``best`` of the epochs that were taken, and the last value that rose by ``min_delta``,
    from which patience counts.
    """

    def __init__(self, patience: int = 5, min_delta: float = 0.0, tie: float = 2e-3):
        self.patience, self.min_delta, self.tie = patience, min_delta, tie
        self.best = self.second = self.mark = float("-inf")
        self.epoch, self.stale, self._epoch = None, 0, -1

    def update(self, primary: float, second: float = float("-inf")) -> bool:
        """True where this epoch is the best so far."""
        self._epoch += 1
        wins = primary > self.best + self.tie or (primary >= self.best - self.tie and second > self.second)
        if wins:
            self.best, self.second, self.epoch = max(primary, self.best), max(second, self.second), self._epoch
        rose = primary > self.mark + self.min_delta
        self.mark, self.stale = (primary, 0) if rose else (self.mark, self.stale + 1)
        return wins

    @property
    def done(self) -> bool:
        return self.stale >= self.patience


def select_epochs(epochs: DataFrame, patience: int = 5, min_delta: float = 0.0, tie: float = 2e-3) -> DataFrame:
    """(run, best_epoch, best, second, stop_epoch, seen) of ``epochs(run, epoch, primary, second)``: ``BestEpoch`` over many runs at once.

    A run's epochs are folded in their order by one expression in the JVM, runs in parallel; a run has as many rows as it
    was trained for. ``stop_epoch`` is the epoch at which patience ended it, null if none did; later epochs do not count.
    """
    lowest = F.lit(float("-inf"))
    none = F.lit(None).cast("long")
    zero = F.struct(lowest.alias("best"), lowest.alias("second"), lowest.alias("mark"), F.lit(0).alias("stale"), none.alias("epoch"), none.alias("stop"), F.lit(0).alias("seen"))

    def step(at, x):
        second = F.coalesce(x["second"].cast("double"), lowest)
        primary = x["primary"].cast("double")
        wins = (primary > at["best"] + tie) | ((primary >= at["best"] - tie) & (second > at["second"]))
        rose = primary > at["mark"] + min_delta
        stale = F.when(rose, 0).otherwise(at["stale"] + 1)
        new = F.struct(
            F.when(wins, F.greatest(primary, at["best"])).otherwise(at["best"]).alias("best"),
            F.when(wins, F.greatest(second, at["second"])).otherwise(at["second"]).alias("second"),
            F.when(rose, primary).otherwise(at["mark"]).alias("mark"), stale.alias("stale"),
            F.when(wins, x["epoch"].cast("long")).otherwise(at["epoch"]).alias("epoch"),
            F.when(stale >= patience, x["epoch"].cast("long")).alias("stop"), (at["seen"] + 1).alias("seen"))
        return F.when(at["stop"].isNotNull(), at).otherwise(new)

    runs = epochs.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("epoch", "primary", "second"))).alias("all"))
    d = runs.select("run", F.aggregate("all", zero, step).alias("x"))
    return d.select("run", F.col("x.epoch").alias("best_epoch"), "x.best", "x.second", F.col("x.stop").alias("stop_epoch"), "x.seen")
