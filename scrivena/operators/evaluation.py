"""Metrics of predictions: per label, overall, weighted, calibrated, top-k, paired tests.

Predictions have y_true, y_pred and, where asked for, a key, a score or an
array of probabilities.  Ratios with a zero denominator are 0.  Null labels
are no labels: rows with a null y_true or y_pred are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivena.plans.staging import stage

ROUND = 9  # places that sums of fractions keep, so that the order of addition can't show


def ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def rounded(column: Column, places: int = ROUND) -> Column:
    return F.round(column, places)


def label_metrics(predictions: DataFrame, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """by..., label, support, pred_count, correct_count, precision, recall, f1, support_share of each label that is true or predicted.

    Each prediction counts once on its true and once on its predicted label, so one shuffle of partial sums does.
    """
    by = by or []
    one = F.lit(1).cast("long") if weight is None else weight
    zero = F.lit(0) if weight is None else F.lit(0.0)
    rows = predictions.filter("y_true is not null and y_pred is not null").withColumn("_w", one)
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), F.col("_w").alias("s"), zero.cast(rows.schema["_w"].dataType).alias("p"), F.when(F.col("y_true") == F.col("y_pred"), F.col("_w")).otherwise(zero).alias("c")),
        F.struct(F.col("y_pred").alias("label"), zero.cast(rows.schema["_w"].dataType).alias("s"), F.col("_w").alias("p"), zero.cast(rows.schema["_w"].dataType).alias("c")),
    )
    sums = rows.select(*by, F.explode(sides).alias("x")).groupBy(*by, "x.label").agg(F.sum("x.s").alias("support"), F.sum("x.p").alias("pred_count"), F.sum("x.c").alias("correct_count"))
    total = F.sum("support").over(Window.partitionBy(*by))
    precision, recall = ratio(F.col("correct_count"), F.col("pred_count")), ratio(F.col("correct_count"), F.col("support"))
    f1 = ratio(2 * F.col("correct_count"), F.col("pred_count") + F.col("support"))
    return sums.select(*by, "label", "support", "pred_count", "correct_count", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), ratio(F.col("support"), total).alias("support_share"))


def overall_metrics(predictions: DataFrame, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """by..., n_labels, accuracy, macro_precision, macro_recall, macro_f1, weighted_f1."""
    by = by or []
    labels = label_metrics(predictions, by, weight)
    return labels.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_labels"),
        rounded(ratio(F.sum("correct_count"), F.sum("support"))).alias("accuracy"),
        rounded(F.avg("precision")).alias("macro_precision"),
        rounded(F.avg("recall")).alias("macro_recall"),
        rounded(F.avg("f1")).alias("macro_f1"),
        rounded(ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support"))).alias("weighted_f1"),
    )


def inverse_author_weight(author: str = "id_person", by: list[str] | None = None) -> Column:
    """1 / rows of the author (within ``by``)."""
    return 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*(by or []), author))


def author_weighted(predictions: DataFrame, author: str = "id_person") -> DataFrame:
    """overall_metrics in which every author has weight 1."""
    rows = predictions.withColumn("_weight", inverse_author_weight(author))
    return overall_metrics(rows, weight=F.col("_weight"))


def confusion_pairs(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by..., y_true, y_pred, n, error_share of each pair of labels that are confused."""
    by = by or []
    pairs = predictions.filter("y_true <> y_pred").groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("error_share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*by))))


def normalised_confusion(predictions: DataFrame) -> DataFrame:
    """y_true, y_pred, n, share of the true label's rows, in long form; all pairs that occur."""
    pairs = predictions.filter("y_true is not null and y_pred is not null").groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("y_true"))))


def support_bins(labels: DataFrame) -> DataFrame:
    """bin, n_labels, min_support, max_support, mean_recall, mean_f1 by quartile of support; equal edges are one."""
    edges = labels.agg(F.array_distinct(F.percentile("support", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).alias("edges"))
    placed = labels.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("support"))))  # edges: one row
    return placed.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n_labels"),
        F.min("support").alias("min_support"),
        F.max("support").alias("max_support"),
        rounded(F.avg("recall")).alias("mean_recall"),
        rounded(F.avg("f1")).alias("mean_f1"),
    )


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """n, rho: rank correlation, equal values sharing their mean rank; null when one of the two is constant.

    Ranks come from the counts of each value, so what is sorted is as long as there are values.
    """

    def ranks(column: str) -> DataFrame:
        counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counts.select(column, (before + (F.col("_n") + 1) / 2).alias(f"_{column}_rank"))

    ranked = rows.select(x, y).join(ranks(x), x).join(ranks(y), y)
    return ranked.agg(F.count(F.lit(1)).alias("n"), rounded(F.corr(f"_{x}_rank", f"_{y}_rank"), 6).alias("rho"))


def ranked_scores(scores: DataFrame, key: str, k: int) -> DataFrame:
    """key, true_class, top: the k best (score, class) of each key; of equal scores the higher class stands first."""
    best = F.slice(F.sort_array(F.collect_list(F.struct("score", "class")), asc=False), 1, k)
    return scores.groupBy(key).agg(F.first("true_class").alias("true_class"), best.alias("top"))


def ranked_rows(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The same of rows that have a key's (score, class) of all classes together, in ``scores``: nothing is shuffled."""
    return rows.select(key, "true_class", F.slice(F.sort_array("scores", asc=False), 1, k).alias("top"))


def topk_rescue(ranked: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """by..., k, n, n_correct, accuracy, rescued (errors of top 1 that top k has), remaining."""
    by = by or []
    place = F.array_position(F.transform("top", lambda t: t["class"]), F.col("true_class"))
    rows = ranked.withColumn("_place", place).select(*by, "_place", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("k"))
    hit = (F.col("_place") > 0) & (F.col("_place") <= F.col("k"))
    sums = rows.groupBy(*by, "k").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_correct"), F.count_if(hit & (F.col("_place") > 1)).alias("rescued"))
    return sums.select(*by, "k", "n", "n_correct", ratio(F.col("n_correct"), F.col("n")).alias("accuracy"), "rescued", (F.col("n") - F.col("n_correct")).alias("remaining"))


def exact_quantiles(rows: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """by..., and for each name in ``points`` the interpolated quantile of the values; null values are left out.

    Exact, and no group is gathered: equal values become one row with their count, these rows are dealt in order
    over partitions, and the rank of a value is what earlier partitions and earlier values of its own sum up to.
    The table written between keeps partition numbers fixed when tasks are repeated.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    dealt = stage(counts.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()), "quantiles")
    sums = dealt.groupBy(*by, "_part").agg(F.sum("_n").alias("_m"))
    group = Window.partitionBy(*by)  # one row for each partition
    before = F.sum("_m").over(group.orderBy("_part")) - F.col("_m")
    offsets = sums.select(*(F.col(b).alias(f"_by_{b}") for b in by), F.col("_part").alias("_by__part"), before.alias("_before"), F.sum("_m").over(group).alias("_all"))
    placed = dealt.join(offsets, _same([*by, "_part"]))
    end = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy("_v"))
    ranked = placed.withColumn("_end", end)
    at = {name: (F.col("_all") - 1) * p for name, p in points.items()}
    covers = lambda rank: (F.col("_end") - F.col("_n") <= rank) & (rank < F.col("_end"))
    found = ranked.groupBy(*by).agg(
        *(F.max(F.when(covers(F.floor(a)), F.col("_v"))).alias(f"_low_{name}") for name, a in at.items()),
        *(F.max(F.when(covers(F.ceil(a)), F.col("_v"))).alias(f"_high_{name}") for name, a in at.items()),
        *(F.max(a - F.floor(a)).alias(f"_part_{name}") for name, a in at.items()),
    )
    between = lambda name: F.col(f"_low_{name}") * (1 - F.col(f"_part_{name}")) + F.col(f"_high_{name}") * F.col(f"_part_{name}")
    return found.select(*by, *(between(name).alias(name) for name in points))


def _same(by: list[str]) -> Column:
    """Equal keys, nulls too, where the other side's are named with ``_by_`` in front."""
    out = F.lit(True)
    for b in by:
        out = out & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    return out


def quartiles(sums: DataFrame, rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds median_, p25_ and p75_ of the values to the sums of each group."""
    points = {f"median_{name}": 0.5, f"p25_{name}": 0.25, f"p75_{name}": 0.75}
    found = exact_quantiles(rows, by, value, points)
    other = found.select(*(F.col(b).alias(f"_by_{b}") for b in by), *(rounded(F.col(p)).alias(p) for p in points))
    return sums.join(other, _same(by), "left").select(*sums.columns, *points)


def score_margins(ranked: DataFrame, by: list[Column]) -> DataFrame:
    """by..., n, mean, min, max, median, p25, p75 of the distance between the two best scores."""
    margin = F.col("top")[0]["score"] - F.col("top")[1]["score"]
    rows = stage(ranked.select(*by, margin.alias("_m")), "margins")  # read twice
    names = rows.columns[:-1]
    sums = rows.groupBy(*names).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("_m")).alias("mean_margin"), rounded(F.min("_m")).alias("min_margin"), rounded(F.max("_m")).alias("max_margin")
    )
    return quartiles(sums, rows, names, "_m", "margin")


# calibration, over p (array of class probabilities) and y_true (class index)


def with_decision(rows: DataFrame) -> DataFrame:
    """Adds y_pred (the first class of the highest probability), confidence, correct and truth_p (0 where the class is unknown)."""
    confidence = F.array_max("p")
    return rows.withColumns(
        {
            "confidence": confidence,
            "y_pred": (F.array_position("p", confidence) - 1).cast("int"),
            "truth_p": F.coalesce(F.get("p", F.col("y_true")), F.lit(0.0)),
        }
    ).withColumn("correct", F.col("y_true") == F.col("y_pred"))


def brier(rows: DataFrame, by: list[str]) -> DataFrame:
    """by..., n, brier, log_loss (probabilities held within 1e-15 of 0 and 1)."""
    squares = F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x * x) - 2 * F.col("truth_p") + 1
    held = F.greatest(F.least(F.col("truth_p"), F.lit(1 - 1e-15)), F.lit(1e-15))
    return with_decision(rows).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(squares)).alias("brier"), rounded(F.avg(-F.log(held))).alias("log_loss"))


def reliability_curve(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """by..., bin, n, mean_confidence, accuracy over equal bins of confidence, the last one closed."""
    placed = with_decision(rows).withColumn("bin", F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int"))
    return placed.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("confidence")).alias("mean_confidence"), rounded(ratio(F.count_if("correct"), F.count(F.lit(1)))).alias("accuracy")
    )


def expected_calibration_error(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """by..., n, ece: distance of accuracy and mean confidence of the bins, weighted by their rows."""
    placed = with_decision(rows).withColumn("bin", F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int"))
    sums = placed.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("m"), F.abs(F.count_if("correct") - F.sum("confidence")).alias("gap"))
    return sums.groupBy(*by).agg(F.sum("m").alias("n"), rounded(ratio(F.sum("gap"), F.sum("m"))).alias("ece"))


def majority_baseline(rows: DataFrame, by: list[str]) -> DataFrame:
    """by..., label (the smallest of the most frequent), n, accuracy, macro_f1 when it is predicted for all."""
    counts = rows.groupBy(*by, "y_true").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy(*by).agg(F.max_by("y_true", F.struct("n", -F.col("y_true"))).alias("label"), F.max("n").alias("hits"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels"))
    f1 = ratio(2 * F.col("hits"), F.col("hits") + F.col("n"))
    return sums.select(*by, "label", "n", ratio(F.col("hits"), F.col("n")).alias("accuracy"), rounded(f1 / F.col("labels")).alias("macro_f1"))


def target_decision(metrics: DataFrame, baseline: DataFrame, by: str, least_lift: float) -> DataFrame:
    """by, macro_f1, baseline_f1, lift, decision, reason: whether a target is good enough to be used."""
    joined = metrics.join(baseline.select(by, F.col("macro_f1").alias("baseline_f1")), by)
    lift = F.col("macro_f1") - F.col("baseline_f1")
    decision = F.when(lift >= least_lift, "include").otherwise("exclude")
    reason = F.when(lift >= least_lift, "").when(lift > 0, "lift below minimum").otherwise("not above baseline")
    return joined.select(by, "macro_f1", "baseline_f1", rounded(lift).alias("lift"), decision.alias("decision"), reason.alias("reason"))


# paired systems


def mcnemar(a: DataFrame, b: DataFrame, key: str = "id_speech") -> DataFrame:
    """n, both, only_a, only_b, neither, chi2, chi2_corrected, significance of two systems on the same rows.

    Both must have each key once and, where both have y_true, agree on it; else reading the result fails.
    """
    label = F.col("y_true").cast("string") if "y_true" in a.columns and "y_true" in b.columns else F.lit("")
    side = lambda df, mine: df.select(key, F.lit(mine).alias("_mine"), "correct", label.alias("_label"))
    mine = F.col("_mine")
    rows = side(a, True).unionByName(side(b, False)).groupBy(key).agg(
        F.count_if(mine).alias("_n_a"),
        F.count_if(~mine).alias("_n_b"),
        F.max(F.when(mine, F.col("correct"))).alias("_x"),
        F.max(F.when(~mine, F.col("correct"))).alias("_y"),
        (F.count("_label").isin(0, 2) & F.min("_label").eqNullSafe(F.max("_label"))).alias("_agree"),
    )
    x, y = F.col("_x"), F.col("_y")
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"),
        F.count_if((F.col("_n_a") != 1) | (F.col("_n_b") != 1)).alias("_unpaired"), F.count_if(~F.col("_agree")).alias("_apart"),
    )
    paired = F.assert_true(F.col("_unpaired") == 0, "both systems must have each key once").isNull()
    agreed = F.assert_true(F.col("_apart") == 0, "the systems' true labels differ").isNull()
    sums = sums.filter(paired & agreed).drop("_unpaired", "_apart")
    apart = F.abs(F.col("only_a") - F.col("only_b"))
    chi2 = ratio(apart * apart, F.col("only_a") + F.col("only_b"))
    corrected = ratio((apart - 1) * (apart - 1), F.col("only_a") + F.col("only_b"))
    # Critical values of chi-squared with one degree of freedom.
    level = F.when(chi2 > 10.828, "p<0.001").when(chi2 > 6.635, "p<0.01").when(chi2 > 3.841, "p<0.05").otherwise("n.s.")
    return sums.select("*", chi2.alias("chi2"), corrected.alias("chi2_corrected"), level.alias("significance"))


def bootstrap_macro_f1(predictions: DataFrame, draws: int, seed: int, key: str = "id_speech") -> DataFrame:
    """draws, mean, low, high: macro F1 over ``draws`` resamples, and its 95 % percentile interval.

    A row is in a resample as often as a Poisson variable of mean 1 says, which integer arithmetic on the key
    draws; so resampling is one pass over the rows, not a join of draws with rows, and sums are by label.
    """
    u = ((F.col(key) % 1000003) * (F.col("draw") * 7919 + 104729) + F.col("draw") * seed) % 1000003
    cuts = [367880, 735759, 919699, 981012, 996341, 999406, 999917]  # 1000000 x the Poisson distribution of mean 1
    times = F.when(u < cuts[0], 0)
    for k, cut in enumerate(cuts[1:], 1):
        times = times.when(u < cut, k)
    rows = predictions.select(key, "y_true", "y_pred", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("_times", times.otherwise(7).cast("long"))
    scores = label_metrics(rows.filter("_times > 0"), ["draw"], F.col("_times")).groupBy("draw").agg(F.avg("f1").alias("f1"))
    return scores.agg(
        F.count(F.lit(1)).alias("draws"), rounded(F.avg("f1")).alias("mean"), rounded(F.percentile("f1", F.lit(0.025))).alias("low"), rounded(F.percentile("f1", F.lit(0.975))).alias("high")
    )


def erfc(z: Column) -> Column:
    """The complementary error function of z >= 0, to 1e-14: its series below 3, its continued fraction above."""
    term = F.struct(z.alias("t"), z.alias("s"))
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(80)), term, lambda a, n: F.struct((a["t"] * (2 * z * z) / (2 * n + 1)).alias("t"), (a["s"] + a["t"] * (2 * z * z) / (2 * n + 1)).alias("s")))["s"]
    series = 1 - 2 / F.sqrt(F.pi()) * F.exp(-z * z) * grown
    far = F.greatest(z, F.lit(1.0))
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), far, lambda a, n: far + (n / F.lit(2.0)) / a)
    return F.when(z < 3, series).otherwise(F.exp(-z * z) / F.sqrt(F.pi()) / fraction)


def chi2_tail(x: Column) -> Column:
    """The chance that chi-squared with one degree of freedom exceeds x; 1 at 0."""
    return erfc(F.sqrt(x / 2))


def compared(predictions: DataFrame, pairs: list[tuple[str, str]], key: str = "id_speech") -> DataFrame:
    """A row for each pair of systems: n, accuracy and macro F1 of both and their differences, what only one has right, chi-squared and p, plain and corrected.

    ``predictions`` has system, key, y_true and y_pred.  All pairs are counted in one grouping by key; a pair whose systems don't
    have the same keys once each, with the same y_true, makes reading the result fail.
    """
    names = sorted({s for p in pairs for s in p})
    rows = predictions.filter(F.col("system").isin(names)).select(key, "system", "y_true", (F.col("y_true") == F.col("y_pred")).alias("right"))
    once = (F.count(F.lit(1)) == F.count_distinct("system")).alias("_once")
    own = rows.groupBy(key).agg(F.collect_list(F.struct("system", "right")).alias("_all"), once, (F.min("y_true").eqNullSafe(F.max("y_true"))).alias("_agree"))  # a key's systems
    own = own.filter(F.assert_true(F.col("_once"), "a system has a key twice").isNull() & F.assert_true(F.col("_agree"), "the systems' true labels differ").isNull())
    table = F.array(*(F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in pairs))
    each = own.withColumn("_of", F.map_from_entries("_all")).select("_of", F.explode(table).alias("p")).select("p.*", F.try_element_at("_of", F.col("p.source")).alias("x"), F.try_element_at("_of", F.col("p.target")).alias("y"))
    x, y = F.col("x"), F.col("y")
    sums = each.filter(x.isNotNull() | y.isNotNull()).groupBy("source", "target").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"), F.count_if(x.isNull() | y.isNull()).alias("_unpaired")
    )
    sums = sums.filter(F.assert_true(F.col("_unpaired") == 0, "both systems must have each key once").isNull()).drop("_unpaired")
    metrics = overall_metrics(predictions.filter(F.col("system").isin(names)), ["system"]).select("system", "accuracy", "macro_f1")
    for side, name in (("source", "a"), ("target", "b")):
        sums = sums.join(metrics.select(F.col("system").alias(side), F.col("accuracy").alias(f"accuracy_{name}"), F.col("macro_f1").alias(f"macro_f1_{name}")), side)
    apart = F.abs(F.col("only_a") - F.col("only_b"))
    chi2 = ratio(apart * apart, F.col("only_a") + F.col("only_b"))
    corrected = F.when(apart > 0, ratio((apart - 1) * (apart - 1), F.col("only_a") + F.col("only_b"))).otherwise(0.0)
    found = sums.withColumns({"chi2": chi2, "chi2_corrected": corrected})
    return found.select(
        "source", "target", "n", "accuracy_a", "accuracy_b", rounded(F.col("accuracy_b") - F.col("accuracy_a")).alias("accuracy_gain"), "macro_f1_a", "macro_f1_b", rounded(F.col("macro_f1_b") - F.col("macro_f1_a")).alias("macro_f1_gain"),
        "both", "only_a", "only_b", "neither", "chi2", chi2_tail(F.col("chi2")).alias("p"), "chi2_corrected", chi2_tail(F.col("chi2_corrected")).alias("p_corrected"),
    )


#: Different pairs of true and predicted label that a task is sent.
MOST_CELLS = 2_000_000


def _drawn(cells: np.ndarray, counts: np.ndarray, labels: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """draw -> draw, n, f1: a multinomial sample of as many rows over the cells of the confusion matrix, by binomials one after the other."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = int(counts.sum())
        for batch in batches:
            draws = batch.column("draw").to_pylist()
            scores, sizes = [], []
            for draw in draws:
                times = np.random.default_rng([seed, draw]).multinomial(total, counts / total)
                support = np.bincount(cells[:, 0], times, labels)
                guessed = np.bincount(cells[:, 1], times, labels)
                right = np.bincount(cells[:, 0], times * (cells[:, 0] == cells[:, 1]), labels)
                some = support + guessed > 0
                scores.append(float((2 * right[some] / (support + guessed)[some]).mean()))
                sizes.append(int(times.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("draw"), pa.array(sizes, pa.int64()), pa.array(scores)], ["draw", "n", "f1"])

    return drawn


def bootstrap_draws(predictions: DataFrame, draws: int, seed: int) -> DataFrame:
    """draw, n, f1: macro F1 of ``draws`` resamples with replacement, each of as many rows as there are.

    Which rows are drawn matters only through the pairs of true and predicted label, so the counts of these are resampled,
    exactly: the work is different pairs times draws, whatever the rows, and draws are dealt over the tasks.
    """
    counts = predictions.filter("y_true is not null and y_pred is not null").groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counts, "cells")
    if (size := counts.count()) > MOST_CELLS:
        raise ValueError(f"{size} different pairs of labels; at most {MOST_CELLS} are resampled")
    found = sorted(counts.collect(), key=lambda r: (str(r.y_true), str(r.y_pred)))
    spark = predictions.sparkSession
    schema = "draw long, n long, f1 double"
    if not found:
        return spark.createDataFrame([], schema)
    numbers = {label: k for k, label in enumerate(sorted({x for r in found for x in (r.y_true, r.y_pred)}, key=str))}
    cells = np.array([(numbers[r.y_true], numbers[r.y_pred]) for r in found])
    kernel = _drawn(cells, np.array([r.n for r in found], np.float64), len(numbers), seed)
    return spark.range(draws).withColumnRenamed("id", "draw").mapInArrow(kernel, schema)


def bootstrap_interval(predictions: DataFrame, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """draws, mean, low, high: macro F1 over ``bootstrap_draws``, and its 95 % percentile interval."""
    return bootstrap_draws(predictions, draws, seed).agg(
        F.count(F.lit(1)).alias("draws"), rounded(F.avg("f1")).alias("mean"), rounded(F.percentile("f1", F.lit(0.025))).alias("low"), rounded(F.percentile("f1", F.lit(0.975))).alias("high")
    )
