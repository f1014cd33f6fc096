"""Reports over label metrics and predictions: ranks, concentration, deltas, confusions between groups.

Ranks and top-n slices carry a full order, so results don't depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivena.operators.evaluation import quartiles, ratio, rounded


def author_rankings(metrics: DataFrame) -> DataFrame:
    """metrics (system, label, support, ..., recall, f1) with errors and descending ranks of four measures per system."""
    w = Window.partitionBy("system")
    errors = F.col("support") - F.col("correct_count")
    ranked = metrics.withColumn("errors", errors)
    for name in ("f1", "recall", "precision", "errors"):
        ranked = ranked.withColumn(f"{name}_rank", F.rank().over(w.orderBy(F.desc(name))))
    return ranked.select("system", "label", "support", "errors", "f1", "f1_rank", "recall_rank", "precision_rank", "errors_rank")


def ranked_slice(rankings: DataFrame, measure: str, n: int, best: bool) -> DataFrame:
    """The n best or worst authors of each system by a measure; ties by larger support, then label."""
    first = F.desc(measure) if best else F.asc(measure)
    place = F.row_number().over(Window.partitionBy("system").orderBy(first, F.desc("support"), "label"))
    return rankings.withColumn("place", place).filter(F.col("place") <= n).select("system", "place", "label", "support", F.col(measure))


def error_concentration(rankings: DataFrame, cutoffs: list[int]) -> DataFrame:
    """system, top_n, errors, error_share, labels: share of errors made by the n authors with the most."""
    w = Window.partitionBy("system")
    placed = rankings.withColumns({"place": F.row_number().over(w.orderBy(F.desc("errors"), "label")), "total": F.sum("errors").over(w)})
    wide = placed.withColumn("top_n", F.explode(F.array(*map(F.lit, cutoffs)))).filter(F.col("place") <= F.col("top_n"))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]), "; ")
    return wide.groupBy("system", "top_n").agg(F.sum("errors").alias("errors"), ratio(F.sum("errors"), F.max("total")).alias("error_share"), names.alias("labels"))


def symmetric_confusions(pairs: DataFrame, n: int) -> DataFrame:
    """The n most confused unordered pairs of each system: both directions, total and share of errors."""
    low, high = F.least("y_true", "y_pred"), F.greatest("y_true", "y_pred")
    sums = (
        pairs.groupBy("system", low.alias("author_a"), high.alias("author_b"))
        .agg(F.sum(F.when(F.col("y_true") < F.col("y_pred"), F.col("n")).otherwise(0)).alias("a_as_b"), F.sum(F.when(F.col("y_true") > F.col("y_pred"), F.col("n")).otherwise(0)).alias("b_as_a"))
        .withColumn("total", F.col("a_as_b") + F.col("b_as_a"))
    )
    w = Window.partitionBy("system")
    ranked = sums.withColumn("share", ratio(F.col("total"), F.sum("total").over(w))).withColumn("place", F.row_number().over(w.orderBy(F.desc("total"), "author_a", "author_b")))
    return ranked.filter(F.col("place") <= n)


def with_parties(pairs: DataFrame, authors: DataFrame) -> DataFrame:
    """Confused pairs with the party of the true and of the predicted author."""
    true, pred = (authors.select(F.col("author").alias(c), F.col("party").alias(f"{c}_party")) for c in ("y_true", "y_pred"))
    return pairs.join(true, "y_true", "left").join(pred, "y_pred", "left")


def party_confusion_summary(pairs: DataFrame) -> DataFrame:
    """system, same_party, n, share of errors within and across parties."""
    same = F.coalesce(F.col("y_true_party") == F.col("y_pred_party"), F.lit(False))
    sums = pairs.groupBy("system", same.alias("same_party")).agg(F.sum("n").alias("n"))
    return sums.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("system"))))


def party_pair_confusions(pairs: DataFrame) -> DataFrame:
    """system, true party, predicted party, n, share of the system's errors."""
    sums = pairs.groupBy("system", "y_true_party", "y_pred_party").agg(F.sum("n").alias("n"))
    return sums.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("system"))))


def top_confusions(pairs: DataFrame, n: int) -> DataFrame:
    """The n most frequent directed confusions of each system."""
    place = F.row_number().over(Window.partitionBy("system").orderBy(F.desc("n"), "y_true", "y_pred"))
    return pairs.withColumn("place", place).filter(F.col("place") <= n).select("system", "place", "y_true", "y_pred", "n")


def metric_deltas(metrics: DataFrame, before: str, after: str) -> DataFrame:
    """label, support, f1 of two systems, delta, direction, rank by gain and by loss."""
    a = metrics.filter(F.col("system") == before).select("label", "support", F.col("f1").alias("f1_before"))
    b = metrics.filter(F.col("system") == after).select("label", F.col("f1").alias("f1_after"))
    delta = F.col("f1_after") - F.col("f1_before")
    direction = F.when(delta > 0, "improved").when(delta < 0, "worse").otherwise("unchanged")
    joined = a.join(b, "label").withColumns({"delta": delta, "direction": direction})
    return joined.withColumns({"gain_rank": F.rank().over(Window.orderBy(F.desc("delta"))), "loss_rank": F.rank().over(Window.orderBy("delta"))})


def delta_summary(deltas: DataFrame) -> DataFrame:
    """Counts by direction, mean, median and support-weighted mean delta, and the authors of the best gain and loss."""
    return deltas.agg(
        F.count_if(F.col("direction") == "improved").alias("improved"),
        F.count_if(F.col("direction") == "worse").alias("worse"),
        F.count_if(F.col("direction") == "unchanged").alias("unchanged"),
        rounded(F.avg("delta")).alias("mean_delta"),
        rounded(F.median("delta")).alias("median_delta"),
        rounded(ratio(F.sum(F.col("delta") * F.col("support")), F.sum("support"))).alias("weighted_delta"),
        F.max_by("label", F.struct("delta", "label")).alias("best_gain"),
        F.min_by("label", F.struct("delta", "label")).alias("best_loss"),
    )


def prediction_slice(predictions: DataFrame, n: int, errors: bool, key: str = "id_speech") -> DataFrame:
    """The n most confident errors, or the n least confident right predictions, of each system."""
    rows = predictions.filter(F.col("correct") != errors)
    order = F.desc("confidence") if errors else F.asc("confidence")
    place = F.row_number().over(Window.partitionBy("system").orderBy(order, key))
    return rows.withColumn("place", place).filter(F.col("place") <= n).select("system", "place", key, "y_true", "y_pred", "confidence")


def contingency(attribution: DataFrame, profile: DataFrame, key: str = "id_speech") -> DataFrame:
    """Rows and shares by correctness of attribution and of a profile of the same speech."""
    joined = attribution.select(key, F.col("correct").alias("attribution_correct")).join(profile.select(key, F.col("correct").alias("profile_correct")), key)
    sums = joined.groupBy("attribution_correct", "profile_correct").agg(F.count(F.lit(1)).alias("n"))
    return sums.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy())))


def joint_errors(attribution: DataFrame, profile: DataFrame, n: int, key: str = "id_speech") -> DataFrame:
    """The n speeches with the highest profile confidence that both get wrong."""
    a = attribution.filter(~F.col("correct")).select(key, "y_true", "y_pred")
    b = profile.filter(~F.col("correct")).select(key, F.col("y_true").alias("profile_true"), F.col("y_pred").alias("profile_pred"), "confidence")
    return a.join(b, key).orderBy(F.desc("confidence"), key).limit(n)


def confidence_by_correctness(rows: DataFrame, by: list[str]) -> DataFrame:
    """by..., correct, n, share, mean, median, p25, p75 of confidence."""
    sums = rows.groupBy(*by, "correct").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("confidence")).alias("mean_confidence"))
    with_share = sums.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*by))))
    return quartiles(with_share, rows, [*by, "correct"], "confidence", "confidence")


def profile_confusions(rows: DataFrame, by: list[str]) -> DataFrame:
    """by..., y_true, y_pred, n, mean and max confidence, share of the true label's rows."""
    sums = rows.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("confidence")).alias("mean_confidence"), rounded(F.max("confidence")).alias("max_confidence"))
    return sums.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*by, "y_true"))))
