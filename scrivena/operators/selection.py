"""Model selection and importance: summaries of candidates, best ones by condition, stability, coefficient shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivena.operators.evaluation import ratio, rounded


def candidate_summary(metrics: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """keys..., units, mean and standard deviation of the sample of a metric over units, rank by mean, ties by key."""
    sums = metrics.groupBy(*keys).agg(F.count(F.lit(1)).alias("units"), rounded(F.avg(metric)).alias("mean"), rounded(F.stddev_samp(metric), 6).alias("sd"))
    return sums.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), *keys)))


def best_by_condition(summary: DataFrame, condition: str, candidate: str, n: int = 1) -> DataFrame:
    """The n best candidates of each condition."""
    place = F.row_number().over(Window.partitionBy(condition).orderBy(F.desc("mean"), candidate))
    return summary.withColumn("place", place).filter(F.col("place") <= n).select(condition, candidate, "place", "mean")


def selection_margin(summary: DataFrame, condition: str, candidate: str) -> DataFrame:
    """condition, best candidate, its mean, the runner-up's mean and the margin (null without one)."""
    w = Window.partitionBy(condition).orderBy(F.desc("mean"), candidate)
    rows = summary.withColumns({"place": F.row_number().over(w), "next_mean": F.lead("mean").over(w)})
    return rows.filter("place = 1").select(condition, candidate, "mean", "next_mean", rounded(F.col("mean") - F.col("next_mean")).alias("margin"))


def fold_stability(metrics: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """keys..., mean, standard deviation of the sample, least and best value with their units."""
    order = F.struct(metric, "unit_id")
    return metrics.groupBy(*keys).agg(
        rounded(F.avg(metric)).alias("mean"), rounded(F.stddev_samp(metric), 6).alias("sd"), F.min(metric).alias("least"), F.max(metric).alias("most"),
        F.max_by("unit_id", order).alias("best_unit"), F.min_by("unit_id", order).alias("worst_unit"),
    )


def block_comparison(summary: DataFrame, kind: str, candidate: str) -> DataFrame:
    """kind, candidates, mean, median and best mean, and the best candidate."""
    return summary.groupBy(kind).agg(
        F.count(F.lit(1)).alias("candidates"), rounded(F.avg("mean"), 7).alias("mean_of_means"), rounded(F.median("mean"), 7).alias("median_of_means"), F.max("mean").alias("best_mean"),
        F.max_by(candidate, F.struct("mean", candidate)).alias("best_candidate"),
    )


def block_kind(blocks: Column) -> Column:
    """base, probability, hard or mixed by the tokens of a block list such as "char+word+prob_sex"."""
    tokens = F.split(blocks, r"\+")
    prob, hard = F.exists(tokens, lambda t: t.startswith("prob_")), F.exists(tokens, lambda t: t.startswith("hard_"))
    return F.when(prob & hard, "mixed").when(prob, "probability").when(hard, "hard").otherwise("base")


def decision(best: DataFrame, drift: DataFrame, least_score: float, most_gap: float) -> DataFrame:
    """go or no-go from the best mean and the largest standardised gap."""
    joined = best.agg(F.max("mean").alias("best_mean")).crossJoin(drift.agg(F.max("standard_gap").alias("max_gap")))  # one row each
    good, steady = F.col("best_mean") >= least_score, F.col("max_gap") <= most_gap
    reason = F.when(good & steady, "").when(good, "drift").when(steady, "score").otherwise("score+drift")
    return joined.select("best_mean", "max_gap", F.when(good & steady, "go").otherwise("no-go").alias("decision"), reason.alias("reason"))


def global_importance(coefficients: DataFrame) -> DataFrame:
    """block, feature, mean and largest absolute coefficient over classes, and the share of all means."""
    sums = coefficients.groupBy("block", "feature").agg(rounded(F.avg(F.abs("coef"))).alias("mean_abs"), F.max(F.abs("coef")).alias("max_abs"))
    return sums.withColumn("share", rounded(ratio(F.col("mean_abs"), F.sum("mean_abs").over(Window.partitionBy()))))


def grouped_importance(importance: DataFrame, by: list[str]) -> DataFrame:
    """by..., features, sum of mean absolute coefficients and its share."""
    sums = importance.groupBy(*by).agg(F.count(F.lit(1)).alias("features"), rounded(F.sum("mean_abs"), 6).alias("total"))
    return sums.withColumn("share", rounded(ratio(F.col("total"), F.sum("total").over(Window.partitionBy())), 6))


def top_features(coefficients: DataFrame, n: int) -> DataFrame:
    """class, direction, place, feature, coef: the n largest and n smallest coefficients of each class."""
    w = Window.partitionBy("class")
    rows = coefficients.withColumns({"up": F.row_number().over(w.orderBy(F.desc("coef"), "block", "feature")), "down": F.row_number().over(w.orderBy("coef", "block", "feature"))})
    sides = F.array(F.struct(F.lit("positive").alias("direction"), F.col("up").alias("place")), F.struct(F.lit("negative").alias("direction"), F.col("down").alias("place")))
    return rows.select("class", "block", "feature", "coef", F.explode(sides).alias("x")).filter(F.col("x.place") <= n).select("class", "x.direction", "x.place", "block", "feature", "coef")
