"""Diagnostics of splits and folds: support, reliability, imbalance, balance of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivena.operators.evaluation import ratio, rounded


def support_summary(speeches: DataFrame, folds: DataFrame) -> DataFrame:
    """id_person, fold_id, fold_role, speeches, chars, first/last date, first/last election."""
    rows = folds.select("id_speech", "fold_id", "fold_role").join(speeches.select("id_speech", "id_person", "char_count", "date", "election"), "id_speech")
    return rows.groupBy("id_person", "fold_id", "fold_role").agg(
        F.count(F.lit(1)).alias("speeches"),
        F.sum("char_count").alias("chars"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.min("election").alias("first_election"),
        F.max("election").alias("last_election"),
    )


def reliability_cells(support: DataFrame, least_chars: int, least_speeches: int) -> DataFrame:
    """Validation cells with reason: which minimum they miss; empty for reliable ones."""
    chars, speeches = F.col("chars") < least_chars, F.col("speeches") < least_speeches
    reason = F.when(chars & speeches, "low_chars+low_speeches").when(chars, "low_chars").when(speeches, "low_speeches").otherwise("")
    return support.filter("fold_role = 'val'").select("id_person", "fold_id", "speeches", "chars", reason.alias("reason"), (reason == "").alias("reliable"))


def author_reliability(cells: DataFrame) -> DataFrame:
    """id_person, cells, reliable and excluded ones, least and median characters, reasons, whether all are excluded."""
    return cells.groupBy("id_person").agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if("reliable").alias("reliable_cells"),
        F.count_if(~F.col("reliable")).alias("excluded_cells"),
        F.min("chars").alias("least_chars"),
        F.median("chars").alias("median_chars"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("reason") != "", F.col("reason")))), "|").alias("reasons"),
        (F.count_if("reliable") == 0).alias("fully_excluded"),
    )


def fold_author_summary(support: DataFrame, cells: DataFrame) -> DataFrame:
    """fold_id, fold_role, authors, least and median characters and speeches, date range, excluded cells."""
    sums = support.groupBy("fold_id", "fold_role").agg(
        F.count(F.lit(1)).alias("authors"),
        F.min("chars").alias("least_chars"),
        F.median("chars").alias("median_chars"),
        F.min("speeches").alias("least_speeches"),
        F.median("speeches").alias("median_speeches"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )
    excluded = cells.groupBy("fold_id").agg(F.count_if(~F.col("reliable")).alias("excluded_cells"))
    return sums.join(excluded, "fold_id", "left")


def imbalance(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by..., n, least, most, mean, median, sd (of the population), ratio (null when the least is 0), gini; zeros are left out.

    Gini needs ranks only up to ties, so it is summed over the distinct values of each group.
    """
    some = values.filter(F.col(value) > 0)
    counts = some.groupBy(*by, value).agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("before", F.coalesce(F.sum("m").over(w), F.lit(0)))
    # A value that m rows share has the ranks before + 1 to before + m.
    weighted = F.sum(F.col(value) * (2 * F.col("m") * F.col("before") + F.col("m") * (F.col("m") + 1)))
    gini = ranked.groupBy(*by).agg(weighted.alias("top"), F.sum(F.col("m") * F.col(value)).alias("total"), F.sum("m").alias("n"))
    stats = some.groupBy(*by).agg(
        F.min(value).alias("least"), F.max(value).alias("most"), F.median(value).alias("median"), rounded(F.stddev_pop(value), 4).alias("sd"),
    )
    n, total = F.col("n"), F.col("total")
    return gini.join(stats, by).select(
        *by, "n", "least", "most", ratio(total, n).alias("mean"), "median", "sd", F.try_divide(F.col("most").cast("double"), F.col("least").cast("double")).alias("ratio"),
        rounded(ratio(F.col("top") - (n + 1) * total, n * total)).alias("gini"),
    )


def split_stats(speeches: DataFrame, outer: DataFrame) -> DataFrame:
    """outer_role (and "all"), speeches, authors, parties, characters, range of elections and dates, by grouping sets."""
    rows = outer.select("id_speech", "outer_role").join(speeches, "id_speech")
    return (
        rows.rollup("outer_role")
        .agg(
            F.count(F.lit(1)).alias("speeches"), F.count_distinct("id_person").alias("authors"), F.count_distinct("party").alias("parties"), F.sum("char_count").alias("chars"),
            F.median("char_count").alias("median_chars"), F.min("election").alias("first_election"), F.max("election").alias("last_election"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        )
        .withColumn("outer_role", F.coalesce("outer_role", F.lit("all")))
    )


def label_distribution(rows: DataFrame, targets: list[str], by: str) -> DataFrame:
    """target, by, label, n, share, labels, majority: of each target's labels in each split; a null label is "missing"."""
    long = rows.select(by, F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.coalesce(F.col(t).cast("string"), F.lit("missing")).alias("label")) for t in targets))).alias("x"))
    counts = long.groupBy("x.target", by, "x.label").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("target", by)
    first = F.row_number().over(w.orderBy(F.desc("n"), "label")) == 1
    return counts.select("target", by, "label", "n", ratio(F.col("n"), F.sum("n").over(w)).alias("share"), F.count(F.lit(1)).over(w).alias("labels"), first.alias("majority"))


def target_summary(rows: DataFrame, targets: list[str]) -> DataFrame:
    """target, classes, rows with a label, authors with a label."""
    long = rows.select("id_person", F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.col(t).cast("string").alias("label")) for t in targets))).alias("x"))
    return long.filter("x.label is not null").groupBy("x.target").agg(F.count_distinct("x.label").alias("classes"), F.count(F.lit(1)).alias("rows"), F.count_distinct("id_person").alias("authors"))


def fold_balance(folded: DataFrame, target: str, weight: str | None = None) -> DataFrame:
    """fold_id, fold_role, largest deviation in points from the label shares of all rows, and the labels most over and under.

    ``weight``: None counts speeches; "author" gives each author the weight 1 within a fold and role; "modal" counts authors by
    their most frequent label, the smallest of equal ones.
    """
    unit = ["fold_id", "fold_role"]
    whole = folded.select("id_speech", "id_person", F.col(target).cast("string").alias("label")).distinct()
    rows = folded.select(*unit, "id_speech", "id_person", F.col(target).cast("string").alias("label"))
    if weight == "modal":
        counts = whole.groupBy("id_person", "label").agg(F.count(F.lit(1)).alias("n"))
        place = F.row_number().over(Window.partitionBy("id_person").orderBy(F.desc("n"), "label"))
        modal = counts.withColumn("place", place).filter("place = 1").select("id_person", "label")
        whole = modal
        rows = rows.select(*unit, "id_person").distinct().join(modal, "id_person")
    one = F.lit(1.0)
    if weight == "author":
        whole = whole.withColumn("w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("id_person")))
        rows = rows.withColumn("w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(*unit, "id_person")))
        one = F.col("w")
    expected = whole.groupBy("label").agg(F.sum(one).alias("x")).select("label", (F.col("x") / F.sum("x").over(Window.partitionBy())).alias("expected"))
    seen = rows.groupBy(*unit, "label").agg(F.sum(one).alias("x")).select(*unit, "label", (F.col("x") / F.sum("x").over(Window.partitionBy(*unit))).alias("share"))
    grid = seen.select(*unit).distinct().join(F.broadcast(expected))  # every label of every fold and role: few rows
    points = rounded(100 * (F.coalesce("share", F.lit(0.0)) - F.col("expected")), 6)
    gaps = grid.join(seen, [*unit, "label"], "left").withColumn("points", points)
    return gaps.groupBy(*unit).agg(
        F.max(F.abs("points")).alias("max_points"), F.max_by("label", F.struct("points", "label")).alias("most_over"), F.min_by("label", F.struct("points", "label")).alias("most_under")
    )
