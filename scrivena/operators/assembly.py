"""Rows of a unit put together from their sources: membership, texts, row data, labels and features.

All sources are stacked and grouped by id once, so keys and contents are shuffled once, whatever the
number of sources; that each id of the membership has each source exactly once is checked within that
grouping, and reading the result fails if not.

Cases: an id may be a member of several units; ids that are in no unit are left out; a null value in a source is a
value, a missing row is not; columns of different sources must have different names; a null id is a
key like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assembled(members: DataFrame, sources: dict[str, DataFrame], key: str = "id_speech") -> DataFrame:
    """``members`` (key, unit, role, ...) with all columns of ``sources`` (each with key, once for each id)."""
    own = [c for c in members.columns if c != key]
    columns = {name: [c for c in df.columns if c != key] for name, df in sources.items()}
    names = [c for cs in columns.values() for c in cs]
    twice = {c for c in [key, *own, *names] if [key, *own, *names].count(c) > 1}
    if twice:
        raise ValueError(f"columns in several sources: {sorted(twice)}")
    stacked = members.select(key, F.struct(*own).alias("_member"))
    for name, df in sources.items():
        stacked = stacked.unionByName(df.select(key, F.struct(*columns[name]).alias(f"_{name}") if columns[name] else F.struct(F.lit(True).alias("there")).alias(f"_{name}")), allowMissingColumns=True)
    sums = [x for n in sources for x in (F.count(f"_{n}").alias(f"_n_{n}"), F.first(f"_{n}", ignorenulls=True).alias(f"_{n}"))]
    grouped = stacked.groupBy(key).agg(F.collect_list("_member").alias("_members"), *sums).filter(F.size("_members") > 0)
    for name in sources:
        grouped = grouped.filter(F.assert_true(F.col(f"_n_{name}") == 1, F.concat(F.lit(f"{name}: not one row for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).isNull())
    rows = grouped.withColumn("_m", F.explode("_members"))
    return rows.select(key, *(F.col("_m")[c].alias(c) for c in own), *(F.col(f"_{n}")[c].alias(c) for n, cs in columns.items() for c in cs))


def row_data(rows: DataFrame, outer: DataFrame, split: str, columns: list[str], key: str = "id_speech") -> DataFrame:
    """key, split_name, outer_role and those of ``columns`` that ``rows`` has, of the rows in ``outer`` (key, outer_role)."""
    there = [c for c in columns if c in rows.columns and c != key]
    return rows.join(outer.select(key, "outer_role"), key).select(key, F.lit(split).alias("split_name"), "outer_role", *there)


def targets(rows: DataFrame, labels: list[str], author: bool = True, key: str = "id_speech") -> DataFrame:
    """key, author (if asked for) and the columns of ``labels``; one that isn't there is an error."""
    missing = [c for c in labels if c not in rows.columns]
    if missing:
        raise ValueError(f"labels that are not among the columns: {missing}")
    return rows.select(key, *([F.col("id_person").alias("author")] if author else []), *labels)


def complete(targets: DataFrame, labels: list[str]) -> DataFrame:
    """The rows of ``targets`` in which no label is null."""
    return targets.dropna(subset=labels)
