"""Cleaning of speeches: filters, imputation, deduplication, party and language rules.

"First" is by an order that is given, never by the order in which rows come.
Cheap filters stand before expressions over texts, so that Spark reads and
rewrites fewer texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scrivena.functions import text as tx

Stage = tuple[str, Callable[[DataFrame], DataFrame]]


def clean_dates(df: DataFrame, column: str = "date") -> DataFrame:
    """Rows whose date is a valid yyyy-MM-dd, as a date."""
    return df.withColumn(column, F.try_to_date(F.col(column), "yyyy-MM-dd")).filter(F.col(column).isNotNull())


def supported_elections(df: DataFrame, least: int, column: str = "election") -> DataFrame:
    """Rows whose election, a number or the first year in a text, is at least ``least``."""
    text = F.col(column).cast("string")
    found = F.regexp_extract(text, r"((?:19|20)\d{2})", 1)
    year = F.coalesce(text.try_cast("double").cast("int"), F.when(found != "", found.cast("int")))
    return df.withColumn(column, year).filter(F.col(column) >= least)


def without_procedural(df: DataFrame, statuses: list[str]) -> DataFrame:
    """Rows whose status is not one of ``statuses`` and whose procedural column is blank."""
    blank = F.trim(F.coalesce("procedural", F.lit(""))) == ""
    return df.filter(blank & ~F.lower(F.trim(F.coalesce("status", F.lit("")))).isin(statuses))


def with_age(df: DataFrame) -> DataFrame:
    """Missing birth years filled where an author has just one other, and the age at the date."""
    w = Window.partitionBy("id_person")
    only = F.when(F.min("birthyear").over(w) == F.max("birthyear").over(w), F.min("birthyear").over(w))
    filled = df.withColumn("birthyear", F.coalesce("birthyear", only))
    return filled.withColumn("age", F.year("date") - F.col("birthyear"))


def with_fixes(df: DataFrame, fixes: DataFrame, column: str, name: str = "name") -> DataFrame:
    """``df`` with ``column`` as a reviewed table ``fixes`` (name, since, value) says, for rows of that name dated since then.

    Names are compared without case and outer or repeated spaces; of several fixes of a row the one with the latest ``since`` holds, a null
    ``since`` for all dates.  Other rows, and those of a null name, stay as they are.
    """
    folded = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    by_name = fixes.groupBy(folded(F.col("name")).alias("_name")).agg(F.array_sort(F.collect_list(F.struct("since", "value"))).alias("_fixes"))  # reviewed by hand
    joined = df.join(by_name, folded(F.col(name)) == F.col("_name"), "left")
    due = F.filter("_fixes", lambda f: f["since"].isNull() | (f["since"] <= F.col("date")))
    last = F.try_element_at(due, F.lit(-1))["value"]
    return joined.withColumn(column, F.coalesce(last, F.col(column))).drop("_name", "_fixes")


def with_columns_only(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of ``columns`` that there are, in that order; a missing ``partyname`` is null."""
    if "partyname" not in df.columns:
        df = df.withColumn("partyname", F.lit(None).cast("string"))
    return df.select(*(c for c in columns if c in df.columns))


def supported_languages(df: DataFrame, languages: list[str]) -> DataFrame:
    """Rows in one of ``languages``; null is none."""
    return df.filter(F.col("language").isin(languages))


def distribution(authors: DataFrame, column: str) -> DataFrame:
    """column, count, pct of the authors' values, null among them."""
    counts = authors.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    whole = counts.agg(F.sum("count").alias("_whole"))
    return counts.crossJoin(F.broadcast(whole)).select(column, "count", (100.0 * F.col("count") / F.col("_whole")).alias("pct"))  # whole: one row


def complete_profiles(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def with_party_names(df: DataFrame) -> DataFrame:
    """Missing party names filled with the party's most frequent one, the first of equal ones by name."""
    key = F.upper(F.trim("party"))
    counts = df.filter("partyname is not null").groupBy(key.alias("_key"), "partyname").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("n"), "partyname"))
    usual = counts.withColumn("place", place).filter("place = 1").select("_key", F.col("partyname").alias("_usual"))
    joined = df.withColumn("_key", key).join(usual, "_key", "left")
    return joined.withColumn("partyname", F.coalesce("partyname", "_usual")).drop("_key", "_usual")


def party_shares(df: DataFrame) -> DataFrame:
    """party (trimmed), words, percent of all words, rounded to 6 places; placeholders of none and their words are left out."""
    known = df.withColumn("party", when_blank(F.col("party"))).filter("party is not null")
    sums = known.groupBy("party").agg(F.sum("word_count").alias("words"))
    return sums.withColumn("percent", F.round(100.0 * F.col("words") / F.sum("words").over(Window.partitionBy()), 6))


def without_small_parties(df: DataFrame, least_percent: float) -> DataFrame:
    """Without parties below a percentage of the words; rows without a party stay."""
    small = party_shares(df).filter(F.col("percent") < least_percent)
    return df.join(small.select(F.col("party").alias("_small")), when_blank(df["party"]) == F.col("_small"), "left_anti")


def without_small_parties_by_language(df: DataFrame, least_percent: float, languages: list[str]) -> DataFrame:
    """The union of each language's rows without the parties that are small in it."""
    views = [without_small_parties(df.filter(F.col("language") == language), least_percent) for language in languages]
    out = views[0]
    for view in views[1:]:
        out = out.unionByName(view)
    return out


def party_switchers(df: DataFrame) -> DataFrame:
    """id_person, parties in order of first appearance, of authors with more than one; placeholders of none are no party."""
    first = df.withColumn("party", when_blank(F.col("party"))).filter("party is not null").groupBy("id_person", "party").agg(F.min(F.struct("date", "time", "id_speech")).alias("since"))
    sequence = F.transform(F.array_sort(F.collect_list(F.struct("since", "party"))), lambda x: x["party"])
    return first.groupBy("id_person").agg(F.count(F.lit(1)).alias("n_parties"), F.array_join(sequence, ">").alias("parties")).filter("n_parties > 1")


def majority_party_rows(df: DataFrame) -> DataFrame:
    """Of authors with several parties the rows of the most frequent one; ties by the later last date, then the greater name.

    Other authors keep all rows; placeholders of none are no party.
    """
    counts = df.select("id_person", when_blank(F.col("party")).alias("_main"), "date").filter("_main is not null").groupBy("id_person", "_main").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("last"))
    mine = Window.partitionBy("id_person")
    place = F.row_number().over(mine.orderBy(F.desc("n"), F.desc("last"), F.desc("_main")))
    main = counts.select("id_person", "_main", place.alias("place"), F.count(F.lit(1)).over(mine).alias("parties")).filter("place = 1 and parties > 1").select("id_person", "_main")
    joined = df.join(main, "id_person", "left")
    return joined.filter(F.col("_main").isNull() | when_blank(F.col("party")).eqNullSafe(F.col("_main"))).drop("_main")


def majority_language_rows(df: DataFrame, tie_break: str) -> DataFrame:
    """Rows of an author's most frequent language; ties go to ``tie_break``, then to the first by name."""
    counts = df.filter("language is not null").groupBy("id_person", "language").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("id_person").orderBy(F.desc("n"), F.desc(F.col("language") == tie_break), "language"))
    main = counts.withColumn("place", place).filter("place = 1").select("id_person", "language")
    return df.join(main, ["id_person", "language"], "left_semi")


def first_of_duplicates(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row, by ``order``, of those with equal keys; nulls are equal."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def audited(df: DataFrame, stages: list[Stage], author: str = "id_person") -> DataFrame:
    """stage_no, stage, rows and authors before and after each stage, and the differences.

    Each stage is one branch of a union over the same plan, so nothing is collected between stages.
    """
    frames = [("input", df)]
    for name, function in stages:
        frames.append((name, function(frames[-1][1])))
    counts = [f.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(author).alias("authors")).select(F.lit(k).alias("stage_no"), F.lit(n).alias("stage"), "rows", "authors") for k, (n, f) in enumerate(frames)]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    w = Window.partitionBy().orderBy("stage_no")  # one row for each stage
    before = lambda c: F.coalesce(F.lag(c).over(w), F.col(c))
    return out.select("stage_no", "stage", "rows", "authors", (before("rows") - F.col("rows")).alias("rows_removed"), (before("authors") - F.col("authors")).alias("authors_removed"))


# descriptive tables


def corpus_overview(df: DataFrame) -> DataFrame:
    """One row of counts, ranges, sums, medians and the share of women among authors."""
    women = df.groupBy("id_person").agg(F.max("female").alias("f")).agg((100.0 * F.sum("f") / F.count(F.lit(1))).alias("female_percent"))
    sums = df.agg(
        F.count(F.lit(1)).alias("speeches"), F.count_distinct("id_person").alias("authors"), F.count_distinct("party").alias("parties"), F.count_distinct("election").alias("elections"),
        F.min("election").alias("first_election"), F.max("election").alias("last_election"), F.sum("word_count").alias("words"), F.sum("char_count").alias("chars"),
        (F.sum("word_count") / F.count("word_count")).alias("mean_words"), F.median("word_count").alias("median_words"),
    )
    return sums.crossJoin(women)  # one row each


def grouped_overview(df: DataFrame, by: str) -> DataFrame:
    """by, speeches, authors, words, mean and median words; null groups are left out."""
    return df.filter(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("speeches"), F.count_distinct("id_person").alias("authors"), F.sum("word_count").alias("words"),
        (F.sum("word_count") / F.count("word_count")).alias("mean_words"), F.median("word_count").alias("median_words"),
    )


def author_overview(df: DataFrame) -> DataFrame:
    """id_person, name and party of the first speech, main language, speeches, words, first and last date."""
    order = F.struct("date", "time", "id_speech")
    return df.groupBy("id_person").agg(
        F.min_by("name", order).alias("name"), F.min_by("party", order).alias("party"), F.mode("language", True).alias("main_language"),
        F.count(F.lit(1)).alias("speeches"), F.sum("word_count").alias("words"), F.min("date").cast("string").alias("first_date"), F.max("date").cast("string").alias("last_date"),
    )


def percentiles(df: DataFrame, column: str, points: list[float]) -> DataFrame:
    """percentile, value (whole part) in long form."""
    found = df.agg(F.percentile(column, F.array(*map(F.lit, points))).alias("v"))
    rows = F.arrays_zip(F.array(*map(F.lit, points)).alias("percentile"), F.col("v").alias("value"))
    return found.select(F.explode(rows).alias("x")).select("x.percentile", F.floor("x.value").cast("long").alias("value"))


def shares(df: DataFrame, within: str, label: str) -> DataFrame:
    """within, label, n, percent of the rows of ``within``."""
    counts = df.groupBy(within, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(within)))


def threshold_report(df: DataFrame, column: str, threshold: int) -> DataFrame:
    """p99 of a length, rows at or below and above it, rows below the threshold."""
    top = df.agg(F.percentile(column, F.lit(0.99)).alias("p99"))
    return df.crossJoin(F.broadcast(top)).agg(  # top: one row
        F.max("p99").alias("p99"), F.count_if(F.col(column) <= F.col("p99")).alias("up_to_p99"), F.count_if(F.col(column) > F.col("p99")).alias("above_p99"), F.count_if(F.col(column) < threshold).alias("below_threshold")
    )


# redaction by a table of values


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    """Spark has no function for this normal form; it is applied to different candidates only, not to texts."""
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def candidates(values: DataFrame) -> DataFrame:
    """value: different values of the first column in normal form, white space as single spaces; empty ones are left out."""
    different = values.toDF("value").filter("value is not null").distinct()
    plain = F.regexp_replace(F.regexp_replace(_nfkc("value"), "[\u00ad\u200b\u200c\u200d\ufeff]", ""), r"[\s\x0B\u00a0\u202f]+", " ")
    return different.select(F.trim(plain).alias("value")).filter("value <> ''").distinct()


def name_candidates(df: DataFrame, columns: list[str], least_part: int = 2) -> DataFrame:
    """value: the names in the columns that ``df`` has, and their parts of ``least_part`` letters or more."""
    present = [F.col(c).cast("string") for c in columns if c in df.columns]
    names = candidates(df.select(F.explode(F.array(*present) if present else F.array().cast("array<string>"))))
    parts = names.select(F.explode(F.split("value", " ")).alias("value")).filter(F.length("value") >= least_part)
    return names.unionByName(parts).distinct()


def party_candidates(df: DataFrame, aliases: dict[str, list[str]], codes: list[str]) -> DataFrame:
    """value: party names, those codes that are listed, and what codes stand for (aliases by lower-case code)."""
    code = F.trim("party")
    known = F.array(*(F.struct(F.lit(c.lower()).alias("code"), F.array(*map(F.lit, names)).alias("names")) for c, names in aliases.items()))
    named = F.flatten(F.transform(F.filter(known, lambda a: a["code"] == F.lower(code)), lambda a: a["names"])) if aliases else F.array().cast("array<string>")
    listed = F.when(code.isin(codes), code)
    return candidates(df.select("party", "partyname").distinct().select(F.explode(F.concat(F.array("partyname", listed), F.coalesce(named, F.array().cast("array<string>"))))))


def redacted_by(df: DataFrame, values: DataFrame, replacement: str, key: str, column: str = "text") -> DataFrame:
    """``df`` with values replaced in a column, and n, the replacements; any number of values.

    Words of the texts are joined with the first words of the values, so a text is searched for the values that
    can be in it and no pattern of all values is made.  A null text stays null, with n 0; rows that repeat a key are searched
    for each other's values too, which changes nothing.  A column n is replaced.
    """
    first = F.coalesce(F.get(tx.folded_words(F.col("value")), F.lit(0)), F.lit(""))
    wanted = values.select(F.trim("value").alias("value")).filter(F.length("value") >= 2).distinct().select(first.alias("_word"), F.struct((-F.length("value")).alias("size"), F.col("value"), tx.fragment(F.col("value")).alias("fragment")).alias("_value"))
    words = tx.folded_words(F.col(column))
    stems = F.transform(F.filter(words, lambda w: w.endswith("s")), lambda w: F.substring(w, 1, F.length(w) - 1))
    mine = df.filter(F.col(column).isNotNull()).select(F.col(key).alias("_key"), F.explode(F.array_distinct(F.concat(words, stems, F.array(F.lit(""))))).alias("_word"))
    found = mine.join(wanted, "_word").groupBy("_key").agg(F.array_sort(F.collect_set("_value")).alias("_values"))
    patterns = found.select("_key", tx.whole_words(F.transform("_values", lambda v: v["fragment"])).alias("_pattern"))
    joined = df.join(patterns, F.col(key).eqNullSafe(F.col("_key")), "left")
    text, pattern = F.col(column), F.col("_pattern")
    hits = F.coalesce(F.regexp_count(text, pattern), F.lit(0))
    replaced = F.when(pattern.isNotNull(), F.regexp_replace(text, pattern, F.lit(replacement))).otherwise(text)
    return joined.withColumns({"n": hits, column: replaced}).select(*(c for c in df.columns if c != "n"), "n")


def when_blank(column: Column) -> Column:
    """Trimmed party codes; blanks and the words that stand for none as null."""
    text = F.trim(column)
    return F.when(F.lower(text).isin("", "nan", "none", "<na>"), None).otherwise(text)
