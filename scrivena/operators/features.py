"""Row features of texts, their quality and drift, TF-IDF by fold, scaling and class blocks.

Texts stand in (id, text); wide feature rows become (id, feature, value) in
long form once and are then summed by one grouping, however many features
there are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivena.functions import text as tx
from scrivena.operators import grams as gr
from scrivena.operators import runs
from scrivena.operators.evaluation import ratio, rounded
from scrivena.plans.staging import spread, stage

MOST_BROADCAST = 200_000  # terms
MOST_BYTES = 64 << 20  # of these
TEXT_COUNTS = ["n_tokens", "n_sentences", "n_long", "n_chars", "mean_token_length", "lix", "rix"]


def char_distribution(texts: DataFrame, key: str, letters: list[str] = tx.LETTERS) -> DataFrame:
    """key, share of each letter, of letters, digits, white space and other characters."""
    text = F.coalesce("text", F.lit(""))
    length = F.length(text)
    kinds = {"share_alpha": r"\p{L}", "share_digit": r"\p{N}", "share_space": r"\s"}
    counts = {name: F.regexp_count(text, F.lit(pattern)) for name, pattern in kinds.items()}
    other = length - counts["share_alpha"] - counts["share_digit"] - counts["share_space"]
    return texts.select(
        key,
        *(tx.share_of_letter(text, c).alias(f"letter_{k:02d}") for k, c in enumerate(letters)),
        *(ratio(c, length).alias(name) for name, c in counts.items()),
        ratio(other, length).alias("share_other"),
    )


def function_words(texts: DataFrame, key: str, words: list[str]) -> DataFrame:
    """key, share of each word among the tokens, and of all of them."""
    rows = texts.select(key, tx.tokens(F.col("text")).alias("t"))
    n = F.size("t")
    each = [ratio(F.size(_only("t", w)), n).alias(f"word_{w}") for w in words]
    listed = F.size(F.filter("t", lambda x: x.isin(words)))
    return rows.select(key, *each, ratio(listed, n).alias("share_listed"))


def _only(column: str, word: str) -> Column:
    return F.filter(column, lambda x: x == word)


def text_counts(texts: DataFrame, key: str) -> DataFrame:
    """key, tokens, sentences (runs of . ! ?, one at least), tokens over six letters, characters in tokens, their mean, LIX and RIX."""
    rows = texts.select(key, tx.tokens(F.col("text")).alias("t"), F.greatest(F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[.!?]+")), F.lit(1)).alias("s"))
    counts = rows.select(
        key,
        F.size("t").cast("long").alias("n_tokens"),
        F.col("s").cast("long").alias("n_sentences"),
        F.size(F.filter("t", lambda x: F.length(x) > 6)).cast("long").alias("n_long"),
        F.length(F.array_join("t", "")).cast("long").alias("n_chars"),
    )
    n, s, long = F.col("n_tokens"), F.col("n_sentences"), F.col("n_long")
    return counts.select("*", ratio(F.col("n_chars"), n).alias("mean_token_length"), (ratio(n, s) + ratio(100 * long, n)).alias("lix"), ratio(long, s).alias("rix"))


def long_features(wide: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """keys..., feature, value; what is not finite is 0."""
    long = wide.select(*keys, *(F.col(f).cast("double").alias(f) for f in features)).unpivot(keys, features, "feature", "value")
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    return long.withColumn("value", F.when(bad, 0.0).otherwise(F.col("value")))


def feature_quality(long: DataFrame, by: str, low_variance: float) -> DataFrame:
    """by (and "all"), feature, n, mean, variance of the population, share of zeros, flags for all zero and low variance."""
    sums = long.groupBy(by, "feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.count_if(F.col("value") == 0).alias("z")
    )
    whole = sums.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q", "z"))).select(F.lit("all").alias(by), "feature", "n", "s", "q", "z")
    mean = F.col("s") / F.col("n")
    variance = F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))
    return sums.unionByName(whole).select(
        by, "feature", "n", rounded(mean, 6).alias("mean"), rounded(variance, 4).alias("variance"), ratio(F.col("z"), F.col("n")).alias("zero_share"),
        (F.col("z") == F.col("n")).alias("all_zero"), (variance < low_variance).alias("low_variance"),
    )


def feature_drift(long: DataFrame, role: str = "role") -> DataFrame:
    """feature, train and eval mean, gap, gap over the pooled standard deviation (0 without any)."""
    train, held = F.col(role) == "train", F.col(role) == "eval"
    sums = long.groupBy("feature").agg(
        F.avg(F.when(train, F.col("value"))).alias("a"), F.avg(F.when(held, F.col("value"))).alias("b"), F.var_pop(F.when(train, F.col("value"))).alias("va"), F.var_pop(F.when(held, F.col("value"))).alias("vb")
    )
    gap = F.col("b") - F.col("a")
    pooled = F.sqrt((F.col("va") + F.col("vb")) / 2)
    return sums.select("feature", rounded(F.col("a"), 6).alias("train_mean"), rounded(F.col("b"), 6).alias("eval_mean"), rounded(gap, 6).alias("gap"), rounded(ratio(F.abs(gap), pooled), 6).alias("standard_gap"))


def drift_summary(drift: DataFrame) -> DataFrame:
    return drift.agg(
        F.count(F.lit(1)).alias("features"), rounded(F.avg("standard_gap"), 5).alias("mean_gap"), rounded(F.median("standard_gap"), 5).alias("median_gap"), F.max("standard_gap").alias("max_gap"),
        F.count_if(F.col("standard_gap") > 0.5).alias("above_half"), F.count_if(F.col("standard_gap") > 1).alias("above_one"),
    )


def standard_scaled(long: DataFrame, key: str, role: str = "role") -> DataFrame:
    """key, feature, z: by mean and standard deviation of the population of the train rows; features without variance are left out."""
    fit = long.filter(F.col(role) == "train").groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd")).filter("sd > 0")
    return long.join(F.broadcast(fit), "feature").select(key, "feature", rounded((F.col("value") - F.col("m")) / F.col("sd"), 4).alias("z"))  # a row per feature


def _runs(items: Column, low: int, high: int, between: str) -> Column:
    """Runs of low to high neighbouring items of a list or characters of a text, in order.

    Built-in functions would interpret a lambda for every run, so this is an Arrow function.
    """

    def run(column: pa.Array) -> pa.Array:
        terms, ends = [], [0]
        for own in column.to_pylist():
            for n in range(low, high + 1):
                cut = (own[k : k + n] for k in range(len(own) - n + 1))
                terms += cut if isinstance(own, str) else map(between.join, cut)
            ends.append(len(terms))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(terms, pa.string()))

    return F.arrow_udf(run, "array<string>")(items)


def _counted(kernel: Callable[[pa.Array], pa.Array], items: Column) -> Column:
    return F.arrow_udf(kernel, "array<struct<term: string, tf: int>>")(items)


def with_word_grams(texts: DataFrame, low: int, high: int, counted: bool = False) -> DataFrame:
    """id, role, grams: runs of low to high words of at least two letters or digits, joined by spaces; (term, tf) if ``counted``."""
    words = F.filter(tx.tokens(F.col("text")), lambda w: F.length(w) > 1)
    texts = spread(texts) if counted else texts
    return texts.select("id", "role", (_counted(gr.word_runs(low, high, " "), words) if counted else _runs(words, low, high, " ")).alias("grams"))


def with_char_grams(texts: DataFrame, low: int, high: int, counted: bool = False) -> DataFrame:
    """id, role, grams: runs of low to high characters of the lower-cased text with white space as single spaces; (term, tf) if ``counted``."""
    plain = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[\s\x0B]+", " ")
    texts = spread(texts) if counted else texts
    return texts.select("id", "role", (_counted(gr.char_runs(low, high), plain) if counted else _runs(plain, low, high, "")).alias("grams"))


def vocabulary(documents: DataFrame, min_df: int, most: int) -> DataFrame:
    """term, idf of documents (grams: terms with their tf): the ``most`` most frequent of the terms that ``min_df`` rows have, ties by term.

    idf is ln((1 + n) / (1 + df)) + 1.  Sums are combined before the shuffle: at most the different terms of each task are shuffled.
    """
    each = documents.select(F.explode("grams").alias("g")).select("g.term", "g.tf")
    terms = each.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_df).orderBy(F.desc("total"), "term").limit(most)
    n = documents.agg(F.count(F.lit(1)).alias("n"))
    return terms.crossJoin(F.broadcast(n)).select("term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))  # n: one row


def _weighted(known: pa.Array, idf: np.ndarray) -> Callable[[pa.Array], pa.Array]:
    """Counted terms -> those that are known, with their weights, the weights of a row of length 1."""

    def weighted(grams: pa.Array) -> pa.Array:
        flat, sizes = grams.flatten(), pc.list_value_length(grams).fill_null(0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(grams)), sizes)
        found = pc.index_in(flat.field("term"), value_set=known).fill_null(-1).to_numpy()
        keep = found >= 0
        weight = flat.field("tf").to_numpy(zero_copy_only=False)[keep] * idf[found[keep]]
        norm = np.sqrt(np.bincount(row[keep], weight * weight, len(grams)))
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(grams)))]).astype(np.int32)
        terms = flat.field("term").filter(pa.array(keep))
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([terms, pa.array(weight / norm[row[keep]])], ["term", "weight"]))

    return weighted


def tfidf_weights(documents: DataFrame, terms: DataFrame, most: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """id, term, weight of documents (id, grams) by the terms and idf of a vocabulary, of these or of other documents: each row of length 1.

    A vocabulary of at most ``MOST_BROADCAST`` terms and ``most_bytes`` bytes is sent to the tasks and a row is weighted where it is; nothing
    is shuffled then.  A larger one is joined.
    """
    if most <= MOST_BROADCAST:
        terms = stage(terms, "terms")
        if (terms.agg(F.sum(F.octet_length("term") + 12)).first()[0] or 0) <= most_bytes:
            table = terms.toArrow()
            known = table.column("term").combine_chunks()
            weights = F.arrow_udf(_weighted(known, table.column("idf").to_numpy()), "array<struct<term: string, weight: double>>")
            return documents.select("id", F.explode(weights("grams")).alias("x")).select("id", "x.term", rounded(F.col("x.weight"), 6).alias("weight"))
    counts = documents.select("id", F.explode("grams").alias("g")).select("id", "g.term", "g.tf").join(terms, "term")
    raw = counts.select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.select("id", "term", rounded(F.col("w") / norm, 6).alias("weight"))


def tfidf(documents: DataFrame, min_df: int, most: int, role: str = "role") -> DataFrame:
    """id, term, weight of documents (id, role, counted grams); terms and their idf are those of the train rows.  Grams are counted once."""
    documents = stage(documents, "grams")
    return tfidf_weights(documents, vocabulary(documents.filter(F.col(role) == "train"), min_df, most), most)


def tfidf_of_texts(texts: DataFrame, kind: str, low: int, high: int, min_df: int, most: int) -> DataFrame:
    """What ``tfidf`` gives of texts (id, role, text) and runs of low to high words or characters (``kind``), without a table of all runs.

    Frequent runs are found level by level and rows are weighted where they are; only if those don't fit the tasks all runs are counted.
    """
    item = {"word": runs.words, "char": runs.characters}[kind](F.col("text"))
    role = F.when(F.col("role") == "train", runs.TRAIN).otherwise("other")
    rows = stage(spread(texts).select("id", F.array(F.struct(F.lit("all").alias("unit"), role.alias("role"))).alias("members"), item.alias("items")), "items")
    found = runs.vocabulary(rows, low, high, min_df, most)
    if found is None:
        grams = {"word": with_word_grams, "char": with_char_grams}[kind]
        return tfidf(grams(texts, low, high, counted=True), min_df, most)
    terms, known = found
    weighted = runs.counted(rows, known, terms, low, ["id"], idf=True)
    return weighted.select("id", F.explode("grams").alias("x")).select("id", "x.term", rounded(F.col("x.weight"), 6).alias("weight"))


def block_normalised(long: DataFrame, block_weights: dict[str, float]) -> DataFrame:
    """id, block, feature, value: each block of a row made length 1 and weighted, then the whole row made length 1."""
    pairs = [F.lit(x) for k, v in block_weights.items() for x in (k, float(v))]
    own = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("id", "block")))
    weighted = long.withColumn("value", ratio(F.col("value"), own) * F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("block")), F.lit(1.0)))
    whole = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("id")))
    return weighted.select("id", "block", "feature", rounded(ratio(F.col("value"), whole), 6).alias("value"))


def hard_labels(p: str = "p") -> Column:
    """One-hot array of the first class with the highest probability."""
    best = F.array_position(p, F.array_max(p))
    return F.transform(p, lambda x, i: (i + 1 == best).cast("int"))


def one_hot(label: Column, classes: list) -> Column:
    """Array with 1 at the label's class; zeros for an unknown label."""
    return F.array(*(F.coalesce((label == c).cast("int"), F.lit(0)) for c in classes))


def aligned(p: Column, have: list, want: list) -> Column:
    """Probabilities in the order of ``want``; 0 for classes that the model doesn't have."""
    return F.array(*(p[have.index(c)] if c in have else F.lit(0.0) for c in want))


def non_finite_counts(wide: DataFrame, by: str, features: list[str]) -> DataFrame:
    """by, feature, bad: how many values are null, NaN or infinite."""
    long = wide.select(by, *(F.col(f).cast("double").alias(f) for f in features)).unpivot([by], features, "feature", "value")
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    return long.groupBy(by, "feature").agg(F.count_if(bad).alias("bad"))
