"""Signals of frozen profilers on other texts, and what the weights of models say.

A profiler is a long table of weights (unit, target, class, block, term, idf, weight) with a row for each
class's intercept (term null) and curves (unit, target, class, a, b).  Applying it looks counted terms up among
the profiler's terms of the fold that the text's unit is resolved to, in the tasks or, if these are too many to be sent there, by
a join, and adds up: no model object is loaded anywhere.

Cases: a text without known terms gets the intercepts' probabilities; classes of a target share what their curves give, also if it
is all 0; a text in several units has signals in each; authors that are in a fold's profiling corpus and
among the texts are an error when the result is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivena.operators.evaluation import ratio
from scrivena.operators.features import hard_labels
from scrivena.operators.integrity import require

#: Largest table of weights that is sent to the tasks; a larger one is joined.
MOST_BYTES = 64 << 20


def resolved(members: DataFrame, stage_name: str) -> DataFrame:
    """``members`` (unit, id) with profiler: that of the same fold in development, ``final`` otherwise."""
    return members.withColumn("profiler", F.col("unit") if stage_name == "dev" else F.lit("final"))


def disjoint(result: DataFrame, authors: DataFrame, profiled: DataFrame) -> DataFrame:
    """``result``, or an error if an author of the texts (profiler, author) is among those that the profiler was fitted on."""
    both = authors.select("profiler", "author").distinct().join(profiled.select("profiler", "author").distinct(), ["profiler", "author"], "left_semi")
    return require(result, both.agg(F.count(F.lit(1)).alias("offending")), "authors of the texts are in the profiling corpus")


def _matrices(table: pa.Table) -> dict[tuple[str, str], tuple[pa.Array, np.ndarray, list[tuple], np.ndarray]]:
    """Terms, their idf, (target, class) of each column and the matrix of weights, by profiler and block."""
    found = {}
    for (profiler, block), own in table.to_pandas().groupby(["profiler", "block"]):
        term = own.term.astype("category")
        columns = sorted(set(zip(own.target, own["class"])))
        at = {c: k for k, c in enumerate(columns)}
        matrix = np.zeros((len(term.cat.categories), len(columns)))
        matrix[term.cat.codes, [at[c] for c in zip(own.target, own["class"])]] = own.weight
        idf = np.zeros(len(matrix))
        idf[term.cat.codes] = own.idf
        found[profiler, block] = (pa.array(term.cat.categories, pa.string()), idf, columns, matrix)
    return found


def _applied(table: pa.Table):
    """(id, block, grams, _m) -> the sum of each target's class over a text's terms and their length, for each unit and block."""

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = _matrices(table)
        for batch in batches:
            n, grams, members = batch.num_rows, batch.column("grams"), batch.column("_m")
            row = np.repeat(np.arange(n), pc.list_value_length(grams).fill_null(0).to_numpy(zero_copy_only=False))
            tf = grams.flatten().field("tf").to_numpy(zero_copy_only=False).astype(np.float64)
            coded = grams.flatten().field("term").dictionary_encode()
            number = coded.indices.to_numpy()
            owner = np.repeat(np.arange(n), pc.list_value_length(members).fill_null(0).to_numpy(zero_copy_only=False))
            for (profiler, block), (terms, idf, columns, weights) in matrices.items():
                here = np.array([b == block for b in batch.column("block").to_pylist()], bool)
                own = pc.equal(members.flatten().field("profiler"), profiler).fill_null(False).to_numpy(zero_copy_only=False) & here[owner]
                if not own.any():
                    continue
                wanted = np.zeros(n, bool)
                wanted[owner[own]] = True
                j = pc.index_in(coded.dictionary, value_set=terms).fill_null(-1).to_numpy()[number]
                some = (j >= 0) & wanted[row]
                r, x = row[some], tf[some] * idf[j[some]]
                length = np.sqrt(np.bincount(r, x * x, n))
                sums = np.stack([np.bincount(r, x * weights[j[some], k], n) for k in range(len(columns))], axis=1)
                hit = own & (np.bincount(r, minlength=n) > 0)[owner]  # texts without known terms have no row
                at, k = owner[hit], len(columns)
                each = pa.array(np.repeat(at, k))
                units = members.flatten().field("unit").filter(pa.array(hit)).take(pa.array(np.repeat(np.arange(len(at)), k)))
                targets, classes = (pa.array([c[i] for c in columns]).take(pa.array(np.tile(np.arange(k), len(at)))) for i in (0, 1))
                m = len(at) * k
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(each), units, pa.array([profiler] * m, pa.string()), pa.array([block] * m, pa.string()), targets, classes.cast(table.schema.field("class").type), pa.array(sums[at].ravel()), pa.array(np.repeat(length[at], k))],
                    ["id", "unit", "profiler", "block", "target", "class", "sum", "length"],
                )

    return applied


def _joined(counted: DataFrame, members: DataFrame, weights: DataFrame) -> DataFrame:
    """The same by joins, for weights of any number."""
    known = weights.groupBy(F.col("unit").alias("profiler"), "block", "term").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("target", "class", "weight")).alias("w"))
    terms = counted.join(members, "id").select("unit", "profiler", "id", "block", F.explode("grams").alias("g")).select("unit", "profiler", "id", "block", "g.term", "g.tf")
    hits = terms.join(known.hint("merge"), ["profiler", "block", "term"]).withColumn("x", F.col("tf") * F.col("idf"))
    lengths = hits.groupBy("unit", "profiler", "id", "block").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    sums = hits.select("unit", "profiler", "id", "block", "x", F.explode("w").alias("w")).groupBy("unit", "profiler", "id", "block", "w.target", "w.class").agg(F.sum(F.col("x") * F.col("w.weight")).alias("sum"))
    return sums.join(lengths.hint("merge"), ["unit", "profiler", "id", "block"])


def decision_values(counted: DataFrame, members: DataFrame, weights: DataFrame, block_weights: dict[str, float] | None = None) -> DataFrame:
    """unit, id, target, class, score of every text of ``members`` (unit, profiler, id) by its profiler.

    ``counted`` has id, block and grams (terms with their tf).  Blocks are made length 1, weighted, and the whole made
    length 1, by the sums of their squares, so that one grouping by text does and a second one by target only adds up blocks.
    Units and sums of texts are small as written and large in memory, so their joins are by merge, never through the driver.
    """
    pairs = [F.lit(x) for k, v in (block_weights or {"": 1.0}).items() for x in (k, float(v))]
    share = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("block")), F.lit(1.0))
    own = weights.filter("term is not null")
    if (own.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0) <= MOST_BYTES:
        table = own.select(F.col("unit").alias("profiler"), "block", "term", "target", "class", "idf", "weight").toArrow()
        kinds = {c: kind for c, kind in [*members.dtypes, *weights.dtypes, *counted.dtypes]}
        applied = counted.join(members.groupBy("id").agg(F.collect_list(F.struct("unit", "profiler")).alias("_m")).hint("merge"), "id").select("id", "block", "grams", "_m")
        parts = applied.mapInArrow(_applied(table), f"id {kinds['id']}, unit {kinds['unit']}, profiler string, block string, target string, class {kinds['class']}, sum double, length double")
    else:
        parts = _joined(counted, members, own)
    blocks = parts.groupBy("unit", "profiler", "id", "target", "class").agg(
        F.sum(ratio(F.col("sum"), F.col("length")) * share).alias("sum"), F.sqrt(F.sum(F.when(F.col("length") > 0, share * share))).alias("norm")
    )
    intercepts = weights.filter("term is null").select(F.col("unit").alias("profiler"), "target", "class", F.col("weight").alias("intercept"))
    every = members.select("unit", "profiler", "id").join(F.broadcast(intercepts), "profiler")  # intercepts: units and classes
    found = every.join(blocks.hint("merge"), ["unit", "profiler", "id", "target", "class"], "left")
    return found.select("unit", "profiler", "id", "target", "class", (F.col("intercept") + ratio(F.col("sum"), F.col("norm"))).alias("score"))


def signals(values: DataFrame, curves: DataFrame) -> DataFrame:
    """unit, id, target, classes, prob, hard: probabilities of each target's classes in their order, and the best as 1.

    ``curves`` (unit, target, class, a, b) are the profilers' sigmoids; probabilities are made to sum to 1.
    """
    by = [F.col("unit").alias("profiler"), "target", "class", "a", "b"]
    p = 1 / (1 + F.exp(F.col("a") * F.col("score") + F.col("b")))
    rows = values.join(F.broadcast(curves.select(*by)), ["profiler", "target", "class"]).withColumn("_p", p)  # curves: units and classes
    own = rows.groupBy("unit", "id", "target").agg(F.array_sort(F.collect_list(F.struct("class", "_p"))).alias("x"))  # a target's classes
    whole = F.aggregate("x", F.lit(0.0), lambda t, x: t + x["_p"])
    own = own.withColumn("_whole", whole)
    prob = F.transform("x", lambda x: F.when(F.col("_whole") > 0, x["_p"] / F.col("_whole")).otherwise(1.0 / F.size("x")))
    found = own.select("unit", "id", "target", F.transform("x", lambda x: x["class"]).alias("classes"), prob.alias("prob"))
    return found.withColumn("hard", hard_labels("prob"))


# What weights say


def averaged(weights: DataFrame, by: list[str]) -> DataFrame:
    """by..., weight: the mean over the calibration folds (column fold) of each weight."""
    return weights.groupBy(*by).agg(F.avg("weight").alias("weight"))


def by_class(weights: DataFrame, classes: DataFrame) -> DataFrame:
    """``weights`` (model, row, feature, weight) with class: a model with one row and two classes has it for the second, and with the other sign for the first.

    ``classes`` has model, row (0, 1, ...) and class.
    """
    rows = weights.groupBy("model").agg((F.max("row") + 1).alias("_rows"))
    kinds = classes.groupBy("model").agg(F.count(F.lit(1)).alias("_classes"))
    joined = weights.join(rows, "model").join(kinds, "model")
    single = (F.col("_rows") == 1) & (F.col("_classes") == 2)
    sides = F.when(single, F.array(F.struct(F.lit(0).alias("row"), F.lit(-1.0).alias("sign")), F.struct(F.lit(1).alias("row"), F.lit(1.0).alias("sign")))).otherwise(F.array(F.struct(F.col("row"), F.lit(1.0).alias("sign"))))
    each = joined.select("model", "feature", "weight", F.explode(sides).alias("s")).select("model", "s.row", "feature", (F.col("weight") * F.col("s.sign")).alias("weight"))
    return each.join(classes, ["model", "row"]).select("model", "class", "feature", "weight")


def family_weights(weights: DataFrame, family: Column, by: list[str]) -> DataFrame:
    """by..., family, n, signed and absolute sums and means of the weights, and the family's share of the absolute sum."""
    sums = weights.withColumn("family", family).groupBy(*by, "family").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("signed_sum"), F.avg("weight").alias("signed_mean"), F.sum(F.abs("weight")).alias("abs_sum"), F.avg(F.abs("weight")).alias("abs_mean")
    )
    whole = sums.groupBy(*by).agg(F.sum("abs_sum").alias("_whole"))
    return sums.join(whole, by).select(*by, "family", "n", "signed_sum", "signed_mean", "abs_sum", "abs_mean", ratio(F.col("abs_sum"), F.col("_whole")).alias("abs_share"))
