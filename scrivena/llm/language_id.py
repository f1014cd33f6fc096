"""Language identification by error-correcting output codes.

Every learned language has a codeword; for each bit of it a binary classifier
over hashed character 1- to 3-grams (log-odds of the two groups of languages
that the bit separates) says how strongly a text leans to either side.
Decoding takes the language whose codeword has the least loss, the exponential
loss of each bit's margin weighted by how often that bit was right on the
texts it was fitted on.  A text whose two best codewords are nearly as close
as each other is flagged as ambiguous.

Only text and lang are used, and lang only in fitting.  The classifiers are
fitted on at most about ``fit_rows`` labelled texts, spread evenly over the
languages; every text is predicted whole.  Any number of languages can be
learned: their counts are summed in tasks, and the driver and the tasks hold one
codeword for each.

Cases: a null text, or one without a letter (``str.isalpha``; numerals such as
roman or circled ones are none), is ``und`` with score 0; very long texts are
read whole, in pieces; null labels are not learned; if nothing is learned all
is ``und``; ties go to the alphabetically first language; repeated rows are
predicted each for itself; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivena.llm.batches import bounded
from scrivena.plans.staging import stage

FIT_ROWS = 40_000
LEAST_EACH = 20
BUCKETS = 1 << 12
CODE_BITS = 63  # of more than 7 languages
MARGIN_SCALE = 4.0
AMBIGUOUS = 0.02
PIECE = 1 << 18
WORDLY = re.compile(r"[^\W\d_]+")
HELD_LANGUAGES = 64  # of which a task holds counts before it passes them on
SUM_PARTS = 8
UNDETERMINED = "und"


def codewords(n: int) -> np.ndarray:
    """A +1/-1 codeword for each of n languages.

    Up to seven have all the different bits there are; more have ``CODE_BITS`` bits at a time, drawn with
    a fixed seed, of which each pair of languages differs in about half.
    """
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        bits = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(bits, dtype=float).T
    code = np.where(np.random.default_rng(n).random((n, max(CODE_BITS, 8 * n.bit_length()))) < 0.5, -1.0, 1.0)
    return code[:, np.abs(code.sum(axis=0)) < n]


def has_letter(text: str) -> bool:
    """Whether a character of the text is a letter; ``\\w`` has numerals too."""
    return any(any(map(str.isalpha, run.group())) for run in WORDLY.finditer(text))


def gram_buckets(text: str) -> np.ndarray:
    """How many character 1-, 2- and 3-grams of the lower-cased text fall in each bucket; runs of non-letters count as one space."""
    counts = np.zeros(BUCKETS, np.int64)
    tail = np.zeros(0, np.uint32)
    for at in range(0, len(text), PIECE):
        points = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = np.where((points >= 97) & (points <= 122) | (points >= 192), points, np.uint32(32))
        line = np.concatenate([tail, letters]) if len(tail) else letters
        line = line[np.concatenate([[True], (line[1:] != 32) | (line[:-1] != 32)])] if len(line) else line
        one = line * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35) + one[1:]
        three = (two[:-1] ^ np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1) + one[2:]
        for hashed in (one[len(tail) :], two[max(0, len(tail) - 1) :], three[max(0, len(tail) - 2) :]):
            counts += np.bincount((hashed >> np.uint32(20)).astype(np.int64), minlength=BUCKETS)
        tail = line[-2:]
    return counts


@dataclass
class Coder:
    """Languages, their codewords, and of each bit the bucket weights, the middle and spread of its margin, and its reliability."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    middle: np.ndarray
    spread: np.ndarray
    reliability: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        counts = gram_buckets(text)
        return ((counts @ self.weights) / max(1, counts.sum()) - self.middle) / self.spread

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the choice is ambiguous."""
        if not self.languages or text is None or not has_letter(text):
            return UNDETERMINED, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        agree = self.code * np.clip(self.margins(text), -3, 3) * MARGIN_SCALE / 3
        loss = (np.exp(-agree) * self.reliability).sum(axis=1) / self.reliability.sum()
        order = np.argsort(loss, kind="stable")
        likely = np.exp(-(loss - loss[order[0]]) * MARGIN_SCALE)
        likely /= likely.sum()
        return self.languages[order[0]], float(likely[order[0]]), bool(likely[order[0]] - likely[order[1]] < AMBIGUOUS)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text leaves 1 on division by 3; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(labelled: DataFrame, fit_rows: int) -> DataFrame:
    """About ``fit_rows`` rows (text, lang) at most, or LEAST_EACH of each language, chosen by a hash of the text, evenly over the languages."""
    sizes = stage(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language-sizes")
    each = max(LEAST_EACH, fit_rows / max(1, sizes.count()))
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labelled.join(sizes, "lang").filter(draw * F.col("n") < each).select("text", "lang")


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many grams of each bucket the texts of each language have."""
    sums: dict[str, np.ndarray] = {}

    def passed_on() -> Iterator[pd.DataFrame]:
        for lang, own in sums.items():
            some = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": some.astype(np.int32), "n": own[some]})
        sums.clear()

    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"]):
            if lang not in sums:
                if len(sums) == HELD_LANGUAGES:
                    yield from passed_on()
                sums[lang] = np.zeros(BUCKETS, np.int64)
            sums[lang] += gram_buckets(text)
    yield from passed_on()


def log_odds(plus: np.ndarray, minus: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Weights (buckets x bits): log-odds of a bucket between the mean shares of the two groups of each bit, given the sums of their shares."""
    return np.log(plus / (code > 0).sum(axis=0)) - np.log(minus / (code < 0).sum(axis=0))


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Coder:
    """Learn from rows (text, lang).

    To the driver come the languages, one margin of each language and bit, and for each of SUM_PARTS tasks that has a
    language the sums of two shares of each bucket and bit; counts by language stay distributed.
    """
    rows = _sample(bounded(labelled).filter("lang is not null and text <> ''").select("text", "lang"), fit_rows)
    counts = rows.mapInPandas(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # One row for each language: the share of bucket b is (n + 0.5) / (total + BUCKETS / 2).
    shares = stage(
        counts.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list(F.col("n").cast("double")).alias("n"), (F.sum("n") + BUCKETS / 2).alias("total")),
        "language-shares",
    )
    languages = sorted(r.lang for r in shares.select("lang").collect())
    n = len(languages)
    code = codewords(n)
    bits = code.shape[1]
    if n < 2:
        empty = np.zeros(bits)
        return Coder(languages, code, np.zeros((BUCKETS, bits)), empty, empty + 1, empty + 1)
    number = {lang: i for i, lang in enumerate(languages)}

    def share_of(buckets: np.ndarray, n: np.ndarray, total: float) -> np.ndarray:
        own = np.full(BUCKETS, 0.5)
        own[buckets] += n
        return own / total

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plus, minus, seen = np.zeros((BUCKETS, bits)), np.zeros((BUCKETS, bits)), False
        for batch in batches:
            seen = seen or len(batch) > 0
            own = [share_of(*r) for r in zip(batch["buckets"], batch["n"], batch["total"])]
            codes = code[[number[lang] for lang in batch["lang"]]]
            for begin in range(0, len(own), HELD_LANGUAGES):
                part = np.stack(own[begin : begin + HELD_LANGUAGES]).T
                plus += part @ (codes[begin : begin + HELD_LANGUAGES] > 0)
                minus += part @ (codes[begin : begin + HELD_LANGUAGES] < 0)
        if seen:  # tasks without a language send nothing, however many tasks there are
            yield pd.DataFrame({"plus": [plus.tobytes()], "minus": [minus.tobytes()]})

    dealt = shares.repartition(SUM_PARTS, "lang").sortWithinPartitions("lang")  # sums in one order, however often they are made
    sums = dealt.mapInPandas(summed, "plus binary, minus binary").collect()
    plus, minus = (sum(np.frombuffer(r[name]).reshape(BUCKETS, bits) for r in sums) for name in ("plus", "minus"))
    weights = log_odds(plus, minus, code)

    def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"lang": batch["lang"], "margins": [(share_of(*r) @ weights).tolist() for r in zip(batch["buckets"], batch["n"], batch["total"])]})

    expected = np.zeros((n, bits))  # margin of each language's average text
    for r in shares.mapInPandas(margins, "lang string, margins array<double>").collect():
        expected[number[r.lang]] = r.margins
    low = np.array([expected[code[:, b] > 0, b].min() for b in range(bits)])
    high = np.array([expected[code[:, b] < 0, b].max() for b in range(bits)])
    middle, spread = (low + high) / 2, np.maximum(1e-9, (low - high) / 2)
    coder = Coder(languages, code, weights, middle, spread, np.ones(bits))

    def right(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        good, seen = np.zeros(bits), 0
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                if has_letter(text):
                    good += coder.margins(text) * code[number[lang]] > 0
                    seen += 1
        yield pd.DataFrame({"bit": np.arange(len(good)), "good": good, "seen": float(seen)})

    share = rows.mapInPandas(right, "bit int, good double, seen double").groupBy("bit").agg((F.sum("good") + 1).alias("good"), (F.sum("seen") + 2).alias("seen")).toPandas()
    accuracy = np.full(bits, 0.75)
    accuracy[share["bit"]] = share["good"] / share["seen"]
    coder.reliability = np.maximum(2 * accuracy - 1, 0.01)
    return coder


def decoded(text: Column, coder: Coder) -> Column:
    """Struct of lang_pred, score (0 to 1) and ambiguous; the coder has one codeword a language and BUCKETS weights a bit."""

    def decode(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([coder.decode(t) for t in texts], columns=["lang_pred", "score", "ambiguous"])

    # Not deterministic: else a filter on the result is pushed below it and the texts are decoded twice.
    return F.pandas_udf(decode, "lang_pred string, score double, ambiguous boolean").asNondeterministic()(text)


def identified(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of each row; learned from the rows that are not held out."""
    coder = fit(docs.filter(~held_out(F.col("doc_id"))), fit_rows)
    rows = docs.select("doc_id", decoded(F.col("text"), coder).alias("decoded"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "decoded.lang_pred", "decoded.score", "decoded.ambiguous")


def with_language(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language can be told (not ``und``)."""
    coder = fit(docs.filter(~held_out(F.col("doc_id"))), fit_rows)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"))
    found = rows.select("d", decoded(F.col("d.text"), coder).alias("decoded"))
    return found.filter(F.col("decoded.lang_pred") != UNDETERMINED).select("d.*")
