"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

Statistics of a text (lengths, variety and repetition of words and lines,
shares of kinds of characters) are standardised and mapped by random cosines
whose inner products approximate a Gaussian kernel.  Ridge weights come from
normal equations that partitions sum over the labelled rows.  Two models, each
fitted on one half, score the other half; on these scores, binned, isotonic
regression learns how often a score means label 1.  All texts are scored by
the model of both halves and calibrated.

Only texts are scored; labels serve in fitting alone.  Statistics are of whole
texts and of all documents; the model is fitted on at most about ``fit_rows``
labelled rows, chosen by a hash of the doc_id.

Cases: a null text is scored as empty; an empty text has zeros for statistics
and a score like any other; a doc_id with several labels has their mean; null
labels are none; without labels all scores are 0.5; repeated rows are scored
each for itself; a text of over ``BLOCK_BYTES`` is read in blocks, with a hash of each different
word and line held beside them; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivena.llm.batches import bounded
from scrivena.llm.words import BLOCK_BYTES, blocks_of, runs_of_texts, utf8, words_of
from scrivena.plans.staging import stage

FIT_ROWS = 20_000
FEATURES = 256
BANDWIDTH = 3.0
RIDGE = 1e-3  # a labelled row
CLIP = 4.0
FIT_PARTS = 8
BINS = 1000  # of scores, for calibration
THRESHOLD = 0.3
NAMES = [
    "log_chars", "log_words", "word_bytes", "word_bytes_sd", "distinct_words", "log_distinct", "same_as_before",
    "upper", "symbols", "stops", "digits", "spaces", "repeated_lines", "pipes", "line_words",
]


# Of the kinds of bytes that are counted: upper case, symbols, stops, digits, spaces, pipes.
_UPPER, _STOPS, _DIGITS, _SPACES, _PIPES = (np.isin(np.arange(256), list(x)) for x in (range(65, 91), b".,", range(48, 58), b" \n", b"|"))
_LETTERS = _UPPER | np.isin(np.arange(256), [*range(97, 123), *range(128, 256)])
KINDS = np.stack([_UPPER, ~(_LETTERS | _DIGITS | _STOPS | _SPACES), _STOPS, _DIGITS, _SPACES, _PIPES])


class Distinct:
    """How many different hashes were added.  Those held are merged when as many again have come, so each is held about twice."""

    def __init__(self) -> None:
        self.merged, self.waiting, self.n = np.zeros(0, np.uint64), [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append(np.unique(hashes))
        self.n += len(self.waiting[-1])
        if self.n > len(self.merged) + BLOCK_BYTES // 8:
            self.count()

    def count(self) -> int:
        if self.waiting:
            self.merged, self.waiting, self.n = np.unique(np.concatenate([self.merged, *self.waiting])), [], 0
        return len(self.merged)


def _rows(nbytes, count, total, squares, distinct, repeats, kinds, lines, different_lines) -> np.ndarray:
    """The statistics of texts, from arrays of their sums; kinds is KINDS x texts."""
    n, some = np.maximum(count, 1), np.maximum(nbytes, 1)
    mean = total / n
    upper, symbols, stops, digits, spaces, pipes = kinds
    return np.column_stack(
        [
            np.log1p(nbytes),
            np.log1p(count),
            mean,
            np.sqrt(np.maximum(squares / n - mean**2, 0)),
            distinct / n,
            np.log1p(distinct) / np.log1p(n),
            repeats / n,
            upper / some,
            symbols / some,
            stops / n,
            digits / some,
            spaces / some,
            1 - different_lines / lines,
            pipes / n,
            np.log1p(count / lines),
        ]
    )


def _of_run(data: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The statistics of a run of texts that fit in a block."""
    at = own - own[0]
    body = data[own[0] : own[-1]]
    words = words_of(data, own)
    first, last = words.first[:-1], words.first[1:]
    lengths = words.ends - words.starts
    total, squares = (np.concatenate([[0], np.cumsum(x)]) for x in (lengths, lengths**2))
    same = np.zeros(len(words.hashes) + 1, np.int64)
    same[2:] = np.cumsum(words.hashes[1:] == words.hashes[:-1])
    sums = (np.concatenate([[0], np.cumsum(kind[body])]) for kind in KINDS)
    lines = [body[a:b].tobytes().split(b"\n") for a, b in zip(at[:-1], at[1:])]
    return _rows(
        np.diff(own),
        words.counts(),
        total[last] - total[first],
        squares[last] - squares[first],
        np.array([len(np.unique(words.hashes[a:b])) for a, b in zip(first, last)]),
        same[last] - same[np.minimum(first + 1, last)],
        np.stack([x[at[1:]] - x[at[:-1]] for x in sums]),
        np.array([len(x) for x in lines]),
        np.array([len(set(x)) for x in lines]),
    )


def _line_hashes(data: np.ndarray) -> Iterator[np.ndarray]:
    """64-bit hashes of the lines of a text, of one block after the other; a line may reach over many."""
    line = hashlib.blake2b(digest_size=8)
    for at in range(0, len(data), BLOCK_BYTES):
        found = []
        head, *more = data[at : at + BLOCK_BYTES].tobytes().split(b"\n")
        line.update(head)
        for own in more:
            found.append(line.digest())
            line = hashlib.blake2b(own, digest_size=8)
        yield np.frombuffer(b"".join(found), np.uint64)
    yield np.frombuffer(line.digest(), np.uint64)


def _of_long(data: np.ndarray) -> np.ndarray:
    """The statistics of one longer text, block by block: what is held of it beside is a hash for each different word and line."""
    count = total = squares = repeats = lines = 0
    different, different_lines = Distinct(), Distinct()
    for words, _, again in blocks_of(data, 1):
        hashes, lengths = words.hashes[again:], (words.ends - words.starts)[again:]
        count, total, squares = count + len(hashes), total + int(lengths.sum()), squares + int((lengths**2).sum())
        repeats += int((words.hashes[1:] == words.hashes[:-1]).sum())  # with the last word of the block before
        different.add(hashes)
    for hashes in _line_hashes(data):
        lines += len(hashes)
        different_lines.add(hashes)
    kinds = KINDS @ sum(np.bincount(data[at : at + BLOCK_BYTES], minlength=256) for at in range(0, len(data), BLOCK_BYTES))
    sums = (len(data), count, total, squares, different.count(), repeats)
    return _rows(*(np.array([x]) for x in sums), kinds[:, None], np.array([lines]), np.array([different_lines.count()]))


def statistics(column: pa.Array) -> np.ndarray:
    """The statistics (texts x NAMES) of a column of texts."""
    data, offsets = utf8(column)
    out = np.zeros((len(column), len(NAMES)))
    for begin, end in runs_of_texts(offsets):
        own = offsets[begin : end + 1]
        out[begin:end] = _of_run(data, own) if own[-1] - own[0] <= BLOCK_BYTES else _of_long(data[own[0] : own[-1]])
    return out


def stats_of(text: Column) -> Column:
    """The statistics of each text, as an array."""

    def run(column: pa.Array) -> pa.Array:
        found = statistics(column)
        at = np.arange(len(found) + 1, dtype=np.int32) * len(NAMES)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(found.ravel()))

    return F.arrow_udf(run, "array<double>")(text)


@dataclass
class Model:
    """Standardisation, random directions and phases, ridge weights, and the calibration curve."""

    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray
    calibrated: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -CLIP, CLIP)
        z = np.sqrt(2 / self.directions.shape[1]) * np.cos(x @ self.directions + self.phases)
        return np.column_stack([z, np.ones(len(z))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(self.raw):
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.features(stats) @ self.weights, self.raw, self.calibrated), 0, 1)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing values with the least weighted squared distance: neighbours out of order are pooled."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text is divisible by 5; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _solved(sums: list[np.ndarray], rows: float) -> np.ndarray:
    a, b = sums[0][:, :-1], sums[0][:, -1]
    return np.linalg.solve(a + RIDGE * max(rows, 1) * np.eye(len(a)) / len(a) * 10, b)


def fit(stats: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from stats (doc_id, stats) and labels (doc_id, quality).

    What comes to the driver is the normal equations of at most FIT_PARTS partitions and BINS sums.
    """
    d = len(NAMES)
    rng = np.random.default_rng(20268)
    directions = rng.normal(0, 1 / BANDWIDTH, (d, FEATURES))
    phases = rng.uniform(0, 2 * np.pi, FEATURES)
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    number = known.count()
    chance = min(1.0, fit_rows / max(1, number))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(chance * (1 << 30)))
    rows = stage(stats.join(chosen, "doc_id").select("stats", "y", F.pmod(F.crc32(F.concat(F.lit("half"), F.col("doc_id").cast("string")).cast("binary")), F.lit(2)).cast("int").alias("half")).repartition(FIT_PARTS), "quality-fit")
    moments = rows.select(F.posexplode("stats").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).orderBy("pos").toPandas()
    none = np.zeros(0)
    if moments.empty:
        return Model(np.zeros(d), np.ones(d), directions, phases, none, none, none)
    spread = moments["sd"].to_numpy()
    model = Model(moments["mean"].to_numpy(), np.where(spread > 1e-9, spread, 1.0), directions, phases, none, none, none)

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, FEATURES + 1, FEATURES + 2))
        seen = np.zeros(2)
        for batch in batches:
            z = model.features(np.stack(batch["stats"].to_numpy()))
            for half in (0, 1):
                own = batch["half"].to_numpy() == half
                sums[half] += z[own].T @ np.column_stack([z[own], batch["y"].to_numpy()[own]])
                seen[half] += own.sum()
        yield pd.DataFrame({"half": [0, 1], "seen": seen, "sums": [s.tobytes() for s in sums]})

    sums, seen = [np.zeros((FEATURES + 1, FEATURES + 2)) for _ in range(2)], [0.0, 0.0]
    for r in rows.mapInPandas(equations, "half int, seen double, sums binary").collect():
        sums[r.half] += np.frombuffer(r.sums).reshape(FEATURES + 1, FEATURES + 2)
        seen[r.half] += r.seen
    other = [_solved([sums[1 - half]], seen[1 - half]) for half in (0, 1)]

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z = model.features(np.stack(batch["stats"].to_numpy()))
            half = batch["half"].to_numpy()
            raw = np.where(half == 0, z @ other[0], z @ other[1])
            yield pd.DataFrame({"bin": np.clip(np.floor(raw * BINS / 2), -BINS // 2, BINS).astype(np.int32), "raw": raw, "y": batch["y"]})

    bins = rows.mapInPandas(binned, "bin int, raw double, y double").groupBy("bin").agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").toPandas()
    model.weights = _solved([sums[0] + sums[1]], seen[0] + seen[1])
    model.raw = bins["raw"].to_numpy()
    model.calibrated = isotonic(bins["y"].to_numpy(), bins["n"].to_numpy().astype(float))
    return model


def scored(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``; labels of held-out documents aren't looked at."""
    stats = stage(bounded(docs).select("doc_id", stats_of(F.col("text")).alias("stats")), "quality-stats")
    model = fit(stats, labels.filter(~held_out(F.col("doc_id"))), fit_rows)

    def run(column: pa.Array) -> pa.Array:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        return pa.array(model.score(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))))

    found = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.arrow_udf(run, "double").asNondeterministic()(F.col("stats")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
