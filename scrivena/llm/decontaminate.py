"""Benchmark decontamination by winnowing.

Both sides keep, of every window of ``WINDOW`` consecutive k-gram hashes, the
smallest: a shared run of at least ``WINDOW + GRAM - 1`` = 13 words has one
such window whole, so both sides keep the same hash of it and the run is
found.  A shared hash is a candidate; around it the 13-word windows of the
document are looked up among those of the items and compared word by word.
Items of fewer than 13 words, for which winnowing guarantees nothing, are one
window each and are looked up by all runs of their length.

The windows of all items and the documents' candidates are tables that Spark
joins, by broadcast if there are at most ``BROADCAST_WINDOWS`` of them.  What documents
send to that join is cut down beforehand by a bit for each item print and window
in a map of at most ``1 << MOST_BITS`` bits, which is all that goes through the
driver; a map that is too full for a benchmark lets more candidates pass and
loses none.

Cases: null and wordless texts have no words and are never contaminated; a
wordless item has no window; very long texts and items are read whole, in
overlapping blocks; repeated rows are judged each for itself; items
that repeat an item_id count once; items without an id hit like all others,
count together as one item and add nothing to the digest of ids; an empty benchmark leaves all clean;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivena.llm.batches import bounded
from scrivena.llm.words import Words, grams, taken, utf8
from scrivena.plans.staging import stage

SPAN = 13
GRAM = 5
WINDOW = SPAN - GRAM + 1
LEAST_BITS, MOST_BITS = 16, 27  # of the map
MAP_PARTS = 8
BROADCAST_WINDOWS = 100_000  # of about 13 words: some 15 MB
NONE = np.uint64((1 << 64) - 1)

WINDOWS = "n int, hash long, words string, item string"
CANDIDATES = "row long, doc_id long, raw long, n_words long, candidates array<struct<n: int, at: long, hash: long, words: string>>"


def _sliding(x: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each n consecutive values, by doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x


def winnowed(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of the hashes that are the least of some window within their text.

    Windows that hang over an end of the text count too; equal minima are all kept.  Both only add hashes.
    """
    pad = WINDOW - 1
    counts = np.diff(first)
    texts = np.repeat(np.arange(len(counts)), counts)
    # Texts are laid out with gaps of the largest value between them, so no window mixes two.
    place = np.arange(len(hashes)) + texts * pad + pad
    line = np.full(len(hashes) + (len(counts) + 1) * pad, NONE)
    line[place] = hashes
    least = _sliding(line, WINDOW, np.minimum)  # of each window
    least[least == NONE] = 0  # windows between two texts
    highest = _sliding(least, WINDOW, np.maximum)  # of the windows around each place
    return np.flatnonzero(hashes == highest[place - pad])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items -> their windows (n, hash, words, item), and their prints as windows of no words with n = 0."""
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        items = batch.column("item_id").to_pylist()
        for begin, end, words, before, again, _ in taken(data, offsets, SPAN - 1):
            counts, rows = words.counts(), []
            for n in range(1, SPAN + 1):
                # A block that isn't the first belongs to an item of more than SPAN words.
                own = [i for i in range(end - begin) if (before or counts[i] >= SPAN if n == SPAN else not before and counts[i] == n)]
                if own:
                    hashes, first = grams(words, n)
                    for i in own:
                        for j in range(int(first[i]), int(first[i + 1])):
                            at = int(words.first[i]) + j - int(first[i])
                            rows.append((n, int(hashes[j].view(np.int64)), words.text(at, at + n), items[begin + i]))
            hashes, first = grams(words, GRAM)
            rows += [(0, int(h), None, None) for h in np.unique(hashes[winnowed(hashes, first)]).view(np.int64)]
            types = [pa.int32(), pa.int64(), pa.string(), pa.string()]
            names = ["n", "hash", "words", "item"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


class BitMap:
    """A bit for each of the hashes that were added."""

    def __init__(self, bits: int, body: np.ndarray | None = None):
        self.shift = np.uint64(64 - bits)
        self.body = np.zeros(1 << (bits - 3), np.uint8) if body is None else body

    def add(self, hashes: np.ndarray) -> None:
        at = hashes >> self.shift
        np.bitwise_or.at(self.body, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.body[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _bit_map(windows: DataFrame, number: int, most_bits: int) -> BitMap:
    """The map of all prints and windows; to the driver come MAP_PARTS of at most ``1 << most_bits`` bits."""
    bits = min(most_bits, max(LEAST_BITS, (16 * number).bit_length()))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = BitMap(bits)
        for batch in batches:
            found.add(batch.column("hash").to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([found.body.tobytes()], pa.binary())], ["body"])

    whole = BitMap(bits)
    for r in windows.select("hash").coalesce(MAP_PARTS).mapInArrow(mapped, "body binary").toLocalIterator():
        whole.body |= np.frombuffer(r.body, np.uint8)
    return whole


def _candidates(words: Words, lengths: list[int], known: BitMap, again: int) -> Iterator[tuple[int, int, int, int]]:
    """(text, n, word in it, place among the grams) of windows that may be an item's; those in the first ``again`` words are left out."""
    for n in lengths:
        hashes, first = grams(words, n)
        if not len(hashes):
            continue
        if n == SPAN:
            five, five_first = grams(words, GRAM)
            kept = winnowed(five, five_first)
            kept = kept[known.has(five[kept])]
            text = np.searchsorted(five_first, kept, side="right") - 1
            inner = kept - five_first[text]  # the word at which the shared gram begins
            begin = (inner[:, None] - np.arange(WINDOW)).ravel()  # windows that have the gram whole
            owner = np.repeat(text, WINDOW)
            fits = (begin >= 0) & (begin < np.diff(first)[owner])
            places = np.unique(first[owner[fits]] + begin[fits])
        else:
            places = np.arange(len(hashes))
        places = places[known.has(hashes[places])]
        text = np.searchsorted(first, places, side="right") - 1
        for place, i in zip(places.tolist(), text.tolist()):
            at = place - int(first[i])
            if at + n > again:
                yield i, n, at, int(hashes[place].view(np.int64))


def _scan(lengths: list[int], known: BitMap):
    """Documents -> their words and the windows that may be an item's."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            n_words = np.zeros(batch.num_rows, np.int64)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for begin, end, words, before, again, _ in taken(data, offsets, SPAN - 1):
                n_words[begin:end] += words.counts() - again
                for i, n, at, h in _candidates(words, lengths, known, again):
                    own = int(words.first[i]) + at
                    found[begin + i].append({"n": n, "at": before + at, "hash": h, "words": words.text(own, own + n)})
            lists = pa.array(found, pa.list_(pa.struct([("n", pa.int32()), ("at", pa.int64()), ("hash", pa.int64()), ("words", pa.string())])))
            kept = [batch.column(c) for c in ("row", "doc_id", "raw")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_words), lists], ["row", "doc_id", "raw", "n_words", "candidates"])

    return scan


def _judged(docs: DataFrame, benchmark: DataFrame, most_bits: int) -> DataFrame:
    """As ``contamination``, with raw."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null").distinct()
    windows = stage(items.mapInArrow(_windows, WINDOWS).distinct(), "benchmark-windows")
    number = windows.count()
    lengths = sorted(r.n for r in windows.filter("n > 0").select("n").distinct().collect())  # SPAN different ones at most
    rows = bounded(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("raw"), "text")
    scanned = stage(rows.mapInArrow(_scan(lengths, _bit_map(windows, number, most_bits)), CANDIDATES), "benchmark-candidates")
    nothing = scanned.filter(F.size("candidates") == 0).select(
        "doc_id", "raw", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"),
        F.lit(None).cast("array<struct<begin: long, end: long>>").alias("spans"),
    )
    some = scanned.filter(F.size("candidates") > 0)
    places = some.select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    key = ["n", "hash", "words"]
    known = windows.filter("n > 0")
    if number <= BROADCAST_WINDOWS:
        known = F.broadcast(known)
    hits = places.join(known, key, "left_semi")
    # Runs of windows that touch or overlap are one span.
    earlier = Window.partitionBy("row").orderBy("at", "n")
    reach = F.max(F.col("at") + F.col("n")).over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    begun = hits.select("row", "n", "at", (F.col("at") > F.coalesce(reach, F.lit(-1))).cast("int").alias("begins"))
    runs = begun.withColumn("run", F.sum("begins").over(earlier)).groupBy("row", "run").agg(F.min("at").alias("begin"), F.max(F.col("at") + F.col("n")).alias("end"))
    spans = runs.groupBy("row").agg(F.sum(F.col("end") - F.col("begin")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    named = places.select("row", *key).distinct().join(known, key).select("row", "item").distinct()
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list("item")), ","), 256)
    named = named.groupBy("row").agg(F.count(F.lit(1)).alias("n_items"), digest.alias("items_sha256"))
    found = some.join(spans, "row", "left").join(named, "row", "left")
    found = found.select("doc_id", "raw", "n_words", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_hit", "n_items")), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), "spans")
    judged = nothing.unionByName(found).withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<begin: long, end: long>>")))
    return judged.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    A document is contaminated when at least a twentieth of its words, and one, are hit.
    """
    return _judged(docs, benchmark, most_bits).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")


def decontaminated(docs: DataFrame, benchmark: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated; the side that is joined has the ids of those that are."""
    bad = _judged(docs, benchmark, most_bits).filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("raw").alias("_raw")).distinct()
    bad = stage(bad, "benchmark-contaminated")
    raw = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (raw == bad["_raw"]), "left_anti")


def items_digest(items: list[str]) -> str:
    """The digest of a set of item ids, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
