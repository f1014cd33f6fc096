"""Exact deduplication by composable polynomial fingerprints.

A text's bytes, A-Z lower-cased, are the digits of a polynomial that is taken
at four fixed points modulo 2^31 - 1.  Hashes of neighbouring pieces combine by
arithmetic, ``H(ab) = H(a) * r^len(b) + H(b)``, so pieces are hashed
independently and a very long text is spread over many tasks.  Texts whose
fingerprints are equal are then compared piece by piece with the text that
stays, so a collision can never drop a document.  Texts are cut in one pass,
so a text of any length takes time in proportion to it.

Cases: a null text counts as empty; rows with the same doc_id and text are
copies of each other and share one decision, and of those that stay
``deduplicated`` returns one; a null doc_id is never the one
that stays unless its whole group is null, and is compared like any other; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivena.llm.batches import bounded
from scrivena.llm.words import LOWER, runs_of_texts, utf8
from scrivena.plans.staging import stage

PRIME = (1 << 31) - 1
RADIXES = (1146283691, 2068310387, 731945173, 1598342141)  # fixed points of the polynomial
CHUNK_BYTES = 1024
SEGMENT_CHARS = 1 << 16
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
N = len(RADIXES)


def normalised(text: Column) -> Column:
    """Null as empty, A-Z lower-cased, nothing else changed."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWERED)


def powers(radix: int, n: int) -> np.ndarray:
    """radix^0 to radix^(n - 1), modulo the prime."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:  # doubling: powers[k + done] = powers[k] * radix^done
        step = np.uint64(pow(radix, done, PRIME))
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step % np.uint64(PRIME)
        done += more
    return out


def _chunk_powers() -> np.ndarray:
    """For each byte of a chunk, and each radix, the power that the byte is multiplied by."""
    return np.stack([powers(r, CHUNK_BYTES)[::-1] for r in RADIXES], axis=1).astype(np.float64)


def polynomial_hashes(low: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hashes (texts x radixes) of the byte runs that ``offsets`` cut out of ``low``.

    Each run is padded in front with zeros, which add nothing to the polynomial, to whole
    chunks; a chunk's sums stay below 2^53, so the matrix product is exact.
    """
    lengths = np.diff(offsets)
    chunks = -(-lengths // CHUNK_BYTES)
    first = np.concatenate([[0], np.cumsum(chunks)])
    total = int(first[-1])
    out = np.zeros((len(lengths), N), np.uint64)
    if not total:
        return out
    body = np.zeros(total * CHUNK_BYTES)
    shift = first[1:] * CHUNK_BYTES - offsets[1:]
    body[np.arange(len(low)) + np.repeat(shift, lengths)] = low
    each = (body.reshape(total, CHUNK_BYTES) @ table).astype(np.uint64) % np.uint64(PRIME)
    left = np.repeat(first[1:], chunks) - np.arange(total) - 1  # chunks that follow in the text
    some = chunks > 0
    for k, radix in enumerate(RADIXES):
        step = powers(pow(radix, CHUNK_BYTES, PRIME), int(chunks.max()))
        terms = each[:, k] * step[left] % np.uint64(PRIME)
        out[some, k] = np.add.reduceat(terms, first[:-1][some]) % np.uint64(PRIME)
    return out


def _hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to the columns the fingerprint, the bytes and the digest of each text."""
    table = _chunk_powers()
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        hashes = np.zeros((batch.num_rows, N), np.uint64)
        digests = []
        for begin, end in runs_of_texts(offsets):
            low = LOWER[data[offsets[begin] : offsets[end]]]
            own = offsets[begin : end + 1] - offsets[begin]
            hashes[begin:end] = polynomial_hashes(low, own, table)
            raw = memoryview(low)
            digests += [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(own[:-1], own[1:])]
        rest = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays(
            [*rest.columns, *(pa.array(hashes[:, k].astype(np.int64)) for k in range(N)), pa.array(np.diff(offsets).astype(np.int64)), pa.array(digests, pa.string())],
            [*rest.schema.names, *(f"h{k}" for k in range(N)), "n_bytes", "text_sha256"],
        )


def _hash_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprint and bytes of each piece of a long text, with r^bytes by which what stands before it is shifted."""
    for batch in _hash_texts(batches):
        sizes = batch.column("n_bytes").to_numpy()
        shifts = [pa.array([pow(r, int(n), PRIME) for n in sizes], pa.int64()) for r in RADIXES]
        rest = batch.drop_columns(["text_sha256"])
        yield pa.RecordBatch.from_arrays([*rest.columns, *shifts], [*rest.schema.names, *(f"s{k}" for k in range(N))])


def _segments(text: Column, size: int) -> Column:
    """Array of the pieces of ``size`` characters, cut in one pass; an empty text has one empty piece."""
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def _appended(k: int):
    """The hash of what is there and one piece more."""
    return lambda h, piece: (h * piece[f"s{k}"] + piece[f"h{k}"]) % PRIME


def fingerprints(docs: DataFrame, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """(doc_id, raw, h0..h3, n_bytes, text_sha256) of each row; raw is a hash of the text as it is.

    Texts of up to ``segment_chars`` characters are hashed where they are read.  Longer ones
    are cut, their pieces dealt over the cluster, hashed there and combined in order; they are
    staged under a number of their row, which thus stays the same if tasks are run again.
    """
    text = F.coalesce("text", F.lit(""))
    rows = bounded(docs).select("doc_id", text.alias("text"), F.xxhash64(text).alias("raw"))
    hashes = ", ".join(f"h{k} long" for k in range(N)) + ", n_bytes long"
    short = rows.filter(F.length("text") <= segment_chars).mapInArrow(_hash_texts, f"doc_id long, raw long, {hashes}, text_sha256 string")
    long = stage(rows.filter(F.length("text") > segment_chars).withColumn("row", F.monotonically_increasing_id()), "dedup-long")
    parts = (
        long.select("row", F.posexplode(_segments(F.col("text"), segment_chars)).alias("seg", "text"))
        .repartition("row", "seg")
        .mapInArrow(_hash_segments, f"row long, seg int, {hashes}, {', '.join(f's{k} long' for k in range(N))}")
    )
    ordered = F.array_sort(F.collect_list(F.struct("seg", *(f"h{k}" for k in range(N)), *(f"s{k}" for k in range(N)))))
    joined = parts.groupBy("row").agg(ordered.alias("parts"), F.sum("n_bytes").alias("n_bytes"))
    for k in range(N):
        joined = joined.withColumn(f"h{k}", F.aggregate("parts", F.lit(0).cast("long"), _appended(k)))
    whole = long.select("row", "doc_id", "raw", F.sha2(normalised(F.col("text")), 256).alias("text_sha256")).join(joined, "row")
    return short.unionByName(whole.select(short.columns))


def exact_duplicates(docs: DataFrame, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, raw.

    Texts are equal when identical after lower-casing A-Z; of equal texts the largest doc_id stays.
    raw is xxhash64 of the text as it is (null as empty), by which rows that repeat a doc_id are told apart.
    """
    key = [*(f"h{k}" for k in range(N)), "n_bytes"]
    prints = stage(fingerprints(docs, segment_chars), "dedup-fingerprints")
    # The groups are staged before they are joined back, so that one with very many rows can be split in the join.
    groups = stage(prints.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "dedup-groups")
    links = stage(prints.join(groups, key), "dedup-links")

    shared = links.filter("group_size > 1").select(F.col("doc_id").alias("_id"), F.col("raw").alias("_raw"), "keep_id", *key).distinct()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("raw", F.xxhash64("text"))
    pieces = (  # the hint spares a sort of whole texts; the side that is hashed has ids only
        texts.join(shared.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("raw") == F.col("_raw")))
        .select("doc_id", "raw", "keep_id", *key, F.posexplode(_segments(F.col("text"), segment_chars)).alias("seg", "text"))
        .withColumn("text", normalised(F.col("text")))
    )
    pieces = stage(pieces, "dedup-pieces")
    stays = pieces.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(*key, "seg", F.col("text").alias("kept_text"), F.col("raw").alias("kept_raw"))
    # Rows that repeat a doc_id may bring several texts under one keep_id: one of them stays.
    one = stays.groupBy(*key).agg(F.min("kept_raw").alias("kept_raw"))
    stays = stage(stays.join(one, [*key, "kept_raw"]).dropDuplicates([*key, "seg"]), "dedup-stays")
    compared = (
        pieces.join(stays.hint("shuffle_hash"), [*key, "seg"], "left")
        .groupBy("doc_id", "raw", *key)
        .agg(F.min(F.coalesce((F.col("text") == F.col("kept_text")).cast("int"), F.lit(0))).alias("same"))
    )
    differing = stage(compared.filter("same = 0").select("doc_id", "raw", *key), "dedup-differing")
    result = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "raw"]
    if differing.isEmpty():
        return links.select(*result)
    return _regrouped(docs, links, differing, key).select(*result)


def deduplicated(docs: DataFrame, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each group, also where rows repeat its doc_id."""
    return one_of_each(docs, exact_duplicates(docs, segment_chars), ["doc_id", "text_sha256"])


def one_of_each(docs: DataFrame, found: DataFrame, group: list[str]) -> DataFrame:
    """Of the rows of ``docs`` that ``found`` (doc_id, raw, kept, and the columns of ``group``) keeps, one of each group.

    Where rows of a group repeat its doc_id, the text of the least raw stays, with the columns of any one
    of its rows.  Only those rows are grouped with their texts.
    """
    dropped, stays = found.filter(~F.col("kept")).select("doc_id", "raw"), found.filter("kept")
    ids = stage(stays.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "dedup-repeated-ids")
    if ids.isEmpty():
        return without(docs, dropped)
    groups = stays.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("raw").alias("one"), F.collect_set("raw").alias("raws")).filter("n > 1")
    groups = stage(groups.select(F.col("doc_id").alias("_id"), F.col("one").alias("_raw"), F.col("raws")), "dedup-repeated")
    taken = dropped.unionByName(groups.select(F.col("_id").alias("doc_id"), F.explode("raws").alias("raw")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"))
    raw = F.xxhash64(F.coalesce(F.col("d.text"), F.lit("")))
    repeated = rows.join(groups.drop("raws"), F.col("d.doc_id").eqNullSafe(F.col("_id")) & (raw == F.col("_raw")))
    firsts = repeated.groupBy("_id", "_raw").agg(F.first("d").alias("d"))
    return without(docs, taken).unionByName(firsts.select("d.*"))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``dropped`` (doc_id, raw) doesn't name; the hashed side has ids only."""
    names = dropped.select(F.col("doc_id").alias("_id"), F.col("raw").alias("_raw")).distinct().hint("shuffle_hash")
    raw = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(names, docs["doc_id"].eqNullSafe(names["_id"]) & (raw == names["_raw"]), "left_anti")


def _regrouped(docs: DataFrame, links: DataFrame, differing: DataFrame, key: list[str]) -> DataFrame:
    """Groups by fingerprint and the text itself, for the fingerprints that differing texts share."""
    hit = differing.select(*key).distinct()
    clear = links.join(hit, key, "left_anti")
    mixed = links.join(hit, key, "left_semi").drop("keep_id", "group_size")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("raw", F.xxhash64("text"))
    texts = texts.select("doc_id", "raw", normalised(F.col("text")).alias("same_text")).distinct()
    on = mixed.doc_id.eqNullSafe(texts.doc_id) & (mixed.raw == texts.raw)
    named = mixed.join(texts, on).select(mixed["*"], texts.same_text)
    groups = named.groupBy(*key, "same_text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return clear.unionByName(named.join(groups, [*key, "same_text"]).select(clear.columns))
