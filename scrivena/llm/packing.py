"""Packing by optimal length buckets.

The histogram of all lengths is taken over the cluster; dynamic programming
over it chooses the bucket bounds that leave the least padding when every
sequence is padded to its bucket's bound.  Within a bucket, batches take as
many sequences as the token budget allows at that bound.

Texts are encoded by a byte-level BPE tokenizer.  A text of more than
``most_tokens`` tokens is cut into pieces of that many and a rest, each with its
token ids and the place in the text, in UTF-8 bytes, at which it begins; so a
histogram has at most ``most_tokens`` rows: it alone comes to the driver.
Pieces are numbered within a bucket in ``shares`` independent shares, whose
sizes give each its offset, so a length that very many pieces have is not
numbered in one task.

Cases: a null or empty text has one piece of no tokens, which is in no bucket
or batch; very long texts are encoded whole, in blocks that are cut only at
places no token can cross, however far the next one is; equal lengths and
repeated rows are packed one by one, rows that are equal in all in any order;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivena.llm.batches import bounded
from scrivena.plans.staging import stage

TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the tokenizer's vocabulary expects a text to be cut into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_TOKENS = 2048
BUCKETS = 8
BUDGET = 16_384
TOKENS_A_SHARE = 4_000_000
LEAST_SHARES = 64
BLOCK_CHARS = 1 << 16
TOKENS_AT_ONCE = 1 << 20

PIECE = "doc_id long, piece int, first_token long, n_tokens int, first_byte long, n_bytes long, input_ids array<int>"
PIECE_COLUMNS = ["doc_id", "piece", "first_token", "n_tokens", "first_byte", "n_bytes", "input_ids"]
# No match of WORDS goes on from another character to white space (``\x1c`` to ``\x1f`` are none for the tokenizer), from an
# ASCII letter to another ASCII character than a letter, or from an ASCII digit to another than a digit.
_PLACE = re.compile(r"(?<=[\S\x1c-\x1f])[^\S\x1c-\x1f]|(?<=[A-Za-z])(?=[!-@\[-`{-~])|(?<=[0-9])(?=[!-/:-~])")


@functools.cache
def load_tokenizer(path: str):
    """The tokenizer, and how many bytes each of its tokens stands for."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("packing", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}), sizes


def blocks_of(text: str, most: int = BLOCK_CHARS) -> Iterator[str]:
    """The text in blocks of ``most`` characters and on to the next place, each of which is encoded as it would be within the whole."""
    at = 0
    while len(text) - at > most and (place := _PLACE.search(text, at + most)):
        yield text[at : place.start()]
        at = place.start()
    yield text[at:]


def encoded(text: str, path: str = TOKENIZER_FILE) -> np.ndarray:
    """Token ids of the whole text."""
    tokenizer, _ = load_tokenizer(path)
    if len(text) <= BLOCK_CHARS:
        return np.array(tokenizer.encode_ordinary(text), np.int32)
    return np.concatenate([np.array(tokenizer.encode_ordinary(block), np.int32) for block in blocks_of(text, BLOCK_CHARS)])


def _pieces(path: str, most_tokens: int):
    def batch_of(columns: list[list], ids: list[np.ndarray], shares: list[int]) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        return pa.RecordBatch.from_arrays([*arrays, lists, pa.array(shares, pa.int64())], [*PIECE_COLUMNS, "hash"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, sizes = load_tokenizer(path)
        columns, ids, hashes, held = [[] for _ in PIECE_COLUMNS[:-1]], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                whole = encoded(text.as_py() or "", path)
                places = np.concatenate([[0], np.cumsum(sizes[whole])])
                for k, first in enumerate(range(0, max(1, len(whole)), most_tokens)):
                    own = whole[first : first + most_tokens]
                    begin, end = int(places[first]), int(places[first + len(own)])
                    for column, x in zip(columns, (doc_id, k, first, len(own), begin, end - begin)):
                        column.append(x)
                    ids.append(own)
                    hashes.append(zlib.crc32(own.tobytes(), zlib.crc32(f"{doc_id}/{k}".encode())))
                    held += len(own)
                    if held > TOKENS_AT_ONCE:
                        yield batch_of(columns, ids, hashes)
                        columns, ids, hashes, held = [[] for _ in columns], [], [], 0
        if ids:
            yield batch_of(columns, ids, hashes)

    return pieces


def best_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding; of equal choices the first.

    padding(i, j) of lengths i to j in one bucket is counts * length of j, less the tokens in them.
    """
    order = np.argsort(lengths)
    length = np.array(lengths, np.float64)[order]
    count = np.array(counts, np.float64)[order]
    n = len(length)
    if n == 0:
        return []
    rows = np.concatenate([[0], np.cumsum(count)])
    tokens = np.concatenate([[0], np.cumsum(count * length)])
    best = length * rows[1:] - tokens[1:]  # with one bucket, of lengths up to j
    cuts = []
    for _ in range(1, min(buckets, n)):
        after, cut = best.copy(), np.full(n, -1)
        for j in range(1, n):
            # the last bucket holds i + 1 to j
            total = best[:j] + length[j] * (rows[j + 1] - rows[1 : j + 1]) - (tokens[j + 1] - tokens[1 : j + 1])
            i = int(total.argmin())
            if total[i] < after[j]:
                after[j], cut[j] = total[i], i
        cuts.append(cut)
        best = after
    bounds, j = [], n - 1
    for cut in reversed(cuts):
        if j >= 0 and cut[j] >= 0:
            bounds.append(int(length[j]))
            j = int(cut[j])
    bounds.append(int(length[j]))
    return bounds[::-1]


def pieces(docs: DataFrame, most_tokens: int = MOST_TOKENS, tokenizer_file: str = TOKENIZER_FILE) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, first_byte, n_bytes, input_ids, hash: each text in pieces of at most ``most_tokens`` tokens.

    hash is a CRC-32 of doc_id and piece as text ("7/0"), then the ids as little-endian 32-bit numbers.
    """
    return bounded(docs).select("doc_id", "text").mapInArrow(_pieces(tokenizer_file, most_tokens), f"{PIECE}, hash long")


def packed(docs: DataFrame, most_tokens: int = MOST_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET, tokenizer_file: str = TOKENIZER_FILE) -> DataFrame:
    """One row per piece: doc_id, piece, its place in tokens and bytes, input_ids, bucket (the padded length), batch, slot.

    Batches are numbered within their bucket, slots within their batch: by share, which is hash modulo the number of
    shares, then doc_id, piece and ids.  bucket * slots used is at most ``budget``, or one sequence where a bucket alone is longer.
    """
    rows = stage(pieces(docs, most_tokens, tokenizer_file), "packing-pieces")
    histogram = rows.filter("n_tokens > 0").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()
    bounds = best_bounds([r.n_tokens for r in histogram], [r.n for r in histogram], buckets)
    shares = number_of_shares(sum(r.n * r.n_tokens for r in histogram))
    bucket = F.lit(None).cast("int")
    for bound in reversed(bounds):
        bucket = F.when(F.col("n_tokens") <= bound, F.lit(bound)).otherwise(bucket)
    dealt = rows.withColumn("bucket", F.when(F.col("n_tokens") > 0, bucket)).withColumn("share", F.pmod("hash", F.lit(shares)).cast("int"))
    full = dealt.filter("bucket is not null")
    sizes = full.groupBy("bucket", "share").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("bucket").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "share", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("bucket", "share").orderBy("doc_id", "piece", "input_ids")
    numbered = full.withColumn("number", F.row_number().over(own)).join(offsets, ["bucket", "share"])
    place = F.col("offset") + F.col("number") - 1
    capacity = F.greatest(F.floor(F.lit(budget) / F.col("bucket")), F.lit(1))
    placed = numbered.select(*PIECE_COLUMNS, "bucket", F.floor(place / capacity).cast("long").alias("batch"), F.pmod(place, capacity).cast("int").alias("slot"))
    empty = dealt.filter("bucket is null").select(*PIECE_COLUMNS, "bucket", F.lit(None).cast("long").alias("batch"), F.lit(None).cast("int").alias("slot"))
    return placed.unionByName(empty)


def number_of_shares(tokens: int) -> int:
    return max(LEAST_SHARES, -(-tokens // TOKENS_A_SHARE))
