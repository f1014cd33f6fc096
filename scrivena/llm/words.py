"""Word kernels over Arrow string columns, used inside Spark tasks.

A word is a longest run of bytes that are digits, ASCII letters (A-Z taken as
a-z) or non-ASCII, which over UTF-8 is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after
lower-casing A-Z.  Words are hashed to 64 bits with whole-array arithmetic.  Texts
are taken many at a time up to ``BLOCK_BYTES``, longer ones by ``blocks_of`` in
overlapping blocks of about that size, so that memory follows the block and not
the text; only a single word is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True

_RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_RADIX), -1, 1 << 64))
_BYTE_CODE = np.random.default_rng(20261).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all bits of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _radix_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        for name, radix in (("up", _RADIX), ("down", _INVERSE)):
            steps = np.full(n, radix, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


@dataclass
class Words:
    """Words of a run of texts: hashes, byte spans in ``data`` and the first word of each text."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # text i has the words first[i] to first[i + 1]
    data: np.ndarray  # lower-cased bytes

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, begin: int, end: int) -> bytes:
        """The words begin to end, joined by spaces."""
        raw = self.data
        return b" ".join(raw[s:e].tobytes() for s, e in zip(self.starts[begin:end], self.ends[begin:end]))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def runs_of_texts(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs (begin, end) of texts with at most ``most`` bytes, or of one longer text."""
    begin, n = 0, len(offsets) - 1
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1)
        yield begin, min(end, n)
        begin = min(end, n)


def _hash_block(low: np.ndarray, inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and spans of the words of a block; a word ends at each of ``cuts``."""
    n = len(low)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[cuts[cuts < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _radix_powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODE[low] * up[:n], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), starts, ends


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the texts that ``offsets`` cut out of ``data``, in order."""
    base = int(offsets[0])
    low = LOWER[data[base : int(offsets[-1])]]
    cuts = np.asarray(offsets, np.int64) - base
    inside = IS_WORD[low]
    parts, at, n = [], 0, len(low)
    while at < n:
        end = min(n, at + BLOCK_BYTES)
        if end < n:  # back to the end of a word; onward if the block is one word
            gaps = np.flatnonzero(~inside[at:end])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                later = np.flatnonzero(~inside[end:])
                end = end + int(later[0]) + 1 if len(later) else n
        own = cuts[np.searchsorted(cuts, at) : np.searchsorted(cuts, end, side="right")] - at
        h, s, e = _hash_block(low[at:end], inside[at:end], own)
        parts.append((h, s + at, e + at))
        at = end
    if parts:
        hashes, starts, ends = (np.concatenate(x) for x in zip(*parts))
    else:
        hashes, starts, ends = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return Words(hashes, starts, ends, np.searchsorted(starts, cuts), low)


def blocks_of(data: np.ndarray, overlap: int) -> Iterator[tuple[Words, int, int]]:
    """Words of one text in blocks: (words, number of words before them, how many of them the block before has as well).

    A block begins with the last ``overlap`` words of the one before it, so a run of up to ``overlap`` + 1 words is whole in one;
    all blocks but the last have more words than that.
    """
    at = before = again = reached = 0
    n = len(data)
    while True:
        end = min(n, reached + BLOCK_BYTES)
        while end < n and IS_WORD[data[end - 1]]:  # back to the end of a word, or on if that is all there is
            gaps = np.flatnonzero(~IS_WORD[data[reached:end]])
            if len(gaps):
                end = reached + int(gaps[-1]) + 1
            else:
                end = min(n, end + BLOCK_BYTES)
        words = words_of(data, np.array([at, end]))
        if end < n and len(words.hashes) <= overlap:
            reached = end
            continue
        yield words, before, again
        if end >= n:
            return
        again = min(overlap, len(words.hashes))
        before += len(words.hashes) - again
        at = at + int(words.starts[-again]) if again else end
        reached = end


def taken(data: np.ndarray, offsets: np.ndarray, overlap: int) -> Iterator[tuple[int, int, Words, int, int, bool]]:
    """Texts begin to end with their words, then for the blocks of a longer text as of ``blocks_of``: (begin, end, words, before, again, whether it is the last)."""
    for begin, end in runs_of_texts(offsets):
        if offsets[end] - offsets[begin] <= BLOCK_BYTES:
            yield begin, end, words_of(data, offsets[begin : end + 1]), 0, 0, True
            continue
        held = None
        for block in blocks_of(data[offsets[begin] : offsets[end]], overlap):
            if held is not None:
                yield begin, end, *held, False
            held = block
        yield begin, end, *held, True


def grams(words: Words, n: int, whole_if_shorter: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within a text, and the first gram of each text.

    With ``whole_if_shorter`` a text of fewer words, but not none, has one gram: all its words.
    """
    counts = words.counts()
    size = len(words.hashes)
    last = np.repeat(words.first[1:], counts)  # end of each word's text
    at = np.arange(size)
    total = np.zeros(size, np.uint64)
    radix = np.uint64(0xD6E8FEB86659FD93)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(min(n, int(counts.max(initial=0)))):
            shifted = np.zeros(size, np.uint64)
            shifted[: size - j] = words.hashes[j:]
            shifted[at + j >= last] = 0
            total += shifted * power
            power = power * radix
    number = np.maximum(counts - n + 1, 0)
    if whole_if_shorter:
        number = np.where((counts > 0) & (counts < n), 1, number)
    keep = at - np.repeat(words.first[:-1], counts) < np.repeat(number, counts)
    return mix(total[keep]), np.concatenate([[0], np.cumsum(number)])
