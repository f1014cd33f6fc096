"""Chat formatting with loss masks that are aligned by offsets.

A turn is rendered as ``<|start|>role<|sep|>text<|end|>``.  In roles and texts
one backslash is put after ``<`` wherever ``<``, backslashes and ``|`` follow
each other, so no control string can occur there and reading back takes the
backslash away again.  The rendered conversation is encoded once; turn spans
and token spans are both sorted, so a binary search finds for each token the
assistant text that it overlaps.  The control strings are tokens of their own,
so a token never reaches from one turn into another.

A conversation of up to ``PART_CHARS`` characters is rendered whole and encoded
once, where it is.  One that is longer may hold any share of all rows: its turns
are dealt over the cluster by range and each task renders and encodes the runs
of turns it gets, in parts of about that size.  As control strings are tokens of
their own, no token crosses the end of a turn: the parts' ids, offsets and masks,
joined, are those of the whole conversation encoded at once.

Cases: a null text or role is empty; turns with equal numbers, or null ones,
which come first, go by role, then text; repeated rows are repeated turns; null
conv_ids are one conversation; a very long text is one turn, which is not cut;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivena.llm.batches import bounded
from scrivena.plans.staging import stage

TOKENIZER_FILE = "/opt/tokenizers/byte_bpe_50k.json"
START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"  # the template's control strings
LEARNED_ROLE = "assistant"
PART_CHARS = 1 << 20
TURN_CHARS = 32  # counted for the control strings of a turn
ORDER_CHARS = 64  # of a text, by which turns of equal number and role are dealt
ENCODED_AT_ONCE = 1 << 19
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.S)

SCHEMA = (
    "conv_id long, chunk long, part int, whole boolean, n_turns int, text string, input_ids array<int>, "
    "token_begin array<int>, token_end array<int>, loss_mask array<boolean>"
)


READ = "conv_id long, chunk long, part int, whole boolean, n_turns long, loss_chars long, chars long, said string, loss string"
READ_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendered text, and the sorted spans in it of the texts that are learned."""
    pieces, spans, at = [], [], 0
    for role, text in turns:
        own = escape(text)
        head = START + escape(role) + SEP
        if role == LEARNED_ROLE:
            spans.append((at + len(head), at + len(head) + len(own)))
        pieces += [head, own, END]
        at += len(head) + len(own) + len(END)
    return "".join(pieces), spans


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    return [(unescape(role), unescape(own)) for role, own in _TURN.findall(text)]


def mask(begins: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of the sorted token spans overlap one of the sorted turn spans."""
    if not spans:
        return np.zeros(len(begins), bool)
    first, last = np.array(spans).T
    at = np.searchsorted(last, begins, side="right")  # the first turn span that ends after the token begins
    return (at < len(first)) & (first[np.minimum(at, len(first) - 1)] < ends) & (ends > begins)


def masked_texts(text: str, begins: Sequence[int], ends: Sequence[int], learned: Sequence[bool]) -> list[str]:
    """The texts under the mask: one for each run of masked tokens, unescaped."""
    flags = np.concatenate([[False], np.array(learned, bool), [False]])
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    return [unescape(text[begins[a] : ends[b - 1]]) for a, b in zip(edges[::2], edges[1::2])]


@functools.cache
def load_tokenizer(path: str):
    """The tokenizer with the control strings added as tokens of their own."""
    from tokenizers import AddedToken, Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(s, special=True, normalized=False) for s in (START, SEP, END)])
    return tokenizer


def _format(path: str, whole: bool):
    def encode(tokenizer, parts: list[tuple]) -> pa.RecordBatch:
        rendered = [render(turns) for *_, turns in parts]
        encoded = tokenizer.encode_batch([text for text, _ in rendered], add_special_tokens=False)
        ids, begins, ends, masks = [], [], [], []
        for e, (_, spans) in zip(encoded, rendered):
            ids.append(np.fromiter(e.ids, np.int32, len(e)))
            at = np.fromiter(itertools.chain.from_iterable(e.offsets), np.int32, 2 * len(e)).reshape(-1, 2)
            begins.append(at[:, 0])
            ends.append(at[:, 1])
            masks.append(mask(at[:, 0], at[:, 1], spans))
        ints, flags = pa.list_(pa.int32()), pa.list_(pa.bool_())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([p[0] for p in parts], pa.int64()),
                pa.array([p[1] for p in parts], pa.int64()),
                pa.array([p[2] for p in parts], pa.int32()),
                pa.array([whole] * len(parts), pa.bool_()),
                pa.array([len(p[3]) for p in parts], pa.int32()),
                pa.array([text for text, _ in rendered], pa.string()),
                pa.array(ids, ints),
                pa.array(begins, ints),
                pa.array(ends, ints),
                pa.array(masks, flags),
            ],
            ["conv_id", "chunk", "part", "whole", "n_turns", "text", "input_ids", "token_begin", "token_end", "loss_mask"],
        )

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(path)
        done: list[tuple] = []
        key, part, turns, size, held = None, 0, [], 0, 0
        for batch in batches:
            for conv, chunk, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "chunk", "role", "text"))):
                more = len(role) + len(text) + TURN_CHARS
                if turns and (key != (conv, chunk) or not whole and size + more > PART_CHARS):
                    done.append((*key, part, turns))
                    part = part + 1 if key == (conv, chunk) else 0
                    turns, size, held = [], 0, held + size
                    if held > ENCODED_AT_ONCE:
                        yield encode(tokenizer, done)
                        done, held = [], 0
                key = (conv, chunk)
                turns.append((role, text))
                size += more
        if turns:
            done.append((*key, part, turns))
        if done:
            yield encode(tokenizer, done)

    return formatted


def formatted(conversations: DataFrame, tokenizer_file: str = TOKENIZER_FILE) -> DataFrame:
    """Rendered and encoded conversations: conv_id, chunk, part, whole, n_turns, text, input_ids, token spans, loss_mask.

    whole tells that the row is all of its conversation; the rows of any other go by chunk, then part.
    """
    rows = bounded(conversations).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.length("role") + F.length("text") + TURN_CHARS
    sizes = rows.groupBy(F.col("conv_id").alias("long_id")).agg(F.sum(size).alias("size"))
    long = stage(sizes.filter(F.col("size") > PART_CHARS).select("long_id"), "chat-long")
    order = ["conv_id", "turn", "role", "text"]
    if long.isEmpty():
        return _whole(rows, order, tokenizer_file)
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    dealt = rows.join(long, is_long, "left_semi").repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, ORDER_CHARS))
    parts = dealt.sortWithinPartitions(*order).withColumn("chunk", F.spark_partition_id().cast("long")).mapInArrow(_format(tokenizer_file, whole=False), SCHEMA)
    return _whole(rows.join(long, is_long, "left_anti"), order, tokenizer_file).unionByName(parts)


def _whole(rows: DataFrame, order: list[str], tokenizer_file: str) -> DataFrame:
    dealt = rows.repartition("conv_id").sortWithinPartitions(*order).withColumn("chunk", F.lit(0).cast("long"))
    return dealt.mapInArrow(_format(tokenizer_file, whole=True), SCHEMA)


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The lists of a column, as slices of one array."""
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (values[a:b] for a, b in zip(at[:-1], at[1:]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each part says under its roles and under its mask: digests if it is all of its conversation, else the texts."""
    for batch in batches:
        rows = []
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "chunk", "part", "whole", "text"))
        spans = (_lists(batch.column(c)) for c in ("token_begin", "token_end", "loss_mask"))
        for conv, chunk, part, whole, text, begins, ends, learned in zip(*columns, *spans):
            turns = read_back(text)
            said = "".join(f"{role}\n{own}\n" for role, own in turns)
            loss = "".join(masked_texts(text, begins, ends, learned))
            if whole:
                texts = (hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest())
            else:
                texts = (said, loss)
            rows.append((conv, chunk, part, whole, len(turns), len(loss), len(text), *texts))
        if rows:
            names = ["conv_id", "chunk", "part", "whole", "n_turns", "loss_chars", "chars", "said", "loss"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), READ_TYPES)], names)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of parts in order -> counts and digests of each conversation."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    key, begun, rows = None, False, []
    n_turns = loss_chars = chars = 0
    turns, loss = hashlib.sha256(), hashlib.sha256()
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "whole", "n_turns", "loss_chars", "chars", "said", "loss"))
        for conv, whole, own_turns, own_loss, own_chars, said, learned in zip(*columns):
            if whole:
                rows.append((conv, own_turns, said, own_loss, learned, own_chars))
                continue
            if begun and conv != key:
                rows.append((key, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                n_turns = loss_chars = chars = 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            key, begun = conv, True
            n_turns += own_turns
            loss_chars += own_loss
            chars += own_chars
            turns.update(said.encode())
            loss.update(learned.encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
            rows = []
    if begun:
        last = [(key, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*last), types)], names)


def digests(parts: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of the output of ``formatted``.

    A part that is all of its conversation is digested where it was made.  A digest is made of all turns in order,
    so the parts of a longer conversation pass through one task, one at a time.
    """
    columns = ["conv_id", "chunk", "part", "whole", "text", "token_begin", "token_end", "loss_mask"]
    read = parts.select(*columns).mapInArrow(_read, READ)
    ordered = read.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "part")
    return ordered.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
