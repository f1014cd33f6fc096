"""Audit of how five document filters interact, in every order in which they can be applied.

The failures of a document are bits: A few words, B few different words, C many capitals, D special
characters, E a text that a smaller doc_id has.  E is an existential self-join: the rows whose text
another row may share are met by a left-semi join on the hash, the exact text and a smaller doc_id;
of each text the other side has the least doc_id only, so a text with very many copies costs one row
for each copy.  Texts that nobody shares are kept out of that join by a bit for each shared hash, in
a map of at most ``1 << decontaminate.MOST_BITS`` bits.  The ids that fail E are put together with those of the other filters, bits are
united by id, and each combination of bits is counted.  All that the 120 orders need follows from
those counts: at most 32 combinations of a part, whatever the size of the table.

Cases: a null text counts as empty (it fails A alone, and E if a smaller doc_id has an empty text
too); a null source belongs to the part of the empty source; a null doc_id has no smaller one, is
smaller than none and has no label; rows that repeat a doc_id are judged each by its own text, and
equal texts of one doc_id are no copies of each other; labels that repeat a doc_id count by their
largest values; words of a text of over ``LONG_BYTES`` are counted by Spark, block by block, with
the same result; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivena.llm import decontaminate
from scrivena.llm.words import BLOCK_BYTES, runs_of_texts, utf8
from scrivena.plans.staging import stage

FILTERS = "ABCDE"
BIT = {name: 1 << k for k, name in enumerate(FILTERS)}
LEAST_WORDS = 200
LEAST_DIFFERENT_PERCENT = 50
MOST_CAPITALS_PERCENT = 2
SPECIAL = b"#$%&*|"
#: A longer text's words are counted by a job of their own.
LONG_BYTES = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IS_CAPITAL, _IS_SPECIAL, _BEGINS = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
_IS_CAPITAL[65:91] = True
_IS_SPECIAL[list(SPECIAL)] = True
_BEGINS[0x80:0xC0] = False  # all bytes of a character but its first


def _marked(flags: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged."""
    out = np.zeros(len(offsets) - 1, np.int64)
    for begin, end in runs_of_texts(offsets):
        if end - begin == 1:
            text = data[offsets[begin] : offsets[end]]
            out[begin] = sum(int(np.count_nonzero(flags[text[k : k + BLOCK_BYTES]])) for k in range(0, len(text), BLOCK_BYTES))
        else:
            sums = np.concatenate([[0], np.cumsum(flags[data[offsets[begin] : offsets[end]]], dtype=np.int64)])
            out[begin:end] = np.diff(sums[offsets[begin : end + 1] - offsets[begin]])
    return out


def _describe(long_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In place of the text its words, different words (both null if it is long), capitals, special and all characters."""
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            counts: list[tuple[int | None, int | None]] = []
            for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                if end - begin > long_bytes:
                    counts.append((None, None))
                else:
                    words = data[begin:end].tobytes().split()  # at the six ASCII spaces
                    counts.append((len(words), len(set(words))))
            rest = batch.drop_columns(["text"])
            n_words, different = (pa.array([c[k] for c in counts], pa.int64()) for k in range(2))
            sums = [pa.array(_marked(flags, data, offsets)) for flags in (_IS_CAPITAL, _IS_SPECIAL, _BEGINS)]
            yield pa.RecordBatch.from_arrays([*rest.columns, n_words, different, *sums], [*rest.schema.names, "n_words", "n_different", "capitals", "special", "chars"])

    return describe


def _block_words(block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def block_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(digest, word, n): how often each word stands in a block of a text; blocks end at spaces."""
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for digest, begin, end in zip(batch.column("digest"), offsets[:-1].tolist(), offsets[1:].tolist()):
                while begin < end:
                    space = _SPACE.search(data, begin + block_bytes, end) if end - begin > block_bytes else None
                    cut = space.start() if space else end
                    found = Counter(data[begin:cut].tobytes().split())
                    begin = cut
                    n = len(found)
                    words = pa.array(list(found), pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([digest.as_py()] * n, pa.string()), words, pa.array(list(found.values()), pa.int64())], ["digest", "word", "n"])

    return block_words


def failures(docs: DataFrame, long_bytes: int = LONG_BYTES) -> DataFrame:
    """(doc_id, part, digest, mask, n) of each doc_id, source and text in ``docs`` (doc_id, source, text).

    mask has the bits of the filters that it fails, n is the number of such rows.
    """
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), text.alias("text"))
    schema = "doc_id long, part string, digest string, n_words long, n_different long, capitals long, special long, chars long"
    described = stage(texts.mapInArrow(_describe(long_bytes), schema), "audit-described")
    long = texts.filter(F.octet_length("text") > long_bytes).select("digest", "text").dropDuplicates(["digest"])
    words = long.mapInArrow(_block_words(long_bytes), "digest string, word string, n long").groupBy("digest", "word").agg(F.sum("n").alias("n"))
    counted = stage(words.groupBy("digest").agg(F.sum("n").alias("long_words"), F.count(F.lit(1)).alias("long_different")), "audit-long-words")

    short = described.filter("n_words is not null")
    long = described.filter("n_words is null").join(counted, "digest", "left").withColumns({"n_words": F.coalesce("long_words", F.lit(0)), "n_different": F.coalesce("long_different", F.lit(0))})
    marks = short.unionByName(long.select(short.columns))
    conditions = {
        "A": F.col("n_words") < LEAST_WORDS,
        "B": 100 * F.col("n_different") < LEAST_DIFFERENT_PERCENT * F.col("n_words"),
        "C": 100 * F.col("capitals") > MOST_CAPITALS_PERCENT * F.col("chars"),
        "D": F.col("special") > 0,
    }
    bits = sum((F.when(c, F.lit(BIT[name])).otherwise(F.lit(0)) for name, c in conditions.items()), F.lit(0))
    others = marks.select("doc_id", "part", "digest", bits.alias("mask"), F.lit(1).cast("long").alias("n"))
    copies = copied(texts, described).select("doc_id", "part", "digest", F.lit(BIT["E"]).alias("mask"), F.lit(0).cast("long").alias("n"))
    return others.unionByName(copies).groupBy("doc_id", "part", "digest").agg(F.bit_or("mask").alias("mask"), F.sum("n").alias("n"))


def copied(texts: DataFrame, described: DataFrame) -> DataFrame:
    """The rows of ``texts`` (doc_id, part, digest, text) whose very text a smaller doc_id has; ``described`` has their ids and digests."""
    shared = described.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("largest")).filter("least < largest").select("digest")
    shared = stage(shared, "audit-shared")
    known = decontaminate._bit_map(shared.select(F.xxhash64("digest").alias("hash")), shared.count(), decontaminate.MOST_BITS)

    @F.pandas_udf("boolean")
    def may_be_shared(hashes: pd.Series) -> pd.Series:
        return pd.Series(known.has(hashes.to_numpy().view(np.uint64)))

    candidates = stage(texts.filter(may_be_shared(F.xxhash64("digest"))).join(shared, "digest"), "audit-candidates")
    firsts = candidates.groupBy("digest", "text").agg(F.min("doc_id").alias("first"))
    a, b = candidates.alias("a"), firsts.alias("b")
    return a.join(b, (F.col("a.digest") == F.col("b.digest")) & (F.col("a.text") == F.col("b.text")) & (F.col("b.first") < F.col("a.doc_id")), "left_semi")


def combinations(docs: DataFrame, labels: DataFrame, long_bytes: int = LONG_BYTES) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each source by the filters they fail, and how many of them the labels call good and toxic."""
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("is_good"), F.max(F.col("toxic") == 1).alias("is_toxic"))
    failing = failures(docs, long_bytes).join(marks, "doc_id", "left")
    of = lambda mark: F.coalesce(F.sum(F.when(F.col(mark), F.col("n"))), F.lit(0))
    return failing.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("is_good").alias("good"), of("is_toxic").alias("toxic"))


def audited(docs: DataFrame, labels: DataFrame, long_bytes: int = LONG_BYTES) -> DataFrame:
    """What each filter does to each part of ``docs`` (doc_id, source, text) at each step of each order.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley; ``labels`` has doc_id, quality and toxic.
    """
    spark = docs.sparkSession
    counts = stage(combinations(docs, labels, long_bytes), "audit-combinations")
    # What happens at a step depends on which filters came before, not on their order: 80 cases.
    cases = [(before, bit) for bit in BIT.values() for before in range(32) if not before & bit]
    case = F.explode(F.array(*(F.struct(F.lit(b).alias("before"), F.lit(f).alias("bit")) for b, f in cases))).alias("case")
    rows = counts.select("*", case).select("part", "mask", "n", "good", "toxic", "case.*")
    fails, free = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) == 0
    total = lambda when, what="n": F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0))
    # A filter comes first among the k that a document fails in 120 / k of the orders.
    share = F.when(fails, F.col("n") * F.lit(120) / F.bit_count("mask")).otherwise(0).cast("long")
    steps = rows.groupBy("part", "before", "bit").agg(
        total(~fails & free).alias("kept"),
        total(fails & free).alias("removed"),
        total(fails & ~free).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & free, "good").alias("good_lost"),
        total(fails & free, "toxic").alias("toxic_lost"),
        F.sum(share).alias("shapley"),
    )
    orders = ["".join(o) for o in itertools.permutations(FILTERS)]
    places = [(o, k + 1, sum(BIT[f] for f in o[:k]), BIT[o[k]]) for o in orders for k in range(5)]
    order = spark.createDataFrame(places, "filter_order string, step int, before int, bit int")  # 600 rows
    return steps.join(F.broadcast(order), ["before", "bit"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


ORACLE_SQL = r"""
with words as materialized (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
),
marks as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
failing as materialized (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
         (case when len(w) < 200 then 1 else 0 end) + (case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end)
         + (case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) then 4 else 0 end)
         + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end)
         + (case when min(words.doc_id) over (partition by t) < words.doc_id then 16 else 0 end) as mask
  from words left join marks using (doc_id)
),
counts as materialized (select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from failing group by part, mask),
f(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from f a, f b, f c, f d, f e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31
),
steps as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::integer as before from orders, (select unnest(range(1, 6))::integer as step))
select part, filter_order, step,
       coalesce(sum(n) filter (mask & bit = 0 and mask & before = 0), 0)::bigint as kept,
       coalesce(sum(n) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as removed,
       coalesce(sum(n) filter (mask & bit <> 0 and mask & before <> 0), 0)::bigint as redundant,
       coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
       coalesce(sum(counts.good) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as good_lost,
       coalesce(sum(counts.toxic) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as toxic_lost,
       coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) filter (mask & bit <> 0), 0)::bigint as shapley
from counts, steps group by part, filter_order, step
"""
