"""Join of documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

Texts with the same words are one node.  A node's 128 MinHash values, 16 bits
each, are cut into 32 bands of four; nodes that agree in a band are
candidates (a pair at 0.8 shares none with a chance of 5e-8).  Candidates are
compared 16 MinHash values at a time and dropped as soon as the posterior
probability that their similarity reaches the threshold, under a uniform
prior, is below ``TOLERANCE``.  What is left is verified on the n-gram sets.

A bucket of many nodes is cut into blocks of about ``BLOCK`` nodes, fewer where
texts are long, and each pair of blocks is a unit of work of its own, so no task
holds more than two blocks however large a group of near copies is.  A pair is
taken up only in the first band that it shares.  No pair becomes a row: units of
few pairs pass on the lists of partners that are left of each node; of larger
ones only the nodes are passed on, and their pairs are told again where they are
verified, by whole-matrix comparisons and a matrix product of gram sets.  After
that there are the number of links of each node and its least linked node in the
unit.  All links between different texts are counted, so a group of g near
copies costs g * g / 2 comparisons of a fraction of a microsecond, and nothing
that is written, shuffled or held grows with the pairs.

Cases: null and wordless texts are linked to nothing and copies of nothing;
a text of fewer words than n has one gram, all its words; very long texts are
read whole, in overlapping blocks; a similarity of just the threshold is a link;
repeated rows are copies; copies in words share class and links; further columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivena.llm.batches import bounded
from scrivena.llm.components import connected_components
from scrivena.llm.exact_dedup import one_of_each
from scrivena.llm.words import grams, mix, taken, utf8
from scrivena.plans.staging import stage

GRAM = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
BLOCK = 2048
BLOCK_WORDS = 1 << 21
PAIRS_AT_ONCE = 1 << 18
FEW_PAIRS = 1 << 11  # a unit
DENSE = 16  # a matrix product pays if more than one in so many pairs is left
GRAMS_AT_ONCE = 1 << 11  # columns of a matrix product

_rng = np.random.default_rng(20267)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_FACTOR = _rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(n, m): after n values, fewer than m matches make the threshold too improbable.

    Under a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1), whose
    tail beyond t is the chance that n + 1 draws at t have at most m successes.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def _digests(words, before: int = 0, again: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the sequence of words of each text; those of the blocks of a text are added."""
    counts = words.counts()
    place = (np.arange(len(words.hashes)) - np.repeat(words.first[:-1], counts) + before + 1).astype(np.uint64)
    out = []
    for step in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        each = mix(words.hashes + place * np.uint64(step))
        each[:again] = 0
        sums = np.zeros(len(words.hashes) + 1, np.uint64)
        np.cumsum(each, out=sums[1:])
        out.append(sums[words.first[1:]] - sums[words.first[:-1]])
    return out[0], out[1]


def minima(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash values (texts x HASHES, 32 bits) of the grams of each text; the highest where there is none."""
    some = np.diff(first) > 0
    out = np.full((len(first) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    if some.any():
        starts = first[:-1][some]
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        for k in range(HASHES):
            out[some, k] = np.minimum.reduceat((x ^ _XOR[k]) * _FACTOR[k], starts)
    return out


def signatures(least: np.ndarray) -> np.ndarray:
    """The values in 16 bits."""
    return (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def _describe(n: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            size = batch.num_rows
            n_words, first, second = np.zeros(size, np.int64), np.zeros(size, np.uint64), np.zeros(size, np.uint64)
            least = np.full((size, HASHES), 0xFFFFFFFF, np.uint32)
            for begin, end, words, before, again, _ in taken(data, offsets, n - 1):
                a, b = _digests(words, before, again)
                n_words[begin:end] += words.counts() - again
                first[begin:end] += a
                second[begin:end] += b
                np.minimum(least[begin:end], minima(*grams(words, n, whole_if_shorter=not before)), out=least[begin:end])
            bands = np.ascontiguousarray(signatures(least)).view(np.int64).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * BANDS), pa.array(bands))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("raw"), pa.array(n_words), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), lists],
                ["row", "doc_id", "raw", "n_words", "d1", "d2", "bands"],
            )

    return describe


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of sorted rows that begin and end with a group of ``keys``, with the groups' first rows (and the end)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            held.append(batch.slice(at, most))
            table = pa.Table.from_batches(held)
            new = np.zeros(table.num_rows, bool)
            for key in keys:
                values = table.column(key).to_numpy()
                new[1:] |= values[1:] != values[:-1]
            edges = np.flatnonzero(new)
            if len(edges):
                whole = table.slice(0, int(edges[-1]))
                held = table.slice(int(edges[-1])).to_batches()
                yield whole, np.concatenate([[0], edges])
    if held:
        table = pa.Table.from_batches(held)
        if table.num_rows:
            new = np.zeros(table.num_rows, bool)
            new[0] = True
            for key in keys:
                values = table.column(key).to_numpy()
                new[1:] |= values[1:] != values[:-1]
            yield table, np.concatenate([np.flatnonzero(new), [table.num_rows]])


def _pairs(units: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs to compare in units of few pairs, not too many at once; a unit is the rows of two blocks, or twice the same."""
    left, right, held = [], [], 0
    shapes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for own, other in units:
        if own is other:
            if len(own) not in shapes:
                shapes[len(own)] = np.triu_indices(len(own), 1)
            a, b = (own[x] for x in shapes[len(own)])
        else:
            a, b = np.repeat(own, len(other)), np.tile(other, len(own))
        left.append(a)
        right.append(b)
        held += len(a)
        if held >= PAIRS_AT_ONCE:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def compared(own: np.ndarray, other: np.ndarray, band: int, needed: list[tuple[int, int]], same: bool) -> np.ndarray:
    """Matrix of the pairs of two blocks (nodes x BANDS), or of one with itself, that have their first band in common here and are not dropped."""
    a_of, b_of = np.ascontiguousarray(own.T), np.ascontiguousarray(other.T)
    left = a_of[band][:, None] == b_of[band][None, :]
    for earlier in range(band):
        left &= a_of[earlier][:, None] != b_of[earlier][None, :]
    if same:
        left &= np.triu(np.ones(left.shape, bool), 1)
    mine, theirs = (np.ascontiguousarray(x).view(np.uint16) for x in (own, other))
    if DENSE * left.sum() > left.size:
        mine, theirs = np.ascontiguousarray(mine.T), np.ascontiguousarray(theirs.T)
        equal = np.zeros(left.shape, np.uint8)
        for n, m in needed:
            for k in range(n - STEP, n):
                equal += mine[k][:, None] == theirs[k][None, :]
            left &= equal >= m
        return left
    a, b = np.nonzero(left)
    matches = np.zeros(len(a), np.int32)
    for n, m in needed:
        matches += (mine[a, n - STEP : n] == theirs[b, n - STEP : n]).sum(axis=1, dtype=np.int32)
        keep = matches >= m
        a, b, matches = a[keep], b[keep], matches[keep]
    left[:] = False
    left[a, b] = True
    return left


def _compare(threshold: float, tolerance: float):
    """Units of members -> (unit, band, node, side, partners) of the nodes that have or are partners; partners are null in units of many pairs."""
    needed = least_matches(threshold, tolerance)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_groups(batches, ["band", "key", "lo", "hi"]):
            column = lambda name: table.column(name).to_numpy()
            band, key, lo, hi, block, node = (column(x) for x in ("band", "key", "lo", "hi", "block", "node"))
            bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            values = np.ascontiguousarray(bands).view(np.uint16)
            unit = mix(mix(key.view(np.uint64) ^ mix(band.astype(np.uint64) + np.uint64(1))) + lo.astype(np.uint64) * np.uint64(1 << 32) + hi.astype(np.uint64)).view(np.int64)
            few, lefts, rights, dense = [], [], [], []
            side = np.zeros(len(node), np.int32)
            for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                rows = np.arange(begin, end)
                if lo[begin] == hi[begin]:
                    own = other = rows
                    pairs = len(rows) * (len(rows) - 1) // 2
                else:
                    side[begin:end] = 1 + (block[begin:end] != lo[begin])
                    own, other = rows[side[begin:end] == 1], rows[side[begin:end] == 2]
                    pairs = len(own) * len(other)
                if pairs <= FEW_PAIRS:
                    few.append((own, other))
                    continue
                left = compared(bands[own], bands[other], int(band[begin]), needed, own is other)
                dense.append(np.union1d(own[left.any(axis=1)], other[left.any(axis=0)]))
            for a, b in _pairs(few):
                shared = bands[a] == bands[b]
                ours = shared.argmax(axis=1) == band[a]  # the first band that they share
                a, b = a[ours], b[ours]
                matches = np.zeros(len(a), np.int32)
                for n, m in needed:
                    matches += (values[a, n - STEP : n] == values[b, n - STEP : n]).sum(axis=1, dtype=np.int32)
                    keep = matches >= m
                    a, b, matches = a[keep], b[keep], matches[keep]
                lefts.append(a)
                rights.append(b)
            a = np.concatenate(lefts) if lefts else np.zeros(0, np.int64)
            b = np.concatenate(rights) if rights else np.zeros(0, np.int64)
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            rows = np.union1d(a, b)
            ends = np.searchsorted(a, rows, side="right")
            partners = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(node[b]))
            many = np.concatenate(dense) if dense else np.zeros(0, np.int64)
            for some, lists in ((rows, partners), (many, pa.nulls(len(many), pa.list_(pa.int64())))):
                columns = [pa.array(unit[some]), pa.array(band[some].astype(np.int32)), pa.array(node[some]), pa.array(side[some]), lists]
                yield pa.RecordBatch.from_arrays(columns, ["unit", "band", "node", "side", "partners"])

    return compare


def _gram_sets(n: int):
    """Distinct grams, sorted, of the texts whose words are those of the node they were fetched for."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            d1, d2 = (batch.column(x).to_numpy().view(np.uint64) for x in ("d1", "d2"))
            first = second = np.zeros(0, np.uint64)
            parts: list[list[np.ndarray]] = []
            for begin, end, words, before, again, last in taken(data, offsets, n - 1):
                if not before:
                    first, second, parts = np.zeros(end - begin, np.uint64), np.zeros(end - begin, np.uint64), [[] for _ in range(end - begin)]
                a, b = _digests(words, before, again)
                first, second = first + a, second + b
                hashes, at = grams(words, n, whole_if_shorter=not before)
                for i, part in enumerate(parts):
                    part.append(np.unique(hashes[at[i] : at[i + 1]]))
                if last:
                    same = np.flatnonzero((first == d1[begin:end]) & (second == d2[begin:end]))
                    own = [(parts[i][0] if len(parts[i]) == 1 else np.unique(np.concatenate(parts[i]))).view(np.int64) for i in same]
                    kept = [batch.column(c).slice(begin, end - begin).take(pa.array(same)) for c in ("node", "bands")]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(own, pa.list_(pa.int64()))], ["node", "bands", "grams"])

    return sets


def shared_matrix(own: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many values each of some sets has in common with each of others: products of 0/1 matrices, some columns at a time."""
    sizes = [len(x) for x in (*own, *other)]
    _, place, number = np.unique(np.concatenate([*own, *other]), return_inverse=True, return_counts=True)
    several = number > 1  # the others are in no two sets
    row, place = np.repeat(np.arange(len(sizes)), sizes)[several[place]], (np.cumsum(several) - 1)[place[several[place]]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    out = np.zeros((len(own), len(other)), np.int64)
    columns = int(several.sum())
    for begin in range(0, columns, GRAMS_AT_ONCE):
        a, b = np.searchsorted(place, (begin, begin + GRAMS_AT_ONCE))
        part = np.zeros((len(sizes), min(GRAMS_AT_ONCE, columns - begin)), np.float32)
        part[row[a:b], place[a:b] - begin] = 1
        out += (part[: len(own)] @ part[len(own) :].T).astype(np.int64)
    return out


def _linked(own: np.ndarray, other: np.ndarray, linked: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each of the nodes, and the least node that it is linked to by way of others, from the matrix of two blocks' rows."""
    links = np.zeros(len(nodes), np.int64)
    np.add.at(links, own, linked.sum(axis=1))
    np.add.at(links, other, linked.sum(axis=0))
    root = nodes.copy()
    highest = np.iinfo(np.int64).max
    while True:
        before = root.copy()
        np.minimum.at(root, own, np.where(linked, root[other][None, :], highest).min(axis=1, initial=highest))
        np.minimum.at(root, other, np.where(linked, root[own][:, None], highest).min(axis=0, initial=highest))
        if (root == before).all():
            return links, root


def shared_counts(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted values ``own`` each of the others has."""
    sizes = np.array([len(x) for x in others])
    line = np.concatenate(others)
    found = own[np.minimum(np.searchsorted(own, line), len(own) - 1)] == line
    return np.add.reduceat(found.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))


def _verify(threshold: float, tolerance: float):
    """Units of (band, node, side, partners, bands, grams) -> (node, links, least linked node) by the exact similarity."""
    least = Fraction(str(threshold))
    needed = least_matches(threshold, tolerance)

    def similar(both, a, b):
        return both * least.denominator >= least.numerator * (a + b - both)

    def sparse(nodes: list[int], partners: list[np.ndarray], sets: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
        grams_of = dict(zip(nodes, sets))
        root = {k: k for k in nodes}
        links = dict.fromkeys(nodes, 0)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for me, mine in zip(nodes, partners):
            if not len(mine):
                continue
            mine, own = mine.tolist(), grams_of[me]
            for p, both in zip(mine, shared_counts(own, [grams_of[p] for p in mine]).tolist()):
                if similar(both, len(own), len(grams_of[p])):
                    links[me] += 1
                    links[p] += 1
                    x, y = find(me), find(p)
                    root[max(x, y)] = min(x, y)
        return ((k, number, find(k)) for k, number in links.items() if number)

    def dense(nodes: np.ndarray, side: np.ndarray, band: int, bands: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
        own, other = (np.arange(len(nodes)),) * 2 if not side.any() else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
        left = compared(bands[own], bands[other], band, needed, own is other)
        sizes = np.array([len(x) for x in sets])
        if DENSE * left.sum() > left.size:
            both = shared_matrix([sets[i] for i in own], [sets[i] for i in other])
        else:
            both = np.zeros(left.shape, np.int64)
            for k in np.flatnonzero(left.any(axis=1)):
                mine = np.flatnonzero(left[k])
                both[k, mine] = shared_counts(sets[own[k]], [sets[i] for i in other[mine]])
        links, root = _linked(own, other, left & similar(both, sizes[own][:, None], sizes[other][None, :]), nodes)
        some = np.flatnonzero(links)
        return zip(nodes[some].tolist(), links[some].tolist(), root[some].tolist())

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_groups(batches, ["unit"], most=256):
            node, side, band = (table.column(c).to_numpy() for c in ("node", "side", "band"))
            partners, sets = (table.column(c).combine_chunks() for c in ("partners", "grams"))
            bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            many = partners.is_null().to_numpy(zero_copy_only=False)
            set_at, set_of = sets.offsets.to_numpy(), sets.values.to_numpy().view(np.uint64)
            near_at, near_of = partners.offsets.to_numpy(), partners.values.to_numpy()
            out: list[tuple[int, int, int]] = []
            for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own_sets = [set_of[set_at[i] : set_at[i + 1]] for i in range(begin, end)]
                if many[begin]:
                    out += dense(node[begin:end], side[begin:end], int(band[begin]), bands[begin:end], own_sets)
                else:
                    out += sparse(node[begin:end].tolist(), [near_of[near_at[i] : near_at[i + 1]] for i in range(begin, end)], own_sets)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], ["node", "links", "root"])

    return verify


def near_duplicates(docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id, n_links, n_copies, raw.

    n_links counts the different texts (in words) at or above the threshold, n_copies the rows
    with the same words.  Texts that links connect, and copies, share a class; class_id is the
    least doc_id in it.  raw is xxhash64 of the text as it is, null as empty.
    """
    return _classed(docs, n, threshold, tolerance, block).drop("worded", "class")


def _classed(docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """As ``near_duplicates``, with what tells classes apart that share a class_id: worded, and class (of wordless rows raw)."""
    rows = bounded(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("raw"), "text")
    described = stage(rows.mapInArrow(_describe(n), "row long, doc_id long, raw long, n_words long, d1 long, d2 long, bands array<long>"), "jaccard-described")
    worded = described.filter("n_words > 0")
    # Sums by key are staged before they are joined back, so that a key with very many rows can be split in the join.
    sums = worded.groupBy("d1", "d2", "n_words").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("least_id"))
    copies = stage(sums, "jaccard-copies")
    members = worded.join(copies, ["d1", "d2", "n_words"])
    members = members.withColumn("bands", F.when(F.col("row") == F.col("node"), F.col("bands")))
    wordless = described.filter("n_words = 0").withColumns({"node": F.col("row"), "n_copies": F.lit(1).cast("long"), "least_id": F.col("doc_id"), "bands": F.lit(None).cast("array<long>")})
    members = stage(members.unionByName(wordless), "jaccard-members")

    nodes = members.filter("bands is not null")
    banded = nodes.select("node", "n_words", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"), F.sum("n_words").alias("words")).filter("size > 1")
    blocks = F.least(F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("words") / BLOCK_WORDS)), F.col("size")).cast("int")
    placed = (
        banded.join(buckets, ["band", "key"])
        .select("node", "band", "key", blocks.alias("blocks"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "band", "key", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    )
    unit = ["band", "key", "lo", "hi"]
    # Bands, partners and grams of near copies are alike and small as written, and many times that in memory: no join may broadcast them.
    units = placed.join(nodes.select("node", "bands").hint("merge"), "node").repartition(*unit).sortWithinPartitions(*unit)
    left = stage(units.mapInArrow(_compare(threshold, tolerance), "unit long, band int, node long, side int, partners array<long>"), "jaccard-candidates")

    wanted = left.select("node").distinct().join(nodes.select("node", "doc_id", F.col("raw").alias("wanted_raw"), "d1", "d2", "bands").hint("merge"), "node").withColumnRenamed("doc_id", "wanted_id")
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("raw"), "text")
    fetched = texts.join(wanted.hint("shuffle_hash"), texts.doc_id.eqNullSafe(wanted.wanted_id) & (texts.raw == wanted.wanted_raw)).select("node", "d1", "d2", "bands", "text")
    sets = fetched.mapInArrow(_gram_sets(n), "node long, bands array<long>, grams array<long>").dropDuplicates(["node"])
    verified = left.join(sets.hint("merge"), "node").repartition("unit").sortWithinPartitions("unit")
    links = stage(verified.mapInArrow(_verify(threshold, tolerance), "node long, links long, root long"), "jaccard-links")

    degrees = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = stage(roots.join(degrees, "node").join(nodes.select("node", "least_id"), "node"), "jaccard-linked")
    least = stage(linked.groupBy("root").agg(F.min("least_id").alias("class_id")), "jaccard-least")
    classes = stage(linked.join(least, "root").select("node", "root", "class_id", "n_links"), "jaccard-classes")
    return members.join(classes, "node", "left").select(
        "doc_id",
        F.when(F.col("n_links").isNull(), F.col("least_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "n_copies",
        "raw",
        (F.col("n_words") > 0).alias("worded"),
        F.when(F.col("n_words") == 0, F.col("raw")).otherwise(F.coalesce("root", "node")).alias("class"),
    )


def one_of_each_class(docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose doc_id is the least of their class; one of them where rows repeat it."""
    found = _classed(docs, n, threshold).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
    return one_of_each(docs, found, ["doc_id", "worded", "class"])
