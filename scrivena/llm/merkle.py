"""Merkle manifest of a corpus: a digest of every document, a root for all, and a proof for each.

Leaves are dealt, in order, to partitions that are whole subtrees (``fanout ** depth`` leaves of one
source).  Each partition hashes its own subtree.  Then the partitions exchange like a butterfly: in
every round the ``fanout`` partitions of an aligned group swap the roots that they have, and each of
them hashes the same parent, with its own siblings noted on the way.  After as many rounds as the
tree has levels, every partition knows the root and all the upper part of its leaves' proofs, and
nothing is handed down the tree.  The same rounds then go over the roots of the sources.  A round
shuffles a row for each partition, and of each subtree one partition alone sends its root.

Leaves get their places by a range partitioning and counts of partitions, so neither a source with
very many documents nor the whole table is sorted in one task.

Cases: nulls are hashed as ``-`` and so differ from empty texts; a null doc_id stands before all
others, the null source before the empty one; rows that repeat a doc_id are leaves of their own, in
the order of their digests; a source of one document has its leaf as root; of a very long text only the
digest leaves the task that reads it; an empty table gives no rows; further columns of ``docs`` are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scrivena.llm.exact_dedup import LOWERED, UPPER
from scrivena.plans.staging import stage

FANOUT = 16
#: A partition's subtree has FANOUT ** DEPTH leaves.
DEPTH = 3

PATH = "array<struct<before: string, after: string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    """Digest of a row of documents with ``text`` as its text."""
    return F.sha2(F.concat(*(field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), field(text)), 256)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` in the order of the columns ``order`` (no two rows equal in all), with number: 0, 1, 2, ...

    What a partition's numbers start from is summed over one row for each partition.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = stage(dealt.select("*", F.shiftright("_at", 33).alias("_part")), name)
    sums = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    starts = sums.select("_part", before.alias("_before"))
    return dealt.join(F.broadcast(starts), "_part").select(*rows.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("number"))


def joined_hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels_of(leaves: list[str], fanout: int, depth: int | None) -> list[list[str]]:
    """The levels over ``leaves``: ``depth`` of them, or if that is None as many as lead to one node."""
    levels = [leaves]
    while len(levels[-1]) > 1 if depth is None else len(levels) <= depth:
        below = levels[-1]
        levels.append([joined_hash(below[k : k + fanout]) for k in range(0, len(below), fanout)])
    return levels


def paths_of(levels: list[list[str]], fanout: int) -> list[list[tuple[str, str]]]:
    """For each leaf, level by level, what stands before and after its node in the node's run."""
    paths: list[list[tuple[str, str]]] = [[] for _ in levels[0]]
    size = 1
    for nodes in levels[:-1]:
        for at in range(len(nodes)):
            first = at - at % fanout
            beside = "".join(nodes[first:at]), "".join(nodes[at + 1 : first + fanout])
            for path in paths[at * size : (at + 1) * size]:
                path.append(beside)
        size *= fanout
    return paths


def _own_levels(leaves: pa.Table, fanout: int, depth: int) -> tuple[pa.Table, list[list[str]]]:
    """A partition's rows in order and its levels; the tree of a source that fits in one partition ends at one node."""
    leaves = leaves.sort_by("at")
    alone = leaves.column("blocks")[0].as_py() == 1
    return leaves, levels_of(leaves.column("leaf").to_pylist(), fanout, None if alone else depth)


def _local_root(fanout: int, depth: int) -> Callable[[pa.Table], pa.Table]:
    def local_root(leaves: pa.Table) -> pa.Table:
        leaves, levels = _own_levels(leaves, fanout, depth)
        return leaves.slice(0, 1).select(["s", "block", "blocks"]).append_column("digest", pa.array(levels[-1]))

    return local_root


def _with_paths(fanout: int, depth: int, columns: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def with_paths(leaves: pa.Table, partition: pa.Table) -> pa.Table:
        """The rows of a partition with the path of each: its own part, then what the exchange has brought."""
        leaves, levels = _own_levels(leaves, fanout, depth)
        upper = [(p["before"], p["after"]) for p in partition.column("path")[0].as_py()]
        paths = [[*own, *upper] for own in paths_of(levels, fanout)]
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        paths = pa.array([[{"before": b, "after": a} for b, a in path] for path in paths], kind)
        roots = [pa.array(partition.column(c).to_pylist() * leaves.num_rows, pa.string()) for c in ("subroot", "root")]
        return pa.table([*(leaves.column(c) for c in columns), *roots, paths], [*columns, "subroot", "root", "path"])

    return with_paths


def exchanged(partitions: DataFrame, fanout: int) -> DataFrame:
    """One round: each partition gets the roots of its group, hashes their parent and notes its siblings.

    ``partitions`` has tree, node (the number of its root in the tree's level), width (nodes of that
    level), digest, sends (whether it speaks for its node) and path.  A tree of one node is finished.
    """
    up = F.floor(F.col("node") / fanout).alias("up")
    some = partitions.filter("width > 1").withColumn("up", up)
    run = F.array_sort(F.collect_list(F.struct("node", "digest")))  # ``fanout`` at most
    runs = some.filter("sends").groupBy("tree", "up").agg(F.transform(run, lambda x: x["digest"]).alias("run"))
    at = F.pmod("node", F.lit(fanout)).cast("int")
    beside = F.struct(F.array_join(F.slice("run", 1, at), "").alias("before"), F.array_join(F.slice("run", at + 2, fanout), "").alias("after"))
    after = some.join(runs, ["tree", "up"]).withColumns(
        {
            "path": F.concat("path", F.array(beside)),
            "digest": F.sha2(F.array_join("run", ""), 256),
            "sends": F.col("sends") & (at == 0),
            "node": F.col("up"),
            "width": F.ceil(F.col("width") / fanout),
        }
    )
    return partitions.filter("width <= 1").unionByName(after.select(partitions.columns))


def butterfly(partitions: DataFrame, fanout: int) -> DataFrame:
    """``partitions`` after as many rounds as its widest tree has levels."""
    width = partitions.agg(F.max("width")).first()[0] or 1
    while width > 1:
        partitions = stage(exchanged(partitions, fanout), "merkle-round")
        width = -(-width // fanout)
    return partitions


def leaves(docs: DataFrame, **also: Column) -> DataFrame:
    """(doc_id, source, leaf) of each row of ``docs``, and further columns by name."""
    return docs.select("doc_id", "source", leaf(F.col("text")).alias("leaf"), *(c.alias(name) for name, c in also.items()))


def manifest(rows: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """The columns of ``rows`` (doc_id, source, leaf and any others), with subroot, root and path.

    Per source leaves ascend by doc_id, and runs of ``fanout`` nodes become one until one is left,
    its subroot; subroots in the order of their sources become the root likewise.  path has for each
    level the digests before and after the leaf's node in its run, up to the root.
    """
    size = fanout**depth
    columns = rows.columns
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    ordered = numbered(rows, ["source", "doc_id", "leaf", "row"], "merkle-ordered")
    sources = stage(ordered.groupBy("source").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")), "merkle-sources")
    n_sources = sources.count()
    sources = numbered(sources, ["source"], "merkle-source-numbers").select(F.col("source").alias("_source"), "first", "n", F.col("number").alias("s"))
    at = F.col("number") - F.col("first")
    placed = ordered.join(sources, F.col("source").eqNullSafe(F.col("_source"))).select(
        *columns, "s", at.alias("at"), F.floor(at / size).alias("block"), F.ceil(F.col("n") / size).alias("blocks")
    )
    placed = stage(placed, "merkle-placed")

    roots = placed.select("s", "block", "blocks", "at", "leaf").groupBy("s", "block").applyInArrow(_local_root(fanout, depth), "s long, block long, blocks long, digest string")
    start = roots.select("s", "block", F.col("s").alias("tree"), F.col("block").alias("node"), F.col("blocks").alias("width"), "digest", F.lit(True).alias("sends"), F.array().cast(PATH).alias("path"))
    within = butterfly(stage(start, "merkle-roots"), fanout)
    over = within.withColumns({"subroot": F.col("digest"), "tree": F.lit(0).cast("long"), "node": F.col("s"), "width": F.lit(n_sources).cast("long"), "sends": F.col("block") == 0})
    over = butterfly(over, fanout).select("s", "block", "subroot", F.col("digest").alias("root"), "path")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in columns)
    return placed.groupBy("s", "block").cogroup(over.groupBy("s", "block")).applyInArrow(_with_paths(fanout, depth, columns), f"{schema}, subroot string, root string, path {PATH}")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to along its path."""
    return F.aggregate(path, digest, lambda d, p: F.sha2(F.concat(p["before"], d, p["after"]), 256))


def audited(docs: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): each proof held against a copy of ``docs``.

    In the copy the texts of the doc_ids whose crc32 5 divides are lower-cased; their proofs must fail,
    unless they have no capital.
    """
    touched = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    seen = F.when(touched, leaf(F.translate("text", UPPER, LOWERED)))
    found = manifest(leaves(docs, seen=seen), fanout, depth)
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["before"], p["after"])), "")
    found = found.withColumn("folded_root", folded(F.coalesce("seen", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELDS = "||".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
_SEEN = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT = "coalesce(strlen({0})::varchar || ':' || {0}, '-')"
ORACLE_SQL = f"""
with recursive crc_bits(i, k, v) as (
  select i, 0, i from range(256) t(i)
  union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end from crc_bits where k < 8
),
crc as materialized (select list(v order by i) as t from crc_bits where k = 8),
docs as materialized (
  select doc_id, source, sha256({_FIELDS} || {_TEXT.format("text")}) as leaf, sha256({_FIELDS} || {_TEXT.format(_SEEN)}) as other,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
                         lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1])), 4294967295::bigint) % 5 = 0 as touched
  from documents, crc
),
leaves as materialized (
  select doc_id, leaf, case when touched then other else leaf end as seen,
         dense_rank() over (order by source nulls first) - 1 as tree, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx
  from docs
),
nodes(tree, level, idx, d) as (
  select tree, 0, idx, leaf from leaves
  union all
  select tree, level + 1, idx // 16, sha256(string_agg(d, '' order by idx)) from (select *, count(*) over (partition by tree) as m from nodes) where m > 1 group by tree, level, idx // 16
),
subroots as materialized (select tree, arg_max(d, level) as d, max(level) as height from nodes group by tree),
tops(level, idx, d) as (
  select 0, tree, d from subroots
  union all
  select level + 1, idx // 16, sha256(string_agg(d, '' order by idx)) from (select *, count(*) over () as m from tops) where m > 1 group by level, idx // 16
),
every as materialized (
  select tree, level, idx, d, 0 as upper from nodes union all select null, level, idx, d, 1 from tops
),
steps as materialized (
  select l.tree, l.idx, upper, level,
         coalesce(string_agg(e.d, '' order by e.idx) filter (e.idx < l.idx // (16 ** level)::bigint), '') as before,
         coalesce(string_agg(e.d, '' order by e.idx) filter (e.idx > l.idx // (16 ** level)::bigint), '') as after
  from leaves l join every e on upper = 0 and e.tree = l.tree and e.idx // 16 = l.idx // (16 ** (level + 1))::bigint
  join subroots s on s.tree = l.tree and level < height
  group by all
  union all
  select l.tree, l.idx, upper, level,
         coalesce(string_agg(e.d, '' order by e.idx) filter (e.idx < l.tree // (16 ** level)::bigint), ''),
         coalesce(string_agg(e.d, '' order by e.idx) filter (e.idx > l.tree // (16 ** level)::bigint), '')
  from leaves l join every e on upper = 1 and level < (select max(level) from tops) and e.idx // 16 = l.tree // (16 ** (level + 1))::bigint
  group by all
),
ranked as materialized (select *, row_number() over (partition by tree, idx order by upper, level) as k from steps),
proofs as (select tree, idx, sha256(string_agg(before || after, '' order by k)) as proof_sha256 from ranked group by tree, idx),
fold(tree, idx, k, d) as (
  select tree, idx, 0::bigint, seen from leaves
  union all select f.tree, f.idx, f.k + 1, sha256(before || d || after) from fold f join ranked r on r.tree = f.tree and r.idx = f.idx and r.k = f.k + 1
),
ends as (select tree, idx, arg_max(d, k) as folded_root from fold group by tree, idx),
root as (select arg_max(d, level) as root from tops)
select doc_id, leaf, s.d as subroot, root, coalesce(proof_sha256, sha256('')) as proof_sha256, folded_root, folded_root = root as verified
from leaves l join subroots s using (tree) join ends using (tree, idx) left join proofs using (tree, idx), root
"""
