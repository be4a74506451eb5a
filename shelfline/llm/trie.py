"""Conversation prefix trie from padded matrices of turn ids.

Conversations are rows of turn ids.  Spark deals them in lexicographic ranges; a task pads its rows to
matrices, sorts them with ``lexsort`` and ORs the column changes between neighbours along the depth: a change
at or before a column starts a node, and ``reduceat`` over the starts gives every depth its members.  Only nodes
on the first and the last row of a range may go on in other ranges.  These are added up afterwards, with plain
sums: they lie on few rows, and a subtree is a run of such rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.common import WORD, crc32_sql, partitions, stored
from shelfline.llm.graph import group_starts

#: Turns a range aims at, and the columns of one padded matrix.
TURNS, WIDTH = 1 << 18, 16
#: Ids of one piece of a list that goes on in other ranges.
PIECE = 1 << 16
EMPTY = hashlib.sha256(b"").hexdigest()
_MEASURES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
_SHARD = ", ".join([f"{c} long" for c in _MEASURES] + ["ends_sha256 string", "shard long", "key binary", "parent_key binary", "words long", "low long", "high long", "piece long", "ids binary"])


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns`` of the conversations with the beginnings of others.

    Conversation ``c`` starts with the first ``crc32(c) % 4`` turns of ``c - c % 20``, and goes on with its own
    turns after as many.  Turns are hashes of role and text (128 bits) and the words of the text; they are in
    the order of ``turn``, nulls first, equal ones by their hashes.  Null roles and texts are empty, rows without
    an id take no part, ``%`` has the sign of the id, repeated rows are turns of their own, texts are read whole
    and further columns are ignored.  The hashes of a single conversation meet in one task, 32 bytes a turn.
    """
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    own = F.struct(
        conversations["turn"].cast("long").alias("turn"),
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit(1), text, role).alias("b"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    ident = conversations["conv_id"].cast("long")
    rows = conversations.where(ident.isNotNull()).select((ident - ident % 20).alias("base"), ident.alias("conv_id"), own.alias("own"))
    # conversations of one base share a partition: the lists and the window need no further shuffle
    lists = rows.repartition("base").groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("own")).alias("own"))
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, 3))).over(Window.partitionBy("base"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4)).cast("int")
    rest = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    both = lists.withColumn("head", head).select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), h), F.slice("own", 1, 0)), rest).alias("turns"))
    return both.select("conv_id", F.transform("turns", lambda t: t.dropFields("turn")).alias("turns"))


# -- one range ----------------------------------------------------------------


class _Rows:
    """Conversations of a range: turn codes and words row by row, sorted once with ``sort``."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        turns = table["turns"].combine_chunks() if isinstance(table["turns"], pa.ChunkedArray) else table["turns"]
        turns = turns.chunk(0) if isinstance(turns, pa.ChunkedArray) else turns
        flat = turns.flatten()
        self.ids = table["conv_id"].to_numpy()
        self.length = np.diff(turns.offsets.to_numpy())
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64)
        self.a, self.b, self.words = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        # codes from 1 in the order of the hashes, so that a range sorts as Spark dealt it; 0 is padding
        order = np.lexsort((self.b, self.a))
        new = np.zeros(len(order), np.int64)
        new[group_starts([self.a[order], self.b[order]]) if len(order) else []] = 1
        self.code = np.zeros(len(order), np.int64)
        self.code[order] = np.cumsum(new)

    def matrix(self, values: np.ndarray, rows: np.ndarray, first: int) -> np.ndarray:
        """Columns ``first`` to ``first + WIDTH`` of rows longer than ``first``, padded with 0."""
        at = first + np.arange(min(WIDTH, int(self.length[rows].max()) - first))
        place = self.start[rows][:, None] + at
        inside = at < self.length[rows][:, None]
        return np.where(inside, values[np.where(inside, place, 0)], 0)

    def sort(self) -> np.ndarray:
        """Rows by their turns, then by id: matrices from the last columns to the first, in stable steps."""
        order = np.argsort(self.ids, kind="stable")
        for first in range((int(self.length.max()) - 1) // WIDTH * WIDTH, -1, -WIDTH):
            longer = self.length[order] > first
            some = order[longer]
            columns = self.matrix(self.code, some, first)
            order = np.concatenate([order[~longer], some[np.lexsort(columns.T[::-1])]])
        return order


def _range_nodes(batches: list[pa.RecordBatch], shard: int) -> Iterator[pa.RecordBatch]:
    """The nodes of one range: finished ones, and parts of those on its first or last row."""
    rows = _Rows(batches)
    order = rows.sort()
    n, deepest = len(order), int(rows.length.max())
    ids, length = rows.ids[order], rows.length[order]
    # per depth: where nodes start, their members, least id, parent (place among the nodes of the depth before)
    level = [{"start": np.zeros(1, np.int64), "n": np.array([n]), "least": ids.min(keepdims=True), "parent": np.zeros(1, np.int64), "words": np.zeros(1, np.int64), "stop": np.array([n])}]
    alive, node, changed = np.arange(n), np.zeros(n, np.int64), np.concatenate([[True], np.zeros(n - 1, bool)])
    for first in range(0, deepest, WIDTH):
        keep = np.flatnonzero(length[alive] > first)
        # a change at a row that has ended counts for the next row that goes on
        changed = np.logical_or.reduceat(changed[: keep[-1] + 1], np.concatenate([[0], keep[:-1] + 1]))
        alive, node = alive[keep], node[keep]
        columns, words = rows.matrix(rows.code, order[alive], first), rows.matrix(rows.words, order[alive], first)
        differs = np.empty(columns.shape, bool)
        differs[0], differs[1:] = True, columns[1:] != columns[:-1]
        differs[:, 0] |= changed
        differs = np.logical_or.accumulate(differs, axis=1)
        for d in range(columns.shape[1]):
            starts = np.flatnonzero(differs[:, d])
            is_node = columns[starts, d] != 0
            members, least = np.add.reduceat(np.ones(len(alive), np.int64), starts), np.minimum.reduceat(ids[alive], starts)
            begins = starts[is_node]
            level.append(
                {
                    "start": alive[begins],
                    "n": members[is_node],
                    "least": least[is_node],
                    "parent": node[begins],
                    "words": words[begins, d],
                    "stop": alive[begins + members[is_node] - 1] + 1,
                }
            )
            number = np.cumsum(is_node) - 1
            node = np.repeat(number, members)
        changed = differs[:, -1]
    for here in level:
        here["first"], here["last"] = here["start"] == 0, here["stop"] == n
        here["open"] = here["first"] | here["last"]
    # from below: children, leaves and saved tokens of whole subtrees; open nodes hold what closed children add
    for d in range(deepest, -1, -1):
        here = level[d]
        size = len(here["n"])
        below = level[d + 1] if d < deepest else None
        shut = ~below["open"] if below else None
        here["children"] = np.bincount(below["parent"][shut], minlength=size) if below else np.zeros(size, np.int64)
        any_child = np.bincount(below["parent"], minlength=size) if below else np.zeros(size, np.int64)
        here["leaves"], here["saved"] = (any_child == 0).astype(np.int64), (here["n"] - 1) * here["words"]
        here["leaves"][here["open"]] = here["saved"][here["open"]] = 0
        if below:
            np.add.at(here["leaves"], below["parent"][shut], below["leaves"][shut])
            np.add.at(here["saved"], below["parent"][shut], below["saved"][shut])
    keys = [_beginnings(rows, order[place]) for place in (0, n - 1)]
    for d, here in enumerate(level):
        size = len(here["n"])
        ending = np.flatnonzero(length == d)
        ended = ids[ending]
        low, high = np.searchsorted(ending, here["start"]), np.searchsorted(ending, here["stop"])
        hashes = np.full(size, EMPTY, object)
        for i in np.flatnonzero((high > low) & ~here["open"]).tolist():
            hashes[i] = hashlib.sha256(_listed(ended[low[i] : high[i]])).hexdigest()
        key, parent_key = np.full(size, None, object), np.full(size, None, object)
        for i in np.flatnonzero(here["open"]).tolist():
            key[i] = keys[0 if here["first"][i] else 1][d]
        parent = pa.nulls(size, pa.int64())
        if d:
            above = level[d - 1]
            of_open = above["open"][here["parent"]]
            parent = pa.array(above["least"][here["parent"]], mask=of_open)
            for side, at in enumerate(("first", "last")):  # a node on both has one name
                inside = above[at][here["parent"]]
                if inside.any():
                    parent_key[inside] = keys[side][d - 1]
        yield _batch(
            size,
            conv_id=here["least"],
            depth=np.full(size, d),
            parent_conv_id=parent,
            n_convs=here["n"],
            n_children=here["children"],
            n_leaves=here["leaves"],
            saved_tokens=here["saved"],
            ends_sha256=hashes,
            shard=np.full(size, shard),
            key=key,
            parent_key=parent_key,
            words=here["words"],
            low=2 * shard + ~here["first"],
            high=2 * shard + here["last"],
        )
        for i in np.flatnonzero((high > low) & here["open"]).tolist():
            for piece, at in enumerate(range(int(low[i]), int(high[i]), PIECE)):
                yield _batch(1, shard=[shard], key=[key[i]], piece=[piece], ids=[_listed(ended[at : min(at + PIECE, int(high[i]))])])


def _listed(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def _batch(size: int, **columns) -> pa.RecordBatch:
    """A record batch of the columns of a range, null where none is given."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [(name, kinds[kind]) for name, kind in (c.split() for c in _SHARD.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kind) if name in columns else pa.nulls(size, kind) for name, kind in fields], names=[f[0] for f in fields])


def _beginnings(rows: _Rows, row: int) -> list[bytes]:
    """128-bit names of all beginnings of a row, the empty one first."""
    said = hashlib.blake2b(digest_size=16)
    names = [said.digest()]
    for at in range(int(rows.start[row]), int(rows.start[row] + rows.length[row])):
        said.update(rows.a[at].tobytes() + rows.b[at].tobytes())
        names.append(said.digest())
    return names


# -- all ranges ---------------------------------------------------------------


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie of ``conv_id, turns`` (from ``rebuilt``, or arrays of structs ``a, b, words``).

    Returns ``conv_id`` (least member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256`` for every node.  Conversations without turns end at the root;
    equal ones share all nodes; an empty table has no nodes.  A range holds about 262,144 turns, 24 bytes each, whatever
    its groups: equal conversations are dealt by their ids.  A single conversation is held whole.
    """
    sequences = stored(sequences.select("conv_id", "turns"), "turns")
    turns = sequences.agg(F.coalesce(F.sum(F.size("turns")), F.lit(0)).alias("n")).first()["n"]
    ranges = max(partitions(sequences.sparkSession), turns // TURNS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _together(_range_nodes(held, TaskContext.get().partitionId()))

    path = F.transform("turns", lambda t: F.struct(t["a"], t["b"]))
    # written, as the borders of the ranges are sampled and all that follows has to see the same ones
    out = stored(sequences.repartitionByRange(ranges, path, F.col("conv_id")).mapInArrow(run, _SHARD), "trie")
    closed = out.where("key is null")
    parts, pieces = out.where("key is not null and piece is null"), out.where("piece is not null")
    opened = _opened(parts, pieces)
    owners = parts.select("shard", F.col("key").alias("parent_key")).distinct()
    owners = owners.join(opened.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("owner")), "parent_key")
    # by range as well: the children of one node are spread like the ranges
    below_open = closed.where("parent_key is not null").join(owners, ["shard", "parent_key"]).withColumn("parent_conv_id", F.col("owner"))
    columns = [*_MEASURES, "ends_sha256"]
    return closed.where("parent_key is null").select(*columns).unionByName(below_open.select(*columns)).unionByName(opened.select(*columns))


def _together(batches: Iterator[pa.RecordBatch], rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Batches of about ``rows`` rows: every depth makes one, and deep ranges many small ones."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held[-64:]) >= rows or len(held) >= 64:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _opened(parts: DataFrame, pieces: DataFrame) -> DataFrame:
    """The nodes on first and last rows of ranges, with ``key``.

    Let the first and the last row of every range be the borders, in order.  A node is the beginning of a run
    of borders, ``low`` to ``high``; the open nodes below it are the deeper ones with the same ``low`` and all that
    begin later in its run.  So a subtree is a running sum over borders and one over the depths of a border.
    """
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    same = [F.max(c).alias(c) for c in ("depth", "parent_key", "words", "high")]
    nodes = parts.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("low").alias("low"), *same, *sums)
    nodes = stored(nodes, "trie-borders")
    children = nodes.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("more"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    nodes = nodes.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long"))
    nodes = nodes.withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words"))

    added = ("n_leaves", "saved_tokens")
    deeper = Window.partitionBy("low").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    # two rows a range
    begun = nodes.groupBy(F.col("low").alias("border")).agg(*[F.sum(c).alias(c) for c in added])
    borders = parts.select(F.explode(F.array(F.col("shard") * 2, F.col("shard") * 2 + 1)).alias("border")).distinct().join(begun, "border", "left")
    so_far = Window.orderBy("border").rowsBetween(Window.unboundedPreceding, 0)
    borders = borders.select("border", *[F.sum(F.coalesce(c, F.lit(0))).over(so_far).alias(c) for c in added])
    nodes = nodes.select(*[c for c in nodes.columns if c not in added], *[F.sum(c).over(deeper).alias(c) for c in added])
    for end, sign in (("low", -1), ("high", 1)):
        at = borders.select(F.col("border").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in added])
        nodes = nodes.join(at, end).select(*nodes.columns, *[f"{c}_{end}" for c in added])
        for c in added:
            nodes = nodes.withColumn(c, F.col(c) + sign * F.col(f"{c}_{end}")).drop(f"{c}_{end}")

    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    sorted_pieces = pieces.select("key", "shard", "piece", "ids").repartition("key").sortWithinPartitions("key", "shard", "piece")
    ends = sorted_pieces.mapInArrow(_hashed, "key binary, ends_sha256 string")
    nodes = nodes.join(parents, "parent_key", "left").join(ends, "key", "left")
    return nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of the joined pieces of every key, a piece at a time."""
    key, said = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": [said.hexdigest()]})

    for batch in batches:
        for at in range(batch.num_rows):
            now, ids = batch.column(0)[at].as_py(), batch.column(3)[at].as_py()
            if now != key:
                if key is not None:
                    yield done()
                key, said = now, hashlib.sha256(ids)
            else:
                said.update(b"," + ids)
    if key is not None:
        yield done()


def oracle() -> str:
    """The SQL twin: a node is a beginning of some conversation, and counts for all beginnings of its own."""
    return rf"""
with t as (
  select conv_id, coalesce(role, '') as r, coalesce(text, '') as x,
         row_number() over (partition by conv_id order by turn nulls first) - 1 as p
  from conversations where conv_id is not null
), c as (select conv_id, {crc32_sql("conv_id::varchar")} % 4 as h from (select distinct conv_id from t)),
b as (
  select c.conv_id, 0 as own, t.p, t.r, t.x from c join t on t.conv_id = c.conv_id - c.conv_id % 20 and t.p < c.h
  union all select c.conv_id, 1, t.p, t.r, t.x from c join t on t.conv_id = c.conv_id and t.p >= c.h
), n as (select *, row_number() over (partition by conv_id order by own, p) as d from b),
prefix as (
  select conv_id, d, string_agg(md5(r) || md5(x), '') over (partition by conv_id order by d rows unbounded preceding) as k,
         len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))::bigint as words from n
  union all select conv_id, 0, '', 0 from c
), whole as (select *, max(d) over (partition by conv_id) as size from prefix),
node as (
  select d, k, min(conv_id) as conv_id, count(*) as n, any_value(words) as words,
         coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where d = size), '') as ends
  from whole group by d, k
), up as (
  select node.*, parent.conv_id as parent from node
  left join prefix on prefix.conv_id = node.conv_id and prefix.d = node.d - 1
  left join node as parent on parent.d = prefix.d and parent.k = prefix.k
), kids as (select u.d, u.k, count(v.k) as children from up as u left join up as v on v.d = u.d + 1 and v.parent = u.conv_id
            and starts_with(v.k, u.k) group by u.d, u.k),
own as (select up.*, children, (children = 0)::bigint as leaf, (n - 1) * words as saved from up join kids using (d, k)),
subtree as (
  select prefix.d, prefix.k, sum(leaf)::bigint as leaves, sum(saved)::bigint as saved
  from own join prefix on prefix.conv_id = own.conv_id and prefix.d <= own.d group by prefix.d, prefix.k
)
select own.conv_id, own.d::bigint as depth, own.parent as parent_conv_id, own.n as n_convs, own.children as n_children,
       subtree.leaves as n_leaves, subtree.saved as saved_tokens, sha256(own.ends) as ends_sha256
from own join subtree using (d, k)
"""
