"""Prefix trie of conversations as balanced parentheses.

A conversation is a path of turns.  Equal paths are one row with a count before anything is sorted, so a conversation
that many repeat costs one row for each task.  The distinct paths are range-sorted, which is the depth-first order of
the trie, and each range is a shard: its nodes are written as balanced parentheses over a range min-max tree of excess
blocks.  ``findclose`` delimits a node's subtree, ranks of ``()`` count its leaves, and cumulative arrays over the
preorder give its members and savings.

Shards meet in shared spines: the nodes on a shard's first or last path may continue next door.  Their figures are
added up by key; what more than one shard has counted is taken off again along the small tree of the shared nodes,
which is encoded the same way.  Every other node is final in its shard.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import col, ship_with_tasks, write_table

#: Positions of a block of the range min-max tree, and open parentheses looked up at once.
BLOCK, AT_ONCE = 256, 4096
#: Conversations in a block of one hundred share their beginning; up to five turns of it are taken over.
FAMILY, MOST_SHARED = 100, 6
#: Bytes of conversation ids hashed at once.
PIECE = 1 << 20
NODE_SCHEMA = ("shard int, depth bigint, spine boolean, key binary, parent_key binary, conv_id bigint, parent_conv_id bigint, n_convs bigint, "
               "n_children bigint, n_leaves bigint, all_tokens bigint, once_tokens bigint, leaf bigint, length bigint, path_key binary")


class Parentheses:
    """Balanced parentheses of a tree or forest, given the depths of its nodes in preorder."""

    def __init__(self, depths: np.ndarray):
        n = len(depths)
        self.opens = 2 * np.arange(n) - (depths - (depths[0] if n else 0))
        steps = np.full(2 * n, -1, np.int64)
        steps[self.opens] = 1
        self.excess = np.cumsum(steps)
        leaf = np.zeros(2 * n, np.int64)
        leaf[:-1] = (steps[:-1] == 1) & (steps[1:] == -1)
        self._leaves = np.concatenate([[0], np.cumsum(leaf)])
        blocks = -(-2 * n // BLOCK)
        padded = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        padded[:2 * n] = self.excess
        self._rows = padded.reshape(blocks, BLOCK)
        self._least = [self._rows.min(1)] if n else [np.empty(0, np.int64)]
        while len(self._least[-1]) > 1:
            low = self._least[-1]
            if len(low) % 2:
                low = self._least[-1] = np.append(low, np.iinfo(np.int64).max)
            self._least.append(low.reshape(-1, 2).min(1))

    def findclose(self) -> np.ndarray:
        """Position of the parenthesis that closes each node: the first one beyond it with a smaller excess."""
        return np.concatenate([self._close(self.opens[i:i + AT_ONCE]) for i in range(0, len(self.opens), AT_ONCE)] or [np.empty(0, np.int64)])

    def _close(self, at: np.ndarray) -> np.ndarray:
        want, block = self.excess[at], at // BLOCK
        hit = (self._rows[block] < want[:, None]) & (np.arange(BLOCK) > (at % BLOCK)[:, None])
        out = block * BLOCK + hit.argmax(1)
        left = np.flatnonzero(~hit.any(1))
        if not len(left):
            return out
        # Up the tree until a sibling to the right goes below, then down to its first block that does.
        node, level, found = block[left], np.zeros(len(left), int), np.zeros(len(left), bool)
        for k, low in enumerate(self._least[:-1]):
            going = ~found
            beside = np.minimum(node + 1, len(low) - 1)
            here = going & (node % 2 == 0) & (low[beside] < want[left])
            node = np.where(here, beside, np.where(going, node // 2, node))
            level = np.where(here, k, level)
            found |= here
        for k in range(len(self._least) - 2, 0, -1):
            down = level >= k
            first = self._least[k - 1][np.minimum(2 * node, len(self._least[k - 1]) - 1)] < want[left]
            node = np.where(down, np.where(first, 2 * node, 2 * node + 1), node)
        out[left] = node * BLOCK + (self._rows[node] < want[left][:, None]).argmax(1)
        return out

    def subtrees(self) -> tuple[np.ndarray, np.ndarray]:
        """(preorder index beyond each node's subtree, leaves in it)."""
        closes = self.findclose()
        return np.arange(len(self.opens)) + (closes - self.opens + 1) // 2, self._leaves[closes] - self._leaves[self.opens]


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[:-1]


def _parents(depths: np.ndarray) -> np.ndarray:
    """Preorder index of each node's parent; the root is its own."""
    out, order = np.zeros(len(depths), np.int64), np.argsort(depths, kind="stable")
    cuts = np.searchsorted(depths[order], np.arange(depths.max() + 2))
    for d in range(1, depths.max() + 1):
        above, own = order[cuts[d - 1]:cuts[d]], order[cuts[d]:cuts[d + 1]]
        out[own] = above[np.searchsorted(above, own) - 1]
    return out


def _least_below(values: np.ndarray, depths: np.ndarray, parents: np.ndarray) -> np.ndarray:
    out, order = values.copy(), np.argsort(depths, kind="stable")
    cuts = np.searchsorted(depths[order], np.arange(depths.max() + 2))
    for d in range(depths.max(), 0, -1):
        own = order[cuts[d]:cuts[d + 1]]
        np.minimum.at(out, parents[own], out[own])
    return out


def _prefix_keys(path: np.ndarray) -> list[bytes]:
    """A key of each node on a path, the root first."""
    digest = hashlib.blake2b(digest_size=16)
    keys = [digest.digest()]
    for turn in path:
        digest.update(turn.tobytes())
        keys.append(digest.copy().digest())
    return keys


def _shard(shard: int, turns: np.ndarray, lengths: np.ndarray, n: np.ndarray, low: np.ndarray, keys: pa.Array) -> pa.RecordBatch:
    """The nodes of sorted distinct paths; ``turns`` holds (hash, hash, code points) of all turns in a row."""
    starts = np.cumsum(lengths) - lengths
    path = np.repeat(np.arange(len(lengths)), lengths)
    depth = np.arange(len(turns)) - starts[path] + 1
    before = np.maximum(path - 1, 0)
    twin = starts[before] + depth - 1
    same = (path > 0) & (depth <= lengths[before])
    same[same] &= (turns[twin[same]] == turns[same]).all(1)
    differs = np.concatenate([[0], np.cumsum(~same)])
    new = differs[1:] > differs[starts[path]]
    index = np.cumsum(new)                          # the root is node 0
    depths = np.concatenate([[0], depth[new]])
    size = np.concatenate([[0], turns[new, 2]])
    ends_at = np.where(lengths > 0, np.append(index, 0)[starts + lengths - 1], 0)
    ended, lowest, path_of = np.zeros(len(depths), np.int64), np.full(len(depths), np.iinfo(np.int64).max), np.full(len(depths), -1)
    ended[ends_at], lowest[ends_at], path_of[ends_at] = n, low, np.arange(len(n))
    tree = Parentheses(depths)
    beyond, leaves = tree.subtrees()
    members, parents = _sums(ended, beyond), _parents(depths)
    lowest = _least_below(lowest, depths, parents)
    children = np.bincount(parents[1:], minlength=len(depths))
    # The nodes of the first path come first; those of the last path are the last ones of their depths.
    latest = np.zeros(depths.max() + 1, np.int64)
    latest[depths] = np.arange(len(depths))
    key = dict(enumerate(_prefix_keys(turns[:lengths[0]])))
    key.update(zip(latest.tolist(), _prefix_keys(turns[starts[-1]:starts[-1] + lengths[-1]])))
    spine = np.zeros(len(depths), bool)
    spine[list(key)] = True
    key_of = lambda i: key.get(int(i))
    under = np.flatnonzero(spine[parents])
    under = under[under > 0]
    parent_keys: list = [None] * len(depths)
    for i in under:
        parent_keys[i] = key_of(parents[i])
    columns = [pa.array(np.full(len(depths), shard, np.int32)), pa.array(depths), pa.array(spine), pa.array([key_of(i) for i in range(len(depths))], pa.binary()),
               pa.array(parent_keys, pa.binary()), pa.array(lowest), pa.array(lowest[parents], mask=depths == 0), pa.array(members), pa.array(children), pa.array(leaves),
               pa.array(_sums(members * size, beyond)), pa.array(_sums(size, beyond)), pa.array((children == 0).astype(np.int64)), pa.array(size),
               keys.take(pa.array(path_of, mask=path_of < 0))]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in NODE_SCHEMA.split(", ")])


def _shards(batches):
    """One shard for each task, from its sorted (shard, path, n, low, path_key) rows."""
    rows = [b for b in batches if b.num_rows]
    if rows:
        table = pa.Table.from_batches(rows).combine_chunks()
        paths = table["path"].chunk(0) if table["path"].num_chunks else pa.array([], pa.list_(pa.int64()))
        turns = paths.flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
        lengths = np.diff(paths.offsets.to_numpy()).astype(np.int64) // 3
        made = _shard(table["shard"][0].as_py(), turns, lengths, table["n"].to_numpy(), table["low"].to_numpy(), table["path_key"].combine_chunks())
        for i in range(0, made.num_rows, 1 << 16):
            yield made.slice(i, 1 << 16)


def _corrections(batches):
    """(key, leaves and tokens that the node's subtree has counted too often), from shared nodes sorted by first shard and depth."""
    rows = [b for b in batches if b.num_rows]
    if rows:
        table = pa.Table.from_batches(rows)
        beyond, _ = Parentheses(table["depth"].to_numpy()).subtrees()
        yield pa.RecordBatch.from_arrays([table["key"].combine_chunks(), pa.array(_sums(table["leaf"].to_numpy(), beyond)), pa.array(_sums(table["again"].to_numpy(), beyond))],
                                         ["key", "less_leaves", "less_tokens"])


def conversation_paths(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, path): each conversation's own turns in order, as (hash, hash, code points) in a row.

    Null turns come first, ties in the order of their hashes.  Null role or text counts as empty; rows without an id are no
    conversation.  Texts are hashed before anything is shuffled.
    """
    text = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.length(text(role_col)).cast("string"), F.lit(":"), text(role_col), text(text_col)).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("bigint")
    rows = (df.where(col(conv_col).isNotNull())
            .select(col(conv_col).cast("bigint").alias("conv_id"),
                    F.struct(col(turn_col).alias("turn"), half(1).alias("hi"), half(17).alias("lo"), F.length(text(text_col)).cast("bigint").alias("len")).alias("t")))
    ordered = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.flatten(F.transform(ordered, lambda t: F.array(t["hi"], t["lo"], t["len"]))).alias("path"))


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its hundred: unsigned crc32 of its decimal id, modulo 6."""
    return F.crc32(conv.cast("string").cast("binary")) % MOST_SHARED


def rebuilt_paths(paths: DataFrame) -> DataFrame:
    """Paths whose first turns come from the conversation ``conv_id - conv_id % 100``: that many of its first turns, or all if
    fewer, none if there is no such conversation; then the conversation's own turns after its first as many."""
    first = (paths.where(F.col("conv_id") % FAMILY == 0)
             .select(F.col("conv_id").alias("base"), F.slice("path", 1, 3 * MOST_SHARED).alias("head")))
    rows = paths.withColumns({"base": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": shared_turns(F.col("conv_id")).cast("int") * 3})
    none = F.array().cast("array<bigint>")
    own = F.when(F.size("path") > F.col("h"), F.slice("path", F.col("h") + 1, F.size("path"))).otherwise(none)
    return (rows.join(first, "base", "left")
            .select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), own).alias("path")))


def _hash_ids(batches):
    """Hashes of the id lists of whole groups; those at a task's ends may go on elsewhere and stay open, in pieces."""
    key, ids, size, first, open_, pieces, n = None, [], 0, 0, True, [], 0

    def piece():
        pieces.append((key, n, first, ",".join(map(str, ids)).encode(), None))

    def row(entries):
        k, nth, f, t, d = zip(*entries)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(f, pa.int64()), pa.array(t, pa.binary()), pa.array(d, pa.string())], ["path_key", "first", "ids", "ends"])

    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key or size > PIECE:
                if key is not None:
                    if k != key and not open_ and not n:
                        pieces.append((key, 0, first, None, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
                    else:
                        piece()
                n = n + 1 if k == key else 0
                open_ = key is None or (k == key and open_)
                key, ids, size, first = k, [], 0, c
            ids.append(c)
            size += 20
        if pieces:
            yield row(pieces)
            pieces = []
    if key is not None:
        piece()
        yield row(pieces)


def _join_pieces(batches):
    """Hashes of groups in pieces, sorted by group and first id."""
    key, digest = None, None
    for batch in batches:
        done = []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if k == key:
                digest.update(b"," + text)
            else:
                if digest:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(text)
        if done:
            yield pa.RecordBatch.from_pylist([{"path_key": a, "ends": b} for a, b in done], pa.schema([("path_key", pa.binary()), ("ends", pa.string())]))
    if digest:
        yield pa.RecordBatch.from_pylist([{"path_key": key, "ends": digest.hexdigest()}], pa.schema([("path_key", pa.binary()), ("ends", pa.string())]))


def hashed_members(paths: DataFrame) -> DataFrame:
    """(path_key, ends): SHA-256 of each path's ids, ascending and comma-joined.

    The ids are range-sorted by path and id, so that a path which a third of all conversations share lies in many
    tasks; its pieces of about a megabyte then pass through one hash in turn, since the hash is sequential.
    """
    rows = paths.select("path_key", "conv_id").repartitionByRange("path_key", "conv_id").sortWithinPartitions("path_key", "conv_id")
    found = write_table(rows.mapInArrow(_hash_ids, "path_key binary, first bigint, ids binary, ends string"))
    pieces = found.where("ends is null").select("path_key", "first", "ids").repartition("path_key").sortWithinPartitions("path_key", "first")
    return found.where("ends is not null").select("path_key", "ends").unionAll(pieces.mapInArrow(_join_pieces, "path_key binary, ends string"))


def path_trie(paths: DataFrame) -> DataFrame:
    """The trie of (conv_id, path) rows: one row for each distinct beginning of a path, the empty one included.

    Returns ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.
    """
    bytes_of = F.concat(*[F.hex(F.xxhash64(F.lit(seed), "path")) for seed in (0, 1)])
    paths = write_table(paths.withColumn("path_key", F.unhex(bytes_of)))
    distinct = paths.groupBy("path", "path_key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"))
    sharded = distinct.repartitionByRange("path").sortWithinPartitions("path").select(F.spark_partition_id().alias("shard"), "path", "n", "low", "path_key")
    nodes = write_table(sharded.mapInArrow(_shards, NODE_SCHEMA))

    sums = ["n_convs", "n_children", "n_leaves", "all_tokens", "once_tokens", "leaf"]
    spine = write_table(nodes.where("spine").groupBy("key").agg(
        *[F.sum(c).alias(c) for c in sums], F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("length").alias("length"),
        F.max("path_key").alias("path_key"), F.max("parent_key").alias("parent_key"), F.count(F.lit(1)).alias("shards"), F.min("shard").alias("first")))
    # A node in several shards has children, so it is no leaf, and its text and its place among its parent's children count once.
    shared = spine.where("shards > 1").withColumn("again", (F.col("shards") - 1) * F.col("length"))
    order = shared.select("key", "depth", "leaf", "again", "first").repartition(1).sortWithinPartitions("first", "depth")
    less = order.mapInArrow(_corrections, "key binary, less_leaves bigint, less_tokens bigint")
    twice = shared.groupBy("parent_key").agg(F.sum(F.col("shards") - 1).alias("less_children")).where("parent_key is not null").withColumnRenamed("parent_key", "key")
    none = F.lit(0).cast("bigint")
    whole = write_table(spine.join(less, "key", "left").join(twice, "key", "left").select(
        "key", "parent_key", "conv_id", "depth", "n_convs", (F.col("n_children") - F.coalesce("less_children", none)).alias("n_children"),
        (F.col("n_leaves") - F.coalesce("less_leaves", none)).alias("n_leaves"),
        (F.col("all_tokens") - F.col("once_tokens") + F.coalesce("less_tokens", none)).alias("saved_tokens"), "path_key"))

    named = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    final = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "path_key"]
    inner = nodes.where("not spine").withColumn("saved_tokens", F.col("all_tokens") - F.col("once_tokens"))
    below = (inner.where("parent_key is not null").drop("parent_conv_id").unionByName(whole.drop("key"), allowMissingColumns=True)
             .join(named, "parent_key", "left").withColumn("parent_conv_id", F.col("_parent")).select(*final))
    rows = inner.where("parent_key is null").select(*final).unionByName(below)
    # Where no path ends the key is one of the node's own, which no path has: null keys would all meet in one task.
    own = F.unhex(F.hex(F.xxhash64("conv_id", "depth")))
    ends = rows.withColumn("path_key", F.coalesce("path_key", own)).join(hashed_members(paths), "path_key", "left")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return ends.select(*final[:-1], F.coalesce("ends", empty).alias("ends_sha256"))


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", rebuild: bool = True) -> DataFrame:
    """The trie of all conversations' turn sequences; with ``rebuild`` after their first turns are replaced by the family's.

    A node is a distinct sequence of first turns, the empty one included.  Null role or text counts as empty; null turns come
    first and ties are ordered by content; repeated rows are turns of their own; rows without an id are left out.  Further
    columns are ignored whatever their names.  An empty table has no node.  Very long texts only weigh by their length.
    """
    paths = conversation_paths(df, conv_col, turn_col, role_col, text_col)
    return path_trie(rebuilt_paths(write_table(paths)) if rebuild else paths)


ship_with_tasks(__name__)
