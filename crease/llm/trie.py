"""Prefix trie of conversations by ternary search trees, one per range shard.

A conversation is a sequence of turns; a turn is known by 128 bits of a hash of its role and text, so texts are read once
and never shuffled.  Sequences are sorted as a whole and dealt by range of (sequence, id), so conversations that begin
alike are neighbours, and a group of equal ones, however large, is spread over as many tasks as its share asks for.

A task cuts its sorted sequences into shards of at most ``SHARD_TURNS`` turns.  In each, the turns are written as numbers
of the shard's own sorted dictionary, and the distinct sequences are inserted into a ternary search tree, the median first
and then the medians of both halves, which keeps the binary trees between siblings balanced.  An iterative traversal
sums up members, leaves and savings from below.

Nodes on the paths of a shard's first and last sequence may have members in other shards too: *boundary nodes*, all others
are finished in their shard.  Boundary nodes are merged by the chained hash of their path: members add up, and only
then is it known which of them are leaves and what they save.  The first shard that has such a node adds this to all nodes
above it, all of which lie on that shard's two paths.  So the merge is two aggregates over as many rows as
the shards' first and last sequences have turns.

Ids of equal conversations are hashed in their order as they come by; groups that touch the end of a task, or are long, are
passed on in pieces of ``CHUNK_IDS`` ids, and one stream per group hashes these.

Defined cases: rows with a null ``conv_id`` belong to no conversation; null roles and texts are empty; null turns come
first; rows with equal turns are ordered by role, then by the hash of the text, and all of them are kept; an
empty table gives no rows; a conversation without turns ends at the root; extra columns are not read, whatever
their names.  One conversation is a unit of work (20 bytes a turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import map_batches, materialise, small_enough

#: Turns of a shard: bounds what a task holds.
SHARD_TURNS = 100_000
#: Ids of one piece of a long list of ids, and ids that a task holds back of a group before it gives out pieces.
CHUNK_IDS, HELD_IDS = 512, 200_000

#: Bytes of a turn in a path: 16 of its hash, 4 of its text's length.
KEY, ENTRY = 16, 20
ROOT = bytes(KEY)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def short_hash(column: Column) -> Column:
    return F.substring(F.sha2(column, 256), 1, 2 * KEY)


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order, as an array of hexadecimal path entries."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    # the role's length first, so that no two turns are written alike
    key = short_hash(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)).cast("binary"))
    entry = F.concat(key, F.lpad(F.hex(F.octet_length(text)), 2 * (ENTRY - KEY), "0"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), role.alias("role"),
                                                                 entry.alias("entry")).alias("row"))
    return rows.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list("row")), lambda row: row["entry"]).alias("turns"))


class _Shard:
    """A ternary search tree over sorted distinct sequences, and the sums over its nodes.

    Node 0 is the root without a text.  ``below`` leads from a node to the tree of its children, ``less`` and ``more`` to
    siblings.
    """

    def __init__(self, paths: list[bytes], counts: list[int], firsts: list[int]):
        flat = np.frombuffer(b"".join(paths), np.uint8).reshape(-1, ENTRY)
        keys = np.ascontiguousarray(flat[:, :KEY]).view([("a", ">u8"), ("b", ">u8")]).ravel()
        dictionary, codes = np.unique(keys, return_inverse=True)
        lengths = np.zeros(len(dictionary), np.int64)
        lengths[codes] = np.ascontiguousarray(flat[:, KEY:]).view(">u4").ravel()
        self.turn_key, self.turn_size = dictionary, lengths.tolist()
        ends = np.cumsum([0, *(len(path) // ENTRY for path in paths)]).tolist()
        codes = codes.tolist()
        self.code, self.less, self.more, self.below, self.parent, self.depth = [-1], [-1], [-1], [-1], [-1], [0]
        self.members, self.least = [0], [min(firsts)]
        self.end_of: dict[int, int] = {}  # node -> the sequence that ends there
        self.node_of = [0] * len(paths)
        waiting = [(0, len(paths))]
        while waiting:
            low, high = waiting.pop()
            if low < high:
                middle = (low + high) // 2
                self._insert(middle, codes[ends[middle]:ends[middle + 1]], counts[middle], firsts[middle])
                waiting += [(low, middle), (middle + 1, high)]

    def _insert(self, sequence: int, codes: list[int], count: int, first: int) -> None:
        code_of, less, more, below, members, least = (self.code, self.less, self.more, self.below, self.members,
                                                      self.least)
        members[0] += count
        node = 0
        for code in codes:
            links, at = below, node
            found = links[at]
            while found >= 0 and code_of[found] != code:
                links, at = (less if code < code_of[found] else more), found
                found = links[at]
            if found < 0:
                found = links[at] = len(code_of)
                for column, value in ((code_of, code), (less, -1), (more, -1), (below, -1), (self.parent, node),
                                      (self.depth, self.depth[node] + 1), (members, 0), (least, first)):
                    column.append(value)
            members[found] += count
            least[found] = min(least[found], first)
            node = found
        self.end_of[node] = sequence
        self.node_of[sequence] = node

    def path(self, sequence: int) -> list[int]:
        """The nodes of a sequence from the root down."""
        nodes = [self.node_of[sequence]]
        while nodes[-1]:
            nodes.append(self.parent[nodes[-1]])
        return nodes[::-1]

    def size(self, node: int) -> int:
        return self.turn_size[self.code[node]] if node else 0

    def traverse(self, boundary: dict[int, int]) -> tuple[list[int], list[int], list[int], list[int]]:
        """Nodes, parents before children, and children, leaves and savings of each node: of the nodes that are finished
        here, so a boundary node's own leaf and saving are left out, and it is no one's child yet."""
        order, waiting = [], [0]
        while waiting:
            node = waiting.pop()
            order.append(node)
            waiting += [n for n in (self.more[node], self.less[node], self.below[node]) if n >= 0]
        children, leaves, saved = ([0] * len(order) for _ in range(3))
        # siblings come before or after each other, but all of a node's subtree comes after it
        for node in reversed(order):
            if node not in boundary:
                leaves[node] += children[node] == 0
                saved[node] += (self.members[node] - 1) * self.size(node)
                children[self.parent[node]] += 1
            if node:
                leaves[self.parent[node]] += leaves[node]
                saved[self.parent[node]] += saved[node]
        return order, children, leaves, saved

    def boundary(self) -> dict[int, int]:
        """Node -> 0 if it lies on the paths of the first and the last sequence, 1 or 2 if on one of them only."""
        first, last = set(self.path(0)), set(self.path(len(self.node_of) - 1))
        both = first & last
        return {node: 0 if node in both else 1 if node in first else 2 for node in first | last}

    def path_keys(self, boundary: dict[int, int]) -> dict[int, bytes]:
        """Chained hashes of the boundary nodes' paths, equal in all shards."""
        keys = {0: ROOT}
        for node in sorted(boundary):  # a parent's number is smaller
            if node:
                turn = self.turn_key[self.code[node]].tobytes()
                keys[node] = hashlib.sha256(keys[self.parent[node]] + turn).digest()[:KEY]
        return keys


def path_key(path: bytes) -> bytes:
    key = ROOT
    for at in range(0, len(path), ENTRY):
        key = hashlib.sha256(key + path[at:at + KEY]).digest()[:KEY]
    return key


PARTS = pa.schema([("chunk", pa.binary()), ("shard", pa.binary()), ("side", pa.int32()), ("key", pa.binary()),
                   ("parent_key", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()),
                   ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
                   ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("size", pa.int64()),
                   ("ends_sha256", pa.string())])
PARTS_SQL = ("chunk binary, shard binary, side int, key binary, parent_key binary, depth long, conv_id long, "
             "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, "
             "ends_sha256 string")


def _shard_rows(paths: list[bytes], counts: list[int], firsts: list[int], ends: list[str | None]) -> pa.RecordBatch:
    """The nodes of a shard; boundary nodes have a key and the shard's name.  ``ends`` is null for groups that were
    passed on in pieces."""
    shard = _Shard(paths, counts, firsts)
    boundary = shard.boundary()
    keys = shard.path_keys(boundary)
    order, children, leaves, saved = shard.traverse(boundary)
    name = hashlib.sha256(paths[0] + b"%d" % firsts[0]).digest()[:KEY]
    rows = []
    for node in order:
        parent, end = shard.parent[node], shard.end_of.get(node)
        at_boundary = node in boundary
        told = ends[end] if end is not None else None if at_boundary else NO_ENDS
        rows.append((None, name if at_boundary else None, boundary.get(node), keys.get(node), keys.get(parent),
                     shard.depth[node], shard.least[node],
                     None if parent < 0 or parent in boundary else shard.least[parent], shard.members[node],
                     children[node], leaves[node], saved[node], shard.size(node), told))
    return _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PARTS)], schema=PARTS)


def _pieces(path: bytes, ids: list[int]) -> pa.RecordBatch:
    """The ids of a group that another task may have a part of."""
    key = path_key(path)
    blank = (None,) * (len(PARTS) - 7)
    return _batch([(",".join(map(str, ids[at:at + CHUNK_IDS])).encode(), None, None, key, None, None, ids[at], *blank)
                   for at in range(0, len(ids), CHUNK_IDS)])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of a task's rows (path, conv_id), sorted by both."""
    paths, counts, firsts, ends, turns = [], [], [], [], 0
    path, ids, count, first, passed_on = None, [], 0, 0, True  # the group that is being read

    def close() -> None:
        nonlocal turns
        paths.append(path)
        counts.append(count)
        firsts.append(first)
        ends.append(None if passed_on else hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        turns += len(path) // ENTRY + 1

    for batch in batches:
        for row_path, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if row_path != path:
                if path is not None:
                    if passed_on and ids:
                        yield _pieces(path, ids)
                    close()
                    # a group that was passed on lies on its shard's boundary
                    if turns >= SHARD_TURNS or passed_on:
                        yield _shard_rows(paths, counts, firsts, ends)
                        paths, counts, firsts, ends, turns = [], [], [], [], 0
                # the first group of a task may have begun in another
                passed_on = path is None
                path, ids, count, first = row_path, [], 0, conv_id
            ids.append(conv_id)
            count += 1
            if len(ids) >= HELD_IDS:
                yield _pieces(path, ids)
                ids, passed_on = [], True
    if path is not None:  # the last group may go on in another task
        passed_on = True
        if ids:
            yield _pieces(path, ids)
        close()
        yield _shard_rows(paths, counts, firsts, ends)


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, ends`` of pieces (key, conv_id, chunk) sorted by key and first id."""
    def give() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])],
                                          names=["key", "ends"])

    key = state = None
    for batch in batches:
        for of, chunk in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if of != key:
                if key is not None:
                    yield give()
                key, state = of, hashlib.sha256(chunk)
            else:
                state.update(b",")
                state.update(chunk)
    if key is not None:
        yield give()


NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node (``NODES``) of the trie of ``conv_id, turns``, as ``conversation_turns`` gives them."""
    paths = materialise(turns.select(F.unhex(F.array_join("turns", "")).alias("path"), "conv_id"), "paths")
    dealt = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    parts = materialise(map_batches(dealt, _search, PARTS_SQL), "parts")

    chunks = parts.where("chunk IS NOT NULL").select("key", "conv_id", "chunk")
    hashed = map_batches(chunks.repartition("key").sortWithinPartitions("key", "conv_id"), _hash_pieces,
                         "key binary, ends string")
    shared = parts.where("shard IS NOT NULL")
    merged = shared.groupBy("key").agg(
        F.min("conv_id").alias("least"), F.sum("n_convs").alias("members"), F.sum("n_children").alias("inner"),
        F.max("size").alias("bytes"), F.max("depth").alias("level"), F.max("parent_key").alias("above"),
        F.max("ends_sha256").alias("told"), F.min("shard").alias("owner"))
    outer = merged.where("above IS NOT NULL").groupBy(F.col("above").alias("key")).agg(F.count("*").alias("outer"))
    merged = (merged.join(outer, "key", "left").join(hashed, "key", "left")
              .withColumn("children", F.col("inner") + F.coalesce("outer", F.lit(0)))
              .select("key", "least", "members", "level", "above", "owner", "children",
                      F.coalesce("ends", "told", F.lit(NO_ENDS)).alias("ends"),
                      F.when(F.col("children") == 0, 1).otherwise(0).cast("long").alias("leaf"),
                      ((F.col("members") - 1) * F.col("bytes")).alias("saving")))
    merged = materialise(merged, "boundary")

    # what boundary nodes add themselves goes to the nodes above them, on the two paths of the first shard that has them
    own = shared.join(merged.select("key", "owner", "leaf", "saving"), "key").select(
        "key", "shard", "side", "depth", "n_leaves", "saved_tokens",
        *(F.when(F.col("shard") == F.col("owner"), F.col(c)).otherwise(0).alias(c) for c in ("leaf", "saving")))
    along = Window.partitionBy("shard", "side").orderBy(F.desc("depth"))
    of_shard = Window.partitionBy("shard")

    def subtree(column: str) -> Column:
        lower = F.sum(F.when(F.col("side") > 0, F.col(column)).otherwise(0)).over(of_shard)
        return F.sum(column).over(along) + F.when(F.col("side") == 0, lower).otherwise(0)

    summed = (own.withColumn("leaves", F.col("n_leaves") + subtree("leaf"))
              .withColumn("saved", F.col("saved_tokens") + subtree("saving"))
              .groupBy("key").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")))
    parents = merged.select(F.col("key").alias("above"), F.col("least").alias("parent_least"))
    boundary = merged.join(summed, "key").join(parents, "above", "left").select(
        F.col("least").alias("conv_id"), F.col("level").alias("depth"), F.col("parent_least").alias("parent_conv_id"),
        F.col("members").alias("n_convs"), F.col("children").alias("n_children"), "n_leaves", "saved_tokens",
        F.col("ends").alias("ends_sha256"))
    # finished nodes right below the boundary lack their parent's smallest member
    side = F.broadcast(parents) if small_enough(parents) else parents
    inner = (parts.where("chunk IS NULL AND shard IS NULL")
             .join(side, F.col("parent_key") == F.col("above"), "left")
             .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent_least")))
    return inner.select(*NODES).unionByName(boundary.select(*NODES))
