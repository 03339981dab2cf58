"""12. Conversation prefix trie, by range shards and a skeleton of their border paths.

Every distinct sequence of first turns is a node. Conversations are paths of
turn digests, dealt by range of (path, conversation) and sorted, so that a node's
members lie side by side. The first and the last path of each shard are its
splitter paths: a node with members in two shards lies on the last path of the
one and on the first path of the other. All splitter paths together are the
skeleton of the trie.

1. Each task walks its sorted shard with a stack as deep as a path and finishes
   every node off the shard's splitter paths. Nodes on these are given as
   partial aggregates.
2. Partial aggregates of a skeleton node are reduced by node. What a skeleton
   node adds to its ancestors (its own saving, itself as a leaf) is known only
   then; one shard owns it, and a running sum up the shard's splitter path
   brings it to the ancestors.
3. The skeleton goes to the local nodes that hang from it, for their parent's
   name: broadcast if its measured size allows it, else by a salted join.

However many conversations share a path or a turn, they are spread over the
shards: equal paths are parted by ``conv_id``. Only the digest of the members
that end in a node must read them in one order; a shard hands them on joined
in pieces of ``PIECE`` characters, which are streamed through one hash.

A rebuilt conversation is one row of turn digests (about 40 bytes a turn, never
texts), and a task holds the nodes of its shard of about ``SHARD_TURNS`` turns.

Defined cases: a null role or text is empty; null turns come first; turns of
one number are ordered by role, then by the first 64 characters of the text, then
by digest, and rows that repeat one count each;
rows without a ``conv_id`` belong to no conversation; the base of a negative id
is found by truncation (-7 has -5). An empty table has no node. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import lookup_join, measured_bytes
from ..session import parallelism
from .common import staged

HEAD, BASE = 9, 5
SHARD_TURNS, PIECE = 1 << 18, 1 << 16
LOCAL, PARTIAL, ENDS = 0, 1, 2
ROOT = b"root"
SCHEMA = ("kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
          "saved_tokens long, ends_sha256 string, shard int, last boolean, node binary, parent binary, "
          "bytes long, seq long, piece string")
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
PARENT_CONV, PARENT = COLUMNS.index("parent_conv_id"), COLUMNS.index("parent")
TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
ARROW = [TYPES[c.split()[1]] for c in SCHEMA.split(", ")]


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, keys, sizes``: digests and text bytes of the turns of every rebuilt conversation."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The length of the role keeps role and text apart.
    key = F.unhex(F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), role, text), 256))
    turns = (conversations.filter("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id"))
             .agg(F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), F.substring(text, 1, 64).alias("start"),
                                                       key.alias("key"), F.octet_length(text).alias("size")))).alias("t")))
    own = staged(turns.select("conv_id", F.transform("t", lambda x: F.struct(x["key"].alias("key"), x["size"].cast("long").alias("size")))
                              .alias("own")), "trie-own")
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % HEAD).cast("int")
    head = own.select(c.alias("base"), F.slice("own", 1, HEAD - 1).alias("head"))
    path = (own.withColumn("base", c - c % BASE).join(head, "base", "left")
            .withColumn("h", h)
            .select("conv_id", F.concat(
                F.when(F.col("head").isNull() | (F.col("h") == 0), F.slice("own", 1, 0)).otherwise(F.expr("slice(head, 1, h)")),
                F.expr("slice(own, h + 1, greatest(size(own), 1))")).alias("path")))
    return path.select("conv_id", F.col("path.key").alias("keys"), F.col("path.size").alias("sizes"))


class _Node:
    __slots__ = ("conv", "n", "children", "leaves", "saved", "bytes", "ends", "below", "sha", "any_ends")

    def __init__(self, size: int):
        self.conv, self.n, self.children, self.leaves, self.saved, self.bytes = None, 0, 0, 0, 0, size
        self.ends: list[str] = []           # ids of members that end here, not yet hashed or given
        self.sha, self.any_ends = None, False
        self.below: list[list] = []         # rows of finished children, and pieces of ends, that wait to know this node

    def count(self, conv: int, n: int) -> None:
        self.n += n
        if self.conv is None or conv < self.conv:
            self.conv = conv


def _ids(path: list[bytes]) -> list[bytes]:
    """The nodes along a path, root first."""
    return list(itertools.accumulate(path, lambda node, key: hashlib.sha256(node + key).digest(), initial=ROOT))


def _shared(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class _Shard:
    """One sorted shard: rows come in path order, finished rows are collected in ``out``."""

    def __init__(self, number: int):
        self.number, self.out = number, []
        self.stack: list[_Node] = []
        self.path: list[bytes] = []
        self.first: list[bytes] = []
        self.on_first = 0                   # stack nodes up to this depth lie on the first path
        self.seq = 0

    def add(self, conv: int, keys: list[bytes], sizes: list[int]) -> None:
        if not self.stack:
            self.stack, self.first, self.first_ids = [_Node(0)], keys, _ids(keys)
            shared, self.on_first = 0, len(keys)
        else:
            shared = _shared(self.path, keys)
            self._close(shared)
            self.on_first = min(self.on_first, shared)
        for size in sizes[shared:]:
            self.stack.append(_Node(size))
        self.path = keys
        top = self.stack[-1]
        top.count(conv, 1)
        top.ends.append(str(conv))
        if len(top.ends) >= PIECE // 8:
            self._flush(top, len(keys))

    def _flush(self, node: _Node, depth: int) -> None:
        """Take the waiting end ids: into the hash of a node, and as a piece of one that may be a skeleton node."""
        if not node.ends:
            return
        text = ",".join(node.ends)
        if depth <= self.on_first:
            self._piece(self.first_ids[depth], text)
        else:
            # Off the first path, but maybe on the last one: both a running hash and pieces until that is known.
            node.sha = node.sha or hashlib.sha256()
            node.sha.update((("," if node.any_ends else "") + text).encode())
            node.below.append([ENDS, text])
        node.any_ends, node.ends = True, []

    def _piece(self, node: bytes, text: str) -> None:
        self.out.append(self._row(kind=ENDS, node=node, shard=self.number, seq=self.seq, piece=text))
        self.seq += 1

    @staticmethod
    def _row(**values) -> list:
        return [values.get(c) for c in COLUMNS]

    def _close(self, depth: int) -> None:
        """Finish the stack's nodes deeper than ``depth``."""
        while len(self.stack) - 1 > depth:
            at = len(self.stack) - 1
            if at <= self.on_first:
                self._partial(at, self.first_ids, last=False)
            else:
                self._local(at)

    def _local(self, at: int) -> None:
        node = self.stack.pop()
        up = self.stack[-1]
        if node.ends:
            node.sha = node.sha or hashlib.sha256()
            node.sha.update((("," if node.any_ends else "") + ",".join(node.ends)).encode())
        leaves = node.leaves or int(not node.children)
        saved = node.saved + (node.n - 1) * node.bytes
        row = self._row(kind=LOCAL, conv_id=node.conv, depth=at, n_convs=node.n, n_children=node.children, n_leaves=leaves,
                        saved_tokens=saved, ends_sha256=(node.sha or hashlib.sha256()).hexdigest())
        for child in node.below:
            if child[0] == LOCAL:
                child[PARENT_CONV] = node.conv
                self.out.append(child)
        if at - 1 <= self.on_first:
            row[PARENT] = self.first_ids[at - 1]
            self.out.append(row)
        else:
            up.below.append(row)
        up.count(node.conv, node.n)
        up.children += 1
        up.leaves += leaves
        up.saved += saved

    def _partial(self, at: int, ids: list[bytes], last: bool) -> None:
        node = self.stack.pop()
        for child in node.below:
            if child[0] == LOCAL:
                child[PARENT] = ids[at]
                self.out.append(child)
            else:
                self._piece(ids[at], child[1])
        if node.ends:
            self._piece(ids[at], ",".join(node.ends))
        self.out.append(self._row(kind=PARTIAL, conv_id=node.conv, depth=at, n_convs=node.n, n_children=node.children,
                                  n_leaves=node.leaves, saved_tokens=node.saved, shard=self.number, last=last, node=ids[at],
                                  parent=ids[at - 1] if at else None, bytes=node.bytes))
        if self.stack:                      # what hangs below counts for the nodes above, but not as their children
            self.stack[-1].count(node.conv, node.n)
            self.stack[-1].leaves += node.leaves
            self.stack[-1].saved += node.saved

    def end(self) -> None:
        """The rest of the stack is the last path."""
        ids = _ids(self.path)
        while self.stack:
            self._partial(len(self.stack) - 1, ids, last=True)


def _batch(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW)], names=COLUMNS)


def _walk(batches):
    from pyspark import TaskContext
    shard = _Shard(TaskContext.get().partitionId())
    for b in batches:
        for conv, keys, sizes in zip(*(b.column(i).to_pylist() for i in range(3))):
            shard.add(conv, keys, sizes)
        if len(shard.out) >= 10_000:
            yield _batch(shard.out)
            shard.out = []
    shard.end()
    for at in range(0, len(shard.out), 10_000):
        yield _batch(shard.out[at:at + 10_000])


def _digests(batches):
    """``node, ends_sha256`` of rows ``(node, piece)`` that come sorted by node and order: one hash is open at a time."""
    node, sha, out = None, None, []
    for b in batches:
        for n, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if n != node:
                if node is not None:
                    out.append((node, sha.hexdigest()))
                node, sha = n, hashlib.sha256(piece.encode())
            else:
                sha.update(b"," + piece.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.string()))],
                                             names=["node", "ends_sha256"])
            out = []
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])],
                                         names=["node", "ends_sha256"])


def _skeleton(found: DataFrame) -> DataFrame:
    """Whole skeleton nodes out of their partial aggregates."""
    parts = found.filter(F.col("kind") == PARTIAL)
    nodes = staged(parts.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.first("parent").alias("parent"),
        F.first("bytes").alias("bytes"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("children"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.min("shard").alias("owner")), "trie-nodes")
    below = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("more"))
    nodes = staged(nodes.join(below, "node", "left")
                   .withColumn("n_children", F.col("children") + F.coalesce("more", F.lit(0))).drop("children", "more"),
                   "trie-skeleton")
    # The owner's splitter paths carry what the node itself adds up to the root: a suffix sum along them. The
    # nodes of the first path that are not on the last one come first; below a common node lie those of both.
    own = (parts.select("node", "shard", "last", F.col("depth").alias("at")).join(
        nodes.select("node", "owner", F.when(F.col("n_children") == 0, 1).otherwise(0).alias("leaf"),
                     ((F.col("n_convs") - 1) * F.col("bytes")).alias("saving")), "node")
        .withColumn("leaf", F.when(F.col("shard") == F.col("owner"), F.col("leaf")).otherwise(0))
        .withColumn("saving", F.when(F.col("shard") == F.col("owner"), F.col("saving")).otherwise(0)))
    fork = own.groupBy("shard").agg(F.coalesce(F.min(F.when(~F.col("last"), F.col("at"))), F.lit(1 << 62)).alias("fork"))
    up = Window.orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    side, both = up.partitionBy("shard", "last"), up.partitionBy("shard")
    apart = F.col("at") >= F.col("fork")
    sums = (own.join(fork, "shard").select("node", *[
        F.when(apart, F.sum(c).over(side)).otherwise(F.sum(c).over(both)).alias(c) for c in ("leaf", "saving")])
        .groupBy("node").agg(F.sum("leaf").alias("leaf"), F.sum("saving").alias("saving")))
    pieces = (found.filter(F.col("kind") == ENDS).select("node", "shard", "seq", "piece")
              .repartition("node").sortWithinPartitions("node", "shard", "seq").select("node", "piece"))
    ends = pieces.mapInArrow(_digests, "node binary, ends_sha256 string")
    return staged(nodes.join(sums, "node").join(ends, "node", "left").select(
        "node", "parent", "conv_id", "depth", "n_convs", "n_children", (F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved") + F.col("saving")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")), "trie-whole")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of the rebuilt ``conversations(conv_id, turn, role, text)``."""
    spark = conversations.sparkSession
    paths = staged(rebuilt(conversations), "trie-paths")
    turns = paths.agg(F.sum(F.size("keys") + 1)).first()[0] or 0
    shards = max(parallelism(spark), -(-int(turns) // SHARD_TURNS))
    found = staged(paths.repartitionByRange(shards, "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
                   .mapInArrow(_walk, SCHEMA), "trie-shards")
    skeleton = _skeleton(found)
    names = skeleton.select(F.col("node").alias("up"), F.col("conv_id").alias("up_conv"))
    size = measured_bytes(skeleton.select(F.hex("node"), "conv_id"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    local = found.filter(F.col("kind") == LOCAL)
    inner = local.filter("parent is null").select(*out)
    hung = lookup_join(local.filter("parent is not null").drop("parent_conv_id"), names, "parent", "up", size)
    stem = lookup_join(skeleton, names, "parent", "up", size)
    return (inner.unionByName(hung.withColumn("parent_conv_id", F.col("up_conv")).select(*out))
            .unionByName(stem.withColumn("parent_conv_id", F.col("up_conv")).select(*out)))
