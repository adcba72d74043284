"""Prefix trie of conversations in minimal-perfect-hash node tables (operator 11).

A node is a distinct sequence of first turns; it is told by a 128-bit digest chained from its parent's and the SHA-256
of (role, text) of its last turn.  Conversations are dealt to shards.  A shard enumerates the distinct digests of its
conversations, gives each a slot 0..n-1 by a minimal perfect hash (the digest kept at the slot verifies every look-up),
and keeps its part of the trie as flat arrays by slot: depth, bytes, parent slot, counts.  Counts scattered at the ends
of conversations are accumulated through the parent slots, deepest level first.

Any dealing of conversations gives the same result, since shards are merged by sums.  First round: members and ends per
local node; merged per digest they tell which conversation owns a node (the smallest member) and whether it is a leaf.  Second
round: each node is weighed in the one shard that holds its owner, whose conversations contain all ancestors of the node as well, so
leaves, children and saved tokens accumulate locally; the partial sums of a digest are added up.

Scale: only digests and byte counts are shuffled, texts never.  A shard has at most SHARD nodes and one conversation.  A node
that many shards share (the root, a common first turn) has one row per shard, never one per conversation; repeated conversations
end at one slot.  The list of conversations that end at a node is put together in ranges of (node, identifier), so that the task
that digests it reads a few long pieces.  No step iterates over depths across tasks.

Defined cases: rows without conv_id belong to no conversation and are left out; null role or text counts as empty; null turns come
first; equal turns are ordered by the digest of (role, text), so repeated rows are turns of their own; remainders have the sign
of the identifier, as in SQL; a conversation that a rebuild leaves without turns is a member of the root and ends there; an empty
table has no node, not even a root; very long texts are hashed where they are read; columns beside those named are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import mix
from tidemark.session import cut_lineage

SHARD = 200_000
PIECE = 1 << 20  # bytes of a piece of a list of conversations
ROOT = bytes(16)
LOCAL = "shard bigint, slot int, parent int, digest binary, depth int, bytes bigint, n bigint, ends bigint, conv bigint"
SUMS = "digest binary, depth int, conv bigint, parent_conv bigint, n bigint, children bigint, leaves bigint, saved bigint"


@dataclass(frozen=True)
class Rebuild:
    """Conversation c starts with the first h turns of c - c % step and goes on after its own first h; h = crc32(c) % parts."""

    step: int = 5
    parts: int = 9

    def borrowed(self, conv: int) -> int:
        return zlib.crc32(str(conv).encode()) % self.parts


class SlotTable:
    """Minimal perfect hash of distinct 128-bit digests, as (high, low) pairs of words.

    Digests that have a place of a level to themselves get the rank of that place as slot; the others go on to the next level.
    """

    def __init__(self, high: np.ndarray, low: np.ndarray):
        self.levels: list[tuple[int, np.ndarray]] = []
        slot, rest, given = np.full(len(high), -1, np.int64), np.arange(len(high)), 0
        while len(rest):
            size = max(16, 5 * len(rest) // 4)
            at = self._place(high[rest], low[rest], size)
            alone = np.bincount(at, minlength=size) == 1
            rank = np.where(alone, np.cumsum(alone) - 1 + given, -1)
            slot[rest] = rank[at]
            self.levels.append((size, rank))
            given, rest = given + int(alone.sum()), rest[rank[at] < 0]
        self.high, self.low = np.empty_like(high), np.empty_like(low)
        self.high[slot], self.low[slot] = high, low

    def _place(self, high: np.ndarray, low: np.ndarray, size: int, level: int | None = None) -> np.ndarray:
        seed = np.uint64((len(self.levels) if level is None else level) * 0x632BE59BD9B4E019 & (1 << 64) - 1)
        return (mix(high ^ mix(low + seed)) % np.uint64(size)).astype(np.int64)

    def slots(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Slot of each digest, -1 for one that the table does not hold."""
        out, rest = np.full(len(high), -1, np.int64), np.arange(len(high))
        for level, (size, rank) in enumerate(self.levels):
            found = rank[self._place(high[rest], low[rest], size, level)]
            out[rest] = found
            rest = rest[found < 0]
        held = out >= 0
        held[held] = (self.high[out[held]] == high[held]) & (self.low[out[held]] == low[held])
        return np.where(held, out, -1)


def climb(depth: np.ndarray, parent: np.ndarray, *counts: np.ndarray) -> None:
    """Add every node's counts to its parent's, deepest level first."""
    order = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[order], np.arange(int(depth.max(initial=0)) + 2))
    for level in range(len(bounds) - 2, 0, -1):
        nodes = order[bounds[level]:bounds[level + 1]]
        for count in counts:
            np.add.at(count, parent[nodes], count[nodes])


class _Paths:
    """Prefixes of the conversations of one shard, one after another: each is followed by the next longer one."""

    def __init__(self):
        self.digest, self.depth, self.bytes, self.conv, self.ends = [], [], [], [], []

    def begin(self, conv: int) -> None:
        self.add(ROOT, 0, 0, conv)

    def add(self, digest: bytes, depth: int, size: int, conv: int) -> None:
        self.digest.append(digest)
        self.depth.append(depth)
        self.bytes.append(size)
        self.conv.append(conv)

    def step(self, turn: bytes, size: int) -> None:
        digest = hashlib.blake2b(self.digest[-1] + turn, digest_size=16).digest()
        self.add(digest, self.depth[-1] + 1, size, self.conv[-1])

    def end(self) -> None:
        self.ends.append(len(self.digest) - 1)

    def nodes(self, shard: int) -> pa.RecordBatch:
        """Local nodes, one row per distinct prefix."""
        words = np.frombuffer(b"".join(self.digest), np.uint64).reshape(-1, 2)
        depth, size, conv = np.array(self.depth, np.int64), np.array(self.bytes, np.int64), np.array(self.conv, np.int64)
        order = np.lexsort((words[:, 1], words[:, 0]))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (words[order[1:]] != words[order[:-1]]).any(axis=1)
        some = order[fresh]
        slot = SlotTable(words[some, 0], words[some, 1]).slots(words[:, 0], words[:, 1])
        count = len(some)
        above = np.where(depth > 0, np.roll(slot, 1), -1)
        node_depth, node_size, parent = (np.zeros(count, np.int64) for _ in range(3))
        node_depth[slot], node_size[slot], parent[slot] = depth, size, above
        if (node_depth[slot] != depth).any() or (node_size[slot] != size).any() or (parent[slot] != above).any():
            raise ValueError("two different prefixes share a digest")
        least = np.full(count, np.iinfo(np.int64).max)
        np.minimum.at(least, slot, conv)
        ends = np.bincount(slot[self.ends], minlength=count).astype(np.int64)
        members = ends.copy()
        climb(node_depth, parent, members)
        digest = np.empty(count, "V16")
        digest[slot] = np.ascontiguousarray(words).view("V16").ravel()
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(count, shard)), pa.array(np.arange(count, dtype=np.int32)), pa.array(parent.astype(np.int32)),
            pa.array(digest.tolist(), pa.binary()), pa.array(node_depth.astype(np.int32)), pa.array(node_size), pa.array(members),
            pa.array(ends), pa.array(least)], names=[c.split()[0] for c in LOCAL.split(", ")])

    def finished(self, shard: int) -> pa.RecordBatch:
        """The conversations that end at a node, in the columns of nodes: slot is null, conv the conversation."""
        digest, conv = [self.digest[i] for i in self.ends], [self.conv[i] for i in self.ends]
        none = [pa.nulls(len(conv), t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())]
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(conv), shard)), *none[:2], pa.array(digest, pa.binary()), *none[2:], pa.array(conv, pa.int64())],
            names=[c.split()[0] for c in LOCAL.split(", ")])


def _local_nodes(rebuild: Rebuild | None):
    """First round: rows (group, conv, digest, bytes), each group's lender first, to local nodes and ends."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        paths, block = _Paths(), 0
        group = conv = None
        lent: list[tuple[bytes, int]] = []
        skipped = place = 0
        for batch in batches:
            for g, c, digest, size in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if c != conv or g != group:
                    if conv is not None:
                        paths.end()
                    if len(paths.digest) >= SHARD:
                        yield paths.nodes(first + block)
                        yield paths.finished(first + block)
                        paths, block = _Paths(), block + 1
                    if g != group:
                        lent = []
                    group, conv, place = g, c, 0
                    paths.begin(c)
                    skipped = rebuild.borrowed(c) if rebuild and c != g else 0
                    for turn in lent[:skipped]:
                        paths.step(*turn)
                if rebuild and c == g and place < rebuild.parts:
                    lent.append((digest, size))
                if place >= skipped:
                    paths.step(digest, size)
                place += 1
        if conv is not None:
            paths.end()
            yield paths.nodes(first + block)
            yield paths.finished(first + block)

    return run


def _partial_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second round: whole shards, one after another, to one row per local node."""
    def sums(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        number = {c: np.asarray(table.column(c).combine_chunks()) for c in ("slot", "parent", "depth", "bytes", "conv", "all", "leaf", "owner")}
        slot = number["slot"]
        depth, parent, size, total, owner = (np.zeros(len(slot), np.int64) for _ in range(5))
        for array, name in ((depth, "depth"), (parent, "parent"), (size, "bytes"), (total, "all"), (owner, "owner")):
            array[slot] = number[name]
        own, leaf = np.zeros(len(slot), bool), np.zeros(len(slot), bool)
        own[slot], leaf[slot] = number["conv"] == number["owner"], number["leaf"]
        leaves, saved = (own & leaf).astype(np.int64), np.where(own, (total - 1) * size, 0)
        climb(depth, parent, leaves, saved)
        children, below = np.zeros(len(slot), np.int64), own & (depth > 0)
        np.add.at(children, parent[below], 1)
        told = own[slot]
        above = np.where(depth > 0, owner[parent], 0)
        return pa.RecordBatch.from_arrays([
            table.column("digest").combine_chunks(), pa.array(depth[slot].astype(np.int32)), pa.array(owner[slot], mask=~told),
            pa.array(above[slot], mask=~told | (depth[slot] == 0)), pa.array(total[slot], mask=~told), pa.array(children[slot]),
            pa.array(leaves[slot]), pa.array(saved[slot])], names=[c.split()[0] for c in SUMS.split(", ")])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and held[-1].column(0)[0].as_py() != int(shard[a]):
                yield sums(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield sums(held)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (digest, conv) to comma-joined pieces of each digest's conversations."""
    out: list[tuple[bytes, int, str]] = []
    node, convs, held = None, [], 0

    def batch_of():
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()),
                                           pa.array([o[2] for o in out], pa.string())], names=["digest", "first", "piece"])

    for batch in batches:
        for digest, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if convs and (digest != node or 12 * len(convs) >= PIECE):
                out.append((node, convs[0], ",".join(map(str, convs))))
                held, convs = held + 12 * len(convs), []
            node = digest
            convs.append(conv)
            if held >= PIECE:
                yield batch_of()
                out, held = [], 0
    if convs:
        out.append((node, convs[0], ",".join(map(str, convs))))
    yield batch_of()


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one SHA-256 per digest."""
    node, sha = None, None
    for batch in batches:
        out = []
        for digest, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if digest != node:
                if sha is not None:
                    out.append((node, sha.hexdigest()))
                node, sha = digest, hashlib.sha256(piece.encode())
            else:
                sha.update(b"," + piece.encode())
        yield _shas(out)
    if sha is not None:
        yield _shas([(node, sha.hexdigest())])


def _shas(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())],
                                      names=["_digest", "ends_sha256"])


def turn_digests(turns: DataFrame, rebuild: Rebuild | None = None) -> DataFrame:
    """(group, conv, digest, bytes) of every turn, in the order in which a task has to read them."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("bigint")
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        (conv - conv % rebuild.step if rebuild else conv).alias("group"), conv.alias("conv"), F.col("turn").alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("bigint").alias("bytes"))
    order = ["group", F.col("group") != F.col("conv"), "conv", F.col("turn").asc_nulls_first(), "digest"]
    return rows.repartition("group").sortWithinPartitions(*order).select("group", "conv", "digest", "bytes")


def prefix_trie(turns: DataFrame, rebuild: Rebuild | None = None) -> DataFrame:
    """One row per node of the trie of (conv_id, turn, role, text) rows.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; see the module.
    """
    local = cut_lineage(turn_digests(turns, rebuild).mapInArrow(_local_nodes(rebuild), LOCAL))
    of_node = local.where("slot is not null").groupBy("digest").agg(
        F.sum("n").alias("all"), (F.sum("n") == F.sum("ends")).alias("leaf"), F.min("conv").alias("owner"))
    shards = (
        local.where("slot is not null").select("shard", "slot", "parent", "digest", "depth", "bytes", "conv").join(of_node, "digest")
        .select("shard", "slot", "parent", "digest", "depth", "bytes", "conv", "all", "leaf", "owner")
        .repartition("shard").sortWithinPartitions("shard")
    )
    nodes = shards.mapInArrow(_partial_sums, SUMS).groupBy("digest").agg(
        F.max("depth").alias("depth"), F.max("conv").alias("conv_id"), F.max("parent_conv").alias("parent_conv_id"), F.max("n").alias("n_convs"),
        F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    order = ["digest", "conv"]
    pieces = local.where("slot is null").select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _pieces, "digest binary, first bigint, piece string")
    ends = pieces.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(_digested, "_digest binary, ends_sha256 string")
    return nodes.join(ends, F.col("digest") == F.col("_digest"), "left").select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
