"""Exact deduplication with Patricia tries (operator 10).

Texts are equal when the same after deleting every character of [\\x20\\x09-\\x0D].  The rows of one
(length, content hash) meet in one task, where full byte strings are inserted into a compressed radix
trie: equality is decided by bytes, never by the hash.  A terminal node stores how many documents end
there and the one that stays.

Scale: every input partition first inserts into tries of its own and sends each distinct text once, so a
text with a third of all rows arrives once per input partition.  Rows reach a task ordered by (length, hash)
and a trie lives only as long as its key.  A trie that outgrows its budget, objects counted, spills its subtrees to scratch
files of the task and takes them up one after another, each within the same budget.

Defined cases: null text counts as empty; empty and blank texts equal each other; of equal texts the one
with the most code points in the original text stays, then the smallest identifier, null identifiers last;
a repeated row is a further member of its group; columns beside identifier and text are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from typing import IO

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
LOCAL_BYTES = 48 << 20
ENTRY_BYTES = 900  # a node with its dictionary, label and owner, measured
TRIE_BYTES = 256 << 20
OWNERS = "length int, hash bigint, body binary, chars int, id bigint, n bigint"
GROUPS = "sha string, keep_id bigint, group_size bigint"
LAST = 1 << 63  # a null identifier orders after every other


class _Node:
    __slots__ = ("label", "children", "owner")

    def __init__(self, label: bytes, owner: tuple | None = None):
        self.label, self.children, self.owner = label, {}, owner


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving (slices compare at memory speed)."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def better(a: tuple, b: tuple) -> tuple:
    """Owner of a merged terminal: (minus code points, identifier, count), counts added."""
    return (*min(a[:2], b[:2]), a[2] + b[2])


class PatriciaTrie:
    """Byte strings with owners; beyond `limit` bytes of memory the subtrees go to scratch files.

    A spill cuts below the longest prefix that all keys share: every child there is a subtree with a file of its own, to which later keys of
    that subtree go straight.  A file is taken up as a trie with the same limit, which spills again below its own, longer prefix.
    """

    def __init__(self, limit: int = TRIE_BYTES):
        self.root, self.limit, self.size = _Node(b""), limit, 0
        self.spilled: list[tuple[bytes, dict[int, IO[bytes]]]] = []

    def insert(self, key: bytes, owner: tuple) -> None:
        for prefix, files in self.spilled:
            if len(key) > len(prefix) and key[len(prefix)] in files and key.startswith(prefix):
                pickle.dump((key, owner), files[key[len(prefix)]])
                return
        node, rest = self.root, key
        while rest:
            child = node.children.get(rest[0])
            if child is None:
                node.children[rest[0]] = _Node(rest, owner)
                self.size += len(rest) + ENTRY_BYTES
                break
            n = _shared(child.label, rest)
            if n < len(child.label):  # split the edge
                top = _Node(child.label[:n])
                child.label = child.label[n:]
                top.children[child.label[0]] = child
                node.children[rest[0]] = child = top
                self.size += ENTRY_BYTES
            node, rest = child, rest[n:]
        else:
            node.owner = owner if node.owner is None else better(node.owner, owner)
        if self.size > self.limit:
            self._spill()

    def _spill(self) -> None:
        """Move every subtree below the shared prefix to a scratch file; a key that ends there stays, as does a single key."""
        prefix, node = b"", self.root
        while len(node.children) == 1 and node.owner is None:
            node = next(iter(node.children.values()))
            prefix += node.label
        if not node.children:
            return
        files: dict[int, IO[bytes]] = {}
        for first, child in node.children.items():
            files[first] = tempfile.TemporaryFile()
            for key, owner in self._walk(child, prefix):
                pickle.dump((key, owner), files[first])
        self.spilled.append((prefix, files))
        self.root, self.size = _Node(b""), 0
        if node.owner is not None:
            self.insert(prefix, node.owner)

    @staticmethod
    def _walk(node: _Node, above: bytes) -> Iterator[tuple[bytes, tuple]]:
        stack = [(node, above)]
        while stack:
            node, above = stack.pop()
            key = above + node.label
            if node.owner is not None:
                yield key, node.owner
            stack.extend((x, key) for x in node.children.values())

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        """Every key with its owner: subtrees in memory, then each spilled one by itself."""
        yield from self._walk(self.root, b"")
        self.root, self.size = _Node(b""), 0
        spilled, self.spilled = self.spilled, []
        for _, files in spilled:
            for file in files.values():
                part = PatriciaTrie(self.limit)
                file.seek(0)
                while True:
                    try:
                        part.insert(*pickle.load(file))
                    except EOFError:
                        break
                file.close()
                yield from part.items()


def _rows(items: Iterable[tuple[int, int, bytes, tuple]]) -> pa.RecordBatch:
    length, code, body, owner = zip(*items, strict=True)
    return pa.RecordBatch.from_arrays([
        pa.array(length, pa.int32()), pa.array(code, pa.int64()), pa.array(body, pa.binary()),
        pa.array([-x[0] for x in owner], pa.int32()),
        pa.array([None if x[1] == LAST else x[1] for x in owner], pa.int64()),
        pa.array([x[2] for x in owner], pa.int64()),
    ], names=["length", "hash", "body", "chars", "id", "n"])


def _local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct text of an input partition once, with its local owner and count."""
    tries: dict[tuple[int, int], PatriciaTrie] = {}
    held = 0

    def flush():
        out, size = [], 0
        for (length, code), trie in tries.items():
            for key, owner in trie.items():
                out.append((length, code, key, owner))
                size += length
                if size > 4 << 20:
                    yield _rows(out)
                    out, size = [], 0
        if out:
            yield _rows(out)

    for batch in batches:
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            body = text.encode().translate(None, BLANKS)
            key = (len(body), xxhash.xxh3_64_intdigest(body) - (1 << 63))
            if (trie := tries.get(key)) is None:
                trie = tries[key] = PatriciaTrie()
            before = trie.size
            trie.insert(body, (-len(text), LAST if ident is None else ident, 1))
            held += trie.size - before
            if held > LOCAL_BYTES:
                yield from flush()
                tries.clear()
                held = 0
    yield from flush()


def _owners(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct text; batches come ordered by (length, hash)."""
    current, trie = None, PatriciaTrie()

    def groups(done):
        found = [(hashlib.sha256(k).hexdigest(), None if o[1] == LAST else o[1], o[2]) for k, o in done.items()]
        return [(s, i, n) for s, i, n in found]

    for batch in batches:
        out = []
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for length, code, body, chars, ident, n in zip(*columns, strict=True):
            if (length, code) != current:
                out += groups(trie)
                current, trie = (length, code), PatriciaTrie()
            trie.insert(body, (-chars, LAST if ident is None else ident, n))
        yield _group_rows(out)
    yield _group_rows(groups(trie))


def _group_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                                       pa.array([r[2] for r in rows], pa.int64())], names=["sha", "keep_id", "group_size"])


def text_groups(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per distinct normalised text: sha (hex), keep_id, group_size."""
    local = docs.select(F.col(ident).cast("bigint"), F.col(text)).mapInArrow(_local, OWNERS)
    return local.repartition("length", "hash").sortWithinPartitions("length", "hash").mapInArrow(_owners, GROUPS)


def normal_sha(text: Column) -> Column:
    """Hex sha256 of the normalised text."""
    text = F.coalesce(text, F.lit(""))
    for blank in BLANKS.decode():
        text = F.replace(text, F.lit(blank))
    return F.sha2(text, 256)


def exact_groups(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Members find their group by the digest of the normalised text; a group with most of the rows is a skewed
    equi-join, which Spark splits.
    """
    members = docs.select(F.col(ident).cast("bigint").alias("doc_id"), normal_sha(F.col(text)).alias("text_sha256"))
    groups = text_groups(docs, ident, text)
    return members.join(groups, members["text_sha256"] == groups["sha"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, all columns; needs unique identifiers to keep one row of a group."""
    kept = exact_groups(docs, ident, text).where("kept").select(F.col("doc_id").alias("_kept_id"))
    return docs.join(kept, F.col(ident).eqNullSafe(F.col("_kept_id")), "left_semi")
