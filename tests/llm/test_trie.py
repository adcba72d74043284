import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import prefix_trie
from tidemark.llm.prefix_trie import Rebuild, SlotTable, climb

SCHEMA = "conv_id long, turn long, role string, text string, digest string, slot int, shard long, n long"


def clean(row):
    return row[2] or "", row[3] or ""


def by_hand(rows, rebuild):
    """Node path -> result row, by dictionaries."""
    convs = {}
    for r in rows:
        if r[0] is not None:
            convs.setdefault(r[0], []).append(r)
    def digest(r):
        role, text = clean(r)
        return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
    own = {c: [clean(r) for r in sorted(t, key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))] for c, t in convs.items()}
    built = {}
    for c, turns in own.items():
        if rebuild:
            h = zlib.crc32(str(c).encode()) % rebuild.parts
            lender = c - int(np.fmod(c, rebuild.step))
            turns = own.get(lender, [])[:h] + turns[h:]
        built[c] = tuple(turns)
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    kids = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[:len(path)] == path]
        ends = sorted(c for c in members if built[c] == path)
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids.get(path, [])),
                    sum(p not in kids for p in below), sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(rng, n):
    rows = []
    for c in range(n):
        length = rng.randrange(1, 13)
        rows += [(c, k, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None, "é", "long " * 40])) for k in range(length)]
    rows += [(500, None, "user", "late"), (500, 3, "user", "x"), (500, 3, "user", "x"), (500, 3, "user", "y"), (500, None, None, None)]
    rows += [(-7, 0, "user", "a"), (-5, 0, "user", "b"), (-5, 1, "user", "c"), (None, 0, "user", "nobody"), (None, 1, "user", "nobody")]
    rows += [(900 + c, k, "user", f"same {k}") for c in range(40) for k in range(10)]
    rows += [(1001, 0, "user", "z" * 300_000)]
    return rows


@pytest.mark.parametrize("rebuild", [Rebuild(), None])
def test_trie_equals_dictionaries(spark, rebuild, monkeypatch):
    rows = conversations(random.Random(3), 60)
    random.Random(4).shuffle(rows)
    monkeypatch.setattr(prefix_trie, "SHARD", 37)
    turns = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(turns, rebuild).collect()), key=str)
    assert got == by_hand(rows, rebuild)


def test_no_conversations_no_nodes(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(nothing, Rebuild()).collect() == []
    nobody = spark.createDataFrame([(None, 0, "user", "x", "", 0, 0, 0)], SCHEMA)
    assert prefix_trie.prefix_trie(nobody, Rebuild()).collect() == []


@pytest.mark.parametrize("n", [1, 2, 1000, 50_000])
def test_slots_are_minimal_and_verified(n):
    words = np.random.default_rng(n).integers(0, 1 << 63, (2 * n, 2)).astype(np.uint64)
    words[:n, 1] = 7  # digests that share a word
    table = SlotTable(words[:n, 0], words[:n, 1])
    assert sorted(table.slots(words[:n, 0], words[:n, 1])) == list(range(n))
    assert (table.slots(words[n:, 0], words[n:, 1]) == -1).all()


def test_climb_adds_up_subtrees():
    depth, parent = np.array([2, 0, 1, 1, 2]), np.array([2, -1, 1, 1, 3])
    count = np.ones(5, np.int64)
    climb(depth, parent, count)
    assert count.tolist() == [1, 5, 2, 2, 1]


def test_long_lists_of_ends_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 100)
    turns = spark.createDataFrame([(c, 0, "user", "hello", "", 0, 0, 0) for c in range(3000)], SCHEMA)
    top = prefix_trie.prefix_trie(turns).where("depth = 1").collect()
    assert [(r.n_convs, r.ends_sha256) for r in top] == [(3000, hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest())]
