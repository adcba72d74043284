import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from .brute import LOWER
from tidemark.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, longest):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def by_hand(rows, target, longest=1, percent=10, least=20, buckets=10_000):
    """Sorted result rows of (doc_id, text) rows."""
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for _, text in rows:
        for f in runs(text, longest)[1]:
            s[of(f)] += 1
    for text in target:
        for f in runs(text, longest)[1]:
            t[of(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    scored = []
    for i, text in rows:
        words, features = runs(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[of(f)] for f in features)
        scored.append((i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((r for r in scored if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = percent * len(able) // 100
    out = [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in scored if r[4] < least]
    return sorted(out, key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_plain_python(spark, corpus, docs, longest):
    rows = [*corpus.items(), (None, corpus[5]), (None, None), (5, corpus[5]), (300, "x" * 70_000 + " y " + "é" * 400 + " tail" * 30)]
    extra = spark.createDataFrame([(i, t, None, None, None, "x", 1, None) for i, t in rows[len(corpus):]], docs.schema)
    target = ["alpha betas GAMMA. alpha", None, "", "one-two three"]
    bench = spark.createDataFrame([(k, t, "x") for k, t in enumerate(target)], "item_id long, text string, doc_id string")
    got = resampling.resample(docs.unionByName(extra), bench, percent=50, longest=longest)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(rows, target, longest, 50)


def test_empty_tables(spark, docs, nothing, corpus):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(nothing, bench).collect() == []
    got = sorted((tuple(r) for r in resampling.resample(docs, bench).collect()), key=str)
    assert got == by_hand(list(corpus.items()), [])


def test_scan_reads_whole_words():
    texts = ["Hello World, é日本 a-b\x00c", "", None, "x", "A" * 300 + " b " + "c" * 5000, " !! ", "[z]{y}`w`"]
    crc, length, first = resampling.scan(pa.array(texts))
    words = [runs(t, 1)[0] for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in words]
    assert crc.tolist() == [zlib.crc32(w.encode()) for t in words for w in t]
    assert length.tolist() == [len(w.encode()) for t in words for w in t]


def test_crc_of_two_strings():
    pairs = [(b"", b""), (b"abc", b""), (b"", b"abc"), (b"hello wor", b"ld" * 1000), (b"a" * 70_000, b"b" * 65_537)]
    crc = [np.array([zlib.crc32(x[k]) for x in pairs], np.uint32) for k in (0, 1)]
    got = resampling.joined_crc(*crc, np.array([len(x[1]) for x in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_ranks_over_many_ranges(spark):
    rows = spark.range(5000).selectExpr("id % 7 as score", "id", "id as n_features", "id as weight").unionAll(
        spark.range(2000).selectExpr("3L", "11L", "11L", "11L"))
    from pyspark.sql import functions as F
    got = resampling.ranked(rows, [F.col("score").desc(), F.col("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 7001))
    assert [(r.score, r.id) for r in got] == sorted(((r.score, r.id) for r in got), key=lambda r: (-r[0], r[1]))
