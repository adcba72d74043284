import math
import unicodedata

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, quality
from tidemark.llm.queries import op13_quality
from tidemark.llm.quality import Moments


def kind(c):
    group = unicodedata.category(c)
    if c in ".,;:?'\"-()":
        return "mark"
    if group[0] in "LM":
        return "upper" if group in ("Lu", "Lt") else "lower"
    if group[0] == "N":
        return "digit"
    if group[0] == "Z" or 9 <= ord(c) <= 13:
        return "white"
    return "mark" if ord(c) > 127 and group[0] == "P" else "symbol"


def by_hand(text):
    """The statistics of a text, word by word."""
    split = "".join(" " if kind(c) == "white" else c for c in text).split(" ")
    words = [w for w in split if w]
    lines = [x for x in text.split("\n") if x]
    of = lambda t, *k: sum(kind(c) in k for c in t)
    share = lambda a, b: math.log((a + 0.5) / (b + 1))
    letters, chars, n = of(text, "lower", "upper"), len(text) - of(text, "white"), len(words)
    far = sum(ord(c) > 127 and kind(c) in ("lower", "upper") for c in text)
    return [
        math.log1p(chars), math.log1p(n), math.log((letters + 1) / (n + 1)), share(of(text, "upper"), letters), share(of(text, "digit"), chars),
        share(of(text, "mark"), chars), share(of(text, "symbol"), chars), share(sum(of(w, "upper") > 1 and not of(w, "lower") for w in words), n),
        share(sum(of(w, "symbol") > 0 and of(w, "lower", "upper") > 0 for w in words), n), share(sum(not of(w, "lower", "upper", "digit") for w in words), n),
        share(sum(a == b for a, b in zip(words, words[1:])), n), share(n - len(set(words)), len(set(words))),
        math.log((n + 1) / (len(lines) + 1)), share(len(lines) - len(set(lines)), len(lines)), share(far, letters),
        math.log1p(max(map(len, words), default=0)), share(sum(kind(w[0]) == "upper" and of(w, "lower") > 0 for w in words), n),
    ]


TEXTS = ["", " \n ", "The The the the. A\nA\nB", "WIE!! GEHT!! 12 | x%% «é» ÄÖ 日本", "a", "x" * 5000, "one\ttwo\n\nthree three", "…? $5.00 No."]


def test_statistics_equal_plain_python():
    np.testing.assert_allclose(quality.statistics(TEXTS), [by_hand(t) for t in TEXTS], rtol=1e-12)
    assert quality.statistics([]).shape == (0, len(quality.STATISTICS))


def moments(x):
    return Moments(float(len(x)), x.sum(axis=0), x.T @ x)


def test_densities_equal_the_formula():
    rng = np.random.default_rng(1)
    rows = {0: rng.normal(size=(300, 3)) @ np.array([[1, 2, 0], [0, 1, 0], [0, 0, 3.0]]), 1: rng.normal(size=(500, 3)) + 1}
    model = quality.discriminant({c: moments(x) for c, x in rows.items()}, 0.3, 0.2)
    centred = {c: x - x.mean(axis=0) for c, x in rows.items()}
    common = sum(x.T @ x for x in centred.values()) / 800
    spread = np.sqrt(np.diag(common))
    x, density = rng.normal(size=(20, 3)), {}
    for c in (0, 1):
        scaled = (0.7 * np.cov(rows[c].T, ddof=0) + 0.3 * common) / np.outer(spread, spread)
        scaled = 0.8 * scaled + 0.2 * np.trace(scaled) / 3 * np.eye(3)
        z = (x - rows[c].mean(axis=0)) / spread
        density[c] = -0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(scaled), z) - 0.5 * np.log(np.linalg.det(scaled))
    np.testing.assert_allclose(model.difference(x), density[1] - density[0], rtol=1e-9)


def test_others_are_total_less_own():
    x = np.random.default_rng(2).normal(size=(50, 4))
    left = moments(x) - moments(x[:20])
    np.testing.assert_allclose(left.scatter(), moments(x[20:]).scatter(), atol=1e-9)


def test_curve_recovers_a_logistic_law():
    z = np.linspace(-4, 4, 81)
    n = np.full(81, 10_000.0)
    slope, level, _ = quality.curve(z, n / (1 + np.exp(-(1.5 * z - 0.5))), n)
    assert slope == pytest.approx(1.5, abs=1e-3) and level == pytest.approx(-0.5, abs=1e-3)


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op13_quality(spark, folder).collect()}
    docs = pq.read_table(f"{folder}/documents.parquet").column("doc_id").to_pylist()
    labels = dict(zip(*(pq.read_table(f"{folder}/labels.parquet").column(c).to_pylist() for c in ("doc_id", "quality")), strict=True))
    assert sorted(got) == sorted(docs)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert len(held) > 50 and np.mean([p == y for p, y in held]) > 0.95


def test_model_does_not_read_held_out_labels(spark):
    rows = [(i, f"word{i} and more text {i * i}" if i % 3 else "BUY!! NOW!! " * (i + 1), i % 3 > 0) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = langid.held_out(F.col("doc_id"), 4, 2)
    found = []
    for flip in (False, True):
        labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, quality int").withColumn(
            "quality", F.when(held & F.lit(flip), 1 - F.col("quality")).otherwise(F.col("quality")))
        described = quality.document_statistics(docs)
        model = quality.learn(described, labels.where(~held))
        found.append({r.doc_id: r.score for r in quality.score_documents(described, model).collect()})
    assert found[0] == pytest.approx(found[1]) and min(found[0].values()) < 0.3 < 0.9 < max(found[0].values())


def test_odd_rows_and_tables(spark, docs, nothing, corpus):
    labels = "doc_id long, quality int, text string"
    some = [(i, 1 - i % 2) for i in corpus if i < 40] + [(1, 1), (1, None), (None, 1), (2, 0), (99_999, 1)]
    taught = spark.createDataFrame([(*r, "x") for r in some], labels)
    described = quality.document_statistics(docs.unionByName(docs.where("doc_id = 5")).unionByName(docs.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long"))))
    got = quality.score_documents(described, quality.learn(described, taught)).collect()
    assert len(got) == len(corpus) + 2 and sum(r.doc_id is None for r in got) == 1 and all(0 <= r.score <= 1 for r in got)
    for few in ([], [(1, 1), (3, 1)]):
        model = quality.learn(described, spark.createDataFrame([(*r, "x") for r in few], labels))
        assert {r.score for r in quality.score_documents(described, model).collect()} == {(len(few) + 0.5) / (len(few) + 1)}
    none = quality.document_statistics(nothing)
    assert quality.score_documents(none, quality.learn(none, taught)).collect() == []
