import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import fingerprints as fp

from . import brute


def selections(symbols, code):
    """Winnowing as described, from given symbol codes."""
    n = len(symbols)
    if n < fp.GRAM:
        return None
    grams = []
    for i in range(n - fp.GRAM + 1):
        h = 0
        for s in symbols[i:i + fp.GRAM]:
            h = (h * fp.BASE + code[s]) % fp.PRIME
        grams.append(h)
    out = []
    for i in range(max(1, len(grams) - fp.WINDOW + 1)):
        window = [(h, -(i + j)) for j, h in enumerate(grams[i:i + fp.WINDOW])]
        out.append(min(window))
    return list(dict.fromkeys((h, -p) for h, p in out))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = ["a", "bb", "the", "éa", "日", "x|y", "\U0001F600", "end."]
    out = {i * 3: " ".join(rng.choices(word, k=rng.randrange(0, 60))) for i in range(60)}
    out |= {1000: None, 1001: "", 1002: "   ", 1003: "one two", 1004: out[30], 1005: "a " * 40, 1006: "日本語" * 20}
    return out


def test_selection_is_rightmost_minimum(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    symbols = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(fp.SYMBOL), F.lit(0))
    rows = df.select("doc_id", symbols.alias("s"), F.transform(symbols, fp._short_hash).alias("c"), fp.winnow(F.col("text")).alias("w"),
                     fp.positions(fp.winnow(F.col("text"))).alias("p")).collect()
    for r in rows:
        want = selections(r["s"], dict(zip(r["s"], r["c"], strict=True)))
        got = [(w // fp.PLACES, p) for w, p in zip(r["w"], r["p"], strict=True)]
        if want is not None:
            assert got == want
        else:
            assert len(got) == min(1, len(r["s"]))


def test_edited_texts_and_likeness(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], "doc_id long, text string, range string, place int")
    rows = {r["doc_id"]: r for r in fp.edited_fingerprints(df).collect()}
    assert set(rows) == set(texts)
    want = brute.edited(texts)
    prints = {i: {x.split(":")[0] for x in r["fingerprint"].split()} for i, r in rows.items()}
    for i, r in rows.items():
        changed, following = want[i]
        assert r["n_chars"] == len(texts[i] or "") and r["edited_sha256"] == brute.sha(changed)
        both, every = prints[i] & prints[following], prints[i] | prints[following]
        assert r["near_next"] == pytest.approx(len(both) / len(every) if every else 1.0)
    assert rows[1004]["fingerprint"] == rows[30]["fingerprint"]
    assert rows[1000]["fingerprint"] == rows[1002]["fingerprint"] == ""


def test_shared_passage_is_found(spark):
    shared = " ".join(f"w{i}" for i in range(fp.GRAM + fp.WINDOW - 1))
    rng = random.Random(1)
    noise = lambda: " ".join(str(rng.random()) for _ in range(30))
    df = spark.createDataFrame([(k, f"{noise()} {shared} {noise()}") for k in range(5)], "doc_id long, text string")
    sets = [set(r[0]) for r in df.select(fp.hashes(fp.winnow(F.col("text")))).collect()]
    assert set.intersection(*sets)


def test_ranges_cover_every_order(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 3)
    ids = [0, 5, -4, 9, 10, 11, 12, 40, 1 << 40, -(1 << 50), 7, 8]
    df = spark.createDataFrame([(i, f"t{i} " * 5) for i in ids], "doc_id long, text string")
    rows = {r["doc_id"]: r["edited_sha256"] for r in fp.edited_fingerprints(df).collect()}
    assert rows == {i: brute.sha(e) for i, (e, _) in brute.edited({i: f"t{i} " * 5 for i in ids}).items()}


def test_empty_table_and_odd_identifiers(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fp.edited_fingerprints(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (None, None), (1, "x y z"), (1, "x y z")], "doc_id long, text string")
    assert fp.edited_fingerprints(odd).count() == 4
    single = spark.createDataFrame([(4, "abcdef")], "doc_id long, text string").transform(fp.edited_fingerprints).first()
    assert single["edited_sha256"] == brute.sha("abcdab")
