import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import exact, minhash

from . import brute


def test_exact_groups(docs, corpus):
    want = brute.exact(corpus.items())
    rows = exact.exact_groups(docs).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in rows)


def test_exact_with_repeated_rows_and_null_identifiers(spark):
    rows = [(None, "a b"), (3, "ab"), (3, "ab"), (2, "a  b"), (None, None), (None, "")]
    got = exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in got) == [
        (-1, -1, 2, True), (-1, -1, 2, True), (-1, 2, 4, False), (2, 2, 4, True), (3, 2, 4, False), (3, 2, 4, False)]


def test_empty_tables(nothing):
    assert exact.exact_groups(nothing).count() == 0
    assert minhash.near_groups(nothing).count() == 0


def test_trie_splits_edges_and_spills():
    keys = {b"": 1, b"a": 2, b"abc": 3, b"abd": 4, b"b" * 300: 5, b"b" * 299 + b"c": 6, b"cc": 7, b"zz" * 400: 8}
    for limit in (10, 400, 1 << 20):
        trie = exact.PatriciaTrie(limit)
        for _ in range(2):
            for key, ident in keys.items():
                trie.insert(key, (-1, ident, 1))
        assert dict(trie.items()) == {k: (-1, i, 2) for k, i in keys.items()}


def test_kept_documents_have_all_columns(docs, corpus):
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, _, _ in brute.exact(corpus.items()).values()}


def test_near_groups(docs, corpus):
    rows = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_groups(docs).collect()}
    assert rows == brute.near_components(corpus)


def test_near_groups_with_null_and_repeated_identifiers(spark):
    rows = [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (1, "A B C D E F"), (5, None)]
    got = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in got), key=str) == [(1, 1, True), (2, 1, False), (2, 1, False), (5, 5, True), (None, 1, False)]


def test_shingle_sets_and_full_sketches(corpus):
    texts = list(corpus.values())
    values, first = minhash.shingle_sets(pa.array(texts, pa.string()))
    assert np.diff(first).tolist() == [len(brute.shingles(t)) for t in texts]
    filled = minhash.sketches(values, first) != np.uint64(2**64 - 1)
    assert (filled.all(axis=1) == (np.diff(first) > 0)).all()


def test_sketch_estimates_likeness():
    rng = np.random.default_rng(2)
    common, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (900, 150, 150))
    sets = [np.unique(np.append(common, a)), np.unique(np.append(common, b))]
    one, two = minhash.sketches(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]), 2048)
    assert abs((one == two).mean() - 900 / 1200) < 0.05


def test_links_that_only_the_second_comparison_finds(spark):
    """Members that fail against their hub are linked to each other through what lies outside it."""
    def text(parts):
        return " ".join(f"{p}{i}" for p, a, b in parts for i in range(a, b))

    rows = {1: text([("h", 0, 400)])}
    rows |= {10 + k: text([("h", 0, 300), ("r", 0, 90 + k)]) for k in range(3)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    pairs = spark.createDataFrame([(1, k) for k in rows if k != 1], "hub long, member long")
    checked = minhash.compared(pairs, df)
    assert minhash.linked(checked).count() == 0
    label = spark.createDataFrame([], "node long, component long")
    found = {(r["hub"], r["member"]) for r in minhash.possible_pairs(checked, label).collect()}
    assert found == {(10, 11), (10, 12), (11, 12)}


def test_near_dedup_holds_few_shingles_at_once_whatever_the_batch(monkeypatch):
    import tracemalloc

    from tidemark.llm import arrays

    rng = np.random.default_rng(4)
    texts = [" ".join(map(str, rng.integers(0, 10**6, 600).tolist())) for _ in range(1000)]
    ids = list(range(1000))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], names=["doc_id", "text"])
    pairs = pa.RecordBatch.from_arrays([pa.array([0] * 1000), pa.array(ids), pa.array(texts)], names=["hub", "member", "text"])
    whole = {}
    for name, run, rows in (("sign", minhash._sign, batch), ("compare", minhash._compare, pairs)):
        for limit in (minhash.SET_BYTES, 1 << 30):
            monkeypatch.setattr(minhash, "SET_BYTES", limit)
            monkeypatch.setattr(arrays, "_powers", {})
            tracemalloc.start()
            whole[name, limit] = [r for b in run([rows]) for r in b.to_pylist()]
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            assert limit == 1 << 30 or peak < 160e6, (name, peak)
        monkeypatch.undo()
        assert len(whole[name, 1 << 30]) == (1000 if name == "sign" else 999)
        assert whole[name, minhash.SET_BYTES] == whole[name, 1 << 30]


def test_pipeline_stages_hand_texts_over_in_small_batches(spark):
    import corpus_pipeline

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    try:
        corpus_pipeline.prepare(spark)
        docs = spark.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("abc "), 1000).alias("text"))
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n bigint").collect()
        assert len(sizes) >= 3 and max(r["n"] for r in sizes) < 6_000_000
    finally:
        spark.conf.set(name, was)
