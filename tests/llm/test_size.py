"""Behaviour that only shows on very long words and texts, and with bounds set low."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import boosting, bpe, exact, minhash, mixing, pii, token_counts, toxicity

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


# --- toxic segments ---------------------------------------------------------------------
def segments_by_recursion(score, start=0):
    """Maximal segments by definition: the best one, then those to its left and right."""
    total = np.append(0.0, np.cumsum(score))
    best, at = 0.0, None
    for i in range(len(score)):
        for j in range(i + 1, len(score) + 1):
            if total[j] - total[i] > best + 1e-12:
                best, at = total[j] - total[i], (i, j)
    if at is None:
        return []
    i, j = at
    return [*segments_by_recursion(score[:i], start), (round(best, 9), start + i, start + j), *segments_by_recursion(score[j:], start + j)]


@pytest.mark.parametrize("drift", [-0.6, -0.1, 0.1])
def test_segments_equal_the_definition(drift):
    for seed in range(40):
        score = np.random.default_rng(seed).normal(drift, 1, 30)
        assert [(round(s, 9), a, b) for s, a, b in toxicity.maximal_segments(score)] == segments_by_recursion(score)


@pytest.mark.parametrize("down", [-1.5, -1.0, -0.5])
def test_segments_take_linear_time(down):
    score = np.where(np.arange(200_000) % 2 == 0, 1.0, down) + np.random.default_rng(1).normal(0, 0.01, 200_000)
    start = time.process_time()
    assert toxicity.maximal_segments(score)
    assert time.process_time() - start < 2


def test_model_keeps_the_most_telling_keys(spark):
    odds = spark.range(1, 1001).selectExpr("id AS key", "cast(id AS double) AS effect", "id % 2 = 0 AS kept")
    kept = [r.key for r in toxicity.most_telling(odds, 100).collect()]
    assert 80 <= len(kept) <= 100 and min(kept) >= 800 and all(k % 2 == 0 for k in kept)
    assert toxicity.most_telling(odds, 500).count() == 500


# --- token counts -----------------------------------------------------------------------
def texts():
    rng = random.Random(2)
    special = "<|endoftext|>"
    yield from ("x" * 400, "ab" * 300 + " tail", "é日" * 150, " " * 90, "\n\n  \n word", "a  b   c\n\nd \n e", "don't we'll 're 'S x's", "!!!???...", "12345678901234567890 1",
                f"foo!{special}bar  {special} {special}", f"  {special[:-2]}", special * 3, "!" * 60 + special, "'" * 9 + "ll'l")
    for _ in range(25):
        yield "".join(rng.choice([" ", "  ", "\n", "a", "the", "'ll", "'", "é", "1", "!", special, special[:5], " ", "ing"]) for _ in range(40))


def test_counts_equal_the_library_at_every_prefix():
    library, own = Tokenizer.from_file(BYTE_BPE), token_counts.PrefixCounter(BYTE_BPE)
    for text in texts():
        ends, sums = next(own.tables([text]))
        sizes = list(range(len(text) + 1))
        want = [len(e.ids) for e in library.encode_batch([text[:n] for n in sizes])]
        assert [own.at_prefix(text, n, ends, sums) for n in sizes] == want, text
        random.Random(len(text)).shuffle(sizes)
        assert [own.at_prefix(text, n, ends, sums) for n in sizes] == [want[n] for n in sizes], text


def test_cut_inside_a_long_word_reads_kept_counts():
    own = token_counts.PrefixCounter(BYTE_BPE)
    rng = random.Random(1)
    word = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    ends, sums = next(own.tables([word]))
    start = time.process_time()
    for budget in (256, 512, 1024, 4096):
        size = own.longest_within(word, budget, ends, sums)
        assert own.at_prefix(word, size, ends, sums) <= budget < own.at_prefix(word, size + 1, ends, sums)
    assert time.process_time() - start < 3


# --- BPE --------------------------------------------------------------------------------
def test_long_words_are_merged_like_short_ones(monkeypatch):
    own, library = bpe.WordBpe(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    rng = random.Random(3)
    words = ["".join(rng.choice("aeinst") for _ in range(n)) for n in (3, 40, 200, 700, 2000)] + ["a" * 999, "ab" * 400, "é" * 300]
    for ids, word in zip(own.merge(words), words, strict=True):
        assert ids.tolist() == library.encode(word, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "LONG_WORD", 1)
    for ids, slow in zip(own.merge(words), own.merge_rounds(words), strict=True):
        assert ids.tolist() == slow.tolist()


def test_one_very_long_word_is_quick():
    own = bpe.WordBpe(WORD_BPE)
    own.merge(["a" * 600])
    word = "".join(random.Random(4).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40_000))
    start = time.process_time()
    own.merge([word])
    assert time.process_time() - start < 1.5


# --- exact dedup ------------------------------------------------------------------------
@pytest.mark.parametrize("limit", [1, 5000, 1 << 30])
def test_spilled_tries_hold_every_key(limit):
    rng = random.Random(5)
    shared = b"one common beginning "
    keys = [shared * rng.randrange(3) + bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(600)] + [b"", shared, b"z" * 9000]
    trie, want = exact.PatriciaTrie(limit), {}
    for n, key in enumerate(keys):
        owner = (-rng.randrange(3), n, 1)
        trie.insert(key, owner)
        want[key] = exact.better(want[key], owner) if key in want else owner
    found = list(trie.items())
    assert len(found) == len(want) and dict(found) == want


def test_short_keys_count_their_objects():
    trie = exact.PatriciaTrie(1 << 20)
    for i in range(5000):
        trie.insert(f"{i:010}".encode(), (0, i, 1))
    assert trie.spilled and len(list(trie.items())) == 5000


# --- personal data ----------------------------------------------------------------------
def test_sample_ignores_identifiers_and_repeats(spark):
    rows = [(None, f"call +1 555 000 {1000 + i} or mail a{i}@b.org today") for i in range(400)] + [(7, "the same +1 555 123 4567 x@y.org")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.learn(docs, sample_docs=100)
    other = pii.learn(docs.withColumn("doc_id", docs["doc_id"] + 1).repartition(3), sample_docs=100)
    assert model.cut == other.cut
    got = pii.find_spans(docs, model).collect()
    assert len(got) == 900 and sum(r.doc_id is None for r in got) == 400


def test_examples_of_a_document_are_bounded():
    text = " ".join(f"+1 555 000 {i:04}" for i in range(3000))
    found = list(pii.examples(1, text))
    assert len(found) > pii.MOST_EXAMPLES == len(pii.few(found, 12345)) and pii.few(found[:3], 1) == found[:3]


def test_written_out_addresses_are_taken_whole():
    local, host = "a.very-long_local+part" * 9, ".".join(["sub" * 30] * 12)
    text = f"write to {local} [at] {host} now"
    start = text.index(local)
    assert ("email", start, start + len(f"{local} [at] {host}")) in pii.candidates(text)


# --- near duplicates and mix: rows without identifiers ------------------------------------
def test_rows_without_identifier_are_grouped(spark):
    same = " ".join(f"w{i}" for i in range(60))
    near = same.replace("w59", "other")
    alone = " ".join(f"v{i}" for i in range(30))
    rows = [(3, same), (None, near), (None, alone), (None, alone), (9, "one two"), (None, None)]
    got = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str)
    assert found == sorted([(3, 56, 3, True), (None, 56, 3, False), (None, 26, None, True), (None, 26, None, False), (9, 1, 9, True), (None, 0, None, True)], key=str)


def test_equal_identifiers_draw_apart(spark):
    rows = [(None if i % 3 else 7, "word " * 10, "s") for i in range(600)] + [(1000 + i, "word " * 10, "t") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs.repartition(4), weights=(1, 1), share=1.25).collect()
    again = mixing.mix_sources(docs.repartition(3), weights=(1, 1), share=1.25).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == 900
    for source in "st":
        part = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 10 and all(r.taken <= 20 for r in part)
    taken = {i: {r.copies for r in got if r.source == "s" and r.doc_id == i} for i in (None, 7)}
    assert all(len(v) > 1 for v in taken.values())  # not all or none


def test_pii_trees_see_every_example(spark, monkeypatch):
    text = " ".join(f"+1 555 000 {i:04}" for i in range(60))
    rows = [(i, f"mail a{i}@b.org or call {text}" if i % 2 else f"version {i}.{i + 1} of 2021-03-04") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = {r.doc_id: r.id for r in docs.selectExpr("doc_id", "xxhash64(text) AS id").collect()}
    got = pii.counted_examples(docs).agg({"n": "sum"}).first()[0]
    assert got == sum(len(list(pii.examples(ids[i], t))) for i, t in rows) > 40 * pii.MOST_EXAMPLES
    here = pii.learn(docs)
    monkeypatch.setattr(pii, "IN_MEMORY", 0)
    monkeypatch.setattr(pii, "fit", lambda *a: boosting.fit(*a, rounds=2))
    there = pii.learn(docs)
    for a, b in zip(here.trees.trees, there.trees.trees):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.allclose(a.leaf, b.leaf)
