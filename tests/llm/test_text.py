import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, langid, mixing, pii, token_counts, toxicity

from . import brute

WORD_BPE, BYTE_BPE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def test_bpe_equals_the_library(docs, corpus):
    library = Tokenizer.from_file(WORD_BPE)
    encoded = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in corpus.items()}
    rows = {r["doc_id"]: r for r in bpe.encode_decode(docs, WORD_BPE).collect()}
    for i, ids in encoded.items():
        assert rows[i]["ids"] == ids
        assert rows[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
    for r in bpe.encoding_digests(docs, WORD_BPE).collect():
        ids = encoded[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), brute.sha(" ".join(map(str, ids))))
        assert r["decoded_sha256"] == brute.sha(library.decode(ids, skip_special_tokens=False))


def test_bpe_special_strings_and_repeats():
    library, own = Tokenizer.from_file(WORD_BPE), bpe.WordBpe(WORD_BPE)
    texts = ["a<|endoftext|>B <|startoftext|>", "aaaa aaaaaaa don't 12", "\x1cΑΣ İ\x85x", "<|endoftext", "\0<|endoftext|>\0"]
    for text, row in zip(texts, own.encode(texts), strict=True):
        assert [int(i) for w in row for i in w[1].split()] == library.encode(text, add_special_tokens=False).ids


def test_token_counts_equal_the_library(docs, corpus):
    library = Tokenizer.from_file(BYTE_BPE)
    for r in token_counts.token_counts(docs, BYTE_BPE, limit=50).collect():
        text = corpus[r["doc_id"]] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 50)
        if n > 50:
            assert len(library.encode(text[:r["limit_chars"]]).ids) <= 50 < len(library.encode(text[:r["limit_chars"] + 1]).ids)
        else:
            assert r["limit_chars"] == len(text)


def test_a_full_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO", 20)
    own, library = token_counts.PrefixCounter(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    for part in range(3):
        texts = [" ".join(f"{w}{i}{part}" for i in range(40)) for w in ("some", "new", "words")]
        for text, matches in zip(texts, own.split_all(texts), strict=True):
            ends, sums = own.table(matches)
            assert sums[-1] == len(library.encode(text).ids)
            assert len(library.encode(text[:own.longest_within(text, 30, ends, sums)]).ids) <= 30


def test_every_prefix_is_counted_exactly():
    library, own = Tokenizer.from_file(BYTE_BPE), token_counts.PrefixCounter(BYTE_BPE)
    rng = random.Random(3)
    parts = ["a", "the", "é", "日", " ", "\n", "'", "s", "<|endoftext|>", "<|", "11", "--", "==", "\xa0", "ing", "\U0001F600", "r", "e"]
    for _ in range(40):
        text = "".join(rng.choice(parts) for _ in range(30))
        table = next(own.tables([text]))
        for size in range(len(text) + 1):
            assert own.at_prefix(text, size, *table) == len(library.encode(text[:size]).ids), text[:size]
    word = b" internationalization"
    assert own.prefixes(word) == [len(library.encode(word[:i].decode()).ids) for i in range(len(word) + 1)]


def test_language_by_profiles(spark, nothing):
    rng = random.Random(4)
    kinds = {"aa": "the of and thing with that".split(), "bb": "der und ich nicht schön das".split()}
    rows = [(i, " ".join(rng.choices(kinds[k], k=40)), k) for i, k in enumerate(["aa", "bb"] * 60)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !", "aa"), (903, "日本語の文章です", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = langid.held_out(F.col("doc_id"), 4, 2)
    profiles = langid.learn_profiles(df.where(~held))
    assert sorted(profiles) == ["aa", "bb"] and all(len(p) <= langid.PROFILE for p in profiles.values())
    found = {r["doc_id"]: r for r in langid.identify(df, profiles).collect()}
    assert all(found[i]["lang_pred"] == k and 0 <= found[i]["score"] <= 1 for i, _, k in rows[:120])
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (900, 901, 902))
    assert {r["doc_id"] for r in langid.known_language(df, profiles).collect()} == {i for i, _, _ in rows[:120]}
    assert {r["doc_id"]: r["h"] for r in df.select("doc_id", held.alias("h")).collect()} == {
        i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    assert langid.learn_profiles(nothing) == {} and langid.identify(df, {}).where("lang_pred <> 'und'").count() == 0


def test_profile_ranks_by_hand():
    keys, counts = langid.grams("aab a")
    assert counts.sum() == 4 + 6 + 4  # letters, pairs with word ends, triples around a letter
    top = keys[np.argsort(-counts, kind="stable")]
    ranks = langid.Ranks({"x": top.view(np.int64).tolist()})
    assert ranks.predict("aab a") == ("x", 1.0, 1.0)


def test_mix_targets_and_copies(docs, corpus, nothing):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(corpus)
    totals = {}
    for r in rows:
        assert r["size"] == len(brute.WORD.findall(corpus[r["doc_id"]] or "")) and r["taken"] in (0, r["size"], 2 * r["size"])
        t = totals.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        t[0] += r["size"]
        t[1] += r["taken"]
    order = sorted((s for s in totals if s is not None)) + [None]
    weight = dict(zip(order, [3, 1, 2, 3], strict=True))
    left, open_, level = 1.5 * sum(t[0] for t in totals.values()), set(order), {}
    while open_:
        full = {s for s in open_ if left * weight[s] / sum(weight[o] for o in open_) > 2 * totals[s][0]}
        if not full:
            level |= {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
            break
        level |= {s: 2.0 * totals[s][0] for s in full}
        left -= sum(level[s] for s in full)
        open_ -= full
    for s, (size, taken, target, told) in totals.items():
        assert told == size and target == pytest.approx(level[s])
        largest = max(r["size"] for r in rows if r["source"] == s)
        assert abs(taken - target) <= max(largest, 1)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    assert mixing.mix_sources(nothing).count() == 0


def test_pareto_chances_follow_appeal(spark):
    df = spark.range(4000).select(F.col("id").alias("ident"), F.lit("s").alias("source"), F.lit(10).cast("bigint").alias("size"),
                                  F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("appeal"))
    plan = spark.createDataFrame([("s", 40000, 10000.0)], "source string, total long, target double")
    taken = mixing.pareto_mix(df, plan).where("copies = 1")
    even = taken.where("ident % 2 = 0").count()
    assert taken.count() == 1000 and abs(even - 750) < 60


def test_base_spans_by_the_fixed_patterns():
    import re

    rng = random.Random(8)
    parts = ["a.b@x.y.z", "@", "ab", ".", "1.2.3.4", "300.1.1.1", "4111 1111-1111 1111", "+1 (234) 555-0199", "+", "7" * 13, " ", "-", "é", "x@y", ".5.6.7"]

    def slow(text):
        out = []
        rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                 "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
        for kind, rule in rules.items():
            for m in re.finditer(rule, text):
                digits = re.sub(r"[^0-9]", "", m.group())
                if (kind == "email" or kind == "ip" and max(map(int, m.group().split("."))) <= 255
                        or kind == "card" and 12 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15):
                    out.append((kind, m.start(), m.end()))
        return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))

    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert pii.base_spans(text) == slow(text), text
    assert pii.base_spans("7" * 300_000 + "a" * 300_000) == []


def test_pii_query_adds_other_writings(spark, nothing):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        filler = " ".join(rng.choice(["some", "words", "stand", "here", "at", "dot"]) for _ in range(8))
        data = rng.choice([f"user{i}@mail.example.com", f"10.{i % 256}.3.{rng.randrange(256)}", "4111 1111 1111 1111", f"+1 (555) {rng.randrange(100, 999)}-1234", str(rng.randrange(10**15, 10**16))])
        rows.append((i, f"{filler} {data} {filler}"))
    rows += [(1000, None), (1001, ""), (1002, "write to someone (at) mail (dot) example (dot) com please"), (1003, "version 2.0 of 2021-03-04")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.learn(df)
    found = {r["doc_id"]: r for r in pii.find_spans(df, model).collect()}
    for i, t in rows:
        base = pii.base_spans(t or "")
        assert [found[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert found[i]["base_sha256"] == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(found[i]["spans"].split(","))
    assert found[1002]["spans"].startswith("email:9:") and found[1003]["spans"] == ""
    assert pii.learn(nothing).trees is None and pii.find_spans(nothing, model).count() == 0
    assert "@" not in pii.redact(df.where("doc_id = 0 or text like '%@%'"), model).where("text like '%@mail%'").select("text").collect().__repr__()


def test_pii_numbers_side_by_side(spark):
    for text, kind, wanted in (("call 555-123-4567 555-765-4321 now", "phone", ["555-123-4567", "555-765-4321"]),
                               ("4111.1111.1111.1111 03/27", "card", ["4111.1111.1111.1111"]), ("4111 1111 1111 1111 12/27", "card", ["4111 1111 1111 1111"]),
                               ("7 (555) 123-4567", "phone", ["(555) 123-4567"])):
        assert set(wanted) <= {text[a:b] for k, a, b in pii.candidates(text) if k == kind}
    assert len(pii.candidates("1 2 " * 5000)) <= 20 * 10_000
    rng = random.Random(4)
    rows = [(i, f"some words {rng.choice(['', 'and then '])}+1 {rng.randrange(200, 999)} {rng.randrange(100, 999)} {rng.randrange(1000, 9999)} or 4111 1111 1111 1111 stand here") for i in range(300)]
    model = pii.learn(spark.createDataFrame(rows, "doc_id long, text string"))
    for text, wanted in (("some words 4111.1111.1111.1111 03/27 stand here", "4111.1111.1111.1111"),
                         ("some words 555-123-4567 555-765-4321 stand here", "555-123-4567")):
        assert wanted in [text[a:b] for _, a, b in model.added(text, pii.base_spans(text))]
    # A kind with few held-out positives takes the threshold of all kinds.
    cut = pii._cuts(np.array([0] * 40 + [1] * 3), np.array([2.0] * 40 + [3.0] * 3), np.ones(43))
    assert cut[0] == cut[1] == 2.0


def toxic_table(spark):
    rng = random.Random(6)
    calm = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        text = rng.choices(calm, k=60)
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["nasty", "vile", "ugly"]) + rng.choice(["", "ness", "ly"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(2000, None), (2001, ""), (2002, "1 2 3")]
    labels += [(5000, 1), (3, None), (None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(spark, nothing):
    docs, labels = toxic_table(spark)
    held = langid.held_out(F.col("doc_id"), 5, 0)
    model = toxicity.learn(docs, labels.where(~held))
    rows = {r["doc_id"]: r for r in toxicity.score_documents(docs, model).collect()}
    out = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([rows[i]["predicted"] == int(i % 6 == 0) for i in out]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    assert rows[2000]["score"] == rows[2001]["score"] == rows[2002]["score"] < 0.5
    spans = toxicity.passages(docs.where("doc_id = 6"), model).collect()
    text = docs.where("doc_id = 6").first()["text"]
    assert spans and all(any(w in text[s["begin"]:s["end"]] for w in ("nasty", "vile", "ugly")) for s in spans)
    bare = toxicity.learn(docs, labels.where("false"))
    assert {r["predicted"] for r in toxicity.score_documents(docs, bare).collect()} <= {0, 1}
    assert toxicity.score_documents(nothing, model).count() == 0


def test_every_toxic_passage_is_judged_by_its_own_words(spark):
    docs, labels = toxic_table(spark)
    model = toxicity.learn(docs, labels)
    calm = " ".join(f"word{k}" for k in range(60))
    dense = "nasty vile ugly nastyness vileness"
    texts = [f"{calm} {dense} {calm} {dense} {calm}",  # the same words again
             f"nasty {calm} vile {calm} ugly {calm} nastyness {calm} vileness {calm} {dense} {calm}"]  # alone first
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r["doc_id"], texts[r["doc_id"]][r["begin"]:r["end"]], r["begin"]) for r in toxicity.passages(df, model).collect()}
    assert {(0, dense, len(calm) + 1), (0, dense, 2 * len(calm) + len(dense) + 3), (1, dense, texts[1].index(dense))} <= found
    best = {r["doc_id"]: r["best_segment"] for r in toxicity.score_documents(df, model).collect()}
    assert abs(best[0] - best[1]) < 1e-9


def test_toxicity_words_do_not_share_counts(spark):
    # Two million words of clean documents fill any table of 2^20 cells: their counts stay apart from those of the toxic word.
    letters = str.maketrans("0123456789", "abcdefghij")
    rows = [(i, " ".join(f"{k:07d}" for k in range(i * 20_000, (i + 1) * 20_000)).translate(letters)) for i in range(100)]
    rows += [(200 + i, "zugwort") for i in range(6)]
    labels = spark.createDataFrame([(i, int(i >= 200)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    base = 6.5 / 107
    rate = base
    for _ in range(5):  # zug, zugw, zugwo, zugwor, zugwort
        rate = (6 + toxicity.PRIOR * rate) / (6 + toxicity.PRIOR)
    got = toxicity.word_scores(model, ["zugwort"])[0]
    assert abs(got[0] - (np.log(rate / (1 - rate)) - np.log(base / (1 - base)) - toxicity.DRIFT)) < 1e-5


def test_toxicity_keeps_what_it_learned_of_clean_words(spark):
    rows = [(i, "giftig böse") for i in range(30)] + [(100 + i, "giftpflanze garten") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id long, toxic int"))
    base = 30.5 / 331

    def exact(word):
        rate = base
        for size in [*(n for n in (3, 4, 5, 6, 8) if len(word) > n), 99]:
            alike = [i for i, t in rows for w in t.split() if w[:size] == word[:size] and (size == 99 or len(w) > size)]
            rate = (sum(i < 100 for i in alike) + toxicity.PRIOR * rate) / (len(alike) + toxicity.PRIOR)
        rate = min(max(rate, toxicity.LEAST_RATE), 1 - toxicity.LEAST_RATE)
        return np.log(rate / (1 - rate)) - np.log(base / (1 - base)) - toxicity.DRIFT

    words = ["giftpflanze", "garten", "giftig", "böse"]
    got = toxicity.word_scores(model, [" ".join(words)])[0]
    assert got[0] < -toxicity.DRIFT - 2 and got[2] > 1
    assert np.abs(got - [exact(w) for w in words]).max() < toxicity.TOLERANCE + 1e-5


def test_maximal_segments_against_brute_force():
    rng = random.Random(7)

    def slow(score):
        best, where = 0.0, None
        for a in range(len(score)):
            for b in range(a + 1, len(score) + 1):
                if sum(score[a:b]) > best + 1e-9:
                    best, where = sum(score[a:b]), (a, b)
        if where is None:
            return []
        a, b = where
        return slow(score[:a]) + [(best, a, b)] + [(s, x + b, y + b) for s, x, y in slow(score[b:])]

    for _ in range(200):
        score = [rng.choice([-3, -2, -1, 1, 2, 4]) + rng.random() / 7 for _ in range(rng.randrange(14))]
        got = toxicity.maximal_segments(np.array(score))
        assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in slow(score)]


def test_digest_of_nothing():
    assert brute.sha("") == hashlib.sha256(b"").hexdigest()
