import hashlib
import math
import random
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import langid

from . import brute

WORDS = {"en": "the of and thing with that there which".split(), "de": "der und ich nicht schön das einer werden".split()}


def table():
    rng = random.Random(12)
    rows = []
    for i in range(90):
        lang = ("en", "de")[i % 3 == 0]
        rows.append((i, " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "e", "en", "ing"]) for _ in range(rng.randrange(20, 90))), lang, None if i % 10 == 0 else f"s{i % 4}"))
    rows += [(100 + k, rows[k][1].replace(" ", "  ") if k % 2 else rows[k][1], "en", "s1") for k in range(8)]
    for k in range(8):
        parts = rows[20 + k][1].split()
        parts[len(parts) // 2] = "changed"
        rows.append((200 + k, " ".join(parts), "en", "s2"))
    return rows + [(300, None, "en", "s0"), (301, "", "de", None), (302, "12 34", None, "s3"), (303, "日本語の文章です。これは長い文です", "en", "s1")]


def grams(text):
    out = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        marked = f"\0{word}\0"
        out.update((word[i],) for i in range(len(word)))
        out.update((marked[i], marked[i + 1]) for i in range(len(marked) - 1))
        out.update(tuple(marked[i:i + 3]) for i in range(len(marked) - 2))
    # Between words one mark ends the one and begins the next.
    return out


def known_languages(rows):
    profiles = {}
    for i, text, lang, _ in rows:
        if lang and __import__("zlib").crc32(str(i).encode()) % 4 != 2:
            profiles.setdefault(lang, Counter()).update(grams(text or ""))
    ranks = {lang: {g: r for r, (g, _) in enumerate(c.most_common(langid.PROFILE))} for lang, c in profiles.items()}
    kept = []
    for row in rows:
        own = [g for g, _ in grams(row[1] or "").most_common(langid.TOP)]
        far = [sum(abs(r - p[g]) if g in p else langid.PROFILE for r, g in enumerate(own)) for p in ranks.values()]
        if own and 1 - min(far) / (langid.PROFILE * len(own)) >= langid.FLOOR:
            kept.append(row)
    return kept


def mix(rows):
    size = {i: len(brute.WORD.findall(t)) for i, t, _, _ in rows}
    names = sorted({s for *_, s in rows if s is not None}) + ([None] if any(s is None for *_, s in rows) else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total = {s: sum(size[i] for i, *_, x in rows if x == s) for s in names}
    target, left, live = {}, 1.5 * sum(total.values()), set(names)
    while live:
        level = left / sum(weight[s] for s in live)
        full = {s for s in live if level * weight[s] > 2 * total[s]}
        target |= {s: 2.0 * total[s] if full else level * weight[s] for s in full or live}
        left -= sum(target[s] for s in full)
        live = live - full if full else set()
    copies = {}
    for s in names:
        own = [i for i, *_, x in rows if x == s]
        whole = math.floor(target[s] / total[s]) if total[s] else 0
        want, pull = target[s] - whole * total[s], sum(size[i] * (1 + math.log1p(size[i])) for i in own)

        def odds(i, want=want, pull=pull):
            u = (int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            p = min(1 - 1e-9, max(1e-9, want * (1 + math.log1p(size[i])) / pull))
            return u / (1 - u) / (p / (1 - p))

        so_far = 0
        for i in sorted(own, key=odds):
            copies[i] = whole + int(want > 0 and so_far + size[i] / 2 <= want)
            so_far += size[i]
    return copies


def test_pipeline_equals_plain_python(spark, tmp_path):
    rows = table()
    spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    kept = known_languages(rows)
    owners = brute.exact([(i, t) for i, t, *_ in kept])
    kept = [r for r in kept if owners[r[0]][0] == r[0]]
    near = brute.near_components({i: t for i, t, *_ in kept})
    kept = [r for r in kept if near[r[0]][1] == r[0]]
    assert len(kept) < len(rows) - 12
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    text = {i: t for i, t, *_ in kept}
    for i, n in mix(kept).items():
        ids = library.encode(text[i], add_special_tokens=False).ids
        if n:
            want[(i, len(ids), brute.sha(" ".join(map(str, ids))))] = n
    assert got == want


def test_repeated_rows_and_null_identifiers(spark, tmp_path):
    rows = table()
    plain = [r for r in rows if r[0] < 40]
    near = [(None, f"{r[1]} changed", *r[2:]) for r in plain if len(r[1].split()) > 40][:5]
    # Rows as they stand, three times; without identifier, twice; one identifier for many texts; near copies without one.
    more = plain[:10] * 3 + [(None, *r[1:]) for r in plain[5:20]] * 2 + [(7, *r[1:]) for r in rows if 40 <= r[0] < 60] + [(None, *r[1:]) for r in rows if 60 <= r[0] < 80] + near
    df = spark.createDataFrame([(*r, None) for r in plain + more], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    texts = {"".join(r[1].split()) for r in rows if r[0] < 80}
    once = corpus_pipeline.exact_copies(spark, df, "")
    kept = [(r["doc_id"], "".join(r["text"].split())) for r in once.collect()]
    assert Counter(t for _, t in kept) == Counter(texts | {"".join(r[1].split()) for r in near})
    assert {(r[0], "".join(r[1].split())) for r in plain} <= set(kept)
    far = ["".join(r["text"].split()) for r in corpus_pipeline.near_copies(spark, once, "").collect()]
    assert Counter(far) == Counter(texts)
    size = Counter()
    for r in corpus_pipeline.source_mix(spark, once, "").collect():
        size[r["text"]] += 1
    assert max(size.values()) <= 2 and len(size) > len(texts) // 2
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(r["ids_sha256"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got and max(got.values()) <= 2 and len(got) <= len(texts)


def test_stages_keep_the_columns_of_documents(spark, nothing, docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for df in (docs, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, "").columns == columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "").count() == 0
