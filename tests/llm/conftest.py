import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, rep long, bucket string"
VOCABULARY = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def words(rng, n):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "s", "ed", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """doc_id -> text: copies, near copies, short, empty, null and long texts."""
    rng = random.Random(11)
    texts = {i: words(rng, rng.randrange(1, 120)) for i in range(40)}
    base = words(rng, 200)
    for k in range(12):  # variants of one text, of which some pairs lie just above and some just below the limit
        parts = base.split()
        for _ in range(k):
            parts[rng.randrange(len(parts))] = f"new{rng.randrange(999)}"
        texts[100 + k] = " ".join(parts)
    texts |= {200: None, 201: "", 202: " \n\t ", 203: texts[5], 204: texts[5].upper(), 205: texts[5].replace(" ", "\n  "), 206: texts[5],
              207: "one two three", 208: "One  two three", 209: "one two three four five", 210: words(rng, 30_000), 211: "é日本 \U0001F600 ß Σ"}
    return texts


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names the operators use inside, and nulls in them."""
    rows = [(i, t, None if i % 9 == 0 else "ab"[i % 2], None if i % 7 == 0 else f"s{i % 3}", None, "x", 1, None) for i, t in corpus.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
