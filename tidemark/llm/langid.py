"""Language identification by rank-order profiles (operator 6).

A profile lists the most frequent letter n-grams (one to three letters, words marked at both ends) by rank.
A text is given the language whose profile is nearest by out-of-place distance: the sum over the text's own
most frequent n-grams of the difference in rank, with the profile length for an n-gram the profile lacks
(after Cavnar and Trenkle).

Scale: n-grams are counted over all learning texts, combined in each task before the shuffle; the top of a language is
taken in salted parts first.  The model is languages x PROFILE rows, which do not grow with the data, and goes
to the tasks with the function.  Prediction is a map.

Defined cases: null texts and texts without a letter are `und` with score 0, as is everything when nothing could
be learned; equal distances go to the first language by code point; null languages are not learned from;
columns beside identifier, text and language are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrays import portions

PROFILE = 400
TOP = 300
SALTS = 64
HELD_GRAMS = 400_000
UNKNOWN = "und"
FLOOR = 0.05  # a text nearer to no profile than this share of the way is in no learned language
_PAIR, _ONE = np.uint64(1 << 63), np.uint64(3 << 62)
_STEP, _TWO = np.uint64(21), np.uint64(42)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram keys of a text, ascending, and their counts.

    A key packs up to three code points of 21 bits (0 marks a word end); the two top bits tell the length.
    """
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[code]
    padded = np.zeros(len(code) + 2, np.uint64)
    padded[1:-1] = np.where(letter, code, 0)
    keep = padded > 0
    keep[1:] |= padded[:-1] > 0
    keep[0] = True
    a = padded[keep]
    if len(a) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inner = a[1:-1] > 0
    keys = np.concatenate([a[a > 0] | _ONE, (a[:-1] << _STEP | a[1:]) | _PAIR,
                           (a[:-2] << _TWO | a[1:-1] << _STEP | a[2:])[inner]])
    keys.sort()
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[start], np.diff(np.append(start, len(keys)))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[start], np.add.reduceat(counts, start)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def rows():
        for lang, parts in held.items():
            keys, counts = _merge(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))],
                                             names=["lang", "gram", "n"])

    for batch in batches:
        for part in portions(batch, batch.schema.names[1]):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if text and len((found := grams(text))[0]):
                    held.setdefault(lang, []).append(found)
            held = {lang: [_merge(parts)] for lang, parts in held.items()}
            if sum(len(parts[0][0]) for parts in held.values()) > HELD_GRAMS:
                yield from rows()
                held = {}
    yield from rows()


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, list[int]]:
    """Language -> its PROFILE most frequent n-grams, most frequent first, ties by key."""
    counted = docs.where(F.col(lang).isNotNull()).select(F.col(lang), F.col(text)).mapInArrow(_count, "lang string, gram bigint, n bigint")
    total = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = (F.col("n").desc(), F.col("gram"))
    salted = Window.partitionBy("lang", F.pmod("gram", F.lit(SALTS))).orderBy(*order)
    first = total.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= PROFILE)
    best = first.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= PROFILE)
    profiles: dict[str, list[int]] = {}
    for row in sorted(best.select("lang", "r", "gram").collect()):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Ranks:
    """Ranks of every profiled n-gram in every language."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.names = sorted(profiles)
        lists = [np.array(profiles[n], np.int64).view(np.uint64) for n in self.names]
        self.keys = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)
        self.rank = np.full((len(lists), len(self.keys) + 1), -1, np.int64)
        for i, keys in enumerate(lists):
            self.rank[i, np.searchsorted(self.keys, keys)] = np.arange(len(keys))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, nearness (1: same ranks, 0: nothing shared) and lead over the second language."""
        keys, counts = grams(text or "")
        if not len(keys) or not self.names:
            return UNKNOWN, 0.0, 0.0
        own = keys[np.argsort(-counts, kind="stable")[:TOP]]
        at = np.searchsorted(self.keys, own)
        at[at == len(self.keys)] = 0
        at[self.keys[at] != own] = len(self.keys)
        rank = self.rank[:, at]
        far = np.where(rank < 0, PROFILE, np.abs(rank - np.arange(len(own)))).sum(axis=1) / (PROFILE * len(own))
        order = np.argsort(far, kind="stable")
        lead = far[order[1]] - far[order[0]] if len(order) > 1 else 1.0
        return self.names[order[0]], float(1 - far[order[0]]), float(lead)


def identify(docs: DataFrame, profiles: dict[str, list[int]], ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (nearness to the profile), lead."""
    def run(batches):
        ranks = Ranks(profiles)
        for batch in batches:
            found = [ranks.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                                              pa.array([f[2] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score", "lead"])

    return docs.select(F.col(ident).cast("bigint").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id bigint, lang_pred string, score double, lead double")


def held_out(ident: Column, parts: int, which: int) -> Column:
    """True where crc32 of the identifier in decimal leaves `which`; a null identifier is not held out."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % parts == which, F.lit(False))


def known_language(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text") -> DataFrame:
    """The rows whose text is in a learned language, all columns: neither `und` nor below FLOOR."""
    width = len(docs.columns)
    at = docs.columns.index(text)

    def run(batches):
        ranks = Ranks(profiles)
        for batch in batches:
            found = [ranks.predict(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([f[0] != UNKNOWN and f[1] >= FLOOR for f in found], pa.bool_()))

    assert width == len(set(docs.columns)), "column names must be unique"
    return docs.mapInArrow(run, docs.schema)
