"""Quality by a regularised quadratic discriminant (operator 13).

A document is described by the statistics in STATISTICS: logarithms of lengths and of smoothed shares of kinds of characters, words and
lines.  Each class has a mean and a covariance of them.  A class covariance is shrunk towards the pooled one and then towards a multiple
of the identity (after Friedman), on statistics scaled by their pooled spread; its Cholesky factor is kept, so a log density is one
triangular product.  The difference of the log densities of the two classes, half the difference of squared Mahalanobis distances and of log
determinants, goes through asinh and a logistic curve, which makes it a probability.

The amounts of shrinkage are chosen, and the curve is fitted, by cross-validation: folds come from a digest of the text, so copies share a
fold, and the moments of the other folds are the total less the fold's own.

Scale: texts are read once; their statistics are written (eight bytes each) and read three times.  Moments are summed in each
task, then by Spark; the driver gets, per class and fold, one number per pair of statistics, and per setting of the shrinkage a histogram of
scores.  The model has a fixed size.  Scoring is a map.

Defined cases: null texts count as empty; empty texts have the statistics of no words and a score like any other; very long texts are read
whole, a portion at a time; null labels are not learned from, of several labels of a document the largest counts; a repeated row is a further
document; without labelled documents, or with one class only, every score is the smoothed share of label 1; an empty table
gives no rows; columns beside those named are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import hash_spans, mix, portions, spans_of
from tidemark.session import cut_lineage

STATISTICS = (
    "characters", "words", "letters a word", "capitals", "digits", "marks", "symbols", "words in capitals", "words with symbols",
    "words of signs only", "words said twice running", "words said before", "words a line", "lines said before", "letters beyond ASCII",
    "longest word", "capitalised words",
)
FOLDS = 5
CLASSES = (0, 1)
#: Shrinkage towards the pooled covariance, and of that towards the identity.
SETTINGS = tuple((pooled, round_) for pooled in (0.0, 0.1, 0.3, 0.6) for round_ in (0.001, 0.03, 0.2))
STEP = 0.05  # bin of asinh of a score
THRESHOLD = 0.7
_LOWER, _UPPER, _DIGIT, _WHITE, _MARK, _SYMBOL = range(6)
_MARKS = ".,;:?'\"-()"


@cache
def _kinds() -> np.ndarray:
    """Kind of every code point."""
    kind = np.full(0x110000, _SYMBOL, np.uint8)
    for c in range(0x110000):
        group = unicodedata.category(chr(c))
        if group[0] in "LM":
            kind[c] = _UPPER if group in ("Lu", "Lt") else _LOWER
        elif group[0] == "N":
            kind[c] = _DIGIT
        elif group[0] == "Z" or 9 <= c <= 13:
            kind[c] = _WHITE
        elif c > 127 and group[0] == "P":
            kind[c] = _MARK
    kind[[ord(c) for c in _MARKS]] = _MARK
    return kind


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log((part + 0.5) / (whole + 1.0))


def statistics(texts: list[str]) -> np.ndarray:
    """One row per text, one column per name in STATISTICS."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    bounds = np.cumsum([0, *map(len, texts)])
    kind = _kinds()[code]
    upto = {k: np.append(0, np.cumsum(kind == k)) for k in (_LOWER, _UPPER, _DIGIT, _MARK, _SYMBOL)}
    upto["far"] = np.append(0, np.cumsum((code > 127) & (kind <= _UPPER)))
    count = {k: c[bounds[1:]] - c[bounds[:-1]] for k, c in upto.items()}
    letters, signs = count[_LOWER] + count[_UPPER], count[_MARK] + count[_SYMBOL]

    begin, end = spans_of(kind != _WHITE, bounds)
    first = np.searchsorted(begin, bounds)
    owner, n_words = np.repeat(np.arange(len(texts)), np.diff(first)), np.diff(first)
    inside = {k: c[end] - c[begin] for k, c in upto.items()}
    word_letters = inside[_LOWER] + inside[_UPPER]
    of_text = lambda flag: np.bincount(owner[flag], minlength=len(texts))
    same = hash_spans(code, begin, end)
    twice = np.zeros(len(same), bool)
    twice[1:] = (same[1:] == same[:-1]) & (owner[1:] == owner[:-1])
    n_distinct = _distinct(same, owner, len(texts))
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, owner, end - begin)

    line_begin, line_end = spans_of(code != 10, bounds)
    line_owner = np.searchsorted(bounds, line_begin, "right") - 1
    n_lines = np.bincount(line_owner, minlength=len(texts))
    distinct_lines = _distinct(hash_spans(code, line_begin, line_end), line_owner, len(texts))

    chars = letters + count[_DIGIT] + signs
    return np.stack([
        np.log1p(chars), np.log1p(n_words), np.log((letters + 1.0) / (n_words + 1.0)), _share(count[_UPPER], letters), _share(count[_DIGIT], chars),
        _share(count[_MARK], chars), _share(count[_SYMBOL], chars), _share(of_text((inside[_UPPER] > 1) & (inside[_LOWER] == 0)), n_words),
        _share(of_text((inside[_SYMBOL] > 0) & (word_letters > 0)), n_words), _share(of_text(word_letters + inside[_DIGIT] == 0), n_words),
        _share(of_text(twice), n_words), _share(n_words - n_distinct, n_distinct), np.log((n_words + 1.0) / (n_lines + 1.0)),
        _share(n_lines - distinct_lines, n_lines), _share(count["far"], letters), np.log1p(longest),
        _share(of_text((kind[begin] == _UPPER) & (inside[_LOWER] > 0)), n_words),
    ], axis=1)


def _distinct(value: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Distinct values of each text."""
    pair = mix(value ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    return np.bincount(owner[np.unique(pair, return_index=True)[1]], minlength=texts)


@dataclass(frozen=True)
class Moments:
    """Rows, sum and sum of outer products of a class."""

    n: float
    total: np.ndarray
    outer: np.ndarray

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.total - other.total, self.outer - other.outer)

    def scatter(self) -> np.ndarray:
        return self.outer - np.outer(self.total, self.total) / max(self.n, 1.0)


@dataclass(frozen=True)
class Discriminant:
    """Mean and inverse Cholesky factor of each class, log determinants, and the curve; without classes only the share of label 1."""

    share: float
    means: tuple[np.ndarray, ...] = ()
    factors: tuple[np.ndarray, ...] = ()
    logdets: tuple[float, ...] = ()
    slope: float = 0.0
    level: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdets, strict=True)]
        return density[1] - density[0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.arcsinh(self.difference(x)) + self.level, -30, 30)))


def discriminant(moments: dict[int, Moments], pooled: float, rounded: float) -> Discriminant | None:
    """Shrunk discriminant of the two classes; None if one has no rows."""
    if any(c not in moments or moments[c].n < 1 for c in CLASSES):
        return None
    scatter = {c: moments[c].scatter() for c in CLASSES}
    n = sum(moments[c].n for c in CLASSES)
    spread = np.sqrt(np.maximum(np.diag(sum(scatter.values())) / n, 1e-6))
    common = sum(scatter.values()) / n / np.outer(spread, spread)
    means, factors, logdets = [], [], []
    for c in CLASSES:
        own = scatter[c] / moments[c].n / np.outer(spread, spread)
        mixed = (1 - pooled) * own + pooled * common
        mixed = (1 - rounded) * mixed + rounded * max(np.trace(mixed) / len(mixed), 1e-3) * np.eye(len(mixed))
        lower = np.linalg.cholesky(mixed)
        means.append(moments[c].total / moments[c].n)
        factors.append(np.linalg.inv(lower) / spread)
        logdets.append(float(2 * np.log(np.diag(lower)).sum()))
    return Discriminant(moments[1].n / n, tuple(means), tuple(factors), tuple(logdets))


def curve(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Slope (not negative), level and mean loss of the logistic curve with y of n documents at each z."""
    design = np.stack([z, np.ones_like(z)], axis=1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (y - n * p) - 1e-3 * w)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    w[0] = max(w[0], 0.0)
    p = np.clip(1 / (1 + np.exp(-np.clip(design @ w, -30, 30))), 1e-9, 1 - 1e-9)
    return float(w[0]), float(w[1]), float(-(y * np.log(p) + (n - y) * np.log(1 - p)).sum() / n.sum())


def document_statistics(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fold (from the content) and x, the statistics of every document."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "_text"):
                x = statistics([t or "" for t in part.column(2).to_pylist()])
                flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), flat], names=["doc_id", "fold", "x"])

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(ident).cast("bigint").alias("doc_id"), F.pmod(F.xxhash64(body), F.lit(FOLDS)).cast("int").alias("fold"), body.alias("_text"))
    return rows.mapInArrow(run, "doc_id bigint, fold int, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, len(STATISTICS)))


def learn(described: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Discriminant from a table of `document_statistics` and (doc_id, label) rows."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_labelled")).agg(
        F.max((F.col(label) == 1).cast("int")).alias("y"))
    taught = cut_lineage(described.join(known, F.col("doc_id") == F.col("_labelled")).select("y", "fold", "x"))
    per_fold = _moments(taught)
    total = {c: _added([m for (y, _), m in per_fold.items() if y == c]) for c in CLASSES if any(y == c for y, _ in per_fold)}
    rows = {c: total[c].n if c in total else 0.0 for c in CLASSES}
    share = (rows[1] + 0.5) / (rows[0] + rows[1] + 1.0)
    if len(total) < 2:
        return Discriminant(share)
    models = {}
    for k in range(FOLDS):
        others = {c: total[c] - per_fold[c, k] if (c, k) in per_fold else total[c] for c in CLASSES}
        for s, setting in enumerate(SETTINGS):
            models[k, s] = discriminant(others, *setting)
    tried = _histograms(taught, models)
    found = {s: curve(*tried[s]) for s in tried}
    if not found:
        return Discriminant(share)
    best = min(found, key=lambda s: (found[s][2], s))
    whole = discriminant(total, *SETTINGS[best])
    return Discriminant(share, whole.means, whole.factors, whole.logdets, *found[best][:2])


def _added(parts: list[Moments]) -> Moments:
    return Moments(sum(m.n for m in parts), sum(m.total for m in parts), sum(m.outer for m in parts))


def _moments(taught: DataFrame) -> dict[tuple[int, int], Moments]:
    """Moments of each class and fold; a row per class, fold and pair of statistics reaches the driver."""
    width = len(STATISTICS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            y, fold, x = np.asarray(batch.column(0)), np.asarray(batch.column(1)), _matrix(batch.column(2))
            x = np.hstack([np.ones((len(x), 1)), x])
            for key in set(zip(y.tolist(), fold.tolist(), strict=True)):
                some = x[(y == key[0]) & (fold == key[1])]
                sums[key] = sums.get(key, 0.0) + some.T @ some
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                                          pa.array([sums[k].ravel() for k in keys], pa.list_(pa.float64()))], names=["y", "fold", "sums"])

    added = taught.mapInArrow(run, "y int, fold int, sums array<double>").select("y", "fold", F.posexplode("sums").alias("at", "v")).groupBy(
        "y", "fold", "at").agg(F.sum("v").alias("v"))
    out: dict[tuple[int, int], np.ndarray] = {}
    for y, fold, at, v in added.collect():
        out.setdefault((y, fold), np.zeros((width + 1) ** 2))[at] = v
    squares = {k: v.reshape(width + 1, width + 1) for k, v in out.items()}
    return {k: Moments(float(m[0, 0]), m[0, 1:], m[1:, 1:]) for k, m in squares.items()}


def _histograms(taught: DataFrame, models: dict[tuple[int, int], Discriminant | None]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per setting: bins of the score, documents with label 1 and documents in each, every document scored without its fold."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            y, fold, x = np.asarray(batch.column(0)), np.asarray(batch.column(1)), _matrix(batch.column(2))
            for (k, s), model in models.items():
                some = fold == k
                if model is None or not some.any():
                    continue
                bins, at = np.unique(np.round(np.arcsinh(model.difference(x[some])) / STEP).astype(int), return_inverse=True)
                counts = np.stack([np.bincount(at, y[some]), np.bincount(at)], axis=1)
                for b, count in zip(bins.tolist(), counts, strict=True):
                    seen[s, b] = seen.get((s, b), 0) + count
        counts = np.array(list(seen.values()), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.int32()),
                                          pa.array(counts[:, 0]), pa.array(counts[:, 1])], names=["setting", "bin", "y", "n"])

    cells = taught.mapInArrow(run, "setting int, bin int, y bigint, n bigint").groupBy("setting", "bin").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    table = cells.toPandas().sort_values(["setting", "bin"])
    return {int(s): (g["bin"].to_numpy() * STEP, g["y"].to_numpy(float), g["n"].to_numpy(float)) for s, g in table.groupby("setting")}


def score_documents(described: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, score, predicted of a table of `document_statistics`."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.probability(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return described.select("doc_id", "x").mapInArrow(run, "doc_id bigint, score double, predicted int")
