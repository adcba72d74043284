"""Toxic passages by maximum-scoring segments (operator 5).

A word's score is its log-odds between toxic and other labelled documents, less a drift that makes the average word
negative.  The rate of a word has a Dirichlet prior: the rate of its longer prefix, that of the shorter one, and
so on down to the share of toxic documents, so unseen words take the rate of what they begin with.  One pass over a
text finds all maximal segments (after Ruzzo and Tompa).  Segment scores are put on one scale by the
extreme-value law of chance segments, lambda * S - ln(K * n), with lambda and K from the words of other documents;
a logistic curve over the best segment, the sum of all significant segments, the sum over distinct words and the length turns
them into a score.  Every occurrence of a word scores, so each passage is judged by its own words; what repeats add to a
document is weighed against the sum over distinct words.

Scale: counts are document counts per word and prefix, each under its own 64-bit hash (two of ten million share one with
probability below 1e-5), combined before the shuffle.  Rates are worked out prefix by prefix in joins.  The model
holds the words and prefixes whose log-odds are more than TOLERANCE from what it says of the next shorter prefix, sorted; of these
the MODEL_KEYS (12 bytes each) that change the scores of the learning texts most, |log-odds less the prefix's| times the documents that hold them, so
prefixes and frequent words first.  The others are scored by their prefix.  That is the capacity of the model, which does not grow with the
vocabulary; up to it every score is within TOLERANCE of the exact one.  Calibration works on a histogram of segment
scores over all labelled documents.  Labels are broadcast up to BROADCAST_LABELS rows, joined by a shuffle beyond.
Scoring is a map.

Defined cases: null and empty texts and texts without a letter have no segment and the score of such; very long texts are read whole, a portion at a time; null labels
are not learned from, of several labels of a document the largest counts; without labelled documents, or with one
class only, every score is the (smoothed) share of toxic ones; columns beside those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import hash_spans, mix, portions, spans_of
from tidemark.llm.langid import _letters
from tidemark.session import cut_lineage

PREFIXES = (3, 4, 5, 6, 8, 0)  # 0: the whole word
PRIOR = 8.0
DRIFT = 1.2
LEAST_RATE = 1e-4
CHANCE = 0.01  # expected segments by chance below which one is significant
MODEL_KEYS = 1 << 20
BROADCAST_LABELS = 5_000_000
TOLERANCE = 0.05  # of log-odds
STEP = 0.25  # bin of a segment score


@dataclass(frozen=True)
class Model:
    """Log-odds of words and prefixes (keys ascending), the chance law, and the weights of the logistic curve."""

    base: float
    key: bytes
    odds: bytes
    scale: float = 1.0
    size: float = 0.1
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0, 0.0)


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points, begin and end of every lower-cased word, and where each text's words begin."""
    lowered = [t.lower() for t in texts]
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    bounds = np.cumsum([0, *map(len, lowered)])
    begin, end = spans_of(_letters()[code], bounds)
    return code, begin, end, np.searchsorted(begin, bounds)


def _keys(code: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Key of every word at each prefix length, with the words that are long enough."""
    for level, size in enumerate(PREFIXES):
        long = np.flatnonzero(end - begin > size)
        stop = begin[long] + size if size else end
        yield mix(hash_spans(code, begin[long], stop) ^ np.uint64((level + 1) * 0x1ED270B9E3779B1)).view(np.int64), long


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per word and prefix of a portion: toxic ones and all, with the level and the key of the next shorter prefix."""
    for batch in batches:
        for part in portions(batch, batch.schema.names[1]):
            label = np.asarray(part.column(0), np.int64)
            code, begin, end, first = _words([t or "" for t in part.column(1).to_pylist()])
            _, some, kind = np.unique(hash_spans(code, begin, end), return_index=True, return_inverse=True)
            pairs = np.unique(np.repeat(np.arange(len(label)), np.diff(first)) << 32 | kind)
            owner, word = pairs >> 32, pairs & 0xFFFFFFFF
            before, has = np.zeros(len(some), np.int64), np.zeros(len(some), bool)
            for level, (key, long) in enumerate(_keys(code, begin[some], end[some])):
                if not len(key):
                    continue
                own, at, back = np.unique(key, return_index=True, return_inverse=True)
                place = np.full(len(some), -1)
                place[long] = back
                held = place[word] >= 0
                pair = np.unique(owner[held] << 32 | place[word[held]])
                which, bad = pair & 0xFFFFFFFF, label[pair >> 32] == 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), level, np.int32)), pa.array(own), pa.array(before[long[at]], mask=~has[long[at]]),
                     pa.array(np.bincount(which[bad], minlength=len(own))), pa.array(np.bincount(which, minlength=len(own)))],
                    names=["level", "key", "parent", "toxic", "seen"])
                before[long], has[long] = key, True


def _odds(counted: DataFrame, base: float) -> DataFrame:
    """key, rate, odds, kept and held of every word and prefix: its exact log-odds, whether the model needs them, and what it says then.

    A word has its longest prefix as parent, a prefix the next shorter one; the first have the share of toxic documents.
    """
    start = float(np.log(base / (1 - base)))
    done = None
    for level in range(len(PREFIXES)):
        rows = counted.where(F.col("level") == level)
        if done is None:
            rows = rows.withColumn("_rate", F.lit(base)).withColumn("_held", F.lit(start))
        else:
            rows = rows.join(done.select(F.col("key").alias("parent"), F.col("rate").alias("_rate"), F.col("held").alias("_held")), "parent", "left")
            rows = rows.withColumn("_rate", F.coalesce("_rate", F.lit(base))).withColumn("_held", F.coalesce("_held", F.lit(start)))
        rate = (F.col("toxic") + F.lit(PRIOR) * F.col("_rate")) / (F.col("seen") + F.lit(PRIOR))
        safe = F.least(F.greatest(F.col("rate"), F.lit(LEAST_RATE)), F.lit(1 - LEAST_RATE))
        rows = rows.withColumn("rate", rate).withColumn("odds", F.log(safe / (1 - safe))).withColumn("kept", F.abs(F.col("odds") - F.col("_held")) > TOLERANCE)
        rows = rows.withColumn("effect", F.abs(F.col("odds") - F.col("_held")) * F.col("seen"))
        rows = cut_lineage(rows.select("key", "rate", "odds", "kept", "effect", F.when(F.col("kept"), F.col("odds")).otherwise(F.col("_held")).alias("held")))
        done = rows if done is None else done.unionByName(rows)
    return done


def most_telling(odds: DataFrame, keys: int) -> DataFrame:
    """The rows that the model needs, at most `keys`: those whose effect is above a cut found from a histogram of its logarithm."""
    needed = odds.where("kept").withColumn("_bin", F.floor(F.log2("effect") * 64))
    above, cut = 0, None
    # As many bins as there are 64ths of octaves between the effects.
    for row in sorted(needed.groupBy("_bin").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        above += row["n"]
        if above > keys:
            cut = row["_bin"]
            break
    return (needed if cut is None else needed.where(F.col("_bin") > cut)).drop("_bin")


def word_scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score of every word, where each text's words begin, where they begin and end, and whether a word is the first of its kind in its text."""
    known, odds = np.frombuffer(model.key, np.int64), np.frombuffer(model.odds, np.float32)
    code, begin, end, first = _words(texts)
    _, some, kind = np.unique(hash_spans(code, begin, end), return_index=True, return_inverse=True)
    start = float(np.log(model.base / (1 - model.base)))
    found = np.full(len(some), start)
    for key, long in _keys(code, begin[some], end[some]) if len(known) else ():
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        same = known[at] == key
        found[long[same]] = odds[at[same]]
    score = (found - start - DRIFT)[kind]
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    fresh = np.zeros(len(begin), bool)
    fresh[np.unique(owner << 32 | kind, return_index=True)[1]] = True
    return score, first, np.stack([begin, end]), fresh


def maximal_segments(score: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments as (score, first word, end), in linear time.

    Runs of scores of one sign are taken together: only positive runs can begin or end a segment.  An entry of the stack points to the nearest
    one below it that starts lower, so a search skips what earlier ones skipped; where none starts lower, all of the stack is final.
    """
    up = score > 0
    if not up.any():
        return []
    total = np.append(0.0, np.cumsum(score, dtype=np.float64))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], up.view(np.int8), [0]))))
    found: list[tuple[float, float, int, int, int]] = []
    stack: list[tuple[float, float, int, int, int]] = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        low, high = float(total[a]), float(total[b])
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= low:
                j = stack[j][4]
            if j < 0:
                found += stack
                stack = [(low, high, a, b, -1)]
                break
            if stack[j][1] >= high:
                stack.append((low, high, a, b, j))
                break
            low, _, a, _, below = stack[j]
            del stack[j:]
            j = below
    return [(high - low, a, b) for low, high, a, b, _ in found + stack]


def significant(model: Model, score: float, words: int) -> bool:
    """Fewer than CHANCE segments of this score are expected by chance in a text of so many words."""
    return model.size * words * np.exp(-model.scale * score) < CHANCE


def _evidence(model: Model, texts: list[str]) -> Iterator[tuple[float, float, float, int]]:
    """Best segment, sum of the significant segments, sum over distinct words, number of words; for each text."""
    score, first, _, fresh = word_scores(model, texts)
    distinct = np.where(fresh & (score > 0), score, 0.0)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        found = [s for s, _, _ in maximal_segments(score[a:b])]
        yield max(found, default=0.0), sum(s for s in found if significant(model, s, b - a)), float(distinct[a:b].sum()), b - a


def _bins(best: float, total: float, distinct: float, n: int) -> tuple[int, int, int, int]:
    return round(best / STEP), round(np.log1p(total) / STEP), round(np.log1p(distinct) / STEP), int(n).bit_length()


def _features(scale: float, size: float, bins: np.ndarray) -> np.ndarray:
    """Constant, best segment above chance, log of all evidence, log of that of distinct words, log length; `bins` has a row for each of _bins."""
    best, total, distinct, n = bins[0] * STEP, bins[1] * STEP, bins[2] * STEP, 2.0 ** (bins[3] - 0.5)
    length = np.log(np.maximum(n, 1))
    return np.stack([np.ones(len(best)), scale * best - np.log(size) - length, total, distinct, length], axis=1)


def _chance(values: np.ndarray, counts: np.ndarray) -> tuple[float, float]:
    """lambda with E[exp(lambda s)] = 1 over the words of other documents, and the constant K of the law.

    K follows from the share of words that begin a chance segment: with few positive words it is near
    (1 - E[exp(lambda s); s > 0] / 2) times that share.
    """
    p = counts / counts.sum()
    if not (values > 0).any() or not (p[values > 0] > 0).any():
        return 1.0, 0.1
    low, high = 1e-6, 1.0
    while (p * np.exp(high * values)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (p * np.exp(middle * values)).sum() < 1 else (low, middle)
    up = p[values > 0].sum()
    return high, max(1e-9, float(up * (1 - 0.5 * min(1.0, (p * np.exp(high * values))[values > 0].sum()))))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, ...]:
    """Weights of a slightly shrunk logistic regression with y toxic of n documents at each x."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    mean[0], spread[0] = 0.0, 1.0
    z = (x - mean) / np.where(spread > 0, spread, 1.0)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (y - n * p) - 1e-2 * w
        hessian = (z * (n * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    w = w / np.where(spread > 0, spread, 1.0)
    w[0] -= (w[1:] * mean[1:]).sum()
    return tuple(w.tolist())


def learn(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Model from the documents that have a label."""
    known = labels.where(F.col(label).isNotNull() & F.col(ident).isNotNull()).groupBy(F.col(ident).alias("_labelled")).agg(F.max(label).alias("_y"))
    if labels.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    taught = docs.join(known, F.col(ident) == F.col("_labelled")).select(F.col("_y").cast("bigint").alias("y"), F.col(text).alias("text"))
    share = labels.agg(F.sum((F.col(label) == 1).cast("int")).alias("a"), F.count(label).alias("n")).first()
    base = ((share["a"] or 0) + 0.5) / (share["n"] + 1.0)
    counted = cut_lineage(taught.mapInArrow(_count, "level int, key bigint, parent bigint, toxic bigint, seen bigint").groupBy("level", "key").agg(
        F.first("parent").alias("parent"), F.sum("toxic").alias("toxic"), F.sum("seen").alias("seen")))
    told = most_telling(_odds(counted, base), MODEL_KEYS).select("key", F.col("odds").cast("float")).toArrow().sort_by("key")
    rates = [np.asarray(told.column(c).combine_chunks()).tobytes() for c in ("key", "odds")]
    model = Model(base, *rates)

    def chance(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often each score occurs among the words of other documents."""
        found: dict[int, int] = {}
        for batch in batches:
            for part in portions(batch.filter(pc.equal(batch.column(0), 0)), "text"):
                score = word_scores(model, [t or "" for t in part.column(1).to_pylist()])[0]
                for s, c in zip(*(v.tolist() for v in np.unique(np.round(score / STEP).astype(int), return_counts=True)), strict=True):
                    found[s] = found.get(s, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], names=["score", "n"])

    words = taught.mapInArrow(chance, "score int, n bigint").groupBy("score").agg(F.sum("n").alias("n")).toPandas().sort_values("score")
    scale, size = _chance(words["score"].to_numpy() * STEP, words["n"].to_numpy().astype(float)) if len(words) else (1.0, 0.1)
    model = Model(base, *rates, scale, size)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, ...], int] = {}
        for batch in batches:
            for part in portions(batch, "text"):
                texts = [t or "" for t in part.column(1).to_pylist()]
                for y, told in zip(part.column(0).to_pylist(), _evidence(model, texts), strict=True):
                    key = (y, *_bins(*told))
                    found[key] = found.get(key, 0) + 1
        keys = list(found)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int32()) for i in range(5)), pa.array([found[k] for k in keys], pa.int64())],
                                         names=[*keyed, "n"])

    keyed = ["y", "best", "total", "distinct", "size"]
    cells = taught.mapInArrow(measure, ", ".join(f"{k} int" for k in keyed) + ", n bigint").groupBy(*keyed).agg(F.sum("n").alias("n"))
    seen = cells.toPandas().sort_values(keyed)
    if not len(seen):
        return Model(base, *rates, weights=(float(np.log(base / (1 - base))), 0.0, 0.0, 0.0, 0.0))
    x = _features(scale, size, seen[keyed[1:]].to_numpy().T)
    n = seen["n"].to_numpy().astype(float)
    return Model(base, *rates, scale, size, _logistic(x, n * (seen["y"].to_numpy() == 1), n))


def score_documents(docs: DataFrame, model: Model, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted, best_segment (score of the best passage)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, batch.schema.names[1]):
                told = list(_evidence(model, [t or "" for t in part.column(1).to_pylist()]))
                x = _features(model.scale, model.size, np.array([_bins(*e) for e in told], float).T)
                p = 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array([e[0] for e in told], pa.float64())],
                                                 names=["doc_id", "score", "predicted", "best_segment"])

    return docs.select(F.col(ident).cast("bigint").alias("doc_id"), F.col(text)).mapInArrow(
        run, "doc_id bigint, score double, predicted int, best_segment double")


def passages(docs: DataFrame, model: Model, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, begin, end (code points of the lower-cased text), score: every significant segment."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, batch.schema.names[1]):
                texts = [t or "" for t in part.column(1).to_pylist()]
                score, first, span, _ = word_scores(model, texts)
                start = np.cumsum([0, *(len(t.lower()) for t in texts)])
                out = [(i, span[0, a + f] - start[k], span[1, a + e - 1] - start[k], s)
                       for k, (i, a, b) in enumerate(zip(part.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True))
                       for s, f, e in maximal_segments(score[a:b]) if significant(model, s, b - a)]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([int(o[1]) for o in out], pa.int64()),
                                                  pa.array([int(o[2]) for o in out], pa.int64()), pa.array([float(o[3]) for o in out], pa.float64())],
                                                 names=["doc_id", "begin", "end", "score"])

    return docs.select(F.col(ident).cast("bigint").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id bigint, begin bigint, end bigint, score double")
