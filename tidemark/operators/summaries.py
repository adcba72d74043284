"""Median, mean and spread of every feature in every training set, without a row per value.

A row belongs to any number of training sets (`sets`, an array of set numbers), so folds, samples and whole eras are summarised
together.  Each pass reduces a task's rows to vectors per set (counts, sums, extremes, bracket counts), which are added per set.  Medians are
exact: the bracket that holds the middle ranks is cut into BINS until it holds few values, and those are looked at.  Two passes and a last
look at the bracket are enough unless a bracket of 1 / BINS of the range holds more than GATHER values of a set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.shipping import ship

BINS = 256
GATHER = 1 << 16
DEEPEST = 6  # cuts after which a bracket is as narrow as two doubles


@dataclass(frozen=True)
class SetStats:
    """Statistics of one training set: per feature median of the finite values (0 if none), mean and SD after filling; rows per class of each label."""

    n: int
    median: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    classes: np.ndarray  # labels x (negatives, positives)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (np.where(np.isfinite(x), x, self.median) - self.mean) / self.sd


def feature_matrix(column: pa.Array) -> np.ndarray:
    """Rows x features, NaN for null; all rows have the same number of features."""
    rows, flat = len(column), np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(rows, len(flat) // rows) if rows else np.zeros((0, 0))


def members(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(set, its rows) for the sets of a batch."""
    owner = np.repeat(np.arange(len(column)), np.asarray(column.value_lengths().fill_null(0)))
    which = np.asarray(column.flatten())
    order = np.argsort(which, kind="stable")
    which, owner = which[order], owner[order]
    cuts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(which)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield int(which[a]), owner[a:b]


def _per_set(rows: DataFrame, measure: Callable[[int, np.ndarray, np.ndarray], dict[str, np.ndarray]]) -> dict[int, dict[str, np.ndarray]]:
    """Vectors of every set, measured per batch and merged: names that begin with 'min' or 'max' by extremes, others by sums."""
    def merge(a: dict[str, np.ndarray] | None, b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        if a is None:
            return b
        how = {"min": np.minimum, "max": np.maximum}
        return {k: how.get(k[:3], np.add)(a[k], b[k]) for k in a}

    def rows_of(found: dict[int, dict[str, np.ndarray]]) -> pa.RecordBatch:
        flat = [(s, k, v.ravel()) for s, vectors in found.items() for k, v in vectors.items()]
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], pa.string()),
                                           pa.array([f[2] for f in flat], pa.list_(pa.float64()))], names=["set", "name", "v"])

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, dict[str, np.ndarray]] = {}
        for batch in batches:
            x, y = feature_matrix(batch.column("x")), feature_matrix(batch.column("ys"))
            for s, own in members(batch.column("sets")):
                found[s] = merge(found.get(s), measure(s, x[own], y[own]))
        yield rows_of(found)

    def together(table: pa.Table) -> pa.Table:
        total: dict[int, dict[str, np.ndarray]] = {}
        for s, name, v in zip(*(table.column(c).to_pylist() for c in ("set", "name", "v")), strict=True):
            total[s] = {**total.get(s, {}), name: merge({name: total[s][name]}, {name: np.array(v)})[name] if name in total.get(s, {}) else np.array(v)}
        return pa.Table.from_batches([rows_of(total)])

    kind = "set int, name string, v array<double>"
    out: dict[int, dict[str, np.ndarray]] = {}
    for s, name, v in rows.mapInArrow(local, kind).groupBy("set").applyInArrow(together, kind).collect():
        out.setdefault(s, {})[name] = np.array(v)
    return out


def _bins(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bin of each value between the bounds of its feature; NaN goes to bin 0."""
    width = np.where(high > low, high - low, 1.0)
    with np.errstate(invalid="ignore"):
        place = np.nan_to_num(np.floor((x - low) / width * BINS), nan=0.0)
    return np.clip(place, 0, BINS - 1).astype(np.int64)


class _Bracket:
    """Where a set's middle ranks lie: for each cut the bounds of every feature and the bins that were kept."""

    def __init__(self, low: np.ndarray, high: np.ndarray, n: np.ndarray):
        self.cuts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.low, self.high, self.n = low, high, n
        self.below, self.inside = np.zeros(len(n)), n.copy()

    def holds(self, x: np.ndarray) -> np.ndarray:
        ok = np.isfinite(x)
        for low, high, first, last in self.cuts:
            at = _bins(x, low, high)
            ok &= (at >= first) & (at <= last)
        return ok

    def histogram(self, x: np.ndarray) -> np.ndarray:
        ok, at = self.holds(x), _bins(x, self.low, self.high)
        feature = np.broadcast_to(np.arange(x.shape[1]), x.shape)
        return np.bincount((feature * BINS + at)[ok], minlength=x.shape[1] * BINS).astype(float)

    def narrow(self, counts: np.ndarray) -> None:
        counts = counts.reshape(-1, BINS)
        upto = np.cumsum(counts, axis=1)
        ranks = [np.maximum((self.n - 1) // 2, 0) - self.below, np.maximum(self.n // 2, 0) - self.below]
        first, last = (np.minimum((upto <= r[:, None]).sum(axis=1), BINS - 1) for r in ranks)
        every = np.arange(len(counts))
        before = upto[every, first] - counts[every, first]
        self.cuts.append((self.low, self.high, first, last))
        self.below, self.inside = self.below + before, upto[every, last] - before
        width = (self.high - self.low) / BINS
        self.low, self.high = self.low + first * width, self.low + (last + 1) * width


def set_statistics(rows: DataFrame) -> dict[int, SetStats]:
    """Statistics of every set of rows (sets array<int>, x array<double>, ys array<double>); sets without rows are absent."""
    ship(rows.sparkSession)

    def first_look(s: int, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        ok = np.isfinite(x)
        return {"n": np.array([float(len(x))]), "finite": ok.sum(axis=0, dtype=float), "sum": np.where(ok, x, 0.0).sum(axis=0),
                "min": np.where(ok, x, np.inf).min(axis=0), "max": np.where(ok, x, -np.inf).max(axis=0),
                "classes": np.stack([(y == 0).sum(axis=0), (y == 1).sum(axis=0)], axis=1).astype(float).ravel()}

    seen = _per_set(rows, first_look)
    bracket = {s: _Bracket(np.where(v["finite"] > 0, v["min"], 0.0), np.where(v["finite"] > 0, v["max"], 0.0), v["finite"]) for s, v in seen.items()}
    centre = {s: v["sum"] / np.maximum(v["finite"], 1) for s, v in seen.items()}

    def counted(s: int, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        away = np.where(np.isfinite(x), x - centre[s], 0.0)
        return {"bins": bracket[s].histogram(x), "squares": (away * away).sum(axis=0)}

    squares: dict[int, np.ndarray] = {}
    for _ in range(DEEPEST):
        found = _per_set(rows, counted)
        for s, v in found.items():
            squares.setdefault(s, v["squares"])
            bracket[s].narrow(v["bins"])
        if all((b.inside <= GATHER).all() for b in bracket.values()):
            break
    medians = _middle_values(rows, bracket)
    out = {}
    for s, v in seen.items():
        n, finite = v["n"][0], v["finite"]
        missing = n - finite
        mean = (v["sum"] + missing * medians[s]) / n
        spread = np.sqrt((squares[s] + finite * (centre[s] - mean) ** 2 + missing * (medians[s] - mean) ** 2) / n)
        out[s] = SetStats(int(n), medians[s], mean, np.where(spread > 1e-12, spread, 1.0), v["classes"].reshape(-1, 2))
    return out


def _middle_values(rows: DataFrame, bracket: dict[int, _Bracket]) -> dict[int, np.ndarray]:
    """Medians from the values inside the brackets, each distinct value of a task once with its count."""
    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_matrix(batch.column("x"))
            out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
            for s, own in members(batch.column("sets")):
                held = bracket[s].holds(x[own])
                for j in np.flatnonzero(held.any(axis=0)):
                    out.append((s, int(j), *np.unique(x[own][held[:, j], j], return_counts=True)))
            yield pa.RecordBatch.from_arrays([
                pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.list_(pa.float64())),
                pa.array([o[3] for o in out], pa.list_(pa.int64()))], names=["set", "pos", "v", "n"])

    def pick(table: pa.Table) -> pa.Table:
        s, j = table.column("set")[0].as_py(), table.column("pos")[0].as_py()
        v = np.asarray(table.column("v").combine_chunks().flatten())
        order = np.argsort(v)
        upto = np.cumsum(np.asarray(table.column("n").combine_chunks().flatten())[order]) + bracket[s].below[j]
        n = bracket[s].n[j]
        low, high = (v[order][min(int(np.searchsorted(upto, r, "right")), len(v) - 1)] for r in ((n - 1) // 2, n // 2))
        return pa.table({"set": pa.array([s], pa.int32()), "pos": pa.array([j], pa.int32()), "median": pa.array([(low + high) / 2], pa.float64())})

    out = {s: np.zeros(len(b.n)) for s, b in bracket.items()}
    gathered = rows.mapInArrow(local, "set int, pos int, v array<double>, n array<bigint>").groupBy("set", "pos").applyInArrow(pick, "set int, pos int, median double")
    for s, j, median in gathered.collect():
        out[s][j] = median
    return out


def stats_frame(spark, stats: dict[int, SetStats], sets: Sequence[int]) -> DataFrame:
    """(set, pos, median, mean, sd) rows."""
    rows = [(s, j, float(m), float(a), float(d)) for s in sets if s in stats
            for j, (m, a, d) in enumerate(zip(stats[s].median, stats[s].mean, stats[s].sd, strict=True))]
    return spark.createDataFrame(rows, "set int, pos int, median double, mean double, sd double")
