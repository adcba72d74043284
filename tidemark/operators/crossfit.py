"""Logistic regressions of many training sets, labels and settings in one run, and their scores in one scan.

A fit is (training set, label, setting).  All fits take their Newton steps together: a pass over the rows adds up loss, gradient and
Hessian of every fit, the group of a fit solves its step, and only coefficients come back.  A step that does not lower the loss is halved.
Rows are scaled by the statistics of the fit's own training set.  The objective is that of an L2 penalty of strength C:
sum of weighted losses + |w|^2 / (2 C), the intercept free.

Scoring reads each row once: it meets all models that apply to it, and one row per (model, row) comes out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import hash_int, join_groups
from tidemark.functions.ranked import numbered
from tidemark.operators.summaries import SetStats, feature_matrix, members, set_statistics
from tidemark.session import cut_lineage
from tidemark.shipping import ship

TOLERANCE = 1e-9
HALVINGS = 30


@dataclass(frozen=True)
class Fit:
    """Training set, position of the label in `ys`, penalty and class weights."""

    set: int
    label: int
    C: float = 1.0
    balanced: bool = False
    max_iter: int = 100


@dataclass(frozen=True)
class Scorer:
    """A fitted model on the scale of its training set; `beta` ends with the intercept."""

    beta: np.ndarray
    stats: SetStats

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.stats.scaled(x) @ self.beta[:-1] + self.beta[-1])))

    def coefficients(self) -> np.ndarray:
        """Coefficients and intercept for unscaled, filled features."""
        own = self.beta[:-1] / self.stats.sd
        return np.append(own, self.beta[-1] - (own * self.stats.mean).sum())


def _class_weights(fit: Fit, stats: SetStats) -> tuple[float, float]:
    if not fit.balanced:
        return 1.0, 1.0
    n = stats.classes[fit.label]
    return tuple(float(n.sum() / (2 * k)) for k in n)


def _sums(beta: np.ndarray, z: np.ndarray, y: np.ndarray, weight: tuple[float, float]) -> np.ndarray:
    """Loss, gradient and Hessian of the data term, as one vector; z ends with a column of ones."""
    score = z @ beta
    p, w = 1 / (1 + np.exp(-np.clip(score, -500, 500))), np.where(y == 1, weight[1], weight[0])
    loss = (w * (np.logaddexp(0, score) - y * score)).sum()
    return np.concatenate([[loss], z.T @ (w * (p - y)), ((z * (w * p * (1 - p))[:, None]).T @ z).ravel()])


def _step(fit: Fit, beta: np.ndarray, total: np.ndarray) -> tuple[float, np.ndarray]:
    """Penalised loss at beta, and the point that the Newton step leads to."""
    width = len(beta)
    free = np.append(np.ones(width - 1), 0.0) / fit.C
    gradient = total[1:width + 1] + free * beta
    hessian = total[width + 1:].reshape(width, width) + np.diag(free + 1e-12)
    return float(total[0] + 0.5 * (free * beta * beta).sum()), beta - np.linalg.solve(hessian, gradient)


def solve(rows: DataFrame, fits: Sequence[Fit], stats: dict[int, SetStats]) -> dict[int, Scorer]:
    """Position of a fit -> its model; fits whose rows hold one class only are left out.

    `rows` have sets, x and ys as in `set_statistics` and are read once per Newton step, by all fits that are not done.
    """
    able = {i: f for i, f in enumerate(fits) if f.set in stats and (stats[f.set].classes[f.label] > 0).all()}
    here = {i: np.zeros(len(stats[f.set].median) + 1) for i, f in able.items()}
    best: dict[int, tuple[float, np.ndarray]] = {}
    steps = dict.fromkeys(able, 0)
    halved = dict.fromkeys(able, 0)
    ship(rows.sparkSession)
    while here:
        for i, loss, ahead in _round(rows, able, stats, here):
            ahead = np.array(ahead)
            if i in best and loss > best[i][0] + 1e-12 * abs(best[i][0]) and halved[i] < HALVINGS:
                here[i] = (best[i][1] + here[i]) / 2
                halved[i] += 1
                continue
            best[i] = (loss, here[i])
            steps[i], halved[i] = steps[i] + 1, 0
            if np.abs(ahead - here[i]).max() < TOLERANCE * (1 + np.abs(ahead).max()) or steps[i] >= able[i].max_iter:
                best[i] = (loss, ahead)
                del here[i]
            else:
                here[i] = ahead
    return {i: Scorer(best[i][1], stats[f.set]) for i, f in able.items()}


def _round(rows: DataFrame, fits: dict[int, Fit], stats: dict[int, SetStats], here: dict[int, np.ndarray]) -> list:
    of_set: dict[int, list[int]] = {}
    for i in here:
        of_set.setdefault(fits[i].set, []).append(i)
    weight = {i: _class_weights(fits[i], stats[fits[i].set]) for i in here}

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x, ys = feature_matrix(batch.column("x")), feature_matrix(batch.column("ys"))
            for s, own in members(batch.column("sets")):
                if s not in of_set:
                    continue
                z = np.hstack([stats[s].scaled(x[own]), np.ones((len(own), 1))])
                for i in of_set[s]:
                    y = ys[own, fits[i].label]
                    known = np.isfinite(y)
                    total[i] = total.get(i, 0.0) + _sums(here[i], z[known], y[known], weight[i])
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([total[k] for k in keys], pa.list_(pa.float64()))], names=["fit", "sums"])

    def stepped(table: pa.Table) -> pa.Table:
        i = table.column("fit")[0].as_py()
        total = np.asarray(table.column("sums").combine_chunks().flatten()).reshape(table.num_rows, -1).sum(axis=0)
        loss, ahead = _step(fits[i], here[i], total)
        return pa.table({"fit": pa.array([i], pa.int32()), "loss": pa.array([loss]), "ahead": pa.array([ahead.tolist()], pa.list_(pa.float64()))})

    added = rows.select("sets", "x", "ys").mapInArrow(local, "fit int, sums array<double>").groupBy("fit")
    return added.applyInArrow(stepped, "fit int, loss double, ahead array<double>").collect()


def score_all(rows: DataFrame, models: dict[int, Scorer], unit: str, apply: dict[int, int], label: dict[int, int], carry: Sequence[str] = ()) -> DataFrame:
    """(fit, unit_id, y, score, carry) of every row and every model that applies to it, in one scan.

    `rows` have `for`, an array of set numbers; model i applies to the rows whose `for` holds apply[i], and y is their label label[i].
    """
    of_group: dict[int, list[int]] = {}
    for i in models:
        of_group.setdefault(apply[i], []).append(i)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ys = feature_matrix(batch.column("x")), feature_matrix(batch.column("ys"))
            for s, own in members(batch.column("for")):
                taken = pa.array(own)
                for i in of_group.get(s, ()):
                    y = ys[own, label[i]]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(own), i, np.int32)), batch.column(unit).take(taken), pa.array(y, mask=~np.isfinite(y)),
                        pa.array(models[i].probability(x[own])), *(batch.column(c).take(taken) for c in carry)], names=["fit", "unit_id", "y", "score", *carry])

    more = "".join(f", `{c}` {kinds[c]}" for c in carry)
    return rows.select("for", "x", "ys", unit, *carry).mapInArrow(run, f"fit int, unit_id {kinds[unit]}, y double, score double{more}")


def labelled_rows(data: DataFrame, unit: str, labels: Sequence[str], features: str, *more: str) -> DataFrame:
    """(unit, x, ys, more): labels as one array of doubles."""
    return data.select(unit, F.col(features).cast("array<double>").alias("x"), F.array(*[F.col(c).cast("double") for c in labels]).alias("ys"), *more)


def fit_all(rows: DataFrame, fits: Sequence[Fit]) -> dict[int, Scorer]:
    """`solve` with the statistics of the training sets worked out first."""
    return solve(rows, fits, set_statistics(rows))


# --- training sets ----------------------------------------------------------------------
@dataclass(frozen=True)
class Draw:
    """Rows in the order of md5(salt:unit): those under `where` with a rank below `wanted` belong to the set, for each (set, wanted)."""

    salt: int
    where: Column
    wanted: tuple[tuple[int, int], ...]


def sampled_sets(rows: DataFrame, unit: str, draws: Sequence[Draw]) -> DataFrame:
    """(unit, _sampled): the sets of all draws that a row belongs to.

    One numbering serves every draw; sets of one draw are nested, as larger ones only have a higher threshold.
    """
    entries = [F.when(d.where, F.struct(F.lit(g).alias("group"), F.lit(d.salt).alias("salt"))) for g, d in enumerate(draws)]
    asked = rows.select(unit, F.explode(F.array_compact(F.array(*entries))).alias("_d")).select(unit, "_d.group", "_d.salt")
    ranks = numbered(asked, unit, "_rank", hash_int("salt", unit), within=["group"])
    limits = F.array(*[F.array(*[F.struct(F.lit(s).alias("set"), F.lit(n).alias("n")) for s, n in d.wanted]) for d in draws])
    found = F.transform(F.filter(F.element_at(limits, F.col("group") + 1), lambda w: F.col("_rank") < w["n"]), lambda w: w["set"])
    return ranks.select(unit, F.explode(found).alias("_set")).groupBy(unit).agg(F.collect_list("_set").alias("_sampled"))


def with_sets(rows: DataFrame, unit: str, fixed: Column, draws: Sequence[Draw]) -> DataFrame:
    """Rows with `sets`: the fixed ones and those of the draws.  Written, as every Newton step reads them."""
    if not draws:
        return cut_lineage(rows.withColumn("sets", fixed))
    # Drawn rows that are read again have to be the same ones.
    rows = cut_lineage(rows)
    joined = join_groups(rows, sampled_sets(rows, unit, draws), [unit], "left")
    none = F.array().cast("array<int>")
    return cut_lineage(joined.withColumn("sets", F.concat(fixed, F.coalesce("_sampled", none))).drop("_sampled"))


def other_folds(n_folds: int, fold: str = "fold") -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda k: k != F.col(fold))
