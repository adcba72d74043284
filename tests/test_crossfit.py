"""Training-set statistics, joint logistic regressions and their scores against numpy on small data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import crossfit as CX
from tidemark.operators import models as ML
from tidemark.operators import summaries as S

SCHEMA = "id long, x array<double>, ys array<double>, sets array<int>, `for` array<int>"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 900
    x = rng.normal(size=(n, 5)) * [1, 10, 0.1, 3, 0] + [0, 100, 0, 5, 2]
    x[rng.random((n, 5)) < 0.15] = np.nan
    x[:, 2] = np.round(x[:, 2], 1)  # ties
    x[::7, 0], x[3, 1], x[4, 1] = 0.0, np.inf, 1e9
    y = np.stack([(rng.random(n) < 1 / (1 + np.exp(-np.nan_to_num(x[:, 0])))), rng.random(n) < 0.2], axis=1).astype(float)
    y[:5, 1] = np.nan
    sets = [[0] + ([1] if i % 2 else []) + ([2] if i < 3 else []) for i in range(n)]
    cell = lambda v: None if np.isnan(v) else float(v)
    rows = [(i, [cell(v) for v in x[i]], [cell(v) for v in y[i]], sets[i], [i % 2]) for i in range(n)]
    return x, y, sets, spark.createDataFrame(rows, SCHEMA).repartition(4).persist()


def by_hand(x):
    ok = np.where(np.isfinite(x), x, np.nan)
    median = np.nan_to_num(np.nanmedian(ok, axis=0))
    filled = np.where(np.isfinite(x), x, median)
    sd = filled.std(axis=0)
    return median, filled.mean(axis=0), np.where(sd > 1e-12, sd, 1.0)


@pytest.mark.parametrize("gather", [1, 1 << 16])
def test_statistics_of_overlapping_sets(data, monkeypatch, gather):
    x, y, sets, rows = data
    monkeypatch.setattr(S, "GATHER", gather)
    got = S.set_statistics(rows)
    assert sorted(got) == [0, 1, 2]
    for s, found in got.items():
        own = np.array([s in z for z in sets])
        for value, want in zip((found.median, found.mean, found.sd), by_hand(x[own]), strict=True):
            np.testing.assert_allclose(value, want, rtol=1e-9)
        assert found.classes.tolist() == [[(y[own, i] == c).sum() for c in (0, 1)] for i in (0, 1)] and found.n == own.sum()


def test_joint_fits_are_stationary_points(data):
    x, y, sets, rows = data
    stats = S.set_statistics(rows)
    fits = [CX.Fit(0, 0, 1.0), CX.Fit(1, 0, 0.01, True), CX.Fit(0, 1, 100.0), CX.Fit(2, 0), CX.Fit(2, 1)]
    models = CX.solve(rows, fits, stats)
    assert 4 not in models  # one class only
    for i in (0, 1, 2):
        f, m = fits[i], models[i]
        own = np.array([f.set in z for z in sets]) & np.isfinite(y[:, f.label])
        z, t = np.hstack([stats[f.set].scaled(x[own]), np.ones((own.sum(), 1))]), y[own, f.label]
        w = np.where(t == 1, len(t) / (2 * t.sum()), len(t) / (2 * (len(t) - t.sum()))) if f.balanced else np.ones(len(t))
        gradient = z.T @ (w * (1 / (1 + np.exp(-z @ m.beta)) - t)) + np.append(m.beta[:-1], 0) / f.C
        assert np.abs(gradient).max() < 1e-5
        filled = np.where(np.isfinite(x), x, stats[f.set].median)
        plain = 1 / (1 + np.exp(-(filled @ m.coefficients()[:-1] + m.coefficients()[-1])))
        np.testing.assert_allclose(m.probability(x), plain, atol=1e-9)


def test_separable_classes_need_halved_steps(spark):
    rows = spark.createDataFrame([(i, [float(i > 5) * 100 + i], [float(i > 5)], [0], [0]) for i in range(12)], SCHEMA)
    model = CX.fit_all(rows, [CX.Fit(0, 0, 1e6)])[0]
    p = model.probability(np.array([[0.0], [111.0]]))
    assert p[0] < 0.01 and p[1] > 0.99


def test_every_model_scores_its_rows_in_one_scan(data):
    x, y, _, rows = data
    models = CX.fit_all(rows, [CX.Fit(0, 0), CX.Fit(1, 1)])
    scored = CX.score_all(rows, models, "id", {0: 0, 1: 1}, {0: 0, 1: 1}, ["sets"])
    got = scored.collect()
    assert len(got) == 900 and all(r.unit_id % 2 == r.fit for r in got)
    for r in got[::97]:
        assert r.score == pytest.approx(models[r.fit].probability(x[r.unit_id][None])[0]) and (r.y is None) == np.isnan(y[r.unit_id, r.fit])
    assert str(scored._jdf.queryExecution().sparkPlan()).count("MapInArrow") == 1


def test_samples_are_exact_nested_and_apart_by_salt(spark):
    rows = spark.range(500).withColumnRenamed("id", "stay_id").withColumn("odd", F.col("stay_id") % 2 == 1)
    draws = [CX.Draw(1, F.col("odd"), ((10, 40), (11, 90))), CX.Draw(2, F.col("odd"), ((12, 40),)), CX.Draw(3, F.lit(True), ((13, 9999),))]
    got = {}
    for r in CX.sampled_sets(rows, "stay_id", draws).collect():
        for s in r["_sampled"]:
            got.setdefault(s, set()).add(r.stay_id)
    assert {s: len(v) for s, v in got.items()} == {10: 40, 11: 90, 12: 40, 13: 500}
    assert got[10] < got[11] and got[10] != got[12] and all(i % 2 for i in got[11] | got[12])


def test_grid_repeats_seedless_fits_and_matches_sizes(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.normal(size=2)], int(rng.integers(0, 2)), int(i % 3 == 0), i % 2) for i in range(300)]
    data = ML.with_folds(spark.createDataFrame(rows, "stay_id long, features array<double>, a int, b int, era int"), 4)
    pred = ML.run_grid(data, F.col("era") == 0, F.col("era") == 1, ["a", "b"], [ML.Spec("logreg", {"C": 1.0})], [0, 1], ["full", "matched", "event_matched"], 4)
    n = pred.groupBy("label", "seed", "training_size", "kind").count().collect()
    assert len(n) == 2 * 2 * 3 * 2 and {r["count"] for r in n} == {150}
    by_cell = {(r.label, r.seed, r.training_size, r.kind): r.auroc for r in ML.auroc(pred, ["label", "seed", "training_size", "kind"]).collect()}
    for label in "ab":
        assert by_cell[label, 0, "full", "transferred"] == by_cell[label, 1, "full", "transferred"]
        assert by_cell[label, 0, "matched", "transferred"] != by_cell[label, 1, "matched", "transferred"]
        assert len({by_cell[label, s, z, "oracle"] for s in (0, 1) for z in ("full", "matched")}) == 1
