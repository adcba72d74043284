"""Rank statistics, samples, folds and bootstrap against direct computation on small random data."""

import numpy as np
import pandas as pd
import pytest
from conftest import as_dict
from pyspark.sql import functions as F

from tidemark.functions import ranked as Q
from tidemark.operators import inference as I
from tidemark.operators import metrics as M
from tidemark.operators import splits as P


def direct_auroc(y, s, w):
    pos, neg = y == 1, y == 0
    diff = s[pos][:, None] - s[neg][None, :]
    pairs = (diff > 0) + 0.5 * (diff == 0)
    return (w[pos][:, None] * w[neg][None, :] * pairs).sum() / (w[pos].sum() * w[neg].sum())


def test_auroc_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 600), "y": rng.integers(0, 2, 600), "w": rng.integers(1, 4, 600),
                        "score": np.round(rng.normal(0, 3, 600), 1) * rng.choice([1e-6, 1.0, 1e6], 600)})
    got = as_dict(Q.auroc(spark.createDataFrame(pdf), ["g"], weight="w"), "g", "auroc")
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(direct_auroc(part.y.values, part.score.values, part.w.values.astype(float)))


def test_auroc_of_ties_and_of_one_class(frame):
    ties = frame("y int, score double", (0, 1.0), (1, 1.0), (0, 1.0), (1, 1.0))
    assert Q.auroc(ties).head()["auroc"] == 0.5
    assert Q.auroc(frame("y int, score double", (1, 1.0), (1, 2.0))).head()["auroc"] is None


@pytest.mark.parametrize("low, high", [(1e6, 1e6 + 1), (0.0, 1e-4), (-1e-300, 1e-300)])
def test_cells_are_even_for_narrow_scores(spark, low, high):
    """Split points come from the data, so no cell holds much more than its share however narrow the range is."""
    df = spark.range(40_000).select(F.lit("g").alias("g"), (F.lit(low) + F.lit(high - low) * F.rand(5)).alias("v")).distinct()
    sizes = Q.cells(df, ["g"], "v").groupBy("_d1", "_d2").count()
    top, n = sizes.agg(F.max("count"), F.count("count")).first()
    assert top <= 6 * df.count() / Q.PARTS**2 and n > Q.PARTS**2 / 2


def test_narrow_scores_rank_exactly(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"y": rng.integers(0, 2, 900), "score": 1e6 + rng.random(900), "w": 1.0})
    got = Q.auroc(spark.createDataFrame(pdf)).head()["auroc"]
    assert got == pytest.approx(direct_auroc(pdf.y.values, pdf.score.values, pdf.w.values))


def test_quantiles_equal_linear_interpolation(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 5000), "v": np.concatenate([rng.normal(0, 1, 3000), np.repeat(2.0, 2000)])})
    probs = [0.0, 0.1, 0.5, 0.501, 0.9, 1.0]
    for accuracy in (2_000, 100):
        monkeypatch.setattr(Q, "SKETCH_ACCURACY", accuracy)
        got = {(r.g, r.p): r["quantile"] for r in Q.quantiles(spark.createDataFrame(pdf), ["g"], "v", probs).collect()}
        for g in ("a", "b", None):
            values = pdf.v[pdf.g.isna() if g is None else pdf.g == g]
            for p in probs:
                assert got[g, p] == pytest.approx(np.quantile(values, p)), (accuracy, g, p)
    whole = {r.p: r["quantile"] for r in Q.quantiles(spark.createDataFrame(pdf), [], "v", probs).collect()}
    assert whole == {p: pytest.approx(np.quantile(pdf.v, p)) for p in probs}


def test_sample_takes_exactly_n(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 10 == 0, "small").otherwise("big"))
    wanted = F.when(F.col("g") == "small", 77).otherwise(1234)
    out = Q.sample_n(df, "id", wanted, 3, ["g"], bins=16)
    assert as_dict(out.groupBy("g").count(), "g", "count") == {"small": 77, "big": 1234}
    assert out.select("id").distinct().count() == 77 + 1234
    whole = Q.sample_n(df, "id", F.lit(10_000), 3, ["g"])
    assert whole.count() == 5000


def test_folds_are_stable_and_checked(spark):
    df = P.assign_folds(spark.range(500).withColumnRenamed("id", "stay_id"))
    few = P.assign_folds(spark.range(100).withColumnRenamed("id", "stay_id"))
    assert few.join(df.withColumnRenamed("fold", "f2"), "stay_id").where("fold <> f2").count() == 0
    P.assert_folds_partition(df, 5)
    with pytest.raises(AssertionError):
        P.assert_folds_partition(df.where("fold <> 2"), 5)
    P.assert_disjoint(df.where("fold = 0"), df.where("fold = 1"))
    with pytest.raises(AssertionError):
        P.assert_disjoint(df.where("fold = 0"), df)


def test_icc_limits(spark):
    same = spark.createDataFrame([(i % 5, float(i % 5)) for i in range(50)], "c int, v double")
    assert M.icc_anova(same, "v", "c").head()["icc"] == pytest.approx(1.0)
    one = spark.createDataFrame([(1, 1.0), (1, 0.0)], "c int, v double")
    row = M.icc_anova(one, "v", "c").head()
    assert row.icc == 0.0 and row.m0 == 2.0


def test_kappa_of_identical_labels(frame):
    df = frame("a int, b int", (1, 1), (0, 0), (1, 1), (0, 0))
    assert M.cohens_kappa(df, ["a", "b"]).head()["a__b"] == 1.0


def predictions(spark, n=120, seeds=2):
    rng = np.random.default_rng(3)
    rows = []
    y = {"a": rng.integers(0, 2, n), "b": rng.integers(0, 2, n)}
    for label in y:
        for seed in range(seeds):
            for kind, skill in (("transferred", 0.5), ("oracle", 1.0)):
                score = y[label] * skill + rng.normal(0, 1, n)
                rows += [(label, "m", seed, kind, i, i % 6, int(y[label][i]), float(score[i])) for i in range(n)]
    return spark.createDataFrame(rows, "label string, model string, seed int, kind string, unit_id long, cluster int, y int, score double")


def test_cluster_bootstrap_equals_a_direct_one(spark):
    pred = predictions(spark)
    draws, point, gaps = I.two_level_bootstrap(pred, "a", "b", n_boot=20, method="multinomial")
    weights = as_dict(I.cluster_weights(pred.select("cluster"), 20, 0), "cluster", "weights")
    assert all(sum(weights[c][r] for c in weights) == 6 for r in range(21))  # K clusters out of K
    pdf = pred.toPandas()
    got = {(r.rep, r.label, r.seed): r.gap for r in gaps.collect()}
    for rep in (0, 7):
        for label in ("a", "b"):
            auc = {}
            for kind, part in pdf[(pdf.label == label) & (pdf.seed == 1)].groupby("kind"):
                w = part.cluster.map(lambda c: weights[c][rep]).values.astype(float)
                auc[kind] = direct_auroc(part.y.values, part.score.values, w)
            assert got[rep, label, 1] == pytest.approx(auc["oracle"] - auc["transferred"])
    direct = np.mean([got[0, "a", s] for s in (0, 1)]) - np.mean([got[0, "b", s] for s in (0, 1)])
    assert point.head()["point"] == pytest.approx(direct)
    assert draws.count() == 20


def test_unit_weights_are_paired_and_average_one(spark):
    units = spark.range(400).withColumnRenamed("id", "unit_id")
    w = I.unit_weights(units, 50, 0).select("unit_id", F.posexplode("weights").alias("rep", "w"))
    assert w.where("rep = 0 AND w = 1").count() == 400
    mean = w.where("rep > 0").agg(F.sum("w") / F.lit(400 * 50)).head()[0]
    assert mean == pytest.approx(1.0, abs=0.03)


def test_summary_drops_undefined_draws(spark):
    draws = spark.createDataFrame([(i, None if i < 3 else float(i)) for i in range(100)], "rep int, draw double")
    row = I.summarise_draws(draws).head()
    assert row.n_undefined == 3 and row.usable and row.p_raw == pytest.approx(1 / 97)
    bad = I.summarise_draws(draws.withColumn("draw", F.when(F.col("rep") > 10, F.col("draw"))))
    with pytest.raises(ValueError):
        I.require_usable(bad)


def test_pooling_needs_every_part(frame):
    draws = frame("part string, rep int, draw double", ("a", 1, 1.0), ("b", 1, 3.0), ("a", 2, 1.0))
    weights = frame("part string, weight double", ("a", 1.0), ("b", 3.0))
    assert as_dict(I.pool_disjoint(draws, weights, "part"), "rep", "draw") == {1: 2.5, 2: None}
