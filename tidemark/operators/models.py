"""Model fits and the transfer comparison.

Input frames hold a key (`stay_id`), a 0/1 column `y`, an array column of features and, for the test set, `fold`.  The logistic
regressions of a whole experiment are fitted together and score the rows in one scan (crossfit.py); trees, and a single
`run_transfer`, are Spark ML jobs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.columns import hash_fold, require_option
from tidemark.functions.ranked import auroc
from tidemark.operators import crossfit as CX
from tidemark.operators.features import fit_preprocessor, scale_with
from tidemark.operators.metrics import gap_scales
from tidemark.operators.splits import TRAINING_SIZES, match_training, oracle_sizes
from tidemark.session import cut_lineage

FAMILIES = ("logreg", "trees")


@dataclass(frozen=True)
class Spec:
    """A model family with its settings."""

    family: str
    params: Mapping[str, object]
    name: str | None = None

    @property
    def label(self) -> str:
        return self.name or self.family


def _estimator(spec: Spec, n_rows: int, seed: int):
    p = spec.params
    if spec.family == "logreg":
        # An L2 strength of C on the summed loss is 1 / (C n) on Spark's mean loss.
        return LogisticRegression(
            featuresCol="_vector", labelCol="_y", weightCol="_weight", maxIter=int(p.get("max_iter", 100)),
            regParam=1.0 / (float(p.get("C", 1.0)) * n_rows), elasticNetParam=0.0, standardization=False,
        )
    return GBTClassifier(
        featuresCol="_vector", labelCol="_y", weightCol="_weight", maxDepth=int(p.get("max_depth", 4)),
        stepSize=float(p.get("learning_rate", 0.1)), maxIter=int(p.get("n_estimators", 100)),
        subsamplingRate=float(p.get("subsample", 1.0)), seed=seed,
    )


Scaling = list[tuple[float, float, float]]


@dataclass(frozen=True)
class Fitted:
    """A model with the preprocessing of its own training rows, (median, mean, sd) per feature."""

    model: Model
    scaling: Scaling
    features: str

    def score(self, rows: DataFrame) -> DataFrame:
        """Rows with a `score` column, the probability of the positive class."""
        keep = [c for c in rows.columns if c != self.features]
        ready = rows.select(*keep, array_to_vector(scale_with(self.features, self.scaling)).alias("_vector"))
        scored = self.model.transform(ready)
        return scored.select(*keep, vector_to_array("probability")[1].alias("score"))


def scalings(rows: DataFrame, features: str, key: str) -> dict[int, Scaling]:
    """Statistics of each group of rows: one number triple per group and feature comes to the driver."""
    out: dict[int, Scaling] = {}
    for r in fit_preprocessor(rows, features, [key]).orderBy(key, "pos").collect():
        out.setdefault(r[key], []).append((r["median"], r["mean"], r["sd"]))
    return out


def class_counts(rows: DataFrame, key: str, y: str = "y") -> dict[int, dict[int, int]]:
    """Rows per class of each group: two numbers per group come to the driver."""
    out: dict[int, dict[int, int]] = {}
    for r in rows.groupBy(key, F.col(y).cast("int").alias("_y")).agg(F.count(F.lit(1)).alias("_n")).collect():
        out.setdefault(r[key], {})[r["_y"]] = r["_n"]
    return out


def fit(train: DataFrame, spec: Spec, seed: int = 0, features: str = "features", y: str = "y",
        scaling: Scaling | None = None, counts: dict[int, int] | None = None) -> Fitted | None:
    """Fit on preprocessed rows; None if the rows hold one class only."""
    train = train.select(F.col(y).cast("double").alias("_y"), features)
    if counts is None or scaling is None:
        whole = train.withColumn("_all", F.lit(0))
        counts = counts or class_counts(whole, "_all", "_y").get(0, {})
        scaling = scaling or scalings(whole, features, "_all").get(0)
    if len(counts) < 2:
        return None
    n = sum(counts.values())
    weight = F.lit(1.0)
    if spec.params.get("class_weight") == "balanced":
        weight = F.when(F.col("_y") == 1, n / (2.0 * counts[1])).otherwise(n / (2.0 * counts[0]))
    # Every iteration of the fit reads these rows.
    ready = train.select("_y", weight.alias("_weight"), array_to_vector(scale_with(features, scaling)).alias("_vector")).persist()
    model = _estimator(spec, n, seed).fit(ready)
    ready.unpersist()
    return Fitted(model, scaling, features)


def out_of_fold(
    rows: DataFrame, spec: Spec, n_folds: int, seed: int = 0, features: str = "features",
    train_filter=None, fold: str = "fold", y: str = "y",
) -> DataFrame | None:
    """Out-of-fold scores: each fold is scored by a model fitted on the others.

    The statistics of all training sets come from one pass.  A fold whose training rows hold one
    class is left out.  `train_filter(frame, fold)` may thin the training rows.
    """
    inside = {k: rows.where(F.col(fold) != k) for k in range(n_folds)}
    if train_filter:
        inside = {k: train_filter(df, k) for k, df in inside.items()}
        tagged = None
        for k, df in inside.items():
            part = df.select(F.lit(k).alias("_out"), y, features)
            tagged = part if tagged is None else tagged.unionByName(part)
    else:
        others = F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda k: k != F.col(fold))
        tagged = rows.select(F.explode(others).alias("_out"), y, features)
    known, counts = scalings(tagged, features, "_out"), class_counts(tagged, "_out", y)
    out = None
    for k, df in inside.items():
        fitted = fit(df, spec, seed, features, y, known[k], counts[k]) if k in known else None
        if fitted is None:
            continue
        scored = fitted.score(rows.where(F.col(fold) == k))
        out = scored if out is None else out.unionByName(scored)
    return out


def run_transfer(
    train: DataFrame,
    test: DataFrame,
    spec: Spec,
    label: str,
    seed: int = 0,
    n_folds: int = config.N_FOLDS,
    training_size: str = "full",
    features: str = "features",
    unit: str = "stay_id",
    oracle: DataFrame | None = None,
) -> DataFrame:
    """Predictions of one cell, long: (label, model, seed, training_size, kind, unit_id, y, score, extra).

    Transferred: fitted on `train`, scores all of `test`.  Oracle: out-of-fold inside `test`; it does not
    depend on the training size and may be handed in.  Other columns of `test` (a cluster, say) are carried
    along.  The frame is lazy over fitted models.
    """
    matched = match_training(train, test, training_size, n_folds, seed, ident=unit)
    fitted = fit(matched, spec, seed, features)
    if fitted is None:
        raise ValueError("the training rows hold one class only")
    scored = fitted.score(test).withColumn("kind", F.lit("transferred"))
    if oracle is None:
        oracle = out_of_fold(test, spec, n_folds, seed, features)
    if oracle is not None:
        scored = scored.unionByName(oracle.withColumn("kind", F.lit("oracle")))
    head = {"label": label, "model": spec.label, "seed": seed, "training_size": training_size}
    return scored.withColumns({k: F.lit(v) for k, v in head.items()}).withColumnRenamed(unit, "unit_id")


def transfer_result(pred: DataFrame, keys: Sequence[str] = ("label", "model", "seed", "training_size")) -> DataFrame:
    """AUROC of both kinds per cell and the gap on three scales.  The oracle pools its out-of-fold rows."""
    per_kind = auroc(pred, [*keys, "kind"])

    def of(kind: str):
        return F.max(F.when(F.col("kind") == kind, F.col("auroc"))).alias(f"auroc_{kind}")

    return gap_scales(per_kind.groupBy(*keys).agg(of("transferred"), of("oracle")))


def training_summary(train: DataFrame, test: DataFrame, training_size: str, n_folds: int = config.N_FOLDS, seed: int = 0,
                     unit: str = "stay_id") -> DataFrame:
    """One row: rows and positives used, sizes of the oracle's training set, prevalences."""
    used = match_training(train, test, training_size, n_folds, seed, ident=unit)
    y = F.col("y").cast("double")
    a = used.agg(F.count(F.lit(1)).alias("n_train_used"), F.sum(y).alias("n_train_positives"), F.avg(y).alias("prevalence_train"))
    b = test.agg(F.count(F.lit(1)).alias("n_test"), F.avg(y).alias("prevalence_test"))
    one = F.lit(1)
    return (
        a.withColumn("_k", one).join(b.withColumn("_k", one), "_k")
        .join(oracle_sizes(test, n_folds).withColumn("_k", one), "_k").drop("_k")
    )


def run_grid(
    data: DataFrame, train_where, test_where, labels: Sequence[str], specs: Sequence[Spec], seeds: Sequence[int],
    training_sizes: Sequence[str] = ("full",), n_folds: int = config.N_FOLDS, features: str = "features",
    carry: Sequence[str] = (), unit: str = "stay_id",
) -> DataFrame:
    """Predictions of all cells as one frame, written: it is the input of every later summary.

    Logistic regressions are fitted and scored together (`logreg_grid`); trees are Spark ML jobs, one cell after another.
    """
    out = None
    linear = [s for s in specs if s.family == "logreg"]
    if linear:
        out = logreg_grid(data, train_where, test_where, labels, linear, seeds, training_sizes, n_folds, features, carry, unit)
    for label in labels:
        train = data.where(train_where).select(unit, F.col(label).alias("y"), features)
        test = data.where(test_where).select(unit, F.col(label).alias("y"), features, "fold", *carry)
        for spec in (s for s in specs if s.family != "logreg"):
            for seed in seeds:
                oracle = out_of_fold(test, spec, n_folds, seed, features)
                for size in training_sizes:
                    cell = run_transfer(train, test, spec, label, seed, n_folds, size, features, unit, oracle).withColumn("y", F.col("y").cast("double"))
                    out = cell if out is None else out.unionByName(cell)
    return cut_lineage(out)


# --- logistic regressions, all cells at once ---------------------------------------------
def _linear_fit(spec: Spec, training_set: int, label: int) -> CX.Fit:
    p = spec.params
    return CX.Fit(training_set, label, float(p.get("C", 1.0)), p.get("class_weight") == "balanced", int(p.get("max_iter", 100)))


def logreg_grid(
    data: DataFrame, train_where: Column, test_where: Column, labels: Sequence[str], specs: Sequence[Spec], seeds: Sequence[int],
    training_sizes: Sequence[str] = ("full",), n_folds: int = config.N_FOLDS, features: str = "features", carry: Sequence[str] = (),
    unit: str = "stay_id",
) -> DataFrame:
    """Predictions (label, model, seed, training_size, kind, unit_id, y, score, fold, carry) of all cells.

    Every training set is a number that rows carry: the others of each fold, the whole training era, and per seed (and label) the samples
    of the oracle's size.  Fits that do not depend on the seed are made once and stand for every seed.
    """
    for size in training_sizes:
        require_option(size, TRAINING_SIZES, "training size")
    rows = CX.labelled_rows(data, unit, labels, features, "fold", F.coalesce(train_where, F.lit(False)).alias("_train"),
                            F.coalesce(test_where, F.lit(False)).alias("_test"), *carry).where("_train or _test")
    y = [F.element_at("ys", i + 1) for i in range(len(labels))]
    counts = rows.where("_test").agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(v), F.lit(0.0)).alias(f"p{i}") for i, v in enumerate(y)]).first()
    share = (n_folds - 1) / n_folds
    n_oracle = round(share * counts["n"])  # half to even, as in oracle_sizes
    whole = n_folds
    number = {("full", s, i): whole for s in seeds for i in range(len(labels))}
    draws, free = [], whole + 1
    for seed in seeds:
        if "matched" in training_sizes:
            draws.append(CX.Draw(1000 + seed, F.col("_train"), ((free, n_oracle),)))
            number |= {("matched", seed, i): free for i in range(len(labels))}
            free += 1
        for i in range(len(labels)) if "event_matched" in training_sizes else ():
            positives = round(share * counts[f"p{i}"])
            draws += [CX.Draw(2000 + seed, F.col("_train") & (y[i] == c), ((free, n),)) for c, n in ((1, positives), (0, n_oracle - positives))]
            number["event_matched", seed, i] = free
            free += 1
    nowhere = F.array().cast("array<int>")
    fixed = F.concat(F.when(F.col("_test"), CX.other_folds(n_folds)).otherwise(nowhere), F.when(F.col("_train"), F.array(F.lit(whole))).otherwise(nowhere))
    ready = CX.with_sets(rows, unit, fixed, draws)

    fits: dict[CX.Fit, int] = {}
    cells: dict[int, list[tuple]] = {}
    for i, label in enumerate(labels):
        for spec in specs:
            for size in training_sizes:
                for seed in seeds:
                    at = fits.setdefault(_linear_fit(spec, number[size, seed, i], i), len(fits))
                    cells.setdefault(at, []).append((label, spec.label, seed, size, "transferred"))
                    for k in range(n_folds):
                        at = fits.setdefault(_linear_fit(spec, k, i), len(fits))
                        cells.setdefault(at, []).append((label, spec.label, seed, size, "oracle"))
    models = CX.fit_all(ready, list(fits))
    if missing := [cells[at][0] for fit, at in fits.items() if at not in models and fit.set >= n_folds]:
        raise ValueError(f"the training rows hold one class only: {missing[:3]}")
    test = ready.where("_test").withColumn("for", F.array(F.col("fold"), F.lit(whole)))
    order = list(fits)
    scored = CX.score_all(test, models, unit, {i: min(order[i].set, whole) for i in models}, {i: order[i].label for i in models}, ["fold", *carry])
    names = data.sparkSession.createDataFrame([(at, *cell) for at in models for cell in cells[at]],
                                              "fit int, label string, model string, seed int, training_size string, kind string")
    return scored.join(names, "fit").drop("fit")


def _linear_folds(data: DataFrame, specs: Sequence[Spec], labels: Sequence[str], n_folds: int, features: str) -> DataFrame:
    """(config, label, fold, y, score): out-of-fold scores of every configuration and label."""
    rows = CX.labelled_rows(data.withColumn("_id", F.lit(0)), "_id", labels, features, "fold")
    ready = CX.with_sets(rows, "_id", CX.other_folds(n_folds), ()).withColumn("for", F.array("fold"))
    fits = [_linear_fit(spec, k, i) for spec in specs for i in range(len(labels)) for k in range(n_folds)]
    names = [(at, spec.label, label, k) for at, (spec, label, k) in enumerate((s, n, k) for s in specs for n in labels for k in range(n_folds))]
    models = CX.fit_all(ready, fits)
    scored = CX.score_all(ready, models, "_id", {i: fits[i].set for i in models}, {i: fits[i].label for i in models})
    frame = data.sparkSession.createDataFrame([n for n in names if n[0] in models], "fit int, config string, label string, fold int")
    return scored.join(frame, "fit").select("config", "label", "fold", "y", "score")


def config_scores(
    data: DataFrame, specs: Sequence[Spec], labels: Sequence[str], n_folds: int = config.N_FOLDS, seed: int = 0, features: str = "features",
) -> DataFrame:
    """Inner cross-validation (config, label, auroc): the mean of the fold AUROCs, not pooled.  All logistic regressions are one run."""
    parts = []
    linear = [s for s in specs if s.family == "logreg"]
    if linear:
        parts.append(auroc(_linear_folds(data, linear, labels, n_folds, features), ["config", "label", "fold"]).select("config", "label", "auroc"))
    for spec in (s for s in specs if s.family != "logreg"):
        for label in labels:
            scored = out_of_fold(data.select(F.col(label).alias("y"), features, "fold"), spec, n_folds, seed, features)
            if scored is not None:
                parts.append(auroc(scored, ["fold"]).select(F.lit(spec.label).alias("config"), F.lit(label).alias("label"), "auroc"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("config", "label").agg(F.avg("auroc").alias("auroc"))


def tune(
    data: DataFrame, specs: Sequence[Spec], labels: Sequence[str], n_folds: int = config.N_FOLDS, seed: int = 0,
    features: str = "features",
) -> DataFrame:
    """(config, mean_auroc, selected) of all configurations; the best mean over labels is selected."""
    means = cut_lineage(config_scores(data, specs, labels, n_folds, seed, features).groupBy("config").agg(F.avg("auroc").alias("mean_auroc")))
    best = means.agg(F.max_by("config", F.struct("mean_auroc", "config")).alias("b")).scalar()
    return means.withColumn("selected", F.col("config") == best)


def learning_curve(
    test: DataFrame, spec: Spec, labels: Sequence[str], fractions: Sequence[float] = tuple(config.LEARNING_FRACTIONS),
    seeds: Sequence[int] = (0, 1, 2), n_folds: int = config.N_FOLDS, features: str = "features", unit: str = "stay_id",
) -> DataFrame:
    """Out-of-fold AUROC at growing training fractions: (label, model, fraction, seed, auroc), for logistic regression.

    Each fold takes exactly the rounded fraction of its training rows, at least 50; the samples of a seed and fold are nested.
    """
    require_option(spec.family, ("logreg",), "family")
    rows = CX.labelled_rows(test, unit, labels, features, "fold")
    sizes = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    inside = {k: sum(n for f, n in sizes.items() if f != k) for k in range(n_folds)}
    number = {(f, s, k): k for f in fractions if f >= 1 for s in seeds for k in range(n_folds)}
    part = [f for f in fractions if f < 1]
    free, draws = n_folds, []
    for s in seeds:
        for k in range(n_folds):
            wanted = []
            for f in part:
                number[f, s, k], free = free, free + 1
                wanted.append((number[f, s, k], max(round(f * inside[k]), config.MIN_LEARNING_ROWS)))
            if wanted:
                draws.append(CX.Draw(7000 + 100 * s + k, F.col("fold") != k, tuple(wanted)))
    ready = CX.with_sets(rows, unit, CX.other_folds(n_folds), draws).withColumn("for", F.array("fold"))
    fits: dict[CX.Fit, int] = {}
    cells: dict[int, list[tuple]] = {}
    fold_of: dict[int, int] = {}
    for i, label in enumerate(labels):
        for (f, s, k), at_set in number.items():
            at = fits.setdefault(_linear_fit(spec, at_set, i), len(fits))
            cells.setdefault(at, []).append((label, spec.label, float(f), s))
            fold_of[at] = k
    models, order = CX.fit_all(ready, list(fits)), list(fits)
    scored = CX.score_all(ready, models, unit, {i: fold_of[i] for i in models}, {i: order[i].label for i in models})
    names = test.sparkSession.createDataFrame([(at, *cell) for at in models for cell in cells[at]], "fit int, label string, model string, fraction double, seed int")
    keys = ["label", "model", "fraction", "seed"]
    return auroc(scored.join(names, "fit"), keys).select(*keys, "auroc")


def with_folds(data: DataFrame, n_folds: int = config.N_FOLDS, seed: int = 0, ident: str = "stay_id") -> DataFrame:
    return data.withColumn("fold", hash_fold(ident, n_folds, seed))
