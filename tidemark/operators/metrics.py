"""Agreement, clustering, prevalence and gap summaries."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.columns import join_groups, logit, suppress
from tidemark.functions.ranked import auroc

__all__ = ["auroc", "cohens_kappa", "prevalence", "icc_anova", "weighted_mean", "gap_scales", "gap_summary",
           "sign_agreement", "seed_spread", "seed_variance", "signal_stability", "project_precision",
           "design_effect", "event_counts", "sanity_checks", "learning_points"]


def cohens_kappa(df: DataFrame, labels: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Kappa of every label pair, one column a__b per pair, from one aggregate."""
    def pair(a: str, b: str) -> Column:
        agree = F.avg((F.col(a) == F.col(b)).cast("double"))
        pa, pb = F.avg(F.col(a).cast("double")), F.avg(F.col(b).cast("double"))
        chance = pa * pb + (1 - pa) * (1 - pb)
        return F.try_divide(agree - chance, 1 - chance).alias(f"{a}__{b}")

    return df.groupBy(*keys).agg(*[pair(a, b) for a, b in combinations(labels, 2)])


def prevalence(df: DataFrame, labels: Sequence[str], keys: Sequence[str] = (), min_cell: int | None = None) -> DataFrame:
    """Rows, positives and share per label and group."""
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(c).cast("bigint")).alias(f"n_{c}") for c in labels],
        *[F.avg(F.col(c).cast("double")).alias(f"prev_{c}") for c in labels],
    )
    return suppress(out, [f"n_{c}" for c in labels], min_cell) if min_cell else out


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    w = F.col(weight) if isinstance(weight, str) else weight
    return F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))


def icc_anova(df: DataFrame, value: str, cluster: str, keys: Sequence[str] = ()) -> DataFrame:
    """One-way ANOVA intraclass correlation for unequal clusters, floored at 0, and design effect.

    Two aggregates: per cluster (size, mean, within squares), then over clusters.  `m0` is the
    effective cluster size.  With one cluster, or no row to spare, the ICC is 0.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    per_cluster = df.where(v.isNotNull()).groupBy(*keys, cluster).agg(
        F.count(F.lit(1)).alias("_m"), F.avg(v).alias("_mean"), (F.var_pop(v) * F.count(F.lit(1))).alias("_within")
    )
    totals = per_cluster.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.sum("_m").alias("n"), F.sum("_within").alias("_ssw"),
        # between squares = sum of m * mean^2 about the grand mean, as the weighted variance of the means
        F.sum(F.col("_m") * F.col("_mean")).alias("_s1"), F.sum(F.col("_m") * F.col("_mean") * F.col("_mean")).alias("_s2"),
        F.sum(F.col("_m") * F.col("_m")).alias("_mm"),
    )
    k, n = F.col("k"), F.col("n")
    usable = (k >= 2) & (n - k >= 1)
    ssb = F.col("_s2") - F.col("_s1") * F.col("_s1") / n
    msb, msw = F.try_divide(ssb, k - 1), F.try_divide(F.col("_ssw"), n - k)
    m0 = F.when(usable, (n - F.col("_mm") / n) / F.nullif(k - 1, F.lit(0))).otherwise(n / k)
    spread = msb + (m0 - 1) * msw
    icc = F.when(usable & (spread > 0), F.greatest((msb - msw) / F.nullif(spread, F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    return totals.select(*keys, "k", "n", icc.alias("icc"), m0.alias("m0")).withColumn(
        "deff", 1.0 + (F.col("m0") - 1.0) * F.col("icc")
    )


def signal_stability(shares: DataFrame, signal: str, epoch: str, share: str, reference: str, last: str) -> DataFrame:
    """Share in the last epoch over the share in the reference epoch, per signal (NULL over zero)."""
    def at(e: str) -> Column:
        return F.max(F.when(F.col(epoch) == e, F.col(share)))

    return shares.groupBy(signal).agg(
        at(reference).alias("reference_share"), at(last).alias("last_share"),
    ).withColumn("ratio", F.try_divide(F.col("last_share"), F.col("reference_share")))


# --- gaps ------------------------------------------------------------------------
def gap_scales(df: DataFrame, transferred: str = "auroc_transferred", oracle: str = "auroc_oracle") -> DataFrame:
    """Absolute, relative (to the oracle's distance from chance) and logit gap."""
    t, o = F.col(transferred), F.col(oracle)
    return df.withColumns({
        "gap": o - t,
        "gap_relative": (o - t) / F.greatest(o - 0.5, F.lit(1e-6)),
        "gap_logit": logit(o) - logit(t),
    })


def gap_summary(gaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean AUROCs and gap over seeds (and over whatever else `keys` leaves out)."""
    return gaps.groupBy(*keys).agg(
        F.avg("auroc_transferred").alias("auroc_transferred"), F.avg("auroc_oracle").alias("auroc_oracle"),
        F.avg("gap").alias("gap"), F.count(F.lit(1)).alias("n_runs"),
    )


def sign_agreement(gaps: DataFrame, label_a: str, label_b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over models of gap(a) - gap(b) on the three scales, and whether the signs agree."""
    keys = list(keys)
    scales = ["gap", "gap_relative", "gap_logit"]

    def mean_of(label: str, scale: str) -> Column:
        return F.avg(F.when(F.col("label") == label, F.col(scale)))

    per_model = gaps.where(F.col("label").isin(label_a, label_b)).groupBy(*keys, "model").agg(
        *[(mean_of(label_a, s) - mean_of(label_b, s)).alias(s) for s in scales]
    )
    out = per_model.groupBy(*keys).agg(*[F.avg(s).alias(s) for s in scales])
    signs = F.array_distinct(F.filter(F.array(*[F.signum(s) for s in scales]), lambda s: s != 0))
    return out.withColumn("all_agree", F.size(signs) <= 1)


def seed_spread(gaps: DataFrame, keys: Sequence[str] = ("model", "label")) -> DataFrame:
    """SD of the gap over seeds (ddof 1)."""
    return gaps.groupBy(*keys).agg(F.stddev_samp("gap").alias("sd"), F.count(F.lit(1)).alias("n_seeds"))


def seed_variance(
    gaps: DataFrame, label_a: str, label_b: str, se_units: float | Column,
    seed_grid: Sequence[int] = tuple(config.SEED_GRID), keys: Sequence[str] = (),
) -> DataFrame:
    """SD of the per-seed difference of gaps; total SE and smallest margin for several seed counts."""
    keys = list(keys)
    gap_of = lambda label: F.avg(F.when(F.col("label") == label, F.col("gap")))
    per_model = gaps.groupBy(*keys, "seed", "model").agg((gap_of(label_a) - gap_of(label_b)).alias("_d"))
    per_seed = per_model.groupBy(*keys, "seed").agg(F.avg("_d").alias("_d"))
    out = per_seed.groupBy(*keys).agg(F.avg("_d").alias("did_mean"), F.stddev_samp("_d").alias("did_sd"))
    units = se_units if isinstance(se_units, Column) else F.lit(float(se_units))
    return (
        out.withColumn("seeds", F.explode(F.array(*[F.lit(k) for k in seed_grid])))
        .withColumn("se_seed", F.col("did_sd") / F.sqrt("seeds"))
        .withColumn("total_se", F.hypot(units, F.col("se_seed")))
        .withColumn("delta_min", F.lit(config.DELTA_MIN_FACTOR) * F.col("total_se"))
    )


def event_counts(labelled: DataFrame, labels: Sequence[str], group: str, train_groups: Sequence[str], n_folds: int) -> DataFrame:
    """Expected positives of a size-matched transferred model and of the oracle per test group and label."""
    long = labelled.select(group, F.explode(F.array(*[
        F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("y")) for c in labels
    ])).alias("_l")).select(group, "_l.*")
    rates = long.groupBy("label", group).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("_pos"))
    in_train = F.col(group).isin(list(train_groups))
    train = rates.where(in_train).groupBy("label").agg((F.sum("_pos") / F.sum("n")).alias("prevalence_train"))
    size = F.bround(F.lit((n_folds - 1) / n_folds) * F.col("n"), 0)
    return rates.where(~in_train).join(train, "label").select(
        "label", group, "n", "prevalence_train", (F.col("_pos") / F.col("n")).alias("prevalence_test"),
        (size * F.col("prevalence_train")).alias("transferred_positives"),
        (size * F.col("_pos") / F.col("n")).alias("oracle_positives"),
        F.try_divide(F.col("prevalence_train") * F.col("n"), F.col("_pos")).alias("ratio"),
    )


def sanity_checks(gaps: DataFrame, band: tuple[float, float] = config.PLAUSIBLE_AUROC) -> DataFrame:
    """(check, item, value, status): volume component, plausible AUROC, leak flag, seed noise."""
    def mean_gap(size: str) -> Column:
        return F.avg(F.when(F.col("training_size") == size, F.col("gap")))

    volume = gaps.groupBy("model").agg((mean_gap("matched") - mean_gap("full")).alias("value")).where(
        F.col("value").isNotNull()
    ).select(F.lit("size_matching_does_not_lower_the_gap").alias("check"), F.col("model").alias("item"), "value",
             F.when(F.col("value") < -0.001, "REVIEW").otherwise("OK").alias("status"))
    low, high = F.min("auroc_oracle"), F.max("auroc_oracle")
    plausible = gaps.groupBy("label").agg(low.alias("_lo"), high.alias("_hi")).select(
        F.lit("auroc_plausible"), F.col("label"), F.col("_hi"),
        F.when((F.col("_lo") >= band[0]) & (F.col("_hi") <= band[1]), "OK").otherwise("REVIEW"),
    )
    top = F.max(F.greatest("auroc_oracle", "auroc_transferred"))
    leak = gaps.agg(top.alias("_top")).select(
        F.lit("no_auroc_above_band"), F.lit("all"), F.col("_top"), F.when(F.col("_top") > band[1], "FAIL").otherwise("OK")
    )
    noise = seed_spread(gaps, ["model", "label"]).agg(F.max("sd").alias("_sd")).where(F.col("_sd").isNotNull()).select(
        F.lit("seed_noise_below_half_sesoi"), F.lit("all"), F.col("_sd") / F.sqrt(F.lit(5.0)),
        F.when(F.col("_sd") / F.sqrt(F.lit(5.0)) < config.SESOI / 2, "OK").otherwise("REVIEW"),
    )
    return volume.union(plausible).union(leak).union(noise)


def learning_points(curve: DataFrame) -> DataFrame:
    """Mean and SD over seeds of the AUROC at each training fraction."""
    return curve.groupBy("label", "model", "fraction").agg(
        F.avg("auroc").alias("auroc_mean"), F.stddev_samp("auroc").alias("auroc_sd"), F.count(F.lit(1)).alias("n_seeds")
    )


# --- precision ----------------------------------------------------------------------
def _testable(delta: Column, sesoi: float) -> Column:
    return (
        F.when(delta <= sesoi, "equivalence testable").when(delta <= 2 * sesoi, "detection only").otherwise("underpowered")
    )


def project_precision(
    splits: DataFrame, se_reference: float | Column, positives_reference: float | Column, sesoi: float = config.SESOI
) -> DataFrame:
    """SE scaled by 1/sqrt(positives of the rarer label): `splits` has n_test, prev_a, prev_b."""
    def lit(x):
        return x if isinstance(x, Column) else F.lit(float(x))

    rarer = F.least("prev_a", "prev_b")
    return (
        splits.withColumn("n_positives", F.col("n_test") * rarer)
        .withColumn("se", lit(se_reference) * F.sqrt(lit(positives_reference) / F.greatest(F.col("n_positives"), F.lit(1.0))))
        .withColumn("delta_min", F.lit(config.DELTA_MIN_FACTOR) * F.col("se"))
        .withColumn("verdict", _testable(F.col("delta_min"), sesoi))
    )


def design_effect(
    projected: DataFrame, icc_a: DataFrame, icc_b: DataFrame, keys: Sequence[str],
    groups_averaged: str = "groups_averaged", sesoi: float = config.SESOI,
) -> DataFrame:
    """Projected margins times sqrt(design effect) of the more clustered label, divided by the square
    root of the number of disjoint groups that are averaged."""
    a = icc_a.select(*keys, F.sqrt("deff").alias("sqrt_deff_a"))
    b = icc_b.select(*keys, F.sqrt("deff").alias("sqrt_deff_b"))
    out = join_groups(join_groups(projected, a, keys), b, keys)
    used = F.greatest("sqrt_deff_a", "sqrt_deff_b")
    rarer = F.when(F.col("prev_a") <= F.col("prev_b"), F.col("sqrt_deff_a")).otherwise(F.col("sqrt_deff_b"))
    gain = F.sqrt(F.col(groups_averaged).cast("double"))
    return out.withColumns({
        "sqrt_deff_used": used,
        "delta_min_conservative": F.col("delta_min") * used / gain,
        "delta_min_optimistic": F.col("delta_min") * rarer / gain,
        "verdict_clustered": _testable(F.col("delta_min") * used / gain, sesoi),
    })
