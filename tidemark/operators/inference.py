"""Two-level bootstrap of a difference of transfer gaps, intervals, p values, multiplicity, verdicts.

Predictions are one long frame (label, model, seed, kind, unit_id, cluster, y, score) with kind
'transferred' or 'oracle'.  Replicates are a column, not a loop: every replicate weights the units by
integers derived from (seed, replicate, unit), the same for all labels, models, seeds and kinds, so
contrasts stay paired (see functions/replicates.py).  Replicate 0 is the sample itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions import replicates as R
from tidemark.functions.columns import hash_int, join_groups, require_option
from tidemark.functions.replicates import METHODS, replicate_weights
from tidemark.session import cut_lineage


LEVELS = ("unit", "cluster")
#: Level that a method resamples unless told otherwise.
USUAL_LEVEL = {"poisson": "unit", "multinomial": "cluster"}


def unit_weights(units: DataFrame, n_boot: int, seed: int, unit: str = "unit_id", method: str = "poisson") -> DataFrame:
    """(unit, weights): how often each unit counts in replicates 0..n, one array per unit; replicate 0 is the sample."""
    return replicate_weights(units, unit, n_boot, seed, method)


def cluster_weights(clusters: DataFrame, n_boot: int, seed: int, cluster: str = "cluster", method: str = "multinomial") -> DataFrame:
    """(cluster, weights): as `unit_weights`; 'multinomial' draws exactly as many clusters as there are."""
    return replicate_weights(clusters, cluster, n_boot, seed, method)


def replicate_auroc(
    pred: DataFrame, n_boot: int, seed: int = 0, method: str = "poisson", keys: Sequence[str] = ("label", "model", "seed", "kind"),
    level: str | None = None,
) -> DataFrame:
    """AUROC of every replicate and cell: (rep, keys, auroc), resampling units or whole clusters by either method.

    For clusters the predictions are first collapsed to counts per (cell, cluster, score).
    """
    require_option(method, METHODS, "method")
    level = level or USUAL_LEVEL[method]
    require_option(level, LEVELS, "level")
    usable = pred.where(F.col("score").isNotNull() & F.col("y").isNotNull())
    if level == "unit":
        return R.replicate_auroc(usable.withColumn("n", F.lit(1)), keys, "unit_id", n_boot, seed, method)
    counts = usable.groupBy(*keys, "cluster", "y", "score").agg(F.count(F.lit(1)).alias("n"))
    return R.replicate_auroc(counts, keys, "cluster", n_boot, seed, method)


def replicate_gaps(replicates: DataFrame, keys: Sequence[str] = ("label", "model", "seed")) -> DataFrame:
    """gap = oracle - transferred per replicate; NULL where either is undefined."""
    def of(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col("auroc")))

    return replicates.groupBy("rep", *keys).agg((of("oracle") - of("transferred")).alias("gap"))


def seed_weights(gaps: DataFrame, n_boot: int, seed: int) -> DataFrame:
    """(rep, model, seed, ws): exact resampling of the seeds of each model, shared by all labels."""
    cells = gaps.select("model", "seed").distinct().withColumn(
        "_i", F.row_number().over(Window.partitionBy("model").orderBy("seed")) - 1
    )
    sizes = cells.groupBy("model").agg(F.count(F.lit(1)).cast("int").alias("_k"))
    draws = (
        sizes.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n_boot))))
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        .select("model", "rep", F.pmod(hash_int(F.lit(seed), F.lit("seed"), "rep", "model", "_j"), F.col("_k")).alias("_i"))
        .groupBy("model", "rep", "_i").agg(F.count(F.lit(1)).alias("ws"))
    )
    return cells.withColumn("_i", F.col("_i").cast("bigint")).join(draws, ["model", "_i"]).select("rep", "model", "seed", "ws")


def _did(weighted: DataFrame, label_a: str, label_b: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over models of the seed-weighted gap(a) - gap(b): (rep, value)."""
    def side(label: str) -> Column:
        g = F.when(F.col("label") == label, F.col("gap"))
        return F.try_divide(F.sum(g * F.col("ws")), F.sum(F.when(g.isNotNull(), F.col("ws"))))

    per_model = weighted.groupBy(*keys, "rep", "model").agg((side(label_a) - side(label_b)).alias("_d"))
    # An undefined model makes the replicate undefined.
    return per_model.groupBy(*keys, "rep").agg(
        F.when(F.count("_d") == F.count(F.lit(1)), F.avg("_d")).alias(value)
    )


def bootstrap_draws(gaps: DataFrame, label_a: str, label_b: str, n_boot: int, seed: int = 0) -> DataFrame:
    """(rep, draw_both, draw_units, draw_seeds) for replicates 1..n from one table of gaps.

    Replicates with resampled units only, seeds only, and both differ just in how the same
    replicate gaps are averaged.
    """
    gaps = gaps.where(F.col("label").isin(label_a, label_b))
    ws = seed_weights(gaps, n_boot, seed)
    resampled = gaps.where(F.col("rep") > 0)
    both = _did(resampled.join(ws, ["rep", "model", "seed"]), label_a, label_b, "draw_both")
    units = _did(resampled.withColumn("ws", F.lit(1)), label_a, label_b, "draw_units")
    sample = gaps.where(F.col("rep") == 0).drop("rep")
    seeds = _did(sample.join(ws, ["model", "seed"]), label_a, label_b, "draw_seeds")
    return both.join(units, "rep", "full").join(seeds, "rep", "full")


def point_estimate(gaps: DataFrame, label_a: str, label_b: str) -> DataFrame:
    sample = gaps.where((F.col("rep") == 0) & F.col("label").isin(label_a, label_b)).withColumn("ws", F.lit(1))
    return _did(sample, label_a, label_b, "point").select("point")


def summarise_draws(draws: DataFrame, draw: str = "draw", keys: Sequence[str] = ()) -> DataFrame:
    """SE, 95 % and 90 % percentile bounds, two-sided p, undefined draws per key.

    One group holds one number per replicate, so plain `percentile` is bounded by the replicate count.
    Undefined draws are dropped; `usable` is false where more than 5 % of them are.
    """
    d = F.col(draw)
    out = draws.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_draws"),
        (F.count(F.lit(1)) - F.count(draw)).alias("n_undefined"),
        F.stddev_samp(d).alias("se"),
        *[F.percentile(d, F.lit(q)).alias(n) for n, q in
          (("ci95_lo", 0.025), ("ci95_hi", 0.975), ("ci90_lo", 0.05), ("ci90_hi", 0.95))],
        p_two_sided(d).alias("p_raw"),
    )
    return out.withColumns({
        "delta_min": F.greatest(F.abs("ci90_lo"), F.abs("ci90_hi")),
        "usable": F.col("n_undefined") <= config.MAX_UNDEFINED_SHARE * F.col("n_draws"),
    })


def p_two_sided(draw: Column, null: float = 0.0) -> Column:
    """2 * min(P(draw <= null), rest), at least 1/n and at most 1, over the defined draws."""
    n = F.count(draw)
    below = F.try_divide(F.count_if(draw <= null), n)
    p = 2 * F.least(below, 1 - below)
    return F.least(F.lit(1.0), F.greatest(p, F.try_divide(F.lit(1.0), n)))


def require_usable(summary: DataFrame) -> None:
    bad = summary.where(~F.col("usable")).take(1)
    if bad:
        raise ValueError(f"no interval: {bad[0].n_undefined} of {bad[0].n_draws} draws have only one class")


def two_level_bootstrap(
    pred: DataFrame, label_a: str, label_b: str, n_boot: int = config.N_BOOT, seed: int = 0, method: str = "poisson", level: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(draws, point, replicate gaps) of gap(a) - gap(b), resampling units or clusters and seeds.

    The gaps are one row per replicate and cell, whatever the size of the data, and everything after
    them reads them several times, so they are written once.
    """
    wanted = pred.where(F.col("label").isin(label_a, label_b))
    gaps = cut_lineage(replicate_gaps(replicate_auroc(wanted, n_boot, seed, method, level=level)))
    return bootstrap_draws(gaps, label_a, label_b, n_boot, seed), point_estimate(gaps, label_a, label_b), gaps


def decompose(draws: DataFrame) -> DataFrame:
    """SE with both levels resampled, units only, seeds only; quadrature check and seed share."""
    both, units, seeds = (F.stddev_samp(f"draw_{c}") for c in ("both", "units", "seeds"))
    out = draws.agg(both.alias("se_both"), units.alias("se_units"), seeds.alias("se_seeds"))
    added = F.hypot("se_units", "se_seeds")
    return out.withColumn("se_quadrature", added).withColumns({
        "ratio_both_to_quadrature": F.try_divide(F.col("se_both"), F.col("se_quadrature")),
        "seed_share": F.try_divide(F.col("se_seeds") * F.col("se_seeds"), F.col("se_quadrature") * F.col("se_quadrature")),
    })


def pool_disjoint(draws: DataFrame, weights: DataFrame, part: str, draw: str = "draw", keys: Sequence[str] = ()) -> DataFrame:
    """Draw-wise weighted mean over disjoint parts: (keys, rep, draw).  An undefined part makes the
    pooled draw undefined; parts with different replicate counts show up as undefined draws as well.

    `weights` is (part, weight), with `keys` if they differ between groups.
    """
    keys = list(keys)
    shared = [k for k in keys if k in weights.columns]
    n_parts = weights.groupBy(*shared).agg(F.count(F.lit(1)).alias("_parts"))
    w = join_groups(weights, n_parts, shared) if shared else weights.withColumn("_parts", n_parts.scalar())
    rows = join_groups(draws, w, [*shared, part])
    return rows.groupBy(*keys, "rep").agg(
        F.when(F.count(draw) == F.max("_parts"),
               F.sum(F.col(draw) * F.col("weight")) / F.sum("weight")).alias(draw)
    )


# --- decisions --------------------------------------------------------------------
def holm(tests: DataFrame, ident: str, p: str = "p_raw", alpha: float = config.ALPHA, family: int | None = None) -> DataFrame:
    """Step-down adjusted p values and rejections.  One row per test of the family, so the window is
    as small as the family; `family` overrides its size."""
    every = Window.orderBy(p, ident)
    size = F.lit(family) if family else F.count(F.lit(1)).over(Window.partitionBy())
    stepped = F.least(F.lit(1.0), (size - F.row_number().over(every) + 1) * F.col(p))
    running = Window.orderBy(p, ident).rowsBetween(Window.unboundedPreceding, 0)
    return (
        tests.withColumn("_step", stepped).withColumn("p_holm", F.max("_step").over(running)).drop("_step")
        .withColumn("reject", F.col("p_holm") < alpha)
    )


def verdict(
    point: str = "point", ci95: tuple[str, str] = ("ci95_lo", "ci95_hi"), ci90: tuple[str, str] = ("ci90_lo", "ci90_hi"),
    signs_agree: str | Column = "all_agree", sesoi: float = config.SESOI,
) -> Column:
    """Drift asymmetry, trivial difference, equivalence or neither, in this order."""
    agree = F.col(signs_agree) if isinstance(signs_agree, str) else signs_agree
    excludes_zero = (F.col(ci95[0]) > 0) | (F.col(ci95[1]) < 0)
    inside = (F.col(ci90[0]) > -sesoi) & (F.col(ci90[1]) < sesoi)
    large = excludes_zero & (F.abs(point) >= sesoi) & agree
    return (
        F.when(large & (F.col(point) > 0), "meaningful drift asymmetry")
        .when(large, "meaningful asymmetry in the opposite direction")
        .when(excludes_zero & inside, "distinguishable but trivial")
        .when(inside, "practically equivalent")
        .otherwise("inconclusive")
    )
