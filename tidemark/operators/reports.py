"""Result tables: joins of the summary frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import join_groups


def cohort_table(common_summary: DataFrame, prevalence: DataFrame, actions: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Per epoch, then all epochs: stays, common cohort, prevalences and action shares.

    The total row weights prevalences by the common cohort and action shares by all stays.
    """
    per_epoch = join_groups(
        join_groups(common_summary.select("epoch", "n_stays", "n_common_cohort"),
                    prevalence.select("epoch", "n", *[f"n_{c}" for c in labels]), ["epoch"]),
        actions.select("epoch", F.col("n").alias("_n_all"), "frac_culture", "frac_antibiotic"), ["epoch"],
    )
    total = per_epoch.agg(
        F.lit("all epochs").alias("epoch"),
        *[F.sum(c).alias(c) for c in ("n_stays", "n_common_cohort", "n", *[f"n_{x}" for x in labels])],
        *[(F.sum(F.col(c) * F.col("_n_all")) / F.sum("_n_all")).alias(c) for c in ("frac_culture", "frac_antibiotic")],
    )
    out = per_epoch.drop("_n_all").unionByName(total)
    return out.select("epoch", "n_stays", "n_common_cohort",
                      *[F.try_divide(F.col(f"n_{c}"), F.col("n")).alias(f"prev_{c}") for c in labels],
                      "frac_culture", "frac_antibiotic")


def label_overview(prevalence: DataFrame, site_prevalence: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(rank, label, prevalence, site_prevalence) over the common cohorts of both sources.

    `prevalence` and `site_prevalence` hold n and n_<label> for any number of groups.
    """
    def overall(df: DataFrame, name: str) -> DataFrame:
        sums = df.agg(F.sum("n").alias("n"), *[F.sum(f"n_{c}").alias(c) for c in labels])
        cells = F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.lit(c).alias("label"),
                                   F.try_divide(F.col(c), F.col("n")).alias(name)) for i, c in enumerate(labels)])
        return sums.select(F.explode(cells).alias("_c")).select("_c.*")

    return overall(prevalence, "prevalence").join(overall(site_prevalence, "site_prevalence"), ["rank", "label"])


def estimate_table(estimates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Printed columns of an estimate table: keys, point, interval, margin, Holm p, verdict."""
    return estimates.select(*keys, "point", "ci95_lo", "ci95_hi", "delta_min", "p_holm", "verdict").orderBy(*keys)


def site_table(estimates: DataFrame, regions: DataFrame) -> DataFrame:
    """Estimates along the site axis with the number of sites: the pooled row covers all of them."""
    pooled = regions.agg(F.sum("n_sites").alias("n")).scalar()
    return (
        estimates.join(regions.select(F.col("region").alias("split"), F.col("n_sites").alias("_n")), "split", "left")
        .withColumn("n_sites", F.when(F.col("design") == "cv", pooled).otherwise(F.col("_n")))
        .drop("_n")
    )
