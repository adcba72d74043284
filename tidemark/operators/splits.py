"""Folds, site splits, and their checks; training-set matching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.columns import hash_fold, hash_int, require_option
from tidemark.functions.ranked import numbered, sample_n

TRAINING_SIZES = ("full", "matched", "event_matched")


def assign_folds(df: DataFrame, n_folds: int = config.N_FOLDS, seed: int = 0, ident: str = "stay_id") -> DataFrame:
    """Fold by a hash of the id alone: the same id gets the same fold in every cohort."""
    return df.withColumn("fold", hash_fold(ident, n_folds, seed))


def overlapping_ids(left: DataFrame, right: DataFrame, ident: str = "stay_id") -> DataFrame:
    return left.select(ident).intersect(right.select(ident))


def assert_disjoint(*groups: DataFrame, ident: str = "stay_id") -> None:
    """No id occurs in two groups."""
    tagged = None
    for i, g in enumerate(groups):
        part = g.select(ident).distinct().withColumn("_group", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    shared = tagged.groupBy(ident).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    if example := shared.select(ident).head(3):
        raise AssertionError(f"groups share ids, for example {[r[0] for r in example]}")


def fold_sizes(df: DataFrame, n_folds: int, fold: str = "fold") -> DataFrame:
    """Rows per fold 0..n-1, zero for empty ones, plus any fold out of range."""
    wanted = df.sparkSession.range(n_folds).select(F.col("id").cast("int").alias(fold))
    counts = df.groupBy(fold).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, fold, "full").select(
        fold, F.coalesce("n", F.lit(0)).alias("n"),
        (F.col(fold).isNotNull() & F.col(fold).between(0, n_folds - 1)).alias("in_range"),
    )


def assert_folds_partition(df: DataFrame, n_folds: int, fold: str = "fold") -> None:
    bad = fold_sizes(df, n_folds, fold).where(~F.col("in_range") | (F.col("n") == 0)).take(n_folds + 1)
    if bad:
        raise AssertionError(f"folds out of range or empty: {bad}")


# --- site axis ------------------------------------------------------------------
def site_groups(df: DataFrame, n_groups: int, seed: int, site: str = "site") -> DataFrame:
    """Disjoint site groups of equal size: sites in hash order, dealt out in turn."""
    sites = numbered(df.where(F.col(site).isNotNull()).select(site).distinct(), site, "_i", hash_int(F.lit(seed), site))
    return df.join(sites.withColumn("group", (F.col("_i") % n_groups).cast("int")).drop("_i"), site)


def regions_to_hold_out(df: DataFrame, regions: Sequence[str], min_stays: int = config.MIN_REGION_STAYS,
                        region: str = "region") -> DataFrame:
    """Regions with enough stays for a leave-one-region-out split."""
    return (
        df.where(F.col(region).isin(list(regions))).groupBy(region).agg(F.count(F.lit(1)).alias("n_stays"))
        .where(F.col("n_stays") >= min_stays)
    )


def site_splits(df: DataFrame, n_groups: int, seed: int, regions: Sequence[str] = tuple(config.REGIONS),
                min_stays: int = config.MIN_REGION_STAYS) -> DataFrame:
    """(design, name, n_test, n_train) of all test sets: site groups, then held-out regions.

    A test set is the rows with `group` = name (see `site_groups`) or `region` = name.
    """
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    groups = site_groups(df, n_groups, seed).groupBy("group").agg(F.count(F.lit(1)).alias("n_test")).select(
        F.lit("cv").alias("design"), F.concat(F.lit("fold"), F.col("group").cast("string")).alias("name"), "n_test"
    )
    held = regions_to_hold_out(df, regions, min_stays).select(
        F.lit("loro").alias("design"), F.col("region").alias("name"), F.col("n_stays").alias("n_test")
    )
    return groups.unionByName(held).withColumn("n_train", total.scalar() - F.col("n_test"))


# --- training-set matching -----------------------------------------------------------
def _round_half_even(c: Column) -> Column:
    return F.bround(c, 0).cast("bigint")


def oracle_sizes(test: DataFrame, n_folds: int, y: str = "y") -> DataFrame:
    """One row: rows and positives that an out-of-fold model on the test set trains on."""
    share = (n_folds - 1) / n_folds
    return test.agg(
        _round_half_even(F.lit(share) * F.count(F.lit(1))).alias("n_oracle"),
        _round_half_even(F.lit(share) * F.coalesce(F.sum(F.col(y).cast("double")), F.lit(0.0))).alias("n_oracle_pos"),
    )


def match_training(
    train: DataFrame, test: DataFrame, size: str, n_folds: int = config.N_FOLDS, seed: int = 0,
    y: str = "y", ident: str = "stay_id",
) -> DataFrame:
    """Training rows cut to the size ('matched') or to the class counts ('event_matched') of the
    oracle's training set.  A class with too few rows is taken whole."""
    require_option(size, TRAINING_SIZES, "training size")
    if size == "full":
        return train
    sizes = oracle_sizes(test, n_folds, y)
    if size == "matched":
        wanted = sizes.select("n_oracle").scalar()
        return sample_n(train, ident, wanted, 1000 + seed)
    positives = sizes.select("n_oracle_pos").scalar()
    negatives = sizes.select(F.col("n_oracle") - F.col("n_oracle_pos")).scalar()
    wanted = F.when(F.col(y) == 1, positives).otherwise(negatives)
    return sample_n(train, ident, wanted, 2000 + seed, keys=[y])


def match_shortage(train: DataFrame, test: DataFrame, n_folds: int = config.N_FOLDS, y: str = "y") -> DataFrame:
    """Wanted and available rows per class for event matching, with a `short` flag."""
    sizes = oracle_sizes(test, n_folds, y)
    have = train.groupBy(y).agg(F.count(F.lit(1)).alias("available"))
    wanted = F.when(F.col(y) == 1, sizes.select("n_oracle_pos").scalar()).otherwise(
        sizes.select(F.col("n_oracle") - F.col("n_oracle_pos")).scalar()
    )
    return have.withColumn("wanted", wanted).withColumn("short", F.col("available") < F.col("wanted"))
