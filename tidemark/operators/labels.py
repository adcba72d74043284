"""Onsets, suspicion, prevalent cases, label tables and their summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import config
from tidemark.functions.columns import join_groups, require_columns, require_option
from tidemark.operators.cohort import common_cohort
from tidemark.operators.temporal import band_join, next_at_or_after

BASELINE_RULES = ("min_before", "at_prediction", "zero")
PREVALENCE_RULES = ("none", "sofa_at_threshold", "rise_before")
ONSET_RULES = ("later_of_both", "suspicion", "sofa")


def first_onset(staged: DataFrame, min_stage: int = 1) -> DataFrame:
    """First time at or over a stage; of several entries at that time the highest stage."""
    require_columns(staged, ["stay_id", "hours", "stage"])
    return (
        staged.where(F.col("stage") >= min_stage)
        .groupBy("stay_id")
        .agg(F.min_by(F.struct("hours", "stage"), F.struct("hours", -F.col("stage"))).alias("_first"))
        .select("stay_id", F.col("_first.hours").alias("onset_hours"), F.col("_first.stage").alias("onset_stage"))
    )


def _baseline(prediction_hour: float, rule: str) -> Column:
    """Baseline as an aggregate expression over the hours of a stay."""
    require_option(rule, BASELINE_RULES, "baseline rule")
    early = F.col("hour") <= prediction_hour
    if rule == "zero":
        return F.max(F.lit(0))
    if rule == "min_before":
        return F.min(F.when(early, F.col("sofa_total")))
    return F.max_by("sofa_total", F.when(early, F.col("hour")))


def baseline_sofa(
    sofa: DataFrame, prediction_hour: float = config.PREDICTION_HOUR, rule: str = "at_prediction"
) -> DataFrame:
    require_columns(sofa, ["stay_id", "hour", "sofa_total"])
    return (
        sofa.groupBy("stay_id").agg(_baseline(prediction_hour, rule).alias("baseline_sofa"))
        .where(F.col("baseline_sofa").isNotNull())
    )


def _over_baseline(sofa: DataFrame, prediction_hour: float, increase: int, rule: str) -> DataFrame:
    """Hours at least `increase` over the baseline, found on the partitioning the score already has."""
    require_columns(sofa, ["stay_id", "hour", "sofa_total"])
    stay = Window.partitionBy("stay_id")
    return (
        sofa.select("stay_id", "hour", "sofa_total")
        .withColumn("baseline_sofa", _baseline(prediction_hour, rule).over(stay))
        .where(F.col("sofa_total") - F.col("baseline_sofa") >= increase)
    )


def organ_dysfunction_onset(
    sofa: DataFrame,
    prediction_hour: float = config.PREDICTION_HOUR,
    increase: int = 2,
    baseline_rule: str = "at_prediction",
) -> DataFrame:
    """First hour strictly after the prediction hour at which the score has risen enough."""
    late = _over_baseline(sofa, prediction_hour, increase, baseline_rule).where(F.col("hour") > prediction_hour)
    return (
        late.groupBy("stay_id")
        .agg(F.min_by(F.struct("hour", "sofa_total", "baseline_sofa"), "hour").alias("_first"))
        .select("stay_id", F.col("_first.hour").cast("double").alias("onset_hours"),
                F.col("_first.sofa_total").alias("onset_sofa"), F.col("_first.baseline_sofa").alias("baseline_sofa"))
    )


def dysfunction_hours(
    sofa: DataFrame,
    prediction_hour: float = config.PREDICTION_HOUR,
    increase: int = 2,
    baseline_rule: str = "at_prediction",
    after_prediction_only: bool = True,
) -> DataFrame:
    rows = _over_baseline(sofa, prediction_hour, increase, baseline_rule)
    if after_prediction_only:
        rows = rows.where(F.col("hour") > prediction_hour)
    return rows.select("stay_id", "sofa_total", "baseline_sofa", F.col("hour").cast("double").alias("dysfunction_hours"))


# --- suspicion of infection -------------------------------------------------------
def suspicion_of_infection(
    antibiotics: DataFrame,
    cultures: DataFrame,
    abx_then_culture_hours: float = config.ABX_THEN_CULTURE_HOURS,
    culture_then_abx_hours: float = config.CULTURE_THEN_ABX_HOURS,
) -> DataFrame:
    """All antibiotic-culture pairs inside the asymmetric window, with the time of the earlier one.

    The result is the pairs, so its size is theirs; where only the suspicion times matter use
    `suspicion_times`, which builds none.
    """
    require_columns(antibiotics, ["stay_id", "hours"])
    require_columns(cultures, ["stay_id", "hours"])
    pairs = band_join(
        antibiotics.select("stay_id", F.col("hours").alias("abx_hours")),
        cultures.select("stay_id", F.col("hours").alias("culture_hours")),
        "abx_hours", "culture_hours", -culture_then_abx_hours, abx_then_culture_hours,
    )
    abx_first = F.col("culture_hours") >= F.col("abx_hours")
    return pairs.select(
        "stay_id", F.least("abx_hours", "culture_hours").alias("suspicion_hours"), "abx_hours", "culture_hours",
        F.when(abx_first, "abx_first").otherwise("culture_first").alias("order"),
    )


def suspicion_times(
    antibiotics: DataFrame,
    cultures: DataFrame,
    abx_then_culture_hours: float = config.ABX_THEN_CULTURE_HOURS,
    culture_then_abx_hours: float = config.CULTURE_THEN_ABX_HOURS,
) -> DataFrame:
    """Distinct (stay_id, suspicion_hours) of those pairs without building them.

    An antibiotic time counts if a culture follows within its window, a culture time if an
    antibiotic follows strictly later within its own.
    """
    abx = antibiotics.select("stay_id", "hours").distinct()
    cul = cultures.select("stay_id", "hours").distinct()
    by_abx = next_at_or_after(abx, cul, 0.0, "_next").where(F.col("_next") - F.col("hours") <= abx_then_culture_hours)
    by_culture = next_at_or_after(cul, abx, 0.0, "_next", strict=True).where(
        F.col("_next") - F.col("hours") <= culture_then_abx_hours
    )
    return by_abx.unionByName(by_culture).select("stay_id", F.col("hours").alias("suspicion_hours")).distinct()


def _suspected(suspicion: DataFrame) -> DataFrame:
    return suspicion.select("stay_id", "suspicion_hours").distinct()


def sepsis3_onset(
    sofa: DataFrame,
    suspicion: DataFrame,
    prediction_hour: float = config.PREDICTION_HOUR,
    increase: int = 2,
    window_before: float = config.DYSFUNCTION_BEFORE_HOURS,
    window_after: float = config.DYSFUNCTION_AFTER_HOURS,
    onset_rule: str = "later_of_both",
    baseline_rule: str = "at_prediction",
) -> DataFrame:
    """Earliest onset after the prediction hour where dysfunction lies in the window around suspicion.

    All three onset rules are non-decreasing in the dysfunction hour, so for each suspicion only the
    first dysfunction hour at or after the start of its window can decide.
    """
    require_option(onset_rule, ONSET_RULES, "onset rule")
    dys = dysfunction_hours(sofa, prediction_hour, increase, baseline_rule).select("stay_id", "dysfunction_hours")
    s, d = F.col("suspicion_hours"), F.col("dysfunction_hours")
    onset = {"later_of_both": F.greatest(s, d), "suspicion": s, "sofa": d}[onset_rule]
    return (
        next_at_or_after(_suspected(suspicion), dys, -window_before, "dysfunction_hours",
                         probe_time="suspicion_hours", target_time="dysfunction_hours")
        .where(d - s <= window_after)
        .withColumn("onset_hours", onset)
        .where(F.col("onset_hours") > prediction_hour)
        .groupBy("stay_id")
        .agg(F.min(F.struct("onset_hours", "suspicion_hours", "dysfunction_hours")).alias("_first"))
        .select("stay_id", "_first.*")
    )


# --- prevalent cases --------------------------------------------------------------
def no_stays(like: DataFrame) -> DataFrame:
    """Empty (stay_id) frame."""
    return like.sparkSession.createDataFrame([], T.StructType([like.schema["stay_id"]]))


def prevalent_from_onsets(onsets: DataFrame, prediction_hour: float = config.PREDICTION_HOUR) -> DataFrame:
    return onsets.where(F.col("onset_hours") <= prediction_hour).select("stay_id")


def prevalent_dysfunction(
    sofa: DataFrame, prediction_hour: float = config.PREDICTION_HOUR, increase: int = 2, rule: str = "none"
) -> DataFrame:
    require_option(rule, PREVALENCE_RULES, "prevalence rule")
    if rule == "none":
        return no_stays(sofa)
    both = sofa.groupBy("stay_id").agg(
        _baseline(prediction_hour, "at_prediction").alias("_at"),
        _baseline(prediction_hour, "min_before").alias("_low"),
    )
    level = F.col("_at") if rule == "sofa_at_threshold" else F.col("_at") - F.col("_low")
    return both.where(level >= increase).select("stay_id")


def prevalent_sepsis3(
    sofa: DataFrame,
    suspicion: DataFrame,
    prediction_hour: float = config.PREDICTION_HOUR,
    increase: int = 2,
    window_before: float = config.DYSFUNCTION_BEFORE_HOURS,
    window_after: float = config.DYSFUNCTION_AFTER_HOURS,
    rule: str = "none",
) -> DataFrame:
    require_option(rule, PREVALENCE_RULES, "prevalence rule")
    if rule == "none":
        return no_stays(sofa)
    baseline = "zero" if rule == "sofa_at_threshold" else "min_before"
    dys = dysfunction_hours(sofa, prediction_hour, increase, baseline, after_prediction_only=False).where(
        F.col("dysfunction_hours") <= prediction_hour
    )
    early = _suspected(suspicion).where(F.col("suspicion_hours") <= prediction_hour)
    return (
        next_at_or_after(early, dys, -window_before, "dysfunction_hours",
                         probe_time="suspicion_hours", target_time="dysfunction_hours")
        .where(F.col("dysfunction_hours") - F.col("suspicion_hours") <= window_after)
        .select("stay_id").distinct()
    )


# --- tables and summaries -----------------------------------------------------------
def stack_onsets(onsets: Mapping[str, DataFrame]) -> DataFrame:
    """(label, stay_id, onset_hours) of all labels."""
    out = None
    for label, frame in onsets.items():
        rows = frame.select(F.lit(label).alias("label"), "stay_id", "onset_hours")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no label was given")
    return out


def label_table(
    cohort: DataFrame,
    onsets: Mapping[str, DataFrame],
    prediction_hour: float = config.PREDICTION_HOUR,
    horizon: float = config.HORIZON_HOURS,
) -> DataFrame:
    """Cohort with one 0/1 column per label: 1 iff prediction hour < onset <= horizon."""
    inside = (F.col("onset_hours") > prediction_hour) & (F.col("onset_hours") <= horizon)
    hits = (
        stack_onsets(onsets).where(inside).groupBy("stay_id")
        .agg(*[F.max((F.col("label") == name).cast("int")).alias(name) for name in onsets])
    )
    return cohort.join(hits, "stay_id", "left").withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in onsets})


def summarise_onsets(
    onsets: Mapping[str, DataFrame],
    cohort: DataFrame,
    prediction_hour: float = config.PREDICTION_HOUR,
    horizons: Sequence[float] = tuple(config.SUMMARY_HORIZONS),
    group: str = "epoch",
) -> DataFrame:
    """Per label and group: ever, early, eligible, events and prevalence per horizon, onset quartiles.

    Quartiles interpolate linearly.  Onset hours are whole seconds of the followed time, so the
    number of distinct values, and with it the buffer of `percentile`, is bounded.
    """
    names = F.array(*[F.lit(n) for n in onsets])
    base = cohort.select("stay_id", group).withColumn("label", F.explode(names))
    df = base.join(stack_onsets(onsets), ["label", "stay_id"], "left")
    onset = F.col("onset_hours")
    counts = df.groupBy("label", group).agg(
        F.count(F.lit(1)).alias("n_stays"),
        F.count("onset_hours").alias("n_ever_onset"),
        F.count_if(onset <= prediction_hour).alias("n_onset_early"),
        *[F.count_if((onset > prediction_hour) & (onset <= h)).alias(f"n_events_{int(h)}h") for h in horizons],
        F.percentile("onset_hours", F.lit(0.25)).alias("onset_hours_q25"),
        F.percentile("onset_hours", F.lit(0.5)).alias("onset_hours_median"),
        F.percentile("onset_hours", F.lit(0.75)).alias("onset_hours_q75"),
    )
    early, eligible = F.col("n_onset_early"), F.col("n_stays") - F.col("n_onset_early")
    return counts.withColumns({
        "frac_early_of_onsets": F.try_divide(early, F.col("n_ever_onset")),
        "n_eligible": eligible,
        "frac_lost_to_early": early / F.col("n_stays"),
        **{f"prevalence_{int(h)}h": F.try_divide(F.col(f"n_events_{int(h)}h"), eligible) for h in horizons},
    })


def design_grid(
    cohort: DataFrame,
    sofa: DataFrame,
    suspicion: DataFrame,
    fixed_onsets: Mapping[str, DataFrame],
    baseline_rules: Sequence[str] = ("at_prediction", "min_before", "zero"),
    prediction_hours: Sequence[float] = (4.0, 6.0),
    horizons: Sequence[float] = (48.0, 72.0),
) -> DataFrame:
    """Counts per (baseline rule, prediction hour, horizon, label, epoch).

    `fixed_onsets` do not depend on the rule; their early cases define the common cohort.  The
    grid multiplies one shared score frame, which the caller should have persisted or checkpointed.
    """
    cells = None
    for hour in prediction_hours:
        prevalent = {n: prevalent_from_onsets(o, hour) for n, o in fixed_onsets.items()}
        common = common_cohort(cohort, prevalent)[1].select("epoch", "n_common_cohort", "frac_retained")
        for rule in baseline_rules:
            onsets = {
                **fixed_onsets,
                "sofa_dysfunction": organ_dysfunction_onset(sofa, hour, baseline_rule=rule),
                "sepsis3": sepsis3_onset(sofa, suspicion, hour, baseline_rule=rule),
            }
            summary = join_groups(summarise_onsets(onsets, cohort, hour, horizons), common, ["epoch"])
            per_horizon = F.explode(F.array(*[
                F.struct(F.lit(float(h)).alias("horizon"), F.col(f"n_events_{int(h)}h").alias("n_events"),
                         F.col(f"prevalence_{int(h)}h").alias("prevalence"))
                for h in horizons
            ]))
            cell = summary.withColumn("_h", per_horizon).select(
                F.lit(rule).alias("baseline_rule"), F.lit(float(hour)).alias("prediction_hour"), "_h.horizon",
                "label", "epoch", "n_common_cohort", "frac_retained", "_h.n_events", "_h.prevalence",
                "frac_early_of_onsets", "onset_hours_median",
            )
            cells = cell if cells is None else cells.unionByName(cell)
    return cells


def action_rates(
    cohort: DataFrame, antibiotics: DataFrame, cultures: DataFrame, suspicion: DataFrame,
    horizon: float = config.HORIZON_HOURS,
) -> DataFrame:
    """Share of stays per epoch with an antibiotic, a culture (both in [0, horizon]) and a suspicion."""
    inside = F.col("hours").between(0, horizon)
    hits = (
        antibiotics.where(inside).select("stay_id", F.lit("abx").alias("_what"))
        .unionByName(cultures.where(inside).select("stay_id", F.lit("culture").alias("_what")))
        .unionByName(suspicion.select("stay_id", F.lit("suspicion").alias("_what")))
        .groupBy("stay_id")
        .agg(*[F.max((F.col("_what") == w).cast("double")).alias(w) for w in ("abx", "culture", "suspicion")])
    )
    return (
        cohort.select("stay_id", "epoch").join(hits, "stay_id", "left").groupBy("epoch")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.coalesce("abx", F.lit(0.0))).alias("frac_antibiotic"),
            F.avg(F.coalesce("culture", F.lit(0.0))).alias("frac_culture"),
            F.avg(F.coalesce("suspicion", F.lit(0.0))).alias("frac_suspicion"),
        )
    )


def convention_prevalence(
    cohort: DataFrame, onsets: Mapping[str, DataFrame], horizon: float = config.HORIZON_HOURS
) -> DataFrame:
    """Share per epoch with any onset up to the horizon (used with zero-baseline onsets)."""
    early = stack_onsets(onsets).where(F.col("onset_hours") <= horizon)
    hits = early.groupBy("stay_id").agg(
        *[F.max((F.col("label") == n).cast("double")).alias(f"_{n}") for n in onsets]
    )
    return (
        cohort.select("stay_id", "epoch").join(hits, "stay_id", "left").groupBy("epoch")
        .agg(F.count(F.lit(1)).alias("n"),
             *[F.avg(F.coalesce(F.col(f"_{n}"), F.lit(0.0))).alias(f"prev_{n}") for n in onsets])
    )
