"""Staged lab and urine labels, oxygenation ratio, hourly organ score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.columns import inspired_fraction, require_columns, require_option, score_card
from tidemark.operators.temporal import asof_backward, ms, rolling_extreme, tick

# Stage rules
RATIO_STAGE_1, RATIO_STAGE_2, RATIO_STAGE_3 = 1.5, 2.0, 3.0
RISE_48H = 0.3
LEVEL_STAGE_3 = 4.0
URINE_WINDOWS = (6, 12, 24)

# Cut-offs to points
COAGULATION = [(20, 4), (50, 3), (100, 2), (150, 1)]
LIVER = [(12.0, 4), (6.0, 3), (2.0, 2), (1.2, 1)]
CNS = [(6, 4), (10, 3), (13, 2), (15, 1)]
RENAL_CREATININE = [(5.0, 4), (3.5, 3), (2.0, 2), (1.2, 1)]
RENAL_URINE = [(200, 4), (500, 3)]
COMPONENTS = ["sofa_resp", "sofa_coag", "sofa_liver", "sofa_cardio", "sofa_cns", "sofa_renal"]

# Look-back of the worst value, in hours
LAB_HOURS, VITAL_HOURS, URINE_HOURS = 24, 4, 24
MIN_CHARTED_HOURS = 6

# Rows of the hour grid that one task is meant to hold
HOURS_PER_TASK = 200_000


def creatinine_stage(
    creatinine: DataFrame, baseline: str = "rolling_min_7d", baseline_hours: float = 168.0, per_tick: bool = False
) -> DataFrame:
    """Rows with base_7d, min_48h and stage 0..3.

    `per_tick` gives one row per (stay, time) with the largest value there, which is all that an onset
    needs; otherwise the baselines are joined back to every row.
    """
    require_columns(creatinine, ["stay_id", "hours", "value"])
    require_option(baseline, ("rolling_min_7d", "first_of_stay"), "baseline")
    rows = creatinine.where(F.col("value").isNotNull())
    ticks = rows.groupBy("stay_id", "hours").agg(F.max("value").alias("value"), F.min("value").alias("_low"))
    ticks = rolling_extreme(ticks, "_low", 48.0, "min_48h")
    if baseline == "rolling_min_7d":
        ticks = rolling_extreme(ticks, "_low", baseline_hours, "base_7d")
    else:
        inside = F.when(F.col("hours") >= 0, F.struct("hours", "_low"))
        ticks = ticks.withColumn("base_7d", F.min(inside).over(Window.partitionBy("stay_id"))["_low"])
    ticks = ticks.drop("_low")
    if not per_tick:
        ticks = rows.join(ticks.drop("value"), ["stay_id", "hours"])
    value, ratio = F.col("value"), F.try_divide(F.col("value"), F.col("base_7d"))
    stage = (
        F.when((ratio >= RATIO_STAGE_3) | (value >= LEVEL_STAGE_3), 3)
        .when(ratio >= RATIO_STAGE_2, 2)
        .when((ratio >= RATIO_STAGE_1) | (value >= F.col("min_48h") + RISE_48H), 1)
        .otherwise(0)
    )
    return ticks.withColumn("stage", stage)


def urine_output_stage(
    urine: DataFrame,
    weight: DataFrame,
    min_coverage_ratio: float = 0.75,
    max_gap_hours: float = 4.0,
) -> DataFrame:
    """One row per (stay, time) with rate_6h, rate_12h, rate_24h (ml/kg/h), evaluable and stage.

    Volume over (t - w, t] is divided by the time since the last entry at or before t - w (since
    admission if there is none).  Volumes are summed as fixed-point numbers, which makes the
    difference of two running totals exact.
    """
    require_columns(urine, ["stay_id", "hours", "value"])
    require_columns(weight, ["stay_id", "weight_kg"])
    ticks = (
        urine.where(F.col("value") >= 0)
        .groupBy("stay_id", "hours")
        .agg(F.sum(F.col("value").cast("decimal(24,9)")).alias("_v"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_t", tick("hours"))
    )
    order = Window.partitionBy("stay_id").orderBy("_t")
    ticks = ticks.withColumns({
        "_run_v": F.sum("_v").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "_run_n": F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)),
    })
    # Running totals never fall, so the total at the anchor is the largest one at or before t - w.
    anchors = {}
    for w in URINE_WINDOWS:
        older = order.rangeBetween(Window.unboundedPreceding, -ms(w))
        anchors[f"_prev_{w}"] = F.coalesce(F.max("hours").over(older), F.lit(0.0))
        anchors[f"_old_v_{w}"] = F.coalesce(F.max("_run_v").over(older), F.lit(0))
        anchors[f"_old_n_{w}"] = F.coalesce(F.max("_run_n").over(older), F.lit(0))
    out = ticks.withColumns(anchors).join(weight.select("stay_id", "weight_kg"), "stay_id", "left")
    rates = {}
    for w in URINE_WINDOWS:
        covered = F.col("hours") - F.col(f"_prev_{w}")
        volume = (F.col("_run_v") - F.col(f"_old_v_{w}")).cast("double")
        usable = covered.between(min_coverage_ratio * w, w / min_coverage_ratio) & (
            F.col("_run_n") - F.col(f"_old_n_{w}") >= w / max_gap_hours
        )
        rates[f"rate_{w}h"] = F.when(usable, volume / F.nullif(covered, F.lit(0.0)) / F.nullif("weight_kg", F.lit(0.0)))
    out = out.withColumns(rates)
    r6, r12, r24 = (F.col(f"rate_{w}h") for w in URINE_WINDOWS)
    evaluable = r6.isNotNull() | r12.isNotNull() | r24.isNotNull()
    stage = (
        F.when(~evaluable, F.lit(None).cast("int"))
        .when((r24 < 0.3) | (r12 <= 0.0), 3)
        .when(r12 < 0.5, 2)
        .when(r6 < 0.5, 1)
        .otherwise(0)
    )
    return out.select("stay_id", "hours", F.col("_v").cast("double").alias("value"), "weight_kg",
                      "rate_6h", "rate_12h", "rate_24h", evaluable.alias("evaluable"), stage.alias("stage"))


def pf_ratio_events(
    pao2: DataFrame, fio2: DataFrame, tolerance_hours: float = config.FIO2_TOLERANCE_HOURS
) -> DataFrame:
    """Arterial oxygen over the inspired fraction in force, room air where none is recent enough."""
    require_columns(pao2, ["stay_id", "hours", "value"])
    require_columns(fio2, ["stay_id", "hours", "value"])
    fractions = fio2.withColumn("value", inspired_fraction("value"))
    matched = asof_backward(pao2.where(F.col("value").isNotNull()), fractions, "_fio2", tolerance_hours)
    return matched.select("stay_id", "hours",
                          (F.col("value") / F.coalesce("_fio2", F.lit(config.ROOM_AIR_FIO2))).alias("value"))


def score_events(
    measurements: DataFrame,
    gcs: DataFrame,
    ventilated: DataFrame,
    urine: DataFrame,
    vasopressors: DataFrame,
) -> DataFrame:
    """All inputs of the hourly score as one long frame (stay_id, concept, hours, value).

    `measurements` is the long frame of labs and charted values; concepts the score does not
    use are ignored.
    """
    used = ["pao2", "fio2", "platelets", "bilirubin_total", "creatinine", "map"]
    parts = [
        measurements.where(F.col("concept").isin(used)).select("stay_id", "concept", "hours", "value"),
        gcs.select("stay_id", F.lit("gcs").alias("concept"), "hours", "value"),
        ventilated.select("stay_id", F.lit("ventilated").alias("concept"), "hours", F.lit(1.0).alias("value")),
        urine.select("stay_id", F.lit("urine").alias("concept"), "hours", "value"),
        vasopressors.select("stay_id", F.concat(F.lit("rate_"), "drug").alias("concept"), "hours",
                            F.col("rate").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("value").isNotNull())


def _hour_tasks(ends: DataFrame) -> int:
    """Tasks for the grid up to `_last` of every stay, so that none holds much more than HOURS_PER_TASK hours."""
    hours = ends.agg(F.sum(F.col("_last").cast("bigint") + 1)).first()[0] or 0
    return max(ends.sparkSession.sparkContext.defaultParallelism, -(-hours // HOURS_PER_TASK))


def hourly_sofa(events: DataFrame, stays: DataFrame, tolerance_hours: float = config.FIO2_TOLERANCE_HOURS) -> DataFrame:
    """Organ score for every hour of every stay: worst values, six components, total, missing count.

    Two exchanges: one aggregate per (stay, tick) of the events, then everything per stay.  The second carries
    the ticks and one row per stay with its last hour; the hours without an event are added behind it, where each
    known hour is stretched up to the next one.  So neither a map task nor a shuffle holds the hour grid, and
    the number of tasks behind the exchange follows the number of hours.
    """
    last = F.ceil("max_hours").cast("int")
    ends = stays.where(last >= 0).select("stay_id", F.lit(0).cast("bigint").alias("_t"), last.alias("_last"))

    def only(concept: str) -> Column:
        return F.when(F.col("concept") == concept, F.col("value"))

    rates = [f"rate_{d}" for d in config.SCORED_PRESSORS]
    fraction = inspired_fraction(only("fio2"))
    ticks = (
        events.groupBy("stay_id", tick("hours").alias("_t"))
        .agg(
            F.min(only("pao2")).alias("pao2"),
            F.max(fraction).alias("fio2"),
            F.max(only("ventilated")).alias("vent"),
            F.min(only("platelets")).alias("platelets"),
            F.max(only("bilirubin_total")).alias("bilirubin"),
            F.max(only("creatinine")).alias("creatinine"),
            F.min(only("map")).alias("map"),
            F.min(only("gcs")).alias("gcs"),
            F.sum(only("urine")).alias("urine"),
            *[F.max(only(r)).alias(r) for r in rates],
        )
        .unionByName(ends, allowMissingColumns=True)
        .repartition(_hour_tasks(ends), "stay_id")
    )
    until_now = Window.partitionBy("stay_id").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    recent = F.last(F.when(F.col("fio2").isNotNull(), F.struct("_t", "fio2")), ignorenulls=True).over(until_now)
    in_force = F.when(F.col("_t") - F.col("_recent._t") <= ms(tolerance_hours), F.col("_recent.fio2"))
    hours = (
        ticks.withColumn("_recent", recent)
        .withColumn("pf", F.col("pao2") / F.coalesce(in_force, F.lit(config.ROOM_AIR_FIO2)))
        .groupBy("stay_id", F.floor(F.col("_t") / float(ms(1))).cast("int").alias("hour"))
        .agg(
            F.max("_last").alias("_last"),
            F.min("pf").alias("pf"),
            F.max("vent").alias("vent"),
            *[F.min(c).alias(c) for c in ("platelets", "map", "gcs")],
            *[F.max(c).alias(c) for c in ("bilirubin", "creatinine", *rates)],
            F.sum("urine").alias("urine"),
        )
    )
    # The row with the last hour lies in hour 0; what comes before it, or has none, is outside the grid.
    order = Window.partitionBy("stay_id").orderBy("hour")
    known = hours.withColumns({
        "_last": F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "_next": F.lead("hour").over(order),
    }).where(F.col("hour") <= F.col("_last"))
    values = [c for c in hours.columns if c not in ("stay_id", "hour", "_last")]
    stretch = F.sequence("hour", F.least(F.col("_next") - 1, F.col("_last")))
    hours = (
        known.withColumn("_hour", F.explode(stretch))
        .select("stay_id", F.col("_hour").alias("hour"),
                *[F.when(F.col("_hour") == F.col("hour"), F.col(c)).alias(c) for c in values])
    )

    def last_hours(n: int):
        return Window.partitionBy("stay_id").orderBy("hour").rowsBetween(-(n - 1), 0)

    labs, vitals, day = last_hours(LAB_HOURS), last_hours(VITAL_HOURS), last_hours(URINE_HOURS)
    full_day = (F.count(F.lit(1)).over(day) == URINE_HOURS) & (F.count("urine").over(day) >= MIN_CHARTED_HOURS)
    worst = hours.select(
        "stay_id", "hour",
        F.min("pf").over(labs).alias("pf_ratio"),
        F.coalesce(F.max("vent").over(labs) > 0, F.lit(False)).alias("ventilated"),
        F.min("platelets").over(labs).alias("platelets"),
        F.max("bilirubin").over(labs).alias("bilirubin"),
        F.max("creatinine").over(labs).alias("creatinine"),
        F.min("map").over(vitals).alias("map"),
        F.min("gcs").over(vitals).alias("gcs"),
        *rates,
        F.when(full_day, F.sum("urine").over(day)).alias("urine_24h"),
    )
    scored = worst.withColumns(component_scores())
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in COMPONENTS[1:]), F.coalesce(F.col(COMPONENTS[0]), F.lit(0)))
    missing = sum((F.col(c).isNull().cast("int") for c in COMPONENTS[1:]), F.col(COMPONENTS[0]).isNull().cast("int"))
    return scored.withColumn("sofa_total", total).withColumn("sofa_components_missing", missing)


def component_scores() -> dict[str, Column]:
    """The six component expressions over the columns of the hourly frame."""
    pf, vent = F.col("pf_ratio"), F.col("ventilated")
    respiration = (
        F.when(pf.isNull(), F.lit(None).cast("int"))
        .when((pf < 100) & vent, 4).when((pf < 200) & vent, 3).when(pf < 300, 2).when(pf < 400, 1).otherwise(0)
    )
    ne, ep, dop, dob = (F.col(f"rate_{d}") for d in config.SCORED_PRESSORS)
    pressure = F.col("map")
    running = ne.isNotNull() | ep.isNotNull() | dop.isNotNull() | dob.isNotNull()
    circulation = (
        F.when(pressure.isNull() & ~running, F.lit(None).cast("int"))
        .when((dop > 15) | (ne > 0.1) | (ep > 0.1), 4)
        .when((dop > 5) | (ne > 0) | (ep > 0), 3)
        .when((dop > 0) | (dob > 0), 2)
        .when(pressure < 70, 1)
        .otherwise(0)
    )
    # greatest() skips NULL and is NULL only if both are.
    renal = F.greatest(
        score_card("creatinine", RENAL_CREATININE, "from"), score_card("urine_24h", RENAL_URINE, "below")
    )
    return {
        "sofa_resp": respiration,
        "sofa_coag": score_card("platelets", COAGULATION, "below"),
        "sofa_liver": score_card("bilirubin", LIVER, "from"),
        "sofa_cardio": circulation,
        "sofa_cns": score_card("gcs", CNS, "below"),
        "sofa_renal": renal,
    }


def component_availability(sofa: DataFrame, cohort: DataFrame, hour: int = 6) -> DataFrame:
    """Share of stays per epoch with each component known at the given hour."""
    return (
        sofa.where(F.col("hour") == hour).join(cohort.select("stay_id", "epoch"), "stay_id")
        .groupBy("epoch")
        .agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in COMPONENTS], F.count(F.lit(1)).alias("n"))
    )
