"""Extractors for the source whose clock is minutes since admission.

Column `patientunitstayid` of the raw tables is the stay; results use `stay_id`, as everywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.columns import first_match, hours_from_minutes, like_any, like_none, starts_with_any
from tidemark.operators.concepts import impute_by_group



def _in_cohort(rows: DataFrame, cohort: DataFrame) -> DataFrame:
    return rows.join(cohort.select("stay_id"), "stay_id", "left_semi")


def _minutes(max_hours: float) -> int:
    return int(max_hours * 60)


def lab(
    labs: DataFrame,
    cohort: DataFrame,
    names: Sequence[str] | None = None,
    max_hours: float = config.MAX_HOURS,
    lookback_hours: float = 0.0,
) -> DataFrame:
    """Laboratory values whose name starts with a concept name; all concepts in one scan."""
    concepts = {n: config.OFFSET_LABS[n] for n in (names or config.OFFSET_LABS)}
    _check_prefixes(concepts)
    concept = None
    for name, spec in concepts.items():
        hit = starts_with_any("_name", spec["names"])
        concept = F.when(hit, F.lit(name)) if concept is None else concept.when(hit, F.lit(name))

    def limit(i: int) -> Column:
        return F.create_map(*[x for n, s in concepts.items() for x in (F.lit(n), F.lit(float(s["valid"][i])))])[F.col("concept")]

    rows = (
        labs.where(F.col("labresultoffset").between(-_minutes(lookback_hours), _minutes(max_hours))
                   & F.col("labresult").isNotNull())
        .select(F.col("patientunitstayid").alias("stay_id"), F.lower("labname").alias("_name"),
                hours_from_minutes("labresultoffset").alias("hours"), F.col("labresult").alias("value"))
        .withColumn("concept", concept)
        .where(F.col("concept").isNotNull() & (F.col("value") >= limit(0)) & (F.col("value") <= limit(1)))
        .select("stay_id", "concept", "hours", "value")
    )
    return _in_cohort(rows, cohort)


def _check_prefixes(concepts: dict) -> None:
    """No name may start two concepts: then the first match is the only one."""
    owners = [(p, n) for n, spec in concepts.items() for p in spec["names"]]
    for p, n in owners:
        for q, m in owners:
            if n != m and q.startswith(p):
                raise ValueError(f"lab names {p!r} ({n}) and {q!r} ({m}) overlap")


def vital(
    periodic: DataFrame,
    aperiodic: DataFrame,
    cohort: DataFrame,
    names: Sequence[str] | None = None,
    max_hours: float = config.MAX_HOURS,
) -> DataFrame:
    """Monitor values: the wide periodic table and the aperiodic one, stacked to long form."""
    wanted = list(names or config.OFFSET_PERIODIC)
    unknown = [n for n in wanted if n not in config.OFFSET_PERIODIC and n not in config.OFFSET_APERIODIC]
    if unknown:
        raise KeyError(f"no such vital sign: {unknown}")

    def stacked(table: DataFrame, specs: dict) -> DataFrame | None:
        cells = []
        for name in wanted:
            if name in specs:
                lo, hi = specs[name]["valid"]
                v = F.col(specs[name]["column"]).cast("double")
                cells.append(F.when(v.between(float(lo), float(hi)),
                                    F.struct(F.lit(name).alias("concept"), v.alias("value"))))
        if not cells:
            return None
        return (
            table.where(F.col("observationoffset").between(0, _minutes(max_hours)))
            .withColumn("_cell", F.explode(F.array_compact(F.array(*cells))))
            .select(F.col("patientunitstayid").alias("stay_id"), "_cell.concept",
                    hours_from_minutes("observationoffset").alias("hours"), "_cell.value")
        )

    parts = [p for p in (stacked(periodic, config.OFFSET_PERIODIC), stacked(aperiodic, config.OFFSET_APERIODIC)) if p]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _in_cohort(rows, cohort)


def gcs_total(nurse: DataFrame, cohort: DataFrame, max_hours: float = config.MAX_HOURS) -> DataFrame:
    """Charted totals; where a time has none, the sum of the parts if all three are there.

    A charted total that is not a number blocks the sum of parts, but gives no value itself.
    """
    spec = config.OFFSET_GCS
    lo, hi = spec["valid"]
    rows = nurse.where(F.col("nursingchartoffset").between(0, _minutes(max_hours))).select(
        F.col("patientunitstayid").alias("stay_id"), F.col("nursingchartoffset").alias("_off"),
        F.col("nursingchartcelltypevalname").alias("_kind"),
        F.col("nursingchartvalue").try_cast("double").alias("value"),
    )
    totals = rows.where(F.col("_kind") == spec["total"])
    parts = (
        rows.where(F.col("_kind").isin(spec["parts"]))
        .groupBy("stay_id", "_off")
        .agg(F.sum("value").alias("value"), F.countDistinct("_kind").alias("_parts"))
        .where(F.col("_parts") == len(spec["parts"]))
        .join(totals.select("stay_id", "_off").distinct(), ["stay_id", "_off"], "left_anti")
    )
    merged = totals.select("stay_id", "_off", "value").unionByName(parts.select("stay_id", "_off", "value"))
    return _in_cohort(
        merged.where(F.col("value").between(lo, hi))
        .select("stay_id", hours_from_minutes("_off").alias("hours"), "value"),
        cohort,
    )


def urine_output(intake: DataFrame, cohort: DataFrame, max_hours: float = config.MAX_HOURS) -> DataFrame:
    spec = config.OFFSET_URINE
    lo, hi = spec["valid"]
    rows = (
        intake.where(
            like_any("celllabel", spec["like"])
            & like_none("celllabel", spec["exclude"], case="lower")
            & F.col("cellvaluenumeric").between(float(lo), float(hi))
            & F.col("intakeoutputoffset").between(0, _minutes(max_hours))
        )
        .groupBy(F.col("patientunitstayid").alias("stay_id"), hours_from_minutes("intakeoutputoffset").alias("hours"))
        .agg(F.sum("cellvaluenumeric").alias("value"))
    )
    return _in_cohort(rows, cohort)


def weights(cohort: DataFrame) -> DataFrame:
    """Admission weight in range, else the median of the sex."""
    lo, hi = config.WEIGHT_VALID
    kept = F.when(F.col("weight_kg").between(lo, hi), F.col("weight_kg"))
    return impute_by_group(cohort.select("stay_id", "gender", kept.alias("weight_kg")), "gender", "weight_kg")


def _distinct_times(rows: DataFrame, offset: Column, cohort: DataFrame, max_hours: float, *extra: Column) -> DataFrame:
    picked = (
        rows.withColumn("_off", offset)
        .where(F.col("_off").between(0, _minutes(max_hours)))
        .select(F.col("patientunitstayid").cast("bigint").alias("stay_id"), *extra,
                hours_from_minutes("_off").alias("hours"))
    )
    return _in_cohort(picked.distinct(), cohort)


def ventilated_hours(respiratory: DataFrame, cohort: DataFrame, max_hours: float = config.MAX_HOURS) -> DataFrame:
    return _distinct_times(respiratory, F.col("respchartoffset").try_cast("int"), cohort, max_hours)


def vasopressor_rates(infusions: DataFrame, cohort: DataFrame, max_hours: float = config.MAX_HOURS) -> DataFrame:
    """Which drug ran at which time.  Rates are free text in this source and stay NULL, so
    the circulation score rests on the arterial pressure alone."""
    drug = first_match("drugname", config.OFFSET_INFUSIONS).alias("drug")
    every = [p for _, patterns in config.OFFSET_INFUSIONS for p in patterns]
    rows = infusions.where(like_any("drugname", every))
    times = _distinct_times(rows, F.col("infusionoffset").try_cast("int"), cohort, max_hours, drug)
    return times.withColumn("rate", F.lit(None).cast("double"))


def _treatment_times(treatment: DataFrame, patterns: Sequence[str], cohort: DataFrame, max_hours: float) -> DataFrame:
    return _distinct_times(treatment.where(like_any("treatmentstring", patterns)), F.col("treatmentoffset"),
                           cohort, max_hours)


def culture_times(treatment: DataFrame, cohort: DataFrame, max_hours: float = config.MAX_HOURS) -> DataFrame:
    return _treatment_times(treatment, config.OFFSET_CULTURE, cohort, max_hours)


def antibiotic_times(treatment: DataFrame, cohort: DataFrame, max_hours: float = config.MAX_HOURS) -> DataFrame:
    return _treatment_times(treatment, config.OFFSET_ANTIBIOTIC, cohort, max_hours)
