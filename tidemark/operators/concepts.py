"""Raw clinical tables to event frames (stay_id, concept, hours, value), timestamp clock.

Every extractor filters on item ids and ranges first, so both reach the Parquet scan, and
then joins the cohort.  All concepts of a table come from one scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.columns import (
    contains_any,
    hours_between,
    like_none,
    rate_mcg_kg_min,
    require_option,
    within_hours,
)
from tidemark.functions.ranked import medians
from tidemark.session import cut_lineage


def by_item(concepts: Mapping[str, Mapping], entry) -> Column:
    """Constant lookup from the item id to entry(concept name, its settings)."""
    pairs = [x for name, spec in concepts.items() for i in spec["itemids"] for x in (F.lit(i), F.lit(entry(name, spec)))]
    return F.create_map(*pairs)[F.col("itemid").cast("int")]


def extract(
    events: DataFrame,
    cohort: DataFrame,
    concepts: Mapping[str, Mapping],
    key: str,
    before_hours: float,
    after_hours: float,
    time: str = "charttime",
    value: str = "valuenum",
) -> DataFrame:
    """Valid values of all concepts in [admission - before, admission + after], one scan.

    An item belongs to one concept.
    """
    ids = [i for spec in concepts.values() for i in spec["itemids"]]
    low, high = by_item(concepts, lambda _, s: float(s["valid"][0])), by_item(concepts, lambda _, s: float(s["valid"][1]))
    tagged = (
        events.where(F.col("itemid").isin(ids) & F.col(value).isNotNull())
        .where((F.col(value) >= low) & (F.col(value) <= high))
        .select(key, F.col(time).alias("_t"), F.col(value).cast("double").alias("value"),
                by_item(concepts, lambda name, _: name).alias("concept"))
    )
    return (
        tagged.join(cohort.select(*{key, "stay_id"}, "intime"), key)
        .where(within_hours("intime", "_t", before_hours, after_hours))
        .select("stay_id", "concept", hours_between("intime", "_t").alias("hours"), "value")
    )


def _pick(concepts: Mapping[str, Mapping], names: Sequence[str] | None) -> dict:
    return dict(concepts) if names is None else {n: concepts[n] for n in names}


def lab(
    labevents: DataFrame,
    cohort: DataFrame,
    names: Sequence[str] | None = None,
    max_hours: float = config.MAX_HOURS,
    lookback_days: int = config.LAB_LOOKBACK_DAYS,
    concepts: Mapping[str, Mapping] = config.LAB_CONCEPTS,
) -> DataFrame:
    """Laboratory values by admission, looking back some days before the stay."""
    return extract(labevents, cohort, _pick(concepts, names), "hadm_id", lookback_days * 24, max_hours)


def chart(
    chartevents: DataFrame,
    cohort: DataFrame,
    names: Sequence[str] | None = None,
    max_hours: float = config.MAX_HOURS,
    concepts: Mapping[str, Mapping] = config.CHART_CONCEPTS,
) -> DataFrame:
    """Charted values by stay, from admission on."""
    return extract(chartevents, cohort, _pick(concepts, names), "stay_id", 0, max_hours)


#: Which chart items the extractors below read.
CHART_FAMILIES = {
    "chart": sorted({i for spec in config.CHART_CONCEPTS.values() for i in spec["itemids"]}),
    "gcs": sorted(config.GCS_PART_ITEMS.values()),
    "ventilation": sorted(config.VENTILATION_ITEMS),
    "weight": sorted({i for c in ("weight_kg", "weight_lbs") for i in config.CHART_CONCEPTS[c]["itemids"]}),
}


def route_charts(chartevents: DataFrame, cohort: DataFrame, max_hours: float = config.MAX_HOURS) -> DataFrame:
    """The chart rows that any extractor can use, by family: one scan, one cohort join, written partitioned by `family`.

    Rows up to the end of the longest window of each stay of the cohort; a row whose item serves two families stands in both.  `family_of`
    reads one family, by partition pruning, as a chart table for the extractors.
    """
    items = sorted({i for ids in CHART_FAMILIES.values() for i in ids})
    serves = [x for i in items for x in (F.lit(i), F.array(*[F.lit(f) for f, ids in CHART_FAMILIES.items() if i in ids]))]
    last = F.col("intime") + F.expr(f"INTERVAL {int(max(max_hours, config.WEIGHT_WINDOW_HOURS)) + 1} HOUR")
    rows = (
        chartevents.where(F.col("itemid").isin(items) & (F.col("valuenum").isNotNull() | F.col("value").isNotNull()))
        .select("stay_id", "itemid", "charttime", "valuenum", "value")
        .join(cohort.select("stay_id", "intime"), "stay_id").where(F.col("charttime") <= last).drop("intime")
    )
    return cut_lineage(rows.withColumn("family", F.explode(F.create_map(*serves)[F.col("itemid").cast("int")])), "family")


def family_of(routed: DataFrame, family: str) -> DataFrame:
    return routed.where(F.col("family") == family).drop("family")


def one_concept(long: DataFrame, name: str) -> DataFrame:
    return long.where(F.col("concept") == name).select("stay_id", "hours", "value")


def gcs_total(chartevents: DataFrame, cohort: DataFrame, max_hours: float = config.MAX_HOURS) -> DataFrame:
    """Sum of the three parts when all of them stand at the same chart time."""
    parts = config.GCS_PART_ITEMS
    pivot = (
        chartevents.where(F.col("itemid").isin(list(parts.values())) & F.col("valuenum").isNotNull())
        .groupBy("stay_id", "charttime")
        .agg(*[F.max(F.when(F.col("itemid") == i, F.col("valuenum"))).alias(p) for p, i in parts.items()])
        .dropna(subset=list(parts))
    )
    return (
        pivot.join(cohort.select("stay_id", "intime"), "stay_id")
        .where(within_hours("intime", "charttime", 0, max_hours))
        .select("stay_id", hours_between("intime", "charttime").alias("hours"),
                (F.col("eye") + F.col("verbal") + F.col("motor")).alias("value"))
    )


def ventilated_hours(chartevents: DataFrame, cohort: DataFrame, max_hours: float = config.MAX_HOURS) -> DataFrame:
    """Distinct times at which any ventilator setting or mode was charted."""
    return (
        chartevents.where(
            F.col("itemid").isin(config.VENTILATION_ITEMS)
            & (F.col("valuenum").isNotNull() | F.col("value").isNotNull())
        )
        .select("stay_id", "charttime")
        .join(cohort.select("stay_id", "intime"), "stay_id")
        .where(within_hours("intime", "charttime", 0, max_hours))
        .select("stay_id", hours_between("intime", "charttime").alias("hours"))
        .distinct()
    )


def urine_output(outputevents: DataFrame, cohort: DataFrame, max_hours: float = config.MAX_HOURS) -> DataFrame:
    """Signed volume per stay and time; irrigant counts negative."""
    lo, hi = config.URINE_VALID
    signed = F.when(F.col("itemid").isin(config.URINE_SUBTRACT_ITEMS), -F.col("value")).otherwise(F.col("value"))
    return (
        outputevents.where(
            F.col("itemid").isin(config.URINE_ITEMS + config.URINE_SUBTRACT_ITEMS)
            & F.col("value").between(float(lo), float(hi))
        )
        .select("stay_id", "charttime", signed.alias("value"))
        .join(cohort.select("stay_id", "intime"), "stay_id")
        .where(within_hours("intime", "charttime", 0, max_hours))
        .groupBy("stay_id", hours_between("intime", "charttime").alias("hours"))
        .agg(F.sum("value").alias("value"))
    )


def weights(chartevents: DataFrame, cohort: DataFrame, first_plausible: bool = False) -> DataFrame:
    """First weight within 48 h in kg, else the median of the sex, with an imputed flag.

    By default an implausible first weight is imputed; `first_plausible` takes the first
    plausible one instead.
    """
    pounds = config.CHART_CONCEPTS["weight_lbs"]["itemids"]
    items = config.CHART_CONCEPTS["weight_kg"]["itemids"] + pounds
    lo, hi = config.WEIGHT_VALID
    kg = F.when(F.col("itemid").isin(pounds), F.col("valuenum") * config.LB_TO_KG).otherwise(F.col("valuenum"))
    rows = (
        chartevents.where(F.col("itemid").isin(items) & F.col("valuenum").isNotNull())
        .select("stay_id", "itemid", "charttime", kg.alias("_kg"))
        .join(cohort.select("stay_id", "intime"), "stay_id")
        .where(F.col("charttime") <= F.col("intime") + F.expr(f"INTERVAL {config.WEIGHT_WINDOW_HOURS} HOUR"))
    )
    if first_plausible:
        rows = rows.where(F.col("_kg").between(lo, hi))
    first = (
        rows.groupBy("stay_id")
        .agg(F.min_by("_kg", F.struct("charttime", "itemid", "_kg")).alias("weight_kg"))
        .where(F.col("weight_kg").between(lo, hi))
    )
    return impute_by_group(cohort.select("stay_id", "gender").join(first, "stay_id", "left"), "gender", "weight_kg")


def impute_by_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """Missing values replaced by the median of their group: (stay_id, value, weight_imputed)."""
    fallback = medians(df, [group], value).withColumnRenamed("median", "_fallback")
    return df.join(fallback, group, "left").select(
        "stay_id",
        F.coalesce(value, "_fallback").alias(value),
        F.col(value).isNull().alias("weight_imputed"),
    )


def explode_hours(intervals: DataFrame, start: str, end: str, max_hours: float) -> DataFrame:
    """One row per hour from floor(start) to ceil(end), cut to [0, max]; empty intervals vanish."""
    lo = F.greatest(F.floor(start), F.lit(0))
    hi = F.least(F.ceil(end), F.lit(int(max_hours)))
    return intervals.where(lo <= hi).withColumn("_h", F.explode(F.sequence(lo, hi))).withColumn(
        "hours", F.col("_h").cast("double")
    ).drop("_h")


def vasopressor_rates(
    inputevents: DataFrame, cohort: DataFrame, weight: DataFrame, max_hours: float = config.MAX_HOURS
) -> DataFrame:
    """Rate in mcg/kg/min of each scored drug for every hour its infusion touches."""
    drug = None
    for name in config.SCORED_PRESSORS:
        hit = F.col("itemid").isin(config.INPUT_CONCEPTS[name])
        drug = F.when(hit, F.lit(name)) if drug is None else drug.when(hit, F.lit(name))
    items = [i for n in config.SCORED_PRESSORS for i in config.INPUT_CONCEPTS[n]]
    infusions = (
        inputevents.where(F.col("itemid").isin(items) & (F.col("rate") > 0))
        .select("stay_id", drug.alias("drug"), "rate", "rateuom", "starttime", "endtime")
        .join(cohort.select("stay_id", "intime"), "stay_id")
        .where((F.col("endtime") >= F.col("intime"))
               & (F.col("starttime") <= F.col("intime") + F.expr(f"INTERVAL {int(max_hours)} HOUR")))
        .join(weight.select("stay_id", "weight_kg"), "stay_id", "left")
        .select("stay_id", "drug", rate_mcg_kg_min("rate", "rateuom", "weight_kg").alias("rate"),
                hours_between("intime", "starttime").alias("_start"), hours_between("intime", "endtime").alias("_end"))
        .where(F.col("rate").isNotNull())
    )
    return explode_hours(infusions, "_start", "_end", max_hours).select("stay_id", "drug", "rate", "hours")


def is_antibiotic() -> Column:
    """Antibiotic by name and not by an excluded route; an unknown route stays in."""
    return contains_any("drug", config.ANTIBIOTIC_STEMS) & (
        F.col("route").isNull() | ~F.upper("route").isin(config.EXCLUDED_ROUTES)
    )


def is_systemic() -> Column:
    return F.upper("route").isin(config.SYSTEMIC_ROUTES)


def culture_filter(variant: str) -> Column:
    require_option(variant, ("any", "sterile_only", "no_surveillance"), "culture variant")
    if variant == "any":
        return F.lit(True)
    if variant == "sterile_only":
        return F.upper("spec_type_desc").isin(config.STERILE_SITES)
    return like_none("spec_type_desc", config.SURVEILLANCE_PATTERNS, config.SURVEILLANCE_EXACT)


def specimen_time() -> Column:
    """Chart time, or midnight of the chart date where only that is known."""
    return F.coalesce(F.col("charttime").cast("timestamp"), F.col("chartdate").cast("timestamp"))


def _action_times(rows: DataFrame, cohort: DataFrame, lookback_hours: float, max_hours: float) -> DataFrame:
    return (
        rows.join(cohort.select("hadm_id", "stay_id", "intime"), "hadm_id")
        .where(within_hours("intime", "_t", lookback_hours, max_hours))
        .select("stay_id", hours_between("intime", "_t").alias("hours"))
        .distinct()
    )


def antibiotic_times(
    prescriptions: DataFrame,
    cohort: DataFrame,
    lookback_hours: float = config.ACTION_LOOKBACK_HOURS,
    max_hours: float = config.MAX_HOURS,
    systemic_only: bool = False,
) -> DataFrame:
    rows = prescriptions.where(is_antibiotic())
    if systemic_only:
        rows = rows.where(is_systemic())
    return _action_times(rows.select("hadm_id", F.col("starttime").alias("_t")), cohort, lookback_hours, max_hours)


def culture_times(
    microbiology: DataFrame,
    cohort: DataFrame,
    lookback_hours: float = config.ACTION_LOOKBACK_HOURS,
    max_hours: float = config.MAX_HOURS,
    variant: str = "no_surveillance",
) -> DataFrame:
    rows = microbiology.where(culture_filter(variant)).select("hadm_id", specimen_time().alias("_t"))
    return _action_times(rows, cohort, lookback_hours, max_hours)
