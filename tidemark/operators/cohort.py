"""Cohorts on the time axis and on the site axis, attrition, profile, coverage, exclusions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.columns import (
    age_years,
    contains_any,
    join_groups,
    like_any,
    normal_code,
    require_columns,
    starts_with_any,
    suppress,
    within_hours,
)
from tidemark.functions.ranked import quantile_columns


def first_per_entity(df: DataFrame, entity: str, order: Sequence[str]) -> DataFrame:
    """The first row per entity; NULL order values come last.

    An aggregate over structs rather than ROW_NUMBER, so that an entity with very many rows is
    reduced before the shuffle.  `order` has to end in a unique column.
    """
    rank = F.struct(*[part for c in order for part in (F.col(c).isNull(), F.col(c))])
    return df.groupBy(entity).agg(F.min_by(F.struct(*df.columns), rank).alias("_row")).select("_row.*")


def build_cohort(
    icustays: DataFrame,
    patients: DataFrame,
    admissions: DataFrame,
    min_los_hours: float = config.MIN_LOS_HOURS,
    min_age: int = config.MIN_AGE,
) -> DataFrame:
    """First stay per patient, then length of stay and age; the rank comes before the filters."""
    require_columns(icustays, ["subject_id", "hadm_id", "stay_id", "intime", "outtime", "los"])
    first = first_per_entity(icustays, "subject_id", ["intime", "stay_id"])
    careunit = [c for c in ("first_careunit",) if c in icustays.columns]
    extra = [c for c in ("dischtime", "admission_type", "race", "insurance", "hospital_expire_flag")
             if c in admissions.columns]
    return (
        first.join(patients, "subject_id")
        .join(admissions.select("hadm_id", "admittime", *extra), "hadm_id")
        .select(
            "subject_id", "hadm_id", "stay_id", "intime", "outtime",
            (F.col("los") * 24.0).alias("los_hours"), *careunit, "gender",
            F.col("anchor_year_group").alias("epoch"),
            (F.col("anchor_age") + F.year("admittime") - F.col("anchor_year")).alias("age"),
            (F.year("intime") - F.col("anchor_year")).alias("anchor_offset_years"),
            "admittime", *extra,
        )
        .where((F.col("los_hours") >= min_los_hours) & (F.col("age") >= min_age))
    )


def attrition(
    icustays: DataFrame,
    cohort: DataFrame,
    min_los_hours: float = config.MIN_LOS_HOURS,
    entity: str = "subject_id",
    order: Sequence[str] = ("intime", "stay_id"),
    los_hours: Column | None = None,
) -> DataFrame:
    """Ordered (step_no, step, n).  One pass over the stays, one over the cohort."""
    los = los_hours if los_hours is not None else F.col("los") * 24.0
    stays = icustays.withColumn("_los", los)

    def step(no: int, name: str, count: str) -> Column:
        return F.struct(F.lit(no).alias("step_no"), F.lit(name).alias("step"), F.col(count).alias("n"))

    rank = F.struct(*[part for c in order for part in (F.col(c).isNull(), F.col(c))])
    per_entity = stays.groupBy(entity).agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("_los", rank).alias("_first_los")
    )
    totals = per_entity.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("stays"),
        F.count(entity).alias("entities"),
        F.count(F.lit(1)).alias("first"),
        F.count_if(F.col("_first_los") >= min_los_hours).alias("long_enough"),
    )
    steps = totals.select(
        F.explode(
            F.array(
                step(1, "all stays", "stays"), step(2, "distinct patients", "entities"),
                step(3, "first stay per patient", "first"), step(4, "minimum length of stay", "long_enough"),
            )
        ).alias("s")
    ).select("s.*")
    final = cohort.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(5).alias("step_no"), F.lit("minimum age: final cohort").alias("step"), "n"
    )
    return steps.unionByName(final)


def cohort_by_epoch(cohort: DataFrame, min_cell: int | None = None) -> DataFrame:
    """Size, age, length of stay, sex, mortality and anchor distance per epoch.

    Ages and year offsets have few distinct values, so plain `percentile` is bounded there;
    lengths of stay go through the exact distributed quantile.
    """
    counts = cohort.groupBy("epoch").agg(
        F.count(F.lit(1)).alias("n_stays"),
        F.countDistinct("subject_id").alias("n_patients"),
        F.percentile("age", F.lit(0.5)).alias("age_median"),
        F.percentile("age", F.lit(0.25)).alias("age_q25"),
        F.percentile("age", F.lit(0.75)).alias("age_q75"),
        F.avg(F.when(F.col("gender") == "F", 1.0).otherwise(0.0)).alias("frac_female"),
        F.avg(F.col("hospital_expire_flag").cast("double")).alias("frac_hosp_mortality"),
        F.percentile("anchor_offset_years", F.lit(0.5)).alias("anchor_offset_median"),
        F.avg(F.when(F.abs("anchor_offset_years") <= 1, 1.0).otherwise(0.0)).alias("frac_within_1y_of_anchor"),
    )
    los = quantile_columns(cohort, ["epoch"], "los_hours", {"los_median": 0.5, "los_q25": 0.25, "los_q75": 0.75})
    out = join_groups(counts, los, ["epoch"], "left")
    return suppress(out, ["n_stays", "n_patients"], min_cell) if min_cell else out


def coverage(
    events: DataFrame,
    cohort: DataFrame,
    concepts: Mapping[str, Sequence[int]],
    key: str = "stay_id",
    time: str = "charttime",
    value: str | None = "valuenum",
    min_cell: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Coverage of all concepts from one scan: (per item, per concept and epoch).

    Per item: rows and stays from 7 days before to 48 h after admission.  Per epoch: share of
    stays with a measured value in the first 6 h.  An item may serve several concepts.
    """
    ids = sorted({i for items in concepts.values() for i in items})
    by_item = F.create_map(*[
        x for i in ids
        for x in (F.lit(i), F.array(*[F.lit(c) for c, items in concepts.items() if i in items]))
    ])
    measured = F.col(value).isNotNull() if value else F.lit(True)
    hits = (
        events.where(F.col("itemid").isin(ids))
        .join(cohort.select(*{key, "stay_id"}, "intime", "epoch"), key)
        .select(
            "stay_id", "epoch", "itemid",
            within_hours("intime", time, 7 * 24, 48).alias("_wide"),
            (within_hours("intime", time, 0, 6) & measured).alias("_early"),
        )
        .where(F.col("_wide"))
        .groupBy("stay_id", "epoch", "itemid")
        .agg(F.count(F.lit(1)).alias("n"), F.max("_early").alias("_early"))
        .withColumn("concept", F.explode(by_item[F.col("itemid")]))
    )
    per_item = hits.groupBy("concept", "itemid").agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_stays")
    )
    seen = (
        hits.where(F.col("_early")).groupBy("concept", "epoch", "stay_id").agg(F.lit(1).alias("_hit"))
        .groupBy("concept", "epoch").agg(F.count(F.lit(1)).alias("n_measured"))
    )
    base = (
        cohort.groupBy("epoch").agg(F.count(F.lit(1)).alias("n_stays"))
        .withColumn("concept", F.explode(F.array(*[F.lit(c) for c in concepts])))
    )
    per_epoch = (
        join_groups(base, seen, ["concept", "epoch"], "left")
        .withColumn("n_measured", F.coalesce("n_measured", F.lit(0)))
        .withColumn("frac_measured", F.col("n_measured") / F.col("n_stays"))
        .select("concept", "epoch", "n_stays", "n_measured", "frac_measured")
    )
    if min_cell:
        per_item = suppress(per_item, ["n_stays"], min_cell)
        per_epoch = suppress(per_epoch, ["n_measured"], min_cell)
    return per_item, per_epoch


def concept_items(df: DataFrame, concepts: Mapping[str, Sequence[int]]) -> DataFrame:
    """(concept, itemid) rows of a concept table, as an inline table."""
    values = ", ".join(f"('{c}', {int(i)})" for c, items in concepts.items() for i in items)
    return df.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(concept, itemid)")


def unknown_items(dictionary: DataFrame, concepts: Mapping[str, Sequence[int]]) -> DataFrame:
    """Concept items that the dictionary does not list."""
    return concept_items(dictionary, concepts).join(dictionary.select("itemid"), "itemid", "left_anti")


def empty_items(per_item: DataFrame, dictionary: DataFrame, concepts: Mapping[str, Sequence[int]]) -> DataFrame:
    """Concept items without rows in the cohort window, with their dictionary label."""
    return (
        concept_items(dictionary, concepts)
        .join(per_item.select("concept", "itemid"), ["concept", "itemid"], "left_anti")
        .join(dictionary.select("itemid", "label"), "itemid", "left")
    )


def search_dictionary(
    dictionary: DataFrame,
    needles: Mapping[str, Sequence[str]],
    label: str = "label",
    ident: str = "itemid",
    extra: Sequence[str] = (),
) -> DataFrame:
    """(concept, item, label): items whose label holds any needle of the concept, ordered.

    All concepts are tested in one pass over the dictionary.
    """
    tests = [F.when(contains_any(label, words), F.lit(concept)) for concept, words in needles.items()]
    return (
        dictionary.withColumn("concept", F.explode(F.array_compact(F.array(*tests))))
        .select("concept", ident, label, *extra)
        .orderBy("concept", ident)
    )


# --- site axis -------------------------------------------------------------------
def build_site_cohort(
    patient: DataFrame,
    hospital: DataFrame,
    min_los_minutes: int = int(config.MIN_LOS_HOURS * 60),
    min_age: int = config.MIN_AGE,
) -> DataFrame:
    """First stay per patient on the offset clock with site attributes."""
    order = ["hospitaldischargeyear", "patienthealthsystemstayid", "unitvisitnumber", "patientunitstayid"]
    first = first_per_entity(patient, "uniquepid", order)
    return (
        first.withColumn("age", age_years("age", config.AGE_CEILING, config.AGE_CEILING_VALUE))
        .withColumn("weight_kg", F.col("admissionweight").try_cast("double"))
        .drop("admissionweight")
        .where((F.col("unitdischargeoffset") >= min_los_minutes) & (F.col("age") >= min_age))
        .join(hospital.select("hospitalid", "region", "numbedscategory", "teachingstatus"), "hospitalid", "left")
        .withColumnRenamed("patientunitstayid", "stay_id")
    )


def with_hit(cohort: DataFrame, hits: DataFrame, name: str, key: str = "stay_id") -> DataFrame:
    """Left join of a 0/1 flag: 1.0 where the stay occurs in `hits`."""
    flags = hits.select(key).distinct().withColumn(name, F.lit(1.0))
    return cohort.join(flags, key, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def site_quality(
    cohort: DataFrame,
    lab: DataFrame,
    treatment: DataFrame,
    min_stays: int = config.MIN_STAYS_PER_SITE,
    min_creatinine: float = config.MIN_CREATININE_COVERAGE,
    min_culture: float = config.MIN_CULTURE_RATE,
) -> DataFrame:
    """Per site: size, data-quality shares, inclusion and the culture-charting subset."""
    creatinine = lab.where(
        starts_with_any("labname", ["creatinine"]) & F.col("labresult").isNotNull()
        & F.col("labresultoffset").between(0, config.SITE_HORIZON_MINUTES)
    ).select(F.col("patientunitstayid").alias("stay_id"))
    culture = treatment.where(like_any("treatmentstring", config.OFFSET_CULTURE)).select(
        F.col("patientunitstayid").alias("stay_id")
    )
    flagged = with_hit(with_hit(cohort, creatinine, "_creatinine"), culture, "_culture")
    return (
        flagged.groupBy("hospitalid")
        .agg(
            F.any_value("region").alias("region"),
            F.any_value("numbedscategory").alias("beds"),
            F.any_value("teachingstatus").alias("teaching"),
            F.count(F.lit(1)).alias("n_stays"),
            F.avg("_creatinine").alias("frac_creatinine"),
            F.avg("_culture").alias("frac_culture"),
        )
        .withColumn("included", (F.col("n_stays") >= min_stays) & (F.col("frac_creatinine") >= min_creatinine))
        .withColumn("sepsis_subset", F.col("included") & (F.col("frac_culture") >= min_culture))
    )


def site_summary(sites: DataFrame) -> DataFrame:
    def stays(flag: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col("n_stays")).otherwise(0))

    return sites.agg(
        F.count(F.lit(1)).alias("n_hospitals"),
        F.sum("n_stays").alias("n_stays"),
        F.count_if("included").alias("n_included_hospitals"),
        stays("included").alias("n_included_stays"),
        F.count_if("sepsis_subset").alias("n_sepsis_hospitals"),
        stays("sepsis_subset").alias("n_sepsis_stays"),
    )


def keep_included(cohort: DataFrame, sites: DataFrame) -> DataFrame:
    """Stays of the included sites, with the subset flag of their site."""
    return cohort.join(sites.where("included").select("hospitalid", "sepsis_subset"), "hospitalid")


# --- prevalent cases and exclusions --------------------------------------------------
def common_cohort(
    cohort: DataFrame, prevalent: Mapping[str, DataFrame], group: str = "epoch"
) -> tuple[DataFrame, DataFrame]:
    """Stays without a prevalent case of any label, and the losses per group."""
    flags = None
    for label, stays in prevalent.items():
        marked = stays.select("stay_id", F.lit(label).alias("_label"))
        flags = marked if flags is None else flags.unionByName(marked)
    if flags is None:
        raise ValueError("no label was given")
    lost = flags.groupBy("stay_id").agg(
        *[F.max((F.col("_label") == label)).alias(f"_prev_{label}") for label in prevalent]
    )
    names = [f"_prev_{label}" for label in prevalent]
    df = (
        cohort.select("stay_id", group).join(lost, "stay_id", "left")
        .withColumns({n: F.coalesce(F.col(n), F.lit(False)) for n in names})
    )
    anything = F.lit(False)
    for n in names:
        anything = anything | F.col(n)
    df = df.withColumn("retained", ~anything)
    summary = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_stays"),
        F.count_if("retained").alias("n_common_cohort"),
        F.avg(F.col("retained").cast("double")).alias("frac_retained"),
        *[F.count_if(f"_prev_{label}").alias(f"lost_to_{label}") for label in prevalent],
    )
    return df.where("retained").select("stay_id", group), summary


def stays_with_code(
    diagnoses: DataFrame, cohort: DataFrame, codes: Sequence[str] = tuple(config.EXCLUSION_CODES), version: int = 10
) -> DataFrame:
    """Stays whose admission carries one of the diagnosis codes; dots and case do not matter."""
    wanted = sorted({c.replace(".", "").upper() for c in codes})
    hits = diagnoses.where((F.col("icd_version") == version) & normal_code("icd_code").isin(wanted)).select("hadm_id").distinct()
    return cohort.select("hadm_id", "stay_id").join(hits, "hadm_id", "left_semi").select("stay_id").distinct()


def exclude(df: DataFrame, stays: DataFrame) -> DataFrame:
    return df.join(stays.select("stay_id"), "stay_id", "left_anti")


def stay_windows(cohort: DataFrame, max_hours: float = config.MAX_HOURS) -> DataFrame:
    """(stay_id, max_hours): how long each stay is followed."""
    return cohort.select("stay_id", F.least("los_hours", F.lit(float(max_hours))).alias("max_hours"))
