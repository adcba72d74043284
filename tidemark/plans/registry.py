"""Registered queries: each operator on the role tables of one data folder, with its check statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.columns import suppress
from tidemark.functions.ranked import quantiles, sample_n
from tidemark.operators import audit as A
from tidemark.operators import cohort as K
from tidemark.operators import concepts as C
from tidemark.operators import crossfit as CX
from tidemark.operators import features as X
from tidemark.operators import inference as I
from tidemark.operators import labels as L
from tidemark.operators import metrics as M
from tidemark.operators import models as ML
from tidemark.operators import offset_concepts as O
from tidemark.operators import reports as R
from tidemark.operators import scores as S
from tidemark.operators import splits as P
from tidemark.operators.temporal import hourly_grid
from tidemark.plans import checks as Q
from tidemark.plans.roles import Roles
from tidemark.plans.study import LabelStudy, Rules, SiteStudy, estimate_contrasts
from tidemark.session import STUDY_SETTINGS, apply_settings

LABELS = config.LABELS
STUDY_RULES = Rules(max_hours=float(Q.STUDY_HOURS))
ITEM_GROUPS = {"low": [1, 2], "middle": [3, 4, 5], "high": [6, 7, 99]}
NEEDLES = {"ring": ["ring"], "colour": ["red", "blue"], "fastener": ["bolt", "nut", "screw"], "gear": ["gear", "gizmo"]}


@dataclass(frozen=True)
class Query:
    run: Callable[[Roles], DataFrame]
    check: str | None = None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return rounded(self.run(Roles(apply_settings(spark, STUDY_SETTINGS), folder)))


QUERIES: dict[str, Query] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 digits (and no negative zero), so that the order of a sum does not show."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), 6) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def query(check: str | None = None, doubles: list[str] | tuple[str, ...] = ()):
    def register(fn: Callable[[Roles], DataFrame]) -> Callable[[Roles], DataFrame]:
        QUERIES[fn.__name__] = Query(fn, Q.check(check, doubles) if check else None)
        return fn

    return register


def study(r: Roles) -> LabelStudy:
    return LabelStudy(r, STUDY_RULES)


def sites(r: Roles) -> SiteStudy:
    # Up to twelve tables of the site study are derived from the lines joined with their orders; they are joined once.
    return SiteStudy(r.keep("o_line"), Rules(), *Q.SITE_LIMITS)


def order_cohort(r: Roles) -> DataFrame:
    return K.build_cohort(r.order_stays, r.order_patients, r.order_admissions)


def share(name: str, condition: str) -> str:
    return f"avg(CASE WHEN {condition} THEN 1e0 ELSE 0e0 END) AS {name}"


# --- cohorts -----------------------------------------------------------------------
@query("SELECT subject_id, hadm_id, stay_id, los_hours, gender, epoch, age, anchor_offset_years, admission_type, hospital_expire_flag FROM order_cohort",
       ["los_hours"])
def first_order_cohort(r):
    return order_cohort(r).select("subject_id", "hadm_id", "stay_id", "los_hours", "gender", "epoch", "age",
                                  "anchor_offset_years", "admission_type", "hospital_expire_flag")


@query("""SELECT 1 AS step_no, 'all stays' AS step, count(*) AS n FROM order_stays
    UNION ALL SELECT 2, 'distinct patients', count(DISTINCT subject_id) FROM order_stays
    UNION ALL SELECT 3, 'first stay per patient', count(*) FROM (SELECT subject_id FROM order_stays GROUP BY 1)
    UNION ALL SELECT 4, 'minimum length of stay', count(*) FROM (SELECT los, row_number() OVER (PARTITION BY subject_id ORDER BY intime, stay_id) AS rk
        FROM order_stays) WHERE rk = 1 AND los * 24e0 >= 12
    UNION ALL SELECT 5, 'minimum age: final cohort', count(*) FROM order_cohort""")
def cohort_attrition(r):
    return K.attrition(r.order_stays, order_cohort(r))


@query(f"""SELECT epoch, count(*) AS n_stays, count(DISTINCT subject_id) AS n_patients, CAST(median(age) AS DOUBLE) AS age_median, quantile_cont(age, 0.25) AS age_q25,
    quantile_cont(age, 0.75) AS age_q75, {share('frac_female', "gender = 'F'")}, avg(CAST(hospital_expire_flag AS DOUBLE)) AS frac_hosp_mortality,
    CAST(median(anchor_offset_years) AS DOUBLE) AS anchor_offset_median, {share('frac_within_1y_of_anchor', 'abs(anchor_offset_years) <= 1')},
    median(los_hours) AS los_median, quantile_cont(los_hours, 0.25) AS los_q25, quantile_cont(los_hours, 0.75) AS los_q75
    FROM order_cohort GROUP BY epoch""",
       ["age_median", "age_q25", "age_q75", "frac_female", "frac_hosp_mortality", "anchor_offset_median", "frac_within_1y_of_anchor",
        "los_median", "los_q25", "los_q75"])
def cohort_profile(r):
    return K.cohort_by_epoch(order_cohort(r))


ITEM_VALUES = Q.values([(c, i) for c, items in ITEM_GROUPS.items() for i in items])
COVERED = f"""(SELECT m.concept, e.itemid, c.stay_id, c.epoch, e.valuenum, e.charttime, c.intime FROM order_events e
    JOIN (VALUES {ITEM_VALUES}) AS m(concept, itemid) ON m.itemid = e.itemid JOIN order_cohort c ON c.hadm_id = e.hadm_id)"""


def order_coverage_frames(r):
    return K.coverage(r.order_events, order_cohort(r), ITEM_GROUPS, key="hadm_id")


@query(f"""SELECT concept, itemid, count(*) AS n_rows, count(DISTINCT stay_id) AS n_stays FROM {COVERED}
    WHERE charttime BETWEEN intime - INTERVAL 7 DAY AND intime + INTERVAL 48 HOUR GROUP BY 1, 2""")
def item_coverage(r):
    return order_coverage_frames(r)[0]


@query(f"""SELECT k.concept, c.epoch, count(*) AS n_stays, count(m.stay_id) AS n_measured, count(m.stay_id) / count(*) AS frac_measured
    FROM order_cohort c CROSS JOIN (SELECT DISTINCT concept FROM (VALUES {ITEM_VALUES}) AS v(concept, itemid)) k
    LEFT JOIN (SELECT DISTINCT concept, stay_id FROM {COVERED} WHERE charttime BETWEEN intime AND intime + INTERVAL 6 HOUR AND valuenum IS NOT NULL) m
    ON m.stay_id = c.stay_id AND m.concept = k.concept GROUP BY 1, 2""", ["frac_measured"])
def epoch_coverage(r):
    return order_coverage_frames(r)[1]


@query(f"""SELECT v.concept, v.itemid, d.label FROM (VALUES {ITEM_VALUES}) AS v(concept, itemid)
    LEFT JOIN (SELECT DISTINCT concept, itemid FROM {COVERED} WHERE charttime BETWEEN intime - INTERVAL 7 DAY AND intime + INTERVAL 48 HOUR) s
    ON s.concept = v.concept AND s.itemid = v.itemid LEFT JOIN (SELECT p_partkey AS itemid, p_name AS label FROM part) d ON d.itemid = v.itemid
    WHERE s.itemid IS NULL""")
def items_without_rows(r):
    dictionary = r.part.select(F.col("p_partkey").alias("itemid"), F.col("p_name").alias("label"))
    return K.empty_items(item_coverage(r), dictionary, ITEM_GROUPS)


@query(f"""SELECT v.concept, v.itemid FROM (VALUES {Q.values([(c, i) for c, s in config.INPUT_CONCEPTS.items() for i in s])}) AS v(concept, itemid)
    WHERE v.itemid NOT IN (SELECT DISTINCT itemid FROM inputevents)""")
def unknown_items(r):
    return K.unknown_items(r.inputevents.select("itemid").distinct(), config.INPUT_CONCEPTS).select("concept", "itemid")


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS concept, p_partkey, p_name FROM part WHERE " + " OR ".join(f"lower(p_name) LIKE '%{w}%'" for w in words)
    for c, words in NEEDLES.items()))
def dictionary_search(r):
    return K.search_dictionary(r.part, NEEDLES, label="p_name", ident="p_partkey")


@query("SELECT DISTINCT c.stay_id FROM diagnoses_icd d JOIN cohort c ON c.hadm_id = d.hadm_id WHERE d.icd_version = 10 AND replace(upper(d.icd_code), '.', '') = 'U071'")
def excluded_stays(r):
    return K.stays_with_code(r.diagnoses_icd, study(r).cohort)


@query("SELECT stay_id, epoch FROM cohort WHERE stay_id NOT IN (SELECT c.stay_id FROM diagnoses_icd d JOIN cohort c ON c.hadm_id = d.hadm_id WHERE d.icd_version = 10 AND replace(upper(d.icd_code), '.', '') = 'U071')")
def cohort_without_excluded(r):
    s = study(r)
    return K.exclude(s.cohort, K.stays_with_code(r.diagnoses_icd, s.cohort)).select("stay_id", "epoch")


@query("SELECT stay_id, uniquepid, hospitalid, unitdischargeoffset, gender, age, weight_kg, region, numbedscategory, teachingstatus FROM s_all", ["weight_kg"])
def site_cohort(r):
    return K.build_site_cohort(r.o_patient, r.o_hospital).select(
        "stay_id", "uniquepid", "hospitalid", "unitdischargeoffset", "gender", "age", "weight_kg", "region", "numbedscategory", "teachingstatus")


@query("SELECT * FROM s_sites", ["frac_creatinine", "frac_culture"])
def site_quality(r):
    return sites(r).sites


@query("""SELECT count(*) AS n_hospitals, CAST(sum(n_stays) AS BIGINT) AS n_stays, count(*) FILTER (WHERE included) AS n_included_hospitals,
    CAST(sum(CASE WHEN included THEN n_stays ELSE 0 END) AS BIGINT) AS n_included_stays, count(*) FILTER (WHERE sepsis_subset) AS n_sepsis_hospitals,
    CAST(sum(CASE WHEN sepsis_subset THEN n_stays ELSE 0 END) AS BIGINT) AS n_sepsis_stays FROM s_sites""")
def site_summary(r):
    return K.site_summary(sites(r).sites)


# --- concepts, timestamp clock -------------------------------------------------------
@query("SELECT * FROM labs", ["hours", "value"])
def lab_extract(r):
    return C.lab(r.labevents, study(r).cohort, None, Q.STUDY_HOURS)


@query("SELECT * FROM charts", ["hours", "value"])
def chart_extract(r):
    return C.chart(r.chartevents, study(r).cohort, None, Q.STUDY_HOURS)


@query("SELECT * FROM gcs", ["hours", "value"])
def pivot_complete_sum(r):
    return C.gcs_total(r.chartevents, study(r).cohort, Q.STUDY_HOURS)


@query("SELECT * FROM vent", ["hours"])
def ventilated_hours(r):
    return C.ventilated_hours(r.chartevents, study(r).cohort, Q.STUDY_HOURS)


@query("SELECT * FROM urine", ["hours", "value"])
def signed_sum(r):
    return C.urine_output(r.outputevents, study(r).cohort, Q.STUDY_HOURS)


@query("SELECT * FROM wt", ["weight_kg"])
def group_median_fallback(r):
    return study(r).weight


@query("""SELECT c.stay_id, coalesce(w.weight_kg, m.fallback) AS weight_kg, w.weight_kg IS NULL AS weight_imputed FROM cohort c
    LEFT JOIN (SELECT stay_id, arg_min(kg, charttime) AS weight_kg FROM weighed WHERE kg BETWEEN 20 AND 400 GROUP BY 1) w ON w.stay_id = c.stay_id
    LEFT JOIN (SELECT gender, median(weight_kg) AS fallback FROM (SELECT stay_id, arg_min(kg, charttime) AS weight_kg FROM weighed
        WHERE kg BETWEEN 20 AND 400 GROUP BY 1) x JOIN cohort c2 ON c2.stay_id = x.stay_id GROUP BY 1) m ON m.gender = c.gender""", ["weight_kg"])
def first_plausible_weight(r):
    return C.weights(r.chartevents, study(r).cohort, first_plausible=True)


@query("SELECT * FROM pressors", ["rate", "hours"])
def interval_explode(r):
    return study(r).pressors


@query("SELECT DISTINCT * FROM abx", ["hours"])
def antibiotic_times(r):
    return study(r).antibiotics


@query(Q.actions("abx", Q.SYSTEMIC), ["hours"])
def systemic_antibiotic_times(r):
    return C.antibiotic_times(r.prescriptions, study(r).cohort, max_hours=Q.STUDY_HOURS, systemic_only=True)


@query(f"""SELECT 'any' AS variant, * FROM ({Q.actions('cul', 'true')}) UNION ALL SELECT 'sterile_only', * FROM ({Q.actions('cul', Q.STERILE)})
    UNION ALL SELECT 'no_surveillance', * FROM cul""", ["hours"])
def culture_times(r):
    cohort, out = study(r).cohort, None
    for variant in ("any", "sterile_only", "no_surveillance"):
        part = C.culture_times(r.microbiologyevents, cohort, max_hours=Q.STUDY_HOURS, variant=variant).select(F.lit(variant).alias("variant"), "stay_id", "hours")
        out = part if out is None else out.unionByName(part)
    return out


# --- concepts, offset clock -------------------------------------------------------------
@query("SELECT * FROM s_labs", ["hours", "value"])
def offset_lab(r):
    return O.lab(r.o_lab, sites(r).cohort)


@query("SELECT * FROM s_vitals", ["hours", "value"])
def union_vitals(r):
    return O.vital(r.o_periodic, r.o_aperiodic, sites(r).cohort)


@query("SELECT * FROM s_gcs", ["hours", "value"])
def offset_gcs(r):
    return O.gcs_total(r.o_nurse, sites(r).cohort)


@query("SELECT * FROM s_urine", ["hours", "value"])
def offset_urine(r):
    return sites(r).urine


@query("SELECT * FROM s_wt", ["weight_kg"])
def offset_weights(r):
    return sites(r).weight


@query("SELECT * FROM s_vent", ["hours"])
def offset_ventilated(r):
    return O.ventilated_hours(r.o_respiratory, sites(r).cohort)


@query("SELECT *, CAST(NULL AS DOUBLE) AS rate FROM s_pressors", ["hours"])
def offset_pressors(r):
    return O.vasopressor_rates(r.o_infusion, sites(r).cohort)


@query("SELECT 'antibiotic' AS action, * FROM s_abx UNION ALL SELECT 'culture', * FROM s_cul", ["hours"])
def offset_actions(r):
    s = sites(r)
    return s.antibiotics.withColumn("action", F.lit("antibiotic")).unionByName(s.cultures.withColumn("action", F.lit("culture")))


# --- event time and scores ------------------------------------------------------------------
@query("SELECT stay_id, CAST(unnest(generate_series(0, CAST(ceil(max_hours) AS BIGINT))) AS INTEGER) AS hour FROM followed")
def hourly_grid_rows(r):
    return hourly_grid(study(r).stays)


@query("SELECT * FROM crea_staged", ["hours", "value", "base_7d", "min_48h"])
def rolling_min_time(r):
    return S.creatinine_stage(study(r).creatinine).select("stay_id", "hours", "value", "base_7d", "min_48h", "stage")


@query(f"SELECT * FROM ({Q.creatinine_sql('(SELECT * FROM labs WHERE concept = ' + chr(39) + 'creatinine' + chr(39) + ')', 'first_of_stay')})",
       ["hours", "value", "base_7d", "min_48h"])
def first_of_stay_baseline(r):
    return S.creatinine_stage(study(r).creatinine, "first_of_stay").select("stay_id", "hours", "value", "base_7d", "min_48h", "stage")


@query("SELECT * FROM urine_staged", ["hours", "value", "weight_kg", "rate_6h", "rate_12h", "rate_24h"])
def gap_aware_rate(r):
    s = study(r)
    return S.urine_output_stage(s.urine, s.weight)


@query("SELECT * FROM oxygen", ["hours", "value"])
def asof_tolerance(r):
    s = study(r)
    return S.pf_ratio_events(C.one_concept(s.labs, "pao2"), C.one_concept(s.charts, "fio2"))


SOFA_DOUBLES = ["pf_ratio", "platelets", "bilirubin", "creatinine", "map", "gcs", "urine_24h", "rate_norepinephrine", "rate_epinephrine", "rate_dopamine", "rate_dobutamine"]
SOFA_COLUMNS = """stay_id, hour, pf_ratio, ventilated, platelets, bilirubin, creatinine, map, gcs, norepinephrine AS rate_norepinephrine,
    epinephrine AS rate_epinephrine, dopamine AS rate_dopamine, dobutamine AS rate_dobutamine, urine_24h, sofa_resp, sofa_coag, sofa_liver,
    sofa_cardio, sofa_cns, sofa_renal, sofa_total, sofa_components_missing"""


@query(f"SELECT {SOFA_COLUMNS} FROM sofa", SOFA_DOUBLES)
def hourly_score(r):
    return study(r).sofa


@query(f"SELECT {SOFA_COLUMNS} FROM s_sofa", SOFA_DOUBLES)
def hourly_score_offset(r):
    return sites(r).sofa


@query("""SELECT c.epoch, avg(CASE WHEN sofa_resp IS NOT NULL THEN 1e0 ELSE 0e0 END) AS sofa_resp, avg(CASE WHEN sofa_coag IS NOT NULL THEN 1e0 ELSE 0e0 END) AS sofa_coag,
    avg(CASE WHEN sofa_liver IS NOT NULL THEN 1e0 ELSE 0e0 END) AS sofa_liver, avg(CASE WHEN sofa_cardio IS NOT NULL THEN 1e0 ELSE 0e0 END) AS sofa_cardio,
    avg(CASE WHEN sofa_cns IS NOT NULL THEN 1e0 ELSE 0e0 END) AS sofa_cns, avg(CASE WHEN sofa_renal IS NOT NULL THEN 1e0 ELSE 0e0 END) AS sofa_renal, count(*) AS n
    FROM sofa s JOIN cohort c ON c.stay_id = s.stay_id WHERE s.hour = 6 GROUP BY 1""", S.COMPONENTS)
def component_availability(r):
    s = study(r)
    return S.component_availability(s.sofa, s.cohort)


# --- labels ------------------------------------------------------------------------------------
@query("SELECT 'creatinine' AS label, * FROM on_crea UNION ALL SELECT 'urine', * FROM on_urine", ["onset_hours"])
def stage_onsets(r):
    o = study(r).onsets()
    return (o["aki_creatinine"].withColumn("label", F.lit("creatinine"))
            .unionByName(o["aki_urine"].withColumn("label", F.lit("urine"))))


@query(" UNION ALL ".join(f"SELECT '{rule}' AS rule, * FROM ({Q.organ_onset('sofa', rule=rule)})" for rule in L.BASELINE_RULES), ["onset_hours"])
def baseline_and_onset(r):
    sofa, out = study(r).totals, None
    for rule in L.BASELINE_RULES:
        part = L.organ_dysfunction_onset(sofa, baseline_rule=rule).withColumn("rule", F.lit(rule))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT * FROM pairs", ["suspicion_hours", "abx_hours", "culture_hours"])
def pair_window(r):
    s = study(r)
    return L.suspicion_of_infection(s.antibiotics, s.cultures)


@query("SELECT DISTINCT stay_id, suspicion_hours FROM pairs", ["suspicion_hours"])
def suspicion_times(r):
    return study(r).suspicion


@query(" UNION ALL ".join(f"SELECT '{o}' AS onset_rule, * FROM ({Q.sepsis_onset('sofa', 'pairs', onset=o)})" for o in L.ONSET_RULES),
       ["onset_hours", "suspicion_hours", "dysfunction_hours"])
def band_onset(r):
    s, out = study(r), None
    for rule in L.ONSET_RULES:
        part = L.sepsis3_onset(s.totals, s.suspicion, onset_rule=rule).withColumn("onset_rule", F.lit(rule))
        out = part if out is None else out.unionByName(part)
    return out


@query(" UNION ALL ".join(f"""SELECT '{rule}' AS rule, 'sofa_dysfunction' AS label, stay_id FROM ({Q.prevalent_organ('sofa', rule)})
    UNION ALL SELECT '{rule}', 'sepsis3', stay_id FROM ({Q.prevalent_sepsis('sofa', 'pairs', rule)})""" for rule in L.PREVALENCE_RULES[1:]))
def prevalent_cases(r):
    s, out = study(r), None
    for rule in L.PREVALENCE_RULES[1:]:
        for label, frame in (("sofa_dysfunction", L.prevalent_dysfunction(s.totals, rule=rule)), ("sepsis3", L.prevalent_sepsis3(s.totals, s.suspicion, rule=rule))):
            part = frame.select(F.lit(rule).alias("rule"), F.lit(label).alias("label"), "stay_id")
            out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT epoch, count(*) AS n_stays, count(*) FILTER (WHERE NOT (a OR u)) AS n_common_cohort, avg(CASE WHEN NOT (a OR u) THEN 1e0 ELSE 0e0 END) AS frac_retained,
    count(*) FILTER (WHERE a) AS lost_to_aki_creatinine, count(*) FILTER (WHERE u) AS lost_to_aki_urine, CAST(0 AS BIGINT) AS lost_to_sofa_dysfunction, CAST(0 AS BIGINT) AS lost_to_sepsis3
    FROM (SELECT epoch, stay_id IN (SELECT stay_id FROM on_crea WHERE onset_hours <= 6) AS a, stay_id IN (SELECT stay_id FROM on_urine WHERE onset_hours <= 6) AS u FROM cohort)
    GROUP BY epoch""", ["frac_retained"])
def prevalent_and_common(r):
    return study(r).common[1]


SUMMARY_DOUBLES = ["frac_early_of_onsets", "frac_lost_to_early", "prevalence_24h", "prevalence_48h", "prevalence_72h",
                   "onset_hours_q25", "onset_hours_median", "onset_hours_q75"]
ON = {"aki_creatinine": "SELECT * FROM on_crea", "sofa_dysfunction": "SELECT * FROM on_sofa", "aki_urine": "SELECT * FROM on_urine", "sepsis3": "SELECT * FROM on_sepsis"}


@query(Q.onset_counts(ON, "cohort", "epoch", Q.T, config.SUMMARY_HORIZONS), SUMMARY_DOUBLES)
def onset_summary(r):
    s = study(r)
    return L.summarise_onsets(s.onsets(), s.cohort)


@query("SELECT * FROM labelled")
def label_table(r):
    return study(r).labelled


PREV = ", ".join(f"CAST(sum({c}) AS BIGINT) AS n_{c}, avg(CAST({c} AS DOUBLE)) AS prev_{c}" for c in LABELS)


@query(f"SELECT epoch, count(*) AS n, {PREV} FROM labelled GROUP BY 1", [f"prev_{c}" for c in LABELS])
def label_prevalence(r):
    return M.prevalence(study(r).labelled, LABELS, ["epoch"])


@query(f"SELECT region, count(*) AS n, {PREV} FROM (SELECT * REPLACE (coalesce(region, 'Unknown') AS region) FROM s_labelled) GROUP BY 1", [f"prev_{c}" for c in LABELS])
def region_prevalence(r):
    return sites(r).prevalence_by("region")


@query(f"SELECT hospitalid, count(*) AS n, {PREV} FROM s_labelled GROUP BY 1", [f"prev_{c}" for c in LABELS])
def site_prevalence(r):
    return sites(r).prevalence_by("hospitalid")


GRID_SQL = " UNION ALL ".join(f"""SELECT '{rule}' AS baseline_rule, {hour}e0 AS prediction_hour, {h}e0 AS horizon, s.label, s.epoch, k.n_common_cohort, k.frac_retained,
    s.n_events_{h}h AS n_events, s.prevalence_{h}h AS prevalence, s.frac_early_of_onsets, s.onset_hours_median
    FROM ({Q.onset_counts({'aki_creatinine': ON['aki_creatinine'], 'aki_urine': ON['aki_urine'], 'sofa_dysfunction': Q.organ_onset('sofa', hour, rule), 'sepsis3': Q.sepsis_onset('sofa', 'pairs', hour, rule)}, 'cohort', 'epoch', hour, [h])}) s
    JOIN (SELECT epoch, count(*) FILTER (WHERE keep) AS n_common_cohort, avg(CASE WHEN keep THEN 1e0 ELSE 0e0 END) AS frac_retained FROM (
        SELECT epoch, stay_id NOT IN (SELECT stay_id FROM on_crea WHERE onset_hours <= {hour}) AND stay_id NOT IN (SELECT stay_id FROM on_urine WHERE onset_hours <= {hour}) AS keep
        FROM cohort) GROUP BY 1) k ON k.epoch = s.epoch""" for rule in ("at_prediction", "min_before", "zero") for hour in (4, 6) for h in (48, 72))


@query(GRID_SQL, ["prediction_hour", "horizon", "frac_retained", "prevalence", "frac_early_of_onsets", "onset_hours_median"])
def design_grid(r):
    s = study(r)
    fixed = {k: v for k, v in s.onsets().items() if k.startswith("aki")}
    return L.design_grid(s.cohort, s.totals, s.suspicion, fixed)


@query("""SELECT c.epoch, count(*) AS n, avg(CASE WHEN a.stay_id IS NOT NULL THEN 1e0 ELSE 0e0 END) AS frac_antibiotic, avg(CASE WHEN u.stay_id IS NOT NULL THEN 1e0 ELSE 0e0 END) AS frac_culture,
    avg(CASE WHEN p.stay_id IS NOT NULL THEN 1e0 ELSE 0e0 END) AS frac_suspicion FROM cohort c
    LEFT JOIN (SELECT DISTINCT stay_id FROM abx WHERE hours BETWEEN 0 AND 48) a ON a.stay_id = c.stay_id
    LEFT JOIN (SELECT DISTINCT stay_id FROM cul WHERE hours BETWEEN 0 AND 48) u ON u.stay_id = c.stay_id
    LEFT JOIN (SELECT DISTINCT stay_id FROM pairs) p ON p.stay_id = c.stay_id GROUP BY 1""", ["frac_antibiotic", "frac_culture", "frac_suspicion"])
def action_rates(r):
    s = study(r)
    return L.action_rates(s.cohort, s.antibiotics, s.cultures, s.suspicion)


ZERO = {"sofa_dysfunction": Q.organ_onset("sofa", rule="zero"), "sepsis3": Q.sepsis_onset("sofa", "pairs", rule="zero"), "aki_creatinine": "SELECT * FROM on_crea"}


@query("SELECT c.epoch, count(*) AS n, " + ", ".join(f"avg(CASE WHEN c.stay_id IN (SELECT stay_id FROM ({sql}) WHERE onset_hours <= 48) THEN 1e0 ELSE 0e0 END) AS prev_{n}" for n, sql in ZERO.items())
       + " FROM cohort c GROUP BY 1", [f"prev_{n}" for n in ZERO])
def convention_prevalence(r):
    s = study(r)
    onsets = s.onsets("zero")
    return L.convention_prevalence(s.cohort, {n: onsets[n] for n in ZERO})


def variant_sql(name: str, abx: str, cul: str) -> str:
    return f"""SELECT '{name}' AS variant, c.epoch, count(*) AS n_stays, count(p.stay_id) AS n_suspicion, count(p.stay_id) / count(*) AS frac FROM cohort c
        LEFT JOIN (SELECT DISTINCT stay_id FROM ({Q.pair_sql('(' + Q.actions('abx', abx) + ')', '(' + Q.actions('cul', cul) + ')')})) p ON p.stay_id = c.stay_id GROUP BY 2"""


@query(" UNION ALL ".join(variant_sql(*v) for v in (
    ("current", "true", "true"), ("iv_only", Q.SYSTEMIC, "true"), ("sterile_only", "true", Q.STERILE), ("iv_and_sterile", Q.SYSTEMIC, Q.STERILE),
    ("no_surveillance", "true", Q.NOT_SURVEILLANCE), ("iv_and_no_surveillance", Q.SYSTEMIC, Q.NOT_SURVEILLANCE))), ["frac"])
def definition_sweep(r):
    return A.definition_sweep(r.prescriptions, r.microbiologyevents, study(r).cohort, max_hours=Q.STUDY_HOURS)


@query(Q.onset_counts({n: f"SELECT * FROM s_on_{t}" for n, t in (("aki_creatinine", "crea"), ("sofa_dysfunction", "sofa"), ("aki_urine", "urine"), ("sepsis3", "sepsis"))},
                      "s_cohort", "region", Q.T, config.SUMMARY_HORIZONS), SUMMARY_DOUBLES)
def onset_summary_offset(r):
    s = sites(r)
    return L.summarise_onsets(s.onsets(), s.cohort, group="region")


# --- audits ------------------------------------------------------------------------------------
SIGNAL_SQL = f"""SELECT k.signal, c.epoch, count(*) AS n_stays, count(h.stay_id) AS n_with_signal, count(h.stay_id) / count(*) AS frac FROM cohort c
    CROSS JOIN (VALUES {Q.values([(n,) for n, _, _ in config.SIGNALS])}) AS k(signal)
    LEFT JOIN (SELECT DISTINCT v.signal, c2.stay_id FROM (SELECT stay_id, charttime AS t, itemid, 'chartevents' AS src FROM chartevents
        UNION ALL SELECT stay_id, starttime, itemid, 'procedureevents' FROM procedureevents) e
        JOIN (VALUES {Q.values(config.SIGNALS)}) AS v(signal, src, itemid) ON v.itemid = e.itemid AND v.src = e.src
        JOIN cohort c2 ON c2.stay_id = e.stay_id WHERE e.t >= c2.intime AND e.t <= c2.intime + INTERVAL 48 HOUR) h
    ON h.stay_id = c.stay_id AND h.signal = k.signal GROUP BY 1, 2"""


def signals(r):
    return A.signal_coverage({"chartevents": r.chartevents, "procedureevents": r.procedureevents}, study(r).cohort)


@query(SIGNAL_SQL, ["frac"])
def signal_coverage(r):
    return signals(r)


@query(f"""SELECT signal, a AS reference_share, b AS last_share, b / nullif(a, 0) AS ratio FROM (
    SELECT signal, max(CASE WHEN epoch = 'BUILDING' THEN frac END) AS a, max(CASE WHEN epoch = 'MACHINERY' THEN frac END) AS b FROM ({SIGNAL_SQL}) GROUP BY 1)""",
       ["reference_share", "last_share", "ratio"])
def signal_stability(r):
    return M.signal_stability(signals(r), "signal", "epoch", "frac", "BUILDING", "MACHINERY")


@query(f"""SELECT c.epoch, count(*) AS n_stays, {share('frac_specimen_48h', 'm.early')}, {share('frac_specimen_anytime', 'm.stay_id IS NOT NULL')},
    {share('frac_micro_order_48h', 'o.micro')}, {share('frac_lab_order_48h', 'o.lab')}, {share('frac_culture_order_48h', 'o.culture')} FROM cohort c
    LEFT JOIN (SELECT c2.stay_id, bool_or(coalesce(m.charttime, CAST(m.chartdate AS TIMESTAMP)) BETWEEN c2.intime AND c2.intime + INTERVAL 48 HOUR) AS early
        FROM microbiologyevents m JOIN cohort c2 ON c2.hadm_id = m.hadm_id GROUP BY 1) m ON m.stay_id = c.stay_id
    LEFT JOIN (SELECT c3.stay_id, bool_or(lower(p.order_type) LIKE '%microbio%') AS micro, bool_or(lower(p.order_type) LIKE '%lab%') AS lab,
        bool_or(lower(p.order_subtype) LIKE '%culture%' OR lower(p.order_subtype) LIKE '%micro%' OR lower(p.order_subtype) LIKE '%blood cx%') AS culture
        FROM poe p JOIN cohort c3 ON c3.hadm_id = p.hadm_id WHERE TRY_CAST(p.ordertime AS TIMESTAMP) BETWEEN c3.intime AND c3.intime + INTERVAL 48 HOUR GROUP BY 1) o
    ON o.stay_id = c.stay_id GROUP BY 1""",
       ["frac_specimen_48h", "frac_specimen_anytime", "frac_micro_order_48h", "frac_lab_order_48h", "frac_culture_order_48h"])
def order_audit(r):
    return A.order_coverage(r.microbiologyevents, r.poe, study(r).cohort)


@query("""SELECT c.epoch, count(m.hadm_id) AS n_specimens, avg(CASE WHEN m.hadm_id IS NULL THEN NULL WHEN m.charttime IS NULL THEN 1e0 ELSE 0e0 END) AS frac_no_charttime,
    count(m.hadm_id) / count(DISTINCT c.stay_id) AS specimens_per_stay FROM cohort c LEFT JOIN microbiologyevents m ON m.hadm_id = c.hadm_id GROUP BY 1""",
       ["frac_no_charttime", "specimens_per_stay"])
def specimen_timing(r):
    return A.specimen_timing(r.microbiologyevents, study(r).cohort)


@query("SELECT order_type, count(*) AS n FROM poe GROUP BY 1 ORDER BY n DESC, order_type NULLS LAST LIMIT 20")
def top_order_types(r):
    return A.top_groups(r.poe, "order_type", 20, "order_type")


@query("SELECT order_subtype, count(*) AS n FROM poe WHERE lower(order_type) LIKE '%lab%' GROUP BY 1 ORDER BY n DESC, order_subtype NULLS LAST LIMIT 25")
def top_lab_orders(r):
    return A.lab_order_subtypes(r.poe)


STEMS = " OR ".join(f"contains(lower(p.drug), '{s}')" for s in config.ANTIBIOTIC_STEMS)


@query(f"""SELECT upper(coalesce(p.route, 'NULL')) AS route, count(*) AS n FROM prescriptions p JOIN cohort c ON c.hadm_id = p.hadm_id WHERE {STEMS}
    GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15""")
def top_antibiotic_routes(r):
    return A.antibiotic_inventory(r.prescriptions, study(r).cohort, "route")


@query(f"""SELECT lower(p.drug) AS drug, count(*) AS n FROM prescriptions p JOIN cohort c ON c.hadm_id = p.hadm_id WHERE {STEMS} GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15""")
def top_antibiotics(r):
    return A.antibiotic_inventory(r.prescriptions, study(r).cohort, "drug")


@query("SELECT upper(m.spec_type_desc) AS spec_type_desc, count(*) AS n FROM microbiologyevents m JOIN cohort c ON c.hadm_id = m.hadm_id GROUP BY 1 ORDER BY n DESC, 1 NULLS LAST LIMIT 15")
def top_specimens(r):
    return A.specimen_inventory(r.microbiologyevents, study(r).cohort)


@query("SELECT source AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, 1 NULLS LAST LIMIT 10")
def top_groups(r):
    return A.top_groups(r.documents, "source", 10)


def site_flags(r) -> dict[str, DataFrame]:
    return {
        "microlab": r.o_micro.select(F.col("patientunitstayid").alias("stay_id")).distinct(),
        "culture": A.stays_with_text(r.o_treatment, "treatmentstring", config.OFFSET_CULTURE),
        "antibiotic": A.stays_with_text(r.o_treatment, "treatmentstring", config.OFFSET_ANTIBIOTIC),
        "creatinine": A.stays_with_prefix(r.o_lab, "labname", ["creatinine"]),
    }


def site_rate_frame(r) -> DataFrame:
    stays = r.o_patient.join(r.o_hospital, "hospitalid", "left").withColumnRenamed("patientunitstayid", "stay_id")
    return A.site_rates(stays, site_flags(r))


SITE_RATES = [f"frac_{n}" for n in ("microlab", "culture", "antibiotic", "creatinine")]
FLAG_SQL = {"microlab": "SELECT patientunitstayid FROM o_micro", "culture": "SELECT patientunitstayid FROM o_treatment WHERE lower(treatmentstring) LIKE '%cultures%'",
            "antibiotic": "SELECT patientunitstayid FROM o_treatment WHERE lower(treatmentstring) LIKE '%antibacterial%' OR lower(treatmentstring) LIKE '%antibiotic%'",
            "creatinine": "SELECT patientunitstayid FROM o_lab WHERE lower(labname) LIKE 'creatinine%'"}
SITE_RATE_SQL = f"""SELECT p.hospitalid, any_value(h.region) AS region, any_value(h.numbedscategory) AS numbedscategory, any_value(h.teachingstatus) AS teachingstatus,
    count(*) AS n_stays, {', '.join(share('frac_' + n, f'p.patientunitstayid IN ({sql})') for n, sql in FLAG_SQL.items())}
    FROM o_patient p LEFT JOIN o_hospital h ON h.hospitalid = p.hospitalid GROUP BY 1"""


@query(SITE_RATE_SQL, SITE_RATES)
def site_rates(r):
    return site_rate_frame(r)


@query(" UNION ALL ".join(f"SELECT '{x}' AS rate, {p}e0 AS p, quantile_cont({x}, {p}) AS quantile FROM ({SITE_RATE_SQL})"
                          for x in SITE_RATES for p in (0.1, 0.25, 0.5, 0.75, 0.9, 1.0)), ["p", "quantile"])
def rate_distribution(r):
    return A.rate_distribution(site_rate_frame(r), SITE_RATES)


@query(" UNION ALL ".join(f"""SELECT '{x}' AS rate, {t}e0 AS threshold, count(*) FILTER (WHERE {x} >= {t}e0) AS n_sites,
    CAST(coalesce(sum(n_stays) FILTER (WHERE {x} >= {t}e0), 0) AS BIGINT) AS n_stays FROM ({SITE_RATE_SQL}) WHERE n_stays >= 100"""
                          for x in SITE_RATES for t in config.RATE_THRESHOLDS), ["threshold"])
def threshold_sweep(r):
    return A.threshold_sweep(site_rate_frame(r), SITE_RATES)


@query(f"""SELECT region, count(*) AS n_sites, CAST(sum(n_stays) AS BIGINT) AS n_stays, {', '.join(f'sum({x} * n_stays) / sum(n_stays) AS {x}' for x in SITE_RATES)}
    FROM ({SITE_RATE_SQL}) GROUP BY 1""", SITE_RATES)
def region_rates(r):
    return A.region_rates(site_rate_frame(r), SITE_RATES)


AVAILABLE = ["creatinine", "platelets", "bilirubin_total", "pao2", "map", "heart_rate", "gcs", "urine", "pressor", "ventilator"]
AVAILABLE_SQL = """(SELECT stay_id, concept FROM s_labs WHERE hours < 6 UNION ALL SELECT stay_id, concept FROM s_vitals WHERE hours < 6
    UNION ALL SELECT stay_id, 'gcs' FROM s_gcs WHERE hours < 6 UNION ALL SELECT stay_id, 'urine' FROM s_urine WHERE hours < 6
    UNION ALL SELECT stay_id, 'pressor' FROM s_pressors WHERE hours <= 48 UNION ALL SELECT stay_id, 'ventilator' FROM s_vent WHERE hours <= 48)"""


def availability(r):
    s = sites(r)
    early = F.col("hours") < 6
    parts = [
        O.lab(r.o_lab, s.cohort).where(early).select("stay_id", "concept"),
        O.vital(r.o_periodic, r.o_aperiodic, s.cohort).where(early).select("stay_id", "concept"),
        O.gcs_total(r.o_nurse, s.cohort).where(early).select("stay_id", F.lit("gcs").alias("concept")),
        s.urine.where(early).select("stay_id", F.lit("urine").alias("concept")),
        O.vasopressor_rates(r.o_infusion, s.cohort, 48).select("stay_id", F.lit("pressor").alias("concept")),
        O.ventilated_hours(r.o_respiratory, s.cohort, 48).select("stay_id", F.lit("ventilator").alias("concept")),
    ]
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    return A.concept_availability(s.cohort, hits, AVAILABLE, min_stays=Q.SITE_LIMITS[0])


@query(" UNION ALL ".join(f"SELECT '{c}' AS concept, avg(CASE WHEN stay_id IN (SELECT stay_id FROM {AVAILABLE_SQL} WHERE concept = '{c}') THEN 1e0 ELSE 0e0 END) AS frac FROM s_cohort" for c in AVAILABLE), ["frac"])
def concept_availability(r):
    return availability(r)[0]


@query(f"""SELECT concept, count(*) AS n_sites, quantile_cont(frac, 0.1) AS p10, quantile_cont(frac, 0.25) AS p25, quantile_cont(frac, 0.5) AS p50,
    quantile_cont(frac, 0.75) AS p75, quantile_cont(frac, 0.9) AS p90 FROM (
        SELECT k.concept, c.hospitalid, avg(CASE WHEN h.stay_id IS NOT NULL THEN 1e0 ELSE 0e0 END) AS frac FROM s_cohort c
        CROSS JOIN (VALUES {Q.values([(c,) for c in AVAILABLE])}) AS k(concept)
        LEFT JOIN (SELECT DISTINCT stay_id, concept FROM {AVAILABLE_SQL}) h ON h.stay_id = c.stay_id AND h.concept = k.concept
        GROUP BY 1, 2 HAVING count(*) >= {Q.SITE_LIMITS[0]}) GROUP BY 1""", ["p10", "p25", "p50", "p75", "p90"])
def site_spread(r):
    return A.site_spread(availability(r)[1])


@query(f"""SELECT n_rows, n_stays_with_record, n_negative, n_stays, n_stays_with_record / n_stays AS frac_stays_with_record, n_rows / greatest(n_stays_with_record, 1) AS records_per_stay,
    CASE WHEN n_negative / greatest(n_rows, 1) < 0.01 AND n_stays_with_record / n_stays < 0.25 THEN 'positive only' ELSE 'includes negatives' END AS verdict
    FROM (SELECT count(*) AS n_rows, count(DISTINCT patientunitstayid) AS n_stays_with_record, count(*) FILTER (WHERE {Q.any_like('lower(organism)', ['%' + m + '%' for m in config.NEGATIVE_MARKERS])}) AS n_negative,
          (SELECT count(*) FROM o_patient) AS n_stays FROM o_micro)""", ["frac_stays_with_record", "records_per_stay"])
def negative_marker_audit(r):
    return A.negative_marker_audit(r.o_micro, r.o_patient)


# --- features ------------------------------------------------------------------------------------
@query("SELECT * FROM panel", Q.VARIABLES)
def hourly_panel(r):
    return study(r).panel


@query(f"SELECT variable, count(*) AS n_late FROM (SELECT 'labs' AS variable, hours FROM labs UNION ALL SELECT 'charts', hours FROM charts) WHERE hours >= {config.WINDOW_HOURS} GROUP BY 1")
def leak_count(r):
    s = study(r)
    labs = C.lab(r.labevents, s.cohort, None, Q.STUDY_HOURS).select(F.lit("labs").alias("variable"), "hours")
    charts = C.chart(r.chartevents, s.cohort, None, Q.STUDY_HOURS).select(F.lit("charts").alias("variable"), "hours")
    return X.leaks(labs.unionByName(charts), config.WINDOW_HOURS)


def tabular_sql(v: str) -> str:
    return (f"min({v}) AS {v}__min, max({v}) AS {v}__max, avg({v}) AS {v}__mean, arg_min({v}, hour) FILTER (WHERE {v} IS NOT NULL) AS {v}__first, "
            f"arg_max({v}, hour) FILTER (WHERE {v} IS NOT NULL) AS {v}__last")


@query(f"SELECT stay_id, {', '.join(tabular_sql(v) for v in Q.VARIABLES)} FROM panel GROUP BY 1", [f"{v}__{a}" for v in Q.VARIABLES for a in config.AGGREGATIONS])
def tabular_features(r):
    s = study(r)
    return X.tabular_view(s.panel, s.variables)


@query("SELECT stay_id, hour, " + ", ".join(f"last_value({v} IGNORE NULLS) OVER (PARTITION BY stay_id ORDER BY hour) AS {v}" for v in Q.VARIABLES) + " FROM panel", Q.VARIABLES)
def sequence_features(r):
    s = study(r)
    steps = X.sequence_view(s.panel, s.variables).select("stay_id", F.posexplode("sequence").alias("hour", "_x"))
    return steps.select("stay_id", "hour", *[F.col("_x")[i].alias(v) for i, v in enumerate(s.variables)])


@query("""SELECT stay_id, CAST(age AS DOUBLE) AS age, CASE WHEN gender = 'F' THEN 1e0 ELSE 0e0 END AS "sex=F", CASE WHEN gender = 'M' THEN 1e0 ELSE 0e0 END AS "sex=M",
    """ + ", ".join(f"""CASE WHEN coalesce(admission_type, 'UNKNOWN') = '{a}' THEN 1e0 ELSE 0e0 END AS "admission_type={a}" """ for a in ("ELECTIVE", "EMERGENCY", "UNKNOWN", "URGENT")) + " FROM cohort")
def static_one_hot(r):
    static = X.static_frame(study(r).cohort)
    dummies = X.one_hot(static, "sex", X.levels(static, "sex")) | X.one_hot(static, "admission_type", X.levels(static, "admission_type"))
    return static.select("stay_id", "age", *[c.alias(n) for n, c in dummies.items()])


@query(f"""SELECT count(*) AS n_stays, sum(n_cells) / (count(*) * {len(Q.VARIABLES) * 6}) AS missing_sequence FROM (
    SELECT stay_id, sum({' + '.join(f'CAST({v} IS NULL AS INTEGER)' for v in Q.VARIABLES)}) AS n_cells FROM (
        SELECT stay_id, hour, {', '.join(f'last_value({v} IGNORE NULLS) OVER (PARTITION BY stay_id ORDER BY hour) AS {v}' for v in Q.VARIABLES)} FROM panel) GROUP BY 1)""", ["missing_sequence"])
def matrix_missing(r):
    matrix, _ = study(r).matrix()
    n = matrix.agg(F.count(F.lit(1)).alias("n")).scalar()
    return X.missing_fraction(matrix).select(n.alias("n_stays"), "missing_sequence")


def vectors(r) -> DataFrame:
    return r.vectors.withColumn("features", F.transform("embedding", lambda x: x.cast("double"))).drop("embedding")


VECTOR_LONG = "SELECT stay_id, era, CAST(unnest(generate_series(0, 63)) AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM vectors"
STATS_SQL = f"""SELECT pos, m AS median, avg(x) AS mean, CASE WHEN stddev_pop(x) > 1e-12 THEN stddev_pop(x) ELSE 1e0 END AS sd FROM (
    SELECT pos, x, median(x) OVER (PARTITION BY pos) AS m FROM ({VECTOR_LONG}) WHERE era <> 2) GROUP BY 1, 2"""


@query(STATS_SQL, ["median", "mean", "sd"])
def fit_preprocessor(r):
    return X.fit_preprocessor(vectors(r).where(F.col("era") != 2), "features")


@query(f"SELECT v.stay_id, v.pos, (v.x - s.mean) / s.sd AS x FROM ({VECTOR_LONG}) v JOIN ({STATS_SQL}) s ON s.pos = v.pos", ["x"])
def fit_apply_preprocessor(r):
    rows = vectors(r)
    stats = X.fit_preprocessor(rows.where(F.col("era") != 2), "features")
    return X.apply_preprocessor(rows, stats, "features").select("stay_id", F.posexplode("features").alias("pos", "x"))


STEP_LONG = f"SELECT stay_id, pos // 16 AS hour, pos % 16 AS pos, x FROM ({VECTOR_LONG})"
STEP_STATS_SQL = f"""SELECT CAST(pos AS INTEGER) AS pos, m AS median, avg(x) AS mean, CASE WHEN stddev_pop(x) > 1e-12 THEN stddev_pop(x) ELSE 1e0 END AS sd FROM (
    SELECT pos, x, median(x) OVER (PARTITION BY pos) AS m FROM ({STEP_LONG})) GROUP BY 1, 2"""


def sequences(r) -> DataFrame:
    """Vectors read as four hours of sixteen variables."""
    hours = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda h: F.slice("features", h * 16 + 1, F.lit(16)))
    return vectors(r).select("stay_id", hours.alias("sequence"))


@query(STEP_STATS_SQL, ["median", "mean", "sd"])
def fit_sequence_preprocessor(r):
    return X.fit_sequence_preprocessor(sequences(r))


@query(f"SELECT v.stay_id, CAST(v.hour AS INTEGER) AS hour, CAST(v.pos AS INTEGER) AS pos, (v.x - s.mean) / s.sd AS x FROM ({STEP_LONG}) v JOIN ({STEP_STATS_SQL}) s ON s.pos = v.pos", ["x"])
def fit_apply_sequence_preprocessor(r):
    rows = sequences(r)
    scaled = X.apply_sequence_preprocessor(rows, X.fit_sequence_preprocessor(rows))
    return scaled.select("stay_id", F.posexplode("sequence").alias("hour", "step")).select("stay_id", "hour", F.posexplode("step").alias("pos", "x"))


@query("""SELECT source, lang, CASE WHEN n > 0 AND n < 10 THEN NULL ELSE n END AS n, CASE WHEN n_long > 0 AND n_long < 10 THEN NULL ELSE n_long END AS n_long
    FROM (SELECT source, lang, count(*) AS n, count(*) FILTER (WHERE n_chars > 2000) AS n_long FROM documents GROUP BY 1, 2)""")
def small_cells_suppressed(r):
    counts = r.documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 2000).alias("n_long"))
    return suppress(counts, ["n", "n_long"], 10)


# --- splits -----------------------------------------------------------------------------------------
@query(f"SELECT doc_id, CAST({Q.hash_sql(chr(39) + '0:' + chr(39) + ' || doc_id')} % 5 AS INTEGER) AS fold FROM documents")
def hash_folds(r):
    return P.assign_folds(r.documents.select("doc_id"), 5, 0, "doc_id")


GROUPS_SQL = f"""SELECT source, CAST((row_number() OVER (ORDER BY {Q.hash_sql("'7:' || source")}, source) - 1) % 3 AS INTEGER) AS "group" FROM (SELECT DISTINCT source FROM documents)"""


@query(f"""SELECT 'fold' || CAST("group" AS VARCHAR) AS name, 'cv' AS design, count(*) AS n_test, (SELECT count(*) FROM documents) - count(*) AS n_train
    FROM documents d JOIN ({GROUPS_SQL}) g ON g.source = d.source GROUP BY 1
    UNION ALL SELECT lang, 'loro', count(*), (SELECT count(*) FROM documents) - count(*) FROM documents WHERE lang IN ('en', 'fr', 'de', 'es') GROUP BY 1 HAVING count(*) >= 100""")
def site_splits(r):
    docs = r.documents.select(F.col("source").alias("site"), F.col("lang").alias("region"))
    return P.site_splits(docs, 3, 7, ["en", "fr", "de", "es"], min_stays=100)


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) INTERSECT SELECT doc_id FROM documents WHERE n_chars > 500")
def shared_ids(r):
    return P.overlapping_ids(r.documents.join(r.labels, "doc_id", "left_semi"), r.documents.where(F.col("n_chars") > 500), "doc_id")


@query(f"""SELECT doc_id, quality FROM (SELECT l.doc_id, l.quality, row_number() OVER (PARTITION BY l.quality ORDER BY md5('2000:' || l.doc_id), l.doc_id) AS rk, w.n, w.p
    FROM (SELECT s.doc_id, s.quality FROM scored s WHERE s.lang = 'en') l CROSS JOIN (
        SELECT CAST(round_even(0.8e0 * count(*), 0) AS BIGINT) AS n, CAST(round_even(0.8e0 * sum(quality), 0) AS BIGINT) AS p FROM scored WHERE lang <> 'en') w)
    WHERE rk <= CASE WHEN quality = 1 THEN p ELSE n - p END""")
def matched_sample(r):
    rows = r.scored.select("doc_id", F.col("quality").alias("y"), "lang")
    out = P.match_training(rows.where(F.col("lang") == "en"), rows.where(F.col("lang") != "en"), "event_matched", 5, 0, ident="doc_id")
    return out.select("doc_id", F.col("y").alias("quality"))


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('1003:' || doc_id), doc_id) AS rk FROM scored WHERE lang = 'en')
    WHERE rk <= (SELECT CAST(round_even(0.8e0 * count(*), 0) AS BIGINT) FROM scored WHERE lang <> 'en')""")
def size_matched_sample(r):
    rows = r.scored.select("doc_id", F.col("quality").alias("y"), "lang")
    return P.match_training(rows.where(F.col("lang") == "en"), rows.where(F.col("lang") != "en"), "matched", 5, 3, ident="doc_id").select("doc_id")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('5:' || doc_id), doc_id) AS rk FROM documents) WHERE rk <= 10")
def sample_per_group(r):
    return sample_n(r.documents, "doc_id", F.lit(10), 5, ["source"]).select("source", "doc_id")


# --- metrics ------------------------------------------------------------------------------------------
@query(Q.auroc_sql("(SELECT *, 1e0 AS w FROM pred)", ["label", "model", "seed", "kind"]), ["n_pos", "n_neg", "auroc"])
def auroc(r):
    return M.auroc(r.pred, ["label", "model", "seed", "kind"])


@query(f"""SELECT lang, (po - pe) / nullif(1 - pe, 0) AS quality__toxic FROM (SELECT lang, po, a * b + (1 - a) * (1 - b) AS pe FROM (
    SELECT lang, avg(CASE WHEN quality = toxic THEN 1e0 ELSE 0e0 END) AS po, avg(quality) AS a, avg(toxic) AS b FROM scored GROUP BY 1))""", ["quality__toxic"])
def kappa(r):
    return M.cohens_kappa(r.scored, ["quality", "toxic"], ["lang"])


PAIRS = [(a, b) for i, a in enumerate(LABELS) for b in LABELS[i + 1:]]


@query("SELECT epoch, " + ", ".join(
    f"""(avg(CASE WHEN {a} = {b} THEN 1e0 ELSE 0e0 END) - (avg({a}) * avg({b}) + (1 - avg({a})) * (1 - avg({b})))) / nullif(1 - (avg({a}) * avg({b}) + (1 - avg({a})) * (1 - avg({b}))), 0) AS {a}__{b}"""
    for a, b in PAIRS) + " FROM labelled GROUP BY 1", [f"{a}__{b}" for a, b in PAIRS])
def label_kappa(r):
    return M.cohens_kappa(study(r).labelled, LABELS, ["epoch"])


def icc_sql(rows: str, value: str, cluster: str, key: str) -> str:
    return f"""SELECT {key}, k, n, icc, m0, 1 + (m0 - 1) * icc AS deff FROM (
        SELECT *, CASE WHEN k < 2 OR n - k < 1 OR msb + (m0 - 1) * msw <= 0 THEN 0e0 ELSE greatest((msb - msw) / nullif(msb + (m0 - 1) * msw, 0), 0e0) END AS icc FROM (
            SELECT *, ssb / nullif(k - 1, 0) AS msb, ssw / nullif(n - k, 0) AS msw, CASE WHEN k < 2 OR n - k < 1 THEN n / k ELSE (n - mm / n) / (k - 1) END AS m0 FROM (
                SELECT {key}, count(*) AS k, CAST(sum(m) AS BIGINT) AS n, sum(m * (mean - grand) ** 2) AS ssb, sum(ss) AS ssw, sum(m * m) AS mm FROM (
                    SELECT {key}, {cluster}, count(*) AS m, avg({value}) AS mean, any_value(g) AS grand, sum(({value} - cm) ** 2) AS ss FROM (
                        SELECT *, avg({value}) OVER (PARTITION BY {key}) AS g, avg({value}) OVER (PARTITION BY {key}, {cluster}) AS cm FROM {rows}) GROUP BY 1, 2) GROUP BY 1)))"""


@query(icc_sql("scored", "toxic", "source", "lang"), ["icc", "m0", "deff"])
def icc_deff(r):
    return M.icc_anova(r.scored, "toxic", "source", ["lang"])


@query(icc_sql("s_labelled", "aki_urine", "hospitalid", "region"), ["icc", "m0", "deff"])
def site_icc(r):
    s = sites(r)
    return M.icc_anova(s.labelled.join(s.cohort.select("stay_id", "region"), "stay_id"), "aki_urine", "hospitalid", ["region"])


@query(" UNION ALL ".join(f"SELECT lang, {p}e0 AS p, count(n_chars) AS n, quantile_cont(n_chars, {p}) AS quantile FROM documents GROUP BY lang" for p in (0.1, 0.5, 0.95)), ["p", "quantile"])
def group_quantiles(r):
    return quantiles(r.documents, ["lang"], "n_chars", [0.1, 0.5, 0.95])


def cells(r) -> DataFrame:
    return M.gap_scales(ML_cells(r))


def ML_cells(r) -> DataFrame:
    def of(kind):
        return F.max(F.when(F.col("kind") == kind, F.col("auroc"))).alias(f"auroc_{kind}")

    return M.auroc(r.pred, ["label", "model", "seed", "kind"]).groupBy("label", "model", "seed").agg(of("transferred"), of("oracle"))


@query("SELECT label, model, avg(auroc_transferred) AS auroc_transferred, avg(auroc_oracle) AS auroc_oracle, avg(gap) AS gap, count(*) AS n_runs FROM cells GROUP BY 1, 2",
       ["auroc_transferred", "auroc_oracle", "gap"])
def gap_summary(r):
    return M.gap_summary(cells(r), ["label", "model"])


@query("SELECT label, model, seed, auroc_transferred, auroc_oracle, gap, gap_relative, gap_logit FROM cells", ["auroc_transferred", "auroc_oracle", "gap", "gap_relative", "gap_logit"])
def gap_scales(r):
    return cells(r)


@query("SELECT * FROM signs", ["gap", "gap_relative", "gap_logit"])
def sign_agreement(r):
    return M.sign_agreement(cells(r), "toxic", "quality")


@query("""SELECT did_mean, did_sd, k AS seeds, did_sd / sqrt(k) AS se_seed, sqrt(0.003e0 * 0.003e0 + did_sd * did_sd / k) AS total_se, 2.443e0 * sqrt(0.003e0 * 0.003e0 + did_sd * did_sd / k) AS delta_min
    FROM (SELECT avg(d) AS did_mean, stddev_samp(d) AS did_sd FROM (SELECT seed, avg(d) AS d FROM (SELECT seed, model,
        avg(gap) FILTER (WHERE label = 'toxic') - avg(gap) FILTER (WHERE label = 'quality') AS d FROM cells GROUP BY 1, 2) GROUP BY 1))
    CROSS JOIN (VALUES (5), (10), (15), (20)) AS g(k)""", ["did_mean", "did_sd", "se_seed", "total_se", "delta_min"])
def seed_variance(r):
    return M.seed_variance(cells(r), "toxic", "quality", 0.003)


@query("""WITH g AS (SELECT label, model, seed, auroc_transferred, auroc_oracle, gap, 'full' AS training_size FROM cells
        UNION ALL SELECT label, model, seed, auroc_transferred, auroc_oracle, gap + CASE WHEN model = 'length' THEN -0.005 ELSE 0.005 END, 'matched' FROM cells)
    SELECT 'size_matching_does_not_lower_the_gap' AS "check", model AS item, m AS value, CASE WHEN m < -0.001 THEN 'REVIEW' ELSE 'OK' END AS status
        FROM (SELECT model, avg(gap) FILTER (WHERE training_size = 'matched') - avg(gap) FILTER (WHERE training_size = 'full') AS m FROM g GROUP BY model)
    UNION ALL SELECT 'auroc_plausible', label, max(auroc_oracle), CASE WHEN min(auroc_oracle) >= 0.6 AND max(auroc_oracle) <= 0.9 THEN 'OK' ELSE 'REVIEW' END FROM g GROUP BY label
    UNION ALL SELECT 'no_auroc_above_band', 'all', max(greatest(auroc_oracle, auroc_transferred)), CASE WHEN max(greatest(auroc_oracle, auroc_transferred)) > 0.9 THEN 'FAIL' ELSE 'OK' END FROM g
    UNION ALL SELECT 'seed_noise_below_half_sesoi', 'all', max(sd) / sqrt(5), CASE WHEN max(sd) / sqrt(5) < 0.005 THEN 'OK' ELSE 'REVIEW' END
        FROM (SELECT stddev_samp(gap) AS sd FROM g GROUP BY model, label) HAVING max(sd) IS NOT NULL""", ["value"])
def sanity_checks(r):
    full = cells(r).select("label", "model", "seed", "auroc_transferred", "auroc_oracle", "gap")
    shift = F.when(F.col("model") == "length", -0.005).otherwise(0.005)
    sizes = full.withColumn("training_size", F.lit("full")).unionByName(full.withColumn("gap", F.col("gap") + shift).withColumn("training_size", F.lit("matched")))
    return M.sanity_checks(sizes)


@query("""SELECT label, lang, n, tp AS prevalence_train, pos / n AS prevalence_test, round_even(0.8e0 * n, 0) * tp AS transferred_positives, round_even(0.8e0 * n, 0) * pos / n AS oracle_positives, tp * n / nullif(pos, 0) AS ratio
    FROM (SELECT label, lang, count(*) AS n, sum(y) * 1e0 AS pos FROM (SELECT 'quality' AS label, lang, quality AS y FROM scored UNION ALL SELECT 'toxic', lang, toxic FROM scored) GROUP BY 1, 2) a
    JOIN (SELECT 'quality' AS l2, avg(quality) AS tp FROM scored WHERE lang = 'en' UNION ALL SELECT 'toxic', avg(toxic) FROM scored WHERE lang = 'en') b ON b.l2 = a.label WHERE lang <> 'en'""",
       ["prevalence_train", "prevalence_test", "transferred_positives", "oracle_positives", "ratio"])
def event_counts(r):
    return M.event_counts(r.scored, ["quality", "toxic"], "lang", ["en"], 5)


def testable(x: str) -> str:
    return f"CASE WHEN {x} <= 0.01 THEN 'equivalence testable' WHEN {x} <= 0.02 THEN 'detection only' ELSE 'underpowered' END"


@query(f"""SELECT lang, n_test, prev_a, prev_b, groups_averaged, n_positives, se, delta_min, verdict, greatest(qa, qb) AS sqrt_deff_used, delta_min * greatest(qa, qb) / sqrt(groups_averaged) AS delta_min_conservative,
    delta_min * CASE WHEN prev_a <= prev_b THEN qa ELSE qb END / sqrt(groups_averaged) AS delta_min_optimistic, {testable('delta_min * greatest(qa, qb) / sqrt(groups_averaged)')} AS verdict_clustered
    FROM (SELECT *, {testable('delta_min')} AS verdict FROM (SELECT *, 2.443e0 * se AS delta_min FROM (SELECT *, 0.0035e0 * sqrt(500e0 / greatest(n_positives, 1e0)) AS se FROM (
        SELECT lang, count(*) AS n_test, avg(toxic) AS prev_a, avg(quality) AS prev_b, 3 AS groups_averaged, count(*) * least(avg(toxic), avg(quality)) AS n_positives FROM scored GROUP BY 1)))) p
    JOIN (SELECT lang AS l2, sqrt(deff) AS qa FROM ({icc_sql('scored', 'toxic', 'source', 'lang')})) a ON a.l2 = p.lang
    JOIN (SELECT lang AS l3, sqrt(deff) AS qb FROM ({icc_sql('scored', 'quality', 'source', 'lang')})) b ON b.l3 = p.lang""",
       ["prev_a", "prev_b", "n_positives", "se", "delta_min", "sqrt_deff_used", "delta_min_conservative", "delta_min_optimistic"])
def precision_projection(r):
    splits = r.scored.groupBy("lang").agg(F.count(F.lit(1)).alias("n_test"), F.avg("toxic").alias("prev_a"), F.avg("quality").alias("prev_b"))
    projected = M.project_precision(splits.withColumn("groups_averaged", F.lit(3)), 0.0035, 500.0)
    out = M.design_effect(projected, M.icc_anova(r.scored, "toxic", "source", ["lang"]), M.icc_anova(r.scored, "quality", "source", ["lang"]), ["lang"])
    return out.drop("sqrt_deff_a", "sqrt_deff_b")


# --- inference -------------------------------------------------------------------------------------------
DRAWS = ["draw_both", "draw_units", "draw_seeds"]
SUMMARY = ["se", "ci95_lo", "ci95_hi", "ci90_lo", "ci90_hi", "p_raw", "delta_min"]


def bootstrap(r, method="poisson", level=None, n_boot=Q.N_BOOT):
    return I.two_level_bootstrap(r.pred, "toxic", "quality", n_boot, 0, method, level)


@query("SELECT * REPLACE (CAST(rep AS INTEGER) AS rep) FROM unit_draws", DRAWS)
def bootstrap_gap(r):
    return bootstrap(r)[0]


@query("SELECT * REPLACE (CAST(rep AS INTEGER) AS rep) FROM exact_draws", DRAWS)
def exact_bootstrap_gap(r):
    return bootstrap(r, "multinomial", "unit")[0]


@query("SELECT * REPLACE (CAST(rep AS INTEGER) AS rep) FROM source_draws", DRAWS)
def cluster_bootstrap_gap(r):
    return bootstrap(r, "multinomial")[0]


@query("SELECT * REPLACE (CAST(rep AS INTEGER) AS rep) FROM sourcep_draws", DRAWS)
def cluster_poisson_gap(r):
    return bootstrap(r, "poisson", "cluster")[0]


@query(f"{Q.summary_sql('SELECT * FROM source_draws', 'draw_both')}", SUMMARY)
def bootstrap_summary(r):
    return I.summarise_draws(bootstrap(r, "multinomial")[0], "draw_both")


def decomposed_sql(draws: str) -> str:
    return f"""SELECT *, se_both / nullif(se_quadrature, 0) AS ratio_both_to_quadrature, se_seeds * se_seeds / nullif(se_quadrature * se_quadrature, 0) AS seed_share
        FROM (SELECT *, sqrt(se_units * se_units + se_seeds * se_seeds) AS se_quadrature FROM (
            SELECT stddev_samp(draw_both) AS se_both, stddev_samp(draw_units) AS se_units, stddev_samp(draw_seeds) AS se_seeds FROM ({draws})))"""


@query(decomposed_sql(f"SELECT * FROM source_draws WHERE rep <= {Q.N_PARTS}"), ["se_both", "se_units", "se_seeds", "se_quadrature", "ratio_both_to_quadrature", "seed_share"])
def variance_decomposition(r):
    return I.decompose(bootstrap(r, "multinomial", n_boot=Q.N_PARTS)[0])


def estimate_sql(name: str, a: str, b: str) -> str:
    draws = Q.draws_sql("source_gaps", a, b)
    parts = decomposed_sql(draws)
    signs = f"""(SELECT (SELECT count(DISTINCT sign(x)) FROM (VALUES (g), (r), (l)) AS t(x) WHERE x <> 0) <= 1 FROM (
        SELECT avg(g) AS g, avg(r) AS r, avg(l) AS l FROM (SELECT model, {', '.join(f"avg({s}) FILTER (WHERE label = '{a}') - avg({s}) FILTER (WHERE label = '{b}') AS {o}" for s, o in (('gap', 'g'), ('gap_relative', 'r'), ('gap_logit', 'l')))} FROM cells GROUP BY model)))"""
    return f"""SELECT '{name}' AS contrast, s.*, d.se_units, d.se_seeds, d.se_quadrature, d.ratio_both_to_quadrature, d.seed_share, p.point, {signs} AS all_agree
        FROM ({Q.summary_sql(draws, 'draw_both')}) s CROSS JOIN ({parts}) d CROSS JOIN ({Q.point_sql('source_gaps', a, b)}) p"""


@query(f"""SELECT *, p_holm < 0.05 AS reject, {Q.VERDICT} AS verdict FROM (SELECT * EXCLUDE (step), max(step) OVER (ORDER BY p_raw, contrast ROWS UNBOUNDED PRECEDING) AS p_holm FROM (
    SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p_raw, contrast) + 1) * p_raw) AS step FROM (
        {estimate_sql('toxic_minus_quality', 'toxic', 'quality')} UNION ALL {estimate_sql('quality_minus_toxic', 'quality', 'toxic')})))""",
       [*SUMMARY, "se_units", "se_seeds", "se_quadrature", "ratio_both_to_quadrature", "seed_share", "point", "p_holm"])
def holm_verdict(r):
    contrasts = [("toxic_minus_quality", "toxic", "quality"), ("quality_minus_toxic", "quality", "toxic")]
    return estimate_contrasts(r.pred, contrasts, Q.N_BOOT, 0, "multinomial")


def draws_by_source_group(r) -> DataFrame:
    """A draw per replicate and disjoint part: toxic share of each language under resampled sources."""
    weights = I.cluster_weights(r.scored.select(F.col("source").alias("cluster")), Q.N_BOOT, 0)
    rows = r.scored.groupBy("lang", F.col("source").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t"))
    drawn = rows.join(weights, "cluster").select("lang", "n", "t", F.posexplode("weights").alias("rep", "w"))
    return drawn.where(F.col("rep") > 0).groupBy("lang", "rep").agg(
        F.try_divide(F.sum(F.col("w") * F.col("t")).cast("double"), F.sum(F.col("w") * F.col("n"))).alias("draw"))


@query("""SELECT CAST(rep AS INTEGER) AS rep, CASE WHEN count(d.draw) = 4 THEN sum(d.draw * w.n) / sum(w.n) END AS draw FROM (
        SELECT lang, rep, sum(w * t) / nullif(sum(w * n), 0) AS draw FROM (SELECT lang, source, count(*) AS n, sum(toxic) AS t FROM scored GROUP BY 1, 2) x
        JOIN (SELECT c.cluster, c.rep, coalesce(w.w, 0) AS w FROM (SELECT cluster, unnest(generate_series(1, 2000)) AS rep FROM source_i) c LEFT JOIN source_w w ON w.cluster = c.cluster AND w.rep = c.rep) y ON y.cluster = x.source
        GROUP BY 1, 2) d
    JOIN (SELECT lang, count(*) AS n FROM scored GROUP BY 1) w ON w.lang = d.lang GROUP BY 1""", ["draw"])
def pool_disjoint(r):
    sizes = r.scored.groupBy("lang").agg(F.count(F.lit(1)).alias("weight"))
    return I.pool_disjoint(draws_by_source_group(r), sizes, "lang")


# --- reports ----------------------------------------------------------------------------------------------
REPORT = [f"prev_{c}" for c in LABELS] + ["frac_culture", "frac_antibiotic"]
EPOCH_ROWS = f"""SELECT c.epoch, count(*) AS n_stays, count(l.stay_id) AS n_common_cohort, {', '.join(f'sum(l.{c}) AS n_{c}' for c in LABELS)},
    avg(CASE WHEN c.stay_id IN (SELECT stay_id FROM cul WHERE hours BETWEEN 0 AND 48) THEN 1e0 ELSE 0e0 END) AS frac_culture,
    avg(CASE WHEN c.stay_id IN (SELECT stay_id FROM abx WHERE hours BETWEEN 0 AND 48) THEN 1e0 ELSE 0e0 END) AS frac_antibiotic
    FROM cohort c LEFT JOIN labelled l ON l.stay_id = c.stay_id GROUP BY ROLLUP (c.epoch)"""


@query(f"""SELECT coalesce(epoch, 'all epochs') AS epoch, CAST(n_stays AS BIGINT) AS n_stays, CAST(n_common_cohort AS BIGINT) AS n_common_cohort,
    {', '.join(f'n_{c} / n_common_cohort AS prev_{c}' for c in LABELS)}, frac_culture, frac_antibiotic FROM ({EPOCH_ROWS})""", REPORT)
def cohort_table(r):
    s = study(r)
    prevalence = M.prevalence(s.labelled, LABELS, ["epoch"])
    actions = L.action_rates(s.cohort, s.antibiotics, s.cultures, s.suspicion)
    return R.cohort_table(s.common[1], prevalence, actions, LABELS)


@query(" UNION ALL ".join(f"SELECT {i + 1} AS rank, '{c}' AS label, (SELECT avg({c}) FROM labelled) AS prevalence, (SELECT avg({c}) FROM s_labelled) AS site_prevalence" for i, c in enumerate(LABELS)),
       ["prevalence", "site_prevalence"])
def label_overview(r):
    here = M.prevalence(study(r).labelled, LABELS, ["epoch"])
    there = sites(r).prevalence_by("region")
    return R.label_overview(here, there, LABELS)


# --- models ------------------------------------------------------------------------------------------------------
LOGREG = ML.Spec("logreg", config.TUNED_LOGREG)
TREES = ML.Spec("trees", {"max_depth": 3, "learning_rate": 0.1, "n_estimators": 10, "subsample": 0.8})
CONFIGS = [ML.Spec("logreg", {"C": c, "max_iter": config.TUNED_LOGREG["max_iter"], "class_weight": w}, f"C={c} {w or 'plain'}") for c, w in config.LOGREG_CONFIGS]
Y = ["y_low", "y_even"]
SEEDS = list(range(config.N_SEEDS))
SIZES = ["full", "matched", "event_matched"]


def transfer_frames(r, features: int | None = None) -> DataFrame:
    rows = ML.with_folds(vectors(r))
    return rows.withColumn("features", F.slice("features", 1, features)) if features else rows


def transfer(r, spec: ML.Spec, sizes, seeds, features=None) -> DataFrame:
    pred = ML.run_grid(transfer_frames(r, features), F.col("era") != 2, F.col("era") == 2, Y, [spec], seeds, sizes)
    return ML.transfer_result(pred)


@query()
def transfer_gap_logreg(r):
    return transfer(r, LOGREG, SIZES, SEEDS)


@query(f"""SELECT label, 'logreg' AS model, seed, training_size, auroc_transferred, auroc_oracle, auroc_oracle - auroc_transferred AS gap,
        (auroc_oracle - auroc_transferred) / greatest(auroc_oracle - 0.5, 1e-6) AS gap_relative, ln(o / (1 - o)) - ln(t / (1 - t)) AS gap_logit
    FROM (SELECT *, least(greatest(auroc_oracle, 1e-6), 1 - 1e-6) AS o, least(greatest(auroc_transferred, 1e-6), 1 - 1e-6) AS t FROM (
        SELECT label, seed, training_size, max(CASE WHEN kind = 'transferred' THEN auroc END) AS auroc_transferred, max(CASE WHEN kind = 'oracle' THEN auroc END) AS auroc_oracle
        FROM ({Q.auroc_sql('(SELECT *, 1 AS w FROM one_scores)', ['label', 'seed', 'training_size', 'kind'])}) GROUP BY 1, 2, 3))""",
       ["auroc_transferred", "auroc_oracle", "gap", "gap_relative", "gap_logit"])
def transfer_gap_one_feature(r):
    """The whole grid of transfer_gap_logreg with one feature, which SQL can fit."""
    return transfer(r, LOGREG, SIZES, SEEDS, 1)


@query("SELECT label, CAST(training_set AS INTEGER) AS training_set, C, balanced, coefficient, intercept FROM fold_fits", ["coefficient", "intercept"])
def logreg_coefficients(r):
    """Coefficient and intercept of every (label, fold, setting) of one feature, for unscaled values."""
    rows = CX.labelled_rows(transfer_frames(r, 1), "stay_id", Y, "features", "fold")
    ready = CX.with_sets(rows, "stay_id", CX.other_folds(config.N_FOLDS), ())
    fits = [CX.Fit(k, i, c, w == "balanced") for i in range(len(Y)) for k in range(config.N_FOLDS) for c, w in config.LOGREG_CONFIGS]
    models = CX.fit_all(ready, fits)
    found = [(Y[f.label], f.set, f.C, f.balanced, *models[i].coefficients().tolist()) for i, f in enumerate(fits)]
    return r.spark.createDataFrame(found, "label string, training_set int, C double, balanced boolean, coefficient double, intercept double")


@query()
def transfer_gap_gbt(r):
    return transfer(r, TREES, ("full",), [0])


@query()
def learning_curve(r):
    return M.learning_points(ML.learning_curve(transfer_frames(r).where("era = 2"), LOGREG, Y))


@query(f"SELECT label, 'logreg' AS model, fraction, seed, auroc FROM ({Q.auroc_sql('(SELECT *, 1 AS w FROM curve_scores)', ['label', 'fraction', 'seed'])})", ["auroc"])
def learning_curve_one_feature(r):
    return ML.learning_curve(transfer_frames(r, 1).where("era = 2"), LOGREG, Y)


@query()
def tuning(r):
    return ML.tune(transfer_frames(r), CONFIGS, Y)


@query(f"""SELECT config, mean_auroc, config = (SELECT max_by(config, (mean_auroc, config)) FROM tuned) AS selected FROM tuned""", ["mean_auroc"])
def tuning_one_feature(r):
    return ML.tune(transfer_frames(r, 1), CONFIGS, Y)


# --- flagship -------------------------------------------------------------------------------------------------
def onset_share_by_region(r: Roles) -> DataFrame:
    """Events to cohort to hourly score to onset after the prediction hour to share per region."""
    s = study(r)
    onset = s.onsets()["sofa_dysfunction"].where(F.col("onset_hours") <= config.HORIZON_HOURS)
    places = r.customer.join(r.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        r.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("c_custkey").alias("stay_id"), F.col("r_name").alias("region"))
    flagged = K.with_hit(s.cohort.select("stay_id"), onset, "_hit").join(places, "stay_id")
    return flagged.groupBy("region").agg(F.count(F.lit(1)).alias("n_stays"), F.avg("_hit").alias("onset_share"))


QUERIES["onset_share_by_region"] = Query(onset_share_by_region, Q.check(
    """SELECT r.r_name AS region, count(*) AS n_stays, avg(CASE WHEN o.stay_id IS NOT NULL THEN 1e0 ELSE 0e0 END) AS onset_share
    FROM cohort c JOIN customer u ON u.c_custkey = c.stay_id JOIN nation n ON n.n_nationkey = u.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
    LEFT JOIN (SELECT stay_id FROM on_sofa WHERE onset_hours <= 48) o ON o.stay_id = c.stay_id GROUP BY 1""", ["onset_share"]))
