"""The studies end to end: label study on the timestamp clock, site study on the offset clock,
and the transfer comparison on a labelled matrix.

Steps are lazy frames, but for the few shared ones that are written to the shared folder when
first used.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.columns import hash_fold, join_groups
from tidemark.operators import cohort as K
from tidemark.operators import concepts as C
from tidemark.operators import features as X
from tidemark.operators import inference as I
from tidemark.operators import labels as L
from tidemark.operators import metrics as M
from tidemark.operators import offset_concepts as O
from tidemark.operators import scores as S
from tidemark.session import cut_lineage


@dataclass(frozen=True)
class Rules:
    """Label and feature rules of a study."""

    prediction_hour: float = config.PREDICTION_HOUR
    horizon: float = config.HORIZON_HOURS
    max_hours: float = config.MAX_HOURS
    increase: int = 2
    baseline_rule: str = "at_prediction"
    prevalence_rule: str = "none"
    onset_rule: str = "later_of_both"
    culture_variant: str = "no_surveillance"
    systemic_only: bool = False
    creatinine_baseline: str = "rolling_min_7d"
    min_stage: int = 1
    window_hours: int = config.WINDOW_HOURS
    aggregations: Sequence[str] = tuple(config.AGGREGATIONS)


class _Study:
    """Shared part: score, onsets, common cohort, labels, matrix, from the extracted frames."""

    rules: Rules
    group: str

    # Subclasses provide: cohort, stays, weight, creatinine, urine, score_inputs, antibiotics,
    # cultures, feature_events, static, and the grouping column of the common cohort.

    # Frames that several steps read are written to the shared folder once.  All of them are one row per
    # stay, per stay and hour, or the few rows of the concepts in use, far smaller than the tables they come from.

    @cached_property
    def sofa(self) -> DataFrame:
        """All columns of the hourly score."""
        return S.hourly_sofa(self.score_inputs, self.stays)

    @cached_property
    def totals(self) -> DataFrame:
        """What onsets and prevalent cases need of the score."""
        return cut_lineage(self.sofa.select("stay_id", "hour", "sofa_total"))

    @cached_property
    def suspicion(self) -> DataFrame:
        return cut_lineage(L.suspicion_times(self.antibiotics, self.cultures))

    @cached_property
    def creatinine_onset(self) -> DataFrame:
        staged = S.creatinine_stage(self.creatinine, self.rules.creatinine_baseline, per_tick=True)
        return cut_lineage(L.first_onset(staged, self.rules.min_stage))

    @cached_property
    def urine_onset(self) -> DataFrame:
        return cut_lineage(L.first_onset(S.urine_output_stage(self.urine, self.weight), self.rules.min_stage))

    def onsets(self, baseline_rule: str | None = None) -> dict[str, DataFrame]:
        r, rule = self.rules, baseline_rule or self.rules.baseline_rule
        return {
            "aki_creatinine": self.creatinine_onset,
            "sofa_dysfunction": L.organ_dysfunction_onset(self.totals, r.prediction_hour, r.increase, rule),
            "aki_urine": self.urine_onset,
            "sepsis3": L.sepsis3_onset(self.totals, self.suspicion, r.prediction_hour, r.increase,
                                       onset_rule=r.onset_rule, baseline_rule=rule),
        }

    def prevalent(self, rule: str | None = None) -> dict[str, DataFrame]:
        """Prevalent cases at the prediction hour: early onsets for the kidney labels, the chosen
        rule for the two rise-based ones."""
        r, rule = self.rules, rule or self.rules.prevalence_rule
        kidney = {
            "aki_creatinine": L.prevalent_from_onsets(self.creatinine_onset, r.prediction_hour),
            "aki_urine": L.prevalent_from_onsets(self.urine_onset, r.prediction_hour),
        }
        if rule == "none":  # no rise-based prevalent case, so the score is not needed
            nobody = L.no_stays(self.cohort)
            return {**kidney, "sofa_dysfunction": nobody, "sepsis3": nobody}
        return {
            **kidney,
            "sofa_dysfunction": L.prevalent_dysfunction(self.totals, r.prediction_hour, r.increase, rule),
            "sepsis3": L.prevalent_sepsis3(self.totals, self.suspicion, r.prediction_hour, r.increase, rule=rule),
        }

    @cached_property
    def common(self) -> tuple[DataFrame, DataFrame]:
        kept, lost = K.common_cohort(self.cohort, self.prevalent(), self.group)
        return cut_lineage(kept), lost

    @cached_property
    def labelled(self) -> DataFrame:
        return L.label_table(self.common[0], self.onsets(), self.rules.prediction_hour, self.rules.horizon)

    @cached_property
    def variables(self) -> list[str]:
        return [*config.VITALS, *config.LABS, *config.DERIVED]

    @cached_property
    def events_of_common(self) -> DataFrame:
        return only_stays(self.feature_events, self.common[0])

    @cached_property
    def panel(self) -> DataFrame:
        return X.hourly_panel(self.feature_events, self.common[0], self.variables, self.rules.window_hours)

    def matrix(self, category_levels: dict[str, list[str]] | None = None) -> tuple[DataFrame, X.MatrixNames]:
        if self.rules.window_hours != self.rules.prediction_hour:
            raise ValueError("the feature window has to end at the prediction hour")
        return X.build_matrix(self.panel, self.static, self.variables, self.rules.aggregations,
                              category_levels=category_levels)

    def dataset(self, n_folds: int = config.N_FOLDS, seed: int = 0) -> tuple[DataFrame, X.MatrixNames]:
        """Matrix, labels, group and fold per stay of the common cohort, checked for late events."""
        X.assert_no_future_leakage(self.events_of_common, self.rules.window_hours)
        matrix, names = self.matrix()
        rows = matrix.join(self.labelled, "stay_id").withColumn("fold", hash_fold("stay_id", n_folds, seed))
        return rows, names


def only_stays(events: DataFrame, stays: DataFrame) -> DataFrame:
    return events.join(stays.select("stay_id"), "stay_id", "left_semi")


class LabelStudy(_Study):
    """Cohort, labels and features from tables with timestamps.

    `tables` holds icustays, patients, admissions, labevents, chartevents, outputevents, inputevents,
    prescriptions and microbiologyevents.
    """

    group = "epoch"

    def __init__(self, tables, rules: Rules = Rules()):
        self.t, self.rules = tables, rules

    @cached_property
    def cohort(self) -> DataFrame:
        return cut_lineage(K.build_cohort(self.t.icustays, self.t.patients, self.t.admissions))

    @cached_property
    def stays(self) -> DataFrame:
        return K.stay_windows(self.cohort, self.rules.max_hours)

    @cached_property
    def chart_rows(self) -> DataFrame:
        """The one scan of the chart table."""
        return C.route_charts(self.t.chartevents, self.cohort, max(self.rules.max_hours, self.rules.window_hours))

    def charted(self, family: str) -> DataFrame:
        return C.family_of(self.chart_rows, family)

    @cached_property
    def weight(self) -> DataFrame:
        return cut_lineage(C.weights(self.charted("weight"), self.cohort))

    @cached_property
    def labs(self) -> DataFrame:
        names = ["creatinine", "platelets", "bilirubin_total", "pao2"]
        return cut_lineage(C.lab(self.t.labevents, self.cohort, names, self.rules.max_hours))

    @cached_property
    def charts(self) -> DataFrame:
        return C.chart(self.charted("chart"), self.cohort, ["fio2", "map"], self.rules.max_hours)

    @cached_property
    def creatinine(self) -> DataFrame:
        return C.one_concept(self.labs, "creatinine")

    @cached_property
    def urine(self) -> DataFrame:
        return cut_lineage(C.urine_output(self.t.outputevents, self.cohort, self.rules.max_hours))

    @cached_property
    def pressors(self) -> DataFrame:
        return C.vasopressor_rates(self.t.inputevents, self.cohort, self.weight, self.rules.max_hours)

    @cached_property
    def score_inputs(self) -> DataFrame:
        hours = self.rules.max_hours
        return S.score_events(
            self.labs.unionByName(self.charts), C.gcs_total(self.charted("gcs"), self.cohort, hours),
            C.ventilated_hours(self.charted("ventilation"), self.cohort, hours), self.urine, self.pressors,
        )

    @cached_property
    def antibiotics(self) -> DataFrame:
        return C.antibiotic_times(self.t.prescriptions, self.cohort, max_hours=self.rules.max_hours,
                                  systemic_only=self.rules.systemic_only)

    @cached_property
    def cultures(self) -> DataFrame:
        return C.culture_times(self.t.microbiologyevents, self.cohort, max_hours=self.rules.max_hours,
                               variant=self.rules.culture_variant)

    @cached_property
    def feature_events(self) -> DataFrame:
        return X.feature_events(self.t.labevents, self.charted("chart"), self.t.outputevents, self.cohort, self.weight,
                                self.rules.window_hours, self.charted("gcs"))

    @cached_property
    def static(self) -> DataFrame:
        return X.static_frame(self.cohort)


class SiteStudy(_Study):
    """The same labels and features along the site axis, from tables with minute offsets.

    `tables` holds o_patient, o_hospital, o_lab, o_treatment, o_periodic, o_aperiodic, o_nurse,
    o_intake, o_infusion and o_respiratory.  Only stays of sites that pass the quality rule remain.
    """

    group = "hospitalid"

    def __init__(self, tables, rules: Rules = Rules(), min_stays: int = config.MIN_STAYS_PER_SITE,
                 min_creatinine: float = config.MIN_CREATININE_COVERAGE, min_culture: float = config.MIN_CULTURE_RATE):
        self.t, self.rules = tables, rules
        self.limits = (min_stays, min_creatinine, min_culture)

    @cached_property
    def everyone(self) -> DataFrame:
        return K.build_site_cohort(self.t.o_patient, self.t.o_hospital)

    @cached_property
    def sites(self) -> DataFrame:
        return K.site_quality(self.everyone, self.t.o_lab, self.t.o_treatment, *self.limits)

    @cached_property
    def cohort(self) -> DataFrame:
        return cut_lineage(K.keep_included(self.everyone, self.sites))

    @cached_property
    def stays(self) -> DataFrame:
        los = self.cohort.withColumn("los_hours", F.col("unitdischargeoffset") / F.lit(60.0))
        return K.stay_windows(los, self.rules.max_hours)

    @cached_property
    def weight(self) -> DataFrame:
        return cut_lineage(O.weights(self.cohort))

    @cached_property
    def labs(self) -> DataFrame:
        names = ["creatinine", "platelets", "bilirubin_total", "pao2"]
        return cut_lineage(O.lab(self.t.o_lab, self.cohort, names, self.rules.max_hours))

    @cached_property
    def creatinine(self) -> DataFrame:
        return C.one_concept(self.labs, "creatinine")

    @cached_property
    def urine(self) -> DataFrame:
        return cut_lineage(O.urine_output(self.t.o_intake, self.cohort, self.rules.max_hours))

    @cached_property
    def score_inputs(self) -> DataFrame:
        hours = self.rules.max_hours
        pressure = O.vital(self.t.o_periodic, self.t.o_aperiodic, self.cohort, ["map"], hours)
        return S.score_events(
            self.labs.unionByName(pressure), O.gcs_total(self.t.o_nurse, self.cohort, hours),
            O.ventilated_hours(self.t.o_respiratory, self.cohort, hours), self.urine,
            O.vasopressor_rates(self.t.o_infusion, self.cohort, hours),
        )

    @cached_property
    def antibiotics(self) -> DataFrame:
        return O.antibiotic_times(self.t.o_treatment, self.cohort, self.rules.max_hours)

    @cached_property
    def cultures(self) -> DataFrame:
        return O.culture_times(self.t.o_treatment, self.cohort, self.rules.max_hours)

    @cached_property
    def feature_events(self) -> DataFrame:
        w = self.rules.window_hours
        vitals = O.vital(self.t.o_periodic, self.t.o_aperiodic, self.cohort, None, w).withColumnRenamed("concept", "variable")
        labs = O.lab(self.t.o_lab, self.cohort, None, w).withColumnRenamed("concept", "variable")
        gcs = O.gcs_total(self.t.o_nurse, self.cohort, w).withColumn("variable", F.lit("gcs_total"))
        urine = X.urine_rate(self.urine, self.weight)
        out = vitals
        for part in (labs, gcs, urine):
            out = out.unionByName(part.select(*out.columns))
        return out.where(F.col("hours") < w)

    @cached_property
    def static(self) -> DataFrame:
        return X.static_frame(self.cohort, "unitadmitsource")

    def prevalence_by(self, key: str) -> DataFrame:
        """Label prevalence per region or site of the common cohort; stays without a region count as 'Unknown'."""
        place = self.cohort.select("stay_id", F.coalesce("region", F.lit("Unknown")).alias("region"))
        return M.prevalence(self.labelled.join(place, "stay_id"), config.LABELS, [key])


# --- transfer comparison -----------------------------------------------------------
def estimate_contrasts(
    pred: DataFrame,
    contrasts: Sequence[tuple[str, str, str]],
    n_boot: int = config.N_BOOT,
    seed: int = 0,
    method: str = "poisson",
    sesoi: float = config.SESOI,
    alpha: float = config.ALPHA,
    family: int | None = None,
    level: str | None = None,
) -> DataFrame:
    """One row per contrast: point, intervals, p, Holm, variance parts, sign agreement, verdict."""
    wanted = sorted({x for _, a, b in contrasts for x in (a, b)})
    # One row per replicate and cell, read by every contrast.
    gaps = cut_lineage(I.replicate_gaps(I.replicate_auroc(pred.where(F.col("label").isin(wanted)), n_boot, seed, method, level=level)))
    cells = M.gap_scales(_cell_aurocs(pred.where(F.col("label").isin(wanted))))
    one = F.lit(1)
    out = None
    for name, a, b in contrasts:
        draws = I.bootstrap_draws(gaps, a, b, n_boot, seed)
        summary = I.summarise_draws(draws, "draw_both")
        parts = I.decompose(draws).drop("se_both")
        point = I.point_estimate(gaps, a, b)
        signs = M.sign_agreement(cells, a, b).select("all_agree")
        row = summary.withColumn("_k", one)
        for extra in (parts, point, signs):
            row = row.join(extra.withColumn("_k", one), "_k")
        row = row.drop("_k").withColumn("contrast", F.lit(name))
        out = row if out is None else out.unionByName(row)
    judged = I.holm(out, "contrast", alpha=alpha, family=family)
    return judged.withColumn("verdict", I.verdict(sesoi=sesoi))


def _cell_aurocs(pred: DataFrame) -> DataFrame:
    def of(kind: str):
        return F.max(F.when(F.col("kind") == kind, F.col("auroc"))).alias(f"auroc_{kind}")

    per_kind = M.auroc(pred, ["label", "model", "seed", "kind"])
    return per_kind.groupBy("label", "model", "seed").agg(of("transferred"), of("oracle"))


def pooled_estimate(draws: DataFrame, points: DataFrame, sizes: DataFrame, part: str = "part", sesoi: float = config.SESOI) -> DataFrame:
    """Size-weighted pool of disjoint parts: draws (part, rep, draw), points (part, point), sizes (part, weight)."""
    pooled = I.summarise_draws(I.pool_disjoint(draws, sizes, part))
    point = join_groups(points, sizes, [part]).agg(M.weighted_mean("point", "weight").alias("point")).scalar()
    return pooled.withColumn("point", point).withColumn("verdict", I.verdict(signs_agree=F.lit(True), sesoi=sesoi))


def tables_of(frames: Mapping[str, DataFrame]):
    """Attribute access to a dict of frames, as the studies expect."""
    return type("Tables", (), dict(frames))()
