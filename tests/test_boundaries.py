"""Hand-made rows for the rules that are easy to get wrong by one."""

import datetime as dt

import pytest
from conftest import as_dict
from pyspark.sql import functions as F

from tidemark.functions import columns as X
from tidemark.operators import cohort as K
from tidemark.operators import concepts as C
from tidemark.operators import features as FE
from tidemark.operators import inference as I
from tidemark.operators import labels as L
from tidemark.operators import offset_concepts as O
from tidemark.operators import scores as S

T0 = dt.datetime(2020, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def test_rolling_window_is_open_left(points):
    staged = S.creatinine_stage(points((1, 0.0, 1.0), (1, 48.0, 1.4)))
    assert as_dict(staged, "hours", "min_48h") == {0.0: 1.0, 48.0: 1.4}


def test_creatinine_stages(points):
    rise = as_dict(S.creatinine_stage(points((1, 0.0, 1.0), (1, 10.0, 1.31))), "hours", "stage")
    assert rise == {0.0: 0, 10.0: 1}
    assert as_dict(S.creatinine_stage(points((1, 0.0, 4.0))), "hours", "stage") == {0.0: 3}
    ratio = as_dict(S.creatinine_stage(points((1, -24.0, 1.0), (1, 1.0, 2.0), (1, 2.0, 3.0))), "hours", "stage")
    assert ratio == {-24.0: 0, 1.0: 2, 2.0: 3}


def test_creatinine_keeps_every_row_and_first_of_stay(points):
    rows = points((1, -5.0, 0.5), (1, 1.0, 1.0), (1, 1.0, 1.2), (1, 2.0, 1.6), (2, -3.0, 1.0))
    staged = S.creatinine_stage(rows, "first_of_stay")
    assert staged.count() == 5
    assert as_dict(staged.where("stay_id = 1"), "hours", "base_7d")[2.0] == 1.0
    assert staged.where("stay_id = 2").head()["base_7d"] is None


def test_urine_anchor_and_density(points, frame):
    weight = frame("stay_id long, weight_kg double", (1, 70.0), (2, 70.0))
    rows = points((1, 0.0, 10.0), (1, 3.0, 10.0), (1, 6.0, 10.0), (1, 9.0, 10.0), (2, 0.0, 10.0), (2, 6.0, 10.0))
    staged = S.urine_output_stage(rows, weight)
    rates = {(r.stay_id, r.hours): r.rate_6h for r in staged.collect()}
    assert rates[1, 6.0] == pytest.approx(20 / 6 / 70)
    assert rates[1, 9.0] == pytest.approx(20 / 6 / 70)
    assert rates[2, 6.0] is None  # one entry in six hours is too sparse
    assert rates[1, 3.0] is None and staged.where("hours = 3").head()["stage"] is None


def test_asof_tolerance(points):
    pao2 = points((1, 4.0, 84.0), (1, 4.01, 84.0), (1, -1.0, 84.0))
    out = as_dict(S.pf_ratio_events(pao2, points((1, 0.0, 40.0))), "hours", "value")
    assert out[4.0] == pytest.approx(84 / 0.4)
    assert out[4.01] == pytest.approx(84 / 0.21)
    assert out[-1.0] == pytest.approx(84 / 0.21)


def test_pair_window_is_asymmetric(frame):
    abx = frame("stay_id long, hours double", (1, 0.0), (2, 0.0), (3, 72.0), (4, 72.01), (5, 5.0))
    cul = frame("stay_id long, hours double", (1, 24.0), (2, 24.01), (3, 0.0), (4, 0.0), (5, 5.0))
    pairs = L.suspicion_of_infection(abx, cul)
    assert as_dict(pairs, "stay_id", "order") == {1: "abx_first", 3: "culture_first", 5: "abx_first"}
    times = L.suspicion_times(abx, cul)
    assert sorted((r.stay_id, r.suspicion_hours) for r in times.collect()) == [(1, 0.0), (3, 0.0), (5, 5.0)]


def sofa_frame(frame, *totals, stay=1):
    return frame("stay_id long, hour int, sofa_total int", *[(stay, h, t) for h, t in enumerate(totals)])


def test_onset_is_strictly_after_the_prediction_hour(frame):
    sofa = sofa_frame(frame, 0, 0, 0, 0, 0, 0, 0, 2, 3)
    assert L.organ_dysfunction_onset(sofa).head()["onset_hours"] == 7.0
    early = sofa_frame(frame, 0, 0, 0, 0, 0, 0, 2, 4)  # at hour 6 the rise is part of the baseline
    assert L.organ_dysfunction_onset(early).head()["onset_hours"] == 7.0
    assert L.organ_dysfunction_onset(early, baseline_rule="zero").head()["baseline_sofa"] == 0


def test_label_interval(frame):
    cohort = frame("stay_id long, epoch string", (1, "a"), (2, "a"), (3, "a"), (4, "a"), (5, "a"))
    onsets = frame("stay_id long, onset_hours double", (1, 6.0), (2, 6.01), (3, 48.0), (4, 48.01))
    assert as_dict(L.label_table(cohort, {"x": onsets}), "stay_id", "x") == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0}


def test_sepsis_onset_needs_dysfunction_in_the_window(frame):
    sofa = sofa_frame(frame, *([0] * 7 + [2] * 3 + [0] * 60))
    near = frame("stay_id long, suspicion_hours double", (1, 8.5))
    assert L.sepsis3_onset(sofa, near).head()["onset_hours"] == 8.5
    far = frame("stay_id long, suspicion_hours double", (1, 58.0))
    assert L.sepsis3_onset(sofa, far).count() == 0
    edge = frame("stay_id long, suspicion_hours double", (1, 57.0))
    assert L.sepsis3_onset(sofa, edge).head()["onset_hours"] == 57.0


def test_missing_component_is_not_zero(frame):
    events = frame("stay_id long, concept string, hours double, value double", (1, "platelets", 0.5, 90.0))
    stays = frame("stay_id long, max_hours double", (1, 1.2))
    rows = {r.hour: r for r in S.hourly_sofa(events, stays).collect()}
    assert sorted(rows) == [0, 1, 2]
    assert rows[0].sofa_coag == 2 and rows[0].sofa_total == 2 and rows[0].sofa_components_missing == 5
    assert rows[2].sofa_coag == 2 and rows[0].sofa_liver is None


def test_urine_total_needs_a_full_day_and_six_charted_hours(frame):
    stays = frame("stay_id long, max_hours double", (1, 30.0), (2, 30.0))
    rows = [(1, "urine", float(h), 10.0) for h in range(0, 24, 4)] + [(2, "urine", float(h), 10.0) for h in range(0, 20, 4)]
    sofa = S.hourly_sofa(frame("stay_id long, concept string, hours double, value double", *rows), stays)
    known = sofa.where(F.col("urine_24h").isNotNull()).groupBy("stay_id").agg(F.min("hour").alias("h"))
    assert as_dict(known, "stay_id", "h") == {1: 23}


def test_null_infusion_rate_leaves_the_circulation_to_the_pressure(frame):
    stays = frame("stay_id long, max_hours double", (1, 0.0))
    pressors = frame("stay_id long, drug string, hours double, rate double", (1, "dopamine", 0.0, None))
    nothing = frame("stay_id long, hours double, value double")
    measured = frame("stay_id long, concept string, hours double, value double", (1, "map", 0.0, 60.0))
    events = S.score_events(measured, nothing, nothing.select("stay_id", "hours"), nothing, pressors)
    assert S.hourly_sofa(events, stays).head()["sofa_cardio"] == 1


def test_rate_units(frame):
    df = frame("rate double, unit string, w double", (1.0, "mg/min", 80.0), (1.0, "MCG/KG/HR", None), (1.0, "mcg/min", 0.0), (1.0, "units", 80.0))
    got = [r[0] for r in df.select(X.rate_mcg_kg_min("rate", "unit", "w")).collect()]
    assert got == [12.5, 1 / 60, None, None]


def test_age_ceiling(frame):
    df = frame("age string", ("> 89",), ("45",), ("",))
    assert [r[0] for r in df.select(X.age_years("age", "> 89", 90)).collect()] == [90, 45, None]


def test_interval_explode(frame):
    df = frame("stay_id long, a double, b double", (1, 2.7, 4.1), (2, 5.0, 3.0), (3, -4.0, 0.5))
    out = C.explode_hours(df, "a", "b", 96).groupBy("stay_id").agg(F.sort_array(F.collect_list("hours")).alias("h"))
    assert as_dict(out, "stay_id", "h") == {1: [2.0, 3.0, 4.0, 5.0], 3: [0.0, 1.0]}


def test_fio2_cleaning(frame):
    df = frame("v double", (40.0,), (0.5,), (1.5,), (0.1,), (20.0,))
    assert [r[0] for r in df.select(X.inspired_fraction("v")).collect()] == [0.4, 0.5, None, None, 0.2]


def test_null_text_never_passes_an_exclusion(frame):
    df = frame("spec_type_desc string", ("Urine",), ("MRSA screen",), (None,), ("staph aureus swab",))
    assert [r[0] for r in df.where(C.culture_filter("no_surveillance")).collect()] == ["Urine"]


def test_unknown_route_stays_in(frame):
    df = frame("drug string, route string", ("Vancomycin", None), ("Vancomycin", "ou"), ("aspirin", "IV"), ("CEFEPIME", "PO"))
    assert [tuple(r) for r in df.where(C.is_antibiotic()).collect()] == [("Vancomycin", None), ("CEFEPIME", "PO")]


def test_norepinephrine_comes_before_epinephrine(frame):
    cohort = frame("stay_id long", (1,))
    rows = frame("patientunitstayid long, drugname string, infusionoffset string", (1, "Norepinephrine", "60"), (1, "epinephrine", "60"), (1, "dopamine", "x"))
    assert sorted(r.drug for r in O.vasopressor_rates(rows, cohort).collect()) == ["epinephrine", "norepinephrine"]


def test_rank_comes_before_the_filters(frame):
    stays = frame("subject_id long, hadm_id long, stay_id long, intime timestamp, outtime timestamp, los double",
                  (1, 10, 100, at(0), at(5), 0.2), (1, 11, 101, at(48), at(99), 3.0), (2, 12, 102, at(0), at(50), 2.0))
    patients = frame("subject_id long, gender string, anchor_age int, anchor_year int, anchor_year_group string", (1, "F", 40, 2020, "a"), (2, "M", 17, 2019, "a"))
    admissions = frame("hadm_id long, admittime timestamp", (10, at(0)), (11, at(48)), (12, at(0)))
    cohort = K.build_cohort(stays, patients, admissions)
    assert [(r.subject_id, r.age) for r in cohort.collect()] == [(2, 18)]  # the short first stay of patient 1 is not replaced
    assert [r.n for r in K.attrition(stays, cohort).orderBy("step_no").collect()] == [3, 2, 2, 1, 1]


def test_weight_first_or_first_plausible(frame):
    cohort = frame("stay_id long, gender string, intime timestamp", (1, "F", T0), (2, "F", T0), (3, "M", T0))
    chart = frame("stay_id long, itemid int, charttime timestamp, valuenum double",
                  (1, 226512, at(1), 5.0), (1, 226512, at(2), 60.0), (2, 226531, at(1), 200.0), (2, 226512, at(60), 1.0))
    default = {r.stay_id: (r.weight_kg, r.weight_imputed) for r in C.weights(chart, cohort).collect()}
    pounds = 200 * 0.45359237
    assert default[2] == (pytest.approx(pounds), False) and default[1] == (pytest.approx(pounds), True)
    assert default[3] == (None, True)
    assert as_dict(C.weights(chart, cohort, first_plausible=True), "stay_id", "weight_kg")[1] == 60.0


def test_tabular_uses_hourly_bins_and_no_filled_values(frame):
    events = frame("stay_id long, variable string, hours double, value double", (1, "a", 0.1, 1.0), (1, "a", 0.9, 3.0), (1, "a", 2.0, 8.0), (1, "a", 3.0, 99.0))
    panel = FE.hourly_panel(events, frame("stay_id long", (1,), (2,)), ["a"], 3)
    assert panel.count() == 6
    row = FE.tabular_view(panel, ["a"]).where("stay_id = 1").head()
    assert (row.a__min, row.a__max, row.a__mean, row.a__first, row.a__last) == (2.0, 8.0, 5.0, 2.0, 8.0)
    assert as_dict(FE.sequence_view(panel, ["a"]), "stay_id", "sequence") == {1: [[2.0], [2.0], [8.0]], 2: [[None], [None], [None]]}


def test_leak_assertion(frame):
    FE.assert_no_future_leakage(frame("variable string, hours double", ("a", 5.99)), 6)
    with pytest.raises(AssertionError):
        FE.assert_no_future_leakage(frame("variable string, hours double", ("a", 6.0)), 6)


def test_preprocessor_of_an_empty_column_and_of_infinities(frame):
    rows = frame("stay_id long, x array<double>", (1, [None, 1.0]), (2, [None, float("inf")]), (3, [None, 3.0]))
    stats = {r.pos: (r.median, r.mean, r.sd) for r in FE.fit_preprocessor(rows, "x").collect()}
    assert stats[0] == (0.0, 0.0, 1.0)
    assert stats[1] == (2.0, 2.0, pytest.approx((2 / 3) ** 0.5))
    scaled = as_dict(FE.apply_preprocessor(rows, FE.fit_preprocessor(rows, "x"), "x"), "stay_id", "x")
    assert scaled[2] == [0.0, 0.0]


def test_holm(frame):
    out = I.holm(frame("k string, p_raw double", ("a", 0.01), ("b", 0.04), ("c", 0.03)), "k")
    assert as_dict(out, "k", "p_holm") == {"a": pytest.approx(0.03), "b": pytest.approx(0.06), "c": pytest.approx(0.06)}


@pytest.mark.parametrize("point, ci95, ci90, agree, expected", [
    (0.02, (0.01, 0.03), (0.012, 0.028), True, "meaningful drift asymmetry"),
    (-0.02, (-0.03, -0.01), (-0.028, -0.012), True, "meaningful asymmetry in the opposite direction"),
    (0.02, (0.01, 0.03), (0.012, 0.028), False, "inconclusive"),
    (0.004, (0.001, 0.007), (0.002, 0.006), True, "distinguishable but trivial"),
    (0.001, (-0.006, 0.008), (-0.005, 0.007), True, "practically equivalent"),
    (0.001, (-0.02, 0.03), (-0.015, 0.02), True, "inconclusive"),
])
def test_verdicts(frame, point, ci95, ci90, agree, expected):
    df = frame("point double, ci95_lo double, ci95_hi double, ci90_lo double, ci90_hi double, all_agree boolean", (point, *ci95, *ci90, agree))
    assert df.select(I.verdict()).head()[0] == expected


def test_unknown_options_are_refused(frame, points):
    with pytest.raises(ValueError):
        S.creatinine_stage(points(), "mean")
    with pytest.raises(ValueError):
        C.culture_filter("all")
    with pytest.raises(ValueError):
        L.baseline_sofa(frame("stay_id long, hour int, sofa_total int"), rule="median")
    with pytest.raises(ValueError):
        L.first_onset(points())


def test_empty_inputs_give_empty_results(points, frame):
    nothing = points()
    assert S.creatinine_stage(nothing).count() == 0
    assert S.pf_ratio_events(nothing, nothing).count() == 0
    times = frame("stay_id long, hours double")
    assert L.suspicion_of_infection(times, times).count() == 0
    assert L.suspicion_times(times, times).count() == 0


def test_hour_grid_of_the_score_is_spread_over_tasks(spark, frame, monkeypatch):
    monkeypatch.setattr(S, "HOURS_PER_TASK", 5_000, raising=False)
    stays = spark.range(300).selectExpr("id AS stay_id", "199.5D AS max_hours").coalesce(1)
    events = frame("stay_id long, concept string, hours double, value double",
                   (1, "platelets", -3.0, 10.0), (1, "platelets", 7.5, 40.0), (1, "platelets", 300.0, 10.0), (999, "platelets", 1.0, 10.0))
    sofa = S.hourly_sofa(events, stays)
    tasks = sofa.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in tasks) == 300 * 201 and max(r["count"] for r in tasks) <= 3 * 5_000
    one = {r.hour: r.platelets for r in sofa.where("stay_id = 1").collect()}
    assert sorted(one) == list(range(201)) and {h for h, v in one.items() if v == 40.0} == set(range(7, 31))
    assert all(v is None for h, v in one.items() if not 7 <= h < 31)
