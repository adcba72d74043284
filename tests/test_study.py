"""The studies and a few registered queries end to end on the smallest data."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark import config
from tidemark.operators import concepts as C
from tidemark.operators import models as ML
from tidemark.operators import reports as R
from tidemark.plans.registry import QUERIES, study
from tidemark.plans.roles import Roles
from tidemark.plans.study import LabelStudy, Rules, estimate_contrasts, pooled_estimate

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not here")


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {n for n in entry.QUERIES if n not in entry.oracle_sql()} == {"transfer_gap_logreg", "transfer_gap_gbt", "learning_curve", "tuning"}


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(0 <= r.onset_share <= 1 for r in rows)


@pytest.mark.parametrize("name", ["first_order_cohort", "gap_aware_rate", "suspicion_times", "matched_sample", "auroc", "negative_marker_audit"])
def test_query_equals_its_check(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    expected = sorted(map(repr, cursor.fetchall()))
    got = sorted(repr(tuple(r)) for r in QUERIES[name](spark, FOLDER).select(*columns).collect())
    assert got == expected


def test_dataset_is_aligned_and_leak_free(spark):
    s = study(Roles(spark, FOLDER))
    rows, names = s.dataset()
    rows = rows.persist()
    assert rows.count() == s.common[0].count() > 0
    sizes = rows.select(F.size("tabular"), F.size("sequence"), F.size("static")).distinct().collect()
    assert [tuple(r) for r in sizes] == [(len(names.tabular), 6, len(names.static))]
    assert len(names.tabular) == 21 * 5 + len(names.static)
    rows.unpersist()


def test_window_has_to_end_at_the_prediction_hour(spark):
    with pytest.raises(ValueError):
        LabelStudy(Roles(spark, FOLDER), Rules(window_hours=4)).matrix({})


def test_estimates_and_tables(spark):
    pred = Roles(spark, FOLDER).pred
    est = estimate_contrasts(pred, [("d", "toxic", "quality")], n_boot=20, method="multinomial")
    row = est.head()
    assert row.ci95_lo <= row.ci90_lo <= row.ci90_hi <= row.ci95_hi and row.p_holm == row.p_raw
    table = R.estimate_table(est, ["contrast"])
    assert table.columns == ["contrast", "point", "ci95_lo", "ci95_hi", "delta_min", "p_holm", "verdict"]
    regions = spark.createDataFrame([("North", 3), ("South", 4)], "region string, n_sites int")
    rows = spark.createDataFrame([("cv", "pooled"), ("loro", "South")], "design string, split string")
    assert {r.split: r.n_sites for r in R.site_table(rows, regions).collect()} == {"pooled": 7, "South": 4}


def test_pooled_estimate(spark):
    draws = spark.createDataFrame([(p, r, r / 1000 + (0.01 if p == "a" else 0.03)) for p in "ab" for r in range(1, 21)], "part string, rep int, draw double")
    points = spark.createDataFrame([("a", 0.01), ("b", 0.03)], "part string, point double")
    sizes = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "part string, weight double")
    assert pooled_estimate(draws, points, sizes).head()["point"] == pytest.approx(0.025)


def test_transfer_carries_the_cluster_and_scores_every_row(spark):
    rows = spark.range(240).selectExpr("id AS stay_id", "CAST(id % 3 = 0 OR id % 7 = 0 AS INT) AS y",
                                       "array(CAST(id % 3 AS DOUBLE), CAST(id % 7 AS DOUBLE), CAST(null AS DOUBLE)) AS features", "id % 4 AS site", "id % 2 AS era")
    data = ML.with_folds(rows, 3)
    spec = ML.Spec("logreg", {"C": 1.0, "max_iter": 30})
    train, test = data.where("era = 0").drop("site", "era", "fold"), data.where("era = 1").drop("era")
    pred = ML.run_transfer(train, test, spec, "y", n_folds=3)
    assert {(r.kind, r["count"]) for r in pred.groupBy("kind").count().collect()} == {("transferred", 120), ("oracle", 120)}
    assert "site" in pred.columns
    result = ML.transfer_result(pred).head()
    assert result.auroc_transferred > 0.6 and result.gap == pytest.approx(result.auroc_oracle - result.auroc_transferred)
    info = ML.training_summary(train, test, "event_matched", 3).head()
    assert info.n_test == 120 and info.n_train_used <= 80


def test_one_chart_scan_serves_every_extractor(spark, frame):
    gcs, vent = list(config.GCS_PART_ITEMS.values()), config.VENTILATION_ITEMS[0]
    rate, kilo = config.CHART_CONCEPTS["heart_rate"]["itemids"][0], config.CHART_CONCEPTS["weight_kg"]["itemids"][0]
    start = datetime(2020, 1, 1)
    rows = [(s, item, start + timedelta(hours=h), v, "x") for s in (1, 2, 3) for h, item, v in
            [(-5, kilo, 70.0), (1, rate, 80.0), (2, rate, None), (3, vent, None), (200, rate, 90.0), *[(4, i, 3.0) for i in gcs], (1, -1, 5.0)]]
    charts = frame("stay_id int, itemid int, charttime timestamp, valuenum double, value string", *rows)
    cohort = frame("stay_id int, intime timestamp, gender string", (1, start, "F"), (2, start, "M"))
    routed = C.route_charts(charts, cohort, 96.0)
    assert routed.where("itemid = -1 or stay_id = 3").isEmpty()
    plain = lambda df: sorted(map(tuple, df.collect()))
    for family, extract in (("chart", C.chart), ("gcs", C.gcs_total), ("ventilation", C.ventilated_hours), ("weight", C.weights)):
        part = C.family_of(routed, family)
        assert plain(extract(part, cohort)) == plain(extract(charts, cohort)) != []
        plan = str(part._jdf.queryExecution().executedPlan())
        assert "PartitionFilters: [isnotnull(family" in plan


def test_lines_and_orders_are_joined_once_for_the_site_study(spark):
    from tidemark.plans.registry import sites
    from tidemark.plans.roles import Roles

    folder = "/root/testdata/sf0.001"
    r, plain = Roles(spark, folder), Roles(spark, folder)
    sites(r)
    for name in ("o_lab", "o_nurse", "o_respiratory"):
        assert "Join" not in getattr(r, name)._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(str, getattr(r, name).collect())) == sorted(map(str, getattr(plain, name).collect()))


def test_tasks_of_a_study_read_small_splits_and_sort_nothing_to_write_parts(spark):
    from tidemark.plans.registry import Query
    from tidemark.session import cut_lineage

    def written(r):
        rows = r.spark.range(0, 2_000_000, 1, 1).select("id", F.rand(1).alias("value"), F.rand(2).alias("other"), (F.col("id") % 4).alias("part"))
        out = cut_lineage(rows.drop("part"))
        assert out.rdd.getNumPartitions() >= 3
        assert out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 1_000_000
        return cut_lineage(rows, "part")

    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "parquet.block.size", "spark.sql.maxConcurrentOutputFileWriters")}
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "1")
    try:
        parts = Query(written)(spark, "/root/testdata/sf0.001")
        assert len(parts.inputFiles()) == 4
        assert [r["count"] for r in parts.groupBy("part").count().collect()] == [500_000] * 4
        assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "8"
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        for key, value in kept.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_shuffles_of_a_study_follow_the_rows_of_its_tables(spark, monkeypatch):
    from tidemark import session

    monkeypatch.setattr(session, "ROWS_PER_PARTITION", 50, raising=False)
    number = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    merge = ("spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    kept = {k: spark.conf.get(k, None) for k in (*session.SETTINGS, *session.STUDY_SETTINGS, *merge, number)}
    try:
        onsets = QUERIES["baseline_and_onset"](spark, FOLDER)
        used = sum(spark.read.parquet(f"{FOLDER}/{t}.parquet").count() for t in ("events", "customer"))
        assert int(spark.conf.get(number)) == -(-used // 50) > 4
        for key, value in zip((*merge, "spark.sql.adaptive.advisoryPartitionSizeInBytes"), ("false", "1", "1")):
            spark.conf.set(key, value)
        assert onsets.rdd.getNumPartitions() > 4  # the session's own number of partitions
        monkeypatch.undo()
        QUERIES["baseline_and_onset"](spark, FOLDER)
        assert spark.conf.get(number) == spark.conf.get("spark.sql.shuffle.partitions") == "4"
    finally:
        for key, value in kept.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
