"""CSV to Parquet, views, sinks."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tidemark import cut_lineage
from tidemark.operators.features import MatrixNames
from tidemark.sources import ingest, sinks


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "csv" / "hosp"
    folder.mkdir(parents=True)
    (folder / "codes.csv").write_text('id,code,note\n1,0012,"a ""quoted"" word, and a comma"\n2,V10,\n')
    with gzip.open(folder / "labs.csv.gz", "wt") as f:
        f.write("id,value\n1,2.5\n2,\n3,7\n")
    return tmp_path


TABLES = [
    ingest.TableSpec("hosp/codes", types={"id": "bigint", "code": "string", "gone": "double"}),
    ingest.TableSpec("hosp/labs", types={"id": "bigint", "value": "double"}),
    ingest.TableSpec("hosp/absent"),
    ingest.TableSpec("hosp/notes", skip=True, reason="free text"),
]


def manifest(spark, raw, **kw):
    rows = ingest.convert_source(spark, "src", str(raw / "csv"), str(raw / "parquet"), TABLES, **kw).collect()
    return {r.table: r for r in rows}


def test_conversion_and_manifest(spark, raw):
    first = manifest(spark, raw)
    assert {t: r.status for t, r in first.items()} == {"codes": "converted", "labs": "converted", "absent": "missing", "notes": "skipped"}
    assert first["codes"].rows == 2 and first["codes"].ignored_pins == ["gone"] and first["labs"].csv_bytes > 0
    codes = spark.read.parquet(str(raw / "parquet/codes.parquet")).orderBy("id").collect()
    assert codes[0].code == "0012" and codes[0].note == 'a "quoted" word, and a comma' and codes[1].note is None
    labs = spark.read.parquet(str(raw / "parquet/labs.parquet"))
    assert dict(labs.dtypes)["value"] == "double" and labs.agg(F.sum("value")).head()[0] == 9.5
    assert manifest(spark, raw)["codes"].status == "cached"
    assert manifest(spark, raw, force=True)["codes"].status == "converted"


def test_all_text_scan(spark, raw):
    frame, ignored = ingest.read_csv(spark, str(raw / "csv/hosp/labs.csv.gz"), ingest.TableSpec("labs", types={"x": "int"}, all_text=True))
    assert [t for _, t in frame.dtypes] == ["string", "string"] and ignored == []


def test_a_bad_value_is_an_error_not_a_null(spark, raw):
    frame, _ = ingest.read_csv(spark, str(raw / "csv/hosp/codes.csv"), ingest.TableSpec("codes", types={"code": "bigint"}))
    with pytest.raises(Exception):
        frame.collect()


def test_views(spark, raw):
    manifest(spark, raw)
    root = str(raw / "parquet")
    ingest.register(spark, root, ["codes"], prefix="v_")
    assert spark.sql("SELECT count(*) FROM v_codes").head()[0] == 2
    with pytest.raises(FileNotFoundError):
        ingest.register(spark, root, ["nothing"])
    assert ingest.register(spark, root, ["nothing"], missing_ok=True) == {}
    assert ingest.register_tree(spark, str(raw)) == ["parquet_codes", "parquet_labs"]
    assert ("value", "double") in [tuple(r) for r in ingest.describe(spark.table("parquet_labs")).collect()]


def test_matrix_round_trip_and_reports(spark, tmp_path, frame):
    rows = frame("stay_id long, tabular array<double>, sequence array<array<double>>", (1, [1.0, None], [[1.0], [None]]))
    names = MatrixNames(["a", "b"], ["a"], ["b"])
    sinks.save_matrix(rows, names, str(tmp_path / "m"))
    back, names_back = sinks.load_matrix(spark, str(tmp_path / "m"))
    assert names_back == names and back.head() == rows.head()
    table = sinks.materialise(frame("k string, v int", ("a", 1), ("b", 2)), str(tmp_path / "t"), partition_by=("k",), sort_by=("v",))
    assert table.where("k = 'b'").head()["v"] == 2
    report = sinks.nest(frame("k string, v int", ("a", 1), ("a", 2)), "k", "rows")
    sinks.write_report(report, str(tmp_path / "r"))
    text = next((tmp_path / "r").glob("part-*.json")).read_text()
    assert json.loads(text) == {"k": "a", "rows": [{"v": 1}, {"v": 2}]}
    sinks.write_report(frame("k string, v int", ("b", 2), ("a", 1)), str(tmp_path / "c"), "csv", ("k",))
    assert next((tmp_path / "c").glob("part-*.csv")).read_text() == "k,v\na,1\nb,2\n"


def test_cut_lineage_starts_again_at_a_scan(spark, frame):
    df = cut_lineage(frame("a int", (1,), (2,)).groupBy("a").count())
    assert sorted(map(tuple, df.collect())) == [(1, 1), (2, 1)]
    assert "Aggregate" not in df._jdf.queryExecution().optimizedPlan().toString()
