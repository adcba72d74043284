"""Feature events, hourly panel, tabular / sequence / static views, preprocessing.

A feature matrix is one row per stay with array columns `tabular` (double), `sequence`
(hours x variables) and `static`; the names of the entries are kept beside it in `MatrixNames`.
Missing is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.ranked import medians
from tidemark.operators import concepts as C
from tidemark.operators.summaries import set_statistics, stats_frame
from tidemark.operators.temporal import fill_forward
from tidemark.session import cut_lineage


@dataclass(frozen=True)
class MatrixNames:
    tabular: list[str]
    sequence: list[str]
    static: list[str]


def fahrenheit_to_celsius(c: Column) -> Column:
    return (c - 32.0) * 5.0 / 9.0


def feature_events(
    labevents: DataFrame,
    chartevents: DataFrame,
    outputevents: DataFrame,
    cohort: DataFrame,
    weight: DataFrame,
    window_hours: int = config.WINDOW_HOURS,
    gcs_events: DataFrame | None = None,
) -> DataFrame:
    """Long frame (stay_id, variable, hours, value) of all features with 0 <= hours < window.

    `gcs_events` are the chart rows of the coma score, if they come apart from the others.
    """
    plain = [v for v in config.VITALS if v not in ("temperature", "gcs_total")]
    charted = C.chart(chartevents, cohort, [*plain, "temperature_c", "temperature_f"], window_hours)
    is_f = F.col("concept") == "temperature_f"
    vitals = charted.select(
        "stay_id",
        F.when(F.col("concept").isin("temperature_c", "temperature_f"), "temperature").otherwise(F.col("concept"))
        .alias("variable"),
        "hours",
        F.when(is_f, fahrenheit_to_celsius(F.col("value"))).otherwise(F.col("value")).alias("value"),
    ).where((F.col("variable") != "temperature") | F.col("value").between(*config.TEMPERATURE_VALID))
    labs = C.lab(labevents, cohort, config.LABS, window_hours, lookback_days=0).withColumnRenamed("concept", "variable")
    gcs = C.gcs_total(chartevents if gcs_events is None else gcs_events, cohort, window_hours).withColumn("variable", F.lit("gcs_total"))
    urine = urine_rate(C.urine_output(outputevents, cohort, window_hours), weight)
    out = vitals
    for part in (labs, gcs, urine):
        out = out.unionByName(part.select(*out.columns))
    return out.where((F.col("hours") >= 0) & (F.col("hours") < window_hours))


def urine_rate(urine: DataFrame, weight: DataFrame) -> DataFrame:
    """Urine volume per kg as variable `urine_rate`."""
    return urine.join(weight.select("stay_id", "weight_kg"), "stay_id", "left").select(
        "stay_id", F.lit("urine_rate").alias("variable"), "hours", (F.col("value") / F.col("weight_kg")).alias("value")
    )


def leaks(events: DataFrame, window_hours: float) -> DataFrame:
    """Count per variable of events at or after the window; no rows means no leak."""
    return events.where(F.col("hours") >= window_hours).groupBy("variable").agg(F.count(F.lit(1)).alias("n_late"))


def assert_no_future_leakage(events: DataFrame, window_hours: float) -> None:
    bad = leaks(events, window_hours).collect()  # at most one row per variable
    if bad:
        raise AssertionError(f"events at or after hour {window_hours}: {({r.variable: r.n_late for r in bad})}")


def hourly_panel(
    events: DataFrame,
    stays: DataFrame,
    variables: Sequence[str],
    window_hours: int = config.WINDOW_HOURS,
    summed: Sequence[str] = ("urine_rate",),
) -> DataFrame:
    """Dense (stay_id, hour) with one column per variable: hourly mean, or sum for `summed`.

    The dense hours are rows of the aggregated frame itself, so no join is needed; values are reduced
    per (stay, hour, variable) before they are turned into columns.
    """
    dense = stays.select("stay_id", F.explode(F.sequence(F.lit(0), F.lit(window_hours - 1))).alias("hour")).select(
        "stay_id", F.col("hour").cast("double").alias("hours"),
        F.lit(None).cast("string").alias("variable"), F.lit(None).cast("double").alias("value"),
    )
    known = stays.select("stay_id").distinct()
    inside = events.where((F.col("hours") >= 0) & (F.col("hours") < window_hours)).join(known, "stay_id", "left_semi")
    how = F.when(F.col("variable").isin(list(summed)), F.sum("value")).otherwise(F.avg("value"))
    return (
        inside.select("stay_id", "hours", "variable", "value").unionByName(dense)
        .groupBy("stay_id", F.floor("hours").cast("int").alias("hour"), "variable").agg(how.alias("_v"))
        .groupBy("stay_id", "hour").pivot("variable", list(variables)).agg(F.first("_v"))
    )


def _statistics(panel: DataFrame, variables: Sequence[str], aggregations: Sequence[str]) -> DataFrame:
    """(stay_id, _stats): one struct of aggregates per variable, in the order of `variables`.

    Aggregates run over the hourly bins of a stay (not raw rows, not filled values), with the variables as
    rows: a few aggregates over many groups rather than one aggregate per variable and statistic.
    """
    known = F.when(F.col("_v").isNotNull(), F.col("hour"))
    every = {
        "min": F.min("_v"), "max": F.max("_v"), "mean": F.avg("_v"),
        "first": F.min_by("_v", known), "last": F.max_by("_v", known),
    }
    position = F.array_position(F.array(*[F.lit(v) for v in variables]), F.col("_variable"))
    return (
        panel.unpivot(["stay_id", "hour"], list(variables), "_variable", "_v")
        .groupBy("stay_id", "_variable").agg(*[every[a].alias(a) for a in aggregations])
        .groupBy("stay_id")
        .agg(F.sort_array(F.collect_list(F.struct(position.alias("_i"), *aggregations))).alias("_stats"))
    )


def tabular_names(variables: Sequence[str], aggregations: Sequence[str]) -> list[str]:
    return [f"{v}__{a}" for v in variables for a in aggregations]


def tabular_view(panel: DataFrame, variables: Sequence[str], aggregations: Sequence[str] = tuple(config.AGGREGATIONS)) -> DataFrame:
    """One column variable__aggregation each."""
    stats = _statistics(panel, variables, aggregations)
    return stats.select("stay_id", *[
        F.col("_stats")[i][a].alias(f"{v}__{a}") for i, v in enumerate(variables) for a in aggregations
    ])


def sequence_view(panel: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Forward-filled hours x variables per stay; the list holds one entry per window hour."""
    filled = fill_forward(panel, variables)
    step = F.struct("hour", F.array(*[F.col(v).cast("double") for v in variables]).alias("_x"))
    return filled.groupBy("stay_id").agg(F.sort_array(F.collect_list(step))["_x"].alias("sequence"))


def levels(df: DataFrame, column: str) -> list[str]:
    """Sorted non-null levels of a categorical column: the names of its 0/1 columns, so as many as the matrix has columns."""
    return sorted(r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().collect())


def one_hot(df: DataFrame, column: str, values: Sequence[str]) -> dict[str, Column]:
    """0/1 columns named column=level; NULL gives zeros throughout."""
    return {f"{column}={v}": F.when(F.col(column) == v, 1.0).otherwise(0.0) for v in values}


def static_frame(cohort: DataFrame, admission: str = "admission_type") -> DataFrame:
    return cohort.select("stay_id", F.col("age").cast("double").alias("age"), F.col("gender").alias("sex"),
                         F.coalesce(admission, F.lit("UNKNOWN")).alias("admission_type"))


def build_matrix(
    panel: DataFrame,
    static: DataFrame,
    variables: Sequence[str],
    aggregations: Sequence[str] = tuple(config.AGGREGATIONS),
    numeric: Sequence[str] = ("age",),
    categorical: Sequence[str] = ("sex", "admission_type"),
    category_levels: dict[str, list[str]] | None = None,
) -> tuple[DataFrame, MatrixNames]:
    """The three aligned views per stay.  Tabular ends with the static columns."""
    dummies: dict[str, Column] = {}
    for c in categorical:
        dummies |= one_hot(static, c, (category_levels or {}).get(c) or levels(static, c))
    static_names = [*numeric, *dummies]
    static_array = F.array(*[F.col(c).cast("double") for c in numeric], *dummies.values())
    wide = _statistics(panel, variables, aggregations).select(
        "stay_id", F.flatten(F.transform("_stats", lambda s: F.array(*[s[a] for a in aggregations]))).alias("_tab")
    )
    known = static.select("stay_id", static_array.alias("static"))
    none = F.array_repeat(F.lit(None).cast("double"), len(static_names))
    matrix = (
        wide.join(sequence_view(panel, variables), "stay_id").join(known, "stay_id", "left")
        .withColumn("static", F.coalesce("static", none))
        .select("stay_id", F.concat("_tab", "static").alias("tabular"), "sequence", "static")
    )
    return matrix, MatrixNames(tabular_names(variables, aggregations) + static_names, list(variables), static_names)


def missing_fraction(matrix: DataFrame) -> DataFrame:
    """Share of missing entries of the tabular and of the sequence view."""
    flat = F.flatten("sequence")

    def share(a: Column | str) -> Column:
        a = F.col(a) if isinstance(a, str) else a
        return F.try_divide(F.sum(F.size(F.filter(a, lambda x: x.isNull()))), F.sum(F.size(a)))

    return matrix.agg(share("tabular").alias("missing_tabular"), share(flat).alias("missing_sequence"))


# --- preprocessing -----------------------------------------------------------------
def fit_preprocessor(rows: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per feature of an array column: (keys, pos, median, mean, sd), fitted on the given rows only.

    Median of the finite values (0 if none), then mean and population SD after filling; an SD of
    1e-12 or less becomes 1.  Without `keys` the passes reduce each task's rows to vectors (see summaries.py) and as many rows as features
    come back; with `keys`, of which there may be many, features are rows and the work spreads over feature x value.
    """
    if not keys:
        ready = cut_lineage(rows.select(F.array(F.lit(0)).alias("sets"), F.col(column).cast("array<double>").alias("x"), F.array().cast("array<double>").alias("ys")))
        return stats_frame(rows.sparkSession, set_statistics(ready), [0]).drop("set")
    cell = [*keys, "pos"]
    long = rows.select(*keys, F.posexplode(column).alias("pos", "value"))
    usable = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    long = long.select(*cell, usable.alias("value"))
    middle = medians(long, cell, "value")
    filled = long.join(middle, cell, "left").select(
        *cell, F.coalesce("median", F.lit(0.0)).alias("median"), F.coalesce("value", "median", F.lit(0.0)).alias("x")
    )
    sd = F.stddev_pop("x")
    return filled.groupBy(*cell).agg(
        F.max("median").alias("median"), F.avg("x").alias("mean"), F.when(sd > 1e-12, sd).otherwise(1.0).alias("sd")
    )


def fit_sequence_preprocessor(rows: DataFrame, column: str = "sequence") -> DataFrame:
    """As `fit_preprocessor`, over all hours of all stays."""
    return fit_preprocessor(rows.select(F.explode(column).alias("_step")), "_step")


def _scaler(stats: DataFrame) -> Column:
    """The statistics as one array, one entry per feature, brought in as a scalar subquery."""
    entry = F.struct("pos", "median", "mean", "sd")
    return stats.agg(F.sort_array(F.collect_list(entry)).alias("_stats")).scalar()


def _scale(x: Column, stats: Column) -> Column:
    def cell(v: Column, s: Column) -> Column:
        usable = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
        return (F.coalesce(usable, s["median"]) - s["mean"]) / s["sd"]

    return F.zip_with(x, stats, cell)


def apply_preprocessor(rows: DataFrame, stats: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("_stats", _scaler(stats)).withColumn(column, _scale(F.col(column), F.col("_stats"))).drop("_stats")


def scale_with(x: str, table: Sequence[tuple[float, float, float]]) -> Column:
    """Array column `x` scaled with statistics that are already known, (median, mean, sd) per feature."""
    median, mean, sd = (", ".join(f"{float(row[i])!r}D" for row in table) for i in range(3))
    return F.expr(
        f"transform({x}, (v, i) -> (coalesce(if(isnan(v) or abs(v) = double('infinity'), null, v), array({median})[i])"
        f" - array({mean})[i]) / array({sd})[i])"
    )


def apply_sequence_preprocessor(rows: DataFrame, stats: DataFrame, column: str = "sequence") -> DataFrame:
    steps = F.transform(F.col(column), lambda step: _scale(step, F.col("_stats")))
    return rows.withColumn("_stats", _scaler(stats)).withColumn(column, steps).drop("_stats")
