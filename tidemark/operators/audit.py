"""Data audits: signals, orders, cultures, definition variants, sites, concept availability."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.columns import join_groups, like_any, starts_with_any, suppress, within_hours
from tidemark.functions.ranked import quantile_columns
from tidemark.operators import concepts as C
from tidemark.operators.cohort import with_hit
from tidemark.operators.labels import suspicion_times
from tidemark.operators.metrics import weighted_mean


def top_groups(df: DataFrame, key: str | Column, n: int, name: str = "value") -> DataFrame:
    """The n most frequent values with their counts; ties by value."""
    k = F.col(key) if isinstance(key, str) else key
    return (
        df.groupBy(k.alias(name)).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_last(name)).limit(n)
    )


def signal_coverage(
    tables: Mapping[str, DataFrame], cohort: DataFrame, signals: Sequence[tuple[str, str, int]] = tuple(config.SIGNALS),
    window_hours: float = 48, min_cell: int | None = None,
) -> DataFrame:
    """Share of stays per epoch with each signal in the window; one scan per table, not per signal."""
    hits = None
    for table, frame in tables.items():
        wanted = [(name, item) for name, t, item in signals if t == table]
        if not wanted:
            continue
        time = "starttime" if table == "procedureevents" else "charttime"
        name = F.create_map(*[x for n, i in wanted for x in (F.lit(i), F.lit(n))])
        part = (
            frame.where(F.col("itemid").isin([i for _, i in wanted]))
            .select("stay_id", F.col(time).alias("_t"), name[F.col("itemid")].alias("signal"))
        )
        hits = part if hits is None else hits.unionByName(part)
    counts = (
        hits.join(cohort.select("stay_id", "epoch", "intime"), "stay_id")
        .where(within_hours("intime", "_t", 0, window_hours))
        .groupBy("signal", "epoch", "stay_id").agg(F.lit(1).alias("_one"))
        .groupBy("signal", "epoch").agg(F.count(F.lit(1)).alias("n_with_signal"))
    )
    names = F.array(*[F.lit(n) for n, t, _ in signals if t in tables])
    base = cohort.groupBy("epoch").agg(F.count(F.lit(1)).alias("n_stays")).withColumn("signal", F.explode(names))
    out = (
        join_groups(base, counts, ["signal", "epoch"], "left")
        .withColumn("n_with_signal", F.coalesce("n_with_signal", F.lit(0)))
        .withColumn("frac", F.col("n_with_signal") / F.col("n_stays"))
        .select("signal", "epoch", "n_stays", "n_with_signal", "frac")
    )
    return suppress(out, ["n_with_signal"], min_cell) if min_cell else out


def order_coverage(microbiology: DataFrame, orders: DataFrame, cohort: DataFrame, window_hours: float = 48) -> DataFrame:
    """Per epoch: stays with a specimen (in the window, at any time) and with microbiology, lab and
    culture orders in it.  Order times are text and cast late; bad ones never match."""
    specimens = (
        microbiology.select("hadm_id", C.specimen_time().alias("_t"))
        .join(cohort.select("hadm_id", "stay_id", "intime"), "hadm_id")
        .select("stay_id", within_hours("intime", "_t", 0, window_hours).alias("_in"))
        .groupBy("stay_id").agg(F.coalesce(F.max("_in"), F.lit(False)).alias("specimen_48h"))
    )
    kind = F.lower("order_type")
    wanted = orders.select(
        "hadm_id", F.try_to_timestamp("ordertime").alias("_t"),
        kind.like("%microbio%").alias("micro"), kind.like("%lab%").alias("lab"),
        like_any("order_subtype", config.CULTURE_ORDER_PATTERNS).alias("culture"),
    ).where(F.col("micro") | F.col("lab") | F.col("culture"))
    ordered = (
        wanted.join(cohort.select("hadm_id", "stay_id", "intime"), "hadm_id")
        .where(within_hours("intime", "_t", 0, window_hours))
        .groupBy("stay_id").agg(*[F.coalesce(F.max(c), F.lit(False)).alias(f"{c}_order") for c in ("micro", "lab", "culture")])
    )
    df = cohort.select("stay_id", "epoch").join(specimens, "stay_id", "left").join(ordered, "stay_id", "left")

    def share(c: str | Column) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        return F.avg(F.when(c, 1.0).otherwise(0.0))

    return df.groupBy("epoch").agg(
        F.count(F.lit(1)).alias("n_stays"),
        share("specimen_48h").alias("frac_specimen_48h"),
        share(F.col("specimen_48h").isNotNull()).alias("frac_specimen_anytime"),
        share("micro_order").alias("frac_micro_order_48h"),
        share("lab_order").alias("frac_lab_order_48h"),
        share("culture_order").alias("frac_culture_order_48h"),
    )


def specimen_timing(microbiology: DataFrame, cohort: DataFrame) -> DataFrame:
    """Per epoch: specimens, share without a clock time, specimens per stay."""
    per_admission = microbiology.groupBy("hadm_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("charttime").isNull()).alias("_untimed")
    )
    return (
        cohort.select("hadm_id", "stay_id", "epoch").join(per_admission, "hadm_id", "left").groupBy("epoch")
        .agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("n_specimens"),
            F.try_divide(F.sum("_untimed"), F.sum("_n")).alias("frac_no_charttime"),
            (F.coalesce(F.sum("_n"), F.lit(0)) / F.countDistinct("stay_id")).alias("specimens_per_stay"),
        )
    )


def lab_order_subtypes(orders: DataFrame, n: int = 25) -> DataFrame:
    return top_groups(orders.where(F.lower("order_type").like("%lab%")), "order_subtype", n, "order_subtype")


def antibiotic_inventory(prescriptions: DataFrame, cohort: DataFrame, by: str, n: int = 15) -> DataFrame:
    """Most frequent routes or drug names among antibiotic prescriptions of the cohort."""
    rows = prescriptions.where(C.contains_any("drug", config.ANTIBIOTIC_STEMS)).join(
        cohort.select("hadm_id"), "hadm_id"
    )
    key = F.upper(F.coalesce("route", F.lit("NULL"))) if by == "route" else F.lower(by)
    return top_groups(rows, key, n, by)


def specimen_inventory(microbiology: DataFrame, cohort: DataFrame, n: int = 15) -> DataFrame:
    rows = microbiology.join(cohort.select("hadm_id"), "hadm_id")
    return top_groups(rows, F.upper("spec_type_desc"), n, "spec_type_desc")


def definition_sweep(
    prescriptions: DataFrame, microbiology: DataFrame, cohort: DataFrame,
    lookback_hours: float = config.ACTION_LOOKBACK_HOURS, max_hours: float = config.MAX_HOURS,
) -> DataFrame:
    """Share of stays per epoch under suspicion for 2 antibiotic x 3 culture definitions.

    Each raw table is read once; the variants are flags on the event times.  A variant becomes part
    of the stay key, so all of them go through one suspicion pass.
    """
    def times(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
        flagged = rows.withColumn("_is", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()])))
        return (
            flagged.where(F.size("_is") > 0)
            .join(cohort.select("hadm_id", "stay_id", "intime"), "hadm_id")
            .where(within_hours("intime", "_t", lookback_hours, max_hours))
            .select("stay_id", C.hours_between("intime", "_t").alias("hours"), F.explode("_is").alias("_kind"))
            .distinct()
        )

    abx = times(
        prescriptions.where(C.is_antibiotic()).withColumn("_t", F.col("starttime").cast("timestamp")),
        {"all": F.lit(True), "iv": C.is_systemic()},
    )
    cul = times(
        microbiology.withColumn("_t", C.specimen_time()),
        {"any": F.lit(True), "sterile": C.culture_filter("sterile_only"), "no_surveillance": C.culture_filter("no_surveillance")},
    )
    variants = [("current", "all", "any"), ("iv_only", "iv", "any"), ("sterile_only", "all", "sterile"),
                ("iv_and_sterile", "iv", "sterile"), ("no_surveillance", "all", "no_surveillance"),
                ("iv_and_no_surveillance", "iv", "no_surveillance")]

    def spread(rows: DataFrame, position: int) -> DataFrame:
        lists = F.create_map(*[
            x for kind in sorted({v[position] for v in variants})
            for x in (F.lit(kind), F.array(*[F.lit(v[0]) for v in variants if v[position] == kind]))
        ])
        return rows.withColumn("variant", F.explode(lists[F.col("_kind")])).select(
            F.struct("variant", F.col("stay_id").alias("stay")).alias("stay_id"), "hours"
        )

    suspected = (
        suspicion_times(spread(abx, 1), spread(cul, 2))
        .select("stay_id.variant", F.col("stay_id.stay").alias("stay_id")).distinct()
        .withColumn("_hit", F.lit(1))
    )
    base = cohort.select("stay_id", "epoch").withColumn("variant", F.explode(F.array(*[F.lit(v[0]) for v in variants])))
    return (
        base.join(suspected, ["variant", "stay_id"], "left").groupBy("variant", "epoch")
        .agg(F.count(F.lit(1)).alias("n_stays"), F.count("_hit").alias("n_suspicion"))
        .withColumn("frac", F.col("n_suspicion") / F.col("n_stays"))
    )


# --- site axis -------------------------------------------------------------------
def site_rates(stays: DataFrame, flags: Mapping[str, DataFrame], site: str = "hospitalid",
               attributes: Sequence[str] = ("region", "numbedscategory", "teachingstatus")) -> DataFrame:
    """Per site: attributes, stays, and the share of stays found in each frame of `flags`."""
    df = stays
    for name, hits in flags.items():
        df = with_hit(df, hits, f"_{name}")
    return df.groupBy(site).agg(
        *[F.any_value(a).alias(a) for a in attributes],
        F.count(F.lit(1)).alias("n_stays"),
        *[F.avg(f"_{name}").alias(f"frac_{name}") for name in flags],
    )


def rate_distribution(sites: DataFrame, rates: Sequence[str], probs: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9, 1.0)) -> DataFrame:
    """Quantiles across sites of several rates, long: (rate, p, quantile).  One value per site."""
    long = sites.select(F.explode(F.array(*[
        F.struct(F.lit(r).alias("rate"), F.col(r).alias("v")) for r in rates
    ])).alias("_r")).select("_r.*")
    entries = F.percentile("v", F.array(*[F.lit(float(p)) for p in probs]))
    ps = F.array(*[F.lit(float(p)) for p in probs])
    return long.groupBy("rate").agg(entries.alias("_q")).select(
        "rate", F.explode(F.arrays_zip(ps.alias("p"), F.col("_q").alias("quantile"))).alias("_z")
    ).select("rate", F.col("_z.p").alias("p"), F.col("_z.quantile").alias("quantile"))


def threshold_sweep(
    sites: DataFrame, rates: Sequence[str], thresholds: Sequence[float] = tuple(config.RATE_THRESHOLDS),
    min_stays: int = config.MIN_STAYS_PER_SITE,
) -> DataFrame:
    """(rate, threshold, sites, stays): coverage left at each minimum rate."""
    points = F.array(*[F.struct(F.lit(r).alias("rate"), F.col(r).alias("v"), F.lit(float(t)).alias("threshold"))
                       for r in rates for t in thresholds])
    rows = sites.where(F.col("n_stays") >= min_stays).select("n_stays", F.explode(points).alias("_p")).select("n_stays", "_p.*")
    over = F.col("v") >= F.col("threshold")
    return rows.groupBy("rate", "threshold").agg(
        F.count_if(over).alias("n_sites"), F.sum(F.when(over, F.col("n_stays")).otherwise(0)).alias("n_stays")
    )


def region_rates(sites: DataFrame, rates: Sequence[str], region: str = "region") -> DataFrame:
    """Stay-weighted rates per region."""
    return sites.groupBy(region).agg(
        F.count(F.lit(1)).alias("n_sites"), F.sum("n_stays").alias("n_stays"),
        *[weighted_mean(r, "n_stays").alias(r) for r in rates],
    )


def concept_availability(cohort: DataFrame, hits: DataFrame, concepts: Sequence[str], site: str = "hospitalid",
                         min_stays: int = config.MIN_STAYS_PER_SITE) -> tuple[DataFrame, DataFrame]:
    """Share of stays with each concept, overall and per site of at least `min_stays` stays.

    `hits` is (stay_id, concept); one pass whatever the number of concepts.
    """
    wide = hits.groupBy("stay_id").agg(
        *[F.max((F.col("concept") == c).cast("double")).alias(f"_{i}") for i, c in enumerate(concepts)]
    )
    flags = [F.coalesce(F.col(f"_{i}"), F.lit(0.0)).alias(f"_{i}") for i in range(len(concepts))]
    df = cohort.select("stay_id", site).join(wide, "stay_id", "left").select("stay_id", site, *flags)
    cells = F.array(*[F.struct(F.lit(c).alias("concept"), F.col(f"_{i}").alias("frac")) for i, c in enumerate(concepts)])
    means = [F.avg(f"_{i}").alias(f"_{i}") for i in range(len(concepts))]
    overall = df.agg(*means).select(F.explode(cells).alias("_c")).select("_c.*")
    per_site = (
        df.groupBy(site).agg(F.count(F.lit(1)).alias("n"), *means).where(F.col("n") >= min_stays)
        .select(site, "n", F.explode(cells).alias("_c")).select(site, "n", "_c.*")
    )
    return overall, per_site


def site_spread(per_site: DataFrame) -> DataFrame:
    """Quantiles across sites of the availability of each concept."""
    out = quantile_columns(per_site, ["concept"], "frac", {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9})
    return join_groups(per_site.groupBy("concept").agg(F.count(F.lit(1)).alias("n_sites")), out, ["concept"], "left")


def negative_marker_audit(micro: DataFrame, patient: DataFrame, text: str = "organism", stay: str = "patientunitstayid") -> DataFrame:
    """Does a culture table hold negative results, or positives only?  One row of counts and a verdict."""
    marked = like_any(text, [f"%{m}%" for m in config.NEGATIVE_MARKERS])
    rows = micro.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(stay).alias("n_stays_with_record"), F.count_if(marked).alias("n_negative")
    )
    total = patient.agg(F.count(F.lit(1)).alias("n")).scalar()
    share = F.try_divide(F.col("n_stays_with_record"), F.col("n_stays"))
    return rows.withColumn("n_stays", total).withColumns({
        "frac_stays_with_record": share,
        "records_per_stay": F.col("n_rows") / F.greatest(F.col("n_stays_with_record"), F.lit(1)),
        "verdict": F.when((F.col("n_negative") / F.greatest(F.col("n_rows"), F.lit(1)) < 0.01) & (share < 0.25),
                          "positive only").otherwise("includes negatives"),
    })


def stays_with_text(df: DataFrame, column: str, patterns: Sequence[str], stay: str = "patientunitstayid") -> DataFrame:
    """Distinct stays with a row whose text matches any pattern."""
    return df.where(like_any(column, patterns)).select(F.col(stay).alias("stay_id")).distinct()


def stays_with_prefix(df: DataFrame, column: str, prefixes: Sequence[str], stay: str = "patientunitstayid") -> DataFrame:
    return df.where(starts_with_any(column, prefixes)).select(F.col(stay).alias("stay_id")).distinct()
