"""Mixing sources to target weights by Pareto order sampling (operator 7).

A source's target is met in two steps: as many certain whole copies of every document as fit, then a sample of the
rest.  In the sample document i has inclusion probability p_i and ranks by its random odds over its
inclusion odds, (u / (1 - u)) / (p / (1 - p)); the smallest ranks are taken until the words asked for are reached.
u comes from a digest of the identifier, and of the place among rows that share it, so reruns agree and do not depend on how rows are dealt.

Scale: texts are read once, for their sizes, which are written.  Only sums per source and per slice of the rank reach a window.  A source is cut into 4096 slices of the rank, the
slice with the cut into 4096 finer ones, and single documents are put in order only in the one fine slice that holds the
cut, so a source with a third of all rows is never ordered in one task.  Sources are few: their table (one row each)
is the only thing that meets in one place.

Defined cases: null text has size 0; a null source is a source of its own, ordered last; empty documents are taken
with probability as any other and add nothing; repeated identifiers and rows without one are each a document with a draw of its own; a source
of empty documents has target 0; very long texts are counted whole; an empty table gives no rows; columns beside those named are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

SLICES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than [\\x20\\x09-\\x0D]; null text has none."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(flat, " "), lambda w: w != "")), F.lit(0)).cast("bigint")


def uniform(ident: Column, place: Column, seed: int) -> Column:
    """Number in (0, 1) from 52 bits of a digest; rows of one identifier after the first add their place."""
    name = F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.when(place > 0, F.concat(F.lit(":"), place.cast("string"))).otherwise(F.lit("")))
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def placed(sized: DataFrame) -> DataFrame:
    """Rows (ident, source, size) with `place`, 0, 1, 2, ... among the rows of one identifier in the order of source and size.

    Only rows whose identifier is repeated are put in order, in ranges that may split an identifier; rows alike in all columns
    may change places, which no result shows.
    """
    many = sized.groupBy("ident").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("ident")
    if many.isEmpty():
        return sized.withColumn("place", F.lit(0).cast("bigint"))
    same = F.col("ident").eqNullSafe(F.col("_many"))
    told = sized.join(many.select(F.col("ident").alias("_many"), F.lit(True).alias("_repeated")), same, "left").drop("_many")
    order = [F.col("ident").asc_nulls_last(), F.col("source").asc_nulls_last(), F.col("size"), F.col("_row")]
    dealt = told.where("_repeated").drop("_repeated").withColumn("_row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    # Written, so that a row has one number however often it is read: range in the upper bits, place in it in the lower 33.
    dealt = cut_lineage(dealt).withColumn("_range", F.shiftright("_row", 33))
    runs = dealt.groupBy("ident", "_range").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("ident").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    runs = runs.select(F.col("ident").alias("_of"), F.col("_range").alias("_in"), "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    numbered = dealt.join(runs, F.col("ident").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_in"))).select(
        "ident", "source", "size", (F.col("_before") + F.col("_row") - F.col("_first")).alias("place"))
    return told.where("_repeated is null").drop("_repeated").withColumn("place", F.lit(0).cast("bigint")).unionByName(numbered)


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, total -> plus weight and target.

    Targets are proportional to weight and stop at `most` times the source's total; what is above is shared again.  That
    is one water level: with sources in the order of cap / weight, the first that the level does not fill ends the
    search (later levels are lower, so it is also the highest of those that fit).
    """
    every = Window.partitionBy(F.lit(0))
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rising = every.orderBy("reach", F.col("source").asc_nulls_last())
    told = (
        sizes.withColumn("weight", weight)
        .withColumn("reach", F.lit(float(most)) * F.col("total") / F.col("weight"))
        .withColumn("goal", F.lit(float(share)) * F.sum("total").over(every))
        .withColumn("before", F.coalesce(F.sum(F.lit(float(most)) * F.col("total")).over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("goal") - F.col("before")) / F.col("open"))
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("reach"), F.col("level"))).over(every))
    )
    cap = F.lit(float(most)) * F.col("total")
    return told.select("source", "total", "weight", F.coalesce(F.least(cap, F.col("level") * F.col("weight")), cap).alias("target"))


def pareto_mix(docs: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """Copies of every document: docs (ident, source, size, appeal, and place if identifiers repeat) and plan (source, total, target).

    `appeal` is a positive relative chance of the document in the sampled part.  Returns ident, source, size, copies.
    """
    docs = docs if "place" in docs.columns else docs.withColumn("place", F.lit(0))
    # Sums of size times appeal set the inclusion odds; they are the only other pass over the documents.
    pull = docs.groupBy("source").agg(F.sum(F.col("size") * F.col("appeal")).alias("pull"))
    whole = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(F.lit(0))
    plan = plan.join(pull, plan["source"].eqNullSafe(pull["source"])).select(
        plan["source"].alias("_source"), "total", "target", "pull", whole.cast("bigint").alias("whole"))
    plan = plan.withColumn("want", F.col("target") - F.col("whole") * F.col("total"))
    chance = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.try_divide(F.col("want") * F.col("appeal"), F.col("pull"))))
    u = uniform(F.col("ident"), F.col("place"), seed)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    ranked = (
        docs.join(plan, docs["source"].eqNullSafe(plan["_source"]))
        .withColumn("p", F.coalesce(chance, F.lit(1e-9)))
        .withColumn("odds", odds)
        # odds / (c + odds) lies in (0, 1); with c the mean chance's odds it spreads evenly however small the chance is.
        .withColumn("mean", F.coalesce(F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.try_divide(F.col("want"), F.col("total")))), F.lit(1e-9)))
        .withColumn("spot", F.col("odds") * F.col("mean") / (1 - F.col("mean")))
        .withColumn("spot", F.col("spot") / (1 + F.col("spot")) * SLICES)
        .withColumn("coarse", F.least(F.floor("spot"), F.lit(SLICES - 1)))
        .withColumn("fine", F.least(F.floor((F.col("spot") - F.col("coarse")) * SLICES), F.lit(SLICES - 1)))
        .select("ident", docs["source"].alias("source"), "size", "whole", "want", "odds", "coarse", "fine")
    )

    def cut(rows: DataFrame, by: str, keys: list[str]) -> DataFrame:
        """For each source the slice in which the words run out, and what is still wanted there."""
        order = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        sums = rows.groupBy(*keys, by).agg(F.sum("size").alias("words"), F.max("want").alias("want"))
        sums = sums.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
        held = sums.where((F.col("before") < F.col("want")) & (F.col("before") + F.col("words") >= F.col("want")))
        return held.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(by).alias(f"_{by}"), (F.col("want") - F.col("before")).alias("left"))

    first = cut(ranked, "coarse", ["source"])
    rows = ranked.join(first, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    edge = rows.where(F.col("coarse") == F.col("_coarse")).drop("want").withColumnRenamed("left", "want")
    second = cut(edge, "fine", ["source"]).withColumnRenamed("left", "last")
    rows = rows.join(second, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    at_cut = (F.col("coarse") == F.col("_coarse")) & (F.col("fine") == F.col("_fine"))
    below = (F.col("coarse") < F.col("_coarse")) | ((F.col("coarse") == F.col("_coarse")) & (F.col("fine") < F.col("_fine")))
    # Documents of the fine slice with the cut: in while that brings the sum nearer to what is wanted.
    order = Window.partitionBy("source").orderBy("odds", "ident", "size").rowsBetween(Window.unboundedPreceding, -1)
    close = (
        rows.where(at_cut).withColumn("so_far", F.coalesce(F.sum("size").over(order), F.lit(0)))
        .withColumn("copies", F.col("whole") + (F.col("so_far") + F.col("size") / 2 <= F.col("last")).cast("bigint"))
    )
    # No cut at all: nothing is wanted, or everything is.
    clear = rows.where(~F.coalesce(at_cut, F.lit(False))).withColumn(
        "copies", F.col("whole") + F.when(F.col("want") <= 0, F.lit(0)).otherwise(F.coalesce(below, F.lit(True)).cast("int")).cast("bigint"))
    columns = ["ident", "source", "size", "copies"]
    return clear.select(*columns).unionByName(close.select(*columns))


def mix_sources(
    docs: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words), copies.

    Longer documents have a higher chance in the sampled part: appeal is 1 + ln(1 + size).
    """
    sized = docs.select(F.col(ident).cast("bigint").alias("ident"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    sized = cut_lineage(placed(sized)).withColumn("appeal", 1 + F.log1p("size"))
    totals = sized.groupBy("source").agg(F.sum("size").alias("total"))
    plan = targets(totals, weights, share, most)
    told = plan.select(F.col("source").alias("_source"), F.col("total").alias("source_size"), "target")
    mixed = pareto_mix(sized, plan, seed)
    return mixed.join(told, mixed["source"].eqNullSafe(told["_source"])).select(
        F.col("ident").alias("doc_id"), "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
