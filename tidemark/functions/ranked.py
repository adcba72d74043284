"""Exact rank statistics without a whole group in one task.

Ranks need a cumulative sum in value order, and a plain window puts a whole group into one task.  Rows are first
collapsed to one per distinct value (a hash aggregate with map-side combine).  For the AUROC they are put into ranges once, and
runs of a range are merged in order.  For quantiles they are cut into cells at split points taken from the data: a mergeable sketch of the distinct values of a group gives PARTS - 1 split points, another
one those of each part.  Windows cover the parts of a group, the cells of a part, or the distinct values of a
cell, about 1 / PARTS^2 of the group's.  The cuts steer the grouping only; comparisons use the value, and the same path is
taken at every size.

Samples: a hash prefix decides for all rows but those of one bin.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import hash_int, join_groups
from tidemark.shipping import ship

PARTS = 64
SKETCH_ACCURACY = 2_000
RUN_ROWS = 1 << 16


def _parts(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """`name`: how many of the split points of its group lie below a row's value (rows are distinct values)."""
    shares = [i / PARTS for i in range(1, PARTS)]
    splits = df.groupBy(*keys).agg(F.array_distinct(F.approx_percentile(value, shares, F.lit(SKETCH_ACCURACY))).alias("_splits"))
    joined = join_groups(df, splits, keys) if keys else df.withColumn("_splits", splits.scalar())
    return joined.withColumn(name, F.size(F.filter("_splits", lambda s: s < F.col(value)))).drop("_splits")


def cells(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows, one per key group and distinct value, with the part `_d1` and the cell `_d2` of the part they lie in."""
    return _parts(_parts(df, keys, value, "_d1"), [*keys, "_d1"], value, "_d2")


def _before(df: DataFrame, keys: Sequence[str], order: str, value: str) -> Column:
    """Sum of `value` over the rows before in `order`."""
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(earlier), F.lit(0))


def auroc(
    df: DataFrame,
    keys: Sequence[str] = (),
    y: str = "y",
    score: str = "score",
    weight: str | None = None,
) -> DataFrame:
    """Mid-rank AUROC per key group: columns keys, n_pos, n_neg, auroc (NULL with one class only).

    With `weight` each row counts that many times.  Rows are collapsed to one per distinct score, put into ranges of (keys, score) once, and each
    run of RUN_ROWS of a range turns into one row (p, q, u) per group; an ordered row of runs has sum(u) + sum(p * negatives in earlier runs).
    """
    keys = list(keys)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    positive = F.col(y).cast("double")
    collapsed = (
        df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(y).isNotNull())
        .select(*keys, F.col(score).cast("double").alias("_s"), (w * positive).alias("_p"), (w * (1.0 - positive)).alias("_q"))
        .groupBy(*keys, "_s")
        .agg(F.sum("_p").alias("_p"), F.sum("_q").alias("_q"))
    )
    order = [*keys, "_s"]
    kinds = "".join(f"`{k}` {collapsed.schema[k].dataType.simpleString()}, " for k in keys)
    ship(df.sparkSession)
    runs = collapsed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        lambda batches: _runs(batches, keys), f"{kinds}_s double, _p double, _q double, _u double")
    merged = runs.withColumn("_u", F.col("_u") + F.col("_p") * _before(runs, keys, "_s", "_q")).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("_p", "_q", "_u")])
    return merged.select(
        *keys,
        F.col("_p").alias("n_pos"),
        F.col("_q").alias("n_neg"),
        F.try_divide(F.col("_u"), F.col("_p") * F.col("_q")).alias("auroc"),
    )


def _runs(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Sorted distinct scores to one row per group and run: first score, positives, negatives, concordant pairs."""
    held, size = [], 0

    def made() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        new = changes([table.column(k) for k in keys], table.num_rows)
        first = np.flatnonzero(new)
        p, q = (np.asarray(table.column(c).combine_chunks()) for c in ("_p", "_q"))
        upto = np.cumsum(q)
        start = np.repeat(upto[first] - q[first], np.diff(np.append(first, len(q))))
        u = np.add.reduceat(p * (upto - start - q / 2), first)
        head = [table.column(k).combine_chunks().take(pa.array(first)) for k in keys]
        return pa.RecordBatch.from_arrays([*head, table.column("_s").combine_chunks().take(pa.array(first)), pa.array(np.add.reduceat(p, first)),
                                           pa.array(np.add.reduceat(q, first)), pa.array(u)], names=[*keys, "_s", "_p", "_q", "_u"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= RUN_ROWS:
            yield made()
            held, size = [], 0
    if size:
        yield made()


def changes(columns: Iterable[pa.ChunkedArray], rows: int) -> np.ndarray:
    """True where a row differs from the one before in any of the columns."""
    new = np.zeros(rows, bool)
    new[:1] = True
    for column in columns:
        code = np.asarray(pc.dictionary_encode(column.combine_chunks(), null_encoding="encode").indices)
        new[1:] |= code[1:] != code[:-1]
    return new


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolation quantiles, long form: keys, p, n, quantile.

    Counts per part and per cell tell in which cells the wanted ranks lie; only values of those cells are put in order.

    For values with a bounded number of distinct levels (ages, ticks of a limited window)
    `F.percentile` is one aggregate and simpler.
    """
    keys, probs = list(keys), sorted(float(p) for p in probs)
    distinct = (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_m"))
    )
    placed = cells(distinct, keys, "_v")
    of_cell = placed.groupBy(*keys, "_d1", "_d2").agg(F.sum("_m").alias("_c"))
    of_part = of_cell.groupBy(*keys, "_d1").agg(F.sum("_c").alias("_c"))
    every = Window.partitionBy(*keys)
    parts = of_part.select(*keys, "_d1", _before(of_part, keys, "_d1", "_c").alias("_b1"), F.sum("_c").over(every).alias("n"))
    wanted = F.array(*[F.lit(p) for p in probs])
    ranks = F.array_distinct(F.flatten(F.transform(wanted, lambda p: F.array(
        F.floor((F.col("n") - 1) * p).cast("bigint"), F.ceil((F.col("n") - 1) * p).cast("bigint")))))
    held = (
        join_groups(of_cell.withColumn("_b2", _before(of_cell, [*keys, "_d1"], "_d2", "_c")), parts, [*keys, "_d1"])
        .withColumn("_from", F.col("_b1") + F.col("_b2"))
        .withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_from")) & (r < F.col("_from") + F.col("_c"))))
        .where(F.size("_ranks") > 0).select(*keys, "_d1", "_d2", "_from", "_ranks", "n")
    )
    inside = join_groups(placed, held, [*keys, "_d1", "_d2"])
    first = F.col("_from") + _before(inside, [*keys, "_d1", "_d2"], "_v", "_m")
    hits = (
        inside.withColumn("_lo", first)
        .withColumn("_r", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_lo")) & (r < F.col("_lo") + F.col("_m")))))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_at"), F.max("n").alias("n"))
        .withColumn("p", F.explode(wanted))
    )
    pos = (F.col("n") - 1) * F.col("p")
    low, high = F.element_at("_at", F.floor(pos).cast("bigint")), F.element_at("_at", F.ceil(pos).cast("bigint"))
    return hits.select(*keys, "p", "n", (low + (high - low) * (pos - F.floor(pos))).alias("quantile"))


def medians(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return quantiles(df, keys, value, [0.5]).select(*keys, F.col("quantile").alias("median"))


def sample_n(
    df: DataFrame,
    ident: str,
    n: Column,
    seed: int,
    keys: Sequence[str] = (),
    bins: int = 1 << 16,
) -> DataFrame:
    """Exactly `n` rows per key group without replacement: the smallest md5(seed:id) values.

    `n` is an expression over `keys` and per-row constants.  The hash prefix is uniform, so only the
    rows of the one bin that holds the cut (about 1/65536 of a group) are ordered against each other.
    """
    keys = list(keys)
    prefix = F.floor(hash_int(F.lit(seed), ident) / F.lit(4294967296 // bins)).cast("int")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ident).cast("string")))
    rows = df.withColumn("_bin", prefix).withColumn("_want", n.cast("bigint"))
    bin_of = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        rows.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_m"), F.max("_want").alias("_want"))
        .withColumn("_before", F.coalesce(F.sum("_m").over(bin_of), F.lit(0)))
    )
    cut = counts.where((F.col("_before") < F.col("_want"))).select(
        *keys, "_bin", (F.col("_want") - F.col("_before")).alias("_room"), "_m"
    )
    inside = join_groups(rows.drop("_want"), cut, [*keys, "_bin"])
    whole = inside.where(F.col("_room") >= F.col("_m"))
    order = Window.partitionBy(*keys, "_bin").orderBy("_digest", ident)
    part = (
        inside.where(F.col("_room") < F.col("_m")).withColumn("_digest", digest)
        .withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.col("_room"))
        .drop("_digest", "_rank")
    )
    return whole.unionByName(part).drop("_bin", "_room", "_m")


def numbered(keys: DataFrame, key: str, name: str, hashed: Column | None = None, within: Sequence[str] = ()) -> DataFrame:
    """Distinct keys (per group of `within`) with consecutive numbers from 0 in the order of (32-bit hash, key): a window sees one of 4096 slices of the hash."""
    within = list(within)
    sliced = keys.select(*within, key, (hash_int(key) if hashed is None else hashed).alias("_hash")).withColumn("_slice", F.shiftright("_hash", 20))
    sizes = sliced.groupBy(*within, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    # As many rows as slices, for each group.
    before = sizes.select(*within, "_slice", _before(sizes, within, "_slice", "_n").alias("_b"))
    place = F.row_number().over(Window.partitionBy(*within, "_slice").orderBy("_hash", key)) - 1
    placed = join_groups(sliced.withColumn("_place", place), before, [*within, "_slice"])
    return placed.select(*within, key, (F.col("_b") + F.col("_place")).cast("bigint").alias(name))


def quantile_columns(df: DataFrame, keys: Sequence[str], value: str, names: dict[str, float]) -> DataFrame:
    """Exact quantiles as one column per name."""
    long = quantiles(df, keys, value, list(names.values()))
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("p") == F.lit(float(p)), F.col("quantile"))).alias(name) for name, p in names.items()]
    )
