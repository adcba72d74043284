"""Event-time primitives: ticks, hour grid, rolling windows, as-of and band matching.

Windows run per stay.  So that one stay with a large share of all rows does no harm, rows are
first collapsed to one per (stay, tick), a tick being a whole second: an aggregate with map-side
combine.  A stay followed for h hours then has at most 3600 h rows, whatever the size of the data.
Running frames (unbounded preceding) cost one step per row; a sliding minimum is built from two
running ones, so no window rescans its frame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import require_columns, require_option

MS_PER_HOUR = 3_600_000


def tick(hours: str | Column) -> Column:
    """Integer milliseconds, the clock of all range frames."""
    h = F.col(hours) if isinstance(hours, str) else hours
    return F.round(h * float(MS_PER_HOUR)).cast("bigint")


def ms(hours: float) -> int:
    return int(round(hours * MS_PER_HOUR))


def hourly_grid(stays: DataFrame) -> DataFrame:
    """Dense (stay_id, hour) from 0 to ceil(max_hours)."""
    require_columns(stays, ["stay_id", "max_hours"])
    last = F.ceil("max_hours").cast("int")
    return stays.where(last >= 0).select("stay_id", F.explode(F.sequence(F.lit(0), last)).alias("hour"))


def fill_forward(df: DataFrame, columns: Sequence[str], key: str = "stay_id", order: str = "hour") -> DataFrame:
    seen = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(seen) for c in columns})


def rolling_extreme(
    df: DataFrame, column: str, hours: float, name: str, worst: str = "min",
    key: str = "stay_id", time: str = "hours",
) -> DataFrame:
    """min or max of `column` over (t - hours, t], open left and closed right, peers included.

    `df` holds one row per (key, time).  Time is cut into blocks as long as the window, so a window
    is the head of its own block plus the tail of the block before.  Both are running extremes, and
    (key, block) is also the unit of distribution: a long or hot key is spread over its blocks.
    """
    require_option(worst, ("min", "max"), "worst")
    running = F.min if worst == "min" else F.max
    pick = F.least if worst == "min" else F.greatest
    width = ms(hours)
    cells = df.withColumn("_t", tick(time)).withColumn("_block", F.floor(F.col("_t") / F.lit(width)))
    block = Window.partitionBy(key, "_block")
    so_far = Window.unboundedPreceding, 0
    cells = cells.withColumn("_head", running(column).over(block.orderBy("_t").rowsBetween(*so_far))).withColumn(
        "_tail", running(column).over(block.orderBy(F.desc("_t")).rowsBetween(*so_far))
    )
    columns = df.columns
    sources = cells.select(key, "_block", "_t", F.lit(1).alias("_kind"), "_tail", F.lit(None).alias("_row"))
    probes = cells.select(
        key, (F.col("_block") - 1).alias("_block"), (F.col("_t") - width).alias("_t"), F.lit(0).alias("_kind"),
        F.lit(None).cast(cells.schema["_tail"].dataType).alias("_tail"), F.struct(*columns, "_head").alias("_row"),
    )
    # Backwards in time; at equal times the probe comes first, so the entry exactly `hours` ago is out.
    back = block.orderBy(F.desc("_t"), "_kind").rowsBetween(*so_far)
    return (
        sources.unionByName(probes)
        .withColumn("_tail", F.last("_tail", ignorenulls=True).over(back))
        .where(F.col("_kind") == 0)
        .select(*[F.col("_row")[c].alias(c) for c in columns], pick(F.col("_row")["_head"], "_tail").alias(name))
    )


def asof_backward(
    left: DataFrame, right: DataFrame, name: str, tolerance: float | None = None,
    key: str = "stay_id", time: str = "hours", value: str = "value",
) -> DataFrame:
    """Last value of `right` at or before each row of `left`, at most `tolerance` hours old.

    Equal-time entries of `right` are reduced to the largest value.  The match is found per distinct
    (key, time) of the left side and joined back, so repeated left rows never enter the window.
    """
    entries = right.where(F.col(value).isNotNull()).groupBy(key, tick(time).alias("_t")).agg(F.max(value).alias("_v"))
    asked = left.select(key, tick(time).alias("_t")).distinct()
    seen = Window.partitionBy(key).orderBy("_t", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last(F.when(~F.col("_asks"), F.struct("_t", "_v")), ignorenulls=True).over(seen)
    fresh = F.lit(True) if tolerance is None else F.col("_t") - F.col("_hit._t") <= ms(tolerance)
    matched = (
        entries.withColumn("_asks", F.lit(False))
        .unionByName(asked.withColumn("_asks", F.lit(True)), allowMissingColumns=True)
        .withColumn("_hit", hit)
        .where(F.col("_asks"))
        .select(key, "_t", F.when(fresh, F.col("_hit._v")).alias(name))
    )
    return left.withColumn("_t", tick(time)).join(matched, [key, "_t"], "left").drop("_t")


def next_at_or_after(
    probes: DataFrame, targets: DataFrame, shift: float, name: str,
    key: str = "stay_id", probe_time: str = "hours", target_time: str = "hours", strict: bool = False,
) -> DataFrame:
    """First target time >= probe time + shift (or > with `strict`), NULL where none follows.

    One running minimum backwards in time; no pair of probe and target is ever built.
    """
    p = probes.select(key, (tick(probe_time) + ms(shift)).alias("_t"), F.struct(*probes.columns).alias("_row"))
    t = targets.select(key, tick(target_time).alias("_t"), F.col(target_time).alias("_target"))
    back = Window.partitionBy(key).orderBy(F.desc("_t"))
    frame = back.rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    return (
        p.unionByName(t, allowMissingColumns=True)
        .withColumn("_next", F.min("_target").over(frame))
        .where(F.col("_row").isNotNull())
        .select("_row.*", F.col("_next").alias(name))
    )


def band_join(
    left: DataFrame, right: DataFrame, left_time: str, right_time: str, low: float, high: float,
    key: str = "stay_id", width: float | None = None,
) -> DataFrame:
    """Pairs with low <= right_time - left_time <= high, joined on (key, time bucket).

    For callers that want the pairs themselves.  Each left row goes to the few buckets its band
    touches, so a hot key is spread over its buckets and only pairs near each other are compared.
    """
    width = width or max((high - low) / 4.0, 1.0)
    first = F.floor((F.col(left_time) + low) / width)
    last = F.floor((F.col(left_time) + high) / width)
    spread = left.withColumn("_bucket", F.explode(F.sequence(first, last)))
    placed = right.withColumn("_bucket", F.floor(F.col(right_time) / width))
    gap = F.col(right_time) - F.col(left_time)
    return spread.join(placed, [key, "_bucket"]).where(gap.between(low, high)).drop("_bucket")
