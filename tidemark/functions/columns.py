"""Column expressions: clocks, text matching, safe casts, hashing, score cards."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Col = str | Column


def as_col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- guards -------------------------------------------------------------------
def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"frame lacks columns {missing}; it has {df.columns}")


def require_option(value: str, options: Sequence[str], what: str) -> None:
    if value not in options:
        raise ValueError(f"{what} has to be one of {list(options)}, not {value!r}")


# --- clocks --------------------------------------------------------------------
def epoch_seconds(t: Col) -> Column:
    """Whole seconds; TIMESTAMP_NTZ is read in the session zone (UTC)."""
    return F.unix_timestamp(as_col(t).cast("timestamp"))


def hours_between(start: Col, end: Col) -> Column:
    """Hours from `start` to `end` on the whole-second clock."""
    return (epoch_seconds(end) - epoch_seconds(start)) / F.lit(3600.0)


def hours_from_minutes(offset: Col) -> Column:
    return as_col(offset) / F.lit(60.0)


def within_hours(start: Col, t: Col, before: float, after: float) -> Column:
    """start - before <= t <= start + after on the full-resolution clock, both ends closed."""
    delta = F.unix_micros(as_col(t).cast("timestamp")) - F.unix_micros(as_col(start).cast("timestamp"))
    return delta.between(F.lit(int(-before * 3_600_000_000)), F.lit(int(after * 3_600_000_000)))


# --- text ----------------------------------------------------------------------
def like_any(c: Col, patterns: Sequence[str], case: str = "lower") -> Column:
    """Case-folded LIKE against any of the patterns."""
    folded = F.lower(as_col(c)) if case == "lower" else F.upper(as_col(c))
    hit = folded.like(patterns[0])
    for p in patterns[1:]:
        hit = hit | folded.like(p)
    return hit


def like_none(c: Col, patterns: Sequence[str], exact: Sequence[str] = (), case: str = "upper") -> Column:
    """No LIKE pattern and no exact value matches; NULL text gives NULL, so it drops out of a filter."""
    folded = F.upper(as_col(c)) if case == "upper" else F.lower(as_col(c))
    keep = F.lit(True)
    for p in patterns:
        keep = keep & ~folded.like(p)
    for value in exact:
        keep = keep & (folded != F.lit(value))
    return keep


def contains_any(c: Col, stems: Sequence[str]) -> Column:
    """Substring search for many literal stems in one pass over the text."""
    return F.lower(as_col(c)).rlike("|".join(re.escape(s.lower()) for s in stems))


def starts_with_any(c: Col, prefixes: Sequence[str]) -> Column:
    folded = F.lower(as_col(c))
    hit = folded.startswith(prefixes[0])
    for p in prefixes[1:]:
        hit = hit | folded.startswith(p)
    return hit


def first_match(c: Col, cases: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Name of the first case with a matching LIKE pattern, in the given order."""
    out = None
    for name, patterns in cases:
        hit = like_any(c, patterns)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def normal_code(c: Col) -> Column:
    """Diagnosis code without dots, upper case."""
    return F.replace(F.upper(as_col(c)), F.lit("."), F.lit(""))


# --- casts and units -------------------------------------------------------------
def age_years(c: Col, ceiling: str, ceiling_value: int) -> Column:
    text = as_col(c)
    return F.when(text == ceiling, F.lit(ceiling_value)).otherwise(text.try_cast("int"))


def rate_mcg_kg_min(rate: Col, unit: Col, weight: Col) -> Column:
    """Infusion rate in mcg/kg/min; unknown units and weight-bound units without a weight give NULL."""
    rate, unit = as_col(rate), F.lower(as_col(unit))
    weight = F.nullif(as_col(weight), F.lit(0.0))
    return (
        F.when(unit == "mcg/kg/min", rate)
        .when(unit == "mg/kg/min", rate * 1000.0)
        .when(unit == "mcg/min", rate / weight)
        .when(unit == "mg/min", rate * 1000.0 / weight)
        .when(unit == "mcg/kg/hr", rate / 60.0)
        .when(unit == "mg/kg/hr", rate * 1000.0 / 60.0)
    )


def inspired_fraction(c: Col) -> Column:
    """Percent or fraction to fraction; anything between 1 and 20 or below 0.2 is unusable."""
    v = as_col(c)
    return F.when(v >= 20.0, v / 100.0).when(v.between(0.2, 1.0), v)


# --- scores ----------------------------------------------------------------------
def score_card(c: Col, cuts: Sequence[tuple[float, int]], direction: str, default: int = 0) -> Column:
    """Ordered cut-offs to points.  'below' tests value < cut, 'from' tests value >= cut; NULL stays NULL."""
    require_option(direction, ("below", "from"), "direction")
    v = as_col(c)
    out = F.when(v.isNull(), F.lit(None).cast("int"))
    for cut, points in cuts:
        out = out.when(v < cut if direction == "below" else v >= cut, F.lit(points))
    return out.otherwise(F.lit(default))


def logit(p: Col) -> Column:
    p = F.least(F.greatest(as_col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


# --- hashing ---------------------------------------------------------------------
def hash_int(*parts: Col) -> Column:
    """32-bit integer from the md5 of the ':'-joined parts: the same in every engine."""
    text = F.concat_ws(":", *[as_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_uniform(*parts: Col) -> Column:
    """Number in (0, 1) from 52 bits of the md5 of the ':'-joined parts."""
    text = F.concat_ws(":", *[as_col(p).cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def hash_fold(ident: Col, n_folds: int, seed: int = 0) -> Column:
    """Fold from the id alone, stable when other rows come or go."""
    return F.pmod(hash_int(F.lit(seed), as_col(ident)), F.lit(n_folds)).cast("int")


# --- small cells -------------------------------------------------------------------
def suppress(df: DataFrame, columns: Sequence[str], minimum: int) -> DataFrame:
    """NULL for counts that are positive but below `minimum`."""
    return df.withColumns(
        {c: F.when((F.col(c) > 0) & (F.col(c) < minimum), F.lit(None)).otherwise(F.col(c)) for c in columns}
    )


# --- joins -------------------------------------------------------------------------
def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on group keys that also matches NULL with NULL, so no group gets lost."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_right_{k}"])
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])
