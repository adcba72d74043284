"""Document fingerprints by winnowing (operator 2).

Symbols are words, and single characters of scripts that are written without spaces.  Every run of GRAM symbols has a
polynomial hash, rolled by doubling: the hash of 2k symbols comes from those of its two halves.  Of every WINDOW hashes in a row
the smallest is chosen, the rightmost of equal ones, and kept with its position.  Two texts that share
GRAM + WINDOW - 1 symbols in a row share a fingerprint, wherever it stands.

Only DataFrame functions.  Scale: the fingerprint of a text is a column expression, no shuffle.  Window minima also double
(2, 4, 8 hashes), so the work per symbol does not depend on the window.  The next document by descending identifier
comes from one exchange of the texts into ranges of identifiers: range bounds are identifiers themselves, at most
MAX_RANGES of them, and the largest identifier of a range is also sent to the next higher one.

Defined cases: null text counts as empty; an empty text has an empty fingerprint and likeness 1 to another empty one, 0 to
any other; a text of fewer than GRAM symbols has the hash of the whole; a text of fewer than WINDOW grams gives their smallest;
equal texts have equal fingerprints; rows without identifier come after all others; of rows that share an
identifier each is followed by one of its equals or by the next identifier, ordered by text; a single document is followed
by itself; columns beside identifier and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM, WINDOW = 4, 8  # powers of two
BASE, PRIME = 1_000_003, (1 << 31) - 1
PLACES = 1 << 32  # a selection is hash * PLACES + (PLACES - 1 - position): the smallest is the rightmost smallest
RANGE_ROWS = 256
MAX_RANGES = 1 << 14
SYMBOL = r"[^\s\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]+|\S"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _doubled(values: Column, times: int, join: Callable[[Column, Column, int], Column]) -> Column:
    """values[i] joined with values[i + 1], then pairs with pairs and so on, `times` values in the end."""
    def step(width: int) -> Callable[[Column], Column]:
        return lambda v: F.zip_with(v, F.slice(v, width + 1, F.greatest(F.size(v), F.lit(1))), lambda a, b: join(a, b, width))

    for power in range(times.bit_length() - 1):
        values = let(values, step(1 << power))
    return values


def _short_hash(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 33)


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Selections of a text in order of the windows they were chosen in, as hash * PLACES + (PLACES - 1 - position)."""
    def of(symbols: Column) -> Column:
        n = F.size(symbols)
        codes = F.transform(symbols, _short_hash)
        rolled = _doubled(codes, gram, lambda a, b, w: (a * F.lit(pow(BASE, w, PRIME)) + b) % F.lit(PRIME))
        whole = F.array(_short_hash(F.array_join(symbols, " ")))
        grams = F.when(n >= gram, F.slice(rolled, 1, F.greatest(n - (gram - 1), F.lit(1)))).when(n > 0, whole)
        placed = F.transform(F.coalesce(grams, F.array().cast("array<bigint>")), lambda h, i: h * F.lit(PLACES) + (F.lit(PLACES - 1) - i))
        # Beyond the end `least` passes over the missing value.
        lowest = _doubled(placed, window, lambda a, b, w: F.least(a, b))
        return F.array_distinct(F.slice(lowest, 1, F.greatest(n - (gram + window - 2), F.lit(1))))

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SYMBOL), F.lit(0)), of)


def hashes(selected: Column) -> Column:
    """Distinct hashes of a fingerprint, positions left out."""
    return F.array_distinct(F.transform(selected, lambda s: F.shiftright(s, 32)))


def positions(selected: Column) -> Column:
    """Positions (symbols from 0) of a fingerprint's hashes."""
    return F.transform(selected, lambda s: F.lit(PLACES - 1) - s.bitwiseAND(F.lit(PLACES - 1)))


def as_text(selected: Column) -> Column:
    """hash:position of every selection, hashes in hex."""
    return F.array_join(F.transform(selected, lambda s: F.concat(
        F.hex(F.shiftright(s, 32)), F.lit(":"), (F.lit(PLACES - 1) - s.bitwiseAND(F.lit(PLACES - 1))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Shared part of two hash sets; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every > 0, both / every).otherwise(F.lit(1.0))


def _range_tops(docs: DataFrame) -> list[int]:
    """Largest identifiers of about equal ranges, ascending."""
    n = docs.count()
    ranges = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    found = docs.agg(F.approx_percentile("doc_id", [(i + 1) / ranges for i in range(ranges)], 10 * max(ranges, 1000)).alias("tops"),
                     F.max("doc_id").alias("top")).first()
    return sorted({*(found["tops"] or []), *([] if found["top"] is None else [found["top"]])}) or [0]


def with_next(docs: DataFrame, made: dict[str, Column]) -> DataFrame:
    """docs (doc_id, text) with the columns `made`, and next_<name> of the next document by descending identifier
    for the text and each of them; the first document follows the last.
    """
    tops = _range_tops(docs)
    table = F.split(F.lit(",".join(map(str, tops))), ",").cast("array<bigint>")
    ident = F.coalesce("doc_id", F.lit(-(1 << 63)))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(tops).bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= len(tops)) & (F.try_element_at(table, at + step) < ident), at + step).otherwise(at))
    place = F.least(below, F.lit(len(tops) - 1))
    own = F.struct(F.col("place").alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(((F.col("place") + 1) % len(tops)).alias("range"), F.lit(True).alias("guest"))
    is_top = F.element_at(table, F.col("place") + 1) == ident
    dealt = docs.withColumn("place", place).withColumn("to", F.explode(F.when(is_top, F.array(own, guest)).otherwise(F.array(own))))
    dealt = dealt.select("doc_id", "text", "to.range", "to.guest").repartition("range")
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    return (
        dealt.withColumns(made)
        .withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", *made)})
        .where("not guest").drop("range", "guest")
    )


def edited_fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third of code points replaced by as many from the start of the next document.
    """
    docs = docs.select(F.col(ident).cast("bigint").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    paired = with_next(docs, {"chosen": winnow(F.col("text"))})
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars") - third), F.substr("next_text", F.lit(1), third))
    return (
        paired.withColumn("n_chars", F.char_length("text"))
        .withColumn("edited", edited)
        .withColumn("edited_chosen", winnow(F.col("edited")))
        .withColumns({"a": hashes(F.col("chosen")), "b": hashes(F.col("edited_chosen")), "c": hashes(F.col("next_chosen"))})
        .select("doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                as_text(F.col("chosen")).alias("fingerprint"), as_text(F.col("edited_chosen")).alias("edited_fingerprint"),
                likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))
    )
