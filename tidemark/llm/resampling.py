"""Target-distribution importance resampling over hashed word runs (operator 12).

Words are maximal runs of letters a-z, digits and characters beyond ASCII, after A-Z are lower-cased.  A portion of texts is
scanned by an Aho-Corasick automaton over its distinct words, each bounded by a delimiter on both sides, so exactly one entry
ends behind every word of the text.  An entry carries the CRC-32 and the byte length of its word; the CRC of a run of words is
composed from the payloads of its words (shifting a CRC by n bytes is a linear map, applied by tables for powers of two), never
from the characters again.  A feature's bucket is its CRC modulo the number of buckets.

A bucket's gain is 1000 times the log ratio of its share in the target to that in the source, one added to each count, rounded
down.  A document weighs the sum of the gains of its features; with Gumbel noise from a digest of its identifier added, the highest
scores are a sample without replacement in proportion to exp(weight / 1000) (after Xie et al., DSIR).

Scale: the automaton lives as long as its portion (4 MB of text); words of over LONG bytes are not put into it, their CRC is taken
from their bytes.  Counts leave a task once, as at most one row per bucket, and the gains are BUCKETS numbers, so what the
driver and the functions hold does not grow.  Texts are scanned once and never shuffled; what is written is two bytes per feature.  Ranks come from a range partitioning by
(score, identifier, ...), whose last key tells repeated rows apart, and from the number of rows in earlier ranges.

Defined cases: null and empty texts have no feature, weight 0 and no rank; a null identifier is drawn as an empty one and comes last among equal
scores; a repeated row is a further document; without target texts every count of the target is 0; an empty table gives no rows; columns beside
those named are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrays import flat, portions
from tidemark.session import cut_lineage

BUCKETS = 10_000
LONG = 255
#: Delimiters to spaces, A-Z to a-z, other bytes as they are.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_LONG_WORDS = re.compile(rb"[^ ]{%d,}" % (LONG + 1))


@cache
def _shifts() -> np.ndarray:
    """For each power of two: the map of a CRC to that followed by so many zero bytes, as tables of its four bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
    units = np.arange(256, dtype=np.uint32)
    first = np.stack([step, *(units << np.uint32(8 * (j - 1)) for j in (1, 2, 3))])
    tables = [first]
    for _ in range(30):
        tables.append(_apply(tables[-1], tables[-1]))
    return np.stack(tables)


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = table[0][crc & 255]
    for j in (1, 2, 3):
        out = out ^ table[j][crc >> np.uint32(8 * j) & 255]
    return out


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two byte strings one after the other; `length` is that of the second."""
    out = first.astype(np.uint32)
    for k in range(int(length.max(initial=0)).bit_length()):
        some = (length >> k & 1).astype(bool)
        out[some] = _apply(_shifts()[k], out[some])
    return out ^ second


def scan(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC and byte length of every word, and where each text's words begin (one more than texts)."""
    bodies = [t.translate(FOLD) for t in pc.fill_null(texts, "").cast(pa.large_binary()).to_pylist()]
    whole = b" " + b" ".join(bodies) + b" "
    starts = np.cumsum([0, *(len(b) + 1 for b in bodies)])
    found = ahocorasick.Automaton()
    for word in set(whole.split()):
        if len(word) <= LONG:
            found.add_word(f" {word.decode('latin-1')} ", zlib.crc32(word) << 16 | len(word))
    hits = np.zeros((0, 2), np.int64)
    if len(found):
        found.make_automaton()
        hits = np.fromiter(chain.from_iterable(found.iter(whole.decode("latin-1"))), np.int64).reshape(-1, 2)
    end, crc, length = hits[:, 0], (hits[:, 1] >> 16).astype(np.uint32), hits[:, 1] & 0xFFFF
    rest = [(m.end(), zlib.crc32(m[0]), len(m[0])) for m in _LONG_WORDS.finditer(whole)]
    if rest:
        end = np.append(end, [r[0] for r in rest])
        order = np.argsort(end)
        end = end[order]
        crc = np.append(crc, np.array([r[1] for r in rest], np.uint32))[order]
        length = np.append(length, [r[2] for r in rest])[order]
    # A word's last delimiter is the first place of the next text at the earliest.
    return crc, length, np.searchsorted(end, starts, "right")


def buckets_of(texts: pa.Array, buckets: int = BUCKETS, longest: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every run of 1 to `longest` words, and the number of words of each text."""
    crc, length, first = scan(texts)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    blank, one = np.uint32(zlib.crc32(b" ")), np.ones(len(crc), np.int64)
    run, bucket, of = crc, [crc % np.uint32(buckets)], [owner]
    for n in range(2, longest + 1):
        run = run[:-1]
        spaced = joined_crc(run, blank, one[:len(run)])
        run = joined_crc(spaced, crc[n - 1:], length[n - 1:])
        inside = owner[:len(run)] == owner[n - 1:]
        bucket.append(run[inside] % np.uint32(buckets))
        of.append(owner[:len(run)][inside])
    return np.concatenate(bucket).astype(np.int64), np.concatenate(of), np.diff(first)


def hashed(docs: DataFrame, ident: str = "doc_id", text: str = "text", buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """doc_id, n_words and the buckets of all features of every text, packed as unsigned integers."""
    kind = _packing(buckets)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, batch.schema.names[1]):
                bucket, owner, words = buckets_of(part.column(1), buckets, longest)
                order = np.argsort(owner, kind="stable")
                data = bucket[order].astype(kind)
                ends = np.searchsorted(owner[order], np.arange(len(words) + 1)) * data.itemsize
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.astype(np.int64)), packed.cast(pa.binary())], names=["doc_id", "n_words", "features"])

    return docs.select(F.col(ident).cast("bigint").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id bigint, n_words bigint, features binary")


def _packing(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def _unpacked(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a portion of documents, and where each document's begin."""
    data, where = flat(column)
    kind = _packing(buckets)
    return np.frombuffer(data.tobytes(), kind), where // np.dtype(kind).itemsize


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n of all features of a table of `hashed`."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in portions(batch, "features"):
                total += np.bincount(_unpacked(part.column(0), buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return features.select("features").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def counted(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The counts as one array; there are as many numbers as buckets."""
    out = np.zeros(buckets, np.int64)
    for row in counts.collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of every bucket, in thousandths of a nat, rounded down."""
    n, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_source + n) / ((s + 1.0) * (all_target + n))))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document of a table of `hashed`."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "features"):
                bucket, first = _unpacked(part.column(2), len(gain))
                total = np.append(0, np.cumsum(gain[bucket]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(first)), pa.array(total[first[1:]] - total[first[:-1]])],
                                                 names=["doc_id", "n_words", "n_features", "weight"])

    return features.select("doc_id", "n_words", "features").mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(ident: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of the SHA-256 of 'seed:identifier'."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with `rank` 1, 2, 3, ... in the given order, from a range partitioning; the windows see one row per range."""
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    order = [*order, F.col("_place")]
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    # Written, so that a row has one number however often it is read: partition in the upper bits, place in the lower 33.
    dealt = cut_lineage(dealt.drop("_place")).withColumn("_range", F.shiftright("_row", 33))
    running = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(F.col("_range").alias("_of"), (F.sum("_n").over(running) - F.col("_n")).alias("_before"))
    inside = F.col("_row") - F.shiftleft(F.col("_range"), 33)
    return dealt.join(before, F.col("_range") == F.col("_of")).withColumn("rank", F.col("_before") + inside + 1).drop("_row", "_range", "_of", "_before")


def resample(docs: DataFrame, target: DataFrame, seed: int = 2024, least: int = 20, percent: int = 10, buckets: int = BUCKETS,
             longest: int = 1, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank: of the documents with `least` words, `percent` of a hundred are drawn and ranked."""
    features = cut_lineage(hashed(docs, ident, text, buckets, longest))
    aimed = hashed(target.select(F.lit(0).alias("_id"), F.col("text")), "_id", "text", buckets, longest)
    gain = gains(counted(bucket_counts(features, buckets), buckets), counted(bucket_counts(aimed, buckets), buckets))
    scored = cut_lineage(weights(features, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    able = F.col("n_words") >= least
    drawn = scored.where(able).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    best = ranked(scored.where(able), order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return best.select(*columns).unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("bigint")).select(*columns))
