"""Near-duplicate groups from fast similarity sketches (operator 4).

Sketch: round i throws every shingle into a hashed bin, later rounds only lower the priority of what they
place, and round `bins + j` throws everything into bin j, so every coordinate is filled; a document
stops after the round that fills its last bin (on average n log n throws, after Dahlgaard, Knudsen and Thorup).
Two documents agree in a coordinate with probability equal to the Jaccard likeness of their sets.

Search: 32 bands of 4 coordinates.  A pair at likeness 0.75 shares no band with probability
(1 - 0.75^4)^32 < 6e-6.  Every candidate link is confirmed on the full sets (64-bit hashes of all shingles).

Scale: equal sets are one class before anything else.  In a band bucket every member is first confirmed against the hub
only, the member with the largest buckets over all bands, so a bucket of m near copies costs m - 1 confirmations.
What is then still in different components is compared with each other only where a link is possible given what both
share with the hub h.  A link of x and y needs |x & y| >= 3/7 (|x| + |y|), so either min(|x & h|, |y & h|) reaches that, or x and y
share shingles outside h, at least .75 |x| - |x & h| of them; the latter meet on the first shingles outside h in hash order
(prefix and position filter).  Both tests are exact: no link between different sets that share a bucket is lost, and no group is paired with
itself.  Components grow by label propagation with pointer jumping over written tables.  Links never leave the
executors.

Defined cases: null, empty and blank texts have no shingles and stand alone; texts of one to four words have one
shingle, the whole sequence; very long texts are read whole; a repeated row is its own copy; rows without identifier come after all others: one
stays only where its group has no identifier, and the component of such a group is null; columns beside identifier and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import mix, portions, words
from tidemark.session import cut_lineage

WIDTH = 5
BINS, ROWS = 128, 4
NUMBER, OUT_OF = 75, 100  # linked at NUMBER / OUT_OF of the union or more
HUB_SPREAD = 500  # members confirmed against one copy of their hub
SET_BYTES = 1 << 20  # text whose shingles a task holds at once: some forty times that in temporary arrays
HUB_COPIES = 32  # tasks that share the members of one hub
NAMELESS = 1 << 62  # keys of rows without identifier, above every identifier
SIGNATURES = "doc_id bigint, n bigint, set_a bigint, set_b bigint, bands array<bigint>"
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending within a text, and where each text's begin."""
    code, first = words(column)
    count = np.diff(first)
    n = len(code)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rest = max(0, n - k)
        rolled[:rest] = mix(rolled[:rest] * _GOLD + code[k:] + np.uint64(k + 1))
        if k + 1 < width:  # texts that end here keep the whole sequence
            short = first[:-1][count == k + 1]
            whole = rolled[short].copy()
            rolled[short] = whole
            kept = (short, whole) if k == 0 else (np.append(kept[0], short), np.append(kept[1], whole))
    if width > 1:
        rolled[kept[0]] = kept[1]
    sizes = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    texts = np.repeat(np.arange(len(count)), sizes)
    ends = np.cumsum(sizes)
    at = np.arange(len(texts)) - np.repeat(ends - sizes, sizes) + first[:-1][texts]
    values = rolled[at]
    for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (texts[1:] != texts[:-1])
    values, texts = values[fresh], texts[fresh]
    return values, np.searchsorted(texts, np.arange(len(count) + 1))


def sketches(values: np.ndarray, first: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One row of `bins` coordinates per text; rows of texts without shingles stay at the maximum."""
    texts = len(first) - 1
    out = np.full((texts, bins), _EMPTY, np.uint64)
    size = np.diff(first)
    owner = np.repeat(np.arange(texts), size)
    live = size > 0
    shift = np.uint64(64 - bins.bit_length() + 1)
    for i in range(2 * bins):
        if not live.any():
            break
        if i:
            keep = live[owner]
            if not keep.all():
                owner, values = owner[keep], values[keep]
        thrown = mix(values + np.uint64((i + 1) * int(_GOLD) & (1 << 64) - 1))
        level = np.uint64(i) << np.uint64(48) | thrown & np.uint64((1 << 48) - 1)
        bin_of = (thrown >> shift).astype(np.int64) if i < bins else np.full(len(owner), i - bins)
        np.minimum.at(out.reshape(-1), owner * bins + bin_of, level)
        live[live] = (out[live] == _EMPTY).any(axis=1)
    return out


def bands_of(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Band keys of each sketch row; the band number is part of the key."""
    texts, bins = sketch.shape
    cut = sketch.reshape(texts, bins // rows, rows)
    key = np.broadcast_to(np.arange(bins // rows, dtype=np.uint64), (texts, bins // rows)).copy()
    for k in range(rows):
        key = mix(key * _GOLD + cut[:, :, k])
    return key


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in portions(batch, batch.schema.names[1], SET_BYTES):
            values, first = shingle_sets(part.column(1))
            size = np.diff(first)
            total = np.zeros((2, len(values) + 1), np.uint64)
            np.cumsum(mix(values ^ _GOLD), out=total[0, 1:])
            np.cumsum(mix(values + _GOLD), out=total[1, 1:])
            a, b = (t[first[1:]] - t[first[:-1]] for t in total)
            keys = bands_of(sketches(values, first)).view(np.int64)
            rows = np.where(size > 0, keys.shape[1], 0)
            bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(rows)), pa.int32()),
                                             pa.array(keys[size > 0].reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), bands],
                                             names=["doc_id", "n", "set_a", "set_b", "bands"])


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members against their hub on full sets; rows come ordered by (hub, part), the hub itself first.

    `prefix` holds the member's first shingles outside the hub, as many as can decide a link with a third set.
    """
    current, hub_set = None, None
    for batch in batches:
        for part in portions(batch, "text", SET_BYTES):
            found: list[tuple] = []
            values, first = shingle_sets(part.column("text"))
            for i, (hub, member) in enumerate(zip(part.column("hub").to_pylist(), part.column("member").to_pylist(), strict=True)):
                own = values[first[i]:first[i + 1]]
                if member == hub:
                    current, hub_set = hub, own.copy()  # not the whole portion
                elif hub == current:
                    at = np.searchsorted(hub_set, own)
                    at[at == len(hub_set)] = 0
                    inside = hub_set[at] == own
                    both = int(inside.sum())
                    least = max(1, -(-NUMBER * len(own) // OUT_OF) - both)
                    found.append((hub, member, len(hub_set), len(own), both, own[~inside][:max(0, len(own) - both - least + 1)].view(np.int64)))
            columns = list(zip(*found, strict=True)) if found else [[]] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.list_(pa.int64()))],
                                             names=["hub", "member", "hub_n", "n", "both", "prefix"])


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(hub, member) pairs with the sizes of both sets and of what they share.

    A hub with many members is copied once per HUB_SPREAD of them, so no task gets all members of a hub.
    """
    many = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_SPREAD).alias("parts"))
    member = pairs.join(many, "hub").select(
        "hub", "member", F.pmod(F.xxhash64("member"), F.col("parts")).alias("part"))
    hub = many.select("hub", F.col("hub").alias("member"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    rows = member.unionByName(hub).join(texts.select(F.col("doc_id").alias("member"), "text"), "member")
    ordered = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("member") != F.col("hub"))
    return ordered.select("hub", "member", "text").mapInArrow(
        _compare, "hub bigint, member bigint, hub_n bigint, n bigint, both bigint, prefix array<bigint>")


def linked(checked: DataFrame) -> DataFrame:
    """(a, b) of the compared pairs that are links."""
    alike = F.col("both") * OUT_OF >= (F.col("hub_n") + F.col("n") - F.col("both")) * NUMBER
    return checked.where(alike).select(F.col("hub").alias("a"), F.col("member").alias("b"))


def possible_pairs(checked: DataFrame, label: DataFrame) -> DataFrame:
    """(hub, member) pairs, smaller first, of sets that met the same hub, lie in different components and may be linked."""
    hubs = checked.groupBy("hub").agg(F.first("hub_n").alias("n"))
    group = checked.select("hub", "member", "n", "both", "prefix").unionByName(
        hubs.select("hub", F.col("hub").alias("member"), "n", F.col("n").alias("both"), F.array().cast("array<bigint>").alias("prefix")))
    placed = group.join(label.withColumnRenamed("node", "member"), "member", "left").withColumn("component", F.coalesce("component", "member"))
    parts = placed.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("m"))
    mixed = parts.groupBy("hub").agg(F.max_by("component", F.struct("m", "component")).alias("major"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    # One row per hub, copied, so that a hub with most of the members meets them in many tasks.
    copied = mixed.select("hub", "major", F.explode(F.sequence(F.lit(0), F.lit(HUB_COPIES - 1))).alias("part"))
    open_rows = cut_lineage(placed.withColumn("part", F.pmod(F.xxhash64("member"), F.lit(HUB_COPIES)).cast("int")).join(copied, ["hub", "part"]).drop("part"))
    minor = open_rows.where("component <> major").select(
        "hub", F.col("member").alias("x"), F.col("n").alias("k"), F.col("both").alias("b"), F.col("component").alias("c"), F.col("prefix").alias("p"))
    apart = (F.col("component") != F.col("c")) & ((F.col("component") == F.col("major")) | (F.col("member") < F.col("x")))
    fits = (F.col("n") * OUT_OF >= F.col("k") * NUMBER) & (F.col("k") * OUT_OF >= F.col("n") * NUMBER)

    # By the hub alone: the partner's size lies in a range, met by classes of sizes 5 % apart.
    reach = NUMBER + OUT_OF
    step = lambda n: F.floor(F.log(n) / F.log(F.lit(1.05)))
    low = F.col("k") * NUMBER / OUT_OF
    high = F.least(F.col("b") * reach / NUMBER - F.col("k"), F.col("k") * OUT_OF / NUMBER)
    ranged = minor.where((F.col("b") > 0) & (high >= low)).withColumn("size", F.explode(F.sequence(step(low), step(high))))
    enough = F.least("b", "both") * reach >= (F.col("k") + F.col("n")) * NUMBER
    sized = open_rows.withColumn("size", step(F.col("n")))
    inside = sized.join(ranged, ["hub", "size"]).where(apart & fits & enough)
    # Outside the hub: a shared shingle of both prefixes.  If it is the first shared one, no more than what follows it in either set
    # is shared besides; later ones have less after them, so testing every one keeps exactly the pairs whose first one passes.
    here = open_rows.select("hub", "member", "n", "both", "component", "major", F.posexplode("prefix").alias("i", "s"))
    there = minor.select("hub", "x", "k", "b", "c", F.posexplode("p").alias("j", "s"))
    room = F.least("both", "b") + F.least(F.col("n") - F.col("both") - F.col("i"), F.col("k") - F.col("b") - F.col("j"))
    outside = here.join(there, ["hub", "s"]).where(apart & fits & (room * reach >= (F.col("k") + F.col("n")) * NUMBER))
    pair = (F.least("member", "x").alias("hub"), F.greatest("member", "x").alias("member"))
    known = checked.select(F.least("hub", "member").alias("hub"), F.greatest("hub", "member").alias("member"))
    return inside.select(*pair).unionByName(outside.select(*pair)).distinct().join(known, ["hub", "member"], "left_anti")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the links (a, b)."""
    both = cut_lineage(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    label = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                        .select("node", F.least("node", "m").alias("component")))
    while True:
        far = label.select(F.col("node").alias("b"), "component")
        heard = both.join(far, "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        best = label.join(heard, "node").select("node", F.col("component").alias("was"), F.least("component", "heard").alias("mine"))
        root = label.select(F.col("node").alias("mine"), F.col("component").alias("up"))
        step = cut_lineage(best.join(root, "mine").select("node", "was", F.least("mine", "up").alias("component")))
        label = step.select("node", "component")
        if step.where("component <> was").isEmpty():
            return label


def near_groups(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (the smallest identifier of its component)."""
    docs = docs.select(F.col(ident).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    # Written, so that a row without identifier has one key however often it is read.
    nameless = cut_lineage(docs.where("doc_id is null").withColumn("doc_id", F.lit(NAMELESS) + F.monotonically_increasing_id()))
    docs = docs.where("doc_id is not null").unionByName(nameless)
    signed = cut_lineage(docs.mapInArrow(_sign, SIGNATURES))
    classes = cut_lineage(signed.where("n > 0").groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    rows = classes.select(F.explode("bands").alias("bucket"), "rep")
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = cut_lineage(rows.join(shared, "bucket"))
    weight = members.groupBy("rep").agg(F.sum("m").alias("weight"))
    hubs = members.join(weight, "rep").groupBy("bucket").agg(F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("hub"))
    direct = cut_lineage(members.join(hubs, "bucket").where("rep <> hub").select("hub", F.col("rep").alias("member")).distinct())

    candidates = weight.select(F.col("rep").alias("doc_id"))
    texts = cut_lineage(docs.join(candidates, "doc_id", "left_semi"))
    checked = cut_lineage(compared(direct, texts))
    links = linked(checked)
    label = components(links)
    more = cut_lineage(linked(compared(cut_lineage(possible_pairs(checked, label)), texts)))
    if not more.isEmpty():
        label = components(links.unionByName(more))

    grouped = classes.select("set_a", "set_b", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    grouped = grouped.select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    named = lambda key: F.when(key < NAMELESS, key)
    return signed.join(grouped, ["set_a", "set_b"], "left").select(
        named(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), named(F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of every near-duplicate group, all columns; rows without an identifier cannot be told apart and are kept."""
    gone = near_groups(docs, ident, text).where("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone_id"))
    return docs.join(gone, F.col(ident) == F.col("_gone_id"), "left_anti")
