"""Bootstrap weights in place, and the AUROC of all replicates by one ordered merge.

A weight is a function of (seed, draw, unit).  It is worked out where the unit's row is, so no draw is ever shuffled:

* 'poisson': inversion of a 32-bit hash, independent per unit;
* 'multinomial': exact resampling of N units out of N.  Units are numbered; N is cut into segments of powers of two, and the
  draws' totals per segment are counted once.  Inside a segment a seeded tree halves the total of a node down to each unit: the left
  half of n gets Binomial(n, 1/2), the sum of one binomial per binary digit of n.  The totals of a draw add up to N whoever asks.

For the AUROC, rows are put into one order by (cell, score).  A chunk of a range partition is packed into runs, one per cell: a few bytes a row
for its unit, its class and whether a new score starts.  A task takes the runs of millions of rows and a block of draws.  It works out the
weights of each unit once for all of its rows: nearby units share the walk down the tree, and a unit has a row in many cells.  A run turns
into pieces, each with vectors over the draws: weighted positives p, negatives q and concordant pairs u.  The first and the last score of a
run are pieces of their own, as other runs may hold the same score.  Pieces of a cell are merged in order; there are a few per run.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import join_groups, require_option
from tidemark.functions.ranked import changes, numbered
from tidemark.session import cut_lineage
from tidemark.shipping import ship

METHODS = ("poisson", "multinomial")
MULTIPLIER = 73244475
BALL = 1 << 28  # tags of the words that a ball uses; those of tree nodes are smaller
CHUNK_ROWS = 1 << 16
CHUNK_PIECES = 192
BLOCK = 64  # draws at a time, fewer where a task has very many units
RANGE_ROWS = 1 << 19  # rows that a task puts in order
GROUP_ROWS = 1 << 22  # rows whose weights a task works out together
TASKS_PER_CORE = 3
GROUP_BYTES = 64 << 20  # of their runs at most, of their weights at a time, and of the pieces made from them
STEP = 1 << 11  # rows that are counted at a time; their vectors fit into a core's cache
NODES = 512  # nodes of a tree whose vectors do


def poisson_cuts() -> list[float]:
    """Cumulative Poisson(1) probabilities of 0, 1, 2, ... up to the last that a double tells from 1."""
    cuts, term = [], math.exp(-1)
    total = term
    while total < 1.0 and (not cuts or total > cuts[-1]):
        cuts.append(total)
        term /= len(cuts)
        total += term
    return cuts


POISSON_CUTS = poisson_cuts()


def mix32(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 32-bit words."""
    return _mix_in_place(x.copy(), np.empty_like(x))


def _mix_in_place(x: np.ndarray, room: np.ndarray) -> np.ndarray:
    """`mix32` without new arrays; `room` has the shape of `x`."""
    for _ in range(2):
        np.right_shift(x, np.uint32(16), out=room)
        np.bitwise_xor(x, room, out=x)
        np.multiply(x, np.uint32(MULTIPLIER), out=x)
    np.right_shift(x, np.uint32(16), out=room)
    return np.bitwise_xor(x, room, out=x)


def _draw_states(n_boot: int, seed: int | None) -> np.ndarray:
    """One word per draw 0..n_boot."""
    start = mix32(np.array([seed], np.int64).astype(np.uint32)) if seed is not None else np.zeros(1, np.uint32)
    return mix32(np.arange(n_boot + 1, dtype=np.uint32) ^ start)


class PoissonWeights:
    """Weights of units told by the two halves of a 64-bit hash."""

    kind = np.uint64

    def __init__(self, n_boot: int):
        self.n_boot, self.state = n_boot, _draw_states(n_boot, None)
        cuts = [math.ceil(c * (1 << 32) - 0.5) for c in POISSON_CUTS]
        self.cuts = np.array([c for c in cuts if c < 1 << 32], np.uint32)

    def matrix(self, units: np.ndarray, a: int, b: int) -> np.ndarray:
        """Weights of the units (rows of two words) in draws a..b-1; draw 0 is the sample itself."""
        word = mix32(mix32(self.state[a:b][None, :] ^ units[:, 0].astype(np.uint32)[:, None]) ^ units[:, 1].astype(np.uint32)[:, None])
        out = np.zeros(word.shape, np.int32)
        for cut in self.cuts:
            out += word >= cut
        if a == 0:
            out[:, 0] = 1
        return out

    def ids(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """One number per unit."""
        return a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)

    def distinct(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units in order, and the place of each row's unit among them."""
        own, back = np.unique(ids, return_inverse=True)
        return own, back.astype(np.int32)

    def table(self, own: np.ndarray, a: int, b: int) -> np.ndarray:
        """Weights of the units from `distinct` in draws a..b-1, in as few bytes as they fit into."""
        out = np.empty((len(own), b - a), np.uint8)
        for start in range(0, len(own), NODES):
            part = own[start:start + NODES]
            out[start:start + NODES] = self.matrix(np.stack([part >> np.uint64(32), part & np.uint64((1 << 32) - 1)], axis=1), a, b)
        return out


def segments(n: int) -> list[tuple[int, int]]:
    """(exponent, first number) of the powers of two that 0..n-1 is cut into, largest first."""
    out, start = [], 0
    for k in range(n.bit_length() - 1, -1, -1):
        if n >> k & 1:
            out.append((k, start))
            start += 1 << k
    return out


def _place(high: int | np.ndarray, low: int | np.ndarray, n: int) -> np.ndarray:
    """Place in 0..n-1 of a ball with these two words, of which 53 bits count."""
    return np.floor(((np.asarray(high, np.int64) << 21) + (np.asarray(low, np.int64) >> 11)) / float(1 << 53) * n)


@cache
def _cuts(n: int) -> list[tuple[int, int]]:
    """(end, high) for each segment of 0..n-1 but the last: balls with a lower first word lie before the end, with a higher one behind it."""
    out = []
    for k, first in segments(n)[:-1]:
        end, least, most = first + (1 << k), 0, (1 << 32) - 1
        while least < most:  # the lowest first word that may lead behind the end
            middle = (least + most) // 2
            least, most = (least, middle) if _place(middle, (1 << 32) - 1, n) >= end else (middle + 1, most)
        out.append((end, least))
    return out


def _balls(n: int, state: np.uint32) -> np.ndarray:
    """How many of n balls of a draw fall into each segment of 0..n-1.  The second word of a ball is needed at the ends of segments only."""
    before = np.zeros(len(segments(n)) + 1, np.int64)
    before[-1] = n
    for start in range(0, n, 1 << 15):
        ball = mix32(np.arange(start, min(n, start + (1 << 15)), dtype=np.uint32) ^ state)
        high = mix32(ball ^ np.uint32(BALL))
        for i, (end, cut) in enumerate(_cuts(n)):
            below, upto = np.count_nonzero(high < np.uint32(cut)), np.count_nonzero(high <= np.uint32(cut))
            if below < upto:
                at = ball[high == np.uint32(cut)]
                below += np.count_nonzero(_place(cut, mix32(at ^ np.uint32(BALL + 1)), n) < end)
            before[i + 1] += below
    return np.diff(before)


def segment_totals(spark: SparkSession, n: int, n_boot: int, seed: int) -> np.ndarray:
    """Balls per segment (rows) and draw 0..n_boot (columns); at most 32 numbers per draw reach the driver."""
    if n & (n - 1) == 0:
        return np.full((1 if n else 0, n_boot + 1), n, np.int64)
    states = _draw_states(n_boot, seed)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_balls(n, states[r]).tolist() for r in reps], pa.list_(pa.int64()))],
                                             names=["rep", "totals"])

    out = np.zeros((len(segments(n)), n_boot + 1), np.int64)
    for rep, totals in ship(spark).range(1, n_boot + 1).withColumnRenamed("id", "rep").mapInArrow(run, "rep bigint, totals array<bigint>").collect():
        out[:, rep] = totals
    return out


@cache
def _half_cdf(digit: int) -> tuple[int, np.ndarray]:
    """First value and cumulative probabilities of Binomial(2^digit, 1/2) within eight deviations of its mean."""
    n = 1 << digit
    reach = min(n // 2, 4 * (1 << -(-digit // 2)) + 1)
    k = np.arange(n // 2 - reach, n // 2 + reach + 1)
    steps = np.log(n - k[:-1]) - np.log(k[:-1] + 1.0)
    log_p = np.append(0.0, np.cumsum(steps))
    p = np.exp(log_p - log_p[reach])
    return int(k[0]), np.cumsum(p / p.sum())


def _half_of(digit: int, word: np.ndarray) -> np.ndarray:
    """Binomial(2^digit, 1/2) from a word: counted bits up to 32, inversion beyond."""
    if digit <= 5:
        return np.bitwise_count(word & np.uint32((1 << (1 << digit)) - 1)).astype(np.int32)
    first, cdf = _half_cdf(digit)
    return (first + np.searchsorted(cdf, (word + 0.5) / float(1 << 32), "right")).astype(np.int32)


class TreeWeights:
    """Weights of numbered units, N out of N in every draw."""

    def __init__(self, n: int, n_boot: int, seed: int, totals: np.ndarray):
        self.n, self.n_boot, self.totals, self.state = n, n_boot, totals, _draw_states(n_boot, seed)
        self.kind = np.uint32 if n <= 1 << 32 else np.int64

    def matrix(self, units: np.ndarray, a: int, b: int) -> np.ndarray:
        """Weights of the units (first column: their numbers) in draws a..b-1; draw 0 is the sample itself."""
        own, back = np.unique(units[:, 0], return_inverse=True)
        return self.table(own, a, b).astype(np.int32)[back]

    def ids(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """One number per unit."""
        return a.astype(self.kind)

    def distinct(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units in order, and the place of each row's unit among them."""
        if self.n > 2 * len(ids):
            own, back = np.unique(ids, return_inverse=True)
            return own.astype(np.int64), back.astype(np.int32)
        there = np.zeros(self.n, bool)
        there[ids] = True
        return np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[ids]

    def table(self, own: np.ndarray, a: int, b: int) -> np.ndarray:
        """Weights of the units (numbers in order, each once) in draws a..b-1, in as few bytes as they fit into.

        A node is split once for all units below it.  The tree is walked depth first, some NODES nodes at a time.
        """
        out = np.zeros((len(own), b - a), np.uint8)
        for s, (k, first) in enumerate(segments(self.n)):
            start, stop = np.searchsorted(own, [first, first + (1 << k)])
            leaf = own[start:stop] - first
            todo = [(0, np.zeros(1, np.int64), self.totals[s, a:b][None, :].astype(np.int32), 0, len(leaf))] if len(leaf) else []
            while todo:
                level, node, count, lo, hi = todo.pop()
                if level == k:
                    if out.dtype == np.uint8 and count.max() > 255:
                        out = out.astype(np.int32)
                    out[start + lo:start + hi] = count
                elif len(node) > NODES:
                    half = len(node) // 2
                    cut = lo + int(np.searchsorted(leaf[lo:hi], node[half] << (k - level)))
                    todo += [(level, node[half:], count[half:], cut, hi), (level, node[:half], count[:half], lo, cut)]
                else:
                    left = self._left(node, count, k, level, a, b)
                    below = leaf[lo:hi] >> (k - level - 1)
                    child = below[np.append(True, below[1:] != below[:-1])]
                    if len(child) == 2 * len(node):
                        part = np.empty((len(child), b - a), np.int32)
                        part[::2] = left
                        np.subtract(count, left, out=part[1::2])
                    else:
                        at, right = np.searchsorted(node, child >> 1), (child & 1).astype(bool)
                        part = left[at]
                        part[right] = count[at[right]] - part[right]
                    todo.append((level + 1, child, part, lo, hi))
        if a == 0:
            out[:, 0] = 1
        return out

    def _left(self, node: np.ndarray, count: np.ndarray, k: int, level: int, a: int, b: int) -> np.ndarray:
        word = self.state[a:b][None, :] ^ node.astype(np.uint32)[:, None]
        mixed, room = np.empty_like(word), np.empty_like(word)
        _mix_in_place(word, room)
        left = np.zeros_like(count)
        for digit in range(int(count.max(initial=0)).bit_length()):
            tag = np.uint32(k << 12 | level << 6 | digit)
            bit = count >> digit & 1
            some = digit > 5 or digit > 1 and 8 * np.count_nonzero(bit) < bit.size
            if some:
                at = np.flatnonzero(bit)
                left.reshape(-1)[at] += _half_of(digit, mix32(word.reshape(-1)[at] ^ tag))
            else:  # common digits without picking: all words, masked
                _mix_in_place(np.bitwise_xor(word, tag, out=mixed), room)
                mixed &= np.multiply(bit.view(np.uint32), np.uint32((1 << (1 << digit)) - 1), out=room)
                left += np.bitwise_count(mixed) if digit else mixed.view(np.int32)
        return left


def key_words(seed: int, key: str) -> tuple[Column, Column]:
    """Two 32-bit words of the md5 of 'seed:key'."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return tuple(F.conv(F.substring(digest, i, 8), 16, 10).cast("bigint") for i in (1, 9))


def located(rows: DataFrame, key: str, n_boot: int, seed: int, method: str) -> tuple[DataFrame, PoissonWeights | TreeWeights]:
    """The rows with `_a` and `_b`, by which the weights know a unit, and the weights."""
    require_option(method, METHODS, "method")
    ship(rows.sparkSession)
    if method == "poisson":
        high, low = key_words(seed, key)
        return rows.withColumn("_a", high).withColumn("_b", low), PoissonWeights(n_boot)
    # What the rows are made from may be large (texts), so they are made once; the numbers are needed twice.
    rows = cut_lineage(rows)
    numbers = cut_lineage(numbered(rows.select(key).distinct(), key, "_a"))
    n = numbers.count()
    weights = TreeWeights(n, n_boot, seed, segment_totals(rows.sparkSession, n, n_boot, seed))
    return join_groups(rows, numbers, [key]).withColumn("_b", F.lit(0).cast("bigint")), weights


def replicate_weights(rows: DataFrame, key: str, n_boot: int, seed: int, method: str) -> DataFrame:
    """(key, weights): one array of the draws 0..n_boot per distinct key."""
    found, weights = located(rows.select(key).distinct(), key, n_boot, seed, method)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                w = weights.matrix(np.stack([np.asarray(part.column(i), np.int64) for i in (1, 2)], axis=1), 0, n_boot + 1)
                lists = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * (n_boot + 1), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "weights"])

    kind = rows.schema[key].dataType.simpleString()
    return found.select(key, "_a", "_b").mapInArrow(run, f"`{key}` {kind}, weights array<int>")


# --- ordered merge --------------------------------------------------------------------
def _runs(table: pa.Table, keys: Sequence[str], weights: PoissonWeights | TreeWeights) -> pa.RecordBatch:
    """A sorted chunk as one row per cell: bounds of its spans (first score, those between, last score) and, as bytes, its rows.

    `new` has a bit per row, set where a score starts.  Where all rows count once, `y` has a bit per row, else `p` and `q` their counts.
    """
    score, y, n, a, b = (np.asarray(table.column(c).combine_chunks()) for c in ("_score", "_y", "_n", "_a", "_b"))
    new = changes([table.column(k) for k in keys], len(score))
    cell = np.flatnonzero(new)
    new[1:] |= score[1:] != score[:-1]
    tie = np.flatnonzero(new)
    first = np.append(np.searchsorted(tie, cell), len(tie))  # first score of each cell
    ids, p, q, plain = weights.ids(a, b), n * y, n * (1 - y), (n == 1) & ((y == 0) | (y == 1))
    columns: list[list[bytes]] = [[] for _ in RUN]
    for i, (start, stop) in enumerate(zip(cell.tolist(), [*cell[1:].tolist(), len(score)], strict=True)):
        own = tie[first[i]:first[i + 1]]
        ends = own[[e for span in _spans(len(own)) for e in (span[0], span[1] - 1)]]
        once = bool(plain[start:stop].all())
        row = (score[ends], ids[start:stop], np.packbits(new[start:stop]), *((np.packbits(y[start:stop] > 0), b"", b"") if once else (b"", p[start:stop], q[start:stop])))
        for column, part in zip(columns, row, strict=True):
            column.append(part if isinstance(part, bytes) else part.tobytes())
    heads = [table.column(k).combine_chunks().take(pa.array(cell)) for k in keys]
    return pa.RecordBatch.from_arrays([*heads, *[pa.array(c, pa.binary()) for c in columns]], names=[*keys, *RUN])


RUN = ("bounds", "ids", "new", "y", "p", "q")


def _spans(scores: int) -> list[tuple[int, int]]:
    """The first score, those between, the last score."""
    return [s for s in ((0, 1), (1, scores - 1), (scores - 1, scores)) if s[0] < s[1]] if scores > 1 else [(0, 1)]


class _Rows:
    """Rows of a run as steps of about STEP rows: whole scores, with the negatives before and up to the score of each positive, or one score."""

    def __init__(self, units: np.ndarray, new: bytes, y: bytes, p: bytes, q: bytes):
        flags = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(units)).astype(bool) for b in (new, y) if b]
        counts = None if y else (np.frombuffer(p), np.frombuffer(q))
        classes = (flags[1], ~flags[1]) if y else (counts[0] != 0, counts[1] != 0)
        tie = np.append(np.flatnonzero(flags[0]), len(units))

        def portion(rows: slice) -> tuple:
            at = [np.flatnonzero(c[rows]) for c in classes]
            return *(units[rows][i] for i in at), counts and tuple(c[rows][i][:, None] for c, i in zip(counts, at, strict=True))

        self.steps = []  # (span, portions of (positives, negatives, counts of both), negatives before, negatives up to)
        for span, (s, e) in enumerate(_spans(len(tie) - 1)):
            while s < e:
                stop = max(s + 1, min(e, int(np.searchsorted(tie, tie[s] + STEP, "right")) - 1))
                start, end = int(tie[s]), int(tie[stop])
                if stop == s + 1:
                    self.steps.append((span, [portion(slice(i, min(end, i + STEP))) for i in range(start, end, STEP)], None, None))
                else:
                    upto = np.append(0, np.cumsum(classes[1][start:end]))
                    score = (np.cumsum(flags[0][start:end]) - 1)[classes[0][start:end]]
                    before, after = (upto[tie[s:stop + 1] - start][score + i].astype(np.int32) for i in (0, 1))
                    self.steps.append((span, [portion(slice(start, end))], before, None if (before == after).all() else after))
                s = stop

    def add(self, w: np.ndarray, p: np.ndarray, q: np.ndarray, u: np.ndarray) -> None:
        """Add up the vectors of the spans (rows of p, q and u) under the weights.

        Small weights of rows that count once are summed as 32-bit integers, which hold every sum of a step.
        """
        small = w.dtype == np.uint8 and STEP * int(w.max(initial=0)) < 1 << 16

        def weighted(units: np.ndarray, counts: np.ndarray | None) -> np.ndarray:
            found = w.take(units, axis=0)
            return found.astype(np.int32 if small else np.float64) if counts is None else found * counts

        def total(vectors: np.ndarray) -> np.ndarray:
            return np.add.reduce(vectors, axis=0, dtype=vectors.dtype)

        for span, portions, before, after in self.steps:
            if before is None:
                more_p, more_q = (sum(total(weighted(x[side], x[2] and x[2][side])).astype(np.float64) for x in portions) for side in (0, 1))
                pairs = more_p * more_q / 2
            else:
                pos, neg, counts = portions[0]
                wp, wn = weighted(pos, counts and counts[0]), weighted(neg, counts and counts[1])
                upto = np.zeros((len(wn) + 1, wn.shape[1]), wn.dtype)
                np.add.accumulate(wn, axis=0, dtype=wn.dtype, out=upto[1:])
                below = upto.take(before, axis=0)
                if after is not None:
                    below += upto.take(after, axis=0)
                below *= wp
                pairs = total(below) / (1 if after is None else 2)
                more_p, more_q = total(wp), upto[-1]
            u[span] += pairs + more_p * q[span]
            p[span] += more_p
            q[span] += more_q


def _counted(runs: pa.Table, keys: Sequence[str], weights: PoissonWeights | TreeWeights, a: int, b: int) -> Iterator[pa.RecordBatch]:
    """Pieces of runs in draws a..b-1, at most about CHUNK_PIECES in a batch."""
    of = {c: runs.column(c).to_pylist() for c in RUN}
    ids = [np.frombuffer(x, weights.kind) for x in of["ids"]]
    own, back = weights.distinct(np.concatenate(ids))
    ends = np.cumsum([len(x) for x in ids])
    rows = [_Rows(part, *(of[c][i] for c in RUN[2:])) for i, part in enumerate(np.split(back, ends[:-1]))]
    bounds = [np.frombuffer(x).reshape(-1, 2) for x in of["bounds"]]
    del of, ids, back
    first = np.append(0, np.cumsum([len(x) for x in bounds]))
    p, q, u = (np.zeros((first[-1], b - a)) for _ in range(3))
    width = max(8, min(BLOCK, GROUP_BYTES // len(own)))
    for c in range(a, b, width):
        w = weights.table(own, c, min(b, c + width))
        for part, s, e in zip(rows, first[:-1], first[1:], strict=True):
            part.add(w, *(v[s:e, c - a:c - a + width] for v in (p, q, u)))
    run, bound = np.repeat(np.arange(len(rows)), np.diff(first)), np.concatenate(bounds)
    heads = [runs.column(k).combine_chunks() for k in keys]
    for s in range(0, len(run), CHUNK_PIECES):
        some = slice(s, min(len(run), s + CHUNK_PIECES))
        size = some.stop - s
        lists = [pa.ListArray.from_arrays(np.arange(size + 1, dtype=np.int32) * (b - a), pa.array(v[some].ravel())) for v in (p, q, u)]
        yield pa.RecordBatch.from_arrays([*[h.take(pa.array(run[some])) for h in heads], pa.array(np.full(size, a, np.int32)), pa.array(bound[some, 0]), pa.array(bound[some, 1]), *lists],
                                         names=[*keys, "_first", "lo", "hi", "p", "q", "u"])


def _pieces(table: pa.Table, keys: Sequence[str], weights: PoissonWeights | TreeWeights) -> Iterator[pa.RecordBatch]:
    """Pieces of a sorted chunk in all draws."""
    yield from _counted(pa.Table.from_batches([_runs(table, keys, weights)]), keys, weights, 0, weights.n_boot + 1)


def _merged(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of (keys, first draw, score) to one row per cell and draw; pieces of one score are added first."""
    current: pa.RecordBatch | None = None
    p = q = u = tie = None

    def settle() -> None:
        nonlocal tie, p, q, u
        if tie is not None:
            _, tp, tq = tie
            u, p, q, tie = u + tp * (q + tq / 2), p + tp, q + tq, None

    def finished() -> pa.RecordBatch:
        settle()
        pairs = p * q
        auroc = np.divide(u, pairs, out=np.zeros(len(p)), where=pairs > 0)
        head = [current.column(k).take(pa.array(np.zeros(len(p), np.int64))) for k in keys]
        rep = current.column("_first")[0].as_py() + np.arange(len(p), dtype=np.int32)
        return pa.RecordBatch.from_arrays([*head, pa.array(rep), pa.array(auroc, mask=pairs <= 0)], names=[*keys, "rep", "auroc"])

    for batch in batches:
        if not batch.num_rows:
            continue
        low, high = (np.asarray(batch.column(c)) for c in ("lo", "hi"))
        values = [np.asarray(batch.column(c).flatten()) for c in ("p", "q", "u")]
        ends = np.append(0, np.cumsum(batch.column("p").value_lengths()))
        cell = [*keys, "_first"]
        new = changes([pa.chunked_array([batch.column(k)]) for k in cell], batch.num_rows)
        for i in range(batch.num_rows):
            if new[i] and (i or current is None or any(current.column(k)[0] != batch.column(k)[0] for k in cell)):
                if current is not None:
                    yield finished()
                current = batch.slice(i, 1)
                p, q, u = (np.zeros(ends[i + 1] - ends[i]) for _ in range(3))
                tie = None
            bp, bq, bu = (v[ends[i]:ends[i + 1]] for v in values)
            if low[i] == high[i]:
                if tie is not None and tie[0] == low[i]:
                    tie = (tie[0], tie[1] + bp, tie[2] + bq)
                    continue
                settle()
                tie = (low[i], bp, bq)
            else:
                settle()
                u, p, q = u + bu + bp * q, p + bp, q + bq
    if current is not None:
        yield finished()


def replicate_auroc(rows: DataFrame, keys: Sequence[str], key: str, n_boot: int, seed: int, method: str, score: str = "score", y: str = "y",
                    n: str = "n") -> DataFrame:
    """(rep, keys, auroc) of the draws 0..n_boot; a row counts `n` times the weight of its `key`.

    Three exchanges: rows by range; their runs of a few bytes a row, once for each block of draws; a few pieces per run, each with vectors over
    the draws.
    """
    keys = list(keys)
    spark = rows.sparkSession
    plain = rows.select(*dict.fromkeys([*keys, key]), F.col(score).cast("double").alias("_score"), F.col(y).cast("double").alias("_y"), F.col(n).cast("bigint").alias("_n"))
    found, weights = located(plain.where(~F.isnan("_score")), key, n_boot, seed, method)
    # A range partitioning reads its input twice, so what comes before runs once.
    ready = cut_lineage(found.select(*keys, "_score", "_y", "_n", "_a", "_b"))
    order = [*keys, "_score", "_a", "_b"]  # units split a score with very many rows
    kinds = ", ".join(f"`{k}` {ready.schema[k].dataType.simpleString()}" for k in keys)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK_ROWS:
                yield _runs(pa.Table.from_batches(held), keys, weights)
                held, size = [], 0
        if size:
            yield _runs(pa.Table.from_batches(held), keys, weights)

    # Work grows with rows x draws, not with bytes: a given number of ranges is not joined into fewer by their size.  A task counts the runs of
    # neighbouring ranges, as many as share the work on weights; where these are fewer than the cores can take, each is one of some draws.
    total = ready.count()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ROWS))
    groups = max(1, -(-total // GROUP_ROWS))
    blocks = min(-(-TASKS_PER_CORE * spark.sparkContext.defaultParallelism // groups), -(-(n_boot + 1) // BLOCK))
    starts = [i * (n_boot + 1) // blocks for i in range(blocks + 1)]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, size, spans = [], None, 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                run = batch.slice(i, 1)
                own = run.column("_block")[0].as_py()
                if held and (own != block or size > GROUP_BYTES or 24 * spans * (starts[block + 1] - starts[block]) > GROUP_BYTES):
                    yield from _counted(pa.Table.from_batches(held), keys, weights, starts[block], starts[block + 1])
                    held, size, spans = [], 0, 0
                held.append(run)
                block, size, spans = own, size + sum(len(run.column(c)[0].as_buffer()) for c in RUN), spans + 3
        if held:
            yield from _counted(pa.Table.from_batches(held), keys, weights, starts[block], starts[block + 1])

    runs = ready.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(cut, f"{kinds}, {', '.join(f'{c} binary' for c in RUN)}")
    group = F.least(F.floor(F.spark_partition_id() * F.lit(groups) / F.lit(ranges)), F.lit(groups - 1)).cast("int")
    dealt = runs.withColumn("_group", group).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.repartitionById(groups * blocks, F.col("_group") * blocks + F.col("_block")).drop("_group")
    pieces = dealt.mapInArrow(count, f"{kinds}, _first int, lo double, hi double, p array<double>, q array<double>, u array<double>")
    ordered = pieces.repartition(*keys, "_first").sortWithinPartitions(*keys, "_first", "lo", "hi")
    return ordered.mapInArrow(lambda batches: _merged(batches, keys), f"{kinds}, rep int, auroc double")
