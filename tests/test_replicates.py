"""Bootstrap weights and the ordered merge against direct computation."""

import copy

import numpy as np
import pyarrow as pa
import pytest

from tidemark.functions import replicates as R
from tidemark.functions.ranked import numbered
from tidemark.operators import inference as I

PAIRS = [(level, method) for level in I.LEVELS for method in R.METHODS]


def weighted_auroc(y, score, w):
    """Share of concordant pairs, ties half, by all pairs."""
    p, q = (w * y)[:, None], (w * (1 - y))[None, :]
    above = (score[:, None] > score[None, :]) + 0.5 * (score[:, None] == score[None, :])
    total = (p * q).sum()
    return (p * q * above).sum() / total if total else None


def predictions(spark, rng, n, levels=7):
    rows = [(label, seed, f"u{i}" if i else None, i % 5 if i % 11 else None, int(rng.integers(0, 2)), float(rng.integers(0, levels)))
            for label in ("a", None) for seed in (0, 1) for i in range(n)]
    rows += [("one class", 0, f"u{i}", 0, 1, float(i)) for i in range(4)] + [("a", 0, "u1", 1, None, 1.0), ("a", 0, "u1", 1, 1, None), ("a", 0, "u1", 1, 1, float("nan"))]
    return spark.createDataFrame(rows, "label string, seed int, unit_id string, cluster int, y int, score double")


@pytest.mark.parametrize("level,method", PAIRS)
@pytest.mark.parametrize("chunk", [7, 1 << 15])
def test_replicates_equal_all_pairs(spark, monkeypatch, level, method, chunk):
    monkeypatch.setattr(R, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(R, "CHUNK_PIECES", 2)
    pred = predictions(spark, np.random.default_rng(5), 40)
    key = "unit_id" if level == "unit" else "cluster"
    weights = {r[0]: r[1] for r in R.replicate_weights(pred.where("y is not null and score is not null"), key, 12, 3, method).collect()}
    got = {(r.rep, r.label, r.seed): r.auroc for r in I.replicate_auroc(pred, 12, 3, method, ("label", "seed"), level).collect()}
    rows = [r for r in pred.collect() if r.y is not None and r.score is not None and not np.isnan(r.score)]
    assert len(got) == 13 * 5
    for (rep, label, seed), value in got.items():
        part = [r for r in rows if r.label == label and r.seed == seed]
        direct = weighted_auroc(*(np.array(v, float) for v in zip(*((r.y, r.score, weights[r[key]][rep]) for r in part), strict=True)))
        assert value == (None if direct is None else pytest.approx(direct))


def test_one_score_for_most_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "CHUNK_ROWS", 16)
    pred = predictions(spark, np.random.default_rng(6), 150, levels=2).where("label = 'a' and seed = 0")
    got = {r.rep: r.auroc for r in I.replicate_auroc(pred, 3, 0, "poisson", ["label"]).collect()}
    rows = [r for r in pred.collect() if r.y is not None and r.score is not None and not np.isnan(r.score)]
    assert got[0] == pytest.approx(weighted_auroc(np.array([r.y for r in rows]), np.array([r.score for r in rows]), np.ones(len(rows))))


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000, 5003])
def test_tree_draws_n_of_n(spark, n):
    totals = R.segment_totals(spark, n, 40, 9)
    assert totals.shape[0] == len(R.segments(n)) and (totals[:, 1:].sum(axis=0) == n).all()
    tree = R.TreeWeights(n, 40, 9, totals)
    whole = tree.matrix(np.arange(n)[:, None], 0, 41)
    assert (whole[:, 0] == 1).all() and (whole >= 0).all() and (whole.sum(axis=0) == n).all()
    some = np.random.default_rng(n).integers(0, n, 50)
    np.testing.assert_array_equal(tree.matrix(some[:, None], 10, 20), whole[some, 10:20])  # whoever asks


def test_tree_counts_are_multinomial(spark):
    """Each count is Binomial(n, 1/n): mean 1, variance 1 - 1/n, Poisson-like shares; two counts are slightly negatively related."""
    n, draws = 300, 2000
    w = R.TreeWeights(n, draws, 1, R.segment_totals(spark, n, draws, 1)).matrix(np.arange(n)[:, None], 1, draws + 1).astype(float)
    assert w.var() == pytest.approx(1 - 1 / n, abs=0.01)
    for k, share in enumerate((0.3673, 0.3685, 0.1842, 0.0612)):
        assert (w == k).mean() == pytest.approx(share, abs=0.003)
    assert np.abs(w.mean(axis=1) - 1).max() < 0.12  # no unit is preferred: five deviations
    pairs = (w[:-1] * w[1:]).mean() - 1
    assert pairs == pytest.approx(-1 / n, abs=0.006)


@pytest.mark.parametrize("digit", [3, 5, 6, 9, 14])
def test_halves_are_binomial(digit):
    word = np.random.default_rng(digit).integers(0, 1 << 32, 200_000).astype(np.uint32)
    half = R._half_of(digit, word)
    n = 1 << digit
    assert half.mean() == pytest.approx(n / 2, abs=5 * np.sqrt(n / 4 / len(word))) and half.var() == pytest.approx(n / 4, rel=0.02)


def test_poisson_shares():
    units = np.random.default_rng(0).integers(0, 1 << 32, (2000, 2))
    w = R.PoissonWeights(200).matrix(units, 0, 201)
    assert (w[:, 0] == 1).all()
    for k, share in enumerate((0.36788, 0.36788, 0.18394, 0.06131, 0.01533)):
        assert (w[:, 1:] == k).mean() == pytest.approx(share, abs=0.003)


def test_pieces_do_not_grow_with_draws_or_rows(spark):
    """A chunk sends at most three pieces per cell, whatever the number of its rows."""
    import pyarrow as pa
    n = 5000
    rng = np.random.default_rng(1)
    table = pa.table({"cell": ["x"] * n, "_score": np.sort(rng.normal(size=n)), "_y": rng.integers(0, 2, n).astype(float), "_n": np.ones(n, np.int64),
                      "_a": rng.integers(0, 99, n), "_b": rng.integers(0, 99, n)})
    assert sum(b.num_rows for b in R._pieces(table, ["cell"], R.PoissonWeights(10))) == 3


def test_numbers_are_dense(spark):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(500)] + [(None,)], "k string")
    got = [r["i"] for r in numbered(keys, "k", "i").collect()]
    assert sorted(got) == list(range(501))


def test_the_work_on_weights_is_shared_by_the_rows_of_a_unit(spark, monkeypatch):
    """A tree of n leaves is split n - 1 times for each draw, however many cells and chunks the rows of a unit are in."""
    monkeypatch.setattr(R, "CHUNK_ROWS", 2000)
    n, draws, split, located = 5000, 3, spark.sparkContext.accumulator(0), R.located

    def counting(*args):
        rows, weights = located(*args)
        plain = copy.copy(weights)

        def left(node, count, *rest):
            split.add(count.size)
            return R.TreeWeights._left(plain, node, count, *rest)

        weights._left = left
        return rows, weights

    monkeypatch.setattr(R, "located", counting)
    rng = np.random.default_rng(3)
    pred = spark.createDataFrame([(c, i, int(rng.integers(0, 2)), float(rng.random())) for c in range(6) for i in range(n)], "cell int, unit_id int, y int, score double")
    assert I.replicate_auroc(pred, draws - 1, 0, "multinomial", ["cell"], "unit").count() == 6 * draws
    assert 0 < split.value <= n * draws


@pytest.mark.parametrize("step,nodes", [(3, 2), (8, 64), (1 << 11, 512)])
@pytest.mark.parametrize("counted", [False, True])
def test_runs_of_chunks_and_blocks_of_draws_merge(spark, monkeypatch, step, nodes, counted):
    """Chunks cut anywhere, scores with more rows than a step, rows that count more than once or not at all."""
    monkeypatch.setattr(R, "STEP", step)
    monkeypatch.setattr(R, "NODES", nodes)
    rng, n, draws = np.random.default_rng(step), 60, 7
    tree = R.TreeWeights(n, draws - 1, 4, R.segment_totals(spark, n, draws - 1, 4))
    cell, unit = np.repeat(["x", "y"], n), np.tile(np.arange(n), 2)
    score, y = np.where(rng.random(2 * n) < 0.4, 1.0, np.round(rng.normal(1, 1, 2 * n), 1)), rng.integers(0, 2, 2 * n).astype(float)
    count = rng.integers(0, 300, 2 * n) if counted else np.ones(2 * n, np.int64)
    order = np.lexsort((score, cell))
    table = pa.table({"cell": cell[order], "_score": score[order], "_y": y[order], "_n": count[order], "_a": unit[order], "_b": np.zeros(2 * n, np.int64)})
    for size in (1, 7, 50, 200):
        runs = pa.Table.from_batches([R._runs(table.slice(i, size), ["cell"], tree) for i in range(0, 2 * n, size)])
        pieces = pa.concat_tables(pa.Table.from_batches([b]) for a, e in ((0, 3), (3, 7)) for b in R._counted(runs, ["cell"], tree, a, e))
        pieces = pieces.sort_by([(c, "ascending") for c in ("cell", "_first", "lo", "hi")])
        got = {(r["cell"], r["rep"]): r["auroc"] for b in R._merged(pieces.combine_chunks().to_batches(), ["cell"]) for r in b.to_pylist()}
        assert len(got) == 2 * draws
        weights = tree.matrix(unit[:, None], 0, draws)
        for (c, rep), value in got.items():
            part = cell == c
            assert value == pytest.approx(weighted_auroc(y[part], score[part], count[part] * weights[part, rep]))


def test_weights_beyond_a_byte(monkeypatch):
    monkeypatch.setattr(R, "NODES", 1)
    tree = R.TreeWeights(4, 5, 2, np.full((1, 6), 1300))
    w = tree.table(np.arange(4), 1, 6)
    assert w.max() > 255 and (w.sum(axis=0) == 1300).all()
    np.testing.assert_array_equal(tree.table(np.array([1, 3]), 1, 6), w[[1, 3]])


def unmixed(x):
    """The word that `mix32` turns into x."""
    fold = lambda x: x ^ (x >> np.uint32(16))
    back = np.uint32(pow(R.MULTIPLIER, -1, 1 << 32))
    return fold(fold(fold(np.array([x], np.uint32)) * back) * back)


@pytest.mark.parametrize("n", [3, 1000, 70_001])
def test_balls_per_segment(n):
    ends = [first + (1 << k) for k, first in R.segments(n)]
    at_cut = unmixed(int(unmixed(R._cuts(n)[0][1])[0]) ^ R.BALL)[0]  # ball 0 needs its second word
    for state in (at_cut, *R._draw_states(3, 8)):
        ball = R.mix32(np.arange(n, dtype=np.uint32) ^ state)
        high, low = (R.mix32(ball ^ np.uint32(R.BALL + i)).astype(np.int64) for i in (0, 1))
        place = np.floor(((high << 21) + (low >> 11)) / float(1 << 53) * n)
        np.testing.assert_array_equal(R._balls(n, state), np.bincount(np.searchsorted(ends, place, "right"), minlength=len(ends)))
    assert R.mix32(R.mix32(np.zeros(1, np.uint32) ^ at_cut) ^ np.uint32(R.BALL))[0] == R._cuts(n)[0][1]


@pytest.mark.parametrize("rows", [3, 400])
def test_distinct_units(rows):
    """Few rows of many units are sorted, many are marked."""
    ids = np.random.default_rng(rows).integers(0, 100, rows).astype(np.uint32)
    for weights in (R.TreeWeights(100, 1, 0, np.zeros((3, 2), np.int64)), R.PoissonWeights(1)):
        own, back = weights.distinct(ids.astype(weights.kind))
        np.testing.assert_array_equal(own, np.unique(ids))
        np.testing.assert_array_equal(own[back], ids)


@pytest.mark.parametrize("level,method", PAIRS)
def test_no_rows(spark, level, method):
    none = spark.createDataFrame([], "label string, unit_id string, cluster int, y int, score double")
    assert I.replicate_auroc(none, 3, 0, method, ["label"], level).count() == 0
