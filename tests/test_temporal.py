"""Event-time primitives against brute force on random rows, with one stay holding a third of them."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import labels as L
from tidemark.operators import temporal as T


def random_rows(seed, n=600, span=80.0, stays=12):
    rng = np.random.default_rng(seed)
    stay = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, stays, n))
    hours = np.round(rng.uniform(-20, span, n) * 60) / 60  # whole minutes, so ties and exact distances occur
    return pd.DataFrame({"stay_id": stay, "hours": hours, "value": np.round(rng.normal(0, 5, n), 2)})


def seconds(hours):
    return np.round(np.asarray(hours) * 3600).astype(int)


@pytest.mark.parametrize("worst", ["min", "max"])
@pytest.mark.parametrize("window", [1.0, 24.0, 168.0])
def test_rolling_extreme(spark, worst, window):
    pdf = random_rows(1).groupby(["stay_id", "hours"], as_index=False).agg(value=("value", "min"))
    out = T.rolling_extreme(spark.createDataFrame(pdf), "value", window, "w", worst).toPandas()
    assert len(out) == len(pdf)
    for stay, part in pdf.groupby("stay_id"):
        t, v = seconds(part.hours), part.value.values
        for r in out[out.stay_id == stay].itertuples():
            now = int(seconds([r.hours])[0])
            inside = v[(t > now - window * 3600) & (t <= now)]
            assert r.w == (inside.min() if worst == "min" else inside.max())


@pytest.mark.parametrize("tolerance", [None, 2.0])
def test_asof_backward(spark, tolerance):
    left, right = random_rows(2), random_rows(3)
    out = T.asof_backward(spark.createDataFrame(left), spark.createDataFrame(right), "m", tolerance).toPandas()
    assert len(out) == len(left)
    for r in out.itertuples():
        near = right[(right.stay_id == r.stay_id) & (seconds(right.hours) <= seconds([r.hours])[0])]
        if tolerance is not None and len(near):
            near = near[seconds(near.hours) >= seconds([r.hours])[0] - tolerance * 3600]
        if near.empty:
            assert pd.isna(r.m)
        else:
            assert r.m == near[near.hours == near.hours.max()].value.max()


@pytest.mark.parametrize("shift, strict", [(0.0, False), (0.0, True), (-48.0, False)])
def test_next_at_or_after(spark, shift, strict):
    probes, targets = random_rows(4)[["stay_id", "hours"]], random_rows(5)[["stay_id", "hours"]]
    out = T.next_at_or_after(spark.createDataFrame(probes), spark.createDataFrame(targets), shift, "n", strict=strict).toPandas()
    assert len(out) == len(probes)
    for r in out.itertuples():
        t = targets[targets.stay_id == r.stay_id].hours
        start = seconds([r.hours])[0] + shift * 3600
        later = t[seconds(t) > start] if strict else t[seconds(t) >= start]
        assert pd.isna(r.n) if later.empty else r.n == later.min()


def test_band_join_and_suspicion_times(spark):
    abx, cul = random_rows(6, 300)[["stay_id", "hours"]].drop_duplicates(), random_rows(7, 300)[["stay_id", "hours"]].drop_duplicates()
    both = abx.merge(cul, on="stay_id", suffixes=("_a", "_c"))
    gap = both.hours_c - both.hours_a
    expected = both[(gap >= 0) & (gap <= 24) | (gap < 0) & (-gap <= 72)]
    a, c = spark.createDataFrame(abx), spark.createDataFrame(cul)
    pairs = L.suspicion_of_infection(a, c).toPandas()
    assert sorted(zip(pairs.stay_id, pairs.abx_hours, pairs.culture_hours)) == sorted(zip(expected.stay_id, expected.hours_a, expected.hours_c))
    times = {(r.stay_id, r.suspicion_hours) for r in L.suspicion_times(a, c).collect()}
    assert times == set(zip(expected.stay_id, np.minimum(expected.hours_a, expected.hours_c)))


@pytest.mark.parametrize("rule", L.ONSET_RULES)
def test_sepsis_onset_equals_all_pairs(spark, rule):
    rng = np.random.default_rng(8)
    sofa = pd.DataFrame([(s, h, int(rng.integers(0, 6))) for s in range(8) for h in range(80)], columns=["stay_id", "hour", "sofa_total"])
    susp = pd.DataFrame({"stay_id": rng.integers(0, 8, 40), "suspicion_hours": np.round(rng.uniform(-20, 120, 40), 2)})
    base = sofa[sofa.hour == 6].set_index("stay_id").sofa_total
    dys = sofa[(sofa.hour > 6) & (sofa.sofa_total - sofa.stay_id.map(base) >= 2)]
    both = dys.merge(susp, on="stay_id")
    both = both[(both.hour - both.suspicion_hours).between(-48, 24)]
    both["onset"] = {"later_of_both": np.maximum(both.hour, both.suspicion_hours), "suspicion": both.suspicion_hours, "sofa": both.hour.astype(float)}[rule]
    expected = both[both.onset > 6].groupby("stay_id").onset.min().to_dict()
    got = L.sepsis3_onset(spark.createDataFrame(sofa), spark.createDataFrame(susp), onset_rule=rule)
    assert {r.stay_id: r.onset_hours for r in got.collect()} == expected


def test_grid_and_fill(spark):
    grid = T.hourly_grid(spark.createDataFrame([(1, 2.1), (2, 0.0)], "stay_id long, max_hours double"))
    assert sorted(map(tuple, grid.collect())) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)]
    df = spark.createDataFrame([(1, 0, None), (1, 1, 5.0), (1, 2, None), (2, 0, None)], "stay_id long, hour int, v double")
    assert sorted(map(tuple, T.fill_forward(df, ["v"]).collect()), key=str) == sorted([(1, 0, None), (1, 1, 5.0), (1, 2, 5.0), (2, 0, None)], key=str)
