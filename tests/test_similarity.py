"""Scores of simulated returns."""

import numpy as np
import pytest

from barloom.operators.similarity import similarity


def test_a_short_symbol_leaves_the_others_alone(spark):
    rng = np.random.default_rng(0)
    draw = lambda n: [float(x) for x in rng.normal(0, 0.01, n)]
    history = [("long", draw(90)), ("short", draw(3)), ("one", draw(1))]
    paths = [(s, trial, path, draw(n)) for s, trial, n in (("long", 0, 70), ("long", 1, 40), ("short", 0, 70), ("one", 0, 70)) for path in range(3)]
    h = spark.createDataFrame([(s, i, x) for s, r in history for i, x in enumerate(r)], "symbol string, nth long, r double")
    p = spark.createDataFrame([(s, t, k, i, x) for s, t, k, r in paths for i, x in enumerate(r)], "symbol string, trial int, path_index int, nth long, r double")
    keys = ["symbol", "trial"]
    scores = lambda a, b: {(r["symbol"], r["trial"]): tuple(r)[2:] for r in similarity(a, b, keys, 10).collect()}
    got = scores(h, p)
    assert set(got) == {("long", 0), ("long", 1), ("short", 0)}
    for s, t in got:
        alone = scores(h.where(f"symbol = '{s}'"), p.where(f"symbol = '{s}' and trial = {t}"))
        assert got[s, t] == pytest.approx(alone[s, t], abs=1e-9, nan_ok=True)
    assert None not in got["long", 0] and None not in got["long", 1]
    last = np.array(history[0][1][-70:])
    means = np.mean([np.mean(r[-70:]) for s, t, _, r in paths if (s, t) == ("long", 0)])
    assert got["long", 0][0] == pytest.approx(100 * max(0, 1 - abs(last.mean() - means) / last.std(ddof=1)))


@pytest.mark.parametrize("chunk", [50_000, 7])
def test_nearest_information(spark, chunk):
    """Against loops over all pairs, with gains on a grid so that many tie, a value that stands alone and a constant parameter."""
    from barloom.operators.report import nearest_information

    rng = np.random.default_rng(3)
    rows = [(i, int(a), bool(b), 7, None if i == 5 else float(a * 3 + rng.integers(-4, 5))) for i, (a, b) in enumerate(zip(rng.integers(0, 4, 60), rng.integers(0, 2, 60)))] + [(60, 99, True, 7, 2.0)]
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, n))
    want = {}
    for at, name in ((1, "a"), (2, "b"), (3, "c")):
        own = [(float(r[at]), r[4]) for r in rows if r[4] is not None]
        own = [(v, y) for v, y in own if sum(w == v for w, _ in own) > 1]
        total = psi(len(own))
        for i, (v, y) in enumerate(own):
            near = sorted(abs(y - z) for j, (w, z) in enumerate(own) if w == v and j != i)
            d = near[min(3, len(near)) - 1]
            total += (psi(min(3, len(near))) - psi(len(near) + 1) - psi(sum(abs(z - y) < d or (d == 0 and z == y) for _, z in own))) / len(own)
        want[name] = max(total, 0)
    df = spark.createDataFrame(rows, "combo_id long, a int, b boolean, c int, Net_Gain double")
    got = {r["param"]: r["information"] for r in nearest_information(df, ["a", "b", "c"], chunk=chunk).collect()}
    assert got == pytest.approx(want, abs=1e-9) and want["a"] > 0.3
    assert nearest_information(df.where("false"), ["a"]).count() == 0


@pytest.mark.parametrize("lags, chunk", [(5, 65_536), (5, 20), (300, 300), (50, 1)])
def test_autocorrelation_by_blocks(spark, lags, chunk):
    """Against sums of products, for series of different length, one shorter than the lags and one that never changes."""
    from barloom.operators.similarity import autocorrelation

    rng = np.random.default_rng(1)
    series = {"a": rng.normal(size=700), "b": rng.normal(size=40), "flat": np.full(9, 0.5)}
    df = spark.createDataFrame([(k, i, float(x)) for k, r in series.items() for i, x in enumerate(r)], "symbol string, nth long, r double")
    got = {(r["symbol"], r["lag"]): r["acf"] for r in autocorrelation(df, ["symbol"], lags, chunk).collect()}
    assert len(got) == 3 * (lags + 1)
    for k, r in series.items():
        x = np.abs(r) - np.abs(r).mean()
        for lag in range(lags + 1):
            want = float(lag == 0) if k == "flat" else (x[lag:] * x[: len(x) - lag]).sum() / (x * x).sum() if lag < len(x) else 0.0
            assert got[k, lag] == pytest.approx(want, abs=1e-9)
