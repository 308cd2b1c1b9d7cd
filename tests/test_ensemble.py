import itertools
import random

import numpy as np
import pytest

from kronopanel.operators import metrics as M
from kronopanel.operators import models as L

OOF = "unique_id string, ds date, fold string, cutoff date, horizon int, category string, model string, y double, y_hat double"


def simplex(k, steps):
    return [np.array(p, float) / steps for p in itertools.product(range(steps + 1), repeat=k) if sum(p) == steps]


def test_squared_error_weights_are_optimal():
    rng = np.random.default_rng(1)
    for trial in range(25):
        y = rng.normal(5, 2, 80)
        x = np.stack([y + rng.normal(b, s, 80) for b, s in zip(rng.normal(0, 1, 4), rng.uniform(0.1, 2, 4))], axis=1)
        if trial % 5 == 0:
            x[:, 3] = x[:, 2]  # two equal models
        w = L.fit_weights(x.T @ x, x.T @ y)
        assert w.sum() == pytest.approx(1) and (w >= 0).all()
        best = min(np.sum((y - x @ v) ** 2) for v in simplex(4, 20))
        assert np.sum((y - x @ w) ** 2) <= best * (1 + 1e-9)


def test_absolute_error_weights_against_a_grid(spark):
    rng = np.random.default_rng(2)
    rows, data = [], {}
    for g in ("a", "b"):
        y = rng.normal(10, 3, 120)
        x = np.stack([y + rng.laplace(0, s, 120) + b for s, b in ((0.5, 0.3), (1.0, -0.5), (2.0, 1.0))], axis=1)
        data[g] = (y, x)
        rows += [(g, float(t), *map(float, r)) for t, r in zip(y, x)]
    rows += [("c", 1.0, 1.0, None, 2.0), ("c", 2.0, 2.5, 2.0, 1.0), ("d", 3.0, 2.0, None, None), ("e", None, 1.0, 1.0, 1.0)]
    h = spark.createDataFrame(rows, "group string, y double, m0 double, m1 double, m2 double")
    out = {}
    for r in L.least_absolute_weights(h, ["m0", "m1", "m2"]).collect():
        out.setdefault(r.group, {})[r.model] = r.weight
    for g, (y, x) in data.items():
        w = np.array([out[g][m] for m in ("m0", "m1", "m2")])
        best = min(np.mean(np.abs(y - x @ v)) for v in simplex(3, 50))
        assert w.sum() == pytest.approx(1) and np.mean(np.abs(y - x @ w)) <= best * 1.003
    assert out["c"]["m1"] == 0 and sum(out["c"].values()) == pytest.approx(1)  # a model without one forecast
    assert set(out["d"].values()) == {1 / 3} and "e" not in out


def test_weights_know_nothing_after_their_cutoff(spark):
    rnd = random.Random(3)
    rows = []
    for fold, cutoff, months in (("f1", "2024-01-01", ("2024-02", "2024-03")), ("f2", "2024-03-01", ("2024-04", "2024-05"))):
        for u in range(30):
            for m in months:
                y = rnd.uniform(50, 100)
                rows += [(f"s{u}", f"{m}-01", fold, cutoff, 2, "food", name, y, y + e) for name, e in (("good", rnd.gauss(0, 1)), ("bad", rnd.gauss(20, 5)))]
    frame = lambda r: spark.createDataFrame([(a, str(b), c, str(d), *rest) for a, b, c, d, *rest in r], OOF.replace("ds date", "ds string").replace("cutoff date", "cutoff string")).selectExpr("unique_id", "date(ds) as ds", "fold", "date(cutoff) as cutoff", "horizon", "category", "model", "y", "y_hat")
    get = lambda r: {(x.fold, x.model): x.weight for x in L.rolling_origin_weights(frame(r), ["good", "bad"]).collect()}
    w = get(rows)
    assert w["f1", "good"] == w["f1", "bad"] == 0.5 and w["f2", "good"] > 0.9
    spoiled = [r if r[1] <= "2024-03-01" else (*r[:8], r[8] * 100) for r in rows]
    assert get(spoiled) == w
    out = L.rolling_origin_ensemble(frame(rows), ["good", "bad"]).collect()
    assert len(out) == 120 and {r.category for r in out} == {"food"} and {str(r.cutoff) for r in out} == {"2024-01-01", "2024-03-01"} and {r.model for r in out} == {"ensemble"}


def test_slices_and_panel_test_against_numpy(spark):
    rng = np.random.default_rng(4)
    rows = []
    for u in range(12):
        for t in range(6):
            y = float(rng.normal(10, 2))
            for m, s in (("a", 1.0), ("b", 2.0)):
                f = y + float(rng.normal(0, s))
                rows.append((m, f"u{u}", f"2024-{t + 1:02d}-01", "f", 3, "x" if u < 6 else "z", y, f, f - 1 if (m, t) != ("b", 2) else None, f + 1))
    o = spark.createDataFrame(rows, "model string, unique_id string, ds string, fold string, horizon int, category string, y double, y_hat double, `q_0.1` double, `q_0.9` double")
    scales = spark.createDataFrame([(f"u{u}", 0.0 if u == 3 else 2.0 + u) for u in range(12)], "unique_id string, mase_scale double")
    got = {(r.model, r.slice, r.value): r for r in M.metric_slices(o, ["category"], scales=scales, levels=(0.1, 0.9)).collect()}
    assert len(got) == 6
    part = [r for r in rows if r[0] == "a" and r[5] == "z"]
    y, f = np.array([r[6] for r in part]), np.array([r[7] for r in part])
    g = got["a", "category", "z"]
    assert g.r2_pooled == pytest.approx(1 - ((y - f) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert g.coverage == pytest.approx(np.mean((y >= f - 1) & (y <= f + 1))) and g.pinball_10 == pytest.approx(np.mean(np.maximum(0.1 * (y - f + 1), -0.9 * (y - f + 1))))
    ratio = [np.mean([abs(r[6] - r[7]) for r in rows if r[0] == "a" and r[1] == f"u{u}"]) / (2.0 + u) for u in range(12) if u != 3]
    assert got["a", "overall", "all"].mase == pytest.approx(np.mean(ratio))
    assert got["b", "overall", "all"].pinball_10 is None and got["b", "overall", "all"].pinball_90 is not None and got["b", "overall", "all"].coverage is None
    d = M.panel_dm(o, [("a", "b")]).first()
    per = [np.mean([abs(r[6] - r[7]) for r in rows if r[0] == "a" and r[1] == f"u{u}"]) - np.mean([abs(r[6] - r[7]) for r in rows if r[0] == "b" and r[1] == f"u{u}"]) for u in range(12)]
    assert d.n == 12 and d.stat == pytest.approx(M.diebold_mariano(np.array(per))[0])
