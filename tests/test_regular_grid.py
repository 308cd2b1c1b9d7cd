import datetime as dt
import math

from kronopanel.operators.regular_grid import regular_grid

S = "series_key string, period string, frequency string, value double, loaded_at timestamp, day string, f string"
T = dt.datetime(2024, 1, 1)


def run(spark, rows, **kw):
    df = regular_grid(spark.createDataFrame([(*r, T, "x", "x") if len(r) == 4 else (*r, "x", "x") for r in rows], S), **kw)
    return {(r.series_key, str(r.period_start)): (r.frequency, r.value, r.status) for r in df.collect()}


def test_notations_frequencies_and_gaps(spark):
    nan = float("nan")
    rows = [
        ("m", "2023-01", "Monthly", 1.0), ("m", "15.02.2023", None, None), ("m", "2023-02-20", "month", nan), ("m", "2023-03-31T21:00:00", "daily", 3.0), ("m", "2023/04/02", "month", 4.0),
        ("w", "2024-01-03", "WEEKLY", 1.0), ("w", "2024-01-22", "week", 2.0),
        ("q", "2023-Q1", "quarter", 1.0), ("q", "2023-Q4", "quarter", 2.0),
        ("none", "2023-01", None, 1.0), ("empty", "2023-01", "daily", None), (None, "2023-01", "daily", 1.0), ("bad", "soon", "daily", 1.0),
    ]
    got = run(spark, rows)
    assert {k: v[2] == "observed" for k, v in got.items()} == {
        ("m", "2023-01-01"): True, ("m", "2023-02-01"): False, ("m", "2023-03-01"): True, ("m", "2023-04-01"): True,
        ("w", "2024-01-01"): True, ("w", "2024-01-08"): False, ("w", "2024-01-15"): False, ("w", "2024-01-22"): True,
        ("q", "2023-01-01"): True, ("q", "2023-04-01"): False, ("q", "2023-07-01"): False, ("q", "2023-10-01"): True,
    }
    assert run(spark, []) == {}


def test_last_loaded_of_a_day_and_mean_over_days(spark):
    rows = [("m", "2023-01-05", "month", 1.0, T), ("m", "2023-01-05", "month", 9.0, dt.datetime(2024, 2, 1)), ("m", "2023-01-07", "month", 1.0, T)]
    assert run(spark, rows) == {("m", "2023-01-01"): ("monthly", 5.0, "observed")}


def test_low_rank_gaps_are_recovered_and_observed_cells_stay_exact(spark):
    truth, rows = {}, []
    for s in range(30):
        for t in range(48):
            y = 100 + s * t * 0.3 + (s % 5) * 10 * math.sin(t / 3)
            key = (f"s{s}", str(dt.date(2020 + t // 12, t % 12 + 1, 1)))
            truth[key] = y
            if (s * 7 + t * 3) % 11 or t in (0, 47):
                rows.append((key[0], key[1], "month", y))
    got = run(spark, rows, rounds=6)
    assert set(got) == set(truth)
    kept = {(r[0], r[1]) for r in rows}
    assert all(got[k][1] == truth[k] for k in kept)
    gaps = [k for k in truth if k not in kept]
    assert all(got[k][2] == "filled" for k in gaps)
    error = sum(abs(got[k][1] - truth[k]) for k in gaps) / len(gaps)
    spread = sum(abs(truth[k] - sum(truth.values()) / len(truth)) for k in gaps) / len(gaps)
    assert error < 0.2 * spread


def test_unsupported_cells_stay_marked(spark):
    got = run(spark, [("a", "2023-01", "month", 1.0), ("a", "2023-03", "month", 2.0)])
    assert got[("a", "2023-02-01")] == ("monthly", None, "unsupported")
