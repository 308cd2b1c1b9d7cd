import datetime as dt
import random

from kronopanel.operators.asof_attributes import attributes_as_of

EV = "event_id long, date date, published_at date, region_code string, value string, attr string"
CH = "value_id long, block string, kind string, region_code string, ds date, published_at date, value double, at int"
D = dt.date


def brute(events, changes):
    out = set()
    for e, d, p, r, *_ in events:
        at = d or p
        best = {}
        for v, b, k, reg, ds, pub, val, _ in changes:
            if e is None or at is None or v is None or b is None or reg is None or pub is None or val is None or val != val or pub > at or reg not in ("all", r):
                continue
            if k and k.strip().lower().replace("-", "_").replace(" ", "_") == "known_future" and (ds is None or (ds.year, ds.month) != (at.year, at.month)):
                continue
            key = (ds or D(1, 1, 1), pub, -v)
            if b not in best or key > best[b]:
                best[b] = key
        out |= {(e, b, -k[2]) for b, k in best.items()}
    return out


def got(spark, events, changes, **kw):
    df = attributes_as_of(spark.createDataFrame(events, EV), spark.createDataFrame(changes, CH), **kw)
    rows = [(r.event_id, r.attribute, r.value_id) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def data(n_ev, n_ch, seed):
    rnd = random.Random(seed)
    day = lambda: rnd.choice([None, *[D(2023, 1, 1) + dt.timedelta(rnd.randrange(400)) for _ in range(9)]])
    events = [(i, day(), day(), rnd.choice(["01", "01", "01", "02", "all", None]), "x", "y") for i in range(n_ev)]
    changes = [
        (i, rnd.choice(["a", "b", "c", None]), rnd.choice(["past_only", "Known-Future", " static ", None]), rnd.choice(["01", "01", "02", "all", None]), day(), day(), rnd.choice([1.0, 2.0, None, float("nan")]), 1)
        for i in range(n_ch)
    ]
    return events, changes


def test_matches_brute_force_with_and_without_hot_entities(spark):
    events, changes = data(120, 250, 1)
    events.append(events[0])  # a repeated row counts once
    want = brute(events, changes)
    assert got(spark, events, changes) == want
    assert got(spark, events, changes, rows_per_group=15) == want  # nearly every entity is cut and salted


def test_future_versions_never_change_the_past(spark):
    events, changes = data(40, 80, 2)
    late = [(1000 + i, "a", "past_only", "all", D(2023, 1, 1), D(2030, 1, 1), 9.0, 1) for i in range(5)]
    assert got(spark, events, changes + late) == got(spark, events, changes)


def test_empty_tables(spark):
    events, changes = data(5, 5, 3)
    assert got(spark, [], changes) == set()
    assert got(spark, events, []) == set()


def test_many_revisions_of_one_day_leave_the_best(spark):
    """Versions of one recording day are one, however many tasks an entity's events are spread over."""
    day = lambda k: D(2024, 3, k)
    rows = [(k, "b", "past_only", "01", D(2024, 1, 1 + k % 3), day(5), float(k)) for k in range(500)] + [(900, "b", "past_only", "01", D(2024, 1, 3), day(9), 9.0)]
    changes = spark.createDataFrame(rows, "value_id long, block string, kind string, region_code string, ds date, published_at date, value double")
    events = spark.createDataFrame([(k, day(4 + k % 7), None, "01") for k in range(70)], "event_id long, date date, published_at date, region_code string")
    for limit in (200_000, 20):
        got = {r.event_id: r.value_id for r in attributes_as_of(events, changes, rows_per_group=limit).collect()}
        assert got == {k: 2 if k % 7 < 5 else 900 for k in range(70) if k % 7 >= 1}
