import datetime as dt
import random

from kronopanel.operators.history import coalesce_runs, history_from_acts, history_from_snapshots

D = dt.date


def brute(rows):
    best = {}
    for e, d, p in rows:
        if e is not None and d is not None:
            best[e, d] = max(filter(None, [best.get((e, d)), p]), default=None)
    out = []
    for e in {e for e, _ in best}:
        runs = []
        for d in sorted(d for x, d in best if x == e):
            if not runs or runs[-1][1] != best[e, d]:
                if runs:
                    runs[-1][3] = d
                runs.append([e, best[e, d], d, None])
        out += [tuple(r) for r in runs if r[1] is not None]
    return set(out)


def test_any_number_of_blocks_gives_the_same_runs(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["hot", "hot", "hot", "a", "b", None]), rnd.choice([None, *[D(2000, 1, 1) + dt.timedelta(rnd.randrange(900)) for _ in range(8)]]), rnd.choice(["p", "p", "q", None])) for _ in range(400)]
    df = spark.createDataFrame(rows, "who string, since date, payload string")
    for blocks in (1, 2, 7, 16):
        got = [tuple(r) for r in coalesce_runs(df, entity="who", start="since", payload="payload", blocks=blocks).collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute(rows)


def test_one_payload_over_all_blocks_is_one_run(spark):
    rows = [("a", D(2000, 1, 1) + dt.timedelta(i), "p") for i in range(60)]
    df = spark.createDataFrame(rows, "ent string, since date, edge string")
    assert [tuple(r) for r in coalesce_runs(df, entity="ent", start="since", payload="edge", blocks=8).collect()] == [("a", "p", D(2000, 1, 1), None)]


def test_acts_with_corrections(spark):
    t = lambda d: dt.datetime(2020, 1, d)
    rows = [
        (1, "B", " a  A ", "2020-01-05", "s1", t(1), "x"), (2, "C", "a a", "05.02.2020", "s1", t(2), "x"),  # corrected
        (3, "c", "A a", "2020/03/01", "s2", t(3), "x"),  # changes nothing
        (4, None, "a a", "2020-05", "s3", t(4), "x"), (5, "D", "a a", "2020-06-01", "s4", t(5), "x"),
        (6, "Z", None, "2020-06-01", "s5", t(5), "x"), (7, "Z", "e", "soon", "s6", t(5), "x"),
        (8, "F", "g", "2020-01-01", None, t(1), "x"), (9, "H", "g", "2020-02-01", None, t(1), "x"),
    ]
    feed = spark.createDataFrame(rows, "reorg_id long, successor string, predecessor string, effective string, source string, recorded_at timestamp, ent string")
    got = {(r.predecessor, r.successor, str(r.valid_from), str(r.valid_to)) for r in history_from_acts(feed).collect()}
    assert got == {
        ("a a", "c", "2020-02-05", "2020-05-01"), ("a a", "d", "2020-06-01", "None"),
        ("g", "f", "2020-01-01", "2020-02-01"), ("g", "h", "2020-02-01", "None"),
    }
    assert history_from_acts(feed.limit(0)).count() == 0


def test_snapshots_leave_gaps_where_an_entity_is_missing(spark):
    rows = [("a", D(2020, 1, 1), "p"), ("a", D(2020, 2, 1), "p"), ("a", D(2020, 4, 1), "p"), ("b", D(2020, 3, 1), "q"), ("b", D(2020, 3, 1), "q")]
    df = spark.createDataFrame(rows, "who string, d date, payload string")
    got = {tuple(map(str, r)) for r in history_from_snapshots(df, entity="who", taken_on="d", payload="payload").collect()}
    assert got == {("a", "p", "2020-01-01", "2020-03-01"), ("a", "p", "2020-04-01", "None"), ("b", "q", "2020-03-01", "2020-04-01")}
