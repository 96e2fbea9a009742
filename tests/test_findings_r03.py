"""Queries over small tables made for a fault that the given tables show only at size, each against its SQL."""

import time
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegate.operators import identity, matching, ordering, publish, scoring, selection, spatial
from tidegate.plans import catalogue, glue
from tidegate.sources import ical
from tidegate.streaming import polls


@pytest.fixture
def on_tables(spark, tmp_path):
    """Runs a query and its SQL over tables given as SQL; returns both results' rows, sorted."""

    def run(name, **tables):
        con = duckdb.connect()
        for t, sql in tables.items():
            path = tmp_path / f"{t}.parquet"
            con.execute(f"COPY ({sql}) TO '{path}'")
            con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{path}'")
        df = catalogue.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
        return sorted(map(tuple, df.collect())), sorted(want)

    return run


def test_a_gap_is_cut_to_whole_seconds_after_it_is_taken(on_tables):
    """a day and half a second, from x.7 to x.2, is no gap of 86,401 seconds; a day and a second is."""
    rows = "(1, 7, '2024-01-01 00:00:00.7'), (2, 7, '2024-01-02 00:00:01.2'), (3, 8, '2024-01-01 00:00:00'), (4, 8, '2024-01-02 00:00:01')"
    got, want = on_tables("gap_prefix", events=f"SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM (VALUES {rows}) AS e(event_id, user_id, ts)")
    assert got == want == [(7, 2), (8, 1)]


def test_hours_before_a_sunset_that_does_not_occur_begin_with_the_day(on_tables):
    """two visits of sf0.1 on days whose sun does not set, while the next day's rises."""
    rows = "(13189, 1527, '2001-01-01'), (57576, 7635, '2000-12-26')"
    got, want = on_tables("rule_hours", orders=f"SELECT * REPLACE (o_orderdate::TIMESTAMP AS o_orderdate) FROM (VALUES {rows}) AS o(o_orderkey, o_custkey, o_orderdate)")
    assert got == want == [(13189, "0-2211"), (57576, "0-2214")]


def test_asks_meet_venues_that_are_counted_already(spark, sf_dir):
    """no join below an aggregate, where asks and venues of one name would be paired one by one."""
    plan = catalogue.QUERIES["venue_by_name"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Join" not in plan[plan.index("Aggregate") :]


def test_pivot_counts_pairs_without_holding_them_apart(spark, sf_dir):
    """a pair of request and venue is one row, so nothing distinct is kept."""
    assert "distinct" not in catalogue.QUERIES["coverage_pivot"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_few_rows_reach_the_sort_of_a_page(spark):
    """of 6,000 rows of two requests little more than the page is sorted, and the page is the sort's own; missing merits come last."""
    rows = [(i % 2, i, "ready" if i % 5 else "check_first", None if i % 7 == 0 else float(i * 7919 % 4001 // 2), i % 40, f"n{i % 9}") for i in range(6000)] + [(2, i, "ready", None, 1, "a") for i in range(4)]
    df = spark.createDataFrame(rows, "request_id long, venue_id long, class string, merit double, travel int, name string")
    key = lambda r: (r[2] != "ready", r[3] is None, -(r[3] or 0), r[4], r[5], r[1])
    want = {(q, r[1], n) for q in range(3) for n, r in enumerate(sorted((x for x in rows if x[0] == q), key=key), 1) if 6 < n <= 9}
    assert {(r.request_id, r.venue_id, r.place) for r in scoring.ranked(df, offset=6).collect()} == want
    assert scoring._near_top(df, F.when(F.col("class") == "ready", 0).otherwise(1), 9).count() < 100


def test_rows_of_one_point_are_measured_together(spark):
    """the distance stands below the rows of a point, and all their pairs, with their own columns, are there; so are the nearest, ties by id."""
    a = [(i, 40.7 + i % 3 / 1000, -74.0, f"a{i}") for i in range(12)] + [(90, None, -74.0, "none")]
    b = [(i, 40.7 + i % 4 / 1000, -74.0, f"b{i}") for i in range(20, 60)]
    sides = [spark.createDataFrame(rows, f"{s}_id long, {s}_lat double, {s}_lon double, {s}_note string") for s, rows in (("a", a), ("b", b))]
    steps = lambda x, y: abs(x[0] % 3 - y[0] % 4)  # noqa: E731  of 111.2 m
    pairs = spatial.radius_join(*sides, 150.0)
    want = sorted((x[0], x[3], y[0], y[3]) for x in a[:12] for y in b if steps(x, y) <= 1)
    assert sorted((r.a_id, r.a_note, r.b_id, r.b_note) for r in pairs.collect()) == want
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(_a") < plan.index("ASIN") < plan.index("collect_list")
    got = {(r.a_id, r.b_note, r.place) for r in spatial.nearest(*sides, 3, 150.0).collect()}
    assert got == {(x[0], y[3], n) for x in a[:12] for n, y in enumerate(sorted((y for y in b if steps(x, y) <= 1), key=lambda y: (steps(x, y), y[0]))[:3], 1)}


def test_display_order_takes_time_in_proportion():
    """F8: sixteen times the rows of a request take nowhere near 256 times as long."""

    def seconds(n):
        at = np.arange(n)
        rows = pd.DataFrame({"venue_id": at, "parent_id": np.nan, "name_key": "", "category": "cafe", "activity": "eat", "kind": None, "lat": 40.0, "lon": -74.0, "standing": "ready", "merit": -at / n, "taste": 0.5, "lead": None, "off": False, "age_doubt": False})
        start = time.perf_counter()
        assert len(ordering.arrange(rows)) == n
        return time.perf_counter() - start

    seconds(100)
    assert seconds(80_000) < 50 * seconds(5_000)


def test_every_film_of_the_list_counts(spark, on_tables):
    """300 films of as many titles; all are scored and all their screenings found, the 31st and later with 0."""
    part = "SELECT i AS p_partkey, 'blue film ' || i AS p_name FROM range(1, 301) AS r(i)"
    got, want = on_tables("popular_films", part=part)
    assert got == want and len(got) == 300 and sum(r[2] > 0 for r in got) == 30
    got, want = on_tables("films_by_title", part=part)
    assert got == want and len(got) == 300
    assert matching.popular_films(glue.table(spark, "/root/testdata/sf0.001", "part").selectExpr("p_partkey film_id", "concat('blue film ', p_partkey) title", "p_partkey popularity")).count() == matching.POPULAR


def test_events_of_a_batch_of_feeds_are_handed_on_in_pieces():
    """a batch of many feeds never stands as rows all at once."""
    event = "BEGIN:VEVENT\r\nUID:{}\r\nDTSTART:20240101T190000Z\r\nEND:VEVENT\r\n"
    feeds = pd.DataFrame({"feed_id": range(60), "body": ["BEGIN:VCALENDAR\r\n" + "".join(event.format(f"{f}-{i}") for i in range(200)) + "END:VCALENDAR\r\n" for f in range(60)]})
    pieces = list(ical._frames(iter([feeds]), "UTC"))
    assert max(map(len, pieces)) < ical.AT_ONCE + 200 and pd.concat(pieces)["uid"].nunique() == 12_000


def test_pairs_in_reach_are_made_by_all_tasks(spark, sf_dir):
    """the places, which come from one small file, are dealt out before they meet the requests; a crossing is settled once a pair."""
    plan = catalogue.QUERIES["reach_over_water"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Repartition") and "crosses" not in plan.split("Join")[1] and plan.count("exists(") <= 2


@pytest.mark.parametrize("name", ["pair_scores", "identity_parents", "create_if_nothing_near"])
def test_pairs_of_records_are_made_by_all_tasks(spark, sf_dir, name):
    """Records come from one small file; they are dealt out before each meets all in its cell."""
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan[plan.index("Generate explode(_a") :]


def test_records_alike_take_no_rounds(spark):
    """Of many records alike only the best goes into the rounds; those that are no twins of themselves all do."""
    rows = [(i, None if i % 7 == 0 else float(i % 50), 10.0 + i % 3, 20.0, [f"n{i % 2}"]) for i in range(6000)] + [(10_000 + i, 1.0, 10.0, 20.0, []) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, merit double, lat double, lon double, names array<string>")
    twins = lambda a, b: (a["names"] == b["names"]) & (F.size(a["names"]) > 0)
    alike = selection._best_of_alike(df, twins)
    assert alike.count() == 6 + 5
    chosen = {r.id for r in selection.choose_apart(df, {"names": 100.0}, twins, rounds=2).where("chosen").collect()}
    best = {}
    for r in sorted(rows[:6000], key=lambda r: (-1.0 if r[1] is None else r[1], -r[0])):
        best[r[2], r[4][0]] = r[0]
    assert chosen == set(best.values()) | set(range(10_000, 10_005))


def test_a_likely_match_nearby_settles_a_record(spark, monkeypatch):
    """a record with such a venue beside it takes no part in the wider rounds; the last round still sees the whole block."""
    seen, join = {}, spatial.radius_join

    def counted(left, right, metres):
        seen[metres] = left.count()
        return join(left, right, metres)

    monkeypatch.setattr(spatial, "radius_join", counted)
    row = lambda i, north, name: (i, name, "cafe", 40.7 + north / 111_195, -74.0, None, None, None, None, None, None)
    kind = "record_id long, name string, category string, lat double, lon double, brand string, website string, phone string, number string, street string, xids array<string>"
    records = spark.createDataFrame([row(1, 0.0, "One"), row(2, 60.0, "Two"), row(3, 130.0, "Three"), row(4, 0.0, "Four"), row(5, 1000.0, "One")], kind)
    venues = spark.createDataFrame([row(10, 5.0, "One"), row(12, 0.0, "Two"), row(13, 0.0, "Three")], kind)
    assert sorted(r.record_id for r in identity.nothing_near(records, venues).collect()) == [4, 5]
    assert list(seen.values()) == [5, 4, 4, 3]


def test_parents_are_looked_for_no_further_than_they_can_be(spark, sf_dir, monkeypatch):
    """the pairs of identity_parents are made within CHILD_M, not the whole block."""
    radii, join = [], spatial.radius_join
    monkeypatch.setattr(spatial, "radius_join", lambda left, right, metres: radii.append(metres) or join(left, right, metres))
    assert catalogue.QUERIES["identity_parents"](spark, sf_dir).columns and radii == [identity.CHILD_M]


def test_records_are_resolved_by_few_pairs(spark):
    """of 600 records on a few blocks, resolution by the deciding pairs equals that by all pairs, which are many times more."""
    rng = np.random.default_rng(4)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    names = ["Blue Cafe", "Blue", "The Blue Cafe Garden", "Old Mill", "Old Mill Theater House", "", None]
    rows = [(i, pick(*names), pick("cafe", "shop", None), 40.7 + int(rng.integers(40)) * 1e-4, -74.0 + int(rng.integers(40)) * 1e-4, pick(None, None, "acme"), pick(None, "https://a.example", "https://b.example"),
             pick(None, None, "914 555 0101", "914 555 0102"), pick(None, "1", "2"), pick(None, "Main St."), pick(None, None, None, ["x"], ["x", "y"], [None])) for i in rng.permutation(600).tolist()]
    kind = "record_id long, name string, category string, lat double, lon double, brand string, website string, phone string, number string, street string, xids array<string>"
    records = spark.createDataFrame(rows, kind)
    every, few = identity.scored_pairs(records).localCheckpoint(), identity.deciding_pairs(records)
    one = lambda pairs: sorted(map(tuple, identity.resolve(records, pairs).collect()))
    got = one(few)
    assert got == one(every) and {r[2] for r in got} == {"auto", "review", "new"}
    assert few.count() <= 6 * 600 < every.count() / 5


def test_a_poll_reads_and_writes_the_state_of_many_records_once():
    """64 records take one read and one write of state and one timer, which rings for every record that event time has passed."""
    calls = []
    value = {}
    state = SimpleNamespace(get=lambda: calls.append("get") or value.get("records"), update=lambda v: calls.append("update") or value.update(records=v), clear=lambda: calls.append("clear") or value.clear())
    handle = SimpleNamespace(getValueState=lambda *_: state, registerTimer=lambda at: calls.append(at), deleteTimer=lambda at: calls.append(-at))
    follower = polls.Follower()
    follower.init(handle)
    row = lambda i, seen: (i, i, 0, None, seen, 1, None, 100 + i, "a", 50, 0)
    assert [r.what for r in follower.handleInputRows((0,), iter([row(i, i < 64) for i in range(65)]), None)] == ["new"] * 64 + ["unheld"]
    assert calls == ["get", 100, "update"]
    calls.clear()
    due = list(follower.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 110), SimpleNamespace(getExpiryTimeInMs=lambda: 100)))
    assert [(r.id, r.seq, r.at, r.what) for r in due] == [(i, -1, 100 + i, "due") for i in range(10)]
    assert calls == ["get", 110, "update"] and len(value["records"][0]) == 64


def test_names_are_compared_before_pairs_are_made(spark, sf_dir, monkeypatch):
    """the names of two groups are compared once, not for each pair of their records; all pairs are those of `scored_pairs`."""
    plan = catalogue.QUERIES["pair_scores"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("array_intersect") > plan.rindex("explode(_b")
    rng = np.random.default_rng(5)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    names = ["Blue Cafe", "Blue", "The Blue Cafe Garden", "Old Mill", "Old Mill Theater House", "", None]
    rows = [(i, pick(*names), pick("cafe", "shop", None), 40.7 + int(rng.integers(8)) * 1e-3, -74.0 + int(rng.integers(8)) * 1e-3, pick(None, None, "acme"), pick(None, "https://a.example", "https://b.example"),
             pick(None, None, "914 555 0101", "914 555 0102"), pick(None, "1", "2"), pick(None, "Main St."), pick(None, None, None, ["x"], ["x", "y"], [None])) for i in rng.permutation(600).tolist()]
    kind = "record_id long, name string, category string, lat double, lon double, brand string, website string, phone string, number string, street string, xids array<string>"
    records = spark.createDataFrame(rows, kind)
    monkeypatch.setattr(spatial, "AT_ONCE", 3)
    assert sorted(map(tuple, identity.every_pair(records).collect())) == sorted(map(tuple, identity.scored_pairs(records).collect()))


def test_a_book_sorts_its_rows_once(spark, tmp_path):
    """the newest row of a key is found without sorting all rows before they meet as well as after."""
    book = publish.Book.create(spark, str(tmp_path / "book"), {"t": ("k long, v string", ["k"])})
    for no, v in enumerate(["a", None, "b"]):
        assert book.publish(f"batch {no}", {"t": spark.createDataFrame([(1, v, v is None), (2, "x", no == 2)], "k long, v string, gone boolean")}, lambda wrote: {})
    rows = book.rows("t")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Sort [") == 1
    assert [tuple(r) for r in rows.collect()] == [(1, "b")]
