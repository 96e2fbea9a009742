"""Queries over small tables made for a fault of the fourth round that the given tables show only at size, each against its SQL."""

import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tests.test_findings_r03 import on_tables  # noqa: F401
from tidegate.functions import water
from tidegate.operators import identity, ordering, spatial
from tidegate.plans import catalogue


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_searches_and_places_alike_meet_once(spark, sf_dir, on_tables):  # noqa: F811
    """40 searches of four points and 600 places of 200 are paired once a point, in plain columns; all of them count."""
    tables = {"supplier": "SELECT i % 4 * 5 + i // 4 * 8400 AS s_suppkey FROM range(40) r(i)", "customer": "SELECT i % 200 * 7 + i // 200 * 3291097 AS c_custkey FROM range(600) r(i)"}
    got, want = on_tables("reach_over_water", **tables)
    assert got == want and len(got) == 30 and sum(r[3] for r in got) > 0 and all(r[2] % 3 == 0 for r in got)
    plan = _optimized(catalogue.QUERIES["reach_over_water"](spark, sf_dir))
    assert plan[plan.rindex("Join") :].count("Aggregate [") == 2 and "exists(" not in plan


def test_a_crossing_in_steps_is_that_of_the_expression(spark):
    """also for trips due north, through a vertex, along the line, touching its end and beyond it."""
    pick = random.Random(4)
    point = lambda: (pick.uniform(40.6, 41.5), pick.uniform(-74.0, -71.6))
    knots = [(y, x) for x, y in [water.BRIDGE, *water.MIDDLE]]
    edges = [((40.8, -73.5), (41.1, -73.5)), ((40.92, -73.7), (40.88, -73.7)), ((40.9, -73.7), (40.94, -73.6)), ((40.9, -73.7), (40.95, -73.75)), ((40.5, -73.9), (41.5, -73.9)), ((40.5, -71.0), (42.5, -71.0))]
    trips = edges + [(b, a) for a, b in edges] + [(a, b) for a in knots for b in knots] + [(point(), pick.choice(knots)) for _ in range(300)] + [(point(), point()) for _ in range(1500)]
    rows = spark.createDataFrame([(*a, *b) for a, b in trips], "a double, b double, c double, d double").withColumns({"m": water.middle_at(F.col("b")), "n": water.middle_at(F.col("d"))})
    got = water.crossed(rows, "over", ("a", "b", "m"), ("c", "d", "n")).withColumn("want", water.crosses(*map(F.col, "abcd")))
    assert got.where("over <> want").isEmpty() and got.where("over").count() > 300


KIND = "record_id long, name string, category string, lat double, lon double, brand string, website string, phone string, number string, street string, xids array<string>"


def _records(spark, n, points=8, seed=6):
    pick = random.Random(seed)
    names = ["Blue Cafe", "Blue", "The Blue Cafe Garden", "Old Mill", "Old Mill Theater House", "", None]
    ids = pick.sample(range(n), n)
    rows = [(i, pick.choice(names), pick.choice(["cafe", "shop", None]), 40.7 + pick.randrange(points) * 4e-4, -74.0 + pick.randrange(points) * 4e-4, pick.choice([None, None, "acme"]), pick.choice([None, "https://a.example", "https://b.example"]),
             pick.choice([None, None, "914 555 0101", "914 555 0102"]), pick.choice([None, "1", "2"]), pick.choice([None, "Main St."]), pick.choice([None, None, None, ["x"], ["x", "y"], [None]])) for i in ids]
    return spark.createDataFrame(rows, KIND)


def test_rows_of_two_points_are_laid_out_in_one_order(spark, sf_dir):
    """F2: two points meet in both orders, but their rows are laid out in one; all pairs are those of `scored_pairs`, smaller id first."""
    plan = _optimized(catalogue.QUERIES["pair_scores"](spark, sf_dir))
    assert re.search(r"low <= _q#\d+\.low", plan) and plan.index("rows") < plan.index("ASIN")
    records = _records(spark, 500)
    got, want = (sorted(map(tuple, rows.collect())) for rows in (identity.every_pair(records), identity.scored_pairs(records)))
    assert got == want and len(got) > 20_000 and all(r[0] < r[1] for r in got)


def test_parents_are_found_by_groups_of_records_alike(spark, monkeypatch):
    """of 2,000 records at 16 points, a row for each name of a point and each name it goes with meets the others; the parents are those of all pairs."""
    seen, join = [], spatial.radius_join
    records = _records(spark, 2000, points=4)
    want = sorted(map(tuple, identity.parents(identity.scored_pairs(records, identity.CHILD_M)).collect()))
    monkeypatch.setattr(spatial, "radius_join", lambda left, right, metres: seen.extend([left.count(), right.count()]) or join(left, right, metres))
    got = sorted(map(tuple, identity.best_parents(records).collect()))
    assert got == want and len(got) > 500 and max(seen) <= 16 * 14


def test_few_rows_of_a_request_are_ordered_in_its_task(spark, monkeypatch):
    """of two requests' rows, those apart and the worse ones of rows alike stay out of the request's task; the order is that of all rows together."""
    rng = np.random.default_rng(9)
    n = 1500
    pick = lambda *x: rng.choice(np.array(x, dtype=object), 2 * n)
    rows = pd.DataFrame({"request_id": np.repeat([1, 2], n), "option_id": np.tile(np.arange(n), 2), "venue_id": np.tile(np.arange(n) // 2 * 2 + (np.arange(n) % 10 > 1) * (np.arange(n) % 2), 2), "name_key": pick("", "a", "b", "c", "d", *(f"n{i}" for i in range(3000)))})
    rows["parent_id"] = np.where(rows["venue_id"] % 20 == 4, rows["venue_id"] + 1, np.nan)
    alike = rows.index % 3 == 0
    rows.loc[alike, "name_key"] = "chain " + (rows.index[alike] % 30).astype(str)
    rows["category"], rows["kind"] = pick("cafe", "park"), pick(None, "x", "y")
    rows["activity"] = rows["category"].map({"cafe": "eat", "park": "outdoors"})
    rows["lat"], rows["lon"] = 40.7 + rows.index % 30 * 1e-3, -74.0
    rows["standing"], rows["merit"] = pick("ready", "ready", "check_first"), np.round(rng.random(2 * n), 2)
    rows["taste"], rows["lead"] = pick(0.3, 0.5, 0.7, 0.9).astype(float), pick(None, "jazz", "art", "film")
    rows["off"], rows["age_doubt"] = rng.random(2 * n) < 0.05, rng.random(2 * n) < 0.05
    rows = rows.sort_values(["request_id", "standing", "merit", "option_id"], ascending=[True, False, False, True], ignore_index=True)
    rows["rank"] = rows.groupby("request_id").cumcount() + 1
    kinds = "request_id long, option_id long, venue_id long, name_key string, parent_id double, category string, kind string, activity string, lat double, lon double, standing string, merit double, taste double, lead string, off boolean, age_doubt boolean, rank int"
    columns = [c.split()[0] for c in kinds.split(", ")]
    df = spark.createDataFrame([tuple(None if x is None or x != x else x for x in r) for r in rows[columns].astype(object).itertuples(index=False, name=None)], kinds).withColumn("parent_id", F.col("parent_id").cast("long"))
    monkeypatch.setattr(ordering, "MOST", 20)
    want = {}
    for request, group in rows.groupby("request_id"):
        group = group.reset_index(drop=True)
        shown = ordering.first_page_loves(group.iloc[ordering.arrange(group)])
        want |= {(request, o): i for i, o in enumerate(shown["option_id"].tolist(), 1)}
    assert {(r.request_id, r.option_id): r.shown for r in ordering.display_order(df).collect()} == want and len(want) > 1000
    kept = ordering._deciding(ordering._told(df))
    assert kept.count() < 0.9 * len(rows) and kept.where("not apart").count() < 0.6 * len(rows)
