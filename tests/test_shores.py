"""Crossing a water, against a plain walk along the trip and known pairs of places."""

import math
import random

from pyspark.sql import functions as F

from tidegate.functions import geo, water

LINE = [water.BRIDGE, *water.MIDDLE]


def middle(x):
    for (x0, y0), (x1, y1) in zip(LINE, LINE[1:]):
        if x0 <= x <= x1:
            return y0 + (x - x0) / (x1 - x0) * (y1 - y0)


def crosses_by_steps(a, b, steps=4000):
    """Looks at both shores of many points of the trip; None where it comes too near to tell."""
    seen, near = set(), False
    for i in range(steps + 1):
        lat, lon = (p + (q - p) * i / steps for p, q in zip(a, b))
        m = middle(lon) if LINE[0][0] <= lon <= LINE[-1][0] else None
        if m is not None:
            seen.add(lat > m)
    return len(seen) == 2


def metres(a, b):
    p, q = map(math.radians, (a[0], b[0]))
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(math.sqrt(h))


def answers(spark, trips):
    rows = spark.createDataFrame([(i, *a, *b) for i, (a, b) in enumerate(trips)], "i int, a double, b double, c double, d double")
    ends = [F.col(c) for c in "abcd"]
    return [(r.x, r.m) for r in rows.select("i", water.crosses(*ends).alias("x"), water.trip_m(*ends).alias("m")).orderBy("i").collect()]


NEW_ROCHELLE, DAVENPORT_NECK, PORT_WASHINGTON, FLUSHING, CITY_ISLAND, PELHAM_BAY = (40.911, -73.782), (40.898, -73.771), (40.826, -73.698), (40.763, -73.830), (40.847, -73.787), (40.866, -73.806)


def test_places_on_one_shore_never_cross(spark):
    pairs = [(NEW_ROCHELLE, PORT_WASHINGTON), (PORT_WASHINGTON, NEW_ROCHELLE), (NEW_ROCHELLE, DAVENPORT_NECK), (FLUSHING, PORT_WASHINGTON), (CITY_ISLAND, PELHAM_BAY), (NEW_ROCHELLE, FLUSHING), (NEW_ROCHELLE, NEW_ROCHELLE)]
    got = answers(spark, pairs)
    assert [x for x, _ in got] == [True, True, False, False, False, False, False]
    bridge = (water.BRIDGE[1], water.BRIDGE[0])
    assert abs(got[0][1] - metres(NEW_ROCHELLE, bridge) - metres(bridge, PORT_WASHINGTON)) < 1e-3 and abs(got[0][1] - got[1][1]) < 1e-6
    assert abs(got[2][1] - metres(NEW_ROCHELLE, DAVENPORT_NECK)) < 1e-3


def test_edges(spark):
    """Due north, through a vertex, along the line, touching its end, beyond it, and unknown points."""
    trips = [((40.8, -73.5), (41.1, -73.5)), ((41.1, -73.5), (40.8, -73.5)), ((41.0, -73.55), (41.1, -73.55)), ((40.92, -73.7), (40.88, -73.7)), ((40.9, -73.7), (40.94, -73.6)), ((40.9, -73.7), (40.95, -73.75)), ((40.5, -73.9), (41.5, -73.9)), ((40.5, -71.0), (42.5, -71.0)), ((None, -73.7), (40.8, -73.6))]
    assert [x for x, _ in answers(spark, trips)] == [True, True, False, True, False, False, False, False, None]


def test_random_trips_cross_where_their_points_do(spark):
    pick = random.Random(3)
    point = lambda: (pick.uniform(40.6, 41.5), pick.uniform(-74.0, -71.6))
    trips = [(point(), point()) for _ in range(1500)]
    got = answers(spark, trips)
    wrong = [t for t, (x, _) in zip(trips, got) if x != crosses_by_steps(*t)]
    assert len(wrong) <= 2  # a trip may cut a corner between two steps
    assert sum(x for x, _ in got) > 300 and all(m >= metres(*t) - 1e-6 for t, (_, m) in zip(trips, got))
