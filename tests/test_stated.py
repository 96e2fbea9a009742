"""Structured data of pages, against a recursive reader and pages written by hand."""

import json
import random

from pyspark.sql import functions as F

from tidegate.sources import structured


def flat(node):
    """The typed nodes of a tree, by recursion."""
    if isinstance(node, list):
        return [y for x in node for y in flat(x)]
    if not isinstance(node, dict):
        return []
    out = flat(node["@graph"]) if isinstance(node.get("@graph"), list) else []
    out += [node] if node.get("@type") else []
    return out + [y for k in ("location", "subEvent", "event", "mainEntity") if node.get(k) for y in flat(node[k])]


def tree(pick, depth):
    if depth == 0 or pick.random() < 0.15:
        return pick.choice([None, "x", 3, {}, [], {"name": "untyped"}])
    if pick.random() < 0.3:
        return [tree(pick, depth - 1) for _ in range(pick.randint(0, 3))]
    node = {"@type": pick.choice(["Store", ["Event", 5], "", None, "https://schema.org/Park"]), "name": pick.choice([str(pick.random()), 7, None])}
    for k in pick.sample(["@graph", "location", "subEvent", "event", "mainEntity", "other"], pick.randint(0, 4)):
        node[k] = tree(pick, depth - 1)
    return node


def test_walk_is_the_recursion():
    pick = random.Random(2)
    trees = [tree(pick, 6) for _ in range(800)]
    assert sum(len(flat(t)) for t in trees) > 1500
    for t in trees:
        assert structured.walk(t) == flat(t)
        assert [n["types"] for n in structured.read_block(json.dumps(t))] == [structured._types(n) for n in flat(t)]


def test_blocks_that_do_not_read_state_nothing():
    for bad in ("", "{", '{"@type": "Store",}', "// c\n{}", '{"@type": "Store", "x": NaN}', "[" * 100_000 + "]" * 100_000):
        assert structured.read_block(bad) == []
    deep = '{"@type": "Store", "location": ' * 300 + "null" + "}" * 300
    assert len(structured.read_block(deep)) == 300


def page(spark, rows):
    return spark.createDataFrame(rows, "page_id long, html string")


def ld(x):
    return f'<script type="application/ld+json">{json.dumps(x)}</script>'


def test_odd_pages(spark):
    week = {"@type": "Store", "openingHoursSpecification": {"dayOfWeek": ["Mo", "su", "Holiday", 4], "opens": "8:30", "closes": "24:00"}}
    none = {"@type": "Store", "openingHoursSpecification": [{"dayOfWeek": "Mo", "opens": "25:00", "closes": "26:00"}, "x", None], "openingHours": "Mo 09:00–17:00"}
    rows = [(1, None), (2, ""), (3, ld(week)), (4, ld(none)), (5, ld({"@type": "Store", "openingHours": "9 " * 600})), (6, ld({"@type": "Store", "name": 5, "telephone": ["1"], "priceRange": "$$$$$"})),
            (7, '<script type="application/ld+json">' + " " * 200_001 + "</script>"), (8, "<script " * 50_000), (9, '<a itemprop="openingHours" ' * 20_000), (10, '<i itemprop="openingHours">Mo 9:00-10:00</i>' * 40), (11, ld({"@type": "Store", "name": "a"}) + ld({"@type": "Park", "name": "b"}))]
    got = {}
    for r in structured.facts(page(spark, rows)).collect():
        got.setdefault(r.page_id, []).append((r.attribute, r.value, r.method))
    assert got.pop(3) == [("opening_hours", "1:510-1440 0:510-1440", "jsonld")]
    assert got.pop(4) == [("opening_hours", "Mo 09:00-17:00", "jsonld")]
    assert got.pop(6) == [("price", "unknown", "jsonld")]
    assert got.pop(10) == [("opening_hours", "Mo 9:00-10:00", "microdata")]
    assert sorted(got.pop(11)) == [("name", "a", "jsonld"), ("name", "b", "jsonld")]
    assert got == {}


def test_words_are_read_only_where_they_are_the_places_own(spark):
    html = "<hr><p>-</p><h2>Hours</h2><p>Monday - Friday: 9am - 5pm</p><p>Saturday: 10am - 4pm</p>"
    pages = page(spark, [(1, html), (2, html)])
    assert [r.page_id for r in structured.facts(pages, F.col("page_id") == 2).collect()] == [2]


def test_events_of_a_page(spark):
    e = lambda **x: {"@type": "Event", "name": "n", "startDate": "2024-05-01", **x}
    many = [e(name=f"e{i}", startDate="2024-05-01T10:00Z" if i % 2 else "soon") for i in range(250)]
    odd = [e(offers=[{"price": "abc"}, {"price": ""}, {"price": True}, {"price": " 1e1 "}, {"price": "NaN"}, 5]), e(startDate="2024-02-30"), e(startDate="2024-13-01T10:00"), e(startDate=5), e(name="x" * 500, startDate="2024-05-01 18:00", endDate="2024-05-01T20:00:00.5+02:00"), e(**{"@type": "Festival"}), e(offers={"price": "0"})]
    got = structured.events(page(spark, [(1, ld(many)), (2, ld(odd)), (3, None)])).orderBy("page_id", "place").collect()
    first, second = [r for r in got if r.page_id == 1], [r for r in got if r.page_id == 2]
    assert [r.title for r in first] == [f"e{i}" for i in range(1, 200, 2)] and first[0].place == 1 and not first[0].all_day
    assert [(r.low, r.high, r.free, r.all_day, len(r.title)) for r in second] == [(0.0, 10.0, False, True, 1), (None, None, False, False, 200), (0.0, 0.0, True, True, 1)]
    assert second[1].start_at.hour == 22 and second[1].end_at.hour == 18 and len(got) == 103
