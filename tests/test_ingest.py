"""Batches that show whole or not at all, and the checks of an event file by hand-made rows; the query is held to its SQL in test_catalogue."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegate.operators import event_ingest, publish

NOW = datetime(2026, 5, 1, 12)
TABLE = {"t": ("k long, v string", ["k"])}


@pytest.fixture
def book(spark, tmp_path):
    return publish.Book.create(spark, str(tmp_path / "book"), TABLE)


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k long, v string, gone boolean")


def shown(book):
    return sorted(map(tuple, book.rows("t").collect()))


def test_a_batch_shows_whole_or_not_at_all(spark, book):
    none = lambda wrote: {}
    assert book.publish("one", {"t": rows(spark, (1, "a", False), (2, "b", False))}, none)
    with pytest.raises(publish.Refused, match="bad"):
        book.publish("two", {"t": rows(spark, (1, "x", False), (3, "bad", False))}, lambda wrote: {"bad": wrote["t"].where("v = 'bad'")})
    with pytest.raises(publish.Refused, match="twice"):
        book.publish("two", {"t": rows(spark, (1, "x", False), (1, "y", False))}, none)
    assert shown(book) == [(1, "a"), (2, "b")]
    assert book.publish("two", {"t": rows(spark, (1, "c", False), (2, None, True))}, none)
    assert not book.publish("two", {"t": rows(spark, (1, "d", False))}, none)
    assert shown(book) == [(1, "c")]
    assert book.publish("three", {"t": rows(spark)}, none) and book.publish("four", {"t": rows(spark, (2, "e", False))}, none)
    assert shown(book) == [(1, "c"), (2, "e")] and sorted(map(tuple, book.rows("t", of=spark.createDataFrame([(2,), (9,)], "k long")).collect())) == [(2, "e")]


@pytest.mark.parametrize("change, reason", [
    ({}, None), ({"id": None}, "id: missing"), ({"title": " "}, "title: missing"), ({"start_at": None}, "start: missing"), ({"end_at": NOW}, "end: before the start"),
    ({"end_at": NOW + timedelta(days=16)}, "end: runs too long"), ({"start_at": NOW + timedelta(days=401), "end_at": None}, "start: too far ahead"), ({"start_at": NOW - timedelta(hours=3), "end_at": None}, "already over"),
    ({"venue": ""}, "place: missing"), ({"venue": None, "place": "Pier", "lat": 41.0, "lon": -73.95}, "place: outside the area"), ({"venue": None, "place": "Pier", "lat": 40.75, "lon": -73.95}, None), ({"facts": None}, None),
])
def test_what_a_row_lacks(spark, change, reason):
    row = {"line": 1, "id": "a", "venue": "v1", "place": None, "lat": None, "lon": None, "title": "T", "start_at": NOW + timedelta(days=1), "end_at": NOW + timedelta(days=2), "status": None, "facts": {"kind": "x"}} | change
    file = spark.createDataFrame([tuple(row.values())], event_ingest.FILE)
    got = event_ingest.checked(file, F.lit(NOW), (40.75, -73.95), 3000.0).first()
    assert got.reason == reason


def test_a_file_with_no_good_row_is_refused_and_an_empty_one_withdraws(spark, tmp_path):
    book = publish.Book.create(spark, str(tmp_path / "events"), event_ingest.TABLES)
    good = (1, "a", "v1", None, None, None, "T", NOW + timedelta(days=1), None, None, {"kind": "x"})
    take = lambda batch, *rs: event_ingest.ingest(book, batch, spark.createDataFrame(list(rs), event_ingest.FILE), "feed", "north", F.lit(NOW), (40.75, -73.95), 3000.0)
    assert take("one", good)
    with pytest.raises(publish.Refused, match="no row"):
        take("two", (1, "b", "v1", None, None, None, "", NOW, None, None, None))
    assert book.rows("events").first().status == "scheduled" and book.rows("rejects").isEmpty()
    assert take("three") and book.rows("events").first().status == "withdrawn" and book.rows("listings").isEmpty() and book.rows("facts").count() == 1
