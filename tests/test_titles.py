"""Titles of events and screenings, and names as sequences of words, by hand-made cases."""

import pytest
from pyspark.sql import functions as F

from tidegate.functions import labels, titles

FILMS = [
    ("Anora (35mm)", ["anora"]),
    ("Movie Night: Wicked", ["wicked"]),
    ("The Brutalist + Q&A", ["the brutalist q and a", "the brutalist"]),
    ("Mission: Impossible – Dead Reckoning", ["mission impossible dead reckoning"]),
    ("Free outdoor cinema under the stars | Amélie in 35 mm - conversation with the cast", ["amelie conversation with the cast", "amelie"]),
    ("Opening night: Nosferatu - with its filmmakers: Q & A", ["nosferatu with its filmmakers q and a", "nosferatu"]),
    ("Wicked Little Letters", ["wicked little letters"]),
    ("Movie-Night", ["night"]),
    ("Summer movies - Jaws 3D [open captioned]", ["jaws"]),
    ("In the Mood for Love : 4K restoration", ["in the mood for love restoration", "in the mood for love"]),
    ("Preview", ["preview"]),
    ("(35mm)", []),
    ("", []),
    (None, []),
]
NAMES = [
    ("hunan iii", "hunan 3", "same"),
    ("blue door", "bluedoor", "same"),
    ("blue", "blue door", None),
    ("hunan", "hunan garden", "prefix"),
    ("hunan garden two", "hunan", "prefix"),
    ("the hunan 3 annex", "hunan three", "within"),
    ("hunan", "hunans garden", None),
    ("", "hunan", None),
    (None, "hunan", None),
    ("red lantern", "lantern red", None),
]


def test_film_keys(spark):
    rows = spark.createDataFrame(FILMS, "title string, keys array<string>").select("title", "keys", titles.film_keys(F.col("title")).alias("got")).collect()
    assert {r.title: r.got for r in rows} == {r.title: r.keys for r in rows}


def test_names_meet_as_sequences_of_words(spark):
    rows = spark.createDataFrame(NAMES, "a string, b string, how string").select("a", "b", "how", labels.names_match(F.col("a"), F.col("b")).alias("got")).collect()
    assert [(r.a, r.b, r.got) for r in rows] == [(r.a, r.b, r.how) for r in rows]


@pytest.mark.parametrize("title, told", [
    (None, {}), ("", {}), ("!!", {}), ("jazz", {"live_music": 1.0}), ("Smart cart", {}), ("dance/opera", {"theatre": 1.0}),
    ("honey tastings - tasting", {"food": 1.0, "drinks": 1.0}), ("open  mic", {}), ("x" * 199 + " jazz", {}), ("pop-up shop", {"markets": 1.0}), ("popup", {}),
])
def test_title_interests(spark, title, told):
    row = spark.createDataFrame([(title,)], "t string").select(titles.title_interests(F.col("t")).alias("i"), titles.drink_title(F.col("t")).alias("d")).first()
    assert row.i == told and row.d == (told.get("drinks", 0) >= 1)
