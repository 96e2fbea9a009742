"""Records followed over polls: what each row does, and a small stream read twice; the query is held to its SQL in test_catalogue."""

from datetime import datetime, timezone

import pytest

from tidegate.streaming import polls
from tidegate.streaming.polls import Follower

HELD = (5, 100, None, 900, "a")
GONE = (5, 100, 100, None, "a")


@pytest.mark.parametrize("held, edited, said, after, what", [
    (None, None, (1, 50, None, None, "x"), (1, 50, None, None, "x"), "new"),
    (HELD, None, (5, 200, None, 900, "a"), (5, 200, None, 900, "a"), "unchanged"),
    (HELD, None, (6, 200, None, None, "b"), (6, 200, None, None, "b"), "changed"),
    (HELD, None, (4, 200, None, 300, "b"), (5, 200, None, 900, "a"), "older"),
    (HELD, None, (None, 90, None, 300, "b"), (None, 100, None, 300, "b"), "changed"),
    (GONE, None, (6, 90, None, None, "b"), GONE, "older"),
    (GONE, 101, (6, 90, None, None, "b"), (6, 100, None, None, "b"), "changed"),
    (GONE, None, (5, 100, None, None, "a"), (5, 100, None, None, "a"), "changed"),
])
def test_what_a_listed_record_does(held, edited, said, after, what):
    assert Follower._seen(held, edited, said) == (after, what)


@pytest.mark.parametrize("held, at, after, what", [
    (None, 50, None, "unheld"), (HELD, 99, HELD, "behind"), (HELD, 100, GONE, "gone"), (GONE, 150, (5, 150, 150, None, "a"), "still gone"),
])
def test_what_a_missing_record_does(held, at, after, what):
    assert Follower._absent(held, at) == (after, what)


def test_polls_take_up_where_the_last_one_ended(spark):
    day = polls.DAY_MS
    at = lambda d: datetime.fromtimestamp(d * 86400, timezone.utc)
    rows = lambda *rs: spark.createDataFrame(list(rs), polls.ROWS)
    runs = [
        rows((1, 1, day, at(1), True, 1, None, 4 * day, "a"), (2, 2, day, at(1), True, 1, None, None, "b"), (None, 3, day, at(1), True, 1, None, None, "c"), (3, 4, day, None, True, 1, None, None, "d")),
        rows((2, 5, 2 * day, at(2), False, None, None, None, None), (2, 6, 2 * day, at(2), False, None, None, None, None)),
        rows(),
        rows((9, 7, 8 * day, at(8), True, 1, None, None, None)),
        rows((2, 8, 9 * day, at(9), True, 0, None, None, "b")),
    ]
    got = {(r.id, r.seq, r.at // day, r.what) for r in polls.replay(spark, runs, "1 hour").collect()}
    assert got == {(1, 1, 1, "new"), (2, 2, 1, "new"), (2, 5, 2, "gone"), (2, 6, 2, "still gone"), (1, -1, 4, "due"), (9, 7, 8, "new"), (2, -1, 7, "forgotten"), (2, 8, 9, "new")}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != polls.ROCKS
