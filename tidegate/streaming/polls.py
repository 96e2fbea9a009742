"""Records followed over polls of their sources: a stateful stream with event-time timers.

Each poll brings the rows of the snapshots read since: a record that a snapshot
lists, or one that a complete snapshot lacks. What is stale changes nothing; a
date that a record names, such as a closing date, comes due when event time
passes it; a record gone for long enough is forgotten, so state does not grow
with all that ever was.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidegate.session import shared_path

DAY_MS = 86_400_000
#: Days after which a record that is gone is forgotten.
KEEP_DAYS = 5
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS = "id long, seq long, arrived long, as_of timestamp, seen boolean, version long, edited long, due long, content string"
OUTCOMES = "id long, seq long, at long, what string"
STATE = "records array<struct<id: long, version: long, newest: long, absent: long, due: long, content: string>>"
#: Records whose ids agree but for this many bits share a state, so that a poll reads and writes it once for all of them.
SHARED_BITS = 6


#: What Follower reads: the columns of ROWS, then the time of data in milliseconds and what records of one state share.
READ = ["id", "seq", "arrived", "as_of", "seen", "version", "edited", "due", "content", "at", "shared"]
OUTCOME = Row("id", "seq", "at", "what")


def _place(row: tuple) -> tuple:
    """Rows go by arrival and number, unknown ones last."""
    _, seq, arrived, *_ = row
    return arrived is None, arrived or 0, seq is None, seq or 0


class Follower(StatefulProcessor):
    """The state of up to 2 ** SHARED_BITS records, of each its version, its newest snapshot, when it was found missing, what it said and what comes due.

    A record has one timer at most: the date that it names while it is there,
    or the day it is forgotten once it is gone. The first of them is the
    state's timer, and when it goes off, so does all that event time has passed.
    """

    def __init__(self, keep_days: int = KEEP_DAYS):
        self.keep = keep_days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("records", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        was = self._records()
        records = dict(was)
        for record, seq, _, _, seen, version, edited, due, content, at, _ in sorted(map(tuple, rows), key=_place):  # a record's rows of one poll: one a snapshot
            held = records.get(record)
            held, outcome = self._seen(held, edited, (version, at, None, due, content)) if seen else self._absent(held, at)
            if held is not None:
                records[record] = held
            yield OUTCOME(record, seq, at, outcome)
        before, after = self._first_timer(was), self._first_timer(records)
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)
        self._keep(was, records)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        was = self._records()
        records = dict(was)
        for record, held in was.items():
            at = self._timer(held)
            if at is None or at >= passed:
                continue
            version, newest, absent, _, content = held
            if absent is None:
                records[record] = (version, newest, None, None, content)
            else:
                del records[record]
            yield OUTCOME(record, -1, at, "due" if absent is None else "forgotten")
        if (after := self._first_timer(records)) is not None:
            self.handle.registerTimer(after)
        self._keep(was, records)

    def _records(self) -> dict[int, tuple]:
        kept = self.state.get()
        return {record: tuple(held) for record, *held in kept[0]} if kept else {}

    def _keep(self, was: dict[int, tuple], records: dict[int, tuple]) -> None:
        if not records and was:
            self.state.clear()
        elif records != was:
            self.state.update(([(record, *held) for record, held in records.items()],))

    def _first_timer(self, records: dict[int, tuple]) -> int | None:
        return min((at for held in records.values() if (at := self._timer(held)) is not None), default=None)

    def close(self) -> None:
        pass

    def _timer(self, held: tuple | None) -> int | None:
        if held is None:
            return None
        _, _, absent, due, _ = held
        return due if absent is None else absent + self.keep

    @staticmethod
    def _absent(held: tuple | None, at: int) -> tuple[tuple | None, str]:
        if held is None:
            return None, "unheld"
        version, newest, absent, _, content = held
        if at < newest:
            return held, "behind"
        return (version, at, at, None, content), "gone" if absent is None else "still gone"

    @staticmethod
    def _seen(held: tuple | None, edited: float | None, said: tuple) -> tuple[tuple, str]:
        if held is None:
            return said, "new"
        (version, newest, absent, due, content), (own, at, _, named, says) = held, said
        newest = max(newest, at)
        lower = version is not None and own is not None and own < version
        missed = absent is not None and at < absent and not (edited is not None and edited > absent)
        if lower or missed:
            return (version, newest, absent, due, content), "older"
        return (own, newest, None, named, says), "unchanged" if absent is None and says == content else "changed"


def follow(rows: DataFrame, late: str, keep_days: int = KEEP_DAYS) -> DataFrame:
    """(id, seq, at, what) of a stream with the columns ROWS: what each row did, and what came due (seq -1).

    For a listed record: new, changed, unchanged, or older (a lower version than
    the one held, or from before it was found missing, unless edited since). For
    a missing one: gone, still gone, behind (from before its newest snapshot, so
    nothing is withdrawn) or unheld. An unknown version is never lower. Times
    are in milliseconds; rows later than `late` behind the newest are dropped, and so are
    rows without id, time of data or `seen`.
    """
    timed = rows.where("id is not null and as_of is not null and seen is not null").withWatermark("as_of", late)
    read = timed.withColumn("at", F.unix_millis("as_of")).withColumn("shared", F.shiftright("id", SHARED_BITS)).select(*READ)
    return read.groupBy("shared").transformWithState(Follower(keep_days), OUTCOMES, "append", "EventTime")


def replay(spark: SparkSession, polls: Iterable[DataFrame], late: str, keep_days: int = KEEP_DAYS) -> DataFrame:
    """The outcomes of polls read one after the other, each run taking up the last one's checkpoint.

    Rows, state and outcomes are in the shared folder; a run that is lost starts
    again from its checkpoint, and the sink's own log keeps outcomes from
    appearing twice. Every run ends once event time has passed over what it read.
    """
    home = shared_path(spark, "polls")
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for poll in polls:
            poll.write.mode("append").parquet(f"{home}/rows")
            came = spark.readStream.schema(ROWS).parquet(f"{home}/rows")
            run = follow(came, late, keep_days).writeStream.format("parquet").option("checkpointLocation", f"{home}/state").option("path", f"{home}/outcomes")
            run.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if kept is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    return spark.read.schema(OUTCOMES).parquet(f"{home}/outcomes")
