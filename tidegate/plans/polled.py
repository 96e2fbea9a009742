"""The query of records followed over polls, with its SQL.

The given events stand for snapshots' rows: an error is a complete snapshot
that lacks the record, all else lists it. Rows arrive up to six hours after
their snapshot, and a poll brings those of eight days.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.session import cut, table
from tidegate.streaming import polls

LATE = "7 hours"
POLL_MS = 8 * polls.DAY_MS


def _rows(spark, d):
    e = table(spark, d, "events").where("user_id is not null and ts is not null")
    k, at = F.col("event_id"), F.unix_millis(F.col("ts").cast("timestamp"))
    arrived = at + k * 7919 % 21600 * 1000
    return e.select(
        (F.col("user_id") * 4 + k % 4).alias("id"), k.alias("seq"), arrived.alias("arrived"), F.timestamp_millis(at).alias("as_of"), (F.coalesce("event_type", F.lit("")) != "error").alias("seen"),
        F.when(k % 41 != 0, F.floor(at / polls.DAY_MS) - F.when(k % 5 == 0, 3).otherwise(0)).alias("version"), F.when(k % 3 != 0, at - k % 13 * 3_600_000).alias("edited"),
        F.when(k % 2 == 0, at + k % 9 * polls.DAY_MS).alias("due"), (k % 8 % 3).cast("string").alias("content"), F.floor(arrived / POLL_MS).alias("poll"),
    )


def polled_records(spark, d):
    rows = cut(_rows(spark, d), "arrivals")
    first, last = rows.agg(F.min("poll"), F.max("poll")).first()
    each = range(first, last + 1) if first is not None else []
    runs = (rows.where(F.col("poll") == p).drop("poll") for p in each)
    return polls.replay(spark, runs, LATE) if each else spark.createDataFrame([], polls.OUTCOMES)


# A record's rows one after the other: `t` is its timer before a row, `w` the event time passed by the end of the poll before.
_SQL = f"""WITH RECURSIVE e AS (SELECT event_id AS k, user_id * 4 + event_id % 4 AS id, epoch_us(ts) // 1000 AS m, coalesce(event_type, '') <> 'error' AS seen FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
  a AS (SELECT *, m + k * 7919 % 21600 * 1000 AS arrived, CASE WHEN k % 41 <> 0 THEN m // {polls.DAY_MS} - CASE WHEN k % 5 = 0 THEN 3 ELSE 0 END END AS version, CASE WHEN k % 3 <> 0 THEN m - k % 13 * 3600000 END AS edited,
    CASE WHEN k % 2 = 0 THEN m + k % 9 * {polls.DAY_MS} END AS due, k % 8 % 3 AS content FROM e),
  p AS (SELECT *, arrived // {POLL_MS} AS poll, row_number() OVER (PARTITION BY id ORDER BY arrived, k) AS n FROM a),
  w AS (SELECT poll, max(max(m)) OVER (ORDER BY poll) - 7 * 3600000 AS passed FROM p GROUP BY poll),
  r AS (SELECT p.*, coalesce((SELECT max(passed) FROM w WHERE w.poll < p.poll), 0) AS w FROM p),
  s AS (
    SELECT id, 0::BIGINT AS n, NULL::BIGINT AS k, NULL::BIGINT AS tm, NULL::VARCHAR AS what, NULL::BIGINT AS fired, NULL::VARCHAR AS firing, -1::BIGINT AS poll, false AS held, NULL::BIGINT AS version, NULL::BIGINT AS newest, NULL::BIGINT AS absent, NULL::BIGINT AS due, NULL::BIGINT AS content FROM r WHERE n = 1
    UNION ALL
    SELECT id, n, k, m, what, fired, firing, poll,
      what NOT IN ('unheld'), CASE WHEN what IN ('new', 'changed', 'unchanged') THEN v ELSE version END,
      CASE WHEN what = 'unheld' THEN NULL WHEN what = 'behind' THEN newest ELSE greatest(newest, m) END,
      CASE WHEN what IN ('gone', 'still gone') THEN m WHEN what IN ('older', 'behind') THEN absent END,
      CASE WHEN what IN ('new', 'changed', 'unchanged') THEN d WHEN what IN ('older', 'behind') THEN due END,
      CASE WHEN what IN ('new', 'changed', 'unchanged') THEN c ELSE content END
    FROM (SELECT *, CASE WHEN seen AND NOT held THEN 'new' WHEN NOT held THEN 'unheld' WHEN NOT seen AND m < newest THEN 'behind' WHEN NOT seen AND absent IS NULL THEN 'gone' WHEN NOT seen THEN 'still gone'
        WHEN coalesce(v < version, false) OR coalesce(m < absent AND NOT coalesce(edited > absent, false), false) THEN 'older' WHEN absent IS NULL AND c = content THEN 'unchanged' ELSE 'changed' END AS what
      FROM (SELECT r.id, r.n, r.k, r.m, r.seen, r.poll, r.version AS v, r.edited, r.due AS d, r.content AS c, CASE WHEN rings THEN t END AS fired, CASE WHEN rings THEN CASE WHEN absent IS NULL THEN 'due' ELSE 'forgotten' END END AS firing,
          q.held AND NOT (rings AND absent IS NOT NULL) AS held, CASE WHEN rings AND absent IS NOT NULL THEN NULL ELSE q.version END AS version, CASE WHEN rings AND absent IS NOT NULL THEN NULL ELSE q.newest END AS newest,
          CASE WHEN rings THEN NULL ELSE absent END AS absent, CASE WHEN rings THEN NULL ELSE q.due END AS due, CASE WHEN rings AND absent IS NOT NULL THEN NULL ELSE q.content END AS content
        FROM (SELECT s.*, CASE WHEN absent IS NULL THEN due ELSE absent + {polls.KEEP_DAYS * polls.DAY_MS} END AS t FROM s) q JOIN r ON r.id = q.id AND r.n = q.n + 1,
          LATERAL (SELECT coalesce(r.poll > q.poll AND t < r.w, false) AS rings)))),
  z AS (SELECT id, CASE WHEN absent IS NULL THEN due ELSE absent + {polls.KEEP_DAYS * polls.DAY_MS} END AS t, CASE WHEN absent IS NULL THEN 'due' ELSE 'forgotten' END AS what FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1)
  SELECT id, k AS seq, tm AS at, what FROM s WHERE n > 0
  UNION ALL SELECT id, -1, fired, firing FROM s WHERE fired IS NOT NULL
  UNION ALL SELECT id, -1, t, what FROM z WHERE t < (SELECT max(passed) FROM w)"""

QUERIES = {"polled_records": polled_records}
ORACLES = {"polled_records": _SQL}
