"""All queries of the library itself, by name, with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegate.plans import crawl, evidence, feeds, food, gate, glue, ingest, places, polled, records, scores, shores, sky, stated

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**places.QUERIES, **evidence.QUERIES, **records.QUERIES, **glue.QUERIES, **gate.QUERIES, **feeds.QUERIES, **scores.QUERIES, **sky.QUERIES, **food.QUERIES, **shores.QUERIES, **crawl.QUERIES, **stated.QUERIES, **polled.QUERIES, **ingest.QUERIES}
ORACLES: dict[str, str] = {**places.ORACLES, **evidence.ORACLES, **records.ORACLES, **glue.ORACLES, **gate.ORACLES, **feeds.ORACLES, **scores.ORACLES, **sky.ORACLES, **food.ORACLES, **shores.ORACLES, **crawl.ORACLES, **stated.ORACLES, **polled.ORACLES, **ingest.ORACLES}
