"""Tables written in batches that show whole or not at all: staged, audited, then published by one row.

A batch's rows go to folders of its attempt, which no reader looks at until the
manifest names the attempt. Tables hold what each batch changed; a reader takes
the newest published row of a key. So a batch that fails, or a job that is lost
half way, leaves nothing to see, and a batch given again changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST = "batch string, attempt string, no long"


class Refused(ValueError):
    """A batch that its audit did not pass."""


class Book:
    """Tables under one folder that all machines share; `tables` gives each one's columns and its keys.

    Any number may read; batches come from one writer at a time.
    """

    def __init__(self, spark: SparkSession, home: str, tables: dict[str, tuple[str, list[str]]]):
        self.spark, self.home, self.tables = spark, home, tables

    @classmethod
    def create(cls, spark: SparkSession, home: str, tables: dict[str, tuple[str, list[str]]]) -> Book:
        """A new book with nothing published."""
        book = cls(spark, home, tables)
        spark.createDataFrame([], MANIFEST).write.parquet(f"{home}/manifest")
        for name in tables:
            spark.createDataFrame([], book._columns(name)).write.parquet(f"{home}/{name}/attempt=none")
        return book

    def _columns(self, name: str) -> str:
        return f"{self.tables[name][0]}, gone boolean"

    def _staged(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{self._columns(name)}, attempt string").parquet(f"{self.home}/{name}")

    def manifest(self) -> DataFrame:
        """(batch, attempt, no): what is published, in order."""
        return self.spark.read.schema(MANIFEST).parquet(f"{self.home}/manifest")

    def has(self, batch: str) -> bool:
        """Whether the batch is published."""
        return not self.manifest().where(F.col("batch") == batch).isEmpty()

    def rows(self, name: str, of: DataFrame | None = None) -> DataFrame:
        """A table as published: of each key the newest row, unless that says it is gone; of the keys in `of` alone, where given."""
        staged = self._staged(name)
        staged = staged if of is None else staged.join(of, of.columns, "left_semi")
        kept = [c for c in staged.columns if c not in ("attempt", "gone")]
        # a batch has a key once, so the newest row is the one of the key's last batch; rows are sorted once, after they meet
        last = F.max("no").over(Window.partitionBy(*self.tables[name][1]))
        newest = staged.join(F.broadcast(self.manifest().select("attempt", "no")), "attempt").withColumn("_last", last)
        return newest.where("no = _last and not gone").select(*kept)

    def publish(self, batch: str, tables: dict[str, DataFrame], audit: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> bool:
        """Stages the tables, audits what was written, and publishes it; false for a batch published before.

        The audit names rows that must not be; any such row refuses the batch,
        and two rows of one key always do.
        """
        if self.has(batch):
            return False
        attempt = uuid.uuid4().hex

        def write(name: str) -> None:
            tables[name].select(*self._staged(name).drop("attempt").columns).write.mode("append").parquet(f"{self.home}/{name}/attempt={attempt}")

        # the tables' jobs are small beside what starting them takes, and none waits for another
        with ThreadPoolExecutor(len(tables)) as pool:
            list(pool.map(write, tables))
        wrote = {name: self._staged(name).where(F.col("attempt") == attempt).drop("attempt") for name in tables}
        faults = {f"{name}: a key twice": rows.groupBy(*self.tables[name][1]).count().where("count > 1") for name, rows in wrote.items()}
        faults |= audit(wrote)
        with ThreadPoolExecutor(len(faults)) as pool:
            for what, none in zip(faults, pool.map(lambda rows: rows.isEmpty(), faults.values()), strict=True):
                if not none:
                    raise Refused(f"{batch}: {what}")
        last = self.manifest().agg(F.coalesce(F.max("no"), F.lit(0))).first()[0]
        self.spark.range(1).select(F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt"), F.lit(last + 1).cast("long").alias("no")).coalesce(1).write.mode("append").parquet(f"{self.home}/manifest")
        return True
