"""Shards of nearly equal bytes by histogram sort.

Documents are ordered by the hash of their text, then by a hash of their id, so
equal texts stand together. Rounds of exact counts below candidate keys narrow
each boundary until the bytes below it are within the tolerance of the target;
only these counts reach the driver. A boundary that falls into a group of equal
texts moves to the group's nearer end; only a group too large for that, as one
that outweighs a shard, is cut. Then the documents move once.
"""

from __future__ import annotations

import bisect
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.llm.common import written

TOP = 1 << 128


def text_size(text: Column | str = "text") -> Column:
    """UTF-8 bytes of the text, null being empty, plus one."""
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1


def sort_key(key: str, text: str) -> tuple[Column, Column]:
    return F.xxhash64(F.coalesce(text, F.lit(""))), F.xxhash64(F.lit(1), F.col(key))


def _packed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """16-byte strings that compare as the pairs of signed numbers do as unsigned."""
    both = np.empty((len(high), 2), dtype=">u8")
    both[:, 0], both[:, 1] = high.astype(np.int64).view(np.uint64), low.astype(np.int64).view(np.uint64)
    return np.ascontiguousarray(both).view("S16").ravel()


def _bounds(keys: list[int]) -> np.ndarray:
    return np.array([k.to_bytes(16, "big") for k in keys], dtype="S16")


def _below(keys: DataFrame, probes: list[int]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows below each probe; probes are sorted."""
    sent = keys.sparkSession.sparkContext.broadcast(_bounds(probes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, rows = np.zeros(len(probes) + 1, dtype=np.int64), np.zeros(len(probes) + 1, dtype=np.int64)
        for b in batches:
            at = np.searchsorted(sent.value, _packed(b.column(0).to_numpy(), b.column(1).to_numpy()), side="right")
            np.add.at(sizes, at, b.column(2).to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(sizes[some]), pa.array(rows[some])], names=["cell", "bytes", "rows"])

    counted = keys.mapInArrow(count, "cell long, bytes long, rows long").groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect()
    sizes, rows = [0] * (len(probes) + 1), [0] * (len(probes) + 1)
    for r in counted:
        sizes[r["cell"]], rows[r["cell"]] = r["bytes"], r["rows"]
    return [int(x) for x in np.cumsum(sizes[:-1])], [int(x) for x in np.cumsum(rows[:-1])]


def splitters(keys: DataFrame, parts: int, by: str = "bytes", tolerance: float = 0.001, probes: int = 48, total: int | None = None) -> list[int]:
    """parts - 1 keys that cut the rows into parts of nearly equal bytes or rows.

    `keys` is a written table of high, low, size. Each round tries `probes` keys
    evenly inside every bracket that is still open. A bracket closes when one of
    its ends is within tolerance of a part, or when no key is left inside.
    """
    which = 0 if by == "bytes" else 1
    if total is None:
        total = _below(keys, [TOP - 1])[which]
        total = total[0]
    slack = tolerance * total / parts
    goals = [total * i / parts for i in range(1, parts)]
    brackets = [(0, 0, TOP - 1, total) for _ in goals]
    open_ = lambda g, b: min(g - b[1], b[3] - g) > slack and b[2] - b[0] > 1
    while any(open_(g, b) for g, b in zip(goals, brackets, strict=True)):
        tried = sorted({b[0] + (b[2] - b[0]) * j // (probes + 1) for g, b in zip(goals, brackets, strict=True) if open_(g, b) for j in range(1, probes + 1)})
        counts = _below(keys, tried)[which]
        for i, (g, (lo, n_lo, hi, n_hi)) in enumerate(zip(goals, brackets, strict=True)):
            at = bisect.bisect_right(counts, g)  # counts grow with the keys
            if at and tried[at - 1] > lo:
                lo, n_lo = tried[at - 1], counts[at - 1]
            if at < len(tried) and tried[at] < hi:
                hi, n_hi = tried[at], counts[at]
            brackets[i] = (lo, n_lo, hi, n_hi)
    best = [b[0] if g - b[1] <= b[3] - g else b[2] for g, b in zip(goals, brackets, strict=True)]
    return list(itertools.accumulate(best, max))


def whole_groups(keys: DataFrame, cuts: list[int], total: int, tolerance: float) -> list[int]:
    """The cuts, moved to an end of the group of equal texts they fall into.

    A cut moves only where that leaves the bytes below it within tolerance of a
    part from its goal; else the group is cut.
    """
    parts = len(cuts) + 1
    ends = [(c >> 64 << 64, (c >> 64) + 1 << 64) for c in cuts]
    probes = sorted({k for pair in ends for k in pair if k < TOP})
    if not probes:
        return cuts
    below = dict(zip(probes, _below(keys, probes)[0], strict=True)) | {TOP: total}
    moved = []
    for i, (cut, pair) in enumerate(zip(cuts, ends, strict=True)):
        away, near = min((abs(below[k] - total * (i + 1) / parts), k) for k in pair)
        moved.append(near if away <= tolerance * total / parts and near < TOP else cut)
    return list(itertools.accumulate(moved, max))


def shard_by_bytes(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", tolerance: float = 0.001, group_tolerance: float = 0.01, bytes_per_cell: int = 1 << 27) -> DataFrame:
    """The documents with shard (from 0) and slot, gapless from 0 in each shard.

    Shards follow the order of text hash, then id hash. Their bytes differ from
    the mean by the tolerance and one document, or by group_tolerance at each end
    where that keeps equal texts together; larger groups of equal texts are cut.
    A null text has one byte. Shards are ranked in cells of about bytes_per_cell
    bytes whose exact counts are known from the last count. Repeated rows, which
    nothing tells apart, get slots one after another. An empty table gives an
    empty one.
    """
    high, low = sort_key(key, text)
    keys = written(docs.select(high.alias("high"), low.alias("low"), text_size(text).alias("size")), "keys")
    total = _below(keys, [TOP - 1])[0][0]
    cuts = whole_groups(keys, splitters(keys, shards, "bytes", tolerance, total=total), total, group_tolerance)
    cells = max(1, -(-total // (shards * bytes_per_cell)))
    inner = splitters(keys, shards * cells, "bytes", 0.5, probes=3, total=total) if cells > 1 else []
    bounds = sorted({*cuts, *inner})
    below = [0, *_below(keys, bounds)[1]] if bounds else [0]
    shard_of = [bisect.bisect_right(cuts, b) for b in [-1, *bounds]]
    first = {}
    for s, n in zip(shard_of, below, strict=True):
        first.setdefault(s, n)
    sent = docs.sparkSession.sparkContext.broadcast((_bounds(bounds), np.array(shard_of, dtype=np.int32), np.array([n - first[s] for s, n in zip(shard_of, below, strict=True)], dtype=np.int64)))

    @F.pandas_udf(T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("before", T.LongType())]))
    def cell(high: pd.Series, low: pd.Series) -> pd.DataFrame:
        bounds, shard_of, before = sent.value
        at = np.searchsorted(bounds, _packed(high.to_numpy(), low.to_numpy()), side="right")
        return pd.DataFrame({"cell": at.astype(np.int32), "shard": shard_of[at], "before": before[at]})

    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    mark = uuid.uuid4().hex[:8]  # the documents may have columns of any name
    h, l, c = (f"_{x}_{mark}" for x in ("high", "low", "cell"))  # noqa: E741
    placed = docs.select(*kept, high.alias(h), low.alias(l)).withColumn(c, cell(h, l))
    unsigned = [F.col(x).bitwiseXOR(F.lit(-(1 << 63))) for x in (h, l)]  # as the bounds compare them, so that slots follow one order throughout
    rank = F.row_number().over(Window.partitionBy(f"{c}.cell").orderBy(*unsigned)) - 1
    return placed.select(*kept, F.col(f"{c}.shard").alias("shard"), (F.col(f"{c}.before") + rank).alias("slot"))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = shard_by_bytes(docs)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return done.select("doc_id", text_size("text").alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
