"""What the text operators share: the words of a text, shared tables, word hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that part words, as a class for regular expressions.
SPACE = r"\x20\x09-\x0D"


def words(text: Column | str) -> Column:
    """The words of a text: runs of characters other than SPACE (null: none)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bucket_of(key: Column | str, buckets: int) -> Column:
    """crc32 of the key as text, modulo the number of buckets."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % F.lit(buckets)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the one the session names in spark.checkpoint.dir; only where that is
    unset and all runs in one process, as in tests, a temporary folder is named
    there. On a cluster a folder must be named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    own = getattr(spark, "_tidegate_shared", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="tidegate-")
        spark._tidegate_shared = own
        spark.sparkContext.setCheckpointDir(own)
    return own


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows written once to the shared folder and read back from there.

    This cuts the lineage; the copy survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns what this Python worker holds but does not use; workers outlive their tasks."""
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def id_filter(ids: DataFrame, key: str, bits: int = 1 << 23):
    """A column function from keys to whether a key may be among `ids`.

    It is a bitmap of fixed size, so what tasks are sent is bounded by `bits`
    whatever the number of ids; it says yes to every id and, as it fills, to more
    and more other keys. An exact join must follow; the bitmap only spares the
    shuffle of rows that can't match.
    """
    marks = _marks(ids, key, bits).toPandas()
    words_ = np.zeros(bits // 64, dtype=np.int64)
    words_[marks["word"].to_numpy(dtype=np.int64)] = marks["mask"].to_numpy(dtype=np.int64)
    sent = ids.sparkSession.sparkContext.broadcast(words_)

    @F.pandas_udf(T.BooleanType())
    def marked(at: pd.Series) -> pd.Series:
        at = at.to_numpy(dtype=np.int64)
        return pd.Series(((sent.value.view(np.uint64)[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)).astype(bool))

    return lambda c: marked(_place(c, bits))


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("long")), F.lit(bits))


def _marks(ids: DataFrame, key: str, bits: int) -> DataFrame:
    """(word, mask): the 64-bit words of the ids' bitmap that have a bit."""
    at = ids.select(_place(F.col(key), bits).alias("at")).select(F.expr("cast(at div 64 AS int)").alias("word"), F.expr("shiftleft(1L, cast(at % 64 AS int))").alias("mask"))
    return at.groupBy("word").agg(F.bit_or("mask").alias("mask"))


def with_may(rows: DataFrame, ids: DataFrame, key: str, bits: int = 1 << 23) -> DataFrame:
    """The rows with `may`, false only where the key is not among `ids`: the test of id_filter without Python.

    At most bits / 64 words of the bitmap are broadcast to a join.
    """
    mark = uuid.uuid4().hex[:8]  # the rows may have columns of any name
    word, mask = f"_word_{mark}", f"_mask_{mark}"
    sent = F.broadcast(_marks(ids, key, bits).select(F.col("word").alias(word), F.col("mask").alias(mask)))
    at = _place(F.col(key), bits)
    bit = F.call_function("shiftright", F.coalesce(F.col(mask), F.lit(0).cast("long")), (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    return rows.join(sent, F.floor(at / 64).cast("int") == F.col(word), "left").select(*(F.col(f"`{c}`") for c in rows.columns), (bit == 1).alias("may"))


def text_slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """(start, texts): runs of at most `most` characters together, or one longer text."""
    held, start, size = [], 0, 0
    for i, item in enumerate(column):
        text = item.as_py()
        if held and size + len(text or "") > most:
            yield start, held
            held, start, size = [], i, 0
        held.append(text)
        size += len(text or "")
    if held:
        yield start, held


_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Scatters the bits of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    if n not in _KEPT.setdefault(base, {}):
        with np.errstate(over="ignore"):
            found = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base, dtype=np.uint64)]), dtype=np.uint64)
        if n != CHUNK:
            return found
        _KEPT[base][n] = found
    return _KEPT[base][n]


#: Bytes hashed at a time; the running sums need about 30 bytes for each.
CHUNK = 1 << 20
_KEPT: dict[int, dict[int, np.ndarray]] = {}


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, word counts of the texts, joined bytes, starts, ends) of all words.

    A word's hash depends on its bytes alone: a polynomial over a table of
    random odd numbers, taken from running sums over chunks of whole words, so
    that a batch costs a few passes of numpy and little memory.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    if not blank[0]:
        starts = np.concatenate([[0], starts])
    hashes = np.zeros(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, low + CHUNK, side="right")))
        s, e = starts[at:stop] - low, ends[at:stop] - low
        part = data[low : ends[stop - 1]]
        n = CHUNK if len(part) <= CHUNK else len(part)
        with np.errstate(over="ignore"):
            run = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_TABLE[part] * _powers(_BASE, n)[: len(part)], dtype=np.uint64, out=run[1:])
            raw = (run[e] - run[s]) * _powers(_BASE_INVERSE, n)[s]
            hashes[at:stop] = mix64(raw + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = stop
    last = np.cumsum(sizes)
    per_text = np.diff(np.concatenate([[0], np.searchsorted(starts, last)]))
    return hashes, per_text, data, starts, ends
