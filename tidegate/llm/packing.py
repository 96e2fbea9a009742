"""Packing token sequences into fixed windows by bin completion.

Lengths are at most the window, so a histogram of lengths is bounded by the
window and not by the corpus: it alone reaches the driver, where a
branch-and-bound search completes bins around the largest remaining length.
The found patterns, with how often each is used, place every piece by its rank
among the pieces of its length; ranks come from a distributed window.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import give_back, written

# ---- tokens


#: A single space between visible characters: the vocabulary never joins what stands before it to what follows.
_CUT = re.compile(r"(?<=\S) (?=\S)")


class _Ragged(Exception):
    """Spaces stand together or at an end; words can't be told by single spaces alone."""


class _Ids(dict):
    """Ids, as bytes, of a word after a single space; kept for short words.

    The vocabulary's ranks serve the search, as they give the tokenizer's ids
    several times faster; texts with one of its added tokens go to the tokenizer.
    """

    def __init__(self, vocabulary: str, ranks: str, added: list[str], room: int):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as file:
            pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encode = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={}).encode_ordinary
        self.vocabulary, self.added, self.room, self.tokenizer = vocabulary, added, room, None

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Ragged
        ids = self.packed(" " + word)
        if len(word) <= 32:
            if len(self) >= self.room:
                self.clear()
            self[word] = ids
        return ids

    def packed(self, text: str) -> bytes:
        ids = self.encode(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def with_added(self, text: str) -> bytes:
        if self.tokenizer is None:
            self.tokenizer = tokenizer(self.vocabulary)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def of(self, text: str) -> bytes:
        """The tokenizer's ids of a text, as little-endian unsigned 32-bit numbers.

        The tokenizer cuts before every single space between visible characters,
        so the parts of a text between such cuts go one by one, those met before
        from memory.
        """
        if any(token in text for token in self.added):
            return self.with_added(text)
        first, *rest = text.split(" ")
        if rest and first and not first[-1].isspace():
            try:
                return self.packed(first) + b"".join(map(self.__getitem__, rest))
            except _Ragged:
                pass
        first, *rest = _CUT.split(text)
        return self.packed(first) + b"".join(self.packed(" " + word) if word[-1].isspace() else self[word] for word in rest)


def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_vocabulary() -> tuple[str, str]:
    """The public byte-level vocabulary with 50,257 ids: for `tokenizers`, and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenized_pieces(docs: DataFrame, window: int = 2048, vocabulary: tuple[str, str] | None = None, end_id: int = 0, with_ids: bool = False, room: int = 150_000) -> DataFrame:
    """One row per piece of each document: its ids followed by end_id.

    Documents of more than `window` ids are cut; the first piece takes the rest
    of the division and all others are full. A null text is an empty one and
    becomes the end id alone. A string of the vocabulary's added tokens in a text
    gets that token's id, as `tokenizers` gives it. Columns other than doc_id and text are left aside; repeated rows are packed
    each for itself.
    """
    path, ranks = vocabulary or default_vocabulary()
    added = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]
    end = struct.pack("<I", end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Ids(path, ranks, added, room)
        ids_of = known.of
        for batch in batches:
            docs_out, pieces, starts, lengths, crcs, blobs = [], [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of(text.as_py() or "") + end
                n, at = len(ids) // 4, 0
                size = n % window or window
                piece = 0
                while at < n:
                    size = min(size, n)
                    part = memoryview(ids)[4 * at : 4 * (at + size)]
                    docs_out.append(key)
                    pieces.append(piece)
                    starts.append(at)
                    lengths.append(size)
                    crcs.append(zlib.crc32(part))
                    if with_ids:
                        blobs.append(bytes(part))
                    at, piece, size = at + size, piece + 1, window
            columns = [pa.array(docs_out, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(blobs, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        known.clear()
        del known, ids_of
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


# ---- the search


def lower_bound(counts: dict[int, int], window: int) -> int:
    """Fewest bins that could do: by the sum, and by items over half a bin."""
    total = sum(k * n for k, n in counts.items())
    best = -(-total // window)
    for low in range(0, window // 2 + 1, max(1, window // 64)):
        big = sum(n for k, n in counts.items() if k > window - low)
        mid = [(k, n) for k, n in counts.items() if window // 2 < k <= window - low]
        small = sum(k * n for k, n in counts.items() if low <= k <= window // 2)
        free = sum(n * (window - k) for k, n in mid)
        best = max(best, big + sum(n for _, n in mid) + max(0, -(-(small - free) // window)))
    return best


def fillings(lengths: list[int], counts: dict[int, int], largest: int, window: int, nodes: int, keep: int, tries: int = 6) -> list[tuple[int, list[int]]]:
    """Undominated fillings around the largest length, least waste first.

    A filling is dominated when one of its items can be exchanged for a longer
    free one that still fits; so after each choice only fillings that leave no
    such exchange are kept. At each place the `tries` longest fitting lengths are
    tried, `nodes` places are visited, and the `keep` best fillings return: with
    many lengths the full enumeration is exponential, so this is part of it.
    """
    found: list[tuple[int, list[int]]] = []
    left = nodes
    room = window - largest
    stack: list[tuple[int, int, list[int]]] = [(room, largest, [largest])]
    while stack and left > 0:
        left -= 1
        free, top, items = stack.pop()
        at = bisect_right(lengths, min(free, top)) - 1
        fits = []
        while at >= 0 and len(fits) < tries:
            k = lengths[at]
            if counts[k] - items.count(k) > 0:
                fits.append(k)
            at -= 1
        if not fits:
            if not any((j := bisect_right(lengths, k + free)) and lengths[j - 1] > k and counts[lengths[j - 1]] - items.count(lengths[j - 1]) > 0 for k in items[1:]):
                found.append((free, items))
                if free == 0 and len(found) >= keep:
                    break
            continue
        if fits[0] == free:  # an exact fit dominates every other filling below
            found.append((0, [*items, free]))
            if len(found) >= keep:
                break
            continue
        stack.extend((free - k, k, [*items, k]) for k in reversed(fits))
    if not found:
        found = [(room, [largest])]
    return sorted(found, key=lambda x: (x[0], len(x[1])))[:keep]


def best_fit(counts: dict[int, int], window: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing on the histogram: the first incumbent."""
    left = {k: n for k, n in counts.items() if n}
    lengths = sorted(left)
    plan = []
    while lengths:
        items, free = [lengths[-1]], window - lengths[-1]
        while (at := bisect_right(lengths, free) - 1) >= 0:
            while at >= 0 and left[lengths[at]] <= items.count(lengths[at]):
                at -= 1
            if at < 0:
                break
            items.append(lengths[at])
            free -= lengths[at]
        copies = min(left[k] // items.count(k) for k in set(items))
        plan.append((copies, items))
        for k in set(items):
            left[k] -= copies * items.count(k)
            if not left[k]:
                lengths.pop(bisect_right(lengths, k) - 1)
    return plan


def complete_bins(counts: dict[int, int], window: int, nodes: int = 12_000, width: int = 200, keep: int = 4) -> list[tuple[int, list[int]]]:
    """Patterns (copies, lengths in one bin) that use every length as often as counts says.

    Depth first: the largest remaining length is completed by its undominated
    fillings, each taken as often as the counts allow. A branch ends when its
    waste leaves no room for fewer bins than the incumbent. The search stops at
    the lower bound or after `nodes` branches, with the best plan so far; width
    and keep are the bounds of `fillings`. Only a plan with as many bins as
    lower_bound is proven to be the best; `place` says whether it is.
    """
    counts = {int(k): int(n) for k, n in counts.items() if n > 0}
    if not counts:
        return []
    total = sum(k * n for k, n in counts.items())
    bound, best = lower_bound(counts, window), best_fit(counts, window)
    fewest = sum(c for c, _ in best)
    left, lengths, plan, bins, waste = dict(counts), sorted(counts), [], 0, 0
    levels: list[list[tuple[int, list[int]]]] = []

    def take(items: list[int], copies: int, sign: int) -> None:
        for k in set(items):
            n = left[k] - sign * copies * items.count(k)
            if sign > 0 and n == 0:
                lengths.pop(bisect_right(lengths, k) - 1)
            elif sign < 0 and left[k] == 0:
                lengths.insert(bisect_right(lengths, k), k)
            left[k] = n

    while fewest > bound and nodes > 0:
        if not lengths:
            if bins < fewest:
                fewest, best = bins, list(plan)
            options: list[tuple[int, list[int]]] = []
        else:
            options = fillings(lengths, left, lengths[-1], window, width, keep)
        levels.append(options[::-1])
        while levels:
            nodes -= 1
            if levels[-1] and nodes > 0:
                spare, items = levels[-1].pop()
                copies = min(left[k] // items.count(k) for k in set(items))
                if waste + spare * copies <= (fewest - 1) * window - total:
                    take(items, copies, 1)
                    plan.append((copies, items))
                    bins, waste = bins + copies, waste + spare * copies
                    break
                continue
            levels.pop()
            if plan and levels:
                copies, items = plan.pop()
                take(items, copies, -1)
                bins, waste = bins - copies, waste - copies * (window - sum(items))
            if nodes <= 0:
                break
        if not levels:
            break
    return best


# ---- placing


def place(pieces: DataFrame, window: int = 2048, rows_per_rank: int = 250_000, **search: int) -> DataFrame:
    """The pieces with sequence_id and offset, gapless from 0 in each sequence.

    `pieces` must be stable (a written table): it is read for the histogram and
    again for the ranks. A length that a third of all pieces share is ranked in
    salted parts whose sizes are summed first. Lengths lie in 1..window; an empty
    table gives an empty result. `proven` tells on every row whether the number of
    sequences equals the lower bound, so that no packing has fewer.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    full = histogram.pop(window, 0)
    plan = complete_bins(histogram, window, **search)
    proven = sum(copies for copies, _ in plan) == lower_bound(histogram, window)
    if full:
        plan = [*plan, (full, [window])]
    first, rows, base = dict.fromkeys([*histogram, window], 0), [], 0
    for copies, items in plan:
        at = 0
        for k in sorted(set(items), reverse=True):
            uses = items.count(k)
            rows.append((k, first[k], base, uses, at))
            first[k] += copies * uses
            at += uses * k
        base += copies
    rows.sort()
    keys = np.array([(k << 44) | start for k, start, *_ in rows], dtype=np.int64)
    values = np.array([r[1:] for r in rows], dtype=np.int64).reshape(-1, 4)
    sent = spark.sparkContext.broadcast((keys, values))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, values = sent.value
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        start, base, uses, at = values[np.searchsorted(keys, (length << 44) | rank, side="right") - 1].T
        q = rank - start
        return pd.DataFrame({"sequence_id": base + q // uses, "offset": at + (q % uses) * length})

    parts = max(8, -(-max([full, *histogram.values(), 0]) // rows_per_rank))
    salted = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    sizes = salted.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_part").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_rank", F.row_number().over(inside) - 1).join(sizes, ["length", "_part"])
    return ranked.withColumn("_at", placed("length", F.col("_rank") + F.col("_before"))).select(*pieces.columns, "_at.sequence_id", "_at.offset", F.lit(proven).alias("proven"))


def pack_documents(docs: DataFrame, window: int = 2048, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """Cuts, packs and places all documents; see tokenized_pieces and place."""
    return place(written(tokenized_pieces(docs, window, vocabulary), "pieces"), window)


def op9(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
