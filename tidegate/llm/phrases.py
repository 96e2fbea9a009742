"""Frequent phrases by contiguous pattern growth, scored as collocations.

A word is a 64-bit number made of its language and its letters. Words are
counted, then pairs of frequent words. Every place where at least two frequent
pairs meet is a pointer; it carries the words that follow, five in all at most,
up to the end of the piece or to the first pair that is not frequent. Pointers go
to the task of their prefix and are sorted by their words, so that the pointers of every
longer prefix lie next to each other: a prefix grows to the right, depth first,
by cutting its run of pointers at each new next word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import give_back, hashed_words, mix64, text_slices, written

#: Longest phrase.
LONGEST = 5
UNDEFINED = "und"

_FORM = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?" else c for c in range(256))
_THREE = np.uint64(3)


def language_number(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _tokens(batch: pa.RecordBatch):
    """(words, links, data, starts, ends, owners, languages) of runs of texts.

    links says whether the next word follows in the same piece; owners are
    numbers of languages.
    """
    langs = [UNDEFINED if x is None else x for x in batch.column("lang").to_pylist()]
    names = sorted(set(langs))
    number = {x: i for i, x in enumerate(names)}
    codes = np.array([language_number(x) for x in names], dtype=np.uint64)
    owner = np.array([number[x] for x in langs], dtype=np.int64)
    for start, texts in text_slices(batch.column("text"), 1 << 22):
        hashes, sizes, data, starts, ends = hashed_words([(t or "").encode().translate(_FORM) for t in texts])
        own = np.repeat(owner[start : start + len(texts)], sizes)
        words = mix64(hashes ^ codes[own]) if len(own) else hashes
        links = np.zeros(len(words), dtype=bool)
        if len(words) > 1:
            breaks = np.concatenate([[0], np.cumsum((data >= 10) & (data <= 13))])
            text = np.repeat(np.arange(len(texts)), sizes)
            links[:-1] = (breaks[starts[1:]] == breaks[ends[:-1]]) & (text[1:] == text[:-1])
        yield words, links, data, starts, ends, own, names


def summed(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows of the columns once, with their counts added."""
    if not len(counts):
        return columns, counts
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    at = np.flatnonzero(new)
    return [c[order][at] for c in columns], np.add.reduceat(counts[order], at)


class Held:
    """Rows with counts, added up in the task before they are sent on; at most about `most` are held."""

    def __init__(self, names: list[str], most: int = 1 << 20):
        self.names, self.most, self.rows, self.size = names, most, [], 0

    def add(self, columns: list[np.ndarray], counts: np.ndarray) -> bool:
        """Takes rows; says whether it is time to send."""
        self.rows.append((columns, counts))
        self.size += len(counts)
        if self.size <= self.most:
            return False
        self.pack()
        return self.size > self.most // 2

    def pack(self) -> None:
        if len(self.rows) > 1:
            columns = [np.concatenate([r[0][i] for r in self.rows]) for i in range(len(self.names))]
            self.rows = [summed(columns, np.concatenate([r[1] for r in self.rows]))]
            self.size = len(self.rows[0][1])

    def send(self) -> Iterator[pa.RecordBatch]:
        self.pack()
        for columns, counts in self.rows:
            for at in range(0, len(counts), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([*(pa.array(c[part].view(np.int64)) for c in columns), pa.array(counts[part])], names=[*self.names, "n"])
        self.rows, self.size = [], 0


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, lang, form, n) of the task's words; per language also its total, without a word."""
    held: dict[int, list] = {}
    totals: dict[str, int] = {}

    def send() -> Iterator[pa.RecordBatch]:
        rows = [(k, x[0], x[1], x[2]) for k, x in held.items()] + [(None, lang, None, n) for lang, n in totals.items()]
        held.clear()
        totals.clear()
        for at in range(0, len(rows), 1 << 15):
            k, lang, form, n = zip(*rows[at : at + (1 << 15)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(lang, pa.string()), pa.array(form, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], names=["word", "lang", "form", "n"])

    for batch in batches:
        for words, _, data, starts, ends, own, names in _tokens(batch):
            found, first, counts = np.unique(words, return_index=True, return_counts=True)
            for i, n in enumerate(np.bincount(own, minlength=len(names)).tolist()):
                if n:
                    totals[names[i]] = totals.get(names[i], 0) + n
            for k, at, n in zip(found.view(np.int64).tolist(), first.tolist(), counts.tolist(), strict=True):
                if (x := held.get(k)) is not None:
                    x[2] += n
                else:
                    held[k] = [names[own[at]], data[starts[at] : ends[at]].tobytes(), n]
            if len(held) > 400_000:
                yield from send()
    yield from send()
    give_back()


class Marks:
    """A bitmap of keys with a size of its own choice: it says yes to every key in it, and seldom to others.

    The size follows the number of keys up to 2^28 bits, 32 MB, whatever the
    table; beyond that more of the other keys pass, and exact counts later tell.
    """

    def __init__(self, keys: DataFrame, least_bits: int = 20, most_bits: int = 28):
        spark, n = keys.sparkSession, keys.count()
        self.bits = max(least_bits, min(most_bits, int(np.ceil(np.log2(max(1, n) * 16)))))
        size = 1 << self.bits
        marks = keys.select(F.expr(f"cast(pmod(key, {size}L) div 64 AS int)").alias("cell"), F.expr("shiftleft(1L, cast(pmod(key, 64) AS int))").alias("mask")).groupBy("cell").agg(F.bit_or("mask").alias("mask")).toArrow()
        cells = np.zeros(size // 64, dtype=np.int64)
        cells[marks["cell"].to_numpy()] = marks["mask"].to_numpy()
        self.sent = spark.sparkContext.broadcast(cells)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = keys & np.uint64((1 << self.bits) - 1)
        return ((self.sent.value.view(np.uint64)[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(a * _THREE + b)


def _count_pairs(frequent: Marks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(["a", "b"])
        for batch in batches:
            for words, links, *_ in _tokens(batch):
                known = frequent(words)
                at = np.flatnonzero(links[:-1] & known[:-1] & known[1:]) if len(words) > 1 else np.zeros(0, dtype=np.int64)
                if held.add(*summed([words[at], words[at + 1]], np.ones(len(at), dtype=np.int64))):
                    yield from held.send()
        yield from held.send()
        give_back()

    return run


def _keys_of_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(c).to_numpy().view(np.uint64) for c in "ab")
        yield pa.RecordBatch.from_arrays([pa.array(pair_key(a, b).view(np.int64)), batch.column("a"), batch.column("b"), batch.column("n")], names=["key", "a", "b", "n"])


def _pointers(pairs: Marks, hot: Marks, buckets: int):
    """Windows of three words or more with their counts, in blocks of prefixes that go to one task.

    A prefix has two words, or three where the first two are hot. A block holds
    whole columns: the words of its windows and their counts.
    """

    def sent(held: Held) -> Iterator[pa.RecordBatch]:
        held.pack()
        for columns, counts in held.rows:
            if not len(counts):
                continue
            bucket = (columns[0] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, rows = bucket[order], np.stack([*(c[order].view(np.int64) for c in columns[1:]), counts[order]])
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, np.arange(0, len(bucket), 1 << 16)]))
            blocks = [rows[:, low:high].tobytes() for low, high in zip(cuts, [*cuts[1:], len(bucket)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(blocks, pa.binary())], names=["bucket", "block"])
        held.rows, held.size = [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(["prefix", *(f"w{j}" for j in range(LONGEST))])
        for batch in batches:
            for words, links, *_ in _tokens(batch):
                n = len(words)
                if n < 3:
                    continue
                two = pair_key(words[:-1], words[1:])
                ok = np.zeros(n + LONGEST, dtype=bool)
                at = np.flatnonzero(links[:-1])
                ok[at] = pairs(two[at])
                start = np.flatnonzero(ok[: n - 2] & ok[1 : n - 1])
                padded = np.concatenate([words, np.zeros(LONGEST, dtype=np.uint64)])
                columns, alive = [words[start]], np.ones(len(start), dtype=bool)
                for j in range(1, LONGEST):
                    alive = alive & ok[start + j - 1]
                    columns.append(np.where(alive, padded[start + j], np.uint64(0)))
                prefix = two[start]
                prefix = np.where(hot(prefix), pair_key(prefix, columns[2]), prefix)
                if held.add(*summed([prefix, *columns], np.ones(len(start), dtype=np.int64))):
                    yield from sent(held)
        yield from sent(held)
        give_back()

    return run


def grow(columns: list[np.ndarray], counts: np.ndarray, least: int, depth: int = 2) -> list[tuple[tuple[int, ...], int]]:
    """(phrase, count) of every frequent phrase longer than `depth`, depth first.

    The rows are one prefix's pointers, sorted by the columns, whose first
    `depth` are equal.
    """
    out: list[tuple[tuple[int, ...], int]] = []

    def extend(low: int, high: int, depth: int, path: tuple[int, ...]) -> None:
        nexts = columns[depth][low:high]
        cuts = np.concatenate([[0], np.flatnonzero(nexts[1:] != nexts[:-1]) + 1])
        sums = np.add.reduceat(counts[low:high], cuts)
        ends = np.concatenate([cuts[1:], [high - low]])
        for i in np.flatnonzero((sums >= least) & (nexts[cuts] != 0)):
            phrase = (*path, int(nexts[cuts[i]]))
            out.append((phrase, int(sums[i])))
            if depth + 1 < len(columns):
                extend(low + int(cuts[i]), low + int(ends[i]), depth + 1, phrase)

    if len(counts):
        extend(0, len(counts), depth, tuple(int(c[0]) for c in columns[:depth]))
    return out


def _grow_prefixes(least: int):
    """Puts a bucket's blocks together, sorts their windows, and grows each prefix; one bucket is held at a time."""

    def settled(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([np.frombuffer(b, dtype=np.int64).reshape(LONGEST + 1, -1) for b in blocks], axis=1)
        columns, counts = summed([c.view(np.uint64) for c in rows[:-1]], rows[-1])
        cuts = np.concatenate([[0], np.flatnonzero((columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])) + 1])
        ends = np.concatenate([cuts[1:], [len(counts)]])
        found = []
        for i in np.flatnonzero(np.add.reduceat(counts, cuts) >= least):
            part = slice(int(cuts[i]), int(ends[i]))
            found += grow([c[part] for c in columns], counts[part], least)
        for at in range(0, len(found), 1 << 15):
            phrases, n = zip(*found[at : at + (1 << 15)], strict=True)
            signed = [np.array(p, dtype=np.uint64).view(np.int64).tolist() for p in phrases]
            yield pa.RecordBatch.from_arrays([pa.array(signed, pa.list_(pa.int64())), pa.array(n, pa.int64())], names=["words", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block"), strict=True):
                if bucket != now and held:
                    yield from settled(held)
                    held = []
                now = bucket
                held.append(block.as_py())
        if held:
            yield from settled(held)
        give_back()

    return run


def frequent_phrases(docs: DataFrame, least: int = 100, hot: int = 20_000, bucket: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Words (word, lang, form, n, total) and phrases (words, a) with counts of at least `least`.

    `docs` has lang and text; a null text is empty, a null lang UNDEFINED. total
    is the number of all words of the language. Phrases have two to five words of
    one piece, and all their occurrences count, overlapping ones too. `hot` is
    the number of occurrences beyond which a pair's pointers are dealt out by
    their third word, and `bucket` about how many occurrences go to one bucket.
    """
    docs = docs.select("lang", "text")
    counted = docs.mapInArrow(_count_words, "word long, lang string, form string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"), F.max("form").alias("form"))
    counted = written(counted.where(F.col("word").isNull() | (F.col("n") >= least)), "words")
    words, totals = counted.where("word is not null"), counted.where("word is null").select("lang", F.col("n").alias("total"))
    if totals.count() <= 10_000:  # so small that each task can have it; else a common join
        totals = F.broadcast(totals)
    words = written(words.join(totals, "lang"), "words")

    known = Marks(words.select(F.col("word").alias("key")))
    pairs = docs.mapInArrow(_count_pairs(known), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    pairs = written(pairs.mapInArrow(_keys_of_pairs, "key long, a long, b long, n long"), "pairs")

    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    pointers = docs.mapInArrow(_pointers(Marks(pairs), Marks(pairs.where(F.col("n") > hot)), 1 + total // bucket), "bucket long, block binary")
    grown = pointers.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_grow_prefixes(least), "words array<long>, a long")
    return words, written(grown.unionByName(pairs.select(F.array("a", "b").alias("words"), F.col("n").alias("a"))), "phrases")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, hot: int = 20_000) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase cut after its first k words has score floor(1000 a n / (l r)); its
    lowest-scoring cut counts, ties to the smallest k. Phrases inside a longer
    frequent one with as many occurrences are left out; as counts only fall when
    a phrase grows, a look at phrases one word longer settles it. Ranks go by
    score, a (both descending) and phrase. An empty table gives an empty one.
    """
    words, phrases = frequent_phrases(docs, least, hot)
    long = phrases.where(F.size("words") > 2)
    inner = lambda start: long.select(F.slice("words", start, F.size("words") - 1).alias("words"), F.col("a").alias("longer"))
    longer = inner(1).unionByName(inner(2)).groupBy("words").agg(F.max("longer").alias("longer"))
    own = phrases.join(longer, "words", "left").where(F.coalesce(F.col("longer") < F.col("a"), F.lit(True)))
    own = own.withColumn("word", F.get("words", F.lit(0))).join(words.select("word", "lang", F.col("total").alias("n")), "word").drop("word", "longer")

    counts = phrases.select("words", F.col("a").alias("f")).unionByName(words.select(F.array("word").alias("words"), F.col("n").alias("f")))
    size = F.size("words")
    cuts = own.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("words", F.lit(1), F.col("k"))).withColumn("right", F.slice("words", F.col("k") + 1, size - F.col("k")))
    part = lambda side, name: counts.select(F.col("words").alias(side), F.col("f").alias(name))
    cuts = cuts.join(part("left", "l"), "left").join(part("right", "r"), "right")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    over = (wide("a") * wide("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    cuts = cuts.withColumn("_over", over.cast("decimal(38,0)")).withColumn("_under", (wide("l") * wide("r")).cast("decimal(38,0)")).withColumn("score", F.expr("_over div _under"))
    best = cuts.groupBy("words").agg(F.min(F.struct("score", "k", "l", "r", "a", "n", "lang")).alias("best")).select("words", "best.*")

    # ties at the end stay until their phrases are spelt out
    likely = best.withColumn("_at", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("_at") <= top).drop("_at", "k")
    likely = written(likely, "ranked")
    spelt = likely.select("words", F.posexplode("words").alias("pos", "word")).join(words.select("word", "form"), "word").groupBy("words").agg(F.sort_array(F.collect_list(F.struct("pos", "form"))).alias("_forms"))
    spelt = likely.join(spelt, "words").withColumn("phrase", F.array_join(F.transform("_forms", lambda x: x["form"]), " "))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return spelt.withColumn("rank", place.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws
      FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
total AS (SELECT lang, sum(len(ws)) AS n FROM p GROUP BY lang),
g AS (SELECT lang, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: ws[i:i + size - 1])) AS ws FROM p, range(1, 6) s(size)),
f AS (SELECT lang, ws, count(*) AS a FROM g GROUP BY lang, ws HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE len(ws) >= 2),
covered AS (SELECT lang, ws, max(a) AS longer FROM (SELECT lang, ws[:-2] AS ws, a FROM c WHERE len(ws) > 2 UNION ALL SELECT lang, ws[2:], a FROM c WHERE len(ws) > 2) GROUP BY lang, ws),
own AS (SELECT c.* FROM c LEFT JOIN covered v USING (lang, ws) WHERE v.longer IS NULL OR 100 * v.longer < 100 * c.a),
cuts AS (SELECT own.lang, own.ws, own.a, k, x.a AS l, y.a AS r, n, (1000::HUGEINT * own.a * n) // (x.a::HUGEINT * y.a) AS score
         FROM own, range(1, 5) s(k), f AS x, f AS y, total
         WHERE k < len(own.ws) AND x.lang = own.lang AND x.ws = own.ws[:k] AND y.lang = own.lang AND y.ws = own.ws[k + 1:] AND total.lang = own.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
ranked AS (SELECT *, array_to_string(ws, ' ') AS phrase FROM best)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked QUALIFY rank <= 2000
"""
