"""Language identification by known words, backing off to character n-grams.

Training counts the words of each language and the character n-grams inside
them. A word that training has seen scores its log frequency in each language;
any other word falls back to its longest n-grams of which at least one is
known, then to shorter ones. A text scores the mean over its words.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.llm.common import bucket_of, give_back, text_slices, written

UNKNOWN = "und"
#: The seed of Spark's xxhash64; for one string it is the plain XXH64.
_SEED = 42


def unit_keys(units: list[str]) -> np.ndarray:
    """Spark's xxhash64 of each string."""
    return np.fromiter((xxhash.xxh64_intdigest(u.encode("utf-8", "surrogatepass"), _SEED) for u in units), dtype=np.uint64, count=len(units)).view(np.int64)


@dataclass
class Units:
    """Units of one size: sorted keys, and for each the languages that have it.

    Unit i lies in the entries starts[i]..starts[i + 1]; gains are the log
    frequencies above that of a unit which a language has never shown.
    """

    keys: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    gains: np.ndarray

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for one that isn't there."""
        if not len(self.keys):
            return np.full(len(wanted), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)


@dataclass
class LanguageModel:
    """The units of each size (0: words) in the order of langs."""

    langs: list[str]
    units: dict[int, Units] = field(default_factory=dict)


def _units(rows: pa.Table, langs: int) -> Units:
    """From (lang, key, n) rows of one size, lang being a number.

    All languages share one number of kinds and one floor: one of few tokens must
    not give unseen units more than the others do. The floor cancels between
    languages, so only what lies above it is kept.
    """
    lang, key, n = (c.to_numpy() for c in rows.columns)
    order = np.lexsort([lang, key])
    lang, key, n = lang[order], key[order], n[order]
    totals, kinds = np.bincount(lang, n, langs), np.bincount(lang).max()
    floor = math.log(0.5 / (totals.max() + 0.5 * kinds + 1))
    gains = np.log((n + 0.5) / (totals[lang] + 0.5 * kinds + 1)) - floor
    keys, starts = np.unique(key, return_index=True)
    return Units(keys, np.append(starts, len(key)).astype(np.int32), lang.astype(np.int32), gains.astype(np.float32))


def _most_each(counts: list[int], total: int) -> int:
    """The most rows of each language that keep the sum within total: rare languages are taken whole."""
    left = total
    for i, n in enumerate(sorted(counts)):
        most = max(1, left // (len(counts) - i))
        if n > most:
            return most
        left -= n
    return max(counts)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = 10_000, longest: int = 4) -> LanguageModel:
    """Learns from at most about sample_docs labelled rows.

    The sample takes all rows of rare languages and about equally many of each
    common one, by a hash of the key, so its size does not grow with the corpus;
    every language, word and n-gram of the sample is learnt. The list of
    languages and the counts of the sample's units reach the driver. Rows with a
    null text or language teach nothing; without any labelled row the model
    knows no language.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = sorted(rows.groupBy("lang").count().collect(), key=lambda r: r["lang"])
    langs = [r["lang"] for r in sizes]
    if not langs:
        return LanguageModel([])
    most = _most_each([r["count"] for r in sizes], sample_docs)
    shares = spark.createDataFrame([(r["lang"], i, math.ceil(min(1.0, most / r["count"]) * (1 << 40))) for i, r in enumerate(sizes)], "lang string, at int, below long")
    taken = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("k"), F.lit(1 << 40)) < F.col("below"))
    spread = taken.select("at", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    counted = written(spread.groupBy("at", "word").agg(F.count("*").alias("n")), "words")
    cut = F.expr(f"flatten(transform(sequence(1, {longest}), n -> transform(sequence(0, greatest(0, length(p) - n)), i -> substring(p, i + 1, n))))")
    padded = counted.withColumn("p", F.concat(F.lit("^"), "word", F.lit("$")))
    grams = padded.select("at", "n", F.explode(cut).alias("unit")).withColumn("size", F.length("unit"))
    units = counted.select(F.lit(0).alias("size"), "at", F.col("word").alias("unit"), "n").unionByName(grams)
    found = written(units.groupBy("size", F.col("at").alias("lang"), F.xxhash64("unit").alias("key")).agg(F.sum("n").alias("n")), "units")
    model = LanguageModel(langs)
    for size in range(longest + 1):
        rows = found.where(F.col("size") == size).select("lang", "key", "n").toArrow()
        if rows.num_rows:
            model.units[size] = _units(rows, len(langs))
    return model


class _Scorer(dict):
    """Maps a token of a text to its row in a table of scores, made on first sight."""

    def __init__(self, model: LanguageModel, room: int = 60_000):
        super().__init__()
        self.model, self.room = model, room
        self.grams = [(size, model.units[size]) for size in sorted(model.units, reverse=True) if size]
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.used = 1  # row 0: no letters
        self.table = np.zeros((4096, max(1, len(self.model.langs))), dtype=np.float32)

    def learn(self, tokens: set[str]) -> None:
        """Makes the rows of new tokens: the mean over a token's words of the mean over units."""
        words: list[str] = []
        counts: list[int] = []
        first = self.used
        for token in tokens:
            parts = [token] if token.isalpha() else "".join(c if c.isalpha() else " " for c in token).split()
            if parts:
                self[token] = first + len(counts)
                counts.append(len(parts))
                words.extend(parts)
            else:
                self[token] = 0
        if not counts:
            return
        fresh, wide = len(counts), self.table.shape[1]
        owner = np.repeat(np.arange(fresh), counts)
        weight = np.repeat(1.0 / np.array(counts), counts)
        sums = np.zeros(fresh * wide)

        def add(units: Units, row: np.ndarray, token: np.ndarray, by: np.ndarray) -> None:
            lens = units.starts[row + 1] - units.starts[row]
            at = np.repeat(units.starts[row] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(int(lens.sum()))
            sums[:] += np.bincount(np.repeat(token, lens) * wide + units.langs[at], np.repeat(by, lens) * units.gains[at], fresh * wide)

        place = self.model.units[0].find(unit_keys(words)) if 0 in self.model.units else np.full(len(words), -1)
        seen = place >= 0
        if seen.any():
            add(self.model.units[0], place[seen], owner[seen], weight[seen])
        todo = np.flatnonzero(~seen)
        for size, units in self.grams:
            if not len(todo):
                break
            padded = [f"^{words[i]}$" for i in todo.tolist()]
            many = np.array([max(0, len(p) - size + 1) for p in padded])
            of = np.repeat(np.arange(len(todo)), many)
            place = units.find(unit_keys([p[i : i + size] for p, n in zip(padded, many.tolist(), strict=True) for i in range(n)]))
            known = place >= 0
            hits = np.bincount(of[known], minlength=len(todo))
            if known.any():
                add(units, place[known], owner[todo][of[known]], (weight[todo] / np.maximum(hits, 1))[of[known]])
            todo = todo[hits == 0]
        while first + fresh > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[first : first + fresh] = sums.reshape(fresh, wide)
        self.used += fresh

    def predict(self, texts: list[str | None], evidence: int) -> list[tuple[str, float]]:
        if not self.model.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        if len(self) > self.room:
            self.reset()
        split = [(t or "").lower().split() for t in texts]
        self.learn(set().union(*split).difference(self.keys()))
        found = []
        for tokens in split:
            rows = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
            rows = rows[rows > 0]
            if not len(rows):
                found.append((UNKNOWN, 0.0))
                continue
            mean = self.table[rows].mean(axis=0, dtype=np.float64)
            p = np.exp((mean - mean.max()) * min(len(rows), evidence))
            best = int(p.argmax())
            found.append((self.model.langs[best], float(p[best] / p.sum())))
        return found


VERDICT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predictor(spark, model: LanguageModel, evidence: int = 20):
    """A column function from text to struct<lang_pred, score>.

    The score is the language's share of the likelihood when a text counts as at
    most `evidence` words, so that repeated text can't make it certain. A task
    keeps the scores of the tokens it meets, and drops them at its end.
    """
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf(VERDICT)
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _Scorer(sent.value)
        for column in texts:
            found: list[tuple[str, float]] = []
            for _, part in text_slices(column, 1 << 19):
                found += scorer.predict(part, evidence)
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["lang_pred", "score"])
        scorer.reset()
        give_back()

    return predict


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", evidence: int = 20) -> DataFrame:
    """The rows with lang_pred and score.

    A null text, or one without a letter, is `und` with score 0; so is every
    text where the model knows no language. Letters of which training has seen
    nothing leave all languages equal; ties go to the first name. Repeated rows
    are judged alike. Columns of the same names are replaced.
    """
    predict = predictor(docs.sparkSession, model, evidence)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    mark = f"_lid_{uuid.uuid4().hex[:8]}"
    return docs.select(*kept, predict(F.col(text)).alias(mark)).select(*kept, f"{mark}.lang_pred", f"{mark}.score")


def held_out(key: Column | str = "doc_id") -> Column:
    """The quarter of the documents that training never reads."""
    return bucket_of(key, 4) == 2


def documents_language(spark, docs: DataFrame) -> DataFrame:
    """Trains on the documents outside the held-out quarter and predicts all."""
    model = train(docs.where(~held_out("doc_id")))
    return identify(docs, model)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents_language(spark, docs.select("doc_id", "text", "lang")).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
