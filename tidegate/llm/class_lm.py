"""Brown class-based bigram model: exchange clustering, counts, and scoring.

A word's class is found by exchange: each round, words move to the class that
most raises the likelihood of the class bigrams, and the counts are taken
again, until a sweep gains next to nothing. The `heads` most frequent words
exchange in this way. Every other word of the training texts then makes one
exchange against the classes found, which stay fixed: it takes the class with
the largest first-order gain, in tables of the whole vocabulary. A text's
probability is the product of class transitions and of word emissions inside
classes; words that training has never seen form a class of their own, with the
Good-Turing share of the tokens.

Counts come from all training documents. Arrays of a fixed number of words (the
heads and the frequent ones) reach every task; the classes and counts of all
others stay in a table that is joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import bucket_of, give_back, hashed_words, text_slices, written

#: Stands for the end of a text, as the hash of no word.
END = np.int64(0x5BD1E9955BD1E995)
ADD = 0.1


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, texts) of all tokens: each text's words, then one END. Only A-Z are lower-cased."""
    hashes, counts, *_ = hashed_words([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])
    out = np.full(len(hashes) + len(counts), END, dtype=np.int64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)] = hashes.view(np.int64)
    return out, np.repeat(np.arange(len(counts)), counts + 1)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted number in sorted keys, -1 if it isn't there."""
    if not len(keys):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class ClassModel:
    """What every task needs; bounded by the numbers of classes and of frequent words.

    Classes are numbered: clusters, then the unseen words, then END. `words` are
    the hashes of frequent words, sorted, with their classes and counts; log10
    throughout.
    """

    clusters: int
    words: np.ndarray
    word_class: np.ndarray
    word_count: np.ndarray
    step: np.ndarray  # log P(class | class before)
    mass: np.ndarray  # log of the tokens of each class
    tokens: int
    kinds: int
    ends: int
    once: int  # words seen once


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all tokens of the documents' texts."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch.column(0), 1 << 23):
                found, n = np.unique(tokens_of(texts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["word", "n"])
        give_back()

    return docs.select("text").mapInArrow(of, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(vocabulary: DataFrame, frequent: int, steps: int = 8) -> pd.DataFrame:
    """About `frequent` words of the highest counts, in falling order.

    A histogram of counts, with a few steps to each doubling, settles which
    words to fetch; of the last step those of the lowest hashes are taken. So
    only the words themselves reach the driver, not each task's best.
    """
    step = F.floor(F.log2("n") * steps)
    words, left = vocabulary.where(F.col("word") != F.lit(int(END))), frequent
    sizes = words.groupBy(step.alias("step")).count().collect()
    for r in sorted(sizes, key=lambda r: -r["step"]):
        if r["count"] > left:
            last = r["step"]
            words = words.where((step > last) | ((step == last) & (F.col("word") < F.lit(-(2**63) + int(2**64 * left / r["count"])))))
            break
        left -= r["count"]
    return words.toPandas().sort_values(["n", "word"], ascending=[False, True], ignore_index=True)


def count_bigrams(docs: DataFrame, heads: np.ndarray) -> DataFrame:
    """(code, n): pairs of neighbouring units, code = left * units + right.

    Units are the heads, then one for all other words, then END, which also
    stands before each text.
    """
    units = len(heads) + 2
    sent = docs.sparkSession.sparkContext.broadcast(heads)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch.column(0), 1 << 23):
                words, _ = tokens_of(texts)
                at = _find(sent.value, words)
                unit = np.where(words == END, units - 1, np.where(at >= 0, at, units - 2))
                found, n = np.unique(np.concatenate([[units - 1], unit[:-1]]) * units + unit, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["code", "n"])
        give_back()

    return docs.select("text").mapInArrow(of, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _sum_codes(rows: DataFrame, total: int) -> np.ndarray:
    """The matrix of (code, n) rows, code = row * total + column."""
    found = rows.groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(total * total)
    out[found["code"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.float64)
    return out.reshape(total, total)


def _matrix(bigrams: DataFrame, classes: np.ndarray, total: int) -> np.ndarray:
    """Class bigram counts under a map from units to classes."""
    units = len(classes)
    sent = bigrams.sparkSession.sparkContext.broadcast(classes)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(total * total, dtype=np.int64)
        for b in batches:
            code = b.column(0).to_numpy()
            sums += np.bincount(sent.value[code // units] * total + sent.value[code % units], b.column(1).to_numpy(), total * total).astype(np.int64)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["code", "n"])

    return _sum_codes(bigrams.mapInArrow(of, "code long, n long"), total)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(m: np.ndarray) -> float:
    """Of the class bigrams, up to what no exchange changes."""
    return float(_xlogx(m).sum() - _xlogx(m.sum(axis=1)).sum() - _xlogx(m.sum(axis=0)).sum())


def best_move(m: np.ndarray, own: int, right: np.ndarray, left: np.ndarray, self_: float, clusters: int) -> tuple[int, float]:
    """The cluster that a word does best in, and the gain in likelihood.

    right and left count the classes after and before the word, without the
    pairs of the word with itself, which self_ counts.
    """
    m = m.copy()
    m[own] -= right
    m[:, own] -= left
    m[own, own] -= self_
    rows, cols = m.sum(axis=1) + left, m.sum(axis=0) + right  # wherever the word goes, its partners stay
    r, c = right.sum() + self_, left.sum() + self_
    k = slice(0, clusters)
    after, before = np.flatnonzero(right), np.flatnonzero(left)
    out, into = m[k][:, after], m[before][:, k].T
    gain = (_xlogx(out + right[after]) - _xlogx(out)).sum(axis=1) + (_xlogx(into + left[before]) - _xlogx(into)).sum(axis=1)
    d = np.arange(clusters)
    here = m[d, d]
    gain += _xlogx(here + right[k] + left[k] + self_) - _xlogx(here + right[k]) - _xlogx(here + left[k]) + _xlogx(here)
    gain -= _xlogx(rows[k] + r) - _xlogx(rows[k]) + _xlogx(cols[k] + c) - _xlogx(cols[k])
    best = int(gain.argmax())
    return (best, float(gain[best] - gain[own])) if gain[best] > gain[own] + 1e-9 else (own, 0.0)


def neighbours(bigrams: DataFrame, units: int, heads: int) -> DataFrame:
    """(word, other, n): each head's neighbours; other counts from `units` on for those before it, and is 2 * units for itself.

    The rows of a word lie together, so that a task sums them up before they move.
    """
    a, z, n = F.floor(F.col("code") / units).cast("int"), (F.col("code") % units).cast("int"), F.col("n")
    after = bigrams.select(a.alias("word"), F.when(a == z, 2 * units).otherwise(z).alias("other"), n)
    before = bigrams.where(a != z).select(z.alias("word"), (a + units).alias("other"), n)
    return after.unionByName(before).where(F.col("word") < heads).repartition("word").sortWithinPartitions("word")


def exchange(bigrams: DataFrame, heads: int, clusters: int, least_gain: float = 0.05, blocks: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """(class of every unit, class bigram counts) after exchange clustering.

    Each round, Spark gathers every word's counts of neighbouring classes, and
    blocks of words exchange in parallel, each seeing its own moves; half of the
    words move in a round, so that partners don't swap places forever. All counts
    are taken again after a round. The search ends when a sweep of two rounds
    adds less than least_gain of what was gained so far; a round that loses
    likelihood is undone and ends it too.
    """
    total = clusters + 2
    # frequent words first: they spread over the clusters in turn
    classes = np.concatenate([np.arange(heads) % clusters, np.arange(clusters, total)])
    counts = _matrix(bigrams, classes, total)
    units = len(classes)
    spark = bigrams.sparkSession
    start = swept = now_ = likelihood(counts)
    near = written(neighbours(bigrams, units, heads), "neighbours") if heads else bigrams
    turn = 0
    while heads:
        sent = spark.sparkContext.broadcast((classes, counts))
        sweep, part = divmod(turn, 2)

        def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            classes = sent.value[0]
            side = np.concatenate([classes, total + classes, [2 * total]]).astype(np.int32)
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(side[b.column(1).to_numpy()]), b.column(2)], names=["word", "side", "n"])

        def moves(rows: pd.DataFrame) -> pd.DataFrame:
            classes, m = sent.value[0], sent.value[1].copy()
            rows = rows.sort_values("word", kind="stable")
            word, side, n = (rows[c].to_numpy() for c in ("word", "side", "n"))
            names, starts = np.unique(word, return_index=True)
            found = np.empty(len(names), dtype=np.int64)
            for i, (lo, hi) in enumerate(zip(starts, np.append(starts[1:], len(word)), strict=True)):
                p = np.zeros(2 * total + 1)
                p[side[lo:hi]] = n[lo:hi]
                right, left, self_ = p[:total], p[total : 2 * total], p[2 * total]
                was = int(classes[names[i]])
                found[i], _ = best_move(m, was, right, left, self_, clusters)
                if found[i] != was:
                    for at, sign in ((was, -1), (found[i], 1)):
                        m[at] += sign * right
                        m[:, at] += sign * left
                        m[at, at] += sign * self_
            return pd.DataFrame({"word": names, "now": found})

        moving = near.where(F.pmod(F.xxhash64("word", F.lit(sweep)), F.lit(2)) == part)
        sides = moving.mapInArrow(profiles, "word int, side int, n long").groupBy("word", "side").agg(F.sum("n").alias("n"))
        moved = sides.groupBy(F.pmod(F.col("word"), F.lit(blocks)).alias("block")).applyInPandas(moves, "word long, now long").toPandas()
        new = classes.copy()
        new[moved["word"].to_numpy(dtype=np.int64)] = moved["now"].to_numpy(dtype=np.int64)
        again = _matrix(bigrams, new, total)
        if likelihood(again) < now_:
            break
        classes, counts, now_ = new, again, likelihood(again)
        turn += 1
        if part == 1:
            if now_ - swept <= least_gain * (now_ - start):
                break
            swept = now_
    return classes, counts


def _contexts(docs: DataFrame, heads: np.ndarray, classes: np.ndarray, total: int) -> DataFrame:
    """(word, code, next, n) of the words that are no heads, as they stand in the texts.

    code is the class before times `total` plus the class after, where all words
    that are no heads count as the class of unseen ones; `next` is the next
    word's hash if it is one of them, else null.
    """
    other = total - 2
    sent = docs.sparkSession.sparkContext.broadcast((heads, classes))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, classes = sent.value
        for batch in batches:
            for _, texts in text_slices(batch.column(0), 1 << 23):
                words, _ = tokens_of(texts)
                at = _find(keys, words)
                cls = np.where(words == END, total - 1, np.where(at >= 0, classes[at] if len(keys) else other, other))
                around = np.concatenate([[total - 1], cls, [total - 1]])
                own = np.flatnonzero(cls == other)
                code = around[own] * total + around[own + 2]
                follows = np.where(code % total == other, words[np.minimum(own + 1, len(words) - 1)], 0)
                order = np.lexsort([follows, code, words[own]])
                w, c, f = words[own][order], code[order], follows[order]
                edge = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (c[1:] != c[:-1]) | (f[1:] != f[:-1])])) if len(w) else np.zeros(0, dtype=np.int64)
                n = np.diff(np.append(edge, len(w)))
                yield pa.RecordBatch.from_arrays([pa.array(w[edge]), pa.array(c[edge]), pa.array(f[edge], mask=c[edge] % total != other), pa.array(n)], names=["word", "code", "next", "n"])
        give_back()

    return docs.select("text").mapInArrow(of, "word long, code long, next long, n long")


def _assign(contexts: DataFrame, counts: np.ndarray, clusters: int) -> DataFrame:
    """(kind, word, n, class): kind 0 is a word with its count and class, kind 1 a class bigram and its count.

    Against fixed classes, the gain of putting a rare word into class k is, to
    first order, the sum of its neighbours' counts times the log of the class
    bigrams that they add to, less its own counts times the log of k's margins.
    """
    total = clusters + 2
    other = clusters
    m = counts + ADD
    seen = np.array([*range(clusters), total - 1])
    after = np.log(m[:clusters] / m[:clusters][:, seen].sum(axis=1, keepdims=True)).T  # [class after, k]
    before = np.log(m[:, :clusters] / m[seen][:, :clusters].sum(axis=0, keepdims=True))  # [class before, k]
    after[other], before[other] = 0.0, 0.0  # a neighbour without a class says nothing
    sent = contexts.sparkSession.sparkContext.broadcast((after, before))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after, before = sent.value
        pairs = np.zeros(total * total, dtype=np.int64)
        for b in batches:
            lists = b.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            code, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            left, right = code // total, code % total
            size = len(sizes) * total
            r = np.bincount(row * total + right, n, size).reshape(-1, total)
            x = np.bincount(row * total + left, n, size).reshape(-1, total)
            best = (r @ after + x @ before).argmax(axis=1)
            own = best[row]
            for a, z, ok in ((left, own, left != other), (own, right, right != other)):
                pairs += np.bincount((a * total + z)[ok], n[ok], total * total).astype(np.int64)
            count = r.sum(axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(best), dtype=np.int32)), b.column(0), pa.array(count), pa.array(best.astype(np.int32))], names=["kind", "word", "n", "class"])
        some = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(some), dtype=np.int32)), pa.array(some), pa.array(pairs[some]), pa.nulls(len(some), pa.int32())], names=["kind", "word", "n", "class"])
        give_back()

    # a word that is no head has a bounded share of the tokens; its rows meet once and serve both sums
    dealt = contexts.select("word", "code", "n").repartition("word")
    rows = dealt.groupBy("word", "code").agg(F.sum("n").alias("n")).groupBy("word").agg(F.collect_list(F.struct("code", "n")).alias("own"))
    return rows.mapInArrow(of, "kind int, word long, n long, class int")


def train(docs: DataFrame, heads: int = 20_000, frequent: int = 400_000, clusters: int = 64, strength: float = 5.0, least_gain: float = 0.05) -> tuple[ClassModel, DataFrame]:
    """The model, and the table (word, n, class) of all training words.

    `heads` words exchange in rounds; the classes and counts of about `frequent`
    ones travel with the model; both bound what tasks are sent. Class
    transitions lean on the class frequencies with the given strength. Without
    documents every count is 0.
    """
    total = clusters + 2
    counted = written(count_words(docs), "counts")
    sums = counted.agg(F.sum("n").alias("tokens"), F.count("*").alias("kinds"), F.sum(F.when(F.col("word") == F.lit(int(END)), F.col("n"))).alias("ends"), F.count_if(F.col("n") == 1).alias("once")).first()
    tokens, kinds, ends, once = (int(sums[c] or 0) for c in ("tokens", "kinds", "ends", "once"))
    top = most_frequent(counted, heads)
    by_rank = top["word"].to_numpy(dtype=np.int64)
    order = np.argsort(by_rank)
    # units are numbered by hash; the rank decides the first classes
    bigrams = written(count_bigrams(docs, by_rank[order]).select(_by_rank("code", order), "n"), "bigrams")
    classes, counts = exchange(bigrams, len(top), clusters, least_gain)
    head_class = classes[: len(top)][order]

    contexts = written(_contexts(docs, by_rank[order], head_class, total), "contexts")
    assigned = written(_assign(contexts, counts, clusters), "assigned")
    rest = assigned.where("kind = 0").select("word", "n", "class")
    known = docs.sparkSession.createDataFrame(pd.DataFrame({"word": by_rank, "n": top["n"].to_numpy(dtype=np.int64), "class": classes[: len(top)].astype(np.int32)}), "word long, n long, class int") if len(top) else rest.limit(0)
    vocabulary = rest.unionByName(known)

    # class bigrams: of heads, of one head and another word, of two other words
    final = counts.copy()
    final[clusters], final[:, clusters] = 0.0, 0.0
    final += _sum_codes(assigned.where("kind = 1").select(F.col("word").alias("code"), "n"), total)
    two = contexts.where("next is not null").select("word", "next", "n").repartition("word").groupBy("word", "next").agg(F.sum("n").alias("n"))
    two = two.join(rest.select("word", F.col("class").alias("a")), "word").join(rest.select(F.col("word").alias("next"), F.col("class").alias("z")), "next")
    final += _sum_codes(two.select((F.col("a") * total + F.col("z")).cast("long").alias("code"), "n"), total)

    share = (final.sum(axis=0) + ADD) * (np.arange(total) != clusters)
    share /= share.sum()
    unseen = (once + 0.5) / (tokens + 1)
    step = (1 - unseen) * (final + strength * share) / (final.sum(axis=1, keepdims=True) + strength)
    step[:, clusters] = unseen
    mass = np.ones(total)
    for r in vocabulary.groupBy("class").agg(F.sum("n").alias("n")).collect():
        mass[r["class"]] = r["n"]
    mass[clusters] = once + 1
    often = most_frequent(vocabulary, frequent).sort_values("word")
    model = ClassModel(
        clusters, often["word"].to_numpy(dtype=np.int64), often["class"].to_numpy(dtype=np.int64), often["n"].to_numpy(dtype=np.int64), np.log10(step), np.log10(mass), tokens, kinds, ends, once
    )
    return model, vocabulary


def _by_rank(code: str, order: np.ndarray) -> Column:
    """Pairs of units numbered by hash, numbered by rank instead."""
    units = len(order) + 2
    names = np.append(order, [units - 2, units - 1]).astype(np.int64)

    @F.arrow_udf("long")
    def of(codes: pa.Array) -> pa.Array:
        x = codes.to_numpy()
        return pa.array(names[x // units] * units + names[x % units])

    return of(F.col(code)).alias(code)


def _lookup(step: np.ndarray, a: Column, z: Column) -> Column:
    """The entry of a small matrix, as a literal of the plan."""
    table = F.expr("array(" + ",".join(f"{x!r}D" for x in step.ravel().tolist()) + ")")
    return F.get(table, (a * step.shape[1] + z).cast("int"))


PART = "doc_id long, mark long, word long, before int, after int, next long, n long, tokens long, known long, base double, score double"


def score(docs: DataFrame, model: ClassModel, vocabulary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, base_score, score) of every document.

    base_score is the add-0.1 unigram log10 probability, score the model's. A
    null text is an empty one: END alone. Tokens that the model's arrays hold are
    scored in the task; the others are joined with the vocabulary, and once more
    where two of them stand together. Rows that share a key are told apart by
    their texts; repeated rows come back as often. Other columns are left aside,
    and an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    end_class = model.clusters + 1

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        logs = np.log10(np.append(m.word_count, 1) + ADD)
        classes = np.append(m.word_class, 0)
        emit = np.log10(np.append(m.word_count, 1)) - m.mass[classes]
        end_log = np.log10(m.ends + ADD)
        for batch in batches:
            for start, texts in text_slices(batch.column(1)):
                ids = batch.column(0).slice(start, len(texts))
                marks = np.fromiter((xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass")) for t in texts), dtype=np.uint64, count=len(texts)).view(np.int64)
                words, doc = tokens_of(texts)
                at = _find(m.words, words)
                is_end, seen = words == END, at >= 0
                rare = ~seen & ~is_end
                cls = np.where(is_end, end_class, np.where(seen, classes[at], -1))
                before, after = np.concatenate([[end_class], cls[:-1]]), np.append(cls[1:], end_class)
                base = np.where(is_end, end_log, np.where(seen, logs[at], 0.0))
                own = np.where(~rare & (before >= 0), m.step[before, cls], 0.0) + np.where(seen, emit[at], 0.0)
                n = len(texts)
                known = np.bincount(doc, seen | (is_end & (m.ends > 0)), n).astype(np.int64)
                none = pa.nulls(n, pa.int64())
                yield _part(ids, pa.array(marks), none, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), none, none, pa.array(np.bincount(doc, minlength=n)), pa.array(known), pa.array(np.bincount(doc, base, n)), pa.array(np.bincount(doc, own, n)))
                if rare.any():
                    i = np.flatnonzero(rare)
                    follows = np.where(after[i] < 0, words[np.minimum(i + 1, len(words) - 1)], 0)
                    rows = np.stack([doc[i], words[i], before[i], after[i], follows])
                    rows = rows[:, np.lexsort(rows[::-1])]
                    edge = np.flatnonzero(np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)]))
                    times = np.diff(np.append(edge, rows.shape[1]))
                    d, w, b, a, f = rows[:, edge]
                    k = len(d)
                    none = pa.nulls(k, pa.int64())
                    yield _part(ids.take(pa.array(d)), pa.array(marks[d]), pa.array(w), pa.array(b.astype(np.int32)), pa.array(a.astype(np.int32)), pa.array(f, mask=a >= 0), pa.array(times), none, none, pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()))
        give_back()

    parts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(of, PART)
    parts = written(parts, "parts")  # read for single words, and for two together
    # rows without a word are dealt by document, so that they don't meet in one task
    parts = parts.withColumn("_w", F.coalesce("word", "doc_id", "mark"))
    joined = parts.join(vocabulary.select(F.col("word").alias("_w"), F.col("n").alias("c"), F.col("class").alias("k")), "_w", "left")
    is_word = F.col("word").isNotNull()
    cls = F.coalesce("k", F.lit(model.clusters))
    step = lambda a, z: F.when((a >= 0) & (z >= 0), _lookup(model.step, a, z)).otherwise(0.0)
    mass = F.get(F.expr("array(" + ",".join(f"{x!r}D" for x in model.mass.tolist()) + ")"), cls)
    emit = F.when(F.col("c").isNotNull(), F.log10("c")).otherwise(0.0) - mass
    first = joined.select(
        "doc_id", "mark", "next", "n", F.when(is_word, cls).alias("cls"), "tokens",
        F.when(is_word, F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).otherwise(F.col("known")).alias("known"),
        F.when(is_word, F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + ADD)).otherwise(F.col("base")).alias("base"),
        F.when(is_word, F.col("n") * (emit + step(F.col("before"), cls) + step(cls, F.col("after")))).otherwise(F.col("score")).alias("score"),
    )
    none = lambda kind: F.lit(None).cast(kind)
    joins = parts.where("next is not null").select("doc_id", "mark", "word", "next", "n").join(vocabulary.select("word", F.col("class").alias("a")), "word", "left")
    joins = joins.join(vocabulary.select(F.col("word").alias("next"), F.col("class").alias("z")), "next", "left")
    pairs = joins.select("doc_id", "mark", none("long").alias("tokens"), none("long").alias("known"), none("double").alias("base"), (F.col("n") * step(F.coalesce("a", F.lit(model.clusters)), F.coalesce("z", F.lit(model.clusters)))).alias("score"))
    rows = first.select("doc_id", "mark", "tokens", "known", "base", "score").unionByName(pairs)
    by_doc = rows.groupBy("doc_id", "mark").agg(F.count("tokens").alias("copies"), *(F.sum(c).alias(c) for c in ("tokens", "known", "base", "score")))
    scale = float(np.log10(model.tokens + ADD * (model.kinds + 1)))
    whole = lambda c: (F.col(c) / F.col("copies")).cast("long")
    one = by_doc.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"), whole("tokens").alias("n_tokens"), whole("known").alias("n_known"), (F.col("base") / F.col("copies")).alias("b"), (F.col("score") / F.col("copies")).alias("score"))
    return one.select(F.col("doc_id").alias(key), "n_tokens", "n_known", (F.col("b") - F.col("n_tokens") * scale).alias("base_score"), "score")


def _part(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=[c.split()[0] for c in PART.split(", ")])


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = bucket_of("doc_id", 10) == 0
    model, vocabulary = train(docs.where(~held_out))
    done = score(docs, model, vocabulary)
    return done.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
