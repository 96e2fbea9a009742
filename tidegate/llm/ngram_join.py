"""Similarity join of documents on word n-grams, by PartEnum signatures.

Two sets of Jaccard similarity J or more differ in few elements. Sets are put
into bands of nearly equal size; within a band, and between a band and the
next, the largest symmetric difference k is known. The feature domain (hashes)
is parted into groups of `parts` partitions, and each subset of `parts - spare`
partitions of a group gives one signature: the hash of what the set holds
there. With k // (spare + 1) + 1 groups, some group holds at most `spare` of
the differing elements, so similar sets share a signature.

Exact copies become one class first. Classes that share a signature are
candidates. Most are settled by comparing each with the smallest class of its
signatures; components found so far then leave only pairs between different
components, which are compared as well, so no link is lost. A parity bitmap
bounds the symmetric difference from below and spares most exact comparisons;
large sets have a second one, as wide as their size asks for, which pairs meet
before the sets themselves are moved.

Signatures travel as their lowest 40 bits: those that are equal by chance only
add candidates, which the exact comparison turns down.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import give_back, hashed_words, id_filter, mix64, text_slices, written
from tidegate.llm.components import connected_components

BITS = 512
#: Bits of a signature that are kept, so that a row takes less room in a shuffle.
SIGNATURE_BITS = 40
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams.

    Only A-Z are lower-cased. A text with fewer words than `size` has its whole
    sequence as one element; a text without words has none.
    """
    hashes, counts, *_ = hashed_words([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])
    sets, at = [], 0
    with np.errstate(over="ignore"):
        if len(hashes) >= size:
            rows = len(hashes) - size + 1
            run = np.zeros(rows, dtype=np.uint64)
            for j in range(size):
                run = (run + hashes[j : j + rows]) * _ODD[j % len(_ODD)]
            run = mix64(run)
        for n in counts.tolist():
            if n >= size:
                sets.append(np.unique(run[at : at + n - size + 1]))
            elif n:
                whole = np.uint64(n)
                for h in hashes[at : at + n]:
                    whole = (whole * _ODD[0]) ^ h
                sets.append(mix64(np.array([whole * _ODD[1]], dtype=np.uint64)))
            else:
                sets.append(np.zeros(0, dtype=np.uint64))
            at += n
    return sets


def set_class(s: np.ndarray) -> int:
    """One 64-bit number for a set, the same for equal sets."""
    with np.errstate(over="ignore"):
        whole = mix64(np.array([mix64(s ^ _ODD[4]).sum(dtype=np.uint64) + np.uint64(len(s)) * _ODD[5]], dtype=np.uint64))
    return int(whole.view(np.int64)[0])


class Bands:
    """Size bands with the number of groups that each label needs."""

    def __init__(self, num: int, den: int, parts: int, spare: int):
        self.num, self.den, self.parts, self.spare = num, den, parts, spare
        self.ends = [0]
        self.subsets = [np.array(x) for x in combinations(range(parts), parts - spare)]

    def of(self, n: int) -> int:
        """The band of a size: band b holds sizes from ends[b-1] + 1 to ends[b]."""
        while self.ends[-1] < n:
            self.ends.append((self.ends[-1] + 1) * self.den // self.num)
        return int(np.searchsorted(self.ends, n))

    def groups(self, label: int) -> tuple[int, int]:
        """(groups, groups that may be passed over when empty) of a label.

        The label of a band compares it with the band below, and the sets of
        the band below with each other.
        """
        self.of(self.ends[min(label, len(self.ends) - 1)])
        while len(self.ends) <= label:
            self.of(self.ends[-1] + 1)
        k = (self.den - self.num) * (self.ends[label - 1] + self.ends[label]) // (self.den + self.num)
        needed = k // (self.spare + 1) + 1
        extra = 1 + needed // 20
        return needed + extra, extra

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """All signatures of a set that isn't empty.

        `extra` groups stand beyond those needed, so similar sets agree in more
        than `extra` groups. A set with at most `extra` groups that have an
        empty subset may leave those subsets out: of the groups in which it
        agrees with the other set one more is full.
        """
        band = self.of(len(s))
        found = []
        with np.errstate(over="ignore"):
            run = np.concatenate([[np.uint64(0)], np.cumsum(mix64(s ^ _ODD[6]), dtype=np.uint64)])
            for label in (band, band + 1):
                groups, extra = self.groups(label)
                cells = groups * self.parts
                # equal ranges of the hash domain; hashes are sorted
                bounds = (np.arange(1, cells, dtype=np.uint64) * np.uint64((2**64 - 1) // cells)) if cells > 1 else np.zeros(0, dtype=np.uint64)
                cut = np.concatenate([[0], np.searchsorted(s, bounds), [len(s)]])
                held = (run[cut[1:]] - run[cut[:-1]]).reshape(groups, self.parts)
                sizes = np.diff(cut).reshape(groups, self.parts)
                empty = np.array([sizes[:, x].sum(axis=1) == 0 for x in self.subsets])
                leave = empty.any(axis=0).sum() <= extra
                number = np.arange(groups, dtype=np.uint64) * _ODD[2] + np.uint64(label) * _ODD[3]
                for j, x in enumerate(self.subsets):
                    sig = number + np.uint64(j + 1) * _ODD[7]
                    for i in x:
                        sig = mix64(sig ^ (held[:, i] + np.uint64(i + 1)))
                    found.append(sig[~empty[j]] if leave else sig)
        return np.concatenate(found)


def wide_bits(s: np.ndarray) -> np.ndarray | None:
    """A parity bitmap of at least two bits an element, as longs; none for sets that the fixed one serves."""
    if 2 * len(s) <= BITS:
        return None
    size = 1 << int(2 * len(s) - 1).bit_length()
    return np.packbits((np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).view(np.int64)


DIGEST = "doc_id long, n long, class long, bits array<long>, wide array<long>"


def _digest(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, class, bits, wide) of each document; class is null for empty sets."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column(1)):
                sets = shingle_sets(texts, size)
                bits = np.zeros((len(sets), BITS), dtype=np.uint8)
                for row, s in zip(bits, sets, strict=True):
                    row[:] = np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
                packed = np.packbits(bits, axis=1).view(np.int64).ravel()
                offsets = np.arange(len(sets) + 1, dtype=np.int32) * (BITS // 64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_class(s) if len(s) else None for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(packed)), pa.array(map(wide_bits, sets), pa.list_(pa.int64()))],
                    names=["doc_id", "n", "class", "bits", "wide"],
                )
        give_back()

    return docs.mapInArrow(of, DIGEST)


def _signatures(docs: DataFrame, size: int, bands: tuple[int, int, int, int]) -> DataFrame:
    """(sig, class); a class that a task has met before isn't repeated by it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, met = Bands(*bands), set()
        for batch in batches:
            for _, texts in text_slices(batch.column(1)):
                sigs, classes = [], []
                for s in shingle_sets(texts, size):
                    if len(s) and (c := set_class(s)) not in met:
                        if len(met) < 300_000:
                            met.add(c)
                        sigs.append(kinds.signatures(s))
                        classes.append(np.full(len(sigs[-1]), c, dtype=np.int64))
                if sigs:
                    yield _pairs(sigs, classes)
        met.clear()
        give_back()

    return docs.mapInArrow(of, "sig long, class long")


def _pairs(sigs: list[np.ndarray], classes: list[np.ndarray]) -> pa.RecordBatch:
    kept = np.concatenate(sigs) & np.uint64((1 << SIGNATURE_BITS) - 1)
    return pa.RecordBatch.from_arrays([pa.array(kept.view(np.int64)), pa.array(np.concatenate(classes))], names=["sig", "class"])


def _sets(docs: DataFrame, size: int, wanted: DataFrame, filter_bits: int) -> DataFrame:
    """(doc_id, elements) of the documents in `wanted`, which has one column, doc_id, and of few others.

    A bitmap of fixed size, filter_bits, tells tasks which documents to hash, so
    that texts need no shuffle; joins drop what it lets through besides.
    """
    may = id_filter(wanted, "doc_id", filter_bits)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in text_slices(batch.column(1)):
                sets = shingle_sets(texts, size)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], names=["doc_id", "elements"])
        give_back()

    return docs.where(may(F.col("doc_id"))).mapInArrow(of, "doc_id long, elements array<long>")


def _could_link(a: str, b: str, num: int, den: int) -> Column:
    """Whether sizes and bitmaps allow the similarity; never false for a link."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    x, y = F.col(f"{a}.bits"), F.col(f"{b}.bits")
    apart = F.lit(0)
    for i in range(BITS // 64):
        apart = apart + F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i))))
    return (den * F.least(na, nb) >= num * F.greatest(na, nb)) & ((den + num) * apart <= (den - num) * (na + nb))


def _wide_could_link(num: int, den: int) -> Column:
    """Whether the wide bitmaps x and y of sets of nx and ny allow the similarity; the larger is folded to the other's size."""
    xor = lambda x, y: F.zip_with(x, y, lambda i, j: i.bitwiseXOR(j))

    def folded(x: Column, to: Column) -> Column:
        """By one half; sets of similar sizes have bitmaps of one size or of the next."""
        return F.when(F.size(x) == to, x).when(F.size(x) == 2 * to, xor(F.slice(x, F.lit(1), to), F.slice(x, to + 1, to)))

    least = F.least(F.size("x"), F.size("y"))
    apart = F.aggregate(xor(folded(F.col("x"), least), folded(F.col("y"), least)), F.lit(0), lambda n, i: n + F.bit_count(i))
    return F.coalesce((den + num) * apart <= (den - num) * (F.col("nx") + F.col("ny")), F.lit(True))


def _likely(pairs: DataFrame, digest: DataFrame, num: int, den: int) -> DataFrame:
    """The written pairs (a, b) that the wide bitmaps, met by ids, leave."""
    about = lambda name, n, wide: digest.where("wide is not null").select(F.col("doc_id").alias(name), F.col("n").alias(n), F.col("wide").alias(wide))
    met = pairs.join(about("a", "nx", "x"), "a", "left").join(about("b", "ny", "y"), "b", "left")
    return written(met.where(_wide_could_link(num, den)).select("a", "b"), "likely")


def _linked(pairs: DataFrame, rows: DataFrame, size: int, num: int, den: int, filter_bits: int) -> DataFrame:
    """The written pairs (a, b) whose exact similarity reaches num / den."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = written(_sets(rows, size, ids, filter_bits), "sets")
    one = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("x")), "a")
    two = one.join(sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("y")), "b")
    # sets can be long: a column function meets one pair at a time, where a batch for Python would hold thousands
    both = two.select("a", "b", (F.size("x") + F.size("y")).cast("long").alias("n"), F.size(F.array_intersect("x", "y")).cast("long").alias("c"))
    return both.where(den * F.col("c") >= num * (F.col("n") - F.col("c"))).select("a", "b")


def join_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, similarity: tuple[int, int] = (80, 100), parts: int = 3, spare: int = 1, filter_bits: int = 1 << 23) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Documents link when the similarity of their sets is at least num / den; a
    component is named by its smallest id. Null and blank texts link with
    nothing. Keys are distinct integers. Sets are told apart by 64-bit hashes.
    Other columns are left aside, and an empty table gives an empty one.
    """
    num, den = similarity
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    digest = written(_digest(rows, size), "digest")
    classes = digest.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits"))

    group = Window.partitionBy("sig")
    shared = _signatures(rows, size, (num, den, parts, spare)).withColumn("low", F.min("class").over(group)).withColumn("high", F.max("class").over(group))
    shared = written(shared.where("low <> high").select("sig", "class").distinct(), "shared")
    named = written(classes.join(shared.select("class").distinct(), "class", "left_semi"), "classes")
    signed = shared.join(named.select("class", "id"), "class").select("sig", "id")
    about = lambda name, own: named.select(F.col("id").alias(name), F.struct("n", "bits").alias(own))

    # first pass: each class against the smallest class of its signatures
    first = signed.select(F.col("id").alias("b"), F.min("id").over(group).alias("a")).where("a < b").distinct()
    tried = first.join(about("a", "p"), "a").join(about("b", "q"), "b").where(_could_link("p", "q", num, den)).select("a", "b")
    edges = written(_linked(_likely(written(tried, "tried"), digest, num, den), rows, size, num, den, filter_bits), "edges")
    found = connected_components(edges)

    # second pass: what still stands in different components; rows stay slim until the last join
    labelled = signed.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = labelled.withColumn("lo", F.min("component").over(group)).withColumn("hi", F.max("component").over(group)).where("lo <> hi").drop("lo", "hi")
    members = F.count("*").over(Window.partitionBy("sig", "component"))
    biggest = F.max(F.struct("members", "component")).over(group)["component"]
    sided = written(open_.withColumn("members", members).withColumn("out", F.col("component") != biggest).select("sig", "id", "component", "out"), "open")
    full = sided.join(named.select("id", "n", "bits"), "id").select("sig", F.struct("id", "n", "bits", "component", "out").alias("p"))
    left, right = full.where("p.out"), full.select("sig", F.col("p").alias("q"))
    differ = (F.col("p.component") != F.col("q.component")) & (~F.col("q.out") | (F.col("p.id") < F.col("q.id"))) & _could_link("p", "q", num, den)
    rest = left.alias("l").join(right.alias("r"), (F.col("l.sig") == F.col("r.sig")) & differ)
    late = written(rest.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).distinct(), "tried")
    more = written(_linked(_likely(late, digest, num, den), rows, size, num, den, filter_bits), "edges")
    final = connected_components(edges.union(more)) if not more.isEmpty() else found

    of_class = classes.select("class", "id").join(final.select(F.col("node").alias("id"), "component"), "id", "left").select("class", F.coalesce("component", "id").alias("component"))
    return digest.join(of_class, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", **join: object) -> DataFrame:
    """The documents without all but the smallest id of each component.

    Most documents go straight through: only those that a bitmap marks as
    possibly dropped meet the exact list of dropped ids in a join.
    """
    dropped = written(join_components(docs, key, **join).where("doc_id <> component_id").select(F.col("doc_id").alias(key)), "dropped")
    may = id_filter(dropped, key)(F.col(key))
    marked = docs.select(F.struct(*docs.columns).alias("doc"), may.alias("may"))
    doubtful = marked.where("may").select("doc.*").join(dropped, key, "left_anti")
    return marked.where(~F.col("may")).select("doc.*").unionByName(doubtful)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return join_components(docs, size=3, similarity=(90, 100))
