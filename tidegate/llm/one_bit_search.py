"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector is split into the centre of its list and a rest. The rest is rotated at
random and only the signs are kept, packed into bits, with two numbers that turn
the product of the signs and a rotated query into an estimate of the inner
product and bound its error. Vectors whose estimate plus bound reaches the best
so far are scored exactly; the others are never looked at in full.

Equal vectors are searched for, and searched with, once. Lists are dealt out in
blocks of bounded size, so neither a large list nor many copies of one vector
make a large task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import written


def usable(vector: Column) -> Column:
    """A vector that is not null or zero and has only finite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(dim: int, seed: int = 20240611) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centres_of(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of `lists` lists by Lloyd's rounds; fewer if the sample has fewer vectors."""
    centres = sample[np.random.default_rng(seed).permutation(len(sample))[:lists]].copy()
    for _ in range(rounds if len(centres) > 1 else 1):
        near = np.concatenate([nearest(part, centres) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1)[None, :] - 2 * vectors @ centres.T, axis=1)


class Index:
    """What every task needs to code vectors: per dimension the centres and a rotation. Its size is bounded by `lists`."""

    def __init__(self, centres: dict[int, np.ndarray]):
        self.centres = centres
        self._rotations: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return {"centres": self.centres, "_rotations": {}}

    def rotation(self, dim: int) -> np.ndarray:
        if dim not in self._rotations:
            self._rotations[dim] = rotation(dim)
        return self._rotations[dim]

    def centres_for(self, dim: int) -> np.ndarray:
        return self.centres.get(dim, np.zeros((1, dim)))

    def code(self, vectors: np.ndarray) -> tuple[np.ndarray, ...]:
        """(list, packed signs, scale, spread, rest's length): the estimate of <q, rest> is scale * <signs, rotated q>, its standard error spread * |q|."""
        dim = vectors.shape[1]
        centres = self.centres_for(dim)
        cell = nearest(vectors, centres)
        rest = vectors - centres[cell]
        turned = rest @ self.rotation(dim).T
        length = np.sqrt((rest * rest).sum(axis=1))
        whole = np.abs(turned).sum(axis=1)  # sqrt(dim) * |rest| * cosine between the rest and its signs
        safe = np.maximum(whole, 1e-300)
        cosine = np.where(length > 0, whole / np.maximum(length * np.sqrt(dim), 1e-300), 1.0)
        spread = length * np.sqrt(np.maximum(0.0, 1 - cosine**2)) / np.maximum(cosine, 1e-9) / np.sqrt(max(1, dim - 1))
        return cell, np.packbits(turned >= 0, axis=1), np.where(whole > 0, length**2 / safe, 0.0), spread, length


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of rows with q in double precision, added up from the first component to the last."""
    total = np.zeros(len(v))
    for d in range(v.shape[1]):
        total += v[:, d] * q[d]
    return total


def best_of_block(queries: np.ndarray, least: np.ndarray, block: dict[str, np.ndarray], index: Index, k: int, epsilon: float, tile: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, rows, scores): the block's best k rows of each query that score at least its `least`.

    Ties of score go to the smaller rep. A query whose `least` is not known takes
    the k-th exact score of the rows with the best estimates.
    """
    vectors, dim = block["v"], queries.shape[1]
    signs = (np.unpackbits(block["bits"], axis=1, count=dim) * 2.0 - 1) * block["scale"][:, None]
    bound = epsilon * block["spread"]
    centres = index.centres_for(dim)[block["cell"][0]]
    step = max(1, tile // max(1, len(vectors)))
    for at in range(0, len(queries), step):
        q = queries[at : at + step]
        norms = np.sqrt((q * q).sum(axis=1))
        guess = (q @ index.rotation(dim).T) @ signs.T
        guess += (q @ centres)[:, None]
        for i in range(len(q)):
            low, est, seeds = least[at + i], guess[i], np.zeros(0, dtype=np.int64)
            if len(vectors) > k:
                seeds = np.argpartition(-est, k - 1)[:k]
                low = max(low, exact(q[i], vectors[seeds]).min())
            slack = 1e-9 * (norms[i] + np.abs(est).max(initial=0))
            rows = np.union1d(np.flatnonzero(est + bound * norms[i] + slack >= low), seeds)
            rough = vectors[rows] @ q[i]
            if len(rows) > k:
                low = max(low, np.partition(rough, len(rows) - k)[len(rows) - k])
            rows = rows[rough >= low - slack]
            score = exact(q[i], vectors[rows])
            keep = np.lexsort((block["rep"][rows], -score))[:k]
            keep = keep[score[keep] >= least[at + i]]
            yield at + i, rows[keep], score[keep]


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), dim)


def _by_dim(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of equal dimension together."""
    for batch in batches:
        dims = batch.column("v").value_lengths().to_numpy()
        for dim in np.unique(dims):
            yield int(dim), batch.filter(pa.array(dims == dim))


def one_each(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): the usable vectors by id, the smallest of each id."""
    v = F.col(vector).cast("array<double>")
    return rows.where(F.col(key).isNotNull() & usable(v)).groupBy(F.col(key).cast("long").alias("id")).agg(F.min(v).alias("v"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(rep, ids, v) over (id, v): distinct vectors with their smallest k + 1 ids, ascending, numbered by the first of these.

    Later copies cannot be among anyone's nearest k: so many better ones are as near.
    """
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_n") <= k + 1)
    found = first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return found.orderBy(F.element_at("ids", 1)).select(F.monotonically_increasing_id().alias("rep"), "ids", "v")


def fit(vectors: DataFrame, rows_a_list: int, lists: int, sample: int) -> Index:
    """The index, from about `sample` vectors in all."""
    total = vectors.count()
    share = min(1.0, sample / max(1, total))
    # chosen by a hash of the vector: the same at any partitioning; the limit only bounds what an unlucky hash lets through
    some = vectors.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("v").limit(2 * sample).toArrow()
    centres = {}
    for dim, part in _by_dim(iter(some.combine_chunks().to_batches())):
        own = _matrix(part.column("v"), dim)
        wanted = int(np.ceil(total * len(own) / max(1, len(some)) / rows_a_list))
        centres[dim] = centres_of(own, max(1, min(lists, wanted)))
    return Index(centres)


def _coded(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part in _by_dim(batches):
            cell, bits, scale, spread, length = index.code(_matrix(part.column("v"), dim))
            cols = [np.full(len(part), dim, dtype=np.int32), cell.astype(np.int32), part.column("rep"), part.column("v"), [b.tobytes() for b in bits], scale, spread, length]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=["dim", "cell", "rep", "v", "bits", "scale", "spread", "length"])

    return run


def _homes(index: Index):
    """Each query with the list whose centre has the largest product with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part in _by_dim(batches):
            best = np.argmax(_matrix(part.column("v"), dim) @ index.centres_for(dim).T, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), dim, dtype=np.int32)), pa.array(best.astype(np.int32)), part.column("rep"), part.column("v")], names=["dim", "cell", "rep", "v"])

    return run


def _open_lists(index: Index, reach: dict[tuple[int, int], float]):
    """Each query once for every list that may hold something as good as its `least`: <q, centre> + |q| * the longest rest there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part in _by_dim(batches):
            q, centres = _matrix(part.column("v"), dim), index.centres_for(dim)
            longest = np.array([reach.get((dim, c), -np.inf) for c in range(len(centres))])
            norms = np.sqrt((q * q).sum(axis=1))
            most = q @ centres.T + norms[:, None] * longest[None, :]
            least = part.column("least").to_numpy()
            slack = 1e-9 * norms * (1 + np.abs(centres).max(initial=0))
            at, cell = np.nonzero(most + slack[:, None] >= least[:, None])
            for low in range(0, len(at), 4096):
                rows = part.take(pa.array(at[low : low + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), dim, dtype=np.int32)), pa.array(cell[low : low + 4096].astype(np.int32)), rows.column("rep"), rows.column("v"), rows.column("least")], names=["dim", "cell", "rep", "v", "least"])

    return run


def _searched(index: Index, k: int, epsilon: float):
    def run(key: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(q) and len(c):
            dim, reps = int(key[0].as_py()), q["rep"].to_numpy()
            c = c.sort_by("rep")
            bits = np.frombuffer(b"".join(c["bits"].to_pylist()), dtype=np.uint8).reshape(len(c), -1)
            block = {"v": _matrix(c["v"], dim), "bits": bits, **{n: c[n].to_numpy() for n in ("rep", "scale", "spread", "cell")}}
            for i, rows, score in best_of_block(_matrix(q["v"], dim), q["least"].to_numpy(), block, index, k, epsilon):
                found.append((reps[i], block["rep"][rows], score))
        rep, near, score = zip(*found, strict=True) if found else ((), (), ())
        return pa.table([pa.array(rep, pa.int64()), pa.array(near, pa.list_(pa.int64())), pa.array(score, pa.list_(pa.float64()))], names=["rep", "near", "score"])

    return run


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, epsilon: float = 2.5, block: int = 16_384, query_block: int = 512, rows_a_list: int = 65_536, lists: int = 4096, sample: int = 65_536) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows of `vectors` but itself.

    Nearness is the largest inner product, ties to the smaller id. Both tables
    have the key and the vector; other columns are left aside. Vectors that are
    null, zero or have a component that is null or not finite take no part, nor
    do rows without a key; a vector is compared with those of its own dimension.
    Repeated rows count once; of several vectors of one key the smallest counts.

    The centres are fitted on about `sample` vectors (at most twice as many);
    every row is indexed, and every list and row is passed over only by its
    bound. `epsilon` is the number of standard errors an estimate may be wrong;
    at 2.5 a row at the edge is missed once in 160 times, others far less often.
    """
    spark = vectors.sparkSession
    distinct = written(distinct_vectors(one_each(vectors, key, vector), k), "distinct")
    index = fit(distinct, rows_a_list, lists, sample)
    coded = written(distinct.select("rep", "v").mapInArrow(_coded(index), "dim int, cell int, rep long, v array<double>, bits binary, scale double, spread double, length double"), "codes")
    cells = coded.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("length").alias("reach")).toPandas()  # at most `lists` rows a dimension
    reach = {(int(d), int(c)): float(r) for d, c, r in zip(cells["dim"], cells["cell"], cells["reach"], strict=True)}
    blocks = spark.createDataFrame([(int(d), int(c), -(-int(n) // block)) for d, c, n in zip(cells["dim"], cells["cell"], cells["n"], strict=True)], "dim int, cell int, blocks int")

    asked = written(one_each(queries, key, vector).select(F.col("id").alias("query_id"), F.xxhash64("v").alias("h"), "v"), "asked")
    known = written(asked.groupBy("h", "v").agg(F.min("query_id").alias("rep")), "queries")  # equal queries are searched for once

    def search(wanted: DataFrame, every: bool) -> DataFrame:
        """(rep, near, score) of wanted (dim, cell, rep, v, least) in every block, or the first, of their lists."""
        wanted = wanted.join(F.broadcast(blocks), ["dim", "cell"])
        wanted = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if every else F.lit(0)).drop("blocks")
        per = wanted.groupBy("dim", "cell", "part").agg(F.ceil(F.count("*") / query_block).cast("int").alias("groups"))
        per = written(per, "groups")
        held = coded.join(F.broadcast(blocks), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        held = held.join(per, ["dim", "cell", "part"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        held = held.select("dim", "cell", "part", "group", "rep", "v", "bits", "scale", "spread")
        wanted = wanted.join(per, ["dim", "cell", "part"]).withColumn("group", F.pmod(F.xxhash64("rep"), F.col("groups")).cast("int"))
        on = ["dim", "cell", "part", "group"]
        found = wanted.groupBy(*on).cogroup(held.groupBy(*on)).applyInArrow(_searched(index, k + 1, epsilon), "rep long, near array<long>, score array<double>")
        return found

    homes = known.select("rep", "v").mapInArrow(_homes(index), "dim int, cell int, rep long, v array<double>").withColumn("least", F.lit(float("-inf")))
    seen = written(search(homes, every=False), "seen")
    asking = known.select("rep", "v").join(seen, "rep", "left").select("rep", "v", F.when(F.size("score") > k, F.element_at("score", -1)).otherwise(float("-inf")).alias("least"))
    found = search(asking.mapInArrow(_open_lists(index, reach), "dim int, cell int, rep long, v array<double>, least double"), every=True)
    # what the first look found stays, also where an estimate falls short the second time
    near = found.unionByName(seen).select("rep", F.explode(F.arrays_zip("near", "score")).alias("x")).select("rep", F.col("x.near").alias("near"), F.col("x.score").alias("score")).distinct()
    order = (F.desc("score"), F.asc("near"))
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("rep").orderBy(*order))).where(F.col("_n") <= k + 1).drop("_n")
    ids = near.join(distinct.select(F.col("rep").alias("near"), "ids"), "near").select("rep", F.explode(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("id")))).alias("x"))
    ids = ids.withColumn("_n", F.row_number().over(Window.partitionBy("rep").orderBy("x"))).where(F.col("_n") <= k + 1)
    best = ids.groupBy("rep").agg(F.sort_array(F.collect_list("x")).alias("xs")).join(known.select("rep", "v", "h"), "rep").drop("rep")
    out = asked.join(best, ["h", "v"]).select("query_id", F.slice(F.filter("xs", lambda x: x["id"] != F.col("query_id")), 1, k).alias("xs"))
    out = out.select("query_id", F.posexplode("xs").alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def op11(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest_neighbours(rows, rows.where(F.col("vec_id") % 20 == 0))


#: All pairs, which SQL can state at a small size; one-bit codes find the same rows there.
OP11_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b) AS score
      FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
