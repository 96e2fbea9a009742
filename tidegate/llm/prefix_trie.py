"""The trie of all beginnings of conversations, totalled from its leaves to its root.

A node is a distinct sequence of first turns. Its key is the exclusive or of a
hash of every (place, role, text) up to there, so keys come from sums that may be
taken in blocks, and a conversation of any length is spread over many tasks.

Totals travel by messages. A run of nodes with the same members is one segment;
each segment counts the child segments it still waits for, and one that waits
for none sends its totals to its parent, round by round, until the root is done.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import SPACE, written

KEY = ["depth", "k1", "k2"]


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, part, at, t1, t2, words): turns in order, as hashes.

    The order is by turn, null first, then role, then text; null roles and texts
    are empty. Rows are sorted over all tasks, not in one task a conversation:
    `at` grows along a conversation within a `part`, and parts follow each other.
    """
    said = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie")
    )
    by = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "tie"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = said.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()
    return dealt.select(
        "conv_id", F.shiftright(at, 33).alias("part"), at.alias("at"), F.xxhash64("role", "text").alias("t1"), F.xxhash64("text", F.lit(7), "role").alias("t2"), F.regexp_count("text", F.lit(f"[^{SPACE}]+")).cast("long").alias("words")
    )


def rebuilt(turns: DataFrame, group: int, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that start as the first of their group does.

    Conversation c gets the first `heads` turns of conversation c - c % group in
    place of its own first ones (all, if that has fewer; none, if it is absent).
    Returns turns (conv_id, depth, t1, t2, words, turns) and conversations
    (conv_id, turns); `turns` is how many a conversation has. `heads`
    is a column over conv_id, 0 to `most`.
    """
    held = turns.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = written(held.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "held")
    convs = held.groupBy("conv_id").agg(F.sum("n").alias("own")).withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", heads)
    bases = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    convs = convs.join(bases, "base", "left").withColumn("take", F.least("h", F.coalesce("there", F.lit(0))))
    convs = written(convs.select("conv_id", "base", "h", "take", (F.col("take") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns")), "convs")
    placed = turns.join(held.join(convs, "conv_id").drop("n"), ["conv_id", "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before") + 1)
    cols = ["conv_id", "depth", "t1", "t2", "words", "turns"]
    own = placed.where("pos > h").withColumn("depth", F.col("pos") - F.col("h") + F.col("take")).select(*cols)
    starts = placed.where((F.col("conv_id") % group == 0) & (F.col("pos") <= most)).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "t1", "t2", "words")
    shared = starts.join(convs, "base").where("depth <= take").select(*cols)
    return own.unionByName(shared), convs.select("conv_id", "turns")


def prefixes(turns: DataFrame, block: int = 1024) -> DataFrame:
    """Each turn with the key of the beginning that it ends, its parent's key, and the words so far.

    Running values are taken within blocks of a conversation and the totals of
    earlier blocks are added to them.
    """
    mark = lambda seed: F.xxhash64(F.lit(seed), "depth", "t1", "t2")
    rows = turns.withColumn("x1", mark(1)).withColumn("x2", mark(2)).withColumn("block", F.expr(f"(depth - 1) div {block}"))
    so_far = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "block", "depth", "x1", "x2", "words", "turns", F.bit_xor("x1").over(so_far).alias("b1"), F.bit_xor("x2").over(so_far).alias("b2"), F.sum("words").over(so_far).alias("b_words"))
    ends = rows.where(F.col("depth") == (F.col("block") + 1) * block).select("conv_id", (F.col("block") + 1).alias("block"), "b1", "b2", "b_words")
    earlier = Window.partitionBy("conv_id").orderBy("block")
    ends = ends.select("conv_id", "block", F.bit_xor("b1").over(earlier).alias("e1"), F.bit_xor("b2").over(earlier).alias("e2"), F.sum("b_words").over(earlier).alias("e_words"))
    rows = rows.join(ends, ["conv_id", "block"], "left")
    zero = F.lit(0).cast("long")
    plus = lambda a, b: F.col(a).bitwiseXOR(F.coalesce(F.col(b), zero))
    rows = rows.select("conv_id", "depth", "x1", "x2", "words", "turns", plus("b1", "e1").alias("k1"), plus("b2", "e2").alias("k2"), (F.col("b_words") + F.coalesce("e_words", zero)).alias("so_far"))
    return rows.select("conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "words", "so_far", (F.col("depth") == F.col("turns")).alias("last"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each key's ids, read piece by piece in order; only the hash's state is held."""
    now, state = None, None
    for batch in batches:
        out = {"depth": [], "k1": [], "k2": [], "ends_sha256": []}
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
            if key != now:
                if state is not None:
                    for name, value in zip(out, (*now, state.hexdigest()), strict=True):
                        out[name].append(value)
                now, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pydict(out, schema=_DIGEST)
    if state is not None:
        yield pa.RecordBatch.from_pydict({name: [value] for name, value in zip(_DIGEST.names, (*now, state.hexdigest()), strict=True)}, schema=_DIGEST)


_DIGEST = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])


def end_digests(ends: DataFrame, span: int = 16_384) -> DataFrame:
    """(depth, k1, k2, ends_sha256) over ends (depth, k1, k2, conv_id), conv_id distinct.

    Ids are first joined in ranges of `span` ids. A SHA-256 is a chain, so the
    ranges of one key pass through one task, in order, one at a time.
    """
    part = F.floor(F.col("conv_id") / span)
    joined = ends.groupBy(*KEY, part.alias("range")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return joined.repartition(*KEY).sortWithinPartitions(*KEY, "range").mapInArrow(_digest, "depth long, k1 long, k2 long, ends_sha256 string")


def peel(segments: DataFrame) -> DataFrame:
    """(conv_id, n_convs, leaves, below) of every segment, from the leaves up.

    `segments` has conv_id, n_convs (together its key), up_conv, up_n (its
    parent's key, null at the root), remaining (child segments), leaves (those
    known before any message) and gain. A round takes the segments that wait for
    nothing, sums what they send by parent, and lowers the parents' counters.
    There are as many rounds as segments on the longest way to the root, which is
    far below the longest conversation: a segment ends only where members part.
    """
    waiting = written(segments.withColumn("below", F.lit(0).cast("long")), "peel")
    finished = []
    while True:
        ready = waiting.where("remaining = 0")
        finished.append(ready)
        sent = ready.where("up_conv is not null").groupBy(F.col("up_conv").alias("conv_id"), F.col("up_n").alias("n_convs"))
        sent = sent.agg(F.count("*").alias("s_n"), F.sum("leaves").alias("s_leaves"), F.sum(F.col("below") + F.col("gain")).alias("s_below"))
        left = waiting.where("remaining > 0").join(sent, ["conv_id", "n_convs"], "left")
        add = lambda a, b, sign=1: (F.col(a) + sign * F.coalesce(F.col(b), F.lit(0))).alias(a)
        waiting = written(left.select("conv_id", "n_convs", "up_conv", "up_n", add("remaining", "s_n", -1), add("leaves", "s_leaves"), "gain", add("below", "s_below")), "peel")
        if waiting.isEmpty():
            break
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    return out.select("conv_id", "n_convs", "leaves", "below")


def prefix_trie(rows: DataFrame, group: int, heads: Column, most: int) -> DataFrame:
    """One row a node of the trie of rebuilt conversations.

    `rows` has conv_id, turn, role and text; other columns are left aside. Rows
    without a conv_id are of no conversation. Repeated rows are turns of their
    own; rows of equal turn follow by role, then text. An empty table has no
    root and gives an empty one. Turns are told apart by 128 bits of hashes.
    """
    turns, convs = rebuilt(written(ordered(rows), "turns"), group, heads, most)
    paths = written(prefixes(turns), "paths")
    nodes = paths.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.max("words").alias("words"), F.max("so_far").alias("so_far"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("p1"), zero.alias("p2"), zero.alias("words"), zero.alias("so_far"))
    nodes = written(nodes.unionByName(root), "nodes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))
    parents = nodes.select(F.col("depth").alias("p0"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("up_conv"), F.col("n_convs").alias("up_n"), F.col("so_far").alias("up_so_far"))
    nodes = written(nodes.withColumn("p0", F.col("depth") - 1).join(parents, ["p0", "p1", "p2"], "left").drop("p0", "p1", "p2"), "nodes")

    several = nodes.where("n_convs > 1")
    top = F.min_by(F.struct("up_conv", "up_n", "up_so_far"), "depth").alias("top")
    segments = several.groupBy("conv_id", "n_convs").agg(top, F.max_by("n_children", "depth").alias("n_children"), F.max("so_far").alias("to"))
    segments = written(segments.select("conv_id", "n_convs", "top.up_conv", "top.up_n", "n_children", "to", ((F.col("n_convs") - 1) * (F.col("to") - F.coalesce("top.up_so_far", zero))).alias("gain")), "segments")
    waits = segments.where("up_conv is not null").groupBy(F.col("up_conv").alias("conv_id"), F.col("up_n").alias("n_convs")).agg(F.count("*").alias("remaining"))
    waiting = segments.join(waits, ["conv_id", "n_convs"], "left").withColumn("remaining", F.coalesce("remaining", zero))
    # a child with one member is a single path: one leaf and nothing saved
    known = F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_children") - F.col("remaining")).cast("long")
    totals = peel(waiting.select("conv_id", "n_convs", "up_conv", "up_n", "remaining", known.alias("leaves"), "gain")).join(segments.select("conv_id", "n_convs", "to"), ["conv_id", "n_convs"])

    ends = paths.where("last").select(*KEY, "conv_id").unionByName(convs.where("turns = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id"))
    cols = [*KEY, "conv_id", "n_convs", "up_conv", "n_children"]
    many = several.join(totals, ["conv_id", "n_convs"]).select(*cols, F.col("leaves").alias("n_leaves"), (F.col("below") + (F.col("n_convs") - 1) * (F.col("to") - F.col("so_far") + F.col("words"))).alias("saved_tokens"))
    single = nodes.where("n_convs = 1").select(*cols, F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"))
    done = many.unionByName(single).join(end_digests(ends), KEY, "left")
    return done.select("conv_id", "depth", F.col("up_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op13(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return prefix_trie(rows, 20, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4, most=3)


OP13_SQL = r"""
WITH own AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, count(*) AS n,
         xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ord(d)::BIGINT),
             lambda crc, b: list_reduce(range(8)::BIGINT[], lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, b)),
             4294967295::BIGINT), 4294967295::BIGINT) % 4 AS h
  FROM own GROUP BY conv_id),
b AS (SELECT c.*, least(c.h, coalesce(o.n, 0)) AS take FROM c LEFT JOIN c AS o ON o.conv_id = c.base),
r AS (SELECT b.conv_id, pos - h + take AS depth, role, text FROM b JOIN own USING (conv_id) WHERE pos > h
      UNION ALL SELECT b.conv_id, pos, role, text FROM b JOIN own ON own.conv_id = b.base WHERE pos <= take),
p AS (SELECT conv_id, depth, list(sha256(role || chr(0) || text)) OVER (PARTITION BY conv_id ORDER BY depth) AS path,
             len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r
      UNION ALL SELECT conv_id, 0, [], 0 FROM c),
l AS (SELECT conv_id, max(depth) AS ends FROM p GROUP BY conv_id),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = ends), '')) AS ends_sha256
      FROM p JOIN l USING (conv_id) GROUP BY depth, path),
k AS (SELECT depth - 1 AS depth, path[:-2] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, path)),
s AS (SELECT p.depth, p.path, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.words) AS saved_tokens
      FROM f AS u JOIN p ON p.conv_id = u.conv_id AND p.depth <= u.depth GROUP BY p.depth, p.path)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (depth, path) LEFT JOIN n AS q ON q.depth = f.depth - 1 AND q.path = f.path[:-2]
"""
