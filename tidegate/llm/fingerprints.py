"""Document fingerprints by consistent weighted sampling.

A text is the weighted set of its words, each weighing its count. For each of
`samples` rounds, a word of weight w draws r and c from Gamma(2, 1) and b from
the unit interval, all fixed by the word and the round; with
t = floor(ln w / r + b) and y = exp(r (t - b)) its key is c / (y e^r). The word
with the smallest key, together with t, is the round's sample. Two texts have
the same sample with probability sum(min w) / sum(max w), the generalised
Jaccard similarity, so the share of equal samples estimates it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import SPACE, words, written

SAMPLES = 32
#: Rounds whose keys one row computes; small enough for compiled code.
BLOCK = 4
DIGITS = 8


def _unit(hash_: Column, shift: int, bits: int) -> Column:
    """A number inside (0, 1) from some bits of a hash."""
    return (F.shiftrightunsigned(hash_, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) * (1.0 / (1 << bits))


def _sample(word: Column, log_weight: Column, rank: Column) -> Column:
    """The word's key and sample in one long, ordered by the key.

    The key's logarithm, in steps of 2**-24, stands above 32 bits that name the
    word and t.
    """
    one = F.xxhash64(word, rank)
    two = F.xxhash64(rank, one)
    r = -F.log(_unit(one, 32, 32) * _unit(one, 0, 32))
    log_c = F.log(-F.log(_unit(two, 43, 21) * _unit(two, 22, 21)))
    b = _unit(two, 0, 22)
    t = F.floor(log_weight / r + b)
    log_key = log_c - r * (t - b + 1.0)
    step = F.least(F.greatest(F.floor((log_key + 64.0) * (1 << 24)), F.lit(0)), F.lit((1 << 31) - 1))
    packed = F.shiftleft(step, 32).bitwiseOR(F.xxhash64(word, t).bitwiseAND(F.lit((1 << 32) - 1)))
    return F.when(log_weight.isNotNull(), packed)


def paired_fingerprints(rows: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(id, fingerprint, edited_fingerprint) for rows of id, same, text, edited.

    `same` is a part that both texts begin with, ending after white space (or
    empty); `text` and `edited` are what follows it. A word of equal weight in
    both is sampled once. Ids are distinct. Rows without a word in either text
    don't come back: see empty_fingerprint. Rows already dealt by id are not
    dealt again.
    """
    blocks = samples // BLOCK
    parts = F.array(*(F.struct(F.lit(i).alias("part"), F.col(c).alias("t")) for i, c in enumerate(("same", "text", "edited"))))
    split = rows.select("id", F.explode(parts).alias("p")).select("id", "p.part", F.explode(words(F.col("p.t"))).alias("word"))
    weights = split.groupBy("id", F.xxhash64("word").alias("word")).agg(F.count(F.when(F.col("part") <= 1, 1)).alias("wa"), F.count(F.when(F.col("part") != 1, 1)).alias("wb"))
    logs = weights.select("id", "word", *(F.when(F.col(w) > 0, F.log(F.col(w).cast("double"))).alias(f"l{w[1]}") for w in ("wa", "wb")))
    dealt = logs.select("id", "word", "la", "lb", F.explode(F.array(*(F.lit(i * BLOCK) for i in range(blocks)))).alias("block"))
    least = [F.min(_sample(F.col("word"), F.col(f"l{x}"), F.col("block") + j)).alias(f"{x}{j}") for x in "ab" for j in range(BLOCK)]
    best = dealt.groupBy("id", "block").agg(*least)
    tag = lambda c: F.lower(F.lpad(F.hex(c.bitwiseAND(F.lit((1 << 32) - 1))), DIGITS, "0"))
    row = F.struct("block", *(F.concat(*(F.coalesce(tag(F.col(f"{x}{j}")), F.lit("0" * DIGITS)) for j in range(BLOCK))).alias(x) for x in "ab"))
    put = best.groupBy("id").agg(F.sort_array(F.collect_list(row)).alias("f"))
    return put.select("id", *(F.array_join(F.col(f"f.{x}"), "").alias(n) for x, n in (("a", "fingerprint"), ("b", "edited_fingerprint"))))


def empty_fingerprint(samples: int = SAMPLES) -> str:
    """Of a text without words."""
    return "0" * (DIGITS * samples)


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two fingerprints."""
    part = lambda f, i: F.substring(f, i * DIGITS + 1, F.lit(DIGITS))
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: part(a, i) == part(b, i))) / float(samples)


def next_in_order(ids: DataFrame, key: str, rows_per_part: int = 500_000) -> DataFrame:
    """The rows with next_id: the next larger key, and the first after the last.

    Rows are ranged over partitions and written, so that each partition finds
    the successors inside it; the first key of each later partition, one row a
    partition, closes the gaps. Keys are distinct.
    """
    parts = 1 + ids.count() // rows_per_part
    ranged = written(ids.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()), "ranged")
    firsts = ranged.groupBy("_part").agg(F.min(key).alias("_first"))
    after = Window.orderBy("_part")
    firsts = firsts.select("_part", F.lead("_first").over(after).alias("_then"), F.min("_first").over(Window.partitionBy()).alias("_all"))
    inside = F.lead(key).over(Window.partitionBy("_part").orderBy(key))
    return ranged.withColumn("_in", inside).join(firsts, "_part").withColumn("next_id", F.coalesce("_in", "_then", "_all")).drop("_part", "_in", "_then", "_all")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(key, fingerprint) of every document; a null or blank text has the empty one.

    Equal texts have equal fingerprints. Other columns are left aside; keys are
    distinct; an empty table gives an empty one.
    """
    rows = docs.select(F.col(key).alias("id"), F.lit("").alias("same"), F.coalesce(text, F.lit("")).alias("text"))
    found = paired_fingerprints(rows.withColumn("edited", F.lit("")), samples)
    return rows.join(found, "id", "left").select(F.col("id").alias(key), F.coalesce("fingerprint", F.lit(empty_fingerprint(samples))).alias("fingerprint"))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = written(next_in_order(docs.select("doc_id", F.length("text").alias("n_chars")), "doc_id"), "order")
    take = F.floor(F.col("n_chars") / 4).cast("int")
    gives = order.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("to"), take.alias("take"))
    given = docs.join(gives, "doc_id").select(F.col("to").alias("doc_id"), F.substring("text", F.lit(1), F.col("take")).alias("given"))
    pairs = docs.join(given, "doc_id").withColumn("n_chars", F.length("text"))
    keep = F.substring("text", F.lit(1), F.col("n_chars") - take)
    pairs = pairs.select("doc_id", "text", "n_chars", keep.alias("keep"), F.concat(keep, F.col("given")).alias("edited"))
    same = F.regexp_extract("keep", rf"(?s)^(.*[{SPACE}])", 1)
    rest = lambda c: F.substring(c, F.length("same") + 1, F.length(c))
    rows = pairs.select(F.col("doc_id").alias("id"), "text", "edited", same.alias("same")).select("id", "same", rest("text").alias("text"), rest("edited").alias("edited"))
    found = paired_fingerprints(rows)
    none = F.lit(empty_fingerprint())
    whole = pairs.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256")).join(found, F.col("doc_id") == F.col("id"), "left")
    done = written(whole.select("doc_id", "n_chars", "edited_sha256", F.coalesce("fingerprint", none).alias("fingerprint"), F.coalesce("edited_fingerprint", none).alias("edited_fingerprint")), "fingerprints")
    nexts = order.select("doc_id", "next_id").join(done.select(F.col("doc_id").alias("next_id"), F.col("fingerprint").alias("other")), "next_id").select("doc_id", "other")
    return done.join(nexts, "doc_id").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("other")).alias("near_next")
    )
