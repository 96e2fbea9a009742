"""Quality rules whose cutoffs are certified on labelled documents.

A rule rejects a document whose measure exceeds a cutoff. The rules tighten
together, step by step of a fixed grid: at each step a document goes if any of
its measures exceeds that step's cutoff. For every stratum, each step is tested
on the labelled documents of good quality: the hypothesis that it rejects more
than `max_loss` of them falls when the exact binomial tail P(Bin(n, max_loss) <=
rejected) is small enough. Steps are tested from the mildest on, which needs no
correction along the grid, and the level is divided by the number of strata, so
with the stated confidence no stratum loses more than `max_loss` of its good
documents that pass the base, by all rules together. About 220 good documents
certify a step for one of four strata. The base (too few words, too much
repetition) is a fixed rule before them and stands outside this guarantee. Among
certified steps the one that gains most on the labels is used.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.llm.common import SPACE, let, words, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Cutoffs of more strata than this are joined by a shuffle.
MOST_SENT = 10_000
#: Cutoffs of each rule, mildest last; those at one place are one step.
GRIDS: dict[str, list[float]] = {
    "symbol_share": [0.01, 0.015, 0.02, 0.03, 0.04, 0.05, 0.08, 0.12, 0.2],
    "dup_line_share": [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95],
    "repeat_share": [0.1, 0.12, 0.14, 0.15, 0.16, 0.17, 0.18, 0.19, 0.2],
    "mean_word_chars": [7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 14.0, 16.0, 20.0],
}


def repeated_words(array: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of words found twice or more in the text.

    Windows are compared by a 64-bit hash. Only a text in which a hash repeats
    pays for sorting them.
    """

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(window))))
        return F.when(F.size(w) < window, F.lit(0).cast("long")).otherwise(let(hashes, repeats))

    def repeats(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, places))

    def places(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        at = F.transform(s, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["i"]))
        return let(F.sort_array(F.array_compact(at)), covered)

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(array, of)


def with_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the counts and shares that the rules read.

    A null or blank text counts as one without words: all counts 0, all shares
    0, base_failed. Columns of the same names are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    n_lines = lambda v: F.struct(F.size(v).cast("long").alias("all"), (F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("dup"))
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeated_words(w).alias("repeat"))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", *GRIDS, "base_failed"]
    kept = [c for c in docs.columns if c not in names]
    mark = uuid.uuid4().hex[:8]  # the rows may have columns of any name
    w, l = f"_w_{mark}", f"_l_{mark}"  # noqa: E741
    counted = docs.select(
        *kept, let(words(text), of_words).alias(w), let(lines, n_lines).alias(l), F.length(F.regexp_replace(body, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols")
    ).select(*kept, F.col(f"{w}.n").alias("n_words"), F.col(f"{w}.chars").alias("word_chars"), "n_symbols", F.col(f"{l}.all").alias("n_lines"), F.col(f"{l}.dup").alias("n_dup_lines"), F.col(f"{w}.repeat").alias("n_repeat_words"))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return counted.select(
        "*",
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("word_chars", "n_words").alias("mean_word_chars"),
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
    )


def log_binomial_tail(n: Column, k: Column, share: float) -> Column:
    """ln P(Bin(n, share) <= k), exact; 0 where k is not below the mean."""
    ratio = share / (1 - share)
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    down = F.when(k >= 1, F.sequence(k, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    choose = F.aggregate(steps, F.lit(0.0), lambda a, j: a + F.log((n - k + j) / j))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def add(a: Column, j: Column) -> Column:
        t = a["t"] * j / ((n - j + 1) * F.lit(ratio))
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    tail = F.aggregate(down, start, add, lambda a: F.log(a["s"]))
    return F.when(k >= n * share, F.lit(0.0)).otherwise(choose + k * math.log(share) + (n - k) * math.log(1 - share) + tail)


def certified_cutoffs(labelled: DataFrame, stratum: str = "stratum", max_loss: float = 0.02, risk: float = 0.05, price: float = 4.0, grids: dict[str, list[float]] | None = None) -> DataFrame:
    """(stratum, one column per rule): the cutoffs in force; a stratum without a certified step has no row.

    `labelled` has the columns of with_signals, a stratum and quality (1: good).
    Of the certified steps the one is chosen with the most bad documents rejected
    less `price` for each good one; the mildest wins ties, and one without a gain
    isn't used. Strata with too few labels get no cutoff. Lists of `grids` are
    equally long. An empty table gives an empty one.
    """
    grids = grids or GRIDS
    steps = len(next(iter(grids.values())))
    if any(len(g) != steps for g in grids.values()):
        raise ValueError("the grids' lists must be equally long")
    exceeded = F.greatest(F.lit(0), *(F.size(F.filter(F.array(*map(F.lit, g)), lambda c: F.col(r) > c)) for r, g in grids.items()))  # noqa: B023  used at once
    rows = labelled.where(~F.col("base_failed")).select(F.col(stratum).alias("stratum"), (F.col("quality") == 1).cast("long").alias("good"), exceeded.alias("over"))
    counts = rows.groupBy("stratum", "over").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    spread = counts.select("stratum", "good", "bad", "over", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i"))
    tested = spread.groupBy("stratum", "i").agg(F.sum("good").alias("n"), F.sum(F.when(F.col("over") > F.col("i"), F.col("good")).otherwise(0)).alias("k"), F.sum(F.when(F.col("over") > F.col("i"), F.col("bad")).otherwise(0)).alias("bad"))
    strata = tested.select("stratum").distinct().agg(F.count("*").alias("strata"))
    milder = Window.partitionBy("stratum").orderBy(F.desc("i"))
    sure = tested.join(F.broadcast(strata)).withColumn("ok", F.min((log_binomial_tail(F.col("n"), F.col("k"), max_loss) <= F.log(F.lit(risk) / F.col("strata"))).cast("int")).over(milder) == 1)
    gain = F.col("bad") - price * F.col("k")
    best = sure.where(F.col("ok") & (gain > 0)).groupBy("stratum").agg(F.max_by("i", F.struct(gain, F.col("i"))).alias("i"))
    return best.select("stratum", *(F.get(F.array(*map(F.lit, g)), F.col("i")).alias(f"max_{r}") for r, g in grids.items()))


def judged(signals: DataFrame, cutoffs: DataFrame, stratum: str = "stratum") -> DataFrame:
    """The rows with `kept`: base passed and no measure above its certified cutoff.

    Cutoffs hold one row a stratum. A row of a stratum without cutoffs is judged
    by the base alone. A column `kept` is replaced; all others stay.
    """
    mark = uuid.uuid4().hex[:8]  # the rows may have columns of any name
    key, cuts = f"_stratum_{mark}", f"_cuts_{mark}"
    named = cutoffs.select(F.col("stratum").alias(key), F.struct(*(f"max_{r}" for r in GRIDS)).alias(cuts))
    if cutoffs.limit(MOST_SENT + 1).count() <= MOST_SENT:  # one row a stratum; a few strata would be hot keys of a shuffle
        named = F.broadcast(named)
    bad = F.lit(False)
    for r in GRIDS:
        bad = bad | F.coalesce(F.col(r) > F.col(f"{cuts}.max_{r}"), F.lit(False))
    kept = [c for c in signals.columns if c != "kept"]
    return signals.join(named, F.col(stratum) == F.col(key), "left").select(*kept, (~F.col("base_failed") & ~bad).alias("kept"))


def quality_of(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """One label a document; a document labelled both ways counts as good."""
    return labels.where(F.col("quality").isNotNull()).groupBy(F.col(key).alias(key)).agg(F.max("quality").alias("quality"))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    signals = written(with_signals(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), "text")).drop("text"), "signals")
    cutoffs = certified_cutoffs(signals.join(quality_of(labels), "doc_id"))
    return judged(signals, cutoffs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _over_sql() -> str:
    return ", ".join(f"len(list_filter({g}::DOUBLE[], lambda c: {r} > c))" for r, g in GRIDS.items())


OP1_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS stratum, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 3, 1))) AS i, ws FROM w),
keyed AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM win),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed) WHERE c > 1),
gaps AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS g FROM twice),
rep AS (SELECT doc_id, sum(g)::BIGINT AS n FROM gaps GROUP BY doc_id),
s AS (SELECT w.doc_id, stratum, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_share, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_share,
             coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_share, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars FROM s),
q AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
lab AS (SELECT stratum, quality, greatest({_over_sql()}) AS over FROM m JOIN q USING (doc_id) WHERE NOT base_failed),
t AS (SELECT stratum, i, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND over > i) AS k, count(*) FILTER (quality <> 1 AND over > i) AS bad FROM lab CROSS JOIN range(9) s(i) GROUP BY ALL),
p AS (SELECT *, CASE WHEN k >= n * 0.02 THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j:
             exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.02) + (n - j) * ln(0.98)))) END AS tail,
             (SELECT count(DISTINCT stratum) FROM t) AS strata FROM t),
ok AS (SELECT *, min((tail <= 0.05 / strata)::INT) OVER (PARTITION BY stratum ORDER BY i DESC) = 1 AS ok, bad - 4.0 * k AS gain FROM p),
best AS (SELECT stratum, arg_max(i, gain * 1000 + i) AS i FROM ok WHERE ok AND gain > 0 GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(greatest({_over_sql()}) <= i, true) AS kept
FROM m LEFT JOIN best USING (stratum)
"""
