"""Removal of boilerplate lines by the number of distinct sites that carry them.

Each line's hash gathers a HyperLogLog sketch of its sites; sketches merge by
aggregation, so a line that stands in every document costs each task one small
sketch. Lines whose estimate comes near the threshold, on either side, get an
exact count of distinct sites. The verdicts equal those of exact counts as long
as an estimate errs by less than the margin.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm.common import SPACE, let, written


def line_key(line: Column) -> Column:
    """What makes two lines the same: their bytes without outer white space."""
    return F.xxhash64(F.regexp_replace(line, f"^[{SPACE}]+|[{SPACE}]+$", ""))


def _lines(docs: DataFrame, text: str, site: str) -> DataFrame:
    """(site, line key) of each line that has a visible character."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    rows = docs.select(F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.explode(lines).alias("line"))
    return rows.where(F.col("line").rlike(f"[^{SPACE}]")).select("site", line_key(F.col("line")).alias("line"))


def spread_lines(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = 8, margin: float = 0.25, lg_k: int = 12) -> DataFrame:
    """Lines on at least min_sites distinct sites: line key and number of sites.

    Estimates below (1 - margin) of the threshold are settled as too few and
    those above (1 + margin) as enough; the lines between are counted exactly.
    A null site counts as one site.
    """
    lines = _lines(docs, text, site)
    low, high = int(min_sites * (1 - margin)), min_sites * (1 + margin)
    est = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"))
    likely = written(est.where(F.col("sites") >= low), "line-spread")
    near = likely.where(F.col("sites") <= high).select("line")
    exact = lines.join(near, "line", "left_semi").groupBy("line").agg(F.countDistinct("site").alias("sites"))
    return likely.where(F.col("sites") > high).select("line", "sites").unionByName(exact.where(F.col("sites") >= min_sites))


def drop_lines(docs: DataFrame, spread: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without their boilerplate lines, with counts of what went.

    Adds n_lines (lines with a visible character), n_spread (those in `spread`)
    and n_removed. A document that has no line of its own, every visible one
    being in `spread`, is a copy rather than a carrier of boilerplate and stays
    whole, for the removal of near duplicates; every other document loses all
    its spread lines, however many they are. Lines without a visible character
    always stay. A null text stays null, an empty one empty. Rows that share a
    key are each judged by their own text, and repeated rows alike.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    body = F.xxhash64(F.col(text))
    mark = uuid.uuid4().hex[:8]  # the documents may have columns of any name
    key_, body_, at = (f"_{x}_{mark}" for x in ("key", "body", "at"))
    rows = docs.select(F.col(key).alias(key_), body.alias(body_), F.posexplode(lines).alias("pos", "line")).where(F.col("line").rlike(f"[^{SPACE}]"))
    marked = rows.select(key_, body_, "pos", line_key(F.col("line")).alias("line"))
    hits = marked.join(spread.select("line"), "line", "left_semi").groupBy(key_, body_).agg(F.collect_set("pos").alias(at))
    out = docs.join(hits, docs[key].eqNullSafe(hits[key_]) & (body == hits[body_]), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(at))
    kept = let(lines, lambda all_: F.array_join(F.transform(left, lambda i: F.get(all_, i)), "\n"))
    n_lines = F.size(F.filter(lines, lambda line: line.rlike(f"[^{SPACE}]")))
    hit = F.when(F.col(at).isNull(), 0).otherwise(F.size(at)).cast("long")
    cut = (hit > 0) & (hit < n_lines)
    old = [c for c in docs.columns if c not in (text, "n_lines", "n_spread", "n_removed")]
    return out.select(
        *(docs[c] for c in old), F.when(cut, kept).otherwise(F.col(text)).alias(text), n_lines.cast("long").alias("n_lines"), hit.alias("n_spread"), F.when(cut, hit).otherwise(F.lit(0).cast("long")).alias("n_removed")
    )


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 8) -> DataFrame:
    """spread_lines, then drop_lines. An empty table gives an empty one."""
    return drop_lines(docs, spread_lines(docs, text, site, min_sites), key, text)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    done = dedup_lines(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    return done.select("doc_id", "n_lines", "n_spread", "n_removed", F.length(text).cast("long").alias("chars_left"), F.sha2(text, 256).alias("text_sha256"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, pos - 1 AS pos, line,
         regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k,
         regexp_matches(line, '[^\x20\x09-\x0D]') AS visible
  FROM (SELECT doc_id, source, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
        FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
spread AS (SELECT k FROM l WHERE visible GROUP BY k HAVING count(DISTINCT site) >= 8),
m AS (SELECT l.*, visible AND k IN (SELECT k FROM spread) AS hit FROM l),
d AS (SELECT doc_id, count(*) FILTER (visible) AS n_lines, count(*) FILTER (hit) AS n_spread FROM m GROUP BY doc_id),
t AS (SELECT m.doc_id, any_value(n_lines) AS n_lines, any_value(n_spread) AS n_spread,
             any_value(CASE WHEN n_spread < n_lines THEN n_spread ELSE 0 END) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT (hit AND n_spread < n_lines)), '') AS text
      FROM m JOIN d USING (doc_id) GROUP BY m.doc_id)
SELECT doc_id, n_lines, n_spread, n_removed, length(text) AS chars_left, sha256(text) AS text_sha256 FROM t
"""
