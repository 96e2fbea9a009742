"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import language_id, line_dedup, ngram_join, packing, quality_rules
from tidegate.llm.common import with_may, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, which are of no language, and tells the language of those that don't say it."""
    predict = language_id.predictor(spark, language_id.train(docs.where(~language_id.held_out("doc_id"))))
    mark = f"_told_{uuid.uuid4().hex[:8]}"  # the documents may have columns of any name
    told = docs.withColumn(mark, predict(F.col("text"))["lang_pred"]).where(F.col(mark) != language_id.UNKNOWN)
    return told.select(*(F.coalesce("lang", mark).alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base or the cutoffs certified for their language, as the first stage left it."""
    labels = quality_rules.quality_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    stratum = F.coalesce(F.col("lang"), F.lit(""))
    row = F.xxhash64("doc_id", stratum, "text")  # all that the verdict is made of; rows that share an id are each judged by their own text
    rows = docs.select(row.alias("row"), "doc_id", stratum.alias("stratum"), "text")
    signals = written(quality_rules.with_signals(rows).drop("text"), "signals")  # computed once; the documents stay where they are
    judged = quality_rules.judged(signals, quality_rules.certified_cutoffs(signals.join(labels, "doc_id")))
    dropped = written(judged.where(~F.col("kept")).select("row").distinct(), "dropped")
    # most documents go straight through: only those that a bitmap marks as possibly dropped meet the exact list
    marked = with_may(docs.select(F.struct(*docs.columns).alias("doc"), row.alias("row")), dropped, "row", 1 << 26)
    doubtful = marked.where("may").join(dropped, "row", "left_anti")
    return marked.where(~F.col("may")).select("doc.*").unionByName(doubtful.select("doc.*"))


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that stand on many sites out of otherwise own documents."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    done = line_dedup.dedup_lines(docs.select(F.struct(*rest).alias("doc"), "doc_id", "source", "text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*(new[c].alias(c) if c in new else F.col(f"doc.{c}") for c in docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group linked by five-word shingles, similarity 0.8."""
    return ngram_join.one_of_each(docs, size=5, similarity=(80, 100)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("quality rules", apply_quality_rules),
    ("line dedup", remove_boilerplate),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("best-fit packing", pack),
]

#: Language ID and packing are not expressible in SQL; tests hold a run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; returns the placed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
