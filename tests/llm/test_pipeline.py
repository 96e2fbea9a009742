"""The pipeline's stages against plain Python."""

import corpus_pipeline as P
from pyspark.sql import functions as F
from tests.llm.test_documents import check_packing
from tests.llm.test_pairs_and_models import brute_components

from tidegate.llm import line_dedup, quality_rules
from tidegate.llm.common import with_may, written


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        seen[name] = {r.doc_id: r for r in docs.collect()}
    first, second, third, fourth = seen.values()
    assert set(fourth) <= set(third) == set(second) <= set(first)
    raw = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert set(first) == {i for i, r in raw.items() if any(c.isalpha() for c in r.text or "")}
    assert all(r.lang == (raw[i].lang or r.lang) and r.lang for i, r in first.items())  # told where it is not given
    signals = {r.doc_id: r for r in quality_rules.with_signals(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert set(second) <= {i for i in first if not signals[i].base_failed}
    assert all(r.n_chars == len(r.text) for r in third.values())
    order = sorted(third)
    groups = brute_components([third[i].text for i in order], 5, 80, 100)
    assert set(fourth) == {order[i] for i, (_, c) in groups.items() if i == c}
    rows = P.STAGES[-1][1](spark, docs, sf_dir).collect()
    left = sorted(fourth)
    place = {i: n for n, i in enumerate(left)}
    Row = type("Row", (), {})
    moved = []
    for r in rows:
        own = Row()
        own.__dict__.update(r.asDict() | {"doc_id": place[r.doc_id]})
        moved.append(own)
    check_packing(moved, [fourth[i].text for i in left], 2048)


def test_run_equals_stages_and_is_stable(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    staged = sorted(map(tuple, P.STAGES[-1][1](spark, docs, sf_dir).collect()))
    assert staged and staged == sorted(map(tuple, P.run(spark, sf_dir).collect())) == sorted(map(tuple, P.run(spark, sf_dir).collect()))


def test_stages_keep_odd_columns_and_rows(spark, sf_dir):
    """Extra columns with the stages' own names, repeated rows, and null columns pass through."""
    own = "some plain words that make a text of more than ten words in one line here"
    rows = [(1, own, "en", "a", 7), (1, own, "en", "a", 7), (2, None, "en", None, None), (3, "", None, "b", 0), (4, f"{own} and then some more of them", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["lang_pred", "score", "n_words", "base_failed", "kept", "stratum", "doc", "n_lines", "n_spread", "n_removed", "_may", "component_id"]
    for c in clash:
        docs = docs.withColumn(c, F.lit("mine"))
    columns = docs.columns
    for _, stage in P.STAGES[:3]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        got = docs.collect()
        assert sorted(r.doc_id for r in got) == [1, 1, 4]
        assert all(r[c] == "mine" for r in got for c in clash)
    assert [r.doc_id for r in P.STAGES[4][1](spark, docs, sf_dir).orderBy("doc_id").collect()] == [1, 1, 4]


def test_empty_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir).limit(0)
        assert docs.count() == 0
        if "piece" in docs.columns:
            break
    assert line_dedup.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)).count() == 0


def test_quality_stage_writes_no_text(spark, sf_dir, monkeypatch):
    """what the stage keeps beside its input and output is small; the documents themselves are not written again."""
    tables = []
    monkeypatch.setattr(P, "written", lambda df, label: tables.append(df.columns) or written(df, label))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null")
    assert P.apply_quality_rules(spark, docs, sf_dir).count() < docs.count()
    assert len(tables) == 2 and not any({"doc", "text"} & set(columns) for columns in tables)


def test_quality_stage_runs_no_python(spark, sf_dir):
    """pipeline: the bitmap of dropped documents is a join, which says yes to every id and to few others, and no node of the stage runs Python."""
    ids = spark.range(-3000, 3000, 3)
    may = with_may(spark.range(-3000, 3000).withColumn("word", F.lit("mine")), ids, "id", 1 << 16)
    assert may.columns == ["id", "word", "may"] and may.count() == 6000
    assert may.where("may and id % 3 = 0").count() == 2000 and may.where("may").count() < 2200
    plan = P.apply_quality_rules(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan
