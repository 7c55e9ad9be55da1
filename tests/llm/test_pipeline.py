"""The pipeline on the smallest folder, stage by stage, and what the entry point registers."""

import __spark_entry__
import corpus_pipeline
from pyspark.sql import functions as F
from rundelta.llm import decontaminate, neardup
from rundelta.llm.common import materialize

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, FOLDER), "test")
        if name == "token shards":
            assert out.count() == docs.count()
            rows = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in out.collect())
            assert all(a[0] + a[1] == b[0] and a[2] <= b[2] for a, b in zip(rows, rows[1:], strict=False))
            break
        assert out.columns == columns and out.count() > 0
        if name == "near duplicates":
            again = neardup.near_duplicates(out, corpus_pipeline.SIMILARITY_PERCENT)
            assert again.where("not kept").count() == 0 and out.count() < docs.count()
        if name == "decontamination":
            bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
            assert decontaminate.find_contaminated(out, bench).where("contaminated").count() == 0
        docs = out


def test_one_row_of_each_group_stays_without_unique_identifiers(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [(None, a), (None, a + " end"), (1, b), (1, b), (1, b), (2, c), (3, c + " end"), (3, d), (4, e), (None, e), (5, None), (5, None), (6, " ")]
    docs = spark.createDataFrame([(i, t, "xyz"[n % 3]) for n, (i, t) in enumerate(rows)], "doc_id long, text string, source string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    groups = [sum((t or "").startswith(x) for _, t in got) for x in "abcde"]
    assert groups == [1, 1, 1, 1, 1] and len(got) == 8
    assert {(1, b), (2, c), (3, d), (4, e)} <= set(got)


def test_stages_take_nulls_clashing_columns_and_nothing(spark):
    """Rows with nulls and columns that are called as the operators' own come through every stage."""
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(1, words, "a", None, 1, "x", 2.0), (2, None, None, "en", None, None, None), (None, "some text here", "b", None, 3, "y", 1.0), (None, None, None, None, None, None, None), (3, "", "a", "fr", 0, "z", 0.0), (3, "", "a", "fr", 0, "z", 0.0), (4, words + " end", "b", None, 5, "x", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, size long, `a.b` string, place double").withColumns({"node": F.lit("n"), "comp": F.lit(1), "shards": F.lit(2), "whole": F.lit("w"), "taken": F.lit(0)})
    for empty in (False, True):
        for name, stage in corpus_pipeline.STAGES:
            given = docs.limit(0) if empty else docs
            out = materialize(stage(spark, given, FOLDER), "test")
            if name == "token shards":
                assert out.count() == given.count()
            else:
                assert out.columns == docs.columns
                kept = {r["doc_id"] for r in out.select("doc_id").collect()}
                assert kept == set() if empty else {2, 3, None} <= kept or name == "mixing"
                if name == "near duplicates" and not empty:
                    assert out.count() == 6 and 4 not in kept


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert names["pipeline"] is corpus_pipeline.run
    assert set(__spark_entry__.oracle_sql()) <= set(names)
