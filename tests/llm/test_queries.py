"""The registered queries of the training-data operators, and the pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import oracle
from __spark_entry__ import oracle_sql, queries
from marlstone.llm import queries as llm
from marlstone.llm import sentencepieces
from marlstone.llm.text import WORD
from marlstone.session import materialize

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_matches_sql(spark, name):
    assert oracle.difference(spark, oracle.connect(SF), queries()[name], oracle_sql()[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(llm.QUERIES) - set(llm.ORACLES) - {"op4_nn_descent", "op12_subspace_dedup"}))
def test_one_row_for_each_document(spark, name):
    want = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    got = materialize(queries()[name](spark, SF), "query").select("doc_id")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_stages_take_effect(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    docs, names = given, [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(materialize(stage(spark, tables[-1], SF), "stage"))
    good, one, clean, mixed, coded = tables[1:]
    assert all(t.columns == given.columns for t in (good, one, clean, mixed))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    trusted = given.join(labels.filter("quality = 1"), "doc_id", "left_semi")
    assert good.join(trusted, "doc_id", "left_semi").count() >= 0.9 * trusted.count()
    junk = given.join(labels.filter("quality = 0"), "doc_id", "left_semi")
    assert good.join(junk, "doc_id", "left_semi").count() <= 0.5 * junk.count()
    assert one.join(good, "doc_id", "left_anti").isEmpty()
    assert one.select("text").distinct().count() == one.count() < good.count()
    assert clean.count() == one.count()
    assert clean.filter(F.col("text").rlike(r"[a-z0-9]@[a-z0-9-]+\.[a-z]")).isEmpty()
    words = F.sum(F.regexp_count("text", F.lit(WORD)))
    assert mixed.select(words).first()[0] == pytest.approx(1.5 * clean.select(words).first()[0], abs=25)
    model = llm.public_tokenizers.path("piece_bpe_32k.model")
    back = sentencepieces.decode(coded, model, ["doc_id"])
    want = mixed.select("doc_id", F.col("text").alias("decoded"))
    assert back.exceptAll(want).isEmpty() and back.count() == want.count()


def test_stages_on_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "a b c " * 9000, None, "s", 3), (2, None, "de", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(1) for c in ("key", "ids", "size", "text_hash", "cls", "index")})
    for table in (docs, docs.filter("1 = 0")):
        for _, stage in corpus_pipeline.STAGES:
            out = materialize(stage(spark, table, SF), "odd")
            assert out.columns == table.columns or "ids" in out.columns
            table = out
