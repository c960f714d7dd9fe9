"""A small corpus through ingest, versions and answers."""

import pytest
from pyspark.sql import functions as F

from marlstone.config import QuerySettings
from marlstone.functions.ids import sha256_hex
from marlstone.plans import answer as answering
from marlstone.errors import IngestError
from marlstone.plans.ingest import Corpus, ingest
from marlstone.plans.steps import StepLog
from marlstone.streaming.progress import step_states, task_progress

MANUAL = "# RS-12 Multimeter Manual\n\n## Voltage\nTurn the dial to V to measure voltage.\n\n## Current\nUse the A socket to measure current.\n"
GUIDE = "# Garden Guide\n\n## Roses\nRoses need sun and water.\n\n## Soil\nSoil should drain well.\n"


def documents(spark, *rows):
    df = spark.createDataFrame(rows, "file_title string, content string")
    return df.withColumn("source_hash", sha256_hex(F.col("content"))).withColumn("doc_key", F.col("source_hash"))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    store = Corpus(spark, str(tmp_path_factory.mktemp("corpus")))
    ingest(documents(spark, ("manual", MANUAL), ("guide", GUIDE)), store, published_at="2024-01-01 00:00:00")
    return store


def test_ingest_is_idempotent(spark, corpus):
    before = sorted((r.id, r.content) for r in corpus.chunks.read().collect())
    ingest(documents(spark, ("manual", MANUAL)), corpus, published_at="2024-01-01 00:00:00")
    assert sorted((r.id, r.content) for r in corpus.chunks.read().collect()) == before
    assert len(before) == 4 and corpus.active_vectors().count() == 4


def test_answers_use_the_named_document(spark, corpus):
    asked = spark.createDataFrame([(1, "RS-12 Multimeter Manual: measure voltage"), (2, "do roses need water")], "query_id int, text string")
    rows = {r.query_id: r for r in answering.answer(asked, corpus, settings=QuerySettings(bm25_enabled=True)).collect()}
    assert (rows[1].route_mode, rows[1].route_reason) == ("hard", "explicit_document_match")
    assert "Roses" not in rows[1].context and "measure voltage" in rows[1].context
    assert rows[2].route_mode == "global" and "Roses need sun" in rows[2].context
    assert rows[2].answer and rows[2].context.startswith("【资料1】\n来源：本地知识库\n文档：")


def test_sub_questions_keep_their_evidence(spark, corpus):
    rows = [(1, "everything about devices", ["measure voltage", "do roses need water"], ["voltage dial", "roses water"])]
    asked = spark.createDataFrame(rows, "query_id int, text string, retrieval_queries array<string>, sub_questions array<string>")
    got = answering.answer(asked, corpus, settings=QuerySettings(bm25_enabled=True)).head()
    assert "dial to V" in got.context and "Roses need sun" in got.context


def test_settled_questions_are_not_searched(spark, corpus):
    asked = spark.createDataFrame([(1, "roses", "please name the document"), (2, "roses", None)], "query_id int, text string, answer string")
    rows = {r.query_id: r for r in answering.answer(asked, corpus).collect()}
    assert (rows[1].answer, rows[1].context, rows[1].route_reason) == ("please name the document", None, "answered")
    assert "Roses" in rows[2].context


def test_steps_are_timed_and_errors_named(spark, corpus):
    log = StepLog("t1")
    with pytest.raises(IngestError, match=r"\[chunks\].*no valid rows"):
        try:
            ingest(documents(spark, ("empty", "   ")), corpus, log=log)
        except IngestError as error:
            raise IngestError(error.message, "chunks") from error
    with pytest.raises(IngestError, match=r"\[load\] division"):
        with log.step("load"):
            1 / 0
    with log.step("store"):
        pass
    shown = {r.task_id: r for r in task_progress(step_states(log.table(spark))).collect()}["t1"]
    assert shown.running_list == ["chunks", "load"] and shown.done_list == ["store"]


def test_new_version_replaces_the_old_one(spark, corpus):
    changed = MANUAL.replace("dial to V", "knob to V")
    ingest(documents(spark, ("manual", changed)), corpus, published_at="2024-02-01 00:00:00")
    texts = [r.content for r in corpus.active_chunks().collect()]
    assert any("knob to V" in t for t in texts) and not any("dial to V" in t for t in texts)
    assert sum("Roses" in t for t in texts) == 1
    assert corpus.chunks.read().count() == 6
