"""The physical plans of the operators that matter at scale."""

import re

import pytest

import __spark_entry__ as entry
from marlstone.operators.chunks import chunk_documents
from marlstone.operators.lexical import bm25_top_k, sparse_top_k
from marlstone.plans import search_queries, tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return [line for line in text.splitlines() if re.search(r"\bExchange (hash|range|Single|RoundRobin)", line)]


def scan(spark, name):
    """Searches that score chunks where they are scanned."""
    if name == "bm25_topk":
        return bm25_top_k(tables.chunks(spark, SF), tables.questions(spark, SF))
    if name == "sparse_dot_topk":
        return sparse_top_k(search_queries.chunk_vectors(spark, SF), search_queries.asked_vectors(spark, SF))
    return entry.queries()[name](spark, SF)


@pytest.mark.parametrize("name", ["bm25_topk", "sparse_dot_topk", "dense_topk"])
def test_searches_cut_each_partition_before_one_exchange(spark, name):
    text = plan(scan(spark, name))
    assert len(exchanges(text)) == 1
    above, below = text.split("Exchange hashpartitioning(query_id", 1)
    assert "WindowGroupLimit" in above and "WindowGroupLimit" in below


@pytest.mark.parametrize("name", ["bm25_topk", "sparse_dot_topk"])
def test_stored_postings_are_summed_before_they_move(spark, name):
    """Postings move only as sums of a partition, results as each partition's best; blocks stay."""
    text = plan(entry.queries()[name](spark, SF))
    assert len(exchanges(text)) == 2 and text.count("partial_sum") == 1
    best, sums = text.split("Exchange hashpartitioning(query_id", 1)
    assert "WindowGroupLimit" in best and "WindowGroupLimit" in sums
    assert "PartitionFilters: [" in text and "bucket" in text.split("PartitionFilters: [", 1)[1].split("]")[0]
    assert "docs" not in text.split("ReadSchema: struct<", 1)[1].split(">>")[0]


@pytest.mark.parametrize("name", ["recent_messages", "history_window", "transcript", "round_robin_sample", "schedule"])
def test_limits_reach_below_the_exchange(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "WindowGroupLimit" in text.split("Exchange hashpartitioning(", 1)[1]


def test_chunking_moves_the_text_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id doc_key", "source file_title", "text content")
    assert len(exchanges(plan(chunk_documents(docs)))) == 1


@pytest.mark.parametrize(
    "name", ["neighbor_expand", "expanded_text", "alias_containment", "rank_metrics", "coverage_argmax", "claim_takeover", "version_states"]
)
def test_no_pairwise_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_used_columns(spark):
    text = plan(tables.table(spark, SF, "documents").select("doc_id"))
    assert "ReadSchema: struct<doc_id:bigint>" in text
    text = plan(entry.queries()["claim_dedupe"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_copies_are_combined_before_the_shuffle(spark):
    text = plan(entry.queries()["claim_dedupe"](spark, SF))
    assert text.count("partial_") >= 2 and len(exchanges(text)) == 1
