"""Searches, scopes and fusion against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.config import QuerySettings
from marlstone.functions.terms import tokenize
from marlstone.operators import fusion, scope, scoring
from marlstone.operators.dense import dense_top_k
from marlstone.operators.lexical import bm25_top_k, sparse_top_k, term_index

RNG = random.Random(3)
WORDS = [f"w{i}" for i in range(30)]
TEXTS = {i: " ".join(RNG.choices(WORDS, k=RNG.randint(0, 40))) for i in range(120)}
QUERIES = {i: " ".join(RNG.choices(WORDS, k=4)) for i in range(7)}


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i, f"d{i % 5}", t) for i, t in TEXTS.items()]
    return spark.createDataFrame(rows, "chunk_id long, doc_id string, content string").repartition(5)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(list(QUERIES.items()), "query_id long, text string")


def brute_bm25(k, allowed=None):
    lengths = {i: len(tokenize(t)) for i, t in TEXTS.items()}
    average = sum(lengths.values()) / len(lengths)
    df = Counter(w for t in TEXTS.values() for w in set(tokenize(t)))
    out = {}
    for q, text in QUERIES.items():
        scores = defaultdict(float)
        for i, t in TEXTS.items():
            if allowed is not None and f"d{i % 5}" not in allowed.get(q, ()):
                continue
            tf = Counter(tokenize(t))
            for w in set(tokenize(text)):
                if tf[w]:
                    idf = math.log(1 + (len(TEXTS) - df[w] + 0.5) / (df[w] + 0.5))
                    scores[i] += idf * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * lengths[i] / average))
        out[q] = sorted(((-round(s, 6), i) for i, s in scores.items()))[:k]
    return out


def collected(hits):
    out = defaultdict(list)
    for r in hits.orderBy("query_id", "rank").collect():
        out[r.query_id].append((-r.score, r.chunk_id))
    return dict(out)


def test_bm25_equals_brute_force(chunks, asked):
    assert collected(bm25_top_k(chunks, asked, 9)) == brute_bm25(9)


def test_query_blocks_give_the_same_result(chunks, asked, monkeypatch):
    whole = scoring.per_query_block.__defaults__
    monkeypatch.setattr(scoring.per_query_block, "__defaults__", (3,))
    assert collected(bm25_top_k(chunks, asked, 9)) == brute_bm25(9)
    monkeypatch.setattr(scoring.per_query_block, "__defaults__", whole)


def test_scoped_bm25_keeps_global_statistics(spark, chunks, asked):
    allowed = {0: {"d1"}, 1: {"d2", "d3"}}
    rows = spark.createDataFrame([(q, d) for q, ds in allowed.items() for d in ds], "query_id long, doc_id string")
    got = collected(bm25_top_k(None, asked, 50, index=term_index(chunks), scope=rows))
    assert got == {q: v for q, v in brute_bm25(50, allowed).items() if v}


def test_han_text_becomes_characters_and_bigrams():
    assert tokenize("RS12万用表，ok") == ["rs12", "万", "用", "表", "万用", "用表", "ok"]


def test_dense_and_sparse_equal_numpy(spark):
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(200, 8)), rng.normal(size=(4, 8))
    x[7] = 0
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, dense array<double>").repartition(3)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, dense array<double>")
    norm = np.linalg.norm(x, axis=1)
    scores = np.round((q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.where(norm > 0, norm, 1), 6)
    expected = {i: sorted((-s, j) for j, s in enumerate(scores[i]))[:6] for i in range(4)}
    assert collected(dense_top_k(vectors, asked, 6)) == expected
    sparse = [{int(t): float(w) for t, w in zip(rng.choice(20, 5, replace=False), rng.normal(size=5))} for _ in range(60)]
    stored = spark.createDataFrame(list(enumerate(sparse[:50])), "chunk_id long, sparse map<int,double>")
    wanted = spark.createDataFrame(list(enumerate(sparse[50:])), "query_id long, sparse map<int,double>")
    expected = {}
    for i, s in enumerate(sparse[50:]):
        dots = [(-round(sum(w * c[t] for t, w in s.items() if t in c), 6), j) for j, c in enumerate(sparse[:50]) if set(s) & set(c)]
        expected[i] = sorted(dots)[:6]
    assert collected(sparse_top_k(stored, wanted, 6)) == {k: v for k, v in expected.items() if v}


def test_a_text_and_its_many_copies_all_rank(spark):
    copies = spark.createDataFrame([(i, "same words here") for i in range(60)] + [(99, "other")], "chunk_id long, content string")
    asked = spark.createDataFrame([(1, "words")], "query_id long, text string")
    assert [r.chunk_id for r in bm25_top_k(copies, asked, 100).orderBy("rank").collect()] == list(range(60))


def test_locked_scope_never_falls_back(spark, chunks, asked):
    scoped = spark.createDataFrame([(0, "none"), (1, "none"), (2, " d1 ")], "query_id long, doc_id string")
    search = lambda q, s: bm25_top_k(None, q, 5, index=term_index(chunks), scope=s)
    hits = scope.search_hard(asked, scoped, search, F.col("query_id") == 0).collect()
    assert {h.query_id for h in hits} == {1, 2}
    assert all(h.route_fallback == (h.query_id == 1) for h in hits)


# ------------------------------------------------------------------ fusion


def brute_merge(lists, limit, per_list):
    scores, first = defaultdict(float), {}
    for order, ids in enumerate(lists):
        for rank, i in enumerate(ids, 1):
            scores[i] += 1.0 / (60 + rank)
            first.setdefault(i, (order, rank))
    ranked = sorted(scores, key=lambda i: (-round(scores[i], 12), first[i], i))
    kept, held = ranked[:limit], []
    for ids in lists:
        held += [i for i in ids if i not in held][:per_list]
    for i in held:
        if i not in kept:
            free = [j for j in kept if j not in held]
            if not free:
                break
            kept[kept.index(free[-1])] = i
    return sorted(kept, key=lambda i: (-round(scores[i], 12), first[i], i))


def test_every_list_keeps_an_entry_of_its_own(spark):
    rng = random.Random(1)
    cases = {q: [rng.sample(range(30), rng.randint(1, 8)) for _ in range(rng.randint(1, 6))] for q in range(40)}
    rows = [(q, f"query_{o}", o, 1.0, i, r) for q, ls in cases.items() for o, ids in enumerate(ls) for r, i in enumerate(ids, 1)]
    hits = spark.createDataFrame(rows, "query_id int, list_name string, list_order int, weight double, chunk_id int, rank int")
    for limit, per_list in ((5, 1), (3, 2), (0, 0)):
        got = defaultdict(list)
        for r in fusion.merge_lists(hits, limit, min_per_list=per_list).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.chunk_id)
        for q, lists in cases.items():
            assert got[q] == brute_merge(lists, limit or 10**6, per_list), (lists, limit, per_list)


def test_fusion_stays_inside_a_subquestion_and_shared_chunk_wins(spark):
    rows = [(1, 0, "direct_hybrid", 10, 1), (1, 0, "direct_hybrid", 11, 2), (1, 0, "bm25", 11, 1), (1, 1, "direct_hybrid", 12, 1)]
    hits = spark.createDataFrame(rows, "query_id int, sub_q int, branch string, chunk_id int, rank int")
    fused = fusion.fuse_branches(hits, by=("query_id", "sub_q")).orderBy("sub_q", "rrf_rank").collect()
    assert [(r.sub_q, r.chunk_id, r.rrf_rank) for r in fused] == [(0, 11, 1), (0, 10, 2), (1, 12, 1)]
    assert fused[0].retrieval_sources == ["bm25", "direct_hybrid"]


def test_variant_names_sort_by_number_and_payload_is_filled(spark):
    ranks = {"query_10": 2, "query_2": 1, "global": 1}
    rows = [(1, "direct_hybrid", 5, 1, ranks, ""), (1, "bm25", 5, 1, {"query_2": 4}, "title")]
    hits = spark.createDataFrame(rows, "query_id int, branch string, chunk_id int, rank int, branch_ranks map<string,int>, title string")
    row = fusion.fuse_branches(hits, payload=("title",)).head()
    assert row.retrieval_query_names_hit == ["query_2", "query_10"]
    assert row.subquery_ranks == {"query_2": {"direct_hybrid": 1, "bm25": 4}, "query_10": {"direct_hybrid": 2}}
    assert row.title == "title"


def test_cliff_equals_model(spark):
    rng = random.Random(2)
    cases = {}
    for q in range(200):
        scores = sorted((round(rng.random(), 2) for _ in range(rng.randint(1, 8))), reverse=True)
        cases[q] = [None if rng.random() < 0.03 else s for s in scores]
    rows = [(q, i + 1, s) for q, ss in cases.items() for i, s in enumerate(ss)]
    df = spark.createDataFrame(rows, "query_id int, rank int, score double")
    kept = Counter(r.query_id for r in fusion.truncate_at_cliff(df).collect())
    for q, ss in cases.items():
        top = min(5, len(ss))
        cut = top
        if all(s is not None for s in ss[:top]):
            gaps = [(ss[i - 1] - ss[i], i) for i in range(min(3, top), top) if ss[i - 1] - ss[i] > 0.08]
            if gaps:
                cut = min(i for g, i in gaps if g == max(g for g, _ in gaps))
        assert kept[q] == cut, ss


def test_exclusive_branch_protection(spark):
    rows = [(1, "direct_hybrid", i, i) for i in range(1, 13)] + [(1, "bm25", i, i) for i in range(1, 6)] + [(1, "hyde", 100 + i, i) for i in range(1, 4)]
    rows += [(1, "bm25", 200, 6)]
    hits = spark.createDataFrame(rows, "query_id int, branch string, chunk_id int, rank int")
    base = QuerySettings(rrf_max_results=6)
    plain = [r.chunk_id for r in fusion.fuse_branches(hits, base).orderBy("rrf_rank").collect()]
    held = [r.chunk_id for r in fusion.fuse_branches(hits, QuerySettings(rrf_max_results=6, rrf_min_exclusive_per_branch=1)).orderBy("rrf_rank").collect()]
    assert len(held) == len(plain) == 6
    assert {101, 200, 6} <= set(held)
