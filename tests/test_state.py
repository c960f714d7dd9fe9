"""Claims, versions, stores, streaming, history, identity and metrics."""

import json
import math
import unicodedata

import pytest
from pyspark.sql import functions as F

from marlstone.config import IngestSettings, QuerySettings
from marlstone.errors import ClaimLostError, IngestError
from marlstone.models import describe_images
from marlstone.operators import conflict, evaluate, formulas, history, identity, routing, vectors, versions
from marlstone.sources import files, stores
from marlstone.streaming import claims, progress

NOW = "2024-01-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def uploads(spark, *rows):
    return spark.createDataFrame([(h, t, "f.md", i) for i, (h, t) in enumerate(rows)], "source_hash string, task_id string, file_name string, uploaded_at long")


def test_claims_follow_the_life_of_an_import(spark, tmp_path):
    path = str(tmp_path / "claims")
    first = {r.source_hash: r for r in claims.claim_batch(uploads(spark, ("h1", "t1"), ("h1", "t2"), ("h2", "t3")), path, 0, now()).collect()}
    assert first["h1"].task_id == "t1" and first["h1"].acquired and first["h1"].attempt == 1
    again = claims.claim_batch(uploads(spark, ("h1", "t9")), path, 1, now()).head()
    assert (again.task_id, again.acquired) == ("t1", False)
    results = spark.createDataFrame([("h1", "t1", False, "x" * 3000, None, None), ("h2", "t3", True, None, "doc", "c")], "source_hash string, task_id string, ok boolean, error string, doc_id string, content_hash string")
    claims.finish_batch(results, path, 2)
    state = {r.source_hash: r for r in claims.latest_claims(claims.claim_log(spark, path)).collect()}
    assert (state["h1"].status, len(state["h1"].error)) == ("failed", 2000)
    assert (state["h2"].status, state["h2"].doc_id, state["h2"].lease_until) == ("completed", "doc", None)
    taken = {r.source_hash: r for r in claims.claim_batch(uploads(spark, ("h1", "t5"), ("h2", "t6")), path, 3, now()).collect()}
    assert (taken["h1"].task_id, taken["h1"].attempt, taken["h1"].acquired) == ("t5", 2, True)
    assert (taken["h2"].task_id, taken["h2"].acquired) == ("t3", False)
    with pytest.raises(ClaimLostError):
        claims.finish_batch(results.where("source_hash = 'h1'").withColumn("ok", F.lit(True)), path, 4)


def test_finish_between_two_batches_is_kept(spark, tmp_path):
    path = str(tmp_path / "claims")
    claims.claim_batch(uploads(spark, ("h1", "t1")), path, 0, now()).collect()
    done = spark.createDataFrame([("h1", "t1", True, None, "doc", "c")], "source_hash string, task_id string, ok boolean, error string, doc_id string, content_hash string")
    claims.finish_batch(done, path, 1)
    claims.claim_batch(uploads(spark, ("h2", "t2")), path, 1, now()).collect()
    state = {r.source_hash: r.status for r in claims.latest_claims(claims.claim_log(spark, path)).collect()}
    assert state == {"h1": "completed", "h2": "processing"}
    assert not claims.claim_batch(uploads(spark, ("h1", "t3")), path, 2, now()).head().acquired


def test_column_budget_has_no_ceiling(spark):
    said = spark.createDataFrame([("s", "user", "x" * 30000, 1, 20000)], "session_id string, role string, text string, ts long, b long")
    assert len(history.budgeted_history(said, F.col("b")).head().history) == 20000
    assert len(history.budgeted_history(said.drop("b"), 20000).head().history) == 20000


def test_repeated_batch_gives_the_same_claims(spark, tmp_path):
    path = str(tmp_path / "claims")
    for _ in range(2):
        got = claims.claim_batch(uploads(spark, ("h", "t")), path, 0, now()).head()
        assert (got.task_id, got.attempt, got.acquired) == ("t", 1, True)


def test_expired_lease_can_be_retried(spark):
    rows = [("a", "failed", NOW), ("b", "processing", "2023-12-31 00:00:00"), ("c", "processing", "2024-01-02 00:00:00"), ("d", "completed", NOW)]
    registry = spark.createDataFrame(rows, "task_id string, status string, l string").withColumn("lease_until", F.col("l").cast("timestamp"))
    wanted = spark.createDataFrame([(t,) for t in "abcde"], "task_id string")
    got = {r.task_id: r.outcome for r in versions.retryable(registry, wanted, now()).collect()}
    assert got == {"a": "reclaimed", "b": "reclaimed", "c": "refused:processing", "d": "refused:completed", "e": "missing"}


def test_claim_stream_equals_batch(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "claims")
    uploads(spark, ("h1", "t1"), ("h1", "t2")).coalesce(1).write.parquet(source)
    seen = []
    stream = spark.readStream.schema("source_hash string, task_id string, file_name string, uploaded_at long").parquet(source)
    claims.claim_stream(stream, path, str(tmp_path / "cp"), lambda df, n: seen.extend(df.collect())).awaitTermination()
    uploads(spark, ("h1", "t3"), ("h2", "t4")).coalesce(1).write.mode("append").parquet(source)
    claims.claim_stream(stream, path, str(tmp_path / "cp"), lambda df, n: seen.extend(df.collect())).awaitTermination()
    assert sorted((r.source_hash, r.task_id, r.acquired) for r in seen) == [("h1", "t1", False), ("h1", "t1", True), ("h2", "t4", True)]


def test_progress_stream_equals_batch(spark, tmp_path):
    rows = [(1, "a", "running", 1, None), (1, "a", "done", 2, 1.234), (1, "b", "running", 3, None), (2, "a", "running", 4, None), (1, "a", "running", 5, None)]
    schema = "task_id int, step string, action string, seq int, seconds double"
    source, sink, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        progress.stream_step_states(stream, sink, cp).awaitTermination()
    key = lambda df: sorted(map(str, (r.asDict() for r in df.select("task_id", "step", "running", "first_done", "started", "seconds").collect())))
    batch = progress.step_states(spark.createDataFrame(rows, schema))
    assert key(progress.current_states(spark, sink)) == key(batch)
    shown = {r.task_id: r for r in progress.task_progress(batch).collect()}
    assert (shown[1].running_list, shown[1].done_list, shown[1].total_seconds) == (["b", "a"], ["a"], 1.23)
    percent = spark.range(1).select(
        progress.progress_percent(F.lit(4), F.lit(1), F.lit(9), F.lit("processing")), progress.progress_percent(F.lit(8), F.lit(0), F.lit(8), F.lit("processing")),
        progress.progress_percent(F.lit(8), F.lit(0), F.lit(8), F.lit("completed")),
    ).head()
    assert [round(v, 3) for v in percent] == [50.0, 95.0, 100.0]


def test_versions_switch_in_one_step(spark):
    log = spark.createDataFrame([("l", "v1", "d1", "h1", 1), ("l", "v2", "d2", "h2", 2), ("m", "v3", "d3", "h3", 1)], "logical_document_id string, version_id string, doc_id string, source_hash string, published_at int")
    docs = spark.createDataFrame([("l", "v1"), ("l", "v2"), ("l", "v9"), ("m", "v3")], "logical_document_id string, version_id string").withColumn("version_status", F.lit("")).withColumn("is_active", F.lit(False))
    state = {r.version_id: (r.version_status, r.is_active) for r in versions.version_states(log, docs).collect()}
    assert state == {"v1": ("retired", False), "v2": ("ready", True), "v9": ("building", False), "v3": ("ready", True)}
    before = {r.version_id: r.is_active for r in versions.version_states(log.where("published_at = 1"), docs).collect()}
    assert before == {"v1": True, "v2": False, "v9": False, "v3": True}
    chunks = spark.createDataFrame([("v1", False, 1), ("v1", True, 2), ("v2", False, 3)], "version_id string, is_active boolean, id int")
    assert sorted(r.id for r in versions.drop_inactive(chunks, spark.createDataFrame([("v1",)], "version_id string")).collect()) == [2, 3]


def test_migration_needs_a_choice_between_equal_titles(spark):
    docs = spark.createDataFrame([("d1", "T", "h1", "s" * 30, None), ("d2", "t", "h2", "", None), ("d3", "U", "h3", "", "ver_old")], "doc_id string, canonical_title string, content_hash string, source_hash string, version_id string")
    none = spark.createDataFrame([], "logical_document_id string, doc_id string")
    plan = {r.doc_id: r for r in versions.migration_plan(docs, none).collect()}
    assert plan["d1"].problem == plan["d2"].problem == "several documents share a title"
    assert (plan["d3"].version_id, plan["d3"].is_active, plan["d3"].problem) == ("ver_old", True, None)
    picked = spark.createDataFrame([(plan["d1"].logical_document_id, "d2")], "logical_document_id string, doc_id string")
    chosen = {r.doc_id: r for r in versions.migration_plan(docs, picked).collect()}
    assert (chosen["d1"].version_status, chosen["d2"].version_status, chosen["d1"].version_id) == ("retired", "ready", "ver_" + "s" * 24)
    wrong = picked.withColumn("doc_id", F.lit("d3"))
    assert "selected record" in {r.problem for r in versions.migration_plan(docs, wrong).collect() if r.doc_id == "d1"}.pop()
    stray = spark.createDataFrame([(1, "nobody")], "id int, doc_id string")
    with pytest.raises(Exception, match="unregistered document"):
        versions.migrate_chunks(stray, versions.migration_plan(docs, picked)).collect()


def test_document_signatures_ignore_order_but_count_copies(spark):
    docs = spark.createDataFrame([("l", d) for d in "abcd"], "logical_document_id string, doc_id string")
    rows = [("a", "t", "x"), ("a", "t", "y"), ("b", "t", "y"), ("b", "t", "x"), ("c", "t", "x"), ("c", "t", "y"), ("c", "t", "y"), ("c", "t", "y"), ("d", "tx", "")]
    found = versions.duplicate_groups(docs, spark.createDataFrame(rows, "doc_id string, title string, content string"))
    got = {r.doc_id: (r.chunks, r.chunk_signature) for r in found.collect()}
    assert got["a"] == got["b"] and len({s for _, s in got.values()}) == 3 and got["c"][0] == 4
    assert "collect_list" not in found._jdf.queryExecution().toString()


def test_keyed_table_upserts_and_refuses_repeated_keys(spark, tmp_path):
    store = stores.KeyedTable(spark, str(tmp_path / "t"), "id", replaces=True)
    assert not store.exists()
    store.write(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"))
    assert store.write(spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string")) == 2
    assert sorted(map(tuple, store.read().collect())) == [(1, "a"), (2, "B"), (3, "c")]
    with pytest.raises(IngestError):
        store.write(spark.createDataFrame([(4, "x"), (4, "y")], "id int, v string"))
    assert store.read().count() == 3
    store.add(spark.createDataFrame([(3, "ignored"), (4, "d")], "id int, v string"))
    assert sorted(map(tuple, store.read().collect())) == [(1, "a"), (2, "B"), (3, "c"), (4, "d")]


def test_files_are_hashed_typed_and_rejected(spark, tmp_path):
    (tmp_path / "a b+c.MD").write_bytes("# Ü".encode())
    (tmp_path / "x.exe").write_bytes(b"MZ")
    (tmp_path / "w.docx").write_bytes(b"word")
    found = files.read_uploads(spark, str(tmp_path))
    assert {(r.file_name, r.kind, r.file_title) for r in found.collect()} == {("a b+c.MD", "markdown", "a b+c"), ("x.exe", None, "x"), ("w.docx", "word", "w")}
    assert [r.file_name for r in files.rejected(found).collect()] == ["x.exe"]
    assert files.markdown_documents(found).head().content == "# Ü"
    converted = files.convert(found, lambda name, data: data.decode().upper()).head()
    assert (converted.content, converted.error) == ("WORD", None)
    images = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\n...."),), (bytearray(b"RIFF0000WEBP"),), (bytearray(b"oops"),), (bytearray(b""),)], "b binary")
    assert [r.p for r in images.select(files.image_problem(F.col("b")).alias("p")).collect()] == [None, None, "not a supported image", "image is empty"]


def test_malformed_vectors_fail_and_missing_ones_are_skipped(spark):
    schema = "content string, dense array<double>, sparse map<int,double>"
    ok = spark.createDataFrame([("a", [1.0, 2.0], {1: 1.0}), (" ", [1.0, 2.0], {1: 1.0}), ("b", None, {1: 1.0}), ("c", [1.0, 2.0], {})], schema)
    assert [r.content for r in vectors.valid_rows(ok, 2).collect()] == ["a"]
    for dense, sparse in (([1.0], {1: 1.0}), ([1.0, math.nan], {1: 1.0}), ([1.0, math.inf], {1: 1.0}), ([1.0, 2.0], {-1: 1.0}), ([1.0, 2.0], {1: math.nan})):
        with pytest.raises(Exception, match="vector"):
            vectors.valid_rows(spark.createDataFrame([("x", dense, sparse)], schema), 2).collect()


class Counting:
    def encode(self, texts):
        return [[1.0] for _ in texts], [{1: float(len(t))} for t in texts]


def test_embedding_resume_skips_finished_rows(spark):
    chunks = spark.createDataFrame([(1, "a", "a"), (2, "bb", "bb"), (3, "ccc", "")], "id int, content string, retrieval_text string")
    done = spark.createDataFrame([(1, [9.0], {1: 9.0}), (2, [9.0], {})], "id int, dense array<double>, sparse map<int,double>")
    assert sorted((r.id, r.sparse[1]) for r in vectors.embed_missing(chunks, done, factory=Counting).collect()) == [(2, 2.0), (3, 3.0)]


def test_sessions_follow_their_events(spark):
    rows = [
        ("s", "me", "create", " ", 1), ("s", "me", "touch", "  a  long message about many things ", 2), ("s", "you", "rename", "stolen", 3),
        ("s", "you", "delete", "", 4), ("s", "me", "clear", "", 5), ("r", "me", "create", "", 1), ("r", "me", "rename", "Mine", 2), ("r", "me", "touch", "hi", 3),
        ("g", "me", "create", "", 1), ("g", "me", "delete", "", 2),
    ]
    got = {r.session_id: r for r in history.session_state(spark.createDataFrame(rows, "session_id string, owner_id string, action string, text string, ts int")).collect()}
    assert set(got) == {"s", "r"}
    assert (got["s"].title, got["s"].last_message, got["s"].updated_at) == ("a long message about…", "", 5)
    assert (got["r"].title, got["r"].last_message) == ("Mine", "hi")
    assert [r.session_id for r in history.session_list(history.session_state(spark.createDataFrame(rows, "session_id string, owner_id string, action string, text string, ts int")), "me", 0).collect()] == ["s"]


def test_history_addresses_and_references(spark):
    text = "see http://a.b/c.png, (https://x/y.JPG?z=1) and http://a.b/c.png or http://no/z.txt"
    df = spark.createDataFrame([("s", "user", text, 1), ("s", "tool", "x", 2)], "session_id string, role string, text string, ts int")
    assert history.visible_history(df).head().image_urls == ["http://a.b/c.png", "https://x/y.JPG?z=1"]
    messages = spark.createDataFrame([("s", 1, ["d1"]), ("s", 2, ["d2"]), ("s", 3, [])], "session_id string, ts int, selected_documents array<string>")
    asked = spark.createDataFrame([(1, "s", "它的公式"), (2, "s", "别的问题")], "query_id int, session_id string, text string")
    assert [(r.query_id, r.documents) for r in history.referred_documents(asked, messages).collect()] == [(1, ["d2"])]


class Reader:
    def describe(self, images):
        if b"bad" in images:
            raise RuntimeError("reader is down")
        return ["x" * 9 for _ in images]


def test_images_are_described_and_exchanges_stored(spark):
    df = spark.createDataFrame([(1, bytearray(b"ok")), (2, bytearray(b"bad"))], "id int, image binary")
    got = {r.id: r.description for r in describe_images(df, "image", Reader, fallback="none", limit=4, batch_size=1).collect()}
    assert got == {1: "xxxx", 2: "none"}
    answers = spark.createDataFrame([("s", "q", "a", 1, 2), ("s", "q2", None, 3, 4)], "session_id string, question string, answer string, asked_at int, answered_at int")
    assert [(r.role, r.text) for r in history.exchange_rows(answers).orderBy("ts").collect()] == [("user", "q"), ("assistant", "a"), ("user", "q2")]


def test_identity_needs_support_in_the_text(spark):
    docs = spark.createDataFrame(
        [(1, "RS-12 file", ["RS-12 file", "RS-12 Manual"], "The RS-12 Manual covers voltage", ["RS-12 Manual"], ["rs12"], "RS-12 Manual", "first_heading")],
        "doc_key int, file_title string, title_candidates array<string>, context string, aliases array<string>, model_codes array<string>, canonical_title string, title_source string",
    ).withColumns({"primary_subject": F.col("canonical_title"), "document_type": F.lit("其他"), "summary": F.lit("s"), "evidence": F.array("canonical_title"), "title_confidence": F.lit(0.82), "requires_review": F.lit(False)})
    schema = "canonical_title string, primary_subject string, aliases array<string>, evidence array<string>, document_type string, summary string, confidence double"
    good = {"canonical_title": "rs12 manual", "primary_subject": "unseen", "aliases": ["invented", "RS-12 file"], "evidence": ["covers  voltage"], "confidence": 7}
    for reply, title, source, confidence in ((good, "rs12 manual", "first_heading", 1.0), ({**good, "evidence": ["absent"]}, "RS-12 Manual", "first_heading", 0.82), ({**good, "canonical_title": "Other"}, "RS-12 Manual", "first_heading", 0.82)):
        row = identity.accept_identity(docs.withColumn("reply", F.from_json(F.lit(json.dumps(reply)), schema))).head()
        assert (row.canonical_title, row.title_source, row.title_confidence) == (title, source, confidence)
    row = identity.accept_identity(docs.withColumn("reply", F.from_json(F.lit(json.dumps(good)), schema))).head()
    assert row.aliases == ["rs12 manual", "RS-12 file"] and row.primary_subject == "rs12 manual"


def test_formula_descriptions_reach_every_occurrence(spark):
    from marlstone.operators.chunks import chunk_documents

    md = "# A\nuses $E=mc^2$ here\n# B\nagain $E=mc^2$ and $x$\n# C\nplain"
    chunks = chunk_documents(spark.createDataFrame([(1, "F", md)], "doc_key int, file_title string, content string"))
    work = formulas.work_list(chunks).collect()
    assert [(w.latex, w.section_title) for w in work] == [("E=mc^2", "A")]
    reply = "```json\n" + json.dumps({"formulas": [{"formula_id": work[0].formula_id, "description": " energy ", "variables": [{"symbol": "m", "meaning": "mass", "unit": "kg"}, {"meaning": "?"}], "conditions": ["rest", ""]}]}) + "\n```"
    known = formulas.parse_replies(spark.createDataFrame([(reply,), ("nonsense",)], "reply string"))
    done = formulas.apply_descriptions(chunks, known, ["doc_key", "chunk_index"]).orderBy("chunk_index").collect()
    assert [("含义：energy；变量说明：m表示mass，单位kg；适用条件：rest" in c.formula_search_text) for c in done] == [True, True, False]


def test_route_decisions(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    queries = make([(i,) for i in range(7)], "query_id int")
    referred = make([(0, "d0")], "query_id int, doc_id string")
    named = make([(0, "x", False), (1, "d1", True), (1, "d2", True), (2, "d1", False)], "query_id int, doc_id string, soft boolean")
    mentioned = make([(4, "m"), (5, "m"), (6, "m")], "query_id int, mention string")
    matches = make([(4, "m", "d1", "g1"), (4, "m", "d2", "g2"), (5, "m", "d3", "g3")], "query_id int, mention string, doc_id string, group_key string")
    weak = make([(6, "d9", 1), (6, "d8", 0), (6, "d7", 3), (6, "d6", 4)], "query_id int, doc_id string, pos int")
    decided = routing.decide_route(queries, referred, named, mentioned, matches, weak)
    routes = {r.query_id: (r.mode, r.locked, r.reason) for r in decided.collect()}
    assert [routes[i] for i in range(7)] == [
        ("hard", True, "conversation_document_reference"), ("soft", True, "explicit_document_ambiguous"),
        ("hard", True, "explicit_document_match"), ("global", False, "no_document_mention"),
        ("soft", True, "explicit_document_ambiguous"), ("hard", True, "explicit_document_match"),
        ("global", False, "weak_document_candidate"),
    ]
    documents = routing.route_documents(decided, referred, named, matches, weak).collect()
    assert sorted((r.query_id, r.doc_id) for r in documents) == [
        (0, "d0"), (1, "d1"), (1, "d2"), (2, "d1"), (4, "d1"), (4, "d2"), (5, "d3"), (6, "d7"), (6, "d8"), (6, "d9"),
    ]


def test_code_matches_need_every_code(spark):
    registry = spark.createDataFrame([("d1", "T1", ["rs12", "b5"]), ("d2", "T2", ["rs12"])], "doc_id string, canonical_title string, model_codes array<string>")
    asked = spark.createDataFrame([(1, "RS-12 and B5"), (2, "RS-12"), (3, "none")], "query_id int, text string")
    assert sorted((r.query_id, r.doc_id) for r in routing.code_matches(asked, registry).collect()) == [(1, "d1"), (2, "d1"), (2, "d2")]


def test_promotion_needs_a_confident_winner(spark):
    ranked = spark.createDataFrame([(1, i, {1: 5, 2: 4, 3: 1, 4: 2, 5: 9}[i], i, 1.0 - i / 10) for i in range(1, 6)], "query_id int, chunk_id int, rrf_rank int, model_rank int, rerank_score double")
    selected = ranked.where("model_rank <= 2").withColumn("place", F.col("model_rank")).withColumn("coverage_protected", F.col("chunk_id") == 2).withColumn("conflict_judge_promoted", F.lit(False))
    pairs = conflict.conflict_pairs(selected, ranked)
    assert [(p.candidate_chunk_id, p.victim_chunk_id) for p in pairs.collect()] == [(3, 1)]
    for reply, kept in (('{"decisions":[{"pair_id":"pair_1","winner":"a","confidence":0.85}]}', {3, 2}), ('{"decisions":[{"pair_id":"pair_1","winner":"A","confidence":0.5}]}', {1, 2}), ("broken", {1, 2})):
        decided = conflict.decide(pairs, conflict.parse_decisions(spark.createDataFrame([(1, reply)], "query_id int, reply string")))
        assert {r.chunk_id for r in conflict.promote(selected, ranked, decided).collect()} == kept
        pool = ranked.select("query_id", "chunk_id", F.col("model_rank").alias("pos"))
        assert conflict.sync_pool(conflict.promote(selected, ranked, decided), pool).count() == 5


def test_rank_metrics_on_a_known_case(spark):
    ranked = spark.createDataFrame([(1, 1, "t", "nothing"), (1, 2, "Ｆｕｌｌ Title", "alpha-beta"), (1, 7, "t", "alpha beta")], "case_id int, rank int, title string, content string")
    criteria = spark.createDataFrame(
        [(1, 0, 0, None, ["ALPHA", "beta"]), (1, 1, 0, "full title", None), (1, 2, 0, "absent", None), (1, 2, 1, None, [])],
        "case_id int, criterion int, option int, title_contains string, content_contains_all array<string>",
    )
    hits = evaluate.criterion_hits(ranked, criteria)
    assert sorted((h.rank, h.criterion) for h in hits.collect()) == [(2, 0), (2, 1), (7, 0)]
    cases = spark.createDataFrame([(1,), (2,)], "case_id int")
    rows = {r.case_id: r for r in evaluate.rank_metrics(cases, hits, criteria).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert rows[1].recall_at_k == pytest.approx(2 / 3) and rows[1].mrr_at_k == 0.5 and rows[1].first_relevant_rank == 2
    assert rows[1].ndcg_at_k == pytest.approx((1 / math.log2(3)) / ideal)
    assert rows[2].recall_at_k is None


def test_plain_names_are_compatibility_normalized(spark):
    import re

    values = ["Ｆｕｌｌ ﬁ", "a_b-C 1", "ẞtraße", "①②"]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    assert [r.v for r in df.select(evaluate.plain_name(F.col("t")).alias("v")).collect()] == [re.sub(r"[^\w]+", "", unicodedata.normalize("NFKC", v).casefold()) for v in values]


def test_quotes_and_answers(spark):
    df = spark.createDataFrame([("a b ... c d", "xx ab yy c  d"), ("a … z", "ab"), ("...", "ab")], "q string, c string")
    assert [r.g for r in df.select(evaluate.quote_grounded(F.col("q"), F.col("c")).alias("g")).collect()] == [True, False, False]
    schema = "reference_facts array<struct<covered:boolean>>, contradictions array<string>, answerable boolean, refusal_correct boolean"
    rows = evaluate.reference_scores(spark.createDataFrame([([(True,), (True,), (False,)], ["c"], True, None), ([(False,)], [], False, True)], schema)).collect()
    assert rows[0].correctness == pytest.approx(4 / 6) and rows[0].completeness == pytest.approx(2 / 3) and rows[1].correctness == 1.0
    with pytest.raises(Exception, match="missing or unlabelled"):
        evaluate.reference_scores(spark.createDataFrame([([], [], True, None)], schema)).collect()


def test_annotations_switch_versions(spark):
    df = spark.createDataFrame([("old", "new"), ("old", None)], "query string, query_v2 string")
    assert [(r.query, r.query_v1) for r in evaluate.activate_annotations(df, "v2").collect()] == [("new", "old"), ("old", "old")]
    with pytest.raises(ValueError):
        evaluate.activate_annotations(df, "v3")


def test_settings_read_the_environment():
    got = QuerySettings.from_env({"BM25_ENABLED": "yes", "RRF_K": "10", "SOFT_ROUTE_WEIGHT": ""})
    assert (got.bm25_enabled, got.rrf_k, got.soft_route_weight) == (True, 10, 0.35)
    with pytest.raises(Exception):
        IngestSettings(embedding_dim=0).require("missing")
