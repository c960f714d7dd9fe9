"""Names, codes and registry search in questions."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions.ids import sha256_hex
from marlstone.operators import registry, routing
from marlstone.plans import answer as answering
from marlstone.plans.ingest import Corpus, ingest

SCHEMA = "doc_id string, canonical_title string, aliases array<string>, model_codes array<string>"


def contained(spark, texts, titles):
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    names = spark.createDataFrame([(f"d{i}", t, [], []) for i, t in enumerate(titles)], SCHEMA)
    return routing.contained_names(queries, routing.registry_names(names))


def test_ten_thousand_names_of_one_beginning(spark):
    titles = [f"user manual {i:05d}" for i in range(10_000)] + ["user manual " + "very long " * 300, "user"]
    names = routing.registry_names(spark.createDataFrame([(f"d{i}", t, [], []) for i, t in enumerate(titles)], SCHEMA))
    heads = routing.headed_names(names.select("name_key").distinct())
    crowd = heads.groupBy("head").count().agg(F.max("count")).first()[0]
    assert crowd <= routing.SHARED_HEAD and heads.count() == 10_002
    asked = ["see User-Manual 00042 and user manual 07777", "the user manual " + "very long " * 300, "user manual 4", "nothing"]
    found = {(r.query_id, r.doc_id) for r in contained(spark, asked, titles).collect()}
    assert found == {(0, "d42"), (0, "d7777"), (1, "d10000")}


def test_contained_names_equal_plain_search(spark):
    pick = random.Random(4)
    titles = ["".join(pick.choices("ab", k=pick.randint(4, 14))) for _ in range(300)]
    texts = ["".join(pick.choices("ab", k=pick.randint(0, 60))) for _ in range(40)]
    got = {}
    for r in contained(spark, texts, titles).collect():
        got.setdefault(r.query_id, set()).add(r.name_key)
    for i, text in enumerate(texts):
        hits = {t for t in titles if len(t) >= 6 and t in text}
        longest = max(map(len, hits), default=0)
        want = {t for t in hits if len(t) == longest or not any(t != o and t in o for o in hits)}
        assert got.get(i, set()) == want


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    store = Corpus(spark, str(tmp_path_factory.mktemp("routes")))
    rows = [
        ("meter", "# Multimeter Handbook\n\nThe RS-12 and B5 measure voltage.\n"), ("garden", "# Rose Garden Almanac\n\nRoses need sun.\n"),
        ("engine", "# Diesel Engine XK-900 Service\n\nChange the oil.\n"),
    ]
    docs = spark.createDataFrame(rows, "file_title string, content string").withColumn("source_hash", sha256_hex(F.col("content")))
    ingest(docs.withColumn("doc_key", F.col("source_hash")), store, published_at="2024-01-01 00:00:00")
    return store


def test_misspelt_titles_are_weak_candidates(spark, corpus):
    asked = spark.createDataFrame(
        [(1, "《Rose Gardn Almanac》 when to water"), (2, "《Rose Garden Almanac》 when"), (3, "how do roses grow"), (4, "what does xk900 need")],
        "query_id int, text string",
    )
    routes, documents = answering.route(asked, corpus)
    found = {r.query_id: (r.mode, r.reason) for r in routes.collect()}
    assert found[1] == ("global", "weak_document_candidate") and found[2] == ("hard", "explicit_document_match")
    assert found[3] == ("global", "no_document_mention") and found[4] == ("hard", "explicit_document_match")
    titles = {r.doc_id: r.canonical_title for r in corpus.active_registry().collect()}
    weak = [titles[r.doc_id] for r in documents.where("query_id = 1").collect()]
    assert "Rose Garden Almanac" in weak and len(weak) <= 3


def test_codes_stand_in_for_names(spark, corpus):
    known = spark.createDataFrame([("d1", "Other title", [], ["rs12", "b5"]), ("d2", "Third", [], ["rs12"])], SCHEMA)
    mentioned = spark.createDataFrame([(1, "RS-12", "RS-12?"), (2, "nope", "nope")], "query_id int, mention string, text string")
    none = spark.createDataFrame([], "query_id int, mention string, doc_id string")
    matches = routing.exact_matches(mentioned, registry.mention_candidates(mentioned, known, none))
    assert {(r.query_id, r.doc_id) for r in matches.collect()} == {(1, "d1"), (1, "d2")}


def test_registry_search_ranks_each_mention(spark, corpus):
    mentioned = spark.createDataFrame([(1, "rose almanac", 0), (1, "diesel service", 1), (2, "rose almanac", 0)], "query_id int, mention string, place int")
    rows = registry.search_registry(mentioned, corpus.active_profiles()).collect()
    titles = {r.doc_id: r.canonical_title for r in corpus.active_registry().collect()}
    first = {(r.query_id, r.mention): titles[r.doc_id] for r in rows if r.pos % 10 == 1}
    assert first == {(1, "rose almanac"): "Rose Garden Almanac", (1, "diesel service"): "Diesel Engine XK-900 Service", (2, "rose almanac"): "Rose Garden Almanac"}


def test_few_places_of_a_text_leave_its_scan(spark, monkeypatch):
    """Only places that some head may begin at become rows, also where a text is cut."""
    monkeypatch.setattr(routing, "PART", 50)
    pick = random.Random(5)
    texts = ["".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=3_000)) for _ in range(20)]
    texts[3] = texts[3][:47] + "magnetometer handbook" + texts[3][47:] + "ünïcode \U0001f600 manual"
    titles = ["Magnetometer Handbook", "Ünïcode \U0001f600 Manual", "nowhere to be found"]
    known = routing.headed_names(spark.createDataFrame([("magnetometerhandbook",), ("nowheretobefound",)], "name_key string"))
    rows = spark.createDataFrame([(i, t.replace(" ", "")) for i, t in enumerate(texts)], "query_id int, key string")
    sizes = sorted({r[0] for r in known.select(F.length("head")).collect()})
    places = rows.mapInArrow(routing._head_places(sizes, routing.head_cells(known)), "query_id int, head string").collect()
    assert "magnetometerhand" in {p.head for p in places if p.query_id == 3} and len(places) < 100
    assert {(r.query_id, r.doc_id) for r in contained(spark, texts, titles).collect()} == {(3, "d0"), (3, "d1")}
