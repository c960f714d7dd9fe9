"""The training-data operators against plain Python, on small tables with nulls, copies and long texts."""

import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from marlstone.llm import brown, mixing, ngram_join, nn_descent, pii, quality, sentencepieces, sketches, text, token_counts, toxicity
from marlstone.session import scratch_dir

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly mix a potion of blue herbs and old wine"
LONG = " ".join(f"word{i % 977} é{i}" for i in range(20_000))
ROWS = [
    (1, BASE, "en", "a"),
    (2, None, "en", "b"),
    (3, "", None, None),
    (4, BASE + " tonight", "en", "a"),
    (4, BASE + " tonight", "en", "a"),
    (None, "no id here, call +1 (555) 555-0100", "de", "b"),
    (6, LONG, "fr", "c"),
    (7, " \t\n ", "en", "c"),
    (8, "  two  spaces <s> ▁ and 漢字 \0 end ", None, "a"),
    (9, BASE.upper(), "en", "b"),
]
# Names that the operators use inside or return, on columns that they must leave alone.
CLASH = ["ids", "size", "cls", "n_tokens", "score", "spans", "key", "cell", "part", "block", "trusted", "row", "target", "index"]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return frame.withColumns({c: F.lit("x") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("1 = 0")


def text_of(row):
    return row[1] or ""


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def by_text(frame, *columns):
    return Counter(tuple(r) for r in frame.select(*columns).collect())


# 5: token counts


def test_token_counts_equal_the_library(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = Counter((r[0], len(text_of(r).encode()), len(model.encode(text_of(r)))) for r in ROWS)
    assert by_text(token_counts.token_counts(docs, MODEL), "doc_id", "n_bytes", "n_tokens") == want


def test_token_counts_of_odd_texts():
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    pick = random.Random(5)
    texts = ["".join(pick.choice("ab  e\n\t▁é<s>\0漢 ") for _ in range(pick.randint(0, 40))) for _ in range(500)]
    parts, offsets = token_counts.segments(pa.array(texts))
    sums = np.concatenate(([0], np.cumsum(token_counts.lengths(model, parts))))
    assert (sums[offsets[1:]] - sums[offsets[:-1]]).tolist() == [len(x) for x in model.encode(texts)]


def test_token_counts_of_nothing(none):
    assert token_counts.over_limit(token_counts.token_counts(none, MODEL), 3).count() == 0


# 1: SentencePiece


def best_score(known, word):
    """The largest sum of scores over all segmentations, by trying every piece at every place."""
    scores = {}

    def walk(node, prefix):
        for c, child in node.items():
            if c == "":
                scores[prefix] = child[1]
            else:
                walk(child, prefix + c)

    if not hasattr(known, "flat"):
        walk(known.trie, "")
        known.flat = scores
    best = [0.0] + [-math.inf] * len(word)
    for end in range(1, len(word) + 1):
        for begin in range(max(0, end - 20), end):
            piece = known.flat.get(word[begin:end], known.cost if end - begin == 1 else None)
            if piece is not None:
                best[end] = max(best[end], best[begin] + piece)
    return best[-1]


def test_viterbi_finds_the_best_segmentation():
    blob = open(MODEL, "rb").read()
    known, model = sentencepieces.Vocabulary(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)
    words = sorted({"▁" + w for w in split(BASE + " theash hestnt unbelievable antidis 12345 aaaaaaaa Straße")})
    ids, ends = known.encode_words(words)
    for word, a, b in zip(words, ends[:-1], ends[1:], strict=True):
        own = ids[a:b].tolist()
        assert "".join(model.id_to_piece(i) for i in own) == word
        assert sum(model.get_score(i) for i in own) == best_score(known, word)


def test_encoding_round_trip(docs):
    coded = sentencepieces.encode(docs, MODEL, ["doc_id", "text"])
    back = sentencepieces.decode(coded, MODEL, ["doc_id", "text", "ids"]).collect()
    assert len(back) == len(ROWS)
    for row in back:
        assert row["decoded"] == (row["text"] or "").replace("▁", " ")
        assert bool(row["ids"]) == bool(row["text"])


def test_encoding_takes_bounded_parts_of_a_batch(spark, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"x": list(range(9))})
    sizes = np.array([0, 5, 6, 30, 0, 1, 2, 8, 9])
    monkeypatch.setattr(text, "PART_BYTES", 10)
    cut = [part.column("x").to_pylist() for part in text.parts(batch, sizes)]
    assert sum(cut, []) == list(range(9))
    assert all(len(rows) == 1 or sizes[rows].sum() <= 10 for rows in cut) and len(cut) == 6
    monkeypatch.undo()
    # More than one part, from inside the batch.
    texts = ["a theash " * 150_000, "", "unbelievable 12345 " * 90_000, None, "Straße " * 90_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    coded = sentencepieces.encode(frame, MODEL, ["doc_id", "text"])
    for row in sentencepieces.decode(coded, MODEL, ["doc_id", "text"]).collect():
        assert row["decoded"] == (row["text"] or "")


def test_encoding_of_nothing(none):
    coded = sentencepieces.encode(none, MODEL, ["doc_id"])
    assert sentencepieces.decode(coded, MODEL, ["doc_id"]).count() == 0


# 6: mixing


def test_mix_equals_filling_up(docs):
    rows = mixing.mix(docs).collect()
    size = lambda r: len(split(text_of(r)))
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += size(r)
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = dict(zip(names, itertools.cycle((5, 2, 1))))
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2 * sizes[s] if full else share[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    taken = Counter()
    for r in rows:
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    assert len(rows) == len(ROWS)
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert by_text(mixing.mix(docs), *rows[0].asDict()) == Counter(tuple(r) for r in rows)


def test_schedule_is_even(spark, docs):
    recipe = mixing.Recipe(block_words=8)
    sources = mixing.source_targets(mixing.sized(docs), recipe)
    slots = mixing.schedule(sources, recipe).orderBy("slot").collect()
    share = {r["index"]: r["slots"] / len(slots) for r in sources.collect()}
    seen = Counter()
    for n, r in enumerate(slots, 1):
        assert r["rank"] == seen[r["index"]]
        seen[r["index"]] += 1
        assert all(abs(seen[s] - n * share[s]) < 6 for s in share)


def test_mixed_texts(docs):
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    words = Counter()
    mixed = mixing.mixed_texts(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        words[r["doc_id"]] += len(split(r["text"]))
    assert +words == +taken


def test_mix_of_nothing(none):
    assert mixing.mix(none).count() == 0 and mixing.mixed_texts(none).count() == 0


# 3: n-gram Jaccard join


def jaccard_components(texts, width, part):
    sets = []
    for t in texts:
        w = split((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= part * len(sets[i] | sets[j]):
            parent[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize(("width", "part"), [(3, 90), (5, 80)])
def test_join_equals_all_pairs(spark, width, part):
    pick = random.Random(width)
    words = [f"w{i}" for i in range(400)]
    passage = [pick.choice(words) for _ in range(60)]
    texts = [None, "", "one", "one", "one two", "ONE two", LONG, LONG + " x"]
    for _ in range(12):
        base = [pick.choice(words) for _ in range(pick.choice((8, 12, 30, 90, 200)))]
        for _ in range(pick.choice((1, 2, 6, 14))):
            copy = list(base)
            for _ in range(pick.randint(0, 3)):
                copy[pick.randrange(len(copy))] = pick.choice(words)
            texts.append(" ".join(copy + (passage if pick.random() < 0.3 else [])))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("cls", F.lit("x"))
    got = {r["doc_id"]: r for r in ngram_join.join_documents(frame, ngram_join.Likeness(width, part, frequent=2)).collect()}
    comps, sizes = jaccard_components(texts, width, part)
    assert [got[i]["component_id"] for i in range(len(texts))] == comps
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes


def test_linked_sets_share_a_signature():
    """Whatever is frequent: sets at the limit of the threshold, with random classes of shingles."""
    rng = np.random.default_rng(3)
    for part, n in itertools.product((80, 90), (5, 6, 7, 9, 11, 20, 37, 80)):
        rule = ngram_join.Likeness(3, part)
        for _ in range(60):
            if _ % 20 == 0:
                levels = rng.integers(1, 30, ngram_join._CELLS, dtype=np.uint8) * (rng.random(ngram_join._CELLS) < rng.random())
            common = rng.integers(1, 2**63, n, dtype=np.uint64)
            a = np.concatenate((common, rng.integers(1, 2**63, rng.integers(0, 1 + n // 4), dtype=np.uint64)))
            b = np.concatenate((common, rng.integers(1, 2**63, rng.integers(0, 1 + n // 4), dtype=np.uint64)))
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if 100 * both >= part * (len(a) + len(b) - both) and len(a) + len(b) > 2 * both:
                assert np.intersect1d(ngram_join.signatures(a, levels, rule), ngram_join.signatures(b, levels, rule)).size


def test_classes_with_many_common_signatures_meet_about_once(spark):
    rng = np.random.default_rng(5)
    held = [set(rng.choice(300, int(rng.integers(1, 200)), replace=False).tolist()) for _ in range(30)] + [{1000}, {1001}, {1001, 7}]
    bits = {f"p{i}": 0 for i in range(8)}
    rows = [{"sign": s, "cls": c, "comp": c % 29, "n": 300, **bits} for c, own in enumerate(held) for s in own]
    kind = "sign long, cls long, comp long, n long, " + ", ".join(f"{b} long" for b in bits)
    met = ngram_join._meetings(spark.createDataFrame(rows, kind), ngram_join.Likeness(3, 90)).select("cls", "o_cls").collect()
    pairs = [(a, b) for a in range(len(held)) for b in range(a + 1, len(held)) if a % 29 != b % 29 and held[a] & held[b]]
    assert {tuple(r) for r in met} == set(pairs)
    assert len(met) < 2 * len(pairs) < sum(len(held[a] & held[b]) for a, b in pairs) / 10


def test_sets_alike_by_chance_share_no_signature():
    rng = np.random.default_rng(4)
    levels, pool = np.zeros(ngram_join._CELLS, np.uint8), np.unique(rng.integers(1, 2**64 - 1, 9_000, dtype=np.uint64))
    sets = [np.sort(rng.choice(pool, 300, replace=False)) for _ in range(200)]
    for part in (85, 90):
        signs = [set(ngram_join.signatures(s, levels, ngram_join.Likeness(3, part)).tolist()) for s in sets]
        assert sum(not a.isdisjoint(b) for a, b in itertools.combinations(signs, 2)) < 1_000
        assert max(len(s) for s in signs) <= 300


def test_passages_of_many_texts_are_no_signatures():
    rng = np.random.default_rng(5)
    common = rng.integers(1, 2**64 - 1, 60, dtype=np.uint64)
    levels = np.zeros(ngram_join._CELLS, np.uint8)
    levels[(common % np.uint64(ngram_join._CELLS)).astype(np.int64)] = 30
    sets = [np.unique(np.concatenate((common, rng.integers(1, 2**64 - 1, 240, dtype=np.uint64)))) for _ in range(200)]
    signs = [set(ngram_join.signatures(s, levels, ngram_join.Likeness(3, 90)).tolist()) for s in sets]
    assert sum(not a.isdisjoint(b) for a, b in itertools.combinations(signs, 2)) < 200


def test_join_of_edge_rows(docs, none):
    rows = ngram_join.join_documents(docs, ngram_join.Likeness(3, 90)).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in rows) == Counter(
        [(1, 1), (2, 2), (3, 3), (4, 1), (4, 1), (None, None), (6, 6), (7, 7), (8, 8), (9, 1)]
    )
    assert ngram_join.join_documents(none).count() == 0
    with pytest.raises(ValueError, match="0.8"):
        ngram_join.join_documents(docs, ngram_join.Likeness(part=70))


# 4: nearest neighbours


def test_search_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16))
    vectors = centres[rng.integers(0, 8, 900)] + 0.4 * rng.normal(size=(900, 16))
    vectors[300:420] = vectors[300]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    bad = [(2000, None), (2001, [0.0] * 16), (2002, [math.nan] * 16), (2003, [None] * 16), (2004, [1.0] * 5), (None, [1.0] * 16), (20, rows[20][1])]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("node", F.lit("x"))
    got = nn_descent.nearest(frame, F.col("id") % 20 == 0, 10).collect()
    found = 0
    for q in range(0, 900, 20):
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and q not in {r["vec_id"] for r in own}
        score = vectors @ vectors[q]
        assert all(r["score"] == pytest.approx(score[r["vec_id"]], abs=1e-9) for r in own)
        order = [i for i in np.lexsort((np.arange(900), -np.round(score, 9))) if i != q][:10]
        found += len({r["vec_id"] for r in own} & set(order))
    assert found >= 0.9 * 10 * 45


def test_search_in_small_and_empty_tables(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (20, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = nn_descent.nearest(frame, F.col("id") % 20 == 0, 20).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 20, 1.0), (0, 2, 1, 0.0), (20, 1, 0, 1.0), (20, 2, 1, 0.0)]
    assert nn_descent.nearest(frame.filter("1 = 0"), F.col("id") % 20 == 0, 20).count() == 0


def recall(spark, vectors, k, rule=None):
    """Of the k best scores of every 20th row, the part that the search finds."""
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in nn_descent.nearest(frame, F.col("id") % 20 == 0, k, rule=rule).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    found = [len(got[q] & set([i for i in np.argsort(-(vectors @ vectors[q])) if i != q][:k])) for q in range(0, len(vectors), 20)]
    return sum(found) / k / len(found)


def test_search_without_clusters(spark):
    vectors = np.random.default_rng(3).normal(size=(4000, 64))
    assert recall(spark, vectors / np.linalg.norm(vectors, axis=1)[:, None], 20) >= 0.98


def test_search_in_blocks_that_hold_few_vectors(spark):
    """More vectors than a task may hold; and tables that a later round replaces don't stay on disk."""
    vectors = np.random.default_rng(5).normal(size=(1500, 32))
    before = set(os.listdir(scratch_dir(spark)))
    assert recall(spark, vectors / np.linalg.norm(vectors, axis=1)[:, None], 20, nn_descent.Search(held=1400, block=400, cell=200)) >= 0.98
    left = Counter(name.split("-")[1] for name in set(os.listdir(scratch_dir(spark))) - before if name.startswith("nn-"))
    assert left["graph"] == left["members"] == left["beam"] == 1


def test_search_with_a_few_long_vectors(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(1200, 16))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors[[7, 500, 901]] *= [[1e4], [2e4], [1e5]]
    vectors[1000:1100] *= 30
    assert recall(spark, vectors, 20) >= 0.98


# 8: fingerprints


def test_edit_likeness(docs, spark):
    rows = [(i, f"{BASE} {i} " * (1 + i % 4)) for i in range(40)] + [(50, None), (51, "ab"), (52, LONG), (None, "x" * 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("x")).repartition(5)
    got = {r["doc_id"]: r for r in sketches.edit_likeness(frame).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    rule = sketches.Sketch()
    assert len(got) == len(rows)
    for (i, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        text, following = text or "", following or ""
        gone = len(text) // 3
        edited = text[: len(text) - gone] + following[:gone]
        a, b, c = sketches.sketch_texts([text, edited, following], rule)
        row = got[i]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == sketches.to_text(a) and row["edited_fingerprint"] == sketches.to_text(b)
        assert row["near_edited"] == sketches.likeness(a, b, rule) and row["near_next"] == sketches.likeness(a, c, rule)
    assert sketches.edit_likeness(docs).count() == len(ROWS)
    plain = {r["doc_id"]: r["fingerprint"] for r in sketches.fingerprints(frame).collect()}
    assert plain == {i: r["fingerprint"] for i, r in got.items()}


def test_sketches_merge_and_estimate():
    rule = sketches.Sketch()
    rng = random.Random(2)
    one, two = ("".join(rng.choice("abcdefgh ") for _ in range(40_000)) for _ in range(2))
    a, b, ab = sketches.sketch_texts([one, two, one + two[: -rule.shingle]], rule)
    assert sketches.likeness(a, ab, rule) > 0.97
    assert sketches.likeness(a, b, rule) == 0
    part = sketches.sketch_texts([one[:4000]], rule)[0]
    assert sketches.likeness(part, a, rule) > 0.9
    merged = sketches.merge(a, b, rule)
    assert set(merged) == set(a) | set(b)
    assert (sketches.from_text(sketches.to_text(merged)) == merged).all()


def test_edit_likeness_of_one_and_none(spark, none):
    one = spark.createDataFrame([(None, "abcdef")], "doc_id long, text string")
    row = sketches.edit_likeness(one).collect()[0]
    assert row["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and row["near_next"] == 1.0
    assert sketches.edit_likeness(none).count() == 0


# 9: personal data


def test_base_spans_equal_the_patterns():
    pick = random.Random(4)
    for _ in range(5000):
        text = "".join(pick.choice("ab1.@+- ()9_%57") for _ in range(pick.randint(0, 60)))
        own = ",".join(f"{k}:{a}:{b}" for k, a, b in pii.base_spans(text))
        assert hashlib.sha256(own.encode()).hexdigest() == pii.brute_digest(text), text


def test_checks_and_context():
    kinds = lambda t: [(k, t[a:b]) for k, a, b, _ in pii.spans(t)]
    assert kinds("pay GB82 WEST 1234 5698 7654 32 now") == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert kinds("pay GB82 WEST 1234 5698 7654 33 now") == []
    assert kinds("call 555-123-4567 today") == [("phone", "555-123-4567")]
    assert kinds("order 555-123-4567 today") == []
    assert kinds("his ssn is 123-45-6789.") == [("ssn", "123-45-6789")]
    assert kinds("part 123-45-6789 fits") == []
    assert kinds("card 4111 1111 1111 1111") == [("card", "4111 1111 1111 1111")]
    assert kinds("card 4111 1111 1111 1112") == []
    assert pii.redacted("a b@c.de +1 555 123 4567", pii.spans("a b@c.de +1 555 123 4567")) == "a <EMAIL> <PHONE>"


def test_long_runs_are_linear():
    assert pii.base_spans("a" * 300_000 + "@" + "1." * 100_000 + "+" * 100_000) != []


def test_proposals_keep_clear_of_all_spans_before_them():
    pick = random.Random(5)
    parts = ["GB82 WEST 1234 5698 7654 32", "555-123-4567", "tel 555 123 4567", "ssn 123-45-6789", "4111 1111 1111 1111", "a@b.de", "+1 (555) 555-0100", "1.2.3.4", " ", ", "]
    for _ in range(1000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(1, 12)))
        found = pii.spans(text)
        base = pii.base_spans(text)
        assert set(base) <= {s[:3] for s in found}
        added = [s for s in found if s[:3] not in base]
        assert not any(a < y and x < b for _, a, b, _ in added for _, x, y in base)
        assert not any(s is not t and s[1] < t[2] and t[1] < s[2] for s in added for t in added)


def test_many_spans_are_linear():
    def seconds(n):
        text = "call +1 555 123 4567 or 555-123-4567, ssn 123-45-6789\n" * n
        start = time.perf_counter()
        assert len(pii.spans(text)) == 3 * n
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(16_000) < 12 * seconds(4_000)


def test_personal_data_of_rows(docs, none):
    rows = pii.find_personal_data(docs).collect()
    assert len(rows) == len(ROWS)
    assert {r["redacted"] for r in rows if r["doc_id"] is None} == {"no id here, call <PHONE>"}
    assert {r["redacted"] for r in rows if r["doc_id"] == 2} == {None}
    assert pii.digest(pii.find_personal_data(docs)).filter("n_phone = 1").count() == 1
    assert pii.redact(docs).columns == docs.columns and pii.redact(none).count() == 0
    assert pii.digest(pii.find_personal_data(none)).count() == 0


# 7: Brown classes


def test_base_scores_and_better_model(spark):
    pick = random.Random(6)
    nouns, verbs, ends = (["n%d" % i for i in range(30)], ["v%d" % i for i in range(30)], ["e%d" % i for i in range(30)])
    texts = [" ".join(pick.choice(x) for _ in range(20) for x in (nouns, verbs, ends)) for _ in range(300)]
    rows = list(enumerate(texts)) + [(400, None), (401, ""), (402, "Unseen words"), (None, "n1 v1"), (5, texts[5])]
    rows.append((next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0), LONG))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("x")).repartition(3)
    got = brown.score_documents(frame, brown.Classes(head=64, tails=16, classes=8)).collect()
    low = [(i, split((t or "").translate(LOWER)) + ["\0"]) for i, t in rows]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    count = Counter(w for i, t in low if not held(i) for w in t)
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t in low:
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        want[(i, held(i), len(t), sum(count[w] > 0 for w in t), n, round(base, 4))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    unseen = [r for r in got if r["held_out"] and r["n_tokens"] > 10 and r["doc_id"] < 300]
    assert unseen and sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen) + 15 * len(unseen)
    assert all(r["score"] <= 0 for r in got)


def test_class_model_is_a_distribution(docs):
    rule = brown.Classes(head=32, tails=8, classes=6)
    blocks = brown.text_blocks(docs, rule)
    counts = brown.word_counts(blocks)
    model = brown.train(blocks, counts, rule)
    assert np.allclose((10**model.transition).sum(1), 1)
    mass = 10**model.unknown * (model.total > 0)
    for r in counts.filter("word is not null and n > 0").collect():
        c = model.unit_class[brown.units(pa.array([r["word"]]), model.head, rule)[0]]
        mass[c] += (r["n"] - model.discount[c]) / model.total[c]
    assert np.allclose(mass[model.total > 0], 1)


def test_model_of_nothing(none):
    assert brown.score_documents(none, brown.Classes(head=32, tails=8, classes=6)).count() == 0


# 2: quality


def kneser_ney(texts, trusted, order):
    """log P of every n-gram's last character by the textbook recursion, over dictionaries."""
    marked = lambda t: "\x02" * (order - 1) + t + "\x03"
    grams = lambda t: [marked(t)[i : i + order] for i in range(len(t) + 1)]
    count = {order: Counter(g for t, k in zip(texts, trusted, strict=True) if k for g in grams(t))}
    for k in range(order - 1, 0, -1):
        count[k] = Counter(g[1:] for g in count[k + 1])
    cuts = {}
    for k, c in count.items():
        of = Counter(c.values())
        n1, n2, n3, n4 = (max(1, of[m]) for m in (1, 2, 3, 4))
        more = sum(v for m, v in of.items() if m >= 5)
        del more
        y = n1 / (n1 + 2 * n2)
        d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        cuts[k] = [min(max(x, 0.1), m - 0.05) for m, x in enumerate(d, 1)]
    total, freed = Counter(), Counter()
    for k, c in count.items():
        for g, n in c.items():
            total[k, g[:-1]] += n
            freed[k, g[:-1]] += cuts[k][min(n, 3) - 1]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (len(count[1]) + 1)
        if (k, g[:-1]) not in total:
            return p(g[1:])
        n = count[k][g]
        return (n - cuts[k][min(n, 3) - 1] if n else 0) / total[k, g[:-1]] + freed[k, g[:-1]] / total[k, g[:-1]] * p(g[1:])

    return [math.exp(-sum(math.log(p(g)) for g in grams(t)) / (len(t) + 1)) for t in texts]


@pytest.mark.parametrize("shard", [2_000_000, 150])
def test_perplexity_equals_the_recursion(spark, shard):
    pick = random.Random(8)
    texts = ["".join(pick.choice("abc de") for _ in range(pick.randint(0, 60))) for _ in range(60)] + ["", "漢字 abc", "abc" * 300]
    trusted = [i % 2 == 0 for i in range(len(texts))]
    rule = quality.Rule(order=4, shard=shard)
    frame = spark.createDataFrame(list(zip(range(len(texts)), texts, trusted, strict=True)), "doc_id long, text string, trusted boolean").repartition(3)
    got = quality.perplexities(frame, quality.gram_probabilities(quality.gram_counts(frame, rule), rule), rule)
    got = {r["doc_id"]: r["perplexity"] for r in got.collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(kneser_ney(texts, trusted, 4), rel=1e-4)


def test_probabilities_of_a_context_add_up(spark):
    rule = quality.Rule(order=3)
    texts = ["abab", "abba", "baab"]
    alphabet = ["a", "b", "\x03"]
    # Every n-gram after one context, as counts of zero where it wasn't seen.
    frame = spark.createDataFrame([(t, True) for t in texts], "text string, trusted boolean")
    counts = quality.gram_counts(frame, rule)
    more = spark.createDataFrame([("ab" + c, 0) for c in [*alphabet, "z"]], "gram string, n long")
    every = counts.union(more).groupBy("gram").agg(F.sum("n").alias("n"))
    got = quality.gram_probabilities(every, rule).filter("gram like 'ab%'").collect()
    # The mark before a text counts as a character of the alphabet only if it follows something.
    assert sum(math.exp(r["logp"]) for r in got) == pytest.approx(1, abs=0.15)


def test_junk_goes_and_clean_text_stays(spark):
    pick = random.Random(9)
    words = split(BASE)
    good = [(i, " ".join(pick.choice(words) for _ in range(60)), "en" if i % 3 else None) for i in range(300)]
    junk = [(1000 + i, "".join(pick.choice("#&%$|!@*") for _ in range(200)), "en") for i in range(20)]
    frame = spark.createDataFrame(good + junk + [(2000, None, "en"), (2001, "", None), (None, good[0][1], "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i,) for i in range(0, 300, 2)] + [(None,), (5000,), (2,)], "doc_id long")
    got = {r["doc_id"]: r for r in quality.classify(frame.withColumn("row", F.lit("x")), labels).collect()}
    assert len(got) == len(good) + len(junk) + 3
    assert not any(got[1000 + i]["keep"] for i in range(20))
    assert sum(got[i]["keep"] for i in range(300)) >= 295


def test_quality_without_trust_or_rows(docs, none, spark):
    nobody = spark.createDataFrame([], "doc_id long")
    rows = quality.classify(docs, nobody).collect()
    assert len(rows) == len(ROWS) and all(r["keep"] and r["max_perplexity"] is None for r in rows)
    assert quality.classify(none, nobody).count() == 0


# 10: toxicity


def test_toxicity_learns_stems(spark):
    pick = random.Random(10)
    words = [f"{a}{b}" for a in ("ba", "de", "fi", "go", "hu", "ka") for b in ("len", "mar", "nis", "pot", "qui", "ros")]
    stems = ("grumf", "vexil")
    rows, labels = [], []
    for i in range(900):
        text = [pick.choice(words) for _ in range(pick.randint(20, 60))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                text.insert(pick.randrange(len(text)), pick.choice(stems) + pick.choice(("", "s", "ing", "!!", pick.choice(words))))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    labels += [(None, 1), (3, None), (5000, 1)]
    frame = spark.createDataFrame(rows + [(1000, None), (1001, ""), (None, LONG), (7, rows[7][1])], "doc_id long, text string").withColumn("label", F.lit("x"))
    marks = spark.createDataFrame(labels, "doc_id long, label int")
    model = toxicity.train(frame, marks.filter(toxicity.fold() != 0), toxicity.Training(rounds=80))
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(frame, model).collect()]
    assert len(got) == len(rows) + 4 and all(0 <= s <= 1 for _, s in got)
    held = [(s >= 0.5) == (i % 4 == 0) for i, s in got if i is not None and i < 900 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(held) >= 0.9 * len(held)
    unseen = toxicity.score_texts(model, pa.array(["balen demar grumfzz vexilzz grumfyy finis", "balen demar finis gopot huqui karos"]))
    assert unseen[0] > 0.5 > unseen[1]


def test_toxicity_without_labels_or_rows(docs, none, spark):
    nobody = spark.createDataFrame([], "doc_id long, label int")
    model = toxicity.train(docs, nobody)
    assert all(r["score"] == pytest.approx(1 / 3) for r in toxicity.score(docs, model).collect())
    assert toxicity.score(none, model).count() == 0
