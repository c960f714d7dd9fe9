"""Alignment of two tokenizers against the rule, token by token."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from marlstone.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    (1, "the quick brown fox"), (2, None), (3, ""), (3, ""), (None, "no id, naïve café 漢字 😀"), (5, "  two  spaces\n\n and \t tabs "),
    (6, "a ▁ b"), (7, "<s> </s> <unk> <0x41> <|endoftext|> [INST]"), (8, "\0 nul \x0b\x1c\x85\xa0　x"), (9, "x" * 5000 + " " + "word " * 3000),
    (10, "the quick brown fox"), (10, "the quick brown fox jumps"), (11, " "), (12, "don't we're I'LL 12345 1,000.50 $#@!"), (13, "  é ﻿q"),
]


def expected(texts):
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    a_bytes, b_bytes = alignment.byte_level_tokens(open(A, encoding="utf-8").read()), alignment.piece_tokens(b)
    rows, counts = [], Counter()
    for key, text in texts:
        groups, links = [], []
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        whole = (" " + (text or "")).encode()
        if text and b"".join(a_bytes[i] for i in ids_a) == whole == b"".join(b_bytes[i] for i in ids_b):
            i = j = 0
            now_a, now_b, end_a, end_b = [], [], 0, 0
            while i < len(ids_a) or j < len(ids_b):
                if end_a <= end_b:
                    now_a.append(ids_a[i])
                    end_a += len(a_bytes[ids_a[i]])
                    i += 1
                else:
                    now_b.append(ids_b[j])
                    end_b += len(b_bytes[ids_b[j]])
                    j += 1
                if end_a == end_b:
                    groups.append(",".join(map(str, now_a)) + "|" + ",".join(map(str, now_b)))
                    links.append((now_a[-1], now_b[-1]))
                    now_a, now_b = [], []
        else:
            ids_a = ids_b = []
        counts.update(links)
        rows.append((key, len(ids_a), len(ids_b), groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return Counter(
        (k, na, nb, len(g), len(l), sum(counts[p] == best[p[1]] for p in l), sum(counts[p] for p in l), ";".join(g)) for k, na, nb, g, l in rows
    )


def hashed(rows):
    return Counter({(*k[:-1], hashlib.sha256(k[-1].encode()).hexdigest() if k[-1] else ""): n for k, n in rows.items()})


def odd_texts():
    pick = random.Random(7)
    made = ["".join(pick.choice("ab'sté漢1 2  \n\t▁.,<|>\0\x1c\x85 　😀 e e ") for _ in range(pick.randint(0, 60))) for _ in range(400)]
    return list(enumerate(made))


@pytest.mark.parametrize("texts", [TEXTS, odd_texts()], ids=["chosen", "random"])
def test_alignment_equals_the_rule(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    docs = docs.withColumns({c: F.lit("x") for c in ("a", "b", "n", "block", "place", "groups", "pairs", "total")})
    got = Counter(tuple(r) for r in alignment.align_documents(docs, A, B).collect())
    assert got == hashed(expected(texts))


def test_whole_groups_and_empty_table(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = Counter(tuple(r) for r in alignment.align_documents(docs, A, B, whole_groups=True).collect())
    assert got == expected(TEXTS)
    assert alignment.align_documents(docs.filter("1 = 0"), A, B).isEmpty()


def test_query_on_a_whole_table(spark):
    from marlstone.llm.queries import op13_end_alignment

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = Counter(tuple(r) for r in op13_end_alignment(spark, "/root/testdata/sf0.001").collect())
    assert got == hashed(expected([tuple(r) for r in docs]))


@pytest.mark.parametrize("work", [1, 2, 3, 7, 64, 1000])
def test_pieces_of_the_path_find_all_common_ends(work):
    rng = np.random.default_rng(work)
    for sizes in ((0, 0), (0, 5), (5, 0), (40, 60), (300, 20)):
        a, b = (np.sort(rng.choice(400, n, replace=False)) for n in sizes)
        ia, ib = alignment.common_ends(a, b, work)
        want = np.intersect1d(a, b)
        assert a[ia].tolist() == want.tolist() == b[ib].tolist()
        i, j = alignment.split_points(a, b, work)
        assert (i + j == np.arange(work, len(a) + len(b), work)).all()


def test_segments_of_empty_texts():
    parts, offsets = alignment.segments(pa.array(["", "a b", " a", ""]))
    assert parts.to_pylist() == ["a", "b", " a"] and offsets.tolist() == [0, 0, 2, 3, 3]
