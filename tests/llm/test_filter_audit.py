"""The filter audit against plain counting, one document after the other."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import filter_audit

GOOD = " ".join(f"word{i}" for i in range(120))
ROWS = [
    (1, GOOD, "en"), (2, GOOD, "en"), (3, GOOD, "de"), (3, GOOD, "de"), (4, None, "en"), (5, "", None), (6, "A B C", ""),
    (None, GOOD, "en"), (None, GOOD, "en"), (None, None, None), (7, "x " * 30_000, "fr"), (8, GOOD + " $", "fr"), (9, GOOD.upper(), "en"),
    (10, "one\ttwo \x0b\x0c\r\n three  four", "de"), (10, "another text of the same id", "de"), (11, GOOD.replace(" ", "\t"), "en"), (0, GOOD + " $", "en"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 1), (7, 0, 1), (7, 1, 0), (4, 1, None), (None, 1, 1), (99, 1, 1), (9, None, 1)]


def plain(rows, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    parts, fails = {}, []
    for i, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        earlier = any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in rows)
        found = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text), "E": earlier,
        }
        fails.append((lang or "", {k for k, v in found.items() if v}, i in good, i in toxic))
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        out, sums = {}, Counter()
        for order in itertools.permutations("ABCDE"):
            for step, now in enumerate(order):
                here = [f for f in mine if not f[1] & set(order[:step])]
                gone = [f for f in here if now in f[1]]
                failing = sum(now in f[1] for f in mine)
                sums[now] += len(gone)
                out["".join(order), step + 1] = [
                    len(here) - len(gone), len(gone), failing - len(gone), sum(f[1] == {now} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)
                ]
        parts.update({(part, o, s): (*v, sums[o[s - 1]]) for (o, s), v in out.items()})
    return parts


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    clash = {c: F.lit("x") for c in ("part", "mask", "key", "copy", "id", "n", "good", "toxic", "step", "head", "least")}
    return docs.withColumns(clash), labels.withColumns({c: F.lit("y") for c in ("key", "good", "part")})


def test_audit_equals_plain_counting(tables):
    got = filter_audit.audit(*tables).collect()
    assert {(r[0], r[1], r[2]): tuple(r[3:]) for r in got} == plain(ROWS, LABELS)
    assert len(got) == 600 * 4


def test_audit_of_empty_tables(spark, tables):
    docs, labels = tables
    assert filter_audit.audit(docs.filter("1 = 0"), labels).isEmpty()
    got = filter_audit.audit(docs, labels.filter("1 = 0")).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.sum("removed")).first()
    assert (got[0], got[1]) == (0, 0) and got[2] > 0


def test_contractions_of_three_filters():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, (2, 8, 3))
    out = filter_audit.orders_of(counts)
    steps = [(o, s) for o in itertools.permutations(range(3)) for s in range(3)]
    for p in range(2):
        for k, (order, step) in enumerate(steps):
            now, before = order[step], sum(1 << i for i in order[:step])
            gone = [m for m in range(8) if not m & before and m >> now & 1]
            assert out["removed"][p, k] == counts[p, gone, 0].sum()
            assert out["toxic_lost"][p, k] == counts[p, gone, 2].sum()
            assert out["unique_fails"][p, k] == counts[p, 1 << now, 0]
