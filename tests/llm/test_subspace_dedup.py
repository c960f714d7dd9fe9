"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import subspace_dedup as sd

SCHEMA = "vec_id long, embedding array<double>, label int"


def unit(v):
    return np.array(v, float) / np.abs(v).max()


def expected(rows, least=0.98):
    def good(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    usable = [good(v, label) for _, v, label in rows]
    near = [[] for _ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = unit(rows[i][1]), unit(rows[j][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    near[i].append(j)
    out = []
    for i in range(n):
        seen, stack = {i}, [i]
        while stack:
            for j in near[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), component, rows[i][0] == component))
    return out


def same(got, want):
    order = lambda rows: sorted(rows, key=str)
    return order([tuple(r) for r in got]) == order(want)


def clustered(seed, n, dim, noise):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    rows = [(i, (centres[rng.integers(6)] + noise * rng.standard_normal(dim)).tolist(), int(rng.integers(2))) for i in range(n)]
    chain = [(n + i, [float(np.cos(i * 0.19)), float(np.sin(i * 0.19))] + [0.0] * (dim - 2), 0) for i in range(12)]
    return rows + chain


@pytest.mark.parametrize("rule", [sd.Nearness(), sd.Nearness(cell_rows=4), sd.Nearness(cell_rows=16, chunk_rows=7, block=4)], ids=["plain", "cells", "chunks"])
@pytest.mark.parametrize("noise", [0.02, 0.14])
def test_equals_all_pairs(spark, rule, noise):
    rows = clustered(1, 150, 24, noise)
    assert same(sd.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), rule).collect(), expected(rows))


def test_odd_rows(spark):
    v, w = [1.0, 0.5, -0.25], [1.0, 0.5, -0.26]
    rows = [
        (5, v, 1), (5, v, 1), (4, w, 1), (3, v, None), (2, v, 2), (None, v, 1), (None, [0.0, 0.0, 1.0], 1), (1, None, 1), (6, [], 1), (7, [0.0, -0.0, 0.0], 1),
        (8, [1.0, None, 2.0], 1), (9, [1.0, float("nan"), 2.0], 1), (10, [float("inf"), 0.0, 1.0], 1), (11, [x * 1e300 for x in v], 1), (12, [x * 1e-300 for x in v], 1),
        (13, [1.0, 0.5], 1), (14, [-x for x in v], 1), (15, [3.0], 1), (16, [0.001], 1), (17, [-2.0], 1), (18, [2.0, 1.0, -0.5], 1),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    clash = {c: F.lit("x") for c in ("cls", "id", "vec", "n", "least", "copies", "chunk", "block", "dim", "kept")}
    assert same(sd.near_duplicates(frame.withColumns(clash)).collect(), expected(rows))
    assert sd.near_duplicates(frame.filter("1 = 0")).isEmpty()
    assert same(sd.near_duplicates(frame.filter("label is null")).collect(), [(3, 0, 3, True)])


def test_query_on_planted_copies(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/check_h/embeddings.parquet").filter("label = 1 and vec_id < 4000").collect()]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    v = np.array([r[1] for r in rows])
    v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    near = (v @ v.T >= 0.98).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in sd.near_duplicates(frame, sd.Nearness(cell_rows=128, chunk_rows=256)).collect()}
    assert [got[r[0]] for r in rows] == near.tolist() and near.max() > 100


def test_linked_vectors_share_a_block():
    rule = sd.Nearness()
    rng = np.random.default_rng(3)
    for dim in (1, 2, 5, 24, 64, 100):
        x = sd.unit_vectors(rng.standard_normal((300, dim)))
        y = sd.unit_vectors(x + 0.19 * sd.unit_vectors(rng.standard_normal((300, dim))) / 1.02)
        linked = (x * y).sum(axis=1) >= rule.least
        d = (sd.rotated(x, rule) - sd.rotated(y, rule)) ** 2
        parts = np.add.reduceat(d, sd.block_edges(dim, rule)[:-1], axis=1)
        assert linked.any() and (parts[linked] <= sd.budgets(dim, rule)).any(axis=1).all()
