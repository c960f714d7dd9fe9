"""Near-duplicate vectors: a range join in each low-dimensional block of rotated vectors, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.ngram_join import components
from marlstone.session import materialize

# Pairs that are verified at once.
_SLICE = 1 << 15


@dataclass(frozen=True)
class Nearness:
    """Vectors of one group link at a cosine of ``least`` or more. The rest decides only the cost."""

    least: float = 0.98
    block: int = 8  # dimensions of a block of the rotated vectors
    cell_rows: int = 1_024  # a block is halved along more of its dimensions until cells hold about so many rows
    chunk_rows: int = 2_048  # cells with more rows are cut into chunks that meet pair by pair
    sample: int = 2_048  # classes whose medians are the places of the halvings
    seed: int = 12

    def distance(self) -> float:
        """The largest squared distance of unit vectors that link, with room for rounding."""
        return 2 * (1 - self.least) + 1e-9


@lru_cache(maxsize=8)
def rotation(dimension: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def block_edges(dimension: int, rule: Nearness) -> np.ndarray:
    """Where blocks of about ``rule.block`` dimensions begin and end."""
    return np.linspace(0, dimension, max(1, round(dimension / rule.block)) + 1).astype(np.int64)


def budgets(dimension: int, rule: Nearness) -> np.ndarray:
    """Each block's part of the squared distance, proportional to its dimensions.

    If two vectors link, their squared distances in the blocks add up to at most ``distance``, so in
    at least one block theirs is within its budget.
    """
    return np.diff(block_edges(dimension, rule)) / dimension * rule.distance()


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; very large or small components don't leave the range of doubles."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def rotated(units: np.ndarray, rule: Nearness) -> np.ndarray:
    """The same numbers for a vector in whatever batch it is."""
    return np.einsum("nd,ed->ne", units, rotation(units.shape[1], rule.seed))


def cells(turned: np.ndarray, block: int, medians: np.ndarray, halvings: int, rule: Nearness) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, cells, home): each row's own cell, then cells above it that may hold rows within the block's budget.

    A cell's number has a bit for each halved dimension. Of two rows in different cells only the one
    in the lower cell goes to the other's, so they meet once.
    """
    edges = block_edges(turned.shape[1], rule)
    halved = min(halvings, int(edges[block + 1] - edges[block]))
    part = turned[:, edges[block] : edges[block] + halved] - medians[edges[block] : edges[block] + halved]
    weights = 1 << np.arange(halved)
    own = (part >= 0) @ weights if halved else np.zeros(len(turned), np.int64)
    yield np.arange(len(turned)), own, True
    near = (np.abs(part) <= np.sqrt(budgets(turned.shape[1], rule)[block]) + 1e-9) @ weights if halved else own
    for flips in range(1, 1 << halved):
        rows = np.flatnonzero((near & flips == flips) & (own ^ flips > own))
        if len(rows):
            yield rows, own[rows] ^ flips, False


def usable(column: str) -> str:
    """SQL condition: not null, not empty, all components finite, one of them not 0."""
    return (
        f"{column} is not null and size({column}) > 0 and forall({column}, x -> x is not null and not isnan(x) "
        f"and abs(x) < double('infinity')) and exists({column}, x -> x <> 0)"
    )


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def vector_classes(rows: DataFrame) -> DataFrame:
    """(cls, label, dim, vec, least, copies): equal vectors of a label are one class. The table is written."""
    found = rows.filter("cls is not null").groupBy("cls").agg(
        F.first("label").alias("label"), F.first("vec").alias("vec"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")
    )
    return materialize(found.withColumn("dim", F.size("vec")), "vector-classes")


def _medians(classes: DataFrame, rule: Nearness) -> dict[int, np.ndarray]:
    """For each dimension, medians of the rotated vectors of at most ``rule.sample`` classes, by hash."""
    taken = classes.orderBy("cls").select("vec").limit(rule.sample).collect()
    sizes = {len(r["vec"]) for r in taken}
    found = {d: np.array([r["vec"] for r in taken if len(r["vec"]) == d], np.float64) for d in sizes}
    return {d: np.median(rotated(unit_vectors(v), rule), axis=0) for d, v in found.items()}


def _placed(classes: DataFrame, halvings: int, medians: dict[int, np.ndarray], rule: Nearness, whole: bool) -> DataFrame:
    """Rows in cells with their vectors or, if not ``whole``, only how many there are in each cell."""
    label, vec = (classes.schema[c].dataType.simpleString() for c in ("label", "vec"))
    keys = f"label {label}, dim int, block int, cell int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                turned = rotated(unit_vectors(_matrix(part.column("vec"))), rule)
                for block in range(len(block_edges(dim, rule)) - 1):
                    places = list(cells(turned, block, medians.get(dim, np.zeros(dim)), halvings, rule))
                    rows, cell = np.concatenate([p[0] for p in places]), np.concatenate([p[1] for p in places]).astype(np.int32)
                    fixed = {"dim": np.full(len(rows), dim, np.int32), "block": np.full(len(rows), block, np.int32), "cell": cell}
                    took = part.take(pa.array(rows))
                    out = [took.column("label"), *[pa.array(x) for x in fixed.values()]]
                    if whole:
                        home = np.concatenate([np.full(len(p[0]), p[2]) for p in places])
                        out += [pa.array(home), took.column("cls"), took.column("copies"), took.column("vec")]
                        yield pa.RecordBatch.from_arrays(out, ["label", *fixed, "home", "cls", "copies", "vec"])
                    else:
                        yield pa.RecordBatch.from_arrays(out, ["label", *fixed])

    schema = f"{keys}, home boolean, cls binary, copies long, vec {vec}" if whole else keys
    return classes.mapInArrow(run, schema)


def _forest(pairs: np.ndarray, size: int) -> np.ndarray:
    """The smallest place that each place reaches over the pairs."""
    root = np.arange(size)
    while True:
        before = root.copy()
        low = np.minimum(root[pairs[0]], root[pairs[1]])
        np.minimum.at(root, pairs[0], low)
        np.minimum.at(root, pairs[1], low)
        root = root[root]
        if (root == before).all():
            return root


def compare(units: np.ndarray, home: np.ndarray, copies: np.ndarray, second: np.ndarray, block: int, rule: Nearness) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a cell its links to others' copies, and the smallest row it reaches.

    ``second`` marks rows of another chunk of the cell: only rows of different chunks are compared;
    without any, all are. Rows that are both away from their own cell aren't. A pair counts in the
    first block in which it is within the budget, so that it counts once.
    """
    turned, edges, most = rotated(units, rule), block_edges(units.shape[1], rule), budgets(units.shape[1], rule)
    part = turned[:, edges[block] : edges[block + 1]]
    a, b = (np.flatnonzero(~second), np.flatnonzero(second)) if second.any() else (np.arange(len(units)), np.arange(len(units)))
    square = (part * part).sum(axis=1)
    near = square[a][:, None] + square[b][None, :] - 2 * (part[a] @ part[b].T) <= most[block] + 1e-6
    near &= home[a][:, None] | home[b][None, :]
    if not second.any():
        near = np.triu(near, 1)
    x, y = np.nonzero(near)
    x, y = a[x], b[y]
    counts, forest = np.zeros(len(units), np.int64), np.empty((2, 0), np.int64)
    for at in range(0, len(x), _SLICE):
        i, j = x[at : at + _SLICE], y[at : at + _SLICE]
        apart = turned[i] - turned[j]
        within = np.add.reduceat(apart * apart, edges[:-1], axis=1) <= most
        first = within[:, block] & ~within[:, :block].any(axis=1)
        i, j = i[first], j[first]
        linked = (units[i] * units[j]).sum(axis=1) >= rule.least
        i, j = i[linked], j[linked]
        np.add.at(counts, i, copies[j])
        np.add.at(counts, j, copies[i])
        root = _forest(np.hstack([forest, np.stack([i, j])]), len(units))
        moved = np.flatnonzero(root != np.arange(len(root)))
        forest = np.stack([moved, root[moved]])
    root = np.arange(len(units))
    root[forest[0]] = forest[1]
    return counts, root


def class_links(classes: DataFrame, rule: Nearness) -> DataFrame:
    """(cls, other, n): links of a class found in one cell, and a class it reaches there. The table is written."""
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    halvings = max(0, int(np.ceil(np.log2(max(1, largest) / rule.cell_rows))))
    medians = _medians(classes, rule)
    keys = ["label", "dim", "block", "cell"]
    sizes = _placed(classes, halvings, medians, rule, whole=False).groupBy(*keys).count()
    crowded = sizes.filter(F.col("count") > rule.chunk_rows).withColumn("chunks", F.ceil(F.col("count") / rule.chunk_rows).cast("int")).drop("count")
    rows = _placed(classes, halvings, medians, rule, whole=True).join(crowded, keys, "left")
    chunk = F.pmod(F.xxhash64("cls"), F.coalesce("chunks", F.lit(1))).cast("int")
    rows = rows.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
    rows = rows.withColumns({"first": F.least("chunk", "other"), "second": F.greatest("chunk", "other")}).drop("chunks", "other")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block, first, second = (table.column(c)[0].as_py() for c in ("block", "first", "second"))
        chunk = table.column("chunk").to_numpy()
        units = unit_vectors(_matrix(table.column("vec").combine_chunks()))
        home, copies = table.column("home").to_numpy(zero_copy_only=False), table.column("copies").to_numpy()
        if first != second and len(np.unique(chunk)) < 2:
            found = np.empty(0, np.int64)
            counts, root = found, found
        else:
            counts, root = compare(units, home, copies, chunk == second if first != second else np.zeros(len(chunk), bool), block, rule)
            found = np.flatnonzero(counts)
        cls = table.column("cls")
        return pa.table({"cls": cls.take(found), "other": cls.take(root[found] if len(found) else found), "n": counts[found]})

    found = rows.groupBy(*keys, "first", "second").applyInArrow(run, "cls binary, other binary, n long")
    return materialize(found, "vector-links")


def near_duplicates(
    rows: DataFrame, rule: Nearness | None = None, key: str = "vec_id", column: str = "embedding", label: str = "label"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row: vectors of its label at a cosine of ``rule.least`` or more.

    Unit vectors are rotated at random and split into blocks of few dimensions. Two that link are within
    a proportional part of the squared distance in at least one block, so each block is range-joined
    under that budget by cells, and every pair found is verified on the whole vectors; nothing is
    approximate. Tasks return counts and spanning forests, never pairs. Equal vectors are one class,
    however many; a crowded cell is cut into chunks that meet pair by pair.

    ``n_links`` counts other rows, copies too. ``component_id`` is the smallest ``vec_id`` reachable,
    its own included. Null labels and vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, nor do vectors of different lengths. Repeated rows link with one
    another. Null ids count as larger than any; a component of null ids only has a null id, and such
    rows are kept. Other columns are ignored. An empty table gives an empty table.
    """
    rule = rule or Nearness()
    kind = rows.schema[column].dataType.simpleString()
    vec = F.col(column) if kind in ("array<float>", "array<double>") else F.col(column).cast("array<double>")
    given = rows.select(F.col(key).alias("id"), F.col(label).alias("label"), vec.alias("vec"))
    # 128 bits of hash, as equal classes are told by them alone.
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(i), "label", "vec")), 16, "0") for i in range(2)]
    good = F.expr(f"label is not null and {usable('vec')}")
    given = given.withColumn("cls", F.when(good, F.unhex(F.concat(*halves))))
    classes = vector_classes(given)
    found = class_links(classes, rule)
    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    comps = components(found.filter("cls <> other").select(F.col("cls").alias("a"), F.col("other").alias("b")).distinct())
    facts = classes.select("cls", "least", "copies")
    smallest = comps.join(facts, "cls").groupBy("comp").agg(F.min("least").alias("smallest"))
    reached = comps.join(smallest, "comp").select("cls", "smallest")
    facts = facts.join(counts, "cls", "left").join(reached, "cls", "left").select(
        "cls", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("smallest", "least").alias("component")
    )
    joined = given.select("id", "cls").join(facts, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component"))
    return joined.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.col(key).eqNullSafe(F.col("component_id"))
    )


SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), usable AS (
  SELECT * FROM vectors WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), found AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM found LEFT JOIN counts USING (vec_id)
"""
