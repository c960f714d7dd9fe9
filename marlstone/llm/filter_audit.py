"""Filter interaction audit: what each filter removes in every order, by contractions of a contingency tensor."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.text import plain_text

# Parts whose orders are contracted in one call.
_PARTS = 64
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@dataclass(frozen=True)
class Limits:
    """A text fails A to D below or above these; E is being a copy of a document with a smaller id."""

    least_words: int = 100
    least_distinct: int = 80
    most_capitals: int = 10
    symbols: str = r"[#$%&*|]"

    names = "ABCDE"


def with_failures(docs: DataFrame, limits: Limits) -> DataFrame:
    """Add ``mask``: bits 0 to 3 are set where the whole ``text`` fails A to D; the text goes."""
    # Splitting at white space takes less time than extracting what is between.
    found = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    rows = docs.withColumn("found", found).withColumns({"words": F.size("found").cast("long"), "distinct": F.size(F.array_distinct("found"))})
    fails = [
        F.col("words") < limits.least_words,
        100 * F.col("distinct") < limits.least_distinct * F.col("words"),
        100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > limits.most_capitals * F.length("text").cast("long"),
        F.col("text").rlike(limits.symbols),
    ]
    mask = sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(fails)), F.lit(0))
    return rows.withColumn("mask", mask).drop("text", "found", "words", "distinct")


def copy_groups(docs: DataFrame, labels: DataFrame, limits: Limits) -> DataFrame:
    """One row for each text and part: its failures, documents, labels, and those of its smallest id.

    Texts don't move, only their SHA-256. Rows are dealt by id (those without one by their text),
    rows alike are folded there, and copies are added up before they meet.
    """
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), plain_text().alias("text"))
    rows = with_failures(rows.withColumn("copy", F.unhex(F.sha2("text", 256))), limits)
    rows = rows.withColumn("key", F.coalesce(F.col("id").cast("string"), F.hex("copy")))
    judged = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("key")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    rows = rows.join(judged, "key", "left").select("key", "id", "copy", "part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    rows = rows.groupBy("key", "id", "copy", "part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    head = F.struct("id", "n", (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("toxic")).alias("toxic"))
    return rows.groupBy("copy", "part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("without_id"),
        F.min(F.when(F.col("id").isNotNull(), head)).alias("head"),
    )


def cells(groups: DataFrame, copies: int) -> DataFrame:
    """(part, mask, n, good, toxic): documents for each combination of failures; ``copies`` is the bit of E."""
    least = F.min("head.id").over(Window.partitionBy("copy"))
    first = F.col("head.id") == F.col("least")
    groups = groups.withColumn("least", least)
    passed = {c: F.when(first, F.col(f"head.{c}")).otherwise(0) for c in ("n", "good", "toxic")}
    passed["n"] = passed["n"] + F.col("without_id")
    one = F.struct(F.col("mask"), *[x.alias(c) for c, x in passed.items()])
    other = F.struct((F.col("mask") + copies).alias("mask"), *[(F.col(c) - x).alias(c) for c, x in passed.items()])
    both = groups.select("part", F.explode(F.array(one, other)).alias("cell")).select("part", "cell.*").filter("n > 0")
    return both.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def selectors(filters: int) -> dict[str, np.ndarray]:
    """For every order and step, a vector along each filter's axis: pass (1, 0), fail (0, 1) or all (1, 1)."""
    passes, fails, whole = (1, 0), (0, 1), (1, 1)
    found: dict[str, list] = {"kept": [], "removed": [], "failing": [], "only": []}
    for order in itertools.permutations(range(filters)):
        for step, now in enumerate(order):
            before = set(order[:step])
            found["kept"].append([passes if i in before or i == now else whole for i in range(filters)])
            found["removed"].append([fails if i == now else passes if i in before else whole for i in range(filters)])
            found["failing"].append([fails if i == now else whole for i in range(filters)])
            found["only"].append([fails if i == now else passes for i in range(filters)])
    return {k: np.array(v, np.int64) for k, v in found.items()}


def contract(tensor: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Parts x steps: the part's tensor, contracted with one selector along each axis."""
    axes = "abcdefgh"[: tensor.ndim - 1]
    steps = ",".join(f"z{x}" for x in axes)
    return np.einsum(f"p{axes},{steps}->pz", tensor, *[chosen[:, i] for i in range(len(axes))])


def orders_of(counts: np.ndarray) -> dict[str, np.ndarray]:
    """The columns ``COUNTS`` as parts x steps; ``counts`` are parts x cells x (all, good, toxic)."""
    filters = int(counts.shape[1]).bit_length() - 1
    # A mask's lowest bit is the first filter, so the last axis of the reshaped cells is the first filter's.
    tensors = [np.transpose(counts[..., i].reshape(-1, *[2] * filters), (0, *range(filters, 0, -1))) for i in range(3)]
    chosen = selectors(filters)
    out = {"kept": contract(tensors[0], chosen["kept"]), "removed": contract(tensors[0], chosen["removed"])}
    out["redundant"] = contract(tensors[0], chosen["failing"]) - out["removed"]
    out["unique_fails"] = contract(tensors[0], chosen["only"])
    out["good_lost"], out["toxic_lost"] = (contract(t, chosen["removed"]) for t in tensors[1:])
    now = np.array([x for order in itertools.permutations(range(filters)) for x in order])
    sums = np.stack([out["removed"][:, now == i].sum(axis=1) for i in range(filters)], axis=1)
    out["shapley"] = sums[:, now]
    return out


def audit(docs: DataFrame, labels: DataFrame, limits: Limits | None = None) -> DataFrame:
    """``part, filter_order, step`` and ``COUNTS`` for every value of ``lang``, order of the filters and step.

    One pass over the texts finds each document's failures, Spark counts documents by part and
    combination of failures, and a part's 32 counts (all, good, toxic) are a 2x2x2x2x2 tensor that is
    contracted for all orders and steps at once. So orders cost nothing for each document.

    Null texts are empty texts: they fail A, pass B to D, and are copies of one another. Null
    ``lang`` is the part ''. A row without id is never a copy of a smaller id and has no labels.
    Rows that repeat an id and text are no copies of one another, but count each. A document is good
    (toxic) if any of its label rows says so. Other columns are ignored. No documents give no rows.
    """
    limits = limits or Limits()
    names, size = limits.names, 1 << len(limits.names)
    found = cells(copy_groups(docs, labels, limits), size >> 1)
    # At most 32 cells a part.
    tensors = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    labels_of = ["".join(o) for o in itertools.permutations(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _PARTS):
                batch = whole.slice(at, _PARTS)
                lists = batch.column("cells")
                values = lists.flatten()
                owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
                counts = np.zeros((batch.num_rows, size, 3), np.int64)
                mask = values.field("mask").to_numpy()
                for i, name in enumerate(("n", "good", "toxic")):
                    counts[owner, mask, i] = values.field(name).to_numpy()
                out = orders_of(counts)
                steps = len(labels_of) * len(names)
                part = batch.column("part").take(pa.array(np.repeat(np.arange(batch.num_rows), steps)))
                order = pa.array(labels_of).take(pa.array(np.tile(np.repeat(np.arange(len(labels_of)), len(names)), batch.num_rows)))
                step = pa.array(np.tile(np.arange(1, len(names) + 1, dtype=np.int32), len(labels_of) * batch.num_rows))
                numbers = [pa.array(out[c].reshape(-1)) for c in COUNTS]
                yield pa.RecordBatch.from_arrays([part, order, step, *numbers], ["part", "filter_order", "step", *COUNTS])

    return tensors.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


SQL = r"""
WITH judged AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), facts AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM texts
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM facts LEFT JOIN judged USING (doc_id)
), cells AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before
  FROM orders, (SELECT unnest(range(1, 6))::INT AS step)
), met AS (
  SELECT *, contains(fails, f) AS failing, translate(fails, before, '') = fails AS reached FROM cells, steps
), counted AS (
  SELECT part, filter_order, step, f, sum(CASE WHEN reached AND NOT failing THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN reached AND failing THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN failing AND NOT reached THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN reached AND failing THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN reached AND failing THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM met GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counted
"""
