"""Mixing sources to target weights by a low-discrepancy schedule of equal word blocks."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.text import running_sum, word_count
from marlstone.session import materialize

_GOLDEN = (math.sqrt(5) - 1) / 2
# Rows sorted by one task for a running sum: about this many documents or slots.
_CELL_ROWS = 8_192


@dataclass(frozen=True)
class Recipe:
    """Weights go to the sources in code point order, again from the first when they run out."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5  # words of the mix / words of all documents
    most: int = 2  # a source gives its words at most so often
    block_words: int = 64


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and a shuffling key that depends on the row alone."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"), _key().alias("key"))


def _key() -> Column:
    return F.md5(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))


def source_targets(rows: DataFrame, recipe: Recipe) -> DataFrame:
    """One row for each source: index, size, target, whole words to take, blocks and slots.

    A source gets weight x level words but at most ``most`` times its size. The level follows from
    sorting sources by the level at which they are full: it is the largest, over all of them, of
    what is left once all that fill earlier are full, by the weights left.
    """
    weights = F.array(*[F.lit(float(w)) for w in recipe.weights])
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("index", F.row_number().over(by_name) - 1)
    sources = sources.withColumn("weight", weights[F.col("index") % len(recipe.weights)])
    cap = (F.lit(recipe.most) * F.col("source_size")).cast("double")
    by_fill = Window.orderBy(cap / F.col("weight"), "index")
    full = F.coalesce(F.sum(cap).over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything)
    sources = sources.withColumn("level", (F.lit(recipe.share) * total - full) / left)
    level = F.max("level").over(everything)
    sources = sources.withColumn("target", F.least(cap, level * F.col("weight")))
    b = recipe.block_words
    sources = sources.withColumn("quota", F.floor(F.col("target") + 0.5))
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / b))
    rounds = F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(0)
    rest = F.col("quota") - rounds * F.col("source_size")
    sources = sources.withColumn("slots", (rounds * F.col("blocks") + F.ceil(rest / b)).cast("long"))
    ahead = by_name.rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumn("first_slot", F.coalesce(F.sum("slots").over(ahead), F.lit(0)))
    return sources.select("source", "index", "source_size", "target", "quota", "blocks", "slots", "first_slot")


def _quotients(a: int, b: int) -> list[int]:
    """Of the continued fraction of a / b; small ones make multiples of a / b fall evenly."""
    out = []
    while a:
        out.append(b // a)
        a, b = b % a, a
    return out


def _step(slots: int) -> int:
    """A whole number near the golden share of the slots, without factors in common, that falls evenly."""
    near = round(slots * _GOLDEN)
    fine = [x for x in range(max(1, near - 40), near + 41) if x < max(2, slots) and math.gcd(x, slots) == 1]
    return min(fine, key=lambda x: (max(_quotients(x, slots)), abs(x - near)))


def schedule(sources: DataFrame, recipe: Recipe) -> DataFrame:
    """slot, source index, rank of the slot in its source, block, and the words taken from the block.

    Slot i has the point (i x step) mod slots with step / slots next to the golden ratio. Points
    fall evenly into the sources' cumulative slot counts and hit each place once, so after any
    number of slots every source has its share, up to a few slots, and in the end exactly its own.
    """
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    slots = spark.range(total).withColumnRenamed("id", "slot")
    wide = F.col("slot").cast("decimal(19,0)") * F.lit(_step(total) if total else 1).cast("decimal(19,0)")
    slots = slots.withColumn("point", (wide % F.lit(max(1, total)).cast("decimal(19,0)")).cast("long"))
    # Points find their source by an equality on cells of the scale; a source covers one cell or more.
    cell = max(1, total // 4096)
    own = sources.filter("slots > 0").withColumn(
        "cell", F.explode(F.sequence(F.expr(f"first_slot div {cell}"), F.expr(f"(first_slot + slots - 1) div {cell}")))
    )
    hit = (F.col("point") >= F.col("first_slot")) & (F.col("point") < F.col("first_slot") + F.col("slots"))
    slots = slots.withColumn("cell", F.expr(f"point div {cell}")).join(own, "cell").filter(hit)
    slots = slots.withColumn("one", F.lit(1).cast("long"))
    slots = running_sum(slots, ["index"], F.expr(f"slot div {_CELL_ROWS}"), [F.col("slot")], "one", "rank")
    b = recipe.block_words
    slots = slots.withColumn("block", F.expr("rank % blocks")).withColumn("start", F.col("block") * b)
    natural = F.least(F.lit(b), F.col("source_size") - F.col("start"))
    taken_before = F.expr("rank div blocks") * F.col("source_size") + F.col("start")
    return slots.select(
        "slot", "index", "rank", "block", natural.alias("length"),
        F.least(natural, F.col("quota") - taken_before).alias("words"),
    )


def mix(docs: DataFrame, recipe: Recipe | None = None) -> DataFrame:
    """For each document how many of its words the mix takes, repeats counted.

    A source's documents are shuffled by a hash of id and text and laid end to end; the stream is
    cut into blocks of ``block_words`` words. The schedule's slots of a source take its blocks in
    turn, again from the first when all are used; the last slot is cut where the source's target is
    met. A document takes what its blocks take, so at most ``most`` times its size.

    Returns ``doc_id, source, size, source_size, target, key, taken``, one row for each row of ``docs``.
    A null source is a source of its own, the last. Null and empty texts have size 0 and are never
    taken. Rows alike in id and text are neighbours in the shuffle and may be taken differently
    often by a part of one round; which of them is left open, as they are equal. An empty table
    gives an empty table. Other columns are ignored.
    """
    recipe = recipe or Recipe()
    rows = materialize(sized(docs), "mix-sizes")
    sources = materialize(source_targets(rows, recipe), "mix-sources")
    b = recipe.block_words
    used = schedule(sources, recipe).groupBy("index", "block").agg(
        F.sum(F.expr("if(words = length, 1L, 0L)")).alias("whole"),
        F.coalesce(F.max(F.expr("if(words < length, words, 0)")), F.lit(0)).alias("cut"),
    )
    named = sources.select(F.col("source").alias("__source"), "index", "source_size", "target")
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    digits = max(1, math.ceil(math.log(max(2, rows.count() / _CELL_ROWS), 16)))
    filled = running_sum(
        rows.filter("size > 0"), ["index"], F.substring("key", 1, digits), [F.col("key")], "size", "at"
    )
    parts = filled.withColumn("block", F.explode(F.expr(f"sequence(at div {b}, (at + size - 1) div {b})")))
    parts = parts.join(used, ["index", "block"], "left")
    start, end = F.greatest(F.col("at"), F.col("block") * b), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * b)
    cut_end = F.least(end, F.col("block") * b + F.col("cut"))
    words = F.coalesce(F.col("whole") * (end - start) + F.greatest(F.lit(0), cut_end - start), F.lit(0))
    out = ["doc_id", "source", "size", "source_size", "target", "key"]
    taken = parts.withColumn("words", words).groupBy("index", "at", *out).agg(F.sum("words").cast("long").alias("taken"))
    return taken.select(*out, "taken").unionByName(
        rows.filter("size = 0").select(*out, F.lit(0).cast("long").alias("taken"))
    )


def mixed_texts(docs: DataFrame, recipe: Recipe | None = None) -> DataFrame:
    """The mix as documents: rows with the columns of ``docs``, as often as they are taken.

    Words taken beyond whole copies are the first ones of the text, with the white space before
    them. Rows alike in id and text are taken together. Documents that aren't taken are left out,
    as are empty ones.
    """
    taken = mix(docs, recipe).groupBy(F.col("key").alias("__of")).agg(F.sum("taken").alias("__taken"), F.max("size").alias("__size"))
    rows = docs.select("*", _key().alias("__key"))
    once = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    rows = rows.join(taken.filter("__taken > 0"), F.col("__key") == F.col("__of")).withColumn("__place", once).filter("__place = 1")
    rows = rows.withColumn("__left", F.explode(F.expr("transform(sequence(0, (__taken - 1) div __size), i -> __taken - i * __size)")))
    with_space = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(with_space, F.lit(1), F.col("__left").cast("int")), "")
    text = F.when(F.col("__left") >= F.col("__size"), F.col("text")).otherwise(cut)
    return rows.withColumn("text", text).select(*docs.columns)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')) AS key
  FROM documents
), named AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(idx % 3 + 1)::INT] AS weight, (2 * source_size)::DOUBLE AS cap FROM named
), levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
      / sum(weight) OVER (ORDER BY cap / weight, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT source, source_size, least(cap, (max(level) OVER ()) * weight) AS target FROM levels
), placed AS (
  SELECT s.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS quota,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offs
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE (quota // source_size) * size
         + greatest(0, least(size, quota % source_size - offs)) END::BIGINT AS taken
FROM placed
"""
