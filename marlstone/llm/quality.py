"""Quality classifier: interpolated modified Kneser-Ney model of trusted text, perplexity by language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.text import mix, plain_text, running_sum, text_batches
from marlstone.session import materialize

_BASE = np.uint64(0x9E3779B97F4A7C15)
# Marks before and after a text.
_BEFORE, _AFTER = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    order: int = 5  # characters of an n-gram
    quantile: float = 0.99  # of a language's trusted perplexities
    slack: float = 1.05  # documents up to so many times that quantile stay
    least: int = 20  # documents that set limits, as a language needs for one of its own
    shard: int = 2_000_000  # n-grams whose probabilities a task holds at a time
    sent: int = 5_000_000  # trusted ids that go to all tasks at most; with more, texts move to be marked


def _grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams ending at each character and after the text, text starts, and code points."""
    marked = "".join(f"{_BEFORE * (order - 1)}{t}{_AFTER}" for t in texts)
    codes = np.frombuffer(marked.encode("utf-32-le"), np.uint32)
    wide = codes.astype(np.uint64)
    h = wide
    with np.errstate(over="ignore"):
        for i in range(1, order):
            h = h[:-1] * _BASE + wide[i:]
    sizes = np.array([len(t) + order for t in texts], np.int64)
    return mix(h), np.concatenate(([0], np.cumsum(sizes))), codes


def _slices(texts: list[str]) -> list[tuple[int, int]]:
    """Bounds of runs of texts with about a million characters, so that arrays by character stay small."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    bounds = [0, *(np.flatnonzero(np.diff(ends >> 20)) + 1).tolist(), len(texts)]
    return list(zip(bounds[:-1], bounds[1:], strict=True))


def _added(keys: np.ndarray, amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, a place of each, and the sums of their amounts."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    sums = np.add.reduceat(amounts[order].astype(np.int64), first) if len(keys) else np.empty(0, np.int64)
    return keys[first], order[first], sums


def gram_counts(docs: DataFrame, rule: Rule) -> DataFrame:
    """(gram, n): all n-grams of all texts with their counts in trusted ones. The table is written.

    A task adds up its own counts first, so the shuffle has each n-gram once for a task.
    """
    order = rule.order

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray]]:
        for batch, texts in text_batches(batches):
            yield texts.to_pylist(), batch.column("trusted").to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, grams = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty((0, order), np.uint32)
        for values, trusted in ((v[a:b], t[a:b]) for v, t in read(batches) for a, b in _slices(v)):
            h, starts, codes = _grams(values, order)
            inside = np.ones(len(h), bool)
            for i in range(1, order):
                cut = starts[1:-1] - i
                inside[cut] = False
            weight = np.repeat(trusted, np.diff(starts))[: len(h)]
            new, first, n = _added(h[inside], weight[inside])
            place = np.flatnonzero(inside)[first]
            text = codes[place[:, None] + np.arange(order)]
            keys, first, counts = _added(np.concatenate((keys, new)), np.concatenate((counts, n)))
            grams = np.concatenate((grams, text))[first]
        text = grams.tobytes().decode("utf-32-le")
        values = pa.array([text[i : i + order] for i in range(0, len(text), order)], pa.string())
        yield pa.RecordBatch.from_arrays([values, pa.array(counts)], ["gram", "n"])

    rows = docs.select(plain_text().alias("text"), "trusted").mapInArrow(run, "gram string, n long")
    return materialize(rows.groupBy("gram").agg(F.sum("n").alias("n")), "kn-counts")


def gram_probabilities(counts: DataFrame, rule: Rule) -> DataFrame:
    """(gram, logp): natural log of P(last character | those before) for every n-gram of ``counts``.

    Below the highest order, an n-gram's count is the number of characters seen before it. Three
    discounts for an order follow from the numbers of n-grams seen once to four times; what they
    take off a context goes to the next lower order. Each order's counts are a written table.
    """
    order = rule.order
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        shorter = tables[k + 1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count_if(F.col("n") > 0).alias("n"))
        tables[k] = materialize(shorter, "kn-counts")
    counted = [
        tables[k].filter("n > 0").select(F.lit(k).alias("k"), F.least("n", F.lit(5)).alias("m")).groupBy("k", "m").count() for k in range(1, order + 1)
    ]
    every = counted[0]
    for more in counted[1:]:
        every = every.union(more)
    seen = {(r["k"], r["m"]): r["count"] for r in every.collect()}
    known = sum(v for (k, _), v in seen.items() if k == 1)
    below = tables[1].select("gram", F.lit(1.0 / (known + 1)).alias("p"))
    for k in range(1, order + 1):
        n1, n2, n3, n4 = (max(1, seen.get((k, m), 0)) for m in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        off = [min(max(d, 0.1), m - 0.05) for m, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
        cut = F.when(F.col("n") == 1, off[0]).when(F.col("n") == 2, off[1]).otherwise(off[2])
        own = tables[k].withColumn("cut", cut).withColumn("context", F.expr(f"substring(gram, 1, {k - 1})"))
        contexts = own.filter("n > 0").groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("freed"))
        row = own.join(contexts, "context", "left")
        if k > 1:
            row = row.withColumn("less", F.expr("substring(gram, 2)")).join(below.select(F.col("gram").alias("less"), "p"), "less")
        else:
            row = row.join(below, "gram")
        own_share = F.when(F.col("n") > 0, (F.col("n") - F.col("cut")) / F.col("total")).otherwise(0.0)
        p = own_share + F.coalesce(F.col("freed") / F.col("total"), F.lit(1.0)) * F.col("p")
        below = row.select("gram", p.alias("p"))
        if k >= order - 1:
            below = materialize(below, "kn-probabilities")
    return below.select("gram", F.log("p").alias("logp"))


class _Table:
    """Open addressing over 64-bit hashes in numpy: one float for each.

    The slots are laid out where the table is first used, so the driver holds the entries only.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.given, self.mask = (keys, values), None

    def _lay_out(self) -> None:
        keys, values = self.given
        self.mask = np.uint64((1 << max(4, int(np.ceil(np.log2(2 * len(keys) + 1))))) - 1)
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.values = np.zeros(int(self.mask) + 1, np.float32)
        todo, self.turns = np.arange(len(keys)), 0
        while len(todo):
            slot = self._slot(keys[todo], self.turns)
            free = self.keys[slot] == 0
            taken, first = np.unique(slot[free], return_index=True)
            winners = todo[free][first]
            self.keys[taken], self.values[taken] = keys[winners], values[winners]
            todo = todo[~np.isin(todo, winners)]
            self.turns += 1

    def _slot(self, keys: np.ndarray, turn: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys + np.uint64(turn) * ((keys >> np.uint64(32)) | np.uint64(1))) & self.mask).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, 0 for those that aren't in the table."""
        if self.mask is None:
            self._lay_out()
        slot = self._slot(keys, 0)
        hit = self.keys[slot] == keys
        out = np.where(hit, self.values[slot], np.float32(0))
        todo = np.flatnonzero(~hit)
        for turn in range(1, self.turns):
            if not len(todo):
                break
            slot = self._slot(keys[todo], turn)
            hit = self.keys[slot] == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            todo = todo[~hit & (self.keys[slot] != 0)]
        return out


def perplexities(docs: DataFrame, logp: DataFrame, rule: Rule) -> DataFrame:
    """``docs`` (id, text, ...) with the perplexity of a character in place of the text.

    Probabilities go to the tasks in shards of at most ``rule.shard`` n-grams, so what a task holds
    doesn't grow. Each shard adds its part to a document's sum; with one shard, nothing is shuffled.
    """
    order = rule.order
    spark = docs.sparkSession

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.frombuffer("".join(batch.column("gram").to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, order).astype(np.uint64)
            h = codes[:, 0]
            with np.errstate(over="ignore"):
                for i in range(1, order):
                    h = h * _BASE + codes[:, i]
            yield pa.RecordBatch.from_arrays([pa.array(mix(h).view(np.int64)), batch.column("logp").cast(pa.float32())], ["h", "logp"])

    table = materialize(logp.mapInArrow(hashed, "h long, logp float"), "kn-table")
    shards = max(1, -(-table.count() // rule.shard))
    kept = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    parts = None
    for shard in range(shards):
        own = table.filter(F.pmod(F.xxhash64("h"), F.lit(shards)) == shard).toArrow()
        held = spark.sparkContext.broadcast(
            _Table(own.column("h").to_numpy().view(np.uint64), own.column("logp").to_numpy())
        )

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch, texts in text_batches(batches):
                sums = np.zeros(len(texts))
                sizes = np.zeros(len(texts), np.int64)
                values = texts.to_pylist()
                for a, b in _slices(values):
                    h, starts, _ = _grams(values[a:b], order)
                    logs = np.concatenate((held.value.get(h).astype(np.float64), np.zeros(order - 1)))
                    sums_before = np.concatenate(([0], np.cumsum(logs)))
                    sums[a:b] = sums_before[starts[1:] - order + 1] - sums_before[starts[:-1]]
                    sizes[a:b] = np.diff(starts) - order + 1
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in kept], pa.array(sums), pa.array(sizes)], [*kept, "log_sum", "symbols"]
                )

        part = docs.mapInArrow(run, f"{schema}, log_sum double, symbols long")
        parts = part if parts is None else parts.unionByName(part)
    if shards > 1:
        parts = parts.groupBy(*kept).agg(F.sum("log_sum").alias("log_sum"), F.max("symbols").alias("symbols"))
    return parts.withColumn("perplexity", F.exp(-F.col("log_sum") / F.col("symbols"))).drop("log_sum", "symbols")


def quantiles(values: DataFrame, by: str, column: str, at: float) -> DataFrame:
    """(by, n, quantile): the exact quantile ``at`` of each group, as Spark's ``percentile`` gives it.

    Equal values are counted first, the counts run over cells of near values, so no group is gathered in one task.
    """
    counted = values.groupBy(by, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("held"))
    counted = materialize(counted, "values")
    ahead = running_sum(counted, [by], F.floor(F.log("value") * 256), [F.col("value")], "held", "ahead")
    sizes = counted.groupBy(F.col(by).alias("__by")).agg(F.sum("held").alias("n"))
    placed = ahead.join(sizes, F.col(by).eqNullSafe(F.col("__by"))).withColumn("place", F.lit(at) * (F.col("n") - 1))
    holds = lambda rank: F.max(F.when((F.col("ahead") <= rank) & (rank < F.col("ahead") + F.col("held")), F.col("value")))
    ends = placed.groupBy(by, "n", "place").agg(holds(F.floor("place")).alias("low"), holds(F.ceil("place")).alias("high"))
    between = (F.ceil("place") - F.col("place")) * F.col("low") + (F.col("place") - F.floor("place")) * F.col("high")
    return ends.select(by, "n", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between).alias("quantile"))


def classify(docs: DataFrame, trusted: DataFrame, rule: Rule | None = None) -> DataFrame:
    """``doc_id, lang, text_hash, perplexity, max_perplexity, keep`` for each row of ``docs(doc_id, text, lang)``.

    ``trusted`` has the ``doc_id`` of documents known to be good. An interpolated modified Kneser-Ney
    model of their characters gives each document's perplexity. A document is kept up to
    ``slack`` times the quantile of its language's trusted documents that the model hasn't learnt
    from, a fifth of them. Languages with few of those (null among them) take the limit of all.

    Null and empty texts are scored as a text that ends at once. Without trusted documents all rows
    are kept with null limits. Repeated rows stay, null ids are never trusted. Other columns are
    ignored. An empty table gives an empty table.
    """
    rule = rule or Rule()
    good = materialize(trusted.select(F.col("doc_id").alias("good_id")).dropna().distinct(), "trusted")
    # The model learns from four fifths of them; the others set the limits, as documents that it hasn't seen.
    fifth = F.pmod(F.xxhash64(F.lit(5), "good_id"), F.lit(5)) == 0
    same = F.col("doc_id") == F.col("good_id")
    learnt = good.filter(~fifth)
    learnt = F.broadcast(learnt) if good.count() <= rule.sent else learnt
    marks = docs.select("doc_id", plain_text().alias("text")).join(learnt, same, "left")
    counts = gram_counts(marks.select("text", F.col("good_id").isNotNull().alias("trusted")), rule)
    # Texts are scored where they are read; marks follow by id.
    rows = docs.select("doc_id", "lang", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"), plain_text().alias("text"))
    scored = perplexities(rows, gram_probabilities(counts, rule), rule)
    scored = materialize(scored.select("doc_id", "lang", "text_hash", "perplexity"), "perplexities")
    known = scored.join(good.filter(fifth), same, "left_semi")
    # Each document counts for its language and, under null, for all.
    known = known.select("perplexity", F.explode(F.array_distinct(F.array(F.lit(None).cast("string"), F.col("lang").cast("string")))).alias("l"))
    levels = materialize(quantiles(known, "l", "perplexity", rule.quantile).select("l", "n", (F.col("quantile") * rule.slack).alias("own")), "limits")
    limits = levels.filter(f"n >= {rule.least} and l is not null")
    for_all = levels.filter("l is null").first()
    common = for_all["own"] if for_all else None
    out = scored.join(limits.select("l", "own"), F.col("lang") == F.col("l"), "left")
    limit = F.coalesce("own", F.lit(common).cast("double"))
    return out.select(
        "doc_id", "lang", "text_hash", "perplexity", limit.alias("max_perplexity"),
        F.coalesce(F.col("perplexity") <= limit, F.lit(True)).alias("keep"),
    )
