"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.text import mix, plain_text, text_batches, words

_BASE = np.uint64(0x9E3779B97F4A7C15)
# Words whose subwords are held in memory at a time.
_SLICE = 1 << 16


@dataclass(frozen=True)
class Training:
    """``sample`` bounds the labelled documents that one task fits the model on."""

    sample: int = 10_000
    bits: int = 18  # subwords share 2 ** bits vectors
    dim: int = 2
    shortest: int = 3
    longest: int = 6
    seen_in: int = 5  # a word trains its subwords if so many sample documents have it
    rounds: int = 160
    rate: float = 0.1
    inertia: float = 0.8


@dataclass(frozen=True)
class Model:
    """A weight for each subword, and the line from a document's sum to its log odds."""

    weights: np.ndarray
    slope: float
    offset: float
    rule: Training


def subwords(vocabulary: pa.Array, rule: Training) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character n-grams of each ``<word>``, and the word each belongs to, by word."""
    marked = [f"<{w}>" for w in vocabulary.to_pylist()]
    sizes = np.array([len(w) for w in marked], np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(marked)), sizes)
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    grams, owners, h = [np.empty(0, np.int64)], [np.empty(0, np.int64)], codes
    with np.errstate(over="ignore"):
        for n in range(2, rule.longest + 1):
            if len(codes) < n:
                break
            h = h[:-1] * _BASE + codes[n - 1 :]
            if n >= rule.shortest:
                whole = np.arange(len(h)) + n <= ends[: len(h)]
                grams.append((mix(h[whole] + np.uint64(n)) >> np.uint64(64 - rule.bits)).astype(np.int64))
                owners.append(owner[: len(h)][whole])
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return grams[order], owners[order]


def _bag(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Vocabulary of the texts, and their distinct (text, word) pairs."""
    flat, offsets = words(texts)
    coded = pc.dictionary_encode(flat)
    n = max(1, len(coded.dictionary))
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    pairs = np.unique(owner * n + coded.indices.to_numpy(zero_copy_only=False))
    return coded.dictionary, pairs // n, pairs % n


def _mean(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, values, minlength=n) / np.maximum(1, np.bincount(owner, minlength=n))


def _sums(model: Model, texts: pa.Array) -> np.ndarray:
    """Mean of the distinct words' subword means, times the root of their number."""
    vocabulary, doc, word = _bag(texts)
    value = np.empty(len(vocabulary))
    for at in range(0, len(vocabulary), _SLICE):
        part = vocabulary.slice(at, _SLICE)
        grams, owner = subwords(part, model.rule)
        value[at : at + len(part)] = _mean(model.weights[grams], owner, len(part))
    n = np.bincount(doc, minlength=len(texts))
    return np.bincount(doc, value[word], minlength=len(texts)) / np.sqrt(np.maximum(1, n))


def score_texts(model: Model, texts: pa.Array) -> np.ndarray:
    """Probability of the label 1 for each text."""
    return 1 / (1 + np.exp(-np.clip(model.slope * _sums(model, texts) + model.offset, -40, 40)))


def _line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one number, by Newton steps with a weak pull to a slope of 1."""
    a, b = 1.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 2)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w = p * (1 - p) + 1e-9
        g = np.array([((y - p) * x).sum() - (a - 1) * 0.1, (y - p).sum()])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -5, 5)), b + float(np.clip(step[1], -5, 5))
    return max(a, 0.0), b


def fit(texts: pa.Array, labels: np.ndarray, rule: Training) -> Model:
    """Gradient descent on subword vectors and softmax weights together.

    Four fifths of the texts train; the others set the line from sums to log odds, as a model
    stopped early is too shy. Plain gradients, not scaled by feature, let subwords that many
    documents agree on come first.
    """
    empty = Model(np.zeros(1 << rule.bits, np.float32), 0.0, float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 2))), rule)
    if len(set(labels.tolist())) < 2 or len(labels) < 20:
        return empty
    trains = np.arange(len(texts)) % 5 != 0
    part, y = texts.filter(pa.array(trains)), labels[trains]
    n = len(part)
    vocabulary, doc, word = _bag(part)
    size = np.bincount(doc, minlength=n)
    often = np.bincount(word, minlength=len(vocabulary)) >= rule.seen_in
    kept = often[word]
    number = np.cumsum(often) - 1
    doc, word, m = doc[kept], number[word[kept]], int(often.sum())
    grams, owner = subwords(vocabulary.filter(pa.array(often)), rule)
    per_word = np.maximum(1, np.bincount(owner, minlength=m))
    share = 1 / np.sqrt(np.maximum(1, size))
    rng = np.random.default_rng(7)
    buckets = 1 << rule.bits
    vectors = np.zeros((buckets, rule.dim), np.float32)
    out = rng.normal(0, 1, (rule.dim, 2))
    bias = np.array([0.0, np.log((y.sum() + 1) / (n - y.sum() + 1))])
    pace = np.zeros_like(vectors, np.float64)
    target = np.eye(2)[y]
    scale = 4.0
    for _ in range(rule.rounds):
        means = np.stack([np.bincount(owner, vectors[grams, k], minlength=m) / per_word for k in range(rule.dim)], 1)
        bag = np.stack([np.bincount(doc, means[word, k], minlength=n) for k in range(rule.dim)], 1) * share[:, None]
        logit = scale * bag @ out + bias
        logit -= logit.max(1, keepdims=True)
        p = np.exp(logit)
        p /= p.sum(1, keepdims=True)
        error = (p - target) / n
        down = scale * (error @ out.T) * share[:, None]
        by_word = np.stack([np.bincount(word, down[doc, k], minlength=m) for k in range(rule.dim)], 1) / per_word[:, None]
        slope = np.stack([np.bincount(grams, by_word[owner, k], minlength=buckets) for k in range(rule.dim)], 1)
        pace = rule.inertia * pace + slope
        top = np.abs(pace).max()
        if top == 0:
            break
        vectors -= (rule.rate * pace / top).astype(np.float32)
        out -= 0.5 * scale * (bag.T @ error)
        bias -= 0.5 * error.sum(0)
    raw = Model((scale * vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), 1.0, 0.0, rule)
    rest = texts.filter(pa.array(~trains))
    slope, offset = _line(_sums(raw, rest), labels[~trains].astype(float))
    return Model(raw.weights, slope, offset, rule)


def train(docs: DataFrame, labels: DataFrame, rule: Training | None = None) -> Model:
    """Fit on at most ``rule.sample`` documents of ``labels(doc_id, label)``, chosen by a hash of their id.

    The sample's texts meet in one task; its size is a fixed parameter and doesn't grow with the
    tables. Null ids and labels are left out; an id with several labels has the largest. Without
    both labels the model is the labels' share alone.
    """
    rule = rule or Training()
    chosen = (
        labels.select("doc_id", F.col("label").cast("int").alias("label")).dropna()
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rule.sample)
    )
    # At most rule.sample rows of two numbers, so the texts need not move to find the sample.
    rows = docs.select("doc_id", plain_text().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id")
    rows = rows.agg(F.min("text").alias("text"), F.max("label").alias("label")).withColumn("at", F.xxhash64("doc_id"))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("at", "ascending"), ("doc_id", "ascending")])
        texts = table.column("text").cast(pa.string()).combine_chunks()
        model = fit(texts, table.column("label").to_numpy().astype(np.int64), rule)
        return pa.table({"weights": [model.weights.tobytes()], "slope": [model.slope], "offset": [model.offset]})

    fitted = rows.groupBy(F.lit("all").alias("all")).applyInArrow(one, "weights binary, slope double, offset double").first()
    if fitted is None:
        return fit(pa.array([], pa.string()), np.empty(0, np.int64), rule)
    return Model(np.frombuffer(fitted["weights"], np.float32), fitted["slope"], fitted["offset"], rule)


def fold(column: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, by its remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of each row's whole text; no shuffle.

    A text's distinct words are embedded as means of their subword vectors, those are averaged, and
    the average counts with the root of their number. The text alone decides. Null and empty texts
    get the score of a text without evidence. Repeated rows stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_texts(model, texts))], ["doc_id", "score"])

    rows = docs.select("doc_id", plain_text().alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
