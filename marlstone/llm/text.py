"""Helpers that the operators share: words of Arrow columns, hashes, distributed running sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# A worker takes so many bytes of a batch at once, longer texts alone, where it holds many times as much for them.
PART_BYTES = 1 << 21
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def plain_text(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    """Number of words in a text; 0 for null."""
    return F.regexp_count(plain_text(column), F.lit(WORD)).cast("long")


def words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after the other, and where each text's words begin (n + 1 offsets)."""
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not filled.all():
        before = np.concatenate(([0], np.cumsum(filled)))
        flat, offsets = flat.filter(pa.array(filled)), before[offsets]
    return flat, offsets.astype(np.int64)


def hashes(values: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of strings."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(x, seed) for x in values.cast(pa.binary()).to_pylist()), np.uint64, len(values))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for every lower-cased word, and the offsets of :func:`words`."""
    flat, offsets = words(texts)
    coded = pc.dictionary_encode(flat)
    return hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)], offsets


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return x.view(np.int64)


def to_bytes(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on, each in as many bytes as the largest needs: how many, all lowest bytes, all next ones and so on."""
    size = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([size]) + numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T[:size].tobytes()


def from_bytes(blob: pa.Buffer, kind: type = np.int32) -> np.ndarray:
    """The numbers of :func:`to_bytes`."""
    given = np.frombuffer(blob, np.uint8)
    size = int(given[0])
    out = np.zeros(((len(given) - 1) // size, np.dtype(kind).itemsize), np.uint8)
    out[:, :size] = given[1:].reshape(size, len(out)).T
    return out.view(kind).ravel()


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Each Arrow batch with its text column as an array of plain strings."""
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column("text").cast(pa.string())


def parts(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, by parts of at most ``PART_BYTES``; a larger row is a part of its own."""
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, PART_BYTES + (ends[at - 1] if at else 0), "right")))
        yield batch.slice(at, end - at)
        at = end


def text_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Like :func:`text_batches`, each batch cut into :func:`parts` by the bytes of its texts."""
    for batch in batches:
        for part in parts(batch, pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)):
            yield part, part.column("text").cast(pa.string())


def pieces(df: DataFrame) -> int:
    """How many groups of a bounded size the input makes: some for each of its splits.

    Splits are cut by bytes, so this grows with the input without reading it.
    """
    return 4 * max(1, df.rdd.getNumPartitions())


def running_sum(df: DataFrame, group: list[str], cell: Column, order: list[Column], amount: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over the group's earlier rows, by ``cell`` and then ``order``.

    Cells cut a group into parts of bounded size. Only their sums run over the whole group; rows
    are sorted inside a cell. So a group with a third of all rows is spread over many tasks.
    """
    rows = df.withColumn("__cell", cell)
    keys = [*group, "__cell"]
    sums = rows.groupBy(*keys).agg(F.sum(amount).alias("__sum"))
    ahead = Window.partitionBy(*group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__before"),
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(keys)]
    joined = rows.join(sums, same, "left")
    return joined.withColumn(out, F.col("__before") + F.col("__inside")).drop(
        "__cell", "__inside", "__before", *[f"__r{i}" for i in range(len(keys))]
    )
