"""Models and limits from all rows, tasks that hold one block at a time."""

import dataclasses
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marlstone.llm import alignment, brown, quality, text


def test_limits_come_from_all_trusted_documents(spark):
    assert "trusted" not in {f.name for f in dataclasses.fields(quality.Rule)}
    pick = random.Random(3)
    values = [("a", pick.lognormvariate(1, 1)) for _ in range(997)] + [("b", 7.5)] * 40 + [(None, 3.0), (None, 4.0), ("c", 0.01)]
    frame = spark.createDataFrame(values, "l string, perplexity double").repartition(5)
    for at in (0.99, 0.5, 1.0):
        got = {r.l: (r.n, r.quantile) for r in quality.quantiles(frame, "l", "perplexity", at).collect()}
        want = frame.groupBy("l").agg(F.count("*").alias("n"), F.percentile("perplexity", F.lit(at)).alias("q")).collect()
        assert got == {r.l: (r.n, pytest.approx(r.q, rel=1e-12)) for r in want}


def test_more_trusted_ids_than_are_sent_change_nothing(spark):
    pick = random.Random(4)
    rows = [(i, "".join(pick.choices("abcd ", k=pick.randint(5, 80))), "en" if i % 2 else "de") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i,) for i in range(0, 200, 3)], "doc_id long")
    one, two = ({r.doc_id: (r.perplexity, r.max_perplexity, r.keep) for r in quality.classify(docs, labels, quality.Rule(order=3, least=3, sent=n)).collect()} for n in (1, 1000))
    assert one == {k: pytest.approx(v, rel=1e-6) for k, v in two.items()}


def test_a_blocks_pairs_leave_before_the_next_block_is_read():
    def blocks():
        row = {"train": [True, False], "sizes": [3, 1], "words": ["x", "y"], "places": [0, 1, 0, 1]}
        yield pa.RecordBatch.from_pylist([row], pa.schema({"train": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int32()), "words": pa.list_(pa.string()), "places": pa.list_(pa.int32())}))
        raise AssertionError("the first block was held")

    rule = brown.Classes(head=2, tails=1)
    first = next(brown._block_pairs(pa.array(["x", "y"]), rule)(blocks()))
    end = rule.head + rule.tails
    pairs = {(p // (end + 1), p % (end + 1)): n for p, n in zip(first["pair"].to_pylist(), first["n"].to_pylist())}
    assert pairs == {(end, 0): 1, (0, 1): 1, (1, 0): 1, (0, end): 1}
    assert np.array(first["n"]).sum() == 4


def _row_groups(table):
    """Rows of the row groups of a written table, file by file."""
    files = [pq.ParquetFile(name.removeprefix("file:").replace("///", "/")).metadata for name in table.inputFiles()]
    return [[f.row_group(g).num_rows for g in range(f.num_row_groups)] for f in files if f.num_rows]


def long_texts(spark, size, n=8):
    pick = random.Random(5)
    known = ["".join(pick.choices("abcdefgh", k=7)) for _ in range(3000)]
    rows = [(i, " ".join(pick.choices(known, k=size // 8))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def test_a_tasks_language_model_blocks_are_not_written_as_one(spark):
    rows, docs = long_texts(spark, brown._BLOCK_BYTES)
    blocks = brown.text_blocks(docs, brown.Classes())
    groups = _row_groups(blocks)
    assert sum(map(sum, groups)) == len(rows) and all(n <= 4 for g in groups for n in g) and any(len(g) > 1 for g in groups)
    got = {}
    for batch in blocks.select("doc_ids", "sizes", "words", "places").toArrow().to_batches():
        for i in range(len(batch)):
            words = batch.column("words")[i].values.take(pa.array(brown._places(batch, i))).to_pylist()
            for key, n in zip(batch.column("doc_ids")[i].as_py(), batch.column("sizes")[i].as_py(), strict=True):
                got[key], words = " ".join(words[:n]), words[n:]
    assert got == dict(rows)


@pytest.mark.parametrize("kind", [np.int32, np.int64])
@pytest.mark.parametrize(("numbers", "size"), [([], 1), ([0], 1), ([5, 255], 1), ([256, 0], 2), ([70000, 1], 3), ([5, 2**31 - 1, 256], 4)])
def test_numbers_come_back_from_their_bytes(numbers, size, kind):
    blob = text.to_bytes(np.array(numbers, kind))
    back = text.from_bytes(pa.py_buffer(blob), kind)
    assert back.dtype == kind and back.tolist() == numbers and len(blob) == 1 + size * len(numbers)


def test_a_tasks_aligned_blocks_are_not_written_as_one(spark):
    rows, docs = long_texts(spark, alignment.BLOCK_BYTES)
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    groups = _row_groups(alignment.aligned_blocks(docs, a, b))
    assert sum(map(sum, groups)) == len(rows) and all(n <= 4 for g in groups for n in g) and any(len(g) > 1 for g in groups)
