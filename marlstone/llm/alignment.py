"""Alignment of two tokenizers' tokens by the bytes at which they end, merged along equal pieces of their path."""

from __future__ import annotations

import hashlib
import json
import os
import re
import secrets
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.text import from_bytes, plain_text, text_batches, to_bytes
from marlstone.session import LARGE_ROWS, materialize

# Texts of a block and of one call of the libraries have about so many bytes; a piece of the merge path has WORK steps.
BLOCK_BYTES, CALL_BYTES, WORK = 4 << 20, 1 << 18, 1 << 16
_SPACE = "▁"
# Both tokenizers cut before a single space between characters that are no white space.
_BOUNDARY = re.compile(rf"(?<=[^\s{_SPACE}]) (?=[^\s{_SPACE}])")
_WHITE = rf"[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}{_SPACE}]"
_UNEVEN = f"^ | $| {_WHITE}|{_WHITE} "


def split_points(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two ascending arrays stands after every ``work`` steps, equal values from ``a`` first.

    A binary search along each diagonal of the merge path; all diagonals are searched at once.
    """
    steps = np.arange(work, len(a) + len(b), work)
    low, high = np.maximum(0, steps - len(b)), np.minimum(steps, len(a))
    while (unsettled := low < high).any():
        middle = (low[unsettled] + high[unsettled]) // 2
        taken = a[middle] <= b[steps[unsettled] - middle - 1]
        low[unsettled] = np.where(taken, middle + 1, low[unsettled])
        high[unsettled] = np.where(taken, high[unsettled], middle)
    return low, steps - low


def common_ends(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` (ascending, without repeats) of the values that both hold.

    Each piece of the path is searched by itself. A pair that a piece's end divides is stitched
    from the last value of one piece and the first of the next.
    """
    i, j = split_points(a, b, work)
    of_a, of_b = [i[:0]], [j[:0]]
    edges_a, edges_b = [0, *i.tolist(), len(a)], [0, *j.tolist(), len(b)]
    for a0, a1, b0, b1 in zip(edges_a, edges_a[1:], edges_b, edges_b[1:], strict=False):
        piece = a[a0:a1]
        at = np.searchsorted(piece, b[b0:b1])
        inside = np.flatnonzero(at < len(piece))
        inside = inside[piece[at[inside]] == b[b0 + inside]]
        of_a.append(a0 + at[inside])
        of_b.append(b0 + inside)
    cut = (i > 0) & (j < len(b))
    i, j = i[cut] - 1, j[cut]
    same = a[i] == b[j]
    found_a, found_b = np.concatenate([*of_a, i[same]]), np.concatenate([*of_b, j[same]])
    order = np.argsort(found_a, kind="stable")
    return found_a[order], found_b[order]


class Strings:
    """Byte strings by number, laid out one after the other."""

    def __init__(self, values: list[bytes]):
        self.flat = np.frombuffer(b"".join(values), np.uint8)
        self.ends = np.cumsum([0, *map(len, values)])

    def sizes(self, ids: np.ndarray) -> np.ndarray:
        return self.ends[ids + 1] - self.ends[ids]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the given strings, one after the other."""
        return self.flat[_ranges(self.ends[ids], self.sizes(ids))]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def byte_level_tokens(vocabulary: str) -> list[bytes]:
    """Token bytes of a byte-level BPE file by id: printable Latin-1 stands for itself, other bytes for 256 upwards."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in own]
    byte = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(others)}
    tokens = json.loads(vocabulary)["model"]["vocab"]
    out = [b""] * (max(tokens.values()) + 1)
    for token, number in tokens.items():
        out[number] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return out


def piece_tokens(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """Piece bytes by id: U+2581 is a space, <0xHH> is a byte."""
    pieces = ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in pieces]


def segments(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts cut before single spaces, and where each text's segments begin; an empty text has none."""
    uneven = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False)
    filled = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(texts, " ")
    if not (uneven | ~filled).any():
        return lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    own = pa.array([_BOUNDARY.split(t.as_py()) if odd else [] for t, odd in zip(texts, uneven, strict=True)], pa.list_(pa.string()))
    both = pa.chunked_array([lists, own]).combine_chunks()
    picked = both.take(pa.array(np.arange(len(texts)) + len(texts) * (uneven | ~filled)))
    return picked.flatten(), picked.offsets.to_numpy() - picked.offsets[0].as_py()


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for ids in lists for x in ids), np.int64, int(sizes.sum())), sizes


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums between offsets."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


class Aligner:
    """Both tokenizers and their token bytes, inside a task."""

    def __init__(self, a_blob: str, b_blob: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = tokenizers.Tokenizer.from_str(a_blob)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_blob)
        self.a_bytes, self.b_bytes = Strings(byte_level_tokens(a_blob)), Strings(piece_tokens(self.b))
        self.digits = Strings([b"%d" % i for i in range(max(len(self.a_bytes.ends), len(self.b_bytes.ends)))])

    def _agree(self, ids: np.ndarray, sizes: np.ndarray, of: Strings, text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Segments whose joined token bytes are the text's."""
        ends = np.concatenate(([0], np.cumsum(sizes)))
        own = _sums(of.sizes(ids), ends)
        same = own == lengths
        if same.all():
            wrong = np.flatnonzero(of.joined(ids) != text)
            same[np.searchsorted(np.cumsum(lengths), wrong, "right")] = False
            return same
        starts, token_starts = np.cumsum(lengths) - lengths, ends[:-1]
        for k in np.flatnonzero(same):
            given = text[starts[k] : starts[k] + lengths[k]]
            same[k] = np.array_equal(of.joined(ids[token_starts[k] : token_starts[k] + sizes[k]]), given)
        return same

    def call(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """For each segment: if its bytes agree, its tokens of A and of B, its links, their pairs (a << 32 | b), its groups as text."""
        texts = [" " + x for x in parts.to_pylist()]
        a, na = _flat([x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)])
        b, nb = _flat(self.b.encode([x[1:] for x in texts], num_threads=1))
        lengths = pc.binary_length(parts).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        text = np.frombuffer("".join(texts).encode(), np.uint8)
        valid = self._agree(a, na, self.a_bytes, text, lengths) & self._agree(b, nb, self.b_bytes, text, lengths)
        if not valid.all():
            a, b = a[np.repeat(valid, na)], b[np.repeat(valid, nb)]
            na, nb = na * valid, nb * valid
        # Ends over all segments of the call: each segment's end is a common one.
        ia, ib = common_ends(np.cumsum(self.a_bytes.sizes(a)), np.cumsum(self.b_bytes.sizes(b)))
        pairs = (a[ia] << 32) | b[ib]
        links = _sums(np.ones(len(ia), np.int64), np.searchsorted(ia, np.concatenate(([0], np.cumsum(na)))))
        return valid, na, nb, links, pairs, self._groups(a, b, ia, ib, na + nb)

    def _groups(self, a: np.ndarray, b: np.ndarray, ia: np.ndarray, ib: np.ndarray, tokens: np.ndarray) -> list[bytes]:
        """``a1,a2|b1;`` of each segment: tokens in order of their groups, A's before B's."""
        before_b, until_a = np.concatenate(([0], ib + 1)), np.append(ia + 1, len(a))
        at_a = np.arange(len(a)) + before_b[np.searchsorted(ia, np.arange(len(a)))]
        at_b = np.arange(len(b)) + until_a[np.searchsorted(ib, np.arange(len(b)))]
        ids, signs = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = a, b
        signs[at_a[ia]], signs[at_b[ib]] = ord("|"), ord(";")
        sizes = self.digits.sizes(ids) + 1
        ends = np.cumsum(sizes)
        out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
        out[_ranges(ends - sizes, sizes - 1)] = self.digits.joined(ids)
        out[ends - 1] = signs
        cuts = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(tokens)))].tolist()
        whole = out.tobytes()
        return [whole[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]

    def distinct(self, parts: pa.Array) -> tuple:
        """:meth:`call` over many segments, in calls of about equal bytes."""
        size = np.cumsum(pc.binary_length(parts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        ends = np.searchsorted(size, np.arange(CALL_BYTES, (size[-1] if len(size) else 0) + CALL_BYTES, CALL_BYTES))
        found, at = [], 0
        for end in dict.fromkeys(np.minimum(ends + 1, len(size)).tolist()):
            found.append(self.call(parts.slice(at, end - at)))
            at = end
        if not found:
            found = [self.call(parts)]
        *numbers, groups = zip(*found, strict=True)
        return *(np.concatenate(x) for x in numbers), [x for part in groups for x in part]


_BLOCK = (
    "block long, doc_id {kind}, n_a array<long>, n_b array<long>, n_links array<long>, groups array<string>, segments binary, "
    "segment_ends binary, pairs binary, pair_sizes binary, a array<int>, b array<int>, n array<long>"
)


@lru_cache(maxsize=1)
def _aligner(a_blob: str, b_blob: bytes) -> Aligner:
    """One for each Python worker, not for each task."""
    return Aligner(a_blob, b_blob)


def _parts(texts: pa.Array) -> list[slice]:
    """Runs of texts of about ``BLOCK_BYTES``; a longer text is one by itself."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(size // BLOCK_BYTES)) + 1
    return [slice(int(x), int(y)) for x, y in zip([0, *cuts], [*cuts, len(texts)], strict=True)]


def _block(aligner: Aligner, ids: pa.Array, texts: pa.Array, whole_groups: bool) -> pa.RecordBatch:
    """A row of :func:`aligned_blocks`."""
    parts, offsets = segments(texts)
    coded = pc.dictionary_encode(parts)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    valid, na, nb, links, pairs, groups = aligner.distinct(coded.dictionary)
    good = _sums(~valid[codes], offsets) == 0
    kept = np.repeat(good, np.diff(offsets))
    codes, offsets = codes[kept], np.concatenate(([0], np.cumsum(np.diff(offsets) * good)))
    figures = [_sums(x[codes], offsets) for x in (na, nb, links)]
    texts_of = []
    for x, y in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        joined = b"".join(map(groups.__getitem__, codes[x:y].tolist()))[:-1]
        texts_of.append(joined.decode() if whole_groups or not joined else hashlib.sha256(joined).hexdigest())
    distinct, place = np.unique(pairs, return_inverse=True)
    amounts = np.zeros(len(distinct), np.int64)
    np.add.at(amounts, place, np.repeat(np.bincount(codes, minlength=len(valid)), links))
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    columns = {
        "block": pa.array([secrets.randbits(63)]),
        "doc_id": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
        **{c: pa.array([x], longs) for c, x in zip(("n_a", "n_b", "n_links"), figures, strict=True)},
        "groups": pa.array([texts_of], pa.list_(pa.string())),
        "segments": pa.array([to_bytes(codes.astype(np.int32))]),
        "segment_ends": pa.array([to_bytes(offsets.astype(np.int64))]),
        "pairs": pa.array([to_bytes(place.astype(np.int32))]),
        "pair_sizes": pa.array([to_bytes(links.astype(np.int32))]),
        "a": pa.array([(distinct >> 32).astype(np.int32)], ints),
        "b": pa.array([(distinct & 0xFFFFFFFF).astype(np.int32)], ints),
        "n": pa.array([amounts], longs),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def aligned_blocks(docs: DataFrame, a_vocabulary: str, b_vocabulary: str, whole_groups: bool = False) -> DataFrame:
    """One row for each part of an Arrow batch: the documents' figures, and their links by distinct segment. Written.

    Distinct segments of the part are encoded and aligned once. ``a, b, n`` are the part's distinct
    linked ids and how many links it has of each; ``pairs`` are places among them, ``pair_sizes`` of each
    segment; ``segments`` are places among distinct segments, document by document.
    """
    a_blob, b_blob = Path(a_vocabulary).read_text(encoding="utf-8"), Path(b_vocabulary).read_bytes()
    rows = docs.select("doc_id", plain_text().alias("text"))
    schema = _BLOCK.format(kind=f"array<{rows.schema['doc_id'].dataType.simpleString()}>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_blob, b_blob)
        for batch, texts in text_batches(batches):
            for part in _parts(texts):
                yield _block(aligner, batch.column("doc_id").slice(part.start, part.stop - part.start), texts[part], whole_groups)
        pa.default_memory_pool().release_unused()

    return materialize(rows.mapInArrow(run, schema), "aligned", LARGE_ROWS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(a, b, n, best): links of each id pair in the whole corpus, and if no other pair of its b has more."""
    rows = blocks.select(F.explode(F.arrays_zip("a", "b", "n")).alias("x")).select("x.*")
    counts = rows.groupBy("a", "b").agg(F.sum("n").alias("n"))
    # A b has as many pairs as A has ids, at most.
    most = F.max("n").over(Window.partitionBy("b"))
    return counts.withColumn("best", F.col("n") == most).filter("n > 0")


def align_documents(docs: DataFrame, a_vocabulary: str, b_vocabulary: str, whole_groups: bool = False) -> DataFrame:
    """Alignment of each whole text between byte-level BPE A (on space + text) and SentencePiece B (on text).

    Token ends are byte offsets in space + text; where an A and a B token both end, a group ends and
    the two tokens are linked. Columns: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256`` (with ``whole_groups``: ``groups``, the text itself).

    Both tokenizers cut before single spaces, so texts are cut there, each batch's distinct segments
    are encoded once, and their ends are merged in pieces of equal work. Links of a batch are added
    up by id pair before Spark adds them over the corpus; the totals return to the batches, whose
    size is bounded, and only there to documents.

    Null and empty texts, and texts whose joined token bytes differ from space + text (as U+2581 does
    in B) have zeros and an empty string. Special strings are plain text. Repeated rows and null ids
    stay, one result row for each row. Other columns are ignored. An empty table gives an empty table.
    """
    blocks = aligned_blocks(docs, a_vocabulary, b_vocabulary, whole_groups)
    wanted = blocks.select("block", F.posexplode(F.arrays_zip("a", "b")).alias("place", "x")).select("block", "place", "x.*")
    known = wanted.join(pair_counts(blocks), ["a", "b"]).groupBy("block").agg(F.collect_list(F.struct("place", "n", "best")).alias("known"))
    rows = blocks.drop("a", "b", "n").join(known, "block", "left")
    digest = "groups" if whole_groups else "groups_sha256"
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker that has encoded still holds the tokenizers and memory that it no longer uses.
        _aligner.cache_clear()
        pa.default_memory_pool().release_unused()
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                blob = {c: from_bytes(row[c].as_buffer()) for c in ("pairs", "segments")}
                # Pairs that only texts without tokens have stay 0.
                of_pair = np.zeros((2, 1 + blob["pairs"].max(initial=-1)), np.int64)
                if row["known"].is_valid:
                    place, total, best = row["known"].values.flatten()
                    of_pair[0, place.to_numpy()] = total.to_numpy()
                    of_pair[1, place.to_numpy()] = best.to_numpy(zero_copy_only=False)
                ends = np.concatenate(([0], np.cumsum(from_bytes(row["pair_sizes"].as_buffer()), dtype=np.int64)))
                of_text = from_bytes(row["segment_ends"].as_buffer(), np.int64)
                total, best = (_sums(_sums(x[blob["pairs"]], ends)[blob["segments"]], of_text) for x in of_pair)
                na, nb, links, groups, ids = (row[c].values for c in ("n_a", "n_b", "n_links", "groups", "doc_id"))
                yield pa.RecordBatch.from_arrays([ids, na, nb, links, links, pa.array(best), pa.array(total), groups], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ", ".join(f"{c} long" for c in names[1:-1])
    return rows.mapInArrow(run, f"doc_id {kind}, {fields}, {digest} string")
