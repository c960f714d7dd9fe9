"""N-gram Jaccard join: parts or prefixes of the sets of word shingles as signatures, then exact verification."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.text import mix, plain_text, signed, text_parts, word_hashes
from marlstone.session import materialize

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
# Cells of the frequency table and of the table of documents to verify. Both are of fixed size.
_CELLS, _CHUNK = 1 << 22, 1 << 14
_MARKS = 1 << 22
# Shingles of this level or above are very frequent. Ways to cut a set into parts.
_CROWD, _WAYS = 13, 4
# Turns in which each class is compared with a few pivots. They end earlier when a turn adds too few links to those before.
_TURNS, _PIVOTS, _WORTH = 6, 4, 1 / 8
# So many of a class's signatures before one go along with it, to meet pairs once.
_BEFORE = 16
# Words of 64 bits in a set's parity bitmap.
_PARITY = 8
_BITS = [f"p{i}" for i in range(_PARITY)]


@dataclass(frozen=True)
class Likeness:
    """Sets of ``shingle`` words link when ``whole`` x intersection >= ``part`` x union."""

    shingle: int = 5
    part: int = 80
    whole: int = 100
    # A shingle is frequent when its cell has this many more than chance gives a cell.
    frequent: int = 16


def shingle_hashes(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of a shorter text, its whole word sequence."""
    words, offsets = word_hashes(texts)
    with np.errstate(over="ignore"):
        rolled = words.copy()
        for i in range(1, width):
            rolled = rolled[:-1] * _A + words[i:]
        rolled = mix(rolled)
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(rolled[a : b - width + 1]))
            elif b > a:
                short = np.uint64(b - a)
                for w in words[a:b]:
                    short = short * _A + w
                out.append(mix(np.array([short * _B], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), plain_text().alias("text"))


def frequent_cells(docs: DataFrame, rule: Likeness) -> np.ndarray:
    """A level for each cell of shingle hashes: 0 if its shingles are rare, else how frequent they are.

    Each task counts all its shingles into a table of fixed size; the tables are added up by
    chunks of cells. A frequent shingle stands out against the mean of its chunk, so the rule
    is the same at any size; levels double the excess in two steps. They only steer which parts of
    sets are indexed.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(_CELLS, np.int32)
        for _, texts in text_parts(batches):
            words, offsets = word_hashes(texts)
            if len(words) < rule.shingle:
                continue
            with np.errstate(over="ignore"):
                rolled = words.copy()
                for i in range(1, rule.shingle):
                    rolled = rolled[:-1] * _A + words[i:]
            starts = np.zeros(len(words) + 1, np.int32)
            np.add.at(starts, offsets[1:], 1)
            owner = np.cumsum(starts)[: len(words)]
            inside = owner[: len(rolled)] == owner[rule.shingle - 1 :]
            cells, found = np.unique((mix(rolled[inside]) % np.uint64(_CELLS)).astype(np.int32), return_counts=True)
            # More than 65,535 in a task count as that.
            table[cells] = np.minimum(table[cells] + found, 65_535)
        parts = table.reshape(-1, _CHUNK)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([parts[i].astype(np.uint16).tobytes() for i in used], pa.binary())],
            ["chunk", "counts"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, np.uint16).astype(np.int64)
        levels = [level(c).tobytes() for c in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["chunk", "levels"])

    def level(counts: np.ndarray) -> np.ndarray:
        mean = counts.mean()
        excess = (counts - mean) / (6 * np.sqrt(mean) + rule.frequent)
        return np.where(excess > 1, 1 + np.floor(2 * np.log2(np.maximum(excess, 1))), 0).astype(np.uint8)

    counted = _rows(docs).mapInArrow(count, "chunk int, counts binary")
    levels = np.zeros((_CELLS // _CHUNK, _CHUNK), np.uint8)
    for row in counted.repartition("chunk").mapInArrow(add, "chunk int, levels binary").collect():
        levels[row["chunk"]] = np.frombuffer(row["levels"], np.uint8)
    return levels.reshape(-1)


@cache
def _bands(rule: Likeness) -> list[int]:
    """Smallest sizes of the bands that sets are sorted into: sets of linked sizes are in one band or in neighbouring ones."""
    sizes = [-(-rule.part // max(1, rule.whole - rule.part))]
    while sizes[-1] < 1 << 40:
        sizes.append(rule.whole * sizes[-1] // rule.part + 1)
    return sizes


@cache
def _cut(band: int, rule: Likeness) -> tuple[int, int]:
    """Into how many parts sets of a band and the one below are cut, and how many more of them agree than one."""
    sizes = _bands(rule)
    # Two sets of one band meet among those of the band above.
    parts = (rule.whole - rule.part) * (sizes[band] + sizes[band + 1] - 2) // (rule.whole + rule.part) + 1
    weak = parts * math.exp(-0.75 * sizes[band - 1] / parts)
    spare = math.floor(weak + 2 * math.sqrt(weak))
    return parts + spare, spare


def _agreed_parts(shingles: np.ndarray, levels: np.ndarray, rule: Likeness) -> np.ndarray:
    """Parts of a set (sorted hashes).

    The space of hashes is cut into parts, the same for all sets of a band of sizes and the band below.
    A shingle of only one of two linked sets spoils one part, and there are more parts than such
    shingles, so linked sets agree on 1 + ``spare`` whole parts. A part's shingles are one signature:
    unlike single shingles, hardly any of these are shared by chance. Weak are parts without shingles or
    with none but very frequent ones, which crowds share. A set with at most ``spare`` weak parts leaves them
    out, as it agrees on another one. Sets that agree on weak parts only both have more; they are cut in
    another way too, and what the last way leaves weak is signatures as well. The number of signatures is linear in the set.
    """
    n = len(shingles)
    crowded = levels[(shingles % np.uint64(_CELLS)).astype(np.int64)] >= _CROWD
    band, out = bisect.bisect_right(_bands(rule), n) - 1, []
    with np.errstate(over="ignore"):
        for at in range(max(1, band), band + 2):
            parts, spare = _cut(at, rule)
            for way in range(_WAYS):
                kind = np.uint64(at * _WAYS + way) * _A
                keys, common = shingles, crowded
                if way:
                    keys = mix(shingles ^ mix(np.array([way], np.uint64)))
                    order = np.argsort(keys)
                    keys, common = keys[order], crowded[order]
                part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                weak = np.logical_and.reduceat(common, starts)
                signs = mix((np.add.reduceat(mix(keys), starts) + part[starts]) * _B + kind)
                out.append(signs[~weak])
                if parts - len(starts) + np.count_nonzero(weak) <= spare:
                    break
            else:
                empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[starts])
                out += [signs[weak], mix(empty * _B + kind)]
    return np.concatenate(out)


def _unshared(n: int, rule: Likeness) -> int:
    """Most shingles of a set of n that a linked set can lack."""
    return n - -(-rule.part * n // rule.whole)


def _first_shingles(shingles: np.ndarray, levels: np.ndarray, rule: Likeness) -> np.ndarray:
    """The first rare shingles of a set, or pairs of frequent ones.

    All sets put their rare shingles first, then the frequent ones, each by hash. Linked sets share
    a shingle within the first d + 1 of both, d being what a linked set can lack. If it is rare, it
    is a signature of both. If not, both have at most d rare shingles and share none of those, so
    sets with r and r' rare ones lack at most e = d - r and e' = d' - r' frequent ones of the other.
    Of the places between neighbours among the shared frequent shingles at most e + e' are taken up
    by shingles of one set only; the others are neighbours in both sets, and a set with f frequent
    shingles has at most f - 1 - (f - e - 1 - e - e') = 2e + e' neighbouring pairs that the other
    lacks. So in any order of pairs common to all sets, the first shared pair is among the first
    2e + e' + 1 of both. The order begins with the least frequent pairs, so crowds meet only where
    sets consist of nothing else. The number of signatures is linear in the set.
    """
    n = len(shingles)
    lacks = _unshared(n, rule)
    level = levels[(shingles % np.uint64(_CELLS)).astype(np.int64)]
    rare = shingles[level == 0]
    if len(rare) > lacks:
        return rare[: lacks + 1]
    own, other = lacks - len(rare), _unshared(rule.whole * n // rule.part, rule)
    rest, level = shingles[level > 0], level[level > 0].astype(np.int64)
    with np.errstate(over="ignore"):
        pairs = mix(rest[:-1] * _A + rest[1:] * _B)
    low, high = np.minimum(level[:-1], level[1:]), np.maximum(level[:-1], level[1:])
    return np.concatenate((rare, pairs[np.lexsort((pairs, high, low))[: 2 * own + other + 1]]))


def signatures(shingles: np.ndarray, levels: np.ndarray, rule: Likeness) -> np.ndarray:
    """Signatures of a set, such that linked sets that differ have one in common.

    From a threshold of 0.85 on they are parts of the set, a fifth to a third as many as shingles. Below, parts get small
    and twice as many, so there they are the first shingles.
    """
    n = len(shingles)
    if n == 0 or rule.whole * n < rule.part * (n + 1):
        return shingles[:0]  # too small to link with any other set
    if 100 * rule.part >= 85 * rule.whole:
        return _agreed_parts(shingles, levels, rule)
    return _first_shingles(shingles, levels, rule)


def shingle_classes(docs: DataFrame, rule: Likeness) -> DataFrame:
    """doc_id, n_shingles, cls (hash of the set; null if empty), signatures and parity bitmap of each row.

    The table is written once.
    """
    levels = frequent_cells(docs, rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_parts(batches):
            sets = shingle_hashes(texts, rule.shingle)
            signs = [signatures(s, levels, rule) for s in sets]
            sizes = np.array([len(s) for s in sets], np.int64)
            ends = np.concatenate(([0], np.cumsum([len(s) for s in signs])))
            flat = signed(np.concatenate(signs)) if ends[-1] else np.empty(0, np.int64)
            lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat)).cast(pa.list_(pa.int64()))
            parity = np.array([parity_bits(s) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes), _class_array(sets), lists,
                    *[pa.array(parity[:, i]) for i in range(_PARITY)],
                    pa.array([parity_bits(s, _width(len(s))) for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "text_hash", "n_shingles", "cls", "signs", *_BITS, "bits"],
            )

    rows = _rows(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    bitmap = ", ".join(f"{b} long" for b in _BITS)
    out = rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, cls long, signs array<long>, {bitmap}, bits array<long>")
    return materialize(out, "shingle-classes")


def _width(n: int) -> int:
    """Words of the long bitmap of n shingles: a power of two with four to eight bits for a shingle."""
    return 1 << max(0, (4 * n - 1).bit_length() - 6)


def parity_bits(shingles: np.ndarray, width: int = _PARITY) -> np.ndarray:
    """For each bit whether an odd number of shingles hash to it, in ``width`` words.

    Two sets' bitmaps differ in no more bits than there are shingles in only one of the sets. The
    halves of a bitmap make the one of half the width, when each bit is set in just one of them.
    """
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) % (64 * width), minlength=64 * width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _class_array(sets: list[np.ndarray]) -> pa.Array:
    keys = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64)
    return pa.array(signed(keys), mask=np.array([len(s) == 0 for s in sets], bool))


def shared_postings(classes: DataFrame) -> DataFrame:
    """(sign, cls) of the signatures that more than one class has, one of those with the same classes. The table is written.

    Near copies share very many signatures; those that all the same classes hold say the same. Signatures are
    compared by the number and two hash sums of their classes.
    """
    one = classes.filter("cls is not null and size(signs) > 0").select("cls", "signs").dropDuplicates(["cls"])
    postings = one.select("cls", F.explode(F.array_distinct("signs")).alias("sign"))
    held = F.count(F.lit(1)).over(Window.partitionBy("sign"))
    postings = materialize(postings.withColumn("held", held).filter("held > 1").drop("held"), "postings")
    sums = [F.bit_xor(F.xxhash64(F.lit(i), "cls")).alias(f"x{i}") for i in range(2)]
    alike = postings.groupBy("sign").agg(F.count(F.lit(1)).alias("held"), *sums)
    kept = alike.groupBy("held", "x0", "x1").agg(F.min("sign").alias("sign")).select("sign")
    return materialize(postings.join(kept, "sign", "left_semi"), "distinct-postings")


def _class_facts(classes: DataFrame) -> DataFrame:
    return classes.filter("cls is not null").select("cls", F.col("n_shingles").alias("n"), *_BITS).dropDuplicates(["cls"])


def _can_link(rule: Likeness, other: str) -> Column:
    """Whether sizes and bitmaps of a row's two sets leave room for a link; ``other`` prefixes the second's columns."""
    n, m = F.col("n"), F.col(f"{other}n")
    sizes = F.lit(rule.whole) * F.least(n, m) >= F.lit(rule.part) * F.greatest(n, m)
    apart = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"{other}{b}"))) for b in _BITS), F.lit(0))
    return sizes & (F.lit(rule.whole + rule.part) * apart <= F.lit(rule.whole - rule.part) * (n + m))


def _open(postings: DataFrame, comps: DataFrame) -> DataFrame:
    """Postings with components, of signatures whose classes aren't all in one component yet."""
    named = postings.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    by_sign = Window.partitionBy("sign")
    named = named.withColumn("low", F.min("comp").over(by_sign)).withColumn("high", F.max("comp").over(by_sign))
    return named.filter("low < high").drop("low", "high")


def pivot_pairs(postings: DataFrame, comps: DataFrame, facts: DataFrame, rule: Likeness, turn: int) -> DataFrame:
    """(a, b): each class with the pivots of most of its signatures, if sizes and bitmaps allow a link.

    A pivot is a signature's first class by a hash, so the signatures of a group of near copies
    mostly agree on it. There are at most four pairs for each class.
    """
    order = F.struct(F.xxhash64(F.lit(turn), "cls").alias("order"), F.col("cls").alias("cls"), F.col("comp").alias("comp"))
    rows = _open(postings, comps).withColumn("first", F.min(order).over(Window.partitionBy("sign")))
    rows = rows.filter(F.col("comp") != F.col("first.comp")).groupBy("cls", F.col("first.cls").alias("pivot")).count()
    best = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("count"), "pivot"))
    pairs = rows.withColumn("place", best).filter(F.col("place") <= _PIVOTS).select("cls", "pivot")
    other = facts.select(F.col("cls").alias("pivot"), *[F.col(c).alias(f"o_{c}") for c in ("n", *_BITS)])
    pairs = pairs.join(facts, "cls").join(other, "pivot").filter(_can_link(rule, "o_"))
    return materialize(pairs.select(F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b")).distinct(), "pivot-pairs")


def _meetings(rows: DataFrame, rule: Likeness) -> DataFrame:
    """Pairs of rows (sign, cls, comp and facts) of different components whose sizes and bitmaps allow a link, hardly any twice.

    Long texts that are nearly alike share hundreds of signatures. A signature leaves a pair to an earlier one if there is
    one among the few that both classes have before it. At the first common signature there is none, so each pair meets there.
    """
    before = F.collect_list("sign").over(Window.partitionBy("cls").orderBy("sign").rowsBetween(-_BEFORE, -1))
    left = materialize(rows.withColumn("before", before), "open-postings")
    right = left.select(*[F.col(c).alias(f"o_{c}") for c in left.columns])
    apart = (F.col("cls") < F.col("o_cls")) & (F.col("comp") != F.col("o_comp"))
    first = ~F.arrays_overlap("before", "o_before")
    return left.join(right, (F.col("sign") == F.col("o_sign")) & apart & _can_link(rule, "o_") & first)


def other_pairs(postings: DataFrame, comps: DataFrame, facts: DataFrame, rule: Likeness) -> DataFrame:
    """(a, b): all pairs with a signature in common whose sizes and bitmaps allow a link, in different components."""
    pairs = _meetings(_open(postings, comps).join(facts, "cls"), rule)
    return materialize(pairs.select(F.col("cls").alias("a"), F.col("o_cls").alias("b")).distinct(), "other-pairs")


def _marked(ids: DataFrame) -> np.ndarray:
    """A bit table of fixed size with the hashes of all ids."""
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(_MARKS))
    words = ids.select(cell.alias("cell")).select(
        F.expr("cast(cell div 64 as int)").alias("word"), F.expr("shiftleft(1L, cast(cell % 64 as int))").alias("bit")
    )
    table = np.zeros(_MARKS // 64, np.int64)
    for row in words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        table[row["word"]] = row["bits"]
    return table.view(np.uint64)


def class_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, rule: Likeness) -> DataFrame:
    """(cls, shingles) of the wanted classes, built again from the texts. The table is written.

    A bit table of fixed size lets tasks pass over most other documents, the join does the rest.
    """
    ids = classes.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    marks = _marked(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_parts(batches):
            cell = batch.column("cell").to_numpy()
            hit = (marks[cell // 64] >> (cell % 64).astype(np.uint64)) & np.uint64(1) == 1
            sets = shingle_hashes(texts.filter(pa.array(hit)), rule.shingle)
            lists = pa.array([signed(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([_class_array(sets), lists], ["cls", "shingles"])

    cell = F.pmod(F.xxhash64("doc_id"), F.lit(_MARKS)).alias("cell")
    sets = docs.select(cell, plain_text().alias("text")).mapInArrow(run, "cls long, shingles array<long>")
    return materialize(sets.join(wanted, "cls", "left_semi").dropDuplicates(["cls"]), "class-sets")


def _folded(x: str, y: str) -> Column:
    """The bitmap ``x``, folded once if it is longer than ``y``."""
    half = f"cast(size({x}) / 2 as int)"
    return F.expr(
        f"if(size({x}) > size({y}), zip_with(slice({x}, 1, {half}), slice({x}, {half} + 1, {half}), (i, j) -> i ^ j), {x})"
    )


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, rule: Likeness) -> DataFrame:
    """The pairs whose whole sets link. The table is written.

    Long bitmaps, a sixteenth of a set or less, rule out most of the pairs that don't link; only the
    sets of the others move.
    """
    bits = classes.join(_members(pairs), "cls", "left_semi").select("cls", "n_shingles", "bits").dropDuplicates(["cls"])
    bits = materialize(bits, "long-bitmaps")
    both = pairs.join(bits.select(F.col("cls").alias("a"), F.col("n_shingles").alias("na"), F.col("bits").alias("x")), "a")
    both = both.join(bits.select(F.col("cls").alias("b"), F.col("n_shingles").alias("nb"), F.col("bits").alias("y")), "b")
    both = both.select("a", "b", "na", "nb", _folded("x", "y").alias("x"), _folded("y", "x").alias("y"))
    apart = F.expr("aggregate(zip_with(x, y, (i, j) -> bit_count(i ^ j)), 0, (s, n) -> s + n)")
    near = both.filter(F.lit(rule.whole + rule.part) * apart <= F.lit(rule.whole - rule.part) * (F.col("na") + F.col("nb")))
    near = materialize(near.select("a", "b"), "near-pairs")
    sets = class_sets(docs, classes, _members(near), rule)
    both = near.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a")
    both = both.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return materialize(both.filter(F.lit(rule.whole) * common >= F.lit(rule.part) * union).select("a", "b"), "linked-pairs")


def class_components(docs: DataFrame, classes: DataFrame, rule: Likeness) -> DataFrame:
    """(cls, comp) of all classes that link with another one.

    Turns with pivots join the bulk of each group of near copies, a few pairs for each class, for as
    long as they add enough links; each turn has other pivots, and leaves out what is joined. Then every
    pair with a common signature that isn't in one component already is verified, unless its bitmaps rule
    a link out, so no link that matters is left out.
    """
    postings, facts = shared_postings(classes), _class_facts(classes)
    links = postings.select(F.col("cls").alias("a"), F.col("cls").alias("b")).limit(0)
    comps = links.select(F.col("a").alias("cls"), F.col("b").alias("comp"))
    known = 0
    for turn in range(_TURNS):
        pairs = pivot_pairs(postings, comps, facts, rule, turn)
        linked = verified(docs, classes, pairs, rule)
        links = links.union(linked)
        comps = components(links)
        found = linked.count()
        known += found
        if found <= _WORTH * known:
            break
    return components(links.union(verified(docs, classes, other_pairs(postings, comps, facts, rule), rule)))


def _members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(cls, comp): for each class with a link the smallest class that it reaches.

    Each round takes the smallest component among the neighbours and then that component's own,
    so labels travel twice as far in every round. Rounds are written tables; aggregates combine
    before the shuffle, so a class with very many links is no bottleneck.
    """
    both = links.select(F.col("a").alias("cls"), F.col("b").alias("other")).union(links.select("b", "a"))
    labels = materialize(both.groupBy("cls").agg(F.least(F.col("cls"), F.min("other")).alias("comp")), "components")
    while True:
        seen = both.join(labels.select(F.col("cls").alias("other"), "comp"), "other").groupBy("cls").agg(F.min("comp").alias("near"))
        step = labels.join(seen, "cls").select("cls", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("cls").alias("comp"), F.col("comp").alias("far"))
        step = step.join(jump, "comp", "left").select("cls", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp"))
        step = materialize(step, "components")
        labels = step.select("cls", "comp")
        if step.filter("comp <> old").isEmpty():
            return labels


def join_documents(docs: DataFrame, rule: Likeness | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_copies, text_hash`` for each row of ``docs``.

    Words are runs without ASCII white space, A-Z lower-cased. Equal sets form one class, whatever
    the number of copies; classes are joined, and links are verified exactly on whole sets.
    ``component_id`` is the smallest ``doc_id`` reachable by links, the row's own included;
    ``n_copies`` counts the rows with the same set.

    Null, empty and blank texts have no shingles and their own id as component. Repeated
    rows link with one another. Null ids count as larger than any; a component of null ids only
    has a null id. Other columns are ignored. Sets are compared by 64-bit shingle hashes.
    """
    rule = rule or Likeness()
    if 5 * rule.part < 4 * rule.whole:
        raise ValueError("pairs of neighbouring shingles need a threshold of 0.8 or more")
    rows = shingle_classes(docs, rule)
    comps = class_components(docs, rows, rule)
    classes = rows.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    smallest = comps.join(classes, "cls").groupBy("comp").agg(F.min("least").alias("smallest"))
    found = classes.join(comps.join(smallest, "comp").drop("comp"), "cls", "left")
    found = found.select("cls", F.coalesce("smallest", "least").alias("component"), "copies")
    joined = rows.select("doc_id", "text_hash", "n_shingles", "cls").join(found, "cls", "left")
    return joined.select(
        "doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"), "text_hash",
    )


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3
    THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), comps AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
), copies AS (SELECT doc_id, count(*) OVER (PARTITION BY n, list) AS n_copies FROM (
  SELECT doc_id, count(*) AS n, list_sort(list(s)) AS list FROM shingles GROUP BY doc_id))
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id, coalesce(g.n_copies, 1)::BIGINT AS n_copies
FROM documents d JOIN comps c USING (doc_id) LEFT JOIN sizes s USING (doc_id) LEFT JOIN copies g USING (doc_id)
"""
