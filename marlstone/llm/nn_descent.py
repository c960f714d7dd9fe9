"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries walk it greedily."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import discard, materialize


@dataclass(frozen=True)
class Search:
    neighbours: int = 40  # of a node in the graph, and as many that point to it
    gain: float = 0.001  # a round that changes a smaller part of the graph's edges is the last
    cell: int = 1024  # nodes compared with one another at the start, four times with other cells
    block: int = 4096  # nodes whose best edges are merged in one task
    beam: int = 128  # best nodes a query keeps
    width: int = 32  # nodes a query opens in a step
    tasks: int = 8  # blocks of nodes that are compared, and parts of queries that walk, while a task can hold all vectors
    held: int = 320_000  # vectors that such a task holds at most; with more, blocks and parts have a fixed size
    starts: int = 64  # nodes a query begins at among vectors of other lengths
    seed: int = 11


def clean_vectors(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(id, vec): rows with a usable vector of the table's usual dimension, as doubles.

    Null vectors and ids, vectors with null or non-finite components and zero vectors take no part,
    nor do vectors of another dimension than most (of the largest one, if several are as common).
    """
    vec = F.col(column).cast("array<double>")
    good = rows.select(F.col(key).cast("long").alias("id"), vec.alias("vec")).filter(
        "id is not null and vec is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) "
        "and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)"
    )
    usual = good.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return good.filter(F.size("vec") == (usual["dim"] if usual else 0))


def distinct_nodes(vectors: DataFrame, copies: int) -> DataFrame:
    """(node, vec, ids): one row for each vector, with its ``copies`` smallest ids. The table is written.

    More ids of one vector can't be among a query's nearest, as equal scores go to smaller ids.
    """
    keyed = vectors.select(F.xxhash64("vec").alias("node"), "vec", "id").repartition("node").dropDuplicates(["node", "id"])
    place = F.row_number().over(Window.partitionBy("node").orderBy("id"))
    few = keyed.withColumn("place", place).filter(F.col("place") <= copies)
    return materialize(few.groupBy("node").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("id")).alias("ids")), "nn-nodes")


def dot(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)")


def _packed(nodes: DataFrame) -> DataFrame:
    """(node, band, code): floats of each vector and of the component that makes all norms of its band equal.

    With it, larger inner products are smaller distances, which graph search needs. Norms in a band
    differ by less than a factor of two, so a long vector leaves the codes of others as they are.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            top = np.abs(rows).max(1)
            rows = rows / top[:, None]
            norm = np.sqrt((rows * rows).sum(1))
            height = np.log2(top) + np.log2(norm)
            band = np.floor(height + 0.5)
            size = np.exp2(height - band - 0.5)
            more = np.sqrt(np.maximum(0, 1 - size * size))
            codes = np.concatenate((rows * (size / norm)[:, None], more[:, None]), 1).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(band.astype(np.int64)), pa.array([c.tobytes() for c in codes], pa.binary())], ["node", "band", "code"]
            )

    return materialize(nodes.select("node", "vec").mapInArrow(pack, "node long, band long, code binary"), "nn-codes")


_FOUND = "node long, others array<long>, sims array<float>"


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """Codes as rows of floats."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a column of lists, and each list's length."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, kind))


def _leading(at: np.ndarray, other: np.ndarray, sim: np.ndarray, late: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` most similar different others of each ``at``, in this order; of equal pairs those not late."""
    order = np.lexsort((late, other, at))
    own, its = at[order], other[order]
    order = order[np.concatenate(([True], (own[1:] != own[:-1]) | (its[1:] != its[:-1])))] if len(order) else order
    # Similarities lie between -1 and 1, so that they fit below the node in one key; others are in order already.
    order = order[np.argsort((at[order].astype(np.int64) << 32) | ((2.0 - sim[order].astype(np.float64)) * (1 << 29)).astype(np.int64), kind="stable")]
    own = at[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate((first, [len(own)])))
    return order[np.arange(len(own)) - np.repeat(first, sizes) < k]


def _found(ids: np.ndarray, at: np.ndarray, other: np.ndarray, sim: np.ndarray) -> pa.Table:
    """Rows of _FOUND from edges in the order of their nodes; ``at`` and ``other`` are positions in ``ids``."""
    own, sizes = np.unique(at, return_counts=True)
    return pa.table({"node": pa.array(ids[own], pa.int64()), "others": _lists(ids[other], sizes, pa.int64()), "sims": _lists(sim, sizes, pa.float32())})


def _placed(codes: DataFrame, size: int, turns: int, rule: Search) -> DataFrame:
    """``codes`` with cell and part, once a turn: nodes of a band on the same sides of some random planes, about ``size``.

    A cell with more nodes is cut by a hash into parts of that size.
    """
    bits = {r["band"]: max(0, int(np.ceil(np.log2(r["count"] / size)))) for r in codes.groupBy("band").count().collect()}
    most = max(bits.values(), default=0)

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows(batch.column("code"))[:, :-1].astype(np.float64)
            used = np.arange(most) < np.array([bits[x] for x in batch.column("band").to_pylist()])[:, None]
            for turn in range(turns):
                planes = np.random.default_rng((rule.seed, turn)).normal(size=(rows.shape[1], most))
                signs = ((rows @ planes > 0) & used) @ (1 << np.arange(most)) if most else np.zeros(len(rows), np.int64)
                cell = pa.array(signs.astype(np.int64) * turns + turn)
                yield pa.RecordBatch.from_arrays([*batch.columns, cell], ["node", "band", "code", "cell"])

    placed = codes.select("node", "band", "code").mapInArrow(sides, "node long, band long, code binary, cell long")
    counts = placed.groupBy("band", "cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    placed = placed.join(counts, ["band", "cell"])
    return placed.withColumn("part", F.pmod(F.xxhash64("node", "cell"), F.col("parts"))).drop("parts")


def _merged(found: DataFrame, nodes: int, rule: Search) -> DataFrame:
    """(node, others, sims, fresh): each node's best edges, most similar first. ``found`` has _FOUND and fresh.

    An edge is ``fresh`` if no graph before had it.
    """

    def run(rows: pa.Table) -> pa.Table:
        other, sizes = _flat(rows.column("others"))
        sim = _flat(rows.column("sims"))[0]
        ids, at = np.unique(np.repeat(rows.column("node").to_numpy(), sizes), return_inverse=True)
        fresh = np.repeat(rows.column("fresh").to_numpy(zero_copy_only=False), sizes)
        best = _leading(at, other, sim, fresh, rule.neighbours)
        own, counts = np.unique(at[best], return_counts=True)
        return pa.table({
            "node": pa.array(ids[own], pa.int64()), "others": _lists(other[best], counts, pa.int64()),
            "sims": _lists(sim[best], counts, pa.float32()), "fresh": _lists(fresh[best], counts, pa.bool_()),
        })

    parts = max(1, int(np.ceil(nodes / rule.block)))
    grouped = found.withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(parts))).groupBy("part")
    own = grouped.applyInArrow(run, f"{_FOUND}, fresh array<boolean>")
    return materialize(own, "nn-graph")


def _first_graph(codes: DataFrame, nodes: int, rule: Search) -> DataFrame:
    """Each node's best in four cells of nodes of its band on the same sides of some random planes."""

    def run(rows: pa.Table) -> pa.Table:
        ids, code = rows.column("node").to_numpy(), _rows(rows.column("code"))
        sims = code @ code.T
        np.fill_diagonal(sims, -9)
        k = min(rule.neighbours, len(ids) - 1)
        if not k:
            return _found(ids, *np.zeros((3, 0), np.int64))
        other = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        return _found(ids, np.repeat(np.arange(len(ids)), k), other.ravel(), np.take_along_axis(sims, other, 1).ravel())

    cells = _placed(codes, rule.cell, 4, rule).groupBy("band", "cell", "part")
    return _merged(cells.applyInArrow(run, _FOUND).withColumn("fresh", F.lit(True)), nodes, rule)


# Pairs that a block holds before it keeps only the best of each node.
_PAIRS = 2_000_000


def _compared(hubs: DataFrame, members: DataFrame, keep: int) -> DataFrame:
    """The best ``keep`` others of each node among those that some hub of a block brings together with it: rows of _FOUND.

    ``hubs`` is (block, news, olds), lists of bounded length, and ``members`` (block, node, code, bar). Pairs
    without a new member were compared before. Only others above a node's bar are returned.
    """

    def run(lists: pa.Table, rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("node").to_numpy())
        ids, code = rows.column("node").to_numpy()[order], _rows(rows.column("code"))[order]
        bars = np.maximum(rows.column("bar").to_numpy()[order], -5).astype(np.float32)
        (news, n_new), (olds, n_old) = _flat(lists.column("news")), _flat(lists.column("olds"))
        news, olds = np.searchsorted(ids, news), np.searchsorted(ids, olds)
        from_new, from_old = np.cumsum(n_new) - n_new, np.cumsum(n_old) - n_old
        sizes = n_new + n_old
        most = int(sizes.max(initial=0))
        step = max(1, _PAIRS // 4 // max(1, most * most))
        held, count = [], 0

        def best() -> list:
            at, other, sim = (np.concatenate(x) for x in zip(*held, strict=True))
            chosen = _leading(at, other, sim, np.zeros(len(at), bool), keep)
            at, other, sim = at[chosen], other[chosen], sim[chosen]
            own, first, counts = np.unique(at, return_index=True, return_counts=True)
            full = counts == keep
            bars[own[full]] = np.maximum(bars[own[full]], sim[(first + counts - 1)[full]])
            return [(at, other, sim)]

        place = np.arange(most)
        for start in range(0, len(sizes), step):
            part = slice(start, start + step)
            new, real = place < n_new[part, None], place < sizes[part, None]
            index = np.zeros(real.shape, np.int64)
            index[new] = news[(from_new[part, None] + place)[new]]
            old = real & ~new
            index[old] = olds[(from_old[part, None] + place - n_new[part, None])[old]]
            block = code[index]
            sims = block @ block.transpose(0, 2, 1)
            good = sims > bars[index][:, :, None]
            good &= (real[:, :, None] & real[:, None, :]) & (new[:, :, None] | new[:, None, :])
            good[:, place, place] = False
            g, i, j = np.nonzero(good)
            held.append((index[g, i], index[g, j], sims[g, i, j]))
            count += len(g)
            if count > _PAIRS:
                held = best()
                count = len(held[0][0])
        if not held:
            return _found(ids, *np.zeros((3, 0), np.int64))
        return _found(ids, *best()[0])

    # The key has another name on one side, as both sides come from the same table.
    members = members.select(F.col("block").alias("to_block"), "node", "code", "bar")
    return hubs.groupBy("block").cogroup(members.groupBy("to_block")).applyInArrow(run, _FOUND)


def _edges(graph: DataFrame) -> DataFrame:
    """(node, other, sim): a graph's lists as rows."""
    pairs = graph.select("node", F.explode(F.arrays_zip("others", "sims")).alias("x"))
    return pairs.select("node", F.col("x.others").alias("other"), F.col("x.sims").alias("sim"))


def _best(edges: DataFrame, by: str, k: int) -> DataFrame:
    """The k edges of most similarity at each node."""
    order = Window.partitionBy(by).orderBy(F.desc("sim"), "node", "other")
    return edges.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _brought(graph: DataFrame, met: DataFrame | None, rule: Search) -> DataFrame:
    """(node, news, olds): whom each node brings together, its neighbours and some that point to it; ``met`` is from the round before."""
    back = _best(_edges(graph), "other", rule.neighbours).groupBy(F.col("other").alias("node")).agg(F.collect_list("node").alias("back"))
    none = F.array().cast("array<long>")
    now = graph.select("node", "others").join(back, "node", "full")
    now = now.select("node", F.array_union(F.coalesce("others", none), F.coalesce("back", none)).alias("all"))
    if met is None:
        return now.select("node", F.col("all").alias("news"), none.alias("olds"))
    known = F.coalesce("met", none)
    now = now.join(met.select("node", F.concat("news", "olds").alias("met")), "node", "left")
    return now.select("node", F.array_except("all", known).alias("news"), F.array_intersect("all", known).alias("olds"))


def neighbour_graph(codes: DataFrame, rule: Search) -> DataFrame:
    """(node, others, sims, fresh): NN-descent, until a round changes hardly any edge.

    In each round a node brings together its neighbours and some that point to it; these are
    compared with one another, and each takes over those that are better than its worst one. A
    node gathers at most twice ``neighbours`` others, whatever the number that point to it. Pairs
    that it brought together before are left out.

    Nodes of a cell do so in one task, so a vector moves once to a block of nodes, not to each of them, and
    the task returns lists of what is best there, not pairs.
    """
    count = codes.count()
    graph, met = _first_graph(codes, count, rule), None
    size = count / rule.tasks if count <= rule.held else rule.held // (2 * rule.neighbours)
    blocks = _placed(codes, max(1, int(np.ceil(size))), 1, rule).select("node", F.xxhash64("band", "cell", "part").alias("block"))
    blocks = materialize(blocks, "nn-blocks")
    while True:
        lists = materialize(_brought(graph, met, rule), "nn-members")
        hubs = lists.filter("size(news) > 0").join(blocks, "node").select("block", "news", "olds")
        bar = F.when(F.size("sims") >= rule.neighbours, F.element_at("sims", -1)).otherwise(F.lit(-5.0)).cast("float")
        member = codes.select("node", "code").join(graph.select("node", bar.alias("bar")), "node", "left")
        member = member.withColumn("bar", F.coalesce("bar", F.lit(-5.0).cast("float")))
        wanted = hubs.select("block", F.explode(F.concat("news", "olds")).alias("node")).distinct()
        found = _compared(hubs, wanted.join(member, "node").select("block", "node", "code", "bar"), rule.neighbours)
        kept = graph.select("node", "others", "sims", F.lit(False).alias("fresh"))
        last, gone = graph, met
        graph, met = _merged(found.withColumn("fresh", F.lit(True)).union(kept), count, rule), lists
        for old in (last, gone):
            if old is not None:
                discard(old)
        edges, changed = graph.agg(F.sum(F.size("others")), F.sum(F.size(F.filter("fresh", lambda x: x)))).first()
        if (changed or 0) <= rule.gain * (edges or 0):
            return graph


def links(graph: DataFrame, codes: DataFrame, rule: Search) -> DataFrame:
    """(node, others): the graph in both directions, at most twice ``neighbours`` at a node, and random links.

    The random ones let a walk leave a group of nodes that only know one another. All stay in a band.
    """
    edges = _edges(graph)
    there = edges.select("node", "other")
    back = _best(edges, "other", rule.neighbours).select(F.col("other").alias("node"), F.col("node").alias("other"))
    # Bands are exponents of doubles, so at most some thousands.
    cells = F.broadcast(codes.groupBy("band").agg(F.greatest(F.lit(1), F.expr("count(*) div 4")).alias("cells")))
    placed = codes.select("node", "band").join(cells, "band")
    near = placed.select("node", "band", F.expr("pmod(xxhash64(node, 1), cells)").alias("cell"))
    far = placed.select(F.col("node").alias("other"), "band", F.expr("pmod(xxhash64(node, 2), cells)").alias("cell"))
    random = near.join(far, ["band", "cell"]).select("node", "other")
    both = there.union(back).union(random).filter("node <> other")
    return materialize(both.groupBy("node").agg(F.collect_set("other").alias("others")), "nn-links")


_BEAM = "query long, band long, part long, code binary, nodes array<long>, scores array<float>, opened array<boolean>, ahead array<long>"


def greedy_search(queries: DataFrame, codes: DataFrame, edges: DataFrame, rule: Search) -> DataFrame:
    """(query, band, nodes, scores): the best ``beam`` nodes of each band that a walk over the links finds for each query, best first.

    ``queries`` has query, band, its code and the nodes to begin at (ahead). In a step each query opens its best
    nodes not yet opened, scores the nodes linked to them and keeps the best. Queries of a part walk in one
    task, so links and codes move once to a part. The walk ends when all best nodes of all queries are open.
    Scores are inner products of codes, for one query and band in proportion to those of the vectors.
    """
    parts = rule.tasks
    if codes.count() > rule.held:
        # A query opens ``width`` nodes in a step, each with its neighbours in both directions and a few random links.
        parts = max(parts, int(np.ceil(queries.select("query").distinct().count() * rule.width * 2 * (rule.neighbours + 4) / rule.held)))
    keys = ["band", "part"]

    def step(beams: pa.Table, rows: pa.Table) -> pa.Table:
        linked = rows.filter(pc.is_valid(rows.column("others")))
        coded = rows.filter(pc.is_valid(rows.column("code")))
        hub = linked.column("node").to_numpy()
        by_hub = np.argsort(hub)
        hub = hub[by_hub]
        others, sizes = _flat(linked.column("others"))
        begins = np.cumsum(sizes) - sizes
        ids = coded.column("node").to_numpy()
        by_id = np.argsort(ids)
        ids = ids[by_id]
        code = _rows(coded.column("code"))[:, :-1] if len(ids) else None
        own = _rows(beams.column("code"))[:, :-1]
        state = {name: _flat(beams.column(name)) for name in ("nodes", "scores", "opened", "ahead")}
        ends = {name: np.cumsum(sizes) for name, (_, sizes) in state.items()}
        out: dict[str, list] = {"nodes": [], "scores": [], "opened": [], "ahead": []}
        for row in range(len(own)):
            known, score, opened, ahead = (state[name][0][ends[name][row] - state[name][1][row] : ends[name][row]] for name in out)
            if len(ahead):
                at = by_hub[(np.searchsorted(hub, ahead))[np.isin(ahead, hub)]] if len(hub) else np.zeros(0, np.int64)
                near = np.unique(np.concatenate([ahead, *(others[begins[x] : begins[x] + sizes[x]] for x in at)]))
                near = near[~np.isin(near, known)]
                score = np.concatenate((score, code[by_id[np.searchsorted(ids, near)]] @ own[row])).astype(np.float32)
                known = np.concatenate((known, near))
                opened = np.concatenate((opened, np.zeros(len(near), bool))) | np.isin(known, ahead)
                best = np.lexsort((known, -score))[: rule.beam]
                known, score, opened = known[best], score[best], opened[best].astype(bool)
                ahead = known[~opened][: rule.width]
            for name, values in zip(out, (known, score, opened, ahead), strict=True):
                out[name].append(values)
        kinds = {"nodes": pa.int64(), "scores": pa.float32(), "opened": pa.bool_(), "ahead": pa.int64()}
        lists = [_lists(np.concatenate(out[name]), np.array([len(x) for x in out[name]]), kinds[name]) for name in out]
        return pa.table([beams.column(name) for name in ("query", "band", "part", "code")] + lists, names=["query", "band", "part", "code", *out])

    part = F.pmod(F.xxhash64("query"), F.lit(parts)).alias("part")
    empty = [F.array().cast(kind).alias(name) for name, kind in (("nodes", "array<long>"), ("scores", "array<float>"), ("opened", "array<boolean>"))]
    beam = materialize(queries.select("query", "band", part, "code", *empty, "ahead"), "nn-beam")
    there = codes.select("node", "code")
    while not beam.filter("size(ahead) > 0").isEmpty():
        hubs = beam.select(*keys, F.explode("ahead").alias("node")).distinct()
        linked = hubs.join(edges, "node", "left").select(*keys, "node", "others")
        seen = F.explode(F.concat(F.array("node"), F.coalesce("others", F.array().cast("array<long>"))))
        coded = linked.select(*keys, seen.alias("node")).distinct().join(there, "node")
        rows = linked.withColumn("code", F.lit(None).cast("binary")).unionByName(coded.withColumn("others", F.lit(None).cast("array<long>")))
        rows = rows.select(F.col("band").alias("to_band"), F.col("part").alias("to_part"), "node", "others", "code")
        last, beam = beam, materialize(
            beam.groupBy(*keys).cogroup(rows.groupBy("to_band", "to_part")).applyInArrow(step, _BEAM), "nn-beam"
        )
        discard(last)
    return beam.select("query", "band", "nodes", "scores")


def starts(wanted: DataFrame, codes: DataFrame, rule: Search) -> DataFrame:
    """(query, band, code, ahead): where a query's walk begins in each band.

    In its own band that is its own vector, in each other one some nodes that a hash selects.
    """
    own = wanted.join(codes, "node")
    place = F.row_number().over(Window.partitionBy("band").orderBy(F.xxhash64("node"), "node"))
    some = codes.select("node", "band").withColumn("place", place).filter(F.col("place") <= rule.starts)
    some = some.groupBy(F.col("band").alias("far")).agg(F.collect_list("node").alias("some"))
    far = own.crossJoin(F.broadcast(some)).filter("far <> band")
    return own.select("query", "band", "code", F.array("node").alias("ahead")).union(far.select("query", "far", "code", "some"))


def nearest(rows: DataFrame, query_ids: Column, k: int, key: str = "vec_id", column: str = "embedding", rule: Search | None = None) -> DataFrame:
    """The ``k`` rows of largest inner product found for each row whose id fulfils ``query_ids``.

    Returns ``query_id, rank, vec_id, score``, nearest first, equal scores by smaller id; a query isn't
    its own candidate, equal vectors of other rows are. Every usable row is in the graph. Copies of a
    vector are one node. Scores are inner products of the original vectors in double precision.

    Unusable vectors (see :func:`clean_vectors`) take no part. Repeated rows count once. With fewer
    candidates than ``k``, all that the walk reaches. An empty table gives an empty table.
    """
    rule = rule or Search()
    vectors = materialize(clean_vectors(rows, key, column), "nn-vectors")
    nodes = distinct_nodes(vectors, k + 1)
    codes = _packed(nodes)
    edges = links(neighbour_graph(codes, rule), codes, rule)
    wanted = vectors.filter(query_ids).dropDuplicates(["id"])
    wanted = materialize(wanted.select(F.col("id").alias("query"), "vec", F.xxhash64("vec").alias("node")), "nn-queries")
    found = greedy_search(starts(wanted.drop("vec"), codes, rule), codes, edges, rule)
    # Scores of codes are off by less than 0.0001, so no other node of a band can be among the query's k nearest.
    last = F.when(F.size("scores") > k, F.get("scores", F.lit(k))).otherwise(F.lit(-9.0))
    near = found.withColumn("last", last).select(
        "query", F.explode(F.expr("filter(arrays_zip(nodes, scores), x -> x.scores >= last - 0.0001)")).alias("x")
    )
    near = near.select("query", F.col("x.nodes").alias("node")).join(nodes.withColumnRenamed("vec", "there"), "node")
    scored = near.join(wanted.select("query", "vec"), "query").select("query", dot("vec", "there").alias("score"), F.explode("ids").alias("vec_id"))
    hits = scored.filter("vec_id <> query")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return hits.select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
