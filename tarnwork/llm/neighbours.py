"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Rows with the same vector are one node that keeps its least ids, so copies never
fill a graph.  Nodes are dealt out to shards of about ``SHARD`` nodes by a hash
of the vector, which spreads near copies evenly.  A task streams one shard after
the other: it reads the nodes of a shard, builds the graph, then answers the
query blocks that follow, so it holds one shard and one block at a time.

Building adds nodes in batches that grow with the graph.  A greedy beam search
from the entry node proposes neighbours; relaxed pruning goes through them from
near to far and keeps one unless a kept one is closer to it by the factor
``RELAXATION``; the edges are then added backwards and full nodes are pruned
again.  Nodes that no edge reaches get edges from their nearest reachable nodes,
so every row can be found.  Searching keeps a beam of ``BEAM`` nodes and widens
the nearest ones that are not widened yet.  The best nodes of a shard are scored
in double precision on the original vectors, and the best of all shards remain.

Queries are the rows for which ``is_query`` holds, against all rows; equal query
vectors are searched once.  Nearness is the cosine, ties go to the smaller id.
A row is known by its id and vector: rows that repeat both count once; rows with
the same id and other vectors are neighbours of each other.  Rows with a null id
and vectors that are null, zero, non-finite, hold a null, or have another length
than most take no part.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.llm.common import prepare
from tarnwork.llm.whitening import usable, usual_length
from tarnwork.operators.keyed import lookup_join

#: Nodes of a shard (its graph takes about 1 kB a node of 64 entries); queries of a block.
SHARD, BLOCK = 4_000, 1_000
#: Edges of a node; nodes of a beam while building and while searching; nodes widened at once.
DEGREE, BUILD_BEAM, BEAM, WIDTH = 32, 64, 128, 4
RELAXATION = 1.2
#: Largest batch of insertions or queries.
BATCH = 256


# ---- the graph of one shard --------------------------------------------------


def _beam_search(unit: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (-1: none) and cosines of the beams of some queries, nearest first."""
    m, n = len(queries), len(unit)
    nodes = np.full((m, beam), -1, np.int64)
    near = np.full((m, beam), -np.inf)
    widened = np.ones((m, beam), bool)
    seen = np.zeros((m, n + 1), bool)
    seen[:, -1] = True  # what -1 stands for
    nodes[:, 0], near[:, 0], widened[:, 0] = entry, queries @ unit[entry], False
    seen[:, entry] = True
    rows = np.arange(m)
    while len(rows):
        # The first WIDTH nodes of each beam that are not widened yet.
        first = np.argsort(widened[rows], axis=1, kind="stable")[:, :WIDTH]
        fresh = ~np.take_along_axis(widened[rows], first, 1)
        going = fresh.any(axis=1)
        rows, first, fresh = rows[going], first[going], fresh[going]
        if not len(rows):
            break
        at = np.where(fresh, np.take_along_axis(nodes[rows], first, 1), n)
        widened[rows[:, None], first] = True
        out = edges[at].reshape(len(rows), -1)
        out = np.where(seen[rows[:, None], out], -1, out)
        out.sort(axis=1)
        out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
        k, _ = (found := np.nonzero(out >= 0))
        values = np.full(out.shape, -np.inf)
        values[found] = np.einsum("ij,ij->i", queries[rows[k]], unit[out[found]])
        seen[rows[:, None], out] = True
        all_near = np.concatenate([near[rows], values], axis=1)
        best = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        near[rows] = np.take_along_axis(all_near, best, 1)
        nodes[rows] = np.take_along_axis(np.concatenate([nodes[rows], out], axis=1), best, 1)
        closed = np.concatenate([widened[rows], out < 0], axis=1)
        widened[rows] = np.take_along_axis(closed, best, 1)
    return nodes, near


def robust_prune(unit: np.ndarray, own: np.ndarray, options: np.ndarray) -> np.ndarray:
    """DEGREE neighbours (-1: none) for each of ``own`` from the rows of ``options`` (-1: none), nearest first."""
    options = np.where(options == own[:, None], -1, options)
    options = np.sort(options, axis=1)
    options[:, 1:][options[:, 1:] == options[:, :-1]] = -1
    near = np.where(options >= 0, np.einsum("ijk,ik->ij", unit[options], unit[own]), -np.inf)
    order = np.argsort(-near, axis=1, kind="stable")
    options, near = np.take_along_axis(options, order, 1), np.take_along_axis(near, order, 1)
    filled = int((options >= 0).sum(axis=1).max(initial=0))
    options, near = options[:, :filled], near[:, :filled]
    vectors = unit[options]
    apart = 2 - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    away = 2 - 2 * near
    alive = options >= 0
    kept = np.full((len(own), DEGREE), -1, np.int64)
    count = np.zeros(len(own), np.int64)
    for k in range(filled):
        take = np.flatnonzero(alive[:, k] & (count < DEGREE))
        kept[take, count[take]] = options[take, k]
        count[take] += 1
        # Squared distances, so the factor is squared as well.
        alive[take] &= RELAXATION**2 * apart[take, k] > away[take]
    return kept


def _put_backwards(unit: np.ndarray, edges: np.ndarray, sources: np.ndarray, targets: np.ndarray) -> None:
    """Adds the edges target -> source; nodes that are full are pruned again."""
    while len(targets):
        order = np.lexsort((sources, targets))
        sources, targets = sources[order], targets[order]
        starts = np.flatnonzero(np.concatenate([[True], targets[1:] != targets[:-1]]))
        place = np.arange(len(targets)) - np.repeat(starts, np.diff(np.append(starts, len(targets))))
        now = place < DEGREE  # the rest of a much wanted node comes in the next turn
        owners = targets[starts]
        options = np.full((len(owners), 2 * DEGREE), -1, np.int64)
        options[:, :DEGREE] = edges[owners]
        options[np.repeat(np.arange(len(owners)), np.diff(np.append(starts, len(targets))))[now], DEGREE + place[now]] = sources[now]
        room = np.sort(np.where(options < 0, np.iinfo(np.int64).max, options), axis=1)
        room[:, 1:][room[:, 1:] == room[:, :-1]] = np.iinfo(np.int64).max
        room.sort(axis=1)
        fits = room[:, DEGREE] == np.iinfo(np.int64).max
        edges[owners[fits]] = np.where(room[fits, :DEGREE] == np.iinfo(np.int64).max, -1, room[fits, :DEGREE])
        full = np.flatnonzero(~fits)
        for at in range(0, len(full), BATCH):
            part = full[at : at + BATCH]
            edges[owners[part]] = robust_prune(unit, owners[part], options[part])
        sources, targets = sources[~now], targets[~now]


def _reached(edges: np.ndarray, entry: int) -> np.ndarray:
    n = len(edges) - 1
    reached = np.zeros(n + 1, bool)
    reached[entry] = True
    front = np.array([entry])
    while len(front):
        out = np.unique(edges[front])
        front = out[(out >= 0) & ~reached[out]]
        reached[front] = True
    return reached[:n]


def build(unit: np.ndarray) -> tuple[np.ndarray, int]:
    """(edges, entry): DEGREE out-neighbours a node (-1: none; the last row belongs to no node), all nodes reachable."""
    n = len(unit)
    edges = np.full((n + 1, DEGREE), -1, np.int64)
    entry = int(np.argmax(unit @ unit.mean(axis=0)))
    rest = np.random.default_rng(n).permutation(n)
    rest = rest[rest != entry]
    done = 0
    while done < len(rest):
        part = rest[done : done + max(1, min(BATCH, (done + 1) // 8))]
        done += len(part)
        beams, _ = _beam_search(unit, edges, entry, unit[part], BUILD_BEAM)
        edges[part] = robust_prune(unit, part, beams)
        a, b = np.nonzero(edges[part] >= 0)
        _put_backwards(unit, edges, part[a], edges[part][a, b])
    while not (reached := _reached(edges, entry)).all():
        # Pruning took the last way to some nodes: their nearest reachable node gives up its farthest edge but one.
        lost = np.flatnonzero(~reached)[:BATCH]
        beams, _ = _beam_search(unit, edges, entry, unit[lost], BUILD_BEAM)
        for node, beam in zip(lost, beams, strict=True):
            _connect(edges, int(node), beam[beam >= 0], reached)
    return edges, entry


def _connect(edges: np.ndarray, node: int, beam: np.ndarray, reached: np.ndarray) -> None:
    """An edge to the node from the first node of its beam with room, or in a chain behind the nearest one."""
    for other in beam:
        free = np.flatnonzero(edges[other] < 0)
        if len(free):
            edges[other, free[0]] = node
            return
    nearest = beam[0]
    old = edges[nearest, -1]
    edges[nearest, -1] = node
    free = np.flatnonzero(edges[node] < 0)
    edges[node, free[0] if len(free) else -1] = old


def search(unit: np.ndarray, graph: tuple[np.ndarray, int], queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Nodes (-1: none) found for unit vectors, nearest first."""
    edges, entry = graph
    parts = [_beam_search(unit, edges, entry, queries[at : at + BATCH], beam)[0] for at in range(0, len(queries), BATCH)]
    return np.concatenate(parts) if parts else np.full((0, beam), -1)


# ---- all shards --------------------------------------------------------------


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths, also for entries whose squares leave the range of a double."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / largest
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None], largest[:, 0]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of two lists of vectors, row by row, in double precision."""
    a = a / np.abs(a).max(axis=1, keepdims=True)
    b = b / np.abs(b).max(axis=1, keepdims=True)
    dots, aa, bb = (np.einsum("ij,ij->i", x, y) for x, y in ((a, b), (a, a), (b, b)))
    return np.clip(dots / np.sqrt(aa * bb), -1.0, 1.0)


def _searcher(length: int, best: int):
    """Streams (shard, tag, k1, k2, vector) rows sorted by shard and tag: nodes have tag 0, queries tag 1."""

    def answered(nodes: np.ndarray, unit: np.ndarray, graph, keys: np.ndarray, block: np.ndarray, query_keys: np.ndarray) -> pa.RecordBatch:
        found = search(unit, graph, _units(block)[0])
        query, _ = np.nonzero(found >= 0)
        node = found[found >= 0]
        score = cosines(block[query], nodes[node])
        order = np.lexsort((-score, query))
        query, node, score = query[order], node[order], score[order]
        starts = np.searchsorted(query, np.arange(len(block)))
        top = np.arange(len(query)) - starts[query] < best
        query, node, score = query[top], node[top], score[top]
        arrays = [query_keys[query, 0], query_keys[query, 1], keys[node, 0], keys[node, 1]]
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in arrays), pa.array(score)], names=["q1", "q2", "k1", "k2", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, held_keys, block, block_keys, index = None, [], [], [], [], None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, block_keys, index
            if block and held:
                if index is None:
                    nodes = np.concatenate(held)
                    unit = _units(nodes)[0]
                    index = (nodes, unit, build(unit), np.concatenate(held_keys))
                nodes, unit, graph, keys = index
                yield answered(nodes, unit, graph, keys, np.concatenate(block), np.concatenate(block_keys))
            block, block_keys = [], []

        for batch in batches:
            shards, tags = (batch.column(k).to_numpy() for k in (0, 1))
            keys = np.stack([batch.column(k).to_numpy() for k in (2, 3)], axis=1)
            vectors = _matrix(batch.column(4), length)
            changes = np.flatnonzero(np.concatenate([[True], (shards[1:] != shards[:-1]) | (tags[1:] != tags[:-1])]))
            for start, end in zip(changes, [*changes[1:], len(shards)], strict=True):
                if shards[start] != shard:
                    yield from flush()
                    shard, held, held_keys, index = shards[start], [], [], None
                if tags[start] == 0:
                    held.append(vectors[start:end])
                    held_keys.append(keys[start:end])
                    continue
                block.append(vectors[start:end])
                block_keys.append(keys[start:end])
                if sum(map(len, block)) >= BLOCK:
                    yield from flush()
        yield from flush()

    return run


def nearest(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", column: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, nearest first."""
    spark = prepare(df.sparkSession)
    length = usual_length(df, column)
    asked = is_query & F.col(f"`{key}`").isNotNull()
    rows = usable(df.where(f"`{key}` IS NOT NULL").withColumn("__asked", asked), column, max(length, 1))
    rows = rows.where(F.exists(F.col(column).cast("array<double>"), lambda x: x != 0))
    vector = F.col(column).cast("array<double>")
    rows = rows.select(F.col(f"`{key}`").alias("id"), vector.alias("vector"), F.coalesce("__asked", F.lit(False)).alias("asked"))
    rows = rows.withColumns({"k1": F.xxhash64("vector"), "k2": F.xxhash64(F.lit("second"), "vector")})
    # One row per id and vector; then the k + 1 least ids of each vector, reduced in the map tasks.
    members = rows.groupBy("k1", "k2", "id").agg(F.first("vector").alias("vector"), F.max("asked").alias("asked"))
    own = Window.partitionBy("k1", "k2").orderBy("id")
    least = members.withColumn("__n", F.row_number().over(own)).where(F.col("__n") <= k + 1)
    classes = least.groupBy("k1", "k2").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("id")).alias("ids"))
    questions = members.where("asked").select("k1", "k2", F.col("id").alias("query_id"))

    n = classes.count()
    shards = max(1, -(-n // shard))
    spread = F.pmod(F.xxhash64("k1", "k2"), F.lit(shards)).cast("int")
    nodes = classes.select(spread.alias("shard"), F.lit(0).alias("tag"), "k1", "k2", "vector")
    asking = rows.where("asked").groupBy("k1", "k2").agg(F.first("vector").alias("vector"))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    asking = asking.select(every, F.lit(1).alias("tag"), "k1", "k2", "vector")
    stream = nodes.unionByName(asking).repartition(shards, "shard").sortWithinPartitions("shard", "tag", "k1", "k2")
    found = stream.mapInArrow(_searcher(max(length, 1), k + 1), "q1 long, q2 long, k1 long, k2 long, score double")

    # The best k + 1 ids of a query vector, its own included; then each query row leaves itself out.
    by_query = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "least", "k1", "k2")
    named = lookup_join(found, classes.select("k1", "k2", "ids", F.element_at("ids", 1).alias("least")), ["k1", "k2"], "inner")
    near = named.withColumn("__n", F.row_number().over(by_query)).where(F.col("__n") <= k + 1)
    item = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("vec_id"), F.col("k1").alias("k1"), F.col("k2").alias("k2")))
    lists = near.select("q1", "q2", F.explode(item).alias("item")).groupBy("q1", "q2").agg(F.sort_array(F.collect_list("item")).alias("items"))
    lists = lists.select(F.col("q1").alias("k1"), F.col("q2").alias("k2"), F.slice("items", 1, k + 1).alias("items"))
    mine = lambda x: (x["vec_id"] == F.col("query_id")) & (x["k1"] == F.col("k1")) & (x["k2"] == F.col("k2"))
    others = F.slice(F.filter("items", lambda x: ~mine(x)), 1, k)
    answers = lookup_join(questions, lists, ["k1", "k2"], "inner").select("query_id", F.posexplode(others).alias("at", "item"))
    return answers.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "item.vec_id", (-F.col("item.far")).alias("score")
    )
