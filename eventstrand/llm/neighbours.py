"""Approximate nearest neighbours by cosine: sharded, robustly pruned directed graphs and beam search."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from eventstrand.llm.common import Scratch

# Shards grow with the table between these, so that queries meet about SHARDS of them up to 16 million rows.
SHARD_ROWS, MOST_SHARD_ROWS, SHARDS = 8_192, 131_072, 128
QUERIES_AT_ONCE = 256
DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAXATION = 32, 64, 128, 1.2
# Vectors whose unit vectors agree in so many decimals are one point of a graph.
DIRECTION_DECIMALS = 7
_INDEX = "shard int, n int, members array<int>, ids array<long>, vectors binary, graph binary"


def beam_search(
    points: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: int, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """Best ``beam`` points met per query and their dot products, best first; -1 fills up.

    All queries walk in step: each expands its best unexpanded point until none is left in its beam.
    """
    q, n = len(queries), len(points)
    ids = np.full((q, beam), -1)
    ids[:, 0] = entry
    scores = np.full((q, beam), -np.inf)
    scores[:, 0] = queries @ points[entry]
    done = np.ones((q, beam), bool)
    done[:, 0] = False
    met = np.zeros((q, n + 1), bool)  # the last column takes the fill of short neighbour lists
    met[:, entry] = met[:, n] = True
    active = np.arange(q)
    while len(active):
        first = np.argmin(done[active], axis=1)
        active = active[~done[active, first]]
        if not len(active):
            break
        first = np.argmin(done[active], axis=1)
        done[active, first] = True
        near = graph[ids[active, first]]
        fresh = ~met[active[:, None], near]
        met[active[:, None], near] = True
        value = np.einsum("qd,qrd->qr", queries[active], points[np.minimum(near, n - 1)])
        value[~fresh] = -np.inf
        every = np.concatenate([scores[active], value], axis=1)
        order = np.argsort(-every, axis=1, kind="stable")[:, :beam]
        rows = np.arange(len(active))[:, None]
        scores[active] = every[rows, order]
        ids[active] = np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1)[rows, order]
        done[active] = np.concatenate([done[active], ~fresh], axis=1)[rows, order]
    ids[np.isinf(scores)] = -1
    return ids, scores


def robust_prune(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """At most ``degree`` neighbours per point among its candidates (-1: none), filled with ``len(points)``.

    The nearest candidate is kept and drops those that lie ``relax`` times nearer to it than to the point.
    Distances are taken from differences, which stay exact for points that lie close together.
    """
    n, rows = len(points), np.arange(len(own))
    ids = np.sort(candidates, axis=1)
    alive = (ids >= 0) & (ids < n) & (ids != own[:, None])
    alive[:, 1:] &= ids[:, 1:] != ids[:, :-1]
    vectors = points[np.where(alive, ids, 0)]
    squared = lambda a: np.einsum("pcd,pcd->pc", d := vectors - a[:, None, :], d)
    gap = np.where(alive, squared(points[own]), np.inf)
    kept = np.full((len(own), degree), n)
    for k in range(degree):
        best = np.argmin(np.where(alive, gap, np.inf), axis=1)
        found = alive[rows, best]
        if not found.any():
            break
        kept[found, k] = ids[rows, best][found]
        between = squared(vectors[rows, best])
        alive &= (relax * between > gap) | ~found[:, None]
        alive[rows, best] = False
    return kept


def build_graph(
    points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAXATION, seed: int = 3
) -> tuple[np.ndarray, int]:
    """Directed graph over unit vectors (rows of neighbours, filled with n) and its entry point.

    Points are inserted in batches that double in size: a greedy search from the entry proposes
    neighbours, pruning keeps diverse ones, and the reverse edges are added and pruned alike.
    """
    n = len(points)
    graph = np.full((n, degree), n)
    entry = int(np.argmax(points @ points.mean(axis=0)))
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at = 1
    while at < n:
        batch = order[at : at + min(max(at, 1), QUERIES_AT_ONCE)]
        at += len(batch)
        proposed, _ = beam_search(points, graph, points[batch], entry, beam)
        graph[batch] = robust_prune(points, batch, proposed, degree, relax)
        source = np.repeat(batch, degree)
        target = graph[batch].ravel()
        real = target < n
        source, target = source[real], target[real]
        by_target = np.argsort(target, kind="stable")
        source, target = source[by_target], target[by_target]
        hit, first, count = np.unique(target, return_index=True, return_counts=True)
        back = np.full((len(hit), count.max(initial=0)), -1)
        back[np.repeat(np.arange(len(hit)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        graph[hit] = robust_prune(points, hit, np.concatenate([graph[hit], back], axis=1), degree, relax)
    return graph, entry


def _unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / scale
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors_of(df: DataFrame, key: str, vector: str) -> DataFrame:
    """One row ``id, vector`` (doubles) per id with a usable vector; the smallest one if an id has several."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.where(F.col("id").isNotNull() & _usable(F.col("vector"))).groupBy("id").agg(F.min("vector").alias("vector"))


def _direction(vector: Column) -> Column:
    """The rounded unit vector.

    A lambda evaluates for every component what it names, so the largest component and the norm are repeated first.
    """
    divided = lambda components, by: F.zip_with(components, F.array_repeat(by, F.size(vector)), lambda x, y: x / y)
    scaled = divided(vector, F.array_max(F.transform(vector, F.abs)))
    norm = F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda total, x: total + x * x))
    return F.transform(divided(scaled, norm), lambda x: F.round(x, DIRECTION_DECIMALS) + 0.0)


def build_index(vectors: DataFrame, shards: int, neighbours: int) -> DataFrame:
    """One row per shard: a graph of the directions, and the ids and exact vectors that each stands for.

    Vectors of one direction, whatever their lengths, are one point, so copies neither crowd a graph nor fill
    a task.  Their nearness to anything agrees in ``DIRECTION_DECIMALS`` decimals, so an answer needs no more
    than ``neighbours + 1`` of them, those of the smallest ids.
    """
    placed = vectors.withColumn("direction", _direction(F.col("vector")))
    ranked = Window.partitionBy("direction").orderBy("id")
    smallest = placed.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= neighbours + 1)
    points = smallest.groupBy("direction").agg(F.sort_array(F.collect_list(F.struct("id", "vector"))).alias("members")).select(
        F.col("members.id").alias("ids"), F.col("members.vector").alias("vectors")
    )
    placed = points.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        table = table.take(np.argsort([i[0] for i in table["ids"].to_pylist()]))
        ids, raw = table["ids"].to_pylist(), table["vectors"].to_pylist()
        graph, entry = build_graph(_unit(np.array([v[0] for v in raw], dtype="<f8")))
        # the entry is the last number
        stored = np.append(graph.ravel(), entry).astype("<i4").tobytes()
        exact = np.array([v for each in raw for v in each], dtype="<f8").tobytes()
        columns = [[table["shard"][0].as_py()], [len(raw)], [[len(i) for i in ids]], [[i for each in ids for i in each]], [exact], [stored]]
        types = (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary(), pa.binary())
        names = [c.split()[0] for c in _INDEX.split(", ")]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return placed.groupBy("shard").applyInArrow(build, _INDEX)


def _answers(index: dict, ids: list[int], vectors: np.ndarray, neighbours: int, beam: int) -> pa.RecordBatch:
    of_point, member_ids = np.array(index["members"]), np.array(index["ids"])
    first = np.cumsum(of_point) - of_point
    raw = np.frombuffer(index["vectors"], "<f8").reshape(len(member_ids), -1)
    norms = np.linalg.norm(raw, axis=1)
    stored = np.frombuffer(index["graph"], "<i4")
    graph, entry = stored[:-1].reshape(index["n"], -1), int(stored[-1])
    points, found = _unit(raw[first]), []
    for at in range(0, len(ids), QUERIES_AT_ONCE):
        part = vectors[at : at + QUERIES_AT_ONCE]
        near, _ = beam_search(points, graph, _unit(part), entry, beam)
        for query_id, query, row in zip(ids[at:], part, near, strict=False):
            row = row[row >= 0]
            rows = np.concatenate([np.arange(first[p], first[p] + of_point[p]) for p in row])
            # cosine in double precision on the original vectors
            exact = (raw[rows] @ query) / (norms[rows] * np.linalg.norm(query))
            best = [(-s, i) for s, i in zip(exact.tolist(), member_ids[rows].tolist(), strict=True) if i != query_id]
            found += [(query_id, i, -s) for s, i in sorted(best)[:neighbours]]
    types = (pa.int64(), pa.int64(), pa.float64())
    return pa.record_batch(
        [pa.array([f[k] for f in found], t) for k, t in enumerate(types)], names=["query_id", "vec_id", "score"]
    )


def nearest(
    df: DataFrame, queries: Column, neighbours: int = 5, key: str = "vec_id", vector: str = "embedding",
    shard_rows: int | None = None, beam: int = SEARCH_BEAM,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that meets ``queries`` its nearest other rows by cosine.

    Every vector is indexed in a shard of about ``shard_rows`` (from ``SHARD_ROWS`` on, growing with the table); blocks
    of queries meet every shard, and the answers of the shards are merged.  Ties go to the smaller id; with fewer candidates than ``neighbours``
    all found are returned.  Rows without id and vectors that are null, empty, zero or hold null or
    non-finite components take no part; an id with several vectors counts with the smallest.  All vectors
    must have one length.  An empty table gives no rows; other columns are ignored.
    """

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield _answers(row, row["query_ids"], np.array(row["query_vectors"], np.float64), neighbours, max(beam, neighbours + 1))

    with Scratch(df.sparkSession, "neighbours") as scratch:
        vectors = scratch.keep(vectors_of(df, key, vector), "vectors")
        rows = vectors.count()
        per_shard = shard_rows or min(max(SHARD_ROWS, rows // SHARDS), MOST_SHARD_ROWS)
        shards = -(-rows // per_shard) or 1
        index = scratch.keep(build_index(vectors, shards, neighbours), "index")
        asked = vectors.withColumnRenamed("id", key).where(queries).withColumnRenamed(key, "id")
        n_blocks = -(-asked.count() // (4 * QUERIES_AT_ONCE)) or 1
        blocks = (
            asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_blocks)))
            .groupBy("block").agg(F.collect_list("id").alias("query_ids"), F.collect_list("vector").alias("query_vectors"))
            .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        )
        # not broadcast: sizes are guessed without the explode, so blocks of every shard would pass the driver
        answers = blocks.join(index.hint("merge"), "shard").mapInArrow(search, "query_id long, vec_id long, score double")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours)
        return scratch.hand_over(ranked.select("query_id", "rank", "vec_id", "score"))
