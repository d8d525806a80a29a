"""k-means for many starts, and for many k, at once.

Every step is one pass over the points for all starts: an Arrow batch is multiplied with the centres of every
start in one matrix product, tasks hand on one row per centre, and the number of passes does not grow
with the number of starts.  Equal vectors are one point with a weight, and all random choices are
hashes of (seed, vector), so they are the same on every run and layout.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from eventstrand.session import remove_folder, shared_dir

# Passes that draw candidate centres, how many times k each draws, and a centre's move that ends a fit.
DRAW_ROUNDS, DRAWN_PER_K, TOLERANCE = 2, 2, 1e-4
# Mini-batches of the search: distinct points in a batch, and batches used.
BATCH_POINTS, BATCH_STEPS = 100_000, 30
# Numbers that the tasks of a pass hand on to be added up on the driver; beyond that Spark adds them up.
MERGED_NUMBERS = 1_000_000
# All centres of one pass go to every worker: with 64 coordinates 50 MB.
MAX_CENTRES = 100_000
_CELLS = 1 << 22  # of a distance matrix


@dataclass(frozen=True)
class ClusterModel:
    """Centres (k x d) and the sum of squared distances of the points to the nearest one."""

    centers: np.ndarray
    cost: float

    @property
    def k(self) -> int:
        return len(self.centers)


@dataclass
class _Start:
    """One fit under way."""

    k: int
    seed: int
    centers: np.ndarray
    seen: np.ndarray | None = None  # weight that each centre has got from mini-batches
    cost: float = np.inf


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    product = x @ centers.T
    return np.maximum((x**2).sum(1)[:, None] + (centers**2).sum(1)[None, :] - 2 * product, 0.0)


def _blocks(batch: pa.RecordBatch, n_centers: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Vectors, weights and hashes of parts of a batch whose distance matrix is bounded."""
    step = max(1, _CELLS // n_centers)
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield _matrix(part.column(0)), part.column(1).to_numpy(), part.column(2).to_numpy().view(np.uint64)


def uniform(hashes: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each 64-bit hash: splitmix64 of the hash moved by the seed."""
    x = hashes + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


@contextmanager
def weighted_points(vectors: DataFrame, column: str = "embedding") -> Iterator[DataFrame]:
    """(v, weight, hash): the distinct vectors, cached while fits read them."""
    v = F.col(column).cast("array<double>")
    points = (
        vectors.select(v.alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("weight"))
        .withColumn("hash", F.xxhash64("v")).persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        yield points
    finally:
        points.unpersist()


def _pass(points: DataFrame, starts: Sequence[_Start]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each start: sums (k x d) and weights of the points nearest to each centre, and the cost."""
    sizes = [len(s.centers) for s in starts]
    if sum(sizes) > MAX_CENTRES:
        raise ValueError(f"{sum(sizes)} centres in one pass, at most {MAX_CENTRES}")
    first = np.concatenate([[0], np.cumsum(sizes)])
    spark = points.sparkSession
    every = spark.sparkContext.broadcast(np.concatenate([s.centers for s in starts]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = every.value
        # per centre: sum of vectors, weight, cost
        total = np.zeros((len(centers), centers.shape[1] + 2))
        for batch in batches:
            for x, weight, _ in _blocks(batch, len(centers)):
                squared, rows = _squared(x, centers), np.arange(len(x))
                member = np.zeros(squared.shape)
                for a, b in zip(first[:-1], first[1:], strict=True):
                    nearest = a + squared[:, a:b].argmin(axis=1)
                    member[rows, nearest] = weight
                    total[:, -1] += np.bincount(nearest, weight * squared[rows, nearest], len(centers))
                total[:, :-2] += member.T @ x
                total[:, -2] += member.sum(axis=0)
        used = np.flatnonzero(total[:, -2])
        yield pa.record_batch(
            [pa.array(used, pa.int32()), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["center", "total"]
        )

    sums = points.mapInArrow(run, "center int, total array<double>")
    width = every.value.shape[1] + 2
    if points.rdd.getNumPartitions() * first[-1] * width > MERGED_NUMBERS:
        sums = sums.groupBy("center").agg(vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"))
    table = np.zeros((first[-1], width))
    for row in sums.collect():  # a row per centre, of every task only while these are few
        table[row.center] += row.total
    every.unpersist()
    return [(table[a:b, :-2], table[a:b, -2], float(table[a:b, -1].sum())) for a, b in zip(first[:-1], first[1:], strict=True)]


def _drawn(points: DataFrame, starts: Sequence[_Start], costs: Sequence[float], turn: int) -> list[np.ndarray]:
    """Per start about ``DRAWN_PER_K`` k points, each with a chance in proportion to its squared distance."""
    first = np.concatenate([[0], np.cumsum([len(s.centers) for s in starts])])
    every = points.sparkSession.sparkContext.broadcast(np.concatenate([s.centers for s in starts]))
    rates = [DRAWN_PER_K * s.k / cost if cost > 0 else 0.0 for s, cost in zip(starts, costs, strict=True)]
    seeds = [s.seed * 1_000_003 + s.k * 101 + turn for s in starts]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, weight, hashes in _blocks(batch, len(every.value)):
                squared = _squared(x, every.value)
                for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                    chance = rates[i] * weight * squared[:, a:b].min(axis=1)
                    chosen = x[uniform(hashes, seeds[i]) < chance]
                    if len(chosen):
                        yield pa.record_batch(
                            [pa.array([i] * len(chosen), pa.int32()), pa.array(list(chosen), pa.list_(pa.float64()))], names=["start", "v"]
                        )

    rows = points.mapInArrow(run, "start int, v array<double>").collect()
    every.unpersist()
    dimension = every.value.shape[1]
    return [np.array(sorted(r.v for r in rows if r.start == i)).reshape(-1, dimension) for i in range(len(starts))]


def _spread(candidates: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the weighted candidates far from each other (k-means++), moved by some local iterations."""
    chosen = [int(rng.choice(len(candidates), p=weights / weights.sum()))]
    nearest = _squared(candidates, candidates[chosen])[:, 0]
    while len(chosen) < k and (nearest * weights).sum() > 0:
        chosen.append(int(rng.choice(len(candidates), p=nearest * weights / (nearest * weights).sum())))
        nearest = np.minimum(nearest, _squared(candidates, candidates[chosen[-1:]])[:, 0])
    centers = candidates[chosen]
    for _ in range(30):
        own = _squared(candidates, centers).argmin(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, candidates * weights[:, None])
        mass = np.bincount(own, weights, len(centers))
        moved = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], centers)
        if np.array_equal(moved, centers):
            break
        centers = moved
    return centers


def _begin(points: DataFrame, settings: Sequence[tuple[int, int]]) -> list[_Start]:
    """Starts for each (k, seed), by k-means||: a few passes draw candidates, one weighs them."""
    seeds = sorted({seed for _, seed in settings})
    firsts = points.agg(*[F.min_by("v", F.struct(F.xxhash64(F.lit(s), "hash"), "v")).alias(f"s{s}") for s in seeds]).first()
    if firsts[0] is None:
        raise ValueError("no vectors to cluster")
    starts = [_Start(k, seed, np.array([firsts[f"s{seed}"]])) for k, seed in settings]
    for turn in range(DRAW_ROUNDS):
        costs = [cost for _, _, cost in _pass(points, starts)]
        for s, drawn in zip(starts, _drawn(points, starts, costs, turn), strict=True):
            s.centers = np.unique(np.concatenate([s.centers, drawn]), axis=0)
    if any(len(s.centers) < s.k for s in starts):
        # too few drawn: any points, those of the smallest hashes
        most = max(s.k for s in starts)
        more = np.array([r.v for r in points.orderBy("hash", "v").limit(most).select("v").collect()])
        for s in starts:
            if len(s.centers) < s.k:
                s.centers = np.unique(np.concatenate([s.centers, more]), axis=0)
    for s, (_, weights, _) in zip(starts, _pass(points, starts), strict=True):
        s.centers = _spread(s.centers, weights, s.k, np.random.default_rng(s.seed))
    return starts


def _moved(s: _Start, sums: np.ndarray, weights: np.ndarray) -> bool:
    """Centres to the mean of their points; does any move further than the tolerance?"""
    new = np.where(weights[:, None] > 0, sums / np.maximum(weights, 1e-300)[:, None], s.centers)
    far = ((new - s.centers) ** 2).sum(axis=1).max() > TOLERANCE**2
    s.centers = new
    return bool(far)


def _finish(points: DataFrame, starts: Sequence[_Start]) -> list[ClusterModel]:
    return [ClusterModel(s.centers, cost) for s, (_, _, cost) in zip(starts, _pass(points, starts), strict=True)]


def full_fits(points: DataFrame, settings: Sequence[tuple[int, int]], max_iter: int = 100) -> list[ClusterModel]:
    """A model for each (k, seed); an iteration is one pass over all points for all of them."""
    starts = _begin(points, settings)
    active = list(starts)
    for _ in range(max_iter):
        active = [s for s, (sums, weights, _) in zip(active, _pass(points, active), strict=True) if _moved(s, sums, weights)]
        if not active:
            break
    return _finish(points, starts)


def minibatch_fits(
    points: DataFrame,
    settings: Sequence[tuple[int, int]],
    batch_points: int = BATCH_POINTS,
    steps: int = BATCH_STEPS,
    seed: int = 0,
) -> list[ClusterModel]:
    """A model for each (k, seed) from seeded batches: a centre moves by the share a batch has in all it has seen.

    The points are dealt to batches by hash; batches that will be used are stored in folders of their
    own, and each step is one small job over one folder for all models.  Costs are over all points.
    """
    starts = _begin(points, settings)
    n_batches = max(1, -(-points.count() // batch_points))
    folder = f"{shared_dir(points.sparkSession)}/batches-{uuid.uuid4().hex}"
    batch = F.pmod(F.xxhash64(F.lit(seed), "hash"), F.lit(n_batches)).cast("int")
    try:
        points.withColumn("batch", batch).where(F.col("batch") < steps).write.partitionBy("batch").parquet(folder)
        stored = points.sparkSession.read.schema("v array<double>, weight double, hash bigint, batch int").parquet(folder)
        active = list(starts)
        for s in active:
            s.seen = np.zeros(len(s.centers))
        for step in range(steps):
            rows = stored.where(F.col("batch") == step % n_batches).drop("batch")
            moving = []
            for s, (sums, weights, _) in zip(active, _pass(rows, active), strict=True):
                s.seen += weights
                rate = np.divide(1.0, s.seen, out=np.zeros_like(s.seen), where=s.seen > 0)[:, None]
                move = (sums - weights[:, None] * s.centers) * rate
                s.centers = s.centers + move
                if (move**2).sum(axis=1).max() > TOLERANCE**2:
                    moving.append(s)
            active = moving
            if not active:
                break
    finally:
        remove_folder(points.sparkSession, folder)
    return _finish(points, starts)


def nearest(models: Sequence[ClusterModel]):
    """Column function: the nearest centre of each model to a vector, as an array of ints; the first on ties."""
    centers = [m.centers for m in models]

    @F.arrow_udf("array<int>")
    def labels(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.list_(pa.int32()))
        x = _matrix(column)
        found = np.column_stack([_squared(x, c).argmin(axis=1) for c in centers]).astype(np.int32)
        return pa.array(list(found), pa.list_(pa.int32()))

    return labels
