"""Neighbour search against brute force."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventstrand.llm import neighbours


def brute(rows, asked, k):
    """The exact answer: id -> [(other id, cosine)]."""
    usable = {}
    for i, v in rows:
        if i is None or v is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        usable[i] = min(usable.get(i, v), v)
    ids = sorted(usable)
    matrix = np.array([usable[i] for i in ids], float)
    norms = np.linalg.norm(matrix, axis=1)
    answers = {}
    for i in ids:
        if asked(i):
            cosine = matrix @ np.array(usable[i]) / (norms * np.linalg.norm(usable[i]))
            best = sorted((-c, j) for c, j in zip(cosine.tolist(), ids, strict=True) if j != i)[:k]
            answers[i] = [(j, -c) for c, j in best]
    return answers


def answers_of(df):
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    return found


@pytest.mark.parametrize("shard_rows", [8192, 150])
def test_recall_and_scores_on_the_given_vectors(spark, sf_dir, shard_rows):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = answers_of(neighbours.nearest(df, F.col("vec_id") % 50 == 0, shard_rows=shard_rows))
    want = brute([(r.vec_id, list(r.embedding)) for r in df.collect()], lambda i: i % 50 == 0, 5)
    assert got.keys() == want.keys()
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    for q, found in got.items():
        exact = dict(want[q])
        assert all(abs(s - exact[j]) < 1e-12 for j, s in found if j in exact)


def test_large_shard_recall():
    rng = np.random.default_rng(0)
    points = rng.normal(size=(3000, 32))
    points[:1500] = rng.normal(size=(10, 32))[rng.integers(0, 10, 1500)] + 0.05 * points[:1500]
    unit = neighbours._unit(points)
    graph, entry = neighbours.build_graph(unit)
    assert graph.shape == (3000, neighbours.DEGREE)
    asked = unit[::30]
    near, _ = neighbours.beam_search(unit, graph, asked, entry, neighbours.SEARCH_BEAM)
    exact = np.argsort(-(asked @ unit.T), axis=1)[:, :6]
    recall = np.mean([len(set(a[:6]) & set(b)) / 6 for a, b in zip(near.tolist(), exact.tolist(), strict=True)])
    assert recall >= 0.95


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    same = [0.5, 0.25, -1.0]
    rows = [
        (0, same), (50, [1.0, 0.0, 0.0]), (100, [0.0, 0.0, 0.0]), (150, None), (200, [nan, 1.0, 1.0]), (250, [1.0, inf, 0.0]),
        (300, [1.0, None, 0.0]), (350, []), (None, [1.0, 1.0, 1.0]), (1, [2.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (2, [0.0, 1.0, 0.0]),
        *[(i, same) for i in range(1000, 1400)],
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("id", F.lit(1))
    got = answers_of(neighbours.nearest(df, F.col("vec_id") % 50 == 0))
    want = brute(rows, lambda i: i % 50 == 0, 5)
    assert got.keys() == want.keys() and 100 not in got and 300 not in got
    for q in want:
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)


def test_few_candidates_and_empty_table(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (7, [1.0, 1.0])], schema)
    assert answers_of(neighbours.nearest(few, F.col("vec_id") % 50 == 0)).keys() == {0}
    assert neighbours.nearest(few, F.col("vec_id") % 50 == 0).count() == 1
    one = few.where("vec_id = 0")
    assert neighbours.nearest(one, F.col("vec_id") % 50 == 0).count() == 0
    assert neighbours.nearest(few.where("false"), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("shard_rows", [None, 400])
@pytest.mark.parametrize("moved", [0.0, 1e-9, 1e-5, 1e-2])
def test_recall_among_scaled_and_moved_copies(spark, moved, shard_rows):
    """600 vectors of nearly one direction and different lengths among 2,000 others."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2600, 24))
    x[:600] = x[0] * rng.uniform(0.1, 50, size=(600, 1))
    x[:600] *= 1 + moved * rng.normal(size=(600, 24))
    x = x[rng.permutation(2600)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = answers_of(neighbours.nearest(df, F.col("vec_id") % 50 == 0, shard_rows=shard_rows))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 2600, 50):
        cosine = unit @ unit[q]
        cosine[q] = -2
        fifth = np.sort(cosine)[-5]
        assert len(got[q]) == 5 and all(abs(s - cosine[j]) < 1e-12 for j, s in got[q])
        hits += sum(s >= fifth - 1e-12 for _, s in got[q])
        total += 5
    assert hits >= 0.95 * total, hits / total


def test_queries_of_many_shards_do_not_pass_the_driver(spark, monkeypatch, plan_of):
    """The queries are few, so they would be broadcast, but each shard has a copy of them."""
    rng = np.random.default_rng(8)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(500, 8)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plans, hand_over = [], neighbours.Scratch.hand_over

    def seen(scratch, answers, *more):
        answers.collect()  # so that its plan is the one that ran
        plans.append(plan_of(answers))
        return hand_over(scratch, answers, *more)

    monkeypatch.setattr(neighbours.Scratch, "hand_over", seen)
    got = answers_of(neighbours.nearest(df, F.col("vec_id") % 50 == 0, shard_rows=20))
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "Broadcast" not in plans[0]
    want = brute(rows, lambda i: i % 50 == 0, 5)
    assert got.keys() == want.keys() and all(len(found) == 5 for found in got.values())
    assert sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)


def test_directions_take_time_by_the_length_of_vectors(spark):
    """Not by its cube: four vectors of 700 took minutes."""
    x = np.random.default_rng(9).normal(size=(4, 700)) * [[1e-200], [1.0], [50.0], [1e200]]
    df = spark.createDataFrame([(v,) for v in x.tolist()], "v array<double>").coalesce(1)
    began = time.monotonic()
    got = np.array([r.d for r in df.select(neighbours._direction(F.col("v")).alias("d")).collect()])
    assert time.monotonic() - began < 20
    assert np.allclose(got, neighbours._unit(x), rtol=0, atol=0.51 * 10**-neighbours.DIRECTION_DECIMALS)
