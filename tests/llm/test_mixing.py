"""Source mixing against plain Python."""

from __future__ import annotations

import heapq
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from eventstrand.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size_of(text):
    return len(WORD.findall(text or ""))


def plain_targets(sizes):
    """Share by weight, cut at three sizes, reshare what is over until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, cut = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in cut)
        free = sum(weight[s] for s in names if s not in cut)
        over = {s for s in names if s not in cut and rest * weight[s] / free > 3 * sizes[s] + 1e-9} if free else set()
        if not over:
            return {s: float(3 * sizes[s]) if s in cut else rest * weight[s] / free for s in names}
        cut |= over


def check_mix(df, rows):
    sized = df.select("doc_id", "source", mixing.sizes_of(F.col("text")).alias("size"))
    got = [tuple(r) for r in mixing.mix(sized).select("doc_id", "source", "size", "source_size", "target", "taken").collect()]
    again = [tuple(r) for r in mixing.mix(sized.repartition(5)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()]
    key = lambda r: repr(r)
    assert sorted(got, key=key) == sorted(again, key=key)
    assert sorted(((r[0], r[1], r[2]) for r in got), key=repr) == sorted(((i, s, size_of(t)) for i, t, s in rows), key=repr)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size_of(text)
    want, taken = plain_targets(sizes), defaultdict(int)
    for _, source, size, source_size, target, words in got:
        assert source_size == sizes[source] and 0 <= words <= 3 * size
        assert target == pytest.approx(want[source], rel=1e-9)
        taken[source] += words
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 2 * mixing.BLOCK_WORDS + 0.01 * want[source], source


def test_mix_of_odd_documents(odd_docs, odd_list, empty_docs):
    check_mix(odd_docs.drop("size"), [(i, t, s) for i, t, _, s, _ in odd_list])
    empty = mixing.mix(empty_docs.select("doc_id", "source", F.lit(0).cast("long").alias("size")))
    assert empty.count() == 0


def test_mix_with_a_hot_source_and_many_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "DOCS_PER_SHARD", 100)
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice((0, 1, 50, 400)), "hot" if i % 3 == 0 else rng.choice(["a", "b", "B", "é", "z", None])) for i in range(900)]
    rows.append((901, "w " * 3, "tiny"))
    check_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), rows)


@pytest.mark.parametrize("at_limit", [True, False])
def test_small_sources_of_short_documents_in_a_large_table(spark, monkeypatch, at_limit):
    """1,000 shards of the table, of which small sources need one or a few."""
    monkeypatch.setattr(mixing, "DOCS_PER_SHARD", 500)
    rng = random.Random(9)
    small = {
        "a": [20] * 500, "b": [20] * 2000, "c": [rng.randint(30, 60) for _ in range(500)],
        "d": [rng.randint(50, 150) for _ in range(500)], "e": [int(i % 100 == 0) for i in range(4000)], "f": [3],
    }
    hot = 495_000
    sizes = {s: sum(x) for s, x in small.items()} | {"hot": 100 * hot}
    rows = [(i, s, n) for s, x in small.items() for i, n in enumerate(x)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").unionByName(
        spark.range(hot).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.lit(100).cast("long").alias("size"))
    )
    mixed = mixing.mix(df, weights=(1, 2, 3) if at_limit else tuple(sizes.values()))
    got = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    assert len(got) == len(sizes)
    for r in got:
        want = 3 * sizes[r.source] if at_limit and r.source != "hot" else plain_targets(sizes)["hot"] if at_limit else sizes[r.source]
        assert r.over <= 0 and abs(r.taken - want) <= 2 * mixing.BLOCK_WORDS + 0.01 * want, (r, want)


def test_seats_beyond_the_room_go_to_others(spark):
    df = spark.createDataFrame([("x", 90, 5), ("y", 9, 9), ("z", 1, 9), ("o", 0, 9)], "k string, w long, room long")
    for seats, want in ((10, {"x": 5, "y": 5, "z": 0, "o": 0}), (15, {"x": 5, "y": 9, "z": 1, "o": 0}), (99, {"x": 5, "y": 9, "z": 9, "o": 0})):
        won = mixing.apportion(df, [], "k", F.col("w"), F.lit(seats), "won", room=F.col("room"))
        assert {r.k: r.won for r in won.collect()} == want


def test_chosen_words_add_up(odd_docs):
    from eventstrand.llm.common import words_of

    sized = odd_docs.drop("size", "taken", "place").withColumn("size", mixing.sizes_of(F.col("text")))
    mixed = mixing.mix(sized)
    once = F.size(F.filter(words_of(F.col("text")), lambda w, i: mixing.chosen(i)))
    assert mixed.where(F.col("taken") != F.col("copies") * F.col("size") + once).count() == 0


def sainte_lague(weights, seats):
    won = {k: 0 for k in weights}
    heap = [(-w, k) for k, w in weights.items() if w > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, k = heapq.heappop(heap)
        won[k] += 1
        heapq.heappush(heap, (-weights[k] / (2 * won[k] + 1), k))
    return won


def test_apportionment_gives_seats_to_the_highest_quotients(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for group in range(40):
        n, seats = rng.randint(1, 12), rng.choice((0, 1, 2, 7, 100, 1001))
        kind = rng.choice(("even", "skewed", "zero"))
        weights = {f"k{i:02d}": {"even": 5, "skewed": rng.randint(1, 10) ** 4, "zero": rng.choice((0, 3))}[kind] for i in range(n)}
        rows += [(group, k, w, seats) for k, w in weights.items()]
        want |= {(group, k): v for k, v in sainte_lague(weights, seats).items()}
    df = spark.createDataFrame(rows, "g int, k string, w long, seats long")
    got = {(r.g, r.k): r.won for r in mixing.apportion(df, ["g"], "k", F.col("w"), F.col("seats"), "won").collect()}
    assert got == want


def test_apportionment_beside_a_long_tail(spark):
    rows, want = [], {}
    for group, (large, tail, small) in enumerate([(1000, 250, 0.4), (100_000, 25_000, 0.4), (3, 2000, 0.2), (50, 400, 0.6)]):
        weights = {"large": float(large)} | {f"t{i:05d}": small for i in range(tail)}
        seats = round(sum(weights.values()))
        rows += [(group, k, w, seats) for k, w in weights.items()]
        want |= {(group, k): v for k, v in sainte_lague(weights, seats).items()}
    df = spark.createDataFrame(rows, "g int, k string, w double, seats long")
    got = {(r.g, r.k): r.won for r in mixing.apportion(df, ["g"], "k", F.col("w"), F.col("seats"), "won").collect()}
    assert got == want


@pytest.mark.parametrize("ids", [lambda i: 7, lambda i: None, lambda i: i % 3])
def test_targets_are_met_where_rows_tie(spark, ids):
    """Rows that are equal in all that orders them still give their words one after the other."""
    rows = [(ids(i), "a", 40) for i in range(1_000)] + [(ids(i), "b", 25) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    mixed = mixing.mix(df).collect()
    assert len(mixed) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in mixed)
    for source in ("a", "b"):
        taken = sum(r.taken for r in mixed if r.source == source)
        target = next(r.target for r in mixed if r.source == source)
        assert abs(taken - target) <= 0.005 * target + 64
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed))
