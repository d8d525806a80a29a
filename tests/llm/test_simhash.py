"""Fingerprints, ball hashing and components against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from eventstrand.llm import simhash
from eventstrand.llm.queries import op13_simhash_near_dedup


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(len(words) - size + 1)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=4):
    """Smallest index reachable over all pairs that differ in few bits."""
    values = np.array(prints, dtype=np.uint64)
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius) + i + 1:
            low, high = sorted((find(i), find(int(j))))
            root[high] = low
    return [find(i) for i in range(len(values))]


def check(got, rows):
    prints = [plain_print(t) for _, t in rows]
    ids_of = {}
    for (i, _), root in zip(rows, plain_components(prints), strict=True):
        ids_of.setdefault(root, set()).add(i)
    smallest = {root: min((i for i in ids if i is not None), default=None) for root, ids in ids_of.items()}
    want = [(i, f"{p:016x}", smallest[root]) for (i, _), p, root in zip(rows, prints, plain_components(prints), strict=True)]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(want, key=key)


def test_odd_documents(spark, odd_docs, odd_list, empty_docs):
    check(simhash.near_duplicates(odd_docs).collect(), [(i, t) for i, t, *_ in odd_list])
    assert simhash.near_duplicates(empty_docs).collect() == []


def test_query_over_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = op13_simhash_near_dedup(spark, sf_dir)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    check(found.collect(), rows)


def crowd(rng, size):
    """Prints at every distance up to 6 of others, in chains and crowds, and far ones."""
    prints = [rng.getrandbits(64) for _ in range(size // 3)] + [0, 1, 2**64 - 1]
    while len(prints) < size:
        near = rng.choice(prints[-20:])
        for bit in rng.sample(range(64), rng.choice((1, 2, 3, 4, 4, 5, 6))):
            near ^= 1 << bit
        prints.append(near)
    return sorted(set(prints))


@pytest.mark.parametrize("buckets, slice_size, radius", [(1, 1 << 21, 4), (64, 50_000, 4), (128, 1 << 21, 2), (4096, 1 << 21, 2)])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, buckets, slice_size, radius):
    """Also with more buckets than a print has variants."""
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", slice_size)
    prints = crowd(random.Random(buckets), 600)
    values = np.array(prints, dtype=np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(v),) for v in values], "print long")
    packed = {}
    for r in simhash._dealt(df, radius // 2, buckets).collect():
        packed[r.bucket] = packed.get(r.bucket, b"") + bytes(r.prints)
    links = []
    for bucket, here in packed.items():
        a, b = simhash._links_of(bucket, np.frombuffer(here, np.uint64), radius, buckets)
        links += zip(a.tolist(), b.tolist(), strict=True)
    place = {p: i for i, p in enumerate(prints)}
    a, b = (np.array([place[link[k]] for link in links], dtype=np.intp) for k in (0, 1))
    assert simhash._roots(a, b, len(prints)).tolist() == plain_components(prints, radius)


def test_large_group_makes_few_links(spark):
    """A crowd of prints around one centre hands on links in proportion to its members, not to its pairs."""
    rng = random.Random(3)
    crowd = {0}
    while len(crowd) < 1500:
        crowd.add(sum(1 << bit for bit in rng.sample(range(64), 2)))
    packed = np.array(sorted(crowd), dtype=np.uint64)
    for bucket in range(4):
        a, b = simhash._links_of(bucket, packed, 4, 4)
        assert len(a) < len(crowd)


def test_buckets_follow_the_prints():
    assert simhash._buckets(1000, 2081) == simhash._buckets(10**7, 2081) == simhash.LEAST_BUCKETS
    many = simhash._buckets(10**9, 2081)
    assert 10**9 * 2081 / many <= simhash.FINGERPRINTS_AT_ONCE


def test_odd_radius_is_refused(empty_docs):
    with pytest.raises(ValueError, match="even"):
        simhash.near_duplicates(empty_docs, radius=3)
