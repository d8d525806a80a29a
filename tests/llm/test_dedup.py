"""Near-duplicates and substring dedup against plain Python."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from eventstrand.llm import minhash, substrings
from eventstrand.llm.common import Scratch
from eventstrand.llm.components import components


def shingle_set(text):
    words = (text or "").encode().lower().split()
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def smallest_linked(rows, percent):
    """Brute force: id -> smallest id reachable over links between all pairs."""
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


def check_near(df, rows, percent):
    want = smallest_linked(rows, percent)
    got = minhash.near_duplicates(df, percent=percent).collect()
    assert len(got) == len(rows)
    sizes = {i: len(shingle_set(t)) for i, t in rows}
    for r in got:
        assert r.n_shingles == sizes[r.doc_id]
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id == r.component_id)


def test_components_of_odd_documents(odd_docs, odd_list, empty_docs):
    check_near(odd_docs, [(i, t) for i, t, *_ in odd_list], 85)
    assert minhash.near_duplicates(empty_docs).count() == 0


@pytest.mark.parametrize("listed", [0, 8, 10**6])
def test_chains_and_groups_that_lie_near_each_other(spark, monkeypatch, listed):
    monkeypatch.setattr(minhash, "LISTED_MEMBERS", listed)
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 7)
    monkeypatch.setattr(minhash, "MATRIX_COLUMNS", 50)
    rng = random.Random(4)
    rows = []
    for group in range(6):
        text = [f"g{group}w{i}" for i in range(120)]
        for _ in range(25):  # a chain: each differs a little from the one before
            rows.append((rng.randrange(10**6), " ".join(text)))
            text[rng.randrange(120)] = f"new{rng.random()}"
        for _ in range(15):  # a crowd around the threshold
            other = list(text)
            for _ in range(rng.choice((1, 2, 3, 5))):
                other[rng.randrange(120)] = f"x{rng.random()}"
            rows.append((rng.randrange(10**6), " ".join(other)))
    rows += [(10**6 + i, "copy of one text again and again here") for i in range(300)]
    rows = list(dict(rows).items())
    check_near(spark.createDataFrame(rows, "doc_id long, text string"), rows, 85)


def test_sketch_is_filled_and_concentrated():
    sketcher = minhash.Sketcher(256)
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 10, 100, 3000):
        sketch = sketcher.sketch(rng.integers(0, 2**63, n).astype(np.uint64))
        assert len(np.unique(sketch)) <= 256 and (sketch != 0).all()
    errors = []
    for share in (0.2, 0.5, 0.85):
        for n in (40, 400):
            both = rng.integers(0, 2**63, int(n * share)).astype(np.uint64)
            a, b = (np.concatenate([both, rng.integers(0, 2**63, n - len(both)).astype(np.uint64)]) for _ in range(2))
            true = len(both) / (2 * n - len(both))
            errors.append(abs((sketcher.sketch(a) == sketcher.sketch(b)).mean() - true))
    assert max(errors) < 0.12 and np.mean(errors) < 0.05


def test_small_sets_fill_by_the_second_half_of_rounds():
    sketcher = minhash.Sketcher(64)
    one = np.array([12345], np.uint64)
    assert (sketcher.sketch(one) == sketcher.sketch(one)).all()
    assert (sketcher.sketch(one) != sketcher.sketch(one + np.uint64(1))).all()


def test_small_tables_are_few_files(spark, monkeypatch):
    """However many partitions a shuffle has: every file costs an executor processes of its own."""
    settings = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    n_files = lambda df: len(df.inputFiles())
    stored, keep = {}, Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name, *a: stored.setdefault(name, keep(self, df, name, *a)))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        docs = [(i, " ".join(f"w{(i // 3) * 7 + j}" for j in range(40)) + f" x{i}") for i in range(600)]
        found = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
        stored["result"] = found
        assert {r.doc_id: r.component_id for r in found.collect()} == {i: i - i % 3 for i in range(600)}
        few = spark.sparkContext.defaultParallelism
        for name in ("nodes", "led", "pairs", "grouped", "first-1", "second-1", "result"):
            assert n_files(stored[name]) <= few, name
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_components_of_paths_and_stars(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 9), (9, 8)]
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(300)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    with Scratch(spark, "test") as scratch:
        df = spark.createDataFrame(edges, "a long, b long").where("a <> b")
        got = {r.node: r.component for r in components(df, scratch, "c").collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def without_repeats(rows, window):
    """Brute force in the order of ids; equal rows are one document."""
    seen, result = {}, {}
    for doc_id, text in sorted({(i, t) for i, t in rows if i is not None}, key=lambda r: (r[0], substrings._base(r[1]))):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.setdefault(key, True)
        result[doc_id, text] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode())
    return result


def check_repeats(df, rows, window=20, prefix=6):
    want = without_repeats(rows, window)
    got = substrings.remove_repeats(df, window, prefix).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_words, r.n_removed, r.kept_text) == want[r.doc_id, r.text], r.doc_id


def test_repeats_in_odd_documents(odd_docs, odd_list, empty_docs):
    check_repeats(odd_docs, [(i, t) for i, t, *_ in odd_list])
    assert substrings.remove_repeats(empty_docs).count() == 0


@pytest.mark.parametrize(("words", "window", "prefix"), [(2, 8, 3), (5, 6, 2), (30, 4, 4)])
def test_repeats_in_texts_of_few_words(spark, words, window, prefix, monkeypatch):
    monkeypatch.setattr(substrings, "DOCS_AT_ONCE", 7)
    rng = random.Random(words)
    rows = [(rng.randrange(10**4), " ".join(f"w{rng.randrange(words)}" for _ in range(rng.choice((0, 3, 8, 20, 60))))) for _ in range(120)]
    rows += rows[:10] + [(rows[0][0], rows[1][1])]
    check_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows, window, prefix)


def test_sha_of_kept_words(spark, sf_dir):
    from eventstrand.llm.queries import QUERIES

    small = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want = without_repeats(rows, 20)
    texts = dict(rows)
    for r in QUERIES["op6_substring_dedup"](spark, small).collect():
        n, removed, kept = want[r.doc_id, texts[r.doc_id]]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, removed, hashlib.sha256(kept.encode()).hexdigest())


def test_large_buckets_keep_pairs_whose_hashes_share_halves(spark):
    halves = np.arange(1, 101, dtype=np.uint64).repeat(2) << np.uint64(32)
    shared = halves + np.arange(200, dtype=np.uint64)
    own = lambda at: np.arange(at, at + 15, dtype=np.uint64) << np.uint64(32)
    full = {1: np.append(shared, own(1000)), 2: np.append(shared, own(2000)), 3: np.append(shared[:100], own(3000))}
    assert 100 * 200 >= 85 * 230
    sets = [(k, bytearray((x >> np.uint64(32)).astype("<u4").tobytes())) for k, x in full.items()]
    members = [("b", k, k, len(x), 3, sum(map(len, full.values()))) for k, x in full.items()]
    links = minhash._block_links(
        spark.createDataFrame(members, "bucket string, node long, component long, n long, size long, shingles long"),
        spark.createDataFrame(sets, "node long, set binary"), 85,
    )
    assert [tuple(r) for r in links.collect()] == [(1, 2)]


def test_verified_rows_do_not_grow_with_repeated_rows(spark):
    """Copies of the rows of a pair are one text per node before the pair is joined with it."""
    base = [f"w{i}" for i in range(100)]
    near = [*base[:-1], "other"]
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    for k in (1, 30):
        texts = spark.createDataFrame([(1, " ".join(base))] * k + [(2, " ".join(near))] * k + [(2, "unlike")] * k, "node long, text string")
        nodes = spark.createDataFrame([(1,), (2,)], "node long")
        assert minhash._texts_of(texts, nodes).count() == 3
        assert [tuple(r) for r in minhash._verified(pairs, texts, 85).distinct().collect()] == [(1, 2)]
        assert minhash._verified(pairs, texts, 85).count() == 1
