"""Near-duplicates by SimHash fingerprints and meet-in-the-middle ball hashing.

Two fingerprints at distance 4 or less have a variant in common that is at most 2 bits from either, and two
fingerprints that share such a variant are at most 4 bits apart.  So every fingerprint emits all variants
within half the radius, and those that meet on a variant are linked.

Variants are dealt to buckets by some bits of a hash that is linear over XOR.  A fingerprint therefore knows
from its own hash which flips lead into which bucket, travels once to every bucket that one of its
variants falls into, and its variants are written out there, a bounded slice of the bucket at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from eventstrand.llm.common import Scratch, mix, seeded, signed
from eventstrand.llm.components import components

SHINGLE_WORDS, SEED, BITS, RADIUS = 4, 42, 64, 4
# A bucket's task holds the fingerprints that reach it and the variants of one slice.
LEAST_BUCKETS, FINGERPRINTS_AT_ONCE, VARIANTS_AT_ONCE = 64, 1 << 24, 1 << 21
_HASHES_AT_ONCE = 1 << 16
_FILTER_BITS = 22


def fingerprint(text: str | None) -> int:
    """A bit is 1 if it is set in over half the hashes of a text's shingles; 0 without words.

    ``bytes`` lower-cases A-Z only and splits at the six ASCII spaces.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(SHINGLE_WORDS, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), _HASHES_AT_ONCE):
        part = zip(starts[at : at + _HASHES_AT_ONCE], ends[at : at + _HASHES_AT_ONCE], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in part], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def _fingerprints(docs: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(signed(found))], names=["doc_id", "print"])

    return docs.mapInArrow(run, "doc_id long, print long")


class Ball:
    """All flips of at most ``radius`` bits, found by the hash that they add to a fingerprint's."""

    def __init__(self, radius: int, hash_bits: int):
        columns = mix(seeded("flip", BITS)) >> np.uint64(BITS - hash_bits) if hash_bits else np.zeros(BITS, np.uint64)
        # a fingerprint's hash is the XOR of eight looked-up parts, one for each of its bytes
        self.parts = np.zeros((8, 256), np.uint64)
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1:
                    self.parts[:, value] ^= columns[bit::8]
        masks = [sum(1 << b for b in flips) for r in range(radius + 1) for flips in combinations(range(BITS), r)]
        masks = np.array(masks, dtype=np.uint64)
        added = self.hash(masks)
        order = np.argsort(added, kind="stable")
        self.added, first = np.unique(added[order], return_index=True)
        self.masks = np.split(masks[order], first[1:])
        self.size = len(masks)

    def hash(self, prints: np.ndarray) -> np.ndarray:
        each = np.ascontiguousarray(prints).view(np.uint8).reshape(-1, 8)
        total = np.zeros(len(prints), np.uint64)
        for i in range(8):
            total ^= self.parts[i][each[:, i]]
        return total


@cache
def ball(radius: int, hash_bits: int) -> Ball:
    return Ball(radius, hash_bits)


def _bits(slices: int) -> int:
    return max(0, slices - 1).bit_length()


def _buckets(prints: int, flips: int) -> int:
    """Few while every bucket can hold all fingerprints, else as many as variants need; a power of 2."""
    if prints <= FINGERPRINTS_AT_ONCE:
        return LEAST_BUCKETS
    return max(LEAST_BUCKETS, 1 << _bits(-(-2 * prints * flips // FINGERPRINTS_AT_ONCE)))


def _dealt(prints: DataFrame, radius: int, buckets: int) -> DataFrame:
    """``bucket, prints``: packed fingerprints, each once for every bucket that holds one of its variants."""

    def reached(found: np.ndarray, flips: Ball) -> tuple[np.ndarray, list[np.ndarray]]:
        own = flips.hash(found)
        if buckets <= len(flips.added):  # nearly any bucket
            names = np.arange(buckets, dtype=np.uint64)
            return names, [found[np.isin(own ^ b, flips.added)] for b in names]
        target = (own[:, None] ^ flips.added[None, :]).ravel()
        order = np.argsort(target, kind="stable")
        names, first = np.unique(target[order], return_index=True)
        return names, np.split(np.repeat(found, len(flips.added))[order], first[1:])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = ball(radius, _bits(buckets))
        step = max(1, VARIANTS_AT_ONCE // flips.size) if buckets > len(flips.added) else 1 << 14
        for batch in batches:
            found = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(found), step):
                names, packed = reached(found[at : at + step], flips)
                rows = pa.array([p.tobytes() for p in packed], pa.binary())
                yield pa.record_batch([pa.array(signed(names)), rows], names=["bucket", "prints"])

    return prints.mapInArrow(run, "bucket long, prints binary")


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node reachable from each of n nodes over the links a, b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for side in (a, b):
            np.minimum.at(root, root[side], low)
        while True:
            shorter = root[root]
            if np.array_equal(shorter, root):
                break
            root = shorter
        if np.array_equal(before, root):
            return root


def _meetings(variants: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For owners of one variant: links from the variant's smallest owner to the others."""
    ordered = np.sort(variants)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return twice.astype(np.intp), twice.astype(np.intp)
    # most variants have one owner; a bit table leaves nearly only the others to be looked up
    place = lambda v: (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)
    likely = np.zeros(1 << _FILTER_BITS, bool)
    likely[place(twice)] = True
    keep = np.flatnonzero(likely[place(variants)])
    variants, owners = variants[keep], owners[keep]
    order = np.lexsort((owners, variants))
    variants, owners = variants[order], owners[order]
    new = np.concatenate([[True], variants[1:] != variants[:-1]])
    smallest = owners[new][np.cumsum(new) - 1]
    return smallest[~new], owners[~new]


def _links_of(bucket: int, prints: np.ndarray, radius: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all of a bucket's fingerprints that meet on a variant in it: one per print joined."""
    prints = np.unique(prints)
    half = radius // 2
    wide = ball(half, 0).size
    bits = _bits(buckets) + _bits(-(-len(prints) * wide // (buckets * VARIANTS_AT_ONCE)))
    flips = ball(half, bits)
    own = flips.hash(prints)
    order = np.argsort(own, kind="stable")
    own = own[order]
    per_bucket = 1 << (bits - _bits(buckets))
    first, second = [], []
    for place in range(bucket * per_bucket, (bucket + 1) * per_bucket):
        wanted = flips.added ^ np.uint64(place)
        low, high = np.searchsorted(own, wanted), np.searchsorted(own, wanted, side="right")
        variants, owners = [], []
        for i in np.flatnonzero(high > low):
            here = order[low[i] : high[i]]
            variants.append((prints[here][:, None] ^ flips.masks[i][None, :]).ravel())
            owners.append(np.repeat(here, len(flips.masks[i])))
        if variants:
            a, b = _meetings(np.concatenate(variants), np.concatenate(owners))
            first.append(a)
            second.append(b)
    if not first or not sum(map(len, first)):
        return prints[:0], prints[:0]
    links = np.unique(np.concatenate(first) * len(prints) + np.concatenate(second))
    a, b = np.divmod(links, len(prints))
    apart = np.bitwise_count(prints[a] ^ prints[b])
    a, b = a[apart <= radius], b[apart <= radius]
    root = _roots(a, b, len(prints))
    joined = np.flatnonzero(root != np.arange(len(prints)))
    return prints[root[joined]], prints[joined]


def _links(dealt: DataFrame, radius: int, buckets: int) -> DataFrame:
    """``a, b``: inside each bucket, every joined fingerprint with the smallest of its group."""

    def emit(bucket: int, packed: list[bytes]) -> pa.RecordBatch:
        a, b = _links_of(bucket, np.frombuffer(b"".join(packed), np.uint64), radius, buckets)
        return pa.record_batch([pa.array(signed(a)), pa.array(signed(b))], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, packed = None, []
        for batch in batches:
            for name, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name != bucket and packed:
                    yield emit(bucket, packed)
                    packed = []
                bucket = name
                packed.append(row.as_py())
        if packed:
            yield emit(bucket, packed)

    return dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, radius: int = RADIUS, text: str = "text") -> DataFrame:
    """``doc_id, print, fingerprint, component_id`` for every row of ``doc_id, text``.

    Documents are linked where their 64-bit fingerprints differ in ``radius`` bits or fewer (even);
    ``component_id`` is the smallest doc_id reachable, the row's own included.  Documents of one fingerprint
    are one node.  A bucket hands on one link per fingerprint that it joins, whatever the size of the
    group, and these links connect the same fingerprints as all pairs would.

    Null, empty and blank texts have fingerprint 0, which is linked like any other.  Repeated rows and rows
    that share an id each get their row; all texts of one id count as nodes of that id.  A row without id
    links others, but gives no id: its ``component_id`` is the smallest id reachable, or null.  An empty
    table gives no rows; other columns are ignored.
    """
    if radius % 2:
        raise ValueError("the radius is halved, so it must be even")
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    with Scratch(df.sparkSession, "simhash") as scratch:
        printed = scratch.keep(_fingerprints(docs), "prints")
        nodes = scratch.keep(printed.groupBy("print").agg(F.min("doc_id").alias("smallest")), "nodes")
        buckets = _buckets(nodes.count(), ball(radius // 2, 0).size)
        met = _links(_dealt(nodes.select("print"), radius // 2, buckets), radius, buckets)
        found = components(scratch.keep(met.distinct(), "links"), scratch, "components")
        named = nodes.join(found.withColumnRenamed("node", "print"), "print", "left").withColumn(
            "component", F.coalesce("component", "print")
        )
        ids = named.groupBy("component").agg(F.min("smallest").alias("component_id"))
        of_print = scratch.keep(named.join(ids, "component").select("print", "component_id"), "ids")
        return scratch.hand_over(
            printed.join(of_print, "print").select(
                "doc_id", "print", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
            )
        )
