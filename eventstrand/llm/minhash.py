"""Near-duplicates by fast similarity sketching, banding and exact verification.

A sketch has t coordinates.  In round i < t every element goes to a hashed coordinate, in round t + j to
coordinate j, each time with a fresh hash; a coordinate keeps the smallest (round, hash).  Rounds end when
all coordinates are filled, after t log t elements on average and 2 t rounds at most, and matching
coordinates estimate the Jaccard similarity with the concentration of independent samples.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from eventstrand.llm.common import Scratch, free_worker, grams, mix, seeded, signed, word_hashes
from eventstrand.llm.components import components

SHINGLE_WORDS = 5
# At similarity 0.85 a pair misses all of 32 bands of 5 coordinates once in 100 million.
BANDS, ROWS = 32, 5
# Buckets with more members are compared by blocks inside tasks instead of by listed pairs.
LISTED_MEMBERS = 8
BLOCK_SHINGLES, BLOCK_MEMBERS, MATRIX_COLUMNS = 400_000, 400, 2_048


def shingles(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles of lower-cased words; one for a shorter text, none without words.

    ``bytes`` lower-cases A-Z only and splits at the six ASCII spaces.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    return np.unique(grams(hashes, min(size, len(hashes))))


class Sketcher:
    def __init__(self, size: int):
        self.size = size
        self.seeds = mix(seeded("round", 2 * size))

    def sketch(self, elements: np.ndarray) -> np.ndarray:
        """The sketch of a set of 64-bit hashes, which must not be empty."""
        t = np.uint64(self.size)
        result = np.zeros(self.size, np.uint64)
        empty = np.ones(self.size, bool)
        for i, seed in enumerate(self.seeds):
            fresh = mix(elements ^ seed)
            if i < self.size:
                place = ((fresh >> np.uint64(32)) * t >> np.uint64(32)).astype(np.intp)
                best = np.full(self.size, np.iinfo(np.uint64).max, np.uint64)
                np.minimum.at(best, place, mix(fresh))
                filled = np.zeros(self.size, bool)
                filled[place] = True
                new = empty & filled
            else:
                best, new = mix(fresh).min(keepdims=True).repeat(self.size), np.arange(self.size) == i - self.size
                new &= empty
            # the round is part of the value, so rounds do not match each other
            result[new] = mix(best[new] + seed)
            empty &= ~new
            if not empty.any():
                break
        return result


_STEPS = seeded("band", ROWS)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates."""
    parts = sketch[: bands * rows].reshape(bands, rows)
    keys = np.zeros(bands, np.uint64)
    for j in range(rows):
        keys = mix(keys + parts[:, j] * _STEPS[j % ROWS])
    return mix(keys ^ np.arange(1, bands + 1, dtype=np.uint64))


def _sketches(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, same, bands``: ``same`` is a 128-bit digest of the set, null if empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        sketcher = Sketcher(bands * rows)
        for batch in batches:
            counts, same, keys = [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py())
                counts.append(len(found))
                same.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                keys.append(signed(band_keys(sketcher.sketch(found), bands, rows)) if len(found) else None)
            columns = [
                batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(same, pa.binary()),
                pa.array(keys, pa.list_(pa.int64())),
            ]
            yield pa.record_batch(columns, names=["doc_id", "text_key", "n_shingles", "same", "bands"])

    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    return keyed.mapInArrow(run, "doc_id long, text_key long, n_shingles long, same binary, bands array<long>")


def text_key(text: Column) -> Column:
    """Tells the texts of one id apart; null and empty are one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, text`` of the wanted nodes, each text of an id once, however often its row comes."""
    found = texts.hint("merge").join(nodes.hint("merge"), "node", "left_semi")
    return found.groupBy("node", text_key(F.col("text")).alias("key")).agg(F.first("text").alias("text")).select("node", "text")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets reach the similarity.

    A task keeps the sets of a few recent left sides; pairs arrive sorted by the left side.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            ids = batch.column(0).to_pylist()
            for i in range(batch.num_rows):
                if i == 0 or ids[i] != last:
                    last, left = ids[i], shingles(batch.column(2)[i].as_py())
                right = shingles(batch.column(3)[i].as_py())
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = _texts_of(texts, ends)
    with_a = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.select("a", "b", "text_a", "text_b").sortWithinPartitions("a").mapInArrow(run, "a long, b long")


def _block_sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, set``: the upper halves of the shingle hashes of the wanted nodes, 4 bytes each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(shingles(t.as_py()) >> np.uint64(32)).astype("<u4").tobytes() for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    return _texts_of(texts, wanted).mapInArrow(run, "node long, set binary")


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements every two sets share, as products of 0-1 matrices over a few columns at a time."""
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    rows, column = rows[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)  # exact up to 16 million
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, MATRIX_COLUMNS):
        a, b = np.searchsorted(column, [low, low + MATRIX_COLUMNS])
        part = np.zeros((len(sets), MATRIX_COLUMNS), np.float32)
        part[rows[a:b], column[a:b] - low] = 1
        total += part @ part.T
    return total


def _block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of different components in one large bucket that may reach the similarity.

    Members are dealt to blocks of bounded size and all pairs of blocks are compared inside a task; only
    what is similar enough leaves it.  Halved hashes may count some shingles too many, and too few by as
    many as share a half inside either set; the answer is wide by these, to be confirmed on the full sets.
    """

    def compare(table: pa.Table) -> pa.Table:
        ids, component, n = (table[c].to_numpy() for c in ("node", "component", "n"))
        halves = [np.frombuffer(x.as_py(), "<u4") for x in table["set"]]
        # sets are sorted, so equal halves are neighbours
        merged = np.array([np.count_nonzero(x[1:] == x[:-1]) for x in halves])
        common, found = _common(halves), []
        for row in range(len(ids) - 1):  # a row at a time, so that one matrix is held
            rest = slice(row + 1, None)
            both = common[row, rest].astype(np.int64) + np.minimum(merged[row], merged[rest])
            enough = (100 * both >= percent * (n[row] + n[rest] - both)) & (component[row] != component[rest])
            found.append(np.flatnonzero(enough) + row + 1)
        i = np.repeat(np.arange(len(found)), [len(x) for x in found])
        j = np.concatenate([np.empty(0, np.intp), *found])
        a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        return pa.table({"a": a, "b": b})

    blocks = F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("size") / BLOCK_MEMBERS))
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    placed = dealt.withColumn("other", other).select(
        "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "component", "n"
    )
    return placed.join(sets, "node").groupBy("bucket", "low", "high").applyInArrow(compare, "a long, b long").distinct()


def _led(members: DataFrame) -> DataFrame:
    """The members of buckets with two nodes or more, each with the bucket's smallest node ``a``."""
    leaders = members.groupBy("bucket").agg(
        F.min(F.struct("node", "n")).alias("leader"), F.count("*").alias("size")
    ).where("size > 1")
    return members.join(leaders.select("bucket", F.col("leader.node").alias("a"), F.col("leader.n").alias("n_a")), "bucket")


def near_duplicates(
    df: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS, text: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_key, same`` for every row of ``doc_id, text``.

    ``text_key`` tells rows of one id with different texts apart, ``same`` is a digest of the shingle set.

    Rows with equal sets are one node, so copies are never paired.  Inside a band's bucket every node is
    first compared with the bucket's leader only; the links found join most of a group.  What remains are
    pairs of one bucket in different components.  They are listed for small buckets and compared by blocks
    inside tasks for large ones, from which only links leave, so no group's pairs are ever written out and
    no link between components is lost.  Links rest on full shingle sets.

    An empty set (null or empty text, or only spaces) is linked with nothing.  Repeated rows are one
    document, and so are rows that share an id while it is the smallest of their sets.  A row without id is
    linked with nothing and has a null ``component_id``.  ``kept`` is ``doc_id <=> component_id``.  An
    empty table gives no rows; other columns are ignored.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    with Scratch(df.sparkSession, "minhash") as scratch:
        sketched = scratch.keep(_sketches(docs, bands, rows), "sketches")
        nodes = scratch.keep(
            sketched.where(F.col("same").isNotNull() & F.col("doc_id").isNotNull()).groupBy("same").agg(
                F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
            ),
            "nodes", sketched.count(),
        )
        members = nodes.select("node", "n", F.explode("bands").alias("bucket"))
        texts = docs.where(F.col("doc_id").isNotNull()).withColumnRenamed("doc_id", "node")
        likely = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)

        led = scratch.keep(_led(members), "led", bands * nodes.count())
        n_led = led.count()
        near_leader = led.where((F.col("node") != F.col("a")) & likely(F.col("n"), F.col("n_a")))
        pairs = scratch.keep(near_leader.select("a", F.col("node").alias("b")).distinct(), "pairs", n_led)
        # pairs grow with the documents, so they are joined by shuffles at every size
        links = scratch.keep(_verified(pairs.hint("merge"), texts.hint("merge"), percent), "links")
        found = components(links, scratch, "first")

        grouped = scratch.keep(
            led.select("node", "n", "bucket").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")),
            "grouped", n_led,
        )
        mixed = grouped.groupBy("bucket").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.sum("n").alias("shingles")
        ).where("lo < hi").select("bucket", "size", "shingles")
        rest = scratch.keep(grouped.join(mixed, "bucket"), "mixed", n_led)
        few, many = rest.where(F.col("size") <= LISTED_MEMBERS), rest.where(F.col("size") > LISTED_MEMBERS)
        left, right = (few.select("bucket", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "component")]) for x in "ab")
        across = (
            left.join(right, "bucket")
            .where((F.col("component_a") < F.col("component_b")) & likely(F.col("n_a"), F.col("n_b")))
            .select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
        )
        sets = _block_sets(texts, many.select("node").distinct())
        across = across.unionByName(_block_links(many, sets, percent)).distinct().join(pairs, ["a", "b"], "left_anti")
        more = scratch.keep(_verified(scratch.keep(across, "across"), texts, percent), "more-links")
        final = components(links.unionByName(more), scratch, "second")
        named = nodes.join(final, "node", "left").select("same", F.coalesce("component", "node").alias("component_id"))
        result = sketched.drop("bands").join(named, "same", "left")
        alone = F.col("same").isNull() | F.col("doc_id").isNull()
        return scratch.hand_over(
            result.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))
            .select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"), "text_key", "same"),
            sketched.count(),
        )
