"""Substring dedup with a sparse suffix tree, partitioned by prefixes.

Indexing every suffix would move many times the text.  Any window of ``window`` words has one selected
suffix, the one inside it whose first ``prefix`` words hash lowest, so equal windows select equal suffixes
and it is enough to index those (about one word in eight).  Selected suffixes are partitioned by their
prefix, a subtree per prefix.  Inside it suffixes are told apart by a longer prefix, the whole stretch
of text their windows cover, and only subtrees that still branch there are split once more, by single
windows.  A node of depth ``window`` or more with several leaves is a repeat; its first leaf stays and
the others are removed.  Subtrees are sorted by Spark and read as a stream, so their size is not bounded
by memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from eventstrand.llm.common import Scratch, grams, mix, signed, word_hashes

WINDOW_WORDS, PREFIX_WORDS = 20, 6
DOCS_AT_ONCE = 2_000
# place: 24 bits of the text's hash, so that rows with one id and two texts stay apart, and a word number
_START_BITS = 39
_START_MASK = (1 << _START_BITS) - 1
_SUFFIXES = "prefix long, content long, doc_id long, place long, n long, repeat boolean"
_NAMES = ["prefix", "content", "doc_id", "place", "n", "repeat"]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _base(text: str | None) -> int:
    return (xxhash.xxh3_64_intdigest(text or "") & 0xFFFFFF) << _START_BITS


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest of every ``width`` neighbours, by doubling."""
    best, at, size = values, np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        n = len(best) - step
        right = best[step:] < best[:n]
        best, at = np.where(right, best[step:], best[:n]), np.where(right, at[step:], at[:n])
        size += step
    return at


def _select(words: np.ndarray, doc: np.ndarray, window: int, prefix: int):
    """Stretches of windows with one selected suffix: prefix hash, content hash, first word, windows."""
    if len(words) < window:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    heads, whole = grams(words, prefix), grams(words, window)
    n = len(whole)
    at = _sliding_argmin(heads, window - prefix + 1)[:n]
    inside = np.flatnonzero(doc[:n] == doc[window - 1 :])
    if not len(inside):
        return _select(words[:0], doc, window, prefix)
    breaks = np.flatnonzero((np.diff(inside) > 1) | (np.diff(at[inside]) != 0)) + 1
    first, last = inside[np.append(0, breaks)], inside[np.append(breaks, len(inside)) - 1]
    content = mix(whole[first] * np.uint64(3) + mix(whole[last] + (last - first).astype(np.uint64)))
    return heads[at[first]], content, first, last - first + 1


def _suffixes(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """The selected suffixes of all texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                ids, texts = part.column(0).to_numpy(), part.column(1).to_pylist()
                split = [_words(t) for t in texts]
                sizes = np.array([len(w) for w in split])
                doc = np.repeat(np.arange(len(split)), sizes)
                hashes = word_hashes([w for words in split for w in words])
                head, content, first, n = _select(hashes, doc, window, prefix)
                base = np.array([_base(t) for t in texts], np.int64)
                owner = doc[first] if len(first) else first
                place = base[owner] + first - (np.cumsum(sizes) - sizes)[owner]
                yield _marked([signed(head), signed(content), ids[owner], place, n])

    return docs.mapInArrow(run, _SUFFIXES)


def _batch(columns: list[np.ndarray], repeat: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([*map(pa.array, columns), pa.array(repeat)], names=_NAMES)


def _marked(columns: list[np.ndarray]) -> pa.RecordBatch:
    """The suffixes of a batch, sorted; what repeats inside it is marked before it is shuffled."""
    order = np.lexsort(columns[3::-1])
    columns = [c[order] for c in columns]
    return _batch(columns, _is_repeat(columns)[0])


def _is_repeat(columns: list[np.ndarray], carried: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For sorted suffixes: is there an equal one at an earlier place, and does a new content start here?

    ``carried`` is the first row of the content that the rows before ended with.
    """
    prefix, content, doc, place, _ = columns
    n = len(prefix)
    starts = np.ones(n, bool)
    starts[1:] = (prefix[1:] != prefix[:-1]) | (content[1:] != content[:-1])
    if n and carried is not None:
        starts[0] = (prefix[0], content[0]) != carried[:2]
    leader = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
    known = leader >= 0
    first_doc = np.where(known, doc[leader], carried[2] if carried else 0)
    first_place = np.where(known, place[leader], carried[3] if carried else 0)
    return (doc != first_doc) | (place != first_place), starts


def _walk(suffixes: DataFrame) -> DataFrame:
    """Stream sorted subtrees; ``repeat`` rows go, the others come back only if their prefix branches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, pending = None, None
        for batch in batches:
            known = batch.column(5)
            if pc.any(known).as_py():
                yield batch.filter(known)
                batch = batch.filter(pc.invert(known))
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns[:5]]
            repeat, starts = _is_repeat(columns, carried)
            prefix = columns[0]
            leaders = np.flatnonzero(starts)
            heads = prefix[leaders]
            # a prefix branches if two contents start in it, here or in earlier batches
            beside = np.zeros(len(leaders), bool)
            beside[1:] = heads[1:] == heads[:-1]
            beside[:-1] |= heads[:-1] == heads[1:]
            if len(leaders) and carried is not None and heads[0] == carried[0]:
                beside[0] = True
                if pending is not None:
                    yield pending
            branch = np.zeros(len(prefix), bool)
            branch[leaders] = beside
            out = repeat | branch
            yield _batch([c[out] for c in columns], repeat[out])
            if len(leaders):
                i = leaders[-1]
                carried = tuple(c[i] for c in columns[:4])
                if beside[-1]:
                    pending = None
                else:
                    pending = _batch([c[i : i + 1] for c in columns], np.zeros(1, bool))

    return suffixes.select(_NAMES).mapInArrow(run, _SUFFIXES)


def _subtrees(suffixes: DataFrame, *prefix: str) -> DataFrame:
    """Suffixes dealt by prefix and sorted; those already known as repeats only pass, spread over all tasks."""
    dealt = F.when(F.col("repeat"), F.xxhash64("doc_id", "place")).otherwise(F.xxhash64(*prefix))
    return suffixes.repartition(dealt).sortWithinPartitions("repeat", "prefix", "content", "doc_id", "place")


def _windows(docs: DataFrame, branching: DataFrame, window: int) -> DataFrame:
    """Single windows of the stretches that share a prefix with other contents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for i in range(batch.num_rows):
                doc_id, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                base = _base(text)
                found = batch.column(2)[i].values
                prefix, place, n = (found.field(k).to_numpy() for k in range(3))
                mine = place & ~_START_MASK == base
                prefix, start, n = prefix[mine], (place[mine] & _START_MASK), n[mine]
                whole = grams(word_hashes(_words(text)), window)
                starts = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
                parts.append((np.repeat(prefix, n), signed(whole)[starts], np.full(len(starts), doc_id), base + starts))
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 4
            columns.append(np.ones(len(columns[0]), np.int64))
            yield _marked(columns)

    stretches = branching.groupBy("doc_id").agg(F.collect_list(F.struct("prefix", "place", "n")).alias("found"))
    return docs.join(stretches, "doc_id").select("doc_id", "text", "found").mapInArrow(run, _SUFFIXES)


def remove_repeats(df: DataFrame, window: int = WINDOW_WORDS, prefix: int = PREFIX_WORDS, text: str = "text") -> DataFrame:
    """``doc_id, text, n_words, n_removed, kept_text`` for every row of ``doc_id`` and ``text``.

    A word is removed if a window of ``window`` words that covers it also starts earlier: in a document
    with a smaller id, or earlier in the same one.  Windows are judged on the input.  Kept words are joined
    by one space.  A null or empty text has no words.  Repeated rows are one document and do not remove
    each other; rows with one id and different texts are ordered by a hash of the text.  A row without
    id removes nothing and loses nothing.  An empty table gives no rows.  Other columns are ignored.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = docs.where(F.col("doc_id").isNotNull())

    def rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for i in range(batch.num_rows):
                value, found = batch.column(1)[i].as_py(), batch.column(2)[i]
                words = _words(value)
                change = np.zeros(len(words) + 1, np.int32)
                if found.is_valid:
                    place, n = (found.values.field(k).to_numpy() for k in range(2))
                    mine = place & ~_START_MASK == _base(value)
                    start = place[mine] & _START_MASK
                    np.add.at(change, start, 1)
                    np.add.at(change, start + n[mine] + window - 1, -1)
                stay = np.cumsum(change[:-1]) == 0
                sizes.append(len(words))
                removed.append(int(len(words) - stay.sum()))
                kept.append(b" ".join([w for w, s in zip(words, stay.tolist(), strict=True) if s]).decode())
            columns = [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (sizes, removed)), pa.array(kept, pa.string())]
            yield pa.record_batch(columns, names=["doc_id", "text", "n_words", "n_removed", "kept_text"])

    with Scratch(df.sparkSession, "substrings") as scratch:
        walked = scratch.keep(_walk(_subtrees(_suffixes(named, window, prefix), "prefix")), "walked")
        branching = walked.where("not repeat")
        windows = scratch.keep(_walk(_subtrees(_windows(named, branching, window), "prefix", "content")).where("repeat"), "windows")
        repeats = walked.where("repeat").select("doc_id", "place", "n").unionByName(windows.select("doc_id", "place", "n"))
        gone = scratch.hand_over(repeats.groupBy("doc_id").agg(F.collect_list(F.struct("place", "n")).alias("gone")))
    return docs.join(gone, "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(
        rewrite, "doc_id long, text string, n_words long, n_removed long, kept_text string"
    )
