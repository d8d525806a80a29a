"""Phrase collocations from stripes: every prefix keys an associative counter of the words that follow it.

Phrases grow by a word a level.  At a level each task counts, for the prefixes it meets, the next words; these
partial stripes are shuffled by prefix and merged elementwise.  An entry of a stripe is the count of an
extension, and of the prefix that keys the next level.  A phrase can only be frequent if the phrases
without its last and without its first word are, so a level looks only at such places of the texts.

What tasks know of the level before is a bit table of bounded size: a wrong answer of it costs a counted
phrase that proves rare, never a frequent one.  Counts are of words, not of hashes, so they are exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from eventstrand.llm.common import Scratch, grams, mix, word_hashes

NO_LANG = "und"
# Pieces end at these; words are what stands between spaces and tabs inside a piece.
ENDS = b".,;:!?\n\x0b\x0c\r"
_CUT = b"\xff"  # no byte of UTF-8
_TABLE = bytes.maketrans(ENDS, _CUT * len(ENDS))

# Sizes of what a task holds: bytes of text worked on at once, buffered places, phrases and words.
CHUNK_BYTES, BUFFERED, HELD, KNOWN = 1 << 19, 1 << 20, 1 << 21, 400_000
# The bit table has about 16 bits for every frequent phrase, within these powers of 2.
LEAST_BITS, MOST_BITS, PROBES = 16, 28, 2
# A prefix with more than this share of all words has its stripes cut into slices by the next word.
HEAVY_SHARE, SLICES = 1_000, 512


class Filter:
    """Which phrases may be frequent."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
        return [mix(hashes + np.uint64(i)) >> np.uint64(64 - bits) for i in range(PROBES)]

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for place in self.places(hashes, self.bits):
            found &= (self.words[(place >> np.uint64(6)).astype(np.intp)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def _lang_hash(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


class _Words(dict):
    """Numbers of words in the order they come; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_CUT: 0})
        self.list = [_CUT]

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.list)
        self.list.append(word)
        return number


class StripeCounter:
    """Counts a task's phrases of ``length`` words; ``take`` texts, then read the stripes that are given out."""

    def __init__(self, length: int, known: Filter | None, heavy: list[str]):
        self.length, self.known, self.heavy = length, known, pa.array(heavy, pa.string())
        self._clear()

    def _clear(self) -> None:
        self.words, self.hashes, self.langs = _Words(), np.zeros(1, np.uint64), {}
        self.buffer, self.buffered = [], 0
        self.rows, self.counts = np.empty((0, self.length + 1), np.int32), np.empty(0, np.int64)

    def take(self, lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        data = b"\n".join(texts).lower().translate(_TABLE).replace(_CUT, b" \xff ")
        parts = [*data.split(), _CUT]
        ids = np.fromiter(map(self.words.__getitem__, parts), np.int32, len(parts))
        del parts, data
        rows = self._places(lang, ids)
        if len(rows):
            number = self.langs.setdefault(lang, len(self.langs))
            self.buffer.append(np.column_stack([np.full(len(rows), number, np.int32), rows]))
            self.buffered += len(rows)
        if self.buffered > BUFFERED:
            self._reduce()
        if len(self.counts) > HELD or len(self.words.list) > KNOWN:
            yield from self.give_out()

    def _places(self, lang: str, ids: np.ndarray) -> np.ndarray:
        """The word numbers of all phrases that may be frequent, a row each."""
        size, n = self.length, len(ids) - self.length + 1
        if n <= 0:
            return np.empty((0, size), np.int32)
        if self.known is None:
            at = np.flatnonzero(ids[:n])
        else:
            new = self.words.list[len(self.hashes) :]
            self.hashes = np.concatenate([self.hashes, word_hashes(new)])
            shorter = mix(grams(self.hashes[ids], size - 1) ^ _lang_hash(lang))
            cuts = np.concatenate([[0], np.cumsum(ids == 0)])
            whole = np.flatnonzero(cuts[size:] == cuts[:-size])
            held = np.zeros(len(shorter), bool)
            inside = np.zeros(len(shorter), bool)
            inside[whole] = True
            inside[whole + 1] = True
            inside = np.flatnonzero(inside)
            held[inside] = self.known.holds(shorter[inside])
            at = whole[held[whole] & held[whole + 1]]
        return np.column_stack([ids[at + k] for k in range(size)])

    def _reduce(self) -> None:
        """Equal rows become one with their count; rows end up sorted by language and words."""
        rows = np.concatenate([self.rows, *self.buffer])
        counts = np.concatenate([self.counts, np.ones(self.buffered, np.int64)])
        self.buffer, self.buffered = [], 0
        if not len(rows):
            return
        widths = [max(1, len(self.langs).bit_length()), *[len(self.words.list).bit_length()] * self.length]
        key, used = rows[:, 0].astype(np.int64), widths[0]
        for k in range(1, self.length + 1):
            if used + widths[k] > 62:  # number what is packed so far anew, in its order
                distinct, key = np.unique(key, return_inverse=True)
                used = len(distinct).bit_length()
            key = key << widths[k] | rows[:, k]
            used += widths[k]
        _, first, place = np.unique(key, return_index=True, return_inverse=True)
        self.rows = rows[first]
        self.counts = np.bincount(place, counts, len(first)).astype(np.int64)

    def give_out(self) -> Iterator[pa.RecordBatch]:
        """The stripes counted so far, ``lang, prefix, slice, next, count``; counting starts anew."""
        self._reduce()
        rows, counts = self.rows, self.counts
        if len(rows):
            vocabulary = pa.array(self.words.list[1:], pa.binary()).cast(pa.string())
            langs = pa.array(list(self.langs), pa.string())
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)
            stripe, heads = np.cumsum(new) - 1, rows[new]
            columns = [vocabulary.take(pa.array(heads[:, k] - 1)) for k in range(1, self.length)]
            empty = pa.array([""] * len(heads), pa.string())
            prefix = pc.binary_join_element_wise(*columns, " ") if columns else empty
            heavy = pc.is_in(prefix, value_set=self.heavy).to_numpy(zero_copy_only=False)[stripe]
            slices = np.array([xxhash.xxh3_64_intdigest(w) % SLICES for w in self.words.list], np.int32)
            part = np.where(heavy, slices[rows[:, -1]], 0)
            order = np.lexsort((part, stripe))
            stripe, part = stripe[order], part[order]
            starts = np.flatnonzero(np.concatenate([[True], (stripe[1:] != stripe[:-1]) | (part[1:] != part[:-1])]))
            offsets = pa.array(np.append(starts, len(rows)), pa.int32())
            table = pa.table({
                "lang": langs.take(pa.array(heads[stripe[starts], 0])),
                "prefix": prefix.take(pa.array(stripe[starts])),
                "slice": pa.array(part[starts], pa.int32()),
                "next": pa.ListArray.from_arrays(offsets, vocabulary.take(pa.array(rows[order, -1] - 1))),
                "count": pa.ListArray.from_arrays(offsets, pa.array(counts[order], pa.int64())),
            })
            yield from table.to_batches(max_chunksize=50_000)
        self._clear()


def _stripes(docs: DataFrame, length: int, known, heavy: list[str]) -> DataFrame:
    """Partial stripes of all texts; ``known`` is a broadcast ``Filter`` of the phrases a word shorter."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = StripeCounter(length, known.value if known else None, heavy)
        for batch in batches:
            waiting: dict[str, list[bytes]] = {}
            sizes: dict[str, int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                here = text.as_buffer().to_pybytes()
                waiting.setdefault(lang, []).append(here)
                sizes[lang] = sizes.get(lang, 0) + len(here)
                if sizes[lang] > CHUNK_BYTES:
                    sizes[lang] = 0
                    yield from counter.take(lang, waiting.pop(lang))
            for lang, texts in waiting.items():
                yield from counter.take(lang, texts)
        yield from counter.give_out()

    schema = "lang string, prefix string, slice int, next array<string>, count array<long>"
    return docs.mapInArrow(run, schema)


def _merged(stripes: DataFrame) -> DataFrame:
    """``lang, phrase, a``: stripes of one prefix and slice meet in one task and are added up entry by entry."""
    entries = stripes.repartition("lang", "prefix", "slice").select(
        "lang", "prefix", "slice", F.explode(F.arrays_zip("next", "count")).alias("entry")
    )
    added = entries.groupBy("lang", "prefix", "slice", F.col("entry.next").alias("next")).agg(F.sum("entry.count").alias("a"))
    phrase = F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))
    return added.select("lang", phrase.alias("phrase"), "a")


def _filter_of(frequent: DataFrame, length: int, count: int):
    """A broadcast filter that holds every phrase of ``frequent``; its size is bounded by ``MOST_BITS``."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * count).bit_length()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = {lang: _lang_hash(lang) for lang in pc.unique(batch.column(0)).to_pylist()}
            words = [w for p in batch.column(1).to_pylist() for w in p.encode().split(b" ")]
            whole = grams(word_hashes(words), length)[::length]
            lang = np.array([langs[x] for x in batch.column(0).to_pylist()], dtype=np.uint64)
            places = np.unique(np.concatenate(Filter.places(mix(whole ^ lang), bits)))
            word = (places >> np.uint64(6)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            value = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), first)
            yield pa.record_batch([pa.array(word[first]), pa.array(value.view(np.int64))], names=["word", "value"])

    found = frequent.select("lang", "phrase").mapInArrow(run, "word long, value long")
    table = found.groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    words = np.zeros(1 << max(0, bits - 6), np.uint64)
    words[table["word"].to_numpy()] = table["value"].to_numpy().view(np.uint64)
    return frequent.sparkSession.sparkContext.broadcast(Filter(bits, words))


def score_of(a: str, n: str, l: str, r: str) -> str:  # noqa: E741
    """SQL of floor(1000 a n / (l r)) in exact decimals, which hold all counts below 10 ** 17."""
    wide = lambda x: f"CAST({x} AS DECIMAL(18, 0))"
    return f"(CAST(1000 AS DECIMAL(4, 0)) * ({wide(a)} * {wide(n)})) DIV ({wide(l)} * {wide(r)})"


def frequent_phrases(df: DataFrame, scratch: Scratch, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, length, a`` of all phrases with a >= least, single words too, and ``lang, n``.

    ``df`` has ``lang`` and ``text``, neither null.
    """
    words = scratch.keep(_merged(_stripes(df, 1, None, [""])), "words")
    sizes = scratch.keep(words.groupBy("lang").agg(F.sum("a").alias("n")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    level = scratch.keep(words.where(F.col("a") >= least), "level-1")
    levels = [level]
    for length in range(2, longest + 1):
        count = level.count()
        if not count:
            break
        known = _filter_of(level, length - 1, count)
        # at most HEAVY_SHARE of them, as the counts of one level add up to no more than all words
        heavy = level.where(F.col("a") * HEAVY_SHARE > total).select("phrase").distinct().collect()
        merged = _merged(_stripes(df, length, known, [r.phrase for r in heavy]))
        level = scratch.keep(merged.where(F.col("a") >= least), f"level-{length}")
        levels.append(level)
    found = None
    for length, level in enumerate(levels, 1):
        here = level.select("lang", "phrase", F.lit(length).alias("length"), "a")
        found = here if found is None else found.unionByName(here)
    return found, sizes


def collocations(
    df: DataFrame, least: int = 100, longest: int = 5, limit: int = 2000, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``limit`` best phrases of 2 to ``longest`` words.

    A phrase occurs ``a`` >= ``least`` times inside pieces of the language's texts, overlaps included.  ``l``
    and ``r`` are the counts of the two parts of its lowest-scoring cut (the first such cut), ``n`` is the
    number of all words and ``score`` is floor(1000 a n / (l r)).  Phrases inside a longer frequent one that
    occurs as often are left out.  Ranks are by score, then by a (both descending), then by phrase.

    A null language is ``und``, together with texts marked so; a null or empty text has no words.  Rows
    are counted as they come, repeated ones too.  Languages without frequent phrases have no rows, nor has
    an empty table; other columns are ignored.
    """
    docs = df.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    with Scratch(df.sparkSession, "phrases") as scratch:
        found, sizes = frequent_phrases(docs, scratch, least, longest)
        # a phrase inside a longer one also lies inside one that is a single word longer and as frequent
        size = F.col("length")
        ends = F.array(F.expr("substring_index(phrase, ' ', length - 1)"), F.expr("substring_index(phrase, ' ', 1 - length)"))
        inner = found.where(size > 2).select("lang", "a", F.explode(ends).alias("phrase"))
        most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        candidates = found.where(size > 1).join(most, ["lang", "phrase"], "left").where("longer IS NULL OR longer < a").drop("longer")
        cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).withColumns({
            "first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - length)"),
        })
        left, right = (
            found.select("lang", F.col("phrase").alias(part), F.col("a").alias(name)) for part, name in (("first", "l"), ("rest", "r"))
        )
        scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(sizes, "lang").withColumn(
            "score", F.expr(score_of("a", "n", "l", "r"))
        )
        best = scored.groupBy("lang", "phrase").agg(
            F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut")
        ).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        # a language's best are among the best of its parts
        part = F.pmod(F.xxhash64("phrase"), F.lit(64))
        ahead = best.withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("place") <= limit)
        ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
        return scratch.hand_over(
            ranked.where(F.col("rank") <= limit).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        )
