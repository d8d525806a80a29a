"""Alignment of two tokenizers by interval coalescing, and how often their tokens are linked in the corpus.

All A and B tokens of a text are intervals of its bytes.  Sorted by start, with the running maximum of their
ends, a new group begins where a start reaches that maximum; within a group all A tokens are linked with all
B tokens.  Groups end at spaces between words in any case, so words are aligned once and remembered.

Workers turn blocks of documents into their id pairs, the pairs of each word and the words of each document.
Pairs are counted by shards of the pairs: a block sends a pair once with the number of its documents
that hold it, and gets the corpus-wide count back.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from eventstrand.llm.common import Scratch, kept_by_worker, mix
from eventstrand.llm.tokens import ByteWords, byte_characters, pieces

# Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
# A shard's task holds about so many pairs of blocks.
LEAST_SHARDS, PAIRS_AT_ONCE = 64, 1 << 21
# Words a worker remembers, in two generations, and their bytes; words encoded and links sorted at once.
REMEMBERED, REMEMBERED_BYTES, WORDS_AT_ONCE, LINKS_AT_ONCE = 260_000, 32 << 20, 400, 1 << 21

def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] numbers), first[1], ..."""
    before = np.cumsum(size) - size
    return np.repeat(first - before, size) + np.arange(int(size.sum()))


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers of at least 0, compressed by planes of their bytes."""
    numbers = np.ascontiguousarray(numbers, dtype="<u8")
    planes = numbers.view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    count = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], decompressed_size=8 * count, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).reshape(-1).view("<u8").astype(np.int64)


def coalesce(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group number of every A and of every B token, from the byte lengths of tokens that cover one text."""
    ends = np.concatenate([np.cumsum(a_sizes), np.cumsum(b_sizes)])
    starts = ends - np.concatenate([a_sizes, b_sizes])
    order = np.lexsort((ends, starts))
    furthest = np.maximum.accumulate(ends[order])
    breaks = np.zeros(len(order), np.int64)
    breaks[1:] = starts[order][1:] >= furthest[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    return group[: len(a_sizes)], group[len(a_sizes) :]


_AFTER = np.array([",", "|", ";", "\n"], object)


class Aligner:
    """Groups of a piece: ``(numbers, text)``, or None where the tokens do not give back its bytes.

    ``numbers``: groups, A tokens, B tokens, A tokens of each group, B tokens of each group, A ids, B ids.
    """

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        of_char = {c: b for b, c in byte_characters().items()}
        self.a_bytes = [
            bytes(of_char[c] for c in token) if all(c in of_char for c in token) else token.encode()
            for token in (self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size()))
        ]
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))
        ]
        self.sizes = [np.array([len(x) for x in side]) for side in (self.a_bytes, self.b_bytes)]
        self.a_names, self.b_names = (np.array([str(i) for i in range(len(side))], object) for side in (self.a_bytes, self.b_bytes))
        self.byte_words = ByteWords(self.a)
        self.b_bits = (len(self.b_bytes) - 1).bit_length()
        self.young: dict = {}
        self.old: dict = {}
        self.held = 0

    def _a_ids(self, words: list[str]) -> list[int]:
        """A's ids of words that stand beside each other, each after a space."""
        parts = [self.byte_words.ids(w) for w in words]
        others = [i for i, part in enumerate(parts) if part is None]
        if others:
            ids = self.a.encode(" " + " ".join([words[i] for i in others]), add_special_tokens=False).ids
            ends = np.cumsum(self.sizes[0][ids])
            cuts = np.searchsorted(ends, np.cumsum([len(words[i].encode()) + 1 for i in others])) + 1
            for i, start, stop in zip(others, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                parts[i] = ids[start:stop]
        return [x for part in parts for x in part]

    def align(self, words: list[str]) -> list[tuple[bytes, str] | None]:
        """Words that stand beside each other, encoded as one text."""
        text = " ".join(words)
        whole = b" " + text.encode()
        a, b = self._a_ids(words), self.b.encode(text, num_threads=1)
        if b"".join([self.a_bytes[i] for i in a]) != whole or b"".join([self.b_bytes[i] for i in b]) != whole:
            if len(words) == 1:
                return [None]
            half = len(words) // 2
            return self.align(words[:half]) + self.align(words[half:])
        ids = np.array(a, np.int64), np.array(b, np.int64)
        group = coalesce(self.sizes[0][ids[0]], self.sizes[1][ids[1]])
        n_groups = int(group[0][-1]) + 1
        count = [np.bincount(g, minlength=n_groups) for g in group]
        # groups end where words do
        group_end = np.cumsum(self.sizes[0][ids[0]])[np.cumsum(count[0]) - 1]
        word_end = np.cumsum([len(w.encode()) + 1 for w in words])
        last = np.searchsorted(group_end, word_end)
        n = np.diff(last, prepend=-1)
        tokens = [np.diff(np.cumsum(c)[last], prepend=0) for c in count]
        return list(zip(self._numbers(n, tokens, count, ids), self._texts(group, last, ids), strict=True))

    @staticmethod
    def _numbers(n: np.ndarray, tokens: list, count: list, ids: tuple) -> list[bytes]:
        """Each word's numbers in a row."""
        size = 3 + 2 * n + tokens[0] + tokens[1]
        at = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), "<u4")
        flat[at], flat[at + 1], flat[at + 2] = n, *tokens
        flat[_ragged(at + 3, n)], flat[_ragged(at + 3 + n, n)] = count
        flat[_ragged(at + 3 + 2 * n, tokens[0])], flat[_ragged(at + 3 + 2 * n + tokens[0], tokens[1])] = ids
        data = flat.tobytes()
        return [data[4 * i : 4 * (i + k)] for i, k in zip(at.tolist(), size.tolist(), strict=True)]

    def _texts(self, group: tuple, last: np.ndarray, ids: tuple) -> list[str]:
        """Each word's groups as text: the tokens in order with what follows each."""
        side = np.repeat([0, 1], [len(x) for x in ids])
        place = 2 * np.concatenate(group) + side
        order = np.argsort(place, kind="stable")
        place = place[order]
        ends = np.append(place[1:] != place[:-1], True)
        # a comma inside a side, a bar after A's, a semicolon after a group, a new line after a word
        after = np.where(ends, 1 + (place & 1) + np.isin(place, 2 * last + 1), 0)
        parts = np.empty(2 * len(order), object)
        parts[0::2] = np.concatenate([self.a_names[ids[0]], self.b_names[ids[1]]])[order]
        parts[1::2] = _AFTER[after]
        return "".join(parts.tolist()).split("\n")[:-1]

    def look_up(self, words: list[str]) -> list[tuple[bytes, str] | None]:
        """The alignment of each word; words not met lately are encoded together."""
        if len(self.young) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        young, old, unknown = self.young, self.old, object()
        result = [young.get(word, unknown) for word in words]
        apart, beside = [], []
        for place, found in enumerate(result):
            if found is not unknown:
                continue
            word = words[place]
            found = old.get(word, unknown)
            if found is not unknown:
                result[place] = young[word] = found
            # white space at an end of a text would run into the next word's space
            elif word[0].isspace() or word[-1].isspace():
                apart.append([place])
            else:
                beside.append(place)
        for part in apart + [beside[at : at + WORDS_AT_ONCE] for at in range(0, len(beside), WORDS_AT_ONCE)]:
            for place, found in zip(part, self.align([words[i] for i in part]), strict=True):
                word, result[place] = words[place], found
                size = len(word) + (len(found[0]) + len(found[1]) if found else 0)
                if size < 1_000:  # long ones hardly come again
                    young[word] = found
                    self.held += size
        return result


def _aligner(path_a: str, path_b: str) -> Aligner:
    """One per Python worker and pair of vocabularies."""
    return kept_by_worker((Aligner, path_a, path_b), lambda: Aligner(path_a, path_b))


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


_BLOCK = (
    "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups_sha256 array<string>, n_pairs long, pairs binary, held binary, word_pairs binary, word_sizes binary, "
    "words binary, times binary, doc_sizes binary"
)


def _block(number: int, ids: list, texts: list[str], aligner: Aligner) -> pa.RecordBatch:
    """What is kept of a block of documents."""
    numbers, docs = _Numbers(), []
    for text in texts:
        cut = pieces(text) if text else []
        docs.append(np.fromiter(map(numbers.__getitem__, cut), np.int64, len(cut)))
    codes = aligner.look_up(list(numbers))
    for i, text in enumerate(texts):  # tokens of the whole text decide where those of a word do not give its bytes
        if any(codes[w] is None for w in np.unique(docs[i])):
            whole = aligner.align([text])[0]
            docs[i] = np.empty(0, np.int64) if whole is None else np.array([len(codes)])
            codes += [] if whole is None else [whole]
    codes = [c or (bytes(12), "") for c in codes]

    data = np.frombuffer(b"".join(c[0] for c in codes), "<u4").astype(np.int64)
    size = np.array([len(c[0]) // 4 for c in codes], dtype=np.int64)
    at = np.cumsum(size) - size
    groups, a, b = (data[at + k] for k in range(3)) if len(at) else (at, at, at)
    a_count = data[_ragged(at + 3, groups)]
    b_count = data[_ragged(at + 3 + groups, groups)]
    a_ids = data[_ragged(at + 3 + 2 * groups, a)]
    b_ids = data[_ragged(at + 3 + 2 * groups + a, b)]
    # every A token with the B tokens of its group
    others = np.repeat(b_count, a_count)
    linked = _ragged(np.repeat(np.cumsum(b_count) - b_count, a_count), others)
    links = np.repeat(a_ids, others) << aligner.b_bits | b_ids[linked]
    pairs, word_pairs = np.unique(links, return_inverse=True)
    added = np.concatenate([[0], np.cumsum(a_count * b_count)])
    end = np.cumsum(groups)
    word_sizes = added[end] - added[end - groups]

    held = np.zeros(len(pairs), np.int64)
    first = np.cumsum(word_sizes) - word_sizes
    words, times, doc_sizes, waiting, n_waiting = [], [], [], [], 0

    def count_held() -> None:
        """Each of the waiting documents holds a pair once."""
        doc = np.repeat(np.arange(len(waiting)), [len(w) for w in waiting])
        word = np.concatenate(waiting)
        place = _ragged(first[word], word_sizes[word])
        key = np.sort(np.repeat(doc, word_sizes[word]) * len(pairs) + word_pairs[place])
        key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
        held[:] += np.bincount(key % max(1, len(pairs)), minlength=len(pairs))

    counts = {name: [] for name in ("n_a", "n_b", "n_groups", "n_links")}
    shas = []
    for doc in docs:
        distinct, often = np.unique(doc, return_counts=True)
        words.append(distinct)
        times.append(often)
        doc_sizes.append(len(distinct))
        for name, of_word in zip(counts, (a, b, groups, word_sizes), strict=True):
            counts[name].append(int((of_word[distinct] * often).sum()))
        shas.append(sha256(";".join([codes[w][1] for w in doc.tolist()]).encode()).hexdigest() if len(doc) else "")
        waiting.append(distinct)
        n_waiting += int(word_sizes[distinct].sum())
        if n_waiting > LINKS_AT_ONCE:
            count_held()
            waiting, n_waiting = [], 0
    if waiting:
        count_held()
    binary = [packed(x) for x in (pairs, held, word_pairs, word_sizes, np.concatenate(words), np.concatenate(times), np.array(doc_sizes))]
    row = [number, ids, *counts.values(), shas, len(pairs), *binary]
    types = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.int64(), *[pa.binary()] * 7]
    names = [column.split()[0] for column in _BLOCK.split(", ")]
    return pa.record_batch([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=names)


def _blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        # the table is stored before it is read, so a number only has to be the task's own
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                if texts and size + len(text) > BLOCK_BYTES:
                    yield _block(number, ids, texts, aligner)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text)
        if texts:
            yield _block(number, ids, texts, aligner)

    return docs.mapInArrow(run, _BLOCK)


def _shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    return (mix(pairs.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _counted(blocks: DataFrame, shards: int, b_bits: int) -> DataFrame:
    """``block, shard, counts``: corpus-wide counts of a block's pairs in a shard, in the block's order.

    One row per shard without a block has ``a`` and ``counts``: the highest count of each A id.
    """

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs, held = unpacked(row["pairs"]), unpacked(row["held"])
                shard = _shard_of(pairs, shards)
                order = np.argsort(shard, kind="stable")
                names, first = np.unique(shard[order], return_index=True)
                parts = [np.split(x[order], first[1:]) for x in (pairs, held)]
                yield pa.record_batch({
                    "shard": pa.array(names, pa.int64()),
                    "block": pa.array([row["block"]] * len(names), pa.int64()),
                    "pairs": pa.array([packed(x) for x in parts[0]][: len(names)], pa.binary()),
                    "held": pa.array([packed(x) for x in parts[1]][: len(names)], pa.binary()),
                })

    def add_up(table: pa.Table) -> pa.Table:
        pairs = [unpacked(x.as_py()) for x in table["pairs"]]
        distinct, place = np.unique(np.concatenate(pairs), return_inverse=True)
        held = np.concatenate([unpacked(x.as_py()) for x in table["held"]])
        counts = np.bincount(place, held, len(distinct)).astype(np.int64)
        a = distinct >> b_bits
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        answers = [packed(x) for x in np.split(counts[place], np.cumsum([len(p) for p in pairs])[:-1])]
        shard = table["shard"][0].as_py()
        return pa.table({
            "block": pa.array([*table["block"].to_pylist(), None], pa.int64()),
            "shard": pa.array([shard] * (len(answers) + 1), pa.int64()),
            "a": pa.array([None] * len(answers) + [packed(a[first])], pa.binary()),
            "counts": pa.array([*answers, packed(np.maximum.reduceat(counts, first))], pa.binary()),
        })

    dealt = blocks.where("n_pairs > 0").select("block", "pairs", "held").mapInArrow(deal, "shard long, block long, pairs binary, held binary")
    return dealt.groupBy("shard").applyInArrow(add_up, "block long, shard long, a binary, counts binary")


def _highest(counted: DataFrame) -> np.ndarray:
    """The highest count of every A id; as long as the vocabulary, so it may be broadcast."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, int] = {}
        for batch in batches:
            for a, count in zip(batch.column(0), batch.column(1), strict=True):
                for i, n in zip(unpacked(a.as_py()).tolist(), unpacked(count.as_py()).tolist(), strict=True):
                    most[i] = max(n, most.get(i, 0))
        yield pa.record_batch([pa.array(list(most), pa.int64()), pa.array(list(most.values()), pa.int64())], names=["a", "n"])

    found = counted.where("block IS NULL").select("a", "counts").mapInArrow(run, "a long, n long").groupBy("a").agg(F.max("n").alias("n")).toArrow()
    a = found["a"].to_numpy()
    highest = np.zeros(int(a.max()) + 1 if len(a) else 1, np.int64)
    highest[a] = found["n"].to_numpy()
    return highest


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(blocks: DataFrame, counted: DataFrame, highest, shards: int, b_bits: int) -> DataFrame:
    """A row per document, from its block and the counts of the block's pairs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                pairs = unpacked(row["pairs"].as_py())
                order = np.argsort(_shard_of(pairs, shards), kind="stable")
                answers = sorted((x["shard"], x["counts"]) for x in row["answers"].as_py() or [])
                counts = np.zeros(len(pairs), np.int64)
                counts[order] = np.concatenate([np.empty(0, np.int64), *[unpacked(x) for _, x in answers]])
                best = counts == highest.value[pairs >> b_bits]
                word_pairs, word_sizes, words, times, doc_sizes = (
                    unpacked(row[name].as_py()) for name in ("word_pairs", "word_sizes", "words", "times", "doc_sizes")
                )
                word_end, doc_end = np.cumsum(word_sizes), np.cumsum(doc_sizes)
                totals = []
                for of_pair in (best.astype(np.int64), counts):
                    added = np.concatenate([[0], np.cumsum(of_pair[word_pairs])])
                    of_word = added[word_end] - added[word_end - word_sizes]
                    added = np.concatenate([[0], np.cumsum(of_word[words] * times)])
                    totals.append(pa.array(added[doc_end] - added[doc_end - doc_sizes]))
                kept = [row[name].values for name in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
                columns = [*kept, *totals, row["groups_sha256"].values]
                yield pa.record_batch(columns, names=[c.split()[0] for c in _RESULT.split(", ")])

    answers = counted.where("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("shard", "counts")).alias("answers"))
    return blocks.join(answers, "block", "left").mapInArrow(run, _RESULT)


def align(df: DataFrame, vocabulary_a: str, vocabulary_b: str, text: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``doc_id, text``.

    A (a byte-level vocabulary of the tokenizers library) encodes space + text, B (a sentencepiece model that
    adds the space) the text; strings of special tokens are plain text.  ``n_links`` counts pairs of an A
    and a B token in one group.  The count of an id pair is the number of rows that hold it linked:
    ``count_sum`` adds it up over the links, ``n_best`` counts the links whose count is their A id's
    highest.  ``groups_sha256`` is the digest of the groups, written ``a1,a2|b1;a3|b2,b3``.

    Texts that are null or empty, and those whose tokens do not give back space + text byte by byte, have
    no tokens: zeros and an empty string.  Every row is a document, also repeated ones and those without
    id or with an id in common.  Very long texts are cut at spaces between words, where tokens and groups
    end in any case.  An empty table gives no rows; other columns are ignored.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    b_bits = _aligner(vocabulary_a, vocabulary_b).b_bits
    with Scratch(df.sparkSession, "alignment") as scratch:
        blocks = scratch.keep(_blocks(docs, vocabulary_a, vocabulary_b), "blocks")
        total = blocks.agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n")).first().n
        shards = max(LEAST_SHARDS, -(-total // PAIRS_AT_ONCE))
        counted = scratch.keep(_counted(blocks, shards, b_bits), "counted")
        highest = df.sparkSession.sparkContext.broadcast(_highest(counted))
        return scratch.hand_over(_scored(blocks, counted, highest, shards, b_bits))
