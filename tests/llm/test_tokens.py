"""Token counts, token files and packing against the tokenizers library called directly."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from eventstrand.llm import counts, minhash, packing, token_files, tokens, toxicity
from eventstrand.llm.common import Scratch
from eventstrand.llm.tokens import BYTE_BPE, WORD_BPE, vocabulary_path

TRICKY = [
    "a  b", " x", "x ", "a \n b", "foo <|endoftext|> bar", "foo  <|endoftext|>bar", "a\xa0 b", "don't can't 'll x's",
    "émile  ", "a\tb c", "x́ y ́z", "<|startoftext|> HI <|endoftext|>", "12 345 a1b", "a\x1cb c\x1c d",
    "Σας ΟΔΟΣ  x", "a b\n\nc d", "", "   ", "a　 b", "ÅX İx", "<|ENDOFTEXT|> a", "a <|endof text|>",
]


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(vocabulary_path(BYTE_BPE))


@pytest.fixture(scope="module")
def word_bpe():
    return Tokenizer.from_file(vocabulary_path(WORD_BPE))


def direct(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_encode_like_whole_texts(byte_bpe, word_bpe, odd_list, monkeypatch):
    monkeypatch.setattr(tokens, "GENERATION_BYTES", 50_000)  # generations change on the way
    rng = random.Random(9)
    parts = ["Word", "été", "Ωmega", "x²", "ªb", "don't", "a1", "ßtraße", "ŉ", "ǆ", "×", "word,", "end.", "why?!", "wait...", "(so)", "'s", "x's.", "l'eau;", "3.5", ":", ".,", "naïve:", "\xada", "ﬁ", "a.\nB", "x!!\ny,\nz###", "a\n\nb", "w$$$", "(w)", "w\"'s", "w.\n's", "w-w", "w_\tw", "w\r\nw", "a\n1", "w<|>"]
    mixed = [" ".join(rng.choice(parts) + rng.choice(("", "", ",", ".", "!?", ".'", "..,")) for _ in range(30)) for _ in range(200)]
    gaps = ["".join(rng.choice(parts) + rng.choice((" ", " ", " ", "  ", " \n", "\t", "\xa0 ")) for _ in range(20)) for _ in range(200)]
    texts = TRICKY + mixed + gaps + [t for _, t, *_ in odd_list if t is None or len(t) < 50_000]
    for text, ids, n in zip(
        texts, tokens.IdPieces(vocabulary_path(BYTE_BPE)).encode(texts),
        tokens.CountPieces(vocabulary_path(WORD_BPE)).encode(texts), strict=True,
    ):
        assert np.frombuffer(ids, "<u4").tolist() == direct(byte_bpe, text), text
        assert n == len(direct(word_bpe, text)), text


def test_counts_of_all_rows(word_bpe, odd_docs, empty_docs):
    rows = counts.count_tokens(odd_docs, vocabulary_path(WORD_BPE), limit=100).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        n = len(direct(word_bpe, r.text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 100)
        assert r.score == "clash"
    assert counts.count_tokens(empty_docs, vocabulary_path(WORD_BPE), limit=1).count() == 0


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    column = pa.array(["a" * 10, None, "b" * 30, "", "c" * 5, "d" * 100, "e"])
    parts = [p.to_pylist() for p in counts._by_bytes(column, 40)]
    assert sum(parts, []) == column.to_pylist()
    assert all(sum(len(t or "") for t in p) <= 40 or len(p) == 1 for p in parts)


def order_key(row):
    return (row[0] is not None, row[0] or 0, row[1] is not None, (row[1] or "").encode())


def test_token_files_roundtrip(byte_bpe, odd_docs, odd_list, empty_docs):
    got = token_files.roundtrip(odd_docs, vocabulary_path(BYTE_BPE), end_id=2, length=64).collect()
    want, start = [], 0
    for doc_id, text, *_ in sorted(odd_list, key=order_key):
        ids = [*direct(byte_bpe, text), 2]
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.roundtrip(empty_docs, vocabulary_path(BYTE_BPE), end_id=2).count() == 0


@pytest.mark.parametrize("bits", [16, 32])
def test_random_access_to_sequences_and_masks(tmp_path, bits, monkeypatch):
    monkeypatch.setattr(token_files, "BATCH_SEQUENCES", 4)
    rng = np.random.default_rng(1)
    documents = [rng.integers(0, 60_000, n).astype(np.uint32) for n in (5, 0, 300, 17, 1, 64)]
    writer = token_files.ShardWriter(str(tmp_path), 3, 16, bits)
    writer.add([1, 2], documents[:2])
    writer.add([3, 4, 5, None], documents[2:])
    writer.close()
    stream = np.concatenate(documents)
    file = token_files.SequenceFile(writer.names[0])
    for i in range(-(-len(stream) // 16)):
        ids, mask = file.sequence(i)
        part = stream[16 * i : 16 * (i + 1)]
        assert ids[: len(part)].tolist() == part.tolist() and mask.sum() == len(part) and len(ids) == 16
    assert file.tokens(3, 200).tolist() == stream[3:203].tolist()
    assert file.tokens(len(stream) - 1, 1).tolist() == stream[-1:].tolist()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["index-000003.arrow", "sequences-000003.arrow"]
    file.close()


def check_packing(rows, capacity):
    """Sequences hold what they may, without gaps."""
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("items_per_task", [50_000, 40])
def test_packing(byte_bpe, odd_docs, odd_list, empty_docs, monkeypatch, items_per_task):
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", items_per_task)
    capacity = 512
    rows = packing.pack_documents(odd_docs, vocabulary_path(BYTE_BPE), end_id=0, capacity=capacity).collect()
    want = []
    for doc_id, text, *_ in odd_list:
        ids = [*direct(byte_bpe, text), 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity)] if len(ids) > capacity else [0]
        for k, at in enumerate(cuts):
            end = cuts[k + 1] if k + 1 < len(cuts) else len(ids)
            want.append((doc_id, k, at, end - at, crc(ids[at:end])))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=key) == sorted(want, key=key)
    bins = check_packing(rows, capacity)
    lower = -(-sum(r.length for r in rows) // capacity)
    assert bins <= lower * 1.15 + 1
    assert packing.pack_documents(empty_docs, vocabulary_path(BYTE_BPE), end_id=0).count() == 0


def test_best_fit_takes_the_fullest_bin_that_has_room():
    rng = random.Random(5)
    for _ in range(100):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(0, 60))]
        bins, offsets, fills = packing.best_fit(sizes, 100)
        simple: list[int] = []
        for s in sorted(sizes, reverse=True):
            room = [b for b in range(len(simple)) if simple[b] + s <= 100]
            if room:
                simple[max(room, key=lambda b: simple[b])] += s
            else:
                simple.append(s)
        assert sorted(fills) == sorted(simple)
        assert all(o + s <= fills[b] for s, b, o in zip(sizes, bins, offsets, strict=True))


def test_rounds_merge_underfull_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 50)
    rng = random.Random(2)
    sizes = [rng.randint(1, 900) for _ in range(2000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, size long")
    with Scratch(spark, "test") as scratch:
        rows = packing.pack(items, 1000, scratch).collect()
    assert sorted(r.item for r in rows) == list(range(2000))
    parts = [type("R", (), {"sequence_id": r.sequence_id, "offset": r.offset, "length": sizes[r.item]}) for r in rows]
    assert check_packing(parts, 1000) <= 1.08 * sum(sizes) / 1000


@pytest.mark.parametrize("end_id, bits", [(70_000, 16), (2, 8), (-1, 16), (2**32, 32)])
def test_ids_that_do_not_fit_are_refused(empty_docs, tmp_path, end_id, bits):
    with pytest.raises(ValueError, match="do not fit"):
        token_files.write_token_files(empty_docs, str(tmp_path), vocabulary_path(BYTE_BPE), end_id, bits=bits)


@pytest.mark.parametrize("operator", ["toxicity", "minhash"])
def test_no_tokenizer_stays_in_the_workers_of_other_operators(spark, operator):
    docs = spark.range(0, 256, 1, 64).selectExpr("id AS doc_id", "concat('some words of document ', id) AS text", "int(id % 2) AS toxic")

    def held() -> int:
        def look(batches):
            import gc

            import pyarrow as pa

            for _ in batches:
                yield pa.record_batch([pa.array([sum(isinstance(x, tokens.Pieces) for x in gc.get_objects())])], names=["n"])

        return docs.mapInArrow(look, "n long").agg({"n": "max"}).first()[0]

    # idle workers take turns, so each has a task of every stage
    packing.pieces(docs, vocabulary_path(BYTE_BPE), 0, 2048).collect()
    assert held() > 0
    (toxicity._counts(docs) if operator == "toxicity" else minhash._sketches(docs, 4, 5)).collect()
    assert held() == 0


def test_a_word_is_remembered_once_whatever_marks_follow_it(byte_bpe):
    encoder = tokens.IdPieces(vocabulary_path(BYTE_BPE))
    marks = ["", ",", ".", "!?", ";", ":", ".)", "-"]
    text = "so " + " ".join(f"Blauwolkigkeité{m}" for m in marks)
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == direct(byte_bpe, text)
    assert sum("Blauwolkigkeité" in piece for piece in encoder.young) == 1


def test_cuts_between_letters_and_marks(byte_bpe, word_bpe):
    rng = random.Random(4)
    letters = ["A", "z", "À", "Ö", "×", "Ø", "ö", "÷", "ø", "ÿ", "ĀĀ", "Ɏ", "ɏ", "ɐ", "Ω", "я", "中", "é", "5", "²"]
    after = ["", " ", ",", "\n", "\n\n", ".\n", "'", "'s ", "\r\n", "\t", "_", " \n", "  ", "\xa0", "\x85", "€", "“", ".'", "\x00"]
    texts = ["".join(rng.choice(letters) * rng.randint(1, 3) + rng.choice(after) for _ in range(12)) for _ in range(3000)]
    for got, n, text in zip(
        tokens.IdPieces(vocabulary_path(BYTE_BPE)).encode(texts),
        tokens.CountPieces(vocabulary_path(WORD_BPE)).encode(texts), texts, strict=True,
    ):
        assert np.frombuffer(got, "<u4").tolist() == direct(byte_bpe, text), text
        assert n == len(direct(word_bpe, text)), text
