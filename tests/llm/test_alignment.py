"""Alignment of two tokenizers against plain Python over whole texts."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from eventstrand.llm import alignment
from eventstrand.llm.queries import op11_tokenizer_alignment
from eventstrand.llm.tokens import BYTE_BPE, PIECE_BPE, vocabulary_path

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def vocabularies():
    a = Tokenizer.from_file(vocabulary_path(BYTE_BPE))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=vocabulary_path(PIECE_BPE))


def byte_of_char():
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


CHARS = byte_of_char()


def plain_groups(text, a, b):
    """(A ids, B ids) of each group; none where the bytes differ."""
    if not text:
        return []
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_bytes = [bytes(CHARS[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in b_ids for p in [b.id_to_piece(i)]]
    whole = (" " + text).encode()
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return []
    ends = [set(np.cumsum([len(x) for x in side]).tolist()) for side in (a_bytes, b_bytes)]
    groups, i, j, at_a, at_b = [], 0, 0, 0, 0
    for end in sorted(ends[0] & ends[1]):
        group = ([], [])
        while at_a < end:
            group[0].append(a_ids[i])
            at_a, i = at_a + len(a_bytes[i]), i + 1
        while at_b < end:
            group[1].append(b_ids[j])
            at_b, j = at_b + len(b_bytes[j]), j + 1
        groups.append(group)
    return groups


def plain(rows, vocabularies):
    groups = [plain_groups(text, *vocabularies) for _, text in rows]
    links = [Counter((x, y) for xs, ys in doc for x in xs for y in ys) for doc in groups]
    counts = Counter(pair for doc in links for pair in doc)
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    result = []
    for (i, _), doc, linked in zip(rows, groups, links, strict=True):
        written = ";".join(f"{','.join(map(str, xs))}|{','.join(map(str, ys))}" for xs, ys in doc)
        result.append((
            i, sum(len(xs) for xs, _ in doc), sum(len(ys) for _, ys in doc), len(doc), sum(linked.values()),
            sum(n for pair, n in linked.items() if counts[pair] == highest[pair[0]]),
            sum(n * counts[pair] for pair, n in linked.items()), sha256(written.encode()).hexdigest() if doc else "",
        ))
    return result


def check(df, rows, vocabularies):
    got = alignment.align(df, vocabulary_path(BYTE_BPE), vocabulary_path(PIECE_BPE))
    assert got.columns == COLUMNS
    key = lambda r: (r[0] is not None, r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain(rows, vocabularies), key=key)


def test_odd_documents(odd_docs, odd_list, empty_docs, vocabularies):
    check(odd_docs, [(i, t) for i, t, *_ in odd_list], vocabularies)
    assert alignment.align(empty_docs, vocabulary_path(BYTE_BPE), vocabulary_path(PIECE_BPE)).collect() == []


def odd_texts():
    rng = random.Random(5)
    parts = [
        " ", " ", " ", "  ", "\n", "\t", "\r\n", " \n", "　", "\xa0", "\x85", "\x00", "the", "Word", "ing", "é", "ß", "日本", "语", "\U0001f600",
        "'s", "can't", "123", "4,567.8", "...", "<s>", "</s>", "<unk>", "<0x0A>", "<|endoftext|>", "a", "▁", "x" * 40, "-" * 9, "́", "﻿",
    ]
    usual = [p for p in parts if p != "▁"]
    texts = ["".join(rng.choice(parts if rng.random() < 0.1 else usual) for _ in range(rng.randrange(1, 40))) for _ in range(800)]
    return [*texts, " ", "  ", "\n", " a", "a ", "▁", "a ▁b", " ".join(["long"] * 50_000), "ab" * 30_000, "é" * 5_000]


def test_odd_characters_and_spaces(spark, vocabularies):
    rows = list(enumerate([*odd_texts(), None, ""]))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows, vocabularies)


def test_small_blocks_shards_and_memory_give_the_same(monkeypatch, vocabularies):
    """The worker's side with every bound met many times."""
    for name, value in {"REMEMBERED": 20, "WORDS_AT_ONCE": 3, "LINKS_AT_ONCE": 100}.items():
        monkeypatch.setattr(alignment, name, value)
    aligner = alignment.Aligner(vocabulary_path(BYTE_BPE), vocabulary_path(PIECE_BPE))
    texts = odd_texts()[:300]
    want = plain(list(enumerate(texts)), vocabularies)
    held = Counter()
    for at in range(0, len(texts), 7):
        part = texts[at : at + 7]
        row = alignment._block(at, list(range(at, at + len(part))), part, aligner).to_pylist()[0]
        columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
        got = list(zip(*(row[c] for c in columns), strict=True))
        assert got == [(*r[:5], r[7]) for r in want[at : at + 7]]
        pairs, counts = alignment.unpacked(row["pairs"]).tolist(), alignment.unpacked(row["held"]).tolist()
        held.update(dict(zip(pairs, counts, strict=True)))
    links = [{(x, y) for xs, ys in plain_groups(t, *vocabularies) for x in xs for y in ys} for t in texts]
    assert held == Counter(x << aligner.b_bits | y for doc in links for x, y in doc)


def test_coalesce_breaks_where_both_end():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        cuts = [np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, n + 1)), n)) for _ in range(2)]
        sizes = [np.diff(np.concatenate([[0], c])) for c in cuts]
        both = np.intersect1d(*cuts)
        for cut, group in zip(cuts, alignment.coalesce(*sizes), strict=True):
            assert group.tolist() == np.searchsorted(both, cut).tolist()


def test_packed_numbers_come_back():
    for x in ([], [0], [1, 2**40, 255, 256], list(range(70_000))):
        assert alignment.unpacked(alignment.packed(np.array(x, np.int64))).tolist() == x


def test_query_over_whole_table(spark, vocabularies):
    sf_dir = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = op11_tokenizer_alignment(spark, sf_dir)
    assert sorted(tuple(r) for r in got.collect()) == sorted(plain(rows, vocabularies))
