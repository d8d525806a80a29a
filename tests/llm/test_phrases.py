"""Phrase collocations against plain counting of every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from eventstrand.llm import phrases
from eventstrand.llm.common import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, longest=5, limit=2000):
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, longest + 1):
                counts["und" if lang is None else lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    result = set()
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {
            (p[i : i + size], a) for p, a in frequent.items() for size in range(2, len(p)) for i in range(len(p) - size + 1)
        }
        found = []
        for p, a in frequent.items():
            if (p, a) not in inside:
                score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))  # noqa: E741
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:limit], 1):  # noqa: E741
            result.add((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return result


def check(df, rows, **parameters):
    got = [tuple(r) for r in phrases.collocations(df, **parameters).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain(rows, **parameters)
    return got


@pytest.mark.parametrize("least, limit", [(3, 2000), (40, 7)])
def test_odd_documents(odd_docs, odd_list, least, limit):
    assert check(odd_docs, [(lang, text) for _, text, lang, *_ in odd_list], least=least, limit=limit)


def text_of(rng, words, size):
    parts = []
    for _ in range(size):
        parts.append(rng.choice(words))
        parts.append(rng.choice((" ", " ", " ", "  ", "\t", " ", ", ", ".", "\n", "\x0b", " \r ")))
    return "".join(parts)


def many_texts():
    rng = random.Random(8)
    common = ["a", "b", "c", "New", "york", "CITY", "é", "\x1c", "\x85x", "\xa0"]
    rows = [(rng.choice((None, "und", "en", "x y")), text_of(rng, common, rng.randrange(60))) for _ in range(400)]
    rows += [("en", "one two three four five six seven"), ("en", "a a a a a a a a")] * 30
    return [*rows, ("en", None), ("zz", ""), ("en", " ".join(f"w{i % 50}" for i in range(30_000)))]


@pytest.mark.parametrize("small", [False, True])
def test_overlaps_pieces_and_languages(spark, monkeypatch, small):
    if small:  # the bit table is full of wrong answers and every prefix is heavy
        for name, value in {"LEAST_BITS": 6, "MOST_BITS": 6, "HEAVY_SHARE": 10**9}.items():
            monkeypatch.setattr(phrases, name, value)
    rows = many_texts()
    check(spark.createDataFrame(rows, "lang string, text string").repartition(5), rows, least=12)


@pytest.mark.parametrize("length", [2, 3, 5])
def test_stripes_given_out_early_add_up(monkeypatch, length):
    """With every bound of a task met many times, the partial stripes still hold each phrase's count."""
    for name, value in {"BUFFERED": 40, "HELD": 30, "KNOWN": 25}.items():
        monkeypatch.setattr(phrases, name, value)
    anything = phrases.Filter(6, np.array([2**64 - 1], dtype=np.uint64))
    counter = phrases.StripeCounter(length, anything, ["a", "b a"])
    rows = [(lang or "und", text or "") for lang, text in many_texts()[:300]]
    given = [b for lang, text in rows for b in counter.take(lang, [text.encode()])]
    assert len(given) > 5
    given += counter.give_out()
    got, want = Counter(), Counter()
    for batch in given:
        for r in batch.to_pylist():
            assert (r["slice"] == 0) or r["prefix"] in ("a", "b a")
            for word, count in zip(r["next"], r["count"], strict=True):
                got[r["lang"], f"{r['prefix']} {word}"] += count
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            want.update((lang, " ".join(words[i : i + length])) for i in range(len(words) - length + 1))
    assert got == want


def test_no_frequent_phrase_and_empty_table(spark, empty_docs):
    assert phrases.collocations(empty_docs).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", "a b c")], "lang string, text string")).count() == 0


def test_scores_pass_64_bits(spark):
    a, n, l, r = 10**12, 10**15, 3 * 10**12, 10**12 + 7  # noqa: E741
    one = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    assert one.selectExpr(phrases.score_of("a", "n", "l", "r") + " AS s").first().s == 1000 * a * n // (l * r)


def test_levels_shuffle_less_than_all_phrases(spark):
    """Words that are rare, and all phrases with them, are not counted beyond the first level."""
    rng = random.Random(2)
    rows = [("en", " ".join("the of".split() + [f"rare{rng.getrandbits(60)}" for _ in range(8)])) for _ in range(500)]
    df = spark.createDataFrame(rows, "lang string, text string")
    with Scratch(spark, "test") as scratch:
        found, _ = phrases.frequent_phrases(df, scratch, 100, 5)
        level = found.where("length = 1")
        known = phrases._filter_of(level, 1, level.count())
        stripes = phrases._stripes(df, 2, known, [])
        assert {(r.prefix, n) for r in stripes.collect() for n in r.next} == {("the", "of")}
