"""Quality rules as a short-circuit cascade, on the JVM only."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from eventstrand.llm.common import Scratch, words_of

SAMPLE_ROWS = 2_000
_LEAST_SECONDS = 1e-3


Statistics = Mapping[str, Column]


@dataclass(frozen=True)
class Rule:
    """``reject`` is a condition over a document's statistics; null counts as not rejected."""

    name: str
    reject: Callable[[Statistics], Column]


# Limits in the manner of the published web-text filters.
RULES = (
    Rule("few_words", lambda s: s["n_words"] < 50),
    Rule("repeated_words", lambda s: 100 * s["n_repeat_words"] > 50 * s["n_words"]),
    Rule("symbols", lambda s: 10 * s["n_symbols"] > s["n_words"]),
    Rule("repeated_lines", lambda s: 10 * s["n_dup_lines"] > 3 * s["n_lines"]),
    Rule("word_length", lambda s: (s["word_chars"] < 2 * s["n_words"]) | (s["word_chars"] > 15 * s["n_words"])),
    Rule("marks", lambda s: 4 * s["n_marks"] > s["n_words"]),
    Rule("capitals", lambda s: 2 * s["n_capitals"] > s["word_chars"]),
)
BASE_RULES = ("few_words", "repeated_words")


def _bound(column: Column, use: Callable[[Column], Column]) -> Column:
    """``use(column)`` with the column computed once: a one-element transform names it."""
    return F.transform(F.array(column), use)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    The windows' hashes are sorted with their places; equal neighbours are repeats.  Places of repeats
    in order then cover three words each, less the overlap with the one before.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_covered(F.sort_array(windows)))


def _covered(ordered: Column) -> Column:
    def with_order(s: Column) -> Column:
        repeats = F.filter(
            s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])
        )
        places = F.sort_array(F.transform(repeats, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            places,
            start,
            lambda acc, i: F.struct(
                (acc["n"] + 3 - F.greatest(acc["end"] - i, F.lit(0))).alias("n"), (i + 3).alias("end")
            ),
            lambda acc: acc["n"],
        )

    # a one-element transform names the sorted array, so it is computed once
    return F.transform(F.array(ordered), with_order)[0]


def _dup_lines(lines: Column) -> Column:
    return F.size(lines) - F.size(F.array_distinct(lines))


# What a rule may read, from the whole text, its words and its lines that have a word.
_OF_TEXT = {"n_symbols": r"[#*$%&|<>]", "n_marks": r"[!?]", "n_capitals": r"\p{Lu}"}
_OF_WORDS = {"n_words": F.size, "word_chars": lambda w: F.char_length(F.concat_ws("", w)), "n_repeat_words": _repeat_words}
_OF_LINES = {"n_lines": F.size, "n_dup_lines": _dup_lines}
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_marks", "n_capitals")


def _lines_of(whole: Column) -> Column:
    return F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


class _InPlace(Mapping):
    """Statistics as expressions of the text, each computed where it stands; of the given columns where they are."""

    def __init__(self, text: str, columns: Iterable[str] = ()):
        self.whole, self.columns = F.coalesce(F.col(text), F.lit("")), set(columns)

    def __getitem__(self, name: str) -> Column:
        if name in self.columns:
            return F.col(name)
        if name in _OF_TEXT:
            found = F.regexp_count(self.whole, F.lit(_OF_TEXT[name]))
        elif name in _OF_WORDS:
            found = _bound(words_of(self.whole), _OF_WORDS[name])
        else:
            found = _bound(_lines_of(self.whole), _OF_LINES[name])
        return found.cast("long")

    def __iter__(self):
        return iter(STATISTICS)

    def __len__(self) -> int:
        return len(STATISTICS)


def statistics(df: DataFrame, text: str = "text", names: Sequence[str] = STATISTICS) -> DataFrame:
    """Add the named statistics; see :func:`judge` for edge cases."""
    whole = F.coalesce(F.col(text), F.lit(""))
    helpers = df.withColumns({"__words": words_of(F.col(text)), "__whole": whole, "__lines": _lines_of(whole)})
    of = {
        **{name: F.regexp_count("__whole", F.lit(pattern)) for name, pattern in _OF_TEXT.items()},
        **{name: fn(F.col("__words")) for name, fn in _OF_WORDS.items()},
        **{name: fn(F.col("__lines")) for name, fn in _OF_LINES.items()},
    }
    return helpers.withColumns({name: of[name].cast("long") for name in names}).drop("__words", "__whole", "__lines")


def order_rules(sample: DataFrame, rules: Sequence[Rule], text: str = "text") -> list[Rule]:
    """Rules by rejected rows per second on a sample, best first; names break ties.

    What each rule rejects is counted once, for all combinations.  Each rule then runs alone, after that warm-up,
    with its own inputs only, and its cost is its time beyond that of a job that computes nothing.  After
    a rule is chosen only the rows that it passes count for the next.  The order decides how much is
    computed, never the verdict.
    """
    at = _InPlace(text)
    rejects = [F.coalesce(rule.reject(at), F.lit(False)) for rule in rules]
    combined = sample.select(F.array(*rejects).alias("rejects")).groupBy("rejects").agg(F.count("*").alias("n"))
    left = [(r.rejects, r.n) for r in combined.collect()]  # at most 2 ** rules rows

    def seconds(column: Column) -> float:
        began = time.perf_counter()
        sample.agg(F.count_if(column)).first()
        return time.perf_counter() - began

    nothing = [seconds(F.lit(False)) for _ in range(3)]
    noise = max(max(nothing) - min(nothing), _LEAST_SECONDS)  # rules that cost less than that cost the same
    costs = [max(min(seconds(reject) for _ in range(2)) - min(nothing), noise) for reject in rejects]
    order, open_rules = [], set(range(len(rules)))
    while open_rules:
        hits = {i: sum(n for rejected, n in left if rejected[i]) for i in open_rules}
        best = min(open_rules, key=lambda i: (-hits[i] / costs[i], costs[i] if not hits[i] else 0, rules[i].name))
        order.append(rules[best])
        open_rules.remove(best)
        left = [(rejected, n) for rejected, n in left if not rejected[best]]
    return order


def cascade(rules: Sequence[Rule], at: Statistics) -> Column:
    """True unless a rule rejects; a rule and its inputs are evaluated only for rows all earlier ones passed."""
    verdict = None
    for rule in rules:
        condition = F.coalesce(rule.reject(at), F.lit(False))
        verdict = F.when(condition, False) if verdict is None else verdict.when(condition, False)
    return F.lit(True) if verdict is None else verdict.otherwise(True)


def judge(
    df: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 7, text: str = "text",
    report: Sequence[str] = STATISTICS,
) -> DataFrame:
    """Add the statistics named in ``report`` of every whole text, and ``kept``: no rule rejects the document.

    Reported statistics are computed for all rows; any other sits inside the branch of the rule that reads it,
    so without a report ``kept`` computes only what is reached.  The order of the rules comes from about
    ``sample_rows`` rows; statistics and verdicts cover all rows.
    A null or empty text has statistics 0 and is rejected by ``few_words``.  One row per input row,
    repeated ones included; other columns stay, those with an output's name are replaced.  An empty
    table gives an empty result.
    """
    names = [r.name for r in rules]
    if len(set(names)) != len(names):
        raise ValueError(f"rule names must differ: {names}")
    rows = df.count()
    with Scratch(df.sparkSession, "quality") as scratch:
        # stored, so that each rule reads the sample and not the table
        part = scratch.keep(df.select(text).sample(min(1.0, sample_rows / max(rows, 1)), seed), "sample")
        ordered = order_rules(part, rules, text)
    reported = statistics(df, text, report) if report else df
    return reported.withColumn("kept", cascade(ordered, _InPlace(text, report)))
