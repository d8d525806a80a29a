"""Secret scans on the JVM: known forms, and a battery of randomness tests for strings without a form."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# (kind, pattern, group whose length counts, least length), as the task defines them.
BASE_KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
RANDOM = "random"
MIN_TOKEN = 20
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}+"
# Alphabets in the order of preference: the first that holds a whole token is its encoding.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    (_DIGITS + "abcdef", "^[0-9a-f]+$"),
    (_DIGITS + "ABCDEF", "^[0-9A-F]+$"),
    (_UPPER + "234567", "^[A-Z2-7]+$"),
    (_LOWER + _DIGITS, "^[a-z0-9]+$"),
    (_UPPER + _DIGITS, "^[A-Z0-9]+$"),
    (_UPPER + _LOWER + _DIGITS, "^[A-Za-z0-9]+$"),
    (_UPPER + _LOWER + _DIGITS + "+/", "^[A-Za-z0-9+/]+$"),
    (_UPPER + _LOWER + _DIGITS + "-_", "^[A-Za-z0-9_-]+$"),
)
# Words: chance that two letters agree, its third moment, and how often the kind of character changes.
TEXT_AGREE, TEXT_AGREE3, TEXT_CHANGE = 0.065, 0.0054, 0.15
LENGTH_STEPS = (32, 48, 96)
FALSE_SHARE, RANDOM_LEVEL = 0.01, 1e-3
_BINS_PER_E, _LAST_BIN = 8, 400


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z) by the logistic approximation with a cubic term (error below 2e-4), never 0."""
    z = F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))
    return F.greatest(1 / (1 + F.exp(1.5976 * z + 0.070565992 * z * z * z)), F.lit(1e-300))


def _fisher(*p: Column) -> Column:
    """Fisher's combination of independent p-values in closed form."""
    x = -sum((F.log(q) for q in p[1:]), F.log(p[0]))
    terms = sum((F.pow(x, F.lit(k)) / math.factorial(k) for k in range(1, len(p))), F.lit(1.0))
    return F.least(F.exp(-x) * terms, F.lit(1.0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _changes(values: Column) -> Column:
    """How many neighbours differ."""
    return F.size(F.filter(values, lambda x, i: (i > 0) & (x != F.get(values, i - 1)))).cast("double")


def _battery(alphabet: Column, body: Column) -> Column:
    """p-values of a token as a random string over its alphabet and as text."""

    def tests(v: Column) -> Column:
        x, kinds = v["x"], v["kinds"]
        n, k = F.size(x).cast("double"), F.length(alphabet).cast("double")
        agree = v["squares"]  # sum of squared counts
        # chi-squared against equal use of the alphabet, Wilson and Hilferty
        df = k - 1
        chi = F.greatest(k * agree / n - n, F.lit(0.0))
        p_chi = _upper_tail((F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        # runs above and below the middle of the alphabet
        low = F.size(F.filter(x, lambda c: c < k / 2)).cast("double")
        high = n - low
        runs = _changes(F.transform(x, lambda c: c < k / 2)) + 1
        mean = 2 * low * high / n + 1
        spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
        p_runs = F.least(2 * _upper_tail(F.abs(runs - mean) / spread), F.lit(1.0))
        # correlation of neighbours
        middle = _sum(x) / n
        square = _sum(F.transform(x, lambda c: (c - middle) * (c - middle)))
        product = _sum(F.transform(x, lambda c, i: F.when(i > 0, (c - middle) * (F.get(x, i - 1) - middle)).otherwise(0.0)))
        serial = product / F.greatest(square, F.lit(1e-9))
        p_serial = F.least(2 * _upper_tail(F.abs(serial) * F.sqrt(n)), F.lit(1.0))
        # as text: fewer agreeing letters than words have, more changes between letters and digits
        pairs, triples = n * (n - 1) / 2, n * (n - 1) * (n - 2)
        expected = TEXT_AGREE * pairs
        deviation = F.sqrt((TEXT_AGREE - TEXT_AGREE**2) * pairs + (TEXT_AGREE3 - TEXT_AGREE**2) * triples)
        p_agree = _upper_tail((expected - (agree - n) / 2) / deviation)
        change = (_changes(kinds) - 0.5 - TEXT_CHANGE * (n - 1)) / F.sqrt(TEXT_CHANGE * (1 - TEXT_CHANGE) * (n - 1))
        return F.struct(
            n.cast("int").alias("n"),
            _fisher(p_chi, p_runs, p_serial).alias("p_random"),
            _fisher(p_agree, _upper_tail(change)).alias("p_text"),
        )

    kind = F.translate(
        body, _DIGITS + _LOWER + _UPPER + "+/_-", "0" * 10 + "a" * 26 + "A" * 26 + "+" * 4
    )
    characters = F.filter(F.split(body, ""), lambda c: c != "")
    used = lambda x: F.transform(F.array_distinct(x), lambda c: F.pow(F.size(F.filter(x, lambda d: d == c)), F.lit(2.0)))
    return _let(
        F.transform(characters, lambda c: F.position(c, alphabet).cast("double") - 1),
        lambda x: _let(
            F.struct(x.alias("x"), F.filter(F.split(kind, ""), lambda c: c != "").alias("kinds"), _sum(used(x)).alias("squares")),
            tests,
        ),
    )


def _tested(token: Column) -> Column:
    """The battery's struct for a token; null for one that is no encoding, too short, or lacks digits or letters."""
    body = F.rtrim(token, F.lit("="))
    alphabet = F.coalesce(*[F.when(body.rlike(p), F.lit(a)) for a, p in ENCODINGS])
    mixed = body.rlike("[0-9]") & body.rlike("[A-Za-z]") & (F.length(body) >= MIN_TOKEN)
    return _let(F.struct(alphabet.alias("a"), body.alias("b")), lambda v: F.when(mixed & v["a"].isNotNull(), _battery(v["a"], v["b"])))


def _stratum(n: Column) -> Column:
    """0 for the shortest tokens, one more from each of ``LENGTH_STEPS`` on."""
    return sum(((n >= step).cast("int") for step in LENGTH_STEPS), F.lit(0))


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.log(F.greatest(p, F.lit(1e-300))) * _BINS_PER_E), F.lit(_LAST_BIN)).cast("int")


def _texts(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def discovery_bins(df: DataFrame, text: str = "text", false_share: float = FALSE_SHARE) -> dict[int, int]:
    """Per length class the least bin of p_text that counts as "not text" at the given false-discovery share.

    Benjamini and Hochberg's step-up on a histogram of all tokens of all texts: a bin counts at its
    largest p-value, so the share is never exceeded.  Only the histogram, at most 4 x 401 rows, is collected.
    """
    tokens = df.select(F.explode(F.regexp_extract_all(_texts(F.col(text)), F.lit(TOKEN), F.lit(0))).alias("token"))
    tested = tokens.select(_tested(F.col("token")).alias("t")).where("t is not null")
    rows = tested.groupBy(_stratum(F.col("t.n")).alias("stratum"), _bin(F.col("t.p_text")).alias("bin")).count().collect()
    found = {}
    for stratum in {r["stratum"] for r in rows}:
        mine = sorted(((r["bin"], r["count"]) for r in rows if r["stratum"] == stratum), reverse=True)
        total, above = sum(c for _, c in mine), 0
        for b, count in mine:
            above += count
            if math.exp(-b / _BINS_PER_E) * total <= false_share * above:
                found[stratum] = b
    return found


def _spans(text: Column, pattern: str, keep: Callable[[Column, Column], Column], kind: str, rank: int) -> Column:
    """Spans in code points of the leftmost matches, from the lengths of matches and of the text between.

    ``keep(match, i)`` chooses among them.
    """
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")

    def located(v: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(v["gaps"], i))
            match = F.get(v["matches"], i)
            end = start + F.length(match)
            span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
            return F.struct(
                end.alias("at"), F.concat(acc["spans"], F.when(keep(match, i), F.array(span)).otherwise(none)).alias("spans")
            )

        begin = F.struct(F.lit(0).alias("at"), none.alias("spans"))
        return F.aggregate(F.sequence(F.lit(0), F.size(v["matches"]) - 1), begin, step, lambda acc: acc["spans"])

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(
        matches,
        lambda m: F.when(F.size(m) == 0, none).otherwise(
            _let(F.struct(m.alias("matches"), F.split(text, pattern, -1).alias("gaps")), located)
        ),
    )


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(df: DataFrame, text: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """Add ``base_spans`` and ``secret_spans``, arrays of (start, rank, end, kind) in code points, by start.

    ``base_spans`` are the known forms of ``BASE_KINDS``.  ``secret_spans`` holds them and the tokens that no
    known form overlaps, that are discovered not to be text at a false share of ``false_share`` among the
    tokens of their length class, and that pass the randomness battery at level ``RANDOM_LEVEL``.  Whole
    texts are scanned; a null or empty text has no spans.  One row per input row, repeated ones included;
    other columns stay, those with an output's name are replaced.  An empty table gives no rows.  Tokens below
    the length and without the mix of characters that ``TOKEN`` asks for are not tested for randomness.
    """
    bins = discovery_bins(df, text, false_share)
    whole = _texts(F.col(text))
    base = []
    for rank, (kind, pattern, group, least) in enumerate(BASE_KINDS):
        def long_enough(match: Column, i: Column, pattern=pattern, group=group, least=least) -> Column:
            return F.length(F.regexp_extract(match, pattern, group)) >= least

        base.append(_spans(F.col("__whole"), pattern, long_enough, kind, rank))

    def random(match: Column, i: Column) -> Column:
        def passes(t: Column) -> Column:
            stratum = _stratum(t["n"])
            least = F.coalesce(*[F.when(stratum == s, F.lit(b)) for s, b in bins.items()], F.lit(_LAST_BIN + 1))
            return (_bin(t["p_text"]) >= least) & (t["p_random"] >= RANDOM_LEVEL)

        return F.coalesce(_let(_tested(match), passes), F.lit(False))

    found = df.withColumn("__whole", whole).withColumn("base_spans", F.sort_array(F.concat(*base)))
    free = F.filter(
        _spans(F.col("__whole"), TOKEN, random, RANDOM, len(BASE_KINDS)),
        lambda s: ~F.exists(F.col("base_spans"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    return found.withColumn("secret_spans", F.sort_array(F.concat("base_spans", free))).drop("__whole")


def mask(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or stretch of overlapping spans, replaced by ``mark``; null stays null."""

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        between = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.concat(acc["out"], F.when(inside, F.lit("")).otherwise(between)).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, begin, step, rest))


def digest(spans: Column) -> Column:
    """Lower-case hex sha256 of the spans as ``kind:start:end``, comma-joined."""
    return F.sha2(written(spans).cast("binary"), 256)
