"""Toxic passages: token log-odds with Dirichlet priors, maximum-scoring segments, extreme-value calibration."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from eventstrand.llm.common import Scratch, free_worker

MAX_LABELLED_ROWS = 200_000
_WORDS = re.compile(r"\w+").findall
# Prefix lengths tried for words that are not terms themselves, longest first.
PREFIXES = (7, 6, 5, 4)
_SCORES = "struct<evidence: double, n_passages: int, passages: array<struct<start: int, end: int, bits: double>>>"


@dataclass(frozen=True)
class Model:
    """Terms (words, or prefixes written ``abcd*``) with log-odds; all other words score ``-drift``.

    ``lam`` and ``k`` are the extreme-value parameters of segment scores in clean text; ``bias`` and
    ``slope`` turn evidence into a probability.  The size is bounded by the labelled sample.
    """

    terms: Mapping[str, float] = field(default_factory=dict)
    drift: float = 0.1
    lam: float = 1.0
    k: float = 0.1
    bias: float = -2.0
    slope: float = 0.0


def features(words: Iterable[str]) -> set[str]:
    """Distinct words of a document and their prefixes."""
    found = set(words)
    return found | {f"{w[:n]}*" for w in found for n in PREFIXES if len(w) > n}


def lookup(terms: Mapping[str, float], word: str) -> float | None:
    """Log-odds of a word, or of its longest prefix that is a term."""
    if word in terms:
        return terms[word]
    for n in PREFIXES:
        if len(word) > n and (score := terms.get(f"{word[:n]}*")) is not None:
            return score
    return None


def segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (Ruzzo and Tompa) as (first word, last word + 1, score).

    ``places`` and ``scores`` are the positively scored words; every word between scores ``-drift``.  A
    candidate keeps the sums before and after it.  Candidates that do not start lower than a later one
    can never grow again; they are set aside with it and go if it is merged to the left.  Every candidate
    is set aside or merged once, so the time is linear.
    """
    stack: list[tuple[int, int, float, float, list]] = []
    total, last = 0.0, -1
    for at, score in zip(places, scores, strict=True):
        left = total - drift * (at - last - 1)
        total, last, start = left + score, at, at
        aside: list = []
        while True:
            while stack and stack[-1][2] >= left:
                *candidate, earlier = stack.pop()
                aside = [*earlier, candidate, *aside] if aside else [*earlier, candidate]
            if not stack or stack[-1][3] >= total:
                break
            start, _, left, _, aside = stack.pop()  # merged, and so is what lay between
        stack.append((start, at + 1, left, total, aside))
    found = []
    for *candidate, aside in stack:
        found += [*aside, candidate]
    return [(s, e, right - left) for s, e, left, right in found]


def _evidence(model: Model, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
    """Evidence that the document is toxic, and its significant passages with their bits.

    A segment of score s among n words is expected K n exp(-lam s) times in clean text; passages expected
    less than once count, each with the bits by which it stays below one.
    """
    words = _WORDS((text or "").lower())
    scored = {w: s for w in set(words) if (s := lookup(model.terms, w)) is not None}
    if not scored:
        return 0.0, []
    places = [i for i, w in enumerate(words) if w in scored]
    norm = math.log(model.k * len(words))
    passages = []
    for start, end, score in segments(places, [scored[words[i]] for i in places], model.drift):
        bits = (model.lam * score - norm) / math.log(2)
        if bits > 0:
            passages.append((start, end, bits))
    return sum(b for *_, b in passages), passages


def evidence(model: Model, text: Column) -> Column:
    """Struct of ``evidence``, ``n_passages`` and ``passages`` (word spans and bits) of every whole text."""

    @F.arrow_udf(_SCORES)
    def score(column: pa.Array) -> pa.Array:
        rows = []
        for value in column:
            total, found = _evidence(model, value.as_py())
            rows.append({"evidence": total, "n_passages": len(found), "passages": [dict(zip(("start", "end", "bits"), p, strict=True)) for p in found]})
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())]))
        return pa.array(rows, pa.struct([("evidence", pa.float64()), ("n_passages", pa.int32()), ("passages", spans)]))

    return score(F.coalesce(text, F.lit("")))


def _counts(labelled: DataFrame) -> DataFrame:
    """Per feature: toxic and clean documents that have it.  Each batch is counted before it is shuffled."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for batch in batches:
            found: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in features(_WORDS((text or "").lower())):
                    found.setdefault(f, [0, 0])[toxic] += 1
            columns = [pa.array(list(found)), *(pa.array([v[k] for v in found.values()], pa.int64()) for k in (1, 0))]
            yield pa.record_batch(columns, names=["feature", "toxic", "clean"])

    return labelled.select("text", "toxic").mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )


def _log_odds(counts: DataFrame, prior_share: float, min_toxic: int, min_z: float) -> dict[str, tuple[float, float]]:
    """Informative-Dirichlet log-odds of features that mark toxic text beyond doubt, and their clean rates.

    The prior adds ``prior_share`` of a feature's own count to both sides, so it pulls to no difference.
    """
    n1, n0 = (float(x or 0) for x in counts.agg(F.sum("toxic"), F.sum("clean")).first())
    if not n1 or not n0:
        return {}
    prior = prior_share * (F.col("toxic") + F.col("clean"))
    mass = prior_share * (n1 + n0)
    y1, y0 = F.col("toxic") + prior, F.col("clean") + prior
    delta = F.log(y1 / (n1 + mass - y1)) - F.log(y0 / (n0 + mass - y0))
    z = delta / F.sqrt(1 / y1 + 1 / y0)
    rated = counts.where(F.col("toxic") >= min_toxic).select("feature", "clean", delta.alias("delta"), z.alias("z"))
    chosen = rated.where(F.col("z") >= min_z).toLocalIterator()
    return {r.feature: (r.delta, (r.clean + 0.5) / (n0 + 1)) for r in chosen}


def _karlin_altschul(terms: Mapping[str, tuple[float, float]], drift: float) -> float:
    """The root of E[exp(lam * score)] = 1 over the words of clean text."""
    scores, rates = np.array(list(terms.values())).T
    rest = 1 - rates.sum()
    low, high = 1e-3, 1.0
    excess = lambda lam: float(rates @ np.exp(lam * scores) + rest * math.exp(-lam * drift) - 1)
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Weighted ridge logistic regression of one variable by damped Newton steps: (bias, slope)."""
    design = np.stack([np.ones_like(x), x], axis=1)
    theta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + ridge * theta
        hessian = (design * (weight * p * (1 - p) + 1e-9)[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta -= step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def fit(
    labelled: DataFrame, max_rows: int = MAX_LABELLED_ROWS, prior_share: float = 0.1, min_toxic: int = 3,
    min_z: float = 2.5, drift: float = 0.1, seed: int = 5,
) -> Model:
    """Learn a :class:`Model` from rows with ``text`` and ``toxic`` (0 or 1; null rows are left out).

    At most about ``max_rows`` labelled rows are used, drawn by a seeded sample; this bounds the terms
    that are collected.  Without rows of both labels the model has no terms and scores all texts alike.
    """
    rows = labelled.where(F.col("toxic").isin(0, 1)).select("text", F.col("toxic").cast("int").alias("toxic"))
    with Scratch(labelled.sparkSession, "toxicity") as scratch:
        n = rows.count()
        if n > max_rows:
            rows = rows.sample(max_rows / n, seed)
        rows = scratch.keep(rows, "labelled")
        counts = scratch.keep(_counts(rows).where(F.col("toxic") + F.col("clean") > 1), "counts")
        terms = _log_odds(counts, prior_share, min_toxic, min_z)
        share = (rows.agg(F.avg("toxic")).first()[0]) or 0.0
        if not terms:
            return Model(bias=math.log((share + 1e-3) / (1 - share + 1e-3)))
        model = Model({t: s for t, (s, _) in terms.items()}, drift, _karlin_altschul(terms, drift))
        # evidence in steps of 1/4 bit up to 64 bits: a table of at most 514 rows
        binned = F.least(F.floor(4 * evidence(model, F.col("text"))["evidence"]), F.lit(256)).cast("int")
        table = rows.select("toxic", binned.alias("bin")).groupBy("toxic", "bin").count().collect()
        x, y, w = (np.array(v, dtype=float) for v in zip(*[(r["bin"] / 4, r["toxic"], r["count"]) for r in table], strict=True))
        bias, slope = _logistic(x, y, w / w.sum() * 1000)
        return replace(model, bias=bias, slope=max(slope, 0.0))


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` (probability of toxic, 0 to 1), ``predicted`` (1 from 0.5 on) and ``passages``.

    Every whole text is scanned.  A null or empty text has no evidence and gets the score of texts without
    toxic words.  One row per input row, repeated ones included; other columns stay, those with an
    output's name are replaced.  An empty table gives no rows.
    """
    found = evidence(model, F.col(text))
    logit = model.bias + model.slope * F.least(F.col("__found.evidence"), F.lit(64.0))
    return (
        df.withColumn("__found", found)
        .withColumns({"score": 1 / (1 + F.exp(-logit)), "passages": F.col("__found.passages")})
        .drop("__found").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is never learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def fit_on_labels(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED_ROWS, seed: int = 5) -> Model:
    """Fit on the labelled documents outside fold 0; a null id has no fold and is not learnt from.

    The labels are drawn before they meet the texts, so the broadcast side has about ``max_rows`` rows.
    """
    marked = labels.where((fold(F.col("doc_id")) != 0) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    n = marked.count()
    drawn = marked.sample(max_rows / n, seed) if n > max_rows else marked
    return fit(documents.select("doc_id", "text").join(F.broadcast(drawn.dropDuplicates()), "doc_id"), max_rows=2 * max_rows)
