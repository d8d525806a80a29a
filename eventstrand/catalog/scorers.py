"""Deterministic stand-in models for the inference operators; integer arithmetic, so exact."""

from __future__ import annotations

from collections.abc import Callable

N_SCORES = 22
EMBEDDING_SIZE = 8


def next_event_model(n_scores: int = N_SCORES) -> Callable:
    """Scores class c at a position with (7 event + 3 product + 1 a + 2 b + 3 d + 5 c) mod ``n_scores``.

    a, b and d are the three features in hundredths, rounded down.
    """

    def make_predict_fn():
        import numpy as np

        classes = np.arange(n_scores)

        def predict(events, products, feats):
            hundredths = np.floor(feats.astype("float64") * 100).astype("int64") @ np.array([1, 2, 3])
            base = 7 * events.astype("int64") + 3 * products.astype("int64") + hundredths
            scores = (base[:, :, None] + 5 * classes) % n_scores
            return scores.reshape(len(events), -1).astype("float32")

        return predict

    return make_predict_fn


def embedding_model(size: int = EMBEDDING_SIZE) -> Callable:
    """Coordinate j sums, over positions i, event, product and features with weights of their own.

    The terms are (event * (j + 1)) mod 11, (product * (j + 2)) mod 7 and
    ((1 + i mod 3) * ((1 + j) a + (2 + j) b + (3 + j) d)) mod 13 for features in hundredths.
    """

    def make_predict_fn():
        import numpy as np

        j = np.arange(size)

        def predict(events, products, feats):
            hundredths = np.floor(feats.astype("float64") * 100).astype("int64")
            mixed = hundredths @ (np.arange(1, 4)[:, None] + j)
            placed = mixed * (1 + np.arange(events.shape[1]) % 3)[None, :, None]
            terms = (events.astype("int64")[:, :, None] * (j + 1)) % 11
            terms = terms + (products.astype("int64")[:, :, None] * (j + 2)) % 7 + placed % 13
            return terms.sum(axis=1).astype("float32")

        return predict

    return make_predict_fn


def quadrant_model() -> Callable:
    """Two coordinates: 1 + the sum of event mod 5, and 1 + the sum of product mod 7, over the positions."""

    def make_predict_fn():
        import numpy as np

        def predict(events, products, feats):
            sums = (events.astype("int64") % 5).sum(axis=1), (products.astype("int64") % 7).sum(axis=1)
            return 1 + np.stack(sums, axis=1).astype("float32")

        return predict

    return make_predict_fn
