"""Array-column functions on event sequences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from eventstrand.functions.hashing import bits_below, md5_hex

PADDING = 0
_BLOCK = 4  # positions that share a 128-bit digest


def int_div(a: Column, b: Column) -> Column:
    """Integer division."""
    return F.call_function("div", a, b)


def pad_right(seq: Column, length: int, fill) -> Column:
    """Append ``fill`` until the array has ``length`` elements; longer arrays are left alone."""
    return F.concat(seq, F.array_repeat(fill, F.greatest(F.lit(length) - F.size(seq), F.lit(0))))


def mask_sequence(seq: Column, probability: float, *key) -> Column:
    """Set elements to the padding value with the given probability, seeded by ``key`` and position.

    The random bits are counter-based: one md5 of (key, block) gives 32 bits to each of a block's four
    positions, so any position can be drawn on its own and a digest is made for four.
    """
    zero = F.lit(PADDING).cast("tinyint")
    n_blocks = int_div(F.size(seq) + (_BLOCK - 1), F.lit(_BLOCK)).cast("int")
    numbers = F.when(n_blocks > 0, F.sequence(F.lit(0), n_blocks - 1)).otherwise(F.array().cast("array<int>"))
    # as a struct, so that the inner function uses the digest and does not make it again
    blocks = F.transform(
        numbers, lambda b: F.struct(md5_hex(*key, b).alias("digest"), F.slice(seq, b * _BLOCK + 1, _BLOCK).alias("part"))
    )
    bits = lambda block, i: F.substr(block["digest"], i * 8 + 1, F.lit(8))
    masked = F.transform(
        blocks, lambda block: F.transform(block["part"], lambda e, i: F.when(bits_below(probability, bits(block, i)), zero).otherwise(e))
    )
    return F.when(seq.isNotNull(), F.flatten(masked))


def feature_matrix(seq: Column, with_balance: bool = True) -> Column:
    """List of feature structs -> N x 3 matrix, or N x 2 without the balance feature."""
    names = ["value_norm", "time_delta_norm"] + (["balance_norm"] if with_balance else [])
    return F.transform(seq, lambda f: F.array(*[f.getField(name) for name in names]))


def argmax(scores: Column) -> Column:
    """0-based index of the largest score; the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def rows_of(flat: Column, n_rows: int, width: int) -> Column:
    """Cut a flat row-major array into ``n_rows`` arrays of ``width`` elements."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_rows - 1)), lambda i: F.slice(flat, i * width + 1, width)
    )
