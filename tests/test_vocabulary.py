import pytest
from pyspark.sql import functions as F

from eventstrand.operators.vocabulary import product_vocabulary, remap_products
from eventstrand.operators.windows import WindowSpec
from eventstrand.plans.preprocess import build_windows


@pytest.fixture
def windows(events_of):
    raw = events_of([(1, i, 1.0, 1, p) for i, p in enumerate([5, 6, 7, 8])])
    return build_windows(raw, WindowSpec(length=2, stride=2))


def test_vocabulary_covers_inputs_only(windows):
    assert {tuple(r) for r in product_vocabulary(windows).select("orig_id", "new_id").collect()} == {
        (5, 1), (6, 2), (7, 3)
    }


@pytest.mark.parametrize("max_broadcast", [100, 1])
def test_unknown_products_become_zero(spark, windows, max_broadcast):
    vocabulary = spark.createDataFrame([(5, 1), (7, 2)], "orig_id bigint, new_id bigint")
    rows = remap_products(windows, vocabulary, max_broadcast).orderBy("window_start").collect()
    assert [r.input_product_seq for r in rows] == [[1, 0], [0, 2]]
    assert rows[0].asDict().keys() == windows.first().asDict().keys()


@pytest.mark.parametrize("max_broadcast", [100, 0])
def test_empty_lists_and_empty_vocabulary(spark, max_broadcast):
    windows = spark.createDataFrame(
        [(1, 0, []), (2, 0, [3, 4]), (3, 0, [4])], "user_id bigint, window_start bigint, input_product_seq array<bigint>"
    )
    known = spark.createDataFrame([(4, 1)], "orig_id bigint, new_id bigint")
    got = remap_products(windows, known, max_broadcast).orderBy("user_id").collect()
    assert [r.input_product_seq for r in got] == [[], [0, 1], [1]]
    nothing = known.where(F.lit(False))
    got = remap_products(windows, nothing, 100).orderBy("user_id").collect()
    assert [r.input_product_seq for r in got] == [[], [0, 0], [0]]


def test_lookup_and_join_give_the_same_rows(spark):
    """Null lists, null elements, padding, repeated keys and unknown products."""
    rows = [
        (1, 0, None), (1, 1, [None, 0, 5]), (1, 1, [7, 7, 9]), (2, 0, []), (2, 0, [5]), (2, 0, [5]), (3, 0, [0, 0]), (None, 4, [5]),
    ]
    windows = spark.createDataFrame(rows, "user_id bigint, window_start bigint, input_product_seq array<bigint>")
    known = spark.createDataFrame([(5, 1), (7, 2)], "orig_id bigint, new_id bigint")
    by_lookup, by_join = (
        sorted(map(repr, remap_products(windows.where("user_id IS NOT NULL"), known, n).collect())) for n in (100, 0)
    )
    assert by_lookup == by_join
    want = [(1, 0, None), (1, 1, [0, 0, 1]), (1, 1, [2, 2, 0]), (2, 0, []), (2, 0, [1]), (2, 0, [1]), (3, 0, [0, 0])]
    got = remap_products(windows.where("user_id IS NOT NULL"), known, 0).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
