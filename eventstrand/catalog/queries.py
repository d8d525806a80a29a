"""One entry per operator: ``name -> fn(spark, sf_dir) -> DataFrame`` of flat columns."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from eventstrand import adapters
from eventstrand.adapters import (
    TEST_MAX_WINDOWS,
    TEST_MEAN,
    TEST_MIN_EVENTS,
    TEST_SPEC,
    TEST_STD,
)
from eventstrand.catalog.scorers import N_SCORES, embedding_model, next_event_model, quadrant_model
from eventstrand.functions import vectors
from eventstrand.functions.vectors import l2_normalize
from eventstrand.operators import clusters, losses, metrics, ranking, splits, tensors, vocabulary, windows
from eventstrand.operators.features import event_features, normalise_events, with_cashflow
from eventstrand.operators.histories import Histories, split_histories
from eventstrand.operators.inference import position_logits, predict_events, score_positions, score_windows
from eventstrand.plans.evaluation import evaluate_contrastive, evaluate_embeddings, evaluate_predictions
from eventstrand.plans.preprocess import build_bucketed_windows, build_windows, features_of, prepare_dataset, write_dataset
from eventstrand.plans.training import training_tables
from eventstrand.session import configure, materialise, session_folder
from eventstrand.sources import bucketed, sinks, tables
from eventstrand.operators.windows import WindowSpec

KEY = ("user_id", "window_start")
LENGTH = TEST_SPEC.length
SEED = 7
BATCH = 32
N_BUCKETS = 10
SPLIT_HISTORY_ABOVE = 70  # makes a third of the test users take the segmented path
WIDE_SPEC = WindowSpec(length=80, stride=40, stride_threshold=90)
SUPPLIER_SPEC = WindowSpec(length=100, stride=50, stride_threshold=600)

QUERIES = {}


def query(fn=None, name: str | None = None):
    """Register ``fn`` under its own or the given name."""
    if fn is None:
        return lambda f: query(f, name)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[name or fn.__name__] = run
    return fn


# ---- inputs -------------------------------------------------------------------------------------


# declared, so that planning a query reads no file
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_shipdate timestamp_ntz",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _raw(spark, sf_dir):
    return adapters.raw_events(_table(spark, sf_dir, "events"))


def _events(spark, sf_dir):
    return normalise_events(_raw(spark, sf_dir))


def _features(spark, sf_dir, prepared: str | None = None) -> Histories:
    return features_of(_raw(spark, sf_dir), TEST_MEAN, TEST_STD, prepared=prepared)


def _windows(spark, sf_dir, spec=TEST_SPEC, prepared: str | None = None) -> DataFrame:
    return build_windows(_raw(spark, sf_dir), spec, TEST_MEAN, TEST_STD, prepared=prepared)


def _prepared(spark, sf_dir) -> str:
    """A third of the test users are heavy, in segments of about the limit; most of them lie in two."""
    return prepare_dataset(_raw(spark, sf_dir), _folder(spark), SPLIT_HISTORY_ABOVE, min_segment=1)


def _split(spark, sf_dir) -> DataFrame:
    return adapters.hash_split(splits.distinct_users(_events(spark, sf_dir)))


def _embeddings(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings")


def _vectors(spark, sf_dir) -> DataFrame:
    return materialise(clusters.user_vectors(adapters.window_embeddings(_embeddings(spark, sf_dir))))


def _labelled_vectors(spark, sf_dir) -> DataFrame:
    vector = F.col("embedding").cast("array<double>")
    return _embeddings(spark, sf_dir).select(
        F.col("vec_id").alias("user_id"),
        vector.alias("embedding"),
        array_to_vector(vector).alias("features"),
        F.col("label").alias("cluster"),
    )


def _grouped_vectors(spark, sf_dir, groups: int) -> DataFrame:
    """Users in ``groups`` clear groups: hundredths of the vectors, and 10 on the group's own coordinate."""
    group = F.col("label") % groups
    placed = F.transform(
        "embedding", lambda x, i: x.cast("double") / 100 + F.when(i == group, F.lit(10.0)).otherwise(F.lit(0.0))
    )
    users = _embeddings(spark, sf_dir).select(F.col("vec_id").alias("user_id"), placed.alias("embedding"))
    return materialise(users.withColumn("features", array_to_vector("embedding")))


def _views(spark, sf_dir) -> DataFrame:
    """Each vector and its masked second view."""
    return _embeddings(spark, sf_dir).select(
        "vec_id",
        F.col("embedding").alias("view1"),
        adapters.masked_view(F.col("embedding"), 0.15, SEED, F.col("vec_id")).alias("view2"),
    )


def _folder(spark) -> str:
    return f"{session_folder(spark)}/{uuid.uuid4().hex}"


# ---- flat output --------------------------------------------------------------------------------


def _text(column: str) -> Column:
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


def _whole(column: str) -> Column:
    return F.col(column).cast("bigint").alias(column)


def _rounded(column, name: str | None = None, digits: int = 4) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return (F.round(c.cast("double"), digits) + 0.0).alias(name or column)


def _feature_text(column: str = "num_feats_seq") -> Column:
    """All features of a window in thousandths: a/b/d of each event, comma-joined."""
    def one(f: Column) -> Column:
        values = [f[i] if column == "matrix" else f[name] for i, name in enumerate(windows.FEATURES)]
        return F.concat_ws("/", *[F.round(v.cast("double") * 1000).cast("bigint").cast("string") for v in values])

    source = "num_feats_seq" if column == "matrix" else column
    return F.array_join(F.transform(source, one), ",").alias("num_feats_seq")


def _window_text(df: DataFrame, *more: Column) -> DataFrame:
    return df.select(
        *KEY, "n_events", *more, _text("input_event_seq"), _text("input_product_seq"), _text("target_event_seq"),
        _feature_text(),
    )


def _feature_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "event_id", "user_id", "pos", "n_events", "product_id", _whole("event_type"),
        _rounded("value_norm"), _rounded("time_delta_norm"), _rounded("balance_norm"),
    )


# ---- events and features ------------------------------------------------------------------------


@query
def scan_events(spark, sf_dir):
    raw = adapters.raw_events(
        tables.read_parquet_folder(spark, sf_dir, "events*.parquet", SCHEMAS["events"])
    )
    return normalise_events(raw).select(
        "event_id", "user_id",
        F.date_format("timestamp_event", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp_event"),
        _rounded("value"), _whole("event_type"), "product_id",
    )


@query
def distinct_users(spark, sf_dir):
    return splits.distinct_users(_events(spark, sf_dir))


@query
def net_cashflow(spark, sf_dir):
    flows = with_cashflow(Histories(_events(spark, sf_dir))).rows()
    return flows.select("event_id", _rounded("net_cashflow"))


@query
def time_delta(spark, sf_dir):
    return _features(spark, sf_dir).rows().select("event_id", _whole("time_delta"))


@query
def running_balance(spark, sf_dir):
    return _features(spark, sf_dir).rows().select("event_id", _rounded("balance"))


@query(name="event_features")
def event_feature_rows(spark, sf_dir):
    return _feature_rows(_features(spark, sf_dir).rows())


@query
def event_features_segmented(spark, sf_dir):
    return _feature_rows(_features(spark, sf_dir, _prepared(spark, sf_dir)).rows())


@query
def heavy_user_segments(spark, sf_dir):
    """What is stored about heavy users: their events, and that no segment is much longer than the limit."""
    segments = spark.read.parquet(f"{_prepared(spark, sf_dir)}/segments")
    bounded = F.max("n_segment") <= 3 * SPLIT_HISTORY_ABOVE
    sizes = segments.withColumn("n_segment", F.sum("n_events").over(Window.partitionBy("segment")))
    return sizes.groupBy("user_id").agg(F.sum("n_events").alias("n_events"), bounded.alias("bounded"))


# ---- windows ------------------------------------------------------------------------------------


@query
def user_history(spark, sf_dir):
    return windows.user_history(_features(spark, sf_dir), LENGTH).select(
        "user_id", "n_events", "chunk", _text("event_type"), _text("product_id"), _feature_text("num_feats"),
    )


@query
def sequence_windows(spark, sf_dir):
    return _window_text(_windows(spark, sf_dir))


@query
def sequence_windows_segmented(spark, sf_dir):
    return _window_text(_windows(spark, sf_dir, prepared=_prepared(spark, sf_dir)))


@query
def sequence_windows_wide(spark, sf_dir):
    return _window_text(_windows(spark, sf_dir, WIDE_SPEC))


@query
def adaptive_stride_windows(spark, sf_dir):
    spec = TEST_SPEC
    stride = F.when(F.col("n_events") > spec.stride_threshold, F.lit(spec.length)).otherwise(F.lit(spec.stride))
    return _windows(spark, sf_dir).select(*KEY, "n_events", stride.cast("bigint").alias("stride"))


@query
def capped_windows(spark, sf_dir):
    return _window_text(_windows(spark, sf_dir, replace(TEST_SPEC, max_windows=TEST_MAX_WINDOWS)))


@query
def min_events_filter(spark, sf_dir):
    return _window_text(_windows(spark, sf_dir, replace(TEST_SPEC, min_events=TEST_MIN_EVENTS)))


@query
def history_filter_counts(spark, sf_dir):
    return windows.history_filter_counts(_events(spark, sf_dir), TEST_MIN_EVENTS)


@query
def supplier_windows(spark, sf_dir):
    events = adapters.events_from_lineitem(_table(spark, sf_dir, "lineitem"))
    features = event_features(split_histories(events), TEST_MEAN, TEST_STD)
    return _window_text(windows.sequence_windows(features, SUPPLIER_SPEC))


# ---- vocabulary and splits ----------------------------------------------------------------------


@query
def product_vocab(spark, sf_dir):
    return vocabulary.product_vocabulary(_windows(spark, sf_dir))


def _remapped(spark, sf_dir, **options):
    rows = materialise(_windows(spark, sf_dir))
    mapped = vocabulary.remap_products(rows, vocabulary.product_vocabulary(rows), **options)
    return mapped.select(*KEY, _text("input_product_seq"))


@query
def remap_products(spark, sf_dir):
    return _remapped(spark, sf_dir)


@query
def remap_products_joined(spark, sf_dir):
    return _remapped(spark, sf_dir, max_broadcast=0)


@query
def semi_join_split(spark, sf_dir):
    train = _split(spark, sf_dir).where(F.col("split") == "train")
    events = splits.keep_users(_raw(spark, sf_dir), train)
    return build_windows(events, TEST_SPEC, TEST_MEAN, TEST_STD).select(*KEY, _text("input_event_seq"))


@query
def uid_split_counts(spark, sf_dir):
    return splits.split_row_counts(_windows(spark, sf_dir), _split(spark, sf_dir))


@query
def uid_split_source(spark, sf_dir):
    path = _folder(spark)
    _split(spark, sf_dir).write.json(path)
    return tables.read_split_rows(spark, path)


@query
def uid_split_document(spark, sf_dir):
    """The same list as JSON documents with a list of users per split."""
    path = _folder(spark)
    sinks.write_split_lists(_split(spark, sf_dir), path)
    return tables.read_split_lists(spark, path, lines=True)


@query
def first_files_scan(spark, sf_dir):
    """The first three of five files in name order; users are dealt to files by their id."""
    path = _folder(spark)
    users = splits.distinct_users(_events(spark, sf_dir)).withColumn("file", F.col("user_id") % 5)
    for i in range(5):
        # a folder of as many files as there are tasks, whose names sort together
        users.where(F.col("file") == i).write.parquet(f"{path}/part_{i}")
    return tables.read_first_files(spark, f"{path}/part_*", 3, folders=True).select("user_id", "file")


@query
def report_roundtrip(spark, sf_dir):
    """The per-class report, written as a CSV report and read back."""
    path = _folder(spark)
    sinks.write_report(per_class_report(spark, sf_dir), path)
    back = spark.read.schema("class string, precision double, recall double, f1 double, support bigint")
    return back.csv(path, header=True)


def _with_bucket(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.col("user_id") % N_BUCKETS)


@query
def bucket_split(spark, sf_dir):
    return splits.bucket_split(_with_bucket(_windows(spark, sf_dir)))


@query
def train_val_rows(spark, sf_dir):
    events = _raw(spark, sf_dir).join(_split(spark, sf_dir), "user_id")
    rows = splits.train_val_rows(_with_bucket(build_windows(events, TEST_SPEC, TEST_MEAN, TEST_STD)))
    return rows.select(*KEY, "bucket", "side", _text("target_event_seq"))


def _by_user(spark, sf_dir, build) -> DataFrame:
    """What ``build(events, split)`` gives on tables that are stored by user."""
    with bucketed.tables_by_user(spark, _folder(spark), N_BUCKETS) as store:
        events = store(_raw(spark, sf_dir), "events", "timestamp_event", "event_id")
        split = store(_split(spark, sf_dir), "split")
        return materialise(build(events, split))


def _stored_semi_join(events: DataFrame, split: DataFrame) -> DataFrame:
    kept = splits.keep_users(events, split.where(F.col("split") == "train"))
    return build_windows(kept, TEST_SPEC, TEST_MEAN, TEST_STD).select(*KEY, _text("input_event_seq"))


def _stored_train_val(events: DataFrame, split: DataFrame) -> DataFrame:
    rows = build_windows(events.join(split, "user_id"), TEST_SPEC, TEST_MEAN, TEST_STD)
    return splits.train_val_rows(_with_bucket(rows)).select(*KEY, "bucket", "side", _text("target_event_seq"))


@query
def stored_semi_join(spark, sf_dir):
    """The same as ``semi_join_split`` on events and users stored by user: no row is shuffled to be joined or ordered."""
    return _by_user(spark, sf_dir, _stored_semi_join)


@query
def stored_train_val_rows(spark, sf_dir):
    """The same as ``train_val_rows`` on such tables."""
    return _by_user(spark, sf_dir, _stored_train_val)


@query
def union_scans(spark, sf_dir):
    suppliers = adapters.events_from_lineitem(_table(spark, sf_dir, "lineitem"))
    both = tables.union_tables(
        [
            _events(spark, sf_dir).withColumn("source", F.lit("events")),
            suppliers.withColumn("source", F.lit("lineitem")),
        ]
    )
    return both.groupBy("source", _whole("event_type")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("product_id").alias("product_sum"),
        F.countDistinct("user_id").alias("n_users"),
    )


# ---- tensor-ready export ------------------------------------------------------------------------


def _padded(spark, sf_dir, **options):
    return tensors.pad_windows(_windows(spark, sf_dir), LENGTH, **options)


@query
def pad_sequences(spark, sf_dir):
    # 80-step windows: most test histories are shorter
    padded = tensors.pad_windows(_windows(spark, sf_dir, WIDE_SPEC), WIDE_SPEC.length)
    return padded.select(
        *KEY, _text("input_event_seq"), _text("input_product_seq"), _text("target_event_seq"),
        F.size("num_feats_seq").cast("bigint").alias("n_feats"),
    )


@query
def mask_events(spark, sf_dir):
    masked = tensors.mask_events(_windows(spark, sf_dir), 0.15, SEED)
    return masked.select(*KEY, _text("input_event_seq"), _text("input_event_seq_v2"))


def _matrix_rows(padded: DataFrame, names: list[str]) -> DataFrame:
    rows = padded.select(*KEY, F.posexplode("num_feats_seq").alias("i", "row"))
    return rows.select(
        *KEY, _whole("i"), *[_rounded(F.col("row")[j], name) for j, name in enumerate(names)]
    )


@query
def num_feats_matrix(spark, sf_dir):
    return _matrix_rows(_padded(spark, sf_dir), list(windows.FEATURES))


@query
def num_feats_no_balance(spark, sf_dir):
    return _matrix_rows(_padded(spark, sf_dir, with_balance=False), list(windows.FEATURES[:2]))


@query
def seeded_sample(spark, sf_dir):
    return ranking.seeded_sample(_windows(spark, sf_dir).select(*KEY), KEY, 200, SEED)


@query
def seeded_batches(spark, sf_dir):
    batches = ranking.seeded_batches(_windows(spark, sf_dir), KEY, BATCH, SEED)
    return batches.select(*KEY, "shuffled_position", "batch_id", _text("input_event_seq"))


@query
def sink_roundtrip(spark, sf_dir):
    path = _folder(spark)
    bucketed = sinks.with_bucket(_raw(spark, sf_dir), N_BUCKETS, SEED)
    sinks.write_buckets(build_bucketed_windows(bucketed, TEST_SPEC, TEST_MEAN, TEST_STD), path)
    return _window_text(spark.read.parquet(path), _whole("bucket"))


@query
def resume_pending_buckets(spark, sf_dir):
    """A first run that reached only the even buckets, then a second one over everything pending."""
    folder, raw = _folder(spark), _raw(spark, sf_dir)
    path, markers = f"{folder}/windows", f"{folder}/done"

    def build(events: DataFrame) -> DataFrame:
        return build_bucketed_windows(events, TEST_SPEC, TEST_MEAN, TEST_STD, SPLIT_HISTORY_ABOVE)

    bucketed = sinks.with_bucket(raw, N_BUCKETS, SEED)
    sinks.check_input(bucketed, f"{markers}-input", markers)
    sinks.write_buckets(build(bucketed.where(F.col("bucket") % 2 == 0)), path)
    spark.range(0, N_BUCKETS, 2).selectExpr("int(id) bucket").coalesce(1).write.json(markers)
    resumed = sinks.write_resumable(raw, build, path, markers, N_BUCKETS, seed=SEED)
    by = F.when(F.col("bucket").isin(resumed), F.lit("second run")).otherwise(F.lit("first run"))
    back = spark.read.parquet(path)
    return back.select(
        *KEY, _whole("bucket"), by.alias("written_by"), _text("input_event_seq"), _feature_text()
    )


@query
def input_fingerprint(spark, sf_dir):
    """What a resumed run compares per bucket, over the scanned events and over the same rows dealt anew."""
    bucketed = sinks.with_bucket(_raw(spark, sf_dir), N_BUCKETS, SEED)
    now = sinks.fingerprint(bucketed)
    again = sinks.fingerprint(bucketed.repartition(7, "event_id")).withColumnRenamed("row_hash", "again").drop("n_rows")
    same = F.col("row_hash") == F.col("again")
    return now.join(again, "bucket").select(_whole("bucket"), F.col("n_rows").alias("n_events"), same.alias("same"))


@query
def stored_user_counts(spark, sf_dir):
    """The writer's report of users kept and dropped by the minimum history, read back from the dataset."""
    folder = _folder(spark)
    write_dataset(
        _raw(spark, sf_dir), folder, N_BUCKETS, replace(TEST_SPEC, min_events=TEST_MIN_EVENTS),
        value_mean=TEST_MEAN, value_std=TEST_STD,
    )
    return spark.read.parquet(f"{folder}/user_counts")


@query
def mean_pool(spark, sf_dir):
    pooled = _padded(spark, sf_dir).select(*KEY, vectors.mean_pool(F.col("num_feats_seq")).alias("pooled"))
    return pooled.select(*KEY, F.posexplode("pooled").alias("i", "x")).select(*KEY, _whole("i"), _rounded("x"))


@query
def training_batches(spark, sf_dir):
    """From the stored dataset to padded, remapped, masked, shuffled rows of both sides."""
    folder = _folder(spark)
    stored = write_dataset(
        _raw(spark, sf_dir), folder, N_BUCKETS, TEST_SPEC, split=_split(spark, sf_dir),
        value_mean=TEST_MEAN, value_std=TEST_STD,
    )
    sides = training_tables(
        _with_bucket(stored), None, spark.read.parquet(f"{folder}/vocabulary"), LENGTH, BATCH,
        seed=SEED,
    )
    both = tables.union_tables([df.withColumn("side", F.lit(side)) for side, df in sides.items()])
    return both.select(
        *KEY, "side", "shuffled_position", "batch_id", _text("input_event_seq"), _text("input_event_seq_v2"),
        _text("input_product_seq"), _text("target_event_seq"), _feature_text("matrix"),
    )


# ---- predictions and metrics --------------------------------------------------------------------


@query
def argmax_predictions(spark, sf_dir):
    predicted = predict_events(_padded(spark, sf_dir), next_event_model(), LENGTH, N_SCORES)
    return predicted.select(*KEY, _text("pred_event_seq"))


def _persistence_pairs(spark, sf_dir, *keep):
    """The next event is predicted to equal the current one."""
    return metrics.prediction_pairs(
        _windows(spark, sf_dir, WIDE_SPEC), "target_event_seq", "input_event_seq", *keep
    )


@query
def prediction_pairs(spark, sf_dir):
    return _persistence_pairs(spark, sf_dir, *KEY).select(
        *KEY, _whole("i"), _whole("target"), _whole("pred")
    )


@query
def per_class_report(spark, sf_dir):
    return metrics.per_class_report(_persistence_pairs(spark, sf_dir)).select(
        "class", _rounded("precision"), _rounded("recall"), _rounded("f1"), "support"
    )


@query
def macro_weighted_metrics(spark, sf_dir):
    summary = metrics.macro_weighted_metrics(metrics.per_class_report(_persistence_pairs(spark, sf_dir)))
    return summary.select(*[_rounded(c) for c in summary.columns])


def _weights(spark, sf_dir):
    return metrics.class_weights(metrics.class_support(_events(spark, sf_dir)))


@query
def class_support(spark, sf_dir):
    return metrics.class_support(_events(spark, sf_dir)).select(_whole("event_type"), "support")


@query
def class_weights(spark, sf_dir):
    return _weights(spark, sf_dir).select(_whole("event_type"), _whole("count"), _rounded("weight"))


def _logits(spark, sf_dir):
    """Logits of a model at every position of the padded windows."""
    return position_logits(_padded(spark, sf_dir), next_event_model(), LENGTH, N_SCORES)


@query
def focal_loss(spark, sf_dir):
    loss = losses.focal_loss(_logits(spark, sf_dir), _weights(spark, sf_dir))
    return loss.select(_rounded("focal_loss"), "n_rows")


@query
def focal_rows(spark, sf_dir):
    rows = losses.focal_rows(_logits(spark, sf_dir), _weights(spark, sf_dir))
    return rows.select(*KEY, _whole("i"), _whole("target"), _rounded("focal"))


@query
def position_scores(spark, sf_dir):
    """Best class, score of the target and log-sum-exp of every position, as they leave the model's worker."""
    scored = score_positions(_padded(spark, sf_dir), next_event_model(), LENGTH, N_SCORES)
    return scored.select(
        *KEY, _whole("i"), _whole("target"), _whole("pred"), _rounded("target_score"), _rounded("log_sum")
    )


def _next_event_reports(spark, sf_dir):
    return evaluate_predictions(
        _padded(spark, sf_dir), next_event_model(), LENGTH, N_SCORES, weights=_weights(spark, sf_dir)
    )


@query
def stored_dataset_report(spark, sf_dir):
    """Stored dataset, validation side, vocabulary, padding, model and per-class report in one flow."""
    folder = _folder(spark)
    stored = write_dataset(
        _raw(spark, sf_dir), folder, N_BUCKETS, TEST_SPEC, split=_split(spark, sf_dir),
        value_mean=TEST_MEAN, value_std=TEST_STD,
    )
    tables_of = training_tables(
        _with_bucket(stored), None, spark.read.parquet(f"{folder}/vocabulary"), LENGTH, BATCH, contrastive=False
    )
    report = evaluate_predictions(tables_of["val"], next_event_model(), LENGTH, N_SCORES)["per_class"]
    return report.select("class", _rounded("precision"), _rounded("recall"), _rounded("f1"), "support")


@query
def next_event_report(spark, sf_dir):
    return _next_event_reports(spark, sf_dir)["per_class"].select(
        "class", _rounded("precision"), _rounded("recall"), _rounded("f1"), "support"
    )


@query
def next_event_loss(spark, sf_dir):
    return _next_event_reports(spark, sf_dir)["loss"].select(_rounded("focal_loss"), "n_rows")


# ---- embeddings ---------------------------------------------------------------------------------


@query(name="l2_normalize")
def unit_vectors(spark, sf_dir):
    unit = l2_normalize(_embeddings(spark, sf_dir).select("vec_id", "embedding"), "embedding")
    return unit.select("vec_id", F.posexplode("embedding").alias("i", "x")).select(
        "vec_id", _whole("i"), _rounded("x")
    )


def _cosines(spark, sf_dir):
    unit = l2_normalize(l2_normalize(_views(spark, sf_dir), "view1"), "view2")
    return metrics.pair_cosine(unit, "view1", "view2").select("vec_id", "cosine")


@query
def pair_cosine(spark, sf_dir):
    return _cosines(spark, sf_dir).select("vec_id", _rounded("cosine"))


@query
def positive_pair_cosine(spark, sf_dir):
    return _cosines(spark, sf_dir).agg(
        _rounded(F.avg("cosine"), "mean_cosine"), F.count(F.lit(1)).alias("n_pairs")
    )


@query
def cosine_histogram(spark, sf_dir):
    return metrics.histogram(_cosines(spark, sf_dir), "cosine").select(
        "bin", _rounded("lower"), _rounded("upper"), "n"
    )


@query
def info_nce_batches(spark, sf_dir):
    batches = ranking.seeded_batches(_views(spark, sf_dir), ["vec_id"], BATCH, SEED)
    return losses.batch_info_nce(batches, "view1", "view2").select("batch_id", "n_rows", _rounded("loss"))


@query
def info_nce(spark, sf_dir):
    loss = losses.info_nce(_views(spark, sf_dir), ["vec_id"], "view1", "view2", BATCH, seed=SEED)
    return loss.select(_rounded("info_nce"), "n_batches")


@query
def score_embeddings(spark, sf_dir):
    scored = score_windows(_padded(spark, sf_dir), embedding_model(), "embedding", LENGTH)
    unit = l2_normalize(scored.select(*KEY, "embedding"), "embedding")
    return unit.select(*KEY, F.posexplode("embedding").alias("i", "x")).select(
        *KEY, _whole("i"), _rounded("x")
    )


@query
def contrastive_validation(spark, sf_dir):
    reports = evaluate_contrastive(
        _padded(spark, sf_dir), embedding_model(), LENGTH, batch_size=BATCH, seed=SEED
    )
    loss, cosine = reports["loss"], reports["cosine"]
    return cosine.select(
        _rounded(loss.select("info_nce").scalar(), "info_nce"), _rounded("mean_cosine"), "n_pairs"
    )


@query
def user_mean_embedding(spark, sf_dir):
    mean = clusters.user_mean_embedding(adapters.window_embeddings(_embeddings(spark, sf_dir)))
    unit = l2_normalize(mean, "embedding", "unit")
    rows = unit.select("user_id", F.posexplode(F.arrays_zip("embedding", "unit")).alias("i", "x"))
    return rows.select("user_id", _whole("i"), _rounded("x.embedding", "mean"), _rounded("x.unit", "unit"))


# ---- clusters -----------------------------------------------------------------------------------


@query
def kmeans_clusters(spark, sf_dir):
    """Clusters of ten clear groups, numbered by their smallest user."""
    users = _grouped_vectors(spark, sf_dir, 10)
    found = clusters.assign_clusters(clusters.kmeans_best_of(users, k=10), users).select("user_id", "cluster")
    numbers = found.groupBy("cluster").agg(F.min("user_id").alias("first")).select(
        F.col("cluster").alias("old"), F.row_number().over(Window.orderBy("first")).cast("bigint").alias("cluster")
    )  # ten rows
    return found.withColumnRenamed("cluster", "old").join(F.broadcast(numbers), "old").select("user_id", "cluster")


@query
def best_k(spark, sf_dir):
    """Six clear groups: six wins, with the silhouette of the groups."""
    searched = clusters.search_k(_grouped_vectors(spark, sf_dir, 6), 4, 8)
    return searched.where("is_best").select(_whole("k"), _rounded("silhouette"))


@query
def silhouette_exact(spark, sf_dir):
    return clusters.silhouette_exact(_labelled_vectors(spark, sf_dir), seed=SEED).select(
        _rounded("silhouette", digits=6), "n_points"
    )


@query
def silhouette_scalable(spark, sf_dir):
    score = clusters.silhouette_squared(_labelled_vectors(spark, sf_dir))
    return spark.createDataFrame([(score,)], "silhouette double").select(_rounded("silhouette", digits=6))


@query
def cluster_distribution(spark, sf_dir):
    return clusters.cluster_distribution(_labelled_vectors(spark, sf_dir)).select(
        _whole("cluster"), "n_users", _rounded("share")
    )


def _user_clusters(spark, sf_dir):
    return splits.distinct_users(_events(spark, sf_dir)).withColumn("cluster", F.col("user_id") % 8)


def _event_counts(spark, sf_dir):
    return clusters.cluster_event_counts(_windows(spark, sf_dir), _user_clusters(spark, sf_dir))


@query
def cluster_event_counts(spark, sf_dir):
    return _event_counts(spark, sf_dir).select("cluster", _whole("event_type"), "n_events")


@query
def cluster_top_events(spark, sf_dir):
    return clusters.cluster_top_events(_event_counts(spark, sf_dir))


def _points(spark, sf_dir):
    """The labelled vectors, all coordinates, on their two main components."""
    return clusters.pca_2d(_labelled_vectors(spark, sf_dir))


def _point_rows(points: DataFrame, *keep) -> DataFrame:
    """The signs of components are arbitrary."""
    return points.select(
        "user_id", *keep, _rounded(F.abs("pc1"), "pc1"), _rounded(F.abs("pc2"), "pc2"), _rounded("explained_percent")
    )


@query
def pca_2d(spark, sf_dir):
    return _point_rows(_points(spark, sf_dir))


@query
def points_report(spark, sf_dir):
    """The sampled 2-D points of users and their clusters, written as a report and read back."""
    path = _folder(spark)
    points = ranking.seeded_sample(_points(spark, sf_dir), ["user_id"], clusters.SCATTER_SAMPLE, SEED)
    sinks.write_report(points, path, "parquet")
    return _point_rows(spark.read.parquet(path), _whole("cluster"))


@query
def stored_dataset_clusters(spark, sf_dir):
    """Stored dataset, validation side, vocabulary, padding, embedding, user means, clusters and their profile in one flow."""
    folder = _folder(spark)
    stored = write_dataset(
        _raw(spark, sf_dir), folder, N_BUCKETS, TEST_SPEC, split=_split(spark, sf_dir),
        value_mean=TEST_MEAN, value_std=TEST_STD,
    )
    val = training_tables(
        _with_bucket(stored), None, spark.read.parquet(f"{folder}/vocabulary"), LENGTH, BATCH, contrastive=False
    )["val"]
    reports = evaluate_embeddings(val, quadrant_model(), LENGTH, k=2)
    first = reports["clusters"].groupBy("cluster").agg(F.min("user_id").alias("first"))
    number = F.row_number().over(Window.orderBy("first"))  # two rows
    of_all = reports["silhouette"].select("silhouette").scalar()
    return (
        reports["distribution"].join(reports["top_events"], "cluster").join(first, "cluster")
        .select(number.cast("bigint").alias("cluster"), "n_users", _rounded("share"), "top_events", _rounded(of_all, "silhouette"))
    )
