"""The registered queries in plain SQL, written from the rules rather than from the Spark plans."""

from __future__ import annotations

from eventstrand.adapters import TEST_MAX_WINDOWS, TEST_MEAN, TEST_MIN_EVENTS, TEST_SPEC, TEST_STD
from eventstrand.catalog.queries import BATCH, N_BUCKETS, SEED, SPLIT_HISTORY_ABOVE, SUPPLIER_SPEC, WIDE_SPEC


def _with(*ctes_and_body: str) -> str:
    *ctes, body = ctes_and_body
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


def _uniform(*parts) -> str:
    text = ", ".join(str(p) for p in parts)
    return f"(('0x' || substr(md5(concat_ws(':', {text})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _masked(events: str, probability: str) -> str:
    """Events with those set to 0 whose 32 bits of the digest of their block of four are below the probability."""
    digest = f"md5(concat_ws(':', {SEED}, user_id, window_start, (i - 1) // 4))"
    bits = f"(('0x' || substr({digest}, 1 + 8 * ((i - 1) % 4), 8))::BIGINT / 4294967296.0::DOUBLE)"
    return f"list_transform({events}, lambda e, i: CASE WHEN {bits} < {probability} THEN 0 ELSE e END)"


EV = """
ev AS (
  SELECT event_id, user_id, ts,
         CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3
                         WHEN 'click' THEN 17 WHEN 'error' THEN 21 END AS event_type,
         CASE WHEN k % 7 <> 0 THEN value::FLOAT END AS value,
         coalesce(k, 0) AS product_id
  FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events) WHERE user_id IS NOT NULL)"""

SUPPLIER_EV = """
ev AS (
  SELECT l_orderkey * 8 + l_linenumber AS event_id, l_suppkey AS user_id, l_shipdate AS ts,
         l_linenumber AS event_type, l_quantity::FLOAT AS value, coalesce(l_partkey, 0) AS product_id
  FROM lineitem WHERE l_suppkey IS NOT NULL)"""

FLOW = """
flow AS (
  SELECT *, (CASE WHEN event_type IN (2, 4) THEN -value WHEN event_type IN (3, 5, 19) THEN value
                  WHEN event_type = 21 THEN -value ELSE 0 END)::FLOAT AS net_cashflow FROM ev)"""

FEAT = f"""
summed AS (
  SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n_events,
         lag(ts) OVER w AS previous,
         CASE WHEN net_cashflow IS NOT NULL THEN sum(net_cashflow::DOUBLE) OVER w END AS after
  FROM flow WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
feat AS (
  SELECT *, coalesce(date_sub('second', previous, ts), 0) AS time_delta,
         coalesce(lag(after) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS balance
  FROM summed),
norm AS (
  SELECT *, ((coalesce(value, 0)::DOUBLE - {TEST_MEAN}) / {TEST_STD})::FLOAT AS value_norm,
         ln(time_delta + 1)::FLOAT AS time_delta_norm, ln(abs(balance) + 1)::FLOAT AS balance_norm
  FROM feat)"""


def _win(spec=TEST_SPEC, cap: int | None = None, min_events: int = 0) -> str:
    n = spec.length
    cut = f"[1:{cap}]" if cap else ""
    return f"""
hist AS (
  SELECT user_id, count(*) AS n_events, list(event_type ORDER BY pos) AS et,
         list(product_id ORDER BY pos) AS pr,
         list([value_norm, time_delta_norm, balance_norm] ORDER BY pos) AS nf
  FROM norm GROUP BY user_id HAVING count(*) >= {min_events}),
started AS (
  SELECT *, unnest(list_sort(
    CASE WHEN n_events <= {n + 1} THEN [0::BIGINT]
         ELSE list_distinct(range(0, n_events - {n},
           CASE WHEN n_events > {spec.stride_threshold} THEN {n} ELSE {spec.stride} END)
           || [n_events - {n + 1}]) END){cut}) AS window_start
  FROM hist),
win AS (
  SELECT user_id, n_events, window_start, et[window_start + 1 : window_start + {n}] AS ie,
         pr[window_start + 1 : window_start + {n}] AS ip, nf[window_start + 1 : window_start + {n}] AS nf,
         et[window_start + 2 : window_start + {n + 1}] AS te
  FROM started)"""


def _thousandths(f: str) -> str:
    parts = ", ".join(f"round(coalesce({f}[{k}], 0)::DOUBLE * 1000)::BIGINT" for k in (1, 2, 3))
    return f"concat_ws('/', {parts})"


def _features(nf: str = "nf", length: int | None = None) -> str:
    if length is None:
        return f"array_to_string(list_transform({nf}, lambda f: {_thousandths('f')}), ',') AS num_feats_seq"
    return (
        f"array_to_string(list_transform(range({length}), lambda i: {_thousandths(f'{nf}[i + 1]')}), ',')"
        " AS num_feats_seq"
    )


BASE = (EV, FLOW, FEAT)
WIN = (*BASE, _win())
WIN_TEXT = f"""
SELECT user_id, window_start, n_events, array_to_string(ie, ',') AS input_event_seq,
       array_to_string(ip, ',') AS input_product_seq, array_to_string(te, ',') AS target_event_seq,
       {_features()}
FROM win"""
FEATURE_ROWS = """
SELECT event_id, user_id, pos, n_events, product_id, event_type::BIGINT AS event_type,
       round(value_norm::DOUBLE, 4) + 0.0 AS value_norm,
       round(time_delta_norm::DOUBLE, 4) + 0.0 AS time_delta_norm,
       round(balance_norm::DOUBLE, 4) + 0.0 AS balance_norm
FROM norm"""

SPLIT = f"""
split AS (SELECT user_id, CASE WHEN {_uniform('user_id')} < 0.8 THEN 'train' ELSE 'test' END AS split
          FROM (SELECT DISTINCT user_id FROM ev))"""

VOCAB = """
vocab AS (
  SELECT orig_id, row_number() OVER (ORDER BY orig_id) AS new_id
  FROM (SELECT DISTINCT unnest(ip) AS orig_id FROM win) WHERE orig_id <> 0)"""

REMAP = _with(*WIN, VOCAB, """
SELECT user_id, window_start, string_agg(coalesce(new_id, 0)::VARCHAR, ',' ORDER BY i) AS input_product_seq
FROM (SELECT user_id, window_start, unnest(ip) AS p, generate_subscripts(ip, 1) AS i FROM win)
LEFT JOIN vocab ON p = orig_id GROUP BY user_id, window_start""")

SIDES = f"""
bucketed AS (SELECT *, user_id % {N_BUCKETS} AS bucket FROM win),
sides AS (
  SELECT bucket, CASE WHEN row_number() OVER (ORDER BY bucket) <= floor(count(*) OVER () * 0.8::DOUBLE)
                      THEN 'train' ELSE 'val' END AS side
  FROM (SELECT DISTINCT bucket FROM bucketed))"""

BUCKET = f"((('0x' || substr(md5(concat_ws(':', {SEED}, user_id)), 1, 8))::BIGINT) % {N_BUCKETS})"


def _padded(column: str, length: int, name: str) -> str:
    return (
        f"array_to_string(list_resize({column}::BIGINT[], {length}, 0), ',') AS {name}"
    )


def _matrix(names) -> str:
    n = TEST_SPEC.length
    columns = ", ".join(
        f"round(coalesce(nf[i + 1][{j + 1}], 0)::DOUBLE, 4) + 0.0 AS {name}" for j, name in enumerate(names)
    )
    return _with(*WIN, f"SELECT user_id, window_start, i, {columns} FROM win, range({n}) AS r(i)")


ORDERED = f"row_number() OVER (ORDER BY md5(concat_ws(':', {SEED}, {{key}})), {{key}}) - 1"

TRAINING = f"""
SELECT *, shuffled_position // {BATCH} AS batch_id FROM (
  SELECT user_id, window_start, side,
         row_number() OVER (PARTITION BY side ORDER BY md5(concat_ws(':', {SEED}, user_id, window_start))) - 1
           AS shuffled_position,
         {_padded('ie', TEST_SPEC.length, 'input_event_seq')},
         {_padded(_masked('ie', "CASE side WHEN 'train' THEN 0.4::DOUBLE ELSE 0.15::DOUBLE END"), TEST_SPEC.length,
                  'input_event_seq_v2')},
         {_padded("list_transform(ip, lambda p: coalesce(list_position(known, p), 0))",
           TEST_SPEC.length, 'input_product_seq')},
         {_padded('te', TEST_SPEC.length, 'target_event_seq')},
         {_features(length=TEST_SPEC.length)}
  FROM bucketed JOIN sides USING (bucket) JOIN split USING (user_id),
       (SELECT list(orig_id ORDER BY new_id) AS known FROM vocab)
  WHERE (side = 'train' AND split = 'train') OR (side = 'val' AND split = 'test'))"""

PAIRS = f"""
pairs AS (
  SELECT user_id, window_start, i - 1 AS i, te[i] AS target, ie[i] AS pred
  FROM (SELECT *, unnest(range(1, least(len(ie), len(te)) + 1)) AS i FROM win) WHERE te[i] <> 0)"""
PAIR_BASE = (*BASE, _win(WIDE_SPEC), PAIRS)

REPORT = """
classes AS (SELECT target AS c FROM pairs UNION SELECT pred FROM pairs),
report AS (
  SELECT c,
    coalesce((SELECT count(*) FROM pairs WHERE target = c AND pred = c)
             / nullif((SELECT count(*) FROM pairs WHERE pred = c), 0), 0) AS p,
    coalesce((SELECT count(*) FROM pairs WHERE target = c AND pred = c)
             / nullif((SELECT count(*) FROM pairs WHERE target = c), 0), 0) AS r,
    (SELECT count(*) FROM pairs WHERE target = c) AS support
  FROM classes),
scored AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM report)"""

WEIGHTS = """
counted AS (
  SELECT c AS event_type, greatest(coalesce(n, 1), 1) AS count
  FROM range(22) AS r(c) LEFT JOIN (SELECT event_type, count(*) AS n FROM ev GROUP BY 1) ON c = event_type),
weights AS (
  SELECT event_type, count,
         ln(1 + sum(count) OVER () / (21 * count))
           * CASE event_type WHEN 0 THEN 0 WHEN 21 THEN 2.5 ELSE 1 END AS weight
  FROM counted)"""

def _hundredths(weights) -> str:
    """Weighted sum of the three features of event i in hundredths, rounded down; 0 beyond the window."""
    return " + ".join(
        f"({w}) * coalesce(floor(nf[i + 1][{k}]::DOUBLE * 100)::BIGINT, 0)" for k, w in enumerate(weights, 1)
    )


BASE_SCORE = f"(7 * coalesce(ie[i + 1], 0) + 3 * {{product}} + {_hundredths((1, 2, 3))})"


def _positions(product: str = "coalesce(ip[i + 1], 0)", rows: str = "win") -> str:
    return f"""
positions AS (
  SELECT user_id, window_start, i, coalesce(te[i + 1], 0) AS target,
         list_transform(range(22), lambda c: (({BASE_SCORE.format(product=product)} + 5 * c) % 22 + 22) % 22) AS x
  FROM {rows}, range({TEST_SPEC.length}) AS r(i))"""


PREDICTED = """
pairs AS (SELECT target, list_position(x, list_max(x)) - 1 AS pred FROM positions WHERE target <> 0)"""
POSITIONS = f"""
{_positions()}, {PREDICTED},
position_loss AS (
  SELECT user_id, window_start, i, target,
         weight * (ln(list_sum(list_transform(x, lambda v: exp(v)))) - x[target + 1]) AS ce
  FROM positions JOIN weights ON target = event_type)"""
VAL_ROWS = """
val AS (
  SELECT bucketed.*, known FROM bucketed JOIN sides USING (bucket) JOIN split USING (user_id),
         (SELECT list(orig_id ORDER BY new_id) AS known FROM vocab)
  WHERE side = 'val' AND split = 'test')"""
REPORT_ROWS = """
SELECT c::VARCHAR AS class, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, support
FROM scored"""

VIEWS = f"""
views AS (
  SELECT vec_id, embedding::DOUBLE[] AS a,
         list_transform(range(64), lambda j:
           CASE WHEN {_uniform(SEED, 'vec_id', 'j')} < 0.15 THEN 0 ELSE embedding[j + 1] END)::DOUBLE[] AS b
  FROM embeddings),
unit AS (
  SELECT vec_id, list_transform(a, lambda v: v / sqrt(list_dot_product(a, a))) AS a,
         list_transform(b, lambda v: v / sqrt(list_dot_product(b, b))) AS b FROM views),
cosines AS (SELECT vec_id, list_dot_product(a, b) AS cosine FROM unit)"""

def _embedding(events: str) -> str:
    feats = _hundredths(("1 + j", "2 + j", "3 + j"))
    return f"""list_transform(range(8), lambda j: list_sum(list_transform(range(len({events})), lambda i:
      ({events}[i + 1] * (j + 1)) % 11 + (ip[i + 1] * (j + 2)) % 7
      + (((1 + i % 3) * ({feats})) % 13 + 13) % 13)))"""


VIEW_WIN = f"""
masked AS (
  SELECT user_id, window_start, ie, ip, nf, {_masked('ie', '0.15')} AS me FROM win),
views AS (
  SELECT user_id, window_start,
    {_embedding('ie')}::DOUBLE[] AS a, {_embedding('me')}::DOUBLE[] AS b
  FROM masked),
unit AS (
  SELECT user_id * 100000 + window_start AS vec_id, user_id, window_start,
         list_transform(a, lambda v: v / sqrt(list_dot_product(a, a))) AS a,
         list_transform(b, lambda v: v / sqrt(list_dot_product(b, b))) AS b FROM views),
cosines AS (SELECT list_dot_product(a, b) AS cosine FROM unit)"""


def _nce(key: str) -> str:
    return f"""
batched AS (SELECT *, ({ORDERED.format(key=key)}) // {BATCH} AS batch_id FROM unit),
sims AS (
  SELECT l.batch_id, l.vec_id, r.vec_id AS other, list_dot_product(l.a, r.b) / 0.07 AS s
  FROM batched l JOIN batched r ON l.batch_id = r.batch_id),
anchors AS (
  SELECT batch_id, vec_id, ln(sum(exp(s - 15))) + 15 - sum(CASE WHEN vec_id = other THEN s ELSE 0 END) AS loss
  FROM sims GROUP BY batch_id, vec_id),
losses AS (SELECT batch_id, count(*) AS n_rows, avg(loss) AS loss FROM anchors GROUP BY batch_id)"""

CLUSTER_EVENTS = """
per_cluster AS (
  SELECT user_id % 8 AS cluster, e AS event_type, count(*) AS n_events
  FROM (SELECT user_id, unnest(ie) AS e FROM win) WHERE e > 0 GROUP BY 1, 2)"""

TOP_EVENTS = """
top AS (
  SELECT cluster, string_agg('ev_' || event_type || ' ' || round_even(n_events / total * 100, 0)::INT || '%',
                             ' | ' ORDER BY rank) AS top_events
  FROM (SELECT *, sum(n_events) OVER (PARTITION BY cluster) AS total,
               row_number() OVER (PARTITION BY cluster ORDER BY n_events DESC, event_type) AS rank
        FROM per_cluster)
  WHERE rank <= 5 GROUP BY cluster)"""

# The best two clusters of points on an arc are the ones before and after an angle; all angles are tried.
TWO_CLUSTERS = """
two AS (
  SELECT user_id, avg(1 + list_sum(list_transform(ie, lambda e: e % 5))) AS x,
         avg(1 + list_sum(list_transform(ip, lambda p: coalesce(list_position(known, p), 0) % 7))) AS y
  FROM val GROUP BY user_id),
arc AS (
  SELECT user_id, x / sqrt(x * x + y * y) AS x, y / sqrt(x * x + y * y) AS y,
         row_number() OVER (ORDER BY atan2(y, x), user_id) AS place FROM two),
cuts AS (
  SELECT cut, sum(pow(x - mx, 2) + pow(y - my, 2)) AS cost
  FROM (SELECT *, avg(x) OVER s AS mx, avg(y) OVER s AS my
        FROM (SELECT a.*, c.place AS cut FROM arc a, arc c WHERE c.place < (SELECT max(place) FROM arc))
        WINDOW s AS (PARTITION BY cut, place <= cut)) GROUP BY cut),
parted AS (SELECT *, place <= (SELECT arg_min(cut, cost) FROM cuts) AS low FROM arc),
named AS (SELECT *, dense_rank() OVER (ORDER BY first) AS cluster
          FROM (SELECT *, min(user_id) OVER (PARTITION BY low) AS first FROM parted)),
apart AS (
  SELECT a.user_id, a.low = b.low AS own, avg(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d
  FROM named a JOIN named b ON a.user_id <> b.user_id GROUP BY 1, 2),
widths AS (
  SELECT user_id, coalesce((max(CASE WHEN NOT own THEN d END) - max(CASE WHEN own THEN d END)) / max(d), 0) AS s
  FROM apart GROUP BY user_id),
per_cluster AS (
  SELECT cluster, e AS event_type, count(*) AS n_events
  FROM (SELECT user_id, unnest(ie) AS e FROM val) JOIN named USING (user_id) WHERE e > 0 GROUP BY 1, 2)"""


def _main_component(source: str, name: str) -> str:
    """The eigenvector of the largest eigenvalue: a column of a high power of the matrix, by repeated squaring."""
    steps = [f"{name}0 AS MATERIALIZED (SELECT i, j, c / (SELECT sum(c) FROM {source} WHERE i = j) AS c FROM {source})"]
    for k in range(14):
        steps.append(f"""
        {name}{k}s AS MATERIALIZED (
          SELECT a.i, b.j, sum(a.c * b.c) AS c FROM {name}{k} a JOIN {name}{k} b ON a.j = b.i GROUP BY 1, 2),
        {name}{k + 1} AS MATERIALIZED (
          SELECT i, j, c / (SELECT sum(c) FROM {name}{k}s WHERE i = j) AS c FROM {name}{k}s)""")
    return ", ".join(steps) + f""",
        {name} AS MATERIALIZED (
          SELECT i, c / sqrt(sum(c * c) OVER ()) AS v FROM {name}14
          WHERE j = (SELECT arg_max(i, c) FROM {name}14 WHERE i = j)),
        {name}_value AS MATERIALIZED (
          SELECT sum(a.v * s.c * b.v) AS value FROM {source} s JOIN {name} a ON a.i = s.i JOIN {name} b ON b.i = s.j)"""


PCA = (
    """
centred AS MATERIALIZED (
  SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS x
  FROM (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)),
spread AS MATERIALIZED (
  SELECT a.i, b.i AS j, sum(a.x * b.x) AS c FROM centred a JOIN centred b USING (vec_id) GROUP BY 1, 2)""",
    _main_component("spread", "one"),
    """
rest AS MATERIALIZED (
  SELECT s.i, s.j, s.c - value * a.v * b.v AS c
  FROM spread s JOIN one a ON a.i = s.i JOIN one b ON b.i = s.j, one_value)""",
    _main_component("rest", "two"),
    """
points AS (
  SELECT vec_id, round(abs(sum(x * one.v)), 4) AS pc1, round(abs(sum(x * two.v)), 4) AS pc2,
         (SELECT round(100 * (one_value.value + two_value.value) / (SELECT sum(c) FROM spread WHERE i = j), 4)
          FROM one_value, two_value) AS explained_percent
  FROM centred JOIN one USING (i) JOIN two USING (i) GROUP BY vec_id)""",
)

DISTANCES = """
dist AS (
  SELECT l.vec_id, l.label AS own, r.label AS label, {distance} AS d
  FROM embeddings l JOIN embeddings r ON l.vec_id <> r.vec_id),
mean AS (SELECT vec_id, own, label, avg(d) AS d FROM dist GROUP BY 1, 2, 3),
ab AS (
  SELECT vec_id, max(CASE WHEN own = label THEN d END) AS a, min(CASE WHEN own <> label THEN d END) AS b
  FROM mean GROUP BY vec_id)"""
EUCLID = "list_distance(l.embedding::DOUBLE[], r.embedding::DOUBLE[])"
SILHOUETTE = "avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END)"

SEMI_JOIN = _with(*WIN, SPLIT, """
    SELECT user_id, window_start, array_to_string(ie, ',') AS input_event_seq
    FROM win WHERE user_id IN (SELECT user_id FROM split WHERE split = 'train')""")
TRAIN_VAL = _with(*WIN, SPLIT, SIDES, """
    SELECT user_id, window_start, bucket, side, array_to_string(te, ',') AS target_event_seq
    FROM bucketed JOIN sides USING (bucket) JOIN split USING (user_id)
    WHERE (side = 'train' AND split = 'train') OR (side = 'val' AND split = 'test')""")

FOCAL = "CASE WHEN target = 0 THEN 0 ELSE pow(1 - exp(-ce), 2.5) * ce END"
MEAN_FOCAL = _with(*WIN, WEIGHTS, POSITIONS, f"""
    SELECT round(avg({FOCAL}), 4) AS focal_loss, count(*) AS n_rows FROM position_loss""")

SQL = {
    "scan_events": _with(EV, """
        SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp_event,
               round(value::DOUBLE, 4) + 0.0 AS value, event_type::BIGINT AS event_type, product_id FROM ev"""),
    "distinct_users": _with(EV, "SELECT DISTINCT user_id FROM ev"),
    "net_cashflow": _with(EV, FLOW, """
        SELECT event_id, round(net_cashflow::DOUBLE, 4) + 0.0 AS net_cashflow FROM flow"""),
    "time_delta": _with(*BASE, "SELECT event_id, time_delta FROM feat"),
    "running_balance": _with(*BASE, "SELECT event_id, round(balance, 4) + 0.0 AS balance FROM feat"),
    "event_features": _with(*BASE, FEATURE_ROWS),
    "event_features_segmented": _with(*BASE, FEATURE_ROWS),
    "heavy_user_segments": _with(EV, f"""
        SELECT user_id, count(*) AS n_events, true AS bounded FROM ev GROUP BY user_id
        HAVING count(*) > {SPLIT_HISTORY_ABOVE}"""),
    "user_history": _with(*BASE, f"""
        SELECT user_id, n_events, pos // {TEST_SPEC.length} AS chunk,
               string_agg(event_type::VARCHAR, ',' ORDER BY pos) AS event_type,
               string_agg(product_id::VARCHAR, ',' ORDER BY pos) AS product_id,
               string_agg({_thousandths('[value_norm, time_delta_norm, balance_norm]')}, ',' ORDER BY pos)
                 AS num_feats_seq
        FROM norm GROUP BY 1, 2, 3"""),
    "sequence_windows": _with(*WIN, WIN_TEXT),
    "sequence_windows_segmented": _with(*WIN, WIN_TEXT),
    "sequence_windows_wide": _with(*BASE, _win(WIDE_SPEC), WIN_TEXT),
    "adaptive_stride_windows": _with(*WIN, f"""
        SELECT user_id, window_start, n_events,
               (CASE WHEN n_events > {TEST_SPEC.stride_threshold} THEN {TEST_SPEC.length}
                     ELSE {TEST_SPEC.stride} END)::BIGINT AS stride FROM win"""),
    "capped_windows": _with(*BASE, _win(cap=TEST_MAX_WINDOWS), WIN_TEXT),
    "min_events_filter": _with(*BASE, _win(min_events=TEST_MIN_EVENTS), WIN_TEXT),
    "history_filter_counts": _with(EV, f"""
        SELECT count(*) FILTER (n >= {TEST_MIN_EVENTS}) AS users_kept,
               count(*) FILTER (n < {TEST_MIN_EVENTS}) AS users_dropped
        FROM (SELECT count(*) AS n FROM ev GROUP BY user_id)"""),
    "supplier_windows": _with(SUPPLIER_EV, FLOW, FEAT, _win(SUPPLIER_SPEC), WIN_TEXT),
    "product_vocab": _with(*WIN, VOCAB, "SELECT orig_id, new_id FROM vocab"),
    "remap_products": REMAP,
    "remap_products_joined": REMAP,
    "semi_join_split": SEMI_JOIN,
    "stored_semi_join": SEMI_JOIN,
    "uid_split_counts": _with(*WIN, SPLIT, """
        SELECT split, count(*) AS n_rows FROM win JOIN split USING (user_id) GROUP BY split"""),
    "uid_split_source": _with(EV, SPLIT, "SELECT user_id, split FROM split"),
    "uid_split_document": _with(EV, SPLIT, "SELECT user_id, split FROM split"),
    "first_files_scan": _with(EV, "SELECT DISTINCT user_id, user_id % 5 AS file FROM ev WHERE user_id % 5 < 3"),
    "report_roundtrip": _with(*PAIR_BASE, REPORT, REPORT_ROWS),
    "stored_dataset_report": _with(
        *WIN, VOCAB, SPLIT, SIDES, VAL_ROWS,
        _positions("coalesce(list_position(known, ip[i + 1]), 0)", "val"), PREDICTED, REPORT, REPORT_ROWS,
    ),
    "bucket_split": _with(*WIN, SIDES, "SELECT bucket, side FROM sides"),
    "train_val_rows": TRAIN_VAL,
    "stored_train_val_rows": TRAIN_VAL,
    "union_scans": """
        WITH both_sources AS (
          SELECT 'events' AS source, user_id,
                 CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3
                                 WHEN 'click' THEN 17 WHEN 'error' THEN 21 END AS event_type,
                 coalesce((props->>'$.k')::BIGINT, 0) AS product_id
          FROM events WHERE user_id IS NOT NULL
          UNION ALL
          SELECT 'lineitem', l_suppkey, l_linenumber, coalesce(l_partkey, 0) FROM lineitem
          WHERE l_suppkey IS NOT NULL)
        SELECT source, event_type::BIGINT AS event_type, count(*) AS n,
               sum(product_id)::BIGINT AS product_sum, count(DISTINCT user_id) AS n_users
        FROM both_sources GROUP BY 1, 2""",
    "pad_sequences": _with(*BASE, _win(WIDE_SPEC), f"""
        SELECT user_id, window_start, {_padded('ie', WIDE_SPEC.length, 'input_event_seq')},
               {_padded('ip', WIDE_SPEC.length, 'input_product_seq')},
               {_padded('te', WIDE_SPEC.length, 'target_event_seq')}, {WIDE_SPEC.length}::BIGINT AS n_feats
        FROM win"""),
    "mask_events": _with(*WIN, f"""
        SELECT user_id, window_start, array_to_string(ie, ',') AS input_event_seq,
               array_to_string({_masked('ie', '0.15')}, ',') AS input_event_seq_v2
        FROM win"""),
    "num_feats_matrix": _matrix(["value_norm", "time_delta_norm", "balance_norm"]),
    "num_feats_no_balance": _matrix(["value_norm", "time_delta_norm"]),
    "seeded_sample": _with(*WIN, f"""
        SELECT user_id, window_start FROM win
        ORDER BY md5(concat_ws(':', {SEED}, user_id, window_start)), user_id, window_start LIMIT 200"""),
    "seeded_batches": _with(*WIN, f"""
        SELECT *, shuffled_position // {BATCH} AS batch_id FROM (
          SELECT user_id, window_start, {ORDERED.format(key='user_id, window_start')} AS shuffled_position,
                 array_to_string(ie, ',') AS input_event_seq FROM win)"""),
    "mean_pool": _with(*WIN, f"""
        SELECT user_id, window_start, j - 1 AS i,
               round(list_sum(list_transform(nf, lambda f: f[j]::DOUBLE)) / {TEST_SPEC.length}, 4) + 0.0 AS x
        FROM win, range(1, 4) AS r(j)"""),
    "training_batches": _with(*WIN, VOCAB, SPLIT, SIDES, TRAINING),
    "sink_roundtrip": _with(*WIN, f"SELECT *, {BUCKET} AS bucket FROM ({WIN_TEXT})"),
    "resume_pending_buckets": _with(*WIN, f"""
        SELECT user_id, window_start, {BUCKET} AS bucket,
               CASE WHEN {BUCKET} % 2 = 0 THEN 'first run' ELSE 'second run' END AS written_by,
               array_to_string(ie, ',') AS input_event_seq, {_features()} FROM win"""),
    "input_fingerprint": _with(EV, f"""
        SELECT {BUCKET} AS bucket, count(*) AS n_events, true AS same FROM ev GROUP BY 1"""),
    "stored_user_counts": _with(EV, f"""
        SELECT count(*) FILTER (n >= {TEST_MIN_EVENTS}) AS users_kept,
               count(*) FILTER (n < {TEST_MIN_EVENTS}) AS users_dropped
        FROM (SELECT count(*) AS n FROM ev GROUP BY user_id)"""),
    "argmax_predictions": _with(*WIN, f"""
        SELECT user_id, window_start, string_agg(best::VARCHAR, ',' ORDER BY i) AS pred_event_seq FROM (
          SELECT user_id, window_start, i, arg_max(c, ((base + 5 * c) % 22 + 22) % 22) AS best FROM (
            SELECT user_id, window_start, i, c, {BASE_SCORE.format(product='coalesce(ip[i + 1], 0)')} AS base
            FROM win, range({TEST_SPEC.length}) AS r(i), range(22) AS k(c))
          GROUP BY 1, 2, 3)
        GROUP BY 1, 2"""),
    "prediction_pairs": _with(*PAIR_BASE, """
        SELECT user_id, window_start, i, target::BIGINT AS target, pred::BIGINT AS pred FROM pairs"""),
    "per_class_report": _with(*PAIR_BASE, REPORT, REPORT_ROWS),
    "next_event_report": _with(*WIN, WEIGHTS, POSITIONS, REPORT, REPORT_ROWS),
    "next_event_loss": MEAN_FOCAL,
    "position_scores": _with(*WIN, _positions(), """
        SELECT user_id, window_start, i, target::BIGINT AS target, list_position(x, list_max(x)) - 1 AS pred,
               x[target + 1]::DOUBLE AS target_score,
               round(ln(list_sum(list_transform(x, lambda v: exp(v)))), 4) AS log_sum FROM positions"""),
    "macro_weighted_metrics": _with(*PAIR_BASE, REPORT, """
        SELECT round(avg(p), 4) AS precision_macro, round(avg(r), 4) AS recall_macro,
               round(avg(f), 4) AS f1_macro,
               round(sum(p * support) / sum(support), 4) AS precision_weighted,
               round(sum(r * support) / sum(support), 4) AS recall_weighted,
               round(sum(f * support) / sum(support), 4) AS f1_weighted
        FROM scored"""),
    "class_support": _with(EV, """
        SELECT event_type::BIGINT AS event_type, count(*) AS support FROM ev GROUP BY 1"""),
    "class_weights": _with(EV, WEIGHTS, """
        SELECT event_type, count, round(weight, 4) AS weight FROM weights"""),
    "focal_loss": MEAN_FOCAL,
    "focal_rows": _with(*WIN, WEIGHTS, POSITIONS, f"""
        SELECT user_id, window_start, i, target::BIGINT AS target, round({FOCAL}, 4) AS focal FROM position_loss"""),
    "l2_normalize": """
        SELECT vec_id, i, round(embedding[i + 1]::DOUBLE
               / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) + 0.0 AS x
        FROM embeddings, range(64) AS r(i)""",
    "pair_cosine": _with(VIEWS, "SELECT vec_id, round(cosine, 4) AS cosine FROM cosines"),
    "positive_pair_cosine": _with(VIEWS, """
        SELECT round(avg(cosine), 4) AS mean_cosine, count(*) AS n_pairs FROM cosines"""),
    "cosine_histogram": _with(VIEWS, """
        ends AS (SELECT min(cosine) AS lo, (max(cosine) - min(cosine)) / 64 AS w FROM cosines),
        hits AS (SELECT least(floor((cosine - lo) / w), 63)::BIGINT AS bin, count(*) AS n
                 FROM cosines, ends GROUP BY 1)""", """
        SELECT b AS bin, round(lo + b * w, 4) AS lower, round(lo + (b + 1) * w, 4) AS upper, coalesce(n, 0) AS n
        FROM ends, range(64) AS r(b) LEFT JOIN hits ON b = bin"""),
    "info_nce_batches": _with(VIEWS, _nce("vec_id"), "SELECT batch_id, n_rows, round(loss, 4) AS loss FROM losses"),
    "info_nce": _with(VIEWS, _nce("vec_id"), """
        SELECT round(avg(loss), 4) AS info_nce, count(*) AS n_batches FROM losses"""),
    "contrastive_validation": _with(*WIN, VIEW_WIN, _nce("user_id, window_start"), """
        SELECT round((SELECT avg(loss) FROM losses), 4) AS info_nce, round(avg(cosine), 4) AS mean_cosine,
               count(*) AS n_pairs FROM cosines"""),
    "score_embeddings": _with(*WIN, f"""
        SELECT user_id, window_start, k AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY user_id, window_start)), 4)
                 AS x
        FROM (SELECT user_id, window_start, k, ({_embedding('ie')})[k + 1]::DOUBLE AS x
              FROM win, range(8) AS r(k))"""),
    "user_mean_embedding": """
        SELECT user_id, i, round(m, 4) + 0.0 AS mean,
               round(m / sqrt(sum(m * m) OVER (PARTITION BY user_id)), 4) + 0.0 AS unit
        FROM (SELECT vec_id // 5 AS user_id, i, avg(embedding[i + 1]::DOUBLE) AS m
              FROM embeddings, range(64) AS r(i) GROUP BY 1, 2)""",
    "silhouette_exact": _with(DISTANCES.format(distance=EUCLID), f"""
        SELECT round({SILHOUETTE}, 6) AS silhouette, count(*) AS n_points FROM ab"""),
    "silhouette_scalable": _with(DISTANCES.format(distance=f"pow({EUCLID}, 2)"), f"""
        SELECT round({SILHOUETTE}, 6) AS silhouette FROM ab"""),
    "kmeans_clusters": """
        SELECT vec_id AS user_id, dense_rank() OVER (ORDER BY first) AS cluster
        FROM (SELECT vec_id, min(vec_id) OVER (PARTITION BY label % 10) AS first FROM embeddings)""",
    "best_k": _with("""
        points AS (
          SELECT vec_id, label % 6 AS label,
                 list_transform(embedding, lambda x, i: x::DOUBLE / 100
                   + CASE WHEN i - 1 = label % 6 THEN 10 ELSE 0 END)::DOUBLE[] AS embedding
          FROM embeddings)""", DISTANCES.format(distance=EUCLID).replace("embeddings", "points"), f"""
        SELECT 6::BIGINT AS k, round({SILHOUETTE}, 4) AS silhouette FROM ab"""),
    "pca_2d": _with(*PCA, "SELECT vec_id AS user_id, pc1, pc2, explained_percent FROM points"),
    "points_report": _with(*PCA, """
        SELECT vec_id AS user_id, label::BIGINT AS cluster, pc1, pc2, explained_percent
        FROM points JOIN embeddings USING (vec_id)"""),
    "stored_dataset_clusters": _with(*WIN, VOCAB, SPLIT, SIDES, VAL_ROWS, TWO_CLUSTERS, TOP_EVENTS, """
        SELECT cluster, count(*) AS n_users, round(count(*) / (SELECT count(*) FROM named), 4) AS share,
               any_value(top_events) AS top_events, (SELECT round(avg(s), 4) FROM widths) AS silhouette
        FROM named JOIN top USING (cluster) GROUP BY cluster"""),
    "cluster_distribution": """
        SELECT label::BIGINT AS cluster, count(*) AS n_users,
               round(count(*) / (SELECT count(*) FROM embeddings), 4) AS share
        FROM embeddings GROUP BY label""",
    "cluster_event_counts": _with(*WIN, CLUSTER_EVENTS, """
        SELECT cluster, event_type::BIGINT AS event_type, n_events FROM per_cluster"""),
    "cluster_top_events": _with(*WIN, CLUSTER_EVENTS, TOP_EVENTS, "SELECT cluster, top_events FROM top"),
}
