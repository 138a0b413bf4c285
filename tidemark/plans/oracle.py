"""The same results as ``catalog``, stated in SQL for DuckDB over the test tables."""

from __future__ import annotations

from tidemark.plans.catalog import AS_OF, ORDER_SHIFT, SPLIT, STORED, TYPES

# Bounds of the latency buckets.
PREDICT_BUCKETS = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0)
FEATURE_FETCH_BUCKETS = (0.001, 0.005, 0.01, 0.02, 0.05, 0.1)

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


# ---- point-in-time joins ---------------------------------------------------


def _asof(names: list[str]) -> str:
    chain = "(SELECT event_id, user_id, ts AS event_ts FROM events WHERE event_type = 'purchase')"
    for n in names:
        chain = f"""(
          SELECT s.*, f.value AS {n}_value, f.ts AS _ts_{n}s FROM {chain} s
          ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = '{n}') f
          ON s.user_id = f.user_id AND s.event_ts >= f.ts)"""
    return f"SELECT * FROM {chain} q"


PIT_TIES = """
WITH features AS (
  SELECT o_custkey, o_orderdate, o_totalprice, o_orderkey FROM (
    SELECT *, row_number() OVER (
      PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS rn FROM orders)
  WHERE rn = 1),
spine AS (SELECT o_orderkey, o_custkey AS cust, o_orderdate AS event_ts FROM orders)
SELECT s.o_orderkey, s.cust, s.event_ts, f.o_totalprice, f.o_orderkey AS last_order,
  f.o_orderdate AS _ts_orders
FROM spine s ASOF LEFT JOIN features f ON s.cust = f.o_custkey AND s.event_ts >= f.o_orderdate
"""

PIT_KEYS = f"""
WITH f AS (
  SELECT o_custkey, o_orderdate + INTERVAL {ORDER_SHIFT} DAY AS at, o_totalprice, o_orderstatus FROM (
    SELECT *, row_number() OVER (
      PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS rn FROM orders)
  WHERE rn = 1),
s AS (SELECT *, CASE WHEN event_id % 11 > 0 THEN event_id % 150 + 1 END AS customer
  FROM ({_asof(["click", "view"])}))
SELECT s.*, f.o_totalprice, f.o_orderstatus, f.at AS _ts_orders
FROM s ASOF LEFT JOIN f ON s.customer = f.o_custkey AND s.event_ts >= f.at
"""

# ---- latest values ---------------------------------------------------------

WRITES = f"""
SELECT user_id, event_id, ts, event_type, value, {K} AS k, value > 100 AS big FROM events
"""


def _fold(source: str, order: str = "event_id", event: str = "ts") -> str:
    """Newest value per field; ``order`` is a sort list."""
    def newest(value: str, where: str) -> str:
        return (
            f"(list({value} ORDER BY {order}) FILTER (WHERE {where}))[-1]"
        )

    fields = [f"{newest('value', f'''event_type = '{t}' ''')} AS {t}" for t in TYPES]
    fields += [
        f"{newest('k', 'k IS NOT NULL')} AS last_k",
        f"{newest('event_type', 'true')} AS last_type",
        f"{newest('big', 'big IS NOT NULL')} AS is_big",
    ]
    return f"""SELECT user_id, {", ".join(fields)}, {newest(event, 'true')} AS _event_ts
      FROM ({source}) w GROUP BY user_id"""



ISLANDS = f"""
SELECT * EXCLUDE (prev, island, last_island) FROM (
  SELECT *, max(island) OVER (PARTITION BY user_id) AS last_island FROM (
    SELECT *, sum(CASE WHEN prev IS NOT NULL AND ts - prev >= INTERVAL 2 DAY THEN 1 ELSE 0 END)
      OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM (
      SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM ({WRITES}))))
WHERE island = last_island
"""
LATE = f"SELECT * REPLACE (ts - to_hours(CAST(k AS INTEGER)) AS ts) FROM ({ISLANDS})"
LATEST_TTL = f"""
SELECT v.* FROM ({_fold(ISLANDS)}) v
JOIN (SELECT user_id, max(ts) AS last_write FROM events GROUP BY user_id) e USING (user_id)
WHERE e.last_write + INTERVAL 2 DAY > TIMESTAMP '{AS_OF}'
"""

IDS = "(SELECT DISTINCT c_custkey AS user_id FROM customer)"
ACTIVITY = ", ".join(
    [f"coalesce(v.{t}, 0.0) AS {t}" for t in TYPES]
    + [
        "coalesce(v.last_k, 0) AS last_k",
        "coalesce(v.last_type, 'unknown') AS last_type",
        "coalesce(v.is_big, false) AS is_big",
    ]
)
LOOKUP = f"""
SELECT i.user_id, {ACTIVITY}, v._event_ts
FROM {IDS} i LEFT JOIN ({LATEST_TTL}) v USING (user_id)
"""
PARTIAL_LOOKUP = f"""
SELECT user_id, click, is_big, CAST(NULL AS VARCHAR) AS nope, _event_ts FROM ({LOOKUP})
"""
MODEL_FEATURES = f"""
SELECT l.* EXCLUDE (_event_ts), l._event_ts AS _ts_activity,
  coalesce(o.last_price, -1.0) AS last_price, coalesce(o.last_status, 'none') AS last_status,
  o._event_ts AS _ts_order_activity
FROM ({LOOKUP}) l LEFT JOIN (
  SELECT o_custkey, arg_max(o_totalprice, row(o_orderdate, o_orderkey)) AS last_price,
    arg_max(o_orderstatus, row(o_orderdate, o_orderkey)) AS last_status,
    arg_max(o_orderdate, row(o_orderdate, o_orderkey)) AS _event_ts
  FROM orders GROUP BY o_custkey) o ON l.user_id = o.o_custkey
"""
FEATURE_AGE = f"""
SELECT user_id, _event_ts,
  round((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(_event_ts)) / 1e6, 6) AS age_seconds
FROM ({LOOKUP})
"""


def _kv_export() -> str:
    key = "concat('ff:{activity:', user_id, '}:v1') AS key"
    none, zero = "CAST(NULL AS VARCHAR) AS text", "CAST(NULL AS DOUBLE) AS number"
    parts = [
        f"SELECT {key}, '{t}' AS field, {none}, round({t}, 6) AS number FROM v WHERE {t} IS NOT NULL"
        for t in TYPES
    ]
    parts += [
        f"SELECT {key}, '_event_ts', {none}, round(epoch_us(_event_ts) / 1e6, 6) FROM v",
        f"SELECT {key}, 'last_k', CAST(last_k AS VARCHAR), {zero} FROM v",
        f"SELECT {key}, 'last_type', last_type, {zero} FROM v",
        f"SELECT {key}, 'is_big', CASE WHEN is_big THEN '1' ELSE '0' END, {zero} FROM v",
    ]
    return f"WITH v AS ({LATEST_TTL}) " + " UNION ALL ".join(parts)


KV_DECODE = """
SELECT concat('ff:{vectors:', vec_id, '}:v1') AS key, TIMESTAMP '2024-01-01 00:00:00' AS _event_ts,
  CAST(label AS BIGINT) AS label, 'fallback' AS missing,
  CAST(i - 1 AS INTEGER) AS pos, round(CAST(embedding[i] AS DOUBLE), 6) AS x
FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
"""

# ---- transform and streaming -----------------------------------------------

STATUS = f"""
SELECT *, {K} AS kk,
  CASE WHEN {K} % 10 = 3 OR {K} IN (44, 46, 48) THEN 'error' WHEN {K} % 2 = 0 THEN 'ok' ELSE 'skipped' END AS status
FROM events
"""
# Only messages with an odd time are rejected and whole.
ODD_TIME = "CASE kk WHEN 44 THEN 'NaN' WHEN 46 THEN '1e300' ELSE 'yesterday' END"
DEAD_LETTER = f"""
SELECT event_id, status,
  CASE WHEN status <> 'error' OR k_odd THEN user_id END AS user_id,
  CASE WHEN status <> 'error' OR k_odd THEN kk END AS k,
  CASE WHEN status <> 'error' THEN round(epoch_us(ts) / 1e6, 3) END AS seconds,
  CASE WHEN k_odd THEN 'event time out of range' WHEN status = 'error' THEN 'not parsed' END AS reason,
  CASE WHEN status = 'error' THEN len(raw) END AS raw_length,
  CASE WHEN status = 'error' THEN sha256(raw) END AS raw_sha256
FROM (SELECT *, CASE WHEN kk % 10 = 3 THEN substr(whole, 1, 20) ELSE whole END AS raw FROM (
  SELECT *, kk IN (44, 46, 48) AS k_odd, concat('{{"user_id":', user_id, ',"event_type":"', event_type,
    '","value":', value, ',"k":', kk, ',"ts":"', {ODD_TIME}, '"}}') AS whole FROM ({STATUS})))
"""
# A whole day of messages goes to the week of its day; a file holds an eighth of all at most.
BOUNDED_BATCHES = """
WITH w AS (SELECT count(*) AS n, (SELECT count(*) // 8 + 1 FROM events) AS most
  FROM events GROUP BY dayofyear(ts) // 7),
b AS (SELECT most AS messages, n // most AS batches FROM w
  UNION ALL SELECT n % most, 1 FROM w WHERE n % most > 0)
SELECT messages, CAST(sum(batches) AS BIGINT) AS batches FROM b WHERE batches > 0 GROUP BY messages
"""
INGEST_STATS = f"""
SELECT CAST(event_id % 3 AS INTEGER) AS partition, count(*) AS messages_consumed,
  count(*) FILTER (status = 'ok') AS rows_written_online,
  count(*) FILTER (status = 'ok') AS rows_written_offline,
  count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'error') AS errors,
  max(event_id) AS last_offset
FROM ({STATUS}) GROUP BY event_id % 3
"""
STREAM_INGEST = f"""
SELECT user_id, ts AS _event_ts, value, kk AS k, event_type FROM ({STATUS}) WHERE status = 'ok'
"""
STREAM_LATEST = f"""
SELECT user_id, arg_max(value, event_id) AS value, arg_max(kk, event_id) AS k,
  arg_max(event_type, event_id) AS event_type, max(ts) AS _event_ts
FROM (
  SELECT * FROM (
    SELECT *, max(island) OVER (PARTITION BY user_id) AS newest FROM (
      SELECT *, sum(CASE WHEN prev IS NOT NULL AND ts - prev >= INTERVAL 1 DAY THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM (
        SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS prev
        FROM ({STATUS}) WHERE status = 'ok')))
  WHERE island = newest)
GROUP BY user_id
"""

# ---- drift -----------------------------------------------------------------


def _edges(long: str, bins: int = 10) -> str:
    """(feature, n, edges) of a (feature, value) table by exact ranks."""
    probabilities = ", ".join(repr(i * (1.0 / bins)) for i in range(bins)) + ", 1.0"
    return f"""
    SELECT feature, n, CASE WHEN len(e) < 2
        THEN list_concat([e[1] + i * (((e[1] + 1e-9) - e[1]) / {bins})
          FOR i IN range(0, {bins})], [e[1] + 1e-9]) ELSE e END AS edges
    FROM (SELECT feature, n, list_sort(list_distinct(list(q))) AS e FROM (
      SELECT a.feature, p.n, CASE WHEN p.r - floor(p.r) < 0.5
          THEN a.value + (b.value - a.value) * (p.r - floor(p.r))
          ELSE b.value - (b.value - a.value) * (1.0 - (p.r - floor(p.r))) END AS q
      FROM (SELECT feature, n, CAST(prob AS DOUBLE) * CAST(n - 1 AS DOUBLE) AS r FROM (
          SELECT feature, count(*) AS n FROM ({long}) GROUP BY feature)
          CROSS JOIN (SELECT unnest([{probabilities}]::DOUBLE[]) AS prob)) p
      JOIN (SELECT feature, value, row_number() OVER (
          PARTITION BY feature ORDER BY value) - 1 AS rk FROM ({long})) a
        ON a.feature = p.feature AND a.rk = CAST(floor(p.r) AS BIGINT)
      JOIN (SELECT feature, value, row_number() OVER (
          PARTITION BY feature ORDER BY value) - 1 AS rk FROM ({long})) b
        ON b.feature = p.feature AND b.rk = least(CAST(floor(p.r) AS BIGINT) + 1, p.n - 1))
    GROUP BY feature, n)"""


def _long(source: str, columns: list[str], where: str = "true") -> str:
    parts = [
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM ({source}) "
        f"WHERE {where} AND {c} IS NOT NULL"
        for c in columns
    ]
    return " UNION ALL ".join(parts)


LINE_COLUMNS = ["l_quantity", "l_discount", "l_extendedprice"]
QUANTILES = f"""
SELECT feature, n, CAST(i - 1 AS INTEGER) AS pos, round(edges[i], 6) AS edge FROM (
  SELECT *, unnest(range(1, len(edges) + 1)) AS i FROM (
    {_edges(_long("SELECT * FROM lineitem", LINE_COLUMNS))}))
"""

BEFORE, AFTER = f"ts < TIMESTAMP '{SPLIT}'", f"ts >= TIMESTAMP '{SPLIT}'"
OLD_VALUES = _long(f"SELECT * FROM events WHERE {BEFORE}", ["value"])
NEW_VALUES = _long(f"SELECT * FROM events WHERE {AFTER}", ["value"])


def _counts(edges: str, base: str, current: str) -> str:
    bin_of = """CASE WHEN value >= edges[1] AND value <= edges[len(edges)]
      THEN least(len(list_filter(edges, lambda e: e <= value)), len(edges) - 1) - 1 ELSE -1 END"""
    return f"""
    SELECT x.feature, edges, {bin_of} AS bin, count(*) FILTER (side = 0) AS baseline,
      count(*) FILTER (side = 1) AS current
    FROM (SELECT *, 0 AS side FROM ({base}) UNION ALL SELECT *, 1 AS side FROM ({current})) x
    JOIN ({edges}) e ON x.feature = e.feature GROUP BY ALL"""


HISTOGRAM = f"""
WITH e AS ({_edges(OLD_VALUES)}), c AS ({_counts("FROM e", OLD_VALUES, NEW_VALUES)})
SELECT g.feature, CAST(g.bin AS INTEGER) AS bin, round(g.edges[g.bin + 1], 6) AS low,
  round(g.edges[g.bin + 2], 6) AS high, coalesce(c.baseline, 0) AS baseline,
  coalesce(c.current, 0) AS current
FROM (SELECT *, unnest(range(0, len(edges) - 1)) AS bin FROM e) g
LEFT JOIN c ON g.feature = c.feature AND g.bin = c.bin
"""


def _psi(features: list[str], base: str, current: str) -> str:
    names = ", ".join(f"'{f}'" for f in features)
    return f"""
    WITH e AS ({_edges(base)}), c AS ({_counts("FROM e", base, current)}),
    sides AS (SELECT feature, sum(baseline) AS any_base, sum(current) AS any_current,
      coalesce(sum(baseline) FILTER (bin >= 0), 0) AS nb,
      coalesce(sum(current) FILTER (bin >= 0), 0) AS nc FROM c GROUP BY feature),
    terms AS (SELECT c.feature, len(edges) - 1 AS bins,
      baseline / CAST(greatest(nb, 1) AS DOUBLE) + 1e-6 AS b,
      current / CAST(greatest(nc, 1) AS DOUBLE) + 1e-6 AS cu
      FROM c JOIN sides USING (feature) WHERE bin >= 0 AND any_base > 0 AND any_current > 0),
    found AS (SELECT feature, bins, sum((cu - b) * ln(cu / b)) AS psi FROM terms GROUP BY ALL)
    SELECT f.feature, round(coalesce(psi, 0.0), 6) AS statistic,
      CAST(0.25 AS DOUBLE) AS threshold, coalesce(psi, 0.0) >= 0.25 AS drifted, 'psi' AS method,
      CAST(coalesce(bins, 10) AS INTEGER) AS bins
    FROM (SELECT unnest([{names}]) AS feature) f LEFT JOIN found USING (feature)"""


FIVE = "5.0::DOUBLE + value * 0"
PSI_DEGENERATE = _psi(
    ["same", "far", "empty"],
    _long(
        f"SELECT {FIVE} AS same, {FIVE} AS far, value AS empty FROM events WHERE {BEFORE}",
        ["same", "far", "empty"],
    ),
    _long(
        f"SELECT CASE WHEN value > 20 THEN {FIVE} ELSE value END AS same, {FIVE} + 1 AS far, "
        f"CAST(NULL AS DOUBLE) AS empty FROM events WHERE {AFTER}",
        ["same", "far", "empty"],
    ),
)
PSI_DAILY = f"""
WITH e AS ({_edges(OLD_VALUES)}),
b AS (SELECT bin, baseline FROM ({_counts("FROM e", OLD_VALUES, NEW_VALUES)}) WHERE bin >= 0),
x AS (SELECT CAST(ts AS DATE) AS day, value, edges FROM events, e WHERE {AFTER}),
n AS (SELECT day, least(len(list_filter(edges, lambda q: q <= value)), len(edges) - 1) - 1 AS bin,
    count(*) AS n FROM x WHERE value >= edges[1] AND value <= edges[len(edges)] GROUP BY ALL),
g AS (SELECT d.day, b.bin, baseline, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT day FROM x) d
    CROSS JOIN (SELECT i AS bin, coalesce(baseline, 0) AS baseline FROM (
      SELECT unnest(range(0, len(edges) - 1)) AS i FROM e) LEFT JOIN b ON i = b.bin) b
    LEFT JOIN n ON n.day = d.day AND n.bin = b.bin),
s AS (SELECT day, baseline / sum(baseline) OVER (PARTITION BY day) + 1e-6 AS b,
    n / greatest(sum(n) OVER (PARTITION BY day), 1) + 1e-6 AS c FROM g),
p AS (SELECT day, sum((c - b) * ln(c / b)) AS psi, count(*) AS bins FROM s GROUP BY day)
SELECT day, 'value' AS feature, round(psi, 6) AS statistic, CAST(0.25 AS DOUBLE) AS threshold,
  psi >= 0.25 AS drifted, 'psi' AS method, CAST(bins AS INTEGER) AS bins FROM p
"""

def _windowed_psi(windows: str, label: str) -> str:
    """PSI of ``events`` after the split in each of ``windows`` (start, till)."""
    return f"""
WITH e AS ({_edges(OLD_VALUES)}),
b AS (SELECT bin, baseline FROM ({_counts("FROM e", OLD_VALUES, NEW_VALUES)}) WHERE bin >= 0),
w AS ({windows}),
x AS (SELECT w.start, w.till, value, edges FROM w JOIN events ON ts >= w.start AND ts < w.till, e WHERE {AFTER}),
n AS (SELECT start, least(len(list_filter(edges, lambda q: q <= value)), len(edges) - 1) - 1 AS bin,
    count(*) AS n FROM x WHERE value >= edges[1] AND value <= edges[len(edges)] GROUP BY ALL),
g AS (SELECT d.start, d.till, b.bin, baseline, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT start, till FROM x) d
    CROSS JOIN (SELECT i AS bin, coalesce(baseline, 0) AS baseline FROM (
      SELECT unnest(range(0, len(edges) - 1)) AS i FROM e) LEFT JOIN b ON i = b.bin) b
    LEFT JOIN n ON n.start = d.start AND n.bin = b.bin),
s AS (SELECT start, till, baseline / sum(baseline) OVER (PARTITION BY start) + 1e-6 AS b,
    n / greatest(sum(n) OVER (PARTITION BY start), 1) + 1e-6 AS c FROM g),
p AS (SELECT start, till, sum((c - b) * ln(c / b)) AS psi, count(*) AS bins FROM s GROUP BY start, till)
SELECT {label}, 'value' AS feature, round(psi, 6) AS statistic, CAST(0.25 AS DOUBLE) AS threshold,
  psi >= 0.25 AS drifted, 'psi' AS method, CAST(bins AS INTEGER) AS bins FROM p
"""


# Windows of seven days that start every day, as far as they hold a row.
SEVEN_DAYS = f"""SELECT CAST(unnest(generate_series(min(CAST(ts AS DATE)) - INTERVAL 6 DAY,
  max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS TIMESTAMP) AS start, start + INTERVAL 7 DAY AS till
  FROM events WHERE {AFTER}"""
PSI_SLIDING = _windowed_psi(SEVEN_DAYS, "start AS window_start, till AS window_end")

CATEGORY_COUNTS = f"""
SELECT 'event_type' AS feature, event_type AS category, count(*) FILTER ({BEFORE}) AS baseline,
  count(*) FILTER ({AFTER}) AS current FROM events GROUP BY event_type
"""


def _chi_square(source: str, column: str, before: str, tail: str) -> str:
    """``tail`` is the closed form of the p-value for an even number of degrees."""
    return f"""
    WITH c AS (SELECT {column} AS cat, CAST(count(*) FILTER ({before}) AS DOUBLE) AS b,
      CAST(count(*) FILTER (NOT ({before})) AS DOUBLE) AS u FROM {source} GROUP BY 1),
    t AS (SELECT *, (b + u) * sum(b) OVER () / sum(b + u) OVER () AS eb,
      (b + u) * sum(u) OVER () / sum(b + u) OVER () AS eu FROM c),
    s AS (SELECT sum((b - eb) ** 2 / greatest(eb, 1e-9) + (u - eu) ** 2 / greatest(eu, 1e-9)) AS x,
      least(min(eb), min(eu)) < 5 AS low_counts FROM t)
    SELECT '{column}' AS feature, round({tail}, 6) AS statistic, CAST(0.05 AS DOUBLE) AS threshold,
      {tail} < 0.05 AS drifted, 'chi_square' AS method, low_counts FROM s"""


OLD_LINES = "SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'"
NEW_LINES = "SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'"
NUMERIC = ["l_quantity", "l_extendedprice"]
REPORT = "feature, method, statistic, threshold, drifted"
DRIFT_REPORT = f"""
SELECT {REPORT} FROM ({_psi(NUMERIC, _long(OLD_LINES, NUMERIC), _long(NEW_LINES, NUMERIC))})
UNION ALL SELECT {REPORT} FROM ({_chi_square(
    "lineitem", "l_returnflag", "l_shipdate < TIMESTAMP '1998-01-01'", "exp(-x / 2)")})
"""

# ---- registry rules --------------------------------------------------------

LATEST_VERSION = """
SELECT concat('grp_', o_custkey) AS name, max(o_orderkey) AS version,
  arg_max(o_orderpriority, o_orderkey) AS entity, CAST(1 AS INTEGER) AS n_features,
  max(o_orderkey) % 7 * 3600 AS ttl_seconds
FROM orders GROUP BY o_custkey
"""
ACTIVE_DEPLOYMENTS = """
SELECT o_orderkey AS id, concat('m_', o_custkey) AS model_name,
  CAST(o_orderkey % 50 AS INTEGER) AS model_version,
  CASE o_orderstatus WHEN 'F' THEN 'production' WHEN 'O' THEN 'canary' ELSE 'shadow' END AS mode,
  CAST(o_orderkey % 101 AS INTEGER) AS traffic_pct, o_orderdate AS created_at
FROM (SELECT *, row_number() OVER (
    PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) AS rn FROM orders)
WHERE o_orderstatus <> 'F' OR rn = 1
"""
SCHEMA_DIFF = f"""
WITH f AS (
  SELECT ({AFTER}) AS later, concat('user_', user_id) AS name, event_type AS feature,
    CASE WHEN max(value) < 60 THEN 'int64' ELSE 'float64' END AS dtype
  FROM events GROUP BY 1, 2, 3),
o AS (SELECT * FROM f WHERE NOT later), n AS (SELECT * FROM f WHERE later),
j AS (SELECT coalesce(o.name, n.name) AS name, coalesce(o.feature, n.feature) AS feature,
    o.dtype AS old_dtype, n.dtype AS new_dtype
  FROM o FULL JOIN n ON o.name = n.name AND o.feature = n.feature)
SELECT name, feature, CASE WHEN new_dtype IS NULL THEN 'removed' WHEN old_dtype IS NULL
    THEN 'added' ELSE 'retyped' END AS change, old_dtype, new_dtype
FROM j WHERE old_dtype IS DISTINCT FROM new_dtype
  AND name IN (SELECT name FROM o) AND name IN (SELECT name FROM n)
"""
LINEAGE = """
WITH m AS (SELECT concat('model_', c_nationkey) AS model_name, max(c_custkey) AS model_version
    FROM customer GROUP BY c_nationkey),
need AS (SELECT DISTINCT concat('model_', c_nationkey) AS model_name,
    c_mktsegment AS feature_group FROM customer),
g AS (SELECT c_mktsegment AS feature_group, max(c_custkey) AS group_version,
    arg_max(c_nationkey, c_custkey) AS nation
  FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1),
f AS (SELECT feature_group, group_version, 'acctbal' AS feature FROM g UNION ALL
  SELECT feature_group, group_version, concat('nation_', nation) FROM g)
SELECT m.model_name, m.model_version, need.feature_group, f.group_version, f.feature
FROM m JOIN need USING (model_name) LEFT JOIN f USING (feature_group)
"""

# ---- routing and scoring ---------------------------------------------------

# The digest's big-endian value modulo 100, folded eight hex digits at a time.
_HASH = "sha256(concat(event_type, ':u_', user_id))"
_CHUNKS = ", ".join(
    f"CAST(concat('0x', substr({_HASH}, {i}, 8)) AS BIGINT)" for i in range(1, 65, 8)
)
BUCKETS = f"""
SELECT *, CAST(list_reduce([0::BIGINT, {_CHUNKS}],
  lambda r, c: (r * 4294967296 + c) % 100) AS INTEGER) AS bucket FROM events
"""


def _routes(version: str) -> str:
    return f"""
    WITH d0 AS (SELECT event_type AS model, day(ts) AS d, min(event_id) AS id, min(ts) AS since
        FROM events WHERE event_type <> 'signup' GROUP BY 1, 2),
    d1 AS (SELECT *, CAST({version} AS INTEGER) AS version, d * 7 % 100 AS pct,
        CASE WHEN model = 'view' THEN 'shadow' WHEN d % 4 = 1 THEN 'canary'
          WHEN d % 4 = 2 THEN 'shadow' ELSE 'production' END AS mode FROM d0),
    d2 AS (SELECT *, CASE WHEN mode = 'production' THEN lead(since) OVER (
        PARTITION BY model, mode ORDER BY since, id) END AS until FROM d1),
    act AS (SELECT e.event_id, d2.* FROM events e JOIN d2 ON e.event_type = d2.model
        AND d2.since <= e.ts AND (d2.until IS NULL OR e.ts < d2.until)),
    b AS ({BUCKETS}),
    ranked AS (SELECT a.event_id, a.version, a.mode, row_number() OVER (PARTITION BY a.event_id
        ORDER BY CASE WHEN a.mode = 'canary' AND b.bucket < a.pct THEN 0
          WHEN a.mode = 'production' THEN 1 ELSE 2 END, a.id) AS rn
      FROM act a JOIN b USING (event_id) WHERE a.mode <> 'shadow'),
    shadows AS (SELECT event_id, string_agg(version, ',' ORDER BY id) AS shadows FROM (
        SELECT event_id, version, min(id) AS id FROM act WHERE mode = 'shadow' GROUP BY 1, 2)
      GROUP BY event_id),
    routed AS (SELECT b.event_id, b.event_type AS model_name, b.user_id, b.bucket,
        r.version AS model_version, r.mode, coalesce(s.shadows, '') AS shadows,
        CASE WHEN r.version IS NOT NULL THEN NULL WHEN EXISTS (
            SELECT 1 FROM act WHERE act.event_id = b.event_id)
          THEN 'no servable deployment' ELSE 'no active deployment' END AS route_error
      FROM b LEFT JOIN ranked r ON r.event_id = b.event_id AND r.rn = 1
      LEFT JOIN shadows s ON s.event_id = b.event_id)"""


ROUTES = f"""{_routes("d")}
SELECT event_id, bucket, model_version, mode, shadows, route_error FROM routed
"""
COHORTS = f"""{_routes("d")}
SELECT model_name, model_version, entities, requests,
  round(requests / sum(requests) OVER (PARTITION BY model_name), 6) AS request_share,
  round(entities / sum(entities) OVER (PARTITION BY model_name), 6) AS entity_share
FROM (SELECT model_name, model_version, count(DISTINCT user_id) AS entities, count(*) AS requests
  FROM routed WHERE model_version IS NOT NULL GROUP BY 1, 2)
"""
PREDICT_COUNTS = f"""{_routes("d")}
SELECT model_name, mode, count(*) AS predictions FROM routed WHERE mode IS NOT NULL GROUP BY 1, 2
"""


def _latency(seconds: str, buckets: tuple[float, ...]) -> str:
    bounds = ", ".join(map(str, buckets))
    return f"""
    SELECT event_type AS model_name, le,
      CAST(count(*) FILTER (le IS NULL OR {seconds} <= le) AS BIGINT) AS count,
      count(*) AS total_count, round(sum({seconds}), 6) AS total_seconds
    FROM events CROSS JOIN (SELECT unnest([{bounds}, NULL]::DOUBLE[]) AS le)
    GROUP BY event_type, le"""


# Weights, limits and the failing shadow are those of the catalog's predictors.
SCORED = f"""{_routes("d % 4 + 1")},
v AS ({_fold(WRITES)}),
x AS (SELECT r.*, coalesce(v.click, 0.0) AS f0, coalesce(v.error, 0.0) AS f1,
    coalesce(v.view, 0.0) AS f2 FROM routed r LEFT JOIN v USING (user_id)),
y AS (SELECT *, model_name IN ('click', 'purchase') AS loaded FROM x),
scored AS (SELECT *, CASE WHEN NOT loaded THEN NULL
    WHEN model_version = 1 THEN CASE WHEN 1.0 + f0 + f1 * 0.5 + f2 * 0.25 > 40 THEN 1.0 ELSE 0.0 END
    WHEN model_version = 2 THEN CASE WHEN 1.0 + f0 * 0.5 + f1 + f2 * 0.25 > 40 THEN 1.0 ELSE 0.0 END
    WHEN model_version = 4 THEN -1.0 + f0 * 0.1 + f1 * 0.2 + f2 * 0.3 END AS prediction,
  CASE WHEN loaded AND shadows = '3' AND f0 > 20
    THEN CASE WHEN 1.0 + f0 * 0.25 + f1 * 0.5 + f2 > 40 THEN 1.0 ELSE 0.0 END END AS shadow_v3
  FROM y)
"""
BATCH_SCORE = f"""{SCORED}
SELECT event_id, model_version, round(CAST(prediction AS DOUBLE), 6) AS prediction,
  CAST(shadow_v3 AS DOUBLE) AS shadow_v3,
  CASE WHEN model_version IS NOT NULL AND NOT loaded THEN 'model version not loaded' END
    AS score_error
FROM scored
"""
# The stored pipelines are fitted to these lines exactly.
def _line(version: int) -> str:
    a, b, c = STORED[version]
    return f"round({c} + f0 * {a} + f2 * {b}, 4)"


PIPELINE_SCORE = f"""{SCORED}
SELECT event_id, model_version,
  CAST(CASE WHEN model_name = 'click' THEN CASE model_version WHEN 1 THEN {_line(1)} WHEN 2 THEN {_line(2)}
    WHEN 3 THEN {_line(3)} END END AS DOUBLE) AS prediction,
  CAST(CASE WHEN model_name = 'click' AND shadows = '3' THEN {_line(3)} END AS DOUBLE) AS shadow_v3,
  CASE WHEN model_version IS NOT NULL AND NOT (model_name = 'click' AND model_version IN (1, 2, 3))
    THEN 'model version not loaded' END AS score_error,
  CAST(CASE WHEN model_name = 'click' AND model_version IN (1, 2, 3) THEN 1.0 END AS DOUBLE) AS r2
FROM scored
"""
SHADOW_AGREEMENT = f"""{SCORED}
SELECT model_name, CAST(shadows AS INTEGER) AS shadow_version, count(*) AS requests,
  count(*) FILTER (shadow_v3 IS NULL) AS failures,
  round(avg(CASE WHEN shadow_v3 IS NOT NULL THEN
    CASE WHEN prediction = shadow_v3 THEN 1.0 ELSE 0.0 END END), 6) AS agreement,
  round(avg(CASE WHEN shadow_v3 IS NOT NULL
    THEN CAST(abs(prediction - shadow_v3) AS DOUBLE) END), 6) AS mean_abs_diff
FROM scored WHERE prediction IS NOT NULL AND shadows <> '' GROUP BY 1, 2
"""
# The newest click and view at or before each request, if younger than a day.
AT_REQUEST = """
SELECT e.event_id, c.value AS click, epoch_us(e.ts) - epoch_us(c.ts) AS click_us,
  v.value AS view, epoch_us(e.ts) - epoch_us(v.ts) AS view_us
FROM events e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c
  ON e.user_id = c.user_id AND e.ts >= c.ts
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
  ON e.user_id = v.user_id AND e.ts >= v.ts
"""
DAY_US = 86_400_000_000
REQUEST_AGE = f"""
SELECT event_id, CASE WHEN click_us < {DAY_US} THEN round(click_us / 1e6, 6) END AS click_age,
  CASE WHEN view_us < {DAY_US} THEN round(view_us / 1e6, 6) END AS view_age
FROM ({AT_REQUEST})
"""
REQUEST_SCORE = f"""{_routes("d % 4 + 1")},
f AS (SELECT event_id, CASE WHEN click_us < {DAY_US} THEN click ELSE 0.0 END AS click,
    CASE WHEN view_us < {DAY_US} THEN view ELSE 0.0 END AS view FROM ({AT_REQUEST})),
y AS (SELECT r.*, click, view,
    model_name IN ('click', 'purchase') AND model_version IN (1, 2) AS listed
  FROM routed r JOIN f USING (event_id))
SELECT event_id, model_version,
  round(CASE WHEN listed AND model_version = 1 THEN 1.0 + 2.0 * click
    WHEN listed THEN -1.0 + 0.5 * click + 0.25 * view END, 6) AS prediction,
  CASE WHEN model_version IS NOT NULL AND NOT listed THEN 'model not found' END AS score_error
FROM y
"""
FEATURE_VECTOR = f"""
SELECT i.user_id, coalesce(v.click, 0.0) AS x0, CAST(coalesce(v.last_k, 0) AS DOUBLE) AS x1,
  CASE WHEN v.is_big THEN 1.0::DOUBLE ELSE 0.0 END AS x2, coalesce(v.purchase, 0.0) AS x3
FROM (SELECT c_custkey AS user_id FROM customer) i LEFT JOIN ({LATEST_TTL}) v USING (user_id)
"""

# ---- feeders ---------------------------------------------------------------

ROLLING = """
WITH days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
j AS (SELECT d.user_id, d.day, e.* EXCLUDE (user_id), CAST(e.ts AS DATE) AS e_day
  FROM days d JOIN events e ON d.user_id = e.user_id AND CAST(e.ts AS DATE) <= d.day)
SELECT user_id, day,
  CAST(count(*) FILTER (event_type = 'view' AND e_day > day - 7) AS BIGINT) AS login_count,
  round(coalesce(avg(value) FILTER (event_type = 'click' AND e_day > day - 7), 0.0), 6)
    AS avg_session_seconds,
  CAST(coalesce(day - max(e_day) FILTER (event_type = 'view'), 999) AS BIGINT)
    AS days_since_last_login,
  CAST(count(DISTINCT event_type) FILTER (e_day > day - 7) AS BIGINT) AS num_features_used
FROM j GROUP BY user_id, day
"""


def _uniform(stream: str) -> str:
    digest = f"md5(concat(c_custkey, '|42|{stream}'))"
    return f"(CAST(concat('0x', substr({digest}, 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def _poisson(stream: str, mean: float) -> str:
    """Count the distribution steps not above the uniform value, by definition."""
    terms = f"[exp(-{mean}::DOUBLE) * {mean}::DOUBLE ** k / factorial(CAST(k AS INTEGER)) FOR k IN range(0, 21)]"
    return f"""len(list_filter(range(1, 22), lambda n:
      list_sum(list_slice({terms}, 1, n)) <= {_uniform(stream)}))"""


SYNTH = f"""
WITH u AS (SELECT DISTINCT c_custkey, CAST({_poisson("visits", 4.0)} AS BIGINT) AS visits,
    -25.0::DOUBLE * ln(1.0 - {_uniform("minutes")}) AS minutes,
    CAST(floor({_uniform("idle_days")} * 60) AS BIGINT) AS idle_days,
    TIMESTAMP '{AS_OF}' - to_seconds(floor({_uniform("time")} * 86400)) AS _event_ts,
    0.8 * sqrt(-2.0 * ln(1.0 - {_uniform("noise_r")}))
      * cos(2.0 * pi() * {_uniform("noise_a")}) AS noise
  FROM customer)
SELECT c_custkey, visits, round(minutes, 4) AS minutes, idle_days, _event_ts,
  CAST(noise - 0.7 * visits - 0.02 * minutes + 0.08 * idle_days > 0 AS INTEGER) AS leaves
FROM u
"""

# Every quantile of a sketch has the rank it should have, within the stated error.
SKETCH_EDGES = f"""
SELECT feature, count(*) AS n, CAST(unnest(range(0, 11)) AS INTEGER) AS pos, true AS near
FROM ({_long("SELECT * FROM lineitem", LINE_COLUMNS)}) GROUP BY feature
"""
LATENCY_QUANTILES = """
SELECT event_type AS model_name, count(value) AS n, unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.99::DOUBLE]) AS probability, true AS near
FROM events GROUP BY event_type
"""

EVENT_LOG = "user_id, ts AS _event_ts, event_id, event_type, value"

ORACLE = {
    "pit_join": _asof(["click"]),
    "pit_join_multi": _asof(["click", "error", "view"]),
    "pit_join_ties": PIT_TIES,
    "pit_join_skew": _asof(["click"]),
    "pit_join_keys": PIT_KEYS,
    "training_from_store": _asof(["click"]),
    "offline_roundtrip": f"SELECT {EVENT_LOG} FROM events",
    "evolved_scan": f"""SELECT {EVENT_LOG}, CASE WHEN {AFTER} THEN {K} END AS k FROM events""",
    "compacted_scan": f"SELECT {EVENT_LOG} FROM events",
    "dedup_features": f"SELECT DISTINCT {EVENT_LOG} FROM events",
    "replay_fewer_dates": f"SELECT {EVENT_LOG} FROM events WHERE {AFTER}",
    "evolution_checked": f"SELECT {EVENT_LOG}, 2 AS refused FROM events",
    "missing_columns": "SELECT count(*) AS rows, 'event_log: missing columns [''_event_ts'', ''value'']' AS refused FROM events",
    "latest_view": _fold(ISLANDS),
    "latest_event_time": _fold(LATE, "ts, event_id"),
    "latest_ttl": LATEST_TTL,
    "online_lookup": LOOKUP,
    "partial_lookup": PARTIAL_LOOKUP,
    "model_features": MODEL_FEATURES,
    "feature_age": FEATURE_AGE,
    "kv_export": _kv_export(),
    "kv_changes": _kv_export(),
    "kv_decode": KV_DECODE,
    "transform_dead_letter": DEAD_LETTER,
    "ingest_stats": INGEST_STATS,
    "stream_ingest": STREAM_INGEST,
    "stream_latest": STREAM_LATEST,
    "stream_latest_multi": STREAM_LATEST,
    "stateful_latest": LATEST_TTL,
    "bounded_batches": BOUNDED_BATCHES,
    "stream_stats": INGEST_STATS,
    "quantile_edges": QUANTILES,
    "sketch_edges": SKETCH_EDGES,
    "histogram": HISTOGRAM,
    "psi": _psi(["value"], OLD_VALUES, NEW_VALUES),
    "psi_shifted": _psi(
        ["value"],
        OLD_VALUES,
        _long(f"SELECT value * 3 AS value FROM events WHERE {AFTER}", ["value"]),
    ),
    "psi_degenerate": PSI_DEGENERATE,
    "psi_daily": PSI_DAILY,
    "psi_sliding": PSI_SLIDING,
    "category_counts": CATEGORY_COUNTS,
    "chi_square": _chi_square("events", "event_type", BEFORE, "exp(-x / 2) * (1 + x / 2)"),
    "drift_report": DRIFT_REPORT,
    "latest_version": LATEST_VERSION,
    "active_deployments": ACTIVE_DEPLOYMENTS,
    "schema_diff": SCHEMA_DIFF,
    "lineage": LINEAGE,
    "canary_bucket": f"SELECT event_id, bucket FROM ({BUCKETS})",
    "route_requests": ROUTES,
    "route_large_log": ROUTES,
    "cohort_split": COHORTS,
    "predict_counts": PREDICT_COUNTS,
    "latency_histogram": _latency("value / 500", PREDICT_BUCKETS),
    "latency_quantiles": LATENCY_QUANTILES,
    "fetch_histogram": _latency("value / 2000", FEATURE_FETCH_BUCKETS),
    "batch_score": BATCH_SCORE,
    "pipeline_score": PIPELINE_SCORE,
    "shadow_agreement": SHADOW_AGREEMENT,
    "request_score": REQUEST_SCORE,
    "request_age": REQUEST_AGE,
    "feature_vector": FEATURE_VECTOR,
    "rolling_features": ROLLING,
    "synth_features": SYNTH,
    "train_eval": """SELECT count(*) AS rows, count(*) FILTER (value > 20) AS positives,
      CAST(50 AS INTEGER) AS trees, true AS beats_majority FROM events WHERE event_type = 'purchase'""",
}
