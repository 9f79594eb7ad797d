"""DuckDB statements for the catalog, written from the definitions rather than from the plans."""

from __future__ import annotations

LOADS = """
li AS (
  SELECT l_orderkey, MIN(l_suppkey) AS suppkey, MIN(l_partkey) AS partkey,
         SUM(l_quantity) AS qty, MIN(l_discount) + 0.0 AS disc
  FROM lineitem GROUP BY l_orderkey),
j AS (
  SELECT o.o_orderkey AS k, CAST(o.o_orderdate AS DATE) AS d, o.o_totalprice AS tp,
         sn.n_name AS pickup, cn.n_name AS delivery,
         sn.n_nationkey AS pn, cn.n_nationkey AS dn, p.p_size AS psize, li.qty AS qty, li.disc AS disc
  FROM orders o JOIN li ON li.l_orderkey = o.o_orderkey
  JOIN supplier s ON s.s_suppkey = li.suppkey JOIN nation sn ON sn.n_nationkey = s.s_nationkey
  JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation cn ON cn.n_nationkey = c.c_nationkey
  JOIN part p ON p.p_partkey = li.partkey),
b AS (
  SELECT *, CAST(50 + 10 * ((k * 37) % 251) AS DOUBLE) AS distance, psize % 3 AS eq,
         CASE WHEN k % 131 = 0 THEN NULL ELSE CAST(90 + (k * 13) % 21 AS DOUBLE) END AS market_index
  FROM j),
all_loads AS (
  SELECT CONCAT('LD-', LPAD(CAST(k AS VARCHAR), 8, '0')) AS load_id,
    CASE WHEN k % 211 = 0 THEN NULL ELSE pickup END AS pickup, delivery,
    CAST(25 + pn AS DOUBLE) AS pickup_lat, CAST(-120 + 2 * pn AS DOUBLE) AS pickup_lon,
    CAST(25 + dn AS DOUBLE) AS delivery_lat, CAST(-120 + 2 * dn AS DOUBLE) AS delivery_lon,
    distance,
    CASE eq WHEN 0 THEN 'Dry Van' WHEN 1 THEN 'Flatbed' ELSE 'Reefer' END AS equipment,
    CASE WHEN k % 160 = 0 THEN -150 * qty WHEN k % 161 = 0 THEN NULL ELSE 150 * qty END AS weight,
    d AS date, market_index, disc AS quote_signal,
    distance * (CAST(1.6 AS DOUBLE) + CAST(0.2 AS DOUBLE) * eq + tp / CAST(250000 AS DOUBLE))
      * (CASE WHEN k % 97 = 0 THEN 4 ELSE 1 END) AS posted_rate
  FROM b),
labelled AS (SELECT * FROM all_loads WHERE date < DATE '2001-01-01'),
holdout AS (SELECT * EXCLUDE (posted_rate) FROM all_loads WHERE date >= DATE '2001-01-01'),
clean AS (
  SELECT * REPLACE (CASE WHEN weight < 0 THEN NULL ELSE weight END AS weight),
    posted_rate / distance AS posted_rate_per_mile,
    LN(posted_rate / distance) AS log_posted_rate_per_mile,
    COALESCE(pickup, 'nan') || ' -> ' || COALESCE(delivery, 'nan') AS route
  FROM labelled),
train AS (SELECT * FROM clean WHERE date < DATE '2000-01-01'),
validation AS (SELECT * FROM clean WHERE date >= DATE '2000-01-01' AND date < DATE '2001-01-01')
"""

MODEL = """,
model AS (SELECT equipment, AVG(log_posted_rate_per_mile) AS m FROM train GROUP BY equipment),
fitted AS (
  SELECT c.*, CASE WHEN c.date < DATE '2000-01-01' THEN 'train' ELSE 'validation' END AS split,
    c.posted_rate AS actual_rate, EXP(m.m) * c.distance AS predicted_rate,
    c.posted_rate_per_mile AS actual_rate_per_mile, EXP(m.m) AS predicted_rate_per_mile,
    c.log_posted_rate_per_mile AS actual_log_rate_per_mile, m.m AS predicted_log_rate_per_mile
  FROM clean c JOIN model m ON m.equipment = c.equipment),
scored AS (
  SELECT *, predicted_rate - actual_rate AS error, ABS(predicted_rate - actual_rate) AS absolute_error,
    POWER(predicted_rate - actual_rate, 2) AS squared_error,
    ABS(predicted_rate - actual_rate) / ABS(actual_rate) * 100 AS absolute_percentage_error,
    actual_rate_per_mile - predicted_rate_per_mile AS rpm_residual,
    ABS(actual_rate - predicted_rate) AS absolute_rate_error
  FROM fitted WHERE split = 'validation')
"""

FINAL = """,
final_model AS (SELECT equipment, AVG(log_posted_rate_per_mile) AS m FROM clean GROUP BY equipment),
submission AS (
  SELECT h.load_id, EXP(f.m) * h.distance AS predicted_rate
  FROM holdout h JOIN final_model f ON f.equipment = h.equipment)
"""

FOLDS = """,
folds AS (
  SELECT * FROM (VALUES
    ('fold_1', DATE '1995-01-01', DATE '1998-01-01', DATE '1998-01-01', DATE '1999-01-01'),
    ('fold_2', DATE '1995-01-01', DATE '1998-07-01', DATE '1998-07-01', DATE '1999-07-01'),
    ('fold_3', DATE '1995-01-01', DATE '2000-01-01', DATE '2000-01-01', DATE '2001-01-01'))
    AS t(fold, a, b, c, d)),
assigned AS (
  SELECT f.fold, 'train' AS role, x.* FROM clean x JOIN folds f ON x.date >= f.a AND x.date < f.b
  UNION ALL
  SELECT f.fold, 'validation' AS role, x.* FROM clean x JOIN folds f ON x.date >= f.c AND x.date < f.d),
fold_model AS (
  SELECT fold, equipment, AVG(log_posted_rate_per_mile) AS m FROM assigned WHERE role = 'train'
  GROUP BY fold, equipment),
fold_rows AS (
  SELECT a.fold, a.role, a.load_id, a.posted_rate AS actual_rate, EXP(m.m) * a.distance AS predicted_rate,
    a.posted_rate_per_mile AS actual_rate_per_mile, EXP(m.m) AS predicted_rate_per_mile
  FROM assigned a JOIN fold_model m ON m.fold = a.fold AND m.equipment = a.equipment),
fold_role AS (
  SELECT fold, role, COUNT(*) AS n, AVG(ABS(predicted_rate - actual_rate)) AS mae,
    SQRT(AVG(POWER(predicted_rate - actual_rate, 2))) AS rmse,
    1 - SUM(POWER(predicted_rate - actual_rate, 2)) / REGR_SXX(actual_rate, actual_rate) AS r2
  FROM fold_rows GROUP BY fold, role),
fold_metrics AS (
  SELECT t.fold, t.n AS train_rows, t.mae AS train_mae, t.rmse AS train_rmse, t.r2 AS train_r2,
    v.n AS validation_rows, v.mae AS validation_mae, v.rmse AS validation_rmse, v.r2 AS validation_r2,
    v.mae - t.mae AS mae_gap, v.rmse - t.rmse AS rmse_gap, t.r2 - v.r2 AS r2_gap
  FROM fold_role t JOIN fold_role v ON t.fold = v.fold AND t.role = 'train' AND v.role = 'validation')
"""

SCENARIO = """,
scenario AS (
  SELECT 'CANADA' AS pickup, 'BRAZIL' AS delivery, CAST(360 AS DOUBLE) AS distance, 'Dry Van' AS equipment,
    CAST(32000 AS DOUBLE) AS weight, CAST(u.day AS DATE) AS date,
    (SELECT EXP(m) FROM final_model WHERE equipment = 'Dry Van') * 360 AS predicted_rate
  FROM UNNEST(GENERATE_SERIES(DATE '2001-12-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS u(day))
"""

NUMERIC = "pickup_lat pickup_lon delivery_lat delivery_lon distance weight market_index quote_signal".split()
CATEGORICAL = "pickup delivery equipment".split()


def _with(body: str, *blocks: str) -> str:
    return f"WITH {LOADS}{''.join(blocks)}\n{body}"


def _rules(counters: list[tuple[str, str]], source: str) -> str:
    """(position, rule, violations, passed) from one counter expression per rule."""
    parts = [
        f"SELECT CAST({i} AS INTEGER) AS position, '{rule}' AS rule, CAST(COALESCE(({expr}), 0) AS BIGINT) AS violations {source}"
        for i, (rule, expr) in enumerate(counters, 1)
    ]
    return "SELECT *, violations = 0 AS passed FROM (" + " UNION ALL ".join(parts) + ")"


ERROR_STATS = """COUNT(*) AS rows, ROUND(AVG(absolute_error), 6) AS mae, ROUND(SQRT(AVG(squared_error)), 6) AS rmse,
  ROUND(AVG(error), 6) AS mean_error, ROUND(AVG(actual_rate), 6) AS actual_rate_mean,
  ROUND(AVG(predicted_rate), 6) AS predicted_rate_mean, ROUND(MEDIAN(error), 6) AS median_error"""

RESIDUAL_STATS = """COUNT(*) AS rows, ROUND(AVG(actual_rate_per_mile), 6) AS actual_rpm,
  ROUND(AVG(predicted_rate_per_mile), 6) AS predicted_rpm, ROUND(AVG(rpm_residual), 6) AS rpm_residual,
  ROUND(AVG(absolute_rate_error), 6) AS mae"""

METRICS = """COUNT(*) AS rows, ROUND(AVG(ABS(predicted_rate - actual_rate)), 6) AS mae,
  ROUND(SQRT(AVG(POWER(predicted_rate - actual_rate, 2))), 6) AS rmse,
  ROUND(1 - SUM(POWER(predicted_rate - actual_rate, 2)) / REGR_SXX(actual_rate, actual_rate), 6) AS r2"""


def _bins(column: str, bins: list[tuple[str, str, str]], source: str = "scored") -> str:
    """Every bin is listed; rows outside all bins form one more line when there are any."""
    values = ", ".join(f"({i}, '{name}', {lo}, {hi})" for i, (name, lo, hi) in enumerate(bins))
    return f""", dim AS (
  SELECT CAST(i AS INTEGER) AS bin, label, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi
  FROM (VALUES {values}) AS t(i, label, lo, hi)),
placed AS (SELECT s.*, d.bin FROM {source} s LEFT JOIN dim d ON s.{column} > d.lo AND s.{column} <= d.hi),
stats AS (SELECT bin, {ERROR_STATS} FROM placed GROUP BY bin)
SELECT COALESCE(d.bin, s.bin) AS bin, d.label, COALESCE(s.rows, 0) AS rows, s.* EXCLUDE (bin, rows)
FROM dim d FULL JOIN stats s ON d.bin = s.bin"""


INF = "'infinity'"
DISTANCE = [
    ("<=250", "'0'", "'250'"),
    ("251-500", "'250'", "'500'"),
    ("501-750", "'500'", "'750'"),
    ("751-1000", "'750'", "'1000'"),
    ("1001-1500", "'1000'", "'1500'"),
    ("1501-2000", "'1500'", "'2000'"),
    (">2000", "'2000'", INF),
]
RATE = [
    ("<1000", "'0'", "'1000'"),
    ("1000-1500", "'1000'", "'1500'"),
    ("1500-2000", "'1500'", "'2000'"),
    ("2000-2500", "'2000'", "'2500'"),
    ("2500-3000", "'2500'", "'3000'"),
    ("3000-4000", "'3000'", "'4000'"),
    ("4000-6000", "'4000'", "'6000'"),
    ("6000-10000", "'6000'", "'10000'"),
    (">10000", "'10000'", INF),
]
WEIGHT = [
    ("<=10k", "'-infinity'", "'10000'"),
    ("10k-20k", "'10000'", "'20000'"),
    ("20k-30k", "'20000'", "'30000'"),
    ("30k-40k", "'30000'", "'40000'"),
    ("40k-50k", "'40000'", "'50000'"),
    (">50k", "'50000'", INF),
]


def _quantile_profile(column: str) -> str:
    return f""", q AS (
  SELECT LIST_SORT(LIST_DISTINCT(QUANTILE_CONT({column}, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM scored),
placed AS (
  SELECT s.*, CAST(GREATEST(1, LEN(LIST_FILTER(q.e, lambda v: v < s.{column}))) AS INTEGER) AS bin, q.e
  FROM scored s, q WHERE s.{column} IS NOT NULL)
SELECT bin, {RESIDUAL_STATS}, ROUND(AVG(actual_rate), 6) AS actual_rate,
  ROUND(ANY_VALUE(e[bin]), 6) AS lower_edge, ROUND(ANY_VALUE(e[bin + 1]), 6) AS upper_edge
FROM placed GROUP BY bin"""


def _expanding(level: str, keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    w = f"OVER ({part} ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"
    out = f"CAST(CAST(AVG(posted_rate_per_mile) {w} AS FLOAT) AS DOUBLE) AS hist_{level}_rpm_mean"
    return out + (f", COUNT(posted_rate_per_mile) {w} AS hist_{level}_rpm_count" if keys else "")


LEVELS = {
    "global": "",
    "route": "pickup, delivery",
    "pickup": "pickup",
    "delivery": "delivery",
    "equipment": "equipment",
}

FROZEN = """, g AS (SELECT AVG(posted_rate_per_mile) AS m FROM train),
r AS (SELECT pickup, delivery, AVG(posted_rate_per_mile) AS m, COUNT(*) AS n FROM train GROUP BY ALL),
p AS (SELECT pickup, AVG(posted_rate_per_mile) AS m, COUNT(*) AS n FROM train GROUP BY ALL),
d AS (SELECT delivery, AVG(posted_rate_per_mile) AS m, COUNT(*) AS n FROM train GROUP BY ALL),
e AS (SELECT equipment, AVG(posted_rate_per_mile) AS m, COUNT(*) AS n FROM train GROUP BY ALL),
frozen AS (
  SELECT v.load_id, CAST(CAST((SELECT m FROM g) AS FLOAT) AS DOUBLE) AS hist_global_rpm_mean,
    CAST(CAST(r.m AS FLOAT) AS DOUBLE) AS hist_route_rpm_mean, COALESCE(r.n, 0) AS hist_route_rpm_count,
    CAST(CAST(p.m AS FLOAT) AS DOUBLE) AS hist_pickup_rpm_mean, COALESCE(p.n, 0) AS hist_pickup_rpm_count,
    CAST(CAST(d.m AS FLOAT) AS DOUBLE) AS hist_delivery_rpm_mean, COALESCE(d.n, 0) AS hist_delivery_rpm_count,
    CAST(CAST(e.m AS FLOAT) AS DOUBLE) AS hist_equipment_rpm_mean, COALESCE(e.n, 0) AS hist_equipment_rpm_count
  FROM validation v
  LEFT JOIN r ON v.pickup IS NOT DISTINCT FROM r.pickup AND v.delivery IS NOT DISTINCT FROM r.delivery
  LEFT JOIN p ON v.pickup IS NOT DISTINCT FROM p.pickup
  LEFT JOIN d ON v.delivery IS NOT DISTINCT FROM d.delivery
  LEFT JOIN e ON v.equipment IS NOT DISTINCT FROM e.equipment)"""

ALL_EXPANDING = ", ".join(_expanding(level, keys) for level, keys in LEVELS.items())


def _describe(target: str) -> str:
    return f"""SELECT split, '{target}' AS target, COUNT({target}) AS count, ROUND(AVG({target}), 5) AS mean,
  ROUND(STDDEV_SAMP({target}), 5) AS std, ROUND(MIN({target}), 5) AS min, ROUND(MAX({target}), 5) AS max,
  ROUND(QUANTILE_CONT({target}, 0.25), 5) AS q25, ROUND(MEDIAN({target}), 5) AS median,
  ROUND(QUANTILE_CONT({target}, 0.75), 5) AS q75 FROM fitted GROUP BY split"""


SCORED_MONEY = "load_id, ROUND(predicted_rate, 4) AS predicted_rate, actual_rate"

CALENDAR = """CAST(MONTH(date) AS INTEGER) AS month, CAST(ISODOW(date) - 1 AS INTEGER) AS day_of_week,
  CAST(DAY(date) AS INTEGER) AS day_of_month, CAST(DAYOFYEAR(date) AS INTEGER) AS day_of_year,
  CAST(date - DATE '1995-01-01' AS INTEGER) AS days_since_start"""

IDS = """, ids AS (
  SELECT k, SUM(a) AS a, SUM(e) AS e FROM (
    SELECT load_id AS k, 1 AS a, 0 AS e FROM {actual} UNION ALL SELECT load_id, 0, 1 FROM {expected})
  GROUP BY k)"""

SUBMISSION_COUNTERS = [
    ("columns_exact", "0"),
    ("row_count", "ABS((SELECT COUNT(*) FROM {actual}) - (SELECT COUNT(*) FROM {expected}))"),
    ("id_missing", "SELECT COUNT(*) FROM {actual} WHERE load_id IS NULL"),
    ("id_duplicate", "SELECT COUNT(*) FROM (SELECT load_id FROM {actual} GROUP BY 1 HAVING COUNT(*) > 1)"),
    ("id_not_delivered", "SELECT COUNT(*) FROM {expected} x ANTI JOIN {actual} y ON x.load_id = y.load_id"),
    ("id_unexpected", "SELECT COUNT(*) FROM {actual} x ANTI JOIN {expected} y ON x.load_id = y.load_id"),
    ("rate_not_numeric", "SELECT COUNT(*) FROM {actual} WHERE predicted_rate IS NULL"),
    ("rate_not_finite", "SELECT COUNT(*) FROM {actual} WHERE NOT ISFINITE(predicted_rate)"),
    ("rate_not_positive", "SELECT COUNT(*) FROM {actual} WHERE predicted_rate <= 0"),
]


def _submission_rules(actual: str, expected: str) -> str:
    return _rules([(r, e.format(actual=actual, expected=expected)) for r, e in SUBMISSION_COUNTERS], "")


def _scenario_rules(source: str) -> str:
    def count(where: str) -> str:
        return f"SELECT COUNT(*) FROM {source} WHERE {where}"

    window = "date BETWEEN DATE '2001-12-01' AND DATE '2001-12-31'"
    return _rules(
        [
            ("columns_exact", "0"),
            ("date_invalid", count("date IS NULL")),
            ("distance_not_numeric", count("distance IS NULL OR NOT ISFINITE(distance)")),
            ("weight_not_numeric", count("weight IS NULL OR NOT ISFINITE(weight)")),
            ("rate_not_numeric", count("predicted_rate IS NULL OR NOT ISFINITE(predicted_rate)")),
            ("date_duplicate", f"SELECT COUNT(date) - COUNT(DISTINCT date) FROM {source}"),
            ("day_missing", f"SELECT 31 - COUNT(DISTINCT date) FROM {source} WHERE {window}"),
            ("day_unexpected", f"SELECT COUNT(DISTINCT date) FROM {source} WHERE NOT ({window})"),
            ("row_count", f"SELECT ABS(COUNT(*) - 31) FROM {source}"),
            ("pickup_wrong", count("pickup IS DISTINCT FROM 'CANADA'")),
            ("delivery_wrong", count("delivery IS DISTINCT FROM 'BRAZIL'")),
            ("distance_wrong", count("distance IS NULL OR NOT ABS(distance - 360) <= 1e-8 + 1e-5 * 360")),
            ("equipment_wrong", count("equipment IS DISTINCT FROM 'Dry Van'")),
            ("weight_wrong", count("weight IS NULL OR NOT ABS(weight - 32000) <= 1e-8 + 1e-5 * 32000")),
            ("rate_not_positive", count("predicted_rate <= 0")),
        ],
        "",
    )


def _count_rules(source: str, counters: list[tuple[str, str]]) -> str:
    return _rules([(r, f"SELECT COUNT(*) FROM {source} WHERE {w}") for r, w in counters], "")


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


VALIDATION_FILLED = ", ".join(
    [f"COALESCE({c}, (SELECT MEDIAN({c}) FROM train)) AS {c}" for c in NUMERIC]
    + [
        f"COALESCE({c}, (SELECT {c} FROM train WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1)) AS {c}"
        for c in CATEGORICAL
    ]
)

CODES = ", codes AS (" + _union(
    [
        f"""SELECT '{c}' AS column_name, {c} AS category, CAST(ROW_NUMBER() OVER (ORDER BY {c}) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT {c} FROM train WHERE {c} IS NOT NULL)"""
        for c in CATEGORICAL
    ]
) + ")"
WIDTHS = ", widths AS (SELECT column_name, CAST(COUNT(*) AS INTEGER) AS width FROM codes GROUP BY column_name)"
FILLED = f", filled AS (SELECT load_id, {VALIDATION_FILLED} FROM validation)"

ORACLE: dict[str, str] = {
    "src_loads": _with("SELECT * FROM all_loads"),
    "src_holdout": _with("SELECT * FROM holdout"),
    "predictions_full": _with(
        f"""SELECT {SCORED_MONEY}, actual_rate_per_mile, ROUND(predicted_rate_per_mile, 8) AS predicted_rate_per_mile,
  ROUND(actual_log_rate_per_mile, 8) AS actual_log_rate_per_mile,
  ROUND(predicted_log_rate_per_mile, 8) AS predicted_log_rate_per_mile FROM scored""",
        MODEL,
    ),
    "submission": _with("SELECT load_id, ROUND(predicted_rate, 4) AS predicted_rate FROM submission", FINAL),
    "feature_matrix": _with(f"SELECT load_id, {', '.join(NUMERIC + CATEGORICAL)} FROM clean"),
    "repair_weight": _with("SELECT load_id, CASE WHEN weight < 0 THEN NULL ELSE weight END AS weight FROM all_loads"),
    "repair_counts": _with(
        """SELECT CASE WHEN date < DATE '2001-01-01' THEN 'labelled' ELSE 'holdout' END AS part, COUNT(*) AS rows,
  COUNT(*) FILTER (weight < 0) AS negative_before, CAST(0 AS BIGINT) AS negative_after,
  COUNT(*) FILTER (weight IS NULL) AS missing_before,
  COUNT(*) FILTER (weight IS NULL OR weight < 0) AS missing_after FROM all_loads GROUP BY 1"""
    ),
    "dq_report": _with(
        _count_rules(
            "labelled",
            [
                ("distance_not_positive", "distance <= 0"),
                ("distance_missing", "distance IS NULL"),
                ("rate_per_mile_not_positive", "posted_rate / NULLIF(distance, 0) <= 0"),
                ("target_missing", "posted_rate IS NULL"),
                ("id_missing", "load_id IS NULL"),
                ("date_missing", "date IS NULL"),
            ],
        )
    ),
    "dq_counters": _with(
        """SELECT COUNT(*) AS rows, MIN(date) AS first_day, MAX(date) AS last_day,
  COUNT(*) FILTER (weight < 0) AS negative_weights, COUNT(*) FILTER (distance <= 0) AS bad_distances,
  COUNT(*) FILTER (posted_rate / NULLIF(distance, 0) <= 0) AS bad_rates_per_mile FROM labelled"""
    ),
    "dq_duplicates": _with(
        "SELECT load_id, COUNT(*) AS copies FROM assigned WHERE role = 'validation' GROUP BY load_id HAVING COUNT(*) > 1",
        FOLDS,
    ),
    "dq_duplicates_loads": _with(
        "SELECT load_id, COUNT(*) AS copies FROM all_loads GROUP BY load_id HAVING COUNT(*) > 1"
    ),
    "dq_predictions": _with(
        _count_rules(
            "scored",
            [
                ("missing", "predicted_rate IS NULL"),
                ("not_finite", "NOT ISFINITE(predicted_rate)"),
                ("not_positive", "predicted_rate <= 0"),
            ],
        ),
        MODEL,
    ),
    "missing_profile": _with(
        _union(
            [
                f"""SELECT COUNT(*) AS rows, '{c}' AS column_name, COUNT(*) - COUNT({c}) AS missing,
  ROUND((COUNT(*) - COUNT({c})) * 100.0::DOUBLE / COUNT(*), 6) AS missing_pct FROM labelled"""
                for c in ["load_id", *CATEGORICAL[:2], *NUMERIC[:5], "equipment", "weight", "date", *NUMERIC[6:], "posted_rate"]
            ]
        )
    ),
    "split_train": _with("SELECT load_id, date, posted_rate FROM train"),
    "split_validation": _with("SELECT load_id, date, posted_rate FROM validation"),
    "split_summary": _with(
        """SELECT 'train' AS split, COUNT(*) AS rows, MIN(date) AS first_day, MAX(date) AS last_day FROM train
UNION ALL SELECT 'validation', COUNT(*), MIN(date), MAX(date) FROM validation"""
    ),
    "scored_join": _with(
        f"""SELECT {SCORED_MONEY}, date, distance, weight, actual_rate_per_mile,
  ROUND(predicted_rate_per_mile, 8) AS predicted_rate_per_mile FROM scored""",
        MODEL,
    ),
    "join_orphans": _with(
        "SELECT load_id, date FROM labelled WHERE load_id NOT IN (SELECT load_id FROM scored)", MODEL
    ),
    "route_coverage": _with(
        """SELECT COUNT(*) AS rows, COUNT(*) FILTER (route IN (SELECT route FROM train)) AS known_rows,
  ROUND(AVG(CASE WHEN route IN (SELECT route FROM train) THEN 100.0::DOUBLE ELSE 0 END), 6) AS known_pct
FROM validation"""
    ),
    "id_reconcile": _with(
        """, expected AS (
  SELECT PRINTF('LD-%08d', n) AS load_id FROM RANGE(1, (SELECT MAX(o_orderkey) + 1 FROM orders)) AS t(n))
SELECT (SELECT COUNT(*) FROM all_loads) AS actual_rows, (SELECT COUNT(*) FROM expected) AS expected_rows,
  CAST(0 AS BIGINT) AS null_ids,
  (SELECT COUNT(*) FROM (SELECT load_id FROM all_loads GROUP BY 1 HAVING COUNT(*) > 1)) AS duplicate_ids,
  CAST(0 AS BIGINT) AS duplicate_expected_ids,
  (SELECT COUNT(*) FROM expected e ANTI JOIN all_loads a ON a.load_id = e.load_id) AS missing_ids,
  (SELECT COUNT(*) FROM all_loads a ANTI JOIN expected e ON a.load_id = e.load_id) AS extra_ids"""
    ),
    "unseen_high_rate": _with(
        _union(
            [
                f"""SELECT '{c}' AS column_name, COUNT(*) AS high_rate_rows, COUNT(*) FILTER (unseen) AS unseen_rows,
  COUNT(DISTINCT COALESCE({c}, '?')) FILTER (unseen) AS unseen_categories FROM (
  SELECT {c}, NOT EXISTS (SELECT 1 FROM train t WHERE t.{c} IS NOT DISTINCT FROM v.{c}) AS unseen
  FROM validation v WHERE posted_rate > 6000)"""
                for c in CATEGORICAL
            ]
        )
    ),
    "metrics_train": _with(f"SELECT {METRICS} FROM fitted WHERE split = 'train'", MODEL),
    "metrics_validation": _with(f"SELECT {METRICS} FROM scored", MODEL),
    "generalization_gap": _with(
        """, m AS (
  SELECT split, COUNT(*) AS n, AVG(ABS(predicted_rate - actual_rate)) AS mae,
    SQRT(AVG(POWER(predicted_rate - actual_rate, 2))) AS rmse,
    1 - SUM(POWER(predicted_rate - actual_rate, 2)) / REGR_SXX(actual_rate, actual_rate) AS r2
  FROM fitted GROUP BY split)
SELECT t.n AS train_rows, ROUND(t.mae, 6) AS train_mae, ROUND(t.rmse, 6) AS train_rmse, ROUND(t.r2, 6) AS train_r2,
  v.n AS validation_rows, ROUND(v.mae, 6) AS validation_mae, ROUND(v.rmse, 6) AS validation_rmse,
  ROUND(v.r2, 6) AS validation_r2, ROUND(v.mae - t.mae, 6) AS mae_gap, ROUND(v.rmse - t.rmse, 6) AS rmse_gap,
  ROUND(t.r2 - v.r2, 6) AS r2_gap FROM m t JOIN m v ON t.split = 'train' AND v.split = 'validation'""",
        MODEL,
    ),
    "error_summary": _with(
        """SELECT COUNT(*) AS rows, ROUND(AVG(absolute_error), 6) AS mae, ROUND(SQRT(AVG(squared_error)), 6) AS rmse,
  ROUND(AVG(error), 6) AS mean_signed_error, ROUND(MEDIAN(absolute_error), 6) AS median_abs_error,
  ROUND(QUANTILE_CONT(absolute_error, 0.9), 6) AS p90_abs_error,
  ROUND(QUANTILE_CONT(absolute_error, 0.95), 6) AS p95_abs_error,
  ROUND(QUANTILE_CONT(absolute_error, 0.99), 6) AS p99_abs_error FROM scored""",
        MODEL,
    ),
    "error_by_equipment": _with(f"SELECT equipment, {ERROR_STATS} FROM scored GROUP BY equipment", MODEL),
    "error_by_distance": _with(_bins("distance", DISTANCE), MODEL),
    "error_by_rate": _with(_bins("actual_rate", RATE), MODEL),
    "error_by_weight": _with(_bins("weight", WEIGHT), MODEL),
    "error_by_weight_raw": _with(
        ", raw AS (SELECT s.* REPLACE (l.weight AS weight) FROM scored s JOIN labelled l ON l.load_id = s.load_id)"
        + _bins("weight", WEIGHT, "raw"),
        MODEL,
    ),
    "error_by_route": _with(
        """SELECT route, COUNT(*) AS rows, ROUND(AVG(absolute_error), 6) AS mae,
  ROUND(SQRT(AVG(squared_error)), 6) AS rmse, ROUND(AVG(error), 6) AS mean_error,
  ROUND(AVG(actual_rate), 6) AS actual_rate_mean FROM scored GROUP BY route HAVING COUNT(*) >= 10""",
        MODEL,
    ),
    "resid_by_distance_q": _with(_quantile_profile("distance"), MODEL),
    "resid_by_weight_q": _with(_quantile_profile("weight"), MODEL),
    "resid_by_market_q": _with(_quantile_profile("market_index"), MODEL),
    "resid_by_quote_q": _with(_quantile_profile("quote_signal"), MODEL),
    "resid_by_equipment": _with(f"SELECT equipment, {RESIDUAL_STATS} FROM scored GROUP BY equipment", MODEL),
    "resid_correlation": _with(
        _union(
            [
                f"SELECT '{c}' AS column_name, ROUND(CORR({c}, rpm_residual), 6) AS correlation FROM scored"
                for c in ["distance", "weight", "market_index", "quote_signal", "actual_rate_per_mile", "rpm_residual"]
            ]
        ),
        MODEL,
    ),
    "target_describe": _with(
        _union([_describe(t) for t in ("posted_rate", "posted_rate_per_mile", "log_posted_rate_per_mile")]), MODEL
    ),
    "calendar_ranges": _with(
        f", c AS (SELECT {CALENDAR} FROM train) "
        + _union(
            [
                f"SELECT '{c}' AS column_name, CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max FROM c"
                for c in ["month", "day_of_week", "day_of_month", "day_of_year", "days_since_start"]
            ]
        )
    ),
    "route_count": _with("SELECT COUNT(DISTINCT route) AS routes FROM clean"),
    "prediction_summary": _with(
        """SELECT COUNT(*) AS rows, ROUND(MIN(predicted_rate), 6) AS min, ROUND(AVG(predicted_rate), 6) AS mean,
  ROUND(MAX(predicted_rate), 6) AS max, ROUND(MEDIAN(predicted_rate), 6) AS median FROM submission""",
        FINAL,
    ),
    "spearman": _with(
        """, r AS (
  SELECT RANK() OVER (ORDER BY distance) + (COUNT(*) OVER (PARTITION BY distance) - 1) / 2.0::DOUBLE AS rx,
    RANK() OVER (ORDER BY posted_rate) + (COUNT(*) OVER (PARTITION BY posted_rate) - 1) / 2.0::DOUBLE AS ry
  FROM clean)
SELECT COUNT(*) AS rows, ROUND(CORR(rx, ry), 6) AS spearman FROM r"""
    ),
    "rpm_by_equipment": _with(
        "SELECT equipment, COUNT(*) AS rows, ROUND(AVG(posted_rate_per_mile), 6) AS mean_rpm FROM clean GROUP BY equipment"
    ),
    "rpm_tail": _with(
        """SELECT COUNT(*) AS rows, ROUND(QUANTILE_CONT(posted_rate_per_mile, 0.99), 6) AS p99,
  ROUND(QUANTILE_CONT(posted_rate_per_mile, 0.995), 6) AS p995,
  ROUND(QUANTILE_CONT(posted_rate_per_mile, 0.999), 6) AS p999 FROM validation"""
    ),
    **{f"hist_{level}": _with(f"SELECT load_id, {_expanding(level, keys)} FROM train") for level, keys in LEVELS.items()},
    "hist_all": _with(f"SELECT load_id, {ALL_EXPANDING} FROM train"),
    "hist_frozen": _with("SELECT * FROM frozen", FROZEN),
    "hist_coverage": _with(
        f", early AS (SELECT {ALL_EXPANDING} FROM train) "
        + _union(
            [
                f"""SELECT '{split}' AS split, 'hist_{level}_rpm_mean' AS feature,
  ROUND(AVG(CASE WHEN hist_{level}_rpm_mean IS NULL THEN 0 ELSE 100.0::DOUBLE END), 6) AS coverage_pct FROM {source}"""
                for split, source in (("train", "early"), ("validation", "frozen"))
                for level in LEVELS
            ]
        ),
        FROZEN,
    ),
    "error_contribution": _with(
        """SELECT load_id, ROUND(squared_error / (SELECT SUM(squared_error) FROM scored), 10) AS error_squared_contribution,
  ROUND(absolute_error / (SELECT SUM(absolute_error) FROM scored), 10) AS absolute_error_contribution FROM scored""",
        MODEL,
    ),
    "top_routes": _with(
        """SELECT * FROM (SELECT route, COUNT(*) AS rows, ROUND(AVG(absolute_error), 6) AS mae,
  ROUND(SQRT(AVG(squared_error)), 6) AS rmse, ROUND(AVG(error), 6) AS mean_error,
  ROUND(AVG(actual_rate), 6) AS actual_rate_mean FROM scored GROUP BY route HAVING COUNT(*) >= 10)
ORDER BY mae DESC, route LIMIT 15""",
        MODEL,
    ),
    "worst_100": _with(
        f"""SELECT {SCORED_MONEY}, pickup, delivery, equipment, distance, weight, ROUND(error, 4) AS error,
  ROUND(absolute_error, 4) AS absolute_error FROM scored ORDER BY scored.absolute_error DESC, load_id LIMIT 100""",
        MODEL,
    ),
    "top_contributors": _with(
        """SELECT load_id, pickup, delivery, pickup_lat, pickup_lon, delivery_lat, delivery_lon, distance, equipment,
  weight, date, market_index, quote_signal, posted_rate, route, actual_rate, ROUND(predicted_rate, 4) AS predicted_rate,
  actual_rate_per_mile, ROUND(predicted_rate_per_mile, 8) AS predicted_rate_per_mile,
  ROUND(actual_log_rate_per_mile, 8) AS actual_log_rate_per_mile,
  ROUND(predicted_log_rate_per_mile, 8) AS predicted_log_rate_per_mile, ROUND(error, 4) AS error,
  ROUND(absolute_error, 4) AS absolute_error, ROUND(squared_error, 2) AS squared_error,
  ROUND(absolute_percentage_error, 6) AS absolute_percentage_error, ROUND(rpm_residual, 8) AS rpm_residual,
  ROUND(absolute_rate_error, 4) AS absolute_rate_error,
  ROUND(squared_error / (SELECT SUM(squared_error) FROM scored), 10) AS error_squared_contribution,
  ROUND(absolute_error / (SELECT SUM(absolute_error) FROM scored), 10) AS absolute_error_contribution
FROM scored ORDER BY scored.absolute_error DESC, load_id LIMIT 100""",
        MODEL,
    ),
    "top_underpredictions": _with(
        f"""SELECT {SCORED_MONEY}, pickup, delivery, equipment, distance, weight, market_index, quote_signal,
  actual_rate_per_mile, ROUND(predicted_rate_per_mile, 8) AS predicted_rate_per_mile,
  ROUND(rpm_residual, 8) AS rpm_residual FROM scored ORDER BY scored.rpm_residual DESC, load_id LIMIT 20""",
        MODEL,
    ),
    "target_rpm": _with("SELECT load_id, posted_rate_per_mile FROM clean"),
    "target_log_rpm": _with(
        "SELECT load_id, ROUND(log_posted_rate_per_mile, 10) AS log_posted_rate_per_mile FROM clean"
    ),
    "reconstruct_rate": _with(
        """SELECT load_id, ROUND(posted_rate / distance * distance, 7) AS from_rpm,
  ROUND(EXP(LN(posted_rate / distance)) * distance, 7) AS from_log_rpm FROM labelled"""
    ),
    "error_columns": _with(
        """SELECT load_id, ROUND(error, 4) AS error, ROUND(absolute_error, 4) AS absolute_error,
  ROUND(squared_error, 2) AS squared_error, ROUND(absolute_percentage_error, 6) AS absolute_percentage_error FROM scored""",
        MODEL,
    ),
    "residual_columns": _with(
        """SELECT load_id, ROUND(rpm_residual, 8) AS rpm_residual,
  ROUND(absolute_rate_error, 4) AS absolute_rate_error FROM scored""",
        MODEL,
    ),
    "calendar_features": _with(f"SELECT load_id, {CALENDAR} FROM clean"),
    "route_feature": _with("SELECT load_id, route FROM clean"),
    "cv_assign": _with("SELECT fold, role, load_id FROM assigned", FOLDS),
    "cv_predictions": _with(
        """SELECT fold, load_id, actual_rate, ROUND(predicted_rate, 4) AS predicted_rate, actual_rate_per_mile,
  ROUND(predicted_rate_per_mile, 8) AS predicted_rate_per_mile FROM fold_rows WHERE role = 'validation'""",
        FOLDS,
    ),
    "cv_fold_metrics": _with(
        "SELECT fold, train_rows, validation_rows, "
        + ", ".join(
            f"ROUND({c}, 6) AS {c}"
            for c in "train_mae train_rmse train_r2 validation_mae validation_rmse validation_r2 mae_gap rmse_gap r2_gap".split()
        )
        + " FROM fold_metrics",
        FOLDS,
    ),
    "cv_summary": _with(
        "SELECT COUNT(*) AS folds, "
        + ", ".join(
            f"ROUND({fn}(validation_{m}), 6) AS {name}_validation_{m}"
            for m in ("mae", "rmse", "r2")
            for fn, name in (("AVG", "mean"), ("STDDEV_SAMP", "std"))
        )
        + ", ROUND(AVG(mae_gap), 6) AS mean_mae_gap FROM fold_metrics",
        FOLDS,
    ),
    "submission_check": _with(_submission_rules("submission", "holdout"), FINAL),
    "submission_check_wrong_rows": _with(_submission_rules("scored", "holdout"), MODEL),
    "scenario_rates": _with("SELECT * REPLACE (ROUND(predicted_rate, 4) AS predicted_rate) FROM scenario", FINAL, SCENARIO),
    "scenario_check": _with(_scenario_rules("scenario"), FINAL, SCENARIO),
    "scenario_check_loads": _with(_scenario_rules("scored"), MODEL),
    "date_spine_check": _with(
        """, n AS (SELECT date, COUNT(*) AS n FROM all_loads GROUP BY date)
SELECT COALESCE(CAST(u.day AS DATE), n.date) AS day, COALESCE(n.n, 0) AS n, n.n IS NULL AS absent, u.day IS NULL AS unexpected
FROM UNNEST(GENERATE_SERIES(DATE '1995-01-01', DATE '2000-12-31', INTERVAL 1 DAY)) AS u(day)
FULL JOIN n ON n.date = CAST(u.day AS DATE)"""
    ),
    "impute_median": _with(
        _union([f"SELECT '{c}' AS column_name, ROUND(MEDIAN({c}), 6) AS median FROM train" for c in NUMERIC])
    ),
    "impute_mode": _with(
        _union(
            [
                f"""SELECT * FROM (SELECT '{c}' AS column_name, {c} AS mode FROM train WHERE {c} IS NOT NULL
  GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1)"""
                for c in CATEGORICAL
            ]
        )
    ),
    "impute_rows": _with("SELECT * FROM filled", FILLED),
    "category_index": _with("SELECT * FROM codes", CODES),
    "onehot_rows": _with(
        _union(
            [
                f"""SELECT f.load_id, '{c}' AS column_name, w.width, CAST(COALESCE(c.code, -1) AS INTEGER) AS slot
  FROM filled f JOIN widths w ON w.column_name = '{c}'
  LEFT JOIN codes c ON c.column_name = '{c}' AND c.category = f.{c}"""
                for c in CATEGORICAL
            ]
        ),
        CODES,
        WIDTHS,
        FILLED,
    ),
    "feature_vector": _with(
        f"""SELECT f.load_id, CAST({len(NUMERIC)} + (SELECT SUM(width) FROM widths) AS INTEGER) AS width,
  {', '.join(f'f.{c} AS x_{c}' for c in NUMERIC)},
  CAST((p.code IS NOT NULL)::INT + (d.code IS NOT NULL)::INT + (e.code IS NOT NULL)::INT AS INTEGER) AS active
FROM filled f LEFT JOIN codes p ON p.column_name = 'pickup' AND p.category = f.pickup
LEFT JOIN codes d ON d.column_name = 'delivery' AND d.category = f.delivery
LEFT JOIN codes e ON e.column_name = 'equipment' AND e.category = f.equipment""",
        CODES,
        WIDTHS,
        FILLED,
    ),
    "model_roundtrip": _with(
        _union(
            [
                f"SELECT '{e}' AS estimator, COUNT(*) AS rows, CAST(0 AS BIGINT) AS differences FROM validation"
                for e in ("forest", "extra_trees")
            ]
        )
    ),
}

# What holds for the ensembles whatever they predict.
_BOTH = "(SELECT 'train' AS split, * FROM train UNION ALL SELECT 'validation' AS split, * FROM validation)"
_PRICES = "load_id, posted_rate AS actual_rate, posted_rate_per_mile AS actual_rate_per_mile, TRUE AS consistent"
_RUNS = """(VALUES
  ('raw_target_forest', 'posted_rate', 'forest', 1, FALSE, 8, 3), ('repaired_weight_forest', 'posted_rate', 'forest', 1, TRUE, 8, 3),
  ('leaf_5_forest', 'posted_rate', 'forest', 5, TRUE, 8, 3), ('rate_per_mile_forest', 'posted_rate_per_mile', 'forest', 5, TRUE, 8, 3),
  ('log_rate_per_mile_forest', 'log_posted_rate_per_mile', 'forest', 5, TRUE, 8, 3),
  ('history_forest', 'posted_rate_per_mile', 'forest', 5, TRUE, 17, 3), ('calendar_forest', 'posted_rate_per_mile', 'forest', 5, TRUE, 13, 3),
  ('route_forest', 'log_posted_rate_per_mile', 'forest', 5, TRUE, 8, 4),
  ('leaf_5_extra_trees', 'log_posted_rate_per_mile', 'extra_trees', 5, TRUE, 8, 3),
  ('leaf_10_extra_trees', 'log_posted_rate_per_mile', 'extra_trees', 10, TRUE, 8, 3),
  ('leaf_20_extra_trees', 'log_posted_rate_per_mile', 'extra_trees', 20, TRUE, 8, 3)) AS r(run, target, estimator, min_leaf, repaired, numeric, categorical)"""
REPORTS = ["error_summary", "error_by_equipment", "error_by_distance", "error_by_rate", "error_by_weight", "error_by_route", "worst_100", "error_contribution"]

ORACLE |= {
    "rf_contract": _with(f"SELECT split, {_PRICES} FROM {_BOTH}"),
    "extratrees_contract": _with(f"SELECT split, {_PRICES} FROM {_BOTH}"),
    "extratrees_trees": _with(
        """SELECT CAST(t.tree AS INTEGER) AS tree, CAST(x.n AS BIGINT) AS leaf_rows, CAST(0 AS BIGINT) AS small_leaves,
  CAST(0 AS BIGINT) AS wrong_nodes, ROUND(x.m, 6) AS root_value
FROM range(100) AS t(tree), (SELECT COUNT(*) AS n, AVG(log_posted_rate_per_mile) AS m FROM train) AS x"""
    ),
    "cv_extratrees_windows": _with(
        """SELECT f.fold, f.a AS train_start, f.b AS train_end, f.c AS validation_start, f.d AS validation_end,
  COUNT(*) FILTER (a.role = 'train') AS train_rows, COUNT(*) FILTER (a.role = 'validation') AS validation_rows
FROM folds f JOIN assigned a ON a.fold = f.fold GROUP BY ALL""",
        FOLDS,
    ),
    "cv_extratrees_written": _with(f"SELECT fold, {_PRICES} FROM assigned WHERE role = 'validation'", FOLDS),
    "submission_extratrees_contract": _with("SELECT load_id, TRUE AS priced FROM holdout"),
    "final_record": _with(
        """SELECT 'leaf_20_extra_trees' AS run, (SELECT COUNT(*) FROM labelled) AS labelled_rows,
  (SELECT COUNT(*) FROM labelled WHERE weight < 0) AS labelled_weights_repaired, (SELECT COUNT(*) FROM holdout) AS holdout_rows,
  (SELECT COUNT(*) FROM holdout WHERE weight < 0) AS holdout_weights_repaired, CAST(0 AS BIGINT) AS differences"""
    ),
    "extratrees_error_by_distance": f"SELECT bin, label, rows, actual_rate_mean FROM ({ORACLE['error_by_distance']})",
    "csv_roundtrip": _with("SELECT * FROM labelled"),
    "csv_roundtrip_holdout": _with("SELECT * FROM holdout"),
    "predictions_roundtrip": _with(
        """SELECT load_id, actual_rate, ROUND(predicted_rate, 4) AS predicted_rate, actual_rate_per_mile,
  ROUND(predicted_rate_per_mile, 8) AS predicted_rate_per_mile FROM scored""",
        MODEL,
    ),
    "report_set": _union([f"SELECT '{name}' AS name, COUNT(*) AS rows FROM ({ORACLE[name]})" for name in REPORTS]),
    "run_log_contract": _with(
        f"""SELECT run, target, estimator, CAST(min_leaf AS INTEGER) AS min_leaf, repaired AS weights_repaired,
  (SELECT COUNT(*) FROM train) AS train_rows, (SELECT COUNT(*) FROM validation) AS validation_rows,
  (SELECT COUNT(*) FROM labelled WHERE weight < 0) AS negative_weights, CAST(numeric AS INTEGER) AS numeric, CAST(categorical AS INTEGER) AS categorical
FROM {_RUNS}"""
    ),
    "leaderboard_contract": f"SELECT run, TRUE AS gap_holds, TRUE AS in_order FROM {_RUNS}",
}
