"""Plain SQL for the registered queries, as an independent check of their results."""

from __future__ import annotations

from ..operators.vocabulary import (CLINICAL_RANGES, CONTEXT, DUPLICATE_ACTION, ENSEMBLE_WEIGHTS, MISSING_ACTION,
                                    OTHER_WEIGHT, RECOMMENDATIONS, SEVERITY_ACTIONS, UNKNOWN_CONTEXT)
from .tables import VISIT_RULES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


VISITS = """visits AS (
  SELECT event_id, user_id AS subject_id, ts AS visit_time,
         CASE WHEN event_type <> 'error' THEN value END AS heart_rate,
         40.0::DOUBLE + k * 2 AS systolic_bp, value AS diastolic_bp,
         CASE WHEN event_type <> 'signup' THEN 50.0::DOUBLE + k END AS weight,
         36.0::DOUBLE + (k // 34) * 0.5::DOUBLE AS temperature, k * 2 - 20 AS age, k + 10.0::DOUBLE AS body_temp,
         strftime(ts, '%Y-%m-%d') AS start_date,
         CASE WHEN event_type <> 'signup' THEN strftime(ts::DATE + (k - 20), '%Y-%m-%d') END AS end_date,
         CASE WHEN event_type <> 'click' THEN event_type END AS site
  FROM (SELECT *, regexp_extract(props, '(\\d+)', 1)::INTEGER AS k FROM events))"""

VISIT_COLUMNS = ["subject_id", "visit_time", "heart_rate", "systolic_bp", "diastolic_bp", "weight", "temperature", "age",
                 "body_temp", "start_date", "end_date", "site"]

READINGS = """readings AS (
  SELECT event_id, user_id AS subject_id, CASE event_type WHEN 'view' THEN 'Heart Rate' WHEN 'click' THEN 'SBP'
         WHEN 'purchase' THEN 'Weight_kg' WHEN 'signup' THEN 'Body Temperature' ELSE 'zzq' END AS parameter, value,
         CASE event_type WHEN 'view' THEN 'heart_rate' WHEN 'click' THEN 'systolic_bp'
         WHEN 'purchase' THEN 'weight' WHEN 'signup' THEN 'temperature' END AS concept
  FROM events)"""

DATASETS = """datasets AS (
  SELECT c_custkey AS dataset_id, c_name AS name, c_mktsegment || '.csv' AS original_filename,
         c_nationkey AS user_id, c_acctbal < 0 AS is_archived, c_custkey AS created_at FROM customer)"""

ANALYSES = """analyses AS (
  SELECT o_orderkey AS analysis_id, o_custkey AS dataset_id, c_nationkey AS user_id,
         CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PROCESSING' ELSE 'FAILED' END AS status,
         o_totalprice / 5000.0 AS quality_score, o_orderdate AS created_at, o_totalprice AS seconds
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""

STORED = """stored AS (
  SELECT *, CASE WHEN anomaly_score >= 0.8 THEN 'CRITICAL' WHEN anomaly_score >= 0.6 THEN 'HIGH'
         WHEN anomaly_score >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS severity
  FROM (SELECT l_orderkey AS analysis_id, l_partkey * 1000 + l_suppkey AS row_key,
         'col_' || l_linenumber || '_' || l_quantity::INTEGER AS column_name, round(l_discount * 10, 4) AS anomaly_score,
         CASE WHEN l_linestatus = 'F' THEN 'statistical' WHEN l_tax >= 0.04 THEN 'statistical, clinical_rules'
              ELSE 'missing_data' END AS detection_method,
         l_returnflag = 'R' AS is_reviewed, CASE WHEN l_returnflag = 'R' THEN 'seen' END AS review_note,
         l_returnflag = 'A' AS is_false_positive, l_shipdate AS created_at FROM lineitem))"""


# ---- univariate --------------------------------------------------------------------------------

def cells(source: str, key: str, cols: list[str], extra: str = "") -> str:
    """CTEs ``cells`` (long values), ``st`` (statistics) and ``md`` (MAD)."""
    union = " UNION ALL ".join(
        f"SELECT {key} AS row_key, '{c}' AS column_name, {c}::DOUBLE AS x{extra} FROM {source} WHERE {c} IS NOT NULL"
        for c in cols)
    return f"""cells AS ({union}),
st AS (SELECT column_name, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi,
  quantile_cont(x, 0.25) AS q1, median(x) AS med, quantile_cont(x, 0.75) AS q3, quantile_cont(x, 0.01) AS p01,
  quantile_cont(x, 0.99) AS p99 FROM cells GROUP BY column_name),
md AS (SELECT column_name, median(abs(x - med)) AS mad FROM cells JOIN st USING (column_name) GROUP BY column_name)"""


def zscore_sql(t: float = 3.0) -> str:
    return f"""SELECT row_key, column_name, 'zscore' AS method, round(least(abs((x - mean) / sd) / {2 * t}, 1), 4) AS score,
  round((x - mean) / sd, 4) AS z_score, round(mean - {t} * sd, 4) AS expected_min, round(mean + {t} * sd, 4) AS expected_max
FROM cells JOIN st USING (column_name) WHERE n >= 4 AND sd > 0 AND abs((x - mean) / sd) > {t}"""


def iqr_sql(f: float = 1.5) -> str:
    return f"""SELECT row_key, column_name, 'iqr' AS method,
  round(least(CASE WHEN x < q1 - {f} * (q3 - q1) THEN (q1 - {f} * (q3 - q1)) - x ELSE x - (q3 + {f} * (q3 - q1)) END
  / (q3 - q1) / {2 * f}, 1), 4) AS score, NULL::DOUBLE AS z_score,
  round(q1 - {f} * (q3 - q1), 4) AS expected_min, round(q3 + {f} * (q3 - q1), 4) AS expected_max
FROM cells JOIN st USING (column_name)
WHERE n >= 4 AND q3 > q1 AND (x < q1 - {f} * (q3 - q1) OR x > q3 + {f} * (q3 - q1))"""


MODIFIED = """SELECT row_key, column_name, 'modified_zscore' AS method, round(least(abs(z) / 7.0, 1), 4) AS score,
  round(z, 4) AS z_score, NULL::DOUBLE AS expected_min, NULL::DOUBLE AS expected_max
FROM (SELECT row_key, column_name, 0.6745 * (x - med) / CASE WHEN mad > 0 THEN mad ELSE sd END AS z
  FROM cells JOIN st USING (column_name) JOIN md USING (column_name) WHERE n >= 4 AND (mad > 0 OR sd > 0))
WHERE abs(z) > 3.5"""

PERCENTILE = """SELECT row_key, column_name, 'percentile_bounds' AS method,
  round(least(CASE WHEN x < p01 THEN p01 - x ELSE x - p99 END / CASE WHEN p99 <> p01 THEN p99 - p01 ELSE 1 END, 1), 4)
  AS score, NULL::DOUBLE AS z_score, round(p01, 4) AS expected_min, round(p99, 4) AS expected_max
FROM cells JOIN st USING (column_name) WHERE n >= 20 AND (x < p01 OR x > p99)"""

# Grubbs flags one cell per column. Its score G/(2·Gc) never exceeds the z-score's or fence's score of that cell in
# the tables used here, so the best-of-all selection needs no Grubbs branch.
BEST = f"""best AS (SELECT * EXCLUDE (rank, rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY row_key, column_name ORDER BY score DESC, rank) AS rn FROM (
    SELECT *, 0 AS rank FROM ({zscore_sql()}) UNION ALL SELECT *, 1 FROM ({iqr_sql()})
    UNION ALL SELECT *, 2 FROM ({MODIFIED}) UNION ALL SELECT *, 4 FROM ({PERCENTILE}))) WHERE rn = 1)"""

VISIT_CELLS = cells("visits", "event_id", ["heart_rate", "systolic_bp", "weight", "temperature"])
LINE_CELLS = cells("lineitem", "l_orderkey", ["l_extendedprice"], ", l_linenumber, l_partkey")


def lines(sql: str) -> str:
    return sql.replace("SELECT row_key,", "SELECT row_key AS l_orderkey, l_linenumber, l_partkey,", 1)


# ---- missing and impossible --------------------------------------------------------------------

VITAL = {"heart_rate", "systolic_bp", "diastolic_bp", "weight", "temperature", "age", "body_temp"}


def missing_cells_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT event_id AS row_key, '{c}' AS column_name, 'missing_value' AS method, "
        f"{0.5 if c in VITAL else 0.2}::DOUBLE AS score, 'missing_value' AS anomaly_type, "
        f"'Missing value in clinical parameter ''{c}''.' AS note FROM visits WHERE {c} IS NULL" for c in VISIT_COLUMNS)


def _impossible(c: str, zero: bool, age: bool, temp: bool) -> str:
    t = f"CAST({c}::DOUBLE AS VARCHAR)"
    score = ["WHEN x < 0 THEN 1.0"]
    note = [f"WHEN x < 0 THEN 'Impossible negative value ' || {t} || ' detected in clinical parameter ''{c}''.'"]
    if zero:
        score.append("WHEN x = 0 THEN 0.9")
        note.append(f"WHEN x = 0 THEN 'Impossible zero value detected in clinical parameter ''{c}''.'")
    if age:
        score.append("WHEN x > 120 THEN 0.8")
        note.append(f"WHEN x > 120 THEN 'Out-of-bounds subject age: ' || {t} || ' years.'")
    if temp:
        score.append("WHEN (x > 45 OR x < 25) AND (x < 77 OR x > 113) THEN 1.0")
        note.append("WHEN (x > 45 OR x < 25) AND (x < 77 OR x > 113) THEN "
                    f"'Physiologically impossible temperature value: ' || {t} || '.'")
    return (f"SELECT event_id AS row_key, '{c}' AS column_name, 'impossible_value' AS method, "
            f"(CASE {' '.join(score)} END)::DOUBLE AS score, 'impossible_value' AS anomaly_type, "
            f"CASE {' '.join(note)} END AS note FROM (SELECT *, {c}::DOUBLE AS x FROM visits)")


IMPOSSIBLE = "SELECT * FROM (" + " UNION ALL ".join([
    _impossible("heart_rate", True, False, False), _impossible("systolic_bp", True, False, False),
    _impossible("diastolic_bp", True, False, False), _impossible("weight", True, False, False),
    _impossible("temperature", True, False, True), _impossible("age", False, True, False),
    _impossible("body_temp", True, False, True)]) + ") WHERE score IS NOT NULL"

MISSING_COUNTS = "mc AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS missing_count FROM visits"
    for c in ["event_id", *VISIT_COLUMNS]) + ")"

RATES = """SELECT column_name, round(missing_count / rows, 4) AS score, 'high_missing_rate' AS anomaly_type,
  'Column ''' || column_name || ''' has a ' || CASE WHEN missing_count / rows > 0.2 THEN 'critical' ELSE 'high' END
  || ' missing data rate of ' || printf('%.1f', missing_count / rows * 100) || '% (' || missing_count || '/' || rows
  || ' rows missing).' AS note FROM mc WHERE missing_count / rows > 0.05"""

STREAKS = " UNION ALL ".join(f"""SELECT event_id AS row_key, '{c}' AS column_name, 'missing_streak' AS method,
  0.5::DOUBLE AS score, 'missing_streak' AS anomaly_type,
  'Parameter ''{c}'' missing for ' || run || ' consecutive visits.' AS note
FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, g ORDER BY visit_time, event_id) AS run FROM (
  SELECT *, sum(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY subject_id ORDER BY visit_time, event_id) AS g
  FROM visits) WHERE {c} IS NULL) WHERE run >= 2""" for c in ["heart_rate", "weight"])


# ---- rules -------------------------------------------------------------------------------------

def _range(c: str, concept: str) -> str:
    low, high, unit, cl, ch = CLINICAL_RANGES[concept]
    below = f"x < {cl}" if cl is not None else "FALSE"
    above = f"x > {ch}" if ch is not None else "FALSE"
    t = "CAST(x AS VARCHAR)"
    return f"""SELECT event_id AS row_key, '{c}' AS column_name, 'range_rules' AS method,
  (CASE WHEN {below} OR {above} THEN 1.0 ELSE 0.8 END)::DOUBLE AS score,
  CASE WHEN {below} OR {above} THEN 'critical_physiological_range' ELSE 'out_of_physiological_range' END AS anomaly_type,
  CASE WHEN {below} THEN 'Critical low value ' || {t} || ' {unit} is below safety threshold ({cl}).'
       WHEN {above} THEN 'Critical high value ' || {t} || ' {unit} is above safety threshold ({ch}).'
       ELSE 'Out-of-range physiological value ' || {t} || ' {unit} (expected [{low}-{high}]).' END AS note,
  {low}::DOUBLE AS expected_min, {high}::DOUBLE AS expected_max
FROM (SELECT event_id, {c}::DOUBLE AS x FROM visits) WHERE {below} OR {above} OR x < {low} OR x > {high}"""


RANGES = " UNION ALL ".join(_range(c, concept) for c, concept in VISIT_RULES.items())

LIMITS = "limits(concept, low, high, cl, ch) AS (VALUES " + ", ".join(
    f"('{c}', {lo}::DOUBLE, {hi}::DOUBLE, {'NULL' if cl is None else cl}::DOUBLE, {'NULL' if ch is None else ch}::DOUBLE)"
    for c, (lo, hi, _, cl, ch) in CLINICAL_RANGES.items()) + ")"

RANGES_LONG = """SELECT event_id AS row_key, concept AS column_name,
  (CASE WHEN value < cl OR value > ch THEN 1.0 ELSE 0.8 END)::DOUBLE AS score,
  CASE WHEN value < cl OR value > ch THEN 'critical_physiological_range' ELSE 'out_of_physiological_range' END AS anomaly_type,
  low AS expected_min, high AS expected_max
FROM readings JOIN limits USING (concept) WHERE value < cl OR value > ch OR value < low OR value > high"""

PRESSURE = """SELECT event_id AS row_key, 'diastolic_bp' AS column_name, 'field_order' AS method, 0.9::DOUBLE AS score,
  'cross_field_inconsistency' AS anomaly_type, 'Diastolic BP (' || CAST(diastolic_bp AS VARCHAR)
  || ' mmHg) is greater than or equal to Systolic BP (' || CAST(systolic_bp AS VARCHAR) || ' mmHg).' AS note,
  0.0::DOUBLE AS expected_min, systolic_bp - 10 AS expected_max FROM visits WHERE diastolic_bp >= systolic_bp"""

DATES = """SELECT event_id AS row_key, 'end_date' AS column_name, 'date_order' AS method, 0.8::DOUBLE AS score,
  'cross_field_inconsistency' AS anomaly_type, 'End date (' || end_date || ') is earlier than start date (' || start_date
  || ').' AS note, 0.0::DOUBLE AS expected_min, 0.0::DOUBLE AS expected_max
FROM visits WHERE try_cast(end_date AS TIMESTAMP) < try_cast(start_date AS TIMESTAMP)"""


def _pairs(source: str, key: str, subject: str, time: str, c: str) -> str:
    return (f"SELECT {key} AS row_key, {c} AS x, lag({c}) OVER (PARTITION BY {subject} ORDER BY {time}, {key}) AS p "
            f"FROM {source} WHERE {c} IS NOT NULL AND {subject} IS NOT NULL")


def shift_sql(source, key, subject, time, c) -> str:
    return f"""SELECT row_key, '{c}' AS column_name, 'shift_percent' AS method, 0.8::DOUBLE AS score,
  'abnormal_longitudinal_shift' AS anomaly_type,
  'Subject weight changed abnormally by ' || printf('%.1f', abs(x - p) / greatest(p, 1e-5) * 100) || '% ('
  || CAST(p AS VARCHAR) || ' kg to ' || CAST(x AS VARCHAR) || ' kg) in consecutive visits.' AS note,
  p * 0.8 AS expected_min, p * 1.2 AS expected_max
FROM ({_pairs(source, key, subject, time, c)}) WHERE abs(x - p) / greatest(p, 1e-5) > 0.20"""


def fold_sql(source, key, subject, time, c) -> str:
    return f"""SELECT row_key, '{c}' AS column_name, 'shift_fold' AS method, 0.7::DOUBLE AS score,
  'abnormal_longitudinal_shift' AS anomaly_type, 'Clinical parameter ''{c}'' experienced a sudden '
  || printf('%.1f', r) || '-fold change from ' || CAST(p AS VARCHAR) || ' to ' || CAST(x AS VARCHAR) || '.' AS note,
  p / 3.0 AS expected_min, p * 3.0 AS expected_max
FROM (SELECT *, CASE WHEN x > p THEN x / greatest(p, 1e-5) ELSE p / greatest(x, 1e-5) END AS r
  FROM ({_pairs(source, key, subject, time, c)})) WHERE r > 3.0"""


def repeat_sql(source, key, subject, time, c) -> str:
    return f"""SELECT row_key, '{c}' AS column_name, 'repeated_values' AS method, 0.7::DOUBLE AS score,
  'suspicious_repeated_value' AS anomaly_type, 'Suspicious repeating values: parameter ''{c}'' remained exactly '
  || CAST(x AS VARCHAR) || ' for ' || run || ' consecutive visits.' AS note,
  0.0::DOUBLE AS expected_min, 0.0::DOUBLE AS expected_max
FROM (SELECT *, row_number() OVER (PARTITION BY subject, island ORDER BY time, row_key) AS run FROM (
  SELECT *, sum(CASE WHEN abs(x - p) < 1e-6 THEN 0 ELSE 1 END) OVER (PARTITION BY subject ORDER BY time, row_key) AS island
  FROM (SELECT {key} AS row_key, {subject} AS subject, {time} AS time, {c} AS x,
    lag({c}) OVER (PARTITION BY {subject} ORDER BY {time}, {key}) AS p
    FROM {source} WHERE {c} IS NOT NULL AND {subject} IS NOT NULL))) WHERE run >= 3"""


VISIT_TIME = ("visits", "event_id", "subject_id", "visit_time")
LONGITUDINAL = " UNION ALL ".join(
    [shift_sql(*VISIT_TIME, "weight")]
    + [fold_sql(*VISIT_TIME, c) for c in VISIT_RULES if c != "weight"]
    + [repeat_sql(*VISIT_TIME, c) for c in VISIT_RULES])
ALL_RULES = (f"rules AS (SELECT *, 1 AS seq FROM ({RANGES}) UNION ALL SELECT *, 2 FROM ({PRESSURE}) "
             f"UNION ALL SELECT *, 3 FROM ({DATES}) UNION ALL "
             f"SELECT *, CASE method WHEN 'repeated_values' THEN 5 ELSE 4 END FROM ({LONGITUDINAL}))")


# ---- merge -------------------------------------------------------------------------------------

_VALUES = " UNION ALL ".join(
    f"SELECT event_id AS row_key, '{c}' AS column_name, subject_id, CAST({c} AS VARCHAR) AS value, "
    f"{'NULL::DOUBLE' if c in ('start_date', 'end_date', 'site', 'visit_time') else c + '::DOUBLE'} AS value_num FROM visits"
    for c in VISIT_COLUMNS)
W = {a: ENSEMBLE_WEIGHTS.get(a, OTHER_WEIGHT) for a in ("statistical", "clinical_rules", "missing_data")}


def merged(conflict: str = "last") -> str:
    """CTEs up to ``findings`` for the visits."""
    rank = "seq DESC, score DESC" if conflict == "last" else "score DESC, seq DESC"
    return f"""{VISITS}, {VISIT_CELLS}, {BEST}, {ALL_RULES},
hits AS (
  SELECT row_key, column_name, 'statistical' AS algo, score, z_score, expected_min, expected_max,
    'statistical_outlier' AS anomaly_type, NULL::VARCHAR AS note, 0 AS seq FROM best
  UNION ALL SELECT row_key, column_name, 'missing_data', score, NULL, NULL, NULL, anomaly_type, note, 2
    FROM ({missing_cells_sql()})
  UNION ALL SELECT row_key, column_name, 'missing_data', score, NULL, NULL, NULL, anomaly_type, note, 3 FROM ({IMPOSSIBLE})
  UNION ALL SELECT row_key, column_name, 'clinical_rules', score, NULL, expected_min, expected_max, anomaly_type, note, seq
    FROM rules),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY row_key, column_name, algo ORDER BY {rank}) AS rn FROM hits) WHERE rn = 1),
scores AS (SELECT row_key, column_name,
  max(CASE WHEN algo = 'statistical' THEN score END) AS s1, max(CASE WHEN algo = 'clinical_rules' THEN score END) AS s2,
  max(CASE WHEN algo = 'missing_data' THEN score END) AS s3,
  max(CASE WHEN algo = 'statistical' THEN z_score END) AS z_score,
  max(CASE WHEN algo = 'statistical' THEN expected_min END) AS lo1,
  max(CASE WHEN algo = 'statistical' THEN expected_max END) AS hi1,
  max(CASE WHEN algo = 'clinical_rules' THEN expected_min END) AS lo2,
  max(CASE WHEN algo = 'clinical_rules' THEN expected_max END) AS hi2,
  max(CASE WHEN algo = 'clinical_rules' THEN anomaly_type END) AS k2,
  max(CASE WHEN algo = 'missing_data' THEN anomaly_type END) AS k3,
  max(CASE WHEN algo = 'clinical_rules' THEN note END) AS n2, max(CASE WHEN algo = 'missing_data' THEN note END) AS n3
  FROM latest GROUP BY row_key, column_name),
combined AS (SELECT *, least(1.0, greatest(0.0,
  (coalesce(s1 * {W['statistical']}, 0) + coalesce(s2 * {W['clinical_rules']}, 0) + coalesce(s3 * {W['missing_data']}, 0))
  / (CASE WHEN s1 IS NULL THEN 0 ELSE {W['statistical']}::DOUBLE END
     + CASE WHEN s2 IS NULL THEN 0 ELSE {W['clinical_rules']}::DOUBLE END
     + CASE WHEN s3 IS NULL THEN 0 ELSE {W['missing_data']}::DOUBLE END))) AS combined FROM scores),
vals AS ({_VALUES}),
findings AS (SELECT c.row_key, c.column_name, v.subject_id::VARCHAR AS subject_id, v.value, v.value_num, z_score,
  CASE WHEN lo2 IS NOT NULL THEN lo2 ELSE lo1 END AS expected_range_min,
  CASE WHEN lo2 IS NOT NULL THEN hi2 ELSE hi1 END AS expected_range_max,
  combined, round(combined, 4) AS anomaly_score,
  CASE WHEN combined >= 0.8 THEN 'CRITICAL' WHEN combined >= 0.6 THEN 'HIGH' WHEN combined >= 0.3 THEN 'MEDIUM'
       ELSE 'LOW' END AS severity,
  concat_ws(', ', CASE WHEN s1 IS NOT NULL THEN 'statistical' END, CASE WHEN s2 IS NOT NULL THEN 'clinical_rules' END,
            CASE WHEN s3 IS NOT NULL THEN 'missing_data' END) AS detection_method,
  (s1 IS NOT NULL)::INT + (s2 IS NOT NULL)::INT + (s3 IS NOT NULL)::INT AS n_methods,
  coalesce(k3, k2, 'statistical_outlier') AS anomaly_type, coalesce(n3, n2) AS note
  FROM combined c JOIN vals v USING (row_key, column_name) WHERE combined >= 0.3)"""


def _context(value: str, low: str, high: str, concept: str) -> str:
    cases = []
    for name, t in CONTEXT.items():
        below, above = t.get("low", t.get("high")), t.get("high", t.get("low"))
        cases.append(f"WHEN {concept} = '{name}' THEN CASE WHEN {value} < {low} THEN {q(below)} WHEN {value} > {high} "
                     f"THEN {q(above)} ELSE 'Clinical variation in parameter ''' || {concept} || ''' detected.' END")
    return f"CASE {' '.join(cases)} ELSE {q(UNKNOWN_CONTEXT)} END"


_CONCEPT = "CASE column_name WHEN 'body_temp' THEN 'temperature' ELSE column_name END"
_CLEAN = ("replace(replace(replace(detection_method, 'statistical', 'Statistical'), 'clinical_rules', 'Clinical Rules'), "
          "'missing_data', 'Missing Data')")
_TAG = ("CASE WHEN value_num IS NOT NULL THEN split_part(detection_method, ', ', 1) ELSE anomaly_type END")
ACTION = (f"CASE WHEN {_TAG} LIKE '%missing%' THEN {q(MISSING_ACTION)} WHEN {_TAG} LIKE '%duplicate%' THEN "
          f"{q(DUPLICATE_ACTION)} " + " ".join(f"WHEN severity = '{s}' THEN {q(t)}" for s, t in SEVERITY_ACTIONS.items())
          + " END")
SIGNIFICANCE = f"""coalesce(note, CASE WHEN value_num IS NOT NULL THEN
  {_context('value_num', 'coalesce(expected_range_min, 0.0)', 'coalesce(expected_range_max, 0.0)', _CONCEPT)}
  || ' Flagged by ' || {_CLEAN} || '.' ELSE 'Value ''' || coalesce(value, 'NaN') || ''' in column ''' || column_name
  || ''' flagged by ' || n_methods || ' methods.' END)"""

SUMMARY = """summary AS (
  SELECT 'total' AS section, 'total' AS name, count(*) AS n FROM findings
  UNION ALL SELECT 'severity', s, count(f.severity) FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) v(s)
    LEFT JOIN findings f ON f.severity = s GROUP BY s
  UNION ALL SELECT 'column', column_name, count(*) FROM findings GROUP BY column_name
  UNION ALL SELECT 'method', m, count(*) FROM (
    SELECT unnest(string_split(detection_method, ', ')) AS m FROM findings) GROUP BY m)"""

_N = "(SELECT coalesce(max(n), 0) FROM summary WHERE section = '{0}' AND name = '{1}')"
_TOP = "(SELECT {0} FROM summary WHERE section = 'column' ORDER BY n DESC, name LIMIT 1)"


def _advice_text(name: str, *args: str) -> str:
    out = q(RECOMMENDATIONS[name])
    for i, a in enumerate(args):
        out = f"replace({out}, '{{{i}}}', CAST({a} AS VARCHAR))"
    return out


ADVICE = f"""SELECT (row_number() OVER (ORDER BY o) - 1)::INTEGER AS position, t AS recommendation FROM (
  SELECT 1 AS o, {_advice_text('critical', _N.format('severity', 'CRITICAL'))} AS t
    WHERE {_N.format('severity', 'CRITICAL')} > 0
  UNION ALL SELECT 2, {_advice_text('missing')} WHERE {_N.format('method', 'missing_data')} > 0
  UNION ALL SELECT 3, {_advice_text('duplicates')} WHERE {_N.format('method', 'duplicates')} > 0
  UNION ALL SELECT 4, {_advice_text('column', _TOP.format('name'), _TOP.format('n'))} WHERE {_TOP.format('n')} > 3
  UNION ALL SELECT 5, {_advice_text('statistical')} WHERE {_N.format('method', 'statistical')} > 5)"""


#: Findings with one more detector: weight 0.3, named after the rules.
OWN = f"""own_scores AS (SELECT row_key, column_name, s1, s2, s3, s4, k2, k3 FROM scores FULL JOIN (
    SELECT event_id AS row_key, 'age' AS column_name, round(age / 200.0, 4)::DOUBLE AS s4 FROM visits WHERE age > 150) o
    USING (row_key, column_name)),
own_all AS (SELECT *, least(1.0, greatest(0.0, (coalesce(s1 * {W['statistical']}, 0) + coalesce(s2 * {W['clinical_rules']}, 0)
    + coalesce(s3 * {W['missing_data']}, 0) + coalesce(s4 * 0.3, 0))
    / (CASE WHEN s1 IS NULL THEN 0 ELSE {W['statistical']}::DOUBLE END
       + CASE WHEN s2 IS NULL THEN 0 ELSE {W['clinical_rules']}::DOUBLE END
       + CASE WHEN s3 IS NULL THEN 0 ELSE {W['missing_data']}::DOUBLE END
       + CASE WHEN s4 IS NULL THEN 0 ELSE 0.3::DOUBLE END))) AS c FROM own_scores),
own AS (SELECT row_key, column_name, round(c, 4) AS anomaly_score, CASE WHEN c >= 0.8 THEN 'CRITICAL' WHEN c >= 0.6
    THEN 'HIGH' WHEN c >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
    concat_ws(', ', CASE WHEN s1 IS NOT NULL THEN 'statistical' END, CASE WHEN s2 IS NOT NULL THEN 'clinical_rules' END,
      CASE WHEN s4 IS NOT NULL THEN 'ages' END, CASE WHEN s3 IS NOT NULL THEN 'missing_data' END) AS detection_method,
    coalesce(k3, k2, CASE WHEN s1 IS NOT NULL THEN 'statistical_outlier' END, 'large_age') AS anomaly_type
    FROM own_all WHERE c >= 0.3)"""


def quality_sql(findings: str, rows: str) -> str:
    return f"""SELECT rows, total, critical, high,
  greatest(0.0, round(100.0 - (critical * 5.0 + high * 2.0 + (total - critical - high) * 0.5), 2))::DOUBLE AS quality_score,
  greatest(0.0, round(100.0 - (critical * 5.0 + high * 2.0 + (total - critical - high) * 0.5) * 1000.0 / rows, 2))::DOUBLE
    AS quality_score_per_1k, round(total / rows * 100, 2) AS anomaly_rate_percent
FROM (SELECT count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical,
  count(*) FILTER (severity = 'HIGH') AS high FROM {findings}), (SELECT count(*) AS rows FROM {rows})"""


# ---- duplicates and neighbours -----------------------------------------------------------------

def near_sql(source: str, key: str, cols: list[str], need: int, names: list[str]) -> str:
    ok = [f"(abs(a.{c} - b.{c}) / greatest(abs(a.{c}), 1e-5) <= 0.01)" for c in cols]
    total = " + ".join(f"{o}::INT" for o in ok)
    flags = ", ".join(f"{o} AS m{i}" for i, o in enumerate(ok))
    shown = "concat_ws(',', " + ", ".join(f"CASE WHEN m{i} THEN '{n}' END" for i, n in enumerate(names)) + ")"
    return f"""SELECT row_key, duplicate_of, {shown} AS columns_matching, round(share, 4) AS anomaly_score,
  'near_duplicate' AS anomaly_type
FROM (SELECT b.{key} AS row_key, a.{key} AS duplicate_of, {flags}, ({total}) / {len(cols)}::DOUBLE AS share,
    row_number() OVER (PARTITION BY b.{key} ORDER BY a.{key}) AS rn
  FROM {source} a JOIN {source} b ON a.{key} < b.{key} AND {total} >= {need}) WHERE rn = 1"""


EXACT_CUSTOMERS = """SELECT c_custkey AS row_key, first AS duplicate_of FROM (
  SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, balance) AS first FROM balances)
  WHERE c_custkey > first"""
BALANCES = "balances AS (SELECT c_custkey, c_nationkey, round(c_acctbal, -2) AS balance FROM customer)"


def lof_ctes(points: str, k: int = 20, contamination: float = 0.05) -> str:
    """CTEs ``scored`` from ``pts(id, v)`` with ``v`` a list of doubles; brute force over all pairs."""
    return f"""pts AS ({points}),
knn AS (SELECT id, other, dist, row_number() OVER (PARTITION BY id ORDER BY dist, other) AS rn FROM (
  SELECT a.id, b.id AS other, list_distance(a.v, b.v) AS dist FROM pts a JOIN pts b ON a.id <> b.id)
  QUALIFY rn <= {k}),
kd AS (SELECT id, max(dist) AS k_dist FROM knn GROUP BY id),
dens AS (SELECT knn.id, 1.0 / (avg(greatest(dist, k_dist)) + 1e-10) AS density FROM knn JOIN kd ON kd.id = knn.other
  GROUP BY knn.id),
fac AS (SELECT knn.id, avg(o.density) / min(s.density) AS lof FROM knn JOIN dens o ON o.id = knn.other
  JOIN dens s ON s.id = knn.id GROUP BY knn.id),
cuts AS (SELECT min(lof) AS lo, max(lof) AS hi, quantile_cont(-lof, {contamination}) AS cut FROM fac),
scored AS (SELECT id AS row_key, round((lof - lo) / (hi - lo), 4) AS anomaly_score, -lof < cut AS is_anomaly,
  round(lof, 4) AS raw_score FROM fac, cuts)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def oracle_sql() -> dict[str, str]:
    events = cells("events", "event_id", ["value"])
    out = {
        # sources
        "csv_round_trip": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
                          "strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders",
        "null_tokens": "SELECT event_id, CASE WHEN event_type NOT IN ('error', 'click', 'view') THEN event_type END "
                       "AS label FROM events",
        "valid_orders": "SELECT o_orderkey, o_totalprice FROM orders",
        "files_accepted": _KNOWN + "SELECT doc_id, source AS user_id FROM documents WHERE (source, sha256(text)) NOT IN "
                                   "(SELECT (source, h) FROM known)",
        "files_rejected": _KNOWN + "SELECT doc_id, source AS user_id FROM documents WHERE (source, sha256(text)) IN "
                                   "(SELECT (source, h) FROM known)",
        "row_index": "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 "
                     "AS row_index FROM orders",
        "formula_free_text": "SELECT conv_id, turn, trim(regexp_replace(trim(CASE WHEN role = 'user' THEN ' =+ -' "
                             "ELSE '@' END || text), '^(?:[=+@-]\\s*)+', '')) AS text FROM conversations",
        "preview_events": "SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 10",
        "findings_written": _with(merged()) + """SELECT 'a1' AS analysis_id, severity, count(*) AS n, count(*) AS open
          FROM findings WHERE severity = 'CRITICAL' GROUP BY severity
          UNION ALL SELECT 'a2', severity, count(*), count(*) FROM findings GROUP BY severity""",
        "findings_exported": _with(merged()) + "SELECT row_key, column_name, anomaly_score, severity, detection_method "
                                               "FROM findings",
        # profiling
        "profile_orders": _profile_sql("orders", {"o_custkey": True, "o_orderstatus": False, "o_totalprice": True,
                                                  "o_orderpriority": False}),
        "profile_lineitem": _profile_sql("lineitem", {
            "l_quantity": True, "l_extendedprice": True, "l_discount": True, "l_tax": True, "l_returnflag": False,
            "l_linestatus": False}),
        "types_of_visits": _with(VISITS) + " UNION ALL ".join(
            ["SELECT 'event_id' AS column_name, 'numeric' AS kind", "SELECT 'heart_rate', 'numeric'"]
            + [f"SELECT '{c}', CASE WHEN bool_and(try_cast({c} AS TIMESTAMP) IS NOT NULL) THEN 'datetime' ELSE "
               f"'categorical' END FROM visits WHERE {c} IS NOT NULL" for c in ("start_date", "end_date", "site")]),
        "missing_by_column": _with(VISITS, MISSING_COUNTS) + "SELECT column_name, missing_count FROM mc WHERE missing_count > 0",
        "missing_share": _with(VISITS, MISSING_COUNTS)
        + "SELECT round(sum(missing_count) / sum(rows) * 100, 6) AS missing_percent FROM mc",
        "missing_grades": _with(VISITS, MISSING_COUNTS) + """SELECT column_name, missing_count,
          round(missing_count / rows * 100, 4) AS percent, CASE WHEN missing_count / rows * 100 > 20 THEN 'severe'
          WHEN missing_count / rows * 100 > 5 THEN 'high' ELSE 'normal' END AS grade FROM mc WHERE missing_count > 0""",
        "imputed_visits": _with(VISITS) + """SELECT event_id, coalesce(heart_rate, (SELECT median(heart_rate) FROM visits))
          AS heart_rate, coalesce(weight, (SELECT median(weight) FROM visits)) AS weight,
          coalesce(site, (SELECT site FROM visits WHERE site IS NOT NULL GROUP BY site ORDER BY count(*) DESC, site LIMIT 1))
          AS site FROM visits""",
        "standard_parameters": _with(READINGS) + "SELECT event_id, parameter, concept FROM readings",
        # univariate
        "zscore_events": _with(events) + zscore_sql(),
        "zscore_documents": _with(cells("documents", "doc_id", ["n_chars"])) + zscore_sql(),
        "zscore_orders": _with(cells("orders", "o_orderkey", ["o_totalprice", "o_custkey"])) + zscore_sql(1.7),
        "zscore_lineitem": _with(LINE_CELLS) + lines(zscore_sql(1.7)),
        "iqr_events": _with(events) + iqr_sql(),
        "modified_zscore_events": _with(events) + MODIFIED,
        "percentile_bounds_events": _with(events) + PERCENTILE,
        "percentile_bounds_lineitem": _with(LINE_CELLS) + lines(PERCENTILE),
        "grubbs_statistics": _with(VISITS, cells("visits", "event_id", ["heart_rate", "systolic_bp", "weight"]))
        + """SELECT row_key, column_name, n, x AS extreme_value, round(g, 4) AS g FROM (
          SELECT row_key, column_name, n, x, abs(x - mean) / sd AS g, row_number() OVER (PARTITION BY column_name
          ORDER BY abs(x - mean) DESC, row_key) AS rn FROM cells JOIN st USING (column_name)) WHERE rn = 1""",
        "statistical_visits": _with(VISITS, VISIT_CELLS, BEST) + "SELECT * FROM best",
        # missing
        "missing_rates": _with(VISITS, MISSING_COUNTS) + RATES,
        "missing_values": _with(VISITS) + missing_cells_sql(),
        "impossible_visits": _with(VISITS) + IMPOSSIBLE,
        "missing_or_impossible": _with(VISITS, MISSING_COUNTS) + f"""SELECT column_name, method, count(*) AS n,
          round(sum(score), 4) AS score FROM (SELECT column_name, 'missing_rate' AS method, score FROM ({RATES})
          UNION ALL SELECT column_name, method, score FROM ({missing_cells_sql()})
          UNION ALL SELECT column_name, method, score FROM ({IMPOSSIBLE})) GROUP BY column_name, method""",
        "missing_streaks": _with(VISITS) + STREAKS,
        # rules
        "range_violations": _with(VISITS) + RANGES,
        "range_violations_long": _with(READINGS, LIMITS) + RANGES_LONG,
        "pressure_order": _with(VISITS) + PRESSURE,
        "dates_out_of_order": _with(VISITS)
        + f"SELECT row_key, column_name, method, score, anomaly_type, note FROM ({DATES})",
        "all_rules": _with(VISITS, ALL_RULES)
        + "SELECT column_name, method, anomaly_type, count(*) AS n FROM rules GROUP BY ALL",
        # longitudinal
        "weight_shifts": _with(VISITS) + "SELECT row_key, column_name, score, round(expected_min, 4) AS expected_min, "
                         f"round(expected_max, 4) AS expected_max FROM ({shift_sql(*VISIT_TIME, 'weight')})",
        "value_folds": "SELECT row_key, column_name, score, round(expected_min, 4) AS expected_min, round(expected_max, 4) "
                       f"AS expected_max FROM ({fold_sql('events', 'event_id', 'user_id', 'ts', 'value')})",
        "price_folds": "SELECT row_key, column_name, score, round(expected_min, 4) AS expected_min, round(expected_max, 4) "
                       f"AS expected_max FROM ({fold_sql('orders', 'o_orderkey', 'o_custkey', 'o_orderdate', 'o_totalprice')})",
        "repeated_temperatures": _with(VISITS) + "SELECT row_key, column_name, method, score, anomaly_type, note FROM "
                                 f"({repeat_sql(*VISIT_TIME, 'temperature')})",
        "repeated_by_slices": _with(VISITS) + "SELECT column_name, method, count(*) AS n, sum(row_key)::BIGINT AS keys FROM ("
        + " UNION ALL ".join([shift_sql(*VISIT_TIME, "weight"), repeat_sql(*VISIT_TIME, "weight"),
                              fold_sql(*VISIT_TIME, "temperature"), repeat_sql(*VISIT_TIME, "temperature")])
        + ") GROUP BY column_name, method",
        # duplicates
        "exact_copies": """SELECT doc_id AS row_key, first AS duplicate_of, 1.0::DOUBLE AS anomaly_score,
          'exact_duplicate' AS anomaly_type FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text, lang) AS first
          FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL) WHERE doc_id > first""",
        "exact_copies_with_nulls": _with(VISITS) + """SELECT event_id AS row_key, first AS duplicate_of FROM (
          SELECT event_id, min(event_id) OVER (PARTITION BY site, systolic_bp, weight) AS first FROM visits)
          WHERE event_id > first""",
        "near_copies_orders": near_sql("orders", "o_orderkey", ["o_custkey", "o_totalprice"], 2,
                                       ["o_custkey", "o_totalprice"]),
        "near_copies_parts": _with("p AS (SELECT *, length(p_name) AS width FROM part)")
        + near_sql("p", "p_partkey", ["p_size", "p_retailprice", "width"], 2, ["p_size", "p_retailprice", "width"]),
        "all_copies": _with(BALANCES, f"exact AS ({EXACT_CUSTOMERS})") + f"""SELECT row_key, duplicate_of,
          1.0::DOUBLE AS anomaly_score, 'exact_duplicate' AS anomaly_type FROM exact UNION ALL
          SELECT row_key, duplicate_of, anomaly_score, anomaly_type FROM
          ({near_sql('balances', 'c_custkey', ['c_nationkey', 'balance'], 2, ['c_nationkey', 'balance'])})
          WHERE row_key NOT IN (SELECT row_key FROM exact)""",
        # neighbours
        "lof_customers": _with(lof_ctes("SELECT c_custkey AS id, [c_custkey::DOUBLE, c_acctbal] AS v FROM customer"))
        + "SELECT * FROM scored",
        "sketched_profile_lineitem": " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count({c}) AS count, count(*) - count({c}) AS missing_count, " + (
                ", ".join(f"NULL::DOUBLE AS {k}" for k in ("mean", "std", "min", "max", "skewness", "kurtosis"))
                if c == "l_returnflag" else f"""round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
                round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max,
                round(avg(pow({c} - m, 3)) / pow(avg(pow({c} - m, 2)), 1.5), 4) AS skewness,
                round(avg(pow({c} - m, 4)) / pow(avg(pow({c} - m, 2)), 2) - 3, 4) AS kurtosis""")
            + ", true AS unique_close FROM lineitem" + (
                "" if c == "l_returnflag" else f", (SELECT avg({c})::DOUBLE AS m FROM lineitem)")
            for c in ("l_quantity", "l_extendedprice", "l_discount", "l_returnflag")),
        "sketched_quantiles_lineitem": """SELECT column_name, q::DOUBLE AS q, true AS close FROM
            (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount')) c(column_name),
            (VALUES (0.01), (0.25), (0.5), (0.75), (0.99)) v(q)""",
        "sketched_bounds_lineitem": """SELECT column_name, true AS close
            FROM (VALUES ('l_extendedprice'), ('l_orderkey')) c(column_name)""",
        "ingested_files": """
          SELECT 'a_nation' AS file, ',' AS delimiter, 'n_nationkey,n_name,n_regionkey' AS header, count(*) AS rows,
            0::BIGINT AS bad_lines, 'n_nationkey=long,n_name=string,n_regionkey=long' AS types,
            'n_nationkey=0,n_name=0,n_regionkey=0' AS missing, least(10, count(*)) AS previewed,
            arg_min(n_name, n_nationkey) AS cell, NULL::VARCHAR AS problem, 'stored' AS duplicate_of FROM nation
          UNION ALL SELECT f, ';', 'r_regionkey,r_name', count(*), 0, 'r_regionkey=long,r_name=string',
            'r_regionkey=0,r_name=0', least(10, count(*)), arg_min(r_name, r_regionkey), NULL, any_value(d)
            FROM region, (VALUES ('b_region', NULL), ('c_copy', 'b_region')) v(f, d) GROUP BY f
          UNION ALL SELECT 'd_supplier', ',', 's_suppkey,label,good', count(*), 0, 's_suppkey=long,label=string,good=boolean',
            's_suppkey=0,label=' || count(*) FILTER (s_suppkey % 3 = 0) || ',good=' || count(*) FILTER (s_acctbal IS NULL),
            least(10, count(*)), first(CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'a "quoted", name ' || s_suppkey END
            ORDER BY s_suppkey), NULL, NULL FROM supplier
          UNION ALL SELECT 'e_customer', chr(9), 'c_custkey,c_acctbal', count(*), 0, 'c_custkey=long,c_acctbal=double',
            'c_custkey=0,c_acctbal=' || count(*) FILTER (c_custkey % 4 = 0), least(10, count(*)),
            first(CASE WHEN c_custkey % 4 > 0 THEN c_acctbal END::VARCHAR ORDER BY c_custkey), NULL, NULL FROM customer
          UNION ALL SELECT 'f_none', '|', 'r_regionkey,r_name', 0, 0, NULL, NULL, NULL, NULL,
            'Uploaded CSV file contains no data rows', NULL
          UNION ALL SELECT 'g_part.csv', ',', 'p_partkey,p_size', count(*) FILTER (p_partkey % 5 > 0),
            count(*) FILTER (p_partkey % 5 = 0), 'p_partkey=long,p_size=long', 'p_partkey=0,p_size=0', 10,
            arg_min(p_size, p_partkey) FILTER (p_partkey % 5 > 0)::VARCHAR, NULL, NULL FROM part""",
        **dict.fromkeys(("marks_on_read", "marks_compacted"), _with(merged()) + """
          SELECT analysis_id, severity, is_reviewed, review_note, is_false_positive, count(*) AS n FROM (
            SELECT a AS analysis_id, severity, a <> 'a3' AND top AS is_reviewed, CASE WHEN a = 'a1' AND top AND row_key % 2 = 0
              THEN 'second' WHEN a <> 'a3' AND top THEN 'first' END AS review_note, a = 'a1' AND top AND row_key % 2 = 0
              AS is_false_positive
            FROM (SELECT *, severity IN ('CRITICAL', 'HIGH') AS top FROM findings), (VALUES ('a1'), ('a2'), ('a3')) v(a))
          GROUP BY ALL"""),
        "ranges_by_study": _with(VISITS) + """SELECT event_id AS row_key, column_name,
            CASE WHEN x < cl OR x > ch THEN 1.0 ELSE 0.8 END::DOUBLE AS score, low AS expected_min, high AS expected_max,
            CASE WHEN x < cl OR x > ch THEN 'critical_physiological_range' ELSE 'out_of_physiological_range' END AS anomaly_type,
            CASE WHEN x < cl THEN 'Critical low value ' || t || ' ' || unit || ' is below safety threshold (' || clt || ').'
                 WHEN x > ch THEN 'Critical high value ' || t || ' ' || unit || ' is above safety threshold (' || cht || ').'
                 ELSE 'Out-of-range physiological value ' || t || ' ' || unit || ' (expected [' || lt || '-' || ht || ']).' END
              AS note
          FROM (SELECT v.event_id, c.column_name, CASE c.column_name WHEN 'weight' THEN weight ELSE heart_rate END AS x,
                       CASE WHEN c.column_name = 'weight' THEN 'all' WHEN event_type IN ('view', 'click') THEN event_type
                            ELSE 'all' END AS study
                FROM visits v JOIN events USING (event_id), (VALUES ('heart_rate'), ('weight')) c(column_name)) y
          JOIN (VALUES ('view', 'heart_rate', 20, 60, 'bpm', 5, NULL, '20', '60', '5', NULL),
                       ('click', 'heart_rate', 10, 90, 'bpm', NULL, 120, '10', '90', NULL, '120'),
                       ('all', 'heart_rate', 15, 80, 'bpm', 2.5, 110, '15', '80', '2.5', '110'),
                       ('all', 'weight', 55, 140, 'kg', NULL, NULL, '55', '140', NULL, NULL))
               r(study, column_name, low, high, unit, cl, ch, lt, ht, clt, cht) USING (study, column_name),
          LATERAL (SELECT x::VARCHAR AS t) z
          WHERE x < low OR x > high OR x < cl OR x > ch""",
        "scores_by_table": _with(VISITS, VISIT_CELLS) + " UNION ALL ".join(
            f"SELECT row_key, column_name, method, score, expected_min, expected_max FROM ({part})"
            for part in (zscore_sql(), iqr_sql(), MODIFIED, PERCENTILE)),
        "stream_living_baseline": """WITH s AS (SELECT count(value) AS n, avg(value) AS m, stddev_samp(value) AS sd,
            median(value) AS med, (SELECT median(abs(value - (SELECT median(value) FROM events))) FROM events) AS mad FROM events),
          e AS (SELECT event_id, value, m * f AS m, sd * f AS sd, med * f AS med, mad * f AS mad, lo, hi FROM events, s,
                (VALUES (0, 1.0::DOUBLE, 5.0::DOUBLE, 90.0::DOUBLE), (1, 0.5, 10.0, 50.0)) h(part, f, lo, hi)
                WHERE event_id % 2 = part)
          SELECT event_id AS row_key, 'zscore' AS method, round(least(abs((value - m) / sd) / 6.0, 1.0), 4) AS score,
            round(m - 3 * sd, 4) AS expected_min FROM e WHERE abs((value - m) / sd) > 3
          UNION ALL SELECT event_id, 'modified_zscore', round(least(abs(0.6745 * (value - med) / mad) / 7.0, 1.0), 4), NULL
            FROM e WHERE abs(0.6745 * (value - med) / mad) > 3.5
          UNION ALL SELECT event_id, 'range_rules', 0.8, lo FROM e WHERE value < lo OR value > hi""",
        **dict.fromkeys(("isolation_properties", "reconstruction_properties"), """SELECT count(*) AS n, 0.0::DOUBLE AS lowest,
          1.0::DOUBLE AS highest, true AS share_close, true AS apart FROM lineitem"""),
        "stream_usage": """SELECT user_id, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, used, greatest(0, 1 - used) AS remaining
          FROM (SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS used FROM events GROUP BY ALL),
               (SELECT max(ts) AS last FROM events)
          WHERE used > 1 AND hour + INTERVAL 1 HOUR <= last - INTERVAL 10 MINUTE""",
        "lof_embeddings": _with(lof_ctes("SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings"))
        + "SELECT * FROM scored",
        "lof_embeddings_approximate": _with(lof_ctes("SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings"))
        + "SELECT * FROM scored",
        "lof_neighbour_recall": "SELECT count(DISTINCT embedding) AS vectors, 20::BIGINT AS k, true AS recalled FROM embeddings",
        "row_scores_on_cells": _with(lof_ctes("SELECT c_custkey AS id, [c_custkey::DOUBLE, c_acctbal] AS v FROM customer"))
        + """SELECT row_key, 'c_custkey' AS column_name, CAST(row_key AS VARCHAR) AS value, anomaly_score AS score
          FROM scored WHERE is_anomaly UNION ALL SELECT row_key, 'c_acctbal', CAST(c_acctbal AS VARCHAR), anomaly_score
          FROM scored JOIN customer ON c_custkey = row_key WHERE is_anomaly""",
        "duplicate_scores_on_cells": _with(BALANCES, f"exact AS ({EXACT_CUSTOMERS})")
        + """SELECT row_key, column_name, 1.0::DOUBLE AS score, 'Row is a duplicate of row ' || duplicate_of || '.' AS note
          FROM exact, (VALUES ('c_nationkey'), ('balance')) v(column_name)""",
        # merge
        "collected_scores": _with(merged()) + "SELECT row_key, column_name, s1 AS statistical, s2 AS clinical_rules, "
                                              "s3 AS missing_data FROM scores",
        "ensemble_scores": _with(merged()) + "SELECT row_key, column_name, anomaly_score, severity FROM findings",
        "ensemble_max_conflict": _with(merged("max")) + "SELECT row_key, column_name, anomaly_score, severity FROM findings",
        "decorated_findings": _with(merged()) + """SELECT row_key, column_name, subject_id, value,
          round(expected_range_min, 4) AS expected_range_min, round(expected_range_max, 4) AS expected_range_max, z_score,
          detection_method, anomaly_type FROM findings""",
        "detector_counts": _with(merged()) + """SELECT algorithm, status, count(algo) AS flagged, failed FROM
          (VALUES ('statistical', 'completed', NULL), ('clinical_rules', 'completed', NULL),
                  ('missing_data', 'completed', NULL), ('ages', 'completed', NULL), ('sensors', 'failed', true)
          ) v(algorithm, status, failed) LEFT JOIN (SELECT algo FROM hits UNION ALL SELECT 'ages' FROM visits WHERE age > 150)
          ON algo = algorithm GROUP BY algorithm, status, failed""",
        "own_detector_findings": _with(merged(), OWN) + """SELECT row_key, column_name, anomaly_score, severity,
          detection_method, anomaly_type FROM own""",
        "own_detector_summary": _with(merged(), OWN, SUMMARY.replace("findings", "own")) + "SELECT section, name, n FROM summary",
        "stored_records": _with(merged()) + """SELECT * FROM (SELECT 'whole' AS analysis_id, 'visits' AS dataset_id,
          'COMPLETED' AS status, max(v.rows) AS total_rows, count(*) AS total_anomalies,
          count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
          count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low,
          greatest(0.0, round(100.0 - 5.0 * critical - 2.0 * high - 0.5 * (medium + low), 2))::DOUBLE AS quality_score,
          round(total_anomalies / total_rows * 100, 2) AS anomaly_rate_percent, NULL::BOOLEAN AS failed, true AS timed
          FROM findings, (SELECT count(*) AS rows FROM visits) v) UNION ALL SELECT 'broken', 'visits', 'FAILED', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, true,
          true""",
        "stored_report": _with(merged(), SUMMARY, f"advice AS ({ADVICE})") + """
          SELECT 'summary' AS section, 'whole' AS name, count(*)::VARCHAR AS value FROM findings
          UNION ALL SELECT 'severity', severity, count(*)::VARCHAR FROM findings GROUP BY severity
          UNION ALL SELECT 'finding', severity, count(*)::VARCHAR FROM findings GROUP BY severity
          UNION ALL SELECT 'algorithm', algo, count(*)::VARCHAR FROM hits GROUP BY algo
          UNION ALL SELECT 'column', 'heart_rate', count(heart_rate)::VARCHAR FROM visits
          UNION ALL SELECT 'column', 'systolic_bp', count(systolic_bp)::VARCHAR FROM visits
          UNION ALL SELECT 'column', 'weight', count(weight)::VARCHAR FROM visits
          UNION ALL SELECT 'column', 'temperature', count(temperature)::VARCHAR FROM visits
          UNION ALL SELECT 'advice', position::VARCHAR, recommendation FROM advice
          UNION ALL SELECT * FROM (VALUES ('in order', 'whole', 'true'), ('dashboard', 'analyses', '3'),
            ('newest', 'whole', 'COMPLETED'), ('newest', 'younger', 'COMPLETED'), ('newest', 'broken', 'FAILED'),
            ('timed', 'whole', 'true'), ('timed', 'younger', 'true'), ('timed', 'broken', 'true'))""",
        "finding_summary": _with(merged(), SUMMARY) + "SELECT section, name, n FROM summary",
        "quality_of_visits": _with(merged()) + quality_sql("findings", "visits"),
        "quality_of_documents": _with(cells("documents", "doc_id", ["n_chars"]), f"""f AS (SELECT *, CASE
          WHEN score >= 0.8 THEN 'CRITICAL' WHEN score >= 0.6 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
          FROM ({zscore_sql(8.0)}) WHERE score >= 0.3)""") + quality_sql("f", "documents"),
        "advice": _with(merged(), SUMMARY) + ADVICE,
        "suggested_actions": _with(merged()) + f"SELECT row_key, column_name, {ACTION} AS suggested_action FROM findings",
        "context_texts": _with(VISITS) + f"SELECT event_id, {_context('heart_rate', '20.0', '100.0', q('heart_rate'))} "
                                         "AS context FROM visits WHERE heart_rate IS NOT NULL",
        "explained_findings": _with(merged()) + f"""SELECT row_key, column_name, coalesce(value, 'NaN') AS value,
          {SIGNIFICANCE} AS clinical_significance FROM findings""",
        "score_sentences": _with(merged()) + f"""SELECT row_key, column_name, 'Value ' || CAST(value_num AS VARCHAR)
          || ' in column ''' || column_name || ''' flagged by ' || n_methods || ' method(s) (' || {_CLEAN}
          || ') with an anomaly confidence of 50.0%.' || CASE WHEN value_num < expected_range_min OR
          value_num > expected_range_max THEN ' This is outside the expected normal range of ['
          || printf('%.2f', expected_range_min) || ' to ' || printf('%.2f', expected_range_max) || '].' ELSE '' END
          AS score_text FROM findings WHERE value_num IS NOT NULL""",
        # stored results
        "filtered_findings": _with(STORED) + "SELECT analysis_id, row_key, column_name, anomaly_score FROM stored "
                                             "WHERE severity = 'CRITICAL' AND NOT is_reviewed",
        "findings_by_method": _with(STORED) + """SELECT analysis_id, row_key, column_name, anomaly_score FROM stored
          WHERE list_contains(string_split(detection_method, ', '), 'clinical_rules') AND is_false_positive
          AND anomaly_score >= 0.5""",
        "dataset_search": _with(DATASETS) + "SELECT dataset_id, name, original_filename FROM datasets WHERE "
                                            "name ILIKE '%build%' OR original_filename ILIKE '%build%'",
        "owned_findings": _with(STORED, ANALYSES) + "SELECT analysis_id, row_key, column_name FROM stored WHERE "
                                                    "analysis_id IN (SELECT analysis_id FROM analyses WHERE user_id = 7)",
        "findings_page": _with(merged()) + """SELECT row_key, column_name, anomaly_score, (SELECT count(*) FROM findings)
          AS total, ceil((SELECT count(*) FROM findings) / 50.0)::BIGINT AS total_pages FROM findings
          ORDER BY anomaly_score DESC, row_key, column_name LIMIT 50 OFFSET 100""",
        "findings_counts": _with(STORED) + """SELECT 'severity' AS section, severity AS name, count(*) AS n FROM stored
          GROUP BY severity UNION ALL SELECT 'column', column_name, count(*) FROM stored GROUP BY column_name
          UNION ALL SELECT 'method', detection_method, count(*) FROM stored GROUP BY detection_method""",
        "reviewed_findings": _with(STORED, "hit AS (SELECT DISTINCT analysis_id, row_key, column_name, TRUE AS h FROM stored "
                                           "WHERE severity = 'CRITICAL')")
        + """SELECT severity, CASE WHEN h THEN TRUE ELSE is_reviewed END AS is_reviewed,
          CASE WHEN h THEN 'checked' ELSE review_note END AS review_note, count(*) AS n
          FROM stored LEFT JOIN hit USING (analysis_id, row_key, column_name) GROUP BY ALL""",
        "false_positives": _with(STORED, "hit AS (SELECT analysis_id, row_key, column_name, bool_or(severity = 'HIGH') AS h "
                                         "FROM stored WHERE severity IN ('HIGH', 'LOW') GROUP BY ALL)")
        + """SELECT severity, CASE WHEN h THEN TRUE ELSE is_reviewed END AS is_reviewed,
          coalesce(h, is_false_positive) AS is_false_positive, count(*) AS n
          FROM stored LEFT JOIN hit USING (analysis_id, row_key, column_name) GROUP BY ALL""",
        "dataset_listing": _with(DATASETS) + "SELECT dataset_id, name, user_id FROM datasets WHERE NOT is_archived",
        "analysis_listing": _with(ANALYSES) + "SELECT analysis_id, dataset_id, user_id, status FROM analyses "
                                              "WHERE status = 'COMPLETED'",
        "dashboard": _with(DATASETS, ANALYSES, STORED) + """SELECT
          (SELECT count(*) FROM datasets WHERE user_id = 7 AND NOT is_archived) AS total_datasets,
          (SELECT count(*) FROM analyses WHERE user_id = 7) AS total_analyses,
          (SELECT round(coalesce(avg(quality_score), 0), 1) FROM analyses WHERE user_id = 7 AND status = 'COMPLETED')
            AS avg_quality_score,
          (SELECT count(*) FROM stored JOIN analyses USING (analysis_id) WHERE user_id = 7) AS total_anomalies""",
        "newest_anomalies": _with(ANALYSES, STORED) + """SELECT s.row_key, s.column_name, s.severity FROM stored s
          JOIN analyses USING (analysis_id) WHERE user_id = 7 ORDER BY s.created_at DESC, s.row_key, s.column_name LIMIT 10""",
        "newest_analyses": _with(ANALYSES, DATASETS) + """SELECT a.analysis_id, a.status, round(a.quality_score, 4)
          AS quality_score, coalesce(d.name, 'Dataset') AS dataset_name FROM analyses a LEFT JOIN datasets d USING (dataset_id)
          WHERE a.user_id = 7 ORDER BY a.created_at DESC, a.analysis_id LIMIT 5""",
        "findings_per_day": _with(STORED) + """SELECT strftime(d, '%Y-%m-%d') AS day, count(s.analysis_id) AS n FROM
          (SELECT unnest(generate_series(DATE '1998-12-02', DATE '1998-12-31', INTERVAL 1 DAY))::DATE AS d)
          LEFT JOIN stored s ON s.created_at::DATE = d GROUP BY d""",
        "platform_counts": _with(DATASETS, ANALYSES, STORED) + """SELECT (SELECT count(*) FROM nation) AS total_users,
          (SELECT count(*) FROM nation WHERE n_regionkey <> 0) AS active_users,
          (SELECT count(*) FROM datasets) AS total_datasets, (SELECT count(*) FROM analyses) AS total_analyses,
          (SELECT count(*) FROM stored) AS total_anomalies_detected""",
        "user_page": "SELECT n_nationkey AS user_id, n_name AS name FROM nation ORDER BY n_nationkey DESC LIMIT 10 OFFSET 5",
        "busiest_columns": _with(STORED) + "SELECT column_name, count(*) AS n FROM stored GROUP BY column_name "
                                           "ORDER BY n DESC, column_name LIMIT 10",
        "severity_shares": _with(STORED) + """SELECT CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1
          WHEN 'MEDIUM' THEN 2 ELSE 3 END AS position, severity, count(*) AS n FROM stored GROUP BY severity""",
        "severity_counts": _with(STORED) + """SELECT s AS severity, count(f.severity) AS n FROM
          (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) v(s)
          LEFT JOIN stored f ON f.severity = s GROUP BY s""",
        "method_counts": _with(STORED) + """SELECT m AS method, count(*) AS n FROM (
          SELECT unnest(string_split(detection_method, ', ')) AS m FROM stored) GROUP BY m""",
        "column_counts": _with(STORED) + "SELECT column_name, count(*) AS n FROM stored GROUP BY column_name",
        "heart_rate_trend": _with(VISITS, cells("visits", "event_id", ["heart_rate"]), f"f AS ({zscore_sql()})")
        + """SELECT event_id AS row_key, CAST(age AS VARCHAR) AS timepoint, coalesce(heart_rate, 0.0) AS value,
          event_id IN (SELECT row_key FROM f) AS is_anomaly, CAST(subject_id AS VARCHAR) AS subject_id,
          round(mean - 3 * sd, 4) AS expected_min, round(mean + 3 * sd, 4) AS expected_max FROM visits, st""",
        "price_histogram": _with(cells("orders", "o_orderkey", ["o_totalprice"]), f"f AS ({zscore_sql(1.7)})") + """,
          w AS (SELECT lo, (hi - lo) / 20 AS width FROM st),
          b AS (SELECT least(floor((o_totalprice - lo) / width)::INTEGER, 19) AS bin,
            o_orderkey IN (SELECT row_key FROM f) AS flagged FROM orders, w)
          SELECT i::INTEGER AS bin, round(lo + i * width, 4) AS low, round(lo + (i + 1) * width, 4) AS high,
            count(bin) AS n, coalesce(bool_or(flagged), FALSE) AS is_anomaly
          FROM range(20) r(i) CROSS JOIN w LEFT JOIN b ON bin = i GROUP BY i, lo, width""",
        "report_findings": _with(merged()) + f"""SELECT row_key, column_name[1:20] AS column_name,
          coalesce(value, 'NaN')[1:15] AS value, round(anomaly_score, 2) AS anomaly_score, severity,
          detection_method[1:15] AS detection_method, ({ACTION})[1:25] AS suggested_action
          FROM findings f ORDER BY f.anomaly_score DESC, row_key, f.column_name LIMIT 200""",
        "report_statistics": _with(VISITS) + " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count({c}) AS count, round((count(*) - count({c})) / count(*) * 100, 2) "
            f"AS missing_percent, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std, round(min({c}), 3) AS min, "
            f"round(max({c}), 3) AS max FROM visits" for c in ("heart_rate", "weight", "temperature")),
        "quality_bands": _with(ANALYSES) + """SELECT analysis_id,
          CASE WHEN quality_score < 60 THEN 'red' WHEN quality_score < 80 THEN 'amber' ELSE 'green' END AS report,
          CASE WHEN quality_score >= 70 THEN 'green' WHEN quality_score >= 40 THEN 'amber' ELSE 'red' END AS screen,
          CASE WHEN quality_score >= 90 THEN 'Excellent' WHEN quality_score >= 75 THEN 'Good'
               WHEN quality_score >= 60 THEN 'Fair' ELSE 'Poor' END AS label FROM analyses""",
        "run_durations": _with(ANALYSES) + "SELECT analysis_id, round(seconds, 2) AS duration_seconds FROM analyses",
        "usage_breaches": """SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour,
          count(*) AS used, greatest(0, 1 - count(*)) AS remaining FROM events GROUP BY user_id, date_trunc('hour', ts)
          HAVING count(*) > 1""",
        "stream_scores": _with(events) + f"{zscore_sql()} UNION ALL {iqr_sql()}",
    }
    out["price_histogram"] = out["price_histogram"].replace("\n,\n", ",\n", 1)
    return out


_KNOWN = """WITH known AS (SELECT source, sha256(text) AS h FROM documents WHERE doc_id IN (
  SELECT doc_id FROM labels WHERE quality = 1) AND lang <> 'de')
"""


def _profile_sql(source: str, cols: dict[str, bool]) -> str:
    parts = []
    for c, numeric in cols.items():
        if numeric:
            x = f"{c}::DOUBLE"
            stats = (f"round(avg({x}), 4) AS mean, round(median({x}), 4) AS median, round(stddev_samp({x}), 4) AS std, "
                     f"round(min({x}), 4) AS min, round(max({x}), 4) AS max, round(quantile_cont({x}, 0.25), 4) AS q25, "
                     f"round(quantile_cont({x}, 0.75), 4) AS q75, (SELECT round(avg(pow({x} - m, 3)) / pow(any_value(sp), 3), 4) "
                     f"FROM {source}, (SELECT avg({x}) AS m, stddev_pop({x}) AS sp FROM {source})) AS skewness, "
                     f"round(kurtosis_pop({x}), 4) AS kurtosis")
        else:
            stats = ", ".join(f"NULL::DOUBLE AS {s}" for s in (
                "mean", "median", "std", "min", "max", "q25", "q75", "skewness", "kurtosis"))
        parts.append(f"SELECT '{c}' AS column_name, count({c}) AS count, count(*) - count({c}) AS missing_count, "
                     f"round((count(*) - count({c})) / count(*) * 100, 2) AS missing_percent, "
                     f"count(DISTINCT {c}) AS unique_count, {stats} FROM {source}")
    return " UNION ALL ".join(parts)
