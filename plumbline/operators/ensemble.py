"""Merging hits into one scored finding per cell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import number_sql, numeric_columns, row_key, scalar_columns
from ..functions.text import sql_text
from .hits import ALGORITHMS, Sql, hit, subject, text_of, written
from .vocabulary import ENSEMBLE_WEIGHTS, OTHER_WEIGHT, SEVERITY_LEVELS

# Which detector's text and type describe the cell when several flagged it.
NOTE_ORDER = ["duplicates", "missing_data", "clinical_rules"]
KIND_ORDER = NOTE_ORDER + ["statistical"]


def weight_of(algo: str, weights=None) -> float:
    return (weights or ENSEMBLE_WEIGHTS).get(algo, OTHER_WEIGHT)


def severity(score: Column) -> Column:
    """CRITICAL, HIGH, MEDIUM or LOW for an unrounded combined score."""
    chain = F
    for label, least in SEVERITY_LEVELS[:-1]:
        chain = chain.when(score >= least, label)
    return chain.otherwise(SEVERITY_LEVELS[-1][0])


def collect_hits(hits: DataFrame, conflict: str = "last", algorithms=None) -> DataFrame:
    """One row per cell with one struct column per detector; the only shuffle of the merge.

    Several hits of one detector on a cell: the last in rule order stays (``conflict="last"``),
    or the highest score (``"max"``).
    """
    algorithms = algorithms or ALGORITHMS
    rank = ["seq", "score"] if conflict == "last" else ["score", "seq"]
    detail = F.struct(*rank, "z_score", "expected_min", "expected_max", "anomaly_type", "note")
    return hits.groupBy("row_key", "column_name").agg(
        F.max("subject_id").alias("subject_id"), F.max("value").alias("value"), F.max("value_num").alias("value_num"),
        *[F.max(F.when(F.col("algo") == a, detail)).alias(a) for a in algorithms])


def combined_score(scores: dict[str, Column], weights=None) -> Column:
    """Weighted mean over the detectors that flagged the cell, clamped to [0, 1]."""
    terms = [(s, weight_of(a, weights)) for a, s in scores.items()]
    zero = F.lit(0.0)
    total = reduce(lambda p, q: p + q, [F.when(s.isNotNull(), s * w).otherwise(zero) for s, w in terms])
    weight = reduce(lambda p, q: p + q, [F.when(s.isNotNull(), F.lit(w)).otherwise(zero) for s, w in terms])
    return F.when(weight > 0, F.least(F.lit(1.0), F.greatest(zero, total / weight))).otherwise(zero)


def ensemble(hits: DataFrame, weights=None, min_score: float = 0.3, conflict: str = "last",
             algorithms=None) -> DataFrame:
    """Findings before explanation: score, severity, methods, type, range and note per cell."""
    algorithms = algorithms or ALGORITHMS
    cells = collect_hits(hits, conflict, algorithms).withColumn(
        "combined", combined_score({a: F.col(a)["score"] for a in algorithms}, weights))

    own = [a for a in algorithms if a not in ALGORITHMS]  # detectors of the caller speak after the built-in ones

    def first_of(field, order):
        return F.coalesce(*[F.col(a)[field] for a in order + own if a in algorithms])

    methods = F.array_compact(F.array(*[F.when(F.col(a).isNotNull(), a) for a in algorithms]))
    ranged = [a for a in ("clinical_rules", "statistical") if a in algorithms]
    has_range = [F.when(F.col(a)["expected_min"].isNotNull(), F.col(a)) for a in ranged]

    def bound(field):
        return F.coalesce(*[s[field] for s in has_range]) if ranged else F.lit(None).cast("double")

    z = F.col("statistical")["z_score"] if "statistical" in algorithms else F.lit(None).cast("double")
    return cells.where(F.col("combined") >= min_score).select(
        "row_key", "column_name", "subject_id", "value", "value_num",
        bound("expected_min").alias("expected_range_min"), bound("expected_max").alias("expected_range_max"),
        z.alias("z_score"), F.col("combined"), F.round("combined", 4).alias("anomaly_score"),
        severity(F.col("combined")).alias("severity"), methods.alias("methods"),
        F.concat_ws(", ", methods).alias("detection_method"),
        F.coalesce(first_of("anomaly_type", KIND_ORDER), F.lit("multivariate_outlier")).alias("anomaly_type"),
        first_of("note", NOTE_ORDER).alias("note"))


def cells_of(df: DataFrame, cols: list[str]) -> Column:
    """The named cells of a row as an array of (name, text, number), to be carried along."""
    numeric = set(numeric_columns(df))
    parts = [f"named_struct('name', {sql_text(c)}, 'text', CAST({text_of(df, c) or 'NULL'} AS STRING), "
             f"'num', CAST({number_sql(df, c) if c in numeric else 'NULL'} AS DOUBLE))" for c in cols]
    return F.expr(f"array({', '.join(parts)})").alias("cells")


def attribute_rows(scores: DataFrame, algo: str) -> DataFrame:
    """Spread the score of each flagged row over its cells; a projection, no join.

    ``scores`` is the output of a row detector run with ``carry=[subject(...), cells_of(...)]``.
    """
    h = hit(Sql("c.name"), algo, algo, "anomaly_score", "c.text", "c.num", kind="multivariate_outlier")
    return written(scores.where("is_anomaly").withColumn("c", F.explode("cells"))
                   .selectExpr("row_key", "subject_id", f"inline(array({h}))"))


def attribute_duplicates(df: DataFrame, key, duplicates: DataFrame, subject_col=None) -> DataFrame:
    """Put a duplicate row's score on every column that matched."""
    keyed = df.select(row_key(key).alias("row_key"), subject(subject_col), cells_of(df, scalar_columns(df)))
    h = hit(Sql("c.name"), "duplicates", Sql("anomaly_type"), "anomaly_score", "c.text", "c.num",
            kind=Sql("anomaly_type"),
            note=Sql("concat('Row is a duplicate of row ', CAST(duplicate_of AS STRING), '.')"))
    matched = F.expr("filter(cells, c -> array_contains(columns_matching, c.name))")
    return written(keyed.join(duplicates, "row_key").withColumn("c", F.explode(matched))
                   .selectExpr("row_key", "subject_id", f"inline(array({h}))"))
