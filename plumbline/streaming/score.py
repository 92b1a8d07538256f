"""Scoring a stream against the statistics of a reference table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.by_table import all_hits
from ..operators.results import usage_per_hour
from ..operators.rules import range_rules
from ..operators.univariate import METHODS, ColumnStats, column_stats, iqr, modified_zscore, percentile_bounds, zscore

BASELINE_SCHEMA = ("column_name string, n long, mean double, std double, min double, max double, p01 double, "
                   "q25 double, median double, q75 double, p99 double, mad double")
_QUANTILES = {0.01: "p01", 0.25: "q25", 0.5: "median", 0.75: "q75", 0.99: "p99"}


def baseline(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per column with everything the univariate tests need; store it next to the table."""
    stats = column_stats(df, cols, tuple(_QUANTILES), mad=True)
    rows = [(c, s.n, s.mean, s.std, s.min, s.max, *[s.quantile.get(q) for q in _QUANTILES], s.mad)
            for c, s in stats.items()]
    return df.sparkSession.createDataFrame(rows, BASELINE_SCHEMA)


def load_baseline(table: DataFrame) -> dict[str, ColumnStats]:
    out = {}
    for r in table.collect():  # one row per column
        out[r["column_name"]] = ColumnStats(
            n=r["n"], mean=r["mean"], std=r["std"], min=r["min"], max=r["max"], mad=r["mad"],
            quantile={q: r[name] for q, name in _QUANTILES.items() if r[name] is not None})
    return out


def score_stream(stream: DataFrame, key, base: DataFrame, methods=("zscore", "iqr"), col_map=None, rules=None,
                 subject_col=None) -> DataFrame:
    """Hits of a stream (or table) against a baseline. Stateless: use append mode."""
    stats = load_baseline(base)
    cols = [c for c in stats if c in stream.columns]
    tests = dict(zip(METHODS, (zscore, iqr, modified_zscore, None, percentile_bounds)))
    out = None
    for m in methods:
        hits = tests[m](stream, key, cols, subject_col=subject_col, stats=stats)
        out = hits if out is None else out.unionByName(hits)
    if col_map:
        hits = range_rules(stream, key, col_map, rules, subject_col)
        out = hits if out is None else out.unionByName(hits)
    return out


def score_arrivals(stream: DataFrame, key, base_path: str, out: str, checkpoint: str, rules_path: str | None = None,
                   concepts=None, methods=("zscore", "modified_zscore"), study_col=None, subject_col=None) -> None:
    """Score everything that has arrived against the baseline and rules as they are stored now, and stop.

    Called again, it goes on behind what it has scored before (the checkpoint knows), with the tables as they are then: they
    are the static sides of joins and are read anew by every call, so a new baseline takes effect without a new stream.
    """
    spark = stream.sparkSession
    rules = spark.read.parquet(rules_path) if rules_path else None
    hits = all_hits(stream, key, spark.read.parquet(base_path), rules, concepts, methods, study_col, subject_col)
    run = (hits.writeStream.outputMode("append").format("parquet").option("path", out)
           .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    run.awaitTermination()


def usage_stream(events: DataFrame, user_col: str, time_col: str, per_hour: int = 5,
                 late: str = "10 minutes") -> DataFrame:
    """User hours over the limit, emitted when the watermark closes the hour."""
    return usage_per_hour(events.withWatermark(time_col, late), user_col, time_col, per_hour).where(f"used > {per_hour}")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything that has arrived into parquet files and read them back."""
    spark: SparkSession = stream.sparkSession
    query = (stream.writeStream.outputMode("append").format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
