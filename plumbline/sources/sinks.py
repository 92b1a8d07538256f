"""Writing findings. Paths are Hadoop paths: ``file:``, ``hdfs:``, ``s3a:``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.results import export_rows
from .files import sanitize_formula


def write_findings(findings: DataFrame, path: str, analysis_id: str, created_at=None) -> None:
    """Replace the findings of one analysis; other analyses in the table stay as they are."""
    stamped = findings.withColumn("analysis_id", F.lit(analysis_id))
    defaults = {"is_reviewed": F.lit(False), "review_note": F.lit(None).cast("string"),
                "is_false_positive": F.lit(False),
                "created_at": F.current_timestamp() if created_at is None else F.lit(created_at).cast("timestamp")}
    for name, value in defaults.items():
        if name not in findings.columns:
            stamped = stamped.withColumn(name, value)
    (stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
     .partitionBy("analysis_id").parquet(path))


def write_reviews(findings: DataFrame, path: str) -> None:
    """Write back findings changed by review marks; read the old state from a different path or a snapshot."""
    (findings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("analysis_id").parquet(path))


RECORD_SCHEMA = ("analysis_id string, dataset_id string, user_id string, status string, created_at timestamp, "
                 "started_at timestamp, completed_at timestamp, total_rows long, total_anomalies long, critical long, "
                 "high long, medium long, low long, quality_score double, anomaly_rate_percent double, "
                 "processing_time_seconds double, error string")


def append_record(spark: SparkSession, record: dict, path: str) -> None:
    """Add the record of one run to the table of analyses: one small file, nothing is rewritten."""
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
    texts = {"analysis_id", "dataset_id", "user_id"}
    row = tuple(None if record.get(n) is None else str(record[n]) if n in texts else record[n] for n in names)
    spark.createDataFrame([row], RECORD_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all runs; of a run that was repeated under its name the last one counts."""
    latest = Window.partitionBy("analysis_id").orderBy(F.desc("completed_at"))
    rows = spark.read.schema(RECORD_SCHEMA).parquet(path).withColumn("__n", F.row_number().over(latest))
    return rows.where("__n = 1").drop("__n")


def write_detectors(algorithms: DataFrame, path: str, analysis_id: str) -> None:
    """Replace the per-detector results of one analysis."""
    (algorithms.withColumn("analysis_id", F.lit(analysis_id)).coalesce(1).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("analysis_id").parquet(path))


def write_sketches(sketches: DataFrame, path: str, by: list[str]) -> None:
    """Store the sketches of some parts; parts that are stored already are replaced, all others stay as they are."""
    (sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))


def export_csv(findings: DataFrame, path: str, sanitize: bool = False) -> None:
    """The 18 export fields as CSV part files in descending score order."""
    rows = export_rows(findings)
    rows = sanitize_formula(rows, ["subject_id", "value", "review_note"]) if sanitize else rows
    rows.write.mode("overwrite").option("header", True).csv(path)
