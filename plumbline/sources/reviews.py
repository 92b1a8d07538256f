"""Review marks as a durable upsert on stored findings.

Marks are only ever appended: a batch of marks is one new folder below ``marks``. Reading merges the marks that are not yet
compacted into the findings, so a mark is visible as soon as its batch is written. Compaction rewrites the analyses that
have marks, and no others: the merged rows are first written aside, then their folders take the place of the old ones,
then the batches are recorded as done. Every step is recorded in ``steps``; a compaction that was interrupted is taken up
at its last finished step, and doing a step again changes nothing.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunks import shuffles_removed

KEY = ["analysis_id", "row_key", "column_name"]
FIELDS = ["is_reviewed", "review_note", "is_false_positive"]
#: So many marked analyses are merged one after the other, so that only one is shuffled at a time.
ONE_BY_ONE = 16
STEPS = "step string, batch long, staged string"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
            return None
        raise


def append_marks(marks: DataFrame, path: str, batch: int | None = None) -> int:
    """Store a batch of marks: analysis_id, row_key, column_name, marked_at and any of is_reviewed, review_note,
    is_false_positive, null meaning unchanged. Returns the number of the batch; a batch that is stored again under its
    number replaces itself, so a failed append can be repeated."""
    batch = int(time.time() * 1e6) if batch is None else batch
    kinds = {"is_reviewed": "boolean", "review_note": "string", "is_false_positive": "boolean"}
    given = [F.col(f) if f in marks.columns else F.lit(None).cast(kinds[f]).alias(f) for f in FIELDS]
    marks.select(*KEY, "marked_at", *given).write.mode("overwrite").parquet(f"{path}/marks/batch={batch}")
    return batch


def _steps(spark: SparkSession, path: str) -> dict[str, tuple[int, str]]:
    """The last batch that each step has reached, and where the merged rows were put."""
    found = _read(spark, f"{path}/steps")
    if found is None:
        return {}
    last = found.groupBy("step").agg(F.max(F.struct("batch", "staged")).alias("m")).collect()  # one row a step
    return {r["step"]: (r["m"]["batch"], r["m"]["staged"]) for r in last}


def _record(spark: SparkSession, path: str, step: str, batch: int, staged: str) -> None:
    spark.createDataFrame([(step, batch, staged)], STEPS).coalesce(1).write.mode("append").parquet(f"{path}/steps")


def open_marks(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame | None:
    """One row for each finding with marks that are not compacted yet: the latest value of every field.

    The later ``marked_at`` counts, whenever its batch came; of equal times the later batch. The log is never cut, so a
    late batch with an old date is held against marks that are compacted already.
    """
    marks = _read(spark, f"{path}/marks")
    if marks is None:
        return None
    done = _steps(spark, path).get("done", (-1, ""))[0]
    marks = marks if upto is None else marks.where(F.col("batch") <= upto)
    when = F.struct("marked_at", "batch")
    return marks.groupBy(*KEY).agg(F.max("batch").alias("last"), *[
        F.max(F.when(F.col(f).isNotNull(), F.struct(when.alias("w"), F.col(f).alias("v")))).alias(f"__{f}")
        for f in FIELDS]).where(F.col("last") > done)


def merged(findings: DataFrame, marks: DataFrame | None) -> DataFrame:
    """``findings`` with the marked fields replaced; a mark without a finding changes nothing."""
    if marks is None:
        return findings
    marks = marks.select(*[F.col(c).alias(f"__{c}") for c in KEY], *[f"__{f}" for f in FIELDS])
    same = None
    for c in KEY:
        test = F.col(c).eqNullSafe(F.col(f"__{c}"))
        same = test if same is None else same & test
    joined = findings.join(marks, same, "left")
    return joined.select(*[F.coalesce(F.col(f"__{c}")["v"], F.col(c)).alias(c) if c in FIELDS else F.col(c)
                           for c in findings.columns])


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """The findings below ``path`` with all marks."""
    return merged(spark.read.parquet(f"{path}/findings"), open_marks(spark, path))


def _moved(spark: SparkSession, place: str, to: str) -> int:
    """Put the analyses staged below ``place`` in the place of those below ``to``; returns how many were moved.

    Folders are moved, so rows are not written again and no second copy of them is kept. After an interruption the folders
    still staged are moved.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(to).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(place)):
        return 0
    count = 0
    for status in fs.listStatus(path(place)):
        name = status.getPath().getName()
        if not status.isDirectory() or not name.startswith("analysis_id="):
            continue
        old, new = path(path(to), name), status.getPath()
        fs.delete(old, True)
        if not fs.rename(new, old):
            raise OSError(f"{new.toString()} could not be moved to {old.toString()}")
        count += 1
    fs.delete(path(place), True)
    spark.catalog.refreshByPath(to)
    return count


def compact(spark: SparkSession, path: str) -> int:
    """Write all open marks into the findings; returns the number of analyses that were rewritten.

    Only partitions of marked analyses are written. Marks that arrive meanwhile stay open. One compaction may run at a time.
    """
    steps = _steps(spark, path)
    staged_upto, place = steps.get("staged", (-1, ""))
    if staged_upto <= steps.get("done", (-1, ""))[0]:
        marks = _read(spark, f"{path}/marks")
        upto = None if marks is None else marks.agg(F.max("batch")).head()[0]
        if upto is None or upto <= steps.get("done", (-1, ""))[0]:
            return 0
        found = open_marks(spark, path, upto)
        findings = spark.read.parquet(f"{path}/findings")
        touched = found.select("analysis_id").distinct()
        place = f"{path}/staged-{upto}"
        # the marked analyses alone are read: their names prune partitions
        names = [r[0] for r in touched.limit(ONE_BY_ONE + 1).collect()]
        if len(names) > ONE_BY_ONE:
            parts = [(findings.join(touched, "analysis_id", "left_semi"), found)]
        else:
            parts = [tuple(t.where(F.col("analysis_id").eqNullSafe(F.lit(name))) for t in (findings, found)) for name in names]
        with shuffles_removed(spark):
            for i, (rows, marks) in enumerate(parts):
                (merged(rows, marks).write.mode("append" if i else "overwrite").option("compression", "zstd")
                 .partitionBy("analysis_id").parquet(place))
        _record(spark, path, "staged", upto, place)
        staged_upto = upto
    # from here on a second run takes the same rows from the staged place
    count = _moved(spark, place, f"{path}/findings")
    _record(spark, path, "done", staged_upto, place)
    return count
