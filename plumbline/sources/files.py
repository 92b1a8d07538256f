"""Checks on files and tables before they are analysed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.schema import quoted


#: Bytes up to which a file's content is one value in memory; a larger one is read in pieces.
WHOLE_BYTES = 32 << 20
PIECE_BYTES = 4 << 20


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) from file metadata; the content column is never read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def file_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, file_hash): SHA-256 of each file's bytes, one row per file, of any size.

    Files above ``WHOLE_BYTES`` are read in pieces: on the executors where the path is a local one, else as a Hadoop stream
    of the driver, one after the other, as other stores can be opened there only.
    """
    files = spark.read.format("binaryFile").load(path)
    whole = files.where(F.col("length") <= WHOLE_BYTES).select("path", "length", F.sha2("content", 256).alias("file_hash"))
    large = [tuple(r) for r in file_sizes(spark, path).where(F.col("length") > WHOLE_BYTES).collect()]
    local = [r for r in large if r[0].startswith("file:")]
    if local:
        rows = spark.createDataFrame(local, "path string, length long").repartition(len(local), "path")
        whole = whole.unionAll(rows.mapInArrow(_hashed_in_pieces, "path string, length long, file_hash string"))
    others = [(p, n, _hashed_as_stream(spark, p)) for p, n in large if not p.startswith("file:")]
    if others:
        whole = whole.unionAll(spark.createDataFrame(others, "path string, length long, file_hash string"))
    return whole


def _hashed_in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path in batch.column(0).to_pylist():
            digest = hashlib.sha256()
            with open("/" + path.removeprefix("file:").lstrip("/"), "rb") as f:  # such paths are not escaped
                while piece := f.read(PIECE_BYTES):
                    digest.update(piece)
            out.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())],
                                         ["path", "length", "file_hash"])


def _hashed_as_stream(spark: SparkSession, path: str) -> str:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def validate_file(spark: SparkSession, path: str, max_bytes: int | None = None) -> None:
    """Raise if a file is empty or larger than ``max_bytes`` (no limit by default)."""
    r = file_sizes(spark, path).agg(F.min("length"), F.max("length")).head()
    if not r[0]:
        raise ValueError("Uploaded file is empty")
    if max_bytes is not None and r[1] > max_bytes:
        raise ValueError(f"File exceeds maximum allowed size of {max_bytes} bytes")


def validate(df: DataFrame) -> DataFrame:
    """Raise if the table has no rows or fewer than two columns."""
    if len(df.columns) < 2:
        raise ValueError("CSV must contain at least 2 columns")
    if df.isEmpty():
        raise ValueError("Uploaded CSV file contains no data rows")
    return df


def reject_known_files(files: DataFrame, datasets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new files, rejected files): same user and hash as a dataset that is not archived."""
    known = datasets.where(~F.col("is_archived")).select("user_id", "file_hash")
    return (files.join(known, ["user_id", "file_hash"], "left_anti"),
            files.join(known, ["user_id", "file_hash"], "left_semi"))


def sanitized(c: Column) -> Column:
    """Text without leading formula characters (= + - @) and outer blanks."""
    return F.trim(F.regexp_replace(F.trim(c), r"^(?:[=+@-]\s*)+", ""))


def sanitize_formula(df: DataFrame, cols=None) -> DataFrame:
    """The table with ``sanitized`` text columns, for export to spreadsheets."""
    chosen = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)
              and (cols is None or f.name in cols)}
    return df.select(*[sanitized(quoted(c)).alias(c) if c in chosen else quoted(c) for c in df.columns])


def preview(df: DataFrame, order_by, n: int = 10) -> DataFrame:
    """The first ``n`` rows in key order with NaN and infinities as NULL."""
    out = []
    for f in df.schema.fields:
        c = quoted(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            bad = F.isnan(c) | (F.abs(c) == float("inf"))
            c = F.when(~bad, c).alias(f.name)
        out.append(c)
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*[quoted(k) for k in keys]).limit(n).select(*out)
