"""Taking in many CSV files at once: one nested record for each file, whatever its delimiter and columns.

The lines of all files are one table, so a large file is read by many tasks and a million small ones do not make a million
jobs. A first pass finds each file's header; a second one splits every line by its file's delimiter and counts per file
and column, with partial counts made where the lines are. Only counts are shuffled, never lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunks import reliable
from ..functions.text import NULL_TOKENS
from .csv import DELIMITERS
from .files import file_fingerprint

#: Lines from the beginning of a file in which header and preview are looked for.
HEAD_LINES = 200
#: Files whose headers are broadcast; with more of them headers are joined.
BROADCAST_FILES = 100_000


def _cells(line: Column, sep: Column) -> Column:
    """Cells of a line: split at the separator outside of quotes, quotes taken off."""
    pattern = F.concat(F.lit("\\Q"), sep, F.lit("\\E"))
    quoted = F.concat(pattern, F.lit('(?=(?:[^"]*"[^"]*")*[^"]*$)'))
    bare = lambda c: F.when(c.rlike('^\\s*".*"\\s*$'), F.replace(
        F.regexp_replace(c, '^\\s*"|"\\s*$', ""), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.when(F.contains(line, F.lit('"')), F.transform(F.split(line, quoted, -1), bare)).otherwise(
        F.split(line, pattern, -1))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """path, block (where in the file the task's part begins), id (rising within it) and line; blank lines are left out."""
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), F.regexp_replace("value", "^﻿", "").alias("line"))
    return text.where(F.trim("line") != "")


def read_heads(spark: SparkSession, path: str) -> DataFrame:
    """path, first (id of the header line), sep, header, damaged (lines that are no UTF-8) of every file with a line."""
    lines = _lines(spark, path)
    found = lines.groupBy("path").agg(F.min(F.struct("block", "id", "line")).alias("head"),
                                      F.count_if(F.contains("line", F.lit("�"))).alias("damaged"))
    header = F.col("head.line")
    ways = [F.struct(F.lit(sep).alias("sep"), F.transform(_cells(header, F.lit(sep)), F.trim).alias("header"))
            for sep in DELIMITERS]
    # the first delimiter that makes two columns; without one the line is one column
    chosen = F.coalesce(F.get(F.filter(F.array(*ways), lambda w: F.size(w["header"]) >= 2), F.lit(0)), ways[0])
    return found.select("path", F.col("head.id").alias("first"), chosen.alias("c"), "damaged").select(
        "path", "first", "c.sep", "c.header", "damaged")


def ingest(spark: SparkSession, path: str, preview_rows: int = 10, null_tokens=None) -> DataFrame:
    """One record for each file of ``path`` (folder, glob): path, length, file_hash, encoding, delimiter, header, rows,
    bad_lines, types and missing (maps by column), preview (the first rows as maps), problem.

    A line with more cells than the header is bad and not counted as a row; a shorter one is padded with missing cells.
    Null tokens are missing. A column is boolean, long or double if all its values are, else string. ``problem`` says why
    a file cannot be analysed: it holds blank lines only, has no data rows, or fewer than two columns. A file without a
    single byte has no record, as Spark's readers pass over it. Of columns with equal names the
    later ones are numbered. Cells with line breaks are not read as such here; use ``read_csv`` with ``multi_line``.
    """
    tokens = list(NULL_TOKENS if null_tokens is None else null_tokens)
    heads = reliable(read_heads(spark, path))  # one row for each file
    few = heads.count() <= BROADCAST_FILES
    lines = _lines(spark, path).join(F.broadcast(heads) if few else heads, "path").where("id <> first")
    cut = lines.select("path", "block", "id", "first", "header", _cells(F.col("line"), F.col("sep")).alias("cells"))
    value = lambda c: F.when(~F.trim(c).isin(tokens), F.trim(c))
    cut = cut.withColumn("bad", F.size("cells") > F.size("header")).withColumn("cells", F.transform("cells", value))
    per_file = cut.groupBy("path").agg(F.count_if(~F.col("bad")).alias("rows"), F.count_if("bad").alias("bad_lines"))
    each = cut.where("NOT bad").select("path", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("header") - 1),
                                       lambda i: F.get("cells", i))).alias("at", "v"))
    whole = F.col("v").rlike(r"^[+-]?\d+$") & F.col("v").try_cast("long").isNotNull()
    columns = each.groupBy("path", "at").agg(
        F.count("v").alias("n"), F.count(F.lit(1)).alias("all"), F.count_if(F.lower("v").isin("true", "false")).alias("b"),
        F.count_if(whole).alias("i"), F.count_if(F.col("v").rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")).alias("d"))
    kind = (F.when(F.col("n") == 0, "string").when(F.col("b") == F.col("n"), "boolean")
            .when(F.col("i") == F.col("n"), "long").when(F.col("d") == F.col("n"), "double").otherwise("string"))
    # one entry for each column of a file
    columns = columns.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(
        "at", kind.alias("kind"), (F.col("all") - F.col("n")).alias("missing")))).alias("columns"))
    early = cut.where(f"NOT bad AND block = 0 AND id - first <= {HEAD_LINES + preview_rows}").groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("id", "cells"))).alias("early"))
    met = (file_fingerprint(spark, path).join(heads.drop("first"), "path", "left").join(per_file, "path", "left")
           .join(columns, "path", "left").join(early, "path", "left"))
    # equal names are told apart by their number among them
    names = F.transform("header", lambda h, i: F.concat(
        F.when(h == "", F.concat(F.lit("column_"), i.cast("string"))).otherwise(h),
        F.when(F.array_position(F.col("header"), h) <= i, F.concat(F.lit("."), (F.size(F.filter(
            F.slice("header", F.lit(1), i), lambda x: x == h))).cast("string"))).otherwise("")))
    met = met.withColumn("names", names)
    of = lambda field: F.map_from_arrays("names", F.transform(
        F.sequence(F.lit(0), F.size("names") - 1), lambda i: F.get("columns", i)[field]))
    rows = F.coalesce("rows", F.lit(0).cast("long"))
    preview = F.transform(F.slice("early", 1, preview_rows), lambda r: F.map_from_arrays(
        F.col("names"), F.transform(F.sequence(F.lit(0), F.size("names") - 1), lambda i: F.get(r["cells"], i))))
    return met.select(
        "path", "length", "file_hash", F.when(F.col("damaged") > 0, "ISO-8859-1").otherwise("UTF-8").alias("encoding"),
        F.col("sep").alias("delimiter"), F.col("names").alias("header"), rows.alias("rows"),
        F.coalesce("bad_lines", F.lit(0).cast("long")).alias("bad_lines"),
        F.when(rows > 0, of("kind")).alias("types"), F.when(rows > 0, of("missing")).alias("missing"), preview.alias("preview"),
        F.when(F.col("names").isNull(), "Uploaded file is empty")
        .when(F.size("names") < 2, "CSV must contain at least 2 columns")
        .when(rows == 0, "Uploaded CSV file contains no data rows").alias("problem"))


def accepted(records: DataFrame, known: DataFrame) -> DataFrame:
    """``records`` with ``duplicate_of``: the path of the file with the same bytes that is ``known`` or, among the records
    themselves, comes first; null where there is none."""
    before = known.groupBy("file_hash").agg(F.min("path").alias("known_path"))
    first = records.groupBy("file_hash").agg(F.min("path").alias("first_path"))
    met = records.join(before, "file_hash", "left").join(first, "file_hash")
    return met.select(*records.columns, F.coalesce("known_path", F.when(
        F.col("first_path") != F.col("path"), F.col("first_path"))).alias("duplicate_of"))
