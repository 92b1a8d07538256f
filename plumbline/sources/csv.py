"""CSV reading with delimiter and encoding detection, bad-line policy and null tokens."""

from __future__ import annotations

import csv as line_csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.schema import quoted
from ..functions.text import NULL_TOKENS

# Tried in this order.
DELIMITERS = [",", "\t", ";", "|"]
HEAD_LINES = 20


def detect_encoding(spark: SparkSession, path: str) -> str:
    """utf-8, or latin-1 if some line is not valid UTF-8; one distributed pass over the text."""
    damaged = spark.read.text(path).where(F.col("value").contains("�"))
    return "UTF-8" if damaged.isEmpty() else "ISO-8859-1"


def detect_delimiter(spark: SparkSession, path: str, delimiters=None) -> tuple[str, list[str]]:
    """First delimiter that splits the header into at least two columns, and the stripped header."""
    head = [r[0] for r in spark.read.text(path).limit(HEAD_LINES).collect()]
    lines = [line.lstrip("﻿") for line in head if line.strip()]
    if not lines:
        raise ValueError("the file is empty")
    for sep in delimiters or DELIMITERS:
        header = next(line_csv.reader(lines[:1], delimiter=sep))
        if len(header) >= 2:
            return sep, [h.strip() for h in header]
    raise ValueError("CSV must contain at least 2 columns")


def _separators_outside_quotes(line: Column, sep: str) -> Column:
    bare = F.regexp_replace(line, '"([^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))


def read_csv(
    spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None,
    on_bad: str = "skip", null_tokens=None, infer: bool = True, keep_text=(), schema: T.StructType | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """A table from CSV files with a header line.

    Lines with too many fields are skipped (``on_bad="skip"``) or raise (``"error"``); short lines are
    padded with NULL. Null tokens are removed before types are inferred. Columns in ``keep_text``
    (subject keys such as ``001``) stay text; an explicit ``schema`` replaces inference. With
    ``multi_line`` quoted cells may hold line breaks, and a file is then read by one task; by default
    this is so if a line leaves a quote open.
    """
    found_sep, header = detect_delimiter(spark, path, [delimiter] if delimiter else None)
    encoding = encoding or detect_encoding(spark, path)
    names = _unique([h or f"column_{i}" for i, h in enumerate(header)])
    text_schema = T.StructType([T.StructField(n, T.StringType()) for n in names]
                               + [T.StructField("_bad", T.StringType())])
    if multi_line is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multi_line = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    raw = (spark.read.schema(text_schema).option("header", True).option("multiLine", multi_line).option("enforceSchema", True)
           .option("sep", found_sep).option("encoding", encoding).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_bad").option("columnPruning", False).option("quote", '"').option("escape", '"').csv(path))
    too_long = F.col("_bad").isNotNull() & (_separators_outside_quotes(F.col("_bad"), found_sep) >= len(names))
    if on_bad == "skip":
        # the second test is always true; the CSV reader refuses a query on the bad-line column alone
        raw = raw.where(~too_long & (F.length(F.concat_ws("", *[quoted(n) for n in names])) >= 0))
    else:
        raw = raw.withColumn(names[0], F.when(
            too_long, F.raise_error(F.concat(F.lit("too many fields: "), F.col("_bad")))).otherwise(quoted(names[0])))
    table = normalise_nulls(raw.drop("_bad"), null_tokens)
    if schema is not None:
        return table.select(*[quoted(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    return infer_types(table, keep_text) if infer else table


def _unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        count = seen.get(n, 0)
        seen[n] = count + 1
        out.append(n if not count else f"{n}.{count}")
    return out


def normalise_nulls(df: DataFrame, tokens=None) -> DataFrame:
    """Text cells that hold a null token become NULL."""
    tokens = list(NULL_TOKENS if tokens is None else tokens)
    return df.select(*[
        F.when(~F.trim(quoted(f.name)).isin(tokens), quoted(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType) else quoted(f.name) for f in df.schema.fields])


def infer_types(df: DataFrame, keep_text=()) -> DataFrame:
    """Cast text columns whose values all are booleans, integers or numbers; one aggregate decides."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in set(keep_text)]
    if not text:
        return df
    aggs = []
    for i, c in enumerate(text):
        v = F.trim(quoted(c))
        aggs += [F.count(v).alias(f"n{i}"), F.count_if(F.lower(v).isin("true", "false")).alias(f"b{i}"),
                 F.count_if(v.rlike(r"^[+-]?\d+$") & v.try_cast("long").isNotNull()).alias(f"i{i}"),
                 F.count_if(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")).alias(f"d{i}")]
    row = df.agg(*aggs).head()
    kinds = {}
    for i, c in enumerate(text):
        n, b, whole, decimal = row[4 * i: 4 * i + 4]
        if n:
            kinds[c] = "boolean" if b == n else "long" if whole == n else "double" if decimal == n else None
    return df.select(*[
        F.trim(quoted(c)).cast(kinds[c]).alias(c) if kinds.get(c) else quoted(c) for c in df.columns])
