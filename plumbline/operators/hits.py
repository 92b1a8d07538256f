"""The common output of all detectors: one row per flagged cell.

A hit carries the cell's text and number along, so that scoring and explaining
never have to go back to the source table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import quoted, row_key
from ..functions.text import fixed_text, number_text, sql_name, sql_number, sql_text

ALGORITHMS = ["statistical", "clinical_rules", "missing_data", "isolation_forest",
              "lof", "autoencoder", "duplicates"]

HIT_COLUMNS = ["row_key", "subject_id", "column_name", "value", "value_num", "algo", "method",
               "score", "z_score", "expected_min", "expected_max", "anomaly_type", "note", "seq"]


class Sql(str):
    """Marks text as an SQL expression where a literal is the default."""


def _text(x) -> str:
    if x is None:
        return "CAST(NULL AS STRING)"
    return f"CAST({x} AS STRING)" if isinstance(x, Sql) else sql_text(x)


def _number(x) -> str:
    return f"CAST({x} AS DOUBLE)" if isinstance(x, str) else sql_number(x)


def hit(column, algo, method, score, value: str | None = None, value_num: str | None = None, z=None, lo=None, hi=None,
        kind="", note=None, seq: int = 0, before=None, amount=None) -> str:
    """SQL of the struct for one flagged cell; every detector uses the same fields and types.

    ``column``, ``algo``, ``method``, ``kind`` and ``note`` are literals unless wrapped in ``Sql``; the
    numeric arguments are numbers or SQL. ``note`` may hold ``{x}`` (the cell's number), ``{before}`` (a
    second number), ``{amount}`` (one decimal) and ``{count}`` (whole). They are filled in after the flagged
    cells have become rows, so the plan formats text once and not once per column and rule; the same goes
    for a NULL ``value``.
    """
    fields = {
        "column_name": _text(column), "value": _text(None if value is None else Sql(value)),
        "value_num": _number(value_num), "algo": _text(algo), "method": _text(method), "score": _number(score),
        "z_score": _number(z), "expected_min": _number(lo), "expected_max": _number(hi), "anomaly_type": _text(kind),
        "note": _text(note), "seq": str(int(seq)), "__before": _number(before), "__amount": _number(amount)}
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def when(condition: str, then: str) -> str:
    return f"CASE WHEN {condition} THEN {then} END"


@dataclass
class Candidates:
    """What a row-local detector says of a row: SQL of a struct for each cell it may flag (NULL = not flagged), conditions
    outside of which nothing is flagged, and columns that the structs need."""

    structs: list[str] = field(default_factory=list)
    tests: list[str] = field(default_factory=list)
    columns: list[Column] = field(default_factory=list)


def emit_all(df: DataFrame, key, parts: list[Candidates], subject_col: str | None = None) -> DataFrame:
    """Hits of several row-local detectors from one scan: one filter, one projection, no shuffle."""
    structs = [x for p in parts for x in p.structs]
    if not structs:
        return no_hits(df, key)
    near = df.where(any_of([t for p in parts for t in p.tests]))
    columns = [c for p in parts for c in p.columns]
    return emit(near.select("*", *columns) if columns else near, key, structs, subject_col)


def emit(df: DataFrame, key, candidates: list[str], subject_col: str | None = None) -> DataFrame:
    """Turn per-row candidate structs (NULL = not flagged) into hit rows, without a shuffle."""
    flagged = F.expr("inline(array_compact(array(" + ", ".join(candidates) + ")))")
    return written(df.select(row_key(key).alias("row_key"), subject(subject_col), flagged))


def written(flagged: DataFrame) -> DataFrame:
    """Fill in the value text and the note of flagged cells, each number text being made once."""
    cast = flagged.selectExpr("*", "CAST(value_num AS STRING) AS __raw_x", "CAST(__before AS STRING) AS __raw_before")
    texts = cast.selectExpr("*", f"{number_text('value_num', '__raw_x')} AS __x",
                            f"{number_text('__before', '__raw_before')} AS __p")
    note = "note"
    for name, text in (("{x}", "__x"), ("{before}", "__p"), ("{amount}", fixed_text("__amount", 1)),
                       ("{count}", "CAST(CAST(__amount AS BIGINT) AS STRING)")):
        note = f"replace({note}, '{name}', coalesce({text}, ''))"
    made = {"note": f"CASE WHEN contains(note, '{{') THEN {note} ELSE note END AS note",
            "value": "coalesce(value, __x) AS value"}
    return texts.selectExpr(*[made.get(c, c) for c in HIT_COLUMNS])


def subject(subject_col: str | None) -> Column:
    c = F.lit(None) if subject_col is None else quoted(subject_col)
    return c.cast("string").alias("subject_id")


def text_of(df: DataFrame, name: str) -> str | None:
    """SQL of the cell text where it is a plain cast; None for floating point, whose text is made from the number."""
    kind = df.schema[name].dataType.typeName()
    return None if kind in ("double", "float") else f"CAST({sql_name(name)} AS STRING)"


def no_hits(df: DataFrame, key) -> DataFrame:
    """An empty hit table with the key type of ``df``."""
    return emit(df.where("false"), key, [when("false", hit("", "", "", 0.0))])


def own_hits(found: DataFrame, df: DataFrame, key, algo: str) -> DataFrame:
    """Flagged cells of a caller's detector in the form of all hits; columns it does not give are empty."""
    full = no_hits(df, key)
    given = {"algo": F.lit(algo), "method": F.col("method") if "method" in found.columns else F.lit(algo)}
    lacking = {"row_key", "column_name", "score"} - set(found.columns)
    if lacking:
        raise ValueError(f"the detector {algo} does not give {', '.join(sorted(lacking))}")
    columns = [given.get(f.name, F.col(f.name) if f.name in found.columns else F.lit(None)).cast(f.dataType).alias(f.name)
               for f in full.schema]
    return found.select(*columns).withColumn("seq", F.coalesce("seq", F.lit(0)))


def any_of(conditions: list[str]) -> str:
    return " OR ".join(f"({c})" for c in conditions)


def union_hits(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
