"""Text forms of values: number formatting, null tokens, label clean-up."""

from __future__ import annotations

# The text tokens a pandas CSV reader treats as missing.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]


def number_text(x: str, raw: str | None = None) -> str:
    """SQL for a double as plain shortest text: ``120.0``, ``0.0005``, ``12345678.9``, ``1e+16``.

    Spark's own cast switches to E-notation at 1e7 and below 1e-3; findings are
    read by people and compared with other engines, so the switch is moved to
    1e16 and 1e-4. ``raw`` names a column that already holds the cast.
    """
    raw = raw or f"CAST({x} AS STRING)"
    fixed = f"regexp_replace(CAST(CAST({x} AS DECIMAL(38,20)) AS STRING), '0+$', '')"
    exponent = f"try_cast(substring_index({raw}, 'E', -1) AS INT)"
    return (f"CASE WHEN NOT contains({raw}, 'E') THEN {raw} "
            f"WHEN abs({x}) >= 1e-4 AND abs({x}) < 1e16 THEN regexp_replace({fixed}, '[.]$', '.0') "
            f"ELSE concat(regexp_replace(substring_index({raw}, 'E', 1), '[.]0$', ''), 'e', "
            f"if({exponent} < 0, '-', '+'), lpad(CAST(abs({exponent}) AS STRING), 2, '0')) END")


def fixed_text(x: str, places: int) -> str:
    """SQL for ``x`` with a fixed number of decimals and no thousands separators.

    ``format_number`` rounds the exact binary value, ``format_string`` its shortest text.
    """
    return f"format_number(CAST({x} AS DOUBLE), '0.{'0' * places}')"


def sql_name(name: str) -> str:
    """A column name that survives dots and spaces."""
    return "`" + name.replace("`", "``") + "`"


def sql_text(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_number(value: float | None) -> str:
    """A double literal."""
    if value is None:
        return "CAST(NULL AS DOUBLE)"
    text = repr(float(value))
    return f"{text}D" if text.lstrip("-")[0].isdigit() else f"CAST('{text}' AS DOUBLE)"
