"""Canonical text: JSON strings and numbers in the form the identifiers hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control characters whose JSON escape has a hex letter, which is lower case here.
LETTER_ESCAPES = ["000b", "000e", "000f", "001a", "001b", "001c", "001d", "001e", "001f"]


def json_string(text: Column) -> Column:
    """A JSON string literal, or ``null``; non-ASCII characters stay as they are.

    Refers to ``text`` once, so nesting documents does not multiply the work.
    """
    wrapped = F.to_json(F.struct(text.cast("string").alias("v")), {"ignoreNullFields": "false"})
    return F.substring(F.rtrim(wrapped, F.lit("}")), 6, 2**31 - 1)


def canonical_json(document: Column, ascii_only: bool) -> Column:
    """Last step for a hashed document: lower-case escapes, and optionally ASCII only.

    Refers to ``document`` several times, so give it a plain column.
    """
    lowered = document
    for code in LETTER_ESCAPES:
        # An even run of backslashes before the escape is escaped backslashes.
        pattern = r"(?<!\\)((?:\\\\)*)\\u" + code.upper()
        lowered = F.regexp_replace(lowered, pattern, "$1\\\\u" + code)
    text = F.when(document.rlike(r"\\u00[01][A-F]"), lowered).otherwise(document)
    if not ascii_only:
        return text
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    escaped = F.transform(
        units,
        lambda u: F.when(u > F.lit("007E"), F.concat(F.lit("\\u"), F.lower(u))).otherwise(
            F.decode(F.unhex(u), "UTF-16BE")
        ),
    )
    return F.when(document.rlike(r"[^\x00-\x7e]"), F.array_join(escaped, "")).otherwise(text)


def json_number(value: Column) -> Column:
    """A double in shortest decimal notation: fixed from 1e-4 up to 1e16, else ``1e+16``."""
    text = value.cast("double").cast("string")
    mantissa = F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.0$", "")
    power = F.split_part(text, F.lit("E"), F.lit(2)).cast("int")
    sign = F.when(power < 0, "-").otherwise("+")
    digits = F.lpad(F.abs(power).cast("string"), 2, "0")
    digits = F.when(F.abs(power) > 99, F.abs(power).cast("string")).otherwise(digits)
    large = F.regexp_replace(
        F.regexp_replace(value.cast("decimal(38,12)").cast("string"), r"0+$", ""), r"\.$", ".0"
    )
    tiny = F.regexp_replace(value.cast("decimal(38,22)").cast("string"), r"0+$", "")
    return (
        F.when(value.isNull(), F.lit("null"))
        .when(~text.contains("E"), text)
        .when(power.between(7, 15), large)
        .when(power == -4, tiny)
        .otherwise(F.concat(mantissa, F.lit("e"), sign, digits))
    )


def json_array(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def json_object(fields: dict[str, Column]) -> Column:
    """A compact JSON object with keys in sorted order; values are JSON text."""
    parts: list[Column] = []
    for i, key in enumerate(sorted(fields)):
        parts.append(F.lit(("," if i else "{") + f'"{key}":'))
        parts.append(fields[key])
    return F.concat(*parts, F.lit("}"))


def json_bool(value: Column) -> Column:
    return value.cast("boolean").cast("string")
