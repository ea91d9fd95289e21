"""Content digests of tables, free of row order."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Hex positions of the 60-bit lanes cut from one SHA-256.
LANES = (1, 16, 31, 46)
# A lane is summed in pieces of 20 bits, which stay inside a bigint for 8e12 rows.
PIECE_BITS, PIECES = 20, 3

def sha_prefix(text: Column, length: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def cents(value: Column) -> Column:
    """Whole hundredths, ties to even."""
    return F.rint(value * 100).cast("bigint")


def real_text(value: Column) -> Column:
    """A double as text, another one for every value; NaN is one value, -0.0 is 0.0.

    A whole number of cents below 1e13 is written as such. Any other value is
    written by its shortest decimal digits without zeros at the ends, and the
    exponent of the last digit.
    """
    value = value.cast("double") + F.lit(0.0)
    whole = F.rint(value * 100)
    short = (F.abs(value) < 1e13) & (whole / 100 == value)
    raw = F.upper(F.abs(value).cast("string"))
    mantissa, power = F.substring_index(raw, "E", 1), F.when(raw.contains("E"), F.substring_index(raw, "E", -1)).otherwise("0")
    point = F.instr(mantissa, ".")
    after = F.when(point > 0, F.length(mantissa) - point).otherwise(0)
    digits = F.ltrim(F.replace(mantissa, F.lit("."), F.lit("")), F.lit("0"))
    kept = F.rtrim(digits, F.lit("0"))
    exponent = power.try_cast("int") - after + F.length(digits) - F.length(kept)
    long = F.concat(F.when(value < 0, "-").otherwise(""), kept, F.lit("e"), exponent.cast("string"))
    return (
        F.when(F.isnan(value), "NaN")
        .when(F.abs(value) == float("inf"), F.when(value < 0, "-Inf").otherwise("Inf"))
        .when(short, F.concat(whole.try_cast("bigint").cast("string"), F.lit("c")))
        .otherwise(long)
    )


def field_text(value: Column, kind: str) -> Column:
    """A field as text that cannot be confused with its neighbours.

    Whole numbers and decimals as they are, doubles by their exact value, time as
    epoch microseconds, anything else with its length in bytes in front; ``N`` for
    null. ``money`` rounds to cents, for columns that the caller names so.
    """
    if kind == "money":
        text = cents(value).cast("string")
    elif kind == "real":
        text = real_text(value)
    elif kind == "reals":
        items = F.transform(value, lambda x: F.coalesce(real_text(x), F.lit("N")))
        text = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    elif kind == "time":
        text = F.unix_micros(value.cast("timestamp")).cast("string")
    elif kind == "number":
        text = value.cast("string")
    else:
        text = value.cast("string")
        text = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(text, F.lit("N"))


def default_kinds(df: DataFrame) -> dict[str, str]:
    kinds = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            kinds[field.name] = "real"
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, (T.DoubleType, T.FloatType)):
            kinds[field.name] = "reals"
        elif isinstance(field.dataType, (T.IntegralType, T.DecimalType)):
            kinds[field.name] = "number"
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            kinds[field.name] = "time"
        else:
            kinds[field.name] = "text"
    return kinds


def row_hash(columns: Mapping[str, str]) -> Column:
    parts: list[Column] = []
    for name, kind in columns.items():
        if parts:
            parts.append(F.lit("|"))
        parts.append(field_text(F.col(name), kind))
    return F.sha2(F.concat(*parts), 256)


def with_lanes(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Add the lanes of each row's hash as numbers; every step is computed once per row."""
    lanes = {
        f"_lane{i}": F.conv(F.substring("_hash", at, 15), 16, 10).cast("bigint")
        for i, at in enumerate(LANES, start=1)
    }
    return df.withColumn("_hash", row_hash(kinds)).withColumns(lanes).drop("_hash")


def lane_sums() -> list[Column]:
    """Sums of all pieces of all lanes, as plain bigint aggregates."""
    out = []
    for i in range(1, len(LANES) + 1):
        for piece in range(PIECES):
            part = F.shiftright(f"_lane{i}", PIECE_BITS * piece).bitwiseAND(F.lit(2**PIECE_BITS - 1))
            out.append(F.coalesce(F.sum(part), F.lit(0)).alias(f"lane{i}_{piece}"))
    return out


def combine_lanes(columns: list[str]) -> Column:
    lanes = []
    for i in range(1, len(LANES) + 1):
        total = F.lit(0).cast("decimal(38,0)")
        for piece in range(PIECES):
            weight = F.lit(2 ** (PIECE_BITS * piece)).cast("decimal(14,0)")
            total = total + F.col(f"lane{i}_{piece}").cast("decimal(19,0)") * weight
        lanes.append(total.cast("decimal(38,0)").cast("string"))
    return F.sha2(
        F.concat_ws("|", F.lit(",".join(columns)), F.col("row_count").cast("string"), *lanes), 256
    )


def digest_from_sums(columns: list[str], sums: Mapping[str, int]) -> str:
    """``combine_lanes`` for one row of sums that is already on the driver."""
    lanes = [
        str(sum(int(sums[f"lane{i}_{piece}"] or 0) << (PIECE_BITS * piece) for piece in range(PIECES)))
        for i in range(1, len(LANES) + 1)
    ]
    text = "|".join([",".join(columns), str(int(sums["row_count"] or 0)), *lanes])
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def lane_state(
    df: DataFrame, kinds: Mapping[str, str] | None = None, by: list[str] | None = None
) -> DataFrame:
    """Row count and lane sums of a table (or of each group): all that its digest needs.

    Sums commute, so partial aggregates combine on the map side and no sort or
    gather of rows is needed.
    """
    kinds = dict(kinds or {c: k for c, k in default_kinds(df).items() if c not in (by or [])})
    return with_lanes(df, kinds).groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("row_count"), *lane_sums())


def moved_state(
    state: DataFrame, added: DataFrame, removed: DataFrame,
    kinds: Mapping[str, str] | None = None, by: list[str] | None = None,
) -> DataFrame:
    """The state after rows were added and removed, of which alone the rows are hashed.

    A changed row is removed as it was and added as it is; a row that is in both
    changes nothing, and a row that is there twice counts twice. Groups without rows
    are left out, as ``lane_state`` does. The order of changes does not matter.
    """
    by = by or []
    kinds = dict(kinds or {c: k for c, k in default_kinds(added).items() if c not in by})
    sums = [c for c in state.columns if c not in by]
    less = lane_state(removed, kinds, by).select(*by, *[(-F.col(c)).alias(c) for c in sums])
    parts = state.unionByName(lane_state(added, kinds, by)).unionByName(less)
    total = parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])
    return total.where(F.greatest(*[F.abs(c) for c in sums]) > 0) if by else total


def state_digest(state: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """row_count and digest (by group) of a state over ``columns``.

    The digest is null where a sum is below zero: rows were removed that the table
    never had.
    """
    by = by or []
    sums = [F.col(c) for c in state.columns if c not in by]
    digest = F.when(F.least(*sums) >= 0, combine_lanes(columns))
    return state.select(*by, "row_count", digest.alias("digest"))


def multiset_digest(
    df: DataFrame, kinds: Mapping[str, str] | None = None, by: list[str] | None = None
) -> DataFrame:
    """Order-free, duplicate-sensitive digest in one aggregation.

    ``by`` gives one digest per group. ``moved_state`` keeps a digest up to date
    from changed rows alone.
    """
    kinds = dict(kinds or {c: k for c, k in default_kinds(df).items() if c not in (by or [])})
    return state_digest(lane_state(df, kinds, by), list(kinds), by)


def bytes_digest(content: Column) -> Column:
    return F.sha2(content, 256)
