"""Type checks, missing-value rules and text rendering.

Missing-value rule (settled once): a float NaN is missing, exactly like null.
Every operator that aggregates first maps NaN to null, because Spark's
``avg``/``max`` propagate NaN where pandas skips it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def is_numeric_type(dt: T.DataType) -> bool:
    """Numeric for modelling purposes: numbers and booleans (cast to 0/1)."""
    return isinstance(dt, _NUMERIC + (T.BooleanType,))


def is_float_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def numeric_columns(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    names = cols if cols is not None else df.columns
    return [c for c in names if is_numeric_type(field_type(df, c))]


def require_columns(df: DataFrame, cols: list[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns: {missing}")


def require_numeric(df: DataFrame, cols: list[str]) -> None:
    """Reject a non-numeric column before modelling."""
    require_columns(df, cols)
    bad = [c for c in cols if not is_numeric_type(field_type(df, c))]
    if bad:
        raise TypeError(f"variables must be numeric: {bad}")


def clean_value(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null (floats only)."""
    c = F.col(name)
    if is_float_type(field_type(df, name)):
        return F.nanvl(c, F.lit(None).cast(field_type(df, name)))
    return c


def as_double(df: DataFrame, name: str) -> Column:
    """Numeric view of a column: NaN → null, booleans → 0/1, cast to double."""
    dt = field_type(df, name)
    c = clean_value(df, name)
    if isinstance(dt, T.BooleanType):
        c = c.cast("int")
    return c.cast("double")


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Entry rule: replace NaN by null in every float/double column."""
    targets = set(cols if cols is not None else df.columns)
    return df.select(*[
        clean_value(df, c).alias(c) if c in targets and is_float_type(field_type(df, c)) else F.col(c)
        for c in df.columns])


def is_missing(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if is_float_type(field_type(df, name)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def safe_div(num: Column, den: Column) -> Column:
    """ANSI-safe division: null instead of an error on a zero divisor."""
    return F.try_divide(num, den)


def render_text(df: DataFrame, name: str) -> Column:
    """P10: a cell as display text, the way Python's ``str`` prints it.

    Doubles print positionally for 1e-4 ≤ |x| < 1e16 (through decimal(38,21),
    trailing zeros stripped, one digit kept after the point) and in Python's
    scientific form outside that range (``1e+16``, ``1.5e-05``), rebuilt from
    Spark's own ``1.0E16`` form; Spark's plain cast would give ``1.0E7`` for
    ten million.  Booleans print ``True``/``False``; timestamps
    ``YYYY-MM-DD HH:MM:SS[.ffffff]``.  Missing stays null (callers choose the
    marker).
    """
    dt = field_type(df, name)
    c = clean_value(df, name)
    if is_float_type(dt):
        x = c.cast("double")
        positional = F.regexp_replace(F.regexp_replace(
            x.try_cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0")
        java = x.cast("string")                                  # e.g. 1.5E-5
        mantissa = F.regexp_replace(F.regexp_extract(java, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
        exponent = F.regexp_extract(java, r"E(-?[0-9]+)$", 1).cast("int")
        scientific = F.concat(mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"),
                              F.lpad(F.abs(exponent).cast("string"), 2, "0"))
        ax = F.abs(x)
        return (F.when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(java == "-0.0", "-0.0")
                .when((ax >= 1e16) | ((ax < 1e-4) & (ax > 0)), scientific)
                .otherwise(positional))
    if isinstance(dt, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        # a fraction prints all six digits, none prints nothing
        whole = F.date_trunc("second", c) == c
        return F.when(whole, c.cast("string")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return c.cast("string")
