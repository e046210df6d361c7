"""CSV with a header row and inferred types, pandas-style missing
tokens.

Spark's CSV reader knows one ``nullValue``; a table written by other tools
marks missing cells with any of several tokens.  So the file is read as
strings, every missing token becomes null, and only then are types
inferred, in one distributed aggregation that tests, for every column, which
of long / double / boolean / timestamp parses all present values.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import ensure_checkpoint_dir

# The default missing-value tokens of the pandas CSV reader.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

_TRUE = ["true", "True", "TRUE"]
_FALSE = ["false", "False", "FALSE"]
#: A number as text: no Java suffix such as 1d or 3f.
_NUMBER = r"^\s*[+-]?(\d|\.\d|[iI]nf|[nN]a[nN]).*[^dDfF]$|^\s*[+-]?\d$"
#: A timestamp needs its date; a time of day alone stays text.
_DATED = r"^\s*\d{4}-"


def _na_to_null(c, tokens):
    return F.when(~c.isin(tokens), c)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             na_values: list[str] | None = None, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """Read CSV file(s) with a header.  With ``schema`` the types are taken
    as given; otherwise they are inferred after missing tokens are nulled.
    A quote inside a quoted field is doubled.  ``multi_line`` lets quoted
    fields hold line breaks; a file is then read by one task, as its records
    can only be told apart from the start."""
    tokens = NA_TOKENS if na_values is None else na_values
    raw = (spark.read.option("header", True).option("sep", sep).option("inferSchema", False)
           .option("quote", '"').option("escape", '"').option("multiLine", multi_line)
           .option("nullValue", None).option("emptyValue", "").option("mode", "FAILFAST").csv(path))
    cleaned = raw.select(*[_na_to_null(F.col(c), tokens).alias(c) for c in raw.columns])
    if schema is not None:
        return cleaned.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return infer_types(cleaned)


def infer_types(df: DataFrame) -> DataFrame:
    """Cast string columns to the narrowest of long, double, boolean,
    timestamp that parses every present value (one aggregation)."""
    checks = []
    for i, c in enumerate(df.columns):
        x = F.col(c)
        present = x.isNotNull()
        checks += [
            F.count_if(present & x.try_cast("long").isNull()).alias(f"l{i}"),
            F.count_if(present & (x.try_cast("double").isNull() | ~x.rlike(_NUMBER))).alias(f"d{i}"),
            F.count_if(present & ~x.isin(_TRUE + _FALSE)).alias(f"b{i}"),
            F.count_if(present & (x.try_cast("timestamp_ntz").isNull() | ~x.rlike(_DATED))).alias(f"t{i}"),
            F.count_if(present).alias(f"n{i}"),
        ]
    if not df.columns:
        return df
    r = df.agg(*checks).first()
    out = []
    for i, c in enumerate(df.columns):
        x = F.col(c)
        if r[f"n{i}"] == 0:
            out.append(x.cast("double").alias(c))     # all missing: a float column, as pandas
        elif r[f"l{i}"] == 0:
            out.append(x.cast("long").alias(c))
        elif r[f"d{i}"] == 0:
            out.append(x.cast("double").alias(c))
        elif r[f"b{i}"] == 0:
            out.append(x.isin(_TRUE).alias(c))
        elif r[f"t{i}"] == 0:
            out.append(x.cast("timestamp_ntz").alias(c))
        else:
            out.append(x)
    return df.select(*out)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write with a header; no index column is added, so a round trip is exact."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a
    machine-local temporary folder)."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/quarry-{name}-{uuid.uuid4().hex[:12]}"
