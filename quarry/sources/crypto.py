"""Encrypt a table cell by cell at rest, and read it back.

Each chosen cell becomes the number of its key (4 bytes) and
``aes_encrypt(cast(cell as string), key, 'GCM')`` (a fresh random nonce per
cell), all JVM-side.  Keys lie in a table of their own, a *key ring* in a folder
that only those may read who may read the cells.  The plan reads it by a scalar
subquery when it runs, so no plan, explain text or event log shows a key.  New
cells take the newest key; old ones say which key they need, so keys can be
rotated at any time, and ``rotate_table`` moves old cells to the newest key.
Decryption casts the text back to the original type, given the original schema,
so the round trip is exact (Spark's double-to-string keeps every digit needed).
"""

from __future__ import annotations

import base64
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.columns import require_columns

#: Bytes in front of a cell that hold the number of its key.
ID_BYTES = 4


def add_key(spark: SparkSession, ring: str, key: bytes | None = None) -> int:
    """Add a key (a random one of 32 bytes unless given) to the ring at path
    ``ring`` and return its number; it is used for new cells from then on."""
    raw = secrets.token_bytes(32) if key is None else key
    if len(raw) not in (16, 24, 32):
        raise ValueError("key must be 16, 24 or 32 bytes")
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ring)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    number = (read_ring(spark, ring).agg(F.max("key_id")).first()[0] if there else 0) + 1
    spark.createDataFrame([(number, base64.b64encode(raw).decode())], _RING).coalesce(1).write.mode("append").json(ring)
    return number


_RING = "key_id int, key string"


def read_ring(spark: SparkSession, ring: str) -> DataFrame:
    return spark.read.schema(_RING).json(ring).select("key_id", F.unbase64("key").alias("key"))


def _newest(ring: DataFrame) -> Column:
    """The newest key and its number, read when the plan runs."""
    return ring.agg(F.max(F.struct("key_id", "key"))).scalar()


def _keys(ring: DataFrame) -> Column:
    return ring.agg(F.map_from_entries(F.collect_list(F.struct("key_id", "key")))).scalar()


def _seal(text: Column, newest: Column) -> Column:
    number = F.unhex(F.lpad(F.hex(newest["key_id"].cast("long")), 2 * ID_BYTES, "0"))
    return F.when(text.isNotNull(), F.concat(number, F.aes_encrypt(text, newest["key"], F.lit("GCM"))))


def cell_key(cell: Column) -> Column:
    """The number of the key that a cell needs."""
    return F.conv(F.hex(F.substring(cell, 1, ID_BYTES)), 16, 10).cast("int")


def _open(cell: Column, keys: Column) -> Column:
    body = F.substring(cell, F.lit(ID_BYTES + 1), F.octet_length(cell))
    return F.aes_decrypt(body, F.element_at(keys, cell_key(cell)), F.lit("GCM")).cast("string")


def encrypt_table(df: DataFrame, cols: list[str] | None, ring: str) -> DataFrame:
    """The chosen columns (all when ``cols`` is None) become encrypted
    binary, under the newest key of the ring at path ``ring``."""
    cols = cols if cols is not None else df.columns
    require_columns(df, cols)
    held = df.withColumn("__key", _newest(read_ring(df.sparkSession, ring)))
    return held.select(*[_seal(F.col(c).cast("string"), F.col("__key")).alias(c) if c in cols else F.col(c) for c in df.columns])


def decrypt_table(df: DataFrame, schema: T.StructType, ring: str, cols: list[str] | None = None) -> DataFrame:
    """Decrypt and cast back to ``schema``'s types."""
    cols = cols if cols is not None else [f.name for f in schema.fields]
    held = df.withColumn("__keys", _keys(read_ring(df.sparkSession, ring)))
    return held.select(*[_open(F.col(f.name), F.col("__keys")).cast(f.dataType).alias(f.name) if f.name in cols else F.col(f.name)
                         for f in schema.fields])


def rotate_table(df: DataFrame, cols: list[str], ring: str) -> DataFrame:
    """Cells under an older key, encrypted anew under the newest one."""
    require_columns(df, cols)
    keys = read_ring(df.sparkSession, ring)
    held = df.withColumns({"__key": _newest(keys), "__keys": _keys(keys)})

    def anew(c: str) -> Column:
        cell = F.col(c)
        return F.when(cell_key(cell) == F.col("__key.key_id"), cell).otherwise(_seal(_open(cell, F.col("__keys")), F.col("__key")))

    return held.select(*[anew(c).alias(c) if c in cols else F.col(c) for c in df.columns])
