"""Registered queries: sources, sinks and stored state (S1, S2, S4, S5,
S9-S11).  Each writes tables derived from the supplied ones into a fresh
folder under the shared checkpoint folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.sources import crypto, files, history, workbooks
from quarry.plans.registry import register, table


def _ring(spark) -> str:
    """A key ring of its own for the query, with one random key."""
    path = files.scratch_path(spark, "keys")
    crypto.add_key(spark, path)
    return path


@register("read_csv", sql="SELECT * FROM customer")
def read_csv(spark, sf):
    cust = table(spark, sf, "customer")
    path = files.write_csv(cust, files.scratch_path(spark, "csv"))
    return files.read_csv(spark, path, schema=cust.schema)


@register("read_csv_inferred", sql="""
SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def read_csv_inferred(spark, sf):
    cust = table(spark, sf, "customer")
    path = files.write_csv(cust, files.scratch_path(spark, "csv"))
    return files.read_csv(spark, path)


@register("read_csv_quoted", sql="SELECT doc_id, text, lang, source, n_chars FROM documents")
def read_csv_quoted(spark, sf):
    """documents, whose texts hold quotes, commas and line breaks."""
    docs = table(spark, sf, "documents")
    path = files.write_csv(docs, files.scratch_path(spark, "csv"))
    return files.read_csv(spark, path, schema=docs.schema, na_values=[], multi_line=True)


@register("read_workbooks", sql="SELECT * FROM customer")
def read_workbooks(spark, sf):
    """customer written as workbooks by the executors (one or more per partition),
    then read back with one task per file."""
    cust = table(spark, sf, "customer")
    root = files.scratch_path(spark, "xlsx")
    workbooks.write_workbooks(cust.repartition(4), root)
    return workbooks.read_workbooks(spark, root, cust.schema)


@register("read_workbooks_inferred", sql="""
SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def read_workbooks_inferred(spark, sf):
    root = files.scratch_path(spark, "xlsx")
    workbooks.write_workbooks(table(spark, sf, "customer").repartition(4), root)
    return workbooks.read_workbooks(spark, root)


@register("encrypt_table")
def encrypt_table(spark, sf):
    return crypto.encrypt_table(table(spark, sf, "customer"), ["c_name", "c_acctbal"], _ring(spark))


@register("encrypt_lengths", sql="""
SELECT c_custkey, (4 + 12 + strlen(c_name) + 16)::INTEGER AS cell_bytes, true AS hidden, c_name FROM customer""")
def encrypt_lengths(spark, sf):
    """S4 cell by cell: a key number, a random nonce, as many bytes as the text and a tag,
    none of the text in it, and the text comes back."""
    cust = table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_name").alias("clear"))
    ring = _ring(spark)
    sealed = crypto.encrypt_table(cust, ["c_name"], ring)
    back = crypto.decrypt_table(sealed, cust.schema, ring, ["c_name"]).select("c_custkey", "c_name")
    cells = sealed.select(F.col("c_custkey").alias("k"), F.octet_length("c_name").alias("cell_bytes"),
                          (F.expr("instr(hex(c_name), hex(clear))") == 0).alias("hidden"))
    return cells.join(back, cells["k"] == back["c_custkey"]).select("c_custkey", "cell_bytes", "hidden", "c_name")


@register("decrypt_table", sql="SELECT * FROM customer")
def decrypt_table(spark, sf):
    cust = table(spark, sf, "customer")
    path = files.scratch_path(spark, "enc")
    ring = _ring(spark)
    crypto.encrypt_table(cust, None, ring).write.parquet(path)
    return crypto.decrypt_table(spark.read.parquet(path), cust.schema, ring)


@register("rotate_keys", sql="""
SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 3 WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS key_id FROM customer""")
def rotate_keys(spark, sf):
    """S4 and S5 over three keys: a part of the table is written under the
    first, a part under the second, and every third row is moved to the newest."""
    cust, ring, path = table(spark, sf, "customer").select("c_custkey", "c_name"), _ring(spark), files.scratch_path(spark, "enc")
    crypto.encrypt_table(cust.where("c_custkey % 2 = 1"), ["c_name"], ring).write.parquet(path)
    crypto.add_key(spark, ring)
    crypto.encrypt_table(cust.where("c_custkey % 2 = 0"), ["c_name"], ring).write.mode("append").parquet(path)
    crypto.add_key(spark, ring)
    sealed = spark.read.parquet(path)
    sealed = sealed.where("c_custkey % 3 != 0").unionByName(crypto.rotate_table(sealed.where("c_custkey % 3 = 0"), ["c_name"], ring))
    numbers = sealed.select("c_custkey", crypto.cell_key(F.col("c_name")).alias("key_id"))
    return crypto.decrypt_table(sealed, cust.schema, ring, ["c_name"]).join(numbers, "c_custkey")


@register("snapshot_save", sql="SELECT * FROM nation")
def snapshot_save(spark, sf):
    h = history.History(spark)
    return h.save(table(spark, sf, "nation"))


@register("snapshot_undo", sql="SELECT * FROM nation")
def snapshot_undo(spark, sf):
    h = history.History(spark)
    nation = table(spark, sf, "nation")
    h.save(nation)
    h.save(nation.where(F.col("n_regionkey") == 1))
    return h.undo()


@register("snapshot_redo", sql="SELECT * FROM nation WHERE n_regionkey = 1")
def snapshot_redo(spark, sf):
    h = history.History(spark)
    nation = table(spark, sf, "nation")
    h.save(nation)
    h.save(nation.where(F.col("n_regionkey") == 1))
    h.undo()
    return history.History.open(spark, h.root).redo()
