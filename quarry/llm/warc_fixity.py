"""WARC records and a Merkle fixity audit of replicas.

Pages become WARC records, each task writing its own files: a record's offset
is where the one before it ends.  A leaf hashes a record with its place in the
file; an inner node hashes up to ``FANOUT`` children in order and stands for
the offset range they cover.  The audit compares the roots of two replicas and
goes down only below nodes that differ, a join per level on that frontier, to
the records that were changed, lost or added.

Everything after the records is DataFrame functions; a node is a row, a group
has at most ``FANOUT`` rows, and trees of all files grow together, one grouped
pass per level.

Results: null urls and bodies are empty; repeated rows are records of their
own; null ids are kept; an empty table has no files, and two empty replicas
agree.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import prepare
from quarry.session import cut_lineage

FANOUT = 16
#: Bytes after which a task starts another file.
FILE_BYTES = 1 << 30


def record_bytes(url: Column, body: Column, page_id: Column, date: str) -> Column:
    """A resource record in WARC/1.1."""
    url, body = F.coalesce(url.cast("string"), F.lit("")), F.coalesce(body.cast("string"), F.lit(""))
    name = F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("")), F.lit(" "), url).cast("binary"))
    uuid = F.concat_ws("-", F.substring(name, 1, 8), F.substring(name, 9, 4), F.substring(name, 13, 4),
                       F.substring(name, 17, 4), F.substring(name, 21, 12))
    header = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid,
                      F.lit(">\r\nWARC-Target-URI: "), F.regexp_replace(url, "[\\r\\n]", " "),
                      F.lit(f"\r\nWARC-Date: {date}\r\nContent-Type: text/html\r\nContent-Length: "),
                      F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(header, body, F.lit("\r\n\r\n")).cast("binary")


def warc_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                 date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """``file, nth, offset, length, page_id, record``, written to the shared
    checkpoint folder (files and offsets are final then)."""
    prepare(pages.sparkSession)
    src = pages.select(F.col(id_col).alias("page_id"), record_bytes(F.col(url_col), F.col(body_col), F.col(id_col), date).alias("record"))

    def run(batches):
        part, file, nth, offset = TaskContext.get().partitionId(), 0, 0, 0
        for b in batches:
            names, number, start, length = [], [], [], []
            for r in b.column("record"):
                size = len(r.as_buffer())
                if offset and offset + size > file_bytes:
                    file, nth, offset = file + 1, 0, 0
                names.append(f"part-{part:06d}-{file:04d}.warc")
                number.append(nth)
                start.append(offset)
                length.append(size)
                nth, offset = nth + 1, offset + size
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *[pa.array(x, pa.int64()) for x in (number, start, length)],
                 b.column("page_id"), b.column("record")], names=["file", "nth", "offset", "length", "page_id", "record"])

    id_type = src.schema["page_id"].dataType.simpleString()
    return cut_lineage(src.mapInArrow(run, f"file string, nth long, offset long, length long, page_id {id_type}, record binary"))


def leaves(records: DataFrame) -> DataFrame:
    """``file, level, idx, start, end, hash`` of the records."""
    # a leaf and an inner node never hash the same bytes: their first character differs
    place = F.concat_ws(":", F.lit("leaf"), F.col("offset").cast("string"), F.col("length").cast("string"), F.sha2("record", 256))
    return records.select("file", F.lit(0).alias("level"), F.col("nth").alias("idx"), F.col("offset").alias("start"),
                          (F.col("offset") + F.col("length")).alias("end"), F.sha2(place, 256).alias("hash"))


def depth_of(*replicas: DataFrame) -> int:
    """Levels above the leaves that bring every file to one root."""
    most = max([r.agg(F.max("nth")).first()[0] or 0 for r in replicas], default=0)
    depth = 1
    while most >= FANOUT**depth:
        depth += 1
    return depth


def tree(records: DataFrame, depth: int) -> list[DataFrame]:
    """The levels of every file's tree, leaves first, each written."""
    levels = [cut_lineage(leaves(records))]
    for level in range(1, depth + 1):
        below = levels[-1]
        children = F.transform(F.sort_array(F.collect_list(F.struct("idx", "hash"))), lambda c: F.concat_ws("=", c["idx"], c["hash"]))
        levels.append(cut_lineage(
            below.groupBy("file", F.floor(F.col("idx") / FANOUT).alias("idx")).agg(
                F.min("start").alias("start"), F.max("end").alias("end"),
                F.sha2(F.concat(F.lit("node:"), F.array_join(children, ",")), 256).alias("hash"))
            .select("file", F.lit(level).alias("level"), "idx", "start", "end", "hash")))
    return levels


def audit(left: list[DataFrame], right: list[DataFrame]) -> DataFrame:
    """``file, nth, start, end, status`` of the records that differ between two
    trees of equal depth: ``corrupt``, ``missing`` (only left) or ``extra``
    (only right)."""
    frontier = None
    for a, b in zip(reversed(left), reversed(right), strict=True):
        def side(level: DataFrame, name: str) -> DataFrame:
            if frontier is not None:
                below = frontier.select("file", F.col("idx").alias("up"))
                level = level.withColumn("up", F.floor(F.col("idx") / FANOUT)).join(below, ["file", "up"], "left_semi")
            return level.select("file", "idx", F.struct("start", "end", "hash").alias(name))

        both = side(a, "l").join(side(b, "r"), ["file", "idx"], "full")
        frontier = cut_lineage(both.filter(~F.col("l.hash").eqNullSafe(F.col("r.hash"))))
    status = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").otherwise("corrupt")
    place = F.coalesce("l", "r")
    return frontier.select("file", F.col("idx").alias("nth"), place["start"].alias("start"), place["end"].alias("end"),
                           status.alias("status"))


def fixity_report(records: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of either replica: ``page_id, file, nth, offset, length,
    record_sha256, status`` with ``intact`` where both agree."""
    depth = depth_of(records, replica)
    found = audit(tree(records, depth), tree(replica, depth)).select("file", "nth", "status")
    extra = replica.join(found.filter("status = 'extra'").select("file", "nth"), ["file", "nth"], "left_semi")
    every = records.unionByName(extra).join(found, ["file", "nth"], "left")
    return every.select("page_id", "file", "nth", "offset", "length", F.sha2("record", 256).alias("record_sha256"),
                        F.coalesce("status", F.lit("intact")).alias("status"))
