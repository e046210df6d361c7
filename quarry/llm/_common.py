"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir

#: Bytes of one Arrow batch handed to Python, so that batches of very long
#: texts stay small (rows alone would not bound them).
BATCH_BYTES = 8 << 20
#: Rows that the Parquet reader decodes at once, and bytes of the pages that are
#: written.  The reader holds a column of a batch in one array, the writer a page;
#: for texts, Spark's defaults (4,096 rows, 1 MB) give arrays so large that the
#: executors' collector starts cycle after cycle and doubles the heap.
READ_ROWS = 128
PAGE_BYTES = 256 << 10

# Options of mallopt.
M_TRIM_THRESHOLD, M_MMAP_THRESHOLD = -1, -3


def prepare(spark: SparkSession) -> None:
    """Shared checkpoint folder, package on the workers, bounded Arrow batches,
    short Parquet batches and pages."""
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    spark.conf.set("parquet.page.size", str(PAGE_BYTES))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def shuffle_width(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def _tidy(own: str) -> None:
    """Forget the tables of all modules but ``own`` and hand freed memory back."""
    gc.unfreeze()
    for name in ("bpe_codec", "packing", "token_counts"):
        module = sys.modules.get(f"quarry.llm.{name}")
        if module is not None and name != own:
            module._WORKER.clear()
    gc.collect()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):                   # the C library of GNU systems
        # large arrays stay mappings of their own, which are handed back when freed
        for option in (M_MMAP_THRESHOLD, M_TRIM_THRESHOLD):
            libc.mallopt(option, 4 << 20)
        libc.malloc_trim(0)


def tidy_task(run, own: str = ""):
    """``run`` for ``mapInArrow``.  Python workers outlive tasks, and some
    modules keep tables in them from task to task; the operators of a pipeline
    must not add up.  So tables of other modules are forgotten before a task,
    and what the task has freed is handed back after it."""
    def tidy(batches):
        _tidy(own)
        gc.freeze()                                    # what is left stays: no need to look through it again
        gc.set_threshold(100_000, 20, 50)              # tasks make millions of small objects, hardly any in cycles
        yield from run(batches)
        _tidy(own)

    return tidy
