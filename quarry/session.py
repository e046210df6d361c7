"""Session construction and lineage helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "quarry", extra: dict | None = None) -> SparkSession:
    """Session for tests and local runs.  On a cluster, pass ``master=None`` and
    let the submitting environment set the master and the checkpoint folder."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
    }
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in the Python workers: zip the package once
    per application and hand it to ``SparkContext.addPyFile``, which
    distributes it to every executor (grouped pandas functions and pandas
    UDFs are pickled by module reference)."""
    import os
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import quarry

    pkg = os.path.dirname(os.path.abspath(quarry.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-code-"), "quarry.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, names in os.walk(pkg):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``.  Only where it is unset and the master is a
    single local process (tests) is a private temporary folder registered;
    on a cluster an unset folder is an error, as executors could not read
    each other's files."""
    sc = spark.sparkContext
    current = sc.getConf().get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if not current:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="quarry-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    ship_package(spark)
    return sc.getCheckpointDir() or current


#: Application -> paths of the tables that ``cut_lineage`` wrote and that are
#: still there.
_CUTS: dict[str, list[str]] = {}


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder
    and read it back: one job, lineage cut, and the files survive executor
    loss (unlike a local checkpoint).  ``DataFrame.checkpoint`` would compute
    the data twice unless it were also persisted.  The table stays until
    ``drop_cuts`` is told that nothing reads it any more."""
    import uuid

    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/quarry-cut-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    _CUTS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.parquet(path)


def cuts_of(spark: SparkSession) -> list[str]:
    """The tables that ``cut_lineage`` has written and not dropped, in order."""
    return list(_CUTS.get(spark.sparkContext.applicationId, []))


def drop_cuts(spark: SparkSession, paths: list[str], still_read_by: DataFrame | None = None) -> None:
    """Delete tables written by ``cut_lineage`` in this application, but for
    those that ``still_read_by`` reads."""
    sc = spark.sparkContext
    mine = _CUTS.get(sc.applicationId, [])
    files = still_read_by.inputFiles() if still_read_by is not None and paths else []
    for path in paths:
        name = path.rsplit("/", 1)[-1]
        if path in mine and not any(f"/{name}/" in f for f in files):
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
            mine.remove(path)
