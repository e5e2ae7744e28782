"""Session helpers: shared scratch tables, lineage cuts and scan parallelism."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_SCRATCH: dict[str, str] = {}
_CUTS: list[str] = []
_SHIPPED: set[str] = set()


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of all executors, once per application.

    Functions that run in workers are found by import there; executors need not have it installed.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="braidframe-"), "braidframe.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(home):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("braidframe", os.path.relpath(full, home)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, local sessions (tests) get a
    temporary folder of this machine, others a folder in the warehouse; a warehouse on the machines' own
    disks is refused, since executors do not share it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        home = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(home)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return home + "/braid-scratch"
    app = spark.sparkContext.applicationId
    if app not in _OWN_SCRATCH:
        _OWN_SCRATCH[app] = "file://" + tempfile.mkdtemp(prefix="braidframe-")
    return _OWN_SCRATCH[app]


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike ``checkpoint()`` this computes the plan a single time, and unlike ``localCheckpoint`` the
    rows survive the loss of an executor. The table stays until :func:`drop_cuts`, since lazy results
    may still read it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/braid-{label}-{uuid.uuid4().hex}"
    df.write.parquet(note(path))
    return spark.read.schema(df.schema).parquet(path)


def note(path: str) -> str:
    """Remember an intermediate folder, so that :func:`drop_cuts` deletes it."""
    _CUTS.append(path)
    return path


def drop_cuts(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far; results that read them must have been taken. Returns their number."""
    paths = spark._jvm.org.apache.hadoop.fs
    dropped = 0
    while _CUTS:
        path = paths.Path(_CUTS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        dropped += 1
    return dropped


def spread(df: DataFrame, *keys: str, source: DataFrame | None = None) -> DataFrame:
    """Give a CPU-heavy per-row stage enough tasks.

    A scan of few, small files yields fewer partitions than the cluster has cores. Only then are the
    rows exchanged (hash of ``keys``, so that a retried task gets the same rows); a scan that already
    splits well is left alone and no text is shuffled. ``source`` is the scan to look at where ``df``
    joins control tables to it. A plan with exchanges is left alone: counting its partitions would run
    it.
    """
    scan = df if source is None else source
    if "Adaptive" in scan._jdf.queryExecution().executedPlan().nodeName():
        return df
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, 1)
    if scan.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted * 3, *[F.col(k) for k in keys])


def task_count(spark: SparkSession) -> int:
    """Tasks for a CPU-heavy stage behind an exchange, whose size in bytes says little about its work."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Collect a control table (aliases, targets, limits) after proving its size."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows; it is read as a control table")
    return rows
