"""Session set-up and the two ways this library cuts lineage.

Both write to the folder in ``spark.checkpoint.dir``, which all executors share, so a lost executor costs a
re-read and never the result. Only with a local master, where that setting is absent (tests, a laptop), a private
folder is made; on a cluster it must be set.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_spools: list[tuple[SparkSession, str]] = []


def get_spark(app: str = "knotwork", cpus: int | str | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus if str(cpus).isdigit() else 8))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver found it; once per context."""
    sc = spark.sparkContext
    root = str(Path(__file__).resolve().parent.parent)
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
        if not sc.master.startswith("local"):  # executors elsewhere get a copy
            base = os.path.join(tempfile.mkdtemp(prefix="knotwork-"), "knotwork")
            sc.addPyFile(shutil.make_archive(base, "zip", root, "knotwork"))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir`` if set, else the context's own, else a fresh local one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="knotwork-"))
        current = sc._jsc.sc().getCheckpointDir()
    return named or current.get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage. A written table does it in one pass, where a checkpoint runs the plan twice."""
    return spool(df)


def spool_counted(df: DataFrame, **marks: Column) -> tuple[DataFrame, dict]:
    """`spool`, with the number of rows and the aggregates ``marks`` observed while they are written."""
    observed = Observation()
    table = spool(df.observe(observed, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in marks.items())))
    return table, observed.get


def spool(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write to a compressed table in the shared folder and read it back: for wide rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/spool-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _spools.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _drop_spools() -> None:
    for spark, path in _spools:
        try:
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
        except Exception:  # the session has ended; its folder is the cluster's to clear
            pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of input for one partition of a range sort.
RANGE_BYTES = 64 << 20


def range_partitions(df: DataFrame) -> int:
    """Partitions for a range sort of ``df``: the session's number, or more where the files it reads are large."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)  # a table that is no file has no size
    return max(shuffle_partitions(df.sparkSession), min(-(-known // RANGE_BYTES), 1 << 17))
