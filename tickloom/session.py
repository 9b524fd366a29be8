"""Session defaults, table loading and the shared folder that lineage is cut in."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings for local work; a cluster's own configuration is never overridden.
LOCAL = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("tickloom").config("spark.driver.memory", memory)
    for k, v in (LOCAL | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``, or one of our own in local mode only."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    d = tempfile.mkdtemp(prefix="tickloom-")
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{d}")
    return f"file://{d}"


_SCRATCH: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ``release`` deletes."""
    if not _SCRATCH:
        atexit.register(_at_exit)
    path = f"{shared_dir(spark)}/tickloom/{name}-{uuid.uuid4().hex}"
    _SCRATCH.add(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete all tables written so far; to be called when the results that were made of them have been read or stored."""
    sc, n = spark.sparkContext, 0
    for path in sorted(_SCRATCH):
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        n += bool(p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True))
    _SCRATCH.clear()
    return n


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and _SCRATCH:
            release(spark)
    except Exception:  # noqa: BLE001 - the session may be gone
        pass
    for path in _SCRATCH:
        if path.startswith("file://"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder once and read it back.

    Unlike a cache the written table survives the loss of any executor, and what is read
    from it again is columnar, so later stages prune it. It is written when the plan is made,
    that is before the result is asked for, and kept until ``release``, since no one else knows
    when the plans that read it have run; at the latest it is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
