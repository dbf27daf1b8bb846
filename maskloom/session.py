"""Session settings, the shared scratch folder, and two helpers every job uses."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "maskloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators were tuned with."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
        if master.startswith("local"):
            # both are needed: with only the bind address, large results are lost
            settings["spark.driver.host"] = "127.0.0.1"
            settings["spark.driver.bindAddress"] = "127.0.0.1"
            settings["spark.ui.enabled"] = "false"
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the warehouse that the session names.

    Spark asks that these folders be shared, so a path without the address of a file system is taken as it is: many
    clusters mount one at the same place on all machines. (Spark warns where such a path is on a local disk.) Where a
    cluster names neither this fails, because a folder of one machine would lose data there. A local session without
    the settings gets a temporary folder.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = context.getCheckpointDir()
    if not base and not context.master.startswith("local"):
        base = context.getConf().get("spark.sql.warehouse.dir", None)
        if not base:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="maskloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return qualified(spark, base).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the address of its file system, so that workers outside the JVM open the same place."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(place).toString()


@contextmanager
def shipped_zip() -> Iterator[str]:
    """A zip of this package, as long as the block lasts."""
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory(prefix="maskloom-ship-") as folder:
        yield shutil.make_archive(f"{folder}/maskloom", "zip", root.parent, root.name)


def ship_package(spark: SparkSession) -> None:
    """Give executors this package where it is not installed: a zip of it is added to the session's files.

    Call it once after the session starts. With the package installed on all machines it is not needed. The zip is
    served by the driver to each executor; it stays until the driver ends.
    """
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="maskloom-ship-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/maskloom", "zip", root.parent, root.name))


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/maskloom-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{_run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables this application wrote by ``materialise``. Call it when no result is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Use it where a costly result is read more than once: the lineage ends here, readers prune columns, and a
    lost executor re-reads files instead of repeating the work.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a scan of few splits enough partitions to use every core.

    A large table has more splits than cores and passes unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Whole texts and sets are large rows: unless the session says otherwise, 500 of them are a batch."""
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, "500")


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after checking that ``df`` has at most ``max_rows`` rows."""
    if df.limit(max_rows + 1).count() > max_rows:
        return df
    return F.broadcast(df)
