"""Session settings and the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "termloom", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the test-suite and the bench use."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one set in code, or a local one of our own in local mode only."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("on a cluster, spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="termloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def discard(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing reads any more."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone by then
        pass


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(discard, spark, path)
    return path


def written_path(df: DataFrame, name: str, **options: str) -> str:
    """Write ``df`` as Parquet below the shared folder and return its path.

    The files outlive a lost executor; they are removed when the driver ends.
    """
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` with its lineage cut by a table in the shared folder."""
    return df.sparkSession.read.schema(df.schema).parquet(written_path(df, name, **options))
