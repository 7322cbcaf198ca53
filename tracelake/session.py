"""Session defaults and durable intermediate results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tracelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, adaptive execution)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    A local session that leaves it unset gets a folder inside its warehouse; on a cluster a
    missing setting is an error, as executors share no local folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tracelake"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def folder_of(spark: SparkSession, name: str):
    """The file system and path object of ``name``, in whatever store it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts the lineage, survives lost executors and gives the planner real sizes. The table is
    removed when the application ends.
    """
    spark = df.sparkSession
    path = scratch(spark, "tables")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new name in the shared folder for files of this application, which are removed when it ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"
    files, place = folder_of(spark, path)
    files.deleteOnExit(place)
    return path


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffles behind tables already written.

    Spark's cleaner removes a shuffle's files once the driver's memory no longer refers to it, so the driver is
    asked to collect garbage; otherwise the files of all steps of a long job lie side by side.
    """
    spark.sparkContext._jvm.System.gc()
