"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "lanewise", **conf: str) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": cores if cores.isdigit() else "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="lanewise-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def write_table(df: DataFrame, name: str, cluster_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once and return it as a plain parquet scan.

    ``cluster_by`` range-partitions the files, so that filters on its leading column skip
    row groups. Give a unique last column: it splits a hot leading value over many files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    out = df
    if cluster_by:
        out = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    out.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
