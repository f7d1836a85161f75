"""Sessions, and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[tuple[str, str], str] = {}


def build(app: str = "noticelake", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; partitions are left to the cluster's settings."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application inside ``spark.checkpoint.dir``, with its file system named.

    A path without a scheme belongs to the default file system.  Where the setting is absent, a
    session on one machine takes a temporary folder and a cluster's is refused.  The folder goes when the
    driver ends.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(base)
    known = (context.applicationId, base)
    if known not in _FOLDERS:
        path = context._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/noticelake/{context.applicationId}")
        system = path.getFileSystem(context._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _FOLDERS[known] = system.makeQualified(path).toString()
    return _FOLDERS[known]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: the lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to all tasks by ``keys``, before steps whose cost is not in their bytes.

    A file of few row groups feeds few tasks, and adaptive execution joins small partitions; a fixed number of them it leaves as it is.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *keys)


def short_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound an Arrow batch by rows, so that very long texts can't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
