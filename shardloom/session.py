"""Session settings and tables stored in the cluster's shared folder."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

STORED_AS = "zstd"  # tables that are read back once or a few times: fewer bytes for little more time
_LOCAL_FOLDERS: dict[str, str] = {}


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shardloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a temporary one in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _LOCAL_FOLDERS:
        folder = tempfile.mkdtemp(prefix="shardloom-")
        context.setCheckpointDir(folder)
        _LOCAL_FOLDERS[context.applicationId] = folder
    return _LOCAL_FOLDERS[context.applicationId]


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its file system, the session's default one if it names none.

    On a cluster a path on a machine's own disk would scatter files over the executors: only one below the shared folder,
    which the cluster vouches for, is taken.
    """
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    full = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(found).toString()
    scheme, _, rest = full.partition(":")
    if scheme == "file":
        full = "file://" + "/" + rest.lstrip("/")
        shared = shared_dir(spark).removeprefix("file:").rstrip("/") + "/"
        if not spark.sparkContext.master.startswith("local") and not full[7:].startswith("/" + shared.lstrip("/")):
            raise ValueError(f"not a folder that every executor can reach: {path}")
    return full


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    It cuts the lineage, so lost executors recompute nothing upstream, and it gives Spark the table's
    real size: a later join broadcasts it only under spark.sql.autoBroadcastJoinThreshold.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path, compression=STORED_AS)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(module: str) -> None:
    """Send a module's functions with the tasks, so that workers need not have the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
