"""Spark session and cluster-level settings shared by every job."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC dates (coerce_date), AQE for runtime
# re-planning (broadcast conversion, partition coalescing, skew splits).
_BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Unicode lower-casing through the JDK tables instead of ICU: same
    # mappings for text, several times faster on non-ASCII strings.
    "spark.sql.icu.caseMappings.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # A scorer call must not be made twice for one row (see operators.scoring).
    "spark.speculation": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "textrisk") -> SparkSession:
    """Build (or reuse) a session with the library's settings.

    On a cluster ``master`` stays None and the launcher decides; tests pass
    ``local[*]`` and a small partition count.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in _BASE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        # Local mode runs every task inside the driver JVM.
        b = b.config("spark.driver.memory", os.environ.get("TEXTRISK_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply runtime SQL settings to a session the caller already owns. The package's
    functions are pickled by value, so Python workers need no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules["textrisk"])
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
              "spark.sql.icu.caseMappings.enabled"):
        spark.conf.set(k, _BASE_CONF[k])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediates: the one the cluster names in
    ``spark.checkpoint.dir``. Only a local session may leave it unset and gets a
    scratch folder; on a cluster that is an error, since executors on other
    machines could not see a folder of the driver."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="textrisk-scratch-")
        spark.sparkContext.setCheckpointDir(d)
    return d


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new sub-path of the shared folder for one written intermediate."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and continue from there.

    Used where a result is read several times (prepared tokens, topic words,
    window counts): the lineage is cut, the plan stays small, later reads take
    only the columns they need, and a lost executor re-reads the files instead
    of recomputing the whole chain. ``clear_scratch`` deletes them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


PART_BYTES = 2 << 20  # bytes of Parquet files that one task starts from


def parts_of(df: DataFrame) -> int:
    """Into how many parts to deal rows read from files, so that what a task holds does not grow with
    the input: one per ``PART_BYTES`` of the files, at least as many as a shuffle has."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    held = 0
    for folder in {f.rpartition("/")[0] if len(files) > 1 else f for files in [df.inputFiles()] for f in files}:
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        held += at.getFileSystem(conf).getContentSummary(at).getLength()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // PART_BYTES))


def clear_scratch(spark: SparkSession) -> None:
    """Delete this session's written intermediates at the end of a job."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(conf).delete(path, True)
