"""Session settings and the shared scratch folder that long jobs write to."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: With it, the shuffle files of a write go when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str = "local[*]", app: str = "strandloom", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session with the settings the operators assume: UTC and adaptive execution."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where the setting is missing on a local master (tests), a local folder is made and set, so that later calls agree. On a cluster
    that is an error: executors don't share a machine's own folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if not found and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir() or found
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


_written: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under scratch_root()."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextlib.contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _cleaned(spark):
        df.select("*").write.parquet(path)  # the setting is read when a plan is made
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_tables(*tables: DataFrame) -> None:
    """Delete tables that materialise() wrote, once nothing reads them any more."""
    for t in tables:
        files = t.inputFiles()
        if files:
            drop_path(t.sparkSession, files[0].rpartition("/")[0])


def tidied(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """build()'s result as a written table; all else that build() wrote is deleted."""
    own = _written.setdefault(spark.sparkContext.applicationId, [])
    before = len(own)
    out = materialise(build(), name)
    for path in own[before:-1]:
        drop_path(spark, path)
    del own[before:-1]
    return out


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this session has written to the shared folder. Results that still read it fail afterwards."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        drop_path(spark, path)
