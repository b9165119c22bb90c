"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, object] = {}
_OPEN: list[Scope] = []


class Scope:
    """Gathers the tables that are materialised while it's open, to release those that a step's result has made needless."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __enter__(self) -> Scope:
        _OPEN.append(self)
        return self

    def __exit__(self, *_) -> None:
        _OPEN.remove(self)

    def release(self, *keep: DataFrame) -> None:
        """Remove all of them but those to keep."""
        discard(*[t for t in self.tables if all(t is not k for k in keep)])
        self.tables = list(keep)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local master (one machine, as in tests) gets a folder of its own; a cluster must name one."""
    here = spark.conf.get("spark.checkpoint.dir", None)
    if not here:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        here = f"file://{tempfile.gettempdir()}/helixmark-checkpoints"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(here)
        spark.conf.set("spark.checkpoint.dir", here)
    return here.rstrip("/")


def _system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def work_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one; it goes when the driver's process ends, or by cleanup()."""
    path = f"{shared_dir(spark)}/helixmark/{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        _FOLDERS[path] = _system(spark, path)
        atexit.register(_remove, path)
    return path


def _remove(path: str) -> None:
    found = _FOLDERS.pop(path, None)
    if found is not None:
        try:
            found[0].delete(found[1], True)
        except (Py4JError, OSError):  # the JVM has ended before us: the folder stays
            pass


def cleanup(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; DataFrames that still read them end with it."""
    _remove(work_dir(spark))


def materialise(df: DataFrame, name: str, few: bool = False, reader: SparkSession | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back; few: as a file for each core at most; reader: the session that reads it, if it isn't that of df.

    Lineage ends there, a lost executor costs a reread only, and Spark knows the size: whether a join
    with the result broadcasts it follows from that size and spark.sql.autoBroadcastJoinThreshold. Few rows are
    shuffled to their files: a coalesce would run several partitions of the plan, sorts and all, in one task.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.repartition(max(1, spark.sparkContext.defaultParallelism)) if few else df).write.parquet(path)
    out = (reader or spark).read.schema(df.schema).parquet(path)
    out._helixmark_path = path
    for scope in _OPEN:
        scope.tables.append(out)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """As materialise, but a table that is read back already is taken as it is."""
    return df if hasattr(df, "_helixmark_path") else materialise(df, name)


def discard(*tables: DataFrame) -> None:
    """Remove the files of materialised tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_helixmark_path", None)
        if path:
            system, p = _system(df.sparkSession, path)
            system.delete(p, True)
