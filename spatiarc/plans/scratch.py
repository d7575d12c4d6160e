"""Tables that cut lineage, in the folder which all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a fresh one only where that is unset, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    set_dir = sc._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spatiarc-")
    sc.setCheckpointDir(own)
    return own


class Scratch:
    """Parquet tables of one run under the shared folder. As a context manager it deletes them when the block fails. Tables that a
    returned DataFrame still reads stay until ``drop``, ``drop_all`` or the end of the application."""

    live: set[Scratch] = set()

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        Scratch.live.add(self)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is not None:
            self.drop()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once; what is returned reads the files, so a lost executor costs no recomputation."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables, or everything, through Hadoop's file system (the folder may be remote)."""
        sc = self.spark.sparkContext
        for at in [self.path(n) for n in names] or [self.root]:
            path = sc._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        if not names:
            Scratch.live.discard(self)


def drop_all() -> None:
    """Delete every table that is left, when no result is read any more; it runs by itself at the end of the application."""
    for scratch in list(Scratch.live):
        if scratch.spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):  # one that can't be reached must not keep the others
                scratch.drop()


atexit.register(drop_all)


def once(df: DataFrame, name: str) -> DataFrame:
    """A table that several parts of a plan read, written so that its input is scanned once and not per reader."""
    with Scratch(df.sparkSession, name) as scratch:
        return scratch.save(df, "table")
