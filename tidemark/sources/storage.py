"""Versioned tables, backups and intermediate tables as Parquet folders.

Paths go through Hadoop's file system layer, so any store that Spark reads will do.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPLETE = "_COMPLETE"


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of our own in local mode and an error on a cluster, whose
    executors would not share it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{folder(spark)}/tidemark/{uuid.uuid4().hex}"
    fs, at = file_system(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{path}/data"


def stored(df: DataFrame, *by: str) -> DataFrame:
    """df written once as Parquet, in a folder for each value of `by`, and read back: cuts the lineage and gives true sizes to
    the planner."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def spread(df: DataFrame, bytes_a_core: int = 128 << 20) -> DataFrame:
    """A small input, which may lie in a single row group, dealt out to all cores; a larger one as it is, since its own splits are
    enough and a shuffle would cost more than it gains. Spark's estimate of the size decides; rows are the same."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * bytes_a_core else df


def kept(spark: SparkSession, name: str, sources: list[str], build: Callable[[str], object]) -> str:
    """The folder of something that is built from files once and read by all later queries, in other applications too where the
    shared folder is the same. Its name holds `name`, to which a new format gives a new number, and the sources' files, their sizes and
    times, so changed sources are built anew; it is there once it is whole, and of two builders at a time one wins."""
    seen = []
    for source in sources:
        fs, at = file_system(spark, source)
        found = fs.listFiles(at, True)
        while found.hasNext():
            x = found.next()
            seen.append(f"{x.getPath()} {x.getLen()} {x.getModificationTime()}")
    path = f"{folder(spark)}/tidemark-kept/{name}-{hashlib.sha256(chr(10).join([name, *sorted(seen)]).encode()).hexdigest()[:32]}"
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        own = scratch(spark)
        build(own)
        fs.mkdirs(at.getParent())
        fs.rename(file_system(spark, own)[1], at)
    return path


def file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def entries(spark: SparkSession, path: str) -> list[str]:
    fs, at = file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


class Tables:
    """Named tables under a root, each a series of whole versions (v000001, ...). A version counts once
    its mark is there, so a failed write leaves the last good one; older versions beyond `keep` go."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def versions(self, name: str) -> list[str]:
        whole = lambda v: file_system(self.spark, f"{self.root}/{name}/{v}/{COMPLETE}")
        return [v for v in entries(self.spark, f"{self.root}/{name}") if v[0] == "v" and (lambda fs, at: fs.exists(at))(*whole(v))]

    def read(self, name: str) -> DataFrame:
        found = self.versions(name)
        if not found:
            raise LookupError(f"no table {name} in {self.root}")
        return self.spark.read.parquet(f"{self.root}/{name}/{found[-1]}/data")

    def write(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> None:
        old = self.versions(name)
        at = f"{self.root}/{name}/v{int(old[-1][1:]) + 1 if old else 1:06d}"
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{at}/data")
        fs, mark = file_system(self.spark, f"{at}/{COMPLETE}")
        fs.create(mark).close()
        for v in old[: len(old) + 1 - self.keep]:
            fs, gone = file_system(self.spark, f"{self.root}/{name}/{v}")
            fs.delete(gone, True)

    def names(self) -> list[str]:
        return [n for n in entries(self.spark, self.root) if n[0] not in "._"]

    def compact(self, name: str, files: int) -> None:
        """Rewrites a table into fewer files."""
        self.write(name, self.read(name).coalesce(files))

    def fragments(self, name: str) -> DataFrame:
        """(file, rows) of the current version."""
        return self.read(name).groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("rows"))

    def backup(self, to: str, label: str, keep: int = 8) -> list[str]:
        """Copies every table to `to`/label and keeps the newest `keep` labels; returns those."""
        for name in self.names():
            self.read(name).write.mode("errorifexists").parquet(f"{to}/{label}/{name}")
        labels = entries(self.spark, to)
        for old in labels[: max(0, len(labels) - keep)]:
            fs, gone = file_system(self.spark, f"{to}/{old}")
            fs.delete(gone, True)
        return labels[-keep:]

    def migrate(self, steps: dict[int, object]) -> list[int]:
        """Runs the steps (version -> function of these tables) that are not recorded yet, in order; each
        is recorded once it is done."""
        done = {r.version for r in self.read("migrations").collect()} if self.versions("migrations") else set()
        ran = []
        for version in sorted(set(steps) - done):
            steps[version](self)
            done.add(version)
            self.write("migrations", self.spark.createDataFrame([(v,) for v in sorted(done)], "version int"))
            ran.append(version)
        return ran
