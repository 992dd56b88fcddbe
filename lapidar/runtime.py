"""Session-level helpers: reading tables, cutting lineage, sizing."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; one of our own only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = own.get() if own.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lapidar-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that lineage is cut and a lost executor costs no recomputation.

    ``keep`` writes a frame and returns it as read back (its size is then known to the planner);
    of a name's tables the last two stay, as each is made from the one before. ``drop`` removes
    tables that no later step reads. What the caller's result still reads stays in the folder,
    below one path for each operator call; ``close`` removes it once the result is written, ``release`` what all calls left.
    """

    made: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        Scratch.made.append(self)
        self.root = f"{shared_dir(spark)}/lapidar-{uuid.uuid4().hex}"
        self.names: dict[str, int] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        n = self.names[name] = self.names.get(name, -1) + 1
        path = f"{self.root}/{name}-{n}"
        df.write.mode("errorifexists").parquet(path)
        if n > 1:
            self._delete(f"{self.root}/{name}-{n - 2}")
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, name: str, only: Column | None = None) -> tuple[DataFrame, int]:
        """keep, and how many of its rows there are (for which ``only`` holds), read from the written table."""
        out = self.keep(df, name)
        return out, (out if only is None else out.where(only)).count()

    def drop(self, *names: str) -> None:
        for name in names:
            for n in range(self.names.get(name, -1) + 1):
                self._delete(f"{self.root}/{name}-{n}")

    def close(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Removes the tables of all operator calls so far; to be called when their results are written."""
    while Scratch.made:
        Scratch.made.pop().close()


def spread(scan: DataFrame) -> DataFrame:
    """A scan dealt out over all cores where its files give fewer splits than that; larger scans stay as they are.

    Only for plain scans ahead of costly Python work: counting the splits plans the frame.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(3 * cores) if scan.rdd.getNumPartitions() < 2 * cores else scan


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package, once for each application, whatever their working folder or path."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    file = Path(tempfile.mkdtemp(prefix="lapidar-")) / "lapidar_package.zip"
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(file))
    _shipped.add(app)
