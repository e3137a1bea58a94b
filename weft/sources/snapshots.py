"""Tables as versioned snapshots: a write never touches what readers see."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Snapshots:
    """Versions of one table under a folder of any file system Spark can write.

    A version is a folder ``v=N``; it counts once its ``_SUCCESS`` mark is there, which Spark's committer
    writes last, so a job that dies leaves the version before in place.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        root = self._path(self.path)
        if not self._fs.exists(root):
            return []
        found = [s.getPath() for s in self._fs.listStatus(root)]
        return sorted(int(p.getName()[2:]) for p in found if p.getName().startswith("v=") and self._fs.exists(self._path(p, "_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame:
        own = self.versions()
        return self.spark.read.parquet(f"{self.path}/v={own[-1] if version is None else version}")

    def write(self, df: DataFrame, partition_by: list[str] | None = None, attempts: int = 5) -> int:
        """Write the next version and return its number.

        A version that another writer has begun is never overwritten: the number after it is tried, up
        to ``attempts`` times.  The folder is claimed by creating it, which one writer only can do where
        the file system creates atomically.
        """
        for _ in range(attempts):
            number = max(self._begun(), default=0) + 1
            claim = self._path(f"{self.path}/claim-{number}")
            self._fs.mkdirs(self._path(self.path))
            if not self._fs.createNewFile(claim):
                continue
            try:
                writer = df.write.mode("errorifexists")
                (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/v={number}")
            finally:
                if self._fs.exists(self._path(f"{self.path}/v={number}")):
                    self._fs.delete(claim, False)
            return number
        raise RuntimeError(f"no free version under {self.path} after {attempts} attempts")

    def _begun(self) -> list[int]:
        """Numbers of versions written, begun or claimed."""
        root = self._path(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return [int(n.split("=" if n.startswith("v=") else "-")[1]) for n in names if n.startswith(("v=", "claim-"))]


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions the new rows belong to."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def with_missing(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """``df`` with every column of ``columns`` (name -> type, default) it does not have yet."""
    from pyspark.sql import functions as F

    for name, (kind, default) in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default).cast(kind))
    return df
