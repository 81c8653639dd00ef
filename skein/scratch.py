"""Tables in the folder all executors share, to cut lineage and to keep what is read more than once."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, one of our own in local mode (tests);
    a cluster raises a ValueError, as its executors would not see each other's files."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="skein-checkpoint-")
        sc.setCheckpointDir(where)
    return where


class Scratch:
    """Parquet tables in the shared folder: they cut lineage, are compressed and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/skein-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, parts: int | None = None) -> DataFrame:
        """Write and read again; ``parts``: in at most so many files."""
        self.n += 1
        df = df if parts is None else df.coalesce(parts)
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._skein_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            self._delete(t._skein_path)

    def clear(self) -> None:
        """Delete all tables; what was made of them must have been written."""
        self._delete(self.root)

    def free(self) -> None:
        """Let Spark delete the shuffle files of jobs whose DataFrames are gone; else they stay until the driver happens
        to collect its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def _delete(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
