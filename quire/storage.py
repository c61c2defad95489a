"""Tables on shared storage: lineage is cut by writing Parquet to the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is set, a local session (tests) has a temporary one, and
    a cluster is an error, as its executors would write to their own disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="quire-")
    spark.sparkContext.setCheckpointDir(own)
    return "file://" + own


class Scratch:
    """Tables of one call.

    ``keep`` writes a frame and reads it back, so that a lost executor costs a re-read and not a
    recomputation; ``drop`` removes a table that nothing reads any more. What a returned frame
    still reads is removed when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[int, str] = {}
        self.tables: list[str] = []
        self.n = 0
        atexit.register(self.clear)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._quire_path = path  # keeps the id in use as long as the path may be dropped
        return out

    def keep_bucketed(self, df: DataFrame, by: list[str], name: str = "t", buckets: int | None = None) -> DataFrame:
        """``keep``, in buckets of the columns ``by`` and sorted by them, so that equi-joins on these don't shuffle it.

        The table is registered in the session's catalog under a name of its own, and removed with the others.
        """
        self.n += 1
        n = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        path, table = f"{self.root}/{self.n:03d}-{name}", f"quire_{name}_{uuid.uuid4().hex[:12]}"
        dealt = df.repartition(n, *by).sortWithinPartitions(*by)
        dealt.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, *by).sortBy(*by).saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            path = self.paths.pop(id(frame), None)
            if path:
                self._delete(path)

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

    def clear(self) -> None:
        try:
            while self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop()}")
            self._delete(self.root)
        except Exception:  # the driver ends and its JVM may be gone; nothing else can be done then
            pass
