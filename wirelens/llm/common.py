"""What the training-data operators share: the work area on shared storage, table reading, word rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space that separates words, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACE}]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in spark.checkpoint.dir. Only where nothing is named (a local test
    session) a temporary folder is set as the checkpoint folder.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wirelens-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


class Work:
    """Intermediate tables of one operator run, written once to shared storage and read back.

    A written table cuts lineage: a lost executor costs the tasks in flight, not the stages before.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_root(spark)}/wirelens-{uuid.uuid4().hex}"
        self.written = 0
        self.live: list[str] = []

    def save(self, df: DataFrame, label: str, compression: str = "snappy", options: dict | None = None) -> DataFrame:
        self.written += 1
        path = f"{self.root}/{self.written:03d}-{label}"
        df.write.options(compression=compression, **(options or {})).parquet(path)
        if not self.live:
            where, store = self._store(self.root)
            store.deleteOnExit(where)
        self.live.append(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._work_path = path
        return back

    def _store(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no pending result reads any more."""
        for table in tables:
            self.live.remove(table._work_path)
            where, store = self._store(table._work_path)
            store.delete(where, True)

    def keep_only(self, *tables: DataFrame) -> None:
        """Deletes all tables but those that the result reads; these go when the application ends."""
        kept = {t._work_path for t in tables}
        for path in [p for p in self.live if p not in kept]:
            self.live.remove(path)
            where, store = self._store(path)
            store.delete(where, True)


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text):
    """Number of words of a text column; null counts as no word. JVM-side, no array is built."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
