"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most files of a table that `few` writes, or of a batch of updates, for each core of the cluster.
FILES_A_CORE = 4


def shared_root(spark: SparkSession) -> str:
    """The shared folder. Only a plain local session without the setting gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = "file://" + tempfile.mkdtemp(prefix="foliospark-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Writes tables that cut lineage; a lost executor costs a re-read, not a recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.names: list[str] = []
        self.root = f"{shared_root(spark)}/foliospark/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def few(self, df: DataFrame, name: str) -> DataFrame:
        """`table` in FILES_A_CORE files a core at most, however many shuffle partitions there are.

        A task of the last stage takes several of them, one after the other. That stage must not have a shuffled hash
        join, whose tables would stay until the task's end.
        """
        return self.table(df.coalesce(FILES_A_CORE * self.spark.sparkContext.defaultParallelism), name)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back. The shuffle files of the write go with its end."""
        path = self.path(name)
        self.names.append(name)
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(key) if before is None else self.spark.conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)

    def drop_all_but(self, *names: str) -> None:
        self.drop(*(n for n in self.names if n not in names))


def with_locator(docs: DataFrame, scratch: Scratch, columns: list[str]) -> DataFrame:
    """`columns` of `docs` with `__loc_file` and `__loc_row`, the place of the row in its stored file.

    A plain scan of Parquet files has them already; any other plan is written once to the shared folder.
    Two readings give the same places, whatever the splits.
    """
    try:
        place = [F.col("_metadata.file_path").alias("__loc_file"), F.col("_metadata.row_index").alias("__loc_row")]
        out = docs.select(*columns, *place)
        out.schema  # noqa: B018  analysis fails where the plan has no file source
        return out
    except Exception as e:  # AnalysisException: the plan isn't a file scan
        if "_metadata" not in str(e):
            raise
    stored = scratch.table(docs.select(*columns), "input")
    return stored.select(*columns, F.col("_metadata.file_path").alias("__loc_file"), F.col("_metadata.row_index").alias("__loc_row"))
