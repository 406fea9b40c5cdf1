"""Files in the folder that driver and executors share (``spark.checkpoint.dir``): steps of loops, import and export files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Store:
    """One operation's tables and files; a written table cuts lineage, so a loop's plan doesn't grow and a lost executor costs a re-read."""

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="foliospark-")
        self.spark, self.root, self.n = spark, f"{root.rstrip('/')}/foliospark/{name}-{uuid.uuid4().hex}", 0

    def path(self) -> str:
        """A path that nothing has been written to."""
        self.n += 1
        return f"{self.root}/{self.n}"

    def table(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def text(self, df: DataFrame) -> str:
        """The path of text files with the lines of a one-column frame, in its order, in one file."""
        path = self.path()
        df.coalesce(1).write.text(path)
        return path
