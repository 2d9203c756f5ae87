"""Tables of intermediate rows in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode a folder of our own where that is unset, on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.labels: list[str] = []

    def table(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.root}/{label}"
        df.write.mode("overwrite").parquet(path)
        self.labels.append(label)
        return self.spark.read.schema(df.schema).parquet(path)

    def only(self, df: DataFrame, label: str) -> DataFrame:
        """The result as a table; all others go."""
        gone = [x for x in self.labels if x != label]
        out = self.table(df, label)
        self.drop(*gone)
        return out

    def drop(self, *labels: str) -> None:
        """Some tables, or all of them."""
        labels = labels or tuple(self.labels)
        conf = self.spark._jsc.hadoopConfiguration()
        for label in labels:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{label}")
            path.getFileSystem(conf).delete(path, True)
        self.labels = [x for x in self.labels if x not in labels]
