"""Reading the input tables, and tables written between the steps of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch. Texts may be long, so batches are far smaller than Spark's default.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table with long texts, for operators that hand Arrow batches to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return table(spark, sf_dir, name)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset a temporary one, on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Stages:
    """Tables written in the shared folder to cut lineage; a lost executor loses none of them.

    ``keep`` writes a frame and reads it back. With ``replaces`` the table of an earlier
    step is deleted once the new one is complete, so that a loop holds two at most.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path  # type: ignore[attr-defined]
        if replaces is not None:
            self.drop(replaces)
        return out

    def grow(self, name: str, df: DataFrame) -> DataFrame:
        """Adds rows to a table of that name and gives all of it, so that a loop's result needs no growing union."""
        path = f"{self.root}/{name}"
        df.write.mode("append").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_stage_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
