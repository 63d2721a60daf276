"""Scratch tables in the cluster's shared folder, and small helpers of the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import shared_folder, ship_package

#: Rows of an Arrow batch. Texts can be long, so batches are short.
BATCH_ROWS = 256


def ready_python(spark: SparkSession) -> None:
    """Settle how Python jobs run: the package on every executor, few rows to a batch."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


class Scratch:
    """Tables written below ``spark.checkpoint.dir``: they cut lineage and outlive lost executors.

    ``keep`` writes a table and returns it read back; ``drop`` removes one that no later step reads.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"

    def keep(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self._read(df, path)

    def numbered(self, df: DataFrame, number: str) -> DataFrame:
        """``df`` written with a column that numbers its rows.

        Numbers of ``monotonically_increasing_id`` follow the file splits, which Spark may cut otherwise in the
        next job; so whatever is joined back by number must come from one written table.
        """
        return self.keep(df.withColumn(number, F.monotonically_increasing_id()), "numbered")

    def _read(self, df: DataFrame, path: str) -> DataFrame:
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def again(self, kept: DataFrame) -> DataFrame:
        """The same table with columns of its own, to join it with itself."""
        return self._read(kept, kept._scratch_path)

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self.remove(table._scratch_path)

    def remove(self, path: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)
