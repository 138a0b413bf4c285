"""Tables between the steps of an operator, in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.workspace import new_run_dir


class Scratch:
    """A folder of one run. Written tables cut the lineage and survive lost executors.

    Tables that a result still reads stay; the others are removed with ``drop``.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, new_run_dir(spark, label)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, to choose numbers of partitions by."""
    from pyspark.sql import functions as F

    return int(docs.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0)
