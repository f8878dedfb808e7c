"""Tables written between the steps of an iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path of its own in ``spark.checkpoint.dir``, which all executors share; where that is unset, as in local tests, a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in a new folder, read again: its lineage ends there."""
    spark, path, schema = df.sparkSession, new_folder(df.sparkSession, "tables"), df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables that ``written`` wrote and that nothing reads any more."""
    for table in tables:
        for path in {f.rpartition("/")[0] for f in table.inputFiles()} if table is not None else ():
            folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def in_order(df: DataFrame, name: str, *by: Column | str) -> DataFrame:
    """``df`` written with a number for each row that rises in the order ``by``; numbers have gaps.  No task sorts all rows."""
    return written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id()))
