"""Tables written to the folder that all executors share, which cut a lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: While a table is written: shuffle files that nothing needs any more go at once, and expressions that would fuse into methods too large
#: for the JVM to compile (8,000 bytes of code) are split instead.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.codegen.hugeMethodLimit": "8000"}

def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where a local session leaves it unset, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """What holds while a table is written."""
    before = {k: spark.conf.get(k) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, path: str) -> None:
    """Write a table as Parquet, compressed by zstd."""
    with writing(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back; it goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    written(df, path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
