"""Intermediate tables that several branches of a plan read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Files to read, per file of the table that lists them.
FILE_ROWS = 10_000
#: Rows per file of tables of nodes and lines. Spark packs 32 files into a task at most (4 MB for opening each, 128 MB a task), so
#: a task that sorts or groups them has a bounded number, however well they compress and however few tasks wrote them.
PART_ROWS = 50_000


def shared_folder(spark: SparkSession) -> str:
    """The application's folder in spark.checkpoint.dir, which may be removed as a whole once the application has ended. Only a local
    session without that setting (as in tests) gets a temporary folder: on a cluster, executors would write to their own disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-kept-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def kept(df: DataFrame, file_rows: int = 0) -> DataFrame:
    """df written once as Parquet to the shared folder and reread, so that it is parsed once and outlives lost executors. file_rows: rows of a
    file at most, for tables whose rows are work rather than bytes (0: no limit), so that more tasks read them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
