"""New files of a folder as a stream, detected batch by batch, with the files of earlier batches as state.

A batch that runs again replaces its own output and its own part of the state. A requirements file may include files of earlier batches; one whose include
was missing is read again when later batches come, until it is there. Spark's file stream passes over empty files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.detect import detect
from ..rules import Ruleset, builtin_rules
from ..schema import FILE, FILES, MANIFESTS

#: The beginning of the warning of a requirements file whose include is missing.
MISSING = "could not read included requirements file "


def latest(table: DataFrame) -> DataFrame:
    """Of rows with a batch, the last one of each file."""
    rest = [c for c in table.columns if c not in (*FILE, "batch")]
    return table.groupBy(*FILE).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*FILE, "x.*")


def latest_manifests(spark: SparkSession, out: str) -> DataFrame:
    """MANIFESTS of all batches below out, as they were read last."""
    return latest(spark.read.schema(f"{MANIFESTS}, batch long").parquet(out))


def watch_tables(stream: DataFrame, out: str, checkpoint: str, rules: Ruleset | None = None, available_now: bool = False, on_error: str = "warn") -> StreamingQuery:
    """MANIFESTS of a stream of FILES, in folders batch=<number> below out (latest_manifests has the last of each file). The files that came so far are kept
    below checkpoint where rules read requirements; a file that comes again replaces the one before. Of manifests of earlier batches, only those with a missing include are read again."""
    chosen = rules or builtin_rules()
    state = f"{checkpoint.rstrip('/')}/files"
    including = bool(chosen.using("py-requirements"))

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        files, contents = batch, None
        if including:
            batch.select("root", "path", "name", "content").write.mode("overwrite").parquet(f"{state}/batch={number}")
            seen = spark.read.schema(f"{FILES}, batch long").parquet(state).where(F.col("batch") <= number)
            contents = latest(seen)
            files = seen.where(F.col("batch") == number).drop("batch")
            if number:
                before = latest(spark.read.schema(f"{MANIFESTS}, batch long").parquet(out).where(F.col("batch") < number))
                waiting = before.where(F.exists("warnings", lambda w: F.startswith(w, F.lit(MISSING)))).select(*FILE)
                again = contents.join(waiting, FILE, "left_semi").join(files.select(*FILE), FILE, "left_anti")
                files = files.unionByName(again)
        detect(files, chosen, on_error=on_error, contents=contents).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, rules: Ruleset | None = None, available_now: bool = False, files_per_batch: int = 10_000) -> StreamingQuery:
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    path = F.regexp_replace("path", r"^[a-zA-Z0-9+.-]+:/*(?=/)", "")
    rows = raw.select(F.lit(folder).alias("root"), F.regexp_replace(path, f"^\\Q{folder.rstrip('/')}\\E/", "").alias("path"), F.substring_index("path", "/", -1).alias("name"), "content")
    return watch_tables(rows, out, checkpoint, rules, available_now)
