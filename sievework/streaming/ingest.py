"""Incremental ingestion: new files become cleaned texts once, a failed one stops nothing, a task can be stopped and goes on later."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sievework.functions import text as tx

# fixed values: observations of the first batch and of later ones; states of a task, the last four are final
FIRST_BATCH, LATER_BATCH = 16, 32
STATES = ("queued", "running", "cancelling", "succeeded", "failed", "cancelled", "interrupted")
FINAL = STATES[3:]


class Cancelled(Exception):
    """A task was stopped between two steps."""


class Cancellation:
    """Asked at the points between steps; Spark jobs that run under its tag are stopped as well."""

    def __init__(self, spark: SparkSession | None = None, tag: str = ""):
        self._event, self._spark, self._tag = threading.Event(), spark, tag

    def request(self) -> None:
        self._event.set()
        if self._spark is not None and self._tag:
            self._spark.sparkContext.cancelJobsWithTag(self._tag)

    def check(self) -> None:
        if self._event.is_set():
            raise Cancelled


class Task:
    """A task's state and progress; a final state stays, whatever comes late."""

    def __init__(self, total: int = 0):
        self.state, self.done, self.total, self.error = "queued", 0, total, None
        self._lock = threading.Lock()

    def move(self, state: str, error: str | None = None) -> bool:
        if state not in STATES:
            raise ValueError(state)
        with self._lock:
            if self.state in FINAL or (self.state == "cancelling" and state == "running"):
                return False
            self.state, self.error = state, error
            return True

    def advance(self, n: int = 1) -> None:
        with self._lock:
            if self.state not in FINAL:
                self.done += n

    def run(self, steps: list[Callable[[], None]], cancellation: Cancellation) -> str:
        """The steps one by one, with a point to stop before each."""
        self.total = self.total or len(steps)
        self.move("running")
        try:
            for step in steps:
                cancellation.check()
                step()
                self.advance()
            self.move("succeeded")
        except Cancelled:
            self.move("cancelled")
        except Exception as e:  # a task's failure is its state
            self.move("failed", f"{e.__class__.__name__}: {e}"[:500])
        return self.state


def first_then(files: int, first: int = FIRST_BATCH, later: int = LATER_BATCH) -> list[int]:
    """Sizes of the batches of a number of files: a small one first, so that the first results come early."""
    out = [min(first, files)] if files else []
    while sum(out) < files:
        out.append(min(later, files - sum(out)))
    return out


def cleaned_documents(docs: DataFrame) -> DataFrame:
    """Texts with their clean form and status."""
    clean = tx.cleaned(F.col("text"))
    return docs.withColumn("clean", clean).withColumn("status", tx.text_status(F.coalesce(F.col("clean"), F.lit(""))))


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, files_per_trigger: int = FIRST_BATCH, corrupt: bool = False) -> StreamingQuery:
    """Append cleaned documents of new Parquet files below ``source`` to ``target``.

    The batch number is part of the path, so a batch that is run again after a failure replaces itself. With
    ``corrupt`` broken files are passed over and the others go on.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("ignoreCorruptFiles", str(corrupt).lower()).parquet(source)

    def put(batch: DataFrame, number: int) -> None:
        cleaned_documents(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_files(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_trigger: int = FIRST_BATCH) -> StreamingQuery:
    """Text files of any bytes, one row each: (path, sha256, text, clean, status, error); what can't be read is a row with its error."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").load(source)

    def put(batch: DataFrame, number: int) -> None:
        text = F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "^\ufeff", "")
        rows = batch.select("path", F.sha2("content", 256).alias("sha256"), text.alias("text"))
        rows = rows.withColumn("clean", tx.cleaned(F.col("text"))).withColumn("status", F.when(F.col("text").isNull(), "failed").otherwise(tx.text_status(F.col("clean"))))
        rows.withColumn("error", F.when(F.col("text").isNull(), "undecodable")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The newest row of each key over all batches."""
    from sievework.operators.history import latest_by

    return latest_by(spark.read.parquet(target), [key], [F.desc("batch")])


def progress(done: Column, total: Column) -> Column:
    """A share from 0 to 1; a task without anything to do is done."""
    return F.when(total > 0, F.least(F.lit(1.0), done / total)).otherwise(F.lit(1.0))
