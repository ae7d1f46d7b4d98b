"""Shared plumbing: storage that every executor sees, and Arrow batches of bounded size."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import is_remote

#: Documents are handed to Python in slices of at most so many characters (a longer one goes alone).
SLICE_CHARS = 4_000_000
#: Unicode white space; Python's own notion also takes four control characters.
UNICODE_SPACE = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Rows of one Arrow batch; long texts make batches of many MB otherwise.
ARROW_ROWS = 512
ARROW_BYTES = 16_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session of one machine (``local[...]``) gets a temporary one if it is unset; a cluster's is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="sievework-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def store(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*partitions) if partitions else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are stored and whose plans are gone.

    Only that frees the executors' disks before Spark's own cleaner runs; a session without a JVM of its own skips it.
    """
    if is_remote():
        return
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or with underscores so that it differs from the taken names in any case of letters."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


#: Ids that a join may broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def sized(ids: DataFrame) -> DataFrame:
    """A stored frame of ids, marked for broadcast if it has at most BROADCAST_IDS rows of one number."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch for this session; never raises a smaller setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key) or 0)
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


#: What workers forget at the end of a task, so that a long session's operators don't add up in their memory.
AT_TASK_END: list[Callable[[], None]] = []


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]) -> DataFrame:
    """``mapInArrow`` with one worker function per task; ``make()`` runs on the executor."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        try:
            for batch in batches:
                out = work(batch)
                if out is not None and out.num_rows:
                    yield out
        finally:
            for forget in AT_TASK_END:
                forget()

    return df.mapInArrow(run, schema)


def slices(lengths: list[int], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows whose lengths add up to ``most`` at most, or of one row."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start = i
            total = 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def held_out(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0. A null id counts as not held out."""
    return F.coalesce(F.expr(f"crc32(encode(cast(`{column}` as string), 'UTF-8')) % 5 = 0"), F.lit(False))
