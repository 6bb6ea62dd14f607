"""The ledger and the drain as Structured Streaming jobs; on the same input they give what the batch
operators give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import drain as D
from ..operators import ledger as L


def first_seen(stream: DataFrame, watermark: str | None = None) -> DataFrame:
    """A stream of (id, at) with each id only when it first comes. With a watermark (on arrival, never
    on publication) state is dropped behind it; without one, every id is remembered."""
    if watermark is None:
        return stream.dropDuplicates(["id"])
    return stream.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["id"])


def counts_by_window(stream: DataFrame, width: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """start, type, n, ids (approximate count) of events (at, type, id) in windows of arrival."""
    w = F.window("at", width)
    return stream.withWatermark("at", watermark).groupBy(w, "type").agg(F.count("*").alias("n"), F.approx_count_distinct("id").alias("ids")).select(F.col("window.start").alias("start"), "type", "n", "ids")


def _version(spark: SparkSession, folder: str, number: int, schema: str) -> DataFrame:
    """A version of a table kept as numbered folders; an error if it is not there as a whole, for an
    empty table in its place would lose all that the versions before had gathered."""
    path = f"{folder}/v{number}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        raise RuntimeError(f"{path} is missing or incomplete; the ledger can't be continued without it")
    return spark.read.schema(schema).parquet(path)


def _current(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, int]:
    """The newest complete version of a table kept as numbered folders."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = -1
    if fs.exists(root):
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                done = max(done, int(name[1:]))
    return (_version(spark, folder, done, schema) if done >= 0 else spark.createDataFrame([], schema)), done


def current_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return _current(spark, folder, "id string, first_seen string")[0]


def keep_ledger(stream: DataFrame, folder: str, checkpoint: str, stamp: Callable[[int], str], capacity: int = L.CAPACITY) -> StreamingQuery:
    """Merge a stream of (id) into the ledger in ``folder``, bounded to its newest entries.

    Each micro-batch writes the next version of the ledger as a whole, named after the batch: a batch
    that is run again after a crash overwrites its own version only, and merging is idempotent. A
    batch whose predecessor's version is lost fails instead of starting afresh.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        base = _version(spark, folder, number - 1, "id string, first_seen string") if number else spark.createDataFrame([], "id string, first_seen string")
        L.cap_ledger(L.merge_seen(base, batch.select("id"), stamp(number)), capacity).write.mode("overwrite").parquet(f"{folder}/v{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain_stream(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand every record of a stream that needs writing to ``write``, batch by batch. Results are written
    before the checkpoint moves on, so after a crash a batch comes again, never too few."""

    def run(batch: DataFrame, number: int) -> None:
        todo = batch.where(D.needs_write())
        if not todo.isEmpty():
            write(todo, number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
