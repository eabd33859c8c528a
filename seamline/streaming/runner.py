"""Running incremental jobs to their current end, and reading what they left.

A job's output folder holds one sub-folder per micro-batch. A batch that is
replayed after a failure overwrites its own folder, so the result stays
exactly-once without a transactional sink.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.operators.relational import first_per_key


STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def stream_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def batch_writer(out: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return write


@contextmanager
def options(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session options for the time of a block; a query keeps those it was started with."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def run_available(
    stream: DataFrame, checkpoint: str, each_batch: Callable[[DataFrame, int], None], mode: str = "append", with_options: dict[str, str] | None = None
):
    """Process everything that has landed, then stop; returns the finished query.

    State lies in RocksDB, outside the heap, which the state API asks for and large state is
    better off in. A query that goes on from a checkpoint keeps the store it began with.
    """
    writer = stream.writeStream.foreachBatch(each_batch).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with options(stream.sparkSession, STATE_STORE | (with_options or {})):
        query = writer.start()
    query.awaitTermination()
    return query


def append_all(stream: DataFrame, out: str, checkpoint: str):
    return run_available(stream, checkpoint, batch_writer(out))


def update_all(stream: DataFrame, out: str, checkpoint: str, with_options: dict[str, str] | None = None):
    return run_available(stream, checkpoint, batch_writer(out), "update", with_options)


PROGRESS = "batch_id long, started string, read_rows long, late_rows long, state_rows long"


def progress_of(query) -> list[tuple]:
    """One row per micro-batch of a finished query, from what it reported."""
    rows = []
    for p in query.recentProgress:
        operators = p["stateOperators"]
        late = sum(o["numRowsDroppedByWatermark"] for o in operators)
        rows.append((p["batchId"], p["timestamp"], p["numInputRows"], late, sum(o["numRowsTotal"] for o in operators)))
    return rows


def keep_progress(spark: SparkSession, query, out: str) -> None:
    """Append a query's progress to a table; a batch that ran again is counted by its last report."""
    rows = progress_of(query)
    if rows:
        spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(out)


def progress(spark: SparkSession, out: str, keys: list[str] | None = None) -> DataFrame:
    """Progress by batch (and folder keys); a batch that was reported again counts once."""
    rows = spark.read.option("basePath", out).parquet(out)
    most = [F.max(c).alias(c) for c in ("read_rows", "late_rows")]
    return rows.groupBy(*(keys or []), "batch_id").agg(*most, F.max_by("state_rows", "started").alias("state_rows"))


def read_appended(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).drop("batch_id")


def read_latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Current value per key: the row of the newest batch that touched it."""
    return first_per_key(spark.read.parquet(out), keys, [F.col("batch_id")]).drop("batch_id")


def forget(spark: SparkSession, path: str) -> None:
    """Delete a generation that no replay can need; a missing one is fine."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    """Watermarked stream; watermarks need an instant, files hold zone-less times."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def window_start() -> Column:
    return F.col("window.start").cast("timestamp_ntz")


def event_window(ts: str, length: str, slide: str | None = None) -> Column:
    return F.window(ts, length, slide) if slide else F.window(ts, length)
