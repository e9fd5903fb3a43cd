"""Structured Streaming forms of the windowed and incremental operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..checkpoints import shared_folder


def source(spark: SparkSession, path: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """A Parquet table as a stream, with a watermark on its time column."""
    schema = spark.read.parquet(path).schema
    head, _, name = path.rstrip("/").rpartition("/")
    # a table that is one file is read by its name within its folder
    read = spark.readStream.schema(schema)
    stream = read.parquet(path) if _is_folder(spark, path) else read.option("pathGlobFilter", name).parquet(head)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def windowed_counts(stream: DataFrame, ts: str, width: str, by: str, slide: str | None = None) -> DataFrame:
    """(start, by, n) of tumbling or sliding windows."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def drained(stream: DataFrame, mode: str = "complete", key: str | None = None) -> DataFrame:
    """Everything that is there now, run through the stream once, as a table that its batches write to the shared folder.

    complete: the last batch's table; append and update: the rows of all batches, with updates by ``key`` the latest of each.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/drained-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/rows/batch=-1")

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that runs again writes over itself
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={0 if mode == 'complete' else number}")

    run = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/rows")
    if key is None:
        return rows.drop("batch")
    rest = [c for c in stream.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, "r.*")


def failure_streaks(stream: DataFrame, key: str, ts: str, failed: str) -> DataFrame:
    """(key, streak) after each batch: failures since the last success, kept as state per key."""

    def update(k, batches, state: GroupState):
        import pandas as pd

        rows = pd.concat(list(batches)).sort_values(ts)
        good = (~rows[failed].to_numpy(dtype=bool)).nonzero()[0]
        # failures after the last success; without any they add to what was there
        streak = len(rows) - 1 - int(good[-1]) if len(good) else len(rows) + (state.get[0] if state.exists else 0)
        state.update((streak,))
        yield pd.DataFrame({key: [k[0]], "streak": [streak]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, streak long", "streak long", "update", GroupStateTimeout.NoTimeout)


def since_mark(df: DataFrame, key: str, mark: int, unexamined: str | None = None) -> DataFrame:
    """Rows after the mark, and before the first one that a flag says is not yet examined."""
    after = df.where(F.col(key) > mark)
    if unexamined is None:
        return after
    first = after.where(F.col(unexamined)).agg(F.min(key).alias("_stop"))
    return after.join(F.broadcast(first)).where(F.col("_stop").isNull() | (F.col(key) < F.col("_stop"))).drop("_stop")
