"""Event-time jobs on captures: tumbling counts, sessions, deduplication, running motion.

Each takes a streaming or a batch DataFrame with a timestamp column; on a stream the watermark
says how late a row may come, on a batch it has no effect.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", ts: str = "ts", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """(window start, keys, n, total): interval sampling as a tumbling window."""
    grouped = events.withWatermark(ts, late).groupBy(F.window(ts, width), *by)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, width: str = "6 hours", step: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    grouped = events.withWatermark(ts, late).groupBy(F.window(ts, width, step))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "n", "mean")


def sessions(events: DataFrame, gap: str = "8 seconds", late: str = "10 minutes", ts: str = "ts", by: str = "user_id") -> DataFrame:
    """(key, start, end, n): runs that a pause longer than the gap parts."""
    grouped = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), F.col(by))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last")).select(by, F.col("w.start").alias("start"), "last", "n")


def once(events: DataFrame, keys: list[str], late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def motion(events: DataFrame, by: str = "user_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """(key, n, travel, last): a push-style accumulator kept as state, a row for each update."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, travel, last = state.get if state.exists else (0, 0.0, None)
        rows = pd.concat(list(frames)).sort_values(ts, kind="stable")
        for v in rows[value]:
            travel += abs(v - last) if last is not None else 0.0
            n, last = n + 1, float(v)
        state.update((n, travel, last))
        yield pd.DataFrame({by: [key[0]], "n": [n], "travel": [travel], "last": [last]})

    kind = dict(events.dtypes)[by]
    return events.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, n long, travel double, last double", "n long, travel double, last double", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything a stream gives until its source is empty, as a Parquet table in the shared folder."""
    from terrafold.operators.graph import shared_folder

    spark, schema = stream.sparkSession, stream.schema
    where = f"{shared_folder(spark)}/terrafold-streams/{name}-{uuid.uuid4().hex}"

    def put(rows: DataFrame, batch: int) -> None:
        # A batch that is run again writes the same folder again.
        rows.write.mode("overwrite").parquet(f"{where}/rows/batch={batch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/rows")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{where}/rows")


def replay(spark, path: str, files: int = 1) -> DataFrame:
    """A table's Parquet files as a stream, some files a batch."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
