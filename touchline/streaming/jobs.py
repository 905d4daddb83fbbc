"""Structured Streaming forms of the operators, on the same step functions as the batch forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from touchline.session import cut_lineage, new_path

DELAY = "2 seconds"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds of the end mark's time, the year 2200.
END_OF_TIME = 7258118400


def watermarked(stream: DataFrame, ts: str = "ts", delay: str = DELAY) -> DataFrame:
    """Declare how late a frame may be; the delay must exceed the one-second confirmation window."""
    return stream.withWatermark(ts, delay)


def per_second_teams(stream: DataFrame) -> DataFrame:
    """Tumbling one-second means of every team."""
    return (watermarked(stream).groupBy(F.window("ts", "1 second"), "sequence_id", "team_label")
            .agg(F.count(F.lit(1)).alias("players"), F.avg("x_m").alias("mean_x"), F.avg("y_m").alias("mean_y"))
            .select("sequence_id", "team_label", F.col("window.start").alias("start"), "players", "mean_x", "mean_y"))


def sliding_votes(stream: DataFrame, label: str) -> DataFrame:
    """Votes per label over two seconds, every 200 ms: the streaming form of the formation vote."""
    return (watermarked(stream).groupBy(F.window("ts", "2 seconds", "200 milliseconds"), "sequence_id", label)
            .agg(F.count(F.lit(1)).alias("votes")).select("sequence_id", F.col("window.end").alias("until"), label, "votes"))


def gap_sessions(stream: DataFrame, gap: str, keys: list[str]) -> DataFrame:
    """Episodes that end when nothing came for ``gap``."""
    return (watermarked(stream).groupBy(F.session_window("ts", gap), *keys).agg(F.count(F.lit(1)).alias("frames"))
            .select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "frames"))


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Drop events repeated within the watermark."""
    return watermarked(stream).dropDuplicatesWithinWatermark(keys)


def around_events(events: DataFrame, frames: DataFrame, before: str = "1 second", after: str = "1 second") -> DataFrame:
    """Stream-stream join of events with the frames from ``before`` to ``after`` them; state ends with the bounds."""
    a = watermarked(events, "event_ts")
    b = watermarked(frames, "ts").withColumnRenamed("sequence_id", "_seq")
    near = F.expr(f"sequence_id = _seq AND ts >= event_ts - INTERVAL {before} AND ts <= event_ts + INTERVAL {after}")
    return a.join(b, near, "inner").drop("_seq")


def run_available(stream: DataFrame, root: str | None = None) -> DataFrame:
    """Run a stream over what has arrived, into a file sink in the shared folder, and read the result.

    The file sink and its checkpoint give each row once, also after a restart. State is kept in RocksDB, in one part for each core.
    """
    spark = stream.sparkSession
    root = root or new_path(spark, "stream")
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        job = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out")
               .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def run_to_the_end(rows: DataFrame, build: Callable[[DataFrame], DataFrame], event_time: str = "ts") -> DataFrame:
    """Run ``build`` over the stream ``rows`` and close it, so that nothing stays open.

    A second source holds the end mark: one row of nulls with a time beyond all others. It is written when the data have
    been read; the run that finds it moves the watermark past every window, session and timer. Its own window never closes.
    """
    spark = rows.sparkSession
    root = new_path(spark, "stream")
    marks = f"{root}/end"
    spark.createDataFrame([], rows.schema).write.parquet(marks)
    both = rows.unionByName(spark.readStream.schema(rows.schema).parquet(marks))
    stream = build(both)
    run_available(stream, root)
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != event_time else F.timestamp_seconds(F.lit(END_OF_TIME)).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    spark.range(1).select(*nothing).write.mode("append").parquet(marks)
    return run_available(stream, root)


def in_pieces(table: DataFrame, frame: str, frames_each: int, disorder: int = 0) -> str:
    """Write a table as files that arrive one after the other, for a stream to read; gives the folder.

    Rows go by spans of ``frames_each`` frames, and half of them ``disorder`` frames later than they should; inside a file they are shuffled.
    """
    folder = new_path(table.sparkSession, "pieces")
    mixed = cut_lineage(table.withColumn("_mix", F.xxhash64(*table.columns)).withColumn("_piece", F.floor((F.col(frame) + F.when(F.col("_mix") % 2 == 0, disorder).otherwise(0)) / frames_each)))
    low, high = mixed.agg(F.min("_piece"), F.max("_piece")).first()
    for piece in range(low or 0, (high or 0) + 1):
        mixed.filter(F.col("_piece") == piece).orderBy("_mix").drop("_mix", "_piece").coalesce(1).write.mode("append").parquet(folder)
    return folder


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.parquet(path)


def frame_time(frame: Column) -> Column:
    """Event time of a frame number: 40 ms each, from a fixed start."""
    return F.timestamp_millis(F.lit(1704067200000) + frame * 40)
