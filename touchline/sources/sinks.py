"""Writers: frame records as JSON lines, state tables, session artifacts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

LOCAL = fs.LocalFileSystem()


def frame_records(tracking: DataFrame, ball: DataFrame) -> DataFrame:
    """One record per frame with its players as an array and its ball."""
    players = tracking.groupBy("sequence_id", "frame_index").agg(
        F.first("timestamp_s").alias("timestamp_s"), F.sort_array(F.collect_list(F.struct("track_id", "team_label", "role", "x_m", "y_m", "position_valid"))).alias("players"))
    one = ball.select("sequence_id", "frame_index", F.struct("ball_x", "ball_y", "ball_valid").alias("ball"))
    return players.join(one, ["sequence_id", "frame_index"], "left")


def write_frames_jsonl(records: DataFrame, path: str) -> None:
    """JSON lines in frame order inside every file; a file holds one range of frames."""
    (records.repartitionByRange("sequence_id", "frame_index").sortWithinPartitions("sequence_id", "frame_index").write.mode("overwrite").json(path))


def write_states(states: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Frame states by sequence, sorted so that min-max statistics skip row groups."""
    (states.repartitionByRange("sequence_id", "frame_index").sortWithinPartitions("sequence_id", "frame_index")
     .write.mode(mode).partitionBy("sequence_id").parquet(path))


def write_session(events: DataFrame, edges: DataFrame, aggregates: DataFrame, root: str) -> None:
    """The tables of analysed sessions; writing a session again replaces only its own partitions."""
    for name, table in (("events", events), ("edges", edges), ("team_summary", aggregates)):
        (table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sequence_id").parquet(f"{root}/{name}"))


def write_stats(stats: DataFrame, path: str) -> None:
    """Player statistics by match id; only the match ids in ``stats`` are replaced."""
    stats.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("match_id").parquet(path)


def file_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; one without a scheme is local."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LOCAL, path)


def write_texts(texts: DataFrame, folder: str) -> int:
    """One file per row of ``name, text`` under ``folder`` (names may hold subfolders); returns how many.

    Each file is written under a name of its own and then renamed, so a task that runs twice leaves whole files only.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_store(folder)
        store.create_dir(base, recursive=True)
        made = {base}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{base}/{name}"
                parent = path.rsplit("/", 1)[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                draft = f"{parent}/.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as f:
                    f.write((text or "").encode())
                store.move(draft, path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return texts.select("name", "text").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_lines(lines: DataFrame, folder: str) -> int:
    """Text files of ``name, value`` rows, the rows of one name in the order of ``line_no``; a file is one group."""
    files = lines.groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "value"))), lambda r: r["value"]), "\n").alias("text"))
    return write_texts(files, folder)
