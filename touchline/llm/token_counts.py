"""Documents and their token counts from flat token files without an index.

A flat file holds nothing but token identifiers, one after the other, an end-of-document identifier after each document.
Files are cut into blocks; each task looks for the identifier in its blocks with vectorised comparisons. What a block cannot
know (how many documents came before, where the last one ended) follows from one row per block by prefix scans in two
levels, so that no task sees a whole long file.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from touchline.llm.rows import pick, qualified, slices
from touchline.session import cut_lineage, new_path

BLOCK_BYTES = 8 << 20
FILE_BYTES = 256 << 20
#: Scan positions held at once inside a block.
STRIDE = 1 << 20

# Fixed value: how the byte-level vocabularies split a text before they merge bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(ranks_file: str):
    """The tokenizer of a file of ranks (base64 bytes and number on each line)."""
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _open(path: str):
    """File system and plain path of a file in shared storage."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _width(kind: str) -> int:
    return np.dtype(kind).itemsize


def write_flat(docs: DataFrame, folder: str, ranks_file: str, end: int, kind: str = "<u2", id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Tokenise ``docs`` into flat files under ``folder`` and return the written order: ``file, ordinal, doc_id``.

    Each task writes its rows in order, into new files of about ``file_bytes``. A task that is run again writes new files;
    only those named in the returned table count. Null texts are documents without tokens.
    """
    source = pick(docs, doc_id=id_col, text=text_col)
    folder = qualified(docs.sparkSession, folder).rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_file).encode_ordinary
        out, name, ordinal = None, "", 0
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        for part in slices(batches, "text"):
            ids, names, ordinals = part.column(0), [], []
            for text in part.column(1).to_pylist():
                if out is None:
                    name, ordinal = f"{folder}/tokens-{uuid.uuid4().hex}.bin", 0
                    out = store.open_output_stream(f"{base}/{name.rsplit('/', 1)[1]}")
                out.write(np.array([*encode(text or ""), end], dtype=kind).tobytes())
                names.append(name)
                ordinals.append(ordinal)
                ordinal += 1
                if out.tell() >= file_bytes:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(ordinals, pa.int64()), ids], ["file", "ordinal", "doc_id"])
        if out is not None:
            out.close()

    written = source.mapInArrow(write, f"file string, ordinal long, doc_id {source.schema['doc_id'].dataType.simpleString()}")
    return cut_lineage(written, "order")  # the rows are those of the tasks that counted


def scan_block(data: np.ndarray, end: int) -> np.ndarray:
    """Positions of the identifier in one block, searched for in strides."""
    found = [np.flatnonzero(data[i:i + STRIDE] == end) + i for i in range(0, len(data), STRIDE)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _scan(kind: str, end: int):
    width = _width(kind)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, path = _open(file)
                with store.open_input_file(path) as f:
                    data = np.frombuffer(f.read_at(size, start), dtype=kind)
                at = scan_block(data, end) + start // width
                stop = start // width + len(data)
                # the first document may have begun in an earlier block: its start is left open
                begun = pa.array(np.concatenate([[0], at[:-1] + 1])[:len(at)], pa.int64(), mask=np.arange(len(at)) == 0)
                spans = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.StructArray.from_arrays([begun, pa.array(at, pa.int64())], ["start", "stop"]))
                yield pa.RecordBatch.from_arrays([pa.array([file]), *(pa.array([x], pa.int64()) for x in (block, stop, len(at), at[-1] if len(at) else None)), spans],
                                                 ["file", "block", "stop", "n", "last", "spans"])

    return walk


def count_tokens(spark: SparkSession, files: DataFrame, end: int, kind: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents of flat files: ``file, ordinal, start, n_tokens`` (places and counts in tokens, without the end mark).

    ``files`` holds ``file`` and ``bytes``. Tokens after the last end mark are a last document; an empty file has none.
    Repeated rows of a file count once; null names or sizes are left out.
    """
    width = _width(kind)
    block_bytes -= block_bytes % width
    known = pick(files, file="file", bytes="bytes").filter("file is not null and bytes > 0").distinct()
    whole = F.floor(F.col("bytes") / width).cast("long") * width
    blocks = known.select("file", whole.alias("bytes")).filter("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / block_bytes).cast("long"))).alias("block"))
    blocks = blocks.select("file", "block", (F.col("block") * block_bytes).alias("start"), F.least(F.lit(block_bytes).cast("long"), F.col("bytes") - F.col("block") * block_bytes).alias("size"))
    found = cut_lineage(blocks.repartition("file", "block").mapInArrow(_scan(kind, end), "file string, block long, stop long, n long, last long, spans array<struct<start:long,stop:long>>"), "blocks")
    summary = found.select("file", "block", "stop", "n", "last")
    # the scan over blocks: a row of a few numbers for each 8 MB of a file
    so_far = Window.partitionBy("file").orderBy("block")
    scanned = summary.select("*", F.sum("n").over(so_far.rowsBetween(Window.unboundedPreceding, 0)).alias("through"),
                             F.last("last", ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    carried = scanned.select("file", "block", (F.col("through") - F.col("n")).alias("done"), F.coalesce(F.col("before") + 1, F.lit(0).cast("long")).alias("open"))
    inside = found.join(carried, ["file", "block"]).select("file", "done", "open", F.posexplode("spans").alias("i", "doc"))
    ended = inside.select("file", (F.col("done") + F.col("i")).alias("ordinal"), F.coalesce("doc.start", "open").alias("start"), "doc.stop")
    tail = scanned.groupBy("file").agg(F.max("through").alias("ordinal"), F.coalesce(F.max("last") + 1, F.lit(0).cast("long")).alias("start"), F.max("stop").alias("stop")).filter("stop > start")
    return ended.unionByName(tail).select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"))


def file_sizes(order: DataFrame) -> DataFrame:
    """``file, bytes`` of the files named in a written order, asked of the storage in tasks."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column(0).to_pylist()
            sizes = []
            for file in files:
                store, path = _open(file)
                sizes.append(store.get_file_info(path).size)
            yield pa.RecordBatch.from_arrays([pa.array(files), pa.array(sizes, pa.int64())], ["file", "bytes"])

    return order.select("file").distinct().mapInArrow(ask, "file string, bytes long")


def document_tokens(docs: DataFrame, ranks_file: str, end: int, kind: str = "<u2", id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, file, ordinal, start``, by way of flat files in the shared folder.

    Null and empty texts have no tokens. Null ids stay null, repeated rows are documents of their own, very long texts are
    encoded whole, an empty table gives an empty result.
    """
    spark = docs.sparkSession
    order = write_flat(docs, new_path(spark, "flat"), ranks_file, end, kind, id_col, text_col, file_bytes)
    counts = count_tokens(spark, file_sizes(order), end, kind, block_bytes)
    return order.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")
