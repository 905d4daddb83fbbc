"""WARC archives as a Spark data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading: files are planned into partitions on the driver. Conditions on record type and other headers are pushed down; the
headers of a record are parsed first, and the payload of an unwanted record is neither inflated (where its compressed length
is known) nor decoded. A schema without ``payload`` skips all payloads.

Writing: each task attempt makes files of its own; a commit lists those of the attempts that counted, and readers go by these
lists. So attempts that failed or ran twice leave nothing that is read. Records are gzip members with their compressed length
in an extra header field, so a reader can leap over them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from touchline.llm.rows import pick, qualified

SCHEMA = ("record_id string, record_type string, page_id long, target_uri string, warc_date string, content_type string, payload_digest string, payload_bytes long, "
          "refers_to long, refers_to_record string, payload binary")
WRITE_COLUMNS = ("page_id", "target_uri", "refers_to", "payload")
#: Bytes after which a writer begins a new file, and that a read partition is planned for.
FILE_BYTES = 64 << 20
PARTITION_BYTES = 128 << 20
CHUNK = 64 << 10
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("2f1c6d1e-6a53-5a0b-8f0e-6f8f3a1d9c11")
END = b"\r\n\r\n"
# Fixed value: the profile of a record that repeats an earlier payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{payload_digest}')}>"


def _safe(value: str) -> str:
    """A header value without line ends and other control characters (percent-encoded)."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One record: a response, or a revisit (without payload) of the page ``refers_to``."""
    own = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, own)}", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_safe(uri)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{own}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, own)}", f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member with its own length and that of its contents in the extra field ``sl``."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if whole >= 1 << 32 or len(data) >= 1 << 32:
        return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + tail
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<HccHII", 12, b"s", b"l", 8, whole, len(data)) + body + tail


def member_length(head: bytes) -> int | None:
    """The length of a gzip member from its extra field, if it has one."""
    if len(head) < 12 or head[:2] != b"\x1f\x8b" or not head[3] & 4:
        return None
    end = 12 + struct.unpack_from("<H", head, 10)[0]
    at = 12
    while at + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at:at + 2] == b"sl" and size >= 8 and at + 8 <= len(head):
            return struct.unpack_from("<I", head, at + 4)[0]
        at += 4 + size
    return None


class _Stream:
    """The contents of a file from ``pos`` on, inflated member by member or as they are; counts what it inflates."""

    def __init__(self, file, size: int, packed: bool):
        self.file, self.size, self.packed = file, size, packed
        self.inflated = 0

    def open(self, pos: int) -> int | None:
        """Begin a record at ``pos``; its packed length, if known."""
        self.pos, self.held, self.done = pos, b"", False
        if not self.packed:
            return None
        self.unpack = zlib.decompressobj(31)
        self.input = self._next()
        return member_length(self.input)

    def _next(self) -> bytes:
        data = self.file.read_at(min(CHUNK, self.size - self.pos), self.pos) if self.pos < self.size else b""
        self.pos += len(data)
        return data

    def _fill(self) -> bool:
        if self.done:
            return False
        if not self.packed:
            data = self._next()
            self.done = not data
        else:
            if not self.input:
                self.input = self._next()
            if not self.input:
                raise EOFError("a record ends too early")
            data = self.unpack.decompress(self.input, CHUNK)
            self.input = self.unpack.unconsumed_tail
            if self.unpack.eof:
                self.done = True
                self.pos -= len(self.unpack.unused_data)
        self.inflated += len(data)
        self.held += data
        return True

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        while (at := self.held.find(mark)) < 0:
            if len(self.held) > most or not self._fill():
                return b""
        out, self.held = self.held[:at], self.held[at + len(mark):]
        return out

    def read(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            self.held = b""
            if not self._fill():
                raise EOFError("a record ends too early")
            parts.append(self.held)
            have += len(self.held)
        data = b"".join(parts)
        self.held = data[n:]
        return data[:n]

    def skip(self) -> int:
        """The place after this member."""
        while not self.done:
            self._fill()
            self.held = b""
        return self.pos


def _headers(data: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines are joined."""
    out, last = {}, None
    for line in data.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def _number(value: str | None) -> int | None:
    """A signed 64-bit number, or none."""
    number = int(value) if value is not None and re.fullmatch(r"-?[0-9]{1,19}", value) else None
    return number if number is not None and -(1 << 63) <= number < 1 << 63 else None


def _fields(head: dict[str, str]) -> dict:
    """The columns that WARC headers alone give."""
    mark = head.get("warc-payload-digest")
    return {"record_id": head.get("warc-record-id"), "record_type": head.get("warc-type"), "page_id": _number(head.get("x-page-id")), "target_uri": head.get("warc-target-uri"), "warc_date": head.get("warc-date"),
            "content_type": head.get("content-type"), "payload_digest": mark.split(":", 1)[-1] if mark else None, "refers_to": _number(head.get("x-refers-to-page-id")), "refers_to_record": head.get("warc-refers-to")}


#: Columns on which conditions are decided from the headers.
HEADER_COLUMNS = frozenset(_fields({}))


@dataclass(frozen=True)
class Condition:
    """A comparison of a header column with a value (``in``: with several)."""

    column: str
    how: str
    value: object

    def holds(self, row: dict) -> bool:
        x, v = row[self.column], self.value
        if x is None:
            return False
        return {"=": lambda: x == v, "in": lambda: x in v, ">": lambda: x > v, ">=": lambda: x >= v, "<": lambda: x < v, "<=": lambda: x <= v, "known": lambda: True}[self.how]()


_HOW = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", IsNotNull: "known"}


def records(file, size: int, packed: bool, conditions: Sequence[Condition] = (), need_http: bool = True, need_payload: bool = True, verify: bool = True, seen: _Stream | None = None) -> Iterator[dict]:
    """Rows of one archive. Records without WARC headers at their start stop the read with an error."""
    stream = seen or _Stream(file, size, packed)
    pos = 0
    while pos < size:
        known = stream.open(pos)
        raw = stream.until(END)
        if not raw.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {pos}")
        head = _headers(raw)
        length = _number(head.get("content-length")) or 0
        row = _fields(head)
        after = None if packed else pos + len(raw) + len(END) + length + len(END)
        if all(c.holds(row) for c in conditions):
            row["payload_bytes"] = row["payload"] = None
            if need_http or need_payload:
                is_http = (row["content_type"] or "").startswith("application/http")
                rest = length
                if is_http:
                    http = stream.until(END)
                    rest = length - len(http) - len(END)
                    full = _number(_headers(http).get("content-length"))
                row["payload_bytes"] = rest if not (is_http and row["record_type"] == "revisit") else full
                if need_payload and row["record_type"] != "revisit":
                    row["payload"] = stream.read(rest)
                    if verify and head.get("warc-payload-digest", "").startswith("sha1:") and digest(row["payload"]) != row["payload_digest"]:
                        raise ValueError(f"the payload of {row['record_id']} does not have its digest")
            yield row
        pos = after if after is not None else pos + known if known else stream.skip()


@dataclass
class WarcPartition(InputPartition):
    files: tuple[tuple[str, int], ...]


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options, self.conditions = schema, options, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take conditions on header columns; the others go back to Spark."""
        for f in filters:
            how = _HOW.get(type(f))
            value = None if how == "known" else getattr(f, "value", None)
            if how and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS and (value is not None or how == "known"):
                self.conditions.append(Condition(f.attribute[0], how, tuple(value) if how == "in" else value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        """Files of the committed lists, or else all archives of a folder or one file; small files share a partition."""
        store, base = fs.FileSystem.from_uri(self.options["path"])
        info = store.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.options["path"])
        if info.type == fs.FileType.File:
            found = [(base, info.size)]
        else:
            inside = [f for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File]
            lists = [f.path for f in inside if f.base_name.startswith("_committed-")]
            if lists:
                named = set()
                for path in lists:
                    with store.open_input_stream(path) as f:
                        named |= set(f.read().decode().split())
                inside = [f for f in inside if f.base_name in named]
            found = [(f.path, f.size) for f in inside if re.search(r"\.warc(\.gz)?$", f.path)]
        most = int(self.options.get("partitionbytes", PARTITION_BYTES))
        out: list[WarcPartition] = []
        group, held = [], 0
        for path, size in sorted(found):
            if group and held + size > most:
                out.append(WarcPartition(tuple(group)))
                group, held = [], 0
            group.append((path, size))
            held += size
        if group:
            out.append(WarcPartition(tuple(group)))
        return out or [WarcPartition(())]

    def read(self, partition: WarcPartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        names = self.schema.names
        schema = to_arrow_schema(self.schema)
        store, _ = fs.FileSystem.from_uri(self.options["path"])
        verify = self.options.get("verify", "true") == "true"
        for path, size in partition.files:
            with store.open_input_file(path) as f:
                rows, held = [], 0
                for row in records(f, size, path.endswith(".gz"), self.conditions, "payload_bytes" in names or "payload" in names, "payload" in names, verify):
                    rows.append([row[n] for n in names])
                    held += 256 + len(row["payload"] or b"")
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class WarcMessage(WriterCommitMessage):
    files: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.most = int(options.get("filebytes", FILE_BYTES))
        self.packed = options.get("compression", "gzip") == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = fs.FileSystem.from_uri(self.path)
        store.create_dir(base, recursive=True)
        out, files = None, []
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in WRITE_COLUMNS]
            for i in range(batch.num_rows):
                if out is None:
                    files.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.packed)
                    out = store.open_output_stream(f"{base}/{files[-1]}", compression=None)
                page_id, uri, refers_to, payload = (c[i].as_py() for c in columns)
                data = record(page_id, uri, payload or b"", refers_to)
                out.write(member(data) if self.packed else data)
                if out.tell() >= self.most:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return WarcMessage(tuple(files))

    def commit(self, messages: list[WarcMessage | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.path)
        store.create_dir(base, recursive=True)
        old = [f.path for f in store.get_file_info(fs.FileSelector(base)) if f.base_name.startswith("_committed-")] if self.overwrite else []
        with store.open_output_stream(f"{base}/_committed-{uuid.uuid4().hex}") as f:
            f.write("\n".join(name for m in messages if m is not None for name in m.files).encode())
        for path in old:
            store.delete_file(path)

    def abort(self, messages: list[WarcMessage | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for name in m.files if m is not None else ():
                store.delete_file(f"{base}/{name}")


class WarcDataSource(DataSource):
    """Options: ``path`` (a folder or file that driver and executors share), ``verify``, ``partitionbytes``, ``filebytes``, ``compression``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        missing = set(WRITE_COLUMNS) - set(schema.names)
        if missing:
            raise ValueError(f"archives need the columns {sorted(missing)}")
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known and let conditions be pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def write_pages(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", text_col: str = "html") -> None:
    """A record per row of ``pages``: of equal payloads the row with the smallest id is a response, the others revisit it.

    A null text is an empty payload. Rows that repeat the smallest id are responses as well. Among payloads whose rows have
    no id at all each row is a response; a null id beside others revisits the smallest of them. Null addresses leave their
    header out. An empty table writes an empty list.
    """
    register(pages.sparkSession)
    source = pick(pages, page_id=id_col, target_uri=uri_col, text=text_col)
    source = source.select(F.col("page_id").cast("long").alias("page_id"), F.col("target_uri").cast("string").alias("target_uri"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("payload"))
    keyed = source.withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload")})
    firsts = keyed.groupBy("sha", "size").agg(F.min("page_id").alias("first_id"))
    joined = keyed.join(firsts, ["sha", "size"])  # a hot payload is a hot key with one row on one side: adaptive execution splits it
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    joined.select("page_id", "target_uri", refers.alias("refers_to"), "payload").write.format("warc").mode("append").option("path", qualified(pages.sparkSession, folder)).save()


def read_archives(spark: SparkSession, folder: str, columns: str | None = None) -> DataFrame:
    """The records of a folder of archives; ``columns``: a schema with some of the columns only."""
    register(spark)
    reader = spark.read.format("warc")
    return (reader.schema(columns) if columns else reader).load(qualified(spark, folder))
