import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
import pytest
from pyarrow import fs

from touchline.llm import warc as W

PAGES = [(3, "http://a/ä", "<p>é</p>"), (1, "http://b", "<p>é</p>"), (2, None, None), (5, "http://c\r\nX: y", ""), (9, "http://d", "x" * 300_000), (8, "http://e", "x" * 300_000),
         (None, "http://f", "<p>é</p>"), (None, "http://g", "alone"), (1, "http://b", "<p>é</p>"), (11, "http://h", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n")]


def want():
    out = []
    for i, _, t in PAGES:
        same = [j for j, _, u in PAGES if (u or "") == (t or "") and j is not None]
        first = min(same, default=None)
        revisit = first is not None and i != first
        b = (t or "").encode()
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "a")
    df = spark.createDataFrame([(t, u, i, "z") for i, u, t in PAGES], "html string, url string, page_id long, Payload string").repartition(3)
    W.write_pages(df, path)
    return path


def test_round_trip(spark, folder):
    rows = W.read_archives(spark, folder).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr) == want()
    texts = {r.page_id: bytes(r.payload).decode() for r in rows if r.record_type == "response" and r.page_id is not None}
    assert texts == {i: t or "" for i, _, t in PAGES if i in texts}
    ids = {r.record_id: r for r in rows}
    assert all(ids[r.refers_to_record].page_id == r.refers_to for r in rows if r.record_type == "revisit")
    assert {r.target_uri for r in rows if r.page_id == 5} == {"http://c%0D%0AX: y"} and {r.target_uri for r in rows if r.page_id == 2} == {None}


def test_conditions_are_pushed_down(spark, folder):
    df = W.read_archives(spark, folder, "page_id long, record_type string").filter("record_type = 'revisit' and page_id >= 3")
    assert sorted(r.page_id for r in df.collect()) == sorted(i for i, *_, t, _ in want() if t == "revisit" and (i or 0) >= 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan


def test_payloads_are_leapt_over():
    data = [W.record(i, "http://x", bytes([65 + i]) * 500_000, None) for i in range(4)]
    packed = b"".join(map(W.member, data))
    assert gzip.decompress(packed) == b"".join(data)
    for blob, is_packed in ((packed, True), (b"".join(data), False), (b"".join(map(gzip.compress, data)), True)):
        stream = W._Stream(pa.BufferReader(blob), len(blob), is_packed)
        rows = list(W.records(None, len(blob), is_packed, [W.Condition("page_id", "=", 2)], True, True, True, stream))
        assert [r["payload"] for r in rows] == [b"C" * 500_000]
    stream = W._Stream(pa.BufferReader(packed), len(packed), True)
    assert len(list(W.records(None, len(packed), True, (), False, False, True, stream))) == 4 and stream.inflated <= 4 * W.CHUNK


def test_damage_is_found():
    bad = W.record(1, None, b"good payload", None).replace(b"good payload", b"evil payload")
    for blob, error in ((bad, ValueError), (b"nonsense", ValueError), (bad[:-10], EOFError)):
        with pytest.raises(error):
            list(W.records(pa.BufferReader(blob), len(blob), False))


def test_only_committed_files_count(spark, folder):
    store = fs.LocalFileSystem()
    with store.open_output_stream(f"{folder}/part-{uuid.uuid4().hex}.warc") as f:
        f.write(W.record(77, None, b"lost attempt", None))
    assert all(r.page_id != 77 for r in W.read_archives(spark, folder, "page_id long").collect())


def test_empty_table_and_small_files(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    W.write_pages(df, str(tmp_path / "none"))
    assert W.read_archives(spark, str(tmp_path / "none")).count() == 0
    rows = spark.range(50).selectExpr("id as page_id", "'u' as target_uri", "cast(null as long) as refers_to", "cast(repeat('x', 3000) as binary) as payload")
    rows.write.format("warc").mode("append").option("path", f"file://{tmp_path}/many").option("filebytes", 8000).option("compression", "none").save()
    assert len(list((tmp_path / "many").glob("*.warc"))) > 10
    back = spark.read.format("warc").option("partitionbytes", 20000).load(f"file://{tmp_path}/many")
    assert back.count() == 50 and back.rdd.getNumPartitions() > 4


def test_smallest_and_largest_ids(spark, tmp_path):
    ids = [-(1 << 63), (1 << 63) - 1, 10 ** 18, -(10 ** 18), 0]
    df = spark.createDataFrame([(i, "u", "same") for i in ids], "page_id long, url string, html string")
    W.write_pages(df, str(tmp_path / "wide"))
    got = {r.page_id: r.refers_to for r in W.read_archives(spark, str(tmp_path / "wide")).filter("record_type in ('response', 'revisit')").collect()}
    assert got == {i: None if i == min(ids) else min(ids) for i in ids}
    assert W.read_archives(spark, str(tmp_path / "wide")).filter(f"page_id = {10 ** 18}").count() == 1
