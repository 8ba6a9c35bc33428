import gzip
import hashlib
import json
import zlib
from pathlib import Path
from urllib.parse import urlparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfglass.llm import warc
from shelfglass.staging import scratch

BIG = "x" * 1200
TRICKY = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 30 + "é\r\n\r"
PAGES = [(1, "http://a/1", BIG), (2, None, BIG), (3, "http://a/ 3\r\nX: y", BIG),
         (4, "http://a/4", TRICKY), (5, "http://a/5", TRICKY), (5, "http://a/5", TRICKY),
         (6, "http://a/6", None), (7, "http://a/7", ""), (8, "", "short"), (9, "", "short"),
         (None, "http://a/n", BIG), (None, "u", "z" * 1000), (10, "u", "é" * 500), (11, "u", "é" * 500),
         (12, "u", "y" * 999), (13, "u", "y" * 999), (14, "u", "\r\n\r\n" * 300), (15, "u", BIG * 3000)]


def pages_frame(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", 1) for r in rows],
        "page_id bigint, url string, html string, digest string, size int")


def brute(rows, least=1000):
    data = [(k, (t or "").encode()) for k, _, t in rows]
    out = []
    for k, body in data:
        keys = [o for o, b in data if b == body]
        first = max((o for o in keys if o is not None), default=None)
        revisit = len(body) >= least and k != first
        out.append((k, len(body), hashlib.sha1(body).hexdigest(),
                    "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def written(spark, pages):
    folder = scratch(spark, "warc-test")
    warc.write_archives(pages, f"{folder}/streams", key="page_id", url="url", payload="html")
    return folder, warc.normalise(spark, f"{folder}/streams", f"{folder}/records")


def digest_rows(found):
    return sorted((tuple(r) for r in found.select(
        warc.key_of(F.col("record_id"), found.sparkSession.range(1).schema[0].dataType),
        "payload_bytes", "payload_digest", "record_type",
        warc.key_of(F.col("refers_to"), found.sparkSession.range(1).schema[0].dataType)).collect()),
        key=repr)


@pytest.fixture(scope="module")
def archives(spark):
    folder, index = written(spark, pages_frame(spark, PAGES).repartition(3))
    return folder, index


def test_round_trip_matches_brute_force(archives):
    folder, index = archives
    found = warc.read_records(index, f"{folder}/records")
    assert digest_rows(found) == brute(PAGES)
    held = [hashlib.sha1(bytes(r["payload"])).hexdigest() for r in found.collect()
            if r["record_type"] == "response"]
    assert sorted(held) == sorted(d for _, _, d, kind, _ in brute(PAGES) if kind == "response")


def test_members_offsets_and_sidecar(archives):
    folder, index = archives
    rows = index.collect()
    for name in {r["archive"] for r in rows}:
        path = Path(urlparse(f"{folder}/records/{name}").path)
        data, mine = path.read_bytes(), sorted(
            (r for r in rows if r["archive"] == name), key=lambda r: r["offset"])
        assert [r["offset"] for r in mine] == [
            sum(x["length"] for x in mine[:i]) for i in range(len(mine))]
        assert sum(r["length"] for r in mine) == len(data)
        for r in mine:
            member = zlib.decompressobj(31)
            record = member.decompress(data[r["offset"]:r["offset"] + r["length"]])
            assert member.eof and not member.unused_data
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        side = [json.loads(x) for x in Path(f"{path}.index.jsonl").read_text().splitlines()]
        assert [(x["offset"], x["length"], x["id"]) for x in side] == [
            (r["offset"], r["length"], r["record_id"]) for r in mine]
        # The rewritten archive inflates to the same bytes as a stream.
        assert gzip.decompress(data).count(b"WARC-Record-ID") == len(mine)


def test_streams_are_one_member_each(archives):
    folder, _ = archives
    for path in Path(urlparse(f"{folder}/streams").path).glob("*.gz"):
        stream = zlib.decompressobj(31)
        stream.decompress(path.read_bytes())
        assert stream.eof and not stream.unused_data


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=30), max_size=5), st.integers(1, 40))
def test_splitter_takes_any_pieces(bodies, step):
    class Out(bytearray):
        write = bytearray.extend

    stream = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in bodies)
    out = Out()
    splitter = warc.Splitter(out)
    found = [x for i in range(0, len(stream), step) for x in splitter.feed(stream[i:i + step])]
    splitter.finish()
    assert len(found) == len(bodies)
    assert b"".join(zlib.decompress(bytes(out[a:a + n]), 31) for a, n, _ in found) == stream


def test_torn_and_foreign_streams_are_errors():
    for bad in (b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", b"WARC/1.1\r\nCont"):
        splitter = warc.Splitter(bytearray())
        splitter.out = type("Out", (), {"write": staticmethod(lambda data: None)})
        assert list(splitter.feed(bad)) == []
        with pytest.raises(ValueError):
            splitter.finish()
    with pytest.raises(ValueError):
        list(warc.Splitter(None).feed(b"HTTP/1.1 200 OK\r\n\r\n"))


def test_empty_table_and_string_keys(spark):
    folder, index = written(spark, pages_frame(spark, []))
    assert index.count() == 0
    assert warc.read_records(index, f"{folder}/records").count() == 0
    rows = [("a b~c", "u", BIG), ("z:é", "u", BIG), ("~", "u", "s"), (None, "u", "t"), ("", "u", "v")]
    folder, index = written(spark, spark.createDataFrame(rows, "page_id string, url string, html string"))
    kind = spark.createDataFrame(rows, "page_id string, url string, html string").schema[0].dataType
    got = warc.read_records(index, f"{folder}/records", payloads=False).select(
        warc.key_of(F.col("record_id"), kind).alias("k"), "record_type",
        warc.key_of(F.col("refers_to"), kind).alias("r")).collect()
    assert {tuple(x) for x in got} == {
        ("a b~c", "revisit", "z:é"), ("z:é", "response", None), ("~", "response", None),
        (None, "response", None), ("", "response", None)}


def test_hot_payload(spark):
    """A payload of most rows goes by broadcast, a rare one by the shuffled join."""
    rows = [(k, "u", BIG if k % 3 else f"{k // 6}" * 1100) for k in range(4000)]
    folder, index = written(spark, pages_frame(spark, rows))
    data = {}
    for k, _, t in rows:
        data.setdefault(t, []).append(k)
    want = {(k, None if k == max(data[t]) else max(data[t])) for k, _, t in rows}
    kind = pages_frame(spark, []).schema["page_id"].dataType
    found = warc.read_records(index, f"{folder}/records", payloads=False).select(
        warc.key_of(F.col("record_id"), kind), warc.key_of(F.col("refers_to"), kind)).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(rows)
