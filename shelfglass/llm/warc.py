"""WARC archives: written, brought into record-by-record form, and read back by offset.

``write_archives`` writes rows as WARC records, one gzip stream per archive, as Spark's text writer
does: a row is a record and the writer's separator is the blank line pair that ends it.
``normalise`` inflates such a stream once, in one pass and whatever its records hold, writes every
record again as a gzip member of its own and a sidecar index with its offset and length.
``read_records`` fetches the members by their offsets, so that readers need not follow the archives.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfglass.llm.registry import query, read
from shelfglass.llm.slots import slot, slots_of
from shelfglass.staging import parallelism, scratch, stage

# Fixed values of the format.
END = "\r\n\r\n"
_END = END.encode()
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: A payload that more than one row in so many shares is joined by broadcast, so at most so many.
HOT_SHARE = 1000
#: Payloads from this size on are stored once, and compressed bytes that a reading task fetches.
LEAST_BYTES, TASK_BYTES = 1000, 32_000_000
# Bytes of pieces or records handed on at a time.
_BATCH_BYTES = 4_000_000

INDEX = "archive string, offset bigint, length bigint, record_type string, record_id string"
RECORDS = ("record_id string, record_type string, url string, payload binary, "
           "payload_bytes bigint, payload_digest string, refers_to string")


# --- writing ---------------------------------------------------------------------------------

def record_id(key: Column, digest: Column) -> Column:
    """URI of a record: its row's key (a tilde for null), escaped, and its payload's digest."""
    name = F.coalesce(F.url_encode(key.cast("string")), F.lit("~"))
    return F.concat(F.lit("<urn:row:"), name, F.lit(":"), digest, F.lit(">"))


def with_responses(rows: DataFrame, least: int) -> DataFrame:
    """Adds ``first``: the key of the record that a row (key, size, digest, ...) revisits, and
    ``revisit``.

    Only rows whose digest may repeat are shuffled, and digests of many rows are not: there are at
    most ``HOT_SHARE`` of them.
    """
    groups = stage(rows.filter(F.col("size") >= least).groupBy("digest", "size").agg(
        F.max("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "payloads")
    total = rows.count()
    heavy = F.col("n") * HOT_SHARE > total
    held = slots_of(groups, F.col("digest"))
    marked = rows.withColumn("slot", slot(F.col("digest")))
    kept = [F.col(c) for c in rows.columns]
    none = F.lit(None).cast(rows.schema["key"].dataType)
    single = marked.join(held, "slot", "left_anti").select(*kept, none.alias("first"),
                                                           F.lit(False).alias("found"))
    asked = marked.join(held, "slot", "left_semi").select(*kept)

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        other = right.select("digest", "size", "first", F.lit(True).alias("hit"))
        return left.join(other, ["digest", "size"], "left").select(
            *rows.columns, "first", F.coalesce("hit", F.lit(False)).alias("found"))

    hot = meet(asked, F.broadcast(groups.filter(heavy)))
    cold = meet(hot.filter("NOT found").drop("first", "found"), groups.filter(~heavy))
    every = single.unionByName(hot.filter("found")).unionByName(cold)
    return every.withColumn("revisit", F.col("found") & ~F.col("key").eqNullSafe(
        F.col("first"))).drop("found")


def write_archives(rows: DataFrame, folder: str, *, key: str, url: str, payload: str,
                   date: str = "2000-01-01T00:00:00Z", least: int = LEAST_BYTES) -> None:
    """Write a WARC record for every row to archives in ``folder``, each one gzip stream.

    The payload is the text in UTF-8, empty for null. Of the rows with equal payloads of at least
    ``least`` bytes that of the largest key is a response record and the others are revisits of it;
    a null key is smaller than any other, and rows that repeat the largest key are responses each.
    All other rows are responses. Blanks and control characters in a URL are written as ``%20``, a
    null URL as an empty one. An empty table gives no archive with a record. Further columns are
    ignored.
    """
    plain = rows.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(payload), F.lit("")).alias("body")).withColumns({
                            "size": F.octet_length("body").cast("long"),
                            "digest": F.sha1(F.col("body").cast("binary"))})
    every = with_responses(plain, least)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                          "Content-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.concat(http, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("body")))
    target = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"\r\n{name}: "), value)

    head = F.concat(
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("key"), F.col("digest"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", target),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(
            line("WARC-Profile", F.lit(REVISIT_PROFILE)),
            line("WARC-Refers-To", record_id(F.col("first"), F.col("digest"))))
        ).otherwise(F.lit("")),
        line("Content-Length", F.octet_length("block").cast("string")), F.lit(END))
    every.withColumn("block", block).select(F.concat(head, F.col("block")).alias("value")).write.option(
        "compression", "gzip").option("lineSep", END).text(folder)


# --- one member for each record ---------------------------------------------------------------

class Member:
    """One record on its way into a gzip member of its own."""

    def __init__(self, out):
        self.out, self.length = out, 0
        self.packer = zlib.compressobj(6, zlib.DEFLATED, 31)

    def put(self, data) -> None:
        self._write(self.packer.compress(data))

    def close(self) -> int:
        self._write(self.packer.flush())
        return self.length

    def _write(self, data: bytes) -> None:
        self.length += len(data)
        self.out.write(data)


def headers_of(head: bytes) -> dict[str, str]:
    """Named fields below the first line, names in lower case."""
    fields = (x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in fields}


class Splitter:
    """Cuts an inflated stream into records by their stated lengths and writes each as a member.

    ``feed`` takes the stream in pieces of any size and gives (offset, length, headers) of every
    record that ends; a payload passes through in pieces.
    """

    def __init__(self, out):
        self.out, self.at = out, 0
        self.held, self.left, self.tail = bytearray(), 0, 0
        self.member: Member | None = None
        self.headers: dict[str, str] = {}

    def feed(self, data: bytes) -> Iterator[tuple[int, int, dict[str, str]]]:
        self.held += data
        while True:
            if self.member is None:
                end = self.held.find(_END)
                if end < 0:
                    return
                head = bytes(self.held[:end + len(_END)])
                if not head.startswith(b"WARC/"):
                    raise ValueError("no WARC record where one should start")
                self.headers = headers_of(head)
                self.left, self.tail = int(self.headers["content-length"]), len(_END)
                self.member = Member(self.out)
                self.member.put(head)
                del self.held[:end + len(_END)]
            take = min(self.left + self.tail, len(self.held))
            if take:
                self.member.put(self.held[:take])
                body = min(take, self.left)
                self.left -= body
                self.tail -= take - body
                del self.held[:take]
            if self.left or self.tail:
                return
            length = self.member.close()
            yield self.at, length, self.headers
            self.at += length
            self.member = None

    def finish(self) -> None:
        if self.member is not None or self.held:
            raise ValueError("the archive ends within a record")


def _location(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder)


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite the archives in ``source`` with one gzip member per record; returns the index.

    Every archive is inflated once, as a stream, in one task; its records go to an archive of their
    own in ``target``, beside a sidecar file with a JSON line (offset, length, type, id, URI,
    digest) for each. The returned index (archive, offset, length, record_type, record_id) is a
    staged table and names only files of tasks that ended well: a lost task writes files of another
    name again. A file without records gives none; a torn record is an error. ``target`` is a
    folder that pyarrow's file systems reach (local, HDFS, S3, GCS, Azure) from all executors.
    """
    pieces = spark.read.option("lineSep", END).text(source).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    names = ["archive", "offset", "length", "record_type", "record_id"]

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _location(target)
        now, out, side, splitter, found = None, None, None, None, []

        def close():
            if now is not None:
                splitter.finish()
                out.close()
                side.close()

        def rows() -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [[]] * len(names)
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            found.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            for file, piece in zip(batch.column(0), batch.column(1), strict=True):
                file = file.as_py()
                if file != now:
                    close()
                    now, name = file, f"{uuid.uuid4().hex}.warc.gz"
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                    side = files.open_output_stream(f"{root}/{name}.index.jsonl", compression=None)
                    splitter = Splitter(out)
                data = piece.as_buffer().to_pybytes() if piece.is_valid else b""
                for offset, length, head in splitter.feed(data + _END):
                    kind, own = head.get("warc-type", ""), head.get("warc-record-id", "")
                    side.write((json.dumps({
                        "offset": offset, "length": length, "type": kind, "id": own,
                        "uri": head.get("warc-target-uri", ""),
                        "digest": head.get("warc-payload-digest", "")}) + "\n").encode())
                    found.append((name, offset, length, kind, own))
            yield rows()
        close()

    files, root = _location(target)
    files.create_dir(root, recursive=True)
    return stage(pieces.mapInArrow(rewritten, INDEX), "warc-index")


# --- reading by offset ------------------------------------------------------------------------

def parsed(member: bytes) -> dict:
    """The parts of one record; a response's payload must have the digest its header states."""
    record = zlib.decompress(member, 31)
    end = record.index(_END) + len(_END)
    head = headers_of(record[:end])
    block = record[end:end + int(head["content-length"])]
    cut = block.index(_END) + len(_END)
    http, payload = headers_of(block[:cut]), block[cut:]
    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"{head['warc-record-id']}: payload and digest differ")
    return {"record_id": head["warc-record-id"], "record_type": kind,
            "url": head.get("warc-target-uri", ""), "payload": payload,
            "payload_bytes": int(http["content-length"]), "payload_digest": digest,
            "refers_to": head.get("warc-refers-to")}


def read_records(index: DataFrame, folder: str, *, payloads: bool = True) -> DataFrame:
    """The records of an index of ``normalise``, each fetched by its offset.

    (record_id, record_type, url, payload, payload_bytes, payload_digest, refers_to). Size and
    digest are those of the full payload, which a revisit states and does not hold. ``payloads``
    False leaves the column ``payload`` null after the digest was compared. Tasks take stretches of
    the index of about ``TASK_BYTES``.
    """
    spark = index.sparkSession
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(parallelism(spark), math.ceil(total / TASK_BYTES))
    types = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _location(folder)
        now, source, held, size = None, None, [], 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in held], t) for n, t in zip(names, types, strict=True)], names)

        for batch in batches:
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != now:
                    if source is not None:
                        source.close()
                    now, source = name, files.open_input_file(f"{root}/{name}")
                record = parsed(source.read_at(length, offset))
                size += len(record["payload"])
                if not payloads:
                    record["payload"] = None
                held.append(record)
                if size > _BATCH_BYTES:
                    yield rows()
                    held, size = [], 0
            yield rows()
            held, size = [], 0

    asked = index.select("archive", "offset", "length").repartitionByRange(
        tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return asked.mapInArrow(fetched, RECORDS)


def key_of(uri: Column, kind: T.DataType) -> Column:
    """The row's key in a record's URI, cast to the type it had; a tilde is null."""
    escaped = F.regexp_extract(uri, "^<urn:row:(.*):[0-9a-f]{40}>$", 1)
    return F.when(escaped != "~", F.url_decode(escaped)).cast(kind)


ORACLE = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
    sha1(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (
  SELECT payload_digest, payload_bytes, max(page_id) AS page_id FROM p
  WHERE payload_bytes >= {LEAST_BYTES} GROUP BY ALL)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN f.page_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.page_id <> p.page_id THEN f.page_id END AS refers_to
FROM p LEFT JOIN firsts f USING (payload_digest, payload_bytes)
"""


@query("op11_warc", ORACLE)
def op11_warc(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    folder, kind = scratch(spark, "warc"), pages.schema["page_id"].dataType
    write_archives(pages, f"{folder}/streams", key="page_id", url="url", payload="html")
    index = normalise(spark, f"{folder}/streams", f"{folder}/records")
    found = read_records(index, f"{folder}/records", payloads=False)
    return found.select(
        key_of(F.col("record_id"), kind).alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", key_of(F.col("refers_to"), kind).alias("refers_to"))
