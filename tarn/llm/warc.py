"""Legacy ARC archives to WARC, and both formats' readers and writers (operator 7).

An ARC file starts with a version block whose second line names the version and whose third names the fields of
each record's header line; records follow by their declared lengths. Version 1 has five fields, version 2 ten.
The converter reads the fields by position from that line, so either version, and any order of fields, works.
WARC records get their identifiers from the record's own key (the same input gives the same archive), their
timestamps from the ARC date, their types from the payload's copies, their digests from the bytes.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path

#: The field lines of the two ARC versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
CAPTURED = "20240101000000"
SPACE_OF_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def sha1_of(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header_url(url: str | None) -> str:
    """A URL without what would break a header line."""
    return "".join(c if c > " " else "%%%02X" % ord(c) for c in url or "") or "-"


def arc_file(records: list[tuple[str | None, str, bytes]], version: int) -> bytes:
    """An ARC file of (url, key, content); content is a whole HTTP response, key goes to the file-name field."""
    block = f"{version} 0 tarn\n{FIELDS[version]}\n\n".encode()
    head = {1: f"filedesc://tarn.arc 0.0.0.0 {CAPTURED} text/plain {len(block)}\n", 2: f"filedesc://tarn.arc 0.0.0.0 {CAPTURED} text/plain 200 - - 0 tarn.arc {len(block)}\n"}
    out = [head[version].encode(), block]
    size = sum(map(len, out))
    for url, key, content in records:
        u = _header_url(url)
        line = {1: f"{u} 0.0.0.0 {CAPTURED} text/html {len(content)}\n", 2: f"{u} 0.0.0.0 {CAPTURED} text/html 200 {sha1_of(content)} - {size} {key} {len(content)}\n"}[version].encode()
        out += [b"\n", line, content]
        size += 1 + len(line) + len(content)
    return b"".join(out)


def arc_records(data: bytes) -> Iterator[dict]:
    """The records of an ARC file as fields and ``content``, the version block left out. Blank lines between
    records are skipped; a length past the end, or a header line of another form, is an error."""
    at, fields = 0, None
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        begin, length = end + 1, int(line[-1])
        if begin + length > len(data):
            raise ValueError(f"a record at {at} declares {length} bytes, past the end")
        content = data[begin : begin + length]
        at = begin + length
        if fields is None:
            if not line[0].startswith("filedesc://"):
                raise ValueError("not an ARC file: no version block")
            first, names = content.decode("utf-8", "replace").splitlines()[:2]
            if first.split(" ")[0] not in ("1", "2"):
                raise ValueError(f"unknown ARC version {first!r}")
            fields = names.split(" ")
            continue
        if len(line) != len(fields):
            raise ValueError(f"{len(line)} fields where the file has {len(fields)}")
        yield dict(zip(fields, line, strict=True)) | {"content": content}


def http_response(payload: bytes, key: str) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Record-Key: %s\r\nContent-Length: %d\r\n\r\n" % (key.encode(), len(payload)) + payload


def split_http(content: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields (lower-case names), the header's bytes, the payload."""
    at = content.find(b"\r\n\r\n")
    head = content if at < 0 else content[: at + 4]
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]) if v)
    return fields, head, b"" if at < 0 else content[at + 4 :]


def record_id(key: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_OF_IDS, 'tarn:' + (key or ''))}>"


def warc_record(url: str, date: str, key: str, content: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.0 record: a response, or with ``refers_to`` (a key) a revisit that keeps the HTTP header alone."""
    stamp = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    block = content if refers_to is None else split_http(content)[1]
    head = ["WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {stamp}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_of(block)}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Key: {refers_to}"]
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def warc_records(data: bytes) -> Iterator[dict]:
    """The records of a WARC file (plain, or gzip of one or many members) as lower-case header fields and ``content``."""
    if data[:2] == b"\x1f\x8b":
        import gzip

        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        begin, length = end + 4, int(fields["content-length"])
        if data[begin + length : begin + length + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} doesn't end where it declares")
        yield fields | {"content": data[begin : begin + length]}
        at = begin + length + 4


# ------------------------------------------------------------------ Spark


def pages_to_arc(df: DataFrame, key: Column, url: Column, payload: Column, records: int = 200) -> DataFrame:
    """ARC files (as rows: content binary) of at most ``records`` records, of versions 1 and 2 in turn."""

    def run(batches):
        version = 1
        for b in batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            for i in range(0, len(rows), records):
                files = [arc_file([(u, str(k), http_response(p or b"", str(k))) for k, u, p in rows[i : i + records]], version)]
                version = 3 - version
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.binary())], ["content"])

    return df.select(key.cast("string").alias("k"), url.cast("string").alias("u"), payload.cast("binary").alias("p")).mapInArrow(run, "content binary")


def read_arc(files: DataFrame) -> DataFrame:
    """The records of ARC files (``content`` binary, as Spark's binaryFile source gives): key, url, date, content,
    payload_bytes, payload_digest. The key is the response's X-Record-Key, else the URL and the date."""

    def run(batches):
        for b in batches:
            for data in b.column(0):
                rows = []
                for r in arc_records(data.as_py()):
                    fields, _, payload = split_http(r["content"])
                    rows.append((fields.get("x-record-key", f"{r['URL']} {r['Archive-date']}"), r["URL"], r["Archive-date"], r["content"], len(payload), sha1_of(payload)))
                columns = zip(*rows, strict=True) if rows else [[]] * 6
                kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "url", "date", "content", "payload_bytes", "payload_digest"])

    return files.select("content").mapInArrow(run, "key string, url string, date string, content binary, payload_bytes long, payload_digest string")


def with_revisits(records: DataFrame, order: Column) -> DataFrame:
    """``records`` with refers_to: of those with equal payloads, the key of the one with the largest (order, key);
    null for that one itself. Groups are summed up before any shuffle of theirs; only payloads that occur more
    than once take part in the join, whose large groups Spark splits (adaptive skew join)."""
    narrow = records.select("payload_digest", "payload_bytes", order.alias("o"), "key")
    best = narrow.groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("o", "key")).alias("m"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "payload_bytes", F.col("m.key").alias("response"))
    out = records.join(best, ["payload_digest", "payload_bytes"], "left")
    return out.withColumn("refers_to", F.when(F.col("response") != F.col("key"), F.col("response"))).drop("response")


def write_warc(records: DataFrame, path: str, per_file: int = 2000) -> None:
    """WARC files (gzip) of at most ``per_file`` records. A record's last byte is a line end, which the text
    writer adds itself, so its other bytes are written as they are."""

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(6)), strict=True)
            data = [warc_record(*r)[:-1] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], ["value"])

    binary = records.select("url", "date", "key", "content", "payload_digest", "refers_to").mapInArrow(run, "value binary")
    binary.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files in a folder: key, url, date, record_type, payload_bytes, payload_digest,
    refers_to (a key). A revisit's payload size is what its HTTP header declares."""

    def run(batches):
        for b in batches:
            for data in b.column(0):
                rows = []
                for r in warc_records(data.as_py()):
                    fields, _, payload = split_http(r["content"])
                    size = len(payload) if r["warc-type"] == "response" else int(fields["content-length"])
                    rows.append((fields.get("x-record-key"), r["warc-target-uri"], r["warc-date"], r["warc-type"], size, r["warc-payload-digest"].removeprefix("sha1:"), r.get("x-refers-to-key")))
                kinds = (pa.string(),) * 4 + (pa.int64(), pa.string(), pa.string())
                columns = zip(*rows, strict=True) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "url", "date", "record_type", "payload_bytes", "payload_digest", "refers_to"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, "key string, url string, date string, record_type string, payload_bytes long, payload_digest string, refers_to string")


def archive_round_trip(df: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """Rows to ARC files, those converted to WARC files in the shared folder, these read back (see :func:`read_warc`).

    A null payload is empty; a null or odd URL, repeated rows and very long payloads are archived like any other.
    Rows with a null key share the key ``None``. An empty table gives an empty result.
    """
    records = read_arc(pages_to_arc(df, F.col(key), F.col(url), F.col(payload)))
    path = scratch_path(df.sparkSession, "warc")
    write_warc(with_revisits(records, F.expr("try_cast(key as bigint)")), path)
    return read_warc(df.sparkSession, path)
