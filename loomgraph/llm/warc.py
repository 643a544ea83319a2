"""WARC writing with revisit records, and a salvage reader.

The writer makes one gzip member a record. Of pages with equal payloads (of at
least `at_least` bytes) the one with the largest identifier is a response, the
others are revisits without a body that name it; who that is comes from the
tree merge of digest runs, so a payload that a third of the pages share never
meets in one task. Tasks write archives of about `roll` bytes under names of
their own into the shared folder and return a manifest row for each; the
manifest is written as a table, so archives of lost or repeated attempts are
never read.

The reader checks everything that can be checked (gzip CRC and length, version
line, Content-Length, record end, block and payload digests). After a failed
check it looks for the next gzip member or version line from the following byte
on that passes all checks, goes on from there, and reports the bytes between as
one quarantined gap with the reason. Compressed and plain records may mix. A
record that claims, or unpacks to, more than `LARGEST` bytes counts as damaged,
and bytes are let go as soon as no record can start in them, so memory is bounded
by LARGEST, whatever lengths an archive claims and however long a gap is.

Defined results: a null html is an empty payload; a null identifier ranks below
all others and comes back as null; of repeated rows one is the response; a null
url is left out, control characters in a url are escaped; an identifier that is
an empty string is one of its own; an empty table gives no archive and no rows;
other columns are not read. Payloads may have up to LARGEST bytes less some for
the headers (the writer raises beyond it); archives may have any length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frozen, positional, row_key, scratch_path, ship
from .exact_dedup import elect

ROLL = 32 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_CHUNK = 1 << 18
LARGEST = 256 << 20  # bytes of a record
NONE = "<urn:page-none>"  # stands for a null identifier


def digest32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(ident: str | None) -> str:
    return NONE if ident is None else f"<urn:page:{quote(ident, safe='')}>"


def of_urn(v: str | None) -> str | None:
    if v == NONE:
        return None
    return unquote(v[10:-1]) if v and v.startswith("<urn:page:") else v


def record(kind: str, ident: str | None, url: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One record's bytes, not compressed."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(ident)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    lines += [f"WARC-Payload-Digest: {digest32(payload)}", f"WARC-Block-Digest: {digest32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    whole = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    if len(whole) > LARGEST:
        raise ValueError(f"a record of {len(whole)} bytes is larger than {LARGEST}")
    return whole


class Broken(ValueError):
    pass


def parse(data: bytes, whole: bool) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and length of the record that data begins with. whole: data holds nothing else."""
    if not _VERSION.match(data):
        raise Broken("no version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise Broken("headers do not end")
    fields = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("header line without a colon")
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not re.fullmatch(r"\d{1,15}", fields.get("content-length", "")):
        raise Broken("no content length")
    start, n = end + 4, int(fields["content-length"])
    block, over = data[start : start + n], data[start + n : start + n + 4]
    if len(block) < n or over != b"\r\n\r\n":
        raise Broken("record is cut off or longer than its length")
    if whole and len(data) != start + n + 4:
        raise Broken("bytes after the record")
    if (d := fields.get("warc-block-digest", "")).startswith("sha1:") and d != digest32(block):
        raise Broken("block digest differs")
    if fields.get("warc-type") == "response" and (d := fields.get("warc-payload-digest", "")).startswith("sha1:") and d != digest32(payload_of(block)):
        raise Broken("payload digest differs")
    return fields, block, start + n + 4


def payload_of(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


class _Source:
    """A stream as bytes by offset; what lies before the offset in use is let go."""

    def __init__(self, stream):
        self.stream, self.base, self.data, self.ended = stream, 0, bytearray(), False

    def upto(self, offset: int) -> bool:
        """Whether the byte before offset exists."""
        while not self.ended and self.base + len(self.data) < offset:
            more = self.stream.read(_CHUNK)
            self.data += more
            self.ended = not more
        return self.base + len(self.data) >= offset

    def get(self, offset: int, n: int) -> bytes:
        self.upto(offset + n)
        return bytes(self.data[offset - self.base : offset - self.base + n])

    def drop(self, offset: int) -> None:
        """What is before offset is not needed again; it goes once it is worth the copying of the rest."""
        if offset - self.base > max(4 * _CHUNK, len(self.data) // 2):
            del self.data[: offset - self.base]
            self.base = offset

    def find(self, offset: int) -> int:
        """The next place from offset on where a record may start; the end if there is none."""
        while True:
            self.upto(offset + _CHUNK)
            if m := _START.search(self.data, offset - self.base):
                return self.base + m.start()
            if self.ended:
                return self.base + len(self.data)
            offset = max(offset, self.base + len(self.data) - 10)
            self.drop(offset)


def _one(source: _Source, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record at this offset and where it ends."""
    if source.get(at, 2) == b"\x1f\x8b":
        z, out, k = zlib.decompressobj(31), bytearray(), at
        while not z.eof:
            part = source.get(k, _CHUNK)
            if not part:
                raise Broken("member is cut off")
            k += len(part)
            while part and not z.eof:
                try:
                    out += z.decompress(part, 16 * _CHUNK)
                except zlib.error as e:
                    raise Broken(f"gzip: {e}") from None
                part = z.unconsumed_tail
                if len(out) > 12 and not out.startswith(b"WARC/1."):
                    raise Broken("no version line")
                if len(out) > LARGEST:
                    raise Broken(f"unpacks to more than {LARGEST} bytes")
            if k - at > LARGEST:
                raise Broken(f"more than {LARGEST} bytes packed")
        fields, block, _ = parse(bytes(out), True)
        return fields, block, k - len(z.unused_data)
    if not _VERSION.match(source.get(at, 10)):
        raise Broken("no version line")
    n = _CHUNK
    while True:
        data = source.get(at, n)
        end = data.find(b"\r\n\r\n")
        if end >= 0 and (m := re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d{1,15})[ \t]*\r\n", data[: end + 4])):
            need = end + 8 + int(m[1])
            if need > LARGEST:
                raise Broken(f"claims more than {LARGEST} bytes")
            if len(data) < need and source.upto(at + need):
                data = source.get(at, need)
            break
        if end >= 0 or len(data) < n or n >= 4 * _CHUNK:
            break
        n *= 2
    fields, block, length = parse(data, False)
    return fields, block, at + length


def salvage(stream) -> Iterator[tuple]:
    """("record", start, end, fields, block) and ("gap", start, end, reason, None), in order, covering all bytes."""
    source, at, gap, why = _Source(stream), 0, None, ""
    while source.upto(at + 1):
        try:
            fields, block, end = _one(source, at)
        except Broken as e:
            if gap is None:
                gap, why = at, str(e)
            at = source.find(at + 1)
            source.drop(at)
            continue
        if gap is not None:
            yield "gap", gap, at, why, None
            gap = None
        yield "record", at, end, fields, block
        at = end
        source.drop(at)
    if gap is not None:
        yield "gap", gap, at, why, None


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """One row at a time: payloads are large."""
    for k in range(batch.num_rows):
        yield tuple(c[k].as_py() for c in batch.columns)


def _store(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def marked(pages: DataFrame, id_col: str, url_col: str, body_col: str, at_least: int) -> DataFrame:
    """ident, url, body, refers_to, again (a revisit) of each page."""
    pages, ident, url, body = positional(pages, id_col, url_col, body_col)
    ident, body = F.col(ident), F.coalesce(F.col(body).cast("string"), F.lit(""))
    light = pages.select(F.monotonically_increasing_id().alias("rid"), ident.alias("id"), F.sha1(body).alias("sha"), F.octet_length(body).alias("n_bytes"))
    key = row_key(F.col("id"), F.col("sha"), F.col("n_bytes"))
    best = elect(frozen(light, "payloads"), ["sha", "n_bytes"]).withColumn("k", key)
    best = best.groupBy("k").agg(F.max("top_id").alias("top_id"), F.max(F.col("rid") == F.col("top_rid")).alias("is_top"))
    rows = pages.select(ident.alias("id"), F.col(url).alias("url"), body.alias("body")).withColumn("sha", F.sha1("body")).withColumn("n_bytes", F.octet_length("body"))
    rows = rows.withColumn("k", key).join(best, "k")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("k").orderBy("url")))
    response = (F.col("n_bytes") < at_least) | (F.col("is_top") & (F.col("nth") == 1))
    return rows.select(F.col("id").cast("string").alias("ident"), "url", "body", F.when(~response, F.col("top_id").cast("string")).alias("refers_to"), (~response).alias("again"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", at_least: int = 0, roll: int = ROLL) -> DataFrame:
    """Writes archives under path; the manifest (path, n_records, n_bytes), written and read again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        store.create_dir(folder, recursive=True)
        out, name, n, size = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{path}/{name}"], "n_records": [n], "n_bytes": [size]})

        for b in batches:
            for ident, url, body, refers_to, again in _rows(b):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                z = zlib.compressobj(4, zlib.DEFLATED, 31)
                kind = "revisit" if again else "response"
                member = z.compress(record(kind, ident, url, body.encode(), refers_to)) + z.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= roll:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    ship(pages.sparkSession)
    rows = marked(pages, id_col, url_col, body_col, at_least)
    return frozen(rows.mapInArrow(write, "path string, n_records long, n_bytes long"), "manifest")


RECORDS = "path string, start long, end long, gap string, type string, record_id string, uri string, digest string, refers_to string, payload_bytes long, payload binary"


def read_warc(archives: DataFrame, path_col: str = "path", with_payload: bool = True) -> DataFrame:
    """A row a record, and a row a quarantined gap (gap: the reason)."""
    names = [f.name for f in T._parse_datatype_string(RECORDS).fields]

    def rows(path: str) -> Iterator[tuple]:
        store, name = _store(path)
        with store.open_input_stream(name, compression=None) as stream:
            for kind, start, end, fields, block in salvage(stream):
                if kind == "gap":
                    yield path, start, end, fields, None, None, None, None, None, None, None
                    continue
                body = payload_of(block)
                n = len(body)
                digest = fields.get("warc-payload-digest")
                if fields.get("warc-type") == "revisit":
                    m = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", block)
                    n = int(m[1]) if m else None
                elif fields.get("warc-type") == "response":
                    digest = digest32(body)
                yield path, start, end, None, fields.get("warc-type"), of_urn(fields.get("warc-record-id")), fields.get("warc-target-uri"), digest, of_urn(fields.get("warc-refers-to")), n, body if with_payload else None

    types = dict(zip(names, [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()], strict=True))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                got, held = [], 0
                for r in rows(path):
                    got.append(r)
                    held += 200 + len(r[-1] or b"")
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, types[n]) for n, c in zip(names, zip(*got, strict=True), strict=True)], names)
                        got, held = [], 0
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, types[n]) for n, c in zip(names, zip(*got, strict=True), strict=True)], names)

    ship(archives.sparkSession)
    spread = archives.select(path_col).repartition(max(1, archives.count()))
    return spread.mapInArrow(read, RECORDS)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = pages.schema["page_id"].dataType
    records = read_warc(write_warc(pages, scratch_path(spark, "warc")), with_payload=False).where("gap IS NULL")
    ident = lambda c: F.col(c).cast(kind)
    return records.select(
        ident("record_id").alias("page_id"), "payload_bytes", F.regexp_replace("digest", "^sha1:", "").alias("payload_digest"),
        F.col("type").alias("record_type"), ident("refers_to").alias("refers_to"),
    )
