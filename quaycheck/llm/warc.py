"""Zstandard WARC archives: written record by record and read back with every header and length checked.

An archive starts with a skippable frame that holds the dictionary; every record is one frame compressed with it.
Payloads of at least `least` bytes that are equal are stored once: the row with the smallest id is the response, the
others are revisits that name it and carry its HTTP header, so the full payload's length and digest can be read from
them. Which rows revisit which is found by an aggregation over digests and a join.

Tasks write archives into a new folder under the shared one and roll over to the next file by size; a written table
lists the files of the attempts that succeeded, so files of lost attempts are never read. Files are opened through the
folder's own scheme (file, hdfs, s3 ...). The reader streams one frame at a time.

Null payloads are empty. Rows with equal payloads and the smallest id in common are all responses. Rows with a null id
never serve as response to others and are written with an empty page number. Other columns are left out. An empty
table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaycheck.llm.common import bounded_sample, fresh_folder, staged

#: Fixed values of the format: skippable frame and frame magic, little-endian; record version; revisit profile.
SKIPPABLE, FRAME = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_OK = "HTTP/1.1 200 OK"


class Broken(ValueError):
    """An archive that breaks the format."""


def _headers(first: str, pairs: list[tuple[str, str]]) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in pairs) + "\r\n").encode()


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The bytes of one response or revisit record."""
    http = _headers(HTTP_OK, [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    block = http + (payload if refers_to is None else b"")
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    clean = "".join(c for c in url or "" if c > " ")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", clean), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _headers(VERSION.decode(), fields) + block + b"\r\n\r\n"


def _split(data: bytes, first: bytes) -> tuple[dict[str, str], bytes]:
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(first):
        raise Broken(f"no {first.decode()} header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or name.strip().lower() in fields:
            raise Broken(f"bad or repeated header {name!r}")
        fields[name.strip().lower()] = value.strip()
    return fields, rest


def _length(fields: dict[str, str]) -> int:
    value = fields.get("content-length", "")
    if not value.isdigit():
        raise Broken("no valid content length")
    return int(value)


def _page(name: str) -> int | None:
    if not (name.startswith("<urn:page:") and name.endswith(">")):
        raise Broken(f"unknown record id {name!r}")
    return int(name[10:-1]) if name != "<urn:page:>" else None


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """(page, payload length, digest, type, refers_to, stored payload) of a record whose headers, lengths and digest hold."""
    fields, rest = _split(data, VERSION)
    n = _length(fields)
    block, tail = rest[:n], rest[n:]
    if len(block) != n or tail != b"\r\n\r\n":
        raise Broken("record length differs from its header")
    for name in ("warc-type", "warc-record-id", "warc-date", "warc-payload-digest"):
        if name not in fields:
            raise Broken(f"no {name}")
    http, payload = _split(block, b"HTTP/")
    size, kind = _length(http), fields["warc-type"]
    method, _, digest = fields["warc-payload-digest"].partition(":")
    if method != "sha256" or len(digest) != 64:
        raise Broken("unknown payload digest")
    if kind == "response":
        if size != len(payload) or hashlib.sha256(payload).hexdigest() != digest:
            raise Broken("payload differs from its length or digest")
        return _page(fields["warc-record-id"]), size, digest, kind, None, payload
    if kind != "revisit" or payload or fields.get("warc-profile") != PROFILE:
        raise Broken(f"unknown record {kind!r}")
    return _page(fields["warc-record-id"]), size, digest, kind, _page(fields.get("warc-refers-to", "")), payload


def dictionary_frame(dictionary: bytes) -> bytes:
    return SKIPPABLE + len(dictionary).to_bytes(4, "little") + dictionary


def read_dictionary(source: BinaryIO) -> bytes:
    """The dictionary from the leading skippable frame; one that is itself compressed is unpacked."""
    head = source.read(8)
    if head[:4] != SKIPPABLE or len(head) < 8:
        raise Broken("no leading dictionary frame")
    n = int.from_bytes(head[4:], "little")
    data = source.read(n)
    if len(data) != n:
        raise Broken("dictionary frame is cut short")
    return zstandard.ZstdDecompressor().decompress(data) if data[:4] == FRAME else data


def frames(source: BinaryIO, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The content of each frame after the dictionary, one at a time."""
    data = read_dictionary(source)
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
    held = b""
    while True:
        held = held or source.read(chunk)
        if not held:
            return
        one, out = unpack.decompressobj(), []
        while True:
            out.append(one.decompress(held))
            if one.eof:
                held = one.unused_data
                break
            held = source.read(chunk)
            if not held:
                raise Broken("the last frame is cut short")
        yield b"".join(out)


def train_dictionary(rows: list[bytes], size: int) -> bytes:
    """A shared dictionary, or an empty one where there is too little to learn from."""
    try:
        return zstandard.train_dictionary(size, rows).as_bytes() if len(rows) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def with_references(pages: DataFrame, id_col: str, url: str, payload: str, least: int) -> DataFrame:
    """(page, url, payload, digest, refers_to) of every row."""
    raw = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    own = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url).cast("string").alias("url"), raw.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # only ids and digests are shuffled; payloads wait for a table that has one row per repeated digest
    keys = pages.select(F.col(id_col).cast("long").alias("page"), F.sha2(raw, 256).alias("digest"), F.length(raw).alias("n")).where(F.col("n") >= least)
    repeated = staged(keys.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("rows")).where("rows > 1 AND first IS NOT NULL").select("digest", "first"), "repeated")
    joined = own.join(repeated, "digest", "left")
    return joined.select("page", "url", "payload", "digest", F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(rows: DataFrame, dictionary: bytes, folder: str, roll: int = 64 << 20, level: int = 3) -> DataFrame:
    """Writes the records of each task to archives in the folder; a table of the files: (path, records)."""
    shared = rows.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches):
        data = shared.value
        pack = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(data) if data else None, write_content_size=True)
        fs, base = pafs.FileSystem.from_uri(folder)
        out, path, size, n = None, "", 0, 0
        try:
            for batch in batches:
                for page, url, payload, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "payload", "digest", "refers_to")), strict=True):
                    if out is None:
                        fs.create_dir(base, recursive=True)
                        path, n = f"{base}/{uuid.uuid4().hex}.warc.zst", 0
                        out = fs.open_output_stream(path)
                        out.write(dictionary_frame(data))
                        size = len(data)
                    frame = pack.compress(record(page, url, payload, digest, refers))
                    out.write(frame)
                    size, n = size + len(frame), n + 1
                    if size >= roll:
                        out.close()
                        out = None
                        yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "records": pa.array([n], pa.int64())})
            if out is not None:
                out.close()
                out = None
                yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "records": pa.array([n], pa.int64())})
        finally:
            if out is not None:
                out.close()

    return staged(rows.mapInArrow(run, "path string, records long"), "archives")


def read_archives(files: DataFrame, folder: str, keep_payload: bool = False) -> DataFrame:
    """Every record of the listed archives; a count that differs from the list's is an error."""
    fields = ["page", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def run(batches):
        fs = pafs.FileSystem.from_uri(folder)[0]
        for batch in batches:
            for path, want in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                seen, held = 0, []
                with fs.open_input_stream(path) as source:
                    for frame in frames(source):
                        row = parse(frame)
                        held.append(row if keep_payload else (*row[:5], None))
                        seen += 1
                        if len(held) >= (64 if keep_payload else 4096):
                            yield batch_of(held)
                            held = []
                if held:
                    yield batch_of(held)
                if seen != want:
                    raise Broken(f"{path}: {seen} records instead of {want}")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], fields)

    spread = files.repartition(max(1, files.count()), "path")
    return spread.mapInArrow(run, "page long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", least: int = 100, sample_rows: int = 1000, sample_bytes: int = 4096, dictionary_bytes: int = 32 << 10, keep_payload: bool = False) -> DataFrame:
    """Writes all rows to archives and reads them back: (id, payload_bytes, payload_digest, record_type, refers_to).

    The dictionary is fitted on at most `sample_rows` payloads of `sample_bytes` each.
    """
    spark = pages.sparkSession
    some = bounded_sample(pages.where(F.length(payload) > 0).select(id_col, F.substring(payload, 1, sample_bytes).alias("t")), sample_rows, id_col)
    dictionary = train_dictionary([r[0].encode() for r in some.select("t").collect()], dictionary_bytes)
    folder = fresh_folder(spark, "warc")
    files = write_archives(with_references(pages, id_col, url, payload, least), dictionary, folder)
    found = read_archives(files, folder, keep_payload).withColumnRenamed("page", id_col)
    return found if keep_payload else found.drop("payload")
