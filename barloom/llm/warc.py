"""Zstandard WARC archives: a dictionary in a leading skippable frame, one frame a record."""

from __future__ import annotations

import hashlib
import os
import struct
import uuid

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, lean, materialize, partitions, qualified, shared_path, small_batches

# Fixed values of the formats: the skippable frame that holds the dictionary, zstd's own
# magic, the WARC version and the revisit profile.
DICT_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes after which a task starts its next archive; the bound of the dictionary's sample.
ROLL, SAMPLE_PAGES, SAMPLE_BYTES, DICT_BYTES = 128 << 20, 200, 16_384, 65_536


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from about 200 pages, drawn by a hash; b"" if there are too few."""
    texts = pages.select("page_id", "html").where("length(html) > 0")
    n = texts.count()
    drawn = texts.where(F.pmod(F.xxhash64("page_id", F.lit("dict")), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1, SAMPLE_PAGES / max(1, n)))))
    sample = [r[0].encode()[:SAMPLE_BYTES] for r in drawn.select(F.substring("html", 1, SAMPLE_BYTES)).limit(2 * SAMPLE_PAGES).collect()]
    if len(sample) < 20:
        return b""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, sample)) // 8), sample).as_bytes()
    except zstandard.ZstdError:
        return b""


def record(kind: str, ident, url: str | None, digest: str, payload: bytes | None, size: int, refers_to=None) -> bytes:
    """One WARC record around an HTTP response; a revisit has its header block only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if payload is None else http + payload
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if ident is None else ident}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", " ".join((url or "about:blank").split())),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    if payload is None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return VERSION + b"\r\n" + lines + b"\r\n" + body + b"\r\n\r\n"


class Corrupt(ValueError):
    pass


def parse(data: bytes) -> tuple[dict, dict, bytes]:
    """WARC headers, HTTP headers and payload of one record; Corrupt unless all agree."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0].encode() != VERSION:
        raise Corrupt("no WARC version line")
    fields = _fields(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise Corrupt(f"no {name}")
    if not fields["content-length"].isdigit():
        raise Corrupt("bad content-length")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise Corrupt(f"content-length {n}, block of {len(rest) - 4}")
    top, sep, payload = rest[:n].partition(b"\r\n\r\n")
    if not sep or not top.startswith(b"HTTP/"):
        raise Corrupt("no HTTP header")
    http = _fields(top.decode("utf-8").split("\r\n")[1:])
    if fields["warc-type"] == "response":
        if int(http.get("content-length", -1)) != len(payload):
            raise Corrupt("HTTP content-length differs from the payload")
        if fields.get("warc-payload-digest") != "sha256:" + hashlib.sha256(payload).hexdigest():
            raise Corrupt("payload digest differs")
    elif fields["warc-type"] == "revisit":
        if payload or not {"warc-refers-to", "warc-profile", "warc-payload-digest"} <= set(fields):
            raise Corrupt("not a revisit")
    else:
        raise Corrupt(f"type {fields['warc-type']}")
    return fields, http, payload


def _fields(lines: list[str]) -> dict:
    out = {}
    for line in lines:
        name, sep, value = line.partition(":")
        if not sep or not name or name != name.strip():
            raise Corrupt(f"bad header {line[:60]!r}")
        if name.lower() in out:
            raise Corrupt(f"repeated header {name}")
        out[name.lower()] = value.strip()
    return out


def frames(stream, chunk: int = 1 << 20):
    """The decoded frames of an archive, its dictionary loaded from the first frame.

    A raw or itself compressed dictionary is accepted, and an archive without one. Later
    skippable frames are passed over; a truncated frame is Corrupt.
    """
    data, known = b"", None

    def fill(n: int) -> bool:
        nonlocal data
        while len(data) < n:
            more = stream.read(max(chunk, n - len(data)))
            if not more:
                return False
            data += more
        return True

    first = True
    while fill(1):
        if not fill(4):
            raise Corrupt("truncated frame")
        if data[1:4] == b"\x2a\x4d\x18" and 0x50 <= data[0] <= 0x5F:
            if not fill(8) or not fill(8 + struct.unpack_from("<I", data, 4)[0]):
                raise Corrupt("truncated skippable frame")
            n = struct.unpack_from("<I", data, 4)[0]
            body, magic = data[8 : 8 + n], struct.unpack_from("<I", data)[0]
            data = data[8 + n :]
            if first and magic == DICT_MAGIC:
                if body[:4] == ZSTD_MAGIC:
                    body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
                known = zstandard.ZstdCompressionDict(body)
            first = False
            continue
        first = False
        if data[:4] != ZSTD_MAGIC:
            raise Corrupt("not a zstd frame")
        d = (zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()).decompressobj()
        out = []
        while True:
            try:
                out.append(d.decompress(data))
            except zstandard.ZstdError as e:
                raise Corrupt(str(e)) from e
            if d.eof:
                data = d.unused_data
                break
            data = b""
            if not fill(1):
                raise Corrupt("truncated frame")
        yield b"".join(out)


def _writer(folder: str, words: bytes, roll: int):
    def write(batches):
        from pyspark import TaskContext

        known = zstandard.ZstdCompressionDict(words) if words else None
        z = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=True) if known else zstandard.ZstdCompressor(level=3, write_checksum=True)
        lead = struct.pack("<II", DICT_MAGIC, len(words)) + words if words else b""
        part, out, made, done = TaskContext.get().partitionId(), None, None, []
        fs, top = filesystem(folder)
        fs.create_dir(top, recursive=True)
        for pdf in batches:
            ids, firsts = pdf["page_id"].astype("Int64"), pdf["first_id"].astype("Int64")
            for i, url, html, digest, size, revisit, first in zip(ids, pdf["url"], pdf["html"], pdf["digest"], pdf["size"], pdf["revisit"], firsts):
                if out is None:
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.warc.zst"
                    out, made = fs.open_output_stream(f"{top}/{name}"), [f"{folder}/{name}", 0, len(lead)]
                    out.write(lead)
                ident = None if pd.isna(i) else int(i)
                payload = None if revisit else (html or "").encode("utf-8")
                data = z.compress(record("revisit" if revisit else "response", ident, url, digest, payload, int(size), first))
                out.write(data)
                made[1], made[2] = made[1] + 1, made[2] + len(data)
                if made[2] >= roll:
                    out.close()
                    out, done = None, [*done, made]
        if out is not None:
            out.close()
            done.append(made)
        if done:
            yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return write


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 100, roll: int = ROLL) -> DataFrame:
    """Writes pages(page_id, url, html) as .warc.zst files; the manifest (path, records, bytes).

    Of rows with equal payloads (the html in UTF-8, null: empty) of at least `least` bytes
    the smallest page_id is a response, the others are revisits that refer to it; rows that
    repeat that page_id are responses too. Rows without page_id are responses, with an
    empty record id. Digests are grouped with map-side combination; what returns to the
    pages is one row a revisit, joined by page_id, so a payload that many pages share meets
    in no task. Names are unique to the attempt and only finished tasks' files are in the
    manifest, which is written once. A url's white space is normalised in its header. Without a
    folder the archives live in the shared folder, as long as the application does.
    """
    small_batches(pages.sparkSession)
    spark = pages.sparkSession
    folder = qualified(spark, folder or shared_path(spark, "warc"))
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    slim = materialize(rows.where(f"size >= {least} and page_id is not null").select("page_id", "digest"), "digests")
    firsts = slim.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("m")).where("first_id < m").drop("m")
    again = materialize(slim.join(firsts, "digest").where("page_id <> first_id").distinct(), "revisits")
    again = again.withColumn("revisit", F.lit(True))
    full = rows.join(again, ["page_id", "digest"], "left").withColumn("revisit", F.coalesce("revisit", F.lit(False)))
    full = full.select("page_id", "url", F.when(~F.col("revisit"), F.col("html")).alias("html"), "digest", "size", "revisit", "first_id")
    return materialize(full.mapInPandas(lean(_writer(folder, train_dictionary(pages), roll)), "path string, records long, bytes long"), "archives")


def _page(urn: str) -> int | None:
    body = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(body) if body else None


def _reader():
    def read(batches):
        for pdf in batches:
            for path, records in zip(pdf["path"], pdf["records"]):
                fs, at = filesystem(path)
                seen, rows = 0, []
                with fs.open_input_stream(at) as stream:
                    for data in frames(stream):
                        seen += 1
                        f, http, payload = parse(data)
                        revisit = f["warc-type"] == "revisit"
                        size = int(http["content-length"]) if revisit else len(payload)
                        rows.append((_page(f["warc-record-id"]), f.get("warc-target-uri"), size, f["warc-payload-digest"].removeprefix("sha256:"), f["warc-type"], _page(f["warc-refers-to"]) if revisit else None, None if revisit else payload.decode("utf-8")))
                        if len(rows) >= 500:
                            yield _frame(rows)
                            rows = []
                if seen != records:
                    raise Corrupt(f"{path}: {seen} records, the manifest has {records}")
                if rows:
                    yield _frame(rows)

    return read


_COLUMNS = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]


def _frame(rows):
    out = pd.DataFrame(rows, columns=_COLUMNS)
    return out.assign(page_id=out["page_id"].astype("Int64"), refers_to=out["refers_to"].astype("Int64"))


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of a manifest's archives (path, records): ids, digests, types, payloads.

    Every frame must hold one whole valid record and every archive as many as the manifest
    says, else the job fails with Corrupt. A revisit's payload is null; its length and digest come from
    its headers. Archives are streamed, a record at a time.
    """
    n = max(1, min(manifest.count(), partitions(manifest.sparkSession)))
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
    return manifest.select("path", "records").repartition(n).mapInPandas(lean(_reader()), schema)
