"""WARC archives: a writer for pages and a splittable reader.

Writer. Each task writes archive files of its own into a shared folder, one gzip member per
record. A retried task writes new files; only the files named in the stored manifest count. Of
records with equal payloads the one with the smallest page_id is a response and the others
revisit it; equality is by SHA-256 and length.

Reader. Archives are cut into byte ranges without regard to records. A task looks for the gzip
magic in its range, takes a candidate for a member only if its first bytes inflate to a WARC
header, and owns the records that start inside its range; the last of them may end in a later one.

Defined results: a null html is an empty payload; pages that share the smallest page_id of
their payload are all responses; null ids come last; a null url is left out of the record; an
empty table gives no archive and an empty result. A record whose payload does not
match its digest is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm.common import in_small_batches, materialize

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 4 << 20
FILE_BYTES = 512 << 20
READ_BYTES = 1 << 20
MANIFEST = "path string, bytes long, records long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    tail = (name or "").rpartition(":")[2].rstrip(">")
    return int(tail) if tail not in ("", "none") else None


def record(page_id: int | None, url: str | None, payload: bytes, revisits: bool, refers_to: int | None, date: str) -> bytes:
    """One record, not yet compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisits else http + payload
    fields = [("WARC-Type", "revisit" if revisits else "response"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{_digest(payload)}"))
    if revisits:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    return b"WARC/1.1\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def parse(data: bytes, with_payload: bool) -> tuple:
    """The fields of ``RECORD`` of an inflated record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or _digest(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    url = fields.get("WARC-Target-URI")
    if url is not None:
        url = re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url)
    refers_to = _page(fields.get("WARC-Refers-To"))
    body = payload if with_payload and kind == "response" else None
    return _page(fields["WARC-Record-ID"]), url, kind, length, digest, refers_to, body


def _writer(folder: str, date: str):
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        out, path, size, count, done = None, "", 0, 0, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "revisits", "refers_to"))):
                if out is None:
                    path = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, size, count = files.open_output_stream(f"{root}/{path}", compression=None), 0, 0
                data = member(record(*row, date))
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((f"{folder}/{path}", size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{path}", size, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "bytes", "records"])

    return run


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per page (page_id, url, html) into ``folder``; returns the stored manifest: path, bytes, records.

    Payloads under ``min_bytes`` are responses always. ``folder`` must be reachable by all executors.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    keyed = in_small_batches(pages).select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("same"), F.octet_length(payload).alias("n"))
    # only payloads that occur more than once are joined; Spark broadcasts them if they are few, and splits a hot one if not
    repeated = (
        keyed.where(F.col("n") >= min_bytes).groupBy("same", "n").agg(F.count(F.lit(1)).alias("copies"), F.min("page_id").alias("refers_to"))
        .where("copies > 1").select("same", "n", "refers_to", F.lit(True).alias("repeated"))
    )
    revisits = F.coalesce("repeated", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    ready = keyed.join(repeated, ["same", "n"], "left").select(
        F.col("page_id").cast("long"), "url", "payload", revisits.alias("revisits"), F.when(revisits, F.col("refers_to")).cast("long").alias("refers_to")
    )
    return materialize(ready.mapInArrow(_writer(folder, date), MANIFEST), "warc-manifest")


def members(file, start: int, end: int) -> Iterator[bytes]:
    """The inflated gzip members of a seekable ``file`` that start in [start, end) and hold WARC records."""
    file.seek(start)
    data, base, over = b"", start, False  # data: what is read from base on

    def more() -> None:
        nonlocal data, over
        got = file.read(READ_BYTES)
        data, over = data + got, not got

    at = start
    while at < end:
        found = data.find(MAGIC, at - base)
        if found < 0:
            # keep what may be the first bytes of the magic
            at = max(at, base + len(data) - len(MAGIC) + 1)
            data, base = data[at - base :], at
            if over:
                return
            more()
            continue
        at = base + found
        if at >= end:
            return
        data, base = data[found:], at
        while len(data) < 4096 and not over:
            more()
        try:
            valid = zlib.decompressobj(31).decompress(data[:4096], 7) == b"WARC/1."
        except zlib.error:
            valid = False
        if not valid:
            at += 1
            continue
        inflate, parts, used = zlib.decompressobj(31), [], 0
        while True:
            parts.append(inflate.decompress(data[used:]))
            used = len(data) - len(inflate.unused_data)
            if inflate.eof:
                break
            if over:
                raise ValueError(f"the member at byte {at} is cut off")
            # what is inflated is not needed again
            data, base, used = b"", base + len(data), 0
            more()
        yield b"".join(parts)
        at = base + used
        data, base = data[used:], at


def _reader(with_payload: bool):
    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]

        def packed(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
                files, inner = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with files.open_input_file(inner) as file:
                    for data in members(file, start, end):
                        rows.append(parse(data, with_payload))
                        held += len(data) if with_payload else 100
                        if held >= 4 << 20:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    return run


def read_warc(spark: SparkSession, manifest: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of the archives in ``manifest`` (path, bytes), one row each; ``payload`` is null for revisits."""
    total = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long")))
    ranges = manifest.where("bytes > 0").select("path", "bytes", start.alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + range_bytes, "bytes").alias("end"))
    return ranges.repartition(max(1, -(-total // range_bytes)), "path", "start").mapInArrow(_reader(with_payload), RECORD)
