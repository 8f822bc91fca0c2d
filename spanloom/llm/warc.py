"""WARC archives of pages: monolithic gzip files, their normal form, and a sidecar offset index.

``write_archives`` deals pages out to tasks, each of which writes one archive as a single
gzip stream. ``normalise`` inflates such a stream once, in chunks, and rewrites every record
as a gzip member of its own, with a sidecar file of record offsets beside the archive; it
takes any gzip file of WARC records, of one member or many. ``read_records`` then reads
single records at their offsets.

Records with equal payloads (by SHA-1) are one response, of the smallest page_id, and
revisits that refer to it. Files are named by task attempt and listed in a table in the
shared folder, so a repeated or lost attempt leaves no record twice.

Cases: a null html is the empty payload, equal to other empty ones. Payloads below
``least_bytes`` are all responses. Rows without a page_id take no part. Rows that repeat a
page_id are records of their own; those equal to the response of their id are responses too.
A null url becomes the page's record id; white space and control characters in a url are
percent-encoded. Other columns are not read. An empty table gives no record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import keep, shared_folder

GZIP, ANY_GZIP, CHUNK = 31, 47, 1 << 18
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
INDEX = "file string, offset long, length long, record_id string, type string, uri string, digest string"


def record_id(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def page_of(record: str) -> int:
    return int(record[len("<urn:page:") : -1])


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record, with its headers and the two line ends after it."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else record_id(page_id)[1:-1]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{a}: {b}\r\n" for a, b in fields).encode() + b"\r\n" + block + END


def headers(head: bytes) -> dict[str, str]:
    """Fields of a header block by lower-case name; folded lines are joined."""
    found, last = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            found[last] = value.strip()
    return found


def decided(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, sha1 (hex) and refers_to (as a string, so that pandas keeps every digit; null: a response) of each page."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    small = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("sha1"), F.length(payload).alias("bytes"))
    first = small.where(F.col("bytes") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = small.join(first.where("n > 1"), "sha1").where("page_id != first").select("page_id", "sha1", F.col("first").alias("refers_to")).distinct()
    return rows.join(again, ["page_id", "sha1"], "left").select("page_id", "url", "payload", "sha1", F.col("refers_to").cast("string"))


def write_archives(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Writes each partition of ``decided`` as one gzip stream; file and records of each."""

    def run(batches):
        store, at = fs.FileSystem.from_uri(folder)
        name, out, n = f"{uuid.uuid4().hex}.warc.gz", None, 0
        squeeze = zlib.compressobj(level, zlib.DEFLATED, GZIP)
        for batch in batches:
            for page_id, url, payload, sha1, refers in zip(*(batch[c] for c in ("page_id", "url", "payload", "sha1", "refers_to"))):
                if out is None:
                    store.create_dir(at, recursive=True)
                    out = store.open_output_stream(f"{at}/{name}", compression=None)
                out.write(squeeze.compress(record(page_id, url, bytes(payload), base32(sha1), None if refers is None else int(refers), date)))
                n += 1
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            yield pd.DataFrame({"file": [f"{folder}/{name}"], "records": [n]})

    return keep(rows.mapInPandas(run, "file string, records long"), "archives")


def inflated(stream):
    """The content of a gzip file, whatever its members, in chunks of bounded size."""
    engine = zlib.decompressobj(ANY_GZIP)
    while data := stream.read(CHUNK):
        while data:
            yield engine.decompress(data, CHUNK)
            if engine.eof:
                data, engine = engine.unused_data.lstrip(b"\0"), zlib.decompressobj(ANY_GZIP)
            else:
                data = engine.unconsumed_tail
    if tail := engine.flush():
        yield tail


def records(chunks):
    """The records of a stream: for each its header block and an iterator over its content, to be used up before the next."""
    held, at, chunks = b"", 0, iter(chunks)

    def more() -> bool:
        nonlocal held, at
        new = next(chunks, None)
        if new is not None:
            held, at = held[at:] + new, 0
        return new is not None

    while True:
        while True:  # line ends between records
            while held[at : at + 1] in (b"\r", b"\n"):
                at += 1
            if at < len(held) or not more():
                break
        if at == len(held):
            return
        while (end := held.find(END, at)) < 0:
            if not more():
                raise ValueError("a record header has no end")
        head, at = held[at:end], end + len(END)
        left = int(headers(head).get("content-length", 0))

        def content():
            nonlocal at, left
            while left:
                if at == len(held) and not more():
                    raise ValueError("a record is cut off")
                part = held[at : at + left]
                at, left = at + len(part), left - len(part)
                if part:
                    yield part

        yield head, content()


def rewrite(source, target, level: int = 6):
    """Copies a stream of records, each as its own gzip member; offset, length and header fields of each."""
    offset = 0
    for head, content in records(inflated(source)):
        squeeze, length = zlib.compressobj(level, zlib.DEFLATED, GZIP), 0
        for part in _around(head, content):
            data = squeeze.compress(part)
            length += len(data)
            target.write(data)
        data = squeeze.flush()
        target.write(data)
        length += len(data)
        yield offset, length, headers(head)
        offset += length


def _around(head: bytes, content):
    yield head + END
    yield from content
    yield END


def normalise(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """One pass over each archive of ``archives`` (file); returns the offset index, whose rows also stand in a sidecar file beside each new archive."""

    def run(batches):
        store, at = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch["file"]:
                source_store, source = fs.FileSystem.from_uri(path)
                name = f"{uuid.uuid4().hex}.warc.gz"
                store.create_dir(at, recursive=True)
                rows = []
                with source_store.open_input_stream(source, compression=None) as read, store.open_output_stream(f"{at}/{name}", compression=None) as write, store.open_output_stream(f"{at}/{name}.idx", compression=None) as side:
                    for offset, length, fields in rewrite(read, write, level):
                        row = {"offset": offset, "length": length, "record_id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None}
                        side.write((json.dumps(row) + "\n").encode())
                        rows.append({"file": f"{folder}/{name}", **row})
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows)
                            rows = []
                if rows:
                    yield pd.DataFrame(rows)

    spread = archives.select("file").repartition(max(1, archives.count()))  # a task for each archive
    return keep(spread.mapInPandas(run, INDEX), "index")


def read_records(index: DataFrame) -> DataFrame:
    """The records that ``index`` names, each read at its offset: its headers, and its payload where it holds one."""

    def run(batches):
        path, opened = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(batch["file"], batch["offset"], batch["length"]):
                if file != path:
                    store, at = fs.FileSystem.from_uri(file)
                    path, opened = file, store.open_input_file(at)
                data = zlib.decompress(opened.read_at(length, offset), GZIP)
                head, block = data[: -len(END)].split(END, 1)
                fields = headers(head)
                http, _, payload = block.partition(END)
                revisit = fields["warc-type"] == "revisit"
                rows.append({
                    "record_id": fields["warc-record-id"],
                    "type": fields["warc-type"],
                    "uri": fields.get("warc-target-uri"),
                    "refers_to": fields.get("warc-refers-to"),
                    "digest": fields["warc-payload-digest"].removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    "payload_bytes": int(headers(http)["content-length"]) if revisit else len(payload),
                    "payload": None if revisit else payload,
                })
            if rows:
                yield pd.DataFrame(rows)

    schema = "record_id string, type string, uri string, refers_to string, digest string, payload_bytes long, payload binary"
    rows = index.select("file", "offset", "length")
    tasks = max(1, index.select("file").distinct().count())  # each reads a stretch of an archive or of some
    ordered = rows.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInPandas(run, schema)


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as normalised archives and returns their offset index."""
    spark = pages.sparkSession
    raw = write_archives(decided(pages, least_bytes), shared_folder(spark, "warc-raw"))
    return normalise(raw, shared_folder(spark, "warc"))


def page_rows(read: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of records read back."""
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).cast("long")
    refers = F.when(F.col("type") == "revisit", page("refers_to"))
    return read.select(page("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), refers.alias("refers_to"))
