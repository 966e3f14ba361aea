"""WARC records in ZIP-packaged archives, written and read in Spark tasks.

An archive is written as a ZIP of two stored members: records, each compressed on its own,
and an index of their places; archives with more members or other indexes are read as well. The reader takes the directory and the index by
ranges, deals the records out in slices and reads each slice as one range;
nothing is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zipfile
import zlib
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.llm.common import on_workers, scratch_path, write_once
from tidegauge.llm.files import Ranges, located
from tidegauge.llm.zips import data_start, members

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.tsv"
ARCHIVE_BYTES = 64 << 20
SLICE_BYTES = 2 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """SHA-1 in base32, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str | None, url: str | None, payload: bytes, refers: str | None, revisit: bool, date: str) -> bytes:
    """One response or revisit record; a revisit has the HTTP header only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url}')}>", f"WARC-Date: {date}",
             f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
             f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"WARC-Block-Digest: sha1:{payload_digest(block)}"]
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"X-Refers-To-Page-ID: {refers}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, names in lower case, and the block; the digest of the block is verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[:int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or fields["warc-block-digest"] != f"sha1:{payload_digest(block)}":
        raise ValueError("damaged record")
    return fields, block


class ArchiveWriter:
    """Appends records to a stored member; the index follows when it is closed."""

    def __init__(self, uri: str):
        system, path = located(uri)
        system.create_dir(path.rsplit("/", 1)[0])
        self._out = system.open_output_stream(path)
        self._zip = zipfile.ZipFile(self._out, "w", zipfile.ZIP_STORED)
        self._member = self._zip.open(RECORDS, "w", force_zip64=True)
        self._index, self.bytes, self.records = io.StringIO(), 0, 0

    def add(self, raw: bytes) -> None:
        packed = gzip.compress(raw, 1, mtime=0)
        self._member.write(packed)
        self._index.write(f"{self.bytes}\t{len(packed)}\n")
        self.bytes, self.records = self.bytes + len(packed), self.records + 1

    def close(self) -> None:
        self._member.close()
        self._zip.writestr(INDEX, self._index.getvalue())
        self._zip.close()
        self._out.close()


def first_pages(pages: DataFrame, min_bytes: int = 0, key: str = "page_id", html: str = "html") -> DataFrame:
    """Payloads of at least ``min_bytes`` that occur more than once: ``sha`` and the smallest key, ``first``."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    return (pages.where(F.octet_length(body) >= min_bytes).groupBy(F.sha1(body).alias("sha"))
            .agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, key: str = "page_id", url: str = "url",
                   html: str = "html", date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row into archives in ``folder`` and return their list: ``path``, ``records``.

    Rows with equal payloads refer to the smallest key, which is the response; rows that
    repeat that key are responses too, and so is a group without any key. The list is itself a
    written table: only archives of tasks that finished are in it, so a lost or
    repeated task leaves at most a file that nobody reads. Payloads that occur
    once need no join partner; the rest is a left join that the planner can broadcast or split.
    """
    spark = on_workers(pages.sparkSession)
    groups = write_once(first_pages(pages, min_bytes, key, html), "payloads")
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).cast("string").alias("page"), F.col(url).cast("string").alias("url"), body.alias("html"),
                        F.sha1(body.cast("binary")).alias("digest"))
    joined = rows.join(groups, rows.digest == groups.sha, "left").select(
        "page", "url", "html", F.col("first").cast("string").alias("first"))

    def write(batches):
        out, done = None, []
        for b in batches:
            for page, link, text, first in zip(b["page"], b["url"], b["html"], b["first"]):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.wacz"
                    out = ArchiveWriter(path)
                revisit = first is not None and first != page
                out.add(record(page, link, text.encode("utf-8", "surrogatepass"), first, revisit, date))
                if out.bytes >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, out.records))
                    out = None
        if out is not None:
            out.close()
            done.append((path, out.records))
        yield pd.DataFrame(done, columns=["path", "records"])

    listing = scratch_path(spark, "archives")
    schema = "path string, records long"
    joined.mapInPandas(write, schema).write.parquet(listing)
    return spark.read.schema(schema).parquet(listing)


def _places(lines: list[str]) -> list[tuple[str | None, int, int]]:
    """Member name (null if the line has none), offset and length of each index line: tabs, or JSON after two fields."""
    out = []
    for line in lines:
        if line.endswith("}"):
            fields = json.loads(line[line.index("{"):])
            out.append((fields["filename"], int(fields["offset"]), int(fields["length"])))
        elif line.strip() and not line.startswith("!"):
            offset, length, *name = line.split("\t")
            out.append((name[0] if name else None, int(offset), int(length)))
    return out


def _walked(file, start: int, size: int, step: int = 1 << 20) -> list[tuple[int, int]]:
    """Offset and length of each record of a member without an index; records are compressed one by one."""
    out, first, at, rest = [], 0, 0, b""
    while at < size or rest:
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            if not rest:
                if at >= size:
                    raise ValueError("archive member ends within a record")
                rest = file.read(start + at, min(step, size - at))
                at += len(rest)
            while rest and not unpack.eof:
                unpack.decompress(rest, step)
                rest = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
        out.append((first, at - len(rest) - first))
        first = at - len(rest)
    return out


def located_records(file) -> list[tuple[int, int]]:
    """Place in the file and length of every record, in order, each once.

    All stored members ``archive/*.warc.gz`` count. Members in ``indexes/`` tell their records, by tabs
    or as JSON lines; a line without a name belongs to the only archive member. A
    member that no index knows is walked.
    """
    found = members(file)
    archives = {m.name.removeprefix("archive/"): m for m in found if m.name.startswith("archive/") and m.name.endswith(".warc.gz")}
    starts = {name: data_start(file, m) for name, m in archives.items()}
    records: dict[str, set[tuple[int, int]]] = {name: set() for name in archives}
    for m in found:
        if not (m.name.startswith("indexes/") and m.name.endswith((".tsv", ".cdx", ".cdxj"))):
            continue
        for name, offset, length in _places(file.read(data_start(file, m), m.size).decode().splitlines()):
            if name is None and len(archives) != 1:
                raise ValueError(f"{m.name} does not name the member of a record")
            name = next(iter(archives)) if name is None else name.removeprefix("archive/")
            if name not in archives or offset + length > archives[name].size:
                raise ValueError(f"{m.name} points outside the members: {name}, {offset}")
            records[name].add((offset, length))
    return sorted((starts[name] + offset, length) for name, known in records.items()
                  for offset, length in (known or _walked(file, starts[name], archives[name].size)))


def slices_of(file, size: int = SLICE_BYTES) -> list[tuple[int, list[int]]]:
    """Runs of neighbouring records: where a run starts in the file and the length of each record."""
    out, lengths, first, filled = [], [], 0, 0
    for start, length in located_records(file):
        if lengths and (filled + length > size or start != first + filled):
            out.append((first, lengths))
            lengths, filled = [], 0
        if not lengths:
            first = start
        lengths.append(length)
        filled += length
    return out + [(first, lengths)] * bool(lengths)


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of the listed archives (column ``path``).

    Columns: ``page_id`` (text), ``url``, ``record_type``, ``refers_to`` (text),
    ``payload_digest``, ``payload_bytes`` of the full payload, and ``payload``
    (null for revisits). Tasks first read directories and indexes, then slices of records dealt out evenly.
    """
    on_workers(archives.sparkSession)

    def plan(batches):
        for b in batches:
            for path in b["path"]:
                with Ranges(path) as file:
                    runs = slices_of(file)
                yield pd.DataFrame({"path": [path] * len(runs), "start": [s for s, _ in runs], "lengths": [n for _, n in runs]})

    def fetch(batches):
        for b in batches:
            for path, start, lengths in zip(b["path"], b["start"], b["lengths"]):
                with Ranges(path) as file:
                    raw = memoryview(file.read(int(start), int(sum(lengths))))
                rows, at = [], 0
                for n in lengths:
                    fields, block = parse_record(zlib.decompress(raw[at:at + n], 31))
                    at += n
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)[1])
                    response, digest = fields["warc-type"] == "response", fields["warc-payload-digest"].removeprefix("sha1:")
                    if response and (len(payload) != size or payload_digest(payload) != digest):
                        raise ValueError("damaged payload")
                    rows.append((fields.get("x-page-id"), fields["warc-target-uri"], fields["warc-type"],
                                 fields.get("x-refers-to-page-id"), digest, size, payload if response else None))
                yield pd.DataFrame(rows, columns=names)

    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    runs = archives.select("path").repartition(_tasks(archives.sparkSession)).mapInPandas(
        plan, "path string, start long, lengths array<long>")
    return runs.repartition(_tasks(archives.sparkSession)).mapInPandas(
        fetch, "page_id string, url string, record_type string, refers_to string, payload_digest string, "
               "payload_bytes long, payload binary")


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def archived(pages: DataFrame, min_bytes: int = 0, key: str = "page_id") -> DataFrame:
    """Write all rows to archives in the shared folder and read the records back.

    Null payloads are empty; null keys and urls are left out of their record;
    repeated rows each get a record; extra columns are not stored; an empty
    table gives no archive and no record.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    kind = pages.schema[key].dataType
    return read_archives(write_archives(pages, folder, min_bytes, key)).withColumns(
        {"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
