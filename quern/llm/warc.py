"""WARC records in ZIP-packaged archives: written in parallel, read back by ranges.

An archive is a ZIP file with stored members: ``archive/data.warc.gz`` (one
gzip member a record) and ``indexes/index.cdxj`` (a line a record, with its
place).  The reader parses the end-of-central-directory record, its ZIP64
counterpart if there is one, and the central directory; it finds the stored
members' bytes and reads the index and the records by ranges, without
extracting anything.

Files go to a folder that all executors share; each attempt of a task writes a
file of its own, and only files that a finished task reported are read, so that
lost executors leave nothing behind but files nobody reads.

Defined results: a null payload is an empty one; a very long one is a record
like any other; an empty table gives no archives and no rows; extra columns
aren't read.  Of records with equal
payloads of ``least`` bytes or more those with the largest page_id are
responses and the others revisit it; rows without a page_id revisit it too, and
are responses where no equal row has one.  Rows that repeat are records each.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MemberFilter, file, heavy_keys, lookup, shared_dir, stage

LEAST = 1000
#: An archive is closed and the next one begun beyond so many bytes; ranges up to so many bytes are read at once.
ARCHIVE_BYTES, READ_BYTES = 256 << 20, 8 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_DATE = "2024-01-01T00:00:00Z"  # records hold no time of capture; a fixed one keeps reruns equal
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(x: str) -> str:
    return x.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP headers and leaves the payload out."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_line(url or '')}", f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {name(refers_to)}"] if refers_to is not None else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode("utf-8", "replace").split("\r\n")[1:]) if k}


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A record's WARC headers, HTTP headers and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _headers(head)
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, _headers(http), payload


class ArchiveWriter:
    """Records into one ZIP file, as a stream."""

    def __init__(self, out: BinaryIO) -> None:
        self.out, self.lines, self.at = out, [], 0
        self.zip = zipfile.ZipFile(_Forward(out), "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=True)

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        packed = gzip.compress(record(page_id, url, payload, refers_to), 1, mtime=0)
        self.data.write(packed)
        self.lines.append(f"{'' if page_id is None else page_id} {json.dumps({'offset': self.at, 'length': len(packed)})}")
        self.at += len(packed)

    def close(self) -> None:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX, (2024, 1, 1, 0, 0, 0)), "\n".join(self.lines))
        self.zip.close()
        self.out.close()


class _Forward(io.RawIOBase):
    """A write-only stream: ZIP members then carry their sizes behind them and in the directory."""

    def __init__(self, out: BinaryIO) -> None:
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(data)
        return len(data)

    def seekable(self) -> bool:
        return False


class ArchiveReader:
    """Finds the stored members of a ZIP file by its directories, and reads ranges of them."""

    def __init__(self, f: BinaryIO, size: int) -> None:
        self.f = f
        tail_at = max(0, size - (1 << 16) - 22)
        tail = self._at(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of a central directory: not a ZIP file")
        count, length, at = struct.unpack("<HII", tail[end + 10 : end + 20])
        if count == 0xFFFF or 0xFFFFFFFF in (length, at):  # the true numbers are in the ZIP64 record
            where = tail_at + end - 20
            mark, _, record_at, _ = struct.unpack("<4sIQI", self._at(where, 20))
            if mark != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            mark, count, length, at = struct.unpack("<4s28xQQQ", self._at(record_at, 56))
            if mark != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of a central directory")
        self.members: dict[str, tuple[int, int]] = {}
        entries, k = self._at(at, length), 0
        for _ in range(count):
            mark, method = entries[k : k + 4], struct.unpack("<H", entries[k + 10 : k + 12])[0]
            if mark != b"PK\x01\x02":
                raise ValueError("a broken central directory")
            packed, plain, names, extras, comments = struct.unpack("<IIHHH", entries[k + 20 : k + 34])
            header = struct.unpack("<I", entries[k + 42 : k + 46])[0]
            name = entries[k + 46 : k + 46 + names].decode("utf-8", "replace")
            extra, j = entries[k + 46 + names : k + 46 + names + extras], 0
            while j + 4 <= len(extra):
                tag, n = struct.unpack("<HH", extra[j : j + 4])
                if tag == 1:  # ZIP64: those of the three numbers that didn't fit, in this order
                    wide = iter(struct.unpack(f"<{n // 8}Q", extra[j + 4 : j + 4 + n // 8 * 8]))
                    plain = next(wide) if plain == 0xFFFFFFFF else plain
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    header = next(wide) if header == 0xFFFFFFFF else header
                j += 4 + n
            if method == 0:
                local = self._at(header, 30)
                self.members[name] = (header + 30 + sum(struct.unpack("<HH", local[26:30])), packed)
            k += 46 + names + extras + comments

    def _at(self, where: int, length: int) -> bytes:
        self.f.seek(where)
        return self.f.read(length)

    def range(self, member: str, offset: int = 0, length: int | None = None) -> bytes:
        at, size = self.members[member]
        return self._at(at + offset, min(size - offset, size if length is None else length))

    def entries(self) -> Iterator[tuple[int, int]]:
        """(place in the file, length) of each record, from the index."""
        at, _ = self.members[DATA]
        for line in self.range(INDEX).decode().split("\n"):
            if line:
                spot = json.loads(line.partition(" ")[2])
                yield at + spot["offset"], spot["length"]


def roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, digest and refers_to of the records that revisit another."""
    seen = pages.select("page_id", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n")).where(F.col("n") >= least)
    seen = stage(seen.select("page_id", "digest"), "warc-digests")
    first = stage(seen.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null"), "warc-firsts")
    met = lookup(seen, "digest", first.drop("n"), heavy_keys(first.select("digest", "n"), seen.count()))
    return met.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()


def write(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Archives of all pages under ``folder``; one row (path, bytes, records) per archive, already written.

    Only pages that may revisit another are shuffled; the rest are written where they are read.
    """
    revisits = stage(roles(pages, least).select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to"), "warc-revisits")
    body = MemberFilter(revisits, "r_id").split(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")), "page_id")
    same = F.col("page_id").eqNullSafe(F.col("r_id")) & (F.sha1("html") == F.col("r_digest")) & (F.octet_length("html") >= least)
    close = body.where("__q_may").join(revisits.hint("merge"), same, "left").select("page_id", "url", "html", "refers_to")
    rows = close.union(body.where("not __q_may").select("page_id", "url", "html", F.lit(None).cast(dict(pages.dtypes)["page_id"])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, archive, path, n = [], None, "", 0
        whole = lambda x: None if pd.isna(x) else int(x)
        for batch in batches:
            for page_id, url, html, refers_to in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"], strict=True):
                if archive is None:
                    path, n = f"{folder}/{uuid.uuid4().hex}.zip", 0
                    archive = ArchiveWriter(file(path, True))
                archive.add(whole(page_id), url, html.encode(), whole(refers_to))
                n += 1
                if archive.at >= ARCHIVE_BYTES:
                    done.append((path, archive.at, n))
                    archive.close()
                    archive = None
        if archive is not None:
            done.append((path, archive.at, n))
            archive.close()
        yield pd.DataFrame(done, columns=["path", "bytes", "records"])

    return stage(rows.mapInPandas(run, "path string, bytes long, records long"), "warc-archives")


def read(archives: DataFrame) -> DataFrame:
    """page_id, url, payload (null for a revisit), payload_bytes, payload_digest, record_type and refers_to of every record in the archives (columns path and bytes)."""

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with file(path, False) as f:
                    rows = list(ArchiveReader(f, f.size()).entries())
                out = pd.DataFrame(rows, columns=["at", "n"])
                out["path"], out["part"] = path, out["at"] // READ_BYTES
                yield out[["path", "part", "at", "n"]].groupby(["path", "part"], as_index=False).agg(at=("at", list), n=("n", list))

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, at, n in zip(batch["path"], batch["at"], batch["n"], strict=True):
                out = []
                with file(path, False) as f:
                    f.seek(int(at[0]))
                    piece = f.read(int(at[-1] + n[-1] - at[0]))  # the records of a part lie side by side
                for a, b in zip(at, n, strict=True):
                    raw = piece[int(a - at[0]) : int(a - at[0] + b)]
                    warc, http, payload = parse(zlib.decompress(raw, 31))
                    digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
                    kind, size = warc["warc-type"], int(http["content-length"])
                    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"a damaged record in {path} at {a}")
                    own = lambda x: int(x) if (x := warc.get(x, "").removeprefix("<urn:page:").rstrip(">")) else None  # noqa: E731, B023
                    out.append((own("warc-record-id"), warc["warc-target-uri"], payload if kind == "response" else None, size, digest, kind, own("warc-refers-to")))
                part = pd.DataFrame(out, columns=["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield part.astype({"page_id": "Int64", "refers_to": "Int64"})

    parts = archives.select("path").mapInPandas(index, "path string, part long, at array<long>, n array<long>")
    # as many tasks as there are parts: the rows of the index are tiny, and would be put together for their size
    tasks = archives.agg(F.sum(F.ceil(F.col("bytes") / READ_BYTES))).first()[0] or 1
    return parts.repartition(max(1, int(tasks)), "path", "part").mapInPandas(records, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back, without the payloads."""
    archives = write(pages, shared_dir(pages.sparkSession, "warc"), least)
    return read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
