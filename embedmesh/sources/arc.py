"""Crawl archives (ARC, version 1) as a Spark data source: ``spark.read.format("arc").load(path)``.

Each record is a gzip member of its own: a line ``url ip yyyyMMddHHmmss content-type length`` and the payload. The first
record of a file describes the file and is left out. One file is one partition, as members can't be found from the middle of
a file. A record with a malformed header is kept with null fields and its header in ``problem``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from glob import glob

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, ip string, archive_ts timestamp, content_type string, content_length int, payload binary, problem string, file string"


def members(raw) -> Iterator[bytes]:
    """The gzip members of a binary file object, unpacked one at a time; checksums and sizes are verified."""
    rest = b""
    while True:
        rest = rest or raw.read(1 << 20)
        if not rest:
            return
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            out.append(unpack.decompress(rest))
            rest = unpack.unused_data if unpack.eof else raw.read(1 << 20)
            if not rest and not unpack.eof:
                break
        yield b"".join(out)
        # padding between members is not a member
        while rest and not rest.startswith(b"\x1f\x8b"):
            at = rest.find(b"\x1f\x8b", 1)
            rest = rest[at:] if at > 0 else raw.read(1 << 20)


def record(member: bytes, file: str = "") -> tuple:
    head, _, body = member.lstrip(b"\r\n").partition(b"\n")
    line = head.decode("utf-8", "replace").strip()
    fields = line.split(" ")
    try:
        if len(fields) != 5:
            raise ValueError(line)
        url, ip, date, kind, length = fields
        when, size = datetime.strptime(date, "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc), int(length)
    except ValueError:
        return (None, None, None, None, None, None, line, file)
    return (url, ip, when, kind, size, body[: max(0, size)], None if len(body) >= size else "short", file)


class ArcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArcReader(self.options)


class ArcReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def _opened(self) -> tuple[fs.FileSystem, str]:
        path = self.options["path"]
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def partitions(self) -> list[InputPartition]:
        """The files of a folder, one file, or (on a local disk) those of a pattern."""
        where, base = self._opened()
        found = where.get_file_info(base)
        if found.type == fs.FileType.Directory:
            files = sorted(f.path for f in where.get_file_info(fs.FileSelector(base)) if f.is_file)
        else:
            files = [base] if found.is_file else sorted(glob(base))
        return [InputPartition(f) for f in files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        where, _ = self._opened()
        with where.open_input_stream(partition.value, compression=None) as raw:
            for number, member in enumerate(members(raw)):
                if number:
                    yield record(member, partition.value)


def register(spark) -> None:
    spark.dataSource.register(ArcDataSource)


_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9._:-]+)", re.I)


def http_response(url: str | None, payload: bytes | None) -> tuple[int | None, str | None, str | None]:
    """(status, headers, body) of an http(s) record, the body decoded by the charset of its Content-Type and by Latin-1 where
    that fails; nulls for other protocols and payloads without an end of headers."""
    if payload is None or not (url or "").lower().startswith(("http://", "https://")):
        return None, None, None
    head, gap, body = bytes(payload).partition(b"\r\n\r\n")
    if not gap:
        return None, None, None
    status = re.match(rb"HTTP/\S+\s+(\d{3})", head)
    kind = re.search(rb"^content-type\s*:(.*)$", head, re.I | re.M)
    charset = _CHARSET.search(kind[1]) if kind else None
    try:
        text = body.decode(charset[1].decode() if charset else "latin-1")
    except (LookupError, UnicodeDecodeError):
        text = body.decode("latin-1")
    return int(status[1]) if status else None, head.partition(b"\r\n")[2].decode("latin-1"), text


def response_column(url: Column, payload: Column) -> Column:
    @F.pandas_udf("status int, headers string, body string")
    def found(urls: pd.Series, payloads: pd.Series) -> pd.DataFrame:
        rows = [http_response(u, p) for u, p in zip(urls, payloads, strict=True)]
        out = pd.DataFrame(rows, columns=["status", "headers", "body"]).astype(object)
        out["status"] = out["status"].astype("Int32")
        return out

    return found(url, payload)


def html_pages(records: DataFrame, content_type: str = "text/html") -> tuple[DataFrame, DataFrame]:
    """((url, archive_ms, html) of the records of exactly that content type, (kind, count) of what was left out)."""
    judged = records.withColumn("response", F.when(F.col("content_type") == content_type, response_column(F.col("url"), F.col("payload"))))
    kind = F.when(F.col("url").isNull(), "HEADER").when(F.col("content_type") != content_type, "OTHER_TYPE").when(F.col("response.body").isNull(), "NO_RESPONSE")
    judged = judged.withColumn("kind", kind)
    pages = judged.where("kind is null").select("url", F.unix_millis("archive_ts").alias("archive_ms"), F.col("response.body").alias("html"))
    return pages, judged.where("kind is not null").groupBy("kind").count()
