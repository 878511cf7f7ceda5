"""Token-id files: every document compressed apart, with one zstandard dictionary for all.

The dictionary is trained on a bounded sample of serialized id arrays. A folder holds ``dictionary`` and data files:

    magic | dictionary hash (u64) | one zstandard frame a document | doc_ids i64 | ends of the frames i64 | lengths i64 |
    number of documents u64 | id bytes u64 | place of the index u64 | magic

so that one document is read by its index entry and one short frame. Files follow each other in ascending doc_id order.
Their names carry the attempt that wrote them and only what the finished tasks report is read, so tasks that ran twice, or
were lost, leave nothing behind that counts.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedmesh.llm.bytebpe import encoder
from embedmesh.llm.common import parts, range_bounds, range_bucket

MAGIC = b"TOKIDS01"
LEVEL = 3
#: Stands for a null doc_id in the files.
NO_ID = -(1 << 63)


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def train_dictionary(docs: DataFrame, path: str, end_id: int, max_docs: int = 2000, max_bytes: int = 2048, size: int = 1 << 15) -> bytes:
    """From about ``max_docs`` documents by a hash of the id, ``max_bytes`` of each one's ids from a place anywhere in it.
    Empty where there is too little to train on; then frames have no dictionary."""
    total = docs.count()
    draw = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        width = int(own.kind[-1])
        for frame in frames:
            out = []
            for ids in own.ids(frame["text"].tolist()):
                raw = np.append(ids, own.number(end_id)).tobytes()
                at = zlib.crc32(raw) % max(1, (len(raw) - max_bytes) // width) * width
                out.append(raw[at : at + max_bytes])
            yield pd.DataFrame({"sample": out})

    chosen = docs.where(draw < F.lit(max_docs / max(1, total))).select("text")
    samples = [bytes(r["sample"]) for r in chosen.mapInPandas(encode, "sample binary").orderBy("sample").limit(2 * max_docs).collect()]
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_hash(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw)


def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_dict_id=False, write_checksum=False)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, files: int | None = None, dictionary: bytes | None = None) -> list[dict]:
    """Encodes the whole texts (null: empty) of (doc_id, text), appends ``end_id`` and writes ``files`` files (default:
    the session's shuffle partitions). Returns a list of one entry a file, in order: path, docs, tokens.

    A null doc_id sorts first; the files hold NO_ID for it and readers give null again. Rows of equal doc_id follow each other, ordered by
    their frames. Empty table: no files.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string"))
    raw = train_dictionary(docs, tokenizer, end_id) if dictionary is None else dictionary
    where, base = _opened(folder)
    where.create_dir(base, recursive=True)
    with where.open_output_stream(f"{base}/dictionary") as f:
        f.write(raw)
    bounds = range_bounds(docs, "doc_id", files or parts(spark))

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, press = encoder(tokenizer), _compressor(raw)
        end = own.number(end_id)
        for frame in frames:
            ids = [np.append(x, end) for x in own.ids(frame["text"].tolist())]
            yield pd.DataFrame({"file": frame["file"], "doc_id": frame["doc_id"], "n": list(map(len, ids)), "frame": [press.compress(x.tobytes()) for x in ids]})

    def store(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(tokenizer)
        where, base = _opened(folder)
        done, now = [], None
        for frame in frames:
            for number, group in frame.groupby("file", sort=True):
                if now is None or now.number != number:
                    if now is not None:
                        done.append(now.close())
                    now = _File(where, f"{base}/{number:06d}-{uuid.uuid4().hex[:12]}", int(number), raw, int(own.kind[-1]))
                now.add(group)
        if now is not None:
            done.append(now.close())
        if done:
            yield pd.DataFrame(done, columns=["number", "path", "docs", "tokens"])

    framed = docs.withColumn("file", range_bucket(F.col("doc_id"), bounds)).mapInPandas(encode, "file int, doc_id long, n long, frame binary")
    sorted_ = framed.repartitionById(len(bounds) + 1, F.col("file")).sortWithinPartitions("file", "doc_id", "n", "frame")
    stored = sorted_.mapInPandas(store, "number int, path string, docs long, tokens long").collect()  # one row a file
    return [r.asDict() for r in sorted(stored)]


class _File:
    def __init__(self, where: fs.FileSystem, path: str, number: int, dictionary: bytes, width: int):
        self.number, self.path, self.width = number, path, width
        self.out = where.open_output_stream(path)
        self.out.write(MAGIC + struct.pack("<Q", dictionary_hash(dictionary)))
        self.at = len(MAGIC) + 8
        self.ids, self.ends, self.lengths = [], [], []

    def add(self, group: pd.DataFrame) -> None:
        frames = group["frame"].tolist()
        self.out.write(b"".join(frames))
        ends = self.at + np.cumsum([len(x) for x in frames])
        self.at = int(ends[-1])
        self.ids.append(group["doc_id"].to_numpy(np.int64))
        self.ends.append(ends.astype(np.int64))
        self.lengths.append(group["n"].to_numpy(np.int64))

    def close(self) -> tuple[int, str, int, int]:
        ids, ends, lengths = (np.concatenate(x) for x in (self.ids, self.ends, self.lengths))
        self.out.write(ids.tobytes() + ends.tobytes() + lengths.tobytes() + struct.pack("<QQQ", len(ids), self.width, self.at) + MAGIC)
        self.out.close()
        return self.number, self.path, len(ids), int(lengths.sum())


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, path: str, folder: str):
        self.where, base = _opened(folder)
        with self.where.open_input_stream(f"{base}/dictionary") as f:
            raw = f.read()
        self.file = self.where.open_input_file(path)
        size = self.file.size()
        n, self.width, at = struct.unpack("<QQQ", self.file.read_at(32, size - 32)[:24])
        head = self.file.read_at(len(MAGIC) + 8, 0)
        if head[:8] != MAGIC or self.file.read_at(8, size - 8) != MAGIC:
            raise ValueError(f"{path} isn't a whole token-id file")
        if struct.unpack("<Q", head[8:])[0] != dictionary_hash(raw):
            raise ValueError(f"{path} was written with another dictionary")
        self.doc_ids, ends, self.lengths = np.frombuffer(self.file.read_at(24 * n, at), np.int64).reshape(3, n)
        self.starts, self.ends = np.concatenate(([len(MAGIC) + 8], ends[:-1])).astype(np.int64), ends
        self.decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)

    def frame_ids(self, frame: bytes, k: int) -> np.ndarray:
        raw = self.decompressor.decompress(frame, max_output_size=int(self.lengths[k]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def document(self, k: int) -> np.ndarray:
        """The k-th document's ids, reading only its frame."""
        return self.frame_ids(self.file.read_at(int(self.ends[k] - self.starts[k]), int(self.starts[k])), k)

    def documents(self, block: int = 1 << 24) -> Iterator[np.ndarray]:
        k = 0
        while k < len(self.ends):
            last = max(k + 1, int(np.searchsorted(self.ends, self.starts[k] + block, "right")))
            start = int(self.starts[k])
            raw = self.file.read_at(int(self.ends[last - 1]) - start, start)
            for j in range(k, last):
                yield self.frame_ids(raw[int(self.starts[j]) - start : int(self.ends[j]) - start], j)
            k = last


def read(spark: SparkSession, folder: str, files: list[dict], with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids array<int>]) from the files: start counts the ids of all documents before."""
    before, rows = 0, []
    for f in files:
        rows.append((f["path"], before))
        before += f["tokens"]
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    if not rows:
        return spark.createDataFrame([], fields)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, base in frame.itertuples(index=False):
                file = Reader(path, folder)
                start = base + np.cumsum(file.lengths) - file.lengths
                got, at = [], 0
                for ids in file.documents():
                    got.append((zlib.crc32(ids.tobytes()), *([ids.astype(np.int32)] * with_ids)))
                    if len(got) == 2048 or at + len(got) == len(start):
                        own = slice(at, at + len(got))
                        out = pd.DataFrame({"doc_id": file.doc_ids[own], "start": start[own], "n_tokens": file.lengths[own], "ids_crc32": [g[0] for g in got]})
                        if with_ids:
                            out["ids"] = [g[1] for g in got]
                        yield out
                        at, got = at + len(got), []

    listed = spark.createDataFrame(rows, "path string, base long")
    found = listed.repartition(len(rows), "path").mapInPandas(decode, fields)
    return found.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(NO_ID), F.col("doc_id")))
