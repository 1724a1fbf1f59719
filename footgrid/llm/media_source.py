"""Media members in archives, read by a Spark data source over byte ranges.

``write_members`` stores each payload losslessly as an 8-bit grey PNG image
(576 samples a row, no row filter) and appends it to an archive of the task.
An archive ends with a footer: the members' offsets and a trailer that says
where it begins. A task writes under a temporary name and moves the finished
archive to a name made from its partition number; a second attempt has the
same rows, so it replaces the archive by an equal one.

``MediaArchives`` is the data source ``media_archives``: it plans byte ranges
of ``split`` bytes over the directory's archives from their sizes alone. A
range's task reads the archive's footer and takes the members that begin in
its range, so each member is read once, whatever the ranges. Each member is
read by its own offset and checked by its CRC, and read again up to
``retries`` times if that fails; a member that stays bad gives a row with an
``error``, and the others are unaffected. Rows leave the reader as Arrow batches
of about ``batch_bytes``.

Null and empty texts have a payload of 576 bytes 255. Equal texts have equal
values. Texts are stored whole. Extra columns are ignored. An empty table gives
a directory without members and no rows.
"""

from __future__ import annotations

import contextlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from footgrid.llm.common import encoded, new_folder, sha256_hex

UNIT = 576
SUFFIX = ".media"
MEMBER = "<4sqBQQI"  # mark, doc_id, whether there is one, payload bytes without filling, media bytes, CRC of the media
TRAILER = "<QQ8s"  # footer's offset, members, mark
MARK, END = b"MEMB", b"MEDIAEND"
PNG = b"\x89PNG\r\n\x1a\n"


def payload_of(data: bytes) -> bytes:
    """Filled with bytes 255 up to a positive multiple of 576."""
    return data + b"\xff" * (UNIT - len(data) if not data else -len(data) % UNIT)


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image whose samples are the payload's bytes."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, UNIT)
    raw = np.zeros((len(rows), UNIT + 1), dtype=np.uint8)
    raw[:, 1:] = rows
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image as ``to_png`` makes them."""
    if media[:8] != PNG:
        raise ValueError("no PNG signature")
    at, data, width, height = 8, [], 0, 0
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("only 8-bit grey images are stored here")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("only rows without a filter are stored here")
    return raw[:, 1:].tobytes()


def write_members(docs: DataFrame, folder: str) -> int:
    """Stores every document's text; gives the number of members."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        attempt = f"{root}/_attempts/{uuid.uuid4().hex}"
        offsets, out = [], None
        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), encoded(batch)):
                if out is None:
                    system.create_dir(f"{root}/_attempts")
                    out = system.open_output_stream(attempt, compression=None)
                media = to_png(payload_of(data))
                offsets.append(out.tell())
                out.write(struct.pack(MEMBER, MARK, doc_id or 0, doc_id is not None, len(data), len(media), zlib.crc32(media)) + media)
        if out is not None:
            at = out.tell()
            out.write(np.array(offsets, dtype="<u8").tobytes() + struct.pack(TRAILER, at, len(offsets), END))
            out.close()
            system.move(attempt, f"{root}/part-{TaskContext.get().partitionId():06d}{SUFFIX}")
        yield pa.RecordBatch.from_arrays([pa.array([len(offsets)], pa.int64())], ["n"])

    return docs.select("doc_id", "text").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


class ByteRange(InputPartition):
    def __init__(self, path: str, size: int, start: int, end: int):
        super().__init__((path, start))
        self.path, self.size, self.start, self.end = path, size, start, end


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(directory)``; options ``split``, ``retries``, ``batch_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "doc_id long, archive string, offset long, n_bytes long, media binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.split = int(options.get("split", 16 << 20))
        self.retries = int(options.get("retries", 3))
        self.batch_bytes = int(options.get("batch_bytes", 4 << 20))

    def partitions(self) -> list[InputPartition]:
        system, root = fs.FileSystem.from_uri(self.folder)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.path.endswith(SUFFIX))
        return [ByteRange(p, n, at, min(at + self.split, n)) for p, n in files for at in range(0, n, self.split)] or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = fs.FileSystem.from_uri(self.folder)
        with system.open_input_file(partition.path) as f:
            at, n, mark = struct.unpack(TRAILER, f.read_at(struct.calcsize(TRAILER), partition.size - struct.calcsize(TRAILER)))
            if mark != END:
                raise OSError(f"{partition.path} has no footer")
            offsets = np.frombuffer(f.read_at(8 * n, at), dtype="<u8")
            first, last = np.searchsorted(offsets, [partition.start, partition.end])
            ends = np.append(offsets, at)
            rows, held = [], 0
            for i in range(first, last):
                rows.append(self.member(f, system, partition.path, int(offsets[i]), int(ends[i + 1] - offsets[i])))
                held += len(rows[-1][4] or b"")
                if held >= self.batch_bytes:
                    yield self.batch(rows)
                    rows, held = [], 0
            if rows:
                yield self.batch(rows)

    def member(self, f, system: fs.FileSystem, path: str, offset: int, size: int) -> tuple:
        """One member by its own offset; after an error of reading or checking it is read from the archive opened anew."""
        error = None
        for turn in range(1 + self.retries):
            try:
                with system.open_input_file(path) if turn else contextlib.nullcontext(f) as source:
                    data = source.read_at(size, offset)
                mark, doc_id, has_id, n_bytes, n_media, crc = struct.unpack_from(MEMBER, data)
                media = data[struct.calcsize(MEMBER) : struct.calcsize(MEMBER) + n_media]
                if mark != MARK or len(media) != n_media or zlib.crc32(media) != crc:
                    raise OSError("the member's mark, length or CRC is wrong")
                return doc_id if has_id else None, path, offset, n_bytes, media, None
            except (OSError, struct.error) as e:
                error = f"{type(e).__name__}: {e}"
        return None, path, offset, None, None, error

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["doc_id", "archive", "offset", "n_bytes", "media", "error"])


def feature_of(payload: bytes) -> str:
    """Mean and deviation of the samples in thousandths, and a 64-bit hash of the
    mean 24x24 frame: a bit for each 3x3 block, 1 where it is brighter than the mean."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    frames = samples.reshape(-1, 24, 24).sum(axis=0, dtype=np.int64)
    blocks = frames.reshape(8, 3, 8, 3).sum(axis=(1, 3)).ravel()
    bits = np.packbits(blocks * len(blocks) > blocks.sum()).tobytes().hex()
    n, counts = len(samples), np.bincount(samples, minlength=256)
    total, squares = int((counts * np.arange(256)).sum()), int((counts * np.arange(256) ** 2).sum())
    return f"{1000 * total // n}:{1000 * (n * squares - total * total) // (n * n)}:{bits}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def media_features(members: DataFrame, strict: bool = False) -> DataFrame:
    """Digests and features of the payloads in ``media``; a bad member keeps its error or, if ``strict``, fails the query."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGEST.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in DIGEST.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, n_bytes, media, error in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media", "error"))):
                if error is not None and strict:
                    raise OSError(f"a member could not be read: {error}")
                if error is not None:
                    rows.append((doc_id, *[None] * 7, error))
                    continue
                payload = from_png(media)
                rows.append((doc_id, n_bytes, len(payload), sha256_hex(payload), zlib.crc32(payload[-32:]), len(media), sha256_hex(media), feature_of(payload), None))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)

    return members.mapInArrow(work, DIGEST)


def stored_features(docs: DataFrame) -> DataFrame:
    """Stores all texts as media members, reads them back, and computes features."""
    spark = docs.sparkSession
    folder = new_folder(spark, "media")
    write_members(docs, folder)
    spark.dataSource.register(MediaArchives)
    return media_features(spark.read.format("media_archives").load(folder), strict=True)
