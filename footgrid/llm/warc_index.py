"""WARC archives of pages and a two-level capture index over them.

``write_archives`` writes a record per page as a gzip member of its own, so a
record can be read with one range read. Of pages with equal payloads of at
least ``least`` bytes, that with the smallest id is stored (``response``); the
others are ``revisit`` records that refer to it.

``write_index`` sorts capture lines by reversed-host URL key over range
partitions. Each partition is a file of compressed blocks of ``block_lines``
lines, and a sparse directory file with the first key and the byte range of
each block. On top is the list of the partitions' first keys, whose length is
the number of partitions (a parameter).

``lookup`` finds captures: a binary search in the list gives the partition, one
in its directory the block, which is range-read and searched; the captures' byte
ranges, sorted by archive and offset, are then range-read and parsed.

Archive and index files get a fresh name per task attempt, and only the names
that Spark has committed to the capture table are used; so a retried or a
speculative task leaves an unused file and no double record. Files lie in the
shared folder and are reached by ``pyarrow.fs``.

Null html is an empty payload, a null url has the empty key. Rows that are equal in
id and payload are all responses. A null page_id makes a record whose id is
empty; it is kept and is the response of its payload only if no other page has it.
Extra columns are ignored. Payloads are stored whole, however long. An empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from footgrid.llm.common import new_folder, sha256_hex, written

CAPTURE = "key string, page_id long, file string, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
LEAST_REVISIT = 100
BLOCK_LINES = 2000
ARCHIVE_BYTES = 256 << 20
DATE = "1970-01-01T00:00:00Z"  # pages carry no fetch time
SEP = "\x1f"


def url_key(url):
    """Column: host labels reversed and joined by commas, then ``)`` and the rest of the URL."""
    authority = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*"
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(url, authority, ""))
    return F.regexp_replace(F.coalesce(key, F.lit("")), r"[\x1f\n]", " ")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record, as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI": (url or "").replace("\r", " ").replace("\n", " "),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def parsed(member: bytes) -> tuple:
    """Of a record read back: page id, bytes and digest of the full payload, type, id that it refers to."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: (s := fields[name][len("<urn:page:") : -1]) and int(s) or (0 if s == "0" else None)
    page_id, digest = number("WARC-Record-ID"), fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "revisit":
        n = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[len("Content-Length: ") :])
        return page_id, n, digest, "revisit", number("WARC-Refers-To")
    found = sha256_hex(payload)
    if found != digest:
        raise OSError(f"record of page {page_id}: payload digest {found}, header {digest}")
    return page_id, len(payload), found, "response", None


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes the archives; gives the capture table, itself written to ``folder``."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select("page_id", "url", "html", F.sha2(F.encode(payload, "utf-8"), 256).alias("digest"))
    first = (
        pages.where(F.octet_length("html") >= least)
        .groupBy(F.sha2(F.encode(payload, "utf-8"), 256).alias("digest"))
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    marked = own.join(first, "digest", "left").select("page_id", "url", "html", "digest", F.expr("CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END").alias("refers_to"), url_key(F.col("url")).alias("key"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(f"{root}/archives")
        name = out = None
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, digest, refers_to, key in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "key"))):
                    if out is None:
                        name = f"archives/{uuid.uuid4().hex}.warc.gz"
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    data = record(page_id, url, (html or "").encode(), digest, refers_to)
                    rows.append((key, page_id, name, out.tell(), len(data)))
                    out.write(data)
                    if out.tell() >= ARCHIVE_BYTES:
                        out = out.close()
                yield _batch(rows, CAPTURE)
        finally:
            if out is not None:
                out.close()

    return written(marked.mapInArrow(write, CAPTURE), "captures")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def write_index(captures: DataFrame, folder: str, partitions: int, block_lines: int = BLOCK_LINES) -> list[tuple[str, int, str]]:
    """Writes blocks and directories; gives the partitions' first (key, page id, file)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(f"{root}/index")
        name = f"index/{uuid.uuid4().hex}"
        held, directory, out = [], [], None

        def block() -> None:
            data = zlib.compress("\n".join(SEP.join(map(str, x)) for x in held).encode(), 6)
            directory.append((held[0][0], held[0][1], out.tell(), len(data)))
            out.write(data)
            held.clear()

        for batch in batches:
            for key, page_id, *place in zip(*(c.to_pylist() for c in batch.columns)):
                out = out or system.open_output_stream(f"{root}/{name}.blocks", compression=None)
                held.append((key, -1 if page_id is None else page_id, *place))
                if len(held) >= block_lines:
                    block()
        if out is not None:
            if held:
                block()
            out.close()
            with system.open_output_stream(f"{root}/{name}.directory", compression=None) as f:
                f.write("\n".join(SEP.join(map(str, x)) for x in directory).encode())
            yield _batch([(directory[0][0], directory[0][1], name)], "key string, page_id long, file string")

    ordered = captures.repartitionByRange(partitions, "key", "page_id").sortWithinPartitions("key", F.coalesce("page_id", F.lit(-1)))
    parts = ordered.mapInArrow(write, "key string, page_id long, file string")
    return sorted(tuple(r) for r in parts.collect())  # one row per partition


class IndexReader:
    """Binary search in the list of partitions, a directory and a block, keeping the last of each."""

    def __init__(self, folder: str, parts: list[tuple[str, int, str]]):
        self.system, self.root = fs.FileSystem.from_uri(folder)
        self.parts, self.firsts = parts, [p[:2] for p in parts]
        self.part = self.block = self.asked = None

    def ranged(self, name: str, offset: int, length: int) -> bytes:
        with self.system.open_input_file(f"{self.root}/{name}") as f:
            return f.read_at(length, offset)

    def find(self, key: str, page_id: int) -> tuple[str, int, int] | None:
        """Archive, offset and length of a capture. Asked again for the same key
        and id, it gives the next capture that has both."""
        want = (key, page_id)
        if self.asked != want:
            self.asked, self.found = want, self._all(want)
        return next(self.found, None)

    def _all(self, want: tuple[str, int]) -> Iterator[tuple[str, int, int]]:
        at = bisect.bisect_right(self.firsts, want) - 1
        if at < 0:
            return
        if self.part != at:
            self.part, self.block = at, None
            with self.system.open_input_stream(f"{self.root}/{self.parts[at][2]}.directory", compression=None) as f:
                lines = [x.split(SEP) for x in f.read().decode().split("\n")]
            self.directory = [(k, int(p)) for k, p, _, _ in lines]
            self.ranges = [(int(o), int(n)) for _, _, o, n in lines]
        b = max(0, bisect.bisect_left(self.directory, want) - 1)
        while b < len(self.directory) and self.directory[b] <= want:
            if self.block != b:
                self.block = b
                lines = [x.split(SEP) for x in zlib.decompress(self.ranged(f"{self.parts[at][2]}.blocks", *self.ranges[b])).decode().split("\n")]
                self.keys, self.places = [(x[0], int(x[1])) for x in lines], [x[2:] for x in lines]
            keys, places = self.keys, self.places
            for i in range(bisect.bisect_left(keys, want), bisect.bisect_right(keys, want)):
                name, offset, length = places[i]
                yield name, int(offset), int(length)
            b += 1


def lookup(wanted: DataFrame, folder: str, parts: list[tuple[str, int, str]], partitions: int, all_there: bool = False) -> DataFrame:
    """Captures of ``wanted`` (key, page_id), read from the archives by byte range. Those that the
    index doesn't hold give no row or, where all must be there, an error."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = IndexReader(folder, parts)
        for batch in batches:
            rows = []
            for key, page_id in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id"))):
                place = reader.find(key, -1 if page_id is None else page_id)
                if place:
                    rows.append(place)
                elif all_there:
                    raise ValueError(f"the index has lost the capture of page {page_id}, key {key}")
            yield _batch(rows, "file string, offset long, length long")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        name = source = None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, system.open_input_file(f"{root}/{file}")
                rows.append(parsed(source.read_at(length, offset)))
            yield _batch(rows, RECORD)
        if source is not None:
            source.close()

    ordered = wanted.repartitionByRange(partitions, "key", "page_id").sortWithinPartitions("key", "page_id")
    places = ordered.mapInArrow(find, "file string, offset long, length long")
    return places.repartitionByRange(partitions, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(fetch, RECORD)


def archived(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """Writes all pages, indexes them, and reads every one back through the index."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    captures = write_archives(pages, folder)
    parts = write_index(captures, folder, n)
    return lookup(pages.select(url_key(F.col("url")).alias("key"), "page_id"), folder, parts, n, all_there=True)
