"""WARC archives with a two-level capture index.

Pages are dealt to ranges of their URL keys (host labels reversed) and sorted within them, so a
range's records lie in its archives in the order of its index. The index shard of a range has
compressed blocks of lines, and a sparse directory of its blocks at the end; a small table names
each shard's first and last key. A lookup halves that table, then the shard's directory, then the
block, and reads the records' byte range; neighbours are read together. A whole read looks up every
key, shard by shard.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import map_arrow, shared_dir, small_pieces, table

#: Payloads of fewer bytes are stored again rather than referred to.
REVISIT_BYTES = 1000
#: An archive is closed when it reaches this size, and another begun.
ARCHIVE_BYTES = 32 << 20
#: Lines of an index block.
BLOCK_LINES = 500
LEVEL = 3
#: Neighbouring records that are read at once add up to this, or are one record.
READ_BYTES = 8 << 20
DATE = "2000-01-01T00:00:00Z"  # pages carry no capture time

SHARDS = "first string, last string, shard string, offset long, length long, lines long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def url_key(url: str | None) -> str:
    """Host labels reversed and comma-joined, then ")" and the path in lower case; scheme, user, port 80 or 443, fragment and www are left out."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^#]*)", (url or "").strip())
    labels = m[1].lower().rstrip(".").split(".")
    if len(labels) > 2 and labels[0] == "www":
        labels = labels[1:]
    port = f":{m[2]}" if m[2] and m[2] not in ("80", "443") else ""
    return ",".join(reversed(labels)) + port + ")" + (m[3].lower() or "/")


def _quoted(s: str) -> str:
    return re.sub(r"[\s%]", lambda c: "".join(f"%{b:02X}" for b in c[0].encode("utf-8", "surrogatepass")), s)


def _unquoted(s: str) -> str:
    return re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), s.encode("utf-8", "surrogatepass")).decode("utf-8", "surrogatepass")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit without one."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_quoted(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    head.append(f"WARC-Payload-Length: {len(payload)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + body + b"\r\n\r\n", LEVEL, mtime=0)


def parse_record(data: bytes) -> dict:
    """The record of one gzip member; a payload that differs from its digest raises ValueError."""
    raw = zlib.decompress(data, 31)
    end = raw.index(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in raw[:end].decode().split("\r\n")[1:])
    body = raw[end + 4 : end + 4 + int(fields["Content-Length"])]
    revisit = fields["WARC-Type"] == "revisit"
    payload = None if revisit else body[body.index(b"\r\n\r\n") + 4 :]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(fields["WARC-Payload-Length"])
    if payload is not None and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    number = lambda s: int(x) if (x := s.removeprefix("<urn:page:").removesuffix(">")) else None
    url = fields.get("WARC-Target-URI")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": None if url is None else _unquoted(url), "record_type": fields["WARC-Type"], "payload_bytes": size, "payload_digest": digest, "refers_to": number(fields["WARC-Refers-To"]) if revisit else None, "payload": payload}


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    local = re.match(r"(?:file:)?/+(.*)", uri)
    return (pafs.LocalFileSystem(), "/" + local[1]) if local else pafs.FileSystem.from_uri(uri)


class _File:
    """A file that appears under its name when it is closed; a second attempt writes the same bytes again."""

    def __init__(self, uri: str):
        self.fs, self.path = _fs(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        context = TaskContext.get()
        self.temp = f"{self.path}.{context.taskAttemptId() if context else 0}.tmp"
        self.out, self.size = self.fs.open_output_stream(self.temp), 0

    def write(self, data: bytes) -> int:
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.path)


@lru_cache(16)
def _open(uri: str) -> pa.NativeFile:
    fs, path = _fs(uri)
    return fs.open_input_file(path)


def read_range(uri: str, offset: int, length: int) -> bytes:
    data = _open(uri).read_at(length, offset)
    return bytes(data)


def captures(pages: DataFrame) -> DataFrame:
    """(key, page_id, digest, url, payload, refers_to), in ranges of the key and sorted: a row for each page, and before those of a revisit one without payload that tells what they refer to.

    Of equal payloads of REVISIT_BYTES or more the largest page_id is the response, the others refer to
    it. Null html is an empty payload. Rows that repeat the response's id are responses too. Rows of
    null id refer to it like any other; where a group has no id at all, all are responses. Payloads
    are shuffled once, into their ranges, where narrow rows meet them by the order.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.select("page_id", F.sha1("payload").alias("digest"), "url", "payload")
    narrow = rows.where(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", "digest", "url")
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    told = narrow.distinct().join(groups, "digest").where("not (page_id <=> refers_to)").select("page_id", "digest", "url", F.lit(None).cast("binary").alias("payload"), "refers_to")
    both = rows.withColumn("refers_to", F.lit(None).cast("long")).unionByName(told).withColumn("key", url_keys(F.col("url")))
    # Ties of the key are spread by id and digest, so that no host or URL makes a range hot. The order
    # is total but for equal rows, so a task that runs again writes the same bytes to the same places.
    order = ("key", "page_id", "digest", "url")
    return both.repartitionByRange(*order).sortWithinPartitions(*order, F.col("payload").isNotNull()).select("key", "page_id", "digest", "url", "payload", "refers_to")


class Shard:
    """An index shard, of which only the directory is held; the last block read is kept, as sorted keys meet it again."""

    def __init__(self, uri: str, offset: int, length: int):
        self.uri = uri
        self.blocks = [(first, last, int(at), int(n)) for first, last, at, n in _lines(uri, offset, length)]
        self.firsts, self.lasts = [b[0] for b in self.blocks], [b[1] for b in self.blocks]
        self._held: tuple[int, list[str], list] = (-1, [], [])

    def entries(self, key: str) -> list[tuple[str, int, int]]:
        """(archive, offset, length) of the key's records: the directory is halved, then the block."""
        out = []
        for i in range(bisect_left(self.lasts, key), bisect_right(self.firsts, key)):
            if self._held[0] != i:
                lines = _lines(self.uri, *self.blocks[i][2:])
                self._held = (i, [x[0] for x in lines], [(x[1], int(x[2]), int(x[3])) for x in lines])
            _, keys, places = self._held
            out += places[bisect_left(keys, key) : bisect_right(keys, key)]
        return out


def read_records(places: list[tuple[str, int, int]]) -> Iterator[dict]:
    """The records at (archive, offset, length), neighbours by one read."""
    at = 0
    while at < len(places):
        archive, begin, length = places[at]
        end, stop = begin + length, at + 1
        while stop < len(places) and places[stop][:2] == (archive, end) and end + places[stop][2] - begin <= READ_BYTES:
            end, stop = end + places[stop][2], stop + 1
        data = read_range(archive, begin, end - begin)
        for _, offset, n in places[at:stop]:
            yield parse_record(data[offset - begin : offset - begin + n])
        at = stop


@dataclass
class Archive:
    """Where the archives, the index shards and the table of shards are."""

    spark: SparkSession
    root: str

    def shards(self) -> DataFrame:
        """A row per range of keys, so they are as few as the partitions of one write."""
        return self.spark.read.parquet(f"{self.root}/shards")

    def find(self, keys: DataFrame, payloads: bool = True) -> DataFrame:
        """The records of the distinct URL keys of `keys` (key), each once; every shard is searched in one task, for the keys within its range."""
        table = self.spark.sparkContext.broadcast(sorted((r.first, r.last, r.shard, r.offset, r.length) for r in self.shards().collect()))

        @arrow_udf("array<int>")
        def holders(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            firsts, lasts = [t[0] for t in table.value], [t[1] for t in table.value]
            for values in batches:
                yield pa.array([list(range(bisect_left(lasts, k), bisect_right(firsts, k))) for k in values.to_pylist()], pa.list_(pa.int32()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, shard, wanted, size = None, None, [], 0
            for batch in batches:
                for n, key in zip(batch.column("n").to_pylist(), batch.column("key").to_pylist(), strict=True):
                    if n != number:
                        number, shard = n, Shard(*table.value[n][2:])
                    for place in shard.entries(key):
                        if wanted and size + place[2] > READ_BYTES:
                            yield _records(wanted, payloads)
                            wanted, size = [], 0
                        wanted.append(place)
                        size += place[2]
            yield _records(wanted, payloads)

        asked = keys.select("key").where("key is not null").distinct().select("key", F.explode(holders(F.col("key"))).alias("n"))
        return map_arrow(asked.repartitionById(max(1, len(table.value)), "n").sortWithinPartitions("n", "key"), run, RECORD)

    def lookup(self, url: str) -> list[dict]:
        """The records of a URL. The driver reads the table's rows around the key only, and each shard's directory and blocks there."""
        key = url_key(url)
        shards = self.shards().where((F.col("first") <= key) & (F.col("last") >= key)).orderBy("first", "last", "shard").collect()
        found = [r for s in shards for r in read_records(Shard(s.shard, s.offset, s.length).entries(key))]
        return [r for r in found if url_key(r["url"]) == key]


def _records(places: list[tuple[str, int, int]], payloads: bool) -> pa.RecordBatch:
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    return pa.RecordBatch.from_pylist([r if payloads else r | {"payload": None} for r in read_records(places)], kind)


def _packed(lines: list[tuple]) -> bytes:
    return zlib.compress("\n".join(" ".join(_quoted(x) if isinstance(x, str) else str(x) for x in line) for line in lines).encode("utf-8", "surrogatepass"))


def _lines(shard: str, offset: int, length: int) -> list[list[str]]:
    text = zlib.decompress(read_range(shard, offset, length)).decode("utf-8", "surrogatepass")
    return [[_unquoted(x) for x in line.split(" ")] for line in text.split("\n") if line]


def url_keys(url: Column) -> Column:
    """The keys of a column of URLs."""

    @arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.array(map(url_key, values.to_pylist()), pa.string())

    return run(url)


def write(pages: DataFrame, root: str | None = None) -> Archive:
    """Archives and index of all rows of `pages` (page_id, url, html) under `root`, by default a new shared folder.

    An empty table has no shards. Rows that repeat an id or a URL are records of their own.
    """
    spark = pages.sparkSession
    root = root or shared_dir(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out, n, uri = None, 0, ""
        index, held, blocks, told = None, [], [], (None, None)

        def flush() -> None:
            data = _packed(held)
            blocks.append((held[0][0], held[-1][0], index.write(data), len(data)))
            held.clear()

        for batch in batches:
            for piece in small_pieces(batch, "payload"):
                for r in piece.to_pylist():
                    same = (r["page_id"], r["digest"], r["url"])
                    if r["payload"] is None:
                        told = same, r["refers_to"]
                        continue
                    if out is None:
                        uri = f"{root}/archives/{part:06d}-{n:04d}.warc.gz"
                        out, n = _File(uri), n + 1
                    index = index or _File(f"{root}/index/{part:06d}.idx")
                    data = record_bytes(r["page_id"], r["url"], r["payload"], r["digest"], told[1] if told[0] == same else None)
                    held.append((r["key"], uri, out.write(data), len(data)))
                    if len(held) == BLOCK_LINES:
                        flush()
                    if out.size >= ARCHIVE_BYTES:
                        out.close()
                        out = None
        if held:
            flush()
        if out is not None:
            out.close()
        if index is not None:
            directory = _packed(blocks)
            offset = index.write(directory)
            index.close()
            yield pa.record_batch([pa.array([x]) for x in (blocks[0][0], blocks[-1][1], f"{root}/index/{part:06d}.idx", offset, len(directory), len(blocks))], names=["first", "last", "shard", "offset", "length", "lines"])

    map_arrow(captures(pages), run, SHARDS).write.parquet(f"{root}/shards")
    return Archive(spark, root)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives and looked up there by their URLs; the archives stay in the shared folder."""
    pages = table(spark, sf_dir, "pages")
    found = write(pages).find(pages.select(url_keys(F.col("url").cast("string")).alias("key")), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM m
"""
