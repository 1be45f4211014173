"""WARC archives: a deterministic sharded writer and a reader.

Records are dealt to shards by ranges of (key, hash of the payload) that hold about `rows_per_shard` rows each, whatever
the keys are, sorted within the shard and written by one task in that order; a file ends when its compressed size
reaches `roll_bytes`. The ranges' bounds are quantiles of a sample by hash, the same wherever rows lie. Names, dates
and record ids follow from the input alone, so a repeated task writes the same bytes. Each file is written under a
temporary name that only its attempt uses and then renamed; the manifest, a table of the files with their sizes and
digests, is written last by Spark's committer. Readers take files from the manifest only.
"""

from __future__ import annotations

import base64
import hashlib
import io
import math
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import filesystem, materialize, work_dir

#: Rows in a shard, on average: about 16 MB of pages. The most shards (beyond, they grow), and their sampled rows each.
ROWS_PER_SHARD, MOST_SHARDS, SAMPLED = 4096, 1 << 14, 64
#: Compressed size at which a file ends.
ROLL_BYTES = 64 << 20
#: WARC-Date of every record: archives of equal input are equal.
DATE = "2020-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6d0c9f0e-3b51-4d0e-9d4f-6c1b6a1c2f11")
_CHUNK = 1 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None, sha1: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{key}/{sha1}/{copy}')}>"


def record(headers: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in headers.items())
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def page_record(key: int | None, url: str | None, payload: bytes, sha1: str, first: int | None, revisit: bool, copy: int) -> bytes:
    """A page's record with regenerated headers; a revisit keeps the HTTP header and leaves the payload out."""
    http = _http(len(payload))
    block = http if revisit else http + payload
    headers = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(key, sha1, copy), "WARC-Date": DATE}
    if url is not None:
        headers["WARC-Target-URI"] = url
    if key is not None:
        headers["X-Page-Id"] = key
    headers |= {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{sha1}", "WARC-Block-Digest": f"sha1:{digest(block)}"}
    if revisit:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(first, sha1)}
        if first is not None:
            headers["X-Refers-To-Page-Id"] = first
    return record(headers, block)


class _Roller:
    """Writes one shard's records as gzip members to files that end at `roll_bytes`."""

    def __init__(self, folder: str, roll_bytes: int):
        self.fs, self.folder = filesystem(folder)
        self.roll_bytes, self.attempt = roll_bytes, uuid.uuid4().hex
        self.out = None

    def open(self, shard: int) -> None:
        self.name = f"shard-{shard & (1 << 64) - 1:020d}-{self.seq:05d}.warc.gz"
        self.temporary = f"{self.folder}/.{self.name}.{self.attempt}.tmp"
        self.out, self.sha, self.size, self.records = self.fs.open_output_stream(self.temporary, compression=None), hashlib.sha256(), 0, 0
        head = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(shard, self.name), "WARC-Date": DATE, "WARC-Filename": self.name, "Content-Type": "application/warc-fields"}
        self.put(record(head, b"software: recordloom\r\nformat: WARC File Format 1.1\r\n"))

    def put(self, data: bytes) -> None:
        packer = zlib.compressobj(5, zlib.DEFLATED, 31)
        packed = packer.compress(data) + packer.flush()
        self.out.write(packed)
        self.sha.update(packed)
        self.size += len(packed)
        self.records += 1

    def close(self) -> Iterator[tuple]:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.folder}/{self.name}")
            yield self.name, self.records, self.size, self.sha.hexdigest()
            self.out = None

    def run(self, rows) -> Iterator[tuple]:
        shard = self.seq = None
        for at, data in rows:
            if at != shard:
                yield from self.close()
                shard, self.seq = at, 0
            elif self.out is not None and self.size >= self.roll_bytes:
                yield from self.close()
                self.seq += 1
            if self.out is None:
                self.open(shard)
            self.put(data)
        yield from self.close()


def _records(batches):
    """Shard and record of each page of sorted rows; a repeated payload's decision precedes the pages it is for."""
    decided: dict[bytes, int | None] = {}
    last = written = None
    for batch in batches:
        shards, keys, kinds = (batch.column(i).to_pylist() for i in range(3))
        for i, (shard, key, kind) in enumerate(zip(shards, keys, kinds, strict=True)):
            if (shard, key) != last:
                last, decided, written = (shard, key), {}, {}
            if kind == 0:
                decided[batch.column(3)[i].as_py()] = batch.column(4)[i].as_py()
                continue
            payload = (batch.column(6)[i].as_py() or "").encode()
            raw = hashlib.sha1(payload).digest()
            sha1 = base64.b32encode(raw).decode()
            first, copy = decided.get(raw, key), written.get(raw, 0)
            written[raw] = copy + 1
            yield shard, page_record(key, batch.column(5)[i].as_py(), payload, sha1, first, first != key or copy > 0, copy)


def _writer(folder: str, roll_bytes: int):
    def run(batches):
        import pyarrow as pa

        files = list(_Roller(folder, roll_bytes).run(_records(batches)))
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in files], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["file", "records", "bytes", "sha256"])

    return run


def _bounds(digests: DataFrame, shards: int, rows: int) -> list[tuple[int | None, int]]:
    """The least (key, hash) of each shard but the first, from about SAMPLED rows for each shard.

    A row is sampled by its key and hash, so equal rows are sampled together and count as many as they are.
    """
    part = max(1, rows // (shards * SAMPLED))
    sample = digests.where(F.pmod(F.xxhash64("key", "h"), F.lit(part)) == 0).groupBy("key", "h").agg(F.count(F.lit(1)).alias("n"))
    found = sorted(((r.key, r.h, r.n) for r in sample.toLocalIterator()), key=lambda r: (r[0] is not None, r[0], r[1]))
    total, seen, out = sum(n for _, _, n in found), 0, []
    for key, h, n in found:
        if seen * shards // total > len(out):
            out += [(key, h)] * (seen * shards // total - len(out))
        seen += n
    return sorted(set(out), key=lambda r: (r[0] is not None, r[0], r[1]))


def _shard(bounds: list[tuple[int | None, int]]) -> Column:
    """How many bounds are at or below the row's key and h, by bisection."""
    if not bounds:
        return F.lit(0)
    longs = lambda xs: F.split(F.lit(",".join("" if x is None else str(x) for x in xs)), ",").try_cast("array<bigint>")
    table = F.arrays_zip(longs(k for k, _ in bounds).alias("key"), longs(h for _, h in bounds).alias("h"))
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    down = lambda at, step: F.when((at + step <= len(bounds)) & (F.get(table, at + step - 1) <= F.struct("key", "h")), at + step).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), down)


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rows_per_shard: int = ROWS_PER_SHARD, roll_bytes: int = ROLL_BYTES) -> str:
    """Write a record for each row of `pages`; the archive's folder (files and a `_manifest` table).

    Of rows with equal payloads that with the largest key is the response and the others revisit it; a null key counts
    as the smallest, and of rows with the same key and payload the first in order of URL is the response. A null
    payload counts as empty. Keys may be any 64-bit numbers, few or far apart; rows without one come first, by their
    payload. A payload of any length is one record. Only the three named columns are read. An empty table makes an
    empty manifest.
    """
    spark = pages.sparkSession
    folder = work_dir(spark, "warc")
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    raw = F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary"))).alias("raw")
    rows = pages.select(F.col(id_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).select("*", raw)
    digests = materialize(rows.select("key", "raw", F.xxhash64("raw").alias("h")), "warc-digests")
    n = digests.count()
    shards = max(1, min(MOST_SHARDS, math.ceil(n / rows_per_shard)))
    shard = _shard(_bounds(digests, shards, n) if shards > 1 else []).alias("shard")
    repeated = digests.groupBy("raw").agg(F.max("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # a range of keys is a shard; a decision is needed once for each key and payload
    text = F.lit(None).cast("string")
    decisions = digests.distinct().join(repeated, "raw").select(shard, "key", F.lit(0).alias("kind"), "raw", "first", text.alias("url"), text.alias("html"))
    both = rows.withColumn("h", F.xxhash64("raw")).select(shard, "key", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("raw"), F.lit(None).cast("long").alias("first"), "url", "html").unionByName(decisions)
    # a task for each shard, so that none grows with the input
    dealt = both.repartition(shards, "shard").sortWithinPartitions("shard", "key", "kind", "url", "html")
    files = dealt.mapInArrow(_writer(folder, roll_bytes), "file string, records long, bytes long, sha256 string")
    files.write.parquet(f"{folder}/_manifest")
    return folder


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one record each."""
    rest = b""
    while True:
        unpacker, out = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not rest:
                rest = stream.read(_CHUNK)
                if not rest:
                    if out:
                        raise ValueError("an archive breaks off")
                    return
            out.append(unpacker.decompress(rest))
            rest = unpacker.unused_data
        yield b"".join(out)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    stream = io.BytesIO(data)
    if not stream.readline().startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    headers: dict[str, str] = {}
    while line := stream.readline().rstrip(b"\r\n"):
        name, _, value = line.decode().partition(":")
        headers[name.lower()] = value.strip()
    block = stream.read(int(headers["content-length"]))
    if len(block) != int(headers["content-length"]) or stream.read() != b"\r\n\r\n":
        raise ValueError("a WARC record breaks off")
    return headers, block


def _reader(folder: str):
    def run(batches):
        import pyarrow as pa

        fs, path = filesystem(folder)
        fields = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for headers, block in map(parse_record, _members(stream)):
                        if headers["warc-type"] == "warcinfo":
                            continue
                        if digest(block) != headers["warc-block-digest"][5:]:
                            raise ValueError(f"a record of {name} differs from its digest")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        said = headers["warc-payload-digest"][5:]
                        length = int(http.rpartition(b":")[2])
                        if headers["warc-type"] == "response" and (digest(payload) != said or len(payload) != length):
                            raise ValueError(f"a payload of {name} differs from its digest")
                        key, first = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                        rows.append((key and int(key), headers.get("warc-target-uri"), length, said, headers["warc-type"], first and int(first)))
                for at in range(0, len(rows), 10_000):
                    part = rows[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate(fields.values())], names=list(fields))

    return run


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each page record: page_id, url, payload_bytes, payload_digest, record_type, refers_to; digests are checked."""
    files = spark.read.parquet(f"{folder}/_manifest").select("file", "bytes")
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), files.count()))
    return files.repartition(n, "file").mapInArrow(_reader(folder), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
