"""Deterministic sharded WARC archives.

Pages are put into shards by ranges of their key; the bounds come from a sample chosen by hash, so they do not depend on how
the input happens to be partitioned. Each shard is written in key order and rolled into files by compressed size. Record ids,
dates and digests are regenerated from the content, gzip members carry no time, and so equal input gives equal bytes.

Every task attempt writes under a name of its own. Only the attempts whose rows reach the manifest are renamed to their final
names; what a lost attempt leaves is never listed. Readers take the files from the manifest and stream one record at a time.

Defined results: a null html is an empty payload, a null url an empty target; of rows with equal payloads the one with the
largest key is the response and the others revisit it (of repeated rows with that key one stays a response); null keys sort
first and are written as empty; an empty table gives an empty manifest. Other columns of the table are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightspark.session import checkpointed, ensure_checkpoint_dir

DATE = "2024-01-01T00:00:00Z"
MANIFEST = "shard int, seq int, temp string, path string, records long, bytes long, sha256 string"
READ = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
        "payload binary, intact boolean")
#: Rows looked at for each shard bound, chosen by hash over all rows.
BOUND_ROWS = 64


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    where, path = fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")
    return where, path


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit carries the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    key = "" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
            f"WARC-Date: {DATE}", "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{digest}",
            f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"WARC-X-Page-Id: {key}",
            f"WARC-X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def payload_keys(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, digest, size) per row: the narrow table on which duplicates are found."""
    body = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col(key).cast("long").alias("page_id"), F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("size"))


def decisions(narrow: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) for the rows that revisit; keys by themselves are not listed."""
    groups = narrow.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = narrow.join(checkpointed(groups.drop("n")), ["digest", "size"])
    return rows.filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def shard_bounds(narrow: DataFrame, shards: int) -> list[int]:
    """Keys at which a new shard begins: quantiles over the rows with the least key hashes, so many a shard, weighted by size."""
    if shards <= 1:
        return []
    rows = (narrow.filter("page_id IS NOT NULL").select("page_id", "size", F.xxhash64("page_id").alias("h")).distinct()
            .orderBy("h", "page_id", "size").limit(BOUND_ROWS * (shards + 8)).toPandas().sort_values(["page_id", "size"], kind="stable"))
    if not len(rows):
        return []
    at = np.searchsorted(np.cumsum(rows["size"].to_numpy() + 500), np.linspace(0, rows["size"].sum() + 500 * len(rows), shards + 1)[1:-1])
    return sorted(set(int(x) for x in rows["page_id"].to_numpy()[np.minimum(at, len(rows) - 1)]))


def _shard_of(bounds: list[int]):
    edges = np.array(bounds, np.int64)

    def of(key: pa.Array) -> pa.Array:
        known = np.asarray(key.is_valid())
        at = np.searchsorted(edges, key.fill_null(0).to_numpy(zero_copy_only=False), "right")
        return pa.array(np.where(known, at, 0).astype(np.int32))

    return F.arrow_udf(of, "int")


class _Roller:
    """Writes one shard after the other and starts a new file whenever the compressed size is reached."""

    def __init__(self, folder: str, limit: int, level: int):
        self.where, self.path = _filesystem(folder)
        self.limit, self.level, self.attempt = limit, level, uuid.uuid4().hex
        self.shard, self.seq, self.out, self.done = -1, 0, None, []

    def _open(self, shard: int) -> None:
        self.seq = self.seq + 1 if shard == self.shard else 0
        self.shard = shard
        self.temp = f"_temporary/{shard:06d}-{self.seq:05d}.{self.attempt}"
        self.where.create_dir(f"{self.path}/_temporary", recursive=True)
        self.out = self.where.open_output_stream(f"{self.path}/{self.temp}", compression=None)
        self.sha, self.bytes, self.records = hashlib.sha256(), 0, 0

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.seq, self.temp, f"pages-{self.shard:06d}-{self.seq:05d}.warc.gz", self.records, self.bytes, self.sha.hexdigest()))
            self.out = None

    def write(self, shard: int, record: bytes) -> None:
        if self.out is None or shard != self.shard or self.bytes >= self.limit:
            self.close()
            self._open(shard)
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = packer.compress(record) + packer.flush()
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)
        self.records += 1


def _writer(folder: str, limit: int, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, known = _Roller(folder, limit, level), {}
        at = responded = None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["shard"], row["page_id"]) != at:
                    at, known, responded = (row["shard"], row["page_id"]), {}, set()
                if row["decides"]:
                    known[row["digest"]] = row["refers_to"]
                    continue
                payload = (row["html"] or "").encode()
                hexed = row["digest"]
                digest = base64.b32encode(bytes.fromhex(hexed)).decode()
                refers = known.get(hexed)
                if refers is None and hexed in responded:  # a repeated row of the response itself
                    refers = row["page_id"]
                responded.add(hexed)
                roller.write(row["shard"], _record(row["page_id"], row["url"] or "", payload, digest, refers))
        roller.close()
        if roller.done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*roller.done)], names=["shard", "seq", "temp", "path", "records", "bytes", "sha256"]).cast(
                pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("temp", pa.string()), ("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    return write


def _committer(folder: str):
    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                kinds = [x.type for x in where.get_file_info([f"{path}/{row['temp']}", f"{path}/{row['path']}"])]
                if kinds[0] != fs.FileType.NotFound:
                    where.move(f"{path}/{row['temp']}", f"{path}/{row['path']}")
                elif kinds[1] == fs.FileType.NotFound:
                    raise FileNotFoundError(row["path"])
            yield batch

    return commit


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", *, shard_bytes: int = 16 << 20,
                   file_bytes: int = 4 << 20, level: int = 1) -> DataFrame:
    """Writes `pages` below `folder` and returns the manifest, which is also stored there as the table `_manifest`."""
    narrow = checkpointed(payload_keys(pages, key, html))
    total = narrow.agg(F.sum("size")).first()[0] or 0
    bounds = shard_bounds(narrow, 1 + int(total // shard_bytes))
    shard: Column = _shard_of(bounds)(F.col("page_id")).alias("shard")
    body = F.col(html).cast("string")
    wide = pages.select(F.col(key).cast("long").alias("page_id"), F.sha1(F.coalesce(body, F.lit("")).cast("binary")).alias("digest"), F.lit(False).alias("decides"),
                        F.lit(None).cast("long").alias("refers_to"), F.col(url).cast("string").alias("url"), body.alias("html"))
    told = decisions(narrow).select("page_id", "digest", F.lit(True).alias("decides"), "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    rows = wide.unionByName(told).select(shard, "*").repartition(len(bounds) + 1, "shard")
    rows = rows.sortWithinPartitions("shard", "page_id", "digest", F.desc("decides"), "url")
    manifest = checkpointed(rows.mapInArrow(_writer(folder, file_bytes, level), MANIFEST))
    committed = manifest.repartition("shard").mapInArrow(_committer(folder), MANIFEST)
    committed.write.mode("overwrite").parquet(f"{folder}/_manifest")
    return pages.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/_manifest")


def _members(stream, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    unpacker, out, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(chunk)
        rest = b""
        if not data:
            return
        out.append(unpacker.decompress(data))
        if unpacker.eof:
            yield b"".join(out)
            rest, out, unpacker = unpacker.unused_data, [], zlib.decompressobj(31)


def _parse(record: bytes, payloads: bool) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    body = block.partition(b"\r\n\r\n")[2]
    length = int(fields["WARC-X-Payload-Length"])
    intact = base32_sha1(block) == fields["WARC-Block-Digest"].removeprefix("sha1:")
    if kind == "response":
        intact = intact and base32_sha1(body) == digest and len(body) == length
    number = lambda name: int(fields[name]) if fields.get(name) else None
    return (number("WARC-X-Page-Id"), fields["WARC-Target-URI"], kind, number("WARC-X-Refers-To-Page"), length, digest,
            body if payloads and kind == "response" else None, intact)


def _reader(folder: str, payloads: bool):
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]
    names = [c.split()[0] for c in READ.split(", ")]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _filesystem(folder)
        rows, size = [], 0
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with where.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for record in _members(stream):
                        rows.append(_parse(record, payloads))
                        size += len(record) if payloads else 200
                        if size > 4 << 20:
                            yield pack(rows)
                            rows, size = [], 0
        if rows:
            yield pack(rows)

    return read


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """One row per record of the listed files; `intact` tells whether its digests hold."""
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path").repartition(n, "path").mapInArrow(_reader(folder, payloads), READ)


def new_folder(spark: SparkSession) -> str:
    """A fresh folder for archives among the shared tables."""
    return f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
