"""WARC archives: a deterministic sharded writer, and a reader.

Records are range-sorted by key and payload digest. The cuts between shards are
the keys at exact row numbers, not at sampled ones, so that the same pages give
the same files, byte for byte, in every run. Each shard is one task, which
compresses record by record, rolls to a new file when the compressed size is
reached, and holds one record at a time.

A file is written under a temporary name that no other attempt has and renamed
when it is closed; its final name and its bytes depend on the pages alone, so a
retried or doubled task ends in the same state. Files count once the manifest, a
table that Spark commits as a whole, lists them. The reader takes files from the
manifest alone, checks their size and digest, and regenerates the digests of
every payload it reads.

Of records with equal payloads (by SHA-1 and length) the one with the largest
key is the response, and the others revisit it: their block has the HTTP headers
without the payload. Pages are told apart as responses by a join without a hint
on narrow rows; hot payloads are combined before the shuffle.

The folder must be one that all executors share. Tasks write through Arrow's
file systems, so it may be local to one machine only in a local session.

The first key of each shard comes to the driver and goes to every task: at most
``MAX_SHARDS`` of them, as shards grow beyond that.

Defined cases. A null payload is an empty one; a null address gives no target
header. Rows without key sort first and are responses unless a row with a key
has their payload; their records are named by the payload's digest and come back
with a null key.  Rows that repeat the response's key and payload are responses
too. Rows equal in key and payload lie in one shard.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators.sequence import INDEX, add_row_index
from faultline.sources.scratch import stored

SHARD_BYTES = 16 << 20  # payload bytes of one shard, on average
MAX_SHARDS = 20_000  # beyond that shards grow, as their first keys come to the driver
PIECE = 1 << 16  # compressed bytes unpacked together
ROLL_BYTES = 4 << 20  # compressed bytes of one file
LEVEL = 4  # of compression
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = (
    "shard int, sequence int, file string, records bigint, bytes bigint, sha256 string"
)
RECORD = (
    "key string, uri string, payload_bytes bigint, payload_digest string, record_type string, "
    "refers_to string, file string, payload binary"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _escaped(uri: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)


def _record_id(key: str | None, digest: str) -> str:
    """A null key is no key: its record is named by its payload."""
    return f"urn:payload:{digest}" if key is None else f"urn:page:{key}"


def record_bytes(
    key: str | None, uri: str | None, size: int, digest: str, payload: bytes | None, refers_to: str | None
) -> bytes:
    """One record; without ``payload`` a revisit of ``refers_to``."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {size}\r\n\r\n"
    ).encode()
    block = http + (payload or b"")
    header = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_record_id(key, digest)}>",
        f"WARC-Date: {DATE}",
    ]
    if uri is not None:
        header.append(f"WARC-Target-URI: {_escaped(uri)}")
    header.append(f"WARC-Payload-Digest: sha1:{digest}")
    header.append(f"WARC-Block-Digest: sha1:{base32_sha1(block)}")
    if refers_to is not None:
        header += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    header += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(header).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member without time or name, so that equal data give equal bytes."""
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def members(data: bytes) -> Iterator[bytes]:
    view, at = memoryview(data), 0
    while at < len(view):
        unpack, out = zlib.decompressobj(31), []
        # in pieces, so that what follows a record is not copied for each record
        while not unpack.eof:
            if at == len(view):
                raise ValueError("the archive ends inside a record")
            piece = view[at : at + PIECE]
            out.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
        yield b"".join(out)


def parsed(record: bytes) -> dict:
    """The fields of one record, its digests checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"block of {fields['WARC-Record-ID']} does not match its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: ([0-9]+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    page = "<urn:page:"

    def key(name: str) -> str | None:
        found = fields.get(name, "")
        return found[len(page) : -1] if found.startswith(page) else None

    return {
        "key": key("WARC-Record-ID"),
        "uri": fields.get("WARC-Target-URI"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": key("WARC-Refers-To"),
        "payload": payload if kind == "response" else None,
    }


def _qualified(spark: SparkSession, path: str) -> str:
    """The folder as a whole address, which the tasks do not have to guess."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.makeQualified(folder).toString()
    return re.sub(r"^file:/+", "file:///", found)


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


class _Files:
    """The files of one shard, one open at a time."""

    def __init__(self, root: str, shard: int, attempt: str, roll: int):
        self.files, self.root = _open(root)
        self.shard, self.attempt, self.roll = shard, attempt, roll
        self.sequence, self.stream, self.done = 0, None, []

    def add(self, member: bytes):
        if self.stream is not None and self.size + len(member) > self.roll:
            self.close()
        if self.stream is None:
            self.files.create_dir(f"{self.root}/_temporary", recursive=True)
            self.temporary = f"{self.root}/_temporary/{self.attempt}-{self.shard}-{self.sequence}"
            self.stream = self.files.open_output_stream(self.temporary, compression=None)
            self.size, self.records, self.sha256 = 0, 0, hashlib.sha256()
        self.stream.write(member)
        self.sha256.update(member)
        self.size += len(member)
        self.records += 1

    def close(self):
        if self.stream is None:
            return
        self.stream.close()
        name = f"pages-{self.shard:07d}-{self.sequence:05d}.warc.gz"
        try:
            self.files.move(self.temporary, f"{self.root}/{name}")
        except OSError:
            # a store that does not rename over the same file of another attempt
            self.files.delete_file(f"{self.root}/{name}")
            self.files.move(self.temporary, f"{self.root}/{name}")
        row = (self.shard, self.sequence, name, self.records, self.size, self.sha256.hexdigest())
        self.done.append(row)
        self.sequence, self.stream = self.sequence + 1, None


def _decided(pages: DataFrame, least: int) -> DataFrame:
    """``pages`` as (key, uri, payload, sha1, size, refers_to); ``payload`` is null
    in revisits."""
    same = pages.groupBy("sha1", "size").agg(F.count("*").alias("_n"), F.max("key").alias("_last"))
    same = same.filter((F.col("_n") > 1) & (F.col("size") >= least)).drop("_n")
    # stored, so that its size is known before the join is planned: wide rows are
    # only sent by payload where repeated payloads are too many to be sent round
    same = stored(same, "repeated")
    joined = pages.join(same, ["sha1", "size"], "left")
    revisit = F.col("_last").isNotNull() & ~F.col("key").eqNullSafe(F.col("_last"))
    return joined.select(
        "key",
        "uri",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "sha1",
        "size",
        F.when(revisit, F.col("_last")).alias("refers_to"),
    )


def write_archives(
    df: DataFrame,
    root: str,
    key: str = "page_id",
    uri: str = "url",
    payload: str = "html",
    least_revisit: int = 0,
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
) -> DataFrame:
    """Write a record per row below the folder ``root``; return its manifest."""
    spark = df.sparkSession
    root = _qualified(spark, root)
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    pages = df.select(
        F.col(key).alias("key"), F.col(uri).alias("uri"), body.alias("payload")
    ).withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("bigint")})

    narrow = pages.select("key", "sha1", "size")
    numbered = add_row_index(narrow, ["key", "sha1"], ties="scan")
    n, total = numbered.agg(F.count("*"), F.sum("size")).first()
    shard_bytes = max(shard_bytes, (total or 0) // MAX_SHARDS)
    per_shard = max(1, n * shard_bytes // max(total or 0, shard_bytes)) if n else 1
    cut_rows = numbered.filter((F.col(INDEX) % per_shard == 0) & (F.col(INDEX) > 0))
    # at most about MAX_SHARDS keys
    cuts = sorted((r["key"] is not None, r["key"], r["sha1"]) for r in cut_rows.collect())
    shards = len(cuts) + 1

    def shard_of(keys: pa.Array, digests: pa.Array) -> pa.Array:
        rows = zip(keys.to_pylist(), digests.to_pylist(), strict=True)
        return pa.array([bisect.bisect_right(cuts, (k is not None, k, d)) for k, d in rows], pa.int32())

    shard = F.arrow_udf(shard_of, "int")(F.col("key"), F.col("sha1"))
    decided = _decided(pages, least_revisit).withColumn("shard", shard)
    placed = decided.repartitionById(shards, F.col("shard")).sortWithinPartitions(
        "shard", "key", "sha1", "uri"
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = f"{TaskContext.get().stageId()}-{TaskContext.get().taskAttemptId()}"
        files, done = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                x = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                if files is None or files.shard != x["shard"]:
                    if files is not None:
                        files.close()
                        done += files.done
                    files = _Files(root, x["shard"], attempt, roll_bytes)
                digest = base64.b32encode(bytes.fromhex(x["sha1"])).decode()
                own, refers = (None if x[c] is None else str(x[c]) for c in ("key", "refers_to"))
                record = record_bytes(own, x["uri"], x["size"], digest, x["payload"], refers)
                files.add(gzip_member(record))
        if files is not None:
            files.close()
            done += files.done
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        columns = [pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(
            columns, ["shard", "sequence", "file", "records", "bytes", "sha256"]
        )

    manifest = placed.mapInArrow(write, MANIFEST)
    manifest.write.mode("errorifexists").parquet(f"{root}/manifest")
    left = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_temporary")
    left.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(left, True)
    return read_manifest(spark, root)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def read_archives(spark: SparkSession, root: str, payloads: bool = True) -> DataFrame:
    """The records of all files of the manifest; ``payloads`` returns bodies too."""
    root = _qualified(spark, root)
    listed = read_manifest(spark, root)
    tasks = max(1, listed.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(root)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_stream(f"{base}/{row['file']}", compression=None) as stream:
                    data = stream.read()
                if len(data) != row["bytes"] or hashlib.sha256(data).hexdigest() != row["sha256"]:
                    raise ValueError(f"{row['file']} does not match the manifest")
                records = []
                for member in members(data):
                    record = parsed(member) | {"file": row["file"]}
                    if not payloads:
                        record["payload"] = None
                    records.append(record)
                if len(records) != row["records"]:
                    raise ValueError(f"{row['file']} has {len(records)} records")
                yield pa.RecordBatch.from_pylist(records, arrow_schema)

    arrow_schema = pa.schema(
        [
            ("key", pa.string()),
            ("uri", pa.string()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.string()),
            ("file", pa.string()),
            ("payload", pa.binary()),
        ]
    )
    return listed.repartition(tasks).mapInArrow(read, RECORD)


# The record every page must come back as; base32 from the hexadecimal digest,
# four characters from every five digits.
ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (
  SELECT page_id, body, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS h,
         max(page_id) OVER (PARTITION BY body) AS last FROM p),
b AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1,
      1)), '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM b
"""
