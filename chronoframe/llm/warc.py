"""WARC archives written with an index first, and read back by coalesced byte ranges.

Writing deals every record its place: each task appends compressed records to archives of its own and returns one index row
per record (archive, offset, length, url, digest, ...). The index is written as a table before anything is read, so it
names only archives of tasks that ended well; a repeated task writes archives of other names.
Reading takes any selection of index rows, sorts them by archive and offset, joins ranges that lie close together into
one read of at most MAX_READ bytes and parses the records in it.

Of records with equal payloads (by SHA-256) of at least MIN_REVISIT bytes the one with the smallest page_id is a
response and carries the payload, the others are revisits that refer to it.

Defined cases: null html is an empty payload, a null url an empty target; repeated rows of the smallest page_id are all
responses; a page_id that is null or no whole number is null and never wins against a number; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm import textkernel as tk
from chronoframe.llm.common import new_folder, small_batches, written

MIN_REVISIT = 100
MAX_ARCHIVE = 128 << 20
MAX_READ = 8 << 20
MAX_GAP = 64 << 10
#: Bytes of records that one task reads, about.
READ_TASK = 32 << 20

INDEX = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())])
INDEX_DDL = "archive string, offset long, length long, url string, digest string, page_id long, record_type string, refers_to long"
READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
READ_DDL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI of the shared folder (file, hdfs, s3 and what else pyarrow knows)."""
    if re.match(r"file:/[^/]", folder):
        folder = "file://" + folder[5:]
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header alone, whose Content-Length is the full payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record; the digest of a response is taken from its payload and held against the header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")

    def page(name: str):
        value = fields.get(name, "<urn:page:None>")[10:-1]
        return None if value == "None" else int(value)

    if fields["WARC-Type"] == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    else:
        payload = None
    return {"page_id": page("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To"), "payload": payload}


class Archives:
    """The archives that one task writes: a new one whenever MAX_ARCHIVE is reached."""

    def __init__(self, folder: str):
        self.fs, self.path = file_system(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.out = None

    def append(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= MAX_ARCHIVE:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None)
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        self.at += len(member)
        return self.name, self.at - len(member), len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """pages (page_id, url, html) -> the index, a written table; the archives lie in folder."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or new_folder(spark, "warc")
    html = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("payload"), F.sha2(html, 256).alias("digest"))
    small = rows.select("page_id", "digest", F.octet_length("payload").alias("size")).where(f"size >= {MIN_REVISIT}")
    copied = small.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = rows.join(written(copied, "repeated-payloads"), "digest", "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("first") != F.col("page_id")), F.col("first"))
    rows = found.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = Archives(folder)
        for batch in batches:
            for part in tk.chunks(batch, "payload"):
                out = []
                for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    place = archives.append(record(page_id, url, payload, digest, refers_to))
                    out.append((*place, url, digest, page_id, "response" if refers_to is None else "revisit", refers_to))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), INDEX, strict=True)], schema=INDEX)
        archives.close()

    return written(rows.mapInArrow(write, INDEX_DDL).withColumn("folder", F.lit(folder)), "warc-index")


def _ranges(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Runs of (folder, archive, offset, length) that one read of at most MAX_READ bytes covers, if more than one."""
    run: list[tuple] = []
    for row in rows:
        folder, archive, offset, length = row
        if run and ((folder, archive) != run[-1][:2] or offset - (run[-1][2] + run[-1][3]) > MAX_GAP or offset + length - run[0][2] > MAX_READ):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def read_records(selection: DataFrame) -> DataFrame:
    """Index rows -> page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""
    spark = selection.sparkSession
    small_batches(spark)
    size = selection.agg(F.sum("length")).first()[0] or 0
    # By the records' bytes, not by the index's: a stretch of an archive is one task's, and the tasks are as many as the bytes call for.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // READ_TASK) if size > READ_TASK else 1
    stretch = F.floor(F.col("offset") / READ_TASK)
    ordered = selection.select("folder", "archive", "offset", "length").repartition(tasks, "folder", "archive", stretch)
    ordered = ordered.sortWithinPartitions("folder", "archive", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        systems: dict = {}
        opened = source = None
        for run in _ranges(rows):
            folder, archive, begin, _ = run[0]
            if opened != (folder, archive):
                if source is not None:
                    source.close()
                fs, path = systems.setdefault(folder, file_system(folder))
                source, opened = fs.open_input_file(f"{path}/{archive}"), (folder, archive)
            data = source.read_at(run[-1][2] + run[-1][3] - begin, begin)
            out = [parse(zlib.decompress(data[at - begin : at - begin + size], 31)) for _, _, at, size in run]
            yield pa.RecordBatch.from_pylist(out, READ)
        if source is not None:
            source.close()

    return ordered.mapInArrow(read, READ_DDL)


ORACLE = r"""
with p as (select page_id, coalesce(html, '') as h from pages),
q as (select page_id, cast(octet_length(encode(h)) as bigint) as payload_bytes, sha256(h) as payload_digest from p),
r as (select *, min(page_id) over (partition by payload_digest) as first from q)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and first <> page_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and first <> page_id then first end as refers_to from r
"""
