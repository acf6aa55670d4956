"""WARC archives: written in one gzip stream, normalised to a member for each record, read by index.

Some crawlers compress a whole archive as one gzip stream, which can only be read from
its start. The normaliser inflates such a file once, as a stream, compresses each record as a
member of its own, and writes offsets and lengths to a sidecar index, after which any record can be
read alone. Records keep their order; their inflated bytes do not change.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm.common import arrow_map, stage, utf8
from coppice.session import new_path

#: Payloads from this size on are replaced by a revisit record if an equal one is kept.
LEAST_REVISIT = 1000
#: Inflated bytes taken from a stream at a time.
CHUNK = 1 << 20
#: Records in one archive file at most.
RECORDS_PER_FILE = 2_000
GZIP = 16 + zlib.MAX_WBITS
INDEX = "file string, seq long, offset long, length long, record_id string, warc_type string"


def _record(page_id: Column, url: Column, refers_to: Column, payload: Column, digest: Column) -> Column:
    """The bytes of a record without the two line breaks behind it."""
    revisit = refers_to.isNotNull()
    body = F.when(revisit, F.lit(b"").cast("binary")).otherwise(payload)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    # a line break in a header value would end the header
    target = F.regexp_replace(text(url), "[\\x00-\\x1f\\x7f]", " ")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), text(page_id),
        F.lit(">\r\nWARC-Target-URI: "), target,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), digest,
        F.lit("\r\nWARC-Payload-Length: "), F.octet_length(payload).cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), text(refers_to), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body)


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> None:
    """Write a record for each row to ``path``, each file one gzip stream.

    Among records with equal payloads of at least ``LEAST_REVISIT`` bytes that with the largest
    id is a response; the others are revisits that name it. Rows that share that id are responses, all of them. A null
    payload is empty. A null id is smaller than any; records with nothing but null ids are
    responses. Spark's writer commits the files, so a lost executor leaves no part of one.
    """
    payload = utf8(payload_col)
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest")
    )
    large = rows.filter(F.octet_length("payload") >= LEAST_REVISIT).select("id", "digest")
    kept = large.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    kept = stage(kept.drop("n"), "kept-payloads")  # joined from a table, a payload that many pages share can be split
    revisits = large.join(kept, "digest").filter(~F.col("id").eqNullSafe(F.col("refers_to")))
    revisits = revisits.select(
        F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to"
    ).distinct()
    same = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest"))
    joined = rows.join(revisits, same, "left")
    record = _record(F.col("id"), F.col("url"), F.col("refers_to"), F.col("payload"), F.col("digest"))
    # a string column may hold any bytes; the text writer puts them out as they are
    joined.select(record.cast("string").alias("value")).write.option("compression", "gzip").option(
        "lineSep", "\r\n\r\n"
    ).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class _Inflated:
    """Reads a gzip file of one or more members as one stream."""

    def __init__(self, data: bytes):
        self.rest, self.stream, self.buffer, self.at = memoryview(data), zlib.decompressobj(GZIP), bytearray(), 0

    def _more(self) -> bool:
        while len(self.rest):
            piece, self.rest = self.rest[:CHUNK], self.rest[CHUNK:]
            out = self.stream.decompress(piece)
            while self.stream.unused_data:  # the next member
                again = self.stream.unused_data
                self.stream = zlib.decompressobj(GZIP)
                out += self.stream.decompress(again)
            if out:
                del self.buffer[: self.at]
                self.at = 0
                self.buffer += out
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        seen = self.at
        while (end := self.buffer.find(mark, max(self.at, seen))) < 0:
            back = len(self.buffer) - self.at
            if not self._more():
                if self.buffer[self.at :].strip():
                    raise ValueError("archive ends inside a header")
                return None
            seen = self.at + max(0, back - len(mark))
        found = bytes(self.buffer[self.at : end + len(mark)])
        self.at = end + len(mark)
        return found

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n:
            if not self._more():
                raise ValueError("archive ends inside a record")
        found = bytes(self.buffer[self.at : self.at + n])
        self.at += n
        return found


def header_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def records(data: bytes) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """(head, fields, body) of every record of a gzip file, inflated as a stream."""
    stream = _Inflated(data)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = header_fields(head)
        body = stream.take(int(fields["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield head, fields, body


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite every archive below ``source`` into ``target`` and return the staged sidecar index.

    ``file, seq, offset, length, record_id, warc_type``: a row for each record, in its member's place. A file has a
    name of its own for each attempt, and only files of the attempts that Spark commits are in
    the index. A task holds one compressed file, and one record, in memory. A damaged
    archive raises an error. No archives give an empty index.
    """

    def rewrite(batches):
        store, _ = pafs.FileSystem.from_uri(target)
        root = pafs.FileSystem.from_uri(target)[1]
        store.create_dir(root, recursive=True)
        for batch in batches:
            for data in batch.column(0):
                name = f"{uuid.uuid4().hex}.warc.gz"
                rows: list[tuple] = []
                offset = 0
                with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                    for head, fields, body in records(data.as_py()):
                        packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                        member = packer.compress(head + body + b"\r\n\r\n") + packer.flush()
                        out.write(member)
                        rows.append(
                            (name, len(rows), offset, len(member), fields["warc-record-id"], fields["warc-type"])
                        )
                        offset += len(member)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[k] for r in rows], kind)
                        for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))
                    ],
                    names=["file", "seq", "offset", "length", "record_id", "warc_type"],
                )

    # one row is one file: small batches bound what a task holds
    files = spark.read.format("binaryFile").load(source).select("content")
    return stage(arrow_map(files, rewrite, INDEX), "warc-index")


def read_records(index: DataFrame, target: str) -> DataFrame:
    """``record_id, warc_type, digest, payload_length, refers_to, body`` of every record in ``index``.

    Each record is read by its offset and inflated alone. The records of a file are read in one task.
    """

    def fetch(batches):
        store, root = pafs.FileSystem.from_uri(target)
        opened, file = None, None
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for name, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if name != opened:
                    if file:
                        file.close()
                    file, opened = store.open_input_file(f"{root}/{name}"), name
                file.seek(offset)
                head, fields, body = next(records(file.read(length)))
                refers = fields.get("warc-refers-to")
                if refers is None and hashlib.sha1(body).hexdigest() != fields["warc-payload-digest"].removeprefix("sha1:"):
                    raise ValueError(f"the payload of {fields['warc-record-id']} is not what was written")
                out.append(
                    (
                        fields["warc-record-id"], fields["warc-type"], fields["warc-payload-digest"],
                        int(fields["warc-payload-length"]), refers, body,
                    )
                )
                size += len(body)
                if size > 16 << 20:
                    yield _fetched(out)
                    out, size = [], 0
            yield _fetched(out)
        if file:
            file.close()

    # a number of its own: by size alone a small index would make one task of all its files
    files = max(1, index.select("file").distinct().count())
    ordered = index.select("file", "offset", "length").repartition(files, "file").sortWithinPartitions("file", "offset")
    return arrow_map(
        ordered, fetch, "record_id string, warc_type string, digest string, payload_length long, refers_to string, body binary"
    )


def _fetched(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    names = ["record_id", "warc_type", "digest", "payload_length", "refers_to", "body"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def page_number(column: str | Column, kind: str) -> Column:
    """The id inside ``<urn:page:...>`` in its own type; null if it is empty."""
    return F.regexp_extract(column, "^<urn:page:(.*)>$", 1).try_cast(kind)


def archive_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> tuple[DataFrame, DataFrame, str]:
    """Write archives, normalise them, and read them back: (records, index, folder of the archives)."""
    spark = pages.sparkSession
    mono, target = new_path(spark, "warc-stream"), new_path(spark, "warc")
    if "://" not in target and not target.startswith("file:"):
        target = f"file://{target}"
    write_archives(pages, mono, id_col, url_col, payload_col)
    index = normalise(spark, mono, target)
    return read_records(index, target), index, target
