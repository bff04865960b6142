"""Operator 6: WARC archives with revisit records.

Headers alone (id, size, SHA-1 of the payload) are shuffled by digest to find each digest's original, the largest id
among the rows with that payload; the decision then joins the pages by id, and records are written with fresh headers:
a response with its payload, or a revisit that names the original and carries no payload.  Archives are written by
Spark's own text writer, one file or more a partition, gzip, with the record separator of the format (two line ends) as line
separator, so task retries and lost executors follow Spark's commit protocol and any file system of Spark's will do.

``read_archive`` streams the files back by the length that each record states, and ``resolve`` joins revisits to the
responses that they refer to, recomputing the digest from the stored payload.

Defined results: null html is an empty payload; very long ones are written and read whole; payloads below ``LEAST``
bytes are always responses; ties can't occur among ids (the largest is the original); rows that repeat
an id keep a record each (of equal ids with equal payload one is the original); a null id is written as an empty one
and read back as null; line ends and other controls in urls are percent-encoded; null urls are written as an empty
target; other columns, whatever their names, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path

LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
#: Bytes of payload that a file holds on average before compression.
FILE_BYTES = 32_000_000
READ = 1 << 20


def decisions(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, payload_bytes, digest, copy, refers_to (null: a response) of every row; copy tells equal ids apart."""
    payload = F.coalesce("html", F.lit(""))
    heads = pages.select("page_id", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(F.encode(payload, "UTF-8")).alias("digest"))
    large = heads.where(F.col("payload_bytes") >= least)
    # only digests of several rows are kept for the join
    several = large.groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = heads.join(several, "digest", "left")
    refers = F.when((F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))
    return joined.select("page_id", "payload_bytes", "digest", refers.alias("refers_to"))


def records(pages: DataFrame, least: int = LEAST, date: str = DATE) -> DataFrame:
    """record: the text of each page's record, without the two line ends that close it."""
    chosen = decisions(pages, least).where("refers_to IS NOT NULL").select(F.col("page_id").alias("id"), F.col("digest").alias("found"), "refers_to").distinct()
    payload = F.coalesce("html", F.lit(""))
    base = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.sha1(F.encode(payload, "UTF-8")).alias("digest"))
    joined = base.join(chosen, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("found")), "left")
    # repeats of the original's own id and payload stay responses
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    target = F.expr(r"regexp_replace(regexp_replace(regexp_replace(url, '\r', '%0D'), '\n', '%0A'), '[\\x00-\\x20\\x7f]', '%20')")
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:x-page:"),
        page,
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        target,
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:x-page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return joined.select(F.concat(head, body).alias("record"))


def write_archive(pages: DataFrame, path: str, least: int = LEAST, date: str = DATE) -> None:
    """WARC files (gzip) of all pages below ``path``, cut at so many records that a file's size is bounded on average.

    Records are written where the join left them; dealing payloads out once more would only cost a shuffle.
    """
    size, n = pages.agg(F.sum(F.octet_length("html")), F.count("*")).collect()[0]
    most = max(1, FILE_BYTES * n // max(size or 0, 1)) if n else 1
    records(pages, least, date).write.option("compression", "gzip").option("maxRecordsPerFile", min(most, 1_000_000)).option("lineSep", "\r\n\r\n").text(path)


def _inflated(content: bytes) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, piece by piece."""
    data = memoryview(content)
    while len(data):
        unzip, at = zlib.decompressobj(31), 0
        while not unzip.eof and at < len(data):
            yield unzip.decompress(data[at : at + READ])
            at += READ
        data = data[at - len(unzip.unused_data) :] if unzip.eof and unzip.unused_data else data[at:]


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a gzip WARC file."""
    pieces, held = _inflated(content), bytearray()

    def need(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        size = 4096
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not need(size):
                end = held.find(b"\r\n\r\n")
                break
            size = len(held) + READ
        if end < 0:
            if bytes(held).strip():
                raise ValueError("a record is cut off")
            return
        lines = bytes(held[:end]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(headers["content-length"])
        if not need(end + 4 + length):
            raise ValueError("a record is cut off")
        block = bytes(held[end + 4 : end + 4 + length])
        need(end + 8 + length)
        del held[: end + 8 + length]
        yield headers, block


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, digest (as stated), refers_to, target, payload of every record."""

    names = ["page_id", "record_type", "digest", "refers_to", "target", "payload"]
    schema = pa.schema([(n, pa.binary() if n == "payload" else pa.string()) for n in names])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for headers, block in parse(content.as_buffer()):
                    page, refers = (headers.get(k, "")[len("<urn:x-page:") : -1] for k in ("warc-record-id", "warc-refers-to"))
                    payload = block.partition(b"\r\n\r\n")[2]
                    rows.append((page or None, headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:"), refers or None, headers["warc-target-uri"], payload))
                    size += len(payload)
                    if size > 4 * READ:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    found = files.mapInArrow(run, "page_id string, record_type string, digest string, refers_to string, target string, payload binary")
    return found.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def resolve(archive: DataFrame) -> DataFrame:
    """A row a record: size and digest of the full payload, a revisit's taken from the response that it refers to."""
    heads = archive.select("page_id", "record_type", "refers_to", F.col("digest").alias("stated"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    responses = heads.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest")
    revisits = heads.where("record_type = 'revisit'").select("page_id", "refers_to", "stated")
    # equal ids may have several responses: the stated digest tells which
    originals = responses.select(F.col("page_id").alias("refers_to"), "payload_bytes", F.col("payload_digest").alias("stated")).join(revisits.select("refers_to", "stated").distinct(), ["refers_to", "stated"], "left_semi").distinct()
    joined = revisits.join(originals, ["refers_to", "stated"], "left")
    missing = F.raise_error(F.lit("a revisit without its response"))
    found = joined.select("page_id", F.when(F.col("payload_bytes").isNull(), missing.cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.col("stated").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to")
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(found)


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return resolve(read_archive(spark, path))
