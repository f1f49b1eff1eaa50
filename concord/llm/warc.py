"""WARC archives with revisit records, and their reader.

Headers (id, digest, size) are shuffled by payload digest; the smallest id of each digest is its original response, and
revisit rows are joined to it by digest. Only then are payloads joined to their decisions, by id and digest, so that no
group of copies meets in one task with its payloads. Archives are written by Spark's text writer, each row one complete
record with fresh headers and the record separator as line separator: lost tasks are rerun and committed as for any table.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, small_batches

CRLF = "\r\n"
FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")
CHUNK = 1 << 20
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def resolve(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """(id, digest, refers_to): the decision for each distinct (id, digest) that has a response elsewhere.

    Of records with equal payloads of at least min_bytes, the one with the smallest id is the response; a record of the
    same digest and another id revisits it. Null ids never become a response for others.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).cast("binary")
    heads = pages.select(F.col(f"`{id_col}`").alias("id"), F.sha2(payload, 256).alias("digest"), F.length(payload).cast("long").alias("size"))
    heads = durable(heads.where(F.col("size") >= min_bytes).groupBy("digest", "id").agg(F.count("*").alias("rows")))
    first = heads.groupBy("digest").agg(F.min("id").alias("refers_to"), F.sum("rows").alias("all")).where((F.col("all") > 1) & F.col("refers_to").isNotNull())
    return heads.join(first, "digest").select("id", "digest", "refers_to")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 100, records_per_file: int = 2000) -> None:
    """Writes one record per input row as gzipped WARC/1.1 files below path.

    Repeated rows of the response's id and payload: one stays the response, the others revisit it. Null payloads are
    empty; null urls have an empty target. Extra columns are ignored.
    """
    small_batches(pages.sparkSession)
    url = F.regexp_replace(F.coalesce(F.col(f"`{url_col}`"), F.lit("")), r"[\r\n]", " ")
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), url.alias("url"), payload.alias("body"))
    rows = rows.withColumn("digest", F.sha2(F.col("body").cast("binary"), 256)).withColumn("size", F.octet_length("body"))
    key = F.concat_ws(":", "digest", F.coalesce(F.col("id").cast("string"), F.lit("null"))).alias("key")
    known = durable(resolve(pages, id_col, payload_col, min_bytes).select(key, "refers_to"))
    own = F.coalesce(F.col("refers_to") == F.col("id"), F.lit(False))
    # payloads move once: rows of one key are together for the join and for settle()
    dealt = rows.select("*", key).repartition("key").join(known, "key", "left").withColumn("own", own).sortWithinPartitions("key")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key: the first of the response's own rows is the response."""
        last = None
        for batch in batches:
            revisit = []
            for mine, refers, digest in zip(batch.column("own").to_pylist(), batch.column("refers_to").to_pylist(), batch.column("digest").to_pylist(), strict=True):
                revisit.append(refers is not None and (not mine or last == digest))
                if mine:
                    last = digest
            yield batch.append_column("revisit", pa.array(revisit, pa.bool_()))

    kind = pages.schema[id_col].dataType.simpleString()
    dealt = dealt.select("id", "url", "body", "digest", "size", "refers_to", "own")
    done = dealt.mapInArrow(settle, f"id {kind}, url string, body string, digest string, size int, refers_to {kind}, own boolean, revisit boolean")
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    block = F.when(F.col("revisit"), HTTP).otherwise(F.concat(F.lit(HTTP), F.col("body")))
    fields = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("size")),
        F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
        F.lit(""),
    ]
    record = F.concat(F.concat_ws(CRLF, *fields), F.lit(CRLF), block)
    done.select(record.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an uncompressed archive; fields by lower-case name."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end]
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.decode().strip().lower(): v.decode() for k, v in FIELD.findall(head[head.index(b"\r\n") :])}
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, block
        at = end + 8 + size


def read(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(id, url, payload_bytes, payload_digest, record_type, refers_to, payload): every record of the archives below path.

    A response's size and digest are computed from the payload read, and must equal its headers; a revisit's come from
    its headers, and its payload is null. Files are read whole, so their size bounds memory (records_per_file).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                packed = content.as_py()
                data = zlib.decompress(packed, 31) if packed[:2] == b"\x1f\x8b" else packed
                del packed
                rows, held = [], 0
                for f, block in records(data):
                    revisit = f["warc-type"] == "revisit"
                    payload = None if revisit else block[block.index(b"\r\n\r\n") + 4 :]
                    size, digest = int(f["x-payload-length"]), f["warc-payload-digest"].partition(":")[2]
                    if payload is not None and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                        raise ValueError(f"the payload of {f['warc-record-id']} isn't what its headers say")
                    ids = [None if x is None or x == "<urn:x-page:null>" else x[12:-1] for x in (f["warc-record-id"], f.get("warc-refers-to"))]
                    rows.append((ids[0], f["warc-target-uri"], size, digest, f["warc-type"], ids[1], payload))
                    held += len(payload or b"") + 200
                    if held > 4 * CHUNK:
                        yield pack(rows)
                        rows, held = [], 0
                if rows:
                    yield pack(rows)

    names = ["id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    out = files.mapInArrow(run, "id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    return out.withColumn("id", F.col("id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))
