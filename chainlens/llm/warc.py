"""WARC archives: write captures, read the archives back, assemble transactions.

Writing: every page becomes a request, a response (or revisit) and a metadata record, the first and
the last naming the middle one in ``WARC-Concurrent-To``.  A record without its closing CRLF CRLF
is a string, so Spark's text writer with that line separator writes valid archives to any store.
Of captures with one payload, that with the largest id is the response and the others revisit it.

Reading: archives are parsed record by record in the tasks; digests are recomputed from the payload
bytes.  Transactions are then joined through the concurrent-to identifiers into one nested row per
capture, and revisits through ``WARC-Refers-To`` to the response whose payload they stand for.

Defined results: a NULL payload is empty, a NULL url has no ``WARC-Target-URI``, line breaks in a
url are percent-encoded; captures with NULL ids are written like others (the largest non-NULL id of
a payload is its response; a payload without any id is a response in all its rows); rows repeated
with one id and payload are all responses or all revisits; an empty table makes archives without
records; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.llm.common import shared_path, ship, text_or_empty, written

_END = "\r\n\r\n"
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def with_sha1_base32(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the bare upper-case base32 SHA-1 of a string column: 4 x 40 bits, 8 letters of 5 bits each.

    In steps of their own, so that each hash and number is computed once a row; and never NULL by its
    type, so that a join on it needs no NULL filter, which would compute it again.
    """
    parts = {f"_p{g}": F.conv(F.substring("_hex", 10 * g + 1, 10), 16, 10).cast("long") for g in range(4)}
    letters = [F.substr(F.lit(_B32), (F.shiftright(f"_p{g}", 35 - 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
               for g in range(4) for i in range(8)]
    return (df.withColumn("_hex", F.sha1(text)).withColumns(parts).withColumn(out, F.coalesce(F.concat(*letters), F.lit("")))
            .drop("_hex", *parts))


def _record_id(kind: str):
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(F.col("page").cast("string"), F.lit("")), "digest",
                          F.coalesce("url", F.lit(""))))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"),
                    F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12),
                    F.lit(">"))


def _record(headers: list, block):
    """A record's text from ``(name, value column or text)``; NULL values leave their header out."""
    lines = [F.lit("WARC/1.1\r\n")]
    for name, value in headers:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit("")))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_END), block)


#: (largest payload, records of a file): 10,000 captures of 32 KB, or as many bytes of larger ones; a payload above
#: the last bound is alone in its file
SIZE_CLASSES = ((32 << 10, 30_000), (1 << 20, 960), (32 << 20, 30), (None, 3))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", records_per_file: int = 30_000) -> None:
    """Write gzip-compressed archives to ``path``; payloads below ``min_bytes`` are never revisited."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page"),
        F.regexp_replace(F.regexp_replace(F.col(url_col).cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"),
        text_or_empty(payload_col).alias("payload"))
    rows = with_sha1_base32(rows, "payload", "digest").withColumn("size", F.octet_length("payload"))
    # the largest page of a payload is its response, whose record id is made from its own url; one combined
    # aggregate, so a payload that a third of the pages share is one row a task
    first = (rows.where((F.col("size") >= min_bytes) & F.col("page").isNotNull()).groupBy("digest", "size")
             .agg(F.max(F.struct("page", "url")).alias("top")).select("digest", "size", "top.*"))
    named = written(first.select("digest", "size", F.col("page").alias("response"),
                                 _record_id("response").alias("response_id")), "responses")
    rows = rows.join(named, ["digest", "size"], "left")
    revisit = F.col("response").isNotNull() & ~F.col("page").eqNullSafe(F.col("response"))
    rows = rows.withColumn("revisit", revisit).withColumn(
        "main_id", F.when(F.col("revisit"), _record_id("revisit")).otherwise(
            F.coalesce("response_id", _record_id("response"))))
    target = ("WARC-Target-URI", F.col("url"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest"))
    stamp = ("WARC-Date", date)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit(_END))
    get = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1" + _END))
    concurrent = ("WARC-Concurrent-To", F.col("main_id"))
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", _record_id("request")), stamp, target, concurrent,
                       ("Content-Type", "application/http;msgtype=request")], get)
    response = _record([("WARC-Type", "response"), ("WARC-Record-ID", F.col("main_id")), stamp, target, digest,
                        ("Content-Type", "application/http;msgtype=response")], F.concat(http, "payload"))
    again = _record([("WARC-Type", "revisit"), ("WARC-Record-ID", F.col("main_id")), stamp, target, digest,
                     ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                     ("WARC-Refers-To", F.col("response_id")),
                     ("Content-Type", "application/http;msgtype=response")], http)
    fields = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page").cast("string"), F.lit("\r\n")), F.lit("")),
                      F.lit("payload-bytes: "), F.col("size").cast("string"), F.lit("\r\n"))
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _record_id("metadata")), stamp, target,
                        concurrent, ("Content-Type", "application/warc-fields")], fields)
    # payloads of one size class go to files of their own, so that a file is bounded by its bytes, too
    size_class = F.size(F.filter(F.array(*[F.lit(most) for most, _ in SIZE_CLASSES[:-1]]), lambda m: F.col("size") > m))
    found = sorted(r[0] for r in pages.select(F.octet_length(text_or_empty(payload_col)).alias("size"))
                   .select(size_class.alias("c")).distinct().collect())  # at most the classes
    fs_path = pages.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    fs_path.getFileSystem(pages.sparkSession._jsc.hadoopConfiguration()).delete(fs_path, True)  # archives of an earlier write
    for c in found or [0]:
        (rows.where(size_class == c)
         .select(F.explode(F.array(request, F.when(F.col("revisit"), again).otherwise(response), metadata)))
         .write.mode("overwrite").option("lineSep", _END).option("compression", "gzip")
         .option("maxRecordsPerFile", min(records_per_file, SIZE_CLASSES[c][1])).text(f"{path}/payloads-{c}"))


_RECORDS = ("type string, record_id string, concurrent_to string, refers_to string, target_uri string, "
            "fields string, payload_bytes bigint, payload_digest string, declared_digest string, payload binary")
_SCHEMA = pa.schema([(c.split()[0], {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[c.split()[1]])
                     for c in _RECORDS.split(", ")])


def parse_warc(stream):
    """``(headers, block)`` of every record of an uncompressed archive stream."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(size := int(headers["content-length"]))
        if len(block) != size:
            raise ValueError("a WARC record ends before its length")
        yield headers, block


def _parsed(payloads: bool):
    def rows(batches):
        out, held = [], 0
        for b in batches:
            for content in b.column("content"):
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as f:
                    for h, block in parse_warc(io.BufferedReader(f, 1 << 20)):
                        row = {"type": h["warc-type"], "record_id": h["warc-record-id"],
                               "concurrent_to": h.get("warc-concurrent-to"), "refers_to": h.get("warc-refers-to"),
                               "target_uri": h.get("warc-target-uri"),
                               "declared_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None}
                        if row["type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            row["payload_bytes"] = len(payload)
                            row["payload_digest"] = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            if row["payload_digest"] != row["declared_digest"]:
                                raise ValueError(f"payload digest of {row['record_id']} differs")
                            if payloads:
                                row["payload"] = payload
                                held += len(payload)
                        elif row["type"] != "revisit":
                            row["fields"] = block.decode("utf-8", "replace")
                        out.append(row)
                        if len(out) >= 5000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
                            out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return rows


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record of the archives below ``path``; payload bytes only on demand."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(_parsed(payloads), _RECORDS)


def assemble_transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture (response or revisit record) of :func:`read_warc`'s rows.

    ``page_id``, ``record_type``, ``payload_bytes``, ``payload_digest``, ``refers_to`` (the page id of
    the response a revisit stands for), ``capture`` (record id, target, payload), ``request`` and
    ``metadata`` (record id and text; NULL where the archive has none).
    """
    def companion(kind):
        return (records.where(F.col("type") == kind).groupBy(F.col("concurrent_to").alias("main"))
                .agg(F.max(F.struct("record_id", "fields")).alias(kind)))

    captures = (records.where(F.col("type").isin("response", "revisit"))
                .join(companion("request"), F.col("record_id") == F.col("main"), "left").drop("main")
                .join(companion("metadata"), F.col("record_id") == F.col("main"), "left").drop("main"))
    page = F.regexp_extract("metadata.fields", "(?m)^page-id: (-?[0-9]+)", 1)
    captures = captures.withColumn("page_id", F.when(page != "", page.cast("long")))
    responses = (captures.where("type = 'response'").groupBy(F.col("record_id").alias("_id"))
                 .agg(F.max("page_id").alias("_page"), F.max("payload_bytes").alias("_bytes"),
                      F.max("payload_digest").alias("_digest")))
    # a response looks itself up, so that captures without a reference don't meet under one NULL key
    return (captures.join(responses, F.coalesce("refers_to", "record_id") == F.col("_id"), "left").select(
        "page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "_digest").alias("payload_digest"), F.col("type").alias("record_type"),
        F.when(F.col("type") == "revisit", F.col("_page")).alias("refers_to"), F.struct("record_id", "target_uri", "payload").alias("capture"),
        "request", "metadata"))


def warc_round_trip(pages: DataFrame, path: str | None = None, **kw) -> DataFrame:
    """Write ``pages``, read the archives back and assemble them (without payloads)."""
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    write_warc(pages, path, **kw)
    return assemble_transactions(written(read_warc(spark, path), "records"))
