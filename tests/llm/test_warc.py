import base64
import gzip
import hashlib
import io
import random

from pyspark.sql import functions as F

from chainlens.llm.warc import assemble_transactions, parse_warc, read_warc, warc_round_trip, write_warc

from . import fixtures as fx

SCHEMA = "page_id long, url string, html string, digest string, size long, page string"
PAGES = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, "<p>é</p>"), (4, "http://b", None),
         (5, "http://c", ""), (6, "http://a\r\nX: y", "x\r\n\r\nWARC/1.1\r\n\r\n"), (None, "http://n", "only null"),
         (None, "http://n", "<p>é</p>"), (7, "http://big", "z" * 300_000), (8, "http://t", "twice"),
         (8, "http://t", "twice")]


def frame(spark, pages):
    return spark.createDataFrame([(*p, None, None, None) for p in pages], SCHEMA).repartition(3)


def brute(pages, least=0):
    out = []
    for i, _, h in pages:
        body = (h or "").encode()
        same = [j for j, _, g in pages if (g or "") == (h or "")]
        top = max((j for j in same if j is not None), default=None)
        revisit = top is not None and i != top and len(body) >= least
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


COLS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_round_trip(spark):
    assert fx.collected(warc_round_trip(frame(spark, PAGES)), *COLS) == brute(PAGES)
    assert fx.collected(warc_round_trip(frame(spark, PAGES), min_bytes=6), *COLS) == brute(PAGES, 6)
    assert warc_round_trip(frame(spark, [])).count() == 0


def test_archives_are_valid_and_whole(spark, tmpdir_fresh):
    write_warc(frame(spark, PAGES), tmpdir_fresh, records_per_file=4)
    kinds, payloads = [], {}
    for f in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(tmpdir_fresh).select("content").collect():
        for headers, block in parse_warc(io.BytesIO(gzip.decompress(bytes(f.content)))):
            kinds.append(headers["warc-type"])
            if kinds[-1] == "response":
                payloads[headers["warc-record-id"]] = block.partition(b"\r\n\r\n")[2]
    n = len(PAGES)
    assert kinds.count("request") == kinds.count("metadata") == n == kinds.count("response") + kinds.count("revisit")
    assert set(payloads.values()) == {(h or "").encode() for _, _, h in PAGES}
    captures = assemble_transactions(read_warc(spark, tmpdir_fresh, payloads=True))
    assert captures.count() == n
    one = captures.where("page_id = 7").first()
    assert bytes(one.capture.payload) == b"z" * 300_000 and one.request.record_id and one.metadata.fields
    assert captures.where(F.col("request").isNull() | F.col("metadata").isNull()).count() == 0
    assert captures.where("page_id = 6").first().capture.target_uri == "http://a%0D%0AX: y"


def test_files_are_bounded_by_bytes(spark, tmpdir_fresh, monkeypatch):
    """Large payloads go to files of their own with few records; no capture is lost."""
    from chainlens.llm import warc

    monkeypatch.setattr(warc, "SIZE_CLASSES", ((1000, 30_000), (100_000, 6), (None, 3)))
    rng = random.Random(3)
    pages = [(i, f"http://a/{i}", "".join(rng.choice("abcdefgh") for _ in range(rng.choice([10, 1000, 1001, 60_000, 150_000]))))
             for i in range(60)]
    got = fx.collected(warc_round_trip(frame(spark, pages), tmpdir_fresh), *COLS)
    assert got == brute(pages)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(tmpdir_fresh).collect()
    sizes = [len(gzip.decompress(bytes(f.content))) for f in files]
    assert max(sizes) < 2 * 100_000 + 5000 and len(files) > 10
    # written again, nothing of the old archives is left
    assert fx.collected(warc_round_trip(frame(spark, pages[:5]), tmpdir_fresh), *COLS) == brute(pages[:5])
