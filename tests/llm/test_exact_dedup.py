import hashlib
from collections import defaultdict

from chainlens.llm.exact_dedup import bucket_directory, exact_dedup

from . import fixtures as fx

COLS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def brute(data):
    groups = defaultdict(list)
    for i, t, _ in data:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_equals_brute_force(spark):
    data = fx.rows()
    for capacity in (1_000_000, 5, 1):  # one bucket, split buckets, one key a bucket
        assert fx.collected(exact_dedup(fx.frame(spark, data), capacity=capacity), *COLS) == brute(data)


def test_no_python_in_the_plan(spark):
    plan = exact_dedup(fx.frame(spark, fx.rows()))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_directory_splits_only_overfull_buckets(spark):
    keys = spark.createDataFrame([(k,) for k in [0, 1, 2, 3, -1, -2, 1 << 62]], "key long")
    found = {(r.depth, r.prefix): r.entries for r in bucket_directory(keys, 4).collect()}
    # the half of the negative keys fits at once; 0..3 and 2**62 need one bit more
    assert found == {(1, 1): 2, (2, 0): 4, (2, 1): 1}
    same = spark.createDataFrame([(5,)] * 9, "key long")
    assert [(r.depth, r.entries) for r in bucket_directory(same, 4).collect()] == [(63, 9)]


def test_lookups_go_through_the_directory(spark, monkeypatch):
    """The directory splits on ordinary tables, and a wrong one gives a wrong result."""
    from chainlens.llm import exact_dedup as x

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    depths = {r.bucket_depth for r in exact_dedup(docs).select("bucket_depth").distinct().collect()}
    assert min(depths) >= 4 and len(depths) > 1
    data = fx.rows()
    whole = x.bucket_directory

    def without_one(*a):
        found = whole(*a)
        first = found.orderBy("depth", "prefix").first()
        return found.where(f"not (depth = {first.depth} and prefix = {first.prefix})")

    monkeypatch.setattr(x, "bucket_directory", without_one)
    got = fx.collected(exact_dedup(fx.frame(spark, data), capacity=5), *COLS)
    assert 0 < len(got) < len(data) and set(got) < set(brute(data))


def test_empty_table(spark):
    assert exact_dedup(fx.frame(spark, [])).count() == 0
