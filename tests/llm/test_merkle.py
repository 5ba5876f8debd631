import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from chainlens.llm import merkle as m

from . import fixtures as fx

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, leaf string, path string, place int"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def up(level):
    return [H("".join(level[i:i + 8])) for i in range(0, len(level), 8)]


def tree(leaves):
    """Root, and each leaf's siblings level by level as (left, right)."""
    path, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, p in enumerate(at):
            run = level[p - p % 8:p - p % 8 + 8]
            path[k].append((run[:p % 8], run[p % 8 + 1:]))
        level, at = up(level), [p // 8 for p in at]
    return level[0], path


def brute(data):
    langs = sorted({r[2] for r in data}, key=lambda v: (v is not None, (v or "").encode()))
    groups = {g: sorted((r for r in data if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    subs = {g: tree([leaf(r) for r in groups[g]]) for g in langs}
    root, top = tree([subs[g][0] for g in langs])
    out = []
    for g, above in zip(langs, top):
        for r, inside in zip(groups[g], subs[g][1]):
            path = inside + above
            node = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                node = leaf((r[0], None if r[1] is None else r[1].translate(fx.LOWER), *r[2:]))
            for left, right in path:
                node = H("".join([*left, node, *right]))
            out.append((r[0], leaf(r), subs[g][0], root, H("".join(h for a, b in path for h in a + b)), node, node == root))
    return sorted(map(str, out))


def run(spark, data, parts=6):
    df = spark.createDataFrame([(*r, "t", "l", "p", 1) for r in data], SCHEMA).repartition(parts)
    out = m.manifest(df, tampered=F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    return sorted(str(tuple(r)) for r in out.collect())


def docs(n, langs, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(10 ** 6), rng.choice(["Text é ", "lower "]) * rng.randrange(9), rng.choice(langs),
             rng.choice(["a", None, "ü"]), rng.choice([None, 7, 12345678901])) for _ in range(n)]


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (2, ["en", None]), (8, ["en"]), (9, ["en"]), (64, ["x"]), (65, ["x"]),
                                      (513, ["en"]), (700, ["en", "en", "en", "de", None, ""]), (4200, ["en", "fr"])])
def test_brute_force(spark, n, langs):
    data = docs(n, langs)
    assert run(spark, data) == brute(data)


def test_awkward_rows(spark):
    data = docs(40, ["en", None, "é", "Z", "a"])
    data += [(None, "A", "en", None, None)] * 30 + [(3, "B", "en", "s", 1)] * 30  # a third under one id, repeated rows
    data += [(5, None, None, None, None), (5, "", "en", "", 0), (6, "Lang " * 20000, "en", "s", 1), (None, None, None, None, None)]
    assert run(spark, data) == brute(data) == run(spark, data, 1)


def test_many_groups(spark):
    """Each group a tree of one leaf: the tree of their roots carries all."""
    data = [(i, "T", f"g{i}", None, None) for i in range(600)]
    assert run(spark, data) == brute(data)


def test_empty(spark):
    assert run(spark, []) == []


def test_blocks_and_stored_levels(spark):
    """A stored row holds at most 512 nodes, and only every ``STRIDE``-th level is stored."""
    data = docs(1000, ["en"]) + docs(300, ["de"])
    leaves = spark.createDataFrame([(r[2], r[0], leaf(r)) for r in data], "tree string, id long, leaf string")
    stored = m.build(m.numbered(leaves, ["id"]), ["id"])
    assert [s.selectExpr("max(size(members)) n").first().n for s in stored] == [512, 2]
    assert stored[1].selectExpr("sum(size(members)) n").first().n == 3  # two nodes of en, one of de


def test_one_changed_byte_is_found(spark):
    data = docs(300, ["en", "de"])
    good = {r[1]: r for r in map(eval, run(spark, data))}
    data[17] = (data[17][0], data[17][1] + "!", *data[17][2:])
    other = list(map(eval, run(spark, data)))
    assert {r[3] for r in other} != {r[3] for r in good.values()}
    assert sum(r[1] not in good for r in other) == 1
