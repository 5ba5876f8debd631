import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chainlens.llm import language_id as li

from . import fixtures as fx

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, h long, lettered string, score string, lang_pred string, k_doc_id int"
ALPHABET = {"aa": "abcdefg ", "mm": "ijklmno ", "tt": "qrstuv é "}


def prose(rng, lang, n=80):
    return "".join(rng.choice(ALPHABET[lang]) for _ in range(n))


def frame(spark, data):
    return spark.createDataFrame([(i, t, g, 0, "l", "s", "p", 1) for i, t, g in data], SCHEMA).repartition(5)


def rows(n=150, seed=2):
    rng = random.Random(seed)
    return [(i, prose(rng, g), g) for i, g in ((i, rng.choice(sorted(ALPHABET))) for i in range(n))]


def is_held():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in li.language_id(docs, held_out=is_held(), train_rows=600).collect()}
    out = [r for r in docs.select("doc_id", "lang").collect() if held(r.doc_id)]
    assert {k for k, r in got.items() if r.held_out} == {r.doc_id for r in out}
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in out]) >= 0.98
    sure = [r for r in out if not got[r.doc_id].rejected]
    assert len(sure) >= 0.9 * len(out) and np.mean([got[r.doc_id].lang_pred == r.lang for r in sure]) >= 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_rows_and_labels_steer_nothing(spark):
    data = rows()
    other = [(i, t, "zz" if held(i) else g) for i, t, g in data]  # other labels on the held-out rows alone
    a = sorted(map(str, li.language_id(frame(spark, data), held_out=is_held(), epochs=3).collect()))
    assert a == sorted(map(str, li.language_id(frame(spark, other), held_out=is_held(), epochs=3).collect()))
    more = data + [(i, "abc " * 50, "mm") for i in range(5000, 5400) if held(i)]
    b = li.language_id(frame(spark, more).coalesce(1), held_out=is_held(), epochs=3).where("doc_id < 5000").collect()
    assert a == sorted(map(str, b))


def test_awkward_rows(spark):
    rng = random.Random(3)
    data = rows() + [(1000, None, "aa"), (1001, "", "aa"), (1002, " \t\n", "mm"), (1003, "123 !? 45", "mm"), (1004, "a", "aa"),
                     (1005, "é", None), (None, prose(rng, "aa"), "aa"), (None, None, None), (1006, prose(rng, "mm", 400000), "mm"),
                     (1007, "中", "aa"), (1008, "\U0001f600 —", "aa"), (1009, prose(rng, "aa", 1_500_000).replace(" ", "a"), "aa")]
    data += [data[0]] * 60
    got = li.language_id(frame(spark, data), held_out=is_held()).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    for i in (1000, 1001, 1002, 1003, 1008):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert by[1006].lang_pred == "mm" and by[1009].lang_pred == "aa" and by[1007].lang_pred in ALPHABET
    assert by[None].held_out is False
    assert li.language_id(frame(spark, [])).count() == 0
    unlabelled = li.language_id(frame(spark, [(i, t, None) for i, t, _ in data])).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}


@pytest.mark.parametrize("train_rows", [1, 7, 30])
def test_sample_is_bounded_and_even(spark, train_rows, monkeypatch):
    seen = {}

    def spy(df, name, *a):
        seen[name] = written(df, name, *a)
        return seen[name]

    written = li.written
    monkeypatch.setattr(li, "written", spy)
    data = rows(120) + [(None, "ab cd", "aa")] * 60 + [(7, "ab ce", "aa")] * 60  # a third under one id
    li.fit_language_model(frame(spark, data), F.lit(True), train_rows=train_rows, epochs=1)
    n = {r["lang"]: r["count"] for r in seen["language-features"].groupBy("lang").count().collect()}
    assert sum(n.values()) <= train_rows and max(n.values()) <= max(1, train_rows // 3)


def plain(text):
    """Buckets of all subwords, one by one."""
    low = [c if 97 <= c <= 122 or c > 127 else 32 for c in text.translate(fx.LOWER).encode()]
    low = [32, *low, 32]
    out = []
    for n, inner in ((3, 1), (4, 2)):
        for i in range(len(low) - n + 1):
            if all(c != 32 for c in low[i + 1:i + 1 + inner]):
                x = int.from_bytes(bytes(low[i:i + n]), "big")
                out.append((x * 2654435761 if n == 3 else (x ^ (x >> 15)) * 2246822519) % 2 ** 32 >> (32 - li.HASH_BITS))
    return out


def test_subwords_and_logits_equal_the_plain_form(monkeypatch):
    texts = ["Hello, wörld", "", "a", "?!", None, "bé " * 40, "x" * 90, "ab c"]
    monkeypatch.setattr(li, "_PIECE", 16)  # texts in several pieces
    rng = np.random.default_rng(5)
    table = rng.integers(-2 ** 30, 2 ** 30, (li.BUCKETS, 3))
    model = {"langs": ["p", "q", "r"], "table": table.astype("<i8").tobytes(), "bias": np.array([.1, .2, 0.]).tobytes(), "heat": 2.0}
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["n", "text"])
    got = pa.Table.from_batches(list(li._predictions(model)([batch]))).to_pylist()
    for text, r in zip(texts, got):
        ids = plain(text or "")
        z = (sum(table[i].astype(object) for i in ids) / 2.0 ** 24 / max(1, len(ids)) if ids else np.zeros(3)) + [.1, .2, 0.]
        p = np.exp((z - max(z)).astype(float) / 2.0)
        p /= p.sum()
        assert r["lang_pred"] == "pqr"[int(p.argmax())] and abs(r["score"] - p.max()) < 1e-9
    feature = pa.RecordBatch.from_arrays([pa.array(["p"] * 8), pa.array(range(8)), pa.array(texts)], ["lang", "h", "text"])
    for r in pa.Table.from_batches(list(li._feature_rows([feature]))).to_pylist():
        ids, n = np.unique(plain(texts[r["h"]]), return_counts=True)
        assert np.array_equal(np.frombuffer(r["idx"], "<i4"), ids)
        assert np.allclose(np.frombuffer(r["val"], "<f4"), n / n.sum())


def test_calibration():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 3000)
    z = rng.normal(size=(3000, 3))
    z[np.arange(3000), y] += 2.0
    heat, _ = li.calibrate(z * 7, y, 0.05)
    p = li._softmax(z * 7 / heat)
    right = p.argmax(axis=1) == y
    assert abs(p.max(axis=1).mean() - right.mean()) < 0.03  # confidence equals accuracy
    _, limit = li.calibrate(z * 7, y, 0.05)
    accepted = p.max(axis=1) >= limit
    assert 0.94 <= right[accepted].mean() and accepted.mean() > 0.3
    assert li.calibrate(np.zeros((0, 3)), np.zeros(0, dtype=int), 0.05) == (1.0, 0.0)
