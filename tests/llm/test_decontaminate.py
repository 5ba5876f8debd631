import hashlib
import random
import re

import numpy as np
import pytest

from chainlens.llm.decontaminate import benchmark_spans, benchmark_verdicts
from chainlens.llm.fm_index import FmIndex, WaveletMatrix, suffix_array

from . import fixtures as fx

COLS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return PATTERN.findall((text or "").translate(fx.LOWER))


def brute(docs, bench, window=13):
    phrases = [(tuple(w[k:k + window]), i) for i, t in bench if (w := split(t))
               for k in range(max(1, len(w) - window + 1))]
    out = []
    for d, t, _ in docs:
        w = split(t)
        hit, items = set(), set()
        for p, i in phrases:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k:k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    items.add(i)
        own = sorted(str(i) for i in items if i is not None)
        out.append((d, len(w), len(hit), len(own), hashlib.sha256(",".join(own).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def tables(spark):
    rng = random.Random(2)
    docs = fx.rows()[:30] + fx.rows()[-14:-5]
    bench = [(k, fx.prose(rng, 30)) for k in range(8)] + [(8, "One, TWO three"), (9, None), (10, "!!"), (None, "zz yy"),
                                                          (11, fx.prose(rng, 13)), (8, "One, TWO three")]
    text = dict(bench)
    docs += [(7000, fx.prose(rng, 20) + " " + text[1] + " " + fx.prose(rng, 30), "a"),
             (7001, "start " + text[2].upper().replace(" ", ", ") + ".", "b"),
             (7002, " ".join(text[3].split()[5:18]) + " " + fx.prose(rng, 900), "b"),
             (7003, text[4] + " " + text[4] + " " + text[11], None), (7004, "one-two/three four ZZ-YY", "a"),
             (7005, " ".join(text[5].split()[5:17]), "b"), (7006, "é " + text[6], "x")]
    return docs, bench, fx.frame(spark, docs), spark.createDataFrame(bench, "item_id long, text string")


@pytest.mark.parametrize("options", [{}, {"block_rows": 40}, {"shard_words": 50}, {"window": 4}])
def test_equals_brute_force(spark, options):
    docs, bench, d, b = tables(spark)
    window = options.get("window", 13)
    assert fx.collected(benchmark_verdicts(d, b, **options), *COLS) == brute(docs, bench, window)


def test_spans_are_merged_and_located(spark):
    docs, bench, d, b = tables(spark)
    spans = {r.id: [tuple(s) for s in r.spans] for r in benchmark_spans(d, b).collect()}
    assert spans[7000] == [(20, 50)] and spans[7001] == [(1, 31)] and spans[7002] == [(0, 13)]
    assert spans[7003] == [(0, 73)] and spans[7005] == []


def test_empty_tables(spark):
    docs, bench, d, b = tables(spark)
    assert benchmark_verdicts(fx.frame(spark, []), b).count() == 0
    none = benchmark_verdicts(d, b.where("item_id = 9 or item_id = 10"))
    assert none.count() == len(docs) and none.where("contaminated or n_hit > 0 or n_items > 0").count() == 0


def test_fm_index():
    rng = np.random.default_rng(0)
    for sigma, n in ((1, 40), (3, 300), (50, 500)):
        text = rng.integers(0, sigma + 1, n)
        text[-1] = 0
        sa = suffix_array(text)
        runs = [text[i:].tolist() for i in range(n)]

        def key(i, text=text):
            # separators sort by position
            return [(s, i + k) if s == 0 else (s, 0) for k, s in enumerate(text[i:].tolist())]

        assert sa.tolist() == sorted(range(n), key=key)
        index = FmIndex(text, sigma)
        phrases = [runs[i][:k] for i in rng.integers(0, n, 60) for k in (1, 2, 5)]
        phrases = [p for p in phrases if p and 0 not in p] + [[sigma] * 9]
        lengths = np.array([len(p) for p in phrases])
        padded = np.zeros((len(phrases), lengths.max()), dtype=np.int64)
        for i, p in enumerate(phrases):
            padded[i, :len(p)] = p
        lo, hi = index.search(padded, lengths)
        for p, a, z in zip(phrases, lo, hi):
            want = [i for i in range(n) if runs[i][:len(p)] == p]
            assert sorted(index.locate(np.arange(a, z)).tolist()) == want
    seq = rng.integers(0, 9, 200)
    wavelet = WaveletMatrix(seq, 8)
    c, i = rng.integers(0, 9, 300), rng.integers(0, 201, 300)
    assert wavelet.rank(c, i).tolist() == [int((seq[:k] == x).sum()) for x, k in zip(c, i)]
