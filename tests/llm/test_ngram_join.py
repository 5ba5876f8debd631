from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from chainlens.llm import common
from chainlens.llm.components import connected_components
from chainlens.llm.ngram_join import ngram_jaccard_classes

from . import fixtures as fx


def shingles(text):
    w = fx.words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(data, percent=80):
    """Component of every text with words: smallest id over rows linked by equal or similar sets."""
    nodes = [(i, shingles(t)) for i, t, _ in data if i is not None]
    parent = list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            s, t = nodes[a][1], nodes[b][1]
            k = len(s & t)
            if k and 100 * k >= percent * (len(s) + len(t) - k):
                parent[find(a)] = find(b)
    low = defaultdict(lambda: 10**9)
    for k, (i, _) in enumerate(nodes):
        low[find(k)] = min(low[find(k)], i)
    return sorted((i, len(s), low[find(k)] if s else i) for k, (i, s) in enumerate(nodes))


@pytest.mark.parametrize("seed", [3, 4])
def test_equals_brute_force(spark, seed):
    data = fx.rows(seed)
    got = ngram_jaccard_classes(fx.frame(spark, data)).collect()
    assert sorted(tuple(r)[:3] for r in got if r.doc_id is not None) == brute(data)
    nulls = [r for r in got if r.doc_id is None]
    assert len(nulls) == 2 and all(r.component_id is None for r in nulls)


def test_near_copies_passages_and_chains(spark):
    """A large group of near copies, a hot passage in different texts, and a chain that only links link by link."""
    import random

    rng = random.Random(9)
    base, passage = fx.prose(rng, 150, 10**6), fx.prose(rng, 60, 10**6)
    data = [(i, fx.edited(rng, base, 1), "a") for i in range(150)]
    data += [(1000 + i, fx.prose(rng, 70, 10**6) + " " + passage, "a") for i in range(80)]
    data += [(2000 + i, fx.prose(rng, 8, 10**6) + " " + passage + " " + passage, "a") for i in range(20)]
    w = base.split()
    for i in range(30):  # each step replaces two words more
        w[5 * i] = f"c{i}"
        data.append((3000 + i, " ".join(w), "a"))
    got = ngram_jaccard_classes(fx.frame(spark, data)).collect()
    assert sorted(tuple(r)[:3] for r in got) == brute(data)


def test_prefixes_go_once_they_are_read(spark):
    """The matrix and the product, the largest tables, don't lie beside those that the join makes of them."""
    from pathlib import Path

    from chainlens.llm.common import shared_path

    folder = Path(shared_path(spark, "x").removeprefix("file:")).parent
    tables = lambda: {p for k in ("matrix", "product") for p in folder.glob(f"{k}-*")}
    before = tables()
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, text + " more"), (3, "alone here")], "doc_id long, text string")
    got = ngram_jaccard_classes(df)
    assert tables() == before
    assert {r.doc_id: r.component_id for r in got.collect()} == {1: 1, 2: 1, 3: 3}


def test_empty_table(spark):
    out = ngram_jaccard_classes(fx.frame(spark, []))
    assert out.columns[:3] == ["doc_id", "n_shingles", "component_id"] and out.count() == 0


def test_fingerprints_tell_words_apart():
    texts = ["A b c", None, "", "x" * 70000 + " y", "x" * 70001, " lead", "tail ", "a b é É"]
    seen, k = {}, 0
    for _, data, offsets in common.text_chunks(pa.array(texts * 3), 64):
        w, starts = common.word_fingerprints(data, offsets)
        for d in range(len(offsets) - 1):
            own = fx.words((texts * 3)[k])
            assert len(own) == starts[d + 1] - starts[d]
            for word, f in zip(own, w[starts[d]:starts[d + 1]]):
                assert seen.setdefault(word, f) == f
            k += 1
    assert k == 24 and len(set(seen.values())) == len(seen)


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 299)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert Counter(got.values()) == {0: 51, 100: 60, 299: 2}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefix_length_covers_every_similar_pair():
    from chainlens.llm.ngram_join import prefix_length

    for n in range(1, 60):
        assert prefix_length(n, 80) == n - int(np.ceil(n * 80 / 100)) + 1
