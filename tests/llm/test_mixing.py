import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chainlens.llm.mixing import mix_sources, word_count

from . import fixtures as fx


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Reshare the excess by weight until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total = share * sum(sizes.values())
    out, open_ = {}, set(names)
    while open_:
        left = total - sum(out.values())
        now = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if now[s] > cap * sizes[s]}
        if not over:
            out.update(now)
            break
        out.update({s: cap * sizes[s] for s in over})
        open_ -= over
    return out


def checked(data, got, near=0.02):
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += len(fx.words(t))
    want = targets(sizes)
    assert len(got) == len(data)
    taken = defaultdict(int)
    source = defaultdict(set)
    for i, t, s in data:
        source[i].add((s, len(fx.words(t))))
    for r in got:
        s = next(s for s, n in source[r.doc_id] if n == r.size and sizes[s] == r.source_size
                 and abs(want[s] - r.target) < 1e-6 * max(1, want[s]))
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(near * want[s], 20), (s, taken[s], want[s])


def test_targets_and_bounds(spark):
    rng = random.Random(8)
    data = [(i, fx.prose(rng, rng.randrange(0, 300)), rng.choice(["a", "b", "c", "É", None, "hot", "hot"]))
            for i in range(400)]
    data += [(10_000 + i, "same text here", "hot") for i in range(300)] + [(20_000, "tiny", "z"), (20_001, None, "zero")]
    got = mix_sources(fx.frame(spark, data)).collect()
    checked(data, got)
    again = mix_sources(fx.frame(spark, data).repartition(17)).collect()  # other partitions, same result
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_awkward_rows(spark):
    data = fx.rows()
    # one text of 20,000 words is a source of its own, capped or not by its weight
    got = mix_sources(fx.frame(spark, data)).collect()
    assert len(got) == len(data) and all(r.taken <= 2 * r.size for r in got)
    assert mix_sources(fx.frame(spark, [])).count() == 0
    empty = mix_sources(fx.frame(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r.size, r.taken) for r in empty] == [(0, 0)] * 2


def test_carry_keeps_the_row(spark):
    data = fx.rows()
    df = fx.frame(spark, data)
    rows = mix_sources(df, carry=True).select("row.*")
    assert rows.columns == df.columns and rows.exceptAll(df).count() == 0 and df.exceptAll(rows).count() == 0


@pytest.mark.parametrize("text", ["", " a  b\tc\n", "a b", "\x0b\x0cé \x1c"])
def test_word_count(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(word_count(F.col("t"))).first()[0]
    assert got == len(fx.words(text))


def test_duals_converge_without_newton(spark, monkeypatch):
    """What Newton steps leave open is bisected to the same rates."""
    from chainlens.llm import mixing

    want = fx.collected(mixing.mix_sources(fx.frame(spark, fx.rows())), "doc_id", "size", "target", "taken")
    monkeypatch.setattr(mixing, "NEWTON_STEPS", 0)
    got = fx.collected(mixing.mix_sources(fx.frame(spark, fx.rows())), "doc_id", "size", "target", "taken")
    assert got == want


def test_rows_without_ids_are_dealt_to_many_slices(spark):
    """A third of the rows under NULL and a third under one id: each window holds a small part, and reruns agree."""
    from chainlens.llm import mixing

    rng = random.Random(12)
    data = [((None, 7, i)[i % 3], " ".join(f"w{rng.randrange(10**6)}" for _ in range(20)), "a") for i in range(3000)]
    df = fx.frame(spark, data)
    a, b = (fx.collected(mixing.mix_sources(d, carry=True).select("row.text", "copies"), "text", "copies")
            for d in (df, df.repartition(2)))
    assert a == b  # which text is repeated doesn't depend on the partitions
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(mixing.SLICES))
    assert df.groupBy(h).count().agg(F.max("count")).first()[0] <= 40
