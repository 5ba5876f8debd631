import random

from chainlens.llm.substring_dedup import repeated_passages, tuned_bands, without_removals

from . import fixtures as fx


def test_bands():
    assert tuned_bands(80, 0.99) == 3 and tuned_bands(80, 0.99, 2) == 5 and tuned_bands(100, 0.99) == 1


def test_passages_are_found_and_clean_documents_left(spark):
    rng = random.Random(5)
    passage, near = fx.prose(rng, 58, 10**6), fx.prose(rng, 80, 10**6)
    line = fx.prose(rng, 9, 10**6)  # a short line that many share is no passage
    data = [(i, fx.prose(rng, 90, 10**6) + "\n" + line, "a") for i in range(20)]
    data += [(100 + i, f"{fx.prose(rng, 35, 10**6)} {passage} {fx.prose(rng, 40, 10**6)}", "a") for i in range(12)]
    # a paragraph with one word changed near its end
    other = near.split()
    other[-2] = "changed"
    data += [(200, fx.prose(rng, 30, 10**6) + "\n" + near, "a"),
             (201, " ".join(other) + "\n" + fx.prose(rng, 30, 10**6), "a")]
    data += [(None, passage, "a"), (300, None, "a"), (301, "", "a"), data[0]]
    got = repeated_passages(fx.frame(spark, data)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(data)
    assert all(by[i].removed_words == 0 and by[i].repeated_words == 0 for i in range(20))
    assert by[100].removed_words == 0 and by[100].repeated_words >= 20
    for i in range(101, 112):
        assert 100 in by[i].kept_in and set(by[i].kept_in) <= set(range(100, i))
        assert all(35 <= s.start and s.end <= 93 for s in by[i].removed)
    assert by[201].kept_in == [200] and by[201].removed_words == 80
    assert 100 in by[None].kept_in and by[300].removed == [] and by[301].n_words == 0
    text = {r.doc_id: r.text for r in without_removals(fx.frame(spark, data), spark.createDataFrame(
        got, repeated_passages(fx.frame(spark, [])).schema)).collect()}
    assert len(text[201].split()) == 30 and text[100] == dict((i, t) for i, t, _ in data)[100]


def test_a_changed_paragraph_is_found_by_its_bands(spark):
    """Paragraphs of 17 words that differ in the last one: Jaccard 12 / 14, no equal content."""
    from chainlens.llm import substring_dedup as s

    rng = random.Random(6)
    uncut = []
    while len(uncut) < 12:  # lines that have no cut inside
        t = fx.prose(rng, 16, 10**6)
        a, b = t + " one", t + " two"
        if all(s._units(*chunk(x))[3].tolist() == [0] for x in (a, b)):
            uncut.append((a, b))
    data = [(2 * i + k, pair[k], "a") for i, pair in enumerate(uncut) for k in (0, 1)]
    got = {r.doc_id: r for r in repeated_passages(fx.frame(spark, data), min_words=10).collect()}
    found = sum(got[2 * i + 1].kept_in == [2 * i] for i in range(12))
    assert found >= 11 and not any(got[2 * i].removed for i in range(12))


def test_lines_with_changes_inside_are_found(spark):
    """Line pairs of Jaccard 0.80 to 0.90 by brute force, with the query's parameters."""
    rng = random.Random(7)

    def shingles(text):
        w = text.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    pairs = []
    while len(pairs) < 100:
        n = rng.randrange(50, 151)
        w = fx.prose(rng, n, 10**6).split()
        v = list(w)
        for _ in range(rng.randrange(1, 4)):
            v[rng.randrange(6, n - 6)] = f"e{rng.randrange(10**6)}"
        a, b = " ".join(w), " ".join(v)
        j = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        if 0.8 <= j <= 0.9:
            pairs.append((a, b))
    data = [(2 * i + k, pair[k], "a") for i, pair in enumerate(pairs) for k in (0, 1)]
    got = {r.doc_id: r for r in repeated_passages(fx.frame(spark, data)).collect()}
    whole = sum(got[2 * i + 1].removed_words == got[2 * i + 1].n_words and got[2 * i + 1].kept_in == [2 * i]
                for i in range(len(pairs)))
    assert whole >= 0.9 * len(pairs) and not any(got[2 * i].removed for i in range(len(pairs)))


def test_small_lines_that_differ_at_their_end_are_found(spark):
    """Lists of 8- to 13-word lines with a word more at each end (Jaccard 4/5 to 9/10), or of 13 with another last word."""
    rng = random.Random(11)
    data = []
    for i in range(40):
        sizes = [rng.randrange(8, 14) for _ in range(6)] if i % 2 else [13] * 6
        lines = [fx.prose(rng, k, 10**6).split() for k in sizes]
        other = [v + ["more"] if i % 2 else v[:-1] + [f"e{rng.randrange(10**6)}"] for v in lines]
        data += [(2 * i + k, "\n".join(" ".join(v) for v in text), "a") for k, text in enumerate((lines, other))]
    got = {r.doc_id: r for r in repeated_passages(fx.frame(spark, data)).collect()}
    later = [got[2 * i + 1] for i in range(40)]
    assert sum(r.removed_words for r in later) >= 0.95 * sum(r.n_words for r in later)
    assert not any(got[2 * i].removed for i in range(40))


def test_passages_of_short_lines_are_found(spark):
    """Verse, lists and tables: 60 words in lines of 3 or 4, and lines of 15 and 3 words by turns."""
    rng = random.Random(9)

    def lines(sizes):
        return "\n".join(fx.prose(rng, k, 10**6) for k in sizes)

    passages = [lines([4] * 15), lines([3] * 20), lines([15, 3] * 4), lines([3, 15] * 4)]
    data = []
    for i, p in enumerate(passages):
        data += [(10 * i + k, f"{fx.prose(rng, 30, 10**6)}\n{p}\n{fx.prose(rng, 30, 10**6)}", "a") for k in (0, 1)]
    got = {r.doc_id: r for r in repeated_passages(fx.frame(spark, data)).collect()}
    for i, p in enumerate(passages):
        n = len(p.split())
        assert [(s.start, s.end) for s in got[10 * i + 1].removed] == [(30, 30 + n)]
        assert got[10 * i].removed == [] and got[10 * i + 1].kept_in == [10 * i]


def test_every_word_is_in_a_paragraph():
    from chainlens.llm import substring_dedup as s

    rng = random.Random(10)
    for _ in range(300):
        sizes = [rng.choice([1, 2, 4, 5, 9, 40]) for _ in range(rng.randrange(1, 12))]
        if sum(sizes) >= s.SHORTEST:
            _, _, _, first, end = s._units(*chunk("\n".join(fx.prose(rng, k, 10**6) for k in sizes)))
            inside = {w for a, z in zip(first.tolist(), end.tolist()) for w in range(a, z)}
            assert inside == set(range(sum(sizes))) and (end - first).min() >= s.SHORTEST


def test_sketches_leave_out_no_similar_pair(spark):
    """Sets of Jaccard >= 0.8 pass for certain; far ones hardly ever."""
    import numpy as np

    from chainlens.llm import substring_dedup as s

    rng = np.random.default_rng(8)
    rows = []
    for _ in range(300):
        n = int(rng.integers(4, 120))
        members = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        common = int(rng.integers(0, n + 1))
        x, y = members[:n], np.concatenate([members[:common], members[n:2 * n - common]])
        rows.append((s._parities(x).tolist(), s._parities(y).tolist(), common * 100 >= (2 * n - common) * 80,
                     common < n // 2))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, similar boolean, far boolean")
    got = df.select(s._close(80)(df.a, df.b).alias("passes"), "similar", "far").collect()
    assert all(r.passes for r in got if r.similar) and any(r.similar for r in got)
    assert sum(r.passes for r in got if r.far) <= 0.02 * sum(r.far for r in got)


def chunk(text):
    import numpy as np

    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return data, np.array([0, len(data)])


def test_awkward_rows(spark):
    data = fx.rows()
    got = repeated_passages(fx.frame(spark, data)).collect()
    assert sorted(str((r.doc_id, r.n_words)) for r in got) == sorted(str((i, len(fx.words(t)))) for i, t, _ in data)
    assert repeated_passages(fx.frame(spark, [])).count() == 0


def test_passages_inside_lines_by_brute_force(spark):
    """Passages of more than 50 words at any place of a line: the whole result, word by word."""
    rng = random.Random(21)
    passages = [fx.prose(rng, n, 10**6).split() for n in (51, 58, 60, 75, 90, 120, 52, 200)]
    data, where = [], {}
    for k, p in enumerate(passages):
        for i in rng.sample(range(1000), 7):
            a, z = rng.randrange(0, 60), rng.randrange(0, 60)
            text = fx.prose(rng, a, 10**6).split() + p + fx.prose(rng, z, 10**6).split()
            doc = 1000 * k + i
            where[doc] = (k, a, a + len(p))
            data.append((doc, " ".join(text), "a"))
    rng.shuffle(data)
    first = {k: min(d for d, w in where.items() if w[0] == k) for k in range(len(passages))}
    got = {r.doc_id: r for r in repeated_passages(fx.frame(spark, data)).collect()}
    right = total = 0
    for d, (k, a, z) in where.items():
        spans = [(s.start, s.end) for s in got[d].removed]
        if d == first[k]:
            assert spans == []
            continue
        assert all(a <= s and e <= z for s, e in spans), (d, spans, a, z)  # no word outside the passage
        assert not spans or set(got[d].kept_in) <= {o for o, w in where.items() if w[0] == k and o < d}
        right += sum(e - s for s, e in spans)
        total += z - a
    assert right >= 0.97 * total


def test_one_id_on_different_texts(spark):
    """The keeper is a document (id and text): of two texts under one id that share a line, one loses it."""
    rng = random.Random(22)
    line = fx.prose(rng, 60, 10**6)
    data = [(1, f"{line}\n{fx.prose(rng, 30, 10**6)}", "a"), (1, f"{fx.prose(rng, 30, 10**6)}\n{line}", "a"),
            (2, f"{fx.prose(rng, 30, 10**6)}\n{line}", "a")]
    got = repeated_passages(fx.frame(spark, data)).collect()
    assert sorted(r.removed_words for r in got if r.doc_id == 1) == [0, 60]
    assert [r.removed_words for r in got if r.doc_id == 2] == [60]


def test_edges_stop_where_words_differ():
    import numpy as np

    from chainlens.llm.substring_dedup import _moved

    w = lambda *x: np.array(x, dtype=np.uint64)
    assert _moved(w(1, 2), w(3, 4, 5), w(1, 9), w(3, 4, 6)) == 2
    assert _moved(w(1, 2), w(3), w(1, 2), w(3, 4)) == 1 and _moved(w(1), w(), w(1), w(2)) == 0
    assert _moved(w(7, 1, 2), w(3), w(8, 1, 2), w(3)) == -1  # a word that the other has not
    assert _moved(w(7, 8), w(3), w(1, 2), w(3)) == -2


def test_keys_are_filtered_before_they_are_shuffled(spark):
    from chainlens.llm.common import may_be_wanted, repeated_key_filter
    import pyarrow as pa

    keys = spark.range(20000).selectExpr("case when id % 100 = 0 then 7 + id % 300 else id * 7919 * 104729 end AS key")
    bits = repeated_key_filter(keys)
    assert all(may_be_wanted(bits, pa.array([7, 107, 207])).to_pylist())
    lone = [i * 7919 * 104729 for i in range(20000) if i % 100]
    assert sum(may_be_wanted(bits, pa.array(lone)).to_pylist()) < 0.25 * len(lone)


def test_units_that_overlap_in_one_text_are_compared_there(spark, monkeypatch):
    """Texts without repeats: no key goes into the join of texts, though a line shares keys with its pieces."""
    from chainlens.llm import substring_dedup as s

    met, classes = [], s.pivot_classes
    monkeypatch.setattr(s, "pivot_classes", lambda product, *a: met.append(product.count()) or classes(product, *a))
    rng = random.Random(31)
    got = repeated_passages(fx.frame(spark, [(i, fx.prose(rng, 150, 10**6), "a") for i in range(60)])).collect()
    assert met == [0] and len(got) == 60 and not any(r.removed for r in got)


def test_least_of_ranges_and_pairs_that_share_a_key_alone():
    import numpy as np

    from chainlens.llm import substring_dedup as s

    rng = np.random.default_rng(32)
    values = rng.integers(0, 2**63, 500, dtype=np.uint64)
    low = rng.integers(0, 400, 300)
    size = rng.integers(1, 101, 300)
    assert s._least(values, low, size).tolist() == [min(values[a:a + n].tolist()) for a, n in zip(low, size)]
    keys = np.array([[2, 4], [2, 6], [8, 6], [8, 10], [8, 12]], dtype=np.uint64)
    one, other = s._lone_pairs(keys)  # 8 is a key of three
    assert sorted(zip((one // 2).tolist(), (other // 2).tolist())) == [(0, 1), (1, 2)]


def test_keys_of_several_values_are_met():
    import numpy as np
    import pyarrow as pa

    from chainlens.llm import substring_dedup as s

    big = 1 << 63
    rows = [(big + 2, 1), (big + 3, 5), (big + 2, 1), (8, 4), (8, 4), (10, 1), (10, 2), (11, 3), (13, 9)]
    blocks = list(s._blocks(lambda b: [np.array(rows, dtype=np.uint64)], 4)([None]))
    assert sum(len(b) for b in blocks) == 2  # two buckets
    met = lambda marked: sorted((r["key"] % 2**64, r["value"], r["rows"], r["seen"])
                                for b in s._met(marked)(blocks) for r in b.to_pylist())
    assert met(True) == [(10, 1, 3, True), (10, 2, 3, True), (10, 3, 3, True), (big + 2, 1, 2, True), (big + 2, 5, 2, True)]
    assert met(False) == [(10, 1, 2, False), (10, 2, 2, False)]
    assert list(s._met(True)([])) == [] and isinstance(blocks[0], pa.RecordBatch)


def test_spans_of_many_rows_are_those_of_each():
    import numpy as np

    from chainlens.llm import substring_dedup as s

    rng = np.random.default_rng(33)
    row, first = rng.integers(0, 40, 300), rng.integers(0, 200, 300)
    end = first + rng.integers(1, 20, 300)
    _, of, rows, start, stop = s._grouped(row, first, end)
    want = [(r, a, z) for r in range(40) for a, z in s._merged(zip(first[row == r].tolist(), end[row == r].tolist()))]
    assert list(zip(rows.tolist(), start.tolist(), stop.tolist())) == want and of.max() == len(want) - 1
    none = np.zeros(0, dtype=np.int64)
    assert all(len(x) == 0 for x in s._grouped(none, none, none))
