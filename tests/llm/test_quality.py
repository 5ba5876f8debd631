import numpy as np

from chainlens.llm import quality as q

from . import fixtures as fx

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    """No label is used in training, so all of them are held out."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = q.quality_scores(docs, train_rows=500).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.995 * len(good)
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad)


def test_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    n = 40_000
    y = rng.random(n) < 0.8
    right = np.array([0.95, 0.9, 0.97, 0.85, 0.9, 0.8, 0.9, 0.75])
    votes = np.where(rng.random((n, 8)) < right, np.where(y, q.GOOD, q.BAD)[:, None], np.where(y, q.BAD, q.GOOD)[:, None])
    votes[rng.random((n, 8)) < 0.2] = q.ABSTAIN
    codes, counts = np.unique((votes * 3 ** np.arange(8)).sum(axis=1), return_counts=True)
    post, share, prob = q.fit_label_model(codes, counts)
    assert abs(share - 0.8) < 0.02
    assert np.abs(prob[1][:, 1] - right).max() < 0.03 and np.abs(prob[0][:, 0] - right).max() < 0.05
    of = dict(zip(codes, post))
    guess = np.array([of[c] for c in (votes * 3 ** np.arange(8)).sum(axis=1)]) > 0.5
    assert (guess == y).mean() > 0.97


def test_sample_is_bounded(spark, monkeypatch):
    """A third of the rows without an id, a third under one: never more than ``train_rows`` documents are fitted."""
    kept = {}
    written = q.written

    def spy(df, name, *a):
        kept[name] = written(df, name, *a)
        return kept[name]

    monkeypatch.setattr(q, "written", spy)
    data = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"plain words of text number {i % 200} stand here", "a")
            for i in range(600)]
    q.quality_scores(fx.frame(spark, data), train_rows=50).count()
    assert kept["features"].count() == 50
    q.quality_scores(fx.frame(spark, [(None, "the same words again and again", "a")] * 300), train_rows=50).count()
    assert kept["features"].count() == 1


def test_scores_equal_the_plain_form(spark, monkeypatch):
    """The scorer's margin by a loop over trigrams and buckets, from the fitted weights."""
    seen = {}
    scores = q._scores

    def spy(weights, posterior, fitted):
        seen["w"], seen["p"] = weights, posterior
        return scores(weights, posterior, fitted)

    monkeypatch.setattr(q, "_scores", spy)
    data = [(i, t, s) for i, t, s in fx.rows() if i is not None]
    got = q.quality_scores(fx.frame(spark, data), train_rows=40).collect()
    w = seen["w"]
    want = []
    for i, t, _ in data:
        raw = np.frombuffer((t or "").encode(), dtype=np.uint8)
        stats, n = q.statistics(raw, np.array([0, len(raw)]))
        z = sum(w[b] for b in q._buckets(stats)[0]) + w[-1]
        grams = [(int(a) << 16 | int(b) << 8 | int(c)) * 2654435761 % 2 ** 32 >> (32 - q.HASH_BITS)
                 for a, b, c in zip(raw, raw[1:], raw[2:])]
        if grams:
            z += q.GAIN * sum(w[g] for g in grams) / len(grams)
        post = seen["p"][int(q.votes(stats, n)[0])]
        want.append((i, post, 1 / (1 + np.exp(-z)), int(n[0]) == 0))
    assert len(got) == len(want)
    key = lambda r: (r[0], r[1], round(r[2], 6))
    for a, b in zip(sorted(((r.doc_id, r.posterior, r.score, r.kept) for r in got), key=key), sorted(want, key=key)):
        assert a[0] == b[0] and a[1] == b[1] and abs(a[2] - b[2]) < 1e-6
        assert a[3] == (b[3] or a[2] >= 0.5)


def test_statistics():
    def one(text):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        stats, n = q.statistics(data, np.array([0, len(data)]))
        return dict(zip(q.STATISTICS, stats[0])), int(n[0])

    s, n = one("a a b | c")
    assert n == 5 and s["repeated neighbours"] == 0.2 and s["bare symbols"] == 0.2
    s, n = one("AB cd!! ef***")
    assert n == 3 and abs(s["upper-case share"] - 1 / 3) < 1e-9 and abs(s["decorated words"] - 2 / 3) < 1e-9
    assert one("")[1] == 0 and one("12 34")[0]["digit share"] == 0.8


def test_awkward_rows_and_reruns(spark):
    data = fx.rows()
    df = fx.frame(spark, data)
    a = q.quality_scores(df, train_rows=20).collect()
    b = q.quality_scores(df.repartition(3), train_rows=20).collect()
    assert len(a) == len(data) and sorted(map(str, a)) == sorted(map(str, b))
    assert all(r.kept for r in a if r.doc_id in (5000, 5001, 5002))
    rows = q.quality_scores(df, carry=True).select("row.*")
    assert rows.columns == df.columns and rows.exceptAll(df).count() == 0
    assert q.quality_scores(fx.frame(spark, [])).count() == 0
    assert q.quality_scores(fx.frame(spark, [(1, None, "a")])).first().kept
