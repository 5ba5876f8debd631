"""Each stage against a brute-force version on its own input."""

from collections import Counter

import corpus_pipeline as pipeline
from chainlens.llm import queries, tokens

from . import fixtures as fx
from .test_decontaminate import brute as contaminated
from .test_mixing import checked
from .test_ngram_join import brute as classes

SF = "/root/testdata/sf0.001"


def rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert [n for n, _ in pipeline.STAGES] == [
        "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights",
        "token-ID / binary output"]
    columns, seen = docs.columns, [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = pipeline.written(stage(spark, seen[-1], SF), "stage-test")
        assert k == 4 or out.columns == columns
        seen.append(out)
    before, good, unique, clean, mixed, files = map(lambda d: rows(d) if "text" in d.columns else d.collect(), seen)

    kept = {r.doc_id for r in queries.quality_scores(docs).where("kept").collect()}
    assert sorted(good) == sorted(r for r in before if r[0] in kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(labels[r[0]] == 1 for r in good if r[0] in labels)
    assert all(r[0] in kept for r in before if labels.get(r[0]) == 1)

    of = {i: (n, c) for i, n, c in classes(good)}
    assert sorted(unique) == sorted(r for r in good if of[r[0]][0] == 0 or of[r[0]][1] == r[0])
    gone = {r[0] for r in contaminated(unique, bench) if r[5]}
    assert gone and sorted(clean) == sorted(r for r in unique if r[0] not in gone)

    times = Counter(mixed)
    assert set(times) <= set(clean) and max(times.values()) <= 2
    taken = [type("R", (), {"doc_id": r[0], "size": len(fx.words(r[1])), "taken": times[r] * len(fx.words(r[1])),
                            "copies": times[r], "target": m.target, "source_size": m.source_size})
             for r, m in zip(sorted(clean), sorted(queries.mix_sources(seen[3]).collect(), key=lambda m: m.doc_id))]
    checked(clean, taken, near=0.1)
    tok = tokens.load(pipeline.OUTPUT_TOKENIZER)
    want = Counter((r[0], len(tok.encode(r[1], add_special_tokens=False).ids) + 1) for r in mixed)
    assert Counter((r.doc_id, r.n_tokens) for r in files) == want


def test_awkward_rows(spark):
    docs = fx.frame(spark, fx.rows())
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = pipeline.written(stage(spark, docs, SF), "stage-test")
        none = stage(spark, docs.limit(0), SF)
        assert none.columns == out.columns and none.count() == 0
        docs = out if k < 4 else docs
    assert docs.count() > 0


def test_repeated_rows_are_one_group(spark):
    same = [(1, "one two three four five six", "a")] * 3 + [(2, "one two three four five six", "b"), (3, "", "a"),
                                                            (3, "", "a"), (4, None, None)]
    out = rows(pipeline.near_duplicates(spark, fx.frame(spark, same), SF))
    assert sorted(map(str, out)) == sorted(map(str, [same[0], same[4], same[5], same[6]]))
