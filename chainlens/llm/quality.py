"""Quality classifier: a weak-label model over heuristic labellers trains a hashed linear scorer.

1. Eight labellers look at statistics of each whole text and vote bad, good or abstain.
2. The vote patterns of all documents are counted (at most 3**8 of them), and expectation-
   maximisation on the counts estimates the classes' share and each labeller's vote probabilities
   given the class.  This gives every pattern the posterior probability of a good document.
3. A linear scorer over hashed features (byte trigrams of the text, buckets of the statistics) is
   fitted to the posteriors of a bounded sample of ``train_rows`` documents, half of them bad ones as far as there
   are so many: of either kind those with the lowest hash of id and text.  Rows with one id and text count once,
   and NULL ids are told apart by their texts.
4. The scorer scores all documents; those below ``threshold`` are rejected.

Defined results: a NULL or empty text gets abstentions only and the score of the average document
without features, and a text without words is kept; ids may be NULL or repeated (one row per input row); an empty
table gives an empty result; a table whose sample is empty is scored by the posteriors alone; other
columns are ignored or, with ``carry``, passed through as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainlens.llm.common import release_memory, ship, text_chunks, text_or_empty, word_fingerprints, written

BAD, ABSTAIN, GOOD = 0, 1, 2

# The statistics and, for each labeller, (statistic, good range, bad range); a value in
# neither range abstains.
STATISTICS = ("symbol share", "upper-case share", "repeated neighbours", "distinct words", "decorated words",
              "word length", "bare symbols", "digit share")
LABELLERS = (
    ("symbol share", (0.0, 0.02), (0.05, 1.0)),
    ("upper-case share", (0.0, 0.15), (0.50, 1.0)),
    ("repeated neighbours", (0.0, 0.10), (0.30, 1.0)),
    ("distinct words", (0.60, 1.0), (0.0, 0.40)),
    ("decorated words", (0.0, 0.02), (0.20, 1.0)),
    ("word length", (3.0, 7.0), (12.0, 1e9)),
    ("bare symbols", (0.0, 0.05), (0.20, 1.0)),
    ("digit share", (0.0, 0.15), (0.50, 1.0)),
)
BUCKETS = 16
HASH_BITS = 14
MIN_WORDS = 5  # shorter texts get no votes

_kind = np.zeros(256, dtype=np.uint8)  # 0 symbol, 1 letter, 2 upper, 3 digit, 4 space, 5 usual mark
_kind[list(range(97, 123)) + list(range(128, 256))] = 1
_kind[65:91] = 2
_kind[48:58] = 3
_kind[[9, 10, 11, 12, 13, 32]] = 4
_kind[[ord(c) for c in ".,;:'\"-()?!"]] = 5
_loud = np.zeros(256, dtype=bool)
_loud[[ord("!"), ord("?")]] = True


def _segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(matrix of STATISTICS, number of words)`` for the texts of a chunk."""
    words, starts = word_fingerprints(data, offsets)
    n_words = np.diff(starts)
    kind = _kind[data]
    size = np.maximum(np.diff(offsets), 1)
    upper = _segment_sums(kind == 2, offsets)
    lower = _segment_sums((kind == 1) & (data < 128), offsets)
    # marks that follow marks, and exclamation, count as symbols
    mark = kind == 5
    double = mark.copy()
    double[1:] &= mark[:-1]
    double[:1] = False
    symbol = _segment_sums((kind == 0) | double | _loud[data], offsets)
    same = np.zeros(len(words), dtype=bool)
    same[1:] = words[1:] == words[:-1]
    begin = starts[:-1][n_words > 0]
    same[begin] = False
    doc = np.repeat(np.arange(len(n_words)), n_words)
    order = np.lexsort((words, doc))
    new = np.ones(len(words), dtype=bool)
    if len(words):
        w, d = words[order], doc[order]
        new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(doc[order][new], minlength=len(n_words))
    space = _segment_sums(kind == 4, offsets)
    # words without any letter or digit: a symbol or mark between spaces or the text's edges
    solid = (kind == 0) | mark
    left = np.ones(len(data), dtype=bool)
    left[1:] = kind[:-1] == 4
    left[offsets[:-1][offsets[:-1] < len(data)]] = True
    right = np.ones(len(data), dtype=bool)
    right[:-1] = kind[1:] == 4
    right[offsets[1:][offsets[1:] > 0] - 1] = True
    bare = _segment_sums(solid & left & right, offsets)
    # words that end in two equal symbols or marks
    twice = np.zeros(len(data), dtype=bool)
    twice[1:] = (data[1:] == data[:-1]) & solid[1:] & right[1:] & ~left[1:]
    decorated = _segment_sums(twice, offsets)
    per_word = np.maximum(n_words, 1)
    # long texts reuse words: the share of distinct ones is taken against that of n / (1 + n / 2000)
    expected = per_word / (1 + per_word / 2000)
    return np.stack([
        symbol / size, upper / np.maximum(upper + lower, 1), _segment_sums(same, starts) / per_word,
        np.minimum(distinct / expected, 1.0), decorated / per_word, (size - space) / per_word, bare / per_word,
        _segment_sums(kind == 3, offsets) / size], axis=1), n_words


def votes(stats: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """The labellers' votes as one number per text (base 3, first labeller lowest)."""
    code = np.zeros(len(stats), dtype=np.int64)
    for j, (name, good, bad) in enumerate(LABELLERS):
        x = stats[:, STATISTICS.index(name)]
        v = np.full(len(stats), ABSTAIN)
        v[(x >= good[0]) & (x <= good[1])] = GOOD
        v[(x >= bad[0]) & (x <= bad[1])] = BAD
        v[n_words < MIN_WORDS] = ABSTAIN
        code += v * 3 ** j
    return code


def decode_votes(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(len(LABELLERS))) % 3


def fit_label_model(codes: np.ndarray, counts: np.ndarray, steps: int = 100):
    """EM on vote patterns: ``(posterior of good per pattern, share of good, vote probabilities [class, labeller, bad or good])``.

    Starts from bad for every pattern with a bad vote, as the labellers look for different faults; one
    pseudo-count per vote keeps probabilities off 0.  An abstention says nothing about the class.
    """
    v = decode_votes(codes)
    n = counts.astype(np.float64)
    post = np.where((v == BAD).any(axis=1), 0.05, np.where((v == GOOD).any(axis=1), 0.95, 0.5))
    cast = np.stack([v == BAD, v == GOOD], axis=2).astype(np.float64)
    share, prob = 0.5, None
    for _ in range(steps):
        share = (n @ post + 1) / (n.sum() + 2)
        prob = np.stack([np.einsum("p,pjv->jv", n * w, cast) + 1.0 for w in (1 - post, post)])
        prob /= prob.sum(axis=2, keepdims=True)
        logit = np.log(share / (1 - share)) + np.einsum("pjv,jv->p", cast, np.log(prob[1]) - np.log(prob[0]))
        fresh = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        if np.abs(fresh - post).max() < 1e-9:
            break
        post = fresh
    return post, share, prob


# --- the hashed linear scorer ------------------------------------------------------------------

_SIZE = 1 << HASH_BITS


def _trigrams(data: np.ndarray) -> np.ndarray:
    """Hashed byte trigram starting at every byte but the last two."""
    x = data.astype(np.uint32)
    h = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
    return ((h * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS)).astype(np.int64)


def _buckets(stats: np.ndarray) -> np.ndarray:
    """Bucket of every statistic: a slot of its own behind the hashed ones."""
    scale = np.array([4.0, 1.0, 2.0, 1.0, 2.0, 0.05, 3.0, 2.0])
    b = np.minimum(np.sqrt(np.minimum(stats * scale, 1.0)) * BUCKETS, BUCKETS - 1).astype(np.int64)
    return _SIZE + np.arange(stats.shape[1]) * BUCKETS + b


N_WEIGHTS = _SIZE + len(STATISTICS) * BUCKETS + 1
GAIN = 8.0  # weight of the mean over trigrams against the buckets


def _scan(max_bytes: int = 512 << 10):
    """batches -> ``(batch, first row, data, offsets, stats, n_words)`` per chunk."""
    def chunks(batches):
        for b in batches:
            for first, data, offsets in text_chunks(b.column("text"), max_bytes):
                yield b, first, data, offsets, *statistics(data, offsets)

    return chunks


def _vote_rows(batches):
    for b, first, data, offsets, stats, n_words in _scan()(batches):
        yield pa.RecordBatch.from_arrays([b.column("h").slice(first, len(n_words)), pa.array(votes(stats, n_words), pa.int32())],
                                         ["h", "code"])


def _features(posterior: dict):
    """Training rows: posterior and the text's sparse features."""
    def rows(batches):
        for b, first, data, offsets, stats, n_words in _scan()(batches):
            codes, slots = votes(stats, n_words), _buckets(stats)
            post, idx, val = [], [], []
            for d in range(len(offsets) - 1):
                text = data[offsets[d]:offsets[d + 1]]
                if len(text) < 3:
                    continue
                i, c = np.unique(_trigrams(text), return_counts=True)
                idx.append(np.concatenate([i, slots[d]]).astype("<i4").tobytes())
                val.append(np.concatenate([GAIN * c / c.sum(), np.ones(slots.shape[1])]).astype("<f4").tobytes())
                post.append(posterior[int(codes[d])])
            yield pa.RecordBatch.from_arrays(
                [pa.array(post, pa.float64()), pa.array(idx, pa.binary()), pa.array(val, pa.binary())],
                ["posterior", "idx", "val"])

    return rows


def _fit(epochs: int = 60, rate: float = 0.5, decay: float = 1e-4):
    """Logistic regression on soft labels by full-batch gradients with per-weight step sizes, in one task."""
    def train(batches):
        post, idx, val, lens = [], [], [], []
        for b in batches:
            post += b.column("posterior").to_pylist()
            for i, v in zip(b.column("idx"), b.column("val")):
                idx.append(np.frombuffer(i.as_buffer(), dtype="<i4"))
                val.append(np.frombuffer(v.as_buffer(), dtype="<f4"))
                lens.append(len(idx[-1]))
        w = np.zeros(N_WEIGHTS)
        if post:
            # any order of arrival gives one result
            key = sorted(range(len(post)), key=lambda k: (post[k], idx[k].tobytes(), val[k].tobytes()))
            y = np.array([post[k] for k in key])
            x, f = np.concatenate([idx[k] for k in key]), np.concatenate([val[k] for k in key])
            at = np.concatenate([[0], np.cumsum([lens[k] for k in key])])[:-1]
            row = np.repeat(np.arange(len(y), dtype=np.int32), [lens[k] for k in key])
            del idx, val
            # both classes weigh the same
            weight = np.where(y > 0.5, 0.5 / max(1e-9, (y > 0.5).mean()), 0.5 / max(1e-9, (y <= 0.5).mean()))
            seen = np.full(N_WEIGHTS, 1e-8)
            for _ in range(epochs):
                z = np.add.reduceat(w.astype(np.float32)[x] * f, at) + w[-1]
                g = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * weight / len(y)
                grad = np.bincount(x, weights=g.astype(np.float32)[row] * f, minlength=N_WEIGHTS) + decay * w / N_WEIGHTS
                grad[-1] += g.sum()
                seen += grad * grad
                w -= rate * grad / np.sqrt(seen)
        n = len(post)
        post = idx = val = y = x = f = row = weight = None
        release_memory()
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f8").tobytes()], pa.binary()),
                                          pa.array([n], pa.int64())], ["weights", "rows"])

    return train


def _scores(weights: np.ndarray, posterior: dict, fitted: bool):
    # sums of whole units of 2**-32 don't depend on what else is in the batch
    fixed = np.round(weights * 2.0**32).astype(np.int64)

    def rows(batches):
        for b, first, data, offsets, stats, n_words in _scan()(batches):
            post = np.array([posterior[int(c)] for c in votes(stats, n_words)])
            if fitted:
                z = weights[_buckets(stats)].sum(axis=1) + weights[-1]
                if len(data) > 2:
                    total = np.concatenate([[0], np.cumsum(fixed[_trigrams(data)]), [0, 0]])
                    last = np.maximum(offsets[1:] - 2, offsets[:-1])
                    total[-2:] = total[-3]
                    z += GAIN * (total[last] - total[offsets[:-1]]) / 2.0**32 / np.maximum(last - offsets[:-1], 1)
                score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            else:
                score = post.copy()
            part = b.slice(first, len(offsets) - 1)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in part.schema.names if c != "text"), pa.array(post, pa.float64()),
                 pa.array(score, pa.float64()), pa.array(n_words, pa.int64())],
                [*(c for c in part.schema.names if c != "text"), "posterior", "score", "n_words"])

    return rows


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 8000,
                   threshold: float = 0.5, carry: bool = False) -> DataFrame:
    """One row per document: ``id_col``, ``posterior`` (label model), ``score`` (scorer), ``kept``.

    With ``carry`` the input row comes along in the struct ``row``.
    """
    ship(docs.sparkSession)
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    hashed = rows.withColumn("h", F.xxhash64("id", "text"))
    # a hash and a vote pattern of every document
    voted = written(hashed.select("h", "text").mapInArrow(_vote_rows, "h bigint, code int"), "votes")
    patterns = voted.groupBy("code").count().collect()  # at most 3**8 rows
    patterns.sort()
    codes = np.array([r[0] for r in patterns], dtype=np.int64)
    counts = np.array([r[1] for r in patterns], dtype=np.int64)
    total = int(counts.sum())
    posterior: dict = {}
    weights, fitted = np.zeros(N_WEIGHTS), False
    if total:
        post, _, _ = fit_label_model(codes, counts)
        posterior = dict(zip(codes.tolist(), post.tolist()))
        bad = F.col("code").isin([c for c, p in posterior.items() if p < 0.5])
        kinds = voted.select("h", bad.alias("bad")).distinct().withColumn(
            "nth", F.row_number().over(Window.partitionBy("bad").orderBy("h"))).where(F.col("nth") <= train_rows)
        kinds = written(kinds, "sample")  # every task passes on at most train_rows hashes of a kind
        n_bad, n_good = (kinds.where(F.col("bad") == b).count() for b in (True, False))
        n_bad = min(n_bad, max(train_rows // 2, train_rows - n_good))
        keys = kinds.where(F.col("nth") <= F.when(F.col("bad"), n_bad).otherwise(train_rows - n_bad)).select("h")
        sample = hashed.join(F.broadcast(keys), "h").dropDuplicates(["h"]).select("id", "text")  # train_rows keys
        features = written(sample.mapInArrow(_features(posterior), "posterior double, idx binary, val binary"),
                           "features")
        model = features.coalesce(1).mapInArrow(_fit(), "weights binary, rows bigint").collect()
        weights = np.frombuffer(model[0]["weights"], dtype="<f8")
        fitted = bool(model[0]["rows"])
    if carry:
        rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("id"),
                           text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    inner = f"row {rows.schema['row'].dataType.simpleString()}, " if carry else ""
    scored = rows.mapInArrow(_scores(weights, posterior, fitted),
                             f"{inner}id {kind}, posterior double, score double, n_words bigint")
    return scored.select(
        *(["row"] if carry else []), F.col("id").alias(id_col), "posterior", "score",
        ((F.col("score") >= threshold) | (F.col("n_words") == 0)).alias("kept"))
