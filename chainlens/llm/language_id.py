"""Language identification: averaged hashed subword embeddings under a linear softmax.

1. A text's subwords are the byte n-grams (3 and 4 bytes) inside its words, with a mark at each word's edges;
   A-Z is lower-cased and every other ASCII byte separates words.  Each is hashed to one of ``BUCKETS`` rows.
2. The model averages the embeddings of all subwords of a text and puts a linear softmax over the languages
   on top.  Stochastic gradient descent in numpy (one task, small batches, momentum, falling step size)
   fits it to a bounded sample: the ``train_rows`` labelled documents with the lowest hash of (id, text),
   dealt evenly to the languages (``train_rows / languages`` at most of each); equal (id, text) rows count once.
3. A fifth of the sample takes no part in the descent.  On it a temperature is chosen by log loss, so that the
   scores are calibrated, and the rejection limit: the lowest score above which at most ``max_error`` of
   those documents are wrong.
4. All documents are scored over their whole texts.  As averaging and softmax weights are both linear, a
   bucket's embedding times the weights is one row of numbers per language, and a text's logits are the
   mean of its subwords' rows: sums of whole units of 2**-24, which don't depend on the batch or the order.

Only the text is an input of a prediction; labels steer nothing but the fit.

Defined results: a NULL text or one without a letter is ``und`` with score 0, and rejected; so is every text
where the sample is empty; a text whose letters give no subword gets the languages' bias.  Labels may be NULL
(not learned from); ids may be NULL (not learned from, not held out) or repeated; one row per input row; an empty table gives
an empty result; of equal logits the first language in order wins; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainlens.llm.common import ship, text_chunks, written

UNKNOWN = "und"
HASH_BITS, DIM = 14, 16
BUCKETS = 1 << HASH_BITS
_UNIT = float(1 << 24)
_PIECE = 1 << 20  # positions worked on at a time, also inside one long text

_fold = np.arange(256, dtype=np.uint8)
_fold[:128] = 32
_fold[97:123] = np.arange(97, 123)
_fold[65:91] = np.arange(97, 123)


def _grams(low: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(bucket, is a subword)`` for the 3- and 4-byte grams from every position but the last three."""
    x = low.astype(np.uint32)
    letter = low != 32
    three = (x[:-3] << 16) | (x[1:-2] << 8) | x[2:-1]
    four = (three << 8) | x[3:]
    shift = np.uint32(32 - HASH_BITS)
    inner = letter[1:-2]
    return [((three * np.uint32(2654435761)) >> shift, inner),
            (((four ^ (four >> 15)) * np.uint32(2246822519)) >> shift, inner & letter[2:-1])]


def subwords(data: np.ndarray, offsets: np.ndarray):
    """Pieces of a chunk: ``(documents' first positions, document numbers, grams)``.

    A text is taken between two separators; one longer than a piece comes in several.
    """
    sizes = np.diff(offsets)
    # three separators behind every text, and one before the first
    spread = np.full(len(data) + 3 * len(sizes) + 1, 32, dtype=np.uint8)
    if len(data):
        spread[np.arange(len(data)) + 1 + np.repeat(3 * np.arange(len(sizes)), sizes)] = _fold[data]
    begin = offsets[:-1] + 3 * np.arange(len(sizes))  # each text's first gram starts on the separator before it
    end = len(spread) - 3
    for a in range(0, end, _PIECE):
        z = min(a + _PIECE, end)
        docs = np.arange(np.searchsorted(begin, a, side="right") - 1, np.searchsorted(begin, z, side="left"))
        yield np.maximum(begin[docs] - a, 0), docs, _grams(spread[a:z + 3])


def _feature_rows(batches):
    """Sample rows: language and the sparse mean of the text's subwords."""
    for b in batches:
        langs, keys = b.column("lang"), b.column("h")
        for first, data, offsets in text_chunks(b.column("text")):
            total = {}
            for starts, docs, grams in subwords(data, offsets):
                ends = np.append(starts[1:], len(grams[0][0]))
                for d, s, e in zip(docs.tolist(), starts, ends):
                    for bucket, real in grams:
                        i, c = np.unique(bucket[s:e][real[s:e]], return_counts=True)
                        total.setdefault(d, np.zeros(BUCKETS, dtype=np.int64))[i] += c
            out = [[], [], [], []]
            for d, c in sorted(total.items()):
                i = np.flatnonzero(c)
                if len(i):
                    out[0].append(langs[first + d].as_py())
                    out[1].append(keys[first + d].as_py())
                    out[2].append(i.astype("<i4").tobytes())
                    out[3].append((c[i] / c.sum()).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()),
                                              pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())],
                                             ["lang", "h", "idx", "val"])


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def descend(rows: list, y: np.ndarray, classes: int, epochs: int, rate: float, batch: int = 16, seed: int = 7):
    """Stochastic gradient descent with momentum: ``(embeddings, weights, bias)``.

    ``rows`` are (buckets, shares) pairs; classes weigh the same.  Embeddings take ``GAIN`` times the step of
    the weights, as each sees only its small share of a text.
    """
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1.0, 1.0, (BUCKETS, DIM)).astype(np.float32)
    w, b = np.zeros((DIM, classes), dtype=np.float32), np.zeros(classes, dtype=np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    weight = (len(y) / classes / np.maximum(np.bincount(y, minlength=classes), 1)).astype(np.float32)
    steps = max(1, epochs * -(-len(rows) // batch))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            some = order[at:at + batch]
            h = np.stack([rows[k][1] @ emb[rows[k][0]] for k in some])
            g = _softmax(h @ w + b)
            g[np.arange(len(some)), y[some]] -= 1
            g *= weight[y[some], None] / len(some)
            lr = rate * (1 - step / steps)
            back = g @ w.T
            vw, vb = 0.9 * vw + h.T @ g, 0.9 * vb + g.sum(axis=0)
            w -= lr * vw
            b -= lr * vb
            for k, r in zip(some, back):
                emb[rows[k][0]] -= (lr * GAIN) * rows[k][1][:, None] * r
            step += 1
    return emb, w, b


GAIN = 300.0


def calibrate(logits: np.ndarray, y: np.ndarray, max_error: float) -> tuple[float, float]:
    """``(temperature, rejection limit)`` from documents that took no part in the descent.

    A small share of each label, 1 / (documents + 2), counts as any language, so that a sample without
    errors doesn't make every score 1.
    """
    if not len(y):
        return 1.0, 0.0
    heat = np.exp(np.linspace(np.log(0.05), np.log(20.0), 121))
    doubt = 1.0 / (len(y) + 2)

    def log_loss(t):
        p = np.log(np.maximum(_softmax(logits / t), 1e-12))
        return -((1 - doubt) * p[np.arange(len(y)), y] + doubt * p.mean(axis=1)).mean()

    loss = [log_loss(t) for t in heat]
    t = float(heat[int(np.argmin(loss))])
    p = _softmax(logits / t)
    score, wrong = p.max(axis=1), p.argmax(axis=1) != y
    order = np.argsort(-score, kind="stable")
    fair = np.flatnonzero(np.cumsum(wrong[order]) <= max_error * np.arange(1, len(y) + 1))
    return t, float(score[order][fair[-1]]) if len(fair) else 1.0


def _fit(epochs: int, rate: float, max_error: float):
    def train(batches):
        rows = []
        for b in batches:
            rows += [(h, lang, i, v) for lang, h, i, v in zip(*(b.column(c).to_pylist() for c in ("lang", "h", "idx", "val")))]
        rows.sort()  # any order of arrival gives one model
        langs = sorted({r[1] for r in rows})
        y = np.array([langs.index(r[1]) for r in rows], dtype=np.int64)
        x = [(np.frombuffer(r[2], dtype="<i4"), np.frombuffer(r[3], dtype="<f4")) for r in rows]
        table = np.zeros((BUCKETS, max(1, len(langs))))
        bias, heat, limit = np.zeros(max(1, len(langs))), 1.0, 0.0
        if rows:
            aside = np.arange(len(rows)) % 5 == 4  # rows are in order of a hash
            emb, w, b = descend([r for r, o in zip(x, aside) if not o], y[~aside], len(langs), epochs, rate)
            table, bias = (emb @ w).astype(np.float64), b.astype(np.float64)
            logits = np.array([v @ table[i] + bias for (i, v), o in zip(x, aside) if o]).reshape(-1, len(langs))
            heat, limit = calibrate(logits, y[aside], max_error)
        yield pa.RecordBatch.from_arrays(
            [pa.array([langs], pa.list_(pa.string())), pa.array([np.round(table * _UNIT).astype("<i8").tobytes()], pa.binary()),
             pa.array([bias.astype("<f8").tobytes()], pa.binary()), pa.array([heat]), pa.array([limit])],
            ["langs", "table", "bias", "heat", "limit"])

    return train


_MODEL = "langs array<string>, table binary, bias binary, heat double, limit double"


def _predictions(model: dict):
    langs = pa.array(model["langs"], pa.string())
    table = np.frombuffer(model["table"], dtype="<i8").reshape(BUCKETS, -1)
    bias, heat = np.frombuffer(model["bias"], dtype="<f8"), model["heat"]

    def rows(batches):
        for b in batches:
            for first, data, offsets in text_chunks(b.column("text")):
                n = len(offsets) - 1
                total, count = np.zeros((n, len(bias)), dtype=np.int64), np.zeros(n, dtype=np.int64)
                for starts, docs, grams in subwords(data, offsets):
                    for bucket, real in grams:
                        where = np.flatnonzero(real)
                        cut = np.append(np.searchsorted(where, starts), len(where))
                        some = np.flatnonzero(np.diff(cut))  # documents with subwords in this piece
                        if len(some):
                            total[docs[some]] += np.add.reduceat(table[bucket[where]], cut[some], axis=0)
                            count[docs[some]] += np.diff(cut)[some]
                p = _softmax((total / _UNIT / np.maximum(count, 1)[:, None] + bias) / heat)
                best = p.argmax(axis=1)
                part = b.slice(first, n)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in part.schema.names if c != "text"), langs.take(pa.array(best)),
                     pa.array(p[np.arange(n), best])],
                    [*(c for c in part.schema.names if c != "text"), "lang_pred", "score"])

    return rows


def fit_language_model(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
                       lang_col: str = "lang", train_rows: int = 4000, epochs: int = 20, rate: float = 0.5,
                       max_error: float = 0.01) -> dict:
    """The model (a bounded row) fitted to the documents of which ``learn`` holds."""
    ship(docs.sparkSession)
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"))
    # choose by language and hash alone, so that no text is sorted or shuffled
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    keys = written(rows.select("lang", "h").distinct().withColumn("nth", nth).where(F.col("nth") <= train_rows),
                   "language-sample")
    fair = max(1, train_rows // max(1, keys.where("nth = 1").count()))
    chosen = keys.where(F.col("nth") <= fair).orderBy("nth", "lang").limit(train_rows).select("lang", "h")
    sample = (rows.join(F.broadcast(chosen), ["lang", "h"])  # at most train_rows keys
              .groupBy("lang", "h").agg(F.first("text").alias("text")))
    features = written(sample.mapInArrow(_feature_rows, "lang string, h bigint, idx binary, val binary"),
                       "language-features")
    model = features.coalesce(1).mapInArrow(_fit(epochs, rate, max_error), _MODEL).collect()
    return model[0].asDict() if model else {"langs": [], "limit": 0.0}


def predict_language(docs: DataFrame, model: dict, text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The ``keep`` columns of every document with ``lang_pred``, ``score`` and ``rejected``."""
    ship(docs.sparkSession)
    text, keep = F.col(text_col), keep or {}
    # whether there is a letter is decided before the text goes to a worker; a text without one stays behind
    rows = docs.select(*[c.alias(f"k_{name}") for name, c in keep.items()],
                       F.when(text.rlike(r"\p{L}"), text).alias("text")).withColumn("lettered", F.col("text").isNotNull())
    if model["langs"]:
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
        rows = rows.mapInArrow(_predictions(model), f"{kinds}, lang_pred string, score double")
    else:
        rows = rows.withColumn("lettered", F.lit(False)).withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    known = F.col("lettered")
    return rows.select(*[F.col(f"k_{name}").alias(name) for name in keep],
                       F.when(known, F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
                       F.when(known, F.col("score")).otherwise(0.0).alias("score"),
                       (~known | (F.col("score") < model["limit"])).alias("rejected"))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                held_out: Column | None = None, **fit) -> DataFrame:
    """One row per document: ``id_col``, ``held_out``, ``lang_pred``, ``score``, ``rejected``.

    Documents of which ``held_out`` (default: none) holds or is NULL are not learned from.
    """
    held = F.lit(False) if held_out is None else held_out
    model = fit_language_model(docs, F.coalesce(~held, F.lit(False)), id_col, text_col, lang_col, **fit)
    return predict_language(docs, model, text_col, {id_col: F.col(id_col), "held_out": F.coalesce(held, F.lit(False))})
