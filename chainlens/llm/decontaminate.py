"""Benchmark decontamination with an FM-index per shard of training text.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  The phrases are all windows of
``window`` words of the benchmark items (a shorter item is one phrase).  They are read in blocks of
about ``block_rows`` (phrase, item) rows, which bounds what is sent to the tasks; each block is one
pass over the documents.

A task cuts its documents into shards of about ``shard_words`` indexed words.  A word that no phrase
of the block has can't be inside an occurrence, so it only ends a run, and runs shorter than the
shortest phrase hold none; the remaining runs are the shard's text.  Its FM-index
(:mod:`chainlens.llm.fm_index`) searches all phrases backward at once, locates their occurrences
through sampled suffix positions, and overlapping occurrences are merged into removal spans.

Defined results: a NULL or empty text has no words and is clean; ids may be NULL or repeated (one
row per input row); an item without words has no phrase; an item whose id is NULL is hit like any
other but isn't listed; an empty benchmark leaves everything clean; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.llm.common import ALNUM, ship, text_chunks, text_or_empty, word_fingerprints, written
from chainlens.llm.fm_index import FmIndex


def _phrases(window: int):
    def rows(batches):
        for b in batches:
            items = b.column("item").to_pylist()
            for first, data, offsets in text_chunks(b.column("text")):
                words, starts = word_fingerprints(data, offsets, ALNUM)
                item, phrase = [], []
                for d in range(len(offsets) - 1):
                    w = words[starts[d]:starts[d + 1]]
                    for i in range(max(1, len(w) - window + 1) if len(w) else 0):
                        item.append(items[first + d])
                        phrase.append(w[i:i + window].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(phrase, pa.binary()), pa.array(item, pa.string())],
                                                 ["phrase", "item"])

    return rows


def benchmark_phrases(benchmark: DataFrame, window: int = 13, item_col: str = "item_id",
                      text_col: str = "text") -> DataFrame:
    """Distinct ``(phrase, item)``: a phrase is its words' fingerprints."""
    ship(benchmark.sparkSession)
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_phrases(window), "phrase binary, item string").distinct()


class _Query:
    """A block of phrases over its own alphabet."""

    def __init__(self, rows):
        phrases = sorted({r[0] for r in rows})
        number = {p: i for i, p in enumerate(phrases)}
        self.items = sorted({r[1] for r in rows if r[1] is not None})
        item_no = {x: i for i, x in enumerate(self.items)}
        pairs = sorted((number[p], item_no[i]) for p, i in rows if i is not None)
        self.item_of = np.array([i for _, i in pairs], dtype=np.int64)
        self.item_at = np.searchsorted(np.array([p for p, _ in pairs], dtype=np.int64), np.arange(len(phrases) + 1))
        words = [np.frombuffer(p, dtype=np.uint64) for p in phrases]
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.shortest = int(self.lengths.min())
        self.alphabet = np.unique(np.concatenate(words))
        self.symbols = np.zeros((len(words), int(self.lengths.max())), dtype=np.int64)
        for i, w in enumerate(words):
            self.symbols[i, :len(w)] = np.searchsorted(self.alphabet, w) + 1
        self.known = np.zeros(1 << 20, dtype=bool)
        self.known[(self.alphabet >> np.uint64(44)).astype(np.int64)] = True

    def encode(self, words: np.ndarray) -> np.ndarray:
        """Symbols of words; 0 where the alphabet doesn't have them."""
        out = np.zeros(len(words), dtype=np.int64)
        maybe = np.flatnonzero(self.known[(words >> np.uint64(44)).astype(np.int64)])
        w = words[maybe]
        at = np.minimum(np.searchsorted(self.alphabet, w), len(self.alphabet) - 1)
        out[maybe] = np.where(self.alphabet[at] == w, at + 1, 0)
        return out


class _Shard:
    """Runs of indexed words of many documents, and the documents' sizes."""

    def __init__(self, query: _Query):
        self.q, self.ids, self.rows, self.n_words = query, [], [], []
        self.text, self.doc, self.pos, self.words = [], [], [], 0

    def add(self, ids: list, rows: list, words: np.ndarray, starts: np.ndarray):
        base = len(self.ids)
        self.ids += ids
        self.rows += rows
        self.n_words += np.diff(starts).tolist()
        symbols = self.q.encode(words)
        doc = np.repeat(np.arange(len(ids)), np.diff(starts))
        known = symbols > 0
        begins = known.copy()
        begins[1:] &= ~(known[:-1] & (doc[1:] == doc[:-1]))
        run = np.cumsum(begins) - 1
        at = np.flatnonzero(known)
        if not len(at):
            return
        at = at[np.bincount(run[at])[run[at]] >= self.q.shortest]
        if not len(at):
            return
        ends = np.flatnonzero(np.diff(run[at], append=-1))
        put = np.arange(len(at)) + np.concatenate([[0], np.cumsum(np.isin(np.arange(len(at)), ends))[:-1]])
        n = len(at) + len(ends)
        text, owner, place = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        text[put], owner[put], place[put] = symbols[at], doc[at] + base, at - starts[doc[at]]
        self.text.append(text)
        self.doc.append(owner)
        self.pos.append(place)
        self.words += n

    def result(self) -> pa.RecordBatch:
        spans: list = [[] for _ in self.ids]
        items: list = [[] for _ in self.ids]
        if self.words:
            q = self.q
            text, doc, pos = (np.concatenate(x) for x in (self.text, self.doc, self.pos))
            index = FmIndex(text, len(q.alphabet))
            lo, hi = index.search(q.symbols, q.lengths)
            found = np.flatnonzero(hi > lo)
            count = (hi - lo)[found]
            ends = np.cumsum(count)
            total = int(ends[-1]) if len(ends) else 0
            rows = np.repeat(lo[found] - (ends - count), count) + np.arange(total)
            phrase = np.repeat(found, count)
            at = index.locate(rows) if total else rows
            change = np.zeros(len(text) + 1, dtype=np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + q.lengths[phrase], -1)
            hit = np.cumsum(change)[:-1] > 0
            step = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
            for a, z in zip(step[::2], step[1::2]):
                # neighbouring runs are apart by a separator, so a covered stretch is inside one
                spans[doc[a]].append({"start": int(pos[a]), "end": int(pos[z - 1]) + 1})
            own = q.item_at[phrase + 1] - q.item_at[phrase]
            stop = np.cumsum(own)
            item = q.item_of[np.repeat(q.item_at[phrase] - (stop - own), own) + np.arange(int(stop[-1]) if total else 0)]
            for d, i in np.unique(np.stack([np.repeat(doc[at], own), item], axis=1), axis=0).tolist():
                items[d].append(q.items[i])
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids, pa.int64()), pa.array(self.rows, pa.int64()), pa.array(self.n_words, pa.int64()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
             pa.array(items, pa.list_(pa.string()))], ["id", "row", "n_words", "spans", "items"])


def _search(rows, shard_words: int, shard_docs: int = 20_000):
    def run(batches):
        query = _Query(rows)
        shard = _Shard(query)
        for b in batches:
            ids, texts = b.column("id").to_pylist(), b.column("row").to_pylist()
            for first, data, offsets in text_chunks(b.column("text")):
                words, starts = word_fingerprints(data, offsets, ALNUM)
                last = first + len(offsets) - 1
                shard.add(ids[first:last], texts[first:last], words, starts)
                if shard.words >= shard_words or len(shard.ids) >= shard_docs:
                    yield shard.result()
                    shard = _Shard(query)
        if shard.ids:
            yield shard.result()

    return run


_SPANS = "id bigint, row bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def benchmark_spans(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id",
                    text_col: str = "text", item_col: str = "item_id", block_rows: int = 200_000,
                    shard_words: int = 1_000_000) -> DataFrame:
    """Per document: ``id``, ``row`` (hash of the text), ``n_words``, removal ``spans`` (word positions, end excluded) and ``items`` that occur."""
    ship(docs.sparkSession)
    phrases = written(benchmark_phrases(benchmark, window, item_col), "phrases")
    n_blocks = -(-phrases.count() // block_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("text"))
    if not n_blocks:
        return (rows.mapInArrow(_count_words, "id bigint, row bigint, n_words bigint")
                .select("id", "row", "n_words", F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
                        F.array().cast("array<string>").alias("items")))
    passes = []
    for k in range(n_blocks):
        block = phrases.where(F.pmod(F.xxhash64("phrase", "item"), F.lit(n_blocks)) == k)
        block = [tuple(r) for r in block.collect()]  # about block_rows rows
        found = rows.mapInArrow(_search(block, shard_words), _SPANS) if block else None
        if n_blocks == 1:
            return found
        if found is not None:  # its hits are written, and the block goes, before the next one comes
            passes.append(written(found.where(F.size("spans") > 0).dropDuplicates(["id", "row"]), "hits"))
    hits = _merged(reduce(DataFrame.union, passes))
    counted = rows.mapInArrow(_count_words, "id bigint, row bigint, n_words bigint")
    return counted.join(hits, counted["id"].eqNullSafe(hits["_id"]) & (counted["row"] == hits["_row"]), "left").select(
        "id", "row", "n_words", F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _merged(every: DataFrame) -> DataFrame:
    """One row per document and text from the hits of all passes (one each); overlapping spans become one."""
    return (every.groupBy(F.col("id").alias("_id"), F.col("row").alias("_row")).agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        .select("_id", "_row", F.expr("""
            aggregate(spans, cast(array() as array<struct<start:bigint,end:bigint>>), (acc, x) ->
              if(size(acc) > 0 and acc[size(acc) - 1].end >= x.start,
                 concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', acc[size(acc) - 1].start,
                        'end', greatest(acc[size(acc) - 1].end, x.end)))),
                 concat(acc, array(x))))""").alias("spans"), "items"))


def benchmark_verdicts(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", share: int = 20,
                       **kw) -> DataFrame:
    """Per document: ``n_words``, ``n_hit`` (words in spans), ``n_items``, ``items_sha256``, ``contaminated``, ``text_hash``.

    ``items_sha256`` is over the ids of the items that occur, sorted as strings and joined by commas.
    A document is contaminated when a word is hit and ``share * n_hit >= n_words``; ``text_hash`` is the
    xxhash64 of its text.
    """
    spans = benchmark_spans(docs, benchmark, id_col=id_col, **kw)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return (spans.withColumn("n_hit", n_hit).select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.col("row").alias("text_hash")))


def _count_words(batches):
    for b in batches:
        n = []
        for _, data, offsets in text_chunks(b.column("text")):
            n += np.diff(word_fingerprints(data, offsets, ALNUM)[1]).tolist()
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), pa.array(n, pa.int64())],
                                         ["id", "row", "n_words"])
