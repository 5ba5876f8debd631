"""Substring deduplication by MinHash banding of paragraphs.

Paragraphs are the lines of a text; as passages also repeat inside longer lines, a line's pieces between
content-defined places (a word whose fingerprint is the smallest among its ``REACH`` neighbours on both
sides) are paragraphs, too, so the same passage gives the same ones wherever it stands.  Neighbouring
lines of fewer than ``SHORTEST`` words are one line; one that is still shorter stands in two paragraphs,
with the last piece before it and with the first one after it, so only a text of fewer words has none.
A paragraph's content is its set of 5-word shingles.

Equal word sequences are one node.  Contents of at least ``t / (1 - t)`` shingles can differ and
still have Jaccard >= t = ``percent`` / 100; they get ``bands`` MinHash keys of ``rows`` values.  The
number of bands is the smallest that finds a pair of similarity t with probability ``recall``:
``1 - (1 - t**rows)**bands``.  Colliding contents are compared by their exact Jaccard similarity and
joined into components (:mod:`chainlens.llm.pivots`); pairs whose sets differ in too many parities
aren't, as they can't be similar.  Overlapping paragraphs of one text share many keys: two that alone share one in
a chunk of texts are compared there.  Keys are shuffled as packed (key, node) pairs, a block for each bucket of keys, and
each bucket is searched for keys of several nodes in whole arrays; so are the paragraphs for those of several places.

Of a component the occurrence in the document with the smallest (id, text hash) stays (its first there); the
others are removals.  Neighbouring removals of a document are merged to runs, whose edges are then
compared word by word with the place that stays: words that are equal there, too, join the run (at most
``CONTEXT`` on a side, more than a paragraph's unmatched edge has), and a similar paragraph's outermost words that
the other one hasn't leave it.  Spans of at least ``min_words`` words are removed.

Defined results: a NULL or empty text has no paragraphs; rows with NULL ids are removed against
others but never stand for them (a component without any id keeps all); rows repeated with one id
and text count as one document, one id on different texts as several; a text of fewer than ``SHORTEST``
words has no paragraph, so its repeats aren't found; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.llm.common import (NOT_SPACE, _powers, discard, key_filter, may_be_wanted, mix, shingle_fingerprints,
                                  ship, text_chunks, text_or_empty, word_fingerprints, written)
from chainlens.llm.pivots import pivot_classes

SHORTEST = 5
REACH = 4
SHINGLE = 5
PARITIES = 256
CONTEXT = 64


def tuned_bands(percent: int, recall: float, rows: int = 1) -> int:
    """Bands needed to find a pair of the threshold's similarity with probability ``recall``."""
    if percent >= 100:
        return 1
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** rows)))


def _cuts(words: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each word: line starts, and local minima of the fingerprints inside a line."""
    n = len(words)
    low = np.ones(n, dtype=bool)
    for k in range(1, REACH + 1):
        same = line[k:] == line[:-k]
        low[k:] &= ~same | (words[k:] < words[:-k])
        low[:-k] &= ~same | (words[:-k] <= words[k:])
        # a place nearer than REACH to the line's edge isn't decided by its content alone
        low[k:] &= same
        low[:-k] &= same
        low[:k] = False
        low[n - k:] = False
    # nor does a line begin with a piece below SHORTEST
    low[SHORTEST:] &= line[SHORTEST:] == line[:-SHORTEST]
    low[:SHORTEST] = False
    low[:1] = True
    low[1:] |= line[1:] != line[:-1]
    return low


def _joined(line: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Each word's line, where a text's neighbouring lines below ``SHORTEST`` words are one line."""
    at = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    short = np.diff(np.append(at, len(line))) < SHORTEST
    begins = np.ones(len(at), dtype=bool)
    begins[1:] = ~(short[1:] & short[:-1]) | (doc[at[1:]] != doc[at[:-1]])
    return np.repeat(np.cumsum(begins), np.diff(np.append(at, len(line))))


def _units(data: np.ndarray, offsets: np.ndarray):
    """``(words, starts of the texts, text of each paragraph, its first word, its end)``: lines and their pieces."""
    words, starts = word_fingerprints(data, offsets)
    n_words = np.diff(starts)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    if not len(words):
        none = np.zeros(0, dtype=np.int64)
        return words, starts, none, none, none
    # a word's line: line breaks before its first byte
    inside = NOT_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    begins[edge] = inside[edge]
    line = np.cumsum(data == 10)[np.flatnonzero(begins)] + doc * (len(data) + 1)
    line = _joined(line, doc)
    pieces = np.flatnonzero(_cuts(words, line))
    first, end = [], []
    for at in (np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])), pieces):
        stop = np.append(at[1:], len(words))
        long = stop - at >= SHORTEST
        first.append(at[long])
        end.append(stop[long])
    # what is still short goes with the last piece before it and with the first one after it
    stop = np.append(pieces[1:], len(words))
    of = doc[pieces]
    lone = np.flatnonzero(stop - pieces < SHORTEST)
    before = lone[(lone > 0) & (of[lone] == of[lone - 1])]
    first.append(pieces[before - 1])
    end.append(stop[before])
    after = lone[lone + 1 < len(pieces)]
    after = after[of[after] == of[after + 1]]
    first.append(pieces[after])
    end.append(stop[after + 1])
    # a line of one piece is one unit
    both = np.unique(np.concatenate(first) * (len(words) + 1) + np.concatenate(end))
    first, end = both // (len(words) + 1), both % (len(words) + 1)
    return words, starts, doc[first], first, end


def _nodes(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the units' word sequences (Python-independent, 64 bits)."""
    if not len(first):
        return np.zeros(0, dtype=np.int64)
    # sum of word * base**position over the unit, from running sums of word * base**index
    n = len(words) + 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _power_table(_ODD, n)[:-1], dtype=np.uint64)])
    value = (total[end] - total[first]) * _power_table(_INVERSE, n)[first]
    return mix(value + mix((end - first).astype(np.uint64))).view(np.int64)


_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_tables: dict = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    if n > 1 << 18:  # a very long text
        return _powers(np.uint64(base), n)
    if base not in _tables:
        _tables[base] = _powers(np.uint64(base), 1 << 18)
    return _tables[base][:n]


def _large(first: np.ndarray, end: np.ndarray, percent: int) -> np.ndarray:
    """Units with shingles enough that one more or less leaves two different ones similar."""
    least = math.ceil(percent / (100 - percent)) if percent < 100 else 1 << 30
    return end - first - SHINGLE + 1 >= least


def _ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(range number, position)`` of all positions of the ranges ``first .. first + size``."""
    of = np.repeat(np.arange(len(first)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def _least(values: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The least of ``values`` in each range ``low .. low + size`` (of 1 or more): of the two spans of the power of 2 below."""
    level = np.frexp(size)[1] - 1  # 2**level <= size
    out = np.empty(len(low), dtype=values.dtype)
    for k in range(int(level.max(initial=-1)) + 1):
        of = np.flatnonzero(level == k)
        out[of] = np.minimum(values[low[of]], values[low[of] + size[of] - (1 << k)])
        values = np.minimum(values[:-(1 << k)], values[1 << k:])
    return out


def _distinct(of: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(set, member)`` in ascending order, each once."""
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    return of[new], value[new]


def _similar(shingles: np.ndarray, low: np.ndarray, size: np.ndarray, pairs: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (rows of two range numbers) have Jaccard >= t."""
    of, place = _ranges(low[pairs].ravel(), size[pairs].ravel())
    of, value = _distinct(of, shingles[place])
    order = np.lexsort((value, of // 2))
    row, value = of[order] // 2, value[order]
    twice = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
    inter = np.bincount(row[1:][twice], minlength=len(pairs))
    union = np.bincount(row, minlength=len(pairs)) - inter
    return inter * 100 >= union * percent


def _lone_pairs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(places in keys.ravel() of each first row, of each second)`` of the keys that exactly two rows of ``keys`` have."""
    flat = keys.ravel()
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    begins = np.flatnonzero(np.concatenate([np.ones(min(len(flat), 1), dtype=bool), flat[1:] != flat[:-1]]))
    two = begins[np.diff(np.append(begins, len(flat))) == 2]
    return order[two], order[two + 1]


_UNIT = np.dtype([("node", "<i8"), ("first", "<i4"), ("end", "<i4")])


def _scanned(percent: int, bands: int, rows: int):
    """Every text's paragraphs, and once per chunk (in its first row) the large ones' MinHash keys and the links found at once.

    ``units`` holds a text's paragraphs as ``_UNIT``, ``keys`` the distinct large units' nodes, then ``bands`` keys of each.
    Units of one text often overlap and so share keys: where exactly two units of a chunk do, they are compared here.
    The second one's key has 1 as its lowest bit, other keys 0.  ``links`` holds the pairs that are similar.
    """
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(_ODD))

    def scan(batches):
        for b in batches:
            for start, data, offsets in text_chunks(b.column("text")):
                words, starts, doc, first, end = _units(data, offsets)
                shingles, at = shingle_fingerprints(words, starts, SHINGLE)
                nodes = _nodes(words, first, end)
                large = np.flatnonzero(_large(first, end, percent))
                large = large[np.unique(nodes[large], return_index=True)[1]]
                # a large unit's shingles are one range; the least hash of each range, for each seed
                low, size = at[doc[large]] + first[large] - starts[doc[large]], (end - first)[large] - SHINGLE + 1
                keys = np.zeros((len(large), bands), dtype=np.uint64)
                for k in range(bands if len(large) else 0):
                    for r in range(rows):
                        keys[:, k] = mix(keys[:, k] + _least(mix(shingles ^ seeds[k * rows + r]), low, size))
                    keys[:, k] = mix(keys[:, k] ^ np.uint64(k + 1))
                keys &= ~np.uint64(1)
                one, other = _lone_pairs(keys)
                pairs = np.unique(np.stack([one // bands, other // bands], axis=1), axis=0)
                pairs = pairs[_similar(shingles, low, size, pairs, percent)] if len(pairs) else pairs
                keys.ravel()[other] |= np.uint64(1)
                k = len(offsets) - 1
                units = np.empty(len(nodes), dtype=_UNIT)
                units["first"], units["end"], units["node"] = first - starts[doc], end - starts[doc], nodes
                cut = (_UNIT.itemsize * np.searchsorted(doc, np.arange(k + 1))).astype(np.int32)
                units = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(cut), pa.py_buffer(units.tobytes())])
                packed = [[x.tobytes()] + [None] * (k - 1) if x.size else [None] * k for x in
                          (np.concatenate([nodes[large].view(np.uint64), keys.ravel()]), nodes[large][pairs])]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(start, k), b.column("text_hash").slice(start, k),
                     pa.array(np.diff(starts), pa.int64()), units,
                     *[pa.array(x, pa.binary()) for x in packed]],
                    ["id", "text_hash", "n_words", "units", "keys", "links"])

    return scan


def _link_rows(batches):
    for b in batches:
        for v in b.column("links"):
            pair = np.frombuffer(v.as_buffer(), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])


def _key_nodes(bands: int):
    """A batch's ``(key, node)``."""
    def pairs(b):
        for v in b.column("keys"):
            flat = np.frombuffer(v.as_buffer(), dtype=np.uint64)
            m = len(flat) // (1 + bands)
            yield np.stack([flat[m:], np.repeat(flat[:m], bands)], axis=1)

    return pairs


def _flat_units(b):
    """``(row of the batch, first, end, node)`` of a batch's units."""
    units = b.column("units")
    cut = np.frombuffer(units.buffers()[1], dtype=np.int32, count=len(units) + 1 + units.offset)[units.offset:]
    raw = units.buffers()[2] if cut[-1] > cut[0] else b""
    flat = np.frombuffer(raw, dtype=np.uint8)[cut[0]:cut[-1]].copy().view(_UNIT)
    return (np.repeat(np.arange(b.num_rows), np.diff(cut) // _UNIT.itemsize),
            *(np.ascontiguousarray(flat[c]) for c in ("first", "end", "node")))


def _node_places(b):
    """A batch's ``(node, place)``: a place is a document (id and text) and a first word."""
    row, first, _, node = _flat_units(b)
    ids = b.column("id")
    doc = mix(np.asarray(ids.fill_null(0)).view(np.uint64) + np.asarray(ids.is_null()).astype(np.uint64) * np.uint64(_ODD))
    doc = mix(doc ^ np.asarray(b.column("text_hash")).view(np.uint64))
    yield np.stack([node.view(np.uint64), mix(doc[row] + first.astype(np.uint64))], axis=1)


_HELD = 1 << 20  # pairs that a task holds before it passes them on


def _blocks(pairs_of, buckets: int):
    """Pairs of 64-bit numbers (key, value) as blocks of those whose keys fall into one bucket."""
    def block(held):
        pairs = np.concatenate(held)
        pairs = pairs[np.argsort(pairs[:, 0])]
        new = np.ones(len(pairs), dtype=bool)
        new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
        pairs = pairs[new]
        bucket = ((pairs[:, 0] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # ascends with the key
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        cut = (16 * np.append(at, len(pairs))).astype(np.int32)
        rows = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(cut), pa.py_buffer(pairs.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), rows], ["bucket", "pairs"])

    def scan(batches):
        held = []
        for b in batches:
            for pairs in pairs_of(b):
                if len(pairs):
                    held.append(pairs)
            if sum(map(len, held)) >= _HELD:
                yield block(held)
                held = []
        if held:
            yield block(held)

    return scan


def _met(marked: bool):
    """``(key, value, rows, seen)`` of the keys of all blocks that have at least two values, each pair once.

    If keys are ``marked``, their lowest bit is a mark and no part of them; ``seen`` says whether some row of the key has it.
    """
    mark = np.uint64(1 if marked else 0)

    def search(batches):
        parts = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for b in batches for v in b.column("pairs")]
        if not parts:
            return
        pairs = np.concatenate(parts).reshape(-1, 2)
        parts.clear()
        key, value, seen = pairs[:, 0] & ~mark, pairs[:, 1], pairs[:, 0] & mark
        order = np.lexsort((value, key))
        key, value, seen = key[order], value[order], seen[order].astype(np.int64)
        group = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        seen = np.maximum.reduceat(seen, group) == 1
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (value[1:] != value[:-1])
        rows = np.add.reduceat(new.astype(np.int64), group)
        of = np.repeat(np.arange(len(group)), np.diff(np.append(group, len(key))))
        some = np.flatnonzero(new & (rows > 1)[of])
        for k in range(0, len(some), 1 << 16):
            part = some[k:k + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[part].view(np.int64)), pa.array(value[part].view(np.int64)), pa.array(rows[of[part]]),
                 pa.array(seen[of[part]])], ["key", "value", "rows", "seen"])

    return search


def _met_values(table: DataFrame, pairs_of, buckets: int, marked: bool = False) -> DataFrame:
    """:func:`_met` of a table whose batches hold pairs."""
    blocks = table.mapInArrow(_blocks(pairs_of, buckets), "bucket int, pairs binary")
    return blocks.repartition(buckets, "bucket").mapInArrow(_met(marked), "key bigint, value bigint, rows bigint, seen boolean")


def _wanted_sets(data, offsets, percent: int, wanted: np.ndarray):
    """``(nodes, number of the node, its distinct shingles in ascending order)`` of a chunk's large units that may be wanted."""
    words, starts, doc, first, end = _units(data, offsets)
    nodes = _nodes(words, first, end)
    some = np.flatnonzero(_large(first, end, percent) & np.asarray(may_be_wanted(wanted, pa.array(nodes, pa.int64()))))
    _, once = np.unique(nodes[some], return_index=True)
    some = some[once]
    shingles, at = shingle_fingerprints(words, starts, SHINGLE)
    of, place = _ranges(at[doc[some]] + first[some] - starts[doc[some]], end[some] - first[some] - SHINGLE + 1)
    return (nodes[some], *_distinct(of, shingles[place]))


def _slots(shingles: np.ndarray) -> np.ndarray:
    return ((mix(shingles ^ np.uint64(_ODD)) >> np.uint64(32)) % np.uint64(PARITIES)).astype(np.int64)


def _parity_rows(of: np.ndarray, shingles: np.ndarray, n: int) -> np.ndarray:
    """Sets' sizes and the parities of their members over ``PARITIES`` slots, as 64-bit words: a row per set.

    Each member that only one of two sets has changes one parity, so the parities of two sets differ in
    no more places than the sets.
    """
    odd = (np.bincount(of * PARITIES + _slots(shingles), minlength=n * PARITIES) & 1).astype(np.uint8)
    words = np.packbits(odd).view(np.int64).reshape(n, PARITIES // 64)
    return np.concatenate([np.bincount(of, minlength=n)[:, None], words], axis=1)


def _parities(shingles: np.ndarray) -> np.ndarray:
    """:func:`_parity_rows` of one set."""
    return _parity_rows(np.zeros(len(shingles), dtype=np.int64), shingles, 1)[0]


def _contents(percent: int, wanted: np.ndarray):
    """The shingle sets of the large units whose node may be wanted and their parities, each once per chunk."""
    def rows(batches):
        for b in batches:
            for _, data, offsets in text_chunks(b.column("text")):
                nodes, of, value = _wanted_sets(data, offsets, percent, wanted)
                cut = (8 * np.searchsorted(of, np.arange(len(nodes) + 1))).astype(np.int32)
                sets = pa.Array.from_buffers(pa.binary(), len(nodes), [None, pa.py_buffer(cut), pa.py_buffer(value.tobytes())])
                sketch = _parity_rows(of, value, len(nodes)).astype(np.int64)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(sketch.ravel()), 1 + PARITIES // 64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), sets, flat.cast(pa.list_(pa.int64()))],
                                                 ["node", "set", "sketch"])

    return rows


def _close(percent: int):
    """Whether two sketches allow Jaccard >= t: the sets differ in at most (1 - t) / (1 + t) of their sizes' sum."""
    def holds(a, b):
        n, m = a[0], b[0]
        apart = reduce(lambda x, y: x + y, [F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(1, 1 + PARITIES // 64)])
        return ((F.least(n, m) * 100 >= F.greatest(n, m) * percent)
                & (apart * (100 + percent) <= (n + m) * (100 - percent)))

    return holds


def _hit_rows(wanted: np.ndarray):
    """Units whose node may be wanted."""
    def rows(batches):
        for b in batches:
            row, first, end, node = _flat_units(b)
            some = np.flatnonzero(np.asarray(may_be_wanted(wanted, pa.array(node, pa.int64()))))
            of = pa.array(row[some])
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(of), b.column("text_hash").take(of), pa.array(first[some]), pa.array(end[some]),
                 pa.array(node[some])], ["id", "text_hash", "first", "end", "node"])

    return rows


def _members(sets) -> tuple[np.ndarray, np.ndarray]:
    """``(row, member)`` of a binary column of 64-bit members."""
    sets = sets.combine_chunks() if isinstance(sets, pa.ChunkedArray) else sets
    cut = np.frombuffer(sets.buffers()[1], dtype=np.int32, count=len(sets) + 1 + sets.offset)[sets.offset:]
    raw = sets.buffers()[2]
    value = np.frombuffer(raw, dtype=np.uint8)[cut[0]:cut[-1]].copy().view(np.uint64) if raw is not None else np.zeros(0, np.uint64)
    return np.repeat(np.arange(len(sets)), np.diff(cut) // 8), value


def _jaccard(batches):
    for b in batches:
        (row_a, a), (row_b, z) = _members(b.column("set_a")), _members(b.column("set_b"))
        row, value = np.concatenate([row_a, row_b]), np.concatenate([a, z])
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        twice = (row[1:] == row[:-1]) & (value[1:] == value[:-1])  # a set has a member once
        inter = np.bincount(row[1:][twice], minlength=b.num_rows)
        union = np.bincount(row, minlength=b.num_rows) - inter
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(inter, pa.int64()),
                                          pa.array(union, pa.int64())], ["a", "b", "inter", "union"])


def _merged(units) -> list:
    """Touching and overlapping ``(first, end)`` as ``[first, end]``."""
    out = []
    for a, z in sorted(units):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


_KEEPER = "struct<id:bigint,text_hash:bigint,first:int,end:int,node:bigint>"
_EDGE = "struct<pos:bigint,other:bigint,other_pos:bigint>"
_RUNS = (f"id bigint, text_hash bigint, runs array<struct<start:bigint,end:bigint,left:{_EDGE},right:{_EDGE},"
         "sources:array<bigint>>>, repeated_words bigint")


def _grouped(row: np.ndarray, first: np.ndarray, end: np.ndarray):
    """:func:`_merged` of many rows: the units' order, their span's number in that order, and the spans' rows, starts and ends."""
    order = np.lexsort((end, first, row))
    wide = int(end.max(initial=0)) + 1
    reach = np.maximum.accumulate(end[order] + row[order] * wide)
    new = np.ones(len(order), dtype=bool)
    new[1:] = (first[order] + row[order] * wide)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    rows = row[order][at]
    last = np.append(at[1:], len(order))[:len(at)] - 1
    return order, np.cumsum(new) - 1, rows, first[order][at], reach[last] - rows * wide


def _runs(min_words: int):
    """A document's runs of removals, and for each edge where the same place is in the document that stays."""
    def run(batches):
        for b in batches:
            units, ids = b.column("units"), b.column("id")
            row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(units.offsets)))
            flat = units.flatten()
            first, end, node = (np.asarray(flat.field(c)).astype(np.int64) for c in ("first", "end", "node"))
            keeper = dict(zip(("id", "text_hash", "first", "end", "node"), flat.field("keeper").flatten()))
            kept = np.asarray(keeper["id"].is_valid())
            keeper = {c: np.asarray(v.fill_null(0)).astype(np.int64) for c, v in keeper.items()}
            own_id = np.asarray(ids.is_valid())[row] & kept & (np.asarray(ids.fill_null(0))[row] == keeper["id"])
            own = own_id & (np.asarray(b.column("text_hash"))[row] == keeper["text_hash"])
            _, _, rows, start, stop = _grouped(row, first, end)
            repeated = np.zeros(b.num_rows, dtype=np.int64)
            np.add.at(repeated, rows, np.where(stop - start >= min_words, stop - start, 0))

            gone = np.flatnonzero(kept & ~(own & (first == keeper["first"])))
            order, of, rows, start, stop = _grouped(row[gone], first[gone], end[gone])
            gone = gone[order]
            long = 2 * (stop - start) >= min_words
            place = np.cumsum(long) - 1
            gone, of = gone[long[of]], place[of[long[of]]]
            rows, start, stop = rows[long], start[long], stop[long]

            def edge(at, side):
                """The unit that ends the run there: the smallest one, of equal words if there is one."""
                best, run_of = gone[at], of[at]
                by = np.lexsort((node[best], (end - first)[best], node[best] != keeper["node"][best], run_of))
                best = best[by][np.unique(run_of[by], return_index=True)[1]]
                # a repeat inside the document keeps its edges
                return pa.StructArray.from_arrays(
                    [pa.array(x[best]) for x in ((first if side == "first" else end), keeper["text_hash"], keeper[side])],
                    fields=list(_EDGE_TYPE), mask=pa.array(own[best]))

            left, right = edge(first[gone] == start[of], "first"), edge(end[gone] == stop[of], "end")
            other = gone[~own_id[gone]]
            source_of, source = _distinct(of[~own_id[gone]], keeper["id"][other])
            sources = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(source_of, np.arange(len(rows) + 1)).astype(np.int32)), pa.array(source))
            found = pa.StructArray.from_arrays([pa.array(start), pa.array(stop), left, right, sources],
                                               fields=list(_RUN_TYPE.value_type))
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(b.num_rows + 1)).astype(np.int32)), found)
            schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("runs", _RUN_TYPE), ("repeated_words", pa.int64())])
            yield pa.RecordBatch.from_arrays([ids, b.column("text_hash"), runs.cast(_RUN_TYPE), pa.array(repeated)], schema=schema)

    return run


_EDGE_TYPE = pa.struct([("pos", pa.int64()), ("other", pa.int64()), ("other_pos", pa.int64())])
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("left", _EDGE_TYPE), ("right", _EDGE_TYPE),
                                ("sources", pa.list_(pa.int64()))]))


def _texts_of(wanted: np.ndarray):
    """Texts whose hash may be wanted."""
    def rows(batches):
        for b in batches:
            yield b.filter(may_be_wanted(wanted, b.column("text_hash")))

    return rows


def _contexts(batches):
    """The fingerprints of ``CONTEXT`` words before and after each of a text's positions."""
    for b in batches:
        positions, hashes = b.column("positions").to_pylist(), b.column("text_hash").to_pylist()
        out = [[], [], [], []]
        for first, data, offsets in text_chunks(b.column("text")):
            words, starts = word_fingerprints(data, offsets)
            for d in range(len(offsets) - 1):
                own = words[starts[d]:starts[d + 1]]
                for p in positions[first + d]:
                    out[0].append(hashes[first + d])
                    out[1].append(p)
                    out[2].append(own[max(0, p - CONTEXT):p].tobytes())
                    out[3].append(own[p:p + CONTEXT].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                                          pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())],
                                         ["h", "p", "before", "after"])


def _moved(mine_in, mine_out, other_in, other_out) -> int:
    """How far an edge moves out (or, below 0, in); words in order from the edge, inside the run and outside it."""
    if len(mine_in) and len(other_in) and mine_in[0] != other_in[0]:
        alien = ~np.isin(mine_in, other_in)
        return -(int(np.argmin(alien)) if not alien.all() else len(alien))
    n = min(len(mine_out), len(other_out))
    differ = np.flatnonzero(mine_out[:n] != other_out[:n])
    return int(differ[0]) if len(differ) else n


def _compared(batches):
    for b in batches:
        moved = []
        part = {c: [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in b.column(c)] for c in ("before", "after", "o_before", "o_after")}
        for k, right in enumerate(b.column("right_side").to_pylist()):
            m, o = [part["before"][k][::-1], part["after"][k]], [part["o_before"][k][::-1], part["o_after"][k]]
            moved.append(_moved(m[0], m[1], o[0], o[1]) if right else _moved(m[1], m[0], o[1], o[0]))
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in ("h", "pos", "other", "other_pos", "right_side")), pa.array(moved, pa.int64())],
            ["h", "pos", "other", "other_pos", "right_side", "moved"])


def _spans(min_words: int):
    """The runs with their edges moved, as removal spans."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            removed, sources = [], []
            for runs, edges in zip(b.column("runs").to_pylist(), b.column("edges").to_pylist()):
                moved = {(e["pos"], e["other"], e["other_pos"], e["right_side"]): e["moved"] for e in edges or ()}
                step = lambda e, right: moved.get((e["pos"], e["other"], e["other_pos"], right), 0) if e else 0
                placed = [(r["start"] - step(r["left"], False), r["end"] + step(r["right"], True), r["sources"]) for r in runs]
                found = [s for s in _merged((a, z) for a, z, _ in placed if a < z) if s[1] - s[0] >= min_words]
                removed.append([{"start": a, "end": z} for a, z in found])
                sources.append(sorted({i for a, z, ids in placed if any(x <= a and z <= y for x, y in found) for i in ids}))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("text_hash"), pa.array(removed, span), b.column("repeated_words"),
                 pa.array(sources, pa.list_(pa.int64()))], ["id", "text_hash", "removed", "repeated_words", "kept_in"])

    return run


def _edges_moved(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """``text_hash`` and its ``edges``: how far every edge of its runs moves."""
    run = runs.select("text_hash", F.explode("runs").alias("r"))
    edges = run.select("text_hash", F.explode(F.array(
        F.struct(F.col("r.left").alias("e"), F.lit(False).alias("right_side")),
        F.struct(F.col("r.right").alias("e"), F.lit(True).alias("right_side")))).alias("x"))
    edges = written(edges.where("x.e is not null").select(
        F.col("text_hash").alias("h"), "x.e.pos", "x.e.other", "x.e.other_pos", "x.right_side").distinct(), "edges")
    places = edges.select("h", "pos").union(edges.select("other", "other_pos")).distinct().groupBy("h").agg(
        F.collect_set("pos").alias("positions"))  # at most a text's paragraphs
    places = written(places, "edge-places")
    some = texts.select("text_hash", "text").mapInArrow(_texts_of(key_filter(places.select("h"))), "text_hash bigint, text string")
    asked = some.dropDuplicates(["text_hash"]).join(places, F.col("text_hash") == F.col("h")).select("text_hash", "text", "positions")
    found = written(asked.mapInArrow(_contexts, "h bigint, p bigint, before binary, after binary"), "contexts")
    other = found.select(F.col("h").alias("oh"), F.col("p").alias("op"), F.col("before").alias("o_before"),
                         F.col("after").alias("o_after"))
    both = (edges.join(found.withColumnRenamed("h", "mh"), (F.col("h") == F.col("mh")) & (F.col("pos") == F.col("p")))
            .join(other, (F.col("other") == F.col("oh")) & (F.col("other_pos") == F.col("op"))))
    moved = written(both.select("h", "pos", "other", "other_pos", "right_side", "before", "after", "o_before", "o_after").mapInArrow(
        _compared, "h bigint, pos bigint, other bigint, other_pos bigint, right_side boolean, moved bigint"), "moved")
    discard(found, places, edges)
    return moved.where("moved <> 0").groupBy(F.col("h").alias("text_hash")).agg(F.collect_list(F.struct(
        "pos", "other", "other_pos", "right_side", "moved")).alias("edges"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80,
                      recall: float = 0.99, rows: int = 2, min_words: int = 20) -> DataFrame:
    """One row per document: ``id_col``, ``n_words``, ``removed`` (word spans), ``removed_words``, ``repeated_words``,
    ``kept_in`` (ids of the documents that keep what was removed), ``text_hash``.

    ``repeated_words`` also counts the spans that stay here and repeat elsewhere.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    bands = tuned_bands(percent, recall, rows)
    table = written(texts.mapInArrow(_scanned(percent, bands, rows), "id bigint, text_hash bigint, n_words bigint, "
                                     "units binary, keys binary, links binary"), "scanned")
    # a bucket of pairs is worked on at once: about as many as 2 million words have
    n_words = table.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_words >> 21)
    met = _met_values(table.select("keys").where("keys is not null"), _key_nodes(bands), buckets, marked=True)
    # one common key is enough for a pair, whatever the sizes; two nodes that were compared where they met are left out
    product = written(met.where("rows > 2 or not seen").select("key", F.col("value").alias("node"), F.lit(1).alias("n"), "rows"),
                      "product")
    known = written(table.select("links").where("links is not null").mapInArrow(_link_rows, "a bigint, b bigint"), "known")
    scanned, table = table, written(table.drop("keys", "links"), "units")
    discard(scanned)
    nodes = written(product.select("node").distinct(), "nodes")
    contents = texts.select("text").mapInArrow(_contents(percent, key_filter(nodes, 64)), "node bigint, set binary, sketch array<bigint>")
    contents = written(contents.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "contents")
    discard(nodes)

    def verified(pairs):
        pairs = written(pairs.select("a", "b"), "pairs")
        if pairs.isEmpty():
            return pairs
        whole = (pairs.join(contents.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
                 .join(contents.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b"))
        found = whole.select("a", "b", "set_a", "set_b").mapInArrow(
            _jaccard, "a bigint, b bigint, inter bigint, `union` bigint")
        return found.where(F.col("inter") * 100 >= F.col("union") * percent).select("a", "b")

    def sketches(nodes):
        return contents.select("node", "sketch").join(nodes, "node", "left_semi")

    classes = pivot_classes(product, None, lambda a, b: F.lit(1), lambda a, b: F.lit(True), verified, sketches,
                            _close(percent), known)
    discard(contents, known)

    # Contents that stand in more than one place (a row repeated with one id and text is one place) ...
    units = table.select("id", "text_hash", "units")
    several = _met_values(units, _node_places, buckets).select(F.col("key").alias("node")).distinct()
    places = classes.select(F.col("node").alias("_n"), "component").join(several, F.col("node") == F.col("_n"), "full")
    places = written(places.select(F.coalesce("node", "_n").alias("node"), F.coalesce("component", "node").alias("component")), "places")
    # ... and where they do.
    hit = units.mapInArrow(_hit_rows(key_filter(places.select("node"))),
                           "id bigint, text_hash bigint, first int, end int, node bigint")
    hits = written(hit.join(places, "node"), "hits")
    here = F.struct("id", "text_hash", "first", "end", "node")
    heads = written(hits.where("id is not null").groupBy("component").agg(F.min(here).alias("keeper")), "heads")
    none = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("id", "long"), ("text_hash", "long"), ("first", "int"),
                                                                ("end", "int"), ("node", "long"))])
    placed = hits.join(heads.withColumnRenamed("component", "_c"), F.col("component") == F.col("_c"), "left")
    grouped = (placed.groupBy("id", "text_hash").agg(F.collect_set(F.struct(
        "first", "end", "node", F.coalesce("keeper", none).alias("keeper"))).alias("units")))
    runs = written(grouped.mapInArrow(_runs(min_words), _RUNS), "runs")
    discard(hits, heads, places)
    edges = _edges_moved(texts, runs).withColumnRenamed("text_hash", "_e")
    moved = runs.join(edges, F.col("text_hash") == F.col("_e"), "left").select("id", "text_hash", "runs", "edges", "repeated_words")
    found = written(moved.mapInArrow(
        _spans(min_words), "id bigint, text_hash bigint, removed array<struct<start:bigint,end:bigint>>, "
                           "repeated_words bigint, kept_in array<bigint>"), "removals")
    found = found.withColumnRenamed("id", "_id").withColumnRenamed("text_hash", "_h")
    out = table.select("id", "text_hash", "n_words").join(
        found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_h")), "left")
    removed = F.coalesce("removed", F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return out.select(
        F.col("id").alias(id_col), "n_words", removed.alias("removed"),
        F.aggregate(removed, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("removed_words"),
        F.coalesce("repeated_words", F.lit(0)).alias("repeated_words"),
        F.coalesce("kept_in", F.array().cast("array<bigint>")).alias("kept_in"), "text_hash")


def without_removals(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the words of the removed spans taken out of the text (white space between words becomes one space)."""
    words = F.regexp_extract_all(text_or_empty(text_col), F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    kept = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
                    lambda x: ~F.exists("_removed", lambda s: (s["start"] <= x["i"]) & (x["i"] < s["end"])))
    gone = passages.where(F.size("removed") > 0).select(
        F.col(id_col).alias("_id"), F.col("text_hash").alias("_h"), F.col("removed").alias("_removed")).distinct()
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col("_id"))
                       & (F.xxhash64(text_or_empty(text_col)) == F.col("_h")), "left")
    return joined.withColumn(text_col, F.when(F.col("_removed").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(kept, lambda x: x["w"]), " "))).drop("_id", "_h", "_removed")
