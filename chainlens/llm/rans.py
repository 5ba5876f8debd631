"""Static range asymmetric numeral system over interleaved lanes (numpy).

A *segment* is a run of symbols with one frequency table (sum 2**SCALE).  Its symbols are cut into
independent blocks of ``BLOCK`` symbols; inside a block symbol ``i`` belongs to lane ``i % LANES``,
and every lane is a 64-bit coder state that moves 32-bit words to or from the block's one stream.
All lanes of all blocks advance together, one numpy step per ``LANES`` symbols.

For each block the encoder keeps the states and the stream position at every ``CHECKPOINT`` steps,
so decoding starts at any of them; :func:`decode` runs all checkpoints of all blocks side by side.
"""

from __future__ import annotations

import zlib

import numpy as np

SCALE = 18
LANES = 256
BLOCK = 1 << 17
CHECKPOINT = 128  # steps, so 32,768 symbols
_LOW = np.uint64(1 << 31)
_U = np.uint64


def frequency_table(symbols: np.ndarray):
    """``(present symbols, frequencies)``: every present symbol gets at least 1, the sum is 2**SCALE."""
    counts = np.bincount(symbols)
    present = np.flatnonzero(counts)
    if len(present) > 1 << SCALE:
        raise ValueError(f"more than 2**{SCALE} symbols in a segment")
    c = counts[present].astype(np.float64)
    f = np.maximum(1, np.floor(c * ((1 << SCALE) / c.sum()))).astype(np.int64)
    order = np.argsort(-f, kind="stable")
    spare = (1 << SCALE) - int(f.sum())
    if spare > 0:
        f[order[0]] += spare
    i = 0
    while spare < 0:  # rare symbols rounded up: take it from the frequent ones
        take = min(-spare, int(f[order[i]]) - 1, max(1, int(f[order[i]]) >> 3))
        f[order[i]] -= take
        spare += take
        i = (i + 1) % len(order)
    return present.astype(np.uint32), f.astype(np.uint32)


def encode(symbols: np.ndarray, present: np.ndarray, freq: np.ndarray) -> list[dict]:
    """Blocks of a segment: ``n``, ``words``, ``states`` and ``offsets`` by checkpoint, ``crc32``."""
    n = len(symbols)
    if not n:
        return []
    where = np.zeros(int(present[-1]) + 1, dtype=np.int64)
    where[present] = np.arange(len(present))
    index = where[symbols]
    f_of = freq.astype(np.uint64)
    c_of = np.concatenate([[0], np.cumsum(f_of)[:-1]]).astype(np.uint64)
    n_blocks = -(-n // BLOCK)
    steps = -(-min(n, BLOCK) // LANES)
    grid = np.zeros((n_blocks * BLOCK if n_blocks > 1 else steps * LANES), dtype=np.int64)
    grid[:n] = index
    grid = grid.reshape(n_blocks, -1, LANES)
    sizes = np.full(n_blocks, BLOCK, dtype=np.int64)
    sizes[-1] = n - BLOCK * (n_blocks - 1)
    lane = np.arange(LANES)
    x = np.full((n_blocks, LANES), _LOW, dtype=np.uint64)
    cap = steps * LANES + 1
    stream = np.zeros((n_blocks, cap), dtype=np.uint32)
    head = np.full(n_blocks, cap, dtype=np.int64)
    marks = []
    limit, rest = f_of << _U(45), _U(1 << SCALE) - f_of
    for t in range(steps - 1, -1, -1):
        # all blocks but the last are full; that one may have ended, or end inside this step
        blocks = n_blocks if t * LANES < sizes[-1] else n_blocks - 1
        s, y = grid[:blocks, t, :], x[:blocks]
        part = blocks == n_blocks and (t + 1) * LANES > sizes[-1]
        emit = y >= limit[s]
        if part:
            active = np.ones((blocks, LANES), dtype=bool)
            active[-1] = t * LANES + lane < sizes[-1]
            emit &= active
        if emit.any():
            rank = np.cumsum(emit, axis=1)
            head[:blocks] -= rank[:, -1]
            rows, cols = np.nonzero(emit)
            moved = y[rows, cols]
            stream[rows, head[rows] + rank[rows, cols] - 1] = moved.astype(np.uint32)
            y[rows, cols] = moved >> _U(32)
        # (q << SCALE) + remainder + start = q * (2**SCALE - f) + y + start
        z = (y // f_of[s]) * rest[s] + y + c_of[s]
        x[:blocks] = np.where(active, z, y) if part else z
        if t % CHECKPOINT == 0:
            marks.append((t, x.copy(), head.copy()))
    out = []
    raw = symbols.astype("<u4")
    for b in range(n_blocks):
        own = [(st[b], h[b]) for t, st, h in reversed(marks) if t * LANES < sizes[b]]
        out.append({
            "n": int(sizes[b]),
            "words": stream[b, head[b]:].astype("<u4").tobytes(),
            "states": np.concatenate([st for st, _ in own]).astype("<u8").tobytes(),
            "offsets": [int(h - head[b]) for _, h in own],
            "crc32": zlib.crc32(raw[b * BLOCK:b * BLOCK + int(sizes[b])].tobytes()),
        })
    return out


def decode(blocks: list[dict], present: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """The symbols of a segment (uint32); raises ``ValueError`` where a checksum differs."""
    if not blocks:
        return np.zeros(0, dtype=np.uint32)
    total = 1 << SCALE
    slot = np.repeat(np.arange(len(present), dtype=np.uint32), freq)
    f_of = freq.astype(np.uint64)
    c_of = np.concatenate([[0], np.cumsum(f_of)[:-1]]).astype(np.uint64)
    words, states, at, left, base = [], [], [], [], 0
    for b in blocks:
        w = np.frombuffer(b["words"], dtype="<u4")
        st = np.frombuffer(b["states"], dtype="<u8").reshape(-1, LANES)
        words.append(w)
        states.append(st)
        for k, o in enumerate(b["offsets"]):
            at.append(base + o)
            left.append(min(CHECKPOINT * LANES, b["n"] - k * CHECKPOINT * LANES))
        base += len(w)
    words.append(np.zeros(1, dtype="<u4"))
    stream = np.concatenate(words)
    x = np.concatenate(states).astype(np.uint64)
    at, left = np.array(at, dtype=np.int64), np.array(left, dtype=np.int64)
    lane = np.arange(LANES)
    steps = int(-(-left.max() // LANES))
    out = np.zeros((len(left), steps, LANES), dtype=np.uint32)
    low = _U(total - 1)
    for t in range(steps):
        active = (t * LANES + lane)[None, :] < left[:, None]
        r = x & low
        s = slot[r.astype(np.int64)]
        out[:, t, :] = s
        y = f_of[s] * (x >> _U(SCALE)) + r - c_of[s]
        need = active & (y < _LOW)
        if need.any():
            rank = np.cumsum(need, axis=1)
            rows, cols = np.nonzero(need)
            # a damaged stream may ask for words behind its end; the checksum tells
            got = stream[np.minimum(at[rows] + rank[rows, cols] - 1, len(stream) - 1)].astype(np.uint64)
            y[rows, cols] = (y[rows, cols] << _U(32)) | got
            at += rank[:, -1]
        x = np.where(active, y, x)
    flat = out.reshape(len(left), -1)
    symbols = present[np.concatenate([flat[i, :k] for i, k in enumerate(left)])]
    begin = 0
    for b in blocks:
        if zlib.crc32(symbols[begin:begin + b["n"]].astype("<u4").tobytes()) != b["crc32"]:
            raise ValueError("checksum of a token block differs")
        begin += b["n"]
    return symbols
