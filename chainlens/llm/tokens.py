"""Token ids and counts of whole texts by the ``tokenizers`` library, with a cache of pieces.

The library encodes at about 3 MB/s a core.  Both vocabulary kinds used here split a text at white
space before anything else, so a text cut before a single ASCII space that follows a character
which is no white space encodes to the concatenation of its parts.  Each task keeps the parts it
has met (two generations of at most ``CACHE_PIECES``, gone with the task or, from :func:`stage_encoder`, with the stage)
and gives only new ones to the library; a text for which the cut isn't safe goes to the library whole.  Byte-level
vocabularies also split between Latin letters, digits, ASCII marks and white space, so there whole batches of texts are cut at
once and only their distinct parts are looked up.  ``tests/llm`` compares both on whole texts.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa

from chainlens.llm.common import release_memory

CACHE_PIECES = 400_000
#: bytes the kept pieces may take, by the estimate of ``_PIECE_BYTES`` and their length
CACHE_BYTES = 100 << 20
_PIECE_BYTES = 200
_CHUNK = 200

#: a space after white space of any kind (also of characters that only some libraries count so)
_UNSAFE = re.compile("[\\s\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff] ")
_loaded: dict = {}
_held: dict = {}


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; a path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def load(name: str):
    """The tokenizer of a file, once per worker."""
    if name not in _loaded:
        from tokenizers import Tokenizer

        _loaded[name] = Tokenizer.from_file(tokenizer_path(name))
    return _loaded[name]


def digest(name: str) -> str:
    """Version of a tokenizer: SHA-256 of its file and the library's version."""
    import tokenizers

    with open(tokenizer_path(name), "rb") as f:
        return hashlib.sha256(f.read() + b"\0tokenizers " + tokenizers.__version__.encode()).hexdigest()


def _as_bytes(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


class _Pieces(dict):
    """piece -> ids (bytes) or count, filled by the library.

    ``lead`` is what stands before a piece: a space, or nothing for the first piece of a text.
    """

    def __init__(self, tok, counts: bool, lead: str):
        super().__init__()
        self.tok, self.counts, self.lead, self.bytes, self.last = tok, counts, lead, 0, {}

    def value(self, ids):
        return len(ids) if self.counts else _as_bytes(ids)

    def fill(self, pieces) -> None:
        """Add ``pieces``.  Those that end in no white space go to the library many at a time."""
        pieces = list(dict.fromkeys(pieces))
        if self.last:
            self.update((p, self.last[p]) for p in pieces if p in self.last)
            pieces = [p for p in pieces if p not in self]
        self.bytes += sum(map(len, pieces)) + _PIECE_BYTES * len(pieces)
        if self.lead:
            safe = [p for p in pieces if p and ("!" <= p[-1] <= "~" or p[-1].isalnum())]
            letters = [p for p in safe if p.isalpha()]
            self._together(letters, True)
            if len(letters) < len(safe):
                self._together([p for p in safe if not p.isalpha()], False)
            alone = [p for p in pieces if p not in self] if len(safe) < len(pieces) else []
        else:
            alone = pieces
        for i in range(0, len(alone), 256):
            some = alone[i:i + 256]
            for p, e in zip(some, self.tok.encode_batch([self.lead + p for p in some], add_special_tokens=False)):
                self[p] = self.value(e.ids)

    def _together(self, pieces: list, letters: bool) -> None:
        """Encode many pieces in one call and cut the ids at the pieces.

        Pieces of letters alone are one word of the library each (checked), others are told apart
        by the offsets.
        """
        for i in range(0, len(pieces), _CHUNK):
            some = pieces[i:i + _CHUNK]
            e = self.tok.encode(self.lead + self.lead.join(some), add_special_tokens=False)
            cut = None
            if letters:
                at = e.word_ids
                if at[-1] == len(some) - 1:
                    cut = [0, *[k for k in range(1, len(at)) if at[k] != at[k - 1]], len(at)]
            if cut is None or len(cut) != len(some) + 1:
                ends = np.cumsum([len(p) + len(self.lead) for p in some])
                at = np.searchsorted(ends, [o[1] for o in e.offsets], side="left")
                cut = np.searchsorted(at, np.arange(len(some) + 1)).tolist()
            if self.counts:
                self.update(zip(some, (b - a for a, b in zip(cut, cut[1:]))))
            else:
                ids = _as_bytes(e.ids)
                self.update(zip(some, (ids[4 * a:4 * b] for a, b in zip(cut, cut[1:]))))

    def trim(self) -> None:
        """Start a new generation when this one is full; the last one stays for look-ups."""
        if len(self) > CACHE_PIECES or self.bytes > CACHE_BYTES:
            self.last = dict(self)
            self.clear()
            self.bytes = 0


#: byte classes of :class:`_ByteLevel`: a space, other white space, letters (A-Z, a-z, U+00C0 to U+024F), digits, marks, others
_SPACE, _WHITE, _LETTER, _DIGIT, _MARK, _OTHER = range(6)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[33:127] = _MARK
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _CLASS[0x80:0xC0] = _CLASS[0xC3:0xCA] = _LETTER
_CLASS[9:14] = _WHITE
_CLASS[32] = _SPACE


class _ByteLevel:
    """Encodes texts by the parts that the byte-level expression splits always, each distinct one of a batch once.

    A part begins where the class of the byte changes, a space stands before the part it leads, and what follows an
    apostrophe belongs to it (``'s``).  Texts with other characters, white space behind white space or an added token aren't cut.
    """

    def __init__(self, tok):
        self.tok, self.known, self.last, self.bytes = tok, {}, {}, 0
        self.added = [t.content.encode() for t in tok.get_added_tokens_decoder().values()]

    @staticmethod
    def fits(tok) -> bool:
        """Whether the vocabulary splits texts by the byte-level expression alone."""
        spec = json.loads(tok.to_str())
        split = spec.get("pre_tokenizer") or {}
        return (spec.get("normalizer") is None and spec.get("post_processor") is None and split.get("type") == "ByteLevel"
                and split.get("use_regex") is True and split.get("add_prefix_space") is False)

    def encode(self, texts: list) -> list:
        """The ids of each text, None for those that aren't cut."""
        if not texts:
            return []
        raw = [t.encode() for t in texts]
        whole = b"\0".join(raw)
        met = [t for t in self.added if t in whole]
        safe = self._safe(raw) & np.array([not any(t in r for t in met) for r in raw], dtype=bool)
        out: list = [None] * len(texts)
        some = np.flatnonzero(safe).tolist()
        for i, ids in zip(some, self._ids([raw[i] for i in some])):
            out[i] = ids
        return out

    @staticmethod
    def _safe(raw: list) -> np.ndarray:
        data = np.frombuffer(b"\0".join(raw) + b"\0", dtype=np.uint8)
        ends = np.cumsum([len(r) + 1 for r in raw])
        kind = _CLASS[data]
        bad = kind == _OTHER
        bad[ends - 1] = False  # what stands between the texts
        white = kind <= _WHITE
        bad[1:] |= white[1:] & white[:-1]
        bad[1:] |= (data[:-1] == 0xC9) & (data[1:] >= 0x90)
        bad[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # two signs among the letters
        safe = np.ones(len(raw), dtype=bool)
        safe[np.searchsorted(ends, np.flatnonzero(bad), side="right")] = False
        return safe

    def _ids(self, raw: list) -> list:
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)])
        if not offsets[-1]:
            return [b""] * len(raw)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        kind = _CLASS[data]
        begins = np.ones(len(data), dtype=bool)
        begins[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE) & (data[:-1] != 39) | (kind[1:] <= _WHITE)
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(begins)
        at = np.append(starts, len(data)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        which = np.asarray(parts.indices)
        values = self._values(parts.dictionary.to_pylist())
        size = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
        flat, first, each = np.frombuffer(b"".join(values), dtype="<u4"), np.cumsum(size) - size, size[which]
        ends = np.cumsum(each)
        ids = flat[np.arange(ends[-1]) + np.repeat(first[which] - (ends - each), each)].tobytes()
        cut = (4 * np.concatenate([[0], ends])[np.searchsorted(starts, offsets)]).tolist()
        return [ids[a:z] for a, z in zip(cut, cut[1:])]

    def _values(self, parts: list) -> list:
        """The ids of distinct parts."""
        if len(self.known) > CACHE_PIECES or self.bytes > CACHE_BYTES:
            self.last, self.known, self.bytes = self.known, {}, 0
        known, last = self.known, self.last
        new = [p for p in parts if p not in known]
        self.bytes += sum(map(len, new)) + _PIECE_BYTES * len(new)
        if last:
            known.update((p, last[p]) for p in new if p in last)
            new = [p for p in new if p not in known]
        # one word of the library each: led by a space, or with a line break before it
        plain = [p for p in new if b"'" not in p and not p.isspace()]
        self._together([p for p in plain if p[0] == 32], "", 1)
        self._together([p for p in plain if p[0] != 32], "\n", 2)
        alone = [p for p in new if p not in known]
        for i in range(0, len(alone), 256):
            some = alone[i:i + 256]
            for p, e in zip(some, self.tok.encode_batch([p.decode() for p in some], add_special_tokens=False)):
                known[p] = _as_bytes(e.ids)
        return [known[p] for p in parts]

    def _together(self, parts: list, before: str, step: int) -> None:
        """Encode many parts in one call and cut the ids at every ``step``-th word (where there are as many as there should be)."""
        for i in range(0, len(parts), _CHUNK):
            some = parts[i:i + _CHUNK]
            e = self.tok.encode("".join([before + p.decode() for p in some]), add_special_tokens=False)
            at = np.asarray(e.word_ids)
            cut = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            if len(cut) == step * len(some) + 1:
                ids = _as_bytes(e.ids)
                self.known.update((p, ids[4 * a:4 * z]) for p, a, z in zip(some, cut[step - 1::step], cut[step::step]))


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids (bytes), or counts their tokens."""

    def __init__(self, name: str, counts: bool = False):
        self.tok, self.counts = load(name), counts
        self.byte_level = _ByteLevel(self.tok) if _ByteLevel.fits(self.tok) else None
        self.spaced = _Pieces(self.tok, counts, " ")
        self.first = _Pieces(self.tok, counts, "")

    def encode(self, texts: list) -> list:
        """The ids or the count of each text."""
        out: list = [None] * len(texts)
        if self.byte_level is not None:
            out = self.byte_level.encode(texts)
            if self.counts:
                out = [None if ids is None else len(ids) // 4 for ids in out]
        which, size = [], 0
        for i, t in enumerate(texts):
            if out[i] is not None:
                continue
            if t.startswith(" ") or _UNSAFE.search(t):
                out[i] = self.spaced.value(self.tok.encode(t, add_special_tokens=False).ids)
                continue
            which.append(i)
            size += len(t)
            if size > 2 << 20:
                self._pieces(texts, which, out)
                which, size = [], 0
        self._pieces(texts, which, out)
        return out

    def _pieces(self, texts, which, out):
        self.spaced.trim()
        self.first.trim()
        get, parts, values, missing = self.spaced.get, [], [], []
        for i in which:
            p = texts[i].split(" ")
            v = list(map(get, p))
            v[0] = self.first.get(p[0])
            parts.append(p)
            values.append(v)
            if None in v:
                missing.append([j for j, x in enumerate(v) if x is None])
            else:
                missing.append(())
        self.first.fill(p[0] for p, m in zip(parts, missing) if m and m[0] == 0)
        self.spaced.fill(p[j] for p, m in zip(parts, missing) for j in m if j)
        for i, p, v, m in zip(which, parts, values, missing):
            for j in m:
                v[j] = self.spaced[p[j]] if j else self.first[p[0]]
            out[i] = sum(v) if self.counts else b"".join(v)


def stage_encoder(name: str, stage: int) -> Encoder:
    """The :class:`Encoder` of a stage: its tasks in one worker share the pieces met."""
    key = (name, stage)
    if key not in _held:
        forget()
        _held[key] = Encoder(name)
    return _held[key]


def forget() -> None:
    """Let go of the pieces of :func:`stage_encoder`, as a stage that follows in the worker does."""
    if _held:
        _held.clear()
        release_memory()
