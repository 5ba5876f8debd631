import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainlens.llm import rans, tokens
from chainlens.llm.token_cache import cached_token_counts
from chainlens.llm.token_output import read_token_ids, token_output

from . import fixtures as fx

ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "x.\nY z", "a  b", "a​ b", "é ́ x",
       "ẛ̣ a", "İ I ſ", "a\x1c b", "a\x85 b", "don't 'tis we'll 've", "<|endoftext|>", "a <|endoftext|> b",
       "x<|startoftext|>y <|endoftext|>", "日本 語 テスト", "🙂 🙂🙂 é", "1234 12 3", "a\t b", "tab\there", "ab " * 3000,
       "x" * 20000, "A!! B!! c*** | d |", "trailing\n", "\n lead", "ſt ﬁ Å", "﻿bom x﻿ y"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_the_library_on_whole_texts(name, spark):
    rng = random.Random(1)
    texts = ODD + [t or "" for _, t, _ in fx.rows()] + [
        "".join(rng.choice(["a", "Bc", " ", "  ", "\n", ".", "é", "9", " ", "'s", "́", "!!"])
                for _ in range(80)) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(50).collect()]
    want = [e.ids for e in tokens.load(name).encode_batch(texts, add_special_tokens=False)]
    ids, counts = tokens.Encoder(name), tokens.Encoder(name, counts=True)
    for _ in range(2):  # empty and filled cache
        assert [np.frombuffer(b, "<u4").tolist() for b in ids.encode(texts)] == want
        assert counts.encode(texts) == [len(w) for w in want]


@given(st.lists(st.text(max_size=30), max_size=8))
@settings(max_examples=150, deadline=None)
def test_pieces_on_any_text(texts):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        want = [e.ids for e in tokens.load(name).encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(b, "<u4").tolist() for b in tokens.Encoder(name).encode(texts)] == want


def test_generations_of_the_piece_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 5)
    enc = tokens.Encoder("byte_bpe_50k.json")
    texts = [" ".join(f"w{(7 * i + k) % 23}" for k in range(9)) for i in range(40)]
    want = [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    for t, w in zip(texts, want):
        assert np.frombuffer(enc.encode([t])[0], "<u4").tolist() == w


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_parts_inside_words_equal_the_library(name):
    rng = random.Random(5)
    some = ["a", "Bc", "é", "ɏ", "ɐ", "×", "÷", "9", "12", " ", " ", "\n", "\t", ".", ",", "!?", "'", "'s", "'re", "<", "_", "\x7f",
            "\0", "\u00a0", "<|endoftext|>", "ñandú", "字"]
    for kinds in (some[:16], some[:22], some):
        texts = ["".join(rng.choice(kinds) for _ in range(rng.randrange(60))) for _ in range(400)]
        want = [e.ids for e in tokens.load(name).encode_batch(texts, add_special_tokens=False)]
        enc = tokens.Encoder(name)
        for _ in range(2):
            assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)] == want


def test_a_word_with_marks_is_no_new_one():
    enc = tokens.Encoder("byte_bpe_50k.json")
    enc.encode(["word, word. (word)\nword! it's", " word"])
    assert set(enc.byte_level.known) == {b"word", b",", b" word", b".", b" (", b")", b"\n", b"!", b" it", b"'s"}
    assert not enc.spaced and not enc.first


def test_tasks_of_a_stage_share_their_pieces():
    tokens.forget()
    enc = tokens.stage_encoder("byte_bpe_50k.json", 3)
    assert tokens.stage_encoder("byte_bpe_50k.json", 3) is enc
    assert tokens.stage_encoder("byte_bpe_50k.json", 4) is not enc and len(tokens._held) == 1
    tokens.forget()
    assert not tokens._held


def test_counts_and_cache(spark, tmpdir_fresh):
    data = fx.rows()
    tok = tokens.load("word_bpe_49k.json")

    def brute(data):
        n = [len(tok.encode(t or "", add_special_tokens=False).ids) for _, t, _ in data]
        return sorted(((i, len((t or "").encode()), k, k > 2048) for (i, t, _), k in zip(data, n)),
                      key=lambda r: tuple((v is None, str(v)) for v in r))

    cache = f"{tmpdir_fresh}/cache"
    cols = ("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert fx.collected(cached_token_counts(fx.frame(spark, data[:40]), "word_bpe_49k.json", cache), *cols) == brute(data[:40])
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for _, t, _ in data[:40]})
    # a second run encodes only what is new, and a run without news appends nothing
    assert fx.collected(cached_token_counts(fx.frame(spark, data), "word_bpe_49k.json", cache), *cols) == brute(data)
    assert spark.read.parquet(cache).count() == len({t or "" for _, t, _ in data})
    cached_token_counts(fx.frame(spark, data), "word_bpe_49k.json", cache).count()
    assert spark.read.parquet(cache).count() == len({t or "" for _, t, _ in data})
    assert cached_token_counts(fx.frame(spark, []), "word_bpe_49k.json").count() == 0


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 32768, 32769, 131072, 131073, 300001])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    s = np.minimum(rng.zipf(1.3, n), 50256).astype(np.uint32)
    if not n:
        assert rans.encode(s, s, s) == [] and len(rans.decode([], s, s)) == 0
        return
    present, freq = rans.frequency_table(s)
    assert int(freq.sum()) == 1 << rans.SCALE and freq.min() >= 1
    blocks = rans.encode(s, present, freq)
    assert (rans.decode(blocks, present, freq) == s).all()
    with pytest.raises(ValueError):
        rans.decode([*blocks[:-1], {**blocks[-1], "crc32": blocks[-1]["crc32"] ^ 1}], present, freq)
    if n > 30000:
        words = np.frombuffer(blocks[0]["words"], "<u4") ^ np.uint32(0x5A5A5A5A)
        with pytest.raises(ValueError):
            rans.decode([{**blocks[0], "words": words.tobytes()}, *blocks[1:]], present, freq)


def test_rans_one_symbol_and_flat_tables():
    for s in (np.zeros(5000, np.uint32), np.arange(60000, dtype=np.uint32), np.full(1, 50256, np.uint32)):
        p, f = rans.frequency_table(s)
        assert (rans.decode(rans.encode(s, p, f), p, f) == s).all()


def test_token_files(spark, tmpdir_fresh):
    data = fx.rows()
    tok = tokens.load("byte_bpe_50k.json")
    path = f"{tmpdir_fresh}/files"
    got = token_output(fx.frame(spark, data), "byte_bpe_50k.json", 2, path=path, segment_tokens=3000).collect()
    ids = {}
    for i, t, _ in data:
        ids.setdefault(i, []).append(tok.encode(t or "", add_special_tokens=False).ids + [2])
    got.sort(key=lambda r: r.start)
    keys = [r.doc_id for r in got]
    assert keys == [None] * 2 + sorted(k for k in keys if k is not None) and len(got) == len(data)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        own = [w for w in ids[r.doc_id] if zlib.crc32(np.array(w, "<u4").tobytes()) == r.ids_crc32]
        assert own and len(own[0]) == r.n_tokens
    back = read_token_ids(spark, path).collect()
    assert sorted(map(str, ((r.doc_id, r.ids) for r in back))) == sorted(
        str((i, w)) for i, own in ids.items() for w in own)
    assert token_output(fx.frame(spark, []), "byte_bpe_50k.json", 2).count() == 0


def test_rows_without_ids_are_dealt_to_many_partitions(spark, tmpdir_fresh):
    """A third of the rows under NULL: they are encoded in several tasks, in order, and come back whole."""
    from chainlens.llm.token_output import token_file_index, write_token_files

    data = [(None if i % 3 == 0 else i, f"text number {i % 400} of many", "a") for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with more rows
    try:
        write_token_files(fx.frame(spark, data), tmpdir_fresh, "byte_bpe_50k.json", 2)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = spark.read.parquet(tmpdir_fresh)
    holding = files.where(F.exists("doc_ids", lambda i: i.isNull())).select("part").distinct().count()
    assert holding >= 2
    rows = token_file_index(spark, tmpdir_fresh).orderBy("start").collect()
    assert len(rows) == 3000 and [r.doc_id for r in rows] == sorted((i for i, _, _ in data), key=lambda i: (i is not None, i or 0))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
