"""Small tables with the awkward cases: NULLs, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          # names that operators use inside
          "id long, text_hash long, node long, key long, n long, row string, size string, digest string, skey string, "
          "copies string, units string, kept string, word_count string")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def edited(rng, text, k):
    w = text.split(" ")
    for _ in range(k):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def rows(seed=3, n=60):
    """``(doc_id, text, source)``: prose, copies, near copies, a shared passage, NULLs, repeats, one long text."""
    rng = random.Random(seed)
    out, texts = [], []
    passage = prose(rng, 60)
    for i in range(n):
        kind = i % 6
        if kind == 1 and texts:
            t = rng.choice(texts)
        elif kind == 2 and texts:
            t = edited(rng, rng.choice(texts), rng.randrange(1, 4))
        elif kind == 3:
            t = prose(rng, 40) + " " + passage + " " + prose(rng, 50)
        else:
            t = prose(rng, rng.choice([3, 8, 30, 90, 200]))
        texts.append(t)
        out.append((1000 - 7 * i, t, rng.choice(["a", "b", "B", "é", None, "hot", "hot", "hot"])))
    out += [(5000, None, "a"), (5001, "", "b"), (5002, " \t\n ", None), (5003, "One", "a"), (5004, "ONE", "a"),
            (5005, "one two three four", "b"), (5006, "One Two  three\nFOUR", "b"), (None, texts[0], "a"),
            (None, None, None), (5007, prose(rng, 20000), "long"), (5008, "é" * 300 + " " + "x" * 5000, "b")]
    out += [out[0], out[0], out[5]]  # repeated rows
    return out


def frame(spark, data):
    return spark.createDataFrame(
        [(i, t, "en", s, None if t is None else len(t), *(None,) * 13) for i, t, s in data], SCHEMA).repartition(5)


def collected(df, *cols):
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
