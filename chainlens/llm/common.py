"""Shared helpers of the operators: written tables in the shared folder, word fingerprints."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import chainlens
from chainlens.session import ensure_checkpoint_dir


#: whole texts go to the workers in batches of at most this many bytes (or one text)
_BATCH_BYTES = 2 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, so that they import it wherever they run.

    Where the session has Spark's default of 64 MiB for a batch of rows to a worker, it is lowered.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_chainlens_shipped", False):
        return
    package = Path(chainlens.__file__).parent
    target = Path(tempfile.mkdtemp(prefix="chainlens-py-"), "chainlens.zip")  # on the driver, which sends it out
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    sc.addPyFile(str(target))
    sc._chainlens_shipped = True
    atexit.register(shutil.rmtree, target.parent, ignore_errors=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder the cluster names in ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark removes a job's shuffle files as soon as the job has ended, not when the driver next
#: collects garbage; safe for a table that is written once and then only read from its files.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back (cuts the lineage, survives executors).

    A table without a ``path`` of its own goes when the application ends.
    """
    spark = df.sparkSession
    own, path = path is None, path or shared_path(spark, name)
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before) if before is not None else spark.conf.unset(_CLEAN_UP)
    if own:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path if own else None
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`written` that nothing will read again (those with a path of their own stay).

    Whatever was made from them must have been written, too: it can't be computed again.
    """
    for table in tables:
        if getattr(table, "written_path", None):
            spark = table.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(table.written_path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: slots of a key filter for each key, and the bounds of their number (2**27 slots are 16 MiB)
_SLOTS_PER_KEY, _LEAST_SLOTS, _MOST_SLOTS = 8, 1 << 16, 1 << 27


def _slot_of(key, slots: int):
    folded = key.bitwiseXOR(F.shiftrightunsigned(key, 32)).bitwiseXOR(F.shiftrightunsigned(key, 15))
    return folded.bitwiseAND(F.lit(slots - 1))


def _slot_number(keys: int, per_key: int = _SLOTS_PER_KEY) -> int:
    slots, wanted = _LEAST_SLOTS, min(per_key * keys, _MOST_SLOTS)
    while slots < wanted:
        slots *= 2
    return slots


def _slot_bits(slot: DataFrame, slots: int) -> np.ndarray:
    """A bit for each of the slots (column ``slot``), as 32-bit words."""
    words = slot.groupBy(F.shiftright("slot", 5).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 32 AS int))")).alias("bits"))
    found = words.toArrow()  # at most slots / 32 rows
    out = np.zeros(slots // 32, dtype=np.uint32)
    out[np.asarray(found.column("word"), dtype=np.int64)] = np.asarray(found.column("bits"), dtype=np.int64).astype(np.uint32)
    return out


def key_filter(keys: DataFrame, per_key: int = _SLOTS_PER_KEY) -> np.ndarray:
    """A bit for each slot that some key (the one bigint column, distinct or not, no NULLs) falls into.

    Rows without a wanted key are passed over with it before they are shuffled or worked on.  It holds
    at most 16 MiB; where keys are more than it tells apart (about 2**26), it lets more rows through,
    which costs time and changes no result.
    """
    slots = _slot_number(keys.count(), per_key)
    return _slot_bits(keys.select(_slot_of(F.col(keys.columns[0]), slots).alias("slot")), slots)


def repeated_key_filter(keys: DataFrame) -> np.ndarray:
    """As :func:`key_filter`, a bit for each slot that at least two of the keys fall into.

    Every key that occurs twice has its bit; a key that occurs once may have it by a slot in common.  What is shuffled are slot
    numbers with their counts, combined in the task.
    """
    slots = _slot_number(keys.count())
    met = keys.select(_slot_of(F.col(keys.columns[0]), slots).alias("slot")).groupBy("slot").count().where("count > 1")
    return _slot_bits(met.select("slot"), slots)


def may_be_wanted(bits: np.ndarray, keys: pa.Array) -> pa.Array:
    """For an Arrow bigint column without NULLs: whether each key may be among the filter's."""
    k = np.asarray(keys).astype(np.int64).view(np.uint64)
    slot = (k ^ (k >> _U(32)) ^ (k >> _U(15))) & _U(len(bits) * 32 - 1)
    return pa.array(((bits[(slot >> _U(5)).astype(np.int64)] >> (slot & _U(31)).astype(np.uint32)) & np.uint32(1)) == 1)


def text_or_empty(col: str):
    """The text column with NULL read as the empty string."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


# --- word fingerprints -------------------------------------------------------------------------
# Words are hashed for a whole batch at once: the Arrow text column is one byte buffer, a byte
# mask says which bytes belong to words, and each word gets a polynomial of its bytes modulo 2**64
# with a final bit mix.  Two different words share a fingerprint with probability about 2**-64.

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

#: bytes of words ``[^\x20\x09-\x0D]+``
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (digits, a-z after lower-casing, all non-ASCII)
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_STEP = 1 << 16


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_POW = _powers(_BASE, _STEP)
_POW_HIGH = _powers(_U(0xD6E8FEB86659FD93), 1 << 12)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift-xor-multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def release_memory() -> None:
    """Give a worker's freed memory back to the system; workers live on between stages, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library: its allocator decides
    _trim = None


def text_chunks(batch_texts: pa.Array, max_bytes: int = 512 << 10):
    """Slices of a string array with about ``max_bytes`` each (a longer text is a slice alone).

    Yields ``(first row, byte buffer, offsets)``; NULL counts as empty.
    """
    arr = batch_texts.cast(pa.large_string()) if not pa.types.is_large_string(batch_texts.type) else batch_texts
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if not len(arr):
        return
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64, count=len(arr) + 1 + arr.offset)[arr.offset:]
    data = arr.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(arr):
        j = int(np.searchsorted(off, off[i] + max_bytes, side="right")) - 1
        j = min(max(j, i + 1), len(arr))
        yield i, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j
    release_memory()


def word_fingerprints(data: np.ndarray, offsets: np.ndarray, mask: np.ndarray = NOT_SPACE):
    """Fingerprints of all words in a chunk.

    A-Z is lower-cased first.  Returns ``(fingerprints, starts)`` where ``starts[d]:starts[d+1]``
    are the words of text ``d``.
    """
    n_docs = len(offsets) - 1
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(n_docs + 1, dtype=np.int64)
    low = _LOWER[data]
    inside = mask[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1]
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    word_at = np.searchsorted(starts, offsets).astype(np.int64)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), word_at
    # position of every byte inside its word
    spans = np.diff(np.append(starts, len(data)))
    k = np.arange(len(data), dtype=np.int64)
    k[starts[0]:] -= np.repeat(starts, spans)
    value = _BYTE[low]
    if int(k[starts[0]:].max(initial=0)) < _STEP:
        k[:starts[0]] = 0
        value *= _POW[k]
    else:  # words of 65,536 bytes and more
        k[:starts[0]] = 0
        value *= _POW[k & (_STEP - 1)]
        value *= _POW_HIGH[(k >> 16) & (len(_POW_HIGH) - 1)]
    value[~inside] = 0
    return mix(np.add.reduceat(value, starts)), word_at


def shingle_fingerprints(words: np.ndarray, starts: np.ndarray, n: int = 5):
    """Fingerprints of all runs of ``n`` words; a text with fewer words is one run, without words none.

    Returns ``(fingerprints, starts)`` with repeats, in text order.
    """
    mult = _powers(_U(0xC2B2AE3D27D4EB4F), n)
    counts = np.diff(starts)
    out_counts = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out_starts = np.concatenate([[0], np.cumsum(out_counts)])
    total = len(words)
    out = np.empty(int(out_starts[-1]), dtype=np.uint64)
    if total >= n:
        rolled = np.zeros(total - n + 1, dtype=np.uint64)
        for i in range(n):
            rolled += words[i:total - n + 1 + i] * mult[i]
        rolled = mix(rolled + _U(n))
    else:
        rolled = np.zeros(0, dtype=np.uint64)
    full = np.flatnonzero(counts >= n)
    if len(full):
        lens = out_counts[full]
        ends = np.cumsum(lens)
        inner = np.arange(int(ends[-1])) - np.repeat(ends - lens, lens)
        out[np.repeat(out_starts[full], lens) + inner] = rolled[np.repeat(starts[full], lens) + inner]
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        w = words[starts[d]:starts[d + 1]]
        out[out_starts[d]] = mix(np.array([(w * mult[:len(w)]).sum(dtype=np.uint64) + _U(len(w))], dtype=np.uint64))[0]
    return out, out_starts
