"""Vectorised text primitives shared by the operators of this subpackage.

Texts reach Python as Arrow batches (``mapInArrow``) and are handled as flat byte arrays: word
boundaries come from a byte class table and word hashes from prefix sums of a polynomial, so no
Python object is made per word.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes handled at once by a Python worker; a longer text is handled alone, whole.
SLICE_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n * 5 // 4, 1 << 19)
        a = np.full(size, _P, np.uint64)
        b = np.full(size, _PINV, np.uint64)
        a[0] = b[0] = 1
        _pow, _inv = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser; returns a new array."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def checkpoint_folder(sc) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset a temporary folder, on one machine alone: on a cluster it is an error."""
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all machines share")
        sc.setCheckpointDir(shared or Path(tempfile.mkdtemp(prefix="ckpt")).as_uri())
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage."""
    checkpoint_folder(df.sparkSession.sparkContext)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it from there."""
    path = f"{checkpoint_folder(df.sparkSession.sparkContext)}/stored-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def broadcast_once(spark, value):
    return spark.sparkContext.broadcast(value)


def tokenizer_path(name: str, folder: str | None = None) -> str:
    return os.path.join(folder or "/opt/tokenizers", name)


def sliced(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of about ``most`` text bytes each, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // max(1, most)
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))


def flat(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each after one blank, and where each begins; null is as empty."""
    col = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        col = pc.utf8_lower(col)
    col = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), col, pa.scalar(" ", pa.large_string()))
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[: offsets[-1]], offsets


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


_LATIN_LETTERS = np.zeros(256, bool)  # after C2: the letters among the signs of Latin-1
_LATIN_LETTERS[[0xAA, 0xB5, 0xBA]] = True


def word_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Whether each byte of UTF-8 text belongs to a word, and which ones begin a character that is a word by itself (None: none does).

    Typographic and full-width signs part words, as ASCII ones do. Characters of scripts written without blanks (Chinese, Japanese, Thai, Lao,
    Khmer, Burmese) are words of their own.
    """
    w = _WORD[data]
    at = np.flatnonzero(data == 0xC2)
    if len(at):
        at = at[~_LATIN_LETTERS[data[np.minimum(at + 1, len(data) - 1)]]]
        w[at] = False
        w[np.minimum(at + 1, len(data) - 1)] = False
    at = np.flatnonzero(data >= 0xE0)
    if not len(at):
        return w, None
    lead, one, two = data[at], data[np.minimum(at + 1, len(data) - 1)], data[np.minimum(at + 2, len(data) - 1)]
    # general punctuation to symbols (U+2000 to U+2BFF), CJK punctuation, full-width signs
    sign = ((lead == 0xE2) & (one < 0xB0)) | ((lead == 0xE3) & (one == 0x80)) | ((lead == 0xEF) & (((one == 0xBC) & ((two <= 0x8F) | ((two >= 0x9A) & (two <= 0xA0)) | (two >= 0xBB))) | ((one == 0xBD) & ((two <= 0x80) | ((two >= 0x9B) & (two <= 0xA5)))) | (one == 0xB8) | (one == 0xB9)))
    for k in range(3):
        w[at[sign] + k] = False
    alone = ((lead == 0xE3) & (one >= 0x81)) | ((lead >= 0xE4) & (lead <= 0xE9)) | ((lead == 0xE0) & (one >= 0xB8) & (one <= 0xBB)) | ((lead == 0xE1) & (((one >= 0x80) & (one <= 0x82)) | ((one >= 0x9E) & (one <= 0x9F)))) | ((lead == 0xF0) & (one >= 0xA0) & (one <= 0xB2))
    return w, at[alone] if alone.any() else None


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends."""
    w, alone = word_bytes(data)
    edge = np.diff(w.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if alone is not None:
        cut = np.union1d(alone, alone + np.where(data[alone] >= 0xF0, 4, 3))
        start, end = np.union1d(start, cut[w[np.minimum(cut, len(data) - 1)] & (cut < len(data))]), np.union1d(end, cut[w[cut - 1] & (cut > 0)])
    return start, end


class Words:
    """Words (letters, digits and non-ASCII characters but signs) of a column of texts, lower case.

    ``start``/``end``: byte spans in ``data``; ``first``: index of each text's first word, with one
    more at the end, so that text ``i`` has the words ``first[i]:first[i + 1]``.
    """

    def __init__(self, column: pa.Array):
        self.data, self.offsets = flat(column, lower=True)
        self.start, self.end = word_spans(self.data)
        self.first = np.searchsorted(self.start, self.offsets)
        n = len(self.data)
        p, self._inv = _powers(n + 1)
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * p[:n], out=self._sum[1:])

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._inv[start])

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def word_hashes(text: str) -> np.ndarray:
    return Words(pa.array([text])).hashes()


def ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one text and the index of each one's first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h[:m].copy()
    for k in range(1, n):
        out *= np.uint64(0x9FB21C651E98DF25)
        out += h[k : k + m]
    ok = np.ones(m, bool)
    for cut in range(1, n):
        at = first[1:-1] - cut
        ok[at[(at >= 0) & (at < m)]] = False
    at = np.flatnonzero(ok)
    return mix(out[at]), at


class HashSet:
    """Membership of 64-bit hashes: a table on the top 16 bits first, then binary search."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(np.asarray(values, np.uint64))
        self.table = np.zeros(1 << 16, bool)
        self.table[(self.values >> np.uint64(48)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` that are members, and their indexes in ``values``."""
        if not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[(h >> np.uint64(48)).astype(np.int64)])
        k = np.searchsorted(self.values, h[at])
        k[k == len(self.values)] = 0
        ok = self.values[k] == h[at]
        return at[ok], k[ok]


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], text: str, schema: str, most: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over parts of batches; ``make()`` runs once in each task, on the worker."""

    def run(batches):
        f = make()
        for batch in batches:
            for part in sliced(batch, text, most):
                out = f(part)
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def picked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id and text alone, as ``doc_id`` long and ``text``: other columns can't clash with results."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
