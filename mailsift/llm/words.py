"""Words of whole texts as 64-bit codes, straight from Arrow buffers.

A batch of texts is one byte buffer. Words, their codes, shingles and rolling window codes are found with a fixed
number of NumPy passes over it, so the cost per byte is the same for short and very long texts. Large batches are
cut into pieces of whole texts first; a piece is larger than ``PIECE_BYTES`` only when one single text is.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

PIECE_BYTES = 1 << 20
BATCH_ROWS = 1000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers of a stream."""
    with np.errstate(over="ignore"):
        steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix(steps + np.uint64(seed * 0x632BE59BD9B4E019 % (1 << 64)))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    plain = stream(1, 256)
    lowered = plain.copy()
    lowered[65:91] = plain[97:123]
    return plain, lowered


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    base = int(stream(2, 1)[0]) | 1
    both = []
    with np.errstate(over="ignore"):
        for factor in (base, pow(base, -1, 1 << 64)):
            steps = np.full(n, factor, np.uint64)
            steps[:1] = 1
            both.append(np.cumprod(steps))
    return both[0], both[1]


BYTE_CODES, LOWER_BYTE_CODES = _tables()
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[[9, 10, 11, 12, 13, 32]] = False


@dataclass
class Words:
    """``codes`` of all words of a piece; words of text ``i`` are ``[bounds[i], bounds[i + 1])``."""

    codes: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def room(self) -> np.ndarray:
        """For each word how many words its text still has from it on."""
        return np.repeat(self.bounds[1:], self.counts) - np.arange(len(self.codes))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, after which the worker hands the memory it has freed back: workers outlive tasks and wait beside others."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return tidied


def in_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``; from now on the session hands texts to Python ``BATCH_ROWS`` rows at a time, which bounds both sides' buffers."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; a null counts as an empty text."""
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(filled, pa.ChunkedArray):
        filled = filled.combine_chunks()
    _, offsets, data = filled.buffers()
    if len(filled) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    cuts = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    if data is None or cuts[-1] == cuts[0]:
        return np.zeros(0, np.uint8), np.zeros(len(filled) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]], cuts - cuts[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text (or one row)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        total = np.cumsum(sizes)
        first = 0
        while first < batch.num_rows:
            before = total[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def split_words(texts: pa.Array, lower: bool) -> Words:
    """Words are what lies between the bytes 0x20 and 0x09-0x0D; ``lower`` folds A-Z."""
    data, offsets = text_buffer(texts)
    inside = IN_WORD[data]
    n = len(data)
    if n == 0 or not inside.any():
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), empty, empty, data, offsets)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begins[edge[inside[edge]]] = True
    closes[edge[inside[edge - 1]] - 1] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    forth, back = _powers_for(n)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum((LOWER_BYTE_CODES if lower else BYTE_CODES)[data] * forth[:n], out=total[1:])
        codes = mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    return Words(codes, np.searchsorted(starts, offsets, "left"), starts, ends, data, offsets)


_kept_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers for ``n`` bytes; those of a usual piece are made once per process."""
    if n > PIECE_BYTES:
        return _powers(n)
    if not _kept_powers:
        _kept_powers.append(_powers(PIECE_BYTES))
    return _kept_powers[0]


def beginnings(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the words of at least ``length`` bytes: their numbers and the codes of their first ``length`` bytes (A-Z folded)."""
    longer = np.flatnonzero(words.ends - words.starts >= length)
    total = np.zeros(len(longer), np.uint64)
    factors = stream(4 + length, length) | np.uint64(1)
    with np.errstate(over="ignore"):
        for at in range(length):
            total += LOWER_BYTE_CODES[words.data[words.starts[longer] + at]] * factors[at]
        return longer, mix(total + np.uint64(length))


def grams(codes: np.ndarray, n: int, seed: int = 3) -> np.ndarray:
    """Codes of the ``n`` words from each word on; the last ``n - 1`` entries reach past the end and mean nothing."""
    factors = stream(seed + n, n) | np.uint64(1)
    out = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for step in range(min(n, len(codes))):
            out[: len(codes) - step] += codes[step:] * factors[step]
        return mix(out)


def windows(codes: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Codes of the ``n``-word windows by a rolling polynomial; entry ``i`` is the window that starts at word ``i``."""
    count = len(codes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    base = int(stream(seed, 1)[0]) | 1
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(codes) - 1, base, np.uint64)]))
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(codes ^ np.uint64(seed)) * powers)])
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(count - 1, inverse, np.uint64)]))
        return mix((total[n:] - total[:count]) * back)


def signed(codes: np.ndarray) -> np.ndarray:
    """The same bits as Spark's ``bigint``."""
    return codes.view(np.int64) if codes.dtype == np.uint64 else codes


def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Row ``i`` is the list ``values[bounds[i]:bounds[i + 1]]``."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))
