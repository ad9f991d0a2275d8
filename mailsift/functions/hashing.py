"""Content digests, SimHash fingerprints and signed feature hashing."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from mailsift import vocabulary as V

# FNV-1a 64-bit parameters.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3

#: Characters of text that a worker takes apart together.
PIECE_CHARS = 1 << 19

_TOKEN = re.compile("[a-z0-9]+")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def _fold_characters(tokens: list[str] | list[bytes], start: int, step: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Character-wise hash of many ASCII tokens at once, one column of characters at a time."""
    lengths = np.fromiter((len(t) for t in tokens), np.int64, len(tokens))
    order = np.argsort(-lengths, kind="stable")
    ranked = lengths[order]
    empty = tokens[0][:0]
    joined = empty.join(tokens[i] for i in order)
    flat = np.frombuffer(joined if isinstance(joined, bytes) else joined.encode("ascii"), np.uint8).astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum(ranked)[:-1]))
    hashes = np.full(len(tokens), start, np.uint64)
    for position in range(int(ranked[0])):
        live = int(np.searchsorted(-ranked, -position, side="left"))
        hashes[:live] = step(hashes[:live], flat[starts[:live] + position])
    out = np.empty_like(hashes)
    out[order] = hashes
    return out


def _fnv1a(tokens: list[str]) -> np.ndarray:
    return _fold_characters(tokens, FNV_OFFSET, lambda h, ch: (h ^ ch) * np.uint64(FNV_PRIME))


def _numbered(tokens_per_text: list[list]) -> tuple[np.ndarray, list, np.ndarray]:
    """(token numbers in order, distinct tokens, number of tokens per text) of one batch."""
    sizes = np.fromiter((len(t) for t in tokens_per_text), np.int64, len(tokens_per_text))
    flat = np.empty(int(sizes.sum()), dtype=object)
    flat[:] = [t for tokens in tokens_per_text for t in tokens]
    codes, distinct = pd.factorize(flat)
    return codes, list(distinct), sizes


def in_pieces(texts: pd.Series, limit: int = PIECE_CHARS) -> Iterator[pd.Series]:
    """The same texts in order, at most ``limit`` characters (or one text) at a time: tokens take many times the room of their text."""
    total = np.cumsum([len(t) if t else 0 for t in texts])
    first = 0
    while first < len(texts):
        before = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + limit, "right")))
        yield texts.iloc[first:last]
        first = last


def simhash_batch(texts: pd.Series, chunk: int = 256) -> pd.Series:
    """64-bit SimHash of every text in one Arrow batch, as signed longs; 0 without a token."""
    codes, distinct, sizes = _numbered([_TOKEN.findall(t.lower()) if t else [] for t in texts])
    result = np.zeros(len(texts), np.uint64)
    if distinct:
        hashes = _fnv1a(distinct).astype("<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes = bits.astype(np.int8) * 2 - 1
        weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
        ends = np.cumsum(sizes)
        filled = np.flatnonzero(sizes)
        for part in np.array_split(filled, max(1, -(-len(filled) // chunk))):
            begin, end = ends[part[0]] - sizes[part[0]], ends[part[-1]]
            offsets = ends[part] - sizes[part] - begin
            total = np.add.reduceat(votes[codes[begin:end]], offsets, axis=0, dtype=np.int32)
            result[part] = np.where(total > 0, weights, np.uint64(0)).sum(axis=1, dtype=np.uint64)
    return pd.Series(result.view(np.int64))


@F.pandas_udf(LongType())
def simhash64(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        for some in in_pieces(texts):
            yield simhash_batch(some)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


SPARSE_COUNTS = StructType().add("buckets", ArrayType(IntegerType())).add("counts", ArrayType(IntegerType()))

#: Bytes as they are hashed: digits and letters in lower case, all else as zero.
_HASHED = np.zeros(256, np.uint8)
for _symbol in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _HASHED[_symbol] = _HASHED[ord(chr(_symbol).upper())] = _symbol

#: Base of the string hash and its inverse, modulo 2**32.
_BASE, _INVERSE = 31, pow(31, -1, 1 << 32)


@functools.lru_cache(4)
def _powers(base: int, bits: int) -> np.ndarray:
    """The first ``2**bits`` powers of ``base``, modulo 2**32."""
    factors = np.full(1 << bits, base, np.uint32)
    factors[0] = 1
    return np.multiply.accumulate(factors, dtype=np.uint32)


def _token_hashes(written: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(31-polynomial string hash as unsigned 32-bit value, length, number of the text) of every token, in order.

    ``written`` holds the bytes of all texts end to end, ``bounds`` where each begins and the last ends. With ``P`` the sum of every
    character over the power of 31 at its place, a token's hash is the difference of ``P`` at its ends times the power at its last
    character: one pass over the characters, whatever the tokens.
    """
    characters = _HASHED[written]
    inside = np.concatenate([[False], characters != 0, [False]])
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    # Texts touch; no token reaches from one into the next.
    cuts = bounds[(bounds > 0) & (bounds < len(written))]
    first[cuts], last[cuts - 1] = inside[cuts + 1], inside[cuts]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    bits = len(written).bit_length()
    sums = np.zeros(len(written) + 1, np.uint32)
    np.cumsum(characters * _powers(_INVERSE, bits)[: len(written)], dtype=np.uint32, out=sums[1:])
    hashes = (sums[last + 1] - sums[first]) * _powers(_BASE, bits)[last]
    return hashes, last - first + 1, np.searchsorted(bounds, first, "right") - 1


def ngram_table(written: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, signed counts, bounds of each text's share) of the 1- and 2-grams of texts whose bytes lie end to end; as ``ngram_counts``.

    Bytes above 127 are parts of other characters and hash to nothing, as in ASCII with such characters replaced.
    The hash of ``"a b"`` is put together from the hashes of ``a`` and ``b``.
    """
    hashes, lengths, rows = _token_hashes(written, bounds)
    powers = _powers(_BASE, int(lengths.max(initial=0) + 1).bit_length())
    together = np.flatnonzero(rows[:-1] == rows[1:])
    second, size = hashes[together + 1], lengths[together + 1]
    joined = hashes[together] * powers[size + 1] + np.uint32(ord(" ")) * powers[size] + second
    grams = np.concatenate([hashes, joined])
    slots = np.concatenate([rows, rows[together]]) * V.HASH_DIMENSION + grams % np.uint32(V.HASH_DIMENSION)
    # Sorted with the sign as last bit, so that the grams of a slot lie side by side.
    ordered = np.sort(slots * 2 + (grams < np.uint32(1 << 31)))
    slots, signs = ordered >> 1, (ordered & 1).astype(np.int32) * 2 - 1
    firsts = np.flatnonzero(np.diff(slots, prepend=-1))
    sums = np.add.reduceat(signs, firsts, dtype=np.int32) if len(firsts) else signs
    used, sums = slots[firsts][sums != 0], sums[sums != 0]
    edges = np.searchsorted(used, np.arange(len(bounds)) * V.HASH_DIMENSION)
    return (used % V.HASH_DIMENSION).astype(np.int32), sums, edges


def ngram_counts(texts: pd.Series) -> list[tuple[np.ndarray, np.ndarray]]:
    """Signed bucket counts of the 1- and 2-grams of each text, ordered by bucket, zero sums dropped."""
    written = [t.encode("ascii", "replace") if t else b"" for t in texts]
    bounds = np.cumsum([0, *(len(w) for w in written)])
    buckets, counts, edges = ngram_table(np.frombuffer(b"".join(written), np.uint8), bounds)
    return [(buckets[a:b], counts[a:b]) for a, b in zip(edges[:-1], edges[1:])]


@F.pandas_udf(SPARSE_COUNTS)
def hash_ngrams(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Signed feature hashing into ``HASH_DIMENSION`` buckets, as parallel sparse arrays."""
    for texts in batches:
        for some in in_pieces(texts):
            found = ngram_counts(some)
            yield pd.DataFrame({"buckets": [b for b, _ in found], "counts": [c for _, c in found]})


def ngram_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, ``buckets``, ``values``): the counts of ``hash_ngrams`` over their length, some texts at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key, texts = batch.columns
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        written = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + PIECE_CHARS, "right")) - 1)
            buckets, counts, edges = ngram_table(written[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
            squares = np.concatenate([[0], np.cumsum(counts.astype(np.int64) ** 2)])
            values = counts / np.repeat(np.sqrt(np.diff(squares[edges])), np.diff(edges))
            arrays = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat)) for flat in (buckets, values)]
            yield pa.RecordBatch.from_arrays([key.slice(first, last - first), *arrays], [batch.schema.names[0], "buckets", "values"])
            first = last


def name_uuid(name: Column) -> Column:
    """Version-3 UUID of a name's bytes, without a namespace."""
    digest = F.md5(name)
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-3"),
        F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )
