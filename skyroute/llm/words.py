"""Vectorised word splitting and hashing over Arrow string columns.

A word is a maximal run of bytes that are not separators.  All positions, hashes and
windows of a *chunk* of documents (about ``CHUNK_BYTES`` of text, or one longer document)
are computed with numpy at once, so Python cost is per chunk and not per word.

A word's hash joins two polynomials over its bytes, modulo two primes below 2**31, and its length, and
passes them through a mixing function; words longer than a chunk have a BLAKE2 digest instead.  Two
different words agree with a chance of about 2**-62; no pattern of letters makes them agree whatever
the base, as it would modulo 2**64.  Hashes are the same on every machine and in every run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_U = np.uint64
#: (prime, base) of each polynomial.
_FIELDS = ((2147483647, 1588635695), (2147483629, 1223106847))


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry table that is True at the bytes of the given closed ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words ``[^\x20\x09-\x0D]+``.
WHITE_SPACE = separators((0x20, 0x20), (0x09, 0x0D))
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: ASCII letters (lower case), digits and all bytes above ASCII.
NOT_ALPHANUMERIC = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@cache
def _powers(base: int, prime: int) -> np.ndarray:
    """Powers of a base modulo a prime, for every byte of a stretch of words."""
    out = np.ones(CHUNK_BYTES, dtype=np.uint64)
    n = 1
    while n < len(out):
        out[n : 2 * n] = out[: min(n, len(out) - n)] * _U(pow(base, n, prime)) % _U(prime)
        n *= 2
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes; both edges must not decrease."""
    out = np.zeros(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):  # a stretch of spans at a time, so that memory follows the stretch and not the text
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK_BYTES, side="right")))
        low, high = int(starts[at]), int(ends[to - 1])
        if high - low > CHUNK_BYTES:
            out[at] = np.frombuffer(hashlib.blake2b(data[low:high].tobytes(), digest_size=8).digest(), dtype=np.uint64)[0]
        else:
            letters = data[low:high].astype(np.uint64) + _U(1)
            s, e = starts[at:to] - low, ends[at:to] - low
            joined = (e - s).astype(np.uint64)
            for prime, base in _FIELDS:
                sums = np.zeros(high - low + 1, dtype=np.uint64)
                np.cumsum(letters * _powers(base, prime)[: high - low], out=sums[1:])  # below 2**60
                value = (sums[e] - sums[s]) % _U(prime) * _powers(pow(base, -1, prime), prime)[s] % _U(prime)
                joined = mix(joined + (value << _U(32)) + value)
            out[at:to] = joined
        at = to
    return out


@dataclass
class Words:
    """The words of one chunk of documents."""

    data: np.ndarray  # bytes of all documents, one after the other
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # one past the last byte of each word
    hashes: np.ndarray  # uint64 for each word
    first: np.ndarray  # index of the first word of each document, and the number of words at the end
    bounds: np.ndarray  # first byte of each document, and the number of bytes at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def prefix_hashes(self, n: int) -> np.ndarray:
        """Hash of the first n bytes of each word (of all of a shorter one)."""
        return mix(span_hashes(self.data, self.starts, np.minimum(self.ends, self.starts + n)) + _U(n))

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split(values: pa.Array, separator: np.ndarray = WHITE_SPACE, lower: bool = False) -> Words:
    """Words of each value; a null value has none."""
    values = values.cast(pa.large_binary()) if not pa.types.is_large_binary(values.type) else values
    if values.null_count:
        values = values.fill_null(b"")
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    raw = values.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    inside = ~separator[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(data, starts, ends, span_hashes(data, starts, ends), np.searchsorted(starts, offsets), offsets)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words; the caller drops runs that cross documents."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, _U(k))
    for i in range(k):
        out = out * _U(0xD6E8FEB86659FD93) + hashes[i : i + n]
    return mix(out)


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; a longer text stands alone."""
    values = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_large_string(values.type) and not pa.types.is_large_binary(values.type):
        values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, len(batch))
        yield batch.slice(at, to - at)
        at = to


def unpacked(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose ``column`` was compressed by ``tables.packed``, with about ``limit`` bytes of text each."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    at, texts, size, done = batch.schema.get_field_index(column), [], 0, 0
    values = batch.column(at)
    for i in range(len(batch)):
        value = values[i].as_buffer()
        texts.append(None if value is None else unpack(value))
        size += len(texts[-1] or b"")
        if size >= limit or i == len(batch) - 1:
            yield batch.slice(done, i + 1 - done).set_column(at, column, pa.array(texts, pa.large_binary()))
            done, texts, size = i + 1, [], 0
