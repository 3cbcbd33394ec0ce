"""Terms of a chunk of texts, dictionary-encoded, with their occurrences in each text.

Terms are compared by their bytes: Arrow encodes them, so that no two terms are ever taken for one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from skyroute.llm.words import separators

#: Bytes of text that are split at once; longer texts are cut where no term is.
STRETCH_BYTES = 2 << 20

#: Terms ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``: letters and all bytes above ASCII.
NOT_LETTERS = separators((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Terms ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+``: digits as well.
NOT_LETTERS_OR_DIGITS = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class TermCounts:
    """One entry for each text and term that occurs in it, by text."""

    text: np.ndarray
    term: np.ndarray  # place in ``terms``
    count: np.ndarray
    terms: pa.LargeBinaryArray  # lower-cased in A-Z

    def totals(self, texts: int) -> np.ndarray:
        """Terms with repeats of each text."""
        return np.bincount(self.text, weights=self.count, minlength=texts).astype(np.int64)


def _stretches(outside: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of about ``STRETCH_BYTES`` that end with a text, or at a byte outside of terms."""
    at, end = 0, len(outside)
    while at < end:
        to = min(at + STRETCH_BYTES, end)
        if to < end:
            text_end = int(offsets[np.searchsorted(offsets, to)])
            while to < text_end:
                ahead = outside[to : to + STRETCH_BYTES]
                if ahead.any():
                    to = min(to + int(ahead.argmax()), text_end)
                    break
                to = min(to + len(ahead), text_end)
        yield at, to
        at = to


def term_counts(values: pa.Array, separator: np.ndarray) -> TermCounts:
    """Occurrences of the terms (maximal runs of bytes that are no separators) of each value; a null has none."""
    values = values.cast(pa.large_binary()) if not pa.types.is_large_binary(values.type) else values
    if values.null_count:
        values = values.fill_null(b"")
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    raw = values.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~separator[data]
    parts = []
    for low, high in _stretches(~inside, offsets):
        own = inside[low:high]
        begin = own.copy()
        begin[1:] &= ~own[:-1]
        edges = offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, high)] - low
        begin[edges] = own[edges]
        starts = np.flatnonzero(begin)
        if not len(starts):
            continue
        letters = _LOWER[data[low:high][own]]  # the bytes of all terms, one after the other
        bounds = np.append(np.cumsum(own)[starts] - 1, len(letters)).astype(np.int64)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
        text = np.searchsorted(offsets, starts + low, side="right") - 1
        cells, count = np.unique(text * len(found.dictionary) + found.indices.to_numpy(), return_counts=True)
        text, term = np.divmod(cells, len(found.dictionary))
        parts.append((text, term, count, found.dictionary))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return TermCounts(none, none, none, pa.array([], pa.large_binary()))
    if len(parts) == 1:
        return TermCounts(*parts[0])
    terms = pa.concat_arrays([p[3] for p in parts]).dictionary_encode()  # what the pieces name, under one number each
    first = np.cumsum([0] + [len(p[3]) for p in parts])
    number = terms.indices.to_numpy()
    cell = np.concatenate([p[0] * len(terms.dictionary) + number[first[k] + p[1]] for k, p in enumerate(parts)])
    cells, at = np.unique(cell, return_inverse=True)
    count = np.bincount(at, weights=np.concatenate([p[2] for p in parts])).astype(np.int64)
    text, term = np.divmod(cells, len(terms.dictionary))
    return TermCounts(text, term, count, terms.dictionary)
