"""Words, word hashes and shingle hashes of whole Arrow text batches, in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Separators of words, as bytes: space and \x09 to \x0D. UTF-8 never has them inside a character.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of plain terms: all ASCII but letters and digits.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits of the input."""
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, so that temporaries stay small."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    at = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


class Words:
    """Words of a text column (null: empty): ``buf`` lower-cased bytes, ``starts``, ``ends`` into it, ``off`` words of each text."""

    def __init__(self, texts: pa.Array, separators: np.ndarray = SPACES):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        self.text_off = off = off - off[0]
        n = len(raw)
        self.buf = np.zeros(n + 8, np.uint8)
        self.buf[:n] = LOWER[raw]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        gap = separators[raw]
        inside = ~gap
        first = inside.copy()
        first[1:] &= gap[:-1] | edge[1:n]
        last = inside
        last[:-1] &= gap[1:] | edge[1:n]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.off = np.searchsorted(self.starts, off)

    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    def hashes(self, most: int | None = None, tag: int = 0) -> np.ndarray:
        """64-bit hashes of the words, or of their first ``most`` bytes."""
        length = self.ends - self.starts
        if most:
            length = np.minimum(length, most)
        eight = np.ndarray((len(self.buf) - 7,), "<u8", self.buf, strides=(1,))
        h = length.astype(np.uint64) * _A + np.uint64(tag)
        todo, at, left = slice(None), self.starts, length
        while len(at):
            h[todo] = mix(h[todo] ^ (eight[at] & _MASKS[np.minimum(left, 8)])) + _A
            more = np.flatnonzero(left > 8)
            todo = more if isinstance(todo, slice) else todo[more]
            at, left = at[more] + 8, left[more] - 8
        return h


def shingles(h: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and their offsets by text; a shorter text is one run of all its words."""
    count = np.diff(off)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    out_off = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(out_off[-1]) - out_off[text] + off[text]
    end = off[text + 1]
    acc = np.full(len(at), np.uint64(size), np.uint64)
    for k in range(size):
        i = at + k
        acc = (acc * _A) ^ np.where(i < end, h[np.minimum(i, max(len(h) - 1, 0))] if len(h) else np.uint64(0), np.uint64(k + 1))
        acc = mix(acc)
    return acc, out_off
