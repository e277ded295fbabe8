"""Word, line and shingle arithmetic over whole Arrow batches with numpy.

Byte ranges are hashed side by side, eight bytes at a step, each step mixed
before the next bytes come in, so that no pattern of a text makes two ranges
collide more often than chance; long ranges are hashed by BLAKE2b.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Byte ranges longer than this are hashed one by one.
LONG_RANGE = 128
#: Bytes of text handled at once; a longer single text is one chunk of its own.
CHUNK_BYTES = 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Mask for the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], U)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the result."""
    h = h.astype(U, copy=True)
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def text_array(column: pa.Array) -> pa.Array:
    """The column as UTF-8 strings without nulls (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `limit` bytes, so that memory doesn't follow the batch."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


@dataclass
class Bytes:
    """All texts of a chunk end to end; text i is buf[offsets[i]:offsets[i+1]]."""

    buf: np.ndarray
    offsets: np.ndarray

    @cached_property
    def _eights(self) -> np.ndarray:
        """The eight bytes from each place on as one number."""
        padded = np.concatenate([self.buf, np.zeros(8, np.uint8)])
        return np.ndarray((len(self.buf) + 1,), "<u8", padded, strides=(1,))

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - start
        h = mix(size.astype(U) + U(1))
        who = np.flatnonzero((size > 0) & (size <= LONG_RANGE))
        done = 0
        while len(who):
            left = size[who] - done
            h[who] = mix(h[who] ^ (self._eights[start[who] + done] & _FIRST[np.minimum(left, 8)]) * U(0x9E3779B97F4A7C15))
            who, done = who[left > 8], done + 8
        for i in np.flatnonzero(size > LONG_RANGE).tolist():
            h[i] = int.from_bytes(blake2b(self.buf[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
        return h


def load(texts: pa.Array) -> Bytes:
    texts = text_array(texts)
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return Bytes(data[offsets[0] : offsets[-1]], offsets - offsets[0])


@dataclass
class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a chunk; those of text i are first[i]..first[i+1]."""

    text: Bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def words(text: Bytes) -> Words:
    n = len(text.buf)
    inside = ~SPACE[text.buf]
    edge = np.zeros(n + 1, bool)
    edge[text.offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(text, start, end, np.searchsorted(start, text.offsets), text.hash(start, end))


def shingles(w: Words, n: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words in one text, and the word each begins with.

    With whole_if_short, a text of 1 to n-1 words has one shingle of all its words.
    """
    total = len(w.hash)
    doc = w.doc
    last = w.first[1:][doc]
    at = np.arange(total)
    keep = at + n <= last
    if whole_if_short:
        keep |= (at == w.first[:-1][doc]) & (w.count[doc] < n)
    at = at[keep]
    last = last[keep]
    h = np.zeros(len(at), U)
    for j in range(n):
        here = at + j
        ok = here < last
        term = np.where(ok, w.hash[np.minimum(here, total - 1)], U(0)) if total else np.zeros(0, U)
        h = h * U(0x2545F4914F6CDD1D) + term
    return mix(h), at


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over each range offsets[i]..offsets[i+1], empty ranges included."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
