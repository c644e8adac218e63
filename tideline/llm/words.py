"""Vectorised words of whole Arrow string columns: no Python object a word.

A column's UTF-8 buffer is cut into words by a byte table. That is exact,
since the separators of every definition used here are ASCII and UTF-8 never
uses an ASCII byte inside a longer character.
"""

from __future__ import annotations

import contextlib
import ctypes
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1


def _splitmix(seed: int, n: int) -> np.ndarray:
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & MASK
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        out.append(z ^ (z >> 31))
    return np.array(out, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that sums of products spread over all bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)  # h is new, the caller's stays
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_BYTE = _splitmix(11, 256) | np.uint64(1)
_STEP = int(_splitmix(23, 1)[0]) | 1
_GRAM = int(_splitmix(37, 1)[0]) | 1


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_POWERS = _powers(_STEP, 4096)
#: Value of each byte at each of a span's first places, and the spans that are hashed together, in the processor's cache.
_PLACES = _POWERS[:24, None] * _BYTE
_SPANS = 1 << 15

#: Byte classes. SPACED: [^\x20\x09-\x0D]+ ; ALNUM: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    """Words of n texts. first has n + 1 entries: words first[i]:first[i+1] are those of text i."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    _hash: np.ndarray | None = None

    @property
    def n(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.n)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hash(self.data, self.start, self.end)
        return self._hash

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether those k lie in one text."""
        h, n = self.hash, len(self.start)
        out = np.zeros(n, np.uint64)
        fits = np.zeros(n, bool)
        if n < k:
            return out, fits
        q = _powers(_GRAM, k)
        acc = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            acc += h[j : n - k + 1 + j] * q[j]
        out[: n - k + 1] = mix(acc)
        last = np.repeat(self.first[1:], self.n)
        fits[: n - k + 1] = (np.arange(n - k + 1) + k) <= last[: n - k + 1]
        return out, fits


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span."""
    out = (end - start).astype(np.uint64)
    for a in range(0, len(start), _SPANS):
        out[a : a + _SPANS] += _span_sums(data, start[a : a + _SPANS], end[a : a + _SPANS])
    return mix(out)


def _span_sums(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of each span's byte values times powers: one place of all spans after another, the rest of long spans at once."""
    length = end - start
    size = np.minimum(length, len(_PLACES)).astype(np.uint8)
    order = np.argsort(size, kind="stable")
    skip = np.searchsorted(size[order], np.arange(len(_PLACES)), side="right")  # spans that end before a place
    at, sums = start[order], np.zeros(len(start), np.uint64)
    for k, a in enumerate(skip.tolist()):
        if a == len(at):
            break
        sums[a:] += _PLACES[k].take(data.take(at[a:] + k))
    out = np.empty_like(sums)
    out[order] = sums
    long = np.flatnonzero(length > len(_PLACES))
    if len(long):
        start, length = start[long] + len(_PLACES), length[long] - len(_PLACES)
        most = int(length.max()) + len(_PLACES)
        powers = _POWERS if most <= len(_POWERS) else _powers(_STEP, most)
        base = np.cumsum(length) - length
        within = np.arange(int(length.sum())) - np.repeat(base, length)
        out[long] += np.add.reduceat(_BYTE[data[within + np.repeat(start, length)]] * powers[within + len(_PLACES)], base)
    return out


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    low, high = offsets[0], offsets[-1]
    raw = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
    return raw, offsets - low


def cut(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = SPACED, lower: bool = False) -> Words:
    """The words of texts given as one byte array and offsets."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(len(offsets), np.int64))
    raw = data.tobytes()
    if lower:
        raw = raw.translate(LOWER.tobytes())
        data = np.frombuffer(raw, np.uint8)
    mask = np.zeros(n + 2, bool)
    mask[1:-1] = np.frombuffer(raw.translate(inside.tobytes()), bool)
    before, here = mask[:-1], mask[1:]
    edge = before != here
    edge[offsets] = True
    start = np.flatnonzero(here & edge)
    end = np.flatnonzero(before & edge)
    first = np.searchsorted(start, offsets)
    return Words(data, offsets, start, end, first)


def release() -> None:
    """Give freed memory back to the system: a worker idles, with what it holds, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about most bytes of text (one row at least), to bound a worker's arrays."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            stop = min(max(stop, at + 1), batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop
        batch = None
    release()


def unused(columns: list[str], name: str) -> str:
    """A name like name that no column has, in any case."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name = "_" + name
    return name


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def crc_mod(ids: pa.Array | np.ndarray, mod: int) -> np.ndarray:
    """crc32 of each id's decimal text, modulo mod."""
    values = ids.to_pylist() if isinstance(ids, pa.Array) else ids.tolist()
    return np.fromiter((zlib.crc32(str(i).encode()) % mod for i in values), np.int64, len(values))


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of a word-level array over each text."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]
