"""Columns of texts as byte arrays: words, their hashes and shingles, whole chunks at a time in numpy.

An Arrow batch of texts is one buffer of UTF-8 bytes with offsets. It is cut into chunks of about a megabyte, never
inside a text, so memory is bounded by the longest text and not by the number of rows in a batch.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1


@dataclass
class Chunk:
    """Rows first to last (exclusive) of a batch.

    :param data: the bytes of their texts, one after the other
    :param offsets: where each text begins, and at the end where the last one ends
    """

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """A string or binary column in chunks; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield Chunk(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


@lru_cache(4)
def _powers(size: int, inverse: bool) -> np.ndarray:
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    steps = np.full(size, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def powers(size: int, inverse: bool = False) -> np.ndarray:
    """Powers of the hash's base, or of its inverse, modulo 2^64."""
    room = 1 << max(20, int(size).bit_length())
    return _powers(room, inverse)[:size]


# Values of the 256 bytes in hashes; the golden ratio's multiples, mixed.
BYTE_VALUES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes: at i that of the first i bytes; ``span_hashes`` gets those of spans."""
    out = np.zeros(len(data) + 1, np.uint64)
    values = BYTE_VALUES[data]
    values *= powers(len(data))
    np.cumsum(values, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of bytes start to end (exclusive); equal bytes have equal hashes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), True)[start] + (end - start).astype(np.uint64))


def byte_class(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Letters, digits and everything beyond ASCII, after lower-casing.
ALNUM = byte_class(bytes([*range(48, 58), *range(97, 123), *range(128, 256)]))
# All but space and the control characters from tab to carriage return.
NOT_SPACE = ~byte_class(b" \t\n\x0b\x0c\r")


@dataclass
class Words:
    """Words of a chunk in order.

    :param start: first byte of each
    :param end: the byte after it
    :param offsets: the words of text i are offsets[i] to offsets[i + 1] (exclusive)
    :param data: the chunk's bytes in lower case (A to Z only)
    """

    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray
    data: np.ndarray

    def hashes(self) -> np.ndarray:
        return span_hashes(prefix_hashes(self.data), self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def rows(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())


def words(chunk: Chunk, kind: np.ndarray = ALNUM) -> Words:
    """Runs of bytes of a kind; the characters of all kinds are whole, as bytes from 128 on go together."""
    data = LOWER[chunk.data]
    size = len(data)
    inside = np.zeros(size + 2, bool)
    inside[1:-1] = kind[data]
    edge = np.zeros(size + 1, bool)
    edge[chunk.offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return Words(start, end, np.searchsorted(start, chunk.offsets), data)


def shingles(hashes: np.ndarray, offsets: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row within a text, and the offsets of each text's.

    :param short: texts of fewer words, but at least one, get one hash for all of them
    """
    count = np.diff(offsets)
    total = len(hashes)
    rolled = np.zeros(max(total - n + 1, 0), np.uint64)
    for i in range(n):
        rolled *= np.uint64(_BASE)
        rolled += hashes[i : i + len(rolled)]
    rolled = mix(rolled)
    made = np.maximum(count - n + 1, 0)
    keep = np.zeros(total + 1, np.int64)
    full = made > 0
    np.add.at(keep, offsets[:-1][full], 1)
    np.add.at(keep, offsets[:-1][full] + made[full], -1)
    kept = rolled[np.cumsum(keep[: len(rolled)]) > 0]
    if not short:
        return kept, np.concatenate([[0], np.cumsum(made)])
    odd = np.flatnonzero((count > 0) & (count < n))
    made[odd] = 1
    out = np.concatenate([[0], np.cumsum(made)])
    if len(odd):
        values = []
        for row in odd:
            h = np.uint64(count[row])
            with np.errstate(over="ignore"):
                for w in hashes[offsets[row] : offsets[row + 1]]:
                    h = h * np.uint64(_BASE) + w + np.uint64(1)
            values.append(h)
        all_rows = np.zeros(out[-1], np.uint64)
        place = np.ones(out[-1], bool)
        place[out[odd]] = False
        all_rows[place] = kept
        all_rows[out[odd]] = mix(np.array(values, np.uint64))
        kept = all_rows
    return kept, out


def distinct_by_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row in ascending order, and their offsets."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.argsort(values, kind="stable")
    order = order[np.argsort(rows[order], kind="stable")]
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[new], rows[new]
    return values, np.searchsorted(rows, np.arange(len(offsets)))
