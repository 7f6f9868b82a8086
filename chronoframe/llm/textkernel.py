"""Vectorised tokenising of whole Arrow text columns: words as byte ranges and 64-bit hashes, no Python strings.

Both word classes in use (letters and digits and everything beyond ASCII; everything but white space) can be told
from single UTF-8 bytes, so a batch is handled as one byte array.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20

_bytes = np.arange(256)
_upper = (_bytes >= 0x41) & (_bytes <= 0x5A)
LOWER = np.where(_upper, _bytes + 32, _bytes).astype(np.uint8)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
WORDS = ((_bytes >= 0x30) & (_bytes <= 0x39)) | (LOWER >= 0x61) & (LOWER <= 0x7A) | (_bytes >= 0x80)
#: `[^\x20\x09-\x0D]+`
SOLID = ~((_bytes == 0x20) | (_bytes >= 0x09) & (_bytes <= 0x0D))

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED = _VALUES[LOWER]
CASED = _VALUES
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Tokens(NamedTuple):
    start: np.ndarray  # byte positions in the chunk
    end: np.ndarray
    hash: np.ndarray  # uint64
    bounds: np.ndarray  # per document, where its tokens begin; one more at the end


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for at, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[at] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and each text's offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """Slices of a batch whose texts hold about limit bytes together, or one longer text."""
    texts = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(np.asarray(texts.to_numpy(zero_copy_only=False), np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def tokenize(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, values: np.ndarray) -> Tokens:
    """Maximal runs of bytes of one class other than 0 (False); no run crosses the border of two texts."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Tokens(none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    kind = member[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[1:n] |= kind[1:] != kind[:-1]
    cut[n] = True
    first, last = kind != 0, kind != 0
    first[1:] &= cut[1:n]
    last &= cut[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * power[:n], out=sums[1:])
    hashed = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    return Tokens(start, end, hashed, np.searchsorted(start, offsets))


def word_hash(words: list[str], values: np.ndarray = FOLDED) -> np.ndarray:
    """The same hashes for given words."""
    data = [w.encode() for w in words]
    joined = np.frombuffer(b"".join(data), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(w) for w in data]))).astype(np.int64)
    power, inverse = _power_tables(len(joined) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[joined] * power[: len(joined)], dtype=np.uint64)))
    return mix((sums[offsets[1:]] - sums[offsets[:-1]]) * inverse[offsets[:-1]] + np.diff(offsets).astype(np.uint64))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each window of size consecutive tokens of the whole chunk; windows over a border are the caller's."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    n = len(hashes) - size + 1
    total = np.zeros(n, np.uint64)
    for at in range(size):
        total += hashes[at : at + n] * np.uint64(pow(0xD6E8FEB86659FD93, at + 1, 1 << 64))
    return mix(total)
