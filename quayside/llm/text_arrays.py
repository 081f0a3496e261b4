"""Texts of Arrow string arrays as numpy arrays of word hashes, and packed arrays.

Nothing here loops over words in Python: separators, folding and hashes are table
look-ups and running sums over the bytes of many texts at once.
"""

from __future__ import annotations

import json
import struct

import numpy as np

#: Bytes of text that are turned into arrays at once (a longer text goes alone).
CHUNK_BYTES = 1 << 20

MULTIPLIER = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LINE_FEED = np.zeros(256, bool)
LINE_FEED[0x0A] = True
#: Every ASCII byte that is neither letter nor digit separates words.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

KEEP = np.arange(256, dtype=np.uint8)
FOLD = KEEP.copy()
FOLD[0x41:0x5B] += 32

_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of the multiplier and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((MULTIPLIER, pow(MULTIPLIER, -1, 1 << 64))):
            steps = np.full(max(n, 2 * CHUNK_BYTES), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread 64-bit values evenly (one-to-one for a given salt)."""
    h = h ^ np.uint64(salt * 0xD6E8FEB86659FD93 & MASK)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def raw_rows(array):
    """(bytes, row bounds) of an Arrow string array; NULL counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc
    array = pc.fill_null(array, "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[
        array.offset:array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def chunks(bounds: np.ndarray):
    """(first row, last row + 1) of runs of rows with a bounded number of bytes."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + CHUNK_BYTES, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def word_bounds(data: np.ndarray, bounds: np.ndarray, separator=SEPARATOR):
    """(first byte, last byte + 1) of every word of the rows ``bounds`` of ``data``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    apart = separator[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], after[-1] = True, True
    before[1:], after[:-1] = apart[:-1], apart[1:]
    before[bounds[:-1][bounds[:-1] < n]] = True
    after[bounds[1:][bounds[1:] > 0] - 1] = True
    return np.flatnonzero(~apart & before), np.flatnonzero(~apart & after) + 1


def hashed_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold=FOLD) -> np.ndarray:
    """Hash of every word."""
    n = len(data)
    power, inverse = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((fold[data].astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def hashed_words(data: np.ndarray, bounds: np.ndarray, separator=SEPARATOR, fold=FOLD):
    """(hash per word, words per row) of the rows ``bounds`` of ``data``."""
    starts, ends = word_bounds(data, bounds, separator)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(bounds) - 1, np.int64)
    return hashed_spans(data, starts, ends, fold), np.diff(np.searchsorted(starts, bounds))


def rows_of_words(array, separator=SEPARATOR, fold=FOLD):
    """Yield (first row, hash per word, words per row) for runs of an Arrow array."""
    data, bounds = raw_rows(array)
    for at, to in chunks(bounds):
        part = data[bounds[at]:bounds[to]]
        yield at, *hashed_words(part, bounds[at:to + 1] - bounds[at], separator, fold)


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as one string of bytes; like bytes of the values lie together, so that
    zstandard finds the high bytes of small numbers."""
    import zstandard
    squeeze, head, parts = zstandard.ZstdCompressor(level=1).compress, [], []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        flat = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
        parts.append(squeeze(flat))
        head.append((name, a.dtype.str, len(a), len(parts[-1])))
    top = json.dumps(head).encode()
    return b"".join((struct.pack("<I", len(top)), top, *parts))


def unpack(raw: bytes) -> dict[str, np.ndarray]:
    import zstandard
    release = zstandard.ZstdDecompressor().decompress
    size, = struct.unpack_from("<I", raw)
    at, out = 4 + size, {}
    for name, kind, n, packed in json.loads(raw[4:at]):
        kind = np.dtype(kind)
        flat = np.frombuffer(release(raw[at:at + packed], max_output_size=max(1, n * kind.itemsize)),
                             np.uint8)
        out[name] = np.ascontiguousarray(flat.reshape(kind.itemsize, n).T).view(kind).reshape(n) \
            if n else np.zeros(0, kind)
        at += packed
    return out
