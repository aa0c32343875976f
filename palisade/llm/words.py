"""Words of whole batches of texts as numpy arrays: fingerprints and places, without a Python step per word.

A word is a run of bytes of one class; ASCII capitals count as small letters. A fingerprint has 64 bits and is the
same in every process and run.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Digits, letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True
#: Everything but ASCII white space.
SOLID = np.ones(256, bool)
SOLID[9:14] = SOLID[32] = False
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of ``h`` over all 64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def slices(texts: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Parts of a string column of about ``size`` bytes (or one longer text): first row, end row, bytes, row borders."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    borders = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(borders, borders[at] + size, side="right")) - 1)
        yield at, end, data[borders[at] : borders[end]], borders[at : end + 1] - borders[at]
        at = end


_ZSTD = pa.Codec("zstd", compression_level=1)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers, byte by byte (all low bytes first) in the narrowest width, compressed."""
    values = values.astype("<u8")
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return bytes([width]) + len(planes).to_bytes(8, "little") + _ZSTD.compress(planes, asbytes=True)


def _planes(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(_ZSTD.decompress(data[9:], size, asbytes=True), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def unpack(data: bytes) -> np.ndarray:
    return _planes(data).astype(np.int64)


def pack_sorted(prints: np.ndarray) -> bytes:
    """Ascending fingerprints as differences: a few bytes less each."""
    return pack(np.diff(prints, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_planes(data), dtype=np.uint64)


class Words(NamedTuple):
    prints: np.ndarray  # fingerprint of each word
    starts: np.ndarray  # first byte
    ends: np.ndarray  # byte behind the last one
    borders: np.ndarray  # words of row i: borders[i] to borders[i + 1]


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    left = ends - starts
    h = left.astype(U) * U(0x9E3779B97F4A7C15)
    live, at = None, starts
    while len(at):
        part = eight[at] & _LOW[np.minimum(left, 8)]
        if live is None:
            h = mix(h ^ part)
        else:
            h[live] = mix(h[live] ^ part)
        more = np.flatnonzero(left > 8)
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def words(data: np.ndarray, rows: np.ndarray, kind: np.ndarray = ALNUM) -> Words:
    """The words of concatenated texts; ``rows`` holds the byte borders of the texts."""
    data = LOWER[data]
    inside = kind[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = rows[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts], last[cuts - 1] = inside[cuts], inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(fingerprints(data, starts, ends), starts, ends, np.searchsorted(starts, rows))
