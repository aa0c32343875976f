"""SHA-256 over many messages at once, with states that can be stored and resumed.

The standard library can copy a running hash but not write it down, so a state could not travel between tasks. Here a
state is eight 32-bit numbers per message. A digest written as hex text is 64 bytes: exactly one block.
"""

from math import isqrt

import numpy as np

PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, isqrt(p) + 1))]


def _root(n: int, degree: int) -> int:
    """Whole part of the root of ``n``."""
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**degree <= n else (low, mid - 1)
    return low


#: First 32 bits behind the point of the square and cube roots of the first primes.
START = np.array([_root(p << 64, 2) & 0xFFFFFFFF for p in PRIMES[:8]], np.uint32)[:, None]
ROUND = np.array([_root(p << 96, 3) & 0xFFFFFFFF for p in PRIMES[:64]], np.uint32)
HEX = np.array([list(f"{b:02x}".encode()) for b in range(256)], np.uint8)


def _turned(x: np.ndarray, *by: int) -> np.ndarray:
    out = (x >> np.uint32(by[0])) | (x << np.uint32(32 - by[0]))
    for k in by[1:]:
        out ^= (x >> np.uint32(k)) | (x << np.uint32(32 - k))
    return out


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (8 x n) after one more block (16 x n, or 16 x 1 if all take the same one)."""
    w = list(block)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turned(x, 7, 18) ^ (x >> np.uint32(3))) + w[t - 7] + (_turned(y, 17, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        one = h + _turned(e, 6, 11, 25) + (g ^ (e & (f ^ g))) + (w[t] + ROUND[t])
        two = _turned(a, 2, 13, 22) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack(np.broadcast_arrays(a, b, c, d, e, f, g, h))


def ending(blocks: int) -> np.ndarray:
    """The padding block (16 x 1) after so many whole blocks."""
    out = np.zeros((16, 1), np.uint32)
    out[0], bits = 0x80000000, blocks * 512
    out[14], out[15] = bits >> 32, bits & 0xFFFFFFFF
    return out


def hex_block(words: np.ndarray) -> np.ndarray:
    """Digests (8 x n) as the blocks that their hex texts fill (16 x n)."""
    raw = np.ascontiguousarray(words.T, ">u4").view(np.uint8)
    return np.ascontiguousarray(HEX[raw].reshape(len(raw), 64).view(">u4").T.astype(np.uint32))


def words(raw: bytes | memoryview) -> np.ndarray:
    """Concatenated digests or states of 32 bytes as columns (8 x n)."""
    return np.ascontiguousarray(np.frombuffer(raw, ">u4").reshape(-1, 8).T.astype(np.uint32))


def raw(columns: np.ndarray) -> bytes:
    return np.ascontiguousarray(columns.T, ">u4").tobytes()
