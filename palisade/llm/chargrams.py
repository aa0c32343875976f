"""Character n-grams of whole texts, hashed to a fixed number of columns, as numpy arrays.

Texts are lower-cased and every character that is not of the chosen class counts as a space. An n-gram lies within one
word and may take in the space before or behind it, so beginnings and ends of words differ from middles.
"""

from collections.abc import Iterator
from functools import cache

import numpy as np

from palisade.llm.words import mix

#: Characters of text handled at once (a longer text alone).
_AT_ONCE = 1 << 20


@cache
def _class(name: str) -> np.ndarray:
    """Which code points are letters (isalpha) or letters and digits (isalnum)."""
    test = getattr(str, name)
    return np.fromiter((test(chr(i)) for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str], sizes: tuple[int, ...], bits: int, kind: str = "isalpha") -> Iterator[tuple[np.ndarray, int]]:
    """For each text the columns of its n-grams, in order of place, and how many characters of the class it has."""
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and (not part or size + len(texts[at]) < _AT_ONCE):
            part.append(f" {texts[at].lower()} ".encode("utf-32-le"))
            size += len(texts[at])
            at += 1
        borders = np.cumsum([0] + [len(p) // 4 for p in part])
        codes = np.frombuffer(b"".join(part), "<u4")
        solid = _class(kind)[codes]
        codes = np.where(solid, codes, 32).astype(np.uint64)
        found, places = [], []
        hashed, inner = codes.copy(), np.ones(len(codes), bool)
        for n in range(1, max(sizes) + 1):
            if n > 1:  # hashed: n-gram from each place; inner: no space strictly inside it
                hashed = hashed[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
                inner = inner[:-1] if n == 2 else inner[:-1] & solid[n - 2 : len(codes) - 1]
            if n in sizes:
                some = solid[: len(hashed)] | solid[n - 1 :] if n > 1 else solid
                place = np.flatnonzero(inner[: len(hashed)] & some if n < 3 else inner)
                columns = mix(hashed[place] + np.uint64(n)) >> np.uint64(64 - bits)
                found.append(columns.astype(np.int64))
                places.append(np.searchsorted(place, borders))
        counts = np.add.reduceat(solid, borders[:-1]) if len(codes) else []
        for i in range(len(part)):
            yield np.concatenate([f[p[i] : p[i + 1]] for f, p in zip(found, places)]), int(counts[i])
