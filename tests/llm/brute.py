"""Plain versions of the operators, one document after the other."""

import hashlib
import math
import re
import zlib
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def remainder(doc_id, folds: int):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds


def rows_of(df, *names):
    return [tuple(r) for r in df.select(*names).collect()]


def words(text) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def decontaminate(docs, items, size=10):
    windows = [(str(i) if i is not None else "", w[k : k + size]) for i, t in items for w in [words(t)] for k in range(max(1, len(w) - size + 1)) if w]
    first = {}
    for item, window in windows:
        first.setdefault(window[0], []).append((item, window))
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for i, word in enumerate(own):
            for item, window in first.get(word, ()):
                if own[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    found.add(item)
        out.append((doc_id, len(own), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def tokens(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + ["\n"]


def language_model(docs, backoff):
    held = [remainder(i, 7) == 2 for i, _ in docs]
    train = [tokens(t) for (_, t), h in zip(docs, held) if not h]
    c1 = Counter(w for ws in train for w in ws)
    c2 = Counter(b for ws in train for b in zip(["\n", *ws], ws))
    n, v = sum(c1.values()), len(c1)
    p = lambda w: (c1[w] + 1) / (n + v + 1)
    out = []
    for (doc_id, text), h in zip(docs, held):
        own = tokens(text)
        out.append((
            doc_id, h, len(own), sum(c1[w] > 0 for w in own), n, sum(math.log10(p(w)) for w in own),
            sum(math.log10((c2[u, w] + backoff * p(w)) / (c1[u] + backoff)) for u, w in zip(["\n", *own], own)),
        ))
    return out


def same(found, wanted, digits=6):
    """Equal rows in any order, floats to ``digits`` digits."""
    key = lambda rows: sorted([tuple(f"{x:.{digits}g}" if isinstance(x, float) else repr(x) for x in r) for r in rows])
    assert key(found) == key(wanted)
