"""Byte-level BPE: exact encoding by backtracking over longest matches, and decoding.

A sequence of tokens is the one that merging by rank produces exactly if every two neighbours are *compatible*: merging
their joined bytes gives the two back. So the encoder takes the longest token at each place, tests it against its left
neighbour, tries the next shorter one if they are incompatible and steps back if none is left. A place from which no
way led to the end is marked, so each place is left at most once per token length: time is linear in the text. The
Aho-Corasick automaton works on strings, so bytes are mapped to the characters of the same number (Latin-1).

Cases: null and empty texts have no tokens; a text of any length is encoded whole; equal rows give equal results.
"""

import base64
import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from palisade.llm.frames import Batches, documents, map_batches, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces and chunks kept with their tokens per process, in each of two generations.
CACHE = 400_000
#: White space as Unicode defines it (\\s of both regex modules also has four control characters).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNKS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall


class Codec:
    """Encoder and decoder for one table of ranks (token bytes -> rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.pieces: Callable[[str], list[str]] = regex.compile(
            pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")
        ).findall
        n = max(ranks.values(), default=-1) + 1
        self.size = [len(self.bytes_of.get(i, b"")) for i in range(n)]
        self.formed = [i if self.size[i] > 1 else -1 for i in range(n)]  # bytes are there before any merge
        self.halves: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}  # token -> longest shorter token that is its prefix
        self.fits: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, list[int]] = {}  # pieces and chunks used lately
        self.older: dict[str, list[int]] = {}
        self.matcher = ahocorasick.Automaton()
        for i in sorted(self.bytes_of):
            b = self.bytes_of[i]
            for cut in range(len(b) - 1, 0, -1):
                left, right = ranks.get(b[:cut], n), ranks.get(b[cut:], n)
                made = max(left, right) < i and all(x in self.halves or self.size[x] == 1 for x in (left, right))
                if made and self.apart(left, right, i):
                    self.halves[i] = left, right
                    break
            if len(b) == 1 or i in self.halves:  # a token that merging cannot make only stands for a whole piece
                self.matcher.add_word(b.decode("latin-1"), i)
        self.matcher.make_automaton()
        for i, b in self.bytes_of.items():
            for cut in range(len(b) - 1, 0, -1):
                if self.matcher.exists(b[:cut].decode("latin-1")):
                    self.shorter[i] = ranks[b[:cut]]
                    break

    def apart(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge of a rank below ``limit`` reaches across the border of two neighbours.

        The tokens at the border are followed back in time, the one formed last first. Two of them would have merged if
        their joined rank comes before the merge that took either away from the border; of equal ranks the left merges first.
        """
        until_left = until_right = limit
        while True:
            rank = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if rank is not None and rank < until_left and rank <= until_right and rank < limit:
                return False
            if self.formed[left] > self.formed[right]:
                until_left, left = left, self.halves[left][1]
            elif self.formed[right] >= 0:
                until_right, right = right, self.halves[right][0]
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) >= CACHE:
                self.fits.clear()
            found = self.fits[left, right] = self.apart(left, right, len(self.size))
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        latin, size, fits, shorter = piece.decode("latin-1"), self.size, self.fits, self.shorter
        longest = [-1] * len(piece)
        for last, token in self.matcher.iter(latin):
            longest[last - size[token] + 1] = token  # of those that start here, the last to end is the longest
        full, dead = len(piece), set()
        left = token = longest[0]
        tokens, at = [left], size[left]
        while at < full:
            token = longest[at]
            while True:
                end = at + size[token]
                if end not in dead:
                    fit = fits.get((left, token))
                    if fit if fit is not None else self.compatible(left, token):
                        tokens.append(token)
                        left, at = token, end
                        break
                while token not in shorter:  # no token leads on from here: step back
                    dead.add(at)
                    token = tokens.pop()
                    at -= size[token]
                    left = tokens[-1] if tokens else -1
                token = shorter[token]
                if left < 0:
                    if at + size[token] in dead:
                        continue
                    tokens, left, at = [token], token, size[token]
                    break
        return tokens

    def _remember(self, piece: str, ids: list[int]) -> list[int]:
        """Keep what was used lately: the full store becomes the old one, and the one before it goes."""
        if len(piece) <= 64:
            if len(self.cache) >= CACHE:
                self.older, self.cache = self.cache, {}
            self.cache[piece] = ids
        return ids

    def _encode_chunk(self, chunk: str) -> list[int]:
        found = self.older.get(chunk)
        if found is None:
            found = []
            pieces = self.pieces(chunk)
            for piece in pieces:
                known = self.cache.get(piece) or self.older.get(piece)
                if known is None:
                    known = self.encode_piece(piece.encode())
                    if len(pieces) > 1:
                        self._remember(piece, known)
                found += known
        return self._remember(chunk, found)

    def encode(self, text: str) -> list[int]:
        """A piece of the pattern never reaches over a change to white space, so chunks are encoded on their own."""
        ids: list[int] = []
        for chunk in CHUNKS(text):
            ids += self.cache.get(chunk) or self._encode_chunk(chunk)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per process and vocabulary file (every node has the file; it is never shipped)."""
    with open(path, "rb") as lines:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def encode(
    docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, with_ids: bool = False
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids themselves."""
    docs = documents(docs)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Batches) -> Batches:
        own = codec(public_tokenizers.path(vocabulary), pattern)
        for batch in batches:
            counts, sums, decoded, lists = [], [], [], []
            for text in batch.column(1):
                ids = own.encode(text.as_py())
                counts.append(len(ids))
                sums.append(hashlib.sha256(",".join(map(own.text_of.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(pa.array(ids, pa.int32()))
            out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                values = pa.concat_arrays(lists) if lists else pa.array([], pa.int32())
                ends = [0]
                for n in counts:
                    ends.append(ends[-1] + n)
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    return map_batches(docs, run, schema + (", ids array<int>" if with_ids else ""))


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
