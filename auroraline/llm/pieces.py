"""Cutting texts into the pieces of byte-level BPE tokenizers with numpy, and a cache of pieces' ids.

A piece is what the pre-tokenizer's pattern matches.  Both patterns used here tell code points
apart by class only (letter, number, white space, other), so the borders of all pieces of many
texts come from a few passes over an array of code points.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Sequence

import numpy as np

from . import common

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Code points that ``\s`` matches in the patterns (the White_Space property); fixed values.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

_classes: np.ndarray | None = None
_POINT_KEYS = np.random.default_rng(77).integers(1, 2**63, 1 << 16, dtype=np.uint64) | np.uint64(1)


def classes() -> np.ndarray:
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        found = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        found[list(WHITE_SPACE)] = SPACE
        _classes = found
    return _classes


class Cut:
    """Pieces of texts: code points, spans, and ``first[i]:first[i + 1]`` are the pieces of text i."""

    def __init__(self, texts: Sequence[str], words_only: bool):
        """``words_only``: the pattern that drops white space and takes numbers one by one; else the one that keeps all and joins a space to what follows."""
        self.points = points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter((len(t) for t in texts), np.int64, len(texts)), out=offsets[1:])
        n = len(points)
        begins = np.zeros(n + 1, bool)
        begins[offsets] = True
        kind = classes()[points]
        run = begins[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        blank = points == 32
        start = np.zeros(n + 4, bool)
        start[:n] = run
        joined = np.zeros(n, bool)
        if words_only:
            start[:n] |= kind == NUMBER
        elif n:
            # a space goes with the run after it; other white space before a run stands alone
            joined[1:] = run[1:] & (kind[1:] != SPACE) & blank[:-1] & ~begins[1:n]
            start[:n] &= ~joined
            last = np.zeros(n, bool)
            last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~begins[1:n]
            start[:n] |= last
        # 's 't 're 've 'm 'll 'd at the start of a piece, where the apostrophe is a run of its own
        quote = np.flatnonzero((points == 39) & run & ~joined)
        if len(quote):
            code = np.zeros(n + 3, np.uint32)
            code[:n] = points
            inside = lambda at: ~begins[np.minimum(at, n)]
            one, two = code[quote + 1], code[quote + 2]
            same = inside(quote + 1)
            short = same & np.isin(one, [ord(c) for c in "stmd"])
            pair = one.astype(np.uint64) * 2**32 + two
            long = same & inside(quote + 2) & ~short & np.isin(pair, [ord(a) * 2**32 + ord(b) for a, b in ("re", "ve", "ll")])
            start[quote[short | long] + 1] = False
            start[quote[short] + 2] = True
            start[quote[long] + 3] = True
        begin = np.flatnonzero(start[:n])
        end = np.append(begin[1:], n)
        if words_only:
            keep = kind[begin] != SPACE
            begin, end = begin[keep], end[keep]
        self.starts, self.ends = begin, end
        self.first = np.searchsorted(begin, offsets)

    def hashes(self) -> np.ndarray:
        low = self.points < 1 << 16
        keys = _POINT_KEYS[np.where(low, self.points, 0)] if not low.all() else _POINT_KEYS[self.points]
        if not low.all():
            keys = np.where(low, keys, common.mix(self.points.astype(np.uint64)) | np.uint64(1))
        return common.span_hashes(keys, self.starts, self.ends)

    def piece(self, i: int) -> str:
        return self.points[self.starts[i] : self.ends[i]].tobytes().decode("utf-32-le", "surrogatepass")


class PieceIds:
    """Ids of pieces by hash, kept between batches; sorted levels that double in size, so look-ups and growth stay cheap.

    ``encode`` gets new pieces, all distinct, and returns flat ids and the number for each.  Beyond
    ``limit`` pieces the cache starts anew, which bounds its memory and changes no result.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 800_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.ids, self.used = np.zeros(1 << 12, np.int32), 0
        self.start, self.count, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def _find(self, keys: np.ndarray) -> np.ndarray:
        at = np.full(len(keys), -1, np.int64)
        for known, index in self.levels:
            k = np.searchsorted(known, keys)
            k[k == len(known)] = 0
            hit = known[k] == keys
            at[hit] = index[k[hit]]
        return at

    def look_up(self, cut: Cut) -> tuple[np.ndarray, np.ndarray]:
        """(index of each piece in this cache, whether the cache was cleared first)."""
        if self.n > self.limit:
            self.clear()
        keys, example, inverse = np.unique(cut.hashes(), return_index=True, return_inverse=True)
        at = self._find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            ids, counts = self.encode([cut.piece(i) for i in example[new]])
            self.ids = self._room(self.ids, self.used + len(ids))
            self.ids[self.used : self.used + len(ids)] = ids
            self.start, self.count = self._room(self.start, self.n + len(new)), self._room(self.count, self.n + len(new))
            self.count[self.n : self.n + len(new)] = counts
            self.start[self.n : self.n + len(new)] = self.used + np.cumsum(counts) - counts
            at[new] = self.n + np.arange(len(new))
            level = (keys[new], at[new])
            self.n, self.used = self.n + len(new), self.used + len(ids)
            while self.levels and len(self.levels[-1][0]) <= 2 * len(level[0]):
                known, index = self.levels.pop()
                both = np.concatenate([known, level[0]])
                order = np.argsort(both, kind="stable")
                level = (both[order], np.concatenate([index, level[1]])[order])
            self.levels.append(level)
        return at[inverse.reshape(-1)]

    def ids_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of pieces and the number for each."""
        counts = self.count[at].astype(np.int64)
        return common.ragged(self.ids, self.start[at], counts), counts


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable Latin-1, else 256 and up in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
