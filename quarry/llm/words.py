"""Words and their XXH64 hashes in numpy, many texts at a time, without a Python object per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Spans from this many bytes on are hashed one by one.
_LONG = 512


@dataclass
class Words:
    """buf: each word followed by one blank, text after text; starts, ends: of the words there; doc: each word's text; counts: words of each text.

    With places: at, the byte of its text at which each word begins, and line, a number that grows by the line ends before it.
    """

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    counts: np.ndarray
    at: np.ndarray | None = None
    line: np.ndarray | None = None

    @property
    def first(self) -> np.ndarray:
        """The index of each text's first word."""
        return np.cumsum(self.counts) - self.counts

    def hashes(self, seed: int = 42) -> np.ndarray:
        return xxh64(self.buf, self.starts, self.ends - self.starts, seed)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, text) of every run of `width` words; a text with fewer words, but some, gives its whole sequence."""
        i = np.arange(len(self.starts) - width + 1) if len(self.starts) >= width else np.zeros(0, np.int64)
        i = i[self.doc[i] == self.doc[i + width - 1]] if len(i) else i
        short = np.flatnonzero((self.counts > 0) & (self.counts < width))
        a = self.first[short]
        first, last = np.concatenate([i, a]), np.concatenate([i + width - 1, a + self.counts[short] - 1])
        doc = np.concatenate([self.doc[i], short])
        if len(short):
            order = np.argsort(doc, kind="stable")
            first, last, doc = first[order], last[order], doc[order]
        return self.starts[first], self.ends[last] - self.starts[first], doc


def split(texts: list[bytes], lower: bool = True, places: bool = False) -> Words:
    """Words are runs of bytes other than blank and \\x09-\\x0D; lower: A-Z become a-z before."""
    big = b"\n".join(texts) + b"\n"
    a = np.frombuffer(big.lower() if lower else big, dtype=np.uint8)
    is_word = _WORD[a]
    before = np.empty_like(is_word)
    before[0] = False
    before[1:] = is_word[:-1]
    keep = is_word | before
    buf, inside = a[keep], is_word[keep]
    buf[~inside] = 32
    ends = np.flatnonzero(~inside)
    starts = np.empty_like(ends)
    if len(ends):
        starts[0] = 0
        starts[1:] = ends[:-1] + 1
    begins = np.flatnonzero(is_word & ~before)
    bounds = np.searchsorted(begins, np.cumsum([len(t) + 1 for t in texts])) if texts else np.zeros(0, np.int64)
    counts = np.diff(bounds, prepend=0)
    doc = np.repeat(np.arange(len(texts)), counts)
    if not places:
        return Words(buf, starts, ends, doc, counts)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    return Words(buf, starts, ends, doc, counts, begins - (np.cumsum(sizes) - sizes)[doc], np.cumsum(a == 10)[begins])


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of buf[start:start+length] for all spans at once."""
    data = np.concatenate([buf, np.zeros(16, np.uint8)])
    u64 = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    u32 = np.ndarray((len(data) - 3,), "<u4", data, 0, (1,))
    s = np.uint64(seed)
    pos, rest = starts.astype(np.int64), lengths.astype(np.int64)
    with np.errstate(over="ignore"):
        h = np.full(len(pos), s + _P5, dtype=np.uint64)
        big = np.flatnonzero((rest >= 32) & (rest < _LONG))
        if len(big):
            p, stripes = pos[big], rest[big] // 32
            v = [np.full(len(big), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            for k in range(int(stripes.max())):
                on = np.flatnonzero(stripes > k)
                at = p[on] + 32 * k
                for j in range(4):
                    v[j][on] = _round(v[j][on], u64[at + 8 * j])
            acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for j in range(4):
                acc = (acc ^ _round(np.zeros(len(big), np.uint64), v[j])) * _P1 + _P4
            h[big] = acc
        h += lengths.astype(np.uint64)
        pos = pos + np.where(rest >= 32, rest // 32 * 32, 0)
        rest = np.where(rest >= 32, rest % 32, rest)
        for k in range(3):
            on = np.flatnonzero(rest >= 8)
            if not len(on):
                break
            at = pos[on]
            h[on] = _rotl(h[on] ^ _round(np.zeros(len(on), np.uint64), u64[at]), 27) * _P1 + _P4
            pos[on] = at + 8
            rest[on] -= 8
        on = np.flatnonzero(rest >= 4)
        at = pos[on]
        h[on] = _rotl(h[on] ^ (u32[at].astype(np.uint64) * _P1), 23) * _P2 + _P3
        pos[on] = at + 4
        rest[on] -= 4
        for k in range(3):
            on = np.flatnonzero(rest > 0)
            if not len(on):
                break
            at = pos[on]
            h[on] = _rotl(h[on] ^ (data[at].astype(np.uint64) * _P5), 11) * _P1
            pos[on] = at + 1
            rest[on] -= 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    for k in np.flatnonzero(lengths >= _LONG):
        h[k] = xxhash.xxh64_intdigest(buf[starts[k] : starts[k] + lengths[k]].tobytes(), seed)
    return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Table:
    """Values by 64-bit hash, put in and looked up many at a time: open addressing over a power of two of slots, a third full or less."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, room: int = 0):
        size = 1 << max(4, int(np.ceil(np.log2(max(len(keys), room, 1) * 2.5))))
        self.shift = np.uint64(64 - int(np.log2(size)))
        self.keys, self.used = np.zeros(size + 256, np.uint64), np.zeros(size + 256, bool)
        self.values = np.zeros(size + 256, values.dtype)
        self.reach = 0
        self.put(keys, values)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add different keys that aren't in the table."""
        at, left, step = (keys >> self.shift).astype(np.int64), np.arange(len(keys)), 0
        while len(left):
            if step >= 250:
                raise ValueError("too many hashes share a prefix")
            slot = at[left] + step
            free = np.flatnonzero(~self.used[slot])
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.values[slot[put]], self.used[slot[put]] = keys[left[put]], values[left[put]], True
            left = np.delete(left, put)
            step += 1
        self.reach = max(self.reach, step)

    def get(self, h: np.ndarray, default) -> np.ndarray:
        out = np.full(len(h), default, dtype=self.values.dtype)
        at, left = (h >> self.shift).astype(np.int64), None
        for k in range(self.reach):
            slot, want = (at + k, h) if left is None else (at[left] + k, h[left])
            hit = (self.keys[slot] == want) & self.used[slot]
            if left is None:
                out[hit] = self.values[slot[hit]]
                left = np.flatnonzero(~hit)
            else:
                out[left[hit]] = self.values[slot[hit]]
                # An empty slot ends the search.
                left = left[~hit & self.used[slot]]
            if not len(left):
                break
        return out
