"""Compact arrays for an n-gram trie: packed bits, Elias-Fano sequences, and levels in a memory-mapped file."""

from __future__ import annotations

import tempfile

import numpy as np

#: Position of the k-th set bit of a byte.
_SELECT = np.zeros((256, 8), np.uint8)
for _b in range(256):
    for _k, _p in enumerate(i for i in range(8) if _b >> i & 1):
        _SELECT[_b, _k] = _p

_EACH, _HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
_FIVES, _THREES, _FIFTEENS = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)


def ordered(*columns: np.ndarray) -> np.ndarray:
    """An order by the columns, the first one first; ties in any order. Packed into one number where that fits."""
    bits = [int(c.max()).bit_length() if len(c) else 0 for c in columns]
    if sum(bits) > 64:
        return np.lexsort(columns[::-1])
    key = columns[0].astype(np.uint64)
    for c, b in zip(columns[1:], bits[1:]):
        key = (key << np.uint64(b)) | c.astype(np.uint64) if b < 64 else c.astype(np.uint64)
    return np.argsort(key)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Values of `width` bits (at most 57), one after another in 64-bit words, with a word to spare."""
    groups = -(-len(values) // 64)
    x = np.zeros((groups, 64), np.uint64)
    x.ravel()[: len(values)] = values
    out = np.zeros((groups, max(1, width)), np.uint64)
    for j in range(64 if width else 0):
        word, shift = divmod(j * width, 64)
        out[:, word] |= x[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= x[:, j] >> np.uint64(64 - shift)
    return np.append(out.ravel(), np.zeros(1, np.uint64))


def read_bits(words: np.ndarray, width: int, i: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(i), np.uint64)
    at = i.astype(np.int64) * width
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (low | high) & np.uint64((1 << width) - 1)


class BitVector:
    """Set bits by number: select over ones and over zeros, with counts by word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        per = np.bitwise_count(words)
        self.ones = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
        self.zeros = np.arange(len(words) + 1, dtype=np.int64) * 64 - self.ones

    def select(self, i: np.ndarray, bit: int = 1) -> np.ndarray:
        counts = self.ones if bit else self.zeros
        word = np.searchsorted(counts, i, "right") - 1
        left = (i - counts[word]).astype(np.uint64)
        x = self.words[word] if bit else ~self.words[word]
        # sums of set bits up to each byte, in the bytes of one number
        s = x - ((x >> np.uint64(1)) & _FIVES)
        s = (s & _THREES) + ((s >> np.uint64(2)) & _THREES)
        s = ((s + (s >> np.uint64(4))) & _FIFTEENS) * _EACH
        # bytes whose sum is not over what is left
        octet = (((((left * _EACH) | _HIGH) - s) & _HIGH) >> np.uint64(7)) * _EACH >> np.uint64(56)
        shift = octet << np.uint64(3)
        left -= ((s << np.uint64(8)) >> shift) & np.uint64(255)
        return word * 64 + shift.astype(np.int64) + _SELECT[(x >> shift) & np.uint64(255), left]


def elias_fano(values: np.ndarray) -> dict[str, np.ndarray]:
    """A non-decreasing sequence: lower bits packed, upper bits in unary."""
    n, top = len(values), int(values[-1]) + 1 if len(values) else 1
    low = max(0, (top // max(1, n)).bit_length() - 1)
    values = values.astype(np.uint64)
    at = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    size = n + (top >> low) + 2
    bits = np.zeros(-(-size // 64) * 64, np.uint8)
    bits[at] = 1
    return {"meta": np.array([n, low, top], np.int64), "low": pack_bits(values & np.uint64((1 << low) - 1), low), "high": np.packbits(bits, bitorder="little").view(np.uint64)}


class Sequence:
    """Reads an Elias-Fano sequence."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.n, self.low, self.top = (int(x) for x in parts["meta"])
        self.words, self.high = parts["low"], BitVector(parts["high"])

    def get(self, i: np.ndarray) -> np.ndarray:
        upper = (self.high.select(i) - i).astype(np.uint64)
        return ((upper << np.uint64(self.low)) | read_bits(self.words, self.low, i)).astype(np.int64)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element not below x (n if none), and whether it equals x."""
        x = np.asarray(x, np.int64)
        out, equal = np.full(len(x), self.n, np.int64), np.zeros(len(x), bool)
        inside = np.flatnonzero(x < self.top)
        if not len(inside) or not self.n:
            return out, equal
        y = x[inside]
        upper = y >> self.low
        a = np.where(upper > 0, self.high.select(np.maximum(0, upper - 1), 0) - upper + 1, 0)
        z = self.high.select(upper, 0) - upper
        lower = (y & ((1 << self.low) - 1)).astype(np.uint64)
        lo, hi = a.copy(), z.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            below = read_bits(self.words, self.low, mid) < lower[live]
            lo[live[below]] = mid[below] + 1
            hi[live[~below]] = mid[~below]
            live = live[lo[live] < hi[live]]
        out[inside] = lo
        hit = np.flatnonzero(lo < z)
        equal[inside[hit]] = read_bits(self.words, self.low, lo[hit]) == lower[hit]
        return out, equal


def grouped(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Strictly rising values inside each group (first: where groups begin), made strictly rising throughout."""
    if not len(values):
        return values.astype(np.int64)
    last = np.append(first[1:], len(values)) - 1
    step = values[last].astype(np.int64) + 1
    return values.astype(np.int64) + np.repeat(np.cumsum(step) - step, last + 1 - first)


def mapped(levels: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The arrays in a memory-mapped file that has no name: it goes when the arrays go."""
    with tempfile.TemporaryFile() as f:
        at = {}
        for name, x in levels.items():
            at[name] = (f.tell(), x.dtype, len(x))
            f.write(np.ascontiguousarray(x).tobytes())
            f.write(b"\0" * (-f.tell() % 8))
        f.write(b"\0" * 8)
        f.flush()
        whole = np.memmap(f, np.uint8, "r")
    return {name: whole[a : a + n * dtype.itemsize].view(dtype) for name, (a, dtype, n) in at.items()}
