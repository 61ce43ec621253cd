"""Elias-Fano sequences and packed integers over memory-mapped arrays.

All queries are vectorised: they take and give numpy arrays.
"""

from __future__ import annotations

import json
import os

import numpy as np

_U = np.uint64
_BYTE_SELECT = np.array([[([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` (0 to 63) bits in 64-bit words, one word to spare."""
    n = len(values)
    words = np.zeros(n * width // 64 + 2, _U)
    if not width or not n:
        return words
    at = np.arange(n, dtype=_U) * _U(width)
    word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
    values = values.astype(_U)
    _merge(words, word, values << shift)
    over = np.nonzero(shift + _U(width) > _U(64))[0]
    words[word[over] + 1] |= values[over] >> (_U(64) - shift[over])  # one value at most runs into a word
    return words


def _merge(words: np.ndarray, at: np.ndarray, bits: np.ndarray) -> None:
    """Set ``bits`` in ``words`` at rising places."""
    if len(at):
        first = np.concatenate(([0], np.nonzero(at[1:] != at[:-1])[0] + 1))
        words[at[first]] |= np.bitwise_or.reduceat(bits, first)


def unpacked(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(at), _U)
    bit = at.astype(_U) * _U(width)
    word, shift = (bit >> _U(6)).astype(np.int64), bit & _U(63)
    high = (words[word + 1] << _U(1)) << (_U(63) - shift)
    return (words[word] >> shift | high) & _U((1 << width) - 1)


_ONES, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)


def _select_in(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) one of each word: byte sums by one multiplication."""
    s = word - ((word >> _U(1)) & _U(0x5555555555555555))
    s = (s & _U(0x3333333333333333)) + ((s >> _U(2)) & _U(0x3333333333333333))
    s = ((s + (s >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES  # byte i: ones of bytes 0..i
    k = k.astype(_U)
    place = ((((k * _ONES) | _TOPS) - s) & _TOPS) >> _U(7)  # a one for each byte that lies before
    place = ((place * _ONES) >> _U(56)) << _U(3)
    rest = k - (((s << _U(8)) >> place) & _U(255))
    return (place + _BYTE_SELECT[((word >> place) & _U(255)).astype(np.int64), rest.astype(np.int64)]).astype(np.int64)


#: Queries answered at a time.
PART = 1 << 14
#: Arrays of a sequence; the hints name the word of every HINT1-th one and HINT0-th zero.
ARRAYS = ("low", "upper", "ones", "hint1", "hint0")
#: Low bits fewer than the densest form has: shorter runs to search.
FINER = 1
#: Places of a run looked at one by one before it is searched.
NEXT = 2
HINT1_BITS, HINT0_BITS = 4, 5


class EliasFano:
    """A non-decreasing sequence below ``universe``."""

    def __init__(self, arrays: dict[str, np.ndarray], n: int, low_bits: int):
        self.low, self.upper, self.ones, self.hint1, self.hint0 = (arrays[k] for k in ARRAYS)
        self.n, self.low_bits = n, low_bits
        self.n0 = len(self.upper) * 64 - n

    @staticmethod
    def build(values: np.ndarray, universe: int) -> tuple[dict[str, np.ndarray], dict[str, int]]:
        n = len(values)
        bits = max(0, int(max(1, universe) // max(1, n)).bit_length() - 1 - FINER)
        values = values.astype(_U)
        place = (values >> _U(bits)).astype(np.int64) + np.arange(n)
        words = np.zeros((n + (int(universe) >> bits) + 2) // 64 + 1, _U)
        _merge(words, place >> 6, _U(1) << (place & 63).astype(_U))
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
        zeros = np.arange(len(ones)) * 64 - ones
        low = packed(values & _U((1 << bits) - 1), bits)
        steps = ((ones, 1 << HINT1_BITS), (zeros, 1 << HINT0_BITS))
        hints = [(np.searchsorted(a, np.arange(0, a[-1], step), side="right") - 1).astype(np.int32) for a, step in steps]
        ones = ones.astype(np.uint32 if n < 1 << 32 else np.int64)
        return dict(zip(ARRAYS, (low, words, ones, *hints))), {"n": n, "low_bits": bits}

    def _word(self, i: np.ndarray, hint: np.ndarray, bits: int, before) -> np.ndarray:
        """The word that holds bit ``i`` of its kind: a few steps from its hint, or,
        where the other kind fills many words between, halving."""
        word = hint[i >> bits].astype(np.int64)
        go = np.nonzero(before(word + 1) <= i)[0]
        for _ in range(4):
            if not len(go):
                return word
            word[go] += 1
            go = go[before(word[go] + 1) <= i[go]]
        low, high = word[go], np.full(len(go), len(self.upper))
        while len(go) and (high - low > 1).any():
            mid = (low + high) >> 1
            up = before(mid) <= i[go]
            low, high = np.where(up, mid, low), np.where(up, high, mid)
        word[go] = low
        return word

    def _ones_before(self, word: np.ndarray) -> np.ndarray:
        return self.ones[word].astype(np.int64)

    def _zeros_before(self, word: np.ndarray) -> np.ndarray:
        return word * 64 - self.ones[word]

    def _select1(self, i: np.ndarray) -> np.ndarray:
        word = self._word(i, self.hint1, HINT1_BITS, self._ones_before)
        return word * 64 + _select_in(self.upper[word], i - self._ones_before(word))

    def _select0(self, i: np.ndarray) -> np.ndarray:
        word = self._word(i, self.hint0, HINT0_BITS, self._zeros_before)
        return word * 64 + _select_in(~self.upper[word], i - self._zeros_before(word))

    @staticmethod
    def _by_part(ask, values: np.ndarray) -> np.ndarray:
        """Answers a part at a time, so that what is between stays in cache."""
        values = np.asarray(values, np.int64)
        if len(values) <= PART:
            return ask(values)
        return np.concatenate([ask(values[i : i + PART]) for i in range(0, len(values), PART)])

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values at positions."""
        return self._by_part(self._at, i)

    def all(self) -> np.ndarray:
        """The whole sequence."""
        at = np.arange(self.n)
        high = np.flatnonzero(np.unpackbits(self.upper.view(np.uint8), bitorder="little"))[: self.n] - at
        return (high << self.low_bits) | unpacked(self.low, at, self.low_bits).astype(np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Position of each value, or -1."""
        return self._by_part(self._find, values)

    def _at(self, i: np.ndarray) -> np.ndarray:
        high = (self._select1(i) - i).astype(_U)
        return ((high << _U(self.low_bits)) | unpacked(self.low, i, self.low_bits)).astype(np.int64)

    def _find(self, values: np.ndarray) -> np.ndarray:
        """The high part's run of positions comes from the upper bits, and the
        successor in it from the low bits."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        high = values >> self.low_bits
        ask = np.nonzero((values >= 0) & (high < self.n0 - 1))[0]
        high, want = high[ask], (values[ask] & ((1 << self.low_bits) - 1)).astype(_U)
        before = self._select0(np.maximum(high - 1, 0))
        before[high == 0] = -1
        # The next zero is mostly in the same word.
        word = (before + 1) >> 6
        rest = ~self.upper[word] >> ((before + 1) & 63).astype(_U)
        end = before + 1 + np.bitwise_count((rest & (~rest + _U(1))) - _U(1))
        far = np.nonzero(rest == 0)[0]
        end[far] = self._select0(high[far])
        end -= high
        start = before + 1 - high
        left, aim, turn = start, want.astype(np.int64), 0
        live = np.nonzero(start < end)[0]
        for _ in range(NEXT):  # runs are mostly this short
            got = unpacked(self.low, left[live], self.low_bits).astype(np.int64)
            live = live[got < aim[live]]
            left[live] += 1
            live = live[left[live] < end[live]]
            if not len(live):
                break
        lo, hi, aim = left[live], end[live], aim[live]
        # Low bits left of ``lo`` are at least ``floor``, those from ``hi`` on at least ``ceiling``.
        floor, ceiling = np.zeros(len(live), np.int64), np.full(len(live), 1 << self.low_bits, np.int64)
        while len(live):
            if turn % 3 == 2 or self.low_bits > 50:  # halving bounds the turns
                mid = (lo + hi) >> 1
            else:  # keys are spread evenly in a run: guess by proportion
                mid = lo + ((hi - lo - 1) * ((aim - floor) / (ceiling - floor))).astype(np.int64)
            got = unpacked(self.low, mid, self.low_bits).astype(np.int64)
            less, exact = got < aim, got == aim
            lo, hi = np.where(less, mid + 1, np.where(exact, mid, lo)), np.where(less, hi, mid)
            floor, ceiling = np.where(less, got, floor), np.where(less, ceiling, got)
            left[live] = lo
            more = np.nonzero(lo < hi)[0]
            live, lo, hi, aim, floor, ceiling = live[more], lo[more], hi[more], aim[more], floor[more], ceiling[more]
            turn += 1
        hit = left < end
        hit[hit] = unpacked(self.low, left[hit], self.low_bits) == want[hit]
        out[ask[hit]] = left[hit]
        return out


def save(path: str, arrays: dict[str, np.ndarray], meta: dict) -> None:
    """One file of aligned arrays behind a header; it appears whole or not at all."""
    spec, at = {}, 0
    for name, a in arrays.items():
        spec[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    head = json.dumps({"arrays": spec, "meta": meta}).encode()
    start = -(-(8 + len(head)) // 64) * 64
    os.makedirs(os.path.dirname(path), exist_ok=True)
    temp = f"{path}.{os.getpid()}.part"
    with open(temp, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for name, a in arrays.items():
            f.seek(start + spec[name][2])
            f.write(np.ascontiguousarray(a).tobytes())
        f.truncate(start + max(at, 64))
    os.replace(temp, path)


def load(path: str) -> tuple[dict[str, np.ndarray], dict]:
    whole = np.asarray(np.memmap(path, np.uint8, "r"))  # still mapped, without the subclass
    size = int.from_bytes(whole[:8].tobytes(), "little")
    head = json.loads(whole[8 : 8 + size].tobytes())
    start = -(-(8 + size) // 64) * 64
    out = {}
    for name, (kind, n, at) in head["arrays"].items():
        width = np.dtype(kind).itemsize
        out[name] = whole[start + at : start + at + n * width].view(kind)
    return out, head["meta"]


def nested(name: str, built: tuple[dict, dict], arrays: dict, meta: dict) -> None:
    """Put a built sequence into a file's arrays under ``name``."""
    arrays |= {f"{name}.{k}": v for k, v in built[0].items()}
    meta[name] = built[1]


def sequence(name: str, arrays: dict, meta: dict) -> EliasFano:
    return EliasFano({k: arrays[f"{name}.{k}"] for k in ARRAYS}, **meta[name])
