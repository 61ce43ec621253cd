"""Trigram language model in an Elias-Fano trie.

Level 1 is the vocabulary in order of a 63-bit word hash, with every word's bytes:
words are told apart by their bytes, the hash only finds them. Level 2 holds each
word's successors; level 3 names a word by its rank among the successors of the
word before it (context-relative), behind monotone pointers. Probabilities are
interpolated with modified absolute discounting, with one set of discounts for
all bigrams and one for all trigrams, and quantised on fixed scales, so a score
does not depend on how the levels are dealt to shards.

Counting: one pass for each level. The first reads the texts; a second turns them
into word numbers, in compressed blocks of about a million tokens, that the others
and the scoring read. Tasks count a block at a time and send each shard one packed
part of it; the pass for level 3 already sends places and ranks in level 2, which are small numbers. Shards of
level 3 are ranges of bigrams of about equal counts, so a bigram's pointer is
found by its place. A context that occurs more often than a shard has tokens is
dealt to several shards, by ranges of the next word (level 2) or by its rank
(level 3), so no task gathers an unbounded context.

The levels are files in the session's shared folder, written by the tasks and
memory-mapped by those that score. Nothing of the model passes the driver but
counts per shard and the few split contexts. A lost task writes its file again.
"""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import elias_fano as ef
from .common import checkpoint, prepare, shared_folder, text_of

#: Tokens that a task counts, or scores, at a time (a longer text makes a longer block).
BLOCK = 1_000_000
#: Tokens that a shard of a level stands for, about; a context with more is split.
SHARD = 2_500_000
END = "\n"  # no word holds white space
_HASH_BITS = 63
#: log10 scales of the codes: greatest loss, and type.
PROB, BACK = (-24.0, np.uint16), (-6.0, np.uint8)


def held_out(doc_id: Column, folds: int = 10) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


_POINT = 0x9E3779B97F4A7C15
_CHUNK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    """Powers 0 to n-1 modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_POINT, _CHUNK), _powers(pow(_POINT, -1, 1 << 64), _CHUNK)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread over all bits (a bijection), then cut to 63."""
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(by)
    return ((h ^ (h >> np.uint64(33))) >> np.uint64(1)).astype(np.int64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """63-bit hashes of the words ``data[start:end]``: the bytes are a polynomial's
    coefficients, which prefix sums evaluate at one point modulo 2^64."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        low = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, low + _CHUNK, side="right")))
        size = int(ends[stop - 1]) - low
        up, down = _tables() if size <= _CHUNK else (_powers(_POINT, size), _tables()[1])
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((data[low : low + size].astype(np.uint64) + np.uint64(1)) * up[:size], out=sums[1:])
        s, e = starts[at:stop] - low, ends[at:stop] - low
        out[at:stop] = (sums[e] - sums[s]) * down[s]
        at = stop
    return _mixed(out)


def _buffers(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words, and the n + 1 places where they begin and end."""
    words = words.cast(pa.large_string())
    _, offsets, data = words.buffers()
    edges = np.frombuffer(offsets, np.int64, len(words) + 1, words.offset * 8) if len(words) else np.zeros(1, np.int64)
    size = int(edges[-1] - edges[0])
    return np.frombuffer(data, np.uint8, size, int(edges[0])) if size else np.zeros(0, np.uint8), edges - edges[0]


def _same(data: np.ndarray, at: np.ndarray, other: np.ndarray, other_at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether ``sizes`` (one or more) bytes of ``data`` at ``at`` equal those of ``other``."""
    if not len(sizes):
        return np.zeros(0, bool)
    first = np.cumsum(sizes) - sizes
    step = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    differs = data[np.repeat(at, sizes) + step] != other[np.repeat(other_at, sizes) + step]
    return ~np.bitwise_or.reduceat(differs, first)


class Tokens:
    """Texts as numbers: ``ids`` into the distinct ``words``, one END (the last of
    them) after each text."""

    def __init__(self, columns: list[pa.Array]):
        texts = pa.chunked_array([c.cast(pa.large_string()) for c in columns], pa.large_string()).combine_chunks()
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        edges = split.offsets.to_numpy().astype(np.int64)
        words = split.flatten()
        full = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        if not full.all():  # white space at a text's ends makes empty words
            edges = np.concatenate(([0], np.cumsum(full)))[edges - edges[0]]
            words = words.filter(pa.array(full))
        coded = words.dictionary_encode()
        del words, split
        self.words = pa.concat_arrays([coded.dictionary.cast(pa.large_string()), pa.array([END], pa.large_string())])
        sizes = np.diff(edges)
        self.lengths = sizes + 1
        self.ids = np.full(len(coded) + len(sizes), len(self.words) - 1, np.int64)
        self.ids[np.arange(len(coded)) + np.repeat(np.arange(len(sizes)), sizes)] = coded.indices.to_numpy()


class Coded:
    """A block of texts: the ``number`` of every distinct word in it (-1: unknown), the
    ``ids`` of the tokens into these, and how many tokens each text has."""

    def __init__(self, number: np.ndarray, ids: np.ndarray, lengths: np.ndarray):
        self.number, self.ids, self.lengths = number, ids, lengths
        self.starts = np.cumsum(lengths) - lengths

    @classmethod
    def of(cls, texts: list[pa.Array], trie: Trie) -> Coded:
        t = Tokens(texts)
        return cls(trie.numbers(t.words), t.ids, t.lengths)

    def packed(self) -> bytes:
        return _pack([np.zeros(0, np.int64), self.number + 1, self.ids, self.lengths])

    @classmethod
    def unpacked(cls, data: bytes) -> Coded:
        _, number, ids, lengths = _unpack(data)
        return cls(number - 1, ids, lengths)

    def some(self, texts: np.ndarray) -> Coded:
        """The block with only the ``texts`` (a mask)."""
        return self if texts.all() else Coded(self.number, self.ids[np.repeat(texts, self.lengths)], self.lengths[texts])

    def pairs(self, begin: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The two words of every token's bigram as one number, the numbers of these
        words with ``begin`` for a text's beginning, and the width of one in bits."""
        wide = max(21, (len(self.number) + 1).bit_length())
        before = np.empty_like(self.ids)
        before[1:] = self.ids[:-1]
        before[self.starts] = len(self.number)
        return (before << wide) | self.ids, np.append(self.number, begin), wide

    def inner(self) -> np.ndarray:
        """Places of the tokens that are not the first of their text."""
        inner = np.ones(len(self.ids), bool)
        inner[self.starts] = False
        return np.nonzero(inner)[0]


def _blocks(batches: Iterator[pa.RecordBatch], text_column: int, block: int = BLOCK) -> Iterator[tuple[list[pa.RecordBatch], list[pa.Array]]]:
    """Record batches until their texts have about ``block`` tokens."""
    held, texts, size = [], [], 0
    for batch in batches:
        held.append(batch)
        texts.append(batch.column(text_column))
        size += texts[-1].nbytes // 6
        if size >= block:
            yield held, texts
            held, texts, size = [], [], 0
    if held:
        yield held, texts


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    return keys[first], np.add.reduceat(counts, np.nonzero(first)[0]) if len(keys) else counts


def _coded(values: np.ndarray, scale: tuple[float, type]) -> np.ndarray:
    most = np.iinfo(scale[1]).max
    return np.rint(np.clip(values / scale[0], 0, 1) * most).astype(scale[1])


def _decoded(codes: np.ndarray, scale: tuple[float, type]) -> np.ndarray:
    return codes * (scale[0] / np.iinfo(scale[1]).max)


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 1, 2 and over, from the numbers of n-grams seen 1 to 4 times."""
    n = n.astype(np.float64)
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    out = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.7 * k for k in (1, 2, 3)]
    return np.array([np.clip(d, 0.1 * k, 0.98 * k) for k, d in enumerate(out, 1)])


class Split:
    """Contexts dealt to shards: those from ``at[i]`` (rising) on to ``parts[i]`` shards
    from ``first[i]`` on. Total and back-off weight are of contexts in several parts."""

    def __init__(self, at=(), parts=(), base: int = 0):
        self.at, self.parts = np.asarray(at, np.int64), np.asarray(parts, np.int64)
        self.first = base + np.cumsum(self.parts) - self.parts
        self.end = base + int(self.parts.sum())
        self.back, self.total = np.zeros(len(self.at)), np.ones(len(self.at))

    def find(self, contexts: np.ndarray) -> np.ndarray:
        """Number of each context in ``at``, or -1."""
        if not len(self.at):
            return np.full(len(contexts), -1)
        i = np.minimum(np.searchsorted(self.at, contexts), len(self.at) - 1)
        return np.where(self.at[i] == contexts, i, -1)

    def range_of(self, contexts: np.ndarray) -> np.ndarray:
        """Number of the range that each context lies in."""
        return np.searchsorted(self.at, contexts, side="right") - 1

    def owner(self, shard: int) -> int:
        return int(np.searchsorted(self.first, shard, side="right")) - 1

    def weigh(self, stats: dict[int, dict], cut: np.ndarray) -> None:
        for i in np.nonzero(self.parts > 1)[0].tolist():
            own = [stats[s] for s in range(self.first[i], self.first[i] + self.parts[i]) if s in stats]
            total = sum(x["total"] for x in own)
            once, twice = (sum(x["seen"][k] for x in own) for k in (0, 1))
            lost = np.dot(cut, (once, twice, sum(x["n"] for x in own) - once - twice))
            self.total[i], self.back[i] = total or 1, lost / total if total else 1.0


def _ranges(counts: np.ndarray, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ranges of about ``shard`` tokens begin, and the parts each is dealt to: one,
    but for a bigram that has more by itself."""
    parts = -(-counts // shard)
    hot = parts > 1
    chunk = np.cumsum(np.where(hot, 0, counts)) // shard
    first = np.ones(len(counts), bool)
    first[1:] = (chunk[1:] != chunk[:-1]) | hot[1:] | hot[:-1]
    return np.nonzero(first)[0], parts[first]


@dataclass
class Model:
    """Where the trie is and how it is dealt to shards."""

    folder: str
    tokens: int = 0
    words: int = 0
    bits: int = 0  # shards of level 1: 2^bits, by the top bits of a word's hash; level 2 has those of split words besides
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # number of the first word of each shard
    places: np.ndarray = field(default_factory=lambda: np.zeros(2, np.int64))  # place of the first bigram of each shard, and their number
    split_words: Split = field(default_factory=Split)
    ranges: Split = field(default_factory=Split)  # of places: the shards of level 3
    cuts: dict[int, np.ndarray] = field(default_factory=dict)  # discounts of levels 2 and 3

    def path(self, what: str, shard: int) -> str:
        return f"{self.folder}/{what}-{shard}.ef"


class Trie:
    """The levels as one task sees them: files are mapped when first asked."""

    def __init__(self, model: Model):
        self.m, self.files = model, {}
        self.begin = self.m.words  # the number that stands for a text's beginning

    def file(self, what: str, shard: int):
        key = what, shard
        if key not in self.files:
            arrays, meta = ef.load(self.m.path(what, shard))
            sequences = {k: ef.sequence(k, arrays, meta) for k, v in meta.items() if isinstance(v, dict)}
            self.files[key] = arrays, meta, sequences
        return self.files[key]

    @staticmethod
    def by_shard(shards: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if len(shards) and int(shards.max()) < 1 << 16:
            shards = shards.astype(np.uint16)  # sorted by radix
        order = np.argsort(shards, kind="stable")
        if len(order):
            ends = np.nonzero(shards[order][1:] != shards[order][:-1])[0] + 1
            for part in np.split(order, ends):
                yield int(shards[part[0]]), part

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Numbers of words, -1 for unknown ones: the hash finds, the bytes decide."""
        if not self.m.words:
            return np.full(len(words), -1, np.int64)
        data, edges = _buffers(words)
        hashes, sizes = word_hashes(data, edges[:-1], edges[1:]), np.diff(edges)
        out = np.full(len(words), -1, np.int64)
        for s, at in self.by_shard(hashes >> (_HASH_BITS - self.m.bits)):
            arrays, meta, seq = self.file("words", s)
            want = hashes[at] & ((1 << (_HASH_BITS - self.m.bits)) - 1)
            got = seq["hashes"].find(want)
            at, got, want = at[got >= 0], got[got >= 0], want[got >= 0]
            begin = seq["edges"].at(got)
            fits = seq["edges"].at(got + 1) - begin == sizes[at]
            fits[fits] = _same(data, edges[at[fits]], arrays["bytes"], begin[fits], sizes[at[fits]])
            out[at[fits]] = got[fits] + self.m.first[s]
            for i, g, h in zip(at[~fits].tolist(), got[~fits].tolist(), want[~fits].tolist()):
                word = data[edges[i] : edges[i + 1]].tobytes()
                for step in (-1, 1):  # other words of that hash lie beside
                    place = g + step
                    while 0 <= place < meta["n"] and int(seq["hashes"].at(np.array([place]))[0]) == h:
                        a, b = seq["edges"].at(np.array([place, place + 1])).tolist()
                        if arrays["bytes"][a:b].tobytes() == word:
                            out[i] = place + self.m.first[s]
                        place += step
        return out

    def shard_of(self, words: np.ndarray) -> np.ndarray:
        """Level 1 shard of a word's number; the beginning lives in shard 0."""
        found = np.searchsorted(self.m.first, words, side="right") - 1
        return np.where(words == self.begin, 0, found)

    def pair_shard(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Level 2 shard of the bigrams; an unknown b is looked for in a's first."""
        out, split = self.shard_of(a), self.m.split_words
        i = split.find(a)
        at = np.nonzero(i >= 0)[0]
        i = i[at]
        out[at] = split.first[i] + np.maximum(b[at], 0) * split.parts[i] // self.m.words
        return out

    def local(self, words: np.ndarray, shard: int) -> np.ndarray:
        """Slot of words in a shard of level 2: a split word is alone in its shards."""
        if shard >= 1 << self.m.bits:
            return np.zeros(len(words), np.int64)
        return np.where(words == self.begin, self.file("words", shard)[1]["n"], words - self.m.first[shard])

    def slots(self, shard: int) -> int:
        return 1 if shard >= 1 << self.m.bits else self.file("words", shard)[1]["n"] + (shard == 0)

    def counts(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        known = np.nonzero(words >= 0)[0]
        for s, at in self.by_shard(self.shard_of(words[known])):
            arrays, meta, _ = self.file("words", s)
            out[known[at]] = ef.unpacked(arrays["counts"], words[known[at]] - self.m.first[s], meta["width"]).astype(np.int64)
        return out

    def unigram(self, words: np.ndarray) -> np.ndarray:
        """log10 of (count + 0.1) / (N + 0.1 (V + 1))."""
        return np.log10((self.counts(words) + 0.1) / (self.m.tokens + 0.1 * (self.m.words + 1)))

    def bigrams(self, a: np.ndarray, b: np.ndarray, coded: bool = True):
        """Place (or -1) of each bigram, its rank among the successors of a, and, once
        they are ``coded``, its log10 probability and a's log10 back-off weight."""
        n = len(a)
        place, rank = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        prob, back = np.full(n, np.nan), np.zeros(n)
        known = np.nonzero(a >= 0)[0]
        for s, at in self.by_shard(self.pair_shard(a[known], b[known])):
            at = known[at]
            seq = self.file("pairs", s)[2]
            left = self.local(a[at], s)
            got = seq["keys"].find(np.where(b[at] >= 0, left * self.m.words + b[at], -1))
            hit = got >= 0
            codes = self.file("pair-codes", s)[0] if coded else {}
            if coded:
                back[at] = _decoded(codes["back"][left], BACK)
            at, got, left = at[hit], got[hit], left[hit]
            place[at] = got + self.m.places[s]
            rank[at] = got - seq["pointers"].at(left)
            if s >= 1 << self.m.bits:  # the ranks of a split word run through its shards
                split = self.m.split_words
                rank[at] += self.m.places[s] - self.m.places[split.first[split.owner(s)]]
            if coded:
                prob[at] = _decoded(codes["prob"][got], PROB)
        return place, rank, prob, back

    def successors(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word's first successor, and how many there are."""
        begin, n = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        split = self.m.split_words
        i = split.find(words)
        at = np.nonzero(i >= 0)[0]
        begin[at] = self.m.places[split.first[i[at]]]
        n[at] = self.m.places[split.first[i[at]] + split.parts[i[at]]] - begin[at]
        rest = np.nonzero(i < 0)[0]
        for s, at in self.by_shard(self.shard_of(words[rest])):
            at = rest[at]
            pointers, left = self.file("pairs", s)[2]["pointers"], self.local(words[at], s)
            begin[at] = pointers.at(left)
            n[at] = pointers.at(left + 1) - begin[at]
            begin[at] += self.m.places[s]
        return begin, n

    def _place_shard(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.m.places[:-1], places, side="right") - 1

    def place_probs(self, places: np.ndarray) -> np.ndarray:
        out = np.empty(len(places))
        for s, at in self.by_shard(self._place_shard(places)):
            out[at] = _decoded(self.file("pair-codes", s)[0]["prob"][places[at] - self.m.places[s]], PROB)
        return out

    def deep_shard(self, place: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Level 3 shard of trigrams, by their first bigram's place; those of a bigram
        in several parts are dealt by rank."""
        r = self.m.ranges.range_of(place)
        return self.m.ranges.first[r] + np.maximum(rank, 0) % self.m.ranges.parts[r]

    def first_place(self, shard: int) -> int:
        return int(self.m.ranges.at[self.m.ranges.owner(shard)])

    def seconds(self, shard: int) -> np.ndarray:
        """The second words of the bigrams of a level 3 shard, in order."""
        r = self.m.ranges.owner(shard)
        low = int(self.m.ranges.at[r])
        s = int(self._place_shard(np.array([low]))[0])
        base = int(self.m.places[s])
        high = int(self.m.ranges.at[r + 1]) if r + 1 < len(self.m.ranges.at) else int(self.m.places[-1])
        return self.file("pairs", s)[2]["keys"].all()[low - base : high - base] % self.m.words

    def trigrams(self, place: np.ndarray, rank: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """log10 probabilities of trigrams, in any order with equal places together:
        ``place`` of the first bigram (or -1), ``rank`` of the third word among the
        second's successors (or -1), ``lower`` the second bigram's log10 probability."""
        out = lower.copy()
        known = np.nonzero(place >= 0)[0]
        for s, at in self.by_shard(self.deep_shard(place[known], rank[known])):
            at = known[at]
            seq, codes = self.file("triples", s)[2], self.file("triple-codes", s)[0]
            local = place[at] - self.first_place(s)
            out[at] += _decoded(codes["back"][local], BACK)
            seen = rank[at] >= 0
            at, local = at[seen], local[seen]
            if not len(at):
                continue
            first = np.concatenate(([True], local[1:] != local[:-1]))
            begin = seq["pointers"].at(local[first])[np.cumsum(first) - 1]
            got = seq["keys"].find(begin + rank[at])
            out[at[got >= 0]] = _decoded(codes["prob"][got[got >= 0]], PROB)
        return out


def _pack(columns: list[np.ndarray]) -> bytes:
    """Number columns, the first (rising) as differences, byte by byte, each compressed."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    out = []
    for i, c in enumerate(columns):
        c = np.diff(c, prepend=0) if i == 0 else c
        width = -(-int(c.max()).bit_length() // 8) if len(c) else 0
        c = c.astype(np.uint32 if width <= 4 else np.uint64)
        raw = squeeze(b"".join((c >> (8 * k)).astype(np.uint8).tobytes() for k in range(width)))
        out.append(np.array([len(raw), width, len(c)], np.int64).tobytes() + raw)
    return b"".join(out)


def _unpack(data: bytes | pa.Buffer) -> list[np.ndarray]:
    out, at = [], 0
    expand = zstandard.ZstdDecompressor().decompress
    while at < len(data):
        size, width, n = np.frombuffer(data, np.int64, 3, at).tolist()
        raw = np.frombuffer(expand(data[at + 24 : at + 24 + size]), np.uint8)
        c = np.zeros(n, np.int64)
        for k in range(width):
            c |= raw[k * n : (k + 1) * n].astype(np.int64) << (8 * k)
        out.append(np.cumsum(c) if not out else c)
        at += 24 + size
    return out


def _shared_path(spark: SparkSession, folder: str | None) -> str:
    if folder is None:
        folder = f"{shared_folder(spark)}/ngrams-{uuid.uuid4().hex}"
        atexit.register(shutil.rmtree, urlparse(folder).path, True)
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError("levels are memory-mapped: give a folder that all executors mount")
    os.makedirs(url.path, exist_ok=True)
    return url.path


# --- counting --------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, block in _blocks(batches, 0):
        t = Tokens(block)
        n = np.bincount(t.ids, minlength=len(t.words))
        yield pa.RecordBatch.from_arrays([t.words.cast(pa.string()), pa.array(n.astype(np.int64))], ["w", "c"])


def _blocks_of(shards: np.ndarray, columns) -> pa.RecordBatch:
    """One packed block for each shard; ``columns(s, at)`` gives its columns."""
    rows = []
    for s, at in Trie.by_shard(shards):
        found = columns(s, at)
        order = np.argsort(found[0], kind="stable")
        rows.append((s, _pack([c[order] for c in found])))
    return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], ["s", "block"])


def _count_pairs(trie: Trie, t: Coded) -> pa.RecordBatch:
    both, number, wide = t.pairs(trie.begin)
    pairs, n = np.unique(both, return_counts=True)
    a, b = number[pairs >> wide], number[pairs & ((1 << wide) - 1)]
    return _blocks_of(trie.pair_shard(a, b), lambda s, at: (trie.local(a[at], s) * trie.m.words + b[at], n[at]))


def _count_triples(trie: Trie, t: Coded) -> pa.RecordBatch:
    both, number, wide = t.pairs(trie.begin)
    pairs, pair_of = np.unique(both, return_inverse=True)
    del both
    place, rank, _, _ = trie.bigrams(number[pairs >> wide], number[pairs & ((1 << wide) - 1)], coded=False)
    at = t.inner()
    # A trigram is its first bigram and its second.
    wide = max(21, len(pairs).bit_length())
    triples, n = np.unique((pair_of[at - 1] << wide) | pair_of[at], return_counts=True)
    place, rank = place[triples >> wide], rank[triples & ((1 << wide) - 1)]
    return _blocks_of(trie.deep_shard(place, rank), lambda s, at: (place[at] - trie.first_place(s), rank[at], n[at]))


def _stats(s: int, counts: np.ndarray, at: np.ndarray, parts: np.ndarray) -> pa.Table:
    seen = np.bincount(np.minimum(counts, 5), minlength=6)[1:5]
    values = [[s], [len(counts)], [int(counts.sum())], [seen.tolist()], [at.tolist()], [parts.tolist()]]
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 3
    return pa.table([pa.array(v, k) for v, k in zip(values, kinds)], names=["s", "n", "total", "seen", "at", "parts"])


_STATS = "s long, n long, total long, seen array<long>, at array<long>, parts array<long>"


def _save_counts(model: Model, what: str, s: int, counts: np.ndarray) -> None:
    ef.save(model.path(what, s), {"block": np.frombuffer(_pack([np.zeros(0, np.int64), counts]), np.uint8)}, {})


def _load_counts(model: Model, what: str, s: int) -> np.ndarray:
    return _unpack(ef.load(model.path(what, s))[0]["block"].tobytes())[1]


def _save_words(model: Model, s: int, hashes: np.ndarray, words: pa.Array, counts: np.ndarray) -> None:
    data, edges = _buffers(words)
    width, low = int(counts.max(initial=0)).bit_length(), (1 << (_HASH_BITS - model.bits)) - 1
    arrays, meta = {"counts": ef.packed(counts, width), "bytes": data}, {"n": len(counts), "width": width}
    ef.nested("hashes", ef.EliasFano.build(hashes & low, low + 1), arrays, meta)
    ef.nested("edges", ef.EliasFano.build(edges, len(data) + 1), arrays, meta)
    ef.save(model.path("words", s), arrays, meta)


def _save_pairs(trie: Trie, s: int, keys: np.ndarray, counts: np.ndarray) -> None:
    slots, words = trie.slots(s), trie.m.words
    arrays, meta = {}, {}
    ef.nested("keys", ef.EliasFano.build(keys, slots * words), arrays, meta)
    ef.nested("pointers", ef.EliasFano.build(np.searchsorted(keys, np.arange(slots + 1) * words), len(keys) + 1), arrays, meta)
    _save_counts(trie.m, "pair-counts", s, counts)
    ef.save(trie.m.path("pairs", s), arrays, meta)


def _successors_of(trie: Trie, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    each, which = np.unique(words, return_inverse=True)
    begin, n = trie.successors(each)
    return begin[which], n[which]


def _save_triples(trie: Trie, s: int, local: np.ndarray, rank: np.ndarray, n: np.ndarray) -> np.ndarray:
    pointers = np.concatenate(([0], np.cumsum(_successors_of(trie, trie.seconds(s))[1])))
    keys, n = _counted(pointers[local] + rank, n)
    arrays, meta = {}, {}
    ef.nested("pointers", ef.EliasFano.build(pointers, int(pointers[-1]) + 1), arrays, meta)
    ef.nested("keys", ef.EliasFano.build(keys, int(pointers[-1]) + 1), arrays, meta)
    _save_counts(trie.m, "triple-counts", s, n)
    ef.save(trie.m.path("triples", s), arrays, meta)
    return n


# --- smoothing -------------------------------------------------------------


def _save_codes(model: Model, what: str, s: int, counts, lower, group, groups: int, cut: np.ndarray, whole: tuple | None) -> None:
    """Interpolated log10 probabilities and log10 back-off weights of the groups;
    ``whole`` has the total and weight of a context in several parts."""
    lost = cut[np.minimum(counts, 3) - 1]
    if whole:
        total, back = (np.array([x]) for x in whole)
    else:
        total = np.bincount(group, counts, groups)
        with np.errstate(divide="ignore", invalid="ignore"):
            back = np.where(total > 0, np.bincount(group, lost, groups) / total, 1.0)
    prob = np.log10((counts - lost) / total[group] + back[group] * lower)
    ef.save(model.path(what, s), {"prob": _coded(prob, PROB), "back": _coded(np.log10(back), BACK)}, {})


def _smooth_pairs(trie: Trie, s: int) -> None:
    m, keys, split = trie.m, trie.file("pairs", s)[2]["keys"].all(), trie.m.split_words
    i = split.owner(s) if s >= 1 << m.bits else -1
    whole = (split.total[i], split.back[i]) if i >= 0 else None
    counts, lower = _load_counts(m, "pair-counts", s), 10 ** trie.unigram(keys % m.words)
    _save_codes(m, "pair-codes", s, counts, lower, keys // m.words, trie.slots(s), m.cuts[2], whole)


def _smooth_triples(trie: Trie, s: int) -> None:
    m, i = trie.m, trie.m.ranges.owner(s)
    pointers, keys = (trie.file("triples", s)[2][k].all() for k in ("pointers", "keys"))
    whole = (m.ranges.total[i], m.ranges.back[i]) if m.ranges.parts[i] > 1 else None
    parent = np.searchsorted(pointers, keys, side="right") - 1
    begin = _successors_of(trie, trie.seconds(s))[0]
    lower = 10 ** trie.place_probs((begin - pointers[:-1])[parent] + keys)
    _save_codes(m, "triple-codes", s, _load_counts(m, "triple-counts", s), lower, parent, len(begin), m.cuts[3], whole)


def train(texts: DataFrame, folder: str | None = None, shard: int = SHARD) -> Model:
    """The model of the column ``text`` (not null) of all rows."""
    return build(texts.select(F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), "text"), folder, shard)[0]


def build(df: DataFrame, folder: str | None = None, shard: int = SHARD) -> tuple[Model, DataFrame]:
    """Learn from the rows of ``df`` (doc_id, held_out, text) that are not held out. Gives
    the model and all texts in blocks: ``rows`` (the first two columns) and ``block``."""
    spark = df.sparkSession
    prepare(spark)
    texts = df.filter("not held_out").select("text")
    model = Model(_shared_path(spark, folder))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(model)
        for held, block in _blocks(batches, 2):
            rows = pa.Table.from_batches(held).select(["doc_id", "held_out"]).combine_chunks().to_batches()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows[0].schema) as out:
                out.write_batch(rows[0])
            cells = [pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([Coded.of(block, trie).packed()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, ["rows", "block"])

    def in_blocks() -> DataFrame:
        """Written to the shared folder once; every later pass reads it there."""
        path = f"file://{model.folder}/texts"
        df.mapInArrow(coded, "rows binary, block binary").write.mode("overwrite").parquet(path)
        return spark.read.schema("rows binary, block binary").parquet(path)

    vocabulary = checkpoint(texts.mapInArrow(_count_words, "w string, c long").groupBy("w").agg(F.sum("c").alias("c")))
    sums = vocabulary.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    model.words, model.tokens = int(sums["v"]), int(sums["n"] or 0)
    if not model.words:
        return model, in_blocks()
    begins = int(vocabulary.filter(F.col("w") == END).first()["c"])  # as many texts begin as end
    model.bits = (max(2 * model.words, model.tokens) // shard).bit_length()
    shards = 1 << model.bits

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, edges = _buffers(batch.column(0))
            h = word_hashes(data, edges[:-1], edges[1:])
            yield pa.RecordBatch.from_arrays([pa.array(h >> (_HASH_BITS - model.bits)), pa.array(h), *batch.columns], ["s", "h", "w", "c"])

    def save_words(key: tuple, table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("h", "ascending"), ("w", "ascending")]))
        counts = table["c"].to_numpy()
        _save_words(model, key[0].as_py(), table["h"].to_numpy(), table["w"].combine_chunks(), counts)
        split = np.nonzero(counts > shard)[0]
        return _stats(key[0].as_py(), counts, split, -(-counts[split] // shard))

    def gathered(df: DataFrame, save) -> dict[int, dict]:
        """Counts per shard from the tasks that write it."""
        return {x["s"]: x for x in df.groupBy("s").applyInArrow(save, _STATS).toArrow().to_pylist()}

    def split_of(stats: dict[int, dict], before: np.ndarray, base: int, more: tuple = ()) -> Split:
        found = sorted([(int(before[s]) + i, n) for s, x in stats.items() for i, n in zip(x["at"], x["parts"])] + list(more))
        return Split([i for i, _ in found], [n for _, n in found], base)

    def first_of(stats: dict[int, dict], n: int) -> np.ndarray:
        per = np.zeros(n, np.int64)
        for s, x in stats.items():
            per[s] = x["n"]
        return np.concatenate(([0], np.cumsum(per)))

    def built(n: int, f) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in batch.column(0).to_pylist():
                    f(Trie(model), s)
                yield batch

        spark.range(0, n, 1, min(n, 10_000)).mapInArrow(run, "id long").count()

    def counted(count):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = Trie(model)
            for rows, block in _read(batches):
                learnt = ~rows.column(1).to_numpy(zero_copy_only=False)
                if learnt.any():
                    yield count(trie, block.some(learnt))

        return blocks.mapInArrow(run, "s long, block binary")

    def columns_of(table: pa.Table) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*(_unpack(b.as_py()) for b in table["block"]))]

    none = np.zeros(0, np.int64)
    stats = gathered(vocabulary.mapInArrow(hashed, "s long, h long, w string, c long"), save_words)
    for s in set(range(shards)) - set(stats):
        _save_words(model, s, none, pa.array([], pa.string()), none)
    model.first = first_of(stats, shards)[:-1]
    model.split_words = split_of(stats, model.first, shards, [(model.words, -(-begins // shard))] if begins > shard else [])

    def save_pairs(key: tuple, table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        keys, counts = _counted(*columns_of(table))
        _save_pairs(Trie(model), s, keys, counts)
        return _stats(s, counts, *_ranges(counts, shard))

    blocks = in_blocks()
    stats = gathered(counted(_count_pairs), save_pairs)
    for s in set(range(model.split_words.end or shards)) - set(stats):
        _save_pairs(Trie(model), s, none, none)
    model.places = first_of(stats, model.split_words.end)
    model.ranges = split_of(stats, model.places, 0)
    model.cuts[2] = discounts(sum(np.array(x["seen"]) for x in stats.values()))
    model.split_words.weigh(stats, model.cuts[2])
    built(model.split_words.end, _smooth_pairs)

    def save_triples(key: tuple, table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        return _stats(s, _save_triples(Trie(model), s, *columns_of(table)), none, none)

    stats = gathered(counted(_count_triples), save_triples)
    for s in set(range(model.ranges.end)) - set(stats):
        _save_triples(Trie(model), s, none, none, none)
    model.cuts[3] = discounts(sum((np.array(x["seen"]) for x in stats.values()), np.zeros(4, np.int64)))
    model.ranges.weigh(stats, model.cuts[3])
    built(model.ranges.end, _smooth_triples)
    return model, blocks


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Coded]]:
    for batch in batches:
        for rows, block in zip(*batch.columns):
            with pa.ipc.open_stream(rows.as_buffer()) as stream:
                yield stream.read_next_batch(), Coded.unpacked(block.as_buffer())


def score_texts(trie: Trie, t: Coded) -> dict[str, np.ndarray]:
    """n_tokens, n_known, base_score and score of each text."""
    m = trie.m
    if not m.words:  # nothing was learnt: c = N = V = 0
        base = np.zeros(len(t.lengths))
        return {"n_tokens": t.lengths, "n_known": np.zeros(len(t.lengths), np.int64), "base_score": base, "score": base.copy()}
    both, number, wide = t.pairs(trie.begin)
    counts, one = trie.counts(t.number), trie.unigram(t.number)
    pairs, pair_of = np.unique(both, return_inverse=True)
    del both
    last = pairs & ((1 << wide) - 1)
    place, rank, prob, back = trie.bigrams(number[pairs >> wide], number[last])
    two = np.where(np.isnan(prob), back + one[last], prob)
    at = t.inner()
    value = two[pair_of]
    # Distinct trigrams: their first bigram and their second.
    wide = max(21, len(pairs).bit_length())
    triples, again = np.unique((pair_of[at - 1] << wide) | pair_of[at], return_inverse=True)
    lead, last = triples >> wide, triples & ((1 << wide) - 1)
    value[at] = trie.trigrams(place[lead], rank[last], two[last])[again]
    doc = np.repeat(np.arange(len(t.lengths)), t.lengths)
    n = len(t.lengths)
    return {
        "n_tokens": t.lengths,
        "n_known": np.bincount(doc, counts[t.ids] > 0, n).astype(np.int64),
        "base_score": np.bincount(doc, one[t.ids], n),
        "score": np.bincount(doc, value, n),
    }


def lm_scores(docs: DataFrame, folds: int = 10, folder: str | None = None, shard: int = SHARD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every
    row of ``docs``; the model learns from the rows that aren't held out.

    A null text is empty: its one token is the end. A null doc_id isn't held
    out. Repeated rows are counted and scored each. An empty table gives no
    rows; with no training row at all both scores are 0. Long texts are scored
    whole. Extra columns are not read."""
    prepare(docs.sparkSession)
    df = docs.select(F.col("doc_id").alias("doc_id"), held_out(F.col("doc_id"), folds).alias("held_out"), text_of().alias("text"))
    model, blocks = build(df, folder, shard)
    names = ["n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(model)
        for rows, block in _read(batches):
            out = score_texts(trie, block)
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(out[k]) for k in names)], ["doc_id", "held_out", *names])

    kind = dict(df.dtypes)["doc_id"]
    scored = blocks.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
