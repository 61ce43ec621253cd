"""Variable-capacity best-fit packing of documents into training sequences.

Documents are cut into pieces of at most the largest permitted length, dealt
evenly to shards of bounded size with their text, and packed by best-fit
decreasing in each. Several permitted lengths are optimised jointly: where a piece
fits no open bin, every permitted length that holds it is filled in trial with the
pieces still to come, and the one of least cost per token is opened. Every bin is
then downsized to the cheapest length that holds its contents. A shard is packed
with one opening length throughout as well, and the packing of least total cost is
kept. Bins come out whole, in random order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, prepare, text_of

SIZES = (512, 1024, 2048, 4096)
#: Pieces of one shard, and bytes of their texts: what a task holds.
SHARD, SHARD_BYTES = 20_000, 48_000_000
#: Cost of a bin besides its length, in tokens.
OVERHEAD = 16

SCHEMA = "doc_id long, piece int, start long, length int, bin_id long, bin_capacity int, bin_offset int, bin_used int, text string"
_WORD = re.compile(WORD)


def cut(text: str, most: int) -> list[tuple[int, int, str]]:
    """(start, length, text) of the pieces: words, and one end token after the last.
    A piece begins with a word (the first with what comes before it), so the pieces
    together are the text."""
    n = len(text.encode().split()) + 1  # bytes are split at ASCII white space
    if n <= most:
        return [(0, n, text)]
    at = [m.start() for i, m in enumerate(_WORD.finditer(text)) if i % most == 0]
    at = [0, *at[1:]] + [len(text)] * (-(-n // most) - len(at) + 1)
    return [(k * most, min(most, n - k * most), text[at[k] : at[k + 1]]) for k in range(-(-n // most))]


class Remaining:
    """Lengths still to be packed, largest first."""

    def __init__(self, lengths: list[int]):
        self.count = Counter(lengths)
        self.mask = sum(1 << n for n in self.count)

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            self.mask ^= 1 << n

    def filled(self, room: int) -> int:
        """Tokens that the largest fitting pieces would put into ``room``."""
        mask, used = self.mask, 0
        while room and (fit := mask & ((1 << (room + 1)) - 1)):
            n = fit.bit_length() - 1
            k = min(self.count[n], room // n)
            used, room = used + k * n, room - k * n
            mask = fit ^ (1 << n)
        return used


def best_fit(lengths: np.ndarray, sizes: tuple[int, ...], choose: Callable[[int, Remaining], int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of lengths in falling order: bin of each, offset in it, used of each bin.
    ``choose`` gives the size to open for a piece, knowing what is still to come.

    ``room`` keeps the open bins by room left; the bits of ``mask`` say which
    rooms exist, so the tightest fit is one shift away. Of equal rooms the bin
    filled last is taken."""
    room: dict[int, list[int]] = {}
    mask, used = 0, []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    lengths = lengths.tolist()
    rest = Remaining(lengths)
    for i, n in enumerate(lengths):
        rest.take(n)
        fit = mask >> n
        if fit:
            left = n + (fit & -fit).bit_length() - 1
            stack = room[left]
            b = stack.pop()
            if not stack:
                mask ^= 1 << left
        else:
            left, b = choose(n, rest), len(used)
            used.append(0)
        where[i], offset[i] = b, used[b]
        used[b] += n
        left -= n
        if left:
            stack = room.setdefault(left, [])
            if not stack:
                mask |= 1 << left
            stack.append(b)
    return where, offset, np.asarray(used, np.int64)


def least_cost(sizes: tuple[int, ...], overhead: int) -> Callable[[int, Remaining], int]:
    """The size of least cost per token, filled in trial with what is still to come;
    of equal ones the largest."""

    def choose(n: int, rest: Remaining) -> int:
        return min((s for s in sizes if s >= n), key=lambda s: ((s + overhead) / (n + rest.filled(s - n)), -s))

    return choose


def fixed(sizes: tuple[int, ...], opening: int) -> Callable[[int, Remaining], int]:
    return lambda n, rest: opening if n <= opening else min(s for s in sizes if s >= n)


def pack(lengths: np.ndarray, sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD):
    """bin, offset, and each bin's used and downsized capacity; ``lengths`` fall."""
    best, ordered = None, np.sort(np.asarray(sizes))
    for choose in (least_cost(sizes, overhead), *(fixed(sizes, s) for s in sizes)):
        where, offset, used = best_fit(lengths, sizes, choose)
        capacity = ordered[np.searchsorted(ordered, used)] if len(used) else used
        cost = int((capacity + overhead).sum())
        if best is None or cost < best[0]:
            best = cost, where, offset, used, capacity
    return best[1:]


def best_fit_packing(
    docs: DataFrame, sizes: tuple[int, ...] = SIZES, shard: int = SHARD, overhead: int = OVERHEAD, shard_bytes: int = SHARD_BYTES, seed: int = 1
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, bin_id, bin_capacity,
    bin_offset, bin_used, text. Rows lie bin by bin, a bin's pieces by offset; bins
    are in random order in their shard, to which documents are dealt evenly.

    Null and empty texts are one end token. Repeated rows and repeated doc_ids
    are packed once each, as separate pieces. A text longer than the largest
    size is cut, nothing is dropped: a document's pieces in order are its text. An
    empty table gives no rows. Other columns are not read."""
    prepare(docs.sparkSession)
    sizes = tuple(sorted(set(sizes)))
    if not sizes or sizes[0] < 1:
        raise ValueError("sizes must be positive")
    most = sizes[-1]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # A text has at most half as many words as bytes, and one token more.
    size = F.octet_length("text").cast("long")
    sums = texts.agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.sum(F.floor(size / (2 * most))).alias("cuts")).first()
    shards = max(1, -(-(sums["n"] + (sums["cuts"] or 0)) // shard), -(-(sums["bytes"] or 0) // shard_bytes))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, *piece) for i, t in zip(batch.column(0).to_pylist(), batch.column(1)) for k, piece in enumerate(cut(t.as_py(), most))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string())
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)] if rows else [pa.array([], kind) for kind in kinds]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got)
        order = pc.sort_indices(table, [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        where, offset, used, capacity = pack(table["length"].take(order).to_numpy(), sizes, overhead)
        part = TaskContext.get().partitionId()
        turn = np.random.default_rng((seed, part)).permutation(len(used))
        by_bin = np.lexsort((offset, turn[where]))
        for i in range(0, len(by_bin), 2_000):
            at = by_bin[i : i + 2_000]
            piece, b = table.take(order.take(pa.array(at))), where[at]
            placed = ((np.int64(part) << 32) + b, capacity[b].astype(np.int32), offset[at].astype(np.int32), used[b].astype(np.int32))
            cells = [*(piece[c].combine_chunks() for c in ("doc_id", "piece", "start", "length")), *map(pa.array, placed), piece["text"].combine_chunks()]
            yield pa.RecordBatch.from_arrays(cells, [c.split()[0] for c in SCHEMA.split(", ")])

    # Round robin (Spark sorts before it deals, so a lost task's rerun deals the same).
    return texts.mapInArrow(pieces, "doc_id long, piece int, start long, length int, text string").repartition(shards).mapInArrow(run, SCHEMA)
