"""Best-fit packing of token sequences by exact-complement hashing.

What can fill a sequence depends on lengths alone, and there are no more
lengths than the sequence is long.  So the plan is made on the histogram of
lengths: sums of one, two and three lengths are indexed, combinations that fill
a sequence exactly are consumed as far as the counts go, and what is left is
packed by best fit, largest first, bins of one shape at a time; the gap that each
piece leaves in a bin is looked up in the same sums first.  Pieces then
find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, named, small_batches
from .tokenization import encoder

CAPACITY = 4096
#: Pieces of one length whose ranks one task works out, as long as there are at most a million such groups.
RANK_GROUP = 256

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def cut_pieces(
    docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, spaced: bool = False, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, special: bool = False
) -> DataFrame:
    """Token ids of each document and ``end_id``, in pieces of ``capacity``; the last may be shorter.

    One row for each piece: doc_id, piece, start, length, ids_crc32 and, if
    asked for, the ids themselves.  Null texts count as empty: one piece, the
    end id alone.  ``special``: control strings in a text become control ids.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    end = np.array([end_id], "<u4").tobytes()
    rows = docs.select(named(id_col).alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, spaced, special).encode
        for batch in batches:
            owner, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                data = encode(text) + end
                for i, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    owner.append(k)
                    piece.append(i)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            arrays = [batch.column(0).take(pa.array(owner, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(ids, pa.list_(pa.int32()))] * with_ids], names=names)

    return rows.mapInArrow(run, PIECES.format(id=kind.simpleString()) + ", ids array<int>" * with_ids)


#: A sequence's content as runs (length, how many), and how many sequences look like that.
Pattern = tuple[tuple[tuple[int, int], ...], int]


class _Sums:
    """The counts left, and which sums of one, two and three of them there are."""

    def __init__(self, counts: np.ndarray, capacity: int) -> None:
        self.left = [int(x) for x in counts]
        self.there = np.array(self.left[: capacity + 1]) > 0
        self.there[0] = False
        twice = np.array(self.left[: capacity + 1]) > 1
        #: By sum: how many pairs of different lengths, and of a length that is there twice.
        self.pairs = np.convolve(self.there.astype(np.int64), self.there)[: capacity + 1]
        same = np.flatnonzero(self.there[: capacity // 2 + 1])
        self.pairs[2 * same] -= 1
        self.pairs //= 2
        self.pairs[2 * np.flatnonzero(twice[: capacity // 2 + 1])] += 1

    def use(self, x: int, n: int) -> None:
        before, self.left[x] = self.left[x], self.left[x] - n
        if before > 1 >= self.left[x] and 2 * x < len(self.pairs):
            self.pairs[2 * x] -= 1
        if before and not self.left[x]:
            self.there[x] = False
            self.pairs[x:] -= self.there[: len(self.pairs) - x]

    def times(self, lengths: tuple[int, ...]) -> int:
        return min(self.left[x] // lengths.count(x) for x in lengths)

    def _two(self, gap: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        """Two lengths that fill ``gap``, the most alike first."""
        lows = np.flatnonzero(self.there[1 : gap // 2 + 1] & self.there[gap - 1 : gap - gap // 2 - 1 : -1]) + 1
        return next((x for c in lows[::-1].tolist() if self.times(x := (*taken, gap - c, c))), None)

    def fill(self, gap: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        """``taken`` and one, two or three lengths that fill ``gap`` exactly, as far as the counts go."""
        if self.there[gap] and self.times((*taken, gap)):
            return (*taken, gap)
        if self.pairs[gap] and (found := self._two(gap, taken)):
            return found
        # sums of three: a length and a sum of two
        thirds = np.flatnonzero(self.there[1 : max(1, gap - 1)] & (self.pairs[gap - 1 : 1 : -1] > 0)) + 1 if gap > 2 else ()
        for b in reversed(thirds):
            if (self.times((*taken, int(b)))) and (found := self._two(gap - int(b), (*taken, int(b)))):
                return found
        return None


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that use up ``counts`` (index: length).  Each step exhausts a length or a shape of bin,
    so patterns are a few for each length, whatever the counts."""
    sums = _Sums(counts, capacity)
    left, there = sums.left, sums.there
    patterns: list[Pattern] = []

    def take(times: int, *lengths: int) -> None:
        runs = {x: lengths.count(x) for x in lengths}
        for x, k in runs.items():
            sums.use(x, k * times)
        patterns.append((tuple(runs.items()), times))

    if left[capacity]:
        take(left[capacity], capacity)
    for a in range(capacity - 1, (capacity - 1) // 2, -1):  # pairs
        b = capacity - a
        if left[a] and left[b] and (a != b or left[a] > 1):
            take(left[a] // 2 if a == b else min(left[a], left[b]), a, b)
    for a in range(capacity - 2, (capacity - 1) // 3, -1):  # triples, by their largest
        if not left[a]:
            continue
        gap = capacity - a
        lows = np.flatnonzero(there[1 : gap // 2 + 1] & there[gap - 1 : gap - gap // 2 - 1 : -1]) + 1
        for c in lows[::-1].tolist():
            b = gap - c
            if b > a:
                continue
            if times := sums.times((a, b, c)):
                take(times, a, b, c)
            if not left[a]:
                break
    for a in range(capacity - 1, 0, -1):  # whatever one, two or three others fill, by the largest
        while left[a] and (found := sums.fill(capacity - a, (a,))):
            take(sums.times(found), *found)
    bins: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}  # by gap
    open_gaps = np.zeros(capacity + 1, bool)

    def put(gap: int, runs: tuple[tuple[int, int], ...], times: int) -> None:
        bins.setdefault(gap, []).append((runs, times))
        open_gaps[gap] = True

    for size in range(capacity, 0, -1):
        while left[size]:
            fits = np.flatnonzero(open_gaps[size:])
            if len(fits):
                gap = size + int(fits[0])
                runs, times = bins[gap].pop()
                open_gaps[gap] = bool(bins[gap])
            else:
                gap, runs, times = capacity, (), left[size]
            most = min(gap // size, left[size])  # so many of this length into one bin, as best fit would in turn
            # each piece placed leaves a gap, which others may fill exactly
            exact = next((x for k in range(1, most + 1) if gap > k * size and (x := sums.fill(gap - k * size, (size,) * k))), None)
            inside = exact or (size,) * most
            full = min(times, sums.times(inside))
            added = tuple((x, inside.count(x)) for x in dict.fromkeys(inside))
            for x, k in added:
                sums.use(x, k * full)
            put(gap - sum(inside), (*runs, *added), full)
            if runs and times > full:
                put(gap, runs, times - full)
    return patterns + [x for shapes in bins.values() for x in shapes]


def slots(patterns: list[Pattern], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """For ranges of ranks within a length: where they go.  Sorted by length and first rank."""
    seen: dict[int, int] = {}
    rows, base = [], 0
    for runs, times in patterns:
        at = 0
        for size, k in runs:
            first = seen.get(size, 0)
            rows.append((size, first, base, k, at))
            seen[size] = first + k * times
            at += k * size
        base += times
    table = np.array(sorted(rows) or np.empty((0, 5)), np.int64).reshape(-1, 5)
    return {n: table[:, i].copy() for i, n in enumerate(("length", "first", "base", "each", "at"))}


def ranked(pieces: DataFrame, histogram: dict[int, int], column: str) -> DataFrame:
    """``pieces`` with ``column``: each one's rank among those of its length, from 0.

    Lengths are split into hashed groups of about RANK_GROUP rows, so that a
    length which many pieces share is many small windows; the groups' sizes are
    summed up before.
    """
    spark = pieces.sparkSession
    each = max(RANK_GROUP, -(-sum(histogram.values()) // 1_000_000))
    parts = spark.createDataFrame([(k, max(1, -(-n // each))) for k, n in histogram.items()], "__length__ long, __parts__ long")
    split = pieces.join(F.broadcast(parts), F.col("length") == F.col("__length__")).withColumn(
        "__part__", F.pmod(F.xxhash64("doc_id", "piece"), F.col("__parts__"))
    ).drop("__length__", "__parts__")
    sizes = split.groupBy("length", "__part__").agg(F.count("*").alias("__n__"))
    before = Window.partitionBy("length").orderBy("__part__").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("length").alias("__l__"), F.col("__part__").alias("__p__"), F.coalesce(F.sum("__n__").over(before), F.lit(0)).alias("__before__"))
    inner = Window.partitionBy("length", "__part__").orderBy("doc_id", "piece", "start", "ids_crc32")
    own = split.withColumn("__within__", F.row_number().over(inner) - 1)
    joined = own.join(starts, (F.col("length") == F.col("__l__")) & (F.col("__part__") == F.col("__p__")))
    return joined.withColumn(column, F.col("__before__") + F.col("__within__")).drop("__l__", "__p__", "__part__", "__before__", "__within__")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (columns of :func:`cut_pieces`) with sequence_id and offset.

    The driver gets the histogram of lengths, ``capacity`` rows at most, and
    sends back the plan, a few rows for each length.  Pieces move once, as
    narrow rows.  Repeated rows are packed as often as they occur; an empty
    table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = cut(pieces.select("doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}
    counts = np.zeros(capacity + 1, np.int64)
    for k, n in histogram.items():
        counts[k] = n
    places = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    rows = ranked(pieces, histogram, "__rank__")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = places.value
        wide = np.int64(1) << np.int64(44)
        keys = s["length"] * wide + s["first"]
        for b in batches:
            size, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            k = np.searchsorted(keys, size * wide + rank, "right") - 1
            within = rank - s["first"][k]
            sequence = s["base"][k] + within // s["each"][k]
            offset = s["at"][k] + within % s["each"][k] * size
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=names)

    order = rows.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("__rank__").cast("long").alias("__rank__"))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    return order.mapInArrow(run, PIECES.format(id=kind) + ", sequence_id long, offset long")


def sequences(packed: DataFrame, pieces: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id and ids, from ``pack`` and ``cut_pieces(with_ids=True)`` of one input
    whose (doc_id, piece) are unique."""
    rows = packed.join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    grouped = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return grouped.select("sequence_id", F.flatten("parts.ids").alias("ids"))
