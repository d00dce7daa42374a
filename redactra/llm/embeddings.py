"""Near-duplicate vectors: every pair of one label is compared, but for those that a bound rules in or out.

Each vector goes to the nearest of a label's centres, a sample of its vectors.
Sorted by label and centre the vectors are written once, to files in the shared
folder; a task is a pair of pieces of one label, and reads the two pieces there.
Nothing is sent to more than one place, so that the disk grows with the input
and not with the number of pairs or of cells.  For a pair of cells (vectors of
one centre) the distance along the line through both centres is a lower bound,
and the sum of the angles to the centres and between them an upper one: pairs
that neither settles are multiplied in single precision, and those within the
error of the limit once more in double precision.  Links never leave as pairs:
a task returns counts and its local components only.  Centres decide about the
work, never about the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, fresh_path, named, release, small_batches
from .components import components

COSINE = 0.93
BLOCK = 8
#: Vectors that a cell should have.
CELL = 1500
#: Bytes of all centres, which every task holds; cells grow beyond CELL to stay within it.
CENTRES_BYTES = 16 << 20
#: Bytes of vectors in a piece, by the size of the table.
PIECE_BYTES = (1 << 20, 16 << 20)
#: Vectors multiplied at a time with those of another cell.
ROWS = 128
#: Links held before they are folded into components.
HELD = 2_000_000
SEED = 7


# The join by a grid over blocks of rotated coordinates, down to links_in_cell.  link_vectors does without it: it sends a
# vector to too many cells where vectors are spread evenly.  Within one process it stays a second way to the same links.


@cache
def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def blocks_of(d: int) -> list[slice]:
    return [slice(a, min(a + BLOCK, d)) for a in range(0, d, BLOCK)]


def _edges(levels: int, d: int) -> np.ndarray:
    """Inner edges of 2**levels bins that a normal coordinate of variance 1/d fills alike; any edges are right."""
    from statistics import NormalDist

    n = 1 << levels
    return np.array([NormalDist(0, d**-0.5).inv_cdf(i / n) for i in range(1, n)])


def cells(z: np.ndarray, depth: int, radius: float, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For block coordinates ``z``: (row, cell, at home) of the cells a row goes to.

    ``depth`` halvings are dealt out over the coordinates in turn.
    """
    n, width = z.shape
    row, cell, gap, home = np.arange(n), np.zeros(n, np.int64), np.zeros(n), np.ones(n, bool)
    for k in range(width):
        levels = depth // width + (k < depth % width)
        if not levels:
            continue
        edges = _edges(levels, d)
        full = np.concatenate([[-np.inf], edges, [np.inf]])
        own = np.searchsorted(edges, z[:, k], "right")
        lo, hi = np.searchsorted(edges, z[:, k] - radius, "right"), np.searchsorted(edges, z[:, k] + radius, "right")
        times = (hi - lo + 1)[row]
        back = np.repeat(np.arange(len(row)), times)
        inner = np.arange(len(back)) - np.repeat(np.cumsum(times) - times, times)
        r = row[back]
        b = lo[r] + inner
        x = z[r, k]
        away = np.maximum(0, np.maximum(full[b] - x, x - full[b + 1]))
        gap = gap[back] + away * away
        stay = gap <= radius * radius + 1e-9
        row, cell, gap, home = r[stay], (cell[back] * (1 << levels) + b)[stay], gap[stay], (home[back] & (b == own[r]))[stay]
    at = np.empty(n, np.int64)
    at[row[home]] = cell[home]
    before = home | (cell < at[row])
    return row[before], cell[before], home[before]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def links_in_cell(x: np.ndarray, home: np.ndarray, piece: np.ndarray, block: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the linked vectors that meet in this cell and in no earlier block.

    At least one of a pair is at home here.  ``piece``: if two pieces of a cell
    meet here, pairs from one piece are met elsewhere.
    """
    d = x.shape[1]
    u = _unit(x)
    z = u @ rotation(d)
    parts = blocks_of(d)
    budget = [(2 - 2 * cosine) * (p.stop - p.start) / d + 1e-9 for p in parts]
    zb = z[:, parts[block]]
    sq = (zb * zb).sum(1)
    crossing = len(np.unique(piece)) > 1
    found_i, found_j = [], []
    n = len(x)
    for a in range(0, n, 256):
        rows = np.arange(a, min(a + 256, n))
        dist = sq[rows, None] + sq[None, a:] - 2 * zb[rows] @ zb[a:].T
        i, j = np.nonzero(dist <= budget[block] + 1e-9)
        i, j = rows[i], j + a
        ok = (i < j) & (home[i] | home[j])
        if crossing:
            ok &= piece[i] != piece[j]
        i, j = i[ok], j[ok]
        for s in range(0, len(i), 20_000):
            p, q = i[s : s + 20_000], j[s : s + 20_000]
            near = (u[p] * u[q]).sum(1) >= cosine
            p, q = p[near], q[near]
            diff = (z[p] - z[q]) ** 2
            first = diff[:, parts[block]].sum(1) <= budget[block]
            for b in range(block):
                first &= diff[:, parts[b]].sum(1) > budget[b]
            found_i.append(p[first])
            found_j.append(q[first])
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.empty(0, np.int64), np.empty(0, np.int64))


def _roots(n: int, i: np.ndarray, j: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The smallest name reachable from each of n items over the pairs."""
    order = np.argsort(names, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    i, j, best = rank[i], rank[j], np.arange(n)
    while True:
        p, q = best[i], best[j]
        if (p == q).all():
            return names[order][best[rank]]
        np.minimum.at(best, np.maximum(p, q), np.minimum(p, q))
        while (best[best] != best).any():
            best = best[best]


def rounding(d: int) -> float:
    """Bounds what rounding does to a product of two unit vectors in single precision."""
    return (d + 8) * 2.0**-23


class Group:
    """The vectors of one label and length in a piece, by cells, those next to the centre first.

    ``cells`` and ``bounds``: the numbers of the cells and where each begins; ``near``: the product with the own centre.
    """

    def __init__(self, v: np.ndarray, cell: np.ndarray, rep: np.ndarray, times: np.ndarray, centres: np.ndarray | None) -> None:
        u = np.empty(v.shape, np.float32)
        for a in range(0, len(v), 8192):
            u[a : a + 8192] = _unit(v[a : a + 8192].astype(np.float64))
        near = np.zeros(len(v), np.float32) if centres is None else np.einsum("ij,ij->i", u, centres[cell])
        order = np.lexsort((-near, cell))
        self.u, self.v, self.rep, self.times, self.near = u[order], v[order], rep[order], times[order], near[order]
        self.cells, starts = np.unique(cell[order], return_index=True)
        self.bounds = np.append(starts, len(v))
        self.centres = None if centres is None else centres[self.cells]
        # half of the rotated coordinates and the length of the rest, from above: their product is an upper bound
        self.head = self.u
        if centres is not None and 32 <= v.shape[1] <= 1024:
            z = self.u @ rotation(v.shape[1])[:, : v.shape[1] // 2].astype(np.float32)
            rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", z, z)) + rounding(v.shape[1]))
            self.head = np.concatenate([z, rest[:, None].astype(np.float32)], 1)

    def __len__(self) -> int:
        return len(self.rep)

    def ahead(self, other: Group) -> np.ndarray:
        """For each centre of ``other`` how much nearer a vector is to its own, as products."""
        return self.near - other.centres @ self.u.T


class Links:
    """The links between two groups (or within one) as counts and local components."""

    def __init__(self, g: Group, h: Group, cosine: float) -> None:
        self.g, self.h, self.cosine, self.same = g, h, cosine, g is h
        #: where h's vectors stand among the items
        self.base = 0 if self.same else len(g)
        self.rep = g.rep if self.same else np.concatenate([g.rep, h.rep])
        self.n = np.zeros(len(self.rep), np.int64)
        self.error = rounding(g.u.shape[1])
        self.held, self.edges = 0, []

    def _keep(self, i: np.ndarray, j: np.ndarray) -> None:
        self.edges.append((i, j))
        self.held += len(i)
        if self.held > HELD:
            best = self._local()
            i = np.flatnonzero(best != np.arange(len(best)))
            self.edges, self.held = [(i, best[i])], 0

    def _local(self) -> np.ndarray:
        i, j = (np.concatenate(x) for x in zip(*self.edges, strict=True)) if self.edges else (np.empty(0, np.int64),) * 2
        return _roots(len(self.rep), i, j, np.arange(len(self.rep)))

    def all_of(self, a: slice, b: slice) -> None:
        """Each vector of ``a`` in g is linked to each of ``b`` in h."""
        self.n[a] += self.h.times[b].sum()
        i, j = np.arange(a.start, a.stop), np.arange(b.start, b.stop) + self.base
        if self.same and a == b:
            self.n[a] -= self.g.times[a]
        else:
            self.n[j] += self.g.times[a].sum()
        self._keep(np.concatenate([i, np.full(len(j), i[0])]), np.concatenate([np.full(len(i), j[0]), j]))

    def product(self, i: np.ndarray, j: np.ndarray, x: np.ndarray, y: np.ndarray, within: bool = False) -> None:
        """Compares the vectors i of g (rows ``x``) with j of h (rows ``y``); ``within``: only pairs with i < j."""
        s = x @ y.T
        if s.max() < self.cosine - self.error:
            return
        hit = s >= self.cosine - self.error
        if within:
            hit &= i[:, None] < j
        r, c = np.nonzero(hit & (s < self.cosine + self.error))
        for a in range(0, len(r), 8192):
            p, q = r[a : a + 8192], c[a : a + 8192]
            u, w = _unit(self.g.v[i[p]].astype(np.float64)), _unit(self.h.v[j[q]].astype(np.float64))
            hit[p, q] = (u * w).sum(1) >= self.cosine
        found = np.count_nonzero(hit)
        if found > 4 * sum(hit.shape):
            self.n[i] += np.where(hit, self.h.times[j], 0).sum(1)
            np.add.at(self.n, j + self.base, np.where(hit, self.g.times[i][:, None], 0).sum(0))
            rows, none = np.arange(len(i)), len(i)
            while True:
                cols = np.where(hit, rows[:, None], none).min(0)
                less = np.minimum(rows, np.where(hit, cols, none).min(1))
                if (less == rows).all():
                    break
                rows = less
            met = cols < none
            self._keep(np.concatenate([i, j[met] + self.base]), np.concatenate([i[rows], i[cols[met]]]))
        elif found:
            r, c = np.nonzero(hit)
            i, j = i[r], j[c]
            np.add.at(self.n, i, self.h.times[j])
            np.add.at(self.n, j + self.base, self.g.times[i])
            self._keep(i, j + self.base)

    def compare(self, a: slice, b: slice, px: np.ndarray | None = None, py: np.ndarray | None = None, reach: float = 0.0) -> None:
        """Compares a run of g with a run of h.  px, py: how far each vector is from the other side; pairs of more than
        ``reach`` together cannot be links.  One run with itself: each pair once."""
        if a.start >= a.stop or b.start >= b.stop:
            return
        g, h = self.g, self.h
        if px is None:
            for s in range(a.start, a.stop, ROWS):
                i = np.arange(s, min(s + ROWS, a.stop))
                within = self.same and a == b
                for t in range(s if within else b.start, b.stop, 16 * ROWS):
                    j = np.arange(t, min(t + 16 * ROWS, b.stop))
                    self.product(i, j, g.u[i], h.u[j], within and t < i[-1] + 1)
            return
        i, j = np.flatnonzero(px <= reach - py.min()), np.flatnonzero(py <= reach - px.min())
        i, j = i[np.argsort(px[i])], j[np.argsort(py[j])]
        px, py, i, j = px[i], py[j], i + a.start, j + b.start
        y = h.head[j]
        for s in range(0, len(i), ROWS):
            m = np.searchsorted(py, reach - px[s], "right")
            if not m:
                break
            some = i[s : s + ROWS]
            x = g.head[some]
            for t in range(0, m, 4 * ROWS):
                e = min(m, t + 4 * ROWS)
                if (x @ y[t:e].T).max() >= self.cosine - 2 * self.error:
                    self.product(some, j[t:e], g.u[some], h.u[j[t:e]])

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """n and root of each item."""
        g, h = self.g, self.h
        runs = lambda x: [slice(*p) for p in zip(x.bounds[:-1].tolist(), x.bounds[1:].tolist(), strict=True)]
        if g.centres is None:
            self.compare(slice(0, len(g)), slice(0, len(h)))
            return self.n, _named_roots(self._local(), self.rep)
        gx = g.ahead(h)
        hx = gx if self.same else h.ahead(g)
        # the cosines between centres, and by the same error bounds the lengths and angles from above
        between = g.centres @ h.centres.T
        reach = (2 - 2 * self.cosine) ** 0.5 * np.sqrt(np.maximum(0, 2 - 2 * between + 4 * self.error)) + 6 * self.error
        angle = np.arccos(np.clip(between - self.error, -1, 1))
        angle[g.cells[:, None] == h.cells] = 0
        limit = np.arccos(self.cosine + 1e-9)
        own_g, own_h = (np.arccos(np.clip(x.near - self.error, -1, 1)) for x in (g, h))
        least_g = np.minimum.reduceat(gx, g.bounds[:-1], axis=1).T
        least_h = np.minimum.reduceat(hx, h.bounds[:-1], axis=1)
        gr, hr = runs(g), runs(h)
        for k, m in zip(*np.nonzero(least_g + least_h <= reach), strict=True):
            if self.same and m < k:
                continue
            a, b, one = gr[k], hr[m], g.cells[k] == h.cells[m]
            # vectors so near to their centres that all of them are links
            half = (limit - angle[k, m]) / 2
            sure_a = a.start + int(np.searchsorted(own_g[a], half, "right"))
            sure_b = b.start + int(np.searchsorted(own_h[b], half, "right"))
            if sure_a == a.start or sure_b == b.start or half <= 0:
                sure_a, sure_b = a.start, b.start
            sure, others = (slice(a.start, sure_a), slice(b.start, sure_b)), (slice(sure_a, a.stop), slice(sure_b, b.stop))
            if sure_a > a.start:
                self.all_of(*sure)
            if one:
                self.compare(*others)
                self.compare(sure[0], others[1])
                if not (self.same and k == m):
                    self.compare(others[0], sure[1])
                continue
            px, py = gx[m], hx[k]
            for x, y in ((others[0], b), (sure[0], others[1])):
                if x.start < x.stop and y.start < y.stop:
                    self.compare(x, y, px[x], py[y], reach[k, m])
        return self.n, _named_roots(self._local(), self.rep)


def _named_roots(best: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The smallest name of each item's component."""
    least = np.full(len(best), np.iinfo(np.int64).max)
    np.minimum.at(least, best, names)
    return least[best]


def read_piece(path: str, files: tuple[str, ...], centres: dict) -> dict[tuple[str, int], Group]:
    """The groups of the vectors in these files."""
    store, folder = pa.fs.FileSystem.from_uri(path)
    columns = ["label", "d", "cell", "rep", "times", "v"]
    table = pa.concat_tables(pq.read_table(f"{folder}/{f}", columns=columns, filesystem=store, partitioning=None) for f in files).combine_chunks()
    label = table["label"].combine_chunks().dictionary_encode()
    names, label = label.dictionary.to_pylist(), label.indices.to_numpy()
    d, cell, rep, times = (table[c].to_numpy() for c in columns[1:5])
    v = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(d, dtype=np.int64)])
    turn = np.flatnonzero((np.diff(label) != 0) | (np.diff(d) != 0)) + 1
    out = {}
    for a, b in zip([0, *turn.tolist()], [*turn.tolist(), len(d)], strict=True):
        key = names[label[a]], int(d[a])
        out[key] = Group(v[ends[a] : ends[b]].reshape(-1, key[1]), cell[a:b], rep[a:b], times[a:b], centres.get(key))
    return out


def pieces_of(files: list[tuple], rows: int) -> tuple[list[tuple[str, ...]], list[tuple[int, int]]]:
    """Runs of files (name, vectors, first and last group, in the order of the groups) of so many vectors, and the pairs
    of runs that have a group in common."""
    pieces, spans, held = [], [], 0
    for name, n, low, high in sorted(files, key=lambda f: (f[2], f[3], f[0])):
        if pieces and held + n <= rows:
            pieces[-1], spans[-1], held = (*pieces[-1], name), (spans[-1][0], high), held + n
        else:
            pieces.append((name,))
            spans.append((low, high))
            held = n
    at: dict = {}
    for k, span in enumerate(spans):
        for group in {*span}:
            at.setdefault(group, []).append(k)
    # a group that two pieces share is the last one of the former and the first one of the latter
    pairs = {(k, k) for k in range(len(pieces))} | {(p, q) for group in at.values() for i, p in enumerate(group) for q in group[i + 1 :]}
    return pieces, sorted(pairs)


def _nearest(v: np.ndarray, centres: np.ndarray | None) -> np.ndarray:
    return np.zeros(len(v), np.int32) if centres is None else (_unit(v).astype(np.float32) @ centres.T).argmax(1).astype(np.int32)


def into_cells(centres: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds cells; copies within a batch become one row, so that a hot vector stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            labels, keys, d = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_numpy()
            seen: dict = {}
            which = np.array([seen.setdefault(k, len(seen)) for k in zip(labels, keys, strict=True)])
            _, first = np.unique(which, return_index=True)
            rep = np.full(len(seen), np.iinfo(np.int64).max)
            np.minimum.at(rep, which, batch.column(2).to_numpy())
            one = batch.take(pa.array(first))
            ends, flat = np.concatenate([[0], np.cumsum(d[first])]), one.column(4).flatten().to_numpy(zero_copy_only=False)
            cell, by = np.zeros(len(first), np.int32), {}
            for k, at in enumerate(first.tolist()):
                by.setdefault((labels[at], int(d[at])), []).append(k)
            for group, at in by.items():
                if group in centres:
                    v = np.stack([flat[ends[k] : ends[k + 1]] for k in at]).astype(np.float64)
                    cell[at] = _nearest(v, centres[group])
            arrays = [one.column(0), one.column(1), one.column(3), pa.array(cell), pa.array(rep), pa.array(np.bincount(which).astype(np.int64)), one.column(4)]
            yield pa.RecordBatch.from_arrays(arrays, names=["label", "key", "d", "cell", "rep", "times", "v"])

    return run


def link_pieces(path: str, pieces: list[tuple[str, ...]], pairs: list[tuple[int, int]], centres: dict, cosine: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For the numbers of pairs of pieces: rep, n and root of the vectors that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: tuple = (None, {})
        for batch in batches:
            for k in batch.column(0).to_pylist():
                p, q = pairs[k]
                if left[0] != p:
                    left = (p, read_piece(path, pieces[p], centres))
                mine = left[1]
                other = mine if p == q else read_piece(path, pieces[q], centres)
                for group in mine.keys() & other.keys():
                    links = Links(mine[group], other[group], cosine)
                    n, root = links.run()
                    hit = n > 0
                    yield pa.RecordBatch.from_arrays([pa.array(links.rep[hit]), pa.array(n[hit]), pa.array(root[hit])], names=["rep", "n", "root"])
        del left
        release()

    return run


def link_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Linked are vectors of one label whose cosine, in double precision, is
    ``cosine`` at least.  Vectors that are null, zero, or hold null or
    non-finite components, or have no label or no id, link with nothing.
    Vectors of different length never link.  Equal vectors are joined once for
    all; rows that share an id share their links.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2048)
    v = named(vector_col)
    # floats stay floats, at half the size: their products are worked out in double precision all the same
    kind = "array<float>" if vectors.select(v).schema[0].dataType.simpleString() == "array<float>" else "array<double>"
    sound = F.when(
        v.isNotNull() & named(label_col).isNotNull() & named(id_col).isNotNull()
        & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0), v
    )
    rows = vectors.select(named(id_col).alias("vec_id"), named(label_col).cast("string").alias("label"), sound.cast(kind).alias("v"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.to_json(F.struct("v"))))).withColumn("key", F.when(F.col("v").isNotNull(), F.col("key")))
    valid = rows.where("v is not null")

    count, numbers = valid.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    size = 4 * numbers // max(1, count)
    per_cell = max(CELL, -(-4 * numbers // CENTRES_BYTES))
    centres: dict = {}
    if count > per_cell:
        sample = valid.where(F.pmod(F.xxhash64("v", "label"), F.lit(per_cell)) == 0).select("label", "key", "v").dropDuplicates(["label", "key"])
        for r in sample.orderBy("label", "key").collect():
            centres.setdefault((r["label"], len(r["v"])), []).append(r["v"])
        centres = {g: _unit(np.array(c, np.float64)).astype(np.float32) for g, c in centres.items() if len(c) > 1}

    piece = min(max(4 * numbers // 64, PIECE_BYTES[0]), PIECE_BYTES[1])
    shape = f"label string, key binary, d int, cell int, rep long, times long, v {kind}"
    order = ["label", "d", "cell", "key"]
    spread = valid.select("label", "key", F.col("vec_id").cast("long").alias("rep"), F.size("v").alias("d"), "v").mapInArrow(into_cells(centres), shape)
    spread = spread.repartitionByRange(max(1, -(-4 * numbers // piece)), *order)
    reps = spread.groupBy(*order).agg(F.min("rep").alias("rep"), F.sum("times").alias("times"), F.first("v").alias("v")).sortWithinPartitions(*order)
    path = fresh_path(spark, "vectors")
    reps.write.option("parquet.enable.dictionary", "false").parquet(path)
    reps = spark.read.schema(reps.schema).parquet(path)

    group = F.struct("label", "d")
    files = reps.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n"), F.min(group).alias("low"), F.max(group).alias("high")).collect()
    pieces, pairs = pieces_of([(r["f"], r["n"], tuple(r["low"]), tuple(r["high"])) for r in files], max(1, piece // max(1, size)))
    found = spark.range(0, len(pairs), 1, min(max(1, len(pairs)), 10_000)).mapInArrow(link_pieces(path, pieces, pairs, centres, cosine), "rep long, n long, root long")
    found = cut(found, "links")
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comp = components(found.select("rep", "root"), "rep", "root")
    ends = reps.select(F.col("label").alias("rl"), F.col("key").alias("rk"), "rep", "times")
    ends = ends.join(links, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left").where("times > 1 or n > 0")
    ends = ends.select("rl", "rk", (F.col("times") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.drop("v").join(ends, (F.col("label") == F.col("rl")) & (F.col("key") == F.col("rk")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
