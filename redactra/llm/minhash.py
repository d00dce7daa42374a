"""Near-duplicate texts by weighted MinHash.

A text is the multiset of its five-word windows.  A window of multiplicity w
stands for the stretch [0, w) of a Poisson process in the plane; the stretch is
put together from dyadic ranges, [0,1), [1,2), [2,4), ..., whose processes run
at a rate as wide as the range, points of a range not wholly covered being
thinned by their position.  Each point falls to one component of the signature,
which keeps the earliest; points are made in order and only while they can
still matter.  Two texts agree in a component with the probability of their
weighted Jaccard similarity.

Signatures are banded; texts that share a band are verified on the multisets.
To spare all pairs in a group of copies, every text of a bucket is compared
with the bucket's most connected text, which near copies mostly link to.  Since
1 - similarity is a metric, those distances rule out pairs left between
classes, the signatures rule out more, and what remains is verified where it
meets, with no bound on its number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import WordHashes, cut, mixed, named, release, small_batches, windows, with_columns_of, words_of
from .components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
SIZE = BANDS * ROWS
#: Share of equal components below which a pair is taken to be unlike: a pair of similarity 0.8 falls below it
#: about once in 10^6, as it fails to share a band.
LIKELY = 0.62
#: Rows of a bucket that one task compares; larger buckets are dealt out as pairs of pieces.
PIECE = 1024

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingles(text: str, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of five words and how often each occurs; a shorter text is one window."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    found = windows(hashes.of(words), min(WORDS, len(words)))
    return np.unique(found, return_counts=True)


def signature(keys: np.ndarray, weights: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The earliest point of each component, infinite if there are no windows."""
    found = np.full(size, np.inf)
    if not len(keys):
        return found
    parts = [(mixed(keys), weights, 0, 1)]
    low = 1
    while True:  # the ranges [low, 2 low) of heavier windows
        heavy = weights > low
        if not heavy.any():
            break
        parts.append((mixed(keys[heavy] + np.uint64(low * int(_C[0]) & 0xFFFFFFFFFFFFFFFF)), weights[heavy], low, low))
        low *= 2
    key = np.concatenate([p[0] for p in parts])
    weight = np.concatenate([p[1] for p in parts])
    lower = np.concatenate([np.full(len(p[0]), p[2]) for p in parts])
    width = np.concatenate([np.full(len(p[0]), p[3], np.float64) for p in parts])
    at, step = np.zeros(len(key)), 0
    while len(key):
        more = max(1, -(-4 * size // len(key))) if step == 0 else max(1, -(-size // len(key)))
        steps = np.arange(step, step + more, dtype=np.uint64)
        draw = mixed(key[:, None] + (steps * _C[1])[None, :])
        gaps = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        # summed one by one from the start, so that a point is the same number however the steps are blocked
        gone = np.cumsum(np.concatenate([at[:, None], gaps], 1), 1)[:, 1:]
        when = gone / (size * width)[:, None]
        other = mixed(draw ^ _C[2])
        component = (other >> np.uint64(32)) % np.uint64(size)
        position = lower[:, None] + np.floor((other & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * width[:, None])
        inside = position < weight[:, None]
        np.minimum.at(found, component[inside].astype(np.int64), when[inside])
        step += more
        at = gone[:, -1]
        on = when[:, -1] < found.max()
        key, weight, lower, width, at = key[on], weight[on], lower[on], width[on], at[on]
    return found


def short_signature(found: np.ndarray) -> bytes:
    """A byte for each component: equal components have equal bytes, others seldom."""
    return (mixed(found.view(np.uint64)) & np.uint64(255)).astype(np.uint8).tobytes()


def band_keys(found: np.ndarray) -> np.ndarray:
    rows = found.view(np.uint64).reshape(BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * _C[3]
    for k in range(ROWS):
        total = mixed(total ^ rows[:, k])
    return total.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets; 0 if both are empty."""
    _, i, j = np.intersect1d(a[0], b[0], True, True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    whole = int(a[1].sum() + b[1].sum()) - common
    return common / whole if whole else 0.0


def _node(text: Column) -> Column:
    return F.unhex(F.md5(text))


def open_links(distance: np.ndarray, group: np.ndarray, piece: np.ndarray, short: np.ndarray, bands: np.ndarray, key: int, texts: list[str], limit: float, likely: float = LIKELY) -> list[tuple[int, int]]:
    """Links between the classes of a bucket, one for each far text and class at most.

    One of two texts lies farther than ``limit`` from the leader (else both are
    in its class), their distances to it differ by ``limit`` at most, their
    signatures agree in a share of ``likely``, and this is the first bucket they
    share.  Such pairs are verified, the likeliest first, until a class is found.
    """
    hashes, known, out = WordHashes(), {}, []

    def own(k: int):
        if k not in known:
            known[k] = shingles(texts[k], hashes)
        return known[k]

    crossing = len(np.unique(piece)) > 1
    for u in np.flatnonzero(distance > limit).tolist():
        ok = (group != group[u]) & (np.abs(distance - distance[u]) <= limit + 1e-9) & (distance > 0)
        ok &= (distance <= limit) | (np.arange(len(distance)) > u)  # two far ones meet once
        if crossing:
            ok &= piece != piece[u]
        x = np.flatnonzero(ok)
        agree = (short[x] == short[u]).mean(1)
        x, agree = x[agree >= likely], agree[agree >= likely]
        shared = bands[x] == bands[u]
        here = bands[u][shared.argmax(1)] == key if len(x) else np.empty(0, bool)
        done: set[int] = set()
        for k in x[here][np.argsort(-agree[here], kind="stable")].tolist():
            if group[k] not in done and 1.0 - similarity(own(u), own(k)) <= limit + 1e-12:
                done.add(int(group[k]))
                out.append((u, k))
    return out


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, x) with distance = 1 - similarity of their ``texts`` (node, text)."""
    small_batches(pairs.sparkSession)
    left = texts.select(F.col("node").alias("x"), F.col("text").alias("text_x"))
    right = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    rows = pairs.join(left, "x").join(right, "a").select("a", "x", "text_a", "text_x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last = WordHashes(), (None, None)
        for b in batches:
            out = []
            for a, ta, tx in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if last[0] != a:
                    last = (a, shingles(ta, hashes))
                out.append(1.0 - similarity(last[1], shingles(tx, hashes)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["a", "x", "distance"])
        del hashes, last
        release()

    return rows.mapInArrow(run, "a binary, x binary, distance double")


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node (the text's 128-bit digest), bands and short signature of each row; texts without words have no node."""

    def make():
        hashes = WordHashes()

        def work(texts: list[str]) -> list[pa.Array]:
            out, seen = [], {}
            for t in texts:
                if t not in seen:
                    s = shingles(t, hashes)
                    found = signature(*s) if len(s[0]) else None
                    seen[t] = (None, None) if found is None else (band_keys(found), short_signature(found))
                out.append(seen[t])
            return [pa.array([b for b, _ in out], pa.list_(pa.int64())), pa.array([x for _, x in out], pa.binary())]

        return work

    narrow = docs.select(named(id_col).alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text")).withColumn("digest", _node(F.col("text")))
    out = with_columns_of(narrow, "text", [T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("short", T.BinaryType())], make, ["doc_id", "digest"])
    return out.select("doc_id", F.when(F.col("bands").isNotNull(), F.col("digest")).alias("node"), "bands", "short")


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILARITY, likely: float = LIKELY) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, node) and classes (node, class node) of the nodes that are not their class's smallest."""
    signed = cut(signatures(docs, id_col, text_col), "signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(F.first("bands").alias("bands"))
    banded = cut(nodes.select("node", F.explode("bands").alias("key")), "bands")
    # the aggregates are tables, so that both sides of a join are plain shuffles and a hot key's partition can be split
    full = cut(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "full")
    shared = cut(banded.join(full, "key"), "shared")
    # the text that shares most bands with others stands in the middle of its group: it leads its buckets
    degree = cut(shared.groupBy("node").agg(F.sum("n").alias("degree")), "degree")
    ordered = shared.select("key", "node").join(degree, "node")
    leads = cut(ordered.groupBy("key").agg(F.max(F.struct("degree", "node"))["node"].alias("leader")), "leads")
    buckets = cut(shared.select("key", "node").join(leads, "key"), "buckets")
    wanted = buckets.select("node").distinct()
    texts = (
        docs.select(F.coalesce(named(text_col), F.lit("")).alias("text")).withColumn("node", _node(F.col("text")))
        .groupBy("node").agg(F.first("text").alias("text"))
    )
    texts = cut(texts.join(wanted, "node", "left_semi"), "texts")
    stars = buckets.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("x")).distinct()
    near = cut(verify(stars, texts), "verified")
    links = near.where(F.col("distance") <= 1.0 - similar + 1e-12).select("a", "x")
    classes = components(links, "a", "x")
    # buckets whose texts are not all in one class: the pairs that the distances to the leader leave open
    own = classes.select(F.col("node").alias("n"), "component")
    member = (
        buckets.join(near.select(F.col("a").alias("leader"), F.col("x").alias("node"), "distance"), ["leader", "node"], "left")
        .join(own, F.col("node") == F.col("n"), "left")
        .select("key", "node", F.coalesce("distance", F.lit(0.0)).alias("d"), F.coalesce("component", "node").alias("c"))
    )
    member = cut(member, "members")
    split = cut(member.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key"), "split")
    mixed_up = cut(member.join(split, "key"), "open")
    if not mixed_up.isEmpty():
        limit = 1.0 - similar
        sizes = mixed_up.groupBy("key").agg(F.count("*").alias("n")).select(F.col("key").alias("k"), F.ceil(F.col("n") / (PIECE // 2)).cast("int").alias("pieces"))
        sizes = sizes.withColumn("pieces", F.when(F.col("pieces") <= 2, 1).otherwise(F.col("pieces")))
        extra = signed.where("node is not null").groupBy("node").agg(F.first("short").alias("short"), F.first("bands").alias("bands"))
        dealt = mixed_up.join(sizes, F.col("key") == F.col("k")).withColumn("piece", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
        dealt = dealt.join(extra, "node").join(texts, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        dealt = dealt.select("key", F.least("piece", "other").alias("p"), F.greatest("piece", "other").alias("q"), "node", "d", "c", "short", "bands", "text", "piece")

        def compare(key, table):
            nodes = table["node"].to_pylist()
            group = np.unique(np.array([x.hex() for x in table["c"].to_pylist()]), return_inverse=True)[1]
            short = np.frombuffer(b"".join(table["short"].to_pylist()), np.uint8).reshape(-1, SIZE)
            bands = np.array(table["bands"].to_pylist(), np.int64)
            found = open_links(table["d"].to_numpy(), group, table["piece"].to_numpy(), short, bands, key[0].as_py(), table["text"].to_pylist(), limit, likely)
            return pa.table({n: pa.array([nodes[pair[k]] for pair in found], pa.binary()) for k, n in enumerate("ax")})

        second = cut(dealt.groupBy("key", "p", "q").applyInArrow(compare, "a binary, x binary"), "verified")
        if not second.isEmpty():
            stars_now = classes.select(F.col("component").alias("a"), F.col("node").alias("x"))
            classes = components(stars_now.unionByName(second), "a", "x")
    return signed.select("doc_id", "node"), classes


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILARITY, likely: float = LIKELY) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class), kept (it is that document).

    Texts whose multisets of five-word windows have a weighted Jaccard
    similarity of ``similar`` at least are linked; classes are the connected
    components.  ``likely`` = 0 verifies every pair of a bucket that distances
    leave open, whatever its signatures say.  Texts without a word (null, empty, blank) are each a class of
    their own; rows that repeat an id and its text are one document, kept twice.
    """
    rows, classes = text_classes(docs, id_col, text_col, similar, likely)
    of = classes.select(F.col("node").alias("n"), "component")
    placed = cut(rows.join(of, rows["node"] == of["n"], "left").select("doc_id", F.coalesce("component", "node").alias("c")), "placed")
    least = cut(placed.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("class_id")).select(F.col("c").alias("k"), "class_id"), "least")
    out = placed.join(least, placed["c"] == least["k"], "left").select("doc_id", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))
    return out.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILARITY) -> DataFrame:
    """``docs`` without those that are not the first (smallest id) of their class; texts without words all stay.

    Of rows that repeat an id and its text one stays.
    """
    rows, classes = text_classes(docs, id_col, text_col, similar)
    of = classes.select(F.col("node").alias("n"), "component")
    placed = cut(rows.where("node is not null").join(of, F.col("node") == F.col("n"), "left").select("doc_id", "node", F.coalesce("component", "node").alias("c")), "placed")
    first = placed.groupBy("c").agg(F.min(F.struct("doc_id", "node")).alias("f")).select(F.col("f.doc_id").alias("__first_id__"), F.col("f.node").alias("__first_node__"))
    text = F.coalesce(named(text_col), F.lit(""))
    marked = docs.withColumn("__node__", _node(text)).withColumn("__blank__", ~text.rlike(r"[^\x20\x09-\x0D]"))
    chosen = marked.where("not __blank__").join(first, F.col("__node__").eqNullSafe(F.col("__first_node__")) & named(id_col).eqNullSafe(F.col("__first_id__")), "left_semi")
    once = chosen.dropDuplicates(["__node__", id_col])
    return once.unionByName(marked.where("__blank__")).drop("__node__", "__blank__")
