"""Quality classifier: hashed word n-gram logistic regression, trained online.

Features are word unigrams and bigrams of two streams, the words themselves and
their shapes (runs of capitals, small letters, digits and each other mark), and
whether a word repeats the one before, hashed into ``2**BITS`` slots.  A
stream's features share a weight of one.  Training follows the regularised
leader coordinate by coordinate over a bounded sample; scoring is a sparse dot
product, row by row.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import CACHE_WORDS, mixed, named, release, small_batches, with_columns_of, words_of

BITS = 18
#: Bound of the training sample, in documents: those of smallest id hash.
MAX_TRAIN = 8_000
PASSES = 4
ALPHA, BETA, L1, L2 = 0.5, 0.02, 1e-4, 1e-4

_RUNS = [(re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "0")]


def shape_of(word: bytes) -> str:
    """``Tion,***`` → ``Aa,***``: letters and digits as classes, one for a run; marks stay, three at most."""
    s = word.decode("utf-8", "replace")
    for pattern, sign in _RUNS:
        s = pattern.sub(sign, s)
    return re.sub(r"(.)\1{3,}", r"\1\1\1", s)[:24]


class _Streams(dict):
    """Word → the hashes of the word and of its shape, as 16 bytes."""

    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        value = struct.pack("<QQ", xxhash.xxh64_intdigest(word.lower()), xxhash.xxh64_intdigest(shape_of(word), 7))
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value


_PAIR = np.uint64(0x9E3779B97F4A7C15)


def features(text: str, streams: _Streams) -> list[np.ndarray]:
    """Slots of each stream: words, word pairs, shapes, shape pairs, repeats."""
    words = words_of(text)
    if not words:
        return []
    pairs = np.frombuffer(b"".join(map(streams.__getitem__, words)), "<u8").reshape(-1, 2)
    word, shape = pairs[:, 0], pairs[:, 1]
    salt = lambda k: np.uint64(0xA24BAED4963EE407 * k & 0xFFFFFFFFFFFFFFFF)
    found = [word + salt(1), shape + salt(3)]
    if len(words) > 1:
        found += [word[:-1] * _PAIR + word[1:] + salt(2), shape[:-1] * _PAIR + shape[1:] + salt(4), (word[:-1] == word[1:]).astype(np.uint64) + salt(5)]
    return [(mixed(x) & np.uint64((1 << BITS) - 1)).astype(np.int64) for x in found]


def dot(weights: np.ndarray, found: list[np.ndarray]) -> float:
    return float(weights[-1] + sum(weights[x].mean() for x in found))


def sigmoid(z: float) -> float:
    return 1.0 / (1.0 + np.exp(-min(max(z, -35.0), 35.0)))


def sparse(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of a text, the bias among them, and their weights."""
    slots = np.concatenate([*found, [1 << BITS]]).astype(np.int64)
    share = np.concatenate([*(np.full(len(x), 1.0 / len(x)) for x in found), [1.0]])
    own, back = np.unique(slots, return_inverse=True)
    return own.astype(np.int32), np.bincount(back, share)


def fit_leader(samples: Iterable[tuple[list[np.ndarray], int]]) -> np.ndarray:
    """Weights (the last is the bias) by follow-the-regularised-leader updates, in the order given."""
    size = (1 << BITS) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    ready = [(*sparse(found), label) for found, label in samples]
    for _ in range(PASSES):
        for own, x, label in ready:
            zi, ni = z[own], n[own]
            wi = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            g = (sigmoid(float(wi @ x)) - label) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[own], n[own] = zi + g - sigma * wi, ni + g * g
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w.astype(np.float32)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(named(id_col).cast("string"), F.lit(""))) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> np.ndarray:
    """Weights from at most ``max_train`` labelled rows that are not held out.

    The sample is that of the labels with the smallest id hashes, so it is the
    same at each run; one task fits it, whose size the bound fixes.  Labels that
    are null or without a document are passed over; without any, all weights
    are 0 and every score is one half.
    """
    small_batches(docs.sparkSession)
    picked = (
        labels.select(named(id_col).alias("__id__"), named(label_col).cast("int").alias("__label__"))
        .where(F.col("__label__").isin(0, 1) & F.col("__id__").isNotNull() & ~held_out("__id__"))
        .orderBy(F.xxhash64("__id__"), "__id__", "__label__")
        .limit(max_train)
    )
    rows = docs.select(named(id_col).alias("__id__"), F.coalesce(named(text_col), F.lit("")).alias("__text__")).join(F.broadcast(picked), "__id__")
    one = rows.select("__label__", "__text__", F.xxhash64("__id__").alias("__at__"), F.xxhash64("__text__").alias("__then__")).repartition(1).sortWithinPartitions("__at__", "__then__")

    def train(batches):
        # one text at a time becomes its sparse row; nothing else of the sample is held
        streams = _Streams()
        weights = fit_leader((features(t, streams), y) for b in batches for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        del streams
        release()
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["weights"])

    found = one.mapInArrow(train, "weights binary").collect()
    return np.frombuffer(found[0][0], np.float32).copy() if found else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``name``: the probability, 0 to 1, that a text is good.

    Empty and null texts score by the bias alone.  The weights (1 MB, whatever
    the corpus) are broadcast.  Row by row, so repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        streams, w = _Streams(), shared.value

        def work(texts: list[str]) -> list[pa.Array]:
            return [pa.array([sigmoid(dot(w, features(t, streams))) for t in texts], pa.float64())]

        return work

    return with_columns_of(docs, text_col, [T.StructField(name, T.DoubleType())], make, keep)
