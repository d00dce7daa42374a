"""Token ids in files of independent zstandard frames.

A shard is: frames, each with the ids of whole documents (or a stretch of a
long one); a skippable frame with the index of documents; a skippable frame
with the seek table (sizes and a checksum of each frame's content), as in the
public seekable format.  A plain zstandard reader gets all ids; ours opens the
tail and decompresses only the frames that hold the documents asked for.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, fresh_path, named, small_batches
from .tokenization import encoder

SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Ids in a frame: what a reader must decompress for one document.
FRAME_IDS = 1 << 17
#: Bytes of input (as the planner estimates them, files as they are stored) that a shard should hold.
SHARD_BYTES = 256 << 20
LEVEL = 1


class ShardWriter:
    """Writes one shard; memory holds one frame and the index (13 bytes a document)."""

    def __init__(self, out, dtype: str = "<u2", frame_ids: int = FRAME_IDS) -> None:
        self.out, self.dtype, self.frame_ids = out, np.dtype(dtype), frame_ids
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int, int]] = []
        self.buffer, self.held = [], 0
        self.keys, self.null, self.sizes = array("q"), bytearray(), array("I")
        self.limit = np.iinfo(self.dtype).max

    def _flush(self) -> None:
        data = b"".join(self.buffer)
        if data:
            packed = self.pack.compress(data)
            self.out.write(packed)
            self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.buffer, self.held = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) > self.limit:
            raise ValueError(f"id {int(ids.max())} does not fit {self.dtype}")
        self.keys.append(0 if doc_id is None else doc_id)
        self.null.append(doc_id is None)
        self.sizes.append(len(ids))
        data = ids.astype(self.dtype)
        while len(data):
            part = data[: self.frame_ids - self.held]
            self.buffer.append(part.tobytes())
            self.held += len(part)
            data = data[len(part) :]
            if self.held >= self.frame_ids:
                self._flush()

    def close(self) -> None:
        self._flush()
        keys, sizes = np.array(self.keys, "<i8"), np.array(self.sizes, "<u4")
        index = self.pack.compress(struct.pack("<QB", len(keys), self.dtype.itemsize) + keys.tobytes() + bytes(self.null) + sizes.tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index) + 4) + index + struct.pack("<I", len(index) + 4))
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), 0x80, SEEK_END))


class ShardReader:
    """Reads a shard from a seekable file; every frame read is held against its checksum."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.seek(0, 2)
        file.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_END or flags != 0x80:
            raise ValueError("no seek table at the end of the shard")
        head = size - 9 - 12 * count - 8
        file.seek(head)
        if struct.unpack("<II", file.read(8)) != (SKIPPABLE_SEEK, 12 * count + 9):
            raise ValueError("damaged seek table")
        self.frames = np.frombuffer(file.read(12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        file.seek(head - 4)
        length = struct.unpack("<I", file.read(4))[0]
        file.seek(head - length - 8)
        if struct.unpack("<II", file.read(8)) != (SKIPPABLE_INDEX, length):
            raise ValueError("damaged document index")
        raw = zstandard.ZstdDecompressor().decompress(file.read(length - 4))
        n, width = struct.unpack_from("<QB", raw)
        self.dtype = np.dtype(f"<u{width}")
        keys = np.frombuffer(raw, "<i8", n, 9)
        null = np.frombuffer(raw, np.uint8, n, 9 + 8 * n)
        self.doc_ids = [None if z else k for k, z in zip(keys.tolist(), null.tolist(), strict=True)]
        self.sizes = np.frombuffer(raw, "<u4", n, 9 + 9 * n).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        self.firsts = np.concatenate([[0], np.cumsum(self.frames[:, 1] // width)])
        self.open_frame = (-1, np.empty(0, self.dtype))
        self.frames_read = 0

    def _frame(self, k: int) -> np.ndarray:
        if self.open_frame[0] != k:
            self.file.seek(int(self.places[k]))
            data = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.frames[k, 0])), max_output_size=int(self.frames[k, 1]))
            if len(data) != self.frames[k, 1] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k} fails its checksum")
            self.open_frame = (k, np.frombuffer(data, self.dtype))
            self.frames_read += 1
        return self.open_frame[1]

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the shard; reads only its frames."""
        at, end, parts = int(self.starts[k]), int(self.starts[k + 1]), []
        while at < end:
            f = int(np.searchsorted(self.firsts, at, "right")) - 1
            upto = min(end, int(self.firsts[f + 1]))
            parts.append(self._frame(f)[at - int(self.firsts[f]) : upto - int(self.firsts[f])])
            at = upto
        return np.concatenate(parts).astype(np.uint32) if parts else np.empty(0, np.uint32)

    def of(self, doc_ids: Iterable[int | None]) -> Iterator[tuple[int | None, np.ndarray]]:
        wanted = set(doc_ids)
        return ((d, self.document(k)) for k, d in enumerate(self.doc_ids) if d in wanted)


def _files(path: str):
    """File system and path, for local folders as for any store Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_shards(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, spaced: bool = True, dtype: str | None = None, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, special: bool = False
) -> DataFrame:
    """Writes ids of all documents in ascending id order; returns the manifest: shard, path, n_docs, n_tokens.

    Documents are dealt out by ranges of ids (a repeated id: by its text's hash
    next), sorted within, and each range is a shard, streamed.  A shard is
    written under a name of the attempt and renamed when whole, so a task that
    runs again replaces the same content.  ``folder`` must be shared by all
    executors.  Null ids come first; null texts count as empty.  ``dtype``: two
    bytes an id if the vocabulary allows it, else four.  ``shards``: as many as
    there are shuffle partitions, or more, so that each holds SHARD_BYTES of
    input at most.  ``special``: control strings in a text become control ids.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(1_000_000, -(-size // SHARD_BYTES)))
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text")).withColumn("__tie__", F.xxhash64("text"))
    dealt = rows.repartitionByRange(shards, "doc_id", "__tie__").sortWithinPartitions("doc_id", "__tie__").select("doc_id", "text")
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, spaced, special)
        encode, width = own.encode, dtype or ("<u2" if own.size <= 1 << 16 else "<u4")
        files, root = _files(folder)
        context, writer, n_docs, n_tokens = TaskContext.get(), None, 0, 0
        shard = context.partitionId()
        path, trial = f"{root}/shard-{shard:06d}.zst", f"{root}/.shard-{shard:06d}.{context.taskAttemptId()}"
        out = None
        for batch in batches:
            if writer is None and batch.num_rows:
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(trial)
                writer = ShardWriter(out, width)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([np.frombuffer(encode(text), "<u4"), end])
                writer.add(doc_id, ids)
                n_docs += 1
                n_tokens += len(ids)
        if writer is not None:
            writer.close()
            out.close()
            files.move(trial, path)
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((shard, pa.int32()), (f"{folder}/shard-{shard:06d}.zst", pa.string()), (n_docs, pa.int64()), (n_tokens, pa.int64()))], names=["shard", "path", "n_docs", "n_tokens"])

    return cut(dealt.mapInArrow(run, "shard int, path string, n_docs long, n_tokens long"), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The shards' totals are summed up over the manifest, one row for each shard.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                files, own = _files(path)
                with files.open_input_file(own) as file:
                    reader = ShardReader(file)
                    for a in range(0, len(reader.sizes), 8192):
                        z = slice(a, a + 8192)
                        crc = [zlib.crc32(reader.document(k).astype("<u4").tobytes()) for k in range(a, min(a + 8192, len(reader.sizes)))]
                        columns = [reader.doc_ids[z], reader.starts[:-1][z] + base, reader.sizes[z], crc]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.repartition(parts).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Writes shards to a fresh shared folder and reads them back."""
    return read_shards(write_shards(docs, fresh_path(docs.sparkSession, "shards"), vocabulary, **options))
