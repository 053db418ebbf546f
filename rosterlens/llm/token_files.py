"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents as one stream, cut into blocks of 1,024. A block keeps
its smallest id and, for each id, the low bits of the difference, at the width that suffices for a
chosen share of them; the high bits of the others stand in an exception list with their places. An
index of block starts and one of documents close the file, so that a reader can go to any document.

    file  = "PFOR1\\0\\0\\0", blocks, index
    block = smallest u32, count u16, width u8, 0 u8, exceptions u32,
            packed u64 words (16 words a bit of width), places u16 each, high bits u32 each
    index = block starts u64 each, doc ids i64 each, doc id is null u8 each, ids of each doc u64,
            blocks u64, docs u64, ids u64
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, scratch_folder
from .common import arrow_long, partitions
from .tokens import library_encoder

BLOCK = 1024
MAGIC = b"PFOR1\0\0\0"
MANIFEST = "path string, part int, n_docs long, n_tokens long, n_bytes long"
_HEAD = struct.Struct("<IHBBI")


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2^width into 16 * width words each: 64 values share `width` words."""
    lanes = np.ascontiguousarray(values.reshape(-1, 64).T.astype(np.uint64))
    words = np.zeros((width, lanes.shape[1]), dtype=np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        words[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).reshape(len(values), 16 * width)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    rows = len(words)
    lanes = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((64, lanes.shape[1]), dtype=np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        v = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            v = v | (lanes[word + 1] << np.uint64(64 - shift))
        out[i] = v & mask
    return np.ascontiguousarray(out.T).reshape(rows, BLOCK)


def encode_blocks(ids: np.ndarray, share: float = 0.9) -> list[bytes]:
    """Blocks of `ids` (unsigned 32-bit), the last one perhaps shorter. `share` of a block's ids fit its width."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return []
    full = np.empty(n * BLOCK, dtype=np.uint32)
    full[:len(ids)] = ids
    full[len(ids):] = ids[-1]  # the padding of the last block costs nothing and is cut when read
    full = full.reshape(n, BLOCK)
    low = full.min(axis=1)
    rest = full - low[:, None]
    at = min(BLOCK - 1, int(np.ceil(share * BLOCK)) - 1)
    chosen = np.partition(rest, at, axis=1)[:, at]
    widths = np.array([max(1, int(c).bit_length()) for c in chosen.tolist()])
    out: list[bytes] = [b""] * n
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        values = rest[rows]
        over = values >> np.uint32(width) if width < 32 else np.zeros_like(values)
        packed = _pack(values & np.uint32((1 << width) - 1), width)
        where, places = np.nonzero(over)
        bounds = np.searchsorted(where, np.arange(len(rows) + 1)).tolist()
        places, high = places.astype("<u2"), over[over > 0].astype("<u4")
        for k, row in enumerate(rows.tolist()):
            a, b = bounds[k], bounds[k + 1]
            count = min(BLOCK, len(ids) - row * BLOCK)
            out[row] = _HEAD.pack(int(low[row]), count, width, 0, b - a) + packed[k].tobytes() + places[a:b].tobytes() + high[a:b].tobytes()
    return out


def decode_blocks(data, starts: list[int]) -> np.ndarray:
    """The ids of the blocks at `starts` in `data`, one after another."""
    heads = [_HEAD.unpack_from(data, s) for s in starts]
    out = np.empty((len(starts), BLOCK), dtype=np.uint32)
    by_width: dict[int, list[int]] = {}
    for k, head in enumerate(heads):
        by_width.setdefault(head[2], []).append(k)
    for width, rows in by_width.items():
        packed = np.concatenate([np.frombuffer(data, "<u8", 16 * width, starts[k] + _HEAD.size) for k in rows]).reshape(len(rows), 16 * width)
        values = _unpack(packed, width)
        for row, k in enumerate(rows):
            low, _, _, _, exceptions = heads[k]
            if exceptions:
                at = starts[k] + _HEAD.size + 128 * width
                places = np.frombuffer(data, "<u2", exceptions, at)
                high = np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions)
                values[row, places] |= high << np.uint32(width)
            out[k] = values[row] + np.uint32(low)
    counts = np.array([h[1] for h in heads])
    return out.ravel() if (counts == BLOCK).all() else np.concatenate([out[k, :c] for k, c in enumerate(counts.tolist())])


class Writer:
    """Writes one file document by document; memory is bounded by `buffered` ids and the indexes."""

    def __init__(self, stream, share: float = 0.9, buffered: int = 256 * BLOCK):
        self.stream, self.share, self.buffered = stream, share, buffered
        self.pending, self.n_pending, self.n_tokens = [], 0, 0
        self.doc_ids, self.lengths, self.starts = [], [], []
        self.size = stream.write(MAGIC) and len(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.n_tokens += len(ids) // 4
        self.pending.append(ids)
        self.n_pending += len(ids) // 4
        if self.n_pending >= self.buffered:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        cut = len(ids) if all_of_it else len(ids) // BLOCK * BLOCK
        for block in encode_blocks(ids[:cut], self.share):
            self.starts.append(self.size)
            self.stream.write(block)
            self.size += len(block)
        self.pending, self.n_pending = [ids[cut:].tobytes()], len(ids) - cut

    def close(self) -> int:
        self._flush(True)
        nulls = np.array([d is None for d in self.doc_ids], dtype=np.uint8)
        tail = b"".join([np.array(self.starts, "<u8").tobytes(), np.array([d or 0 for d in self.doc_ids], "<i8").tobytes(), nulls.tobytes(),
                         np.array(self.lengths, "<u8").tobytes(), struct.pack("<QQQ", len(self.starts), len(self.doc_ids), self.n_tokens)])
        self.stream.write(tail)
        self.stream.close()
        return self.size + len(tail)


class Reader:
    """Reads a file's documents in order, or one document, a bounded run of blocks at a time."""

    def __init__(self, data):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token file")
        self.data = data
        blocks, docs, self.n_tokens = struct.unpack_from("<QQQ", data, len(data) - 24)
        at = len(data) - 24 - 8 * docs
        self.lengths = np.frombuffer(data, "<u8", docs, at).astype(np.int64)
        self.nulls = np.frombuffer(data, np.uint8, docs, at - docs) > 0
        self.doc_ids = np.frombuffer(data, "<i8", docs, at - 9 * docs)
        self.block_starts = np.frombuffer(data, "<u8", blocks, at - 9 * docs - 8 * blocks).astype(np.int64).tolist()
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids `start` to `start + n` of the file, from the blocks that hold them alone."""
        if not n:
            return np.zeros(0, np.uint32)
        a, b = start // BLOCK, (start + n - 1) // BLOCK + 1
        return decode_blocks(self.data, self.block_starts[a:b])[start - a * BLOCK:start - a * BLOCK + n]

    def documents(self, most: int = 512 * BLOCK) -> Iterator[tuple[int, np.ndarray]]:
        """(place, ids) of every document in order."""
        d, n = 0, len(self.lengths)
        while d < n:
            e = max(d + 1, int(np.searchsorted(self.starts, self.starts[d] + most, "right")) - 1)
            base = int(self.starts[d])
            ids = self.ids(base, int(self.starts[e]) - base)
            for k in range(d, e):
                yield k, ids[int(self.starts[k]) - base:int(self.starts[k + 1]) - base]
            d = e


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, share: float = 0.9, files: int | None = None) -> DataFrame:
    """Encodes every text, appends `end_id` and writes the ids in ascending doc_id order; returns the manifest.

    One file for each range of doc_id, in `folder` (by default a new one in spark.checkpoint.dir),
    under a name of its own for each attempt: only the manifest, which is kept in the checkpoint
    folder, says which files count, so a lost or repeated task leaves no half-written or double
    data. Null texts are empty, null ids come first, equal ids stand in the order of their texts; other
    columns are ignored; an empty table gives files without documents or none.
    """
    spark = docs.sparkSession
    folder = folder or scratch_folder(spark, "tokens")
    n = files or partitions(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = library_encoder(tokenizer, keeps_space=False)
        end = struct.pack("<I", end_id)
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        path = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.pfor"
        writer = Writer(system.open_output_stream(path), share)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                writer.add(doc_id, ids + end)
        size = writer.close()
        yield pa.RecordBatch.from_pylist([{"path": f"{folder.rstrip('/')}/{path.rsplit('/', 1)[1]}", "part": part, "n_docs": len(writer.lengths), "n_tokens": writer.n_tokens, "n_bytes": size}],
                                         pa.schema([("path", pa.string()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return checkpointed(ordered.mapInArrow(run, MANIFEST))


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """The documents of the manifest's files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and,
    if asked for, the ids as an array. A file is read by one task, a bounded run of blocks at a time."""
    spark = manifest.sparkSession
    totals = sorted((r["part"], r["n_tokens"]) for r in manifest.select("part", "n_tokens").collect())  # one pair a file
    before, at = {}, 0
    for part, n in totals:
        before[part], at = at, at + n
    shared = spark.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = _file_system(row["path"])
                with system.open_input_file(path) as file:
                    reader = Reader(file.read_buffer())
                crc, ids, done = [], [], 0

                def out(upto: int):
                    columns = [arrow_long(reader.doc_ids[done:upto], reader.nulls[done:upto]), arrow_long(reader.starts[done:upto] + shared.value[row["part"]]),
                               arrow_long(reader.lengths[done:upto]), arrow_long(crc)]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    return pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int64()))] * with_ids, names=names + ["ids"] * with_ids)

                for k, values in reader.documents():
                    crc.append(zlib.crc32(values.astype("<u4").tobytes()))
                    if with_ids:
                        ids.append(values.astype(np.int64))
                    if len(crc) == 4096:
                        yield out(k + 1)
                        crc, ids, done = [], [], k + 1
                if crc:
                    yield out(done + len(crc))

    return manifest.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
