"""Best-fit packing of token sequences into sequences of a fixed capacity, by hierarchical residual packing.

Every partition packs its own items best-fit and hands on only what is nearly full; its underfull
bins travel as single items to fewer, merged partitions, which pack them best-fit again, until a
round no longer closes a useful share of them. No task ever holds more bins than `per_task`.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import arrow_long
from .tokens import library_encoder

END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = END_ID, sparing: bool = False) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32.

    A document's ids are its text's, then `end_id`. Documents of up to `capacity` ids are one piece;
    longer ones are cut into pieces of `capacity`, of which only the first may be shorter. A null or
    empty text is one piece of the end id alone; repeated rows are separate documents, a null doc_id
    stays null, further columns are ignored, an empty table gives no rows. `sparing` takes the texts in
    smaller slices and frees the words a worker keeps at each task's end, for less memory and more time.
    """
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer, keeps_space=True)
        try:
            yield from pieces(encoder, batches)
        finally:
            if sparing:
                encoder.forget()

    def pieces(encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            piece, start, length, crc = [], [], [], []
            for row, ids in enumerate(encoder.encode(batch.column(1), 2_000_000 if sparing else 8_000_000)):
                ids += end
                n = len(ids) // 4
                lead = n % capacity or min(n, capacity)
                for k, at in enumerate([0, *range(lead, n, capacity)]):
                    to = lead if k == 0 else at + capacity
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(ids[4 * at:4 * to]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), arrow_long(start), arrow_long(length), arrow_long(crc)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin, and each bin's fill. Largest items first, ties in given order.

    Open bins stand by free space; a bit set of the spaces in use finds the smallest that fits.
    """
    order = np.argsort(-sizes, kind="stable")
    bin_of = np.zeros(len(sizes), dtype=np.int64)
    fills: list[int] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fitting = spaces >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                spaces &= ~(1 << space)
            fills[b] += size
        else:
            b, space = len(fills), capacity
            fills.append(size)
        bin_of[i] = b
        left = space - size
        if left:
            by_space[left].append(b)
            spaces |= 1 << left
    return bin_of, np.array(fills, dtype=np.int64)


def _packer(length: str, capacity: int, nearly_full: int, per_task: int, last: bool, round_no: int):
    """Packs bins (fill, members: list of items) of a partition; closed bins get their number, the others none."""

    def merged(fills: np.ndarray, members: pa.ListArray) -> tuple[np.ndarray, pa.ListArray]:
        bin_of, new_fills = best_fit(fills, capacity)
        order = np.argsort(bin_of, kind="stable")  # old bins by new bin
        members = members.take(pa.array(order))
        sizes = np.diff(np.asarray(members.offsets))
        counts = np.bincount(bin_of[order], weights=sizes, minlength=len(new_fills)).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        # of the type that came, or it couldn't be joined to the next batch
        return new_fills, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), members.flatten(), type=members.type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = (round_no << 56) + (TaskContext.get().partitionId() << 32)
        fills, members = np.zeros(0, np.int64), None

        def out(keep: np.ndarray, closed: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number
            at = np.flatnonzero(keep)
            for a in range(0, len(at), 4096):
                part = at[a:a + 4096]
                ids = np.arange(number, number + len(part))
                number += len(part)
                taken = members.take(pa.array(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64(), mask=np.full(len(part), not closed)), arrow_long(fills[part]), taken, places(taken)],
                    names=["sequence_id", "fill", "members", "offsets"])

        def places(taken: pa.ListArray) -> pa.ListArray:
            lengths = taken.flatten().field(length).to_numpy(zero_copy_only=False).astype(np.int64)
            bounds = np.asarray(taken.offsets)
            before = np.concatenate([[0], np.cumsum(lengths)])
            within = before[:-1] - np.repeat(before[bounds[:-1]], np.diff(bounds))
            return pa.ListArray.from_arrays(taken.offsets, arrow_long(within))

        for batch in batches:
            if not batch.num_rows:
                continue
            fills = np.concatenate([fills, batch.column(0).to_numpy(zero_copy_only=False)])
            members = batch.column(1) if members is None else pa.concat_arrays([members, batch.column(1)])
            if len(fills) >= per_task:  # close what is nearly full, go on with the rest as items
                fills, members = merged(fills, members)
                yield from out(fills >= nearly_full, True)
                rest = np.flatnonzero(fills < nearly_full)
                fills, members = fills[rest], members.take(pa.array(rest))
                if len(fills) > per_task // 2:  # what cannot be paired here leaves; later rounds mix it anew
                    yield from out(np.ones(len(fills), bool), last)
                    fills, members = np.zeros(0, np.int64), None
        if members is not None and len(fills):
            fills, members = merged(fills, members)
            done = np.ones(len(fills), bool) if last else fills >= nearly_full
            yield from out(done, True)
            yield from out(~done, False)

    return run


def pack_best_fit(items: DataFrame, length: str = "length", capacity: int = 2048, nearly_full: float = 0.995,
                  per_task: int = 16_384, fan_in: int = 8, least_gain: float = 0.002) -> DataFrame:
    """The items with `sequence_id` and `offset`: gapless sequences of at most `capacity`.

    Items must be 1 to `capacity` long; longer, shorter or null lengths raise. Ties go in row order;
    repeated rows are separate items; an empty table gives no rows. Each round packs best-fit within
    partitions and closes bins filled to `nearly_full` of the capacity. The rest move, as items, to a
    `fan_in`-th of the partitions, but never to fewer than hold `per_task` bins each. When one task
    holds all of them, or a round closes or saves under `least_gain` of them, the bins stand as they are.
    """
    kept = [c for c in items.columns if c not in ("sequence_id", "offset")]
    wrong = F.col(length).isNull() | ~F.col(length).between(1, capacity)
    first = items.select(
        F.when(wrong, F.raise_error(F.lit(f"lengths must be 1 to {capacity}"))).otherwise(F.col(length).cast("long")).alias("fill"),
        F.array(F.struct(*kept)).alias("members"))
    member_type = first.schema["members"].dataType.simpleString()
    schema = f"sequence_id long, fill long, members {member_type}, offsets array<long>"
    limit = int(capacity * nearly_full)
    width, closed, before, round_no, todo, last = None, [], None, 0, first, False
    while True:
        packed = checkpointed(todo.mapInArrow(_packer(length, capacity, limit, per_task, last, round_no), schema))
        closed.append(packed.where("sequence_id is not null"))
        left = packed.where("sequence_id is null").select("fill", "members")
        if last:
            break
        n = left.count()
        if n == 0:
            break
        width = max(1, -(-n // per_task), (width or packed.rdd.getNumPartitions()) // fan_in)
        # the last round closes everything: one task holds the rest, or mixing them no longer helps
        last = width == 1 or (before is not None and n > (1 - least_gain) * before and width <= -(-n // per_task))
        before, round_no = n, round_no + 1
        todo = left.repartition(width, F.xxhash64(F.lit(round_no), *(F.col("members")[0][c] for c in kept)))
    whole = closed[0]
    for c in closed[1:]:
        whole = whole.unionByName(c)
    return whole.select("sequence_id", F.explode(F.arrays_zip("members", "offsets")).alias("m")).select(
        *(F.col("m.members")[c].alias(c) for c in kept), "sequence_id", F.col("m.offsets").alias("offset"))
