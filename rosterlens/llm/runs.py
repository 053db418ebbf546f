"""Periodic runs of words by maximal pairs, from an LCP-interval tree with left-word class lists.

A run of period q and length L is a pair of places (s, s + q) whose suffixes agree on exactly L - q words
and whose left words differ: a maximal pair of length l = L - q at distance q <= l. So the suffixes are
sorted, their LCP intervals visited bottom up, and every interval keeps one list of its places in order,
each with the class of its left word. Where two children of an interval of length l meet, each place of
the smaller list is held against its nearest places in the larger one. Nearer than l, places of one
interval form an arithmetic progression in which all but the first have one left class, so the nearest
one decides; pairs of unlike classes within l are runs as they stand, with no extension. A run is met at
multiples of its period too; the least period of a start and end is kept.

Suffix order and LCP are found for many texts side by side, by doubling; only places whose next words
repeat in their text take part.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from heapq import merge

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import arrow_long, text_slices, words_of

#: Text searched at once, for bounded memory.
SLICE_BYTES = 2_000_000


def _repeated(codes: np.ndarray, room: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Whether a place's next `width` words stand elsewhere in its text too (hash collisions only add places)."""
    key = codes.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        window = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(min(width, len(key))):
            window[:len(key) - k] = (window[:len(key) - k] ^ key[k:]) * np.uint64(0xD6E8FEB86659FD93)
            window ^= window >> np.uint64(29)
    inside = np.flatnonzero(room >= width)
    out = np.zeros(len(codes), bool)
    _, group, size = np.unique(window[inside], return_inverse=True, return_counts=True)
    out[inside] = size[group] > 1
    return out


def _doubled(first: np.ndarray, room: np.ndarray, active: np.ndarray) -> list[np.ndarray]:
    """rank[k][i]: the place of the 2^k words from i among all such in order; 0 past a text's end. Ends when no
    two of the `active` places agree on 2^k words."""
    n = len(first)
    ranks = [np.concatenate([first, [0]])]
    while True:
        step = 1 << len(ranks) - 1
        head = ranks[-1]
        ahead = np.minimum(np.arange(n) + step, n)
        key = head[:n].astype(np.int64) << 32 | np.where(room > step, head[ahead], 0)
        _, rank = np.unique(key, return_inverse=True)
        ranks.append(np.concatenate([rank.astype(np.int64) + 1, [0]]))
        of = np.sort(ranks[-1][active])
        if not (of[1:] == of[:-1]).any():
            return ranks


def _order_and_lcp(ranks: list[np.ndarray], room: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The active places in suffix order, and the words each agrees on with the one before it."""
    order = active[np.argsort(ranks[-1][active], kind="stable")]
    a, b, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(max(len(order) - 1, 0), np.int64)
    left = np.minimum(room[a], room[b])
    n = len(room)
    for k in range(len(ranks) - 2, -1, -1):
        same = (left >= 1 << k) & (ranks[k][np.minimum(a, n)] == ranks[k][np.minimum(b, n)])
        lcp[same] += 1 << k
        left[same] -= 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return order, np.concatenate([[0], lcp])


def _joined(one: list[int], two: list[int], length: int, least: int, left: list[int], found: dict) -> list[int]:
    """The places of two children of an interval of `length` words; new runs go to `found`."""
    if len(one) < len(two):
        one, two = two, one
    for p in two:
        k = bisect_left(one, p)
        for i, j in ((p, one[k]) if k < len(one) else (0, 0), (one[k - 1], p) if k else (0, 0)):
            q = j - i
            if 0 < q <= length and q + length >= least and left[i] != left[j]:
                span = i, j + length
                if found.get(span, q) >= q:
                    found[span] = q
    if len(two) * 8 > len(one):
        return list(merge(one, two))
    for p in two:
        one.insert(bisect_left(one, p), p)
    return one


def _pairs(order: list[int], lcp: list[int], shallowest: int, least: int, left: list[int], found: dict) -> None:
    """Bottom-up visit of the LCP intervals of at least `shallowest` words; `found` gets start, end -> least period."""
    stack: list[tuple[int, list[int]]] = []
    places: list[int] = []
    for place, length in zip(order, lcp, strict=True):
        while stack and stack[-1][0] > length:
            depth, others = stack.pop()
            places = _joined(others, places, depth, least, left, found)
        if length < shallowest:
            stack.clear()
        elif stack and stack[-1][0] == length:
            stack[-1] = length, _joined(stack[-1][1], places, length, least, left, found)
        else:
            stack.append((length, places))
        places = [place]
    while stack:
        depth, others = stack.pop()
        places = _joined(others, places, depth, least, left, found)


def runs_of(codes: np.ndarray, bounds: np.ndarray, shortest: int = 12) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of the texts codes[bounds[i]:bounds[i + 1]], in order of start, period.

    A run has `shortest` words at least and two periods at least; starts and ends count from the first text's start.
    """
    n = len(codes)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    room = bounds[1:][text] - np.arange(n)
    shallowest = -(-shortest // 2)
    active = _repeated(codes, room, text, shallowest) if n else np.zeros(0, bool)
    if not active.any():
        return []
    some = np.zeros(len(bounds) - 1, bool)
    some[text[active]] = True
    inside = some[text]
    at = np.flatnonzero(inside)  # only texts that repeat something are sorted
    text, room, codes, active = text[at], room[at], codes[at], np.flatnonzero(active[at])
    _, first = np.unique(text.astype(np.int64) << 32 | codes.astype(np.int64), return_inverse=True)
    order, lcp = _order_and_lcp(_doubled(first.astype(np.int64) + 1, room, active), room, active)
    start = np.concatenate([[True], text[1:] != text[:-1]])
    left = np.concatenate([[0], codes[:-1].astype(np.int64) + 1])
    left[start] = 0  # nothing stands before the first word
    found: dict[tuple[int, int], int] = {}
    _pairs(order.tolist(), lcp.tolist(), shallowest, shortest, left.tolist(), found)
    base = at.tolist()
    return sorted((base[s], base[e - 1] + 1, q) for (s, e), q in found.items())


def repeat_tail(codes: np.ndarray, g: int) -> np.ndarray:
    """The words with a repeated stretch planted: from place a = g % n on, those from a on with period p."""
    n = len(codes)
    if n == 0:
        return codes
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return codes[np.where(at < a, at, a + (at - a) % p)]


RESULT = ("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
          "runs array<struct<start:long,length:long,period:long>>, collapsed string")


def periodic_runs(df: DataFrame, shortest: int = 12, text: str = "text", plant: str | None = None, collapsed: bool = True) -> DataFrame:
    """The rows without their text, with the runs of its words and the text they collapse to.

    Adds `n_runs`; `start`, `length`, `period` and `exponent_milli` of the longest run (ties: least start,
    then period; null without one); `runs`, all of them by start and period; `collapsed`, the words joined by
    single spaces less those that a run holds after its first period (null if `collapsed` is false); SHA-256
    of both as text. `plant` names a column of whole numbers: where it is not null, the words are first
    repeated by repeat_tail(). Null, empty and blank texts have no words and no runs; a text of any length is
    searched whole; repeated rows stay separate; an empty table gives no rows. Columns of these names are replaced.
    """
    made = [part.split(" ")[0] for part in RESULT.split(", ")]
    kept = [c for c in df.columns if c != text and c not in made and c != plant]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for part in text_slices(batch.column(0), SLICE_BYTES):
                rows = slice(row, row + len(part))
                row += len(part)
                planted = batch.column(1).slice(rows.start, len(part)).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(rows.start, len(part)) for c in batch.columns[2:]), *_searched(part, planted, shortest, collapsed)], names=[*kept, *made])

    schema = df.select(*kept).schema
    for field in df.sparkSession.createDataFrame([], RESULT).schema:
        schema = schema.add(field)
    from pyspark.sql import functions as F

    planted = F.col(plant).cast("long") if plant else F.lit(None).cast("long")
    return df.select(text, planted.alias("_plant_"), *kept).mapInArrow(run, schema)


def _searched(texts: pa.Array, planted: list, shortest: int, with_text: bool) -> list[pa.Array]:
    words = words_of(texts)
    codes, bounds = words.code.astype(np.int64), words.bounds
    for i, g in enumerate(planted):
        if g is not None:
            codes[bounds[i]:bounds[i + 1]] = repeat_tail(codes[bounds[i]:bounds[i + 1]], g)
    runs = runs_of(codes, bounds, shortest)
    keep = np.ones(len(codes), bool)
    for s, e, q in runs:
        keep[s + q:e] = False
    upto = np.concatenate([[0], np.cumsum(keep)])
    kept = pa.LargeListArray.from_arrays(pa.array(upto[bounds], pa.int64()), words.unique.take(pa.array(codes[keep])).cast(pa.large_string()))
    collapsed = pc.binary_join(kept, pa.scalar(" ", pa.large_string()))
    starts = np.array([s for s, _, _ in runs], np.int64)
    first = np.searchsorted(starts, bounds[:-1], "left").tolist()
    to = np.searchsorted(starts, bounds[1:], "left").tolist()
    columns: list[list] = [[] for _ in range(5)]
    listed, shas, text_shas = [], [], []
    none = hashlib.sha256(b"").hexdigest()
    base = bounds.tolist()
    for i in range(len(texts)):
        own = [(s - base[i], e - s, q) for s, e, q in runs[first[i]:to[i]]]
        own.sort(key=lambda r: (r[0], r[2]))
        best = min(own, key=lambda r: (-r[1], r[0], r[2])) if own else (None, None, None)
        for column, value in zip(columns, (len(own), *best, 1000 * best[1] // best[2] if own else None), strict=True):
            column.append(value)
        listed.append([{"start": s, "length": n, "period": q} for s, n, q in own])
        shas.append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()).hexdigest() if own else none)
    offsets = np.asarray(collapsed.offsets) if hasattr(collapsed, "offsets") else np.frombuffer(collapsed.buffers()[1], np.int64)[:len(collapsed) + 1]
    data = collapsed.buffers()[2]
    view = memoryview(data) if data else memoryview(b"")
    for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        text_shas.append(hashlib.sha256(view[a:b]).hexdigest())
    places = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    text = collapsed.cast(pa.string()) if with_text else pa.nulls(len(texts), pa.string())
    return [*(pa.array(c, pa.int64()) for c in columns), pa.array(shas), pa.array(text_shas), pa.array(listed, places), text]
