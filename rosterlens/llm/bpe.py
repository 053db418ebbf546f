"""Byte-level BPE encoding and decoding by a file of ranks.

Each match of the splitting pattern is merged separately. A segment tree over the match's byte
positions keeps the leftmost minimum pair rank at its root; a merge takes it, relinks the live
neighbours and updates the three leaves that changed, each by a walk to the root. Many matches of
one padded width are merged side by side, one array row each.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import once_per_worker
from .tokens import TextEncoder

_NONE = np.int64(1) << 62


class RankBpe:
    """Encoder and decoder of one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.token = {r: t for t, r in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.byte_rank = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for t, rank in self.ranks.items():
            for cut in range(1, len(t)):
                a, b = self.ranks.get(t[:cut]), self.ranks.get(t[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, shift: int) -> np.ndarray:
        """Rank and place of pairs as one number, smaller rank first, then further left; _NONE for no pair."""
        key = left << 32 | right
        i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[i] == key, self.pair_ranks[i] << shift | at, _NONE)

    def _merge(self, pieces: list[bytes], shift: int) -> list[bytes]:
        width = 1 << shift
        n = len(pieces)
        sizes = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
        token = self.byte_rank[raw]
        places = np.arange(width)
        after = np.broadcast_to(places + 1, (n, width)).copy()
        after[after >= sizes[:, None]] = width
        before = np.broadcast_to(places - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
        tree[:, width:2 * width - 1] = self._leaf(token[:, :-1], token[:, 1:], places[:-1], shift)
        tree[:, width:2 * width][after == width] = _NONE
        level = width
        while level > 1:
            half = level // 2
            np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2], out=tree[:, half:level])
            level = half

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + width
            tree[rows, node] = value
            for _ in range(shift):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        live = np.flatnonzero(tree[:, 1] < _NONE)
        while len(live):
            best = tree[live, 1]
            i = best & (width - 1)
            merged = best >> shift
            j = after[live, i]
            k = after[live, j]
            token[live, i] = merged
            after[live, i] = k
            token[live, j] = -1
            put(live, j, np.full(len(live), _NONE))
            right = k < width
            rows, at, to = live[right], i[right], k[right]
            before[rows, to] = at
            value = np.full(len(live), _NONE)
            value[right] = self._leaf(merged[right], token[rows, to], at, shift)
            put(live, i, value)
            left = before[live, i] >= 0
            rows, at = live[left], before[live, i][left]
            put(rows, at, self._leaf(token[rows, at], merged[left], at, shift))
            live = live[tree[live, 1] < _NONE]
        keep = (token >= 0) & (places < sizes[:, None])
        flat = token[keep].astype("<u4")
        cuts = np.concatenate([[0], np.cumsum(keep.sum(axis=1))]).tolist()
        whole = flat.tobytes()
        return [whole[4 * a:4 * b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def merge_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit integers; a piece that is a token is that token."""
        out: dict[bytes, bytes] = {}
        by_shift: dict[int, list[bytes]] = {}
        for p in pieces:
            rank = self.ranks.get(p)
            if rank is not None:
                out[p] = rank.to_bytes(4, "little")
            else:
                by_shift.setdefault((len(p) - 1).bit_length(), []).append(p)
        for shift, group in by_shift.items():
            step = max(1, (1 << 18) >> shift)
            for a in range(0, len(group), step):
                part = group[a:a + step]
                out.update(zip(part, self._merge(part, shift), strict=True))
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        found = [[m.encode() for m in self.find(t)] for t in texts]
        ids = self.merge_pieces(list(set().union(*found)))
        return [b"".join(map(ids.__getitem__, f)) for f in found]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, memoryview(ids).cast("I").tolist())) if ids else b""


def _bpe(path: str, pattern: str) -> tuple[RankBpe, TextEncoder]:
    def make():
        bpe = RankBpe(path, pattern)
        return bpe, TextEncoder(bpe.encode_many, keeps_space=True)

    return once_per_worker(("ranks", path, pattern), make)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds `ids`, the text's token ids as little-endian unsigned 32-bit integers.

    Null and empty texts get no ids (an empty value); rows, other columns and repeats stay as they
    are, a column already named `ids` is replaced. The pattern must give a space to the word after it,
    as the one of the byte-level vocabularies does.
    """
    return _mapped(df, text, ids, lambda values: list(_bpe(path, pattern)[1].encode(values)))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds `to`, the bytes that the ids stand for; null ids give null, unknown ids raise."""
    return _mapped(df, ids, to, lambda values: [None if v is None else _bpe(path, pattern)[0].decode(v) for v in values.to_pylist()])


def _mapped(df: DataFrame, source: str, to: str, run) -> DataFrame:
    kept = [c for c in df.columns if c != to]

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = pa.array(run(batch.column(source)), pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], names=[*kept, to])

    schema = df.select(*kept).schema.add(to, "binary")
    return df.mapInArrow(batches_of, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: number of ids, and the SHA-256 of the ids and of the bytes they decode to.

    Encodes and decodes as encode() and decode() do, without keeping the ids: the texts go in and
    three short columns come out. Null texts count as empty; ids of documents may be null or repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = _bpe(path, pattern)
        for batch in batches:
            n, sha, back = [], [], []
            for ids in encoder.encode(batch.column("text")):
                n.append(len(ids) // 4)
                sha.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([pc.cast(batch.column("doc_id"), pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
