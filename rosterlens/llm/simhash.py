"""SimHash fingerprints of documents and the groups that near fingerprints link, by BK-trees.

Fingerprints at most `radius` bits apart agree in at least one of `radius` + 1 blocks of bits, so a
shard holds the different fingerprints with one value of one block. Each shard builds a BK-tree:
a child is keyed by its Hamming distance to the parent, and a search follows only the edges within
the radius of the distance it has just measured. A large shard becomes several trees of bounded
size; its fingerprints go to each of them. Shards report links that keep their members connected,
and stars are contracted over all shards until every group has one root.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import few_tasks, partitions, text_slices, words_of

#: Text fingerprinted at once, for bounded memory.
SLICE_BYTES = 1_500_000


def shingle_hashes(texts: pa.Array, size: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every run of `size` lower-cased words, repeats included, and each text's bounds among them.

    Fewer words make one shingle of them all; a text without words has none.
    """
    import xxhash

    words = words_of(texts, lower=True)
    flat, n, counts = words.unique.cast(pa.binary()).take(pa.array(words.code)), len(words.code), words.counts
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(made)])
    whole = counts >= size
    hashes = np.zeros(bounds[-1], dtype=np.uint64)
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    if whole.any():
        joined = pc.binary_join_element_wise(*(flat.slice(k, n - size + 1) for k in range(size)), b" ") if size > 1 else flat
        at = _ranges(words.bounds[:-1][whole], made[whole])
        found = np.fromiter(map(digest, joined.take(pa.array(at)).to_pylist()), np.uint64, len(at))
        hashes[np.repeat(whole, made)] = found
    for i in np.flatnonzero(~whole & (counts > 0)).tolist():
        hashes[bounds[i]] = digest(b" ".join(flat.slice(words.bounds[i], counts[i]).to_pylist()))
    return hashes, bounds


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, one after another."""
    before = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.arange(counts.sum()) + np.repeat(starts - before, counts)


def majority_bits(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One fingerprint per range of hashes: the bits set in over half of them; zero for an empty range."""
    counts = np.diff(bounds)
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    step_at = 0
    while step_at < len(full):  # about a million hashes at a time
        to = max(step_at + 1, int(np.searchsorted(bounds[full + 1], bounds[full[step_at]] + 1_000_000)))
        rows = full[step_at:to]
        a, b = bounds[rows[0]], bounds[rows[-1] + 1]
        bits = np.unpackbits(hashes[a:b].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(bits, bounds[rows] - a, axis=0, dtype=np.int32)
        out[rows] = np.packbits(2 * sums > counts[rows][:, None], axis=1).view(">u8").ravel()
        step_at = to
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the 64-bit fingerprint as a signed long. A null text counts as empty: fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [majority_bits(*shingle_hashes(t, shingle)) for t in text_slices(batch.column(1), SLICE_BYTES)]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


class BkTree:
    """Fingerprints by Hamming distance: node k has children keyed by their distance to it."""

    def __init__(self, radius: int):
        self.radius, self.values, self.children, self.root_of = radius, [], [], []

    def near(self, value: int) -> list[int]:
        """Nodes within the radius of `value`."""
        if not self.values:
            return []
        found, todo, radius = [], [0], self.radius
        values, children = self.values, self.children
        while todo:
            k = todo.pop()
            d = (values[k] ^ value).bit_count()
            if d <= radius:
                found.append(k)
            for distance, child in children[k].items():
                if d - radius <= distance <= d + radius:
                    todo.append(child)
        return found

    def insert(self, value: int) -> int:
        k, node = len(self.values), 0
        self.values.append(value)
        self.children.append({})
        self.root_of.append(k)
        while k:
            d = (self.values[node] ^ value).bit_count()
            child = self.children[node].get(d)
            if child is None:
                self.children[node][d] = k
                break
            node = child
        return k

    def root(self, k: int) -> int:
        roots = self.root_of
        while roots[k] != k:
            roots[k] = roots[roots[k]]
            k = roots[k]
        return k

    def add_linked(self, value: int) -> None:
        """Inserts `value` and joins it with everything near it."""
        near = self.near(value)
        k = self.insert(value)
        for other in near:
            r = self.root(other)
            if r != self.root(k):
                self.root_of[self.root(k)] = r


def _search(radius: int):
    """Rows sorted by (shard, tree, asks): first a tree's members, then the fingerprints that ask it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, key, last = BkTree(radius), None, None  # last: a single member so far, no tree yet

        def links() -> list[tuple[int, int]]:
            return [(v, tree.values[r]) for k, v in enumerate(tree.values) if (r := tree.root(k)) != k]

        def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

        pairs: list[tuple[int, int]] = []
        for batch in batches:
            block, value, number, asks, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "value", "tree", "asks", "fp"))
            for *now, asking, f in zip(block.tolist(), value.tolist(), number.tolist(), asks.tolist(), fp.view(np.uint64).tolist(), strict=True):
                if now != key:
                    pairs += links()
                    tree, key, last = BkTree(radius), now, None
                if not asking and last is None and not tree.values:
                    last = f
                    continue
                if last is not None:
                    tree.add_linked(last)
                    last = None
                if asking:
                    pairs += {(f, tree.values[tree.root(k)]) for k in tree.near(f)}
                else:
                    tree.add_linked(f)
            if len(pairs) > 100_000:
                yield out(pairs)
                pairs = []
        yield out(pairs + links())

    return run


def _block(fp: Column, k: int, blocks: int) -> Column:
    at, to = 64 * k // blocks, 64 * (k + 1) // blocks
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << (to - at)) - 1))


def near_links(distinct: DataFrame, radius: int = 2, per_tree: int = 2048) -> DataFrame:
    """Links (a, b) of different fingerprints that connect exactly what links of at most `radius` bits connect."""
    blocks = radius + 1
    rows = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("block"), _block(F.col("fp"), k, blocks).alias("value")) for k in range(blocks)))).alias("s")).select("fp", "s.*")
    large = rows.groupBy("block", "value").count().where(F.col("count") > per_tree).select("block", "value", F.ceil(F.col("count") / per_tree).cast("int").alias("trees"))
    rows = rows.join(large, ["block", "value"], "left").withColumn("trees", F.coalesce("trees", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), "trees").cast("int"))
    # a link between two trees is found when the fingerprint of the lower one asks the higher one
    rows = rows.withColumn("tree", F.explode(F.sequence("own", F.col("trees") - 1))).withColumn("asks", F.col("tree") != F.col("own"))
    spread = rows.select("block", "value", "tree", "asks", "fp").repartition(partitions(distinct.sparkSession), "block", "value", "tree")
    return spread.sortWithinPartitions("block", "value", "tree", "asks").mapInArrow(_search(radius), "a long, b long")


def contracted(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node but the roots: the least node of each group of linked nodes.

    Alternates large stars (each node hands its larger neighbours to its least one) and small stars
    (likewise its smaller ones); the number of rounds grows with the logarithm of the longest path.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, tasks = now, few_tasks(now[0], 20_000)
        both = edges.union(edges.select("v", "u")).coalesce(tasks)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = checkpointed(small.where("u <> v").coalesce(tasks).distinct().coalesce(tasks))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp and component_id of every document: the least doc_id that links of at most `radius` bits reach.

    Equal fingerprints, texts without words among them (fingerprint zero), are one group from the
    start and enter the search once. Null texts count as empty, a null doc_id joins a group but does
    not name it, repeated rows return as often as they came, other columns are ignored.
    """
    prints = checkpointed(fingerprints(docs, shingle))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = contracted(near_links(distinct, radius)).withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.select("fp", "root").join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
