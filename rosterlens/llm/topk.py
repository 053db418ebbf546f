"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped into buckets of like length. A query's k-th best score so far, divided by its own
length and a bucket's, is the bucket's local cosine threshold: above one, the bucket and all shorter
ones hold nothing; a high threshold makes pruning by a few coordinates pay; a low one leaves pruning
by length. Candidates that remain are verified by their integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import partitions

BUCKET = 512
_SLACK = 1e-9
HIGH = 0.7  # local threshold from which coordinates prune
FOCUS = 3


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """vec_id, v (floor(scale * x) for each component as double) and norm2; vectors null or with null or non-finite parts are left out."""
    x = F.col(vector)
    finite = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.where(finite & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v")).withColumn(
        "norm2", F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))


class Best:
    """The k highest (score, smaller id first) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.scores, self.ids = k, [np.zeros(0, np.int64)] * queries, [np.zeros(0, np.int64)] * queries

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        keep = np.lexsort((i, -s))[:self.k]
        self.scores[q], self.ids[q] = s[keep], i[keep]

    def threshold(self, q: int) -> float:
        return float(self.scores[q][-1]) if len(self.scores[q]) == self.k else -np.inf


def retrieve(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Best:
    """The k best of `vectors` for each query; a score below a query's floor may be left out, as may its own id."""
    best = Best(len(queries), k)
    if not len(vectors) or not len(queries):
        return best
    c, qf = vectors.astype(np.float64), queries.astype(np.float64)
    lengths, query_lengths = np.sqrt((c ** 2).sum(1)), np.sqrt((qf ** 2).sum(1))
    order = np.argsort(-lengths, kind="stable")
    c, vectors, ids, lengths = c[order], vectors[order], ids[order], lengths[order]
    unit = c / np.where(lengths > 0, lengths, 1)[:, None]
    # sums of doubles are exact below 2^53
    exact = np.abs(c).max(initial=0) * np.abs(qf).max(initial=0) * c.shape[1] < 2.0 ** 53
    for q in range(len(queries)):
        direction = qf[q] / (query_lengths[q] or 1)
        focus = np.argsort(-np.abs(direction))[:FOCUS]
        for a in range(0, len(c), BUCKET):
            theta = max(best.threshold(q), floors[q])
            longest = query_lengths[q] * lengths[a]
            if theta > 0 and theta > longest * (1 + _SLACK):
                break  # nothing here or shorter can reach it
            b = min(a + BUCKET, len(c))
            local = theta / longest if longest else -np.inf
            at = np.arange(a, b)
            if local >= HIGH:  # coordinates: a unit vector at this cosine lies within a band of each of the query's
                local = min(local, 1.0)
                for f in focus:
                    half = np.sqrt((1 - direction[f] ** 2) * (1 - local ** 2)) + _SLACK
                    at = at[np.abs(unit[at, f] - direction[f] * local) <= half + (1 - local) * np.abs(direction[f])]
            elif theta > 0:  # length: only vectors long enough
                at = at[:int(np.searchsorted(-lengths[a:b], -theta / (query_lengths[q] * (1 + _SLACK)), "right"))]
            at = at[ids[at] != query_ids[q]]
            if len(at):
                score = (c[at] @ qf[q]).astype(np.int64) if exact else vectors[at] @ queries[q]
                found = score >= theta if np.isfinite(theta) else np.ones(len(at), bool)
                best.add(q, score[found], ids[at][found])
    return best


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, 0), np.int64)


def _answer(best: Best, query_ids: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"query_id": np.repeat(query_ids, [len(s) for s in best.scores]), "vec_id": np.concatenate([*best.ids, np.zeros(0, np.int64)]), "score": np.concatenate([*best.scores, np.zeros(0, np.int64)])})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, per_cell: int = 8192, query_block: int = 512) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k highest integer products, ties to the smaller vec_id.

    Both inputs are integer_vectors(); a query never meets its own id. All vectors must have one
    dimension. Queries and candidates meet in cells of a grid, each vector copied once for each block
    of queries, each query once for each group of candidates. The longest candidates go first, and
    the k-th score among them is the floor with which a query enters its cells. Repeated ids are separate rows;
    empty tables give no rows; scores must fit 63 bits.
    """
    spark = vectors.sparkSession
    vectors, queries = checkpointed(vectors), checkpointed(queries)
    n, m = vectors.count(), queries.count()
    groups, blocks = max(1, -(-n // per_cell)), max(1, -(-m // query_block))
    head = vectors.orderBy(F.desc("norm2"), "vec_id").limit(2 * BUCKET).select("vec_id", "v")  # a fixed number
    first = spark.sparkContext.broadcast([(r["vec_id"], r["v"]) for r in head.collect()])

    def with_floor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = np.array([r[0] for r in first.value], dtype=np.int64)
        longest = np.array([r[1] for r in first.value], dtype=np.int64).reshape(len(ids), -1)
        for batch in batches:
            if not len(batch):
                continue
            best = retrieve(_matrix(batch["v"]), batch["vec_id"].to_numpy(), np.full(len(batch), -np.inf), longest, ids, k)
            yield batch[["vec_id", "v"]].assign(floor=[best.threshold(q) for q in range(len(batch))])

    asked = queries.mapInPandas(with_floor, "vec_id long, v array<long>, floor double").select(
        "vec_id", "v", "floor", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(True).alias("asks"))
    # groups of like length: a rank by length cuts equal lengths too
    bounds = vectors.approxQuantile("norm2", [i / groups for i in range(1, groups)], 0.1 / groups) if groups > 1 else []
    group = F.lit(0)
    for b in bounds:
        group = group + (F.col("norm2") >= b).cast("int")
    same = F.col("norm2").isin(bounds) if bounds else F.lit(False)  # a length that many share is dealt over all groups
    given = vectors.select("vec_id", "v", F.lit(None).cast("double").alias("floor"), F.when(same, F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).otherwise(group).alias("group"), F.lit(False).alias("asks")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def answer() -> Iterator[pa.RecordBatch]:
            rows = pd.concat(parts, ignore_index=True)
            asks = rows["asks"].to_numpy(dtype=bool)
            q, c = rows[asks], rows[~asks]
            best = retrieve(_matrix(q["v"]), q["vec_id"].to_numpy(), q["floor"].to_numpy(), _matrix(c["v"]), c["vec_id"].to_numpy(), k)
            yield pa.RecordBatch.from_pandas(_answer(best, q["vec_id"].to_numpy()), preserve_index=False)

        for batch in batches:
            frame = batch.to_pandas()
            for now, part in frame.groupby(["block", "group"], sort=True):
                if now != key and parts:
                    yield from answer()
                    parts = []
                key = now
                parts.append(part)
        if parts:
            yield from answer()

    cells = asked.select("block", "group", "asks", "vec_id", "v", "floor").unionByName(given.select("block", "group", "asks", "vec_id", "v", "floor"))
    found = cells.repartition(max(partitions(spark), min(groups * blocks, 4096)), "block", "group").sortWithinPartitions("block", "group").mapInArrow(cell, "query_id long, vec_id long, score long")
    # at most k rows a query and group: fold them to the k best without sorting a query's rows in one window
    row = F.struct((-F.col("score")).alias("down"), "vec_id")
    kept = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(row)), 1, k).alias("best"))
    return kept.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.down")).alias("score"))
