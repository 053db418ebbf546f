"""Toxicity by a factorization machine over hashed terms.

    score = sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>)  over the different terms i, j of a text

The pairwise part learns what additive weights miss, such as an insult beside a mention of a group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remainder, text_slices, words_of

BUCKETS = 1 << 18
#: Text taken apart at once, for bounded memory.
SLICE_BYTES = 1_500_000
PREFIXES = (4, 5, 6)
_EDGE = ".,;:!?%*&$#|\"'()[]{}<>-_"


def bounded_sample(labelled: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """About `most` of the rows at most, chosen by a hash of the key: all of them where there are fewer."""
    n = labelled.count()
    if n <= most:
        return labelled
    return labelled.where(F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1_000_000)) < int(1_000_000 * most / n))


def term_rows(texts: pa.Array, known: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(text, bucket, texts) for the different terms of each part of the texts, only buckets `known` to a model if given.

    Terms are the words in lower case without marks at the ends, and their first four, five and six
    letters, by which compounds and inflected forms of a word meet.
    """
    for part in text_slices(texts, SLICE_BYTES):
        words = words_of(part)
        terms = pc.utf8_trim(pc.utf8_lower(words.unique), _EDGE)
        columns = [_bucket(terms.cast(pa.binary()).to_pylist(), b"")]
        sizes = pc.utf8_length(terms).to_numpy(zero_copy_only=False)
        for n in PREFIXES:
            starts = pc.utf8_slice_codeunits(terms, 0, n).cast(pa.binary()).to_pylist()
            columns.append(np.where(sizes >= n, _bucket(starts, b"^%d" % n), 0))
        buckets = np.stack(columns, axis=1)
        if known is not None:
            buckets[~known[buckets]] = 0
        useful = buckets.any(axis=1)[words.code]
        pairs = np.unique(words.row[useful] * len(terms) + words.code[useful])  # different words of each text
        row, code = np.divmod(pairs, max(1, len(terms)))
        key = np.unique((row[:, None] * BUCKETS + buckets[code]).ravel())
        key = key[key % BUCKETS > 0]
        yield key // BUCKETS, key % BUCKETS, len(part)


def _bucket(terms: list[bytes], kind: bytes) -> np.ndarray:
    begin = zlib.crc32(kind)
    return np.fromiter((zlib.crc32(t, begin) % (BUCKETS - 1) + 1 if t else 0 for t in terms), np.int64, len(terms))


def _margins(model: dict, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    place = model["place"][bucket]
    known = place >= 0
    row, place = row[known], place[known]
    w, v = model["w"], model["v"]
    out = np.full(n, model["b"], dtype=np.float64)
    if len(row):
        begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        at = row[begins]
        sums = np.add.reduceat(v[place], begins, axis=0)
        out[at] += np.add.reduceat(w[place], begins) + 0.5 * ((sums ** 2).sum(1) - np.add.reduceat((v ** 2).sum(1)[place], begins))
    return out


def train(rows: np.ndarray, buckets: np.ndarray, labels: np.ndarray, factors: int = 4, epochs: int = 12, least: int = 5,
          rate: float = 0.1, decay: float = 2e-4, batch: int = 256, seed: int = 7) -> dict:
    """Fits the machine by AdaGrad on texts given as (row, bucket) pairs sorted by row; terms of fewer than `least` texts are left out."""
    rng = np.random.default_rng(seed)
    place = np.full(BUCKETS, -1, dtype=np.int64)
    used = np.flatnonzero(np.bincount(buckets, minlength=BUCKETS) >= least)
    place[used] = np.arange(len(used))
    keep = place[buckets] >= 0
    rows, terms = rows[keep], place[buckets[keep]]
    bounds = np.searchsorted(rows, np.arange(len(labels) + 1))
    share = np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3)
    b = float(np.log(share / (1 - share)))
    w, v = np.zeros(len(used)), rng.normal(0, 0.01, (len(used), factors))
    gw, gv = np.full(len(used), 1e-3), np.full((len(used), factors), 1e-3)
    spot = np.zeros(len(used), dtype=np.int64)  # a term's place among those of the batch
    for _ in range(epochs if len(used) else 0):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), batch):
            some = order[a:a + batch]
            counts = bounds[some + 1] - bounds[some]
            before = np.concatenate([[0], np.cumsum(counts)])
            at = terms[np.arange(before[-1]) + np.repeat(bounds[some] - before[:-1], counts)]
            of = np.repeat(np.arange(len(some)), counts)
            vt = v[at]
            sums = np.stack([np.bincount(of, vt[:, f], len(some)) for f in range(factors)], axis=1)
            pair = 0.5 * ((sums ** 2).sum(1) - np.bincount(of, (vt ** 2).sum(1), len(some)))
            m = b + np.bincount(of, w[at], len(some)) + pair
            slope = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - labels[some])
            b -= 0.02 * slope.mean()
            touched = np.flatnonzero(np.bincount(at, minlength=len(used)))
            spot[touched] = np.arange(len(touched))
            inverse = spot[at]
            g = np.bincount(inverse, slope[of], len(touched)) / len(some) + decay * w[touched]
            gw[touched] += g ** 2
            w[touched] -= rate * g / np.sqrt(gw[touched])
            part = slope[of][:, None] * (sums[of] - vt)
            g = np.stack([np.bincount(inverse, part[:, f], len(touched)) for f in range(factors)], axis=1) / len(some) + decay * v[touched]
            gv[touched] += g ** 2
            v[touched] -= 0.3 * rate * g / np.sqrt(gv[touched])
    return {"b": b, "w": w, "v": v, "place": place}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 16_384) -> dict:
    """A machine fitted on at most about `most` labelled documents (a bounded sample by hash of doc_id).

    Only rows with a label and a remainder other than 2 teach; a document labelled twice counts as the
    larger label. One task fits; its result is bounded by the number of buckets. Without labelled
    documents the score is that of no evidence.
    """
    taught = labels.where(F.col(label).isNotNull() & (remainder(F.col("doc_id"), 4) != 2)).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    chosen = bounded_sample(taught, most)

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for row, bucket, n in term_rows(batch.column("text")):
                bounds = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, n), batch.column("label").slice(done, n), pa.ListArray.from_arrays(pa.array(bounds), pa.array(bucket.astype(np.int32)))], names=["doc_id", "label", "terms"])
                done += n

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels_, counts, terms = [], [], []
        for batch in batches:
            labels_.append(batch.column("label").to_numpy(zero_copy_only=False))
            counts.append(np.diff(np.asarray(batch.column("terms").offsets)))
            terms.append(batch.column("terms").flatten().to_numpy(zero_copy_only=False))
        if not labels_:
            return
        n = np.concatenate(counts)
        model = train(np.repeat(np.arange(len(n)), n), np.concatenate(terms).astype(np.int64), np.concatenate(labels_))
        used = np.flatnonzero(model["place"] >= 0)
        yield pa.RecordBatch.from_arrays([pa.array([model["b"]]), pa.array([used.astype("<i4").tobytes()]), pa.array([model["w"].astype("<f4").tobytes()]), pa.array([model["v"].astype("<f4").tobytes()])], names=["b", "used", "w", "v"])

    sampled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")  # bounded by `most`
    termed = sampled.mapInArrow(terms_of, sampled.select("doc_id").schema.add("label", "double").add("terms", T.ArrayType(T.IntegerType())))
    # sorted, so that the fit is the same however the rows arrive, as after a lost executor
    row = termed.repartition(1).sortWithinPartitions("doc_id", "terms").mapInArrow(fitted, "b double, used binary, w binary, v binary").first()
    if row is None:
        return {"b": 0.0, "w": np.zeros(0), "v": np.zeros((0, 1)), "place": np.full(BUCKETS, -1)}
    used = np.frombuffer(row["used"], "<i4")
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[used] = np.arange(len(used))
    w = np.frombuffer(row["w"], "<f4")
    return {"b": row["b"], "w": w, "v": np.frombuffer(row["v"], "<f4").reshape(len(w), -1), "place": place}


def score(docs: DataFrame, model: dict, column: str = "score") -> DataFrame:
    """Adds `column` (0 to 1) to the documents, all whole texts; null and empty texts get the score of no evidence.

    Other columns, nulls and repeated rows stay as they are; one named `column` is replaced.
    """
    kept = [c for c in docs.columns if c != column]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_margins(shared.value, *part) for part in term_rows(batch.column("text"), shared.value["place"] >= 0)]
            if made:
                s = 1 / (1 + np.exp(-np.clip(np.concatenate(made), -50, 50)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(s)], names=[*kept, column])

    return docs.mapInArrow(run, docs.select(*kept).schema.add(column, "double"))
