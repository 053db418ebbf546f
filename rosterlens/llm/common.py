"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word pattern and the white space it leaves out.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A given table, only the named columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def few_tasks(rows: int, per_task: int, least: int = 16) -> int:
    """Tasks for so many rows. Every task before a shuffle leaves files of its own, so that small tables in the many
    partitions of a large job would take more disk for those than for their rows; coalesce() to this number."""
    return max(least, -(-rows // per_task))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


def sealed(*columns: str) -> Column:
    """The columns as one generated value `_made`: a later filter on one of them is not moved before their making,
    where the optimizer would put each whole expression in place of its name, inside loops over arrays too."""
    return F.explode(F.array(F.struct(*columns))).alias("_made")


def text_slices(texts: pa.Array, most: int = 8_000_000) -> Iterator[pa.Array]:
    """Consecutive parts of a text column of about `most` bytes each (one text at least), nulls as empty."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield texts.slice(at, to - at)
        at = to


class Words:
    """The words of a part of a text column: `code` of each word, `bounds` of each text, `unique` words by code."""

    def __init__(self, flat: pa.Array, bounds: np.ndarray):
        coded = flat.dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False)
        self.unique = coded.dictionary
        self.bounds = bounds

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def row(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Words by WORD, with A-Z lowered on request: Arrow's ASCII white space is exactly those six bytes."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, bounds = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    bounds -= bounds[0]
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if empty.any():  # at the ends of texts
        bounds = np.concatenate([[0], np.cumsum(~empty)])[bounds]
        flat = flat.filter(pa.array(~empty))
    return Words(flat, bounds)


class Memo:
    """Values of keys, made many at once and kept between batches: at most about `most` bytes.

    Two generations: when the newer one is full it becomes the older one, from which keys still in
    use move back. The bound is on memory alone; a forgotten key is made again.
    """

    def __init__(self, make: Callable[[list], dict], most: int = 64_000_000):
        self.make, self.half, self.size, self.new, self.old = make, most // 2, 0, {}, {}

    def clear(self) -> None:
        self.size, self.new, self.old = 0, {}, {}

    def _keep(self, made: dict) -> None:
        self.new.update(made)
        self.size += 100 * len(made) + sum(map(getsizeof, made)) + sum(map(getsizeof, made.values()))

    def holding(self, keys: set) -> dict:
        if self.size > self.half:
            self.old, self.new, self.size = self.new, {}, 0
        missing = keys - self.new.keys()
        if missing and self.old:
            again = {k: self.old[k] for k in missing & self.old.keys()}
            self._keep(again)
            missing -= again.keys()
        if missing:
            self._keep(self.make(list(missing)))
        return self.new


#: One per worker process: loaded vocabularies and their memos outlive a task when workers are reused.
_LOADED: dict = {}


def once_per_worker(key, make: Callable):
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]


def arrow_long(values, nulls=None) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64), mask=nulls)
