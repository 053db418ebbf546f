"""Merkle manifest of a data set: a leaf a row, a tree a group of rows, one tree over the groups.

Places of leaves are ranks in bitmaps, not positions in a sorted table. Each group keeps a bitmap of its ids,
compressed to the 64-bit words that hold any; words are merged across tasks by OR before they are
shuffled. Popcount directories over 2^16, 2^32 and 2^48 ids give the rows before each word, and the bits
below an id the rest. A leaf then goes to the slot array of its block of 3^4 places, keyed by group and
block: a task reduces four levels at once, the blocks' tops fill the next arrays, and the way down
carries each block's proof to its rows. No task sees more than a block, a word's ids or a directory's
2^16 entries, however many rows a group has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

RUN = 3
LEVELS = 4
SPAN = RUN**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Stands for the word of null ids: below every word, and at each directory below every span.
_NULL_WORD = -(1 << 57) - 1
#: Copies of one row written by one row of the plan at most.
_COPIES = 4096


def leaf_of(values: Sequence[Column]) -> Column:
    """SHA-256 of the values, each as its UTF-8 byte count, a colon and its text, or `-` if null."""
    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(part, values)).cast("binary"), 256))


# places -------------------------------------------------------------------------------------------------------


def id_bitmaps(rows: DataFrame) -> DataFrame:
    """The words of each group's bitmap: g, w, bits, n rows; `rows` has g, w and low (0 to 63)."""
    return rows.groupBy("g", "w").agg(F.bit_or(F.expr("shiftleft(1L, low)")).alias("bits"), F.count(F.lit(1)).alias("n"))


def with_directories(words: DataFrame) -> DataFrame:
    """The words with `before`, the group's rows ahead of them, and `total`, the group's rows."""
    def ahead(df: DataFrame, key: str, within: Column | None) -> DataFrame:
        w = Window.partitionBy("g", *([] if within is None else [within])).orderBy(key)
        return df.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    spans = [words]
    for up, below, bits in (("d1", "w", 10), ("d2", "d1", 16), ("d3", "d2", 16)):
        spans[-1] = ahead(spans[-1].withColumn(up, F.shiftright(below, bits)), below, F.col(up))
        spans.append(spans[-1].groupBy("g", up).agg(F.sum("n").alias("n")))
    whole = Window.partitionBy("g")
    top = ahead(spans[3], "d3", None).select("g", "d3", F.col("before").alias("ahead"), F.sum("n").over(whole).alias("total"))
    for level, up in ((2, "d3"), (1, "d2"), (0, "d1")):
        joined = spans[level].join(top, ["g", up])
        rest = ("w", "bits", "n") if level == 0 else (f"d{level}",)
        name = "before" if level == 0 else "ahead"
        top = joined.select("g", *rest, (F.col("before") + F.col("ahead")).alias(name), "total")
    return top


def placed(rows: DataFrame) -> DataFrame:
    """The rows (g, id, leaf, claimed) with `at`, their place in the group by id, nulls first, then leaf, and `total`.

    Rows alike in all four are told apart by their place alone.
    """
    rows = rows.withColumn("w", F.coalesce(F.shiftright("id", 6), F.lit(_NULL_WORD))).withColumn("low", F.coalesce(F.col("id").bitwiseAND(63), F.lit(0)).cast("int"))
    words = checkpointed(id_bitmaps(rows.select("g", "w", "low")))
    repeated = words.where("n > bit_count(bits)").select("g", "w")
    index = with_directories(words)
    below = F.expr("cast(bit_count(bits & ~shiftleft(-1L, low)) as long)")
    if repeated.isEmpty():
        return rows.join(index.drop("n"), ["g", "w"]).select("g", "id", "leaf", "claimed", (F.col("before") + below).alias("at"), "total")
    per_id = rows.select("g", "w", "low").join(repeated, ["g", "w"]).groupBy("g", "w", "low").agg(F.count(F.lit(1)).alias("n"))
    many = per_id.groupBy("g", "w").agg(F.collect_list(F.struct("low", "n")).alias("many"))
    found = rows.join(index.drop("n").join(many, ["g", "w"], "left"), ["g", "w"])
    smaller = F.aggregate(F.filter("many", lambda m: m["low"] < F.col("low")), F.lit(0).cast("long"), lambda s, m: s + m["n"])
    copies = F.aggregate(F.filter("many", lambda m: m["low"] == F.col("low")), F.lit(0).cast("long"), lambda s, m: s + m["n"])
    found = checkpointed(found.select("g", "id", "leaf", "claimed", (F.col("before") + F.coalesce(smaller, below)).alias("at"), "total", F.coalesce(copies, F.lit(1)).alias("copies")))
    # rows of one id: equal ones are counted, then ordered by leaf within the leaf's first two bytes
    kinds = found.where("copies > 1").groupBy("g", "id", "leaf", "claimed", "at", "total").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.substring("leaf", 1, 2))
    kinds = checkpointed(kinds)
    sums = kinds.groupBy("g", "at", "p").agg(F.sum("n").alias("rows"))
    upto = Window.partitionBy("g", "at").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("g", "at", "p", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("g", "at", "p").orderBy("leaf", "claimed").rowsBetween(Window.unboundedPreceding, -1)
    first = kinds.withColumn("own", F.coalesce(F.sum("n").over(within), F.lit(0))).join(sums, ["g", "at", "p"])
    first = first.select("g", "id", "leaf", "claimed", "total", "n", (F.col("at") + F.col("ahead") + F.col("own")).alias("at"))
    parts = first.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {_COPIES}"))))
    each = parts.withColumn("k", F.explode(F.sequence(F.col("part") * _COPIES, F.least(F.col("n"), (F.col("part") + 1) * _COPIES) - 1)))
    again = each.select("g", "id", "leaf", "claimed", (F.col("at") + F.col("k")).alias("at"), "total")
    return found.where("copies = 1").drop("copies").unionByName(again)


# levels -------------------------------------------------------------------------------------------------------


def _hash(text: bytes) -> bytes:
    return hashlib.sha256(text).hexdigest().encode()


def _levels(nodes: list[bytes], total: int) -> list[list[bytes]]:
    """The block's nodes (hex digests) and the levels above them, up to its top."""
    levels = [nodes]
    for _ in range(LEVELS):
        if total <= SPAN and len(nodes) == 1:
            break
        nodes = [_hash(b"".join(nodes[i:i + RUN])) for i in range(0, len(nodes), RUN)]
        levels.append(nodes)
    return levels


def _parts(batches: Iterator[pa.RecordBatch], most: int = 256) -> Iterator[tuple[pa.RecordBatch, pa.StructArray]]:
    """A few blocks at a time, for bounded memory, with their slots one after the other."""
    for batch in batches:
        for a in range(0, batch.num_rows, most):
            part = batch.slice(a, most)
            yield part, part.column("slots").flatten()


def _arrays(part: pa.RecordBatch, slots: pa.StructArray) -> Iterator[tuple[int, list[int]]]:
    """Each block's row and its slots in order of place (the inverse of their keys)."""
    offsets = np.asarray(part.column("slots").offsets)
    offsets = (offsets - offsets[0]).tolist()
    slot = slots.field("slot").to_numpy(zero_copy_only=False)
    for row, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
        place = np.empty(b - a, np.int64)
        place[slot[a:b]] = np.arange(a, b)
        yield row, place.tolist()


def _hex(column: pa.Array) -> list[bytes | None]:
    return [None if v is None else v.hex().encode() for v in column.to_pylist()]


def _blocks(nodes: DataFrame, *carried: str) -> DataFrame:
    """Nodes (g, at, total, digest) in keyed slot arrays of SPAN consecutive places."""
    slot = F.struct((F.col("at") % SPAN).cast("int").alias("slot"), "digest", *carried)
    return checkpointed(nodes.groupBy("g", F.expr(f"at div {SPAN}").alias("block"), "total").agg(F.collect_list(slot).alias("slots")))


def _tops(blocks: DataFrame) -> DataFrame:
    """The blocks' top nodes, the nodes of the next round."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, slots in _parts(batches):
            digests = _hex(slots.field("digest"))
            totals = batch.column("total").to_pylist()
            tops = [bytes.fromhex(_levels([digests[i] for i in own], totals[row])[-1][0].decode()) for row, own in _arrays(batch, slots)]
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("block"), pa.array([-(-t // SPAN) for t in totals], pa.int64()), pa.array(tops, pa.binary())],
                                             names=["g", "at", "total", "digest"])

    return blocks.mapInArrow(run, "g string, at long, total long, digest binary")


def _climb(nodes: DataFrame, largest: int, *carried: str) -> tuple[list[DataFrame], DataFrame]:
    """The slot arrays of every round, and the roots: one node for each g."""
    rounds = [_blocks(nodes, *carried)]
    while largest > SPAN:
        rounds.append(_blocks(_tops(rounds[-1])))
        largest = -(-largest // SPAN)
    return rounds, _tops(rounds[-1]).select("g", "digest")


def _steps(levels: list[list[bytes]], slot: int) -> list[tuple[bytes, bytes]]:
    """The siblings left and right of a node and of those above it, up to below the block's top."""
    out = []
    for nodes in levels[:-1]:
        a = slot - slot % RUN
        out.append((b"".join(nodes[a:slot]), b"".join(nodes[slot + 1:a + RUN])))
        slot //= RUN
    return out


_STEPS = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
_STEPS_SQL = "array<struct<left:binary,right:binary>>"


def _described(steps: list[tuple[bytes, bytes]]) -> list[dict]:
    return [{"left": a, "right": b} for a, b in steps]


def _above(batch: pa.RecordBatch) -> list[list[tuple[bytes, bytes]]]:
    return [[(s["left"], s["right"]) for s in steps] for steps in batch.column("steps").to_pylist()]


def _down(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """The proof of each node of a round: that within its block, then its block's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, slots in _parts(batches):
            digests = _hex(slots.field("digest"))
            totals, blocks_, above_ = batch.column("total").to_pylist(), batch.column("block").to_pylist(), _above(batch)
            rows, at, steps = [], [], []
            for row, own in _arrays(batch, slots):
                levels = _levels([digests[i] for i in own], totals[row])
                for slot in range(len(own)):
                    rows.append(row)
                    at.append(blocks_[row] * SPAN + slot)
                    steps.append(_described(_steps(levels, slot) + above_[row]))
            of = lambda name: batch.column(name).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([of("g"), pa.array(at, pa.int64()), pa.array(steps, _STEPS), of("subroot"), of("root")],
                                             names=["g", "at", "steps", "subroot", "root"])

    joined = blocks.join(above.withColumnRenamed("at", "block"), ["g", "block"])
    return joined.mapInArrow(run, f"g string, at long, steps {_STEPS_SQL}, subroot binary, root binary")


def _leaves(blocks: DataFrame, above: DataFrame, with_proofs: bool) -> DataFrame:
    """Each leaf's row: its proof's digest, and the root folded from its claimed leaf."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, slots in _parts(batches):
            digests, claimed = _hex(slots.field("digest")), _hex(slots.field("claimed"))
            ids, totals, above_ = slots.field("id"), batch.column("total").to_pylist(), _above(batch)
            rows, order, sha, folded, proofs = [], [], [], [], []
            for row, own in _arrays(batch, slots):
                levels = _levels([digests[i] for i in own], totals[row])
                rest = b"".join(a + b for a, b in above_[row])
                for slot, i in enumerate(own):
                    inside = _steps(levels, slot)
                    node = claimed[i] or digests[i]
                    for a, b in inside:
                        node = _hash(a + node + b)
                    for a, b in above_[row]:
                        node = _hash(a + node + b)
                    sha.append(hashlib.sha256(b"".join(a + b for a, b in inside) + rest).hexdigest())
                    folded.append(node)
                    proofs.append(_described(inside + above_[row]) if with_proofs else None)
                rows += [row] * len(own)
                order += own
            of = lambda name: batch.column(name).take(pa.array(rows, pa.int64()))
            leaf = slots.field("digest").take(pa.array(order, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [of("g"), ids.take(pa.array(order, pa.int64())), leaf, of("subroot"), of("root"), pa.array(sha),
                 pa.array([f.decode() for f in folded]), pa.array(proofs, _STEPS)],
                names=["g", "id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "proof"])

    joined = blocks.join(above.withColumnRenamed("at", "block"), ["g", "block"])
    return joined.mapInArrow(run, f"g string, id long, leaf binary, subroot binary, root binary, proof_sha256 string, folded_root string, proof {_STEPS_SQL}")


def _ranked(roots: DataFrame) -> DataFrame:
    """The groups' roots with `at`, their place by key, and `total`: a sort over ranges, then the rows of the ranges before."""
    rows = checkpointed(roots.orderBy("g").withColumn("n", F.monotonically_increasing_id())).withColumn("part", F.shiftright("n", 33))
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))  # at most one a partition of the sort
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("ahead"), F.sum("rows").over(Window.partitionBy()).alias("total"))
    return rows.join(parts, "part").select("g", "digest", (F.col("ahead") + F.col("n").bitwiseAND((1 << 33) - 1)).alias("at"), "total")


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, id: str = "doc_id", group: str = "source",
             claimed: tuple[Column, dict[str, Column]] | None = None, with_proofs: bool = True) -> DataFrame:
    """One row per document: `id`, `group`, leaf, subroot, root, proof_sha256, folded_root, verified, proof.

    A leaf is the digest of `columns`. A group's leaves ascend by `id`; runs of three consecutive nodes
    become the digest of their joined hex digests until one is left, the subroot; groups' subroots, null
    first, then bytewise, likewise give the root. `proof` holds the siblings left and right of the leaf and of
    each node above it (null without `with_proofs`), `proof_sha256` the digest of all of them in a row.
    `claimed` is a condition and the columns' values then claimed: where it holds, `folded_root` is
    folded from the leaf of those, else from the row's own. `verified` tells whether that is the root.

    Null ids come first in their group; rows of one id stand by leaf; equal rows are separate leaves; a null
    group is a group of its own; texts of any length are hashed whole, empty ones as `0:`; an empty table
    gives no rows; further columns are left out.
    """
    own = [F.col(c) for c in columns]
    leaf = leaf_of(own)
    other = F.lit(None).cast("binary")
    if claimed is not None:
        other = F.when(claimed[0], leaf_of([claimed[1].get(c, F.col(c)) for c in columns]))
    key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    rows = docs.select(key.alias("g"), F.col(id).cast("long").alias("id"), leaf.alias("leaf"), other.alias("claimed"))
    nodes = placed(rows).withColumnRenamed("leaf", "digest")
    arrays = _blocks(nodes, "id", "claimed")
    largest = arrays.agg(F.max("total")).first()[0] or 0
    rounds = [arrays]
    if largest > SPAN:
        more, roots = _climb(_tops(arrays), -(-largest // SPAN))
        rounds += more
    else:
        roots = _tops(arrays).select("g", "digest")
    groups = checkpointed(_ranked(roots))
    n = groups.agg(F.max("total")).first()[0] or 0
    up, root = _climb(groups.select(F.lit("").alias("g"), "at", "total", "digest"), n)
    none = F.array().cast(_STEPS_SQL)
    proofs = root.select("g", F.lit(0).cast("long").alias("at"), none.alias("steps"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    for blocks in reversed(up):
        proofs = _down(blocks, proofs)
    proofs = groups.select("g", "at", F.col("digest").alias("own")).join(proofs.drop("g"), "at").select("g", F.lit(0).cast("long").alias("at"), "steps", F.col("own").alias("subroot"), "root")
    for blocks in reversed(rounds[1:]):
        proofs = _down(blocks, proofs)
    found = _leaves(arrays, proofs, with_proofs)
    text = lambda name: F.lower(F.hex(name)).alias(name)
    value = F.when(F.col("g").startswith("1"), F.expr("substring(g, 2)")).cast(docs.schema[group].dataType)
    return found.select(F.col("id").alias(id), value.alias(group), text("leaf"), text("subroot"), text("root"), "proof_sha256", "folded_root",
                        (F.col("folded_root") == F.lower(F.hex("root"))).alias("verified"), "proof")
