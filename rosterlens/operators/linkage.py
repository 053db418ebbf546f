"""Record linkage within blocks: similarity matches, a token pass and one-to-one assignment."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.edits import distances, nearest_two
from ..functions.text import edit_similarity, grams, tokens_contained
from ..scale import lookup, numbered, partitions, salted_join
from ..session import checkpointed

# Acceptance score and margin of the first provider, score of the second.
ACCEPT, MARGIN, ACCEPT_SECOND = 0.85, 0.05, 0.75
#: Texts of one tile.
TILE = 2048


def _named(left: DataFrame, block: Sequence[str], id: str, names: Sequence[str]) -> DataFrame:
    """A row's different names that are not empty."""
    return left.select(*block, id, F.explode(F.array_distinct(F.array_compact(F.array(*names)))).alias("_name")).filter("_name <> ''")


def indexed_scores(asked: DataFrame, targets: DataFrame, block: Sequence[str], id: str, other: str, floor: float, size: int = 2,
                   rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Every pair of a block whose similarity reaches `floor`, found through rare grams; and the ids with a name too short for that.

    Within k edits two texts differ in at most k times `size` grams, so they share one of the first k * size + 1 of each,
    counted from the rarest in the block. k is bounded by a text's own length, as the other is at most 1 / floor times as long.
    A name with no more grams than that has no such guarantee: its id is left to other means.
    """
    limit = F.floor((1 - floor) / floor * F.length("_text") + 1e-9) * size + 1

    def prefix(texts: DataFrame, keep: Sequence[str]) -> DataFrame:
        spread = texts.select(*block, *keep, F.col(keep[-1]).alias("_text")).withColumn("_gram", F.explode(grams(F.col("_text"), size)))
        # the whole table of counts holds each gram of a block once
        counted = lookup(spread, common, [*block, "_gram"])
        order = F.array_sort(F.collect_list(F.struct(F.coalesce("_held", F.lit(0)).alias("n"), F.col("_gram").alias("g"))))
        ranked = counted.groupBy(*block, *keep, "_text").agg(order.alias("_all"))
        return ranked.select(*block, *keep, F.explode(F.slice("_all", F.lit(1), limit.cast("int"))).alias("_g")).select(*block, *keep, F.col("_g.g").alias("_gram"))

    of_targets = targets.select(*block, "_target").distinct()
    common = of_targets.select(*block, F.explode(grams(F.col("_target"), size)).alias("_gram")).groupBy(*block, "_gram").agg(F.count(F.lit(1)).alias("_held"))
    names = asked.select(*block, "_name").distinct()
    met = salted_join(prefix(names, ["_name"]), prefix(of_targets, ["_target"]), [*block, "_gram"], None, ["_name"], rows).select(*block, "_name", "_target").distinct()
    near = F.least(F.length("_name"), F.length("_target")) >= floor * F.greatest(F.length("_name"), F.length("_target")) - 1e-9
    scored = met.filter(near).withColumn("score", edit_similarity(F.col("_name"), F.col("_target"))).filter(F.col("score") >= floor - 1e-12)
    pairs = asked.join(scored, [*block, "_name"]).join(targets, [*block, "_target"]).groupBy(*block, id, other).agg(F.max("score").alias("score"))
    short = asked.withColumn("_text", F.col("_name")).filter(F.length("_name") - size + 1 < limit).select(id).distinct()
    return pairs, short


def _whole_block(asked: DataFrame, targets: DataFrame, block: Sequence[str], id: str, other: str, rows: int | None) -> DataFrame:
    """All pairs of the asked rows with their block, each row's best kept as they come."""
    met = salted_join(asked, targets, list(block), None, ["_name"], rows)
    return met.withColumn("score", edit_similarity(F.col("_name"), F.col("_target"))).groupBy(*block, id, other).agg(F.max("score").alias("score"))


def _dealt_texts(texts: DataFrame, block: Sequence[str], text: str, tile: str, most: int) -> DataFrame:
    """The texts of a block dealt to tiles of about `most`, with their tile and the number of tiles."""
    sized = texts.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(f"{tile}s"))
    return lookup(texts, sized, block, "inner").withColumn(tile, F.pmod(F.xxhash64(text), F.col(f"{tile}s")).cast("int"))


def best_two(left: DataFrame, right: DataFrame, block: Sequence[str], id: str, other: str, names: Sequence[str], target: str,
             rows: int | None = None) -> DataFrame:
    """Each row's two most similar candidates of its block over all its names: id, other, score, place (1, 2).

    Ties go to the smaller `other`. Names are folded already. A block's different names and its different targets are
    dealt to tiles (of `rows` texts, TILE by default); a task holds one tile of each and hands on two candidates a name.
    A target's two smallest `other`s suffice, as do each name's best two.
    """
    block, most = list(block), rows or TILE
    targets = checkpointed(right.select(*block, other, F.col(target).alias("_target")).filter("_target <> ''").dropna(subset=block).distinct())
    coded = checkpointed(numbered(targets.select(*block, other).distinct(), block, [other], "_code", rows))
    same = [targets[c] == coded[c] for c in block]
    held = targets.join(coded, [*same, targets[other].eqNullSafe(coded[other])]).select(*[targets[c] for c in block], "_target", "_code")
    w = Window.partitionBy(*block, "_target").orderBy("_code")
    held = held.withColumn("_n", F.row_number().over(w)).filter("_n <= 2").groupBy(*block, "_target").agg(F.collect_list("_code").alias("_codes"))
    held = checkpointed(_dealt_texts(held, block, "_target", "_two", most))
    asked = checkpointed(_named(left, block, id, names))
    texts = checkpointed(_dealt_texts(asked.select(*block, "_name").distinct().dropna(subset=block), block, "_name", "_one", most))
    ones, twos = (x.groupBy(*block).agg(F.max(f"{c}s").alias(f"{c}s")) for x, c in ((texts, "_one"), (held, "_two")))
    parts = lookup(ones, twos, block, "inner").agg(F.sum(F.col("_ones").cast("long") * F.col("_twos"))).first()[0] or 1
    # enough tasks for the work, which is a tile pair's and not its bytes'
    tasks = min(max(partitions(left), parts // 16), 100 * partitions(left))
    key = [*block, "_one", "_two"]
    texts = lookup(texts.drop("_ones"), twos, block, "inner").withColumn("_two", F.explode(F.sequence(F.lit(0), F.col("_twos") - 1))).drop("_twos")
    held = lookup(held.drop("_twos"), ones, block, "inner").withColumn("_one", F.explode(F.sequence(F.lit(0), F.col("_ones") - 1))).drop("_ones")

    def met(group: pa.Table, others: pa.Table) -> pa.Table:
        asked, at, code, score = [], [], [], []
        if group.num_rows and others.num_rows:
            asked = group.column("_name").to_pylist()
            at, code, score = nearest_two(asked, others.column("_target").to_pylist(), others.column("_codes").to_pylist())
        kept = group.select(block).take(pa.array(at, pa.int64()))
        for name, values in (("_name", pa.array([asked[i] for i in at], pa.string())), ("_code", pa.array(code, pa.int64())), ("score", pa.array(score, pa.float64()))):
            kept = kept.append_column(name, values)
        return kept

    schema = StructType([*(texts.schema[c] for c in block), StructField("_name", StringType()), StructField("_code", LongType()), StructField("score", DoubleType())])
    pairs = texts.repartition(tasks, *key).groupBy(*key).cogroup(held.repartition(tasks, *key).groupBy(*key)).applyInArrow(met, schema)
    order = [F.desc("score"), "_code"]
    few = pairs.withColumn("_n", F.row_number().over(Window.partitionBy(*block, "_name").orderBy(*order))).filter("_n <= 2").drop("_n")
    each = asked.join(checkpointed(few), [*block, "_name"]).groupBy(*block, id, "_code").agg(F.max("score").alias("score"))
    each = each.withColumn("_n", F.row_number().over(Window.partitionBy(*block, id).orderBy(*order))).filter("_n <= 2")
    every = each.join(coded, [*block, "_code"]).select(id, other, "score")
    w = Window.partitionBy(id).orderBy(F.desc("score"), other)
    return every.withColumn("place", F.row_number().over(w)).filter("place <= 2")


def block_edits(left: DataFrame, right: DataFrame, block: Sequence[str], id: str, other: str, name: str, target: str, rows: int | None = None) -> DataFrame:
    """The edits between the texts of every pair of a block: id, other, edits; null where a text is.

    Both sides are dealt to tiles of at most about `rows` (TILE by default); a task holds one tile of each, meets each different
    text once and hands on a row for each pair. There are as many rows as pairs; repeated rows count, rows without a block stay out.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    block, most = list(block), rows or TILE

    def dealt(side: DataFrame, key: str, text: str, tile: str) -> tuple[DataFrame, DataFrame]:
        held = side.select(*block, F.col(key).alias("_key"), F.col(text).alias("_text")).dropna(subset=block)
        sized = held.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(f"{tile}s"))
        # by place, so that equal rows part
        return held.withColumn("_place", F.monotonically_increasing_id()), checkpointed(sized)

    (texts, ones), (held, twos) = dealt(left, id, name, "_one"), dealt(right, other, target, "_two")
    sizes = lookup(ones, twos, block, "inner")
    pairs = sizes.agg(F.sum(F.col("_ones").cast("long") * F.col("_twos"))).first()[0] or 1
    tasks = min(max(partitions(left), pairs), 100 * partitions(left))
    key = [*block, "_one", "_two"]

    def beside(side: DataFrame, own: str, others: str) -> DataFrame:
        tiled = lookup(side, sizes, block, "inner").withColumn(own, F.pmod(F.col("_place"), F.col(f"{own}s")).cast("int"))
        return tiled.select(*block, "_key", "_text", own, F.explode(F.sequence(F.lit(0), F.col(f"{others}s") - 1)).alias(others)).repartition(tasks, *key)

    kinds = [to_arrow_type(side.schema[c].dataType) for side, c in ((left, id), (right, other))]

    def met(one: pa.Table, two: pa.Table) -> pa.Table:
        n, m = one.num_rows, two.num_rows
        a, b = (t.column("_text").combine_chunks().dictionary_encode() for t in (one, two))
        found = np.zeros((len(a.dictionary) + 1, len(b.dictionary) + 1), np.int32)
        if len(a.dictionary) and len(b.dictionary):
            for at, edits in distances(a.dictionary.to_pylist(), b.dictionary.to_pylist()):
                found[at, :-1] = edits
        x, y = (c.indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in (a, b))
        none = ((x < 0)[:, None] | (y < 0)).ravel()
        ids, others = (t.column("_key").combine_chunks().take(pa.array(at)) for t, at in ((one, np.repeat(np.arange(n), m)), (two, np.tile(np.arange(m), n))))
        return pa.table([ids.cast(kinds[0]), others.cast(kinds[1]), pa.array(found[x][:, y].ravel(), pa.int32(), mask=none if none.any() else None)], names=[id, other, "edits"])

    schema = StructType([left.schema[id], right.schema[other], StructField("edits", IntegerType())])
    return beside(texts, "_one", "_two").groupBy(*key).cogroup(beside(held, "_two", "_one").groupBy(*key)).applyInArrow(met, schema)


def at_least(left: DataFrame, right: DataFrame, block: Sequence[str], id: str, other: str, names: Sequence[str], target: str, floor: float,
             rows: int | None = None) -> DataFrame:
    """Every pair of a row and a candidate of its block whose similarity over all its names reaches `floor`."""
    targets = right.select(*block, other, F.col(target).alias("_target")).filter("_target <> ''")
    asked = checkpointed(_named(left, block, id, names))
    pairs, short = indexed_scores(asked, targets, block, id, other, floor, rows=rows)
    few = checkpointed(short)
    rest = _whole_block(asked.join(few, id, "left_semi"), targets, block, id, other, rows).filter(F.col("score") >= floor - 1e-12)
    return pairs.join(few, id, "left_anti").unionByName(rest)


def match_with_margin(left: DataFrame, best: DataFrame, id: str, other: str, accept: float = ACCEPT,
                      margin: float = MARGIN) -> DataFrame:
    """Matched when the best score is high enough and clear of the second (0 without one); else ambiguous, or
    unmatched. `best` holds each row's best two candidates, as best_two() gives them."""
    top = best.groupBy(id).agg(
        F.max(F.when(F.col("place") == 1, F.col(other))).alias("linked"),
        F.max(F.when(F.col("place") == 1, F.col("score"))).alias("score"),
        F.max(F.when(F.col("place") == 2, F.col("score"))).alias("second"))
    out = left.join(top, id, "left")
    one, second = F.coalesce("score", F.lit(0.0)), F.coalesce("second", F.lit(0.0))
    status = (F.when((one >= accept) & (one - second >= margin - 1e-12), "matched")
              .when(one >= accept, "ambiguous").otherwise("unmatched"))
    out = out.withColumns({"score": one, "second": second, "status": status})
    return out.withColumn("linked", F.when(F.col("status") == "matched", F.col("linked")))


def match_unique_hit(left: DataFrame, scores: DataFrame, candidates: DataFrame, block: Sequence[str], id: str,
                     other: str, accept: float = ACCEPT_SECOND) -> DataFrame:
    """Linked when exactly one candidate of the block scores high enough."""
    hits = scores.filter(F.col("score") >= accept).groupBy(id).agg(
        F.count(F.lit(1)).alias("hits"), F.min(other).alias("_other"))
    held = candidates.select(*block).distinct().withColumn("_held", F.lit(True))
    out = left.join(hits, id, "left").join(held, list(block), "left")
    n = F.coalesce("hits", F.lit(0))
    status = (F.when(n == 1, "linked").when(n > 1, "ambiguous")
              .when(F.col("_held"), "below_threshold").otherwise("no_candidate"))
    out = out.withColumns({"hits": n, "status": status})
    return out.withColumn("linked", F.when(F.col("status") == "linked", F.col("_other"))).drop("_other", "_held")


def token_pass(links: DataFrame, candidates: DataFrame, block: Sequence[str], id: str, other: str, name: str,
               targets: Sequence[str], open_status: Sequence[str], least: int = 2,
               rows: int | None = None) -> DataFrame:
    """Open rows with exactly one candidate whose names hold all their tokens are linked in a
    second pass; rows of the first pass stay as they are.

    A name of a block meets only the names there that share its rarest token, each once however many
    rows have it; of a name's candidates the least and the greatest say whether there is one.
    """
    open_rows = links.filter(F.col("status").isin(*open_status)).select(*block, id, name)
    tokens = F.array_distinct(F.filter(F.split(F.concat_ws(" ", *targets), " "), lambda t: t != ""))
    named = candidates.groupBy(*block, *targets).agg(F.min(other).alias("_least"), F.max(other).alias("_most"))
    spread = named.withColumn("_token", F.explode(tokens))
    common = spread.groupBy(*block, "_token").agg(F.count(F.lit(1)).alias("_held"))
    asked = open_rows.select(*block, name).distinct()
    own = asked.withColumn("_token", F.explode(F.array_distinct(F.split(name, " "))))
    rarest = own.join(common, [*block, "_token"], "left").groupBy(*block, name).agg(
        F.min(F.struct(F.coalesce("_held", F.lit(0)).alias("n"), F.col("_token").alias("t"))).alias("_r"))
    probe = rarest.filter("_r.n > 0").select(*block, name, F.col("_r.t").alias("_token"))
    met = salted_join(probe, spread, [*block, "_token"], None, [name], rows)
    hit = met.filter(tokens_contained(F.col(name), [F.col(t) for t in targets], least))
    ends = [F.min("_least").alias("_least"), F.max("_most").alias("_most")]
    hit = hit.groupBy(*block, name).agg(*ends)
    one = open_rows.join(hit, [*block, name]).groupBy(id).agg(*ends).filter("_least = _most").withColumnRenamed("_least", "_found")
    out = links.join(one.select(id, "_found"), id, "left")
    fresh = F.col("_found").isNotNull()
    return out.withColumns({
        "linked": F.when(fresh, F.col("_found")).otherwise(F.col("linked")),
        "link_pass": F.when(fresh, 2).when(F.col("linked").isNotNull(), 1),
        "status": F.when(fresh, "matched").otherwise(F.col("status"))}).drop("_found")


def name_overlap(map_: DataFrame, players: DataFrame, candidates: DataFrame, league: str, team: str, club: str,
                 names: Sequence[str], target: str, id: str) -> DataFrame:
    """Per team the players whose folded name is one of the mapped club's, and the largest such
    count at any other club of the league."""
    long = players.select(league, team, id, F.explode(F.array_compact(F.array(*names))).alias("_name"))
    c = candidates.select(league, club, F.col(target).alias("_name")).distinct()
    hits = long.join(c, [league, "_name"]).select(league, team, club, id).distinct().groupBy(league, team, club).agg(
        F.count(F.lit(1)).alias("n"))
    marked = hits.join(map_.select(league, team, F.col(club).alias("_own")), [league, team])
    out = marked.groupBy(league, team).agg(
        F.max(F.when(F.col(club) == F.col("_own"), F.col("n"))).alias("own"),
        F.max(F.when(F.col(club) != F.col("_own"), F.col("n"))).alias("other"))
    return map_.select(league, team).join(out, [league, team], "left").na.fill(0, ["own", "other"])


def independent_best(scores: DataFrame, block: Sequence[str], row: str, column: str) -> DataFrame:
    """Each row's best column on its own, ties to the lower column."""
    return scores.groupBy(*block, row).agg(
        F.min_by(column, F.struct(-F.col("score"), F.col(column))).alias("best"))


def assign(scores: DataFrame, block: Sequence[str], row: str, column: str, digits: int = 6,
           most: int = 10_000) -> DataFrame:
    """One-to-one assignment of rows to columns within blocks that maximises the summed score.

    Auction rounds: each free row bids for the column worth most to it, a column keeps its highest
    bid and frees its former row. Scores count in whole steps of 10^-digits times (rows + 1), so a
    bid raise of one step makes the end result exact. Each row needs a score for every column of its block (missing ones count as a score of 0).
    Raises when a block has more rows than columns, and when `most` rounds leave rows without a column.
    """
    sizes = scores.groupBy(*block).agg(F.countDistinct(row).alias("_rows"), F.countDistinct(column).alias("_columns"))
    if sizes.filter("_rows > _columns").limit(1).count():
        raise ValueError("a block has more rows than columns")
    scaled = scores.withColumn("_v", F.round(F.col("score") * 10**digits).cast("long"))
    n = scaled.select(*block, row).distinct().groupBy(*block).agg((F.count(F.lit(1)) + 1).alias("_steps"))
    values = checkpointed(scaled.join(n, list(block)).select(
        *block, row, column, (F.col("_v") * F.col("_steps")).alias("_v")))
    held = values.select(*block, column).distinct().withColumns(
        {"_price": F.lit(0).cast("long"), "_row": F.lit(None).cast(dict(values.dtypes)[row])})
    rows = values.select(*block, row).distinct()
    for _ in range(most):
        taken = held.filter("_row is not null").select(*block, F.col("_row").alias(row))
        free = rows.join(taken, [*block, row], "left_anti")
        worth = values.join(free, [*block, row]).join(held.drop("_row"), [*block, column])
        w = Window.partitionBy(*block, row).orderBy(F.desc(F.col("_v") - F.col("_price")), column)
        best = worth.withColumn("_n", F.row_number().over(w)).filter("_n <= 2").groupBy(*block, row).agg(
            F.max(F.when(F.col("_n") == 1, F.struct(column, "_price", (F.col("_v") - F.col("_price")).alias("_w")))).alias("_a"),
            F.max(F.when(F.col("_n") == 2, F.col("_v") - F.col("_price"))).alias("_b"))
        gain = F.col("_a._w") - F.coalesce("_b", F.col("_a._w"))
        bids = best.select(*block, row, F.col(f"_a.{column}").alias(column), (F.col("_a._price") + gain + 1).alias("_bid"))
        top = bids.groupBy(*block, column).agg(F.max(F.struct("_bid", row)).alias("_t"))
        nxt = held.join(top, [*block, column], "left")
        held_next = checkpointed(nxt.select(
            *block, column, F.coalesce("_t._bid", "_price").alias("_price"),
            F.coalesce(f"_t.{row}", "_row").alias("_row"), F.col("_t").isNotNull().alias("_moved")))
        moved = held_next.filter("_moved").limit(1).count()
        held = held_next.drop("_moved")
        if not moved:
            break
    else:
        raise RuntimeError(f"assignment unfinished after {most} rounds")
    return held.filter("_row is not null").select(*block, F.col("_row").alias(row), column)


def season_candidates(rows: DataFrame, block: Sequence[str], id: str, columns: Sequence[str]) -> DataFrame:
    """Distinct candidates seen per block."""
    return rows.select(*block, id, *columns).distinct()


def main_league(rows: DataFrame, player: str, league: str, minutes: str) -> DataFrame:
    """Total minutes and the league of a player's largest row."""
    return rows.groupBy(player).agg(
        F.sum(minutes).alias("minutes"), F.min_by(league, F.struct(-F.col(minutes), league)).alias("league"))

