"""Co-event graphs: partners, links, neighbourhood means and link prediction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import dot
from ..scale import lookup, numbered, value_ranks
from ..session import checkpointed
from .resample import hashed

# Least count of a partner, partners kept per node.
LEAST = 3
PARTNERS = 5


def unordered(rows: DataFrame, x: str, y: str) -> DataFrame:
    """The pair's key: lower end first."""
    a, b = F.col(x), F.col(y)
    return rows.withColumns({"player_a": F.least(a, b), "player_b": F.greatest(a, b)})


def pass_counts(passes: DataFrame, block: Sequence[str], player: str = "player",
                receiver: str = "receiver") -> DataFrame:
    """Passes between each unordered pair; both directions are combined map-side."""
    given = passes.filter(F.col(receiver).isNotNull())
    return unordered(given, player, receiver).groupBy(*block, "player_a", "player_b").agg(
        F.count(F.lit(1)).alias("n"))


def both_ends(pairs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Each pair seen from both of its nodes."""
    sides = F.array(F.struct(F.col("player_a").alias("node"), F.col("player_b").alias("partner")),
                    F.struct(F.col("player_b").alias("node"), F.col("player_a").alias("partner")))
    return pairs.select(*keep, F.inline(sides))


def kept_links(counts: DataFrame, block: Sequence[str], n: str = "n", least: int = LEAST,
               partners: int = PARTNERS) -> DataFrame:
    """Each node keeps its most frequent partners, ties to the lower id; either end's choice links."""
    ends = both_ends(counts.filter(F.col(n) >= least), [*block, n])
    w = Window.partitionBy(*block, "node").orderBy(F.desc(n), "partner")
    top = ends.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= partners)
    return unordered(top, "node", "partner").select(*block, "player_a", "player_b").distinct()


def merged_kinds(passes: DataFrame, presses: DataFrame, block: Sequence[str], least: int = LEAST,
                 partners: int = PARTNERS) -> DataFrame:
    """Links of either kind with the kind and both counts, 0 where a pair has none."""
    pair = [*block, "player_a", "player_b"]
    a = kept_links(passes, block, least=least, partners=partners).withColumn("_p", F.lit(True))
    b = kept_links(presses, block, least=least, partners=partners).withColumn("_q", F.lit(True))
    kind = F.when(F.col("_q").isNull(), "pass").when(F.col("_p").isNull(), "press").otherwise("both")
    out = a.join(b, pair, "full_outer").withColumn("kind", kind).drop("_p", "_q")
    out = out.join(passes.withColumnRenamed("n", "n_pass"), pair, "left")
    out = out.join(presses.withColumnRenamed("n", "n_press"), pair, "left")
    return out.na.fill(0, ["n_pass", "n_press"])


def degrees(nodes: DataFrame, links: DataFrame, block: Sequence[str], node: str) -> DataFrame:
    per = both_ends(links, block).groupBy(*block, F.col("node").alias(node)).agg(F.count(F.lit(1)).alias("links"))
    return nodes.join(per, [*block, node], "left").withColumn("links", F.coalesce("links", F.lit(0)))


def link_report(nodes: DataFrame, links: DataFrame, league: str, block: Sequence[str], node: str) -> DataFrame:
    """Per league and in all: nodes, links by kind, mean degree and nodes without links."""
    d = degrees(nodes, links, block, node).rollup(league).agg(
        F.count(F.lit(1)).alias("nodes"), F.avg("links").alias("mean_degree"),
        F.count_if(F.col("links") == 0).alias("isolated"))
    kinds = links.rollup(league).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("pass", "press", "both")])
    a, b = d.alias("a"), kinds.alias("b")
    out = a.join(b, F.col(f"a.{league}").eqNullSafe(F.col(f"b.{league}")), "left")
    return out.select(f"a.{league}", "nodes", "mean_degree", "isolated",
                      *[F.coalesce(k, F.lit(0)).alias(k) for k in ("pass", "press", "both")])


def unlinked_counts(nodes: DataFrame, links: DataFrame, block: Sequence[str]) -> DataFrame:
    """Pairs of a block that are no links, counted as all pairs less the links."""
    n = F.col("_n")
    all_pairs = nodes.groupBy(*block).agg(F.count(F.lit(1)).alias("_n")).select(
        *block, F.floor(n * (n - 1) / 2).alias("pairs"))
    held = links.groupBy(*block).agg(F.count(F.lit(1)).alias("linked"))
    out = all_pairs.join(held, list(block), "left").withColumn("linked", F.coalesce("linked", F.lit(0)))
    return out.withColumn("unlinked", F.col("pairs") - F.col("linked"))


def neighbour_means(features: DataFrame, edges: DataFrame, columns: Sequence[str], node: str = "node") -> DataFrame:
    """Own features next to the mean of the neighbours', 0 for a node without any.

    ``edges`` holds both directions (node, partner); means are combined map-side, so a hub's
    neighbours are not gathered.
    """
    sent = features.select(F.col(node).alias("partner"), *columns)
    got = lookup(edges.select(node, "partner"), sent, ["partner"], "inner").groupBy(node).agg(
        *[F.avg(c).alias(f"near_{c}") for c in columns])
    out = lookup(features, got, [node])
    return out.withColumns({f"near_{c}": F.coalesce(f"near_{c}", F.lit(0.0)) for c in columns})


def two_hop(features: DataFrame, edges: DataFrame, columns: Sequence[str], node: str = "node") -> DataFrame:
    """Neighbourhood means taken twice: a node's own features, its neighbours' (near_) and the neighbours' of those (near_hop_)."""
    one = checkpointed(neighbour_means(features, edges, columns, node))
    hop = neighbour_means(one.select(node, *[F.col(f"near_{c}").alias(f"hop_{c}") for c in columns]), edges, [f"hop_{c}" for c in columns], node)
    return lookup(one, hop.drop(*[f"hop_{c}" for c in columns]), [node])


def split_links(links: DataFrame, pair: Sequence[str], share: float, seed: int = 0) -> DataFrame:
    """Flags about ``share`` of the links as hidden, by a hash of the pair."""
    h = hashed(F.lit(seed), *[F.col(c) for c in pair])
    return links.withColumn("hidden", h < F.lit(int(share * 2**32)))


def node_features(rows: DataFrame, node: str, group: str, groups: Sequence, values: dict[str, Column], minutes: Column) -> DataFrame:
    """Per node: its group, the one of most `minutes` (ties to the first name), as indicators, and means of the values.

    A node with no group, or one that is not listed, is UNKNOWN; a node without any value has a mean of 0.
    """
    cells = rows.groupBy(node, group).agg(F.sum(minutes).alias("_m"), *[F.sum(c).alias(f"_s_{n}") for n, c in values.items()], *[F.count(c).alias(f"_n_{n}") for n, c in values.items()])
    known = F.col(group).isin(*groups)
    per = cells.groupBy(node).agg(
        F.min_by(group, F.when(known, F.struct(-F.col("_m"), F.col(group)))).alias("_g"), F.max(known.cast("int")).alias("_known"),
        *[F.coalesce(F.try_divide(F.sum(f"_s_{n}"), F.sum(f"_n_{n}")), F.lit(0.0)).alias(n) for n in values])
    named = F.when(F.col("_known") == 1, F.col("_g").cast("string")).otherwise(F.lit("UNKNOWN"))
    return per.select(node, *values, *[(named == str(g)).cast("int").alias(f"is_{g}") for g in [*groups, "UNKNOWN"]])


def balanced_negatives(nodes: DataFrame, links: DataFrame, wanted: DataFrame, block: Sequence[str], node: str, seed: int = 0, rounds: int = 20) -> DataFrame:
    """Unlinked pairs of each block, as many as `wanted` (block, n) asks, drawn by hash in rounds.

    Draw s of a block names two different places among its nodes; the first draws that are neither links nor repeats are
    kept in order, so the result does not depend on how many draws a round takes. Blocks still short draw twice as many in
    the next round. A block with fewer than twice as many unlinked pairs as asked has less than three times as many pairs as
    links or asked pairs: all its unlinked pairs are listed, and the first taken in hash order, or all if there are no more.
    Raises when the rounds do not suffice.
    """
    n = checkpointed(numbered(nodes.select(*block, node).distinct(), block, [node], "_at"))
    asked = wanted.select(*block, F.col("n").alias("_want")).filter("_want > 0")
    own = links.select(*block, "player_a", "player_b").distinct()
    sized = n.groupBy(*block).agg(F.max("_at").alias("_n"))
    linked = own.groupBy(*block).agg(F.count(F.lit(1)).alias("_links"))
    sized = checkpointed(asked.join(sized, list(block)).join(linked, list(block), "left").withColumn("_free", F.expr("_n * (_n - 1) div 2") - F.coalesce("_links", F.lit(0))))
    dense = sized.filter("_free < 2 * _want").select(*block, "_want")
    listed = n.join(dense, list(block)).withColumnRenamed(node, "_x").join(n.select(*block, F.col(node).alias("_y"), F.col("_at").alias("_to")), list(block)).filter("_at < _to")
    listed = listed.select(*block, "_want", F.least("_x", "_y").alias("player_a"), F.greatest("_x", "_y").alias("player_b")).join(own, [*block, "player_a", "player_b"], "left_anti")
    listed = listed.withColumn("_h", hashed(F.lit(seed), *[F.col(c) for c in block], F.col("player_a"), F.col("player_b")))
    listed = numbered(listed, block, ["_h", "player_a", "player_b"], "_place").filter("_place <= _want").select(*block, "player_a", "player_b")
    sized = sized.filter("_free >= 2 * _want")
    todo, found, first, each = sized.select(*block, "_n", "_want"), None, 0, 2
    for _ in range(rounds):
        # slots are counted per block from `first` times what it wants on, so that rounds never overlap
        slots = todo.withColumn("_slot", F.explode(F.sequence(F.col("_want") * first, F.col("_want") * (first + each) - 1)))
        keys = [F.lit(seed), *[F.col(c) for c in block], F.col("_slot")]
        one = F.pmod(hashed(*keys, F.lit("a")), F.col("_n")) + 1
        two = 1 + F.pmod(one + F.pmod(hashed(*keys, F.lit("b")), F.col("_n") - 1), F.col("_n"))
        drawn = slots.select(*block, "_slot", F.least(one, two).alias("_i"), F.greatest(one, two).alias("_j"))
        drawn = drawn.groupBy(*block, "_i", "_j").agg(F.min("_slot").alias("_slot"))
        ends = lookup(lookup(drawn, n.withColumnsRenamed({node: "_x", "_at": "_i"}), [*block, "_i"], "inner"), n.withColumnsRenamed({node: "_y", "_at": "_j"}), [*block, "_j"], "inner")
        pairs = ends.select(*block, "_slot", F.least("_x", "_y").alias("player_a"), F.greatest("_x", "_y").alias("player_b"))
        fresh = pairs.join(own, [*block, "player_a", "player_b"], "left_anti")
        every = fresh if found is None else found.unionByName(fresh).groupBy(*block, "player_a", "player_b").agg(F.min("_slot").alias("_slot"))
        found = checkpointed(every.select(*block, "_slot", "player_a", "player_b"))
        have = found.groupBy(*block).agg(F.count(F.lit(1)).alias("_have"))
        todo = checkpointed(sized.select(*block, "_n", "_want").join(have, list(block), "left").filter(F.coalesce("_have", F.lit(0)) < F.col("_want")).drop("_have"))
        if todo.isEmpty():
            break
        first, each = first + each, 2 * each
    else:
        raise RuntimeError(f"too few unlinked pairs after {rounds} rounds")
    placed = numbered(found, block, ["_slot"], "_place").join(asked, list(block))
    return placed.filter("_place <= _want").select(*block, "player_a", "player_b").unionByName(listed)


def learned_link_scores(train: DataFrame, test: DataFrame, vectors: DataFrame, id: str, vector: str, label: str = "y", penalty: float = 1e-3) -> DataFrame:
    """The test pairs with `score`: a logistic regression on the products of both ends' vector places, fitted on the training pairs."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def products(pairs: DataFrame) -> DataFrame:
        a = vectors.select(F.col(id).alias("player_a"), F.col(vector).alias("_a"))
        b = vectors.select(F.col(id).alias("player_b"), F.col(vector).alias("_b"))
        met = lookup(lookup(pairs, a, ["player_a"], "inner"), b, ["player_b"], "inner")
        return met.withColumn("_f", array_to_vector(F.zip_with("_a", "_b", lambda x, y: x * y))).drop("_a", "_b")

    model = LogisticRegression(featuresCol="_f", labelCol=label, regParam=penalty, maxIter=100).fit(checkpointed(products(train)))
    out = model.transform(products(test)).withColumn("score", vector_to_array("probability")[1])
    return out.drop("_f", "rawPrediction", "probability", "prediction")


def pair_scores(pairs: DataFrame, vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """Dot product of both ends' vectors."""
    a = vectors.select(F.col(id).alias("player_a"), F.col(vector).alias("_a"))
    b = vectors.select(F.col(id).alias("player_b"), F.col(vector).alias("_b"))
    out = lookup(lookup(pairs, a, ["player_a"], "inner"), b, ["player_b"], "inner")
    return out.withColumn("score", dot(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def auc(rows: DataFrame, by: Sequence[str], positive: Column, score: str) -> DataFrame:
    """Chance that a positive scores above a negative, ties half, by the middle-rank sum."""
    flagged = rows.select(*by, score, positive.cast("int").alias("_y"))
    ranks = value_ranks(flagged, by, score)
    per = flagged.groupBy(*by, score).agg(F.sum("_y").alias("_p"), F.count(F.lit(1)).alias("_n"))
    j = lookup(per, ranks.select(*by, score, "middle_rank"), [*by, score], "inner")
    sums = j.groupBy(*by).agg(F.sum(F.col("_p") * F.col("middle_rank")).alias("_r"), F.sum("_p").alias("positives"),
                              F.sum(F.col("_n") - F.col("_p")).alias("negatives"))
    p, q = F.col("positives"), F.col("negatives")
    return sums.select(*by, "positives", "negatives", F.try_divide(F.col("_r") - p * (p + 1) / 2, p * q).alias("auc"))
