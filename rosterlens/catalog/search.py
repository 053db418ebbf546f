"""Nearest profiles, fit, identification and neighbour overlap."""

from pyspark.sql import functions as F

from ..operators import search as se
from .registry import query, rounded


def vectors(v):
    """Vectors with the clubs an entity has been at: its own and a second one for some."""
    i = F.col("id")
    seen = F.when(i % 3 == 0, F.array("team", ((i + 1) % 4).cast("int"))).otherwise(F.array("team"))
    return v.vector.withColumn("seen", seen)


PAIRS = """
    select a.id, b.id as other, a.grp, list_distance(a.v1, b.v1) as d, list_distance(a.v2, b.v2) as d2
    from v_vector a join v_vector b using (grp)
    where a.id <> b.id and a.team <> b.team and not (b.id % 3 = 0 and (b.id + 1) % 4 = a.team)"""


@query("J13_nearest_in_block", f"""
    select id, other, round(d, 6) as distance, cast(row_number() over (partition by id order by d, other) as int) as place
    from ({PAIRS}) qualify row_number() over (partition by id order by d, other) <= 10""")
def _(v):
    r = vectors(v)
    out = se.nearest(r, r, ["grp"], "id", "v1", "v1", 10, home="team", seen="seen")
    return rounded(out.select("id", "other", F.col("value").alias("distance"), "place"))


@query("W13_top_n_by_metric", """
    select a.id, b.id as other, round(list_distance(a.v2, b.v2), 6) as distance
    from v_vector a join v_vector b on a.id <> b.id
    qualify row_number() over (partition by a.id order by list_distance(a.v2, b.v2), b.id) <= 3""")
def _(v):
    out = se.nearest(v.vector, v.vector, [], "id", "v2", "v2", 3)
    return rounded(out.select("id", "other", F.col("value").alias("distance")))


@query("J14_club_fit_search", """
    with k as (select team, avg(v1[1]) as a, avg(v1[2]) as b, avg(v1[3]) as c, avg(v1[4]) as d from v_vector group by 1),
    s as (select k.team, p.id, (k.a * v1[1] + k.b * v1[2] + k.c * v1[3] + k.d * v1[4]) * 100 as score
          from k join v_vector p on p.team <> k.team and not (p.id % 3 = 0 and (p.id + 1) % 4 = k.team))
    select team, id, round(score, 6) as score from s where score > 0
    qualify row_number() over (partition by team order by score desc, id) <= 20""")
def _(v):
    r = vectors(v)
    part = [F.get("v1", F.lit(i)) for i in range(4)]
    clubs = r.groupBy("team").agg(*[(F.avg(c) * 100).alias(f"m{i}") for i, c in enumerate(part)])
    clubs = clubs.select("team", F.array(*[f"m{i}" for i in range(4)]).alias("profile"))
    players = r.select("id", F.slice("v1", 1, 4).alias("scores"), "seen")
    clubs = clubs.withColumn("club", F.col("team"))
    out = se.nearest(clubs, players, [], "team", "profile", "scores", 20, "dot", right_id="id",
                     home="club", seen="seen", positive=True)
    return rounded(out.select(F.col("id").alias("team"), F.col("other").alias("id"), F.col("value").alias("score")))


RANKS = """
    select a.id, a.grp, count(*) as k, list_distance(any_value(a.v1), any_value(a.v2)) as own,
           count(*) filter (where list_distance(a.v1, b.v2) <= list_distance(a.v1, a.v2)) as rank
    from v_vector a join v_vector b using (grp) group by 1, 2"""


@query("M18_identification", f"""
    with r as ({RANKS})
    select count(*) as rows, count(*) filter (where rank = 1) as hits, round(sum(1 / k), 6) as by_chance,
           round(avg(cast(rank = 1 as int) - 1 / k), 6) as statistic, round(avg(1 / rank), 6) as mrr from r where k >= 2""")
def _(v):
    return rounded(se.identification(se.own_ranks(v.vector, ["grp"], "id", "v1", "v2")))


@query("M18_own_ranks", f"select id, k, rank, round(own, 6) as own from ({RANKS})")
def _(v):
    return rounded(se.own_ranks(v.vector, ["grp"], "id", "v1", "v2"))


@query("C16_team_block_hits", """
    with r as (select a.id, count(*) as k, count(*) filter (where list_distance(a.v1, b.v2)
                      <= list_distance(a.v1, a.v2)) as rank
               from v_vector a join v_vector b using (grp, team) group by 1)
    select count(*) as rows, count(*) filter (where rank = 1) as hits, round(sum(1 / k), 6) as by_chance,
           round(avg(cast(rank = 1 as int) - 1 / k), 6) as statistic, round(avg(1 / rank), 6) as mrr from r where k >= 2""")
def _(v):
    return rounded(se.identification(se.own_ranks(v.vector, ["grp", "team"], "id", "v1", "v2")))


@query("M19_distance_spread", """
    select count(*) as pairs, round(avg(d), 6) as mean, round(stddev_samp(d), 6) as sd
    from (select list_distance(a.v1, b.v2) as d from v_vector a join v_vector b using (grp))""")
def _(v):
    return rounded(se.pair_moments(v.vector, ["grp"], "id", "v1", "v2"))


@query("M19_combined_distance", """
    select a.id, round(list_distance(a.v1[1:16], a.v2[1:16]) / 0.5 + list_distance(a.v1[17:32], a.v2[17:32]) / 0.25, 6) as own,
           count(*) filter (where list_distance(a.v1[1:16], b.v2[1:16]) / 0.5 + list_distance(a.v1[17:32], b.v2[17:32]) / 0.25
                 <= list_distance(a.v1[1:16], a.v2[1:16]) / 0.5 + list_distance(a.v1[17:32], a.v2[17:32]) / 0.25) as rank
    from v_vector a join v_vector b using (grp) group by a.id, a.v1, a.v2""")
def _(v):
    r = v.vector.select("id", "grp", F.slice("v1", 1, 16).alias("a1"), F.slice("v2", 1, 16).alias("b1"),
                        F.slice("v1", 17, 16).alias("a2"), F.slice("v2", 17, 16).alias("b2"))
    return rounded(se.combined_ranks(r, ["grp"], "id", [("a1", "b1", 0.5), ("a2", "b2", 0.25)]))


NEAR = """
    select a.id, b.id as other from v_vector a join v_vector b using (grp) where a.id <> b.id
    qualify row_number() over (partition by a.id order by list_distance(a.{v}, b.{v}), b.id) <= 10"""


@query("M34_neighbour_overlap", f"""
    with one as ({NEAR.format(v='v1')}), two as ({NEAR.format(v='v2')}),
    s as (select one.id, count(two.id) / 10 as share from one left join two using (id, other) group by 1)
    select round(avg(share), 6) as share, count(*) as rows from s""")
def _(v):
    near = lambda c: se.nearest(v.vector, v.vector, ["grp"], "id", c, c, 10)
    return rounded(se.shared_neighbours(near("v1"), near("v2"), 10))


@query("A35_same_league_share", f"""
    with n as ({NEAR.format(v='v1')}), s as (select n.id, avg(cast(a.team = b.team as int)) as s
        from n join v_vector a on a.id = n.id join v_vector b on b.id = n.other group by 1)
    select round(avg(s), 6) as share, count(*) as rows from s""")
def _(v):
    near = se.nearest(v.vector, v.vector, ["grp"], "id", "v1", "v1", 10)
    return rounded(se.same_league_share(near, v.vector.select("id", "team"), "team"))


@query("J6_pairs_per_block", """
    select grp, team, count(*) as nodes, count(*) * (count(*) - 1) // 2 as pairs from v_vector group by 1, 2""")
def _(v):
    return se.block_pair_counts(v.vector, ["grp", "team"])


@query("T5_sorted_candidate_lists", f"""
    with n as (select id, other, d, row_number() over (partition by id order by d, other) as place from ({PAIRS})
               qualify row_number() over (partition by id order by d, other) <= 10)
    select id, string_agg(other || case when d >= 1.3 then '!' else '' end, ',' order by d, other) as similar
    from n group by 1""")
def _(v):
    r = vectors(v)
    near = se.nearest(r, r, ["grp"], "id", "v1", "v1", 10, home="team", seen="seen")
    cell = F.struct("value", "other")
    lists = near.groupBy("id").agg(F.array_sort(F.collect_list(cell)).alias("_l"))
    shown = F.transform("_l", lambda s: F.concat(s["other"].cast("string"), F.when(s["value"] >= 1.3, "!").otherwise("")))
    return lists.select("id", F.array_join(shown, ",").alias("similar"))


@query("C17_identification_report", f"""
    with r as ({RANKS})
    select round(avg(cast(rank = 1 as int)), 6) as top_1, round(avg(cast(rank <= 3 as int)), 6) as top_3,
           round(avg(cast(rank <= 5 as int)), 6) as top_5, round(avg(cast(rank <= 10 as int)), 6) as top_10,
           round(avg(1 / rank), 6) as mrr,
           round(avg(list_sum(list_transform(range(1, k + 1), lambda x: 1.0::double / x)) / k), 6) as chance
    from r""")
def _(v):
    from ..functions.numbers import expected_reciprocal_rank

    r = se.own_ranks(v.vector, ["grp"], "id", "v1", "v2")
    rank = F.col("rank")
    tops = [F.avg((rank <= t).cast("double")).alias(f"top_{t}") for t in (1, 3, 5, 10)]
    return rounded(r.agg(*tops, F.avg(1 / rank).alias("mrr"), F.avg(expected_reciprocal_rank(F.col("k"))).alias("chance")))
