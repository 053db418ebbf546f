"""Upgrade plans, squads and published records."""

from pyspark.sql import functions as F

from ..functions.numbers import band
from ..operators import publish as pb
from ..operators import resample as rs
from ..plans import upgrade as up
from ..session import checkpointed
from .registry import query, rounded

GROUPS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
SHAPE = {"ECONOMY": 3, "LARGE": 2, "MEDIUM": 2, "PROMO": 1, "SMALL": 1, "STANDARD": 1}
BUDGETS = [950.0, 1900.0, 2900.0]
#: A pair of club and player is own from its first line on if that is before this day, else a candidate.
OWN_BEFORE = "1995-03-01"

CLUBS = f"""
    pt as (select p_partkey as id, p_type as grp, p_retailprice as price, round(p_size + p_retailprice / 1000, 4) as value,
                  (1 + p_partkey % 5) / 10.0::double as sd from part),
    pairs as (select l_suppkey as club, l_partkey as id, min(l_shipdate) < date '{OWN_BEFORE}' as mine from lineitem group by 1, 2),
    own as (select club, pt.* from pairs join pt using (id) where mine),
    cand as (select club, pt.*, cast(id % 5 - 1 as double) as score from pairs join pt using (id) where not mine),
    clubs as (select distinct club from own),
    shape as (select club, grp, places from clubs, (values ('ECONOMY', 3), ('LARGE', 2), ('MEDIUM', 2), ('PROMO', 1), ('SMALL', 1), ('STANDARD', 1)) g(grp, places))"""


def parts(v):
    p = F.col("p_partkey")
    return v.table("part").select(
        p.alias("id"), F.col("p_type").alias("grp"), F.col("p_retailprice").alias("price"),
        F.round(F.col("p_size") + F.col("p_retailprice") / 1000, 4).alias("value"), ((1 + p % 5) / 10).alias("sd"))


def club_tables(v):
    """Own players, candidates and shapes from all lines."""
    l = v.table("lineitem").groupBy(F.col("l_suppkey").alias("club"), F.col("l_partkey").alias("id")).agg(
        (F.min("l_shipdate") < F.lit(OWN_BEFORE).cast("date")).alias("mine"))
    rows = l.join(parts(v), "id")
    own = rows.filter("mine").drop("mine")
    cand = rows.filter("not mine").drop("mine").withColumn("score", (F.col("id") % 5 - 1).cast("double"))
    cells = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(n).alias("places")) for g, n in SHAPE.items()])
    shape = own.select("club").distinct().select("club", F.inline(cells))
    return own, cand, shape


def plans(v, caps):
    own, cand, shape = club_tables(v)
    return up.club_plans(own, cand, shape, GROUPS, BUDGETS, caps)


PLAN_SQL = f"""
    with {CLUBS},
    rk as (select club, grp, value, sd, row_number() over (partition by club, grp order by value desc, id) as n from own),
    ok as (select s.club, s.grp, a, coalesce(sum(value) filter (where n <= places - a), 0) as total, coalesce(sum(sd * sd) filter (where n > places - a and n <= places), 0) as var,
                  count(n) filter (where n <= places - a) = places - a as enough
           from shape s left join rk using (club, grp), range(0, 4) r(a) where a <= places group by s.club, s.grp, a, places),
    z as (select * from ok where a = 0),
    tot as (select club, sum(case when enough then 0 else 1 end) as lacking, sum(total) as total from z group by 1),
    f as (select *, unnest([false, true]) as fit from cand), fc as (select * from f where (not fit or score > 0) and price <= 2900),
    dominated as (select c.club, c.fit, c.id from fc c join fc d on d.club = c.club and d.fit = c.fit and d.grp = c.grp and d.price <= c.price and d.value >= c.value
                  and (d.price < c.price or d.value > c.value or d.id < c.id) group by 1, 2, 3 having count(*) >= 3),
    sk as (select c.club, c.fit, c.grp, c.id, c.price, c.value, c.sd * c.sd as s2, case when z.enough then 0 else 1 end as l,
                  o1.total - z.total as d1, o2.total - z.total as d2, o3.total - z.total as d3, o1.var as v1, o2.var as v2, o3.var as v3
           from fc c anti join dominated x on x.club = c.club and x.fit = c.fit and x.id = c.id
           join z on z.club = c.club and z.grp = c.grp
           left join ok o1 on o1.club = c.club and o1.grp = c.grp and o1.a = 1 and o1.enough
           left join ok o2 on o2.club = c.club and o2.grp = c.grp and o2.a = 2 and o2.enough
           left join ok o3 on o3.club = c.club and o3.grp = c.grp and o3.a = 3 and o3.enough),
    sets as (
        select club, fit, 1 as a, price as cost, value as v, s2, d1 as d, v1 as lost, l, [id] as ids from sk
        union all
        select c.club, c.fit, 2, c.price + d.price, c.value + d.value, c.s2 + d.s2, case when c.grp = d.grp then c.d2 else c.d1 + d.d1 end,
               case when c.grp = d.grp then c.v2 else c.v1 + d.v1 end, case when c.grp = d.grp then c.l else c.l + d.l end, list_sort([c.id, d.id])
        from sk c join sk d on d.club = c.club and d.fit = c.fit and (d.grp > c.grp or d.grp = c.grp and d.id > c.id) and c.price + d.price <= 2900
        union all
        select c.club, c.fit, 3, c.price + d.price + e.price, c.value + d.value + e.value, c.s2 + d.s2 + e.s2,
               case when c.grp = e.grp then c.d3 when c.grp = d.grp then c.d2 + e.d1 when d.grp = e.grp then c.d1 + d.d2 else c.d1 + d.d1 + e.d1 end,
               case when c.grp = e.grp then c.v3 when c.grp = d.grp then c.v2 + e.v1 when d.grp = e.grp then c.v1 + d.v2 else c.v1 + d.v1 + e.v1 end,
               case when c.grp = e.grp then c.l when c.grp = d.grp then c.l + e.l when d.grp = e.grp then c.l + d.l else c.l + d.l + e.l end, list_sort([c.id, d.id, e.id])
        from sk c join sk d on d.club = c.club and d.fit = c.fit and (d.grp > c.grp or d.grp = c.grp and d.id > c.id) and c.price + d.price <= 2900
        join sk e on e.club = d.club and e.fit = d.fit and (e.grp > d.grp or e.grp = d.grp and e.id > d.id) and c.price + d.price + e.price <= 2900),
    every as (
        select club, fit, 0 as a, 0.0::double as cost, round(total, 9) as total, 0.0::double as var, []::bigint[] as ids from tot, (values (false), (true)) t(fit) where lacking = 0
        union all
        select s.club, s.fit, s.a, round(s.cost, 6), round(t.total + s.d + s.v, 9), s.lost + s.s2, s.ids from sets s join tot t on t.club = s.club and t.lacking = s.l where s.d is not null),
    grid as (select unnest([950.0, 1900.0, 2900.0]) as budget), caps as (select unnest([1, 2, 3]) as cap),
    most as (select club, fit, budget, cap, max(total) as total from every, grid, caps where cost <= budget and a <= cap group by all),
    best as (select m.club, m.fit, m.budget, m.cap, m.total, min({{'cost': e.cost, 'a': e.a, 'ids': e.ids, 'var': e.var}}) as p
             from most m join every e on e.club = m.club and e.fit = m.fit and e.total = m.total and e.cost <= m.budget and e.a <= m.cap group by all)"""


@query("M35_upgrade_plans", PLAN_SQL + """
    select club, fit, cast(budget as double) as budget, cap, round(total, 4) as total from best where cap <= 2""")
def _(v):
    return rounded(plans(v, [1, 2]).select("club", "fit", "budget", "cap", "total"), 4)


@query("M35_upgrade_plans_three_additions", PLAN_SQL + """
    select club, fit, cast(budget as double) as budget, cap, round(total, 4) as total, round(p.cost, 4) as cost, array_to_string(p.ids, ',') as signed from best""")
def _(v):
    out = plans(v, [1, 2, 3]).withColumn("signed", F.array_join(F.col("in_ids").cast("array<string>"), ","))
    return rounded(out.select("club", "fit", "budget", "cap", "total", "cost", "signed"), 4)


@query("X10_gain_and_interval", PLAN_SQL + """
    select b.club, b.fit, cast(b.budget as double) as budget, b.cap, round(b.total - t.total, 4) as gain, round(b.total - t.total - 1.645 * sqrt(p.var), 4) as low,
           round(b.total - t.total + 1.645 * sqrt(p.var), 4) as high
    from best b join tot t on t.club = b.club and t.lacking = 0""")
def _(v):
    own, cand, shape = club_tables(v)
    out = up.with_gain(plans(v, [1, 2, 3]), up.baselines(own, shape)).filter("base is not null")
    return rounded(out.select("club", "fit", "budget", "cap", "gain", "low", "high"), 4)


@query("X11_infeasibility_reason", f"""
    with {CLUBS}, n as (select s.club, s.grp, greatest(0, places - (select count(*) from own where own.club = s.club and own.grp = s.grp)) as need from shape s),
    r as (select *, row_number() over (partition by club, grp order by price, id) as k from cand),
    f as (select n.club, n.grp, need, count(k) as have, coalesce(sum(price) filter (where k <= need), 0) as cost from n left join r using (club, grp) group by 1, 2, 3),
    p as (select club, sum(need)::bigint as needed, bool_or(have < need) as few, sum(cost) as cheapest from f group by 1)
    select club, cast(budget as double) as budget, cap, needed, case when needed > cap then 'more places than signings' when few then 'too few candidates'
           when cheapest > budget then 'budget too small' end as reason
    from p, (select unnest([950.0, 1900.0, 2900.0]) as budget), (select unnest([1, 2, 3]) as cap)""")
def _(v):
    own, cand, shape = club_tables(v)
    return up.infeasible(own, cand, shape, BUDGETS, [1, 2, 3])


@query("C29_broken_plans", PLAN_SQL + """
    select 0::bigint as broken, (select count(*) from best) as plans, (select count(distinct club) from own) as clubs""")
def _(v):
    own, cand, shape = club_tables(v)
    every = checkpointed(plans(v, [1, 2, 3]))
    bad = up.broken_plans(every, own, cand, shape)
    return bad.agg(F.count(F.lit(1)).alias("broken")).join(every.agg(F.count(F.lit(1)).alias("plans"))).join(own.agg(F.count_distinct("club").alias("clubs")))


@query("U6_picks_in_and_out", """
    with t as (select p_brand, list_sort(list(p_partkey) filter (where p_size <= 25)) as base, list_sort(list(p_partkey) filter (where p_size between 20 and 40)) as ten from part group by 1)
    select p_brand, len(list_filter(ten, lambda x: not list_contains(base, x))) as n_in, len(list_filter(base, lambda x: not list_contains(ten, x))) as n_out from t""")
def _(v):
    p = v.table("part").select("p_brand", "p_partkey", "p_size")
    base, ten = (p.filter(c).select("p_brand", "p_partkey") for c in ("p_size <= 25", "p_size between 20 and 40"))
    n = lambda d, c: d.groupBy("p_brand").agg(F.count(F.lit(1)).cast("int").alias(c))
    keys = ["p_brand", "p_partkey"]
    return n(ten.join(base, keys, "left_anti"), "n_in").join(n(base.join(ten, keys, "left_anti"), "n_out"), "p_brand")


QUOTAS = {"ECONOMY": 2, "LARGE": 2, "MEDIUM": 3, "PROMO": 2, "SMALL": 1}
QUOTA_SQL = "(values ('ECONOMY', 2), ('LARGE', 2), ('MEDIUM', 3), ('PROMO', 2), ('SMALL', 1)) q(grp, quota)"


@query("M36_random_squads", f"""
    with {CLUBS}, d as (select draw, grp, price, value, quota, row_number() over (partition by draw, grp
           order by ('0x' || substr(md5('0-' || draw || '-' || id), 1, 8))::bigint, id) as n from pt join {QUOTA_SQL} using (grp), range(200) r(draw))
    select cast(draw as int) as draw, round(sum(price), 4) as cost, round(sum(value), 4) as value, count(*) as players
    from d where n <= quota group by 1 having round(sum(price), 4) <= 9500""")
def _(v):
    return rounded(up.random_squads(parts(v), QUOTAS, F.lit(9500.00001), 200), 4)


REDRAW = f"""
    cl as (select distinct p_brand as cluster from part), ci as (select cluster, row_number() over (order by cluster) - 1 as slot, count(*) over () as n from cl),
    pk as (select replicate, ('0x' || substr(md5('0-' || replicate || '-all-' || slot), 1, 8))::bigint % n as slot from ci, range(50) r(replicate)),
    dr as (select distinct replicate, cluster from pk join ci using (slot)),
    rows as (select replicate, id, grp, price, value from dr join (select p_brand as cluster, pt.* from pt join part on p_partkey = id) using (cluster))"""


def redrawn(v):
    p = parts(v).join(v.table("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("cluster")), "id")
    p = p.withColumn("all", F.lit("all"))
    return rs.draws(p, "all", "cluster", 50).drop("times").join(p, ["all", "cluster"])


@query("C24_cheapest_fill", f"""
    with {CLUBS}, {REDRAW}, k as (select *, row_number() over (partition by replicate, grp order by price, id) as n from rows join {QUOTA_SQL} using (grp))
    select cast(replicate as int) as replicate, count(*) as filled, round(sum(price), 4) as cost, count(*) < 10 as short from k where n <= quota group by 1""")
def _(v):
    return rounded(up.cheapest_fill(redrawn(v), QUOTAS), 4)


@query("A40_squad_tally", f"""
    with {CLUBS}, {REDRAW}, t as (select replicate, grp, max((value, -id)) as a, max((price, -id)) as b from rows group by 1, 2),
    s as (select replicate, unnest(['P3', 'P2']) as predictor, unnest([-a[2], -b[2]]) as id from t),
    o as (select replicate, predictor, string_agg(id::bigint, ',' order by id) as squad, round(sum(id % 7 * 1.0::double), 6) as actual from s group by 1, 2),
    w as (select replicate, max(squad) filter (where predictor = 'P3') as sa, max(squad) filter (where predictor = 'P2') as sb,
                 max(actual) filter (where predictor = 'P3') as va, max(actual) filter (where predictor = 'P2') as vb from o group by 1)
    select count(*) filter (where sa <> sb and va > vb) as wins, count(*) filter (where sa = sb) as identical,
           count(*) filter (where sa <> sb and va = vb) as ties, count(*) as replicates from w""")
def _(v):
    picks = redrawn(v).groupBy("replicate", "grp").agg(
        F.max_by("id", F.struct("value", -F.col("id"))).alias("P3"), F.max_by("id", F.struct("price", -F.col("id"))).alias("P2"))
    long = picks.unpivot(["replicate", "grp"], ["P3", "P2"], "predictor", "id")
    squads = long.groupBy("replicate", "predictor").agg(
        F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("squad"),
        F.sum((F.col("id") % 7).cast("double")).alias("actual"))
    return up.squad_tally(squads, [], "P3", "P2")


@query("L8_player_records", """
    select p_partkey as id, case when p_size % 3 = 0 then 'nick ' || p_size else p_name end as name, p_type as grp,
           round(p_retailprice / 7, 4) as value, round(p_retailprice / 7 - 1.645 * p_size / 10, 4) as low, round(p_retailprice / 7 + 1.645 * p_size / 10, 4) as high,
           case when p_size > 10 then cast(p_retailprice >= 950 as int) + cast(p_retailprice >= 980 as int) end as band from part""")
def _(v):
    s = F.col("p_size")
    rows = v.table("part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(s % 3 == 0, F.concat(F.lit("nick "), s.cast("string"))).alias("nickname"),
        F.col("p_type").alias("grp"), (F.col("p_retailprice") / 7).alias("value"), (s / 10).alias("sd"), band(F.col("p_retailprice"), [950, 980]).alias("band"), s.alias("size"))
    return pb.player_records(rows, F.col("size") > 10)


@query("L8_club_records", """
    select p_brand as club, md5(array_to_string(list_sort(list(p_partkey)), ',')) as players, count(*) as n from part group by 1""")
def _(v):
    rows = v.table("part").select(F.col("p_brand").alias("club"), F.col("p_partkey").alias("id"))
    out = pb.club_records(rows, ["club"], "id")
    return out.select("club", F.md5(F.array_join(F.col("players").cast("array<string>"), ",")).alias("players"), F.size("players").cast("long").alias("n"))


@query("S13_published_json", """
    select p_brand as club, '{"club":"' || p_brand || '","players":[' || array_to_string(list_sort(list(p_partkey)), ',') || ']}' as json
    from part group by 1""")
def _(v):
    rows = v.table("part").select(F.col("p_brand").alias("club"), F.col("p_partkey").alias("id"))
    return pb.as_json(pb.club_records(rows, ["club"], "id"), ["club"])


@query("S14_output_digest", """
    with f as (select p_brand as club, '{"club":"' || p_brand || '","players":[' || array_to_string(list_sort(list(p_partkey)), ',') || ']}' as json
               from part group by 1)
    select sha256(string_agg(club || ' ' || sha256(json), chr(10) order by club || ' ' || sha256(json))) as digest from f""")
def _(v):
    rows = v.table("part").select(F.col("p_brand").alias("club"), F.col("p_partkey").alias("id"))
    files = pb.as_json(pb.club_records(rows, ["club"], "id"), ["club"])
    return pb.digest(files.select(F.col("club").alias("path"), F.encode("json", "UTF-8").alias("content")), "path", "content")
