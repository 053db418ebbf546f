"""Key, text, total and range checks."""

from pyspark.sql import functions as F

from ..operators import checks as ck
from ..operators import exposure as ex
from ..operators import joins as jn
from .registry import query, rounded


@query("Q4_duplicate_rows", """
    select user_id, event_type, event_id
    from (select *, count(*) over (partition by user_id, event_type, cast(ts as date)) as n from events)
    where n > 1""")
def _(v):
    e = v.table("events").withColumn("day", F.to_date("ts"))
    out = ck.duplicate_rows(e, ["user_id", "event_type", "day"])
    return out.select("user_id", "event_type", "event_id")


@query("Q5_suspicious_text", """
    select doc_id, 'text' as "column", md5(text) as value from documents
    where contains(text, 'Ã') or contains(text, 'Â') or contains(text, chr(92)) or contains(text, 'ê')
    union all
    select doc_id, 'source', md5(source) from documents
    where contains(source, 'Ã') or contains(source, 'Â') or contains(source, chr(92)) or contains(source, 'ê')""")
def _(v):
    out = ck.suspicious_text(v.table("documents"), ["doc_id"], ["text", "source", "nickname"],
                             [*ck.SUSPICIOUS, "ê"])
    return out.withColumn("value", F.md5("value"))


@query("Q6_lowest_totals_with_counts", """
    with t as (select team, game_day, sum(minutes) as minutes from v_player_game group by all),
    low as (select * from t order by minutes, team, game_day limit 10)
    select team, game_day, minutes,
           (select count(*) from v_player_game g where g.team = low.team
            and g.game_day = low.game_day and status = 'F') as finished
    from low""")
def _(v):
    rows = v.player_game
    totals = rows.groupBy("team", "game_day").agg(F.sum("minutes").alias("minutes"))
    low = ck.extreme_totals(totals, "minutes", ["team", "game_day"], 10)
    return ck.with_counts(low, rows.filter("status = 'F'"), ["team", "game_day"], "finished")


@query("Q7_highest_with_last_action", """
    with p as (select game, team, period, round(max(seconds) / 60, 1) as minute, count(*) as n
               from v_action group by all),
    t as (select game, team, sum(n) as n, string_agg(period || ':' || minute, ',' order by period)
                 as last_minutes, sum(minute) * 11 as expected from p group by 1, 2)
    select game, team, cast(n as bigint) as n, last_minutes, round(expected, 4) as expected
    from t order by n desc, game, team limit 10""")
def _(v):
    totals = v.action.groupBy("game", "team").agg(F.count(F.lit(1)).alias("n"))
    top = ck.extreme_totals(totals, "n", ["game", "team"], 10, largest=True)
    last = ck.last_minutes(v.action, ["game", "team"], "period", "seconds")
    shown = F.expr("array_join(transform(map_entries(last_minutes),"
                   " e -> concat(e.key, ':', e.value)), ',')")
    return rounded(top.join(last, ["game", "team"]).withColumn("last_minutes", shown), 4)


@query("Q11_reason_cascade", """
    with linked as (select player, case when player % 11 = 0 then null
                                        else player // 2 * 2 + cast(player % 5 > 0 as int) end as tm
                    from v_entity),
    shared as (select tm from linked where tm is not null group by 1 having count(distinct player) > 1),
    priced as (select player as tm, max(value) as price from v_valuation group by 1)
    select l.player,
           case when l.tm is null then 'no id' when s.tm is not null then 'shared id'
                when price is null then 'no valuation' when l.player % 13 = 0 then 'no date of birth'
                else 'priced' end as reason
    from linked l left join shared s using (tm) left join priced p using (tm)""")
def _(v):
    p = F.col("player")
    tm = F.when(p % 11 != 0, F.floor(p / 2) * 2 + (p % 5 > 0).cast("int"))
    links = v.entity.select("player", tm.alias("tm"))
    shared = ck.shared_ids(links, "player", "tm").withColumn("held", F.lit(True))
    priced = v.valuation.groupBy(F.col("player").alias("tm")).agg(F.max("value").alias("price"))
    rows = links.join(shared, "tm", "left").join(priced, "tm", "left")
    rules = [("no id", F.col("tm").isNull()), ("shared id", F.col("held")),
             ("no valuation", F.col("price").isNull()), ("no date of birth", p % 13 == 0)]
    return rows.select("player", ck.reason(rules, "priced").alias("reason"))


@query("Q14_key_and_row_equality", """
    select 'keys' as test, count(*) as differing from (
        select l_orderkey from lineitem where l_linenumber = 1 except select o_orderkey from orders
        union all (select o_orderkey from orders except select l_orderkey from lineitem where l_linenumber = 1))
    union all
    select 'rows', count(*) from (
        (select l_orderkey, l_linenumber, l_quantity from lineitem
         except all select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity < 50)
        union all
        (select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity < 50
         except all select l_orderkey, l_linenumber, l_quantity from lineitem))""")
def _(v):
    lines, orders = v.table("lineitem"), v.table("orders")
    keys = ck.key_gaps(lines.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("k")),
                       orders.select(F.col("o_orderkey").alias("k")), ["k"])
    rows = lines.select("l_orderkey", "l_linenumber", "l_quantity")
    gaps = ck.row_gaps(rows, rows.filter("l_quantity < 50"))
    n = F.count(F.lit(1)).alias("differing")
    return (keys.agg(n).select(F.lit("keys").alias("test"), "differing")
            .unionByName(gaps.agg(n).select(F.lit("rows").alias("test"), "differing")))


@query("Q15_number_ceiling", """
    with leaves as (
        select 'price' as path, o_totalprice as value from orders
        union all select 'spread.*', o_totalprice / 100 from orders
        union all select 'spread.*', cast(o_custkey as double) from orders
        union all select 'at.day', cast(day(o_orderdate) as double) from orders
        union all select 'id', cast(o_orderkey as double) from orders)
    select count(*) filter (where isnan(value) or isinf(value)) as not_finite,
           count(*) filter (where path <> 'id' and value >= 10000) as too_large,
           max(value) filter (where path <> 'id') as largest
    from leaves""")
def _(v):
    o = v.table("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"),
        F.array(F.col("o_totalprice") / 100, F.col("o_custkey").cast("double")).alias("spread"),
        F.struct(F.dayofmonth("o_orderdate").alias("day"), F.lit("x").alias("note")).alias("at"))
    return ck.number_report(ck.numeric_leaves(o, []), ["id"])


@query("Q16_orphan_facts", """
    with held as (select o_orderkey from orders where o_totalprice > 100000),
    lone as (select l_quantity from lineitem where l_orderkey not in (select o_orderkey from held)),
    per as (select o_orderkey, count(l_orderkey) as n from orders
            left join lineitem on l_orderkey = o_orderkey group by 1)
    select (select count(*) from lone) as rows, (select sum(l_quantity) from lone) as value,
           min(n) as lowest, quantile_cont(n, 0.5) as median, max(n) as highest,
           count(*) filter (where n = 0) as empty
    from per""")
def _(v):
    lines = v.table("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    orders = v.table("orders")
    lone = ck.orphans(lines, orders.filter("o_totalprice > 100000"), ["o_orderkey"], "l_quantity")
    return lone.join(ck.count_spread(orders.select("o_orderkey"), lines, ["o_orderkey"]))


@query("Q17_reconciliation", """
    with a as (select league, player, round(sum(value), 4) as v, count(*) as n from v_player_game group by all),
    b as (select league, player, v + case when player % 50 = 0 then 0.01 else 0 end as v,
                 n + case when player % 77 = 0 then 1 else 0 end as n
          from a where player % 91 <> 0)
    select coalesce(a.player, b.player) as player, a.n as n_l, b.n as n_r
    from a full join b using (league, player)
    where abs(coalesce(a.v, -1) - coalesce(b.v, -1)) > 1e-6 or coalesce(a.n, -1) <> coalesce(b.n, -1)""")
def _(v):
    a = v.player_game.groupBy("league", "player").agg(
        F.round(F.sum("value"), 4).alias("v"), F.count(F.lit(1)).alias("n"))
    p = F.col("player")
    b = a.filter(p % 91 != 0).withColumns({
        "v": F.col("v") + F.when(p % 50 == 0, 0.01).otherwise(0.0),
        "n": F.col("n") + F.when(p % 77 == 0, 1).otherwise(0)})
    return ck.reconcile(a, b, ["league", "player"], ["v"], 1e-6, ["n"]).select("player", "n_l", "n_r")


@query("Q18_relative_gap", """
    select player, round(case when a.r is null and b.r is null then 0
             when a.r is null or b.r is null then 'inf'::double
             else abs(a.r - b.r) / greatest(1, abs(a.r), abs(b.r)) end, 6) as gap
    from (select player, value / minutes * 90 as r from v_player_window where win = 1) a
    full join (select player, value / minutes * 90 as r from v_player_window where win = 2) b
    using (player)""")
def _(v):
    t = v.player_window
    one = t.filter("win = 1").select("player", F.col("per_ninety").alias("a"))
    two = t.filter("win = 2").select("player", F.col("per_ninety").alias("b"))
    gap = ck.relative_gap(F.col("a"), F.col("b")).alias("gap")
    return rounded(one.join(two, "player", "full_outer").select("player", gap))


@query("C3_probability_range", """
    select league, 'p' as "column", round(min(p), 6) as lowest, round(max(p), 6) as highest,
           count(*) filter (where p <= 0 or p >= 1) as outside, count(*) as rows
    from v_prob group by 1""")
def _(v):
    return rounded(ck.value_range(v.prob, ["league"], ["p"]))


@query("C7_source_profile", """
    select league, count(*) as rows, count(distinct player) as players,
           count(*) filter (where minutes = 0) as empty,
           count(*) filter (where status = 'F') as "F", count(*) filter (where status = 'O') as "O",
           count(*) filter (where status = 'P') as "P"
    from v_player_game group by 1""")
def _(v):
    rows = v.player_game
    counts = rows.groupBy("league").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("minutes") == 0).alias("empty"))
    players = rows.select("league", "player").distinct().groupBy("league").agg(
        F.count(F.lit(1)).alias("players"))
    tab = ck.counts_table(rows, "league", "status", ["F", "O", "P"])
    return counts.join(players, "league").join(tab, "league")


@query("U7_cross_tab", """
    select n_regionkey as region, count(*) filter (where c_mktsegment = 'BUILDING') as "BUILDING",
           count(*) filter (where c_mktsegment = 'MACHINERY') as "MACHINERY",
           count(*) filter (where c_mktsegment = 'ABSENT') as "ABSENT"
    from customer join nation on c_nationkey = n_nationkey group by 1""")
def _(v):
    rows = v.entity.select(F.col("league").alias("region"), "grp")
    return ck.counts_table(rows, "region", "grp", ["BUILDING", "MACHINERY", "ABSENT"])


@query("J1_contracted_join", """
    select o_orderkey, o_totalprice, sum_qty
    from orders join (select l_orderkey, sum(l_quantity) as sum_qty from lineitem group by 1)
         on l_orderkey = o_orderkey""")
def _(v):
    sums = v.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("sum_qty"))
    orders = v.table("orders").select("o_orderkey", "o_totalprice")
    return jn.contracted(orders, sums, ["o_orderkey"])


@query("J2_left_lookup", """
    select l_orderkey, l_linenumber, p_name from lineitem
    left join (select * from part where p_size > 10) on l_partkey = p_partkey""")
def _(v):
    parts = v.table("part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    out = jn.contracted(lines, parts, ["l_partkey"], "left", "many_to_one")
    return out.select("l_orderkey", "l_linenumber", "p_name")


@query("J3_outer_with_side", """
    with a as (select l_orderkey as k, count(*) as lines from lineitem where l_discount > 0.05 group by 1),
    b as (select o_orderkey as k, 1 as orders from orders where o_totalprice > 50000)
    select coalesce(a.k, b.k) as k, coalesce(lines, 0) as lines, coalesce(orders, 0) as orders,
           case when b.k is null then 'left_only' when a.k is null then 'right_only' else 'both' end as side
    from a full join b on a.k = b.k""")
def _(v):
    a = v.table("lineitem").filter("l_discount > 0.05").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.count(F.lit(1)).alias("lines"))
    b = v.table("orders").filter("o_totalprice > 50000").select(
        F.col("o_orderkey").alias("k"), F.lit(1).alias("orders"))
    return jn.outer_with_side(a, b, ["k"], ["lines", "orders"])


@query("J4_semi_join", """
    select event_id from events where (user_id, event_type) in
        (select user_id, event_type from events where value > 200)""")
def _(v):
    e = v.table("events")
    hot = e.filter("value > 200").select("user_id", "event_type").distinct()
    return e.join(hot, ["user_id", "event_type"], "left_semi").select("event_id")


@query("J5_anti_join", """
    select c_custkey from customer where not exists
        (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)""")
def _(v):
    big = v.table("orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return v.table("customer").join(big, "c_custkey", "left_anti").select("c_custkey")


@query("J7_band_pairs", """
    with e as (select game, period, team, player, cast(round(seconds * 1000) as bigint) as ms from v_action),
    p as (select a.game, a.team, least(a.player, b.player) as player_a,
                 greatest(a.player, b.player) as player_b
          from e a join e b on a.game = b.game and a.period = b.period and a.team = b.team
               and a.player <> b.player
               and (b.ms > a.ms or (b.ms = a.ms and a.player < b.player)) and b.ms <= a.ms + 300000)
    select team, player_a, player_b, count(*) as n from p group by all""")
def _(v):
    ms = F.round(F.col("seconds") * 1000).cast("long")
    events = v.action.select("game", "period", "team", "player", ms.alias("ms"))
    return jn.band_pairs(events, ["game", "period", "team"], "player", "ms", 300_000, by=["team"])


@query("J8_as_of_latest", """
    with k as (select o_custkey as player, cast(o_orderdate as date) as date, o_totalprice as value
               from orders where o_totalprice > 0
               and o_orderdate between date '1997-01-01' and date '1998-06-30'),
    l as (select player, max(date) as price_date from k group by 1)
    select player, price_date, max(value) as price, max(value) <> min(value) as conflict
    from k join l using (player) where date = price_date group by all""")
def _(v):
    rows = v.table("orders").select(
        F.col("o_custkey").alias("player"), F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("value"))
    return jn.as_of(rows, "player", "date", "value", F.to_date(F.lit("1997-01-01")),
                    F.to_date(F.lit("1998-06-30")))


@query("J9_as_of_after_bound", """
    with b as (select league, max(game_date) - 900 as bound from v_game group by 1),
    k as (select player, date, value from v_valuation join v_entity using (player)
          join b using (league) where date > bound and date <= date '2000-12-31')
    select player, max(date) as price_date, arg_max(value, date) as price from k group by 1""")
def _(v):
    bounds = v.game.groupBy("league").agg(F.date_sub(F.max("game_date"), 900).alias("bound"))
    return jn.as_of_after(v.entity, bounds, ["league"], v.valuation, "player", "date", "value",
                          "bound", F.to_date(F.lit("2000-12-31")))


@query("J10_as_of_with_fallback", """
    with pr as (select player, arg_max(value, date) as price from v_valuation
                where date < date '1997-01-01' group by 1),
    o as (select player, arg_max(value, date) filter (where date >= date '2000-01-01') as inside,
                 arg_max(value, date) as latest
          from v_valuation where date between date '1999-06-01' and date '2000-09-30' group by 1)
    select player, price, case when inside is not null then 'window'
                when latest is not null then 'carried' else 'price' end as how,
           round(ln(coalesce(inside, latest, price) / price), 6) as outcome
    from pr left join o using (player)""")
def _(v):
    d = lambda s: F.to_date(F.lit(s))
    prices = v.valuation.filter(F.col("date") < d("1997-01-01")).groupBy("player").agg(
        F.max_by("value", "date").alias("price"))
    out = jn.with_fallback(prices, "player", "price", v.valuation, "date", "value",
                           (d("2000-01-01"), d("2000-09-30")), d("1999-06-01"))
    return rounded(out.select("player", "price", "how", "outcome"))


@query("J15_first_source", """
    with a as (select player, min(grp) as g from v_player_game where minutes > 200 group by 1),
    b as (select player, min(grp) as g from v_player_game where status = 'F' group by 1)
    select player, coalesce(a.g, b.g, c.grp) as grp,
           case when a.g is not null then 'exposed' when b.g is not null then 'finished'
                else 'directory' end as source
    from v_entity c left join a using (player) left join b using (player)""")
def _(v):
    rows = v.player_game
    per = lambda d: d.groupBy("player").agg(F.min("grp").alias("grp"))
    sources = {"exposed": per(rows.filter("minutes > 200")), "finished": per(rows.filter("status = 'F'")),
               "directory": v.entity.select("player", "grp")}
    return jn.first_source(v.entity.select("player"), sources, ["player"], "grp")


@query("J16_opponent_share", """
    with s as (select league, game, home as team, away as opp from v_match
               union all select league, game, away, home from v_match),
    c as (select game, team, count(*) as n from v_action where type <> 'tackle' group by all)
    select s.game, s.team, round(coalesce(o.n, 0) / nullif(coalesce(m.n, 0) + coalesce(o.n, 0), 0), 6)
           as share
    from s left join c m on m.game = s.game and m.team = s.team
    left join c o on o.game = s.game and o.team = s.opp""")
def _(v):
    from ..operators.profiles import opponent_share

    own = v.action.filter("type <> 'tackle'")
    out = opponent_share(own, v.match, ["league", "game"], "game")
    return rounded(out.select("game", "team", "share"))


@query("S11_first_non_null", """
    select player, arg_min(case when minutes > 100 then status end, (game_day, game))
                       filter (where minutes > 100) as first_status,
           arg_min(value, (game_day, game)) filter (where value > 0) as first_value,
           sum(minutes) as minutes
    from v_player_game group by 1""")
def _(v):
    rows = v.player_game.withColumns({
        "first_status": F.when(F.col("minutes") > 100, F.col("status")),
        "first_value": F.when(F.col("value") > 0, F.col("value"))})
    firsts = jn.first_values(rows, ["player"], ["first_status", "first_value"], ["game_day", "game"])
    return firsts.join(rows.groupBy("player").agg(F.sum("minutes").alias("minutes")), "player")


@query("C2_boundary_dates", """
    with w as (select league, game_date, case when game_day <= ceil(0.6 * max(game_day) over
                 (partition by league)) then 1 else 2 end as win from v_game)
    select league, max(game_date) as last_game, min(game_date) filter (where win = 2) as first_w2,
           (select min(game_date) from w where win = 2) as cutoff
    from w group by 1""")
def _(v):
    g = ex.assign_windows(v.game, ["league"])
    per = g.groupBy("league").agg(
        F.max("game_date").alias("last_game"),
        F.min(F.when(F.col("win") == 2, F.col("game_date"))).alias("first_w2"))
    return per.join(per.agg(F.min("first_w2").alias("cutoff")))


@query("C1_game_bundle", """
    with w as (select *, case when game_day <= ceil(0.6 * max(game_day) over (partition by league))
                         then 1 else 2 end as win from v_match),
    d as (select game, min(cast(ts as date)) as game_date from v_action group by 1)
    select league, game, game_date, home, away from w join d using (game) where win = 1""")
def _(v):
    g = ex.assign_windows(v.match, ["league"]).filter("win = 1")
    dates = v.action.groupBy("game").agg(F.min(F.to_date("ts")).alias("game_date"))
    out = jn.contracted(g, dates, ["game"])
    return out.select("league", "game", "game_date", "home", "away")


@query("U1_bag_union", """
    select league, 'home' as side, count(*) as n from v_match where home % 2 = 0 group by 1
    union all select league, 'away', count(*) from v_match where away % 2 = 0 group by 1""")
def _(v):
    m = v.match
    both = (m.filter("home % 2 = 0").select("league", F.lit("home").alias("side"))
            .unionByName(m.filter("away % 2 = 0").select("league", F.lit("away").alias("side"))))
    return both.groupBy("league", "side").agg(F.count(F.lit(1)).alias("n"))


@query("S5_distinct_teams", """
    select league, team, min(game) as first_game from
        (select league, game, home as team from v_match union all select league, game, away from v_match)
    group by all""")
def _(v):
    sides = jn.expand_sides(v.match, ["league", "game"])
    return sides.groupBy("league", "team").agg(F.min("game").alias("first_game"))
