"""Group shares, rank functions, probability scores, scalar and text functions."""

from pyspark.sql import functions as F

from ..functions import numbers as nm
from ..functions import text as tx
from ..operators import exposure as ex
from ..operators import groups as gr
from ..operators import scoring as sc
from ..scale import numbered, quantiles
from .registry import query, rounded


@query("A6_modal_group", """
    with p as (select player, priority, sum(minutes) as m, count(*) as n
               from (select o_custkey as player, o_orderpriority as priority, o_orderkey % 4 as minutes
                     from orders) group by all having sum(minutes) > 0),
    b as (select player, priority, rank() over (partition by player order by m desc, n desc) as r from p),
    t as (select player, case when count(*) = 1 then min(priority) else 'UNKNOWN' end as modal, count(*) as tied
          from b where r = 1 group by 1)
    select c.player, coalesce(case when modal <> 'UNKNOWN' then modal end,
                              case when c.player % 3 = 0 then grp end, 'UNKNOWN') as grp,
           case when modal <> 'UNKNOWN' then 'rows' when c.player % 3 = 0 then 'mapped' else 'none' end as step
    from v_entity c left join t using (player)""")
def _(v):
    rows = v.table("orders").select(
        F.col("o_custkey").alias("player"), F.col("o_orderpriority").alias("grp"),
        (F.col("o_orderkey") % 4).alias("minutes"))
    modal = gr.modal_group(rows, ["player"], "grp")
    mapped = v.entity.filter("player % 3 = 0").select("player", "grp")
    return gr.resolved_group(v.entity.select("player"), ["player"], modal, mapped, "grp")


@query("A36_shape_largest_remainder", """
    with g as (select distinct c_mktsegment as grp from customer), t as (select distinct team from v_player_game),
    m as (select team, grp, cast(coalesce(sum(minutes), 0) as bigint) as m from (select t.team, g.grp from t, g)
          left join v_player_game using (team, grp) group by 1, 2),
    s as (select team, grp, m, sum(m) over (partition by team) as t,
                 (10 * m) // sum(m) over (partition by team) as whole,
                 (10 * m) % sum(m) over (partition by team) as rest from m),
    r as (select *, row_number() over (partition by team order by rest desc, grp) as n,
                 10 - sum(whole) over (partition by team) as spare from s)
    select team, grp, cast(whole + case when n <= spare then 1 else 0 end as int) as places from r""")
def _(v):
    m = v.player_game.groupBy("team", "grp").agg(F.sum("minutes").alias("minutes"))
    return gr.shape(m, "team", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])


@query("A18_reliability_bins", """
    with e as (select quantile_cont(p, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) as q from v_prob),
    b as (select y, p, cast(len(list_filter(list_distinct(q[2:10]), lambda x: x < p and x > q[1] and x < q[11])) as int) as bin
          from v_prob, e)
    select bin, count(*) as n, cast(sum(y) as bigint) as o, round(sum(p), 6) as e,
           round(avg(p), 6) as mean_predicted, round(avg(y), 6) as observed,
           round(sum(y) / sum(p) - 1, 6) as relative_residual
    from b group by 1""")
def _(v):
    return rounded(sc.reliability(v.prob, "y", "p"))


@query("A19_probability_scores", """
    select league, count(*) as rows, cast(sum(y) as bigint) as positives, round(avg(y), 6) as base_rate,
           round(avg(p), 6) as mean_p, round((avg(p) - avg(y)) / avg(y), 6) as miss,
           abs((avg(p) - avg(y)) / avg(y)) > 0.1 as flagged, round(avg((p - y) ** 2), 6) as brier,
           round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) as log_loss
    from v_prob group by 1""")
def _(v):
    return rounded(sc.probability_scores(v.prob, "y", "p", ["league"]))


@query("A20_hosmer_lemeshow", """
    with e as (select quantile_cont(p, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) as q from v_prob),
    b as (select y, p, len(list_filter(list_distinct(q[2:10]), lambda x: x < p and x > q[1] and x < q[11])) as bin
          from v_prob, e),
    g as (select bin, count(*) as n, sum(y) as o, sum(p) as e from b group by 1)
    select round(sum((o - e) ** 2 / (e * (1 - e / n))), 5) as hl from g""")
def _(v):
    return rounded(sc.hosmer_lemeshow(sc.reliability(v.prob, "y", "p")), 5)


@query("A21_rate_spread", """
    select league, grp, count(*) as n, round(avg(r), 6) as mean, round(median(r), 6) as median,
           round(quantile_cont(r, 0.1), 6) as p10, round(quantile_cont(r, 0.9), 6) as p90
    from (select league, grp, value / minutes * 90 as r from v_player_window) group by all""")
def _(v):
    return rounded(sc.spread(v.player_window, ["league", "grp"], "per_ninety"))


def links(v):
    c = F.col("player")
    status = F.when(c % 7 == 0, "ambiguous").when(c % 5 == 0, "unmatched").otherwise("matched")
    linked = F.when(status == "matched", F.floor(c / 3) * 2 + c % 2)
    per = v.player_game.groupBy("league", "team", "player").agg(F.sum("minutes").alias("minutes"))
    return per.withColumns({"status": status, "linked": linked})


LINKS = """
    select *, case when status = 'matched' then player // 3 * 2 + player % 2 end as linked
    from (select league, team, player, sum(minutes) as minutes,
                 case when player % 7 = 0 then 'ambiguous' when player % 5 = 0 then 'unmatched'
                      else 'matched' end as status from v_player_game group by all)"""


@query("A25_match_rates", f"""
    select league, count(*) filter (where status = 'matched') as matched,
           count(*) filter (where status = 'ambiguous') as ambiguous,
           count(*) filter (where status = 'unmatched') as unmatched,
           round(sum(case when status = 'matched' then minutes else 0 end) / sum(minutes), 6) as rate,
           round(sum(case when status = 'matched' and minutes >= 800 then minutes else 0 end)
                 / sum(case when minutes >= 800 then minutes else 0 end), 6) as rate_regular
    from ({LINKS}) group by rollup(league)""")
def _(v):
    return rounded(gr.match_rates(links(v), "league", ["matched", "ambiguous", "unmatched"], least=800))


@query("A26_agreement", """
    with w as (select league, player, sum(minutes) filter (where win = 1) as a,
                      sum(minutes) filter (where win = 2) as b from v_player_window group by all),
    r as (select cast(league as varchar) as league, a / b / 1.5 as ratio from w where a is not null and b is not null),
    x as (select * from r union all select 'ALL', ratio from r)
    select league, count(*) as pairs, round(avg(cast(ratio between 0.8 and 1.2 as int)), 6) as within,
           round(median(ratio), 6) as median from x group by 1""")
def _(v):
    p = ex.window_pairs(v.player_window, ["league", "player"])
    p = p.select(F.col("league").cast("string").alias("league"),
                 (F.col("minutes_w1") / F.col("minutes_w2") / 1.5).alias("ratio"))
    return rounded(gr.agreement(p, "league"))


@query("C26_weighted_agreement", """
    with w as (select player, sum(minutes) filter (where win = 1) as a,
                      sum(minutes) filter (where win = 2) as b from v_player_window group by all)
    select round(sum(case when a / b / 1.5 between 0.8 and 1.2 then a else 0 end) / sum(a), 6) as share,
           round(sum(case when a / b / 1.5 between 0.8 and 1.2 and a >= 450 then a else 0 end)
                 / sum(case when a >= 450 then a else 0 end), 6) as share_regular
    from w where a is not null and b is not null""")
def _(v):
    p = ex.window_pairs(v.player_window, ["player"])
    p = p.withColumn("ratio", F.col("minutes_w1") / F.col("minutes_w2") / 1.5)
    return rounded(gr.weighted_agreement(p, "minutes_w1", 450))


@query("A27_consolidation", """
    with l as (select user_id, case when event_id % 3 = 0 then null else user_id // 2 + event_id % 2 end as linked,
                      case when event_id % 3 = 0 then 'unmatched' else 'matched' end as status from events)
    select user_id, array_to_string(list_sort(list_distinct(list(linked) filter (where linked is not null))), ',') as ids,
           case when count(distinct linked) = 1 then min(linked) end as id,
           count(*) filter (where status = 'matched') as matched,
           count(*) filter (where status <> 'matched') as unmatched
    from l group by 1""")
def _(v):
    e = F.col("event_id")
    l = v.table("events").select("user_id", F.when(e % 3 != 0, F.floor(F.col("user_id") / 2) + e % 2).alias("linked"),
                                 F.when(e % 3 == 0, "unmatched").otherwise("matched").alias("status"))
    out = gr.consolidated(l, "user_id", "linked")
    return out.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("A28_shared_id_cases", f"""
    with g as (select linked, count(*) as links, count(distinct player) as p, count(distinct team) as t
               from ({LINKS}) where linked is not null group by 1 having count(*) > 1)
    select linked, links, case when p = 1 and t > 1 then 'one player, several teams'
             when p > 1 and t = 1 then 'several players, one team'
             when p > 1 and t > 1 then 'several of both' else 'one player, one team' end as "case"
    from g""")
def _(v):
    return gr.shared_id_cases(links(v), "linked", "player", "team")


ICC_SQL = """
    with r as (select team, value / minutes * 90 as v from v_player_window where win = 1),
    c as (select team, count(*) as n, avg(v) as m from r group by 1),
    s as (select sum(n) as big, count(*) as k, sum(n * n) as nn, sum(n * m) / sum(n) as g from c),
    b as (select sum(n * (m - g) ** 2) as ssb from c, s),
    w as (select sum((v - m) ** 2) as ssw from r join c using (team)),
    a as (select cast(big as bigint) as n, k as clusters, ssb / (k - 1) as msb, ssw / (big - k) as msw,
                 (big - nn / big) / (k - 1) as k0 from s, b, w),
    i as (select *, (msb - msw) / (msb + (k0 - 1) * msw) as icc from a)"""


@query("A30_intraclass_correlation", ICC_SQL + """
    select n, clusters, round(msb / msw, 6) as f, round(k0, 6) as k0, round(icc, 8) as icc from i""")
def _(v):
    out = gr.anova(v.player_window.filter("win = 1"), ["team"], "per_ninety")
    out = out.select("n", "clusters", (F.col("msb") / F.col("msw")).alias("f"), "k0",
                     F.round("icc", 8).alias("icc"))
    return out.withColumns({"f": F.round("f", 6), "k0": F.round("k0", 6)})


@query("A31_design_effect", ICC_SQL + """
    select round(1 + (k0 - 1) * icc, 6) as design_effect, round(n / (1 + (k0 - 1) * icc), 4) as effective,
           round(tanh(2.80158 / sqrt(n / (1 + (k0 - 1) * icc) - 3)), 8) as detectable from i""")
def _(v):
    out = gr.power(gr.anova(v.player_window.filter("win = 1"), ["team"], "per_ninety"))
    return out.select(F.round("design_effect", 6).alias("design_effect"),
                      F.round("effective", 4).alias("effective"), F.round("detectable", 8).alias("detectable"))


@query("A32_between_share", """
    with r as (select league, unnest(['minutes', 'rate']) as "column",
                      unnest([minutes, value / minutes * 90]) as x from v_player_window),
    m as (select *, avg(x) over (partition by "column", league) as mg, avg(x) over (partition by "column") as g from r)
    select "column", round(sum((mg - g) ** 2) / sum((x - g) ** 2), 8) as share from m group by 1""")
def _(v):
    out = gr.between_share(v.player_window.withColumnRenamed("per_ninety", "rate"), ["league"], ["minutes", "rate"])
    return rounded(out, 8)


@query("A34_ratio_by_thirds", """
    with t as (select *, quantile_cont(minutes, 1/3::double) over () as lo,
                      quantile_cont(minutes, 2/3::double) over () as hi from v_player_window),
    x as (select case when minutes > hi then 'high' when minutes <= lo then 'low' end as third, offensive, value from t)
    select third, round(median(offensive) / median(value), 6) as ratio from x where third is not null group by 1""")
def _(v):
    return rounded(gr.ratio_by_thirds(v.player_window, "minutes", "offensive", "value"))


@query("A39_fold_balance", """
    with f as (select *, (row_number() over (partition by league order by game_day, game) - 1) % 5 as fold from v_player_game)
    select league, fold, count(*) as games, sum(lines)::bigint as actions,
           round(avg(cast(status = 'F' as int)), 6) as base_rate,
           cast(sum(sum(lines)) over (partition by league) - sum(lines) as bigint) as training
    from f where fold is not null group by 1, 2""")
def _(v):
    from ..operators.sequences import fold_of
    from ..scale import group_values

    f = fold_of(v.player_game, ["league"], ["game_day", "game"])
    per = f.groupBy("league", "fold").agg(
        F.count(F.lit(1)).alias("games"), F.sum("lines").alias("actions"),
        F.avg((F.col("status") == "F").cast("int")).alias("base_rate"))
    out = group_values(per, ["league"], _all=F.sum("actions"))
    return rounded(out.withColumn("training", F.col("_all") - F.col("actions")).drop("_all"))


@query("W10_group_percentiles", """
    select player, win, cast(floor(100 * (rank() over (partition by grp order by minutes) - 1)
                             / count(*) over (partition by grp)) as bigint) as pct
    from v_player_window""")
def _(v):
    return gr.percentiles(v.player_window, ["grp"], "minutes").select("player", "win", "pct")


@query("W11_rank_among_subset", """
    select id, case when price >= 950 then row_number() over (partition by price >= 950
                    order by round(value, 4) desc, id) end as rank
    from v_market""")
def _(v):
    m = v.market.withColumn("s", F.round("value", 4))
    return gr.rank_among(m, "id", F.col("price") >= 950, "s").select("id", "rank")


@query("W12_spearman", """
    with p as (select a.grp, a.minutes as x, b.minutes as y from v_player_window a join v_player_window b
               using (player) where a.win = 1 and b.win = 2),
    r as (select grp, rank() over (partition by grp order by x) + (count(*) over (partition by grp, x) - 1) / 2 as rx,
                 rank() over (partition by grp order by y) + (count(*) over (partition by grp, y) - 1) / 2 as ry from p)
    select grp, round(corr(rx, ry), 6) as spearman from r group by 1""")
def _(v):
    p = ex.window_pairs(v.player_window, ["grp", "player"])
    return rounded(ex.spearman(p, ["grp"], "minutes_w1", "minutes_w2"))


@query("W15_expected_reciprocal_rank", """
    select league, grp, count(*) as m,
           round(list_sum(list_transform(range(1, count(*) + 1), lambda x: 1.0::double / x)) / count(*), 6) as expected
    from v_entity group by all""")
def _(v):
    per = v.entity.groupBy("league", "grp").agg(F.count(F.lit(1)).alias("m"))
    return rounded(per.withColumn("expected", nm.expected_reciprocal_rank(F.col("m"))))


@query("W16_survival_share", """
    with r as (select grp, minutes as u from v_player_window where win = 1),
    q as (select grp, player, minutes as v from v_player_window where win = 2)
    select q.grp, q.player, q.v, round(count(*) filter (where r.u >= q.v) / count(*), 6) as closeness
    from q join r using (grp) group by all""")
def _(v):
    t = v.player_window
    ref = t.filter("win = 1").select("grp", F.col("minutes").alias("u"))
    ask = t.filter("win = 2").select("grp", "player", F.col("minutes").alias("v"))
    return rounded(gr.survival_share(ref, ask, ["grp"], "u", "v", ["player"]))


@query("T1_head_and_tail", """
    (select 'low' as side, team, player, minutes from v_player_window where win = 1 order by minutes, team, player limit 10)
    union all
    (select 'high', team, player, minutes from v_player_window where win = 1 order by minutes desc, team, player limit 10)""")
def _(v):
    from ..operators.checks import extreme_totals

    t = v.player_window.filter("win = 1").select("team", "player", "minutes")
    return (extreme_totals(t, "minutes", ["team", "player"], 10).select(F.lit("low").alias("side"), "*")
            .unionByName(extreme_totals(t, "minutes", ["team", "player"], 10, True)
                         .select(F.lit("high").alias("side"), "*")))


@query("T2_farthest_from_one", """
    with w as (select player, grp, sum(minutes) filter (where win = 1) / sum(minutes) filter (where win = 2) as r
               from v_player_window group by all)
    select grp, player, round(r, 6) as ratio from w where r is not null
    qualify row_number() over (partition by grp order by round(abs(r - 1), 9) desc, player) <= 20""")
def _(v):
    from pyspark.sql import Window

    p = ex.window_pairs(v.player_window, ["grp", "player"])
    p = p.withColumn("ratio", F.col("minutes_w1") / F.col("minutes_w2"))
    w = Window.partitionBy("grp").orderBy(F.desc(F.round(F.abs(F.col("ratio") - 1), 9)), "player")
    out = p.withColumn("_n", F.row_number().over(w)).filter("_n <= 20")
    return rounded(out.select("grp", "player", "ratio"))


@query("T3_top_with_breakdown", """
    with t as (select grp from v_market order by round(value, 4) desc, id limit 100)
    select g.grp, count(t.grp) as n from (select distinct p_type as grp from part
        union all select 'ABSENT') g left join t using (grp) group by 1""")
def _(v):
    top = v.market.orderBy(F.desc(F.round("value", 4)), "id").limit(100)
    return gr.class_counts(top, "grp", ["STANDARD", "ECONOMY", "PROMO", "LARGE", "SMALL", "MEDIUM", "ABSENT"])


@query("T4_top_tail_hits", """
    with p as (select player, arg_min(value, date) as first, arg_max(value, date) as last from v_valuation group by 1)
    select count(*) filter (where n <= 117 and last >= 1.5 * first) as hits,
           count(*) filter (where last >= 1.5 * first) as all_hits, count(*) as rows
    from (select *, row_number() over (order by first desc, player) as n from p)""")
def _(v):
    p = v.valuation.groupBy("player").agg(F.min_by("value", "date").alias("first"), F.max_by("value", "date").alias("last"))
    rose = F.col("last") >= 1.5 * F.col("first")
    top = p.orderBy(F.desc("first"), "player").limit(117)
    return top.agg(F.count_if(rose).alias("hits")).join(
        p.agg(F.count_if(rose).alias("all_hits"), F.count(F.lit(1)).alias("rows")))


@query("T6_page_of_ranking", """
    select id, round(value, 4) as value, (select count(*) from v_market) as total
    from v_market order by round(value, 4) desc, id limit 25 offset 50""")
def _(v):
    page = v.market.orderBy(F.desc(F.round("value", 4)), "id").offset(50).limit(25)
    return rounded(page.select("id", "value").join(v.market.agg(F.count(F.lit(1)).alias("total"))), 4)


@query("Q12_price_bands", """
    select o_orderkey, cast(o_totalprice >= 50000 as int) + cast(o_totalprice >= 100000 as int)
           + cast(o_totalprice >= 250000 as int) as band from orders""")
def _(v):
    return v.table("orders").select("o_orderkey", nm.band(F.col("o_totalprice"), [50000, 100000, 250000]).alias("band"))


@query("Q13_age_bands", """
    select o_orderkey, round(date_diff('day', cast(o_orderdate as date), date '2026-07-01') / 365.25, 6) as age,
           case when date_diff('day', cast(o_orderdate as date), date '2026-07-01') / 365.25 < 23 then 'under 23'
                when date_diff('day', cast(o_orderdate as date), date '2026-07-01') / 365.25 < 27 then '23 to 26'
                when date_diff('day', cast(o_orderdate as date), date '2026-07-01') / 365.25 < 31 then '27 to 30'
                else '31 and over' end as band
    from orders""")
def _(v):
    years = nm.age(F.to_date(F.lit("2026-07-01")), F.to_date("o_orderdate"))
    return rounded(v.table("orders").select("o_orderkey", years.alias("age"), nm.age_band(years).alias("band")))


@query("X1_text_folding", r"""
    select doc_id, md5(trim(regexp_replace(strip_accents(replace(replace(replace(replace(replace(replace(
        lower(replace(text, chr(160), ' ')), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o'), 'ł', 'l'), 'đ', 'd')),
        '[^a-z0-9]+', ' ', 'g'))) as folded
    from documents""")
def _(v):
    return v.table("documents").select("doc_id", F.md5(tx.fold(F.col("text"))).alias("folded"))


@query("X2_club_folding", r"""
    select s_suppkey, array_to_string(list_filter(string_split(trim(regexp_replace(lower('FC ' || s_name || ' Calcio de ' || n_name),
             '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x not in ('fc', 'calcio', 'de')), ' ') as club
    from supplier join nation on s_nationkey = n_nationkey""")
def _(v):
    s = v.table("supplier").join(v.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    raw = F.concat(F.lit("FC "), "s_name", F.lit(" Calcio de "), "n_name")
    return s.select("s_suppkey", tx.fold_club(raw).alias("club"))


@query("X4_token_containment", r"""
    with t as (select a.doc_id, string_split(trim(regexp_replace(lower(coalesce(source, '') || ' ' || lang), '[^a-z0-9]+', ' ', 'g')), ' ') as own,
                      string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') || ['en', 'src1', 'src2', 'fr'] as pool
               from documents a)
    select doc_id, len(list_filter(own, lambda x: not list_contains(pool, x))) = 0 as contained from t""")
def _(v):
    own = tx.fold(F.concat_ws(" ", "source", "lang"))
    ascii_text = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    hit = tx.tokens_contained(own, [ascii_text, F.lit("en src1 src2 fr")], 2)
    return v.table("documents").select("doc_id", hit.alias("contained"))


POSITIONS = ["Goalkeeper", "Left Center Back", "Right Wing Back", "Left Center Midfield", "Center Attacking Midfield",
             "Left Midfield", "Right Wing", "Center Forward", "Substitute"]


@query("X5_position_rules", f"""
    with n as (select o_orderkey, ({POSITIONS!r})[o_orderkey % 9 + 1] as name from orders)
    select o_orderkey, case when name = 'Goalkeeper' then 'GK' when contains(name, 'Center Back') then 'CB' when contains(name, 'Back') then 'FB'
             when contains(name, 'Defensive Midfield') or contains(name, 'Center Midfield') then 'MID'
             when contains(name, 'Wing') or contains(name, 'Attacking Midfield') or name in ('Left Midfield', 'Right Midfield') then 'WIDE'
             when contains(name, 'Forward') or contains(name, 'Striker') then 'FWD' end as grp from n""")
def _(v):
    name = F.element_at(F.array(*[F.lit(x) for x in POSITIONS]), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return v.table("orders").select("o_orderkey", name.alias("name")).select("o_orderkey", tx.position_group(F.col("name")).alias("grp"))


@query("X6_logit_and_map", """
    select id, round(ln(p) - ln(1 - p), 6) as logit,
           round(1 / (1 + exp(-(0.2 + 0.8 * (ln(p) - ln(1 - p))))), 6) as mapped from v_prob""")
def _(v):
    p = F.col("p")
    return rounded(v.prob.select("id", sc.logit(p).alias("logit"),
                                 sc.recalibrated(p, F.lit(0.2), F.lit(0.8)).alias("mapped")))


@query("X7_fit_score", """
    select id, round((v1[1]*v2[1] + v1[4]*v2[4] + v1[6]*v2[6] + v1[7]*v2[7] + v1[8]*v2[8]
                      + (v1[2]*v2[2] + v1[3]*v2[3] + v1[5]*v2[5]) / 3) / 6, 8) as score from v_vector""")
def _(v):
    products = {d: F.get("v1", F.lit(i)) * F.get("v2", F.lit(i)) for i, d in enumerate(nm.FIT_WEIGHTS)}
    return rounded(v.vector.select("id", nm.fit_score(products).alias("score")), 8)


@query("X8_missing_as_zero", """
    select coalesce(a.player, b.player) as player, round(coalesce(a.r, 0), 3) as first,
           round(coalesce(b.r, 0), 3) as second,
           array_to_string(list_filter([case when a.r is null then 0 end, case when b.r is null then 1 end],
                           lambda x: x is not null), ',') as missing
    from (select player, value / minutes as r from v_player_window where win = 1) a
    full join (select player, value / minutes as r from v_player_window where win = 2) b on a.player = b.player""")
def _(v):
    r = F.col("value") / F.col("minutes")
    wide = v.player_window.groupBy("player").agg(
        F.max(F.when(F.col("win") == 1, r)).alias("a"), F.max(F.when(F.col("win") == 2, r)).alias("b"))
    vec = nm.vector(["a", "b"])
    return wide.select("player", F.round(vec[0], 3).alias("first"), F.round(vec[1], 3).alias("second"),
                       F.array_join(nm.missing_places(["a", "b"]).cast("array<string>"), ",").alias("missing"))


@query("X12_budgets", """
    select grp, floor(10 * quantile_cont(price, 0.25))::bigint as b25, floor(10 * quantile_cont(price, 0.5))::bigint as b50,
           floor(10 * quantile_cont(price, 0.75))::bigint as b75 from v_market group by 1""")
def _(v):
    q = quantiles(v.market, ["grp"], "price", {"b25": 0.25, "b50": 0.5, "b75": 0.75})
    return q.select("grp", *[F.floor(10 * F.col(c)).alias(c) for c in ("b25", "b50", "b75")])


@query("X13_decision_rules", """
    with s as (select league, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) as la, avg((p - y) ** 2) as ha,
                      avg(-(y2 * ln(p) + (1 - y2) * ln(1 - p))) as lb, avg((p - y2) ** 2) as hb
               from v_prob group by 1)
    select league, case when lb <= la and hb < ha then 'b' when la <= lb and ha <= hb then 'a' else 'mixed' end as chosen
    from s""")
def _(v):
    a = sc.probability_scores(v.prob, "y", "p", ["league"]).select("league", F.col("log_loss").alias("la"), F.col("brier").alias("ha"))
    b = sc.probability_scores(v.prob, "y2", "p", ["league"]).select("league", F.col("log_loss").alias("lb"), F.col("brier").alias("hb"))
    pick = sc.chosen_depth(F.col("la"), F.col("ha"), F.col("lb"), F.col("hb"), "a", "b")
    return a.join(b, "league").select("league", pick.alias("chosen"))


@query("X14_display_rounding", """
    select o_orderkey, cast(round(cast(o_totalprice as decimal(18, 2)), 1) as double) as away,
           cast(round_even(cast(o_totalprice as decimal(18, 2)), 1) as double) as even from orders""")
def _(v):
    p = F.col("o_totalprice")
    return v.table("orders").select("o_orderkey", nm.fixed(p, 1).alias("away"), nm.rounded_even(p, 1).alias("even"))


@query("Q19_filtered_listing", """
    select id, cast(row_number() over (order by round(value, 4) desc, id) as bigint) as rank from v_market
    where grp = 'PROMO' and size between 5 and 30 and (cast(price >= 950 as int) + cast(price >= 980 as int)) <= 1""")
def _(v):
    m = v.market.filter((F.col("grp") == "PROMO") & F.col("size").between(5, 30)
                        & (nm.band(F.col("price"), [950, 980]) <= 1))
    out = m.select("id", (-F.round("value", 4)).alias("_s"))
    return numbered(out, [], ["_s", "id"], "rank").select("id", "rank")


@query("Q20_name_search", """
    select c_custkey, c_name from customer where contains(lower(replace(c_name, '#', ' ')), 'customer 0000001')
    order by c_name limit 10""")
def _(v):
    return tx.search(v.table("customer"), "CUSTOMER 0000001", ["c_name"], "c_name").select("c_custkey", "c_name")


@query("Q21_list_edits", """
    with t as (select p_brand, list_sort(list(p_partkey)) as base, list_sort(list(p_partkey) filter (p_size <= 10)) as gone,
                      list_sort(list(p_partkey + 1) filter (p_partkey % 5 = 0)) as more from part group by 1),
    k as (select *, list_filter(base, lambda x: not coalesce(list_contains(gone, x), false)) as kept from t),
    e as (select p_brand, list_concat(kept, list_filter(coalesce(more, []), lambda x: not list_contains(kept, x))) as ids from k)
    select p_brand, len(ids) as n, list_sum(ids)::bigint as total, array_to_string(ids, ',') as ids from e""")
def _(v):
    key = F.col("p_partkey")
    per = v.table("part").groupBy("p_brand").agg(
        F.sort_array(F.collect_list(key)).alias("base"), F.sort_array(F.collect_list(F.when(F.col("p_size") <= 10, key))).alias("gone"),
        F.sort_array(F.collect_list(F.when(key % 5 == 0, key + 1))).alias("more"))
    ids = per.select("p_brand", gr.edited(F.col("base"), F.col("gone"), F.col("more")).alias("ids"))
    return ids.select("p_brand", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
                      F.array_join("ids", ",").alias("ids"))


@query("M10_calibrated_routing", """
    with c as (select league, -0.1 + len(league) * 0.05 as b0, 0.9 as b1 from v_prob group by 1),
    u as (select id, league, case when id % 3 = 0 then p * 0.9 else p end as used from v_prob)
    select id, round(used, 6) as used, round(1 / (1 + exp(-(b0 + b1 * (ln(used) - ln(1 - used))))), 6) as calibrated
    from u join c using (league)""")
def _(v):
    oof = v.prob.filter("id % 3 = 0").select("id", (F.col("p") * 0.9).alias("p"))
    coef = v.prob.groupBy("league").agg(F.lit(0.9).alias("slope")).withColumn(
        "intercept", F.lit(-0.1) + F.length("league") * 0.05)
    return rounded(sc.routed(v.prob, oof, ["id"], "p", coef, ["league"]).select("id", "used", "calibrated"))


@query("M5_error_scores", """
    with w as (select a.league, a.grp, a.value / a.minutes * 90 / 1e5 as x, b.value / b.minutes * 90 / 1e5 as y, b.minutes as m2
               from v_player_window a join v_player_window b using (player) where a.win = 1 and b.win = 2),
    p as (select *, 'all' as subset from w union all select *, 'league ' || league from w),
    l as (select subset, y, 0.5 / m2 as noise, unnest(['P0', 'P1', 'P2']) as predictor,
                 unnest([1.0::double, 0.5 * x + 0.6, x]) as v from p),
    r as (select *, rank() over (partition by subset, predictor order by v) + (count(*) over (partition by subset, predictor, v) - 1) / 2 as rv,
                 rank() over (partition by subset, predictor order by y) + (count(*) over (partition by subset, predictor, y) - 1) / 2 as ry from l),
    s as (select subset, predictor, count(*) as pairs, sum((y - v) ** 2) as sse, sum((y - v) ** 2) - sum(noise) as tse,
                 case when min(v) < max(v) then regr_slope(y, v) end as slope,
                 case when min(v) < max(v) then regr_intercept(y, v) end as intercept,
                 case when min(v) < max(v) then corr(rv, ry) end as spearman from r group by 1, 2)
    select s.subset, s.predictor, s.pairs, round(s.sse, 6) as sse, round(s.tse, 6) as tse,
           round(s.tse / b.tse, 6) as tse_ratio, round(s.sse / b.sse, 6) as raw_ratio,
           round(s.slope, 6) as slope, round(s.intercept, 6) as intercept, round(s.spearman, 6) as spearman
    from s join s b on b.subset = s.subset and b.predictor = 'P2'""")
def _(v):
    p = ex.window_pairs(v.player_window, ["league", "grp", "player"])
    x, y = F.col("per_ninety_w1") / 1e5, F.col("per_ninety_w2") / 1e5
    rows = p.select("league", y.alias("y"), (0.5 / F.col("minutes_w2")).alias("noise"),
                    F.lit(1.0).alias("P0"), (0.5 * x + 0.6).alias("P1"), x.alias("P2"))
    tags = F.array(F.lit("all"), F.concat(F.lit("league "), F.col("league").cast("string")))
    return rounded(sc.error_scores(rows, "y", ["P0", "P1", "P2"], "noise", tags, "P2"))


@query("M17_error_records", """
    with l as (select league, unnest(['a', 'b']) as model, y, unnest([p, 0.5]) as v from v_prob)
    select league, model, round(sum((y - v) ** 2), 6) as sse, round(count(*) * 0.01, 6) as noise, count(*) as rows
    from l group by 1, 2""")
def _(v):
    long = v.prob.select("league", "y", F.lit(0.01).alias("noise"), F.col("p").alias("a"), F.lit(0.5).alias("b")).unpivot(
        ["league", "y", "noise"], ["a", "b"], "model", "v")
    return rounded(sc.error_records(long, ["league", "model"], "y", "v", "noise"))


@query("U5_pivot_unpivot_ratios", """
    with r as (select league, sum((y - p) ** 2) as a, sum((y - 0.5) ** 2) as b, sum((y - 0.8) ** 2) as c from v_prob group by 1)
    select league, unnest(['a/b', 'c/a']) as comparison, round(unnest([a / b, c / a]), 6) as ratio,
           round(unnest([a - b, c - a]), 6) as difference from r""")
def _(v):
    long = v.prob.select("league", "y", F.lit(0.0).alias("noise"), F.col("p").alias("a"), F.lit(0.5).alias("b"),
                         F.lit(0.8).alias("c")).unpivot(["league", "y", "noise"], ["a", "b", "c"], "model", "v")
    rec = sc.error_records(long, ["league", "model"], "y", "v", "noise")
    return rounded(sc.model_ratios(rec, ["league"], ["a", "b", "c"], "sse", [("a", "b"), ("c", "a")]))


@query("M26_percentile_intervals", """
    select grp, round(quantile_cont(r, 0.025), 6) as p2_5, round(quantile_cont(r, 0.975), 6) as p97_5,
           round(median(r), 6) as median
    from (select grp, value / minutes * 90 as r from v_player_window) group by 1""")
def _(v):
    return rounded(sc.percentile_intervals(v.player_window, ["grp"], "per_ninety"))


@query("M27_verdicts", """
    with d as (select p_type as grp, p_partkey % 200 as value, p_retailprice from part),
    e as (select grp, p_retailprice - 901 as value from d)
    select grp, round(avg(value), 6) as point, round(quantile_cont(value, 0.025), 6) as p2_5,
           round(quantile_cont(value, 0.975), 6) as p97_5, round(median(value), 6) as median,
           count(*) filter (where value < 0) as below, count(*) as draws,
           count(*) filter (where value < 0) >= 0.975 * count(*) as passes
    from e group by 1""")
def _(v):
    d = v.table("part").select(F.col("p_type").alias("grp"), (F.col("p_retailprice") - 901).alias("value"))
    points = d.groupBy("grp").agg(F.avg("value").alias("point"))
    return rounded(sc.verdicts(d, points, ["grp"]))


@query("C4_monotone_map_bins", """
    select 0::bigint as differing, count(*) as rows from v_prob""")
def _(v):
    q = v.prob.withColumn("q", sc.recalibrated(F.col("p"), F.lit(0.3), F.lit(0.7)))
    a = sc.binned(q, "p", ["league"]).withColumnRenamed("bin", "bin_p")
    both = sc.binned(a, "q", ["league"])
    return both.agg(F.count_if(F.col("bin") != F.col("bin_p")).alias("differing"), F.count(F.lit(1)).alias("rows"))


@query("M16_style_fit_products", """
    with p as (select player, win, league, grp, value / minutes as a, offensive / minutes as b from v_player_window),
    c as (select *, a - avg(a) over w as ca, b - avg(b) over w as cb from p window w as (partition by league, grp))
    select player, win, round((ca * cb - avg(ca * cb) over (partition by league, grp)) / 1e6, 6) as fit from c""")
def _(v):
    m = F.col("minutes")
    p = v.player_window.withColumns({"a": F.col("value") / m, "b": F.col("offensive") / m})
    c = ex.cell_centred(p, ["league", "grp"], ["a", "b"])
    c = c.withColumn("fit", F.col("c_a") * F.col("c_b"))
    out = ex.cell_centred(c, ["league", "grp"], ["fit"])
    return rounded(out.select("player", "win", (F.col("c_fit") / 1e6).alias("fit")))
