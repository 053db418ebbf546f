"""Windows, exposure and rates."""

from pyspark.sql import functions as F

from ..operators import exposure as ex
from .registry import query, rounded

KEYS = ["league", "team", "player", "grp"]


@query("slice_centred_rates", """
    with t as (select *, value / minutes * 90 as per_ninety from v_player_window),
    lv as (select league, win, 90 * sum(value) / sum(minutes) as level from t group by all)
    select league, team, player, win, round(minutes, 6) as minutes, games,
           round(per_ninety, 6) as per_ninety, round(level, 6) as level,
           round(per_ninety - level, 6) as centred
    from t join lv using (league, win)""")
def _(v):
    t = ex.centred_rates(v.player_window, ["league", "win"])
    return rounded(t.select("league", "team", "player", "win", "minutes", "games", "per_ninety",
                            "level", "centred"))


@query("Q1_window_boundary", """
    select league, max(game_day) as last_day, cast(ceil(0.6 * max(game_day)) as int) as boundary
    from v_game group by 1""")
def _(v):
    return ex.boundaries(v.game, ["league"])


@query("Q2_window_assignment", """
    select league, game, game_day,
           case when game_day <= ceil(0.6 * max(game_day) over (partition by league))
                then 1 else 2 end as win
    from v_game""")
def _(v):
    g = v.game.select("league", "game", "game_day")
    return ex.assign_windows(g, ["league"])


@query("Q3_date_violations", """
    with g as (select *, game_date + cast(game % 40 as int) as shown,
                case when game_day <= ceil(0.6 * max(game_day) over (partition by league))
                     then 1 else 2 end as win from v_game),
    e as (select league, min(shown) filter (where win = 1) as first_w1,
                 max(shown) filter (where win = 1) as last_w1,
                 min(shown) filter (where win = 2) as first_w2,
                 max(shown) filter (where win = 2) as last_w2 from g group by 1)
    select league, first_w1, last_w1, first_w2, last_w2,
           count(*) filter (where win = 1 and shown > first_w2) as w1_after_first_w2,
           count(*) filter (where win = 2 and shown < last_w1) as w2_before_last_w1,
           cast(coalesce(max(case when win = 1 and shown > first_w2 then shown - first_w2
                         when win = 2 and shown < last_w1 then last_w1 - shown end), 0) as double)
               as largest_days
    from g join e using (league) group by all""")
def _(v):
    g = ex.assign_windows(v.game, ["league"])
    g = g.withColumn("shown", F.date_add("game_date", (F.col("game") % 40).cast("int")))
    return ex.date_violations(g, ["league"], "shown")


@query("A1_exposure_totals", """
    select league, team, player, sum(minutes) as minutes,
           count(*) filter (where minutes > 0) as games,
           count(*) filter (where status = 'F') as starts
    from v_player_game group by all""")
def _(v):
    return ex.exposure(v.player_game, ["league", "team", "player"], starter=F.col("status") == "F")


@query("A2_team_game_totals", """
    select league, team, game_day, sum(minutes) as minutes from v_player_game group by all""")
def _(v):
    return v.player_game.groupBy("league", "team", "game_day").agg(F.sum("minutes").alias("minutes"))


@query("A3_exposure_grains", """
    select 'team' as grain, status as team, player, sum(minutes) as minutes,
           count(*) filter (where minutes > 0) as games,
           arg_min(grp || game, (game_day, game)) as label
    from v_player_game group by all
    union all
    select 'entity', null, player, sum(minutes), count(*) filter (where minutes > 0),
           arg_min(grp || game, (game_day, game))
    from v_player_game group by all""")
def _(v):
    rows = v.player_game.drop("team").withColumnRenamed("status", "team")
    rows = rows.withColumn("tag", F.concat("grp", F.col("game").cast("string")))
    return ex.exposure_grains(rows, ["team"], ["player"], "tag", ["game_day", "game"])


@query("A4_windowed_exposure", """
    select league, team, player, win, sum(minutes) as minutes,
           count(*) filter (where minutes > 0) as games
    from v_windowed group by all""")
def _(v):
    return ex.exposure(v.windowed, ["league", "team", "player", "win"])


@query("A5_player_window_values", """
    select league, team, player, grp, win, minutes, games, round(value, 6) as value,
           round(offensive, 6) as offensive, round(defensive, 6) as defensive,
           round(value / minutes * 90, 6) as per_ninety
    from v_player_window""")
def _(v):
    exposed = ex.exposure(v.windowed, [*KEYS, "win"])
    out = ex.value_table(exposed, v.windowed, [*KEYS, "win"], ["value", "offensive", "defensive"])
    return rounded(out)


@query("Q8_rate_of_exposed", """
    select game, minutes, round(value / minutes * 90, 6) as per_ninety
    from v_player_game where minutes > 0""")
def _(v):
    out = ex.per_ninety(v.player_game, {"per_ninety": "value"})
    return rounded(out.select("game", "minutes", "per_ninety"))


@query("A7_league_levels", """
    select league, win, round(90 * sum(value) / sum(minutes), 6) as level
    from v_player_window group by all""")
def _(v):
    return rounded(ex.levels(v.player_window, ["league", "win"]))


@query("Q9_population", """
    select a.player, a.minutes, b.minutes as minutes_w2
    from v_player_window a join v_player_window b using (player)
    where a.win = 1 and b.win = 2 and a.minutes >= 450 and b.minutes >= 270
      and a.grp in ('BUILDING', 'FURNITURE', 'HOUSEHOLD')""")
def _(v):
    out = ex.population(v.player_window, ["player"], first=450, second=270, group="grp",
                        groups=["BUILDING", "FURNITURE", "HOUSEHOLD"])
    return out.select("player", "minutes", "minutes_w2")


@query("Q10_one_row_per_entity", """
    with t as (select user_id as player, event_type as team, sum(value) as minutes,
                      count(*) as games from events group by all)
    select player, team, round(minutes, 6) as minutes, games from t
    qualify row_number() over (partition by player order by round(minutes, 6) desc, team) = 1""")
def _(v):
    t = v.table("events").groupBy(F.col("user_id").alias("player"), F.col("event_type").alias("team"))
    t = t.agg(F.round(F.sum("value"), 6).alias("minutes"), F.count(F.lit(1)).alias("games"))
    return ex.one_per_entity(t, "player", "minutes", ["team"])


@query("A22_provider_minutes", """
    with l as (select l_partkey as id, l_linenumber as link_pass, l_quantity as minutes from lineitem)
    select id, sum(minutes) as total, max(minutes) as largest
    from l where link_pass <= 3 group by 1""")
def _(v):
    links = v.table("lineitem").select(
        F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("link_pass"),
        F.col("l_quantity").alias("minutes"))
    total = ex.provider_minutes(links, "id", "sum", passes=3).withColumnRenamed("minutes", "total")
    return total.join(
        ex.provider_minutes(links, "id", "max", passes=3).withColumnRenamed("minutes", "largest"), "id")


@query("A23_season_main", """
    with r as (select user_id as player, event_type as club, user_id % 3 + event_id % 4 as league,
                      event_id % 90 as minutes from events),
    t as (select player, cast(sum(minutes) as bigint) as total from r group by 1
          having sum(minutes) >= 450),
    c as (select player, club, sum(minutes) as m from r group by 1, 2
          qualify row_number() over (partition by player order by m desc, club) = 1),
    g as (select player, league, sum(minutes) as m from r group by 1, 2
          qualify row_number() over (partition by player order by m desc, league) = 1)
    select player, total, club as main_club, league as main_league
    from t join c using (player) join g using (player)""")
def _(v):
    e = F.col("event_id")
    rows = v.table("events").select(
        F.col("user_id").alias("player"), F.col("event_type").alias("club"),
        (F.col("user_id") % 3 + e % 4).alias("league"), (e % 90).alias("minutes"))
    return ex.season_main(rows, "player", {"main_club": "club", "main_league": "league"}, 450)


@query("M6_threshold_sensitivity", """
    with p as (select a.player, a.value / a.minutes * 90 as x, b.value / b.minutes * 90 as y,
                      a.minutes as m1, b.minutes as m2
               from v_player_window a join v_player_window b using (player)
               where a.win = 1 and b.win = 2),
    k as (select * from p join (values (180), (270), (360), (450)) a(t1) on m1 >= t1
          join (values (90), (180), (270)) b(t2) on m2 >= t2),
    r as (select *, rank() over (partition by t1, t2 order by x)
               + (count(*) over (partition by t1, t2, x) - 1) / 2.0 as rx,
               rank() over (partition by t1, t2 order by y)
               + (count(*) over (partition by t1, t2, y) - 1) / 2.0 as ry from k)
    select t1, t2, count(*) as pairs, round(corr(x, y), 6) as pearson,
           round(corr(rx, ry), 6) as spearman
    from r group by all""")
def _(v):
    pairs = ex.window_pairs(v.player_window, ["player"])
    grid = [(a, b) for a in (180, 270, 360, 450) for b in (90, 180, 270)]
    return rounded(ex.threshold_sensitivity(pairs, grid))


@query("A11_cell_centring", """
    select player, win, round(r - avg(r) over (partition by league, grp), 6) as centred
    from (select *, value / minutes * 90 as r from v_player_window)""")
def _(v):
    t = ex.cell_centred(v.player_window, ["league", "grp"], ["per_ninety"])
    return rounded(t.select("player", "win", F.col("c_per_ninety").alias("centred")))
