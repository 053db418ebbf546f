"""Sequences of actions and what is derived from their order."""

from pyspark.sql import functions as F

from ..operators import joins as jn
from ..operators import profiles as pf
from ..operators import sequences as sq
from .registry import query, rounded


@query("W1_sequence_ids", "select game, period, action, cast(seq as bigint) as seq from v_seq1")
def _(v):
    o = sq.with_positions(sq.ordered(v.action))
    return o.df.select("game", "period", "action", "seq")


@query("W2_sequence_duration", """
    select game, period, action, round(seq_duration, 6) as seq_duration from v_seq2""")
def _(v):
    o = sq.with_spans(sq.with_positions(sq.ordered(v.action)))
    return rounded(o.df.select("game", "period", "action", "seq_duration"))


@query("W3_creation_flag", "select game, period, action, creates from v_seq")
def _(v):
    return v.sequenced_once.select("game", "period", "action", "creates")


@query("W4_time_to_zone", """
    select game, period, cast(seq as bigint) as seq, round(seconds, 6) as seconds from v_times""")
def _(v):
    return rounded(sq.buildup_times(v.sequenced_once))


@query("W5_receivers", """
    select action, case when lead(team) over w = team and lead(player) over w <> player
                        then lead(player) over w end as receiver
    from v_action window w as (partition by game, period order by action)""")
def _(v):
    return sq.receivers(v.action).select("action", "receiver")


@query("W6_assist_goal_flags", """
    select action, type = 'shot' as open_shot, type = 'shot' and success as open_goal, assist
    from v_seq""")
def _(v):
    o = sq.with_runs(sq.with_spans(sq.with_positions(sq.ordered(v.action))))
    return sq.with_outcome_flags(o).df.select("action", "open_shot", "open_goal", "assist")


@query("W7_direction_flip", """
    select action, case when team <> home then 100 - start_x else start_x end as start_x,
           case when team <> home then 100 - end_y else end_y end as end_y
    from v_action join (select game, home from v_match) using (game)""")
def _(v):
    out = sq.play_left_to_right(v.action, v.match, length=100.0, width=100.0)
    return out.select("action", "start_x", "end_y")


@query("W8_alternating_deal", """
    with s as (select game, game_day, home as team, true as at_home from v_match
               union all select game, game_day, away, false from v_match)
    select game, team, case when (row_number() over (partition by team, at_home
               order by game_day, game) % 2 = 1) = at_home then 'A' else 'B' end as half
    from s""")
def _(v):
    sides = jn.expand_sides(v.match, ["game", "game_day"])
    return sq.alternate(sides, ["team"], ["game_day", "game"]).select("game", "team", "half")


@query("W9_round_robin_folds", """
    select game, cast((row_number() over (partition by league order by game_day, game_date, game) - 1) % 5
                      as int) as fold from v_game""")
def _(v):
    return sq.fold_of(v.game, ["league"], ["game_day", "game_date", "game"]).select("game", "fold")


@query("M11_action_values", """
    with p as (select *, (start_x + 1) / 200 as ps, (101 - end_x) / 400 as pc from v_action),
    b as (select *, lag(ps) over w as s, lag(pc) over w as c, lag(team) over w as t
          from p window w as (partition by game order by period, action))
    select action, round(ps - coalesce(case when t = team then s else c end, 0), 6) as offensive,
           round(-(pc - coalesce(case when t = team then c else s end, 0)), 6) as defensive
    from b""")
def _(v):
    a = v.action.withColumns({"ps": (F.col("start_x") + 1) / 200, "pc": (101 - F.col("end_x")) / 400})
    return rounded(sq.action_values(a, "ps", "pc").select("action", "offensive", "defensive"))


@query("M12_outcome_labels", """
    with a as (select a.*, home, away from v_action a join (select game, home, away from v_match) using (game)),
    f as (select *, max(case when type = 'shot' and success and team = home then 1 else 0 end) over w as h,
                 max(case when type = 'shot' and success and team = away then 1 else 0 end) over w as w
          from a window w as (partition by game order by period, action
                              rows between current row and 9 following))
    select action, case when team = home then h else w end = 1 as scores,
           case when team = home then w else h end = 1 as concedes from f""")
def _(v):
    a = v.action.join(v.match.select("game", "home", "away"), "game")
    goal = (F.col("type") == "shot") & F.col("success")
    return sq.outcome_labels(a, goal).select("action", "scores", "concedes")


@query("M13_previous_features", """
    with a as (select *, row_number() over w as n, lag(start_x) over w as x1, lag(start_x, 2) over w as x2,
                      lag(type) over w as t1, lag(seconds) over w as s1
               from v_action window w as (partition by game order by period, action))
    select action, start_x as x_0, coalesce(x1, start_x) as x_1, coalesce(x2, x1, start_x) as x_2,
           cast(coalesce(t1, type) = 'pass' as int) as type_1_pass,
           cast(coalesce(t1, type) = 'shot' as int) as type_1_shot,
           round(seconds - coalesce(s1, seconds), 6) as delta_1
    from a""")
def _(v):
    values = {"x": F.col("start_x"), "kind": F.col("type"), "t": F.col("seconds")}
    out = sq.previous_features(v.action, values)
    hot = sq.one_hot("kind_1", ["pass", "shot"], "type_1")
    return rounded(out.withColumns(hot).withColumn("delta_1", F.col("t_0") - F.col("t_1")).select(
        "action", "x_0", "x_1", "x_2", "type_1_pass", "type_1_shot", "delta_1"))


@query("X9_pressed_player", """
    with rel as (select event_id, team, unnest([event_id - 2, event_id + 1, event_id - 1]) as rid,
                        unnest([1, 2, 3]) as ord from v_action where type = 'tackle'),
    f as (select r.event_id, arg_min(o.player, ord) as pressed_player
          from rel r join v_action o on o.event_id = r.rid where o.team <> r.team group by 1)
    select a.event_id, start_x as x, start_y as y, pressed_player
    from v_action a left join f using (event_id) where type = 'tackle'""")
def _(v):
    e = F.col("event_id")
    press = v.action.filter("type = 'tackle'").select(
        "event_id", "team", F.array(e - 2, e + 1, e - 1).alias("related_events"),
        F.array("start_x", "start_y").alias("location"))
    return sq.pressed_players(press, v.action).select("event_id", "x", "y", "pressed_player")


@query("A38_game_summary", """
    select game, count(*) as events, count(*) filter (where type = 'tackle') as pressures,
           count(*) filter (where type = 'shot') as shots,
           round(avg(start_x) filter (where type = 'shot'), 6) as mean_shot_x
    from v_action group by 1""")
def _(v):
    kind = F.col("type")
    return rounded(v.action.groupBy("game").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(kind == "tackle").alias("pressures"),
        F.count_if(kind == "shot").alias("shots"),
        F.avg(F.when(kind == "shot", F.col("start_x"))).alias("mean_shot_x")))


DIMENSION_SQL = """
    select {by}, avg(cast(seq_duration > 10 as int)) filter (where op) as possession,
           avg(abs(start_y - 50)) filter (where op) as width,
           avg(cast(type = 'take_on' as int)) filter (where op) as dribble,
           avg(cast(creates as int)) filter (where op) as creation,
           case when sum(len) filter (where pl) > 0 then
                sum(case when end_x > start_x then len else 0 end) filter (where pl)
                / sum(len) filter (where pl) end as verticality,
           avg(start_x / 100) filter (where not op) as depth,
           count(*) filter (where op) as n_open, count(*) filter (where pl) as n_verticality,
           count(*) filter (where not op) as n_depth
    from (select *, type <> 'tackle' as op, type in ('pass', 'cross') as pl,
                 sqrt((end_x - start_x) ** 2 + (end_y - start_y) ** 2) as len from v_seq)
    group by {by}"""
BUILDUP_SQL = """
    select {by}, -avg(seconds) as buildup, count(*) as n_buildup
    from (select distinct {by}, game, period, seq from v_seq) join v_times using (game, period, seq)
    group by {by}"""
SHOWN = ["possession", "width", "dribble", "creation", "verticality", "depth", "buildup"]
ROUNDED = ", ".join(f"round({d}, 6) as {d}" for d in SHOWN)


@query("A12_player_dimensions", f"""
    with d as ({DIMENSION_SQL.format(by='team, player')}), b as ({BUILDUP_SQL.format(by='team, player')})
    select team, player, {ROUNDED}, n_open as n_possession, n_verticality, n_depth,
           coalesce(n_buildup, 0) as n_buildup from d left join b using (team, player)""")
def _(v):
    out = pf.action_dimensions(v.sequenced, v.times, ["team", "player"], length=100.0, width=100.0)
    return rounded(out.select("team", "player", *SHOWN, "n_possession", "n_verticality", "n_depth",
                              "n_buildup"))


@query("A12_team_dimensions", f"""
    with d as ({DIMENSION_SQL.format(by='league, team')}), b as ({BUILDUP_SQL.format(by='league, team')})
    select league, team, {ROUNDED}, coalesce(n_buildup, 0) as n_buildup
    from d left join b using (league, team)""")
def _(v):
    out = pf.action_dimensions(v.sequenced, v.times, ["league", "team"], length=100.0, width=100.0)
    return rounded(out.select("league", "team", *SHOWN, "n_buildup"))


SHARE_SQL = """
    select s.game, s.team, coalesce(o.n, 0) / nullif(coalesce(m.n, 0) + coalesce(o.n, 0), 0) as share
    from (select game, home as team, away as opp from v_match
          union all select game, away, home from v_match) s
    left join (select game, team, count(*) as n from v_action where type <> 'tackle' group by all) m
         on m.game = s.game and m.team = s.team
    left join (select game, team, count(*) as n from v_action where type <> 'tackle' group by all) o
         on o.game = s.game and o.team = s.opp"""
PRESS_SQL = f"""
    with sh as ({SHARE_SQL}),
    lu as (select game, team, player, count(*) * 3e0 as minutes from v_action group by all),
    m as (select team, player, sum(minutes) as m, sum(minutes * share) as w
          from lu join sh using (game, team) group by 1, 2),
    n as (select team, player, count(*) as n from v_action where type = 'tackle' and start_x > 60 group by all)
    select team, player, coalesce(n, 0) / m * 90 * 0.5 / (w / m) as pressing, m as n_pressing
    from m left join n using (team, player)"""
TEAM_PRESS_SQL = f"""
    with sh as ({SHARE_SQL}), s as (select team, count(*) as g, avg(share) as s from sh group by 1),
    n as (select team, count(*) as n from v_action where type = 'tackle' and start_x > 60 group by all)
    select team, coalesce(n, 0) / g * 0.5 / s as pressing, g as n_pressing from s left join n using (team)"""


def pressing(v, keys=("team", "player")):
    a = v.action
    share = pf.opponent_share(a.filter(F.col("type").isin(*pf.IN_POSSESSION)), v.match, ["game"], "game")
    high = a.filter("type = 'tackle' and start_x > 60")
    if list(keys) == ["team"]:
        return pf.team_pressing(high, share, keys)
    lineups = a.groupBy("game", "team", "player").agg((F.count(F.lit(1)) * 3.0).alias("minutes"))
    return pf.player_pressing(high, lineups, share, keys)


@query("A13_player_pressing", f"""
    select team, player, round(pressing, 6) as pressing, n_pressing from ({PRESS_SQL})""")
def _(v):
    return rounded(pressing(v))


@query("A13_team_pressing", f"""
    select team, round(pressing, 6) as pressing, n_pressing from ({TEAM_PRESS_SQL})""")
def _(v):
    return rounded(pressing(v, ["team"]))


PROFILE_SQL = f"""
    select coalesce(d.team, p.team) as team, coalesce(d.player, p.player) as player, pressing,
           possession, buildup, width, verticality, depth, dribble, creation
    from ({DIMENSION_SQL.format(by='team, player')}) d
    left join ({BUILDUP_SQL.format(by='team, player')}) b using (team, player)
    full join ({PRESS_SQL}) p on p.team = d.team and p.player = d.player"""
ALL = pf.DIMENSIONS


def profiles(v):
    dims = pf.action_dimensions(v.sequenced, v.times, ["team", "player"], length=100.0, width=100.0)
    return pf.assembled(dims, pressing(v), ["team", "player"])


@query("A14_profile_assembly", f"""
    select team, player, {', '.join(f'round({d}, 6) as {d}' for d in ALL)} from ({PROFILE_SQL})""")
def _(v):
    return rounded(profiles(v).select("team", "player", *ALL))


@query("A10_moments_and_z", f"""
    with p as ({PROFILE_SQL}),
    m as (select team, {', '.join(f'avg({d}) as m_{d}, stddev_samp({d}) as s_{d}' for d in ALL)}
          from p where dribble > 0.2345 group by 1)
    select team, player, {', '.join(f'round(({d} - m_{d}) / s_{d}, 5) as z_{d}' for d in ALL)}
    from p left join m using (team)""")
def _(v):
    p = profiles(v)
    stats = pf.moments(p.filter("dribble > 0.2345"), ["team"], ALL)
    return rounded(pf.standardised(p, stats, ["team"], ALL).select(
        "team", "player", *[f"z_{d}" for d in ALL]), 5)


@query("A15_pooled_parts", """
    select team, player, count(*) filter (where type <> 'tackle') as n_width,
           round(avg(abs(start_y - 50)) filter (where type <> 'tackle'), 6) as width,
           count(*) filter (where type = 'tackle') as n_depth,
           round(avg(start_x / 100) filter (where type = 'tackle'), 6) as depth
    from v_action group by all""")
def _(v):
    sums = lambda d: pf.dimensions(
        pf.action_sums(d, ["team", "player"], 100.0, 100.0).withColumns(
            {"s_buildup": F.lit(0.0), "n_buildup": F.lit(0)}), ["team", "player"])
    odd, even = (v.sequenced.filter(F.col("game_day") % 2 == r) for r in (1, 0))
    out = pf.pooled(sums(odd), sums(even), ["team", "player"], ["width", "depth"])
    return rounded(out)


@query("A16_basic_numbers", """
    select team, player, count(*) filter (where type = 'shot' and success) as goals,
           round(count(*) filter (where type = 'shot') / (count(*) * 3e0) * 90, 6) as shots_per_ninety,
           round(count(*) filter (where assist) / (count(*) * 3e0) * 90, 6) as assists_per_ninety,
           round(ln(count(*) * 3e0), 6) as log_minutes
    from v_seq group by 1, 2""")
def _(v):
    o = sq.with_outcome_flags(sq.with_runs(sq.with_spans(sq.with_positions(sq.ordered(v.action)))))
    per = o.df.groupBy("team", "player").agg(
        (F.count(F.lit(1)) * 3.0).alias("minutes"), F.count_if("open_goal").alias("goals"),
        F.count_if("open_shot").alias("shots"), F.count_if("assist").alias("assists"))
    m = F.col("minutes")
    return rounded(per.select("team", "player", "goals", (F.col("shots") / m * 90).alias("shots_per_ninety"),
                              (F.col("assists") / m * 90).alias("assists_per_ninety"),
                              F.log(m).alias("log_minutes")))


def left_out(v):
    keys, cols = ["league", "team"], ["n_open", "n_played", "n_defensive", "s_long", "s_width", "s_dribble",
                                      "s_creation", "s_forward", "s_length", "s_depth"]
    sums = pf.action_sums(v.sequenced, [*keys, "player"], 100.0, 100.0)
    rest = pf.leave_one_out(sums, keys, "player", cols)
    times = pf.leave_one_out_buildup(v.sequenced, v.times, keys, "player", ["game", "period"])
    return pf.dimensions(rest.join(times, [*keys, "player"]), [*keys, "player"])


@query("A17_leave_one_out_profile", """
    with s as (select *, type <> 'tackle' as op from v_seq),
    t as (select team, count(*) filter (where op) as n, sum(abs(start_y - 50)) filter (where op) as w,
                 sum(cast(creates as int)) filter (where op) as c from s group by 1),
    p as (select team, player, count(*) filter (where op) as n,
                 coalesce(sum(abs(start_y - 50)) filter (where op), 0) as w,
                 coalesce(sum(cast(creates as int)) filter (where op), 0) as c from s group by 1, 2),
    q as (select distinct team, game, period, seq, seconds from v_seq s join v_times t using (game, period, seq)
          ) , q2 as (select team, game, period, seq, max(seconds_t) as sec from
              (select s.team, s.game, s.period, s.seq, t.seconds as seconds_t
               from v_seq s join v_times t on t.game = s.game and t.period = s.period and t.seq = s.seq) group by all),
    tq as (select team, sum(sec) as s, count(*) as n from q2 group by 1),
    pq as (select team, player, sum(sec) as s, count(*) as n from
             (select distinct team, player, game, period, seq from v_seq) join q2 using (team, game, period, seq)
           group by 1, 2)
    select p.team, p.player, round((t.w - p.w) / (t.n - p.n), 6) as width,
           round((t.c - p.c) / (t.n - p.n), 6) as creation,
           round(-(tq.s - coalesce(pq.s, 0)) / (tq.n - coalesce(pq.n, 0)), 6) as buildup,
           tq.n - coalesce(pq.n, 0) as n_buildup
    from p join t using (team) join tq using (team)
    left join pq on pq.team = p.team and pq.player = p.player""")
def _(v):
    return rounded(left_out(v).select("team", "player", "width", "creation", "buildup", "n_buildup"))


@query("C19_leave_nobody_out", """
    with p as (select team, player, sum(abs(start_y - 50)) filter (where type <> 'tackle') as w
               from v_action group by all),
    a as (select team, sum(w) as w from p group by 1),
    t as (select team, sum(abs(start_y - 50)) filter (where type <> 'tackle') as w from v_action group by 1)
    select round(max(abs(a.w - t.w)), 6) as largest_gap from a join t using (team)""")
def _(v):
    keys = ["league", "team"]
    sums = pf.action_sums(v.sequenced, [*keys, "player"], 100.0, 100.0)
    cols = ["n_open", "s_width", "s_creation", "s_depth", "n_defensive"]
    again = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cols])
    whole = pf.action_sums(v.sequenced, keys, 100.0, 100.0).select(*keys, *[F.col(c).alias(f"w_{c}") for c in cols])
    gap = F.greatest(*[F.abs(F.col(c) - F.col(f"w_{c}")) for c in cols])
    return again.join(whole, keys).agg(F.round(F.max(gap), 6).alias("largest_gap"))


@query("A33_home_share_gap", """
    with s as (select game, game_day, home as team, 1 as h from v_match
               union all select game, game_day, away, 0 from v_match),
    w as (select *, case when game_day <= ceil(0.6 * (select max(game_day) from v_match))
                    then 'window 1' else 'window 2' end as scope from s),
    x as (select * from w union all select game, game_day, team, h, 'season' from w)
    select team, scope,
           round(abs(sum(h) filter (where game_day % 2 = 1) / nullif(count(*) filter (where game_day % 2 = 1), 0)
             - sum(h) filter (where game_day % 2 = 0) / nullif(count(*) filter (where game_day % 2 = 0), 0)), 6) as gap
    from x group by 1, 2""")
def _(v):
    from ..operators.exposure import boundaries

    cut = boundaries(v.match, []).select("boundary")
    s = jn.expand_sides(v.match, ["game_day"]).join(cut)
    window = F.when(F.col("game_day") <= F.col("boundary"), "window 1").otherwise("window 2")
    x = s.select("team", "game_day", "at_home", F.explode(F.array(window, F.lit("season"))).alias("scope"))
    odd = F.col("game_day") % 2 == 1
    home = F.col("at_home").cast("int")

    def share(mask):
        return F.avg(F.when(mask, home))

    return rounded(x.groupBy("team", "scope").agg(F.abs(share(odd) - share(~odd)).alias("gap")))


@query("C15_deal_balance", """
    with s as (select game, game_day, home as team, true as at_home from v_match
               union all select game, game_day, away, false from v_match),
    d as (select *, case when (row_number() over (partition by team, at_home order by game_day, game)
                  % 2 = 1) = at_home then 'A' else 'B' end as half from s)
    select team, count(*) filter (where half = 'A') as "A", count(*) filter (where half = 'B') as "B",
           count(*) filter (where half = 'A' and at_home) as home_a,
           count(*) filter (where half = 'B' and at_home) as home_b
    from d group by 1""")
def _(v):
    d = sq.alternate(jn.expand_sides(v.match, ["game", "game_day"]), ["team"], ["game_day", "game"])
    half, home = F.col("half"), F.col("at_home")
    return d.groupBy("team").agg(
        F.count_if(half == "A").alias("A"), F.count_if(half == "B").alias("B"),
        F.count_if((half == "A") & home).alias("home_a"), F.count_if((half == "B") & home).alias("home_b"))


HALF_SQL = """
    select team, player, case when game_day % 2 = 1 then 'A' else 'B' end as half, count(*) as minutes,
           avg(start_x) as a, avg(start_y) as b, avg(value) as c
    from v_action group by all"""


def halves(v):
    half = F.when(F.col("game_day") % 2 == 1, "A").otherwise("B").alias("half")
    return v.action.groupBy("team", "player", half).agg(
        F.count(F.lit(1)).alias("minutes"), F.avg("start_x").alias("a"), F.avg("start_y").alias("b"),
        F.avg("value").alias("c"))


@query("M21_halves_profiles", f"""
    with h as ({HALF_SQL}), m as (select avg(a) as ma, stddev_samp(a) as sa from
        (select avg(start_x) as a from v_action group by team, player))
    select team, player, half, minutes, round((a - ma) / sa, 6) as z_a from h, m""")
def _(v):
    whole = v.action.groupBy("team", "player").agg(F.avg("start_x").alias("a"))
    out = pf.standardised(halves(v), pf.moments(whole, [], ["a"]), [], ["a"])
    return rounded(out.select("team", "player", "half", "minutes", "z_a"))


@query("M20_half_correlations", f"""
    with h as ({HALF_SQL}), j as (select x.team, x.player, x.a as a1, y.a as a2, x.b as b1, y.b as b2,
        x.c as c1, y.c as c2 from h x join h y using (team, player) where x.half = 'A' and y.half = 'B'),
    r as (select team, 'a' as dimension, count(*) as rows, corr(a1, a2) as r from j group by 1
          union all select team, 'b', count(*), corr(b1, b2) from j group by 1
          union all select team, 'c', count(*), corr(c1, c2) from j group by 1)
    select team, dimension, rows, round(r, 6) as r, round(2 * r / (1 + r), 6) as stepped_up from r""")
def _(v):
    return rounded(pf.half_correlations(halves(v), ["team", "player"], "half", ["a", "b", "c"], ["team"]))


@query("M22_noise_reference", f"""
    with h as ({HALF_SQL})
    select x.team, x.player, round(sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2), 6) as d,
           round(sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2)
                 / sqrt(1.0 / x.minutes + 1.0 / y.minutes), 6) as u
    from h x join h y using (team, player)
    where x.half = 'A' and y.half = 'B' and x.minutes >= 25 and y.minutes >= 25""")
def _(v):
    out = pf.noise_reference(halves(v), ["team", "player"], ["a", "b", "c"], least=25)
    return rounded(out.select("team", "player", "d", "u"))
