"""Co-event graphs, cohorts of movers and record linkage."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numbers import vector
from ..operators import cohorts as co
from ..operators import graph as gh
from ..operators import groups as gr
from ..operators import joins as jn
from ..operators import linkage as lk
from ..operators import sequences as sq
from ..session import checkpointed
from .registry import query, rounded

PASS_SQL = """
    select team, least(player, receiver) as player_a, greatest(player, receiver) as player_b, count(*) as n
    from (select *, case when lead(team) over w = team and lead(player) over w <> player then lead(player) over w end as receiver
          from v_action window w as (partition by game, period order by action))
    where receiver is not null and type in ('pass', 'cross', 'take_on') group by all"""
PRESS_SQL = """
    select a.team, least(a.player, b.player) as player_a, greatest(a.player, b.player) as player_b, count(*) as n
    from (select *, cast(round(seconds * 1000) as bigint) as ms from v_action) a
    join (select *, cast(round(seconds * 1000) as bigint) as ms from v_action) b
         on a.game = b.game and a.period = b.period and a.team = b.team and a.player <> b.player
         and (b.ms > a.ms or (b.ms = a.ms and a.player < b.player)) and b.ms <= a.ms + 300000
    group by all"""
KEPT = """
    select distinct team, player_a, player_b from (
      select *, row_number() over (partition by team, node order by n desc, partner) as place from (
        select team, player_a, player_b, n, player_a as node, player_b as partner from {t} where n >= 2
        union all select team, player_a, player_b, n, player_b, player_a from {t} where n >= 2)) where place <= 3"""
LINKS_SQL = f"""
    pc as ({PASS_SQL}), qc as ({PRESS_SQL}), pk as ({KEPT.format(t='pc')}), qk as ({KEPT.format(t='qc')}),
    mk as (select team, player_a, player_b, max(p) as p, max(q) as q from
           (select *, 1 as p, 0 as q from pk union all select *, 0, 1 from qk) group by 1, 2, 3),
    links as (select m.team, m.player_a, m.player_b, case when q = 0 then 'pass' when p = 0 then 'press' else 'both' end as kind,
                     coalesce(pc.n, 0) as n_pass, coalesce(qc.n, 0) as n_press
              from mk m left join pc on pc.team = m.team and pc.player_a = m.player_a and pc.player_b = m.player_b
              left join qc on qc.team = m.team and qc.player_a = m.player_a and qc.player_b = m.player_b)"""


def passes(v):
    r = sq.receivers(v.action).filter(F.col("type").isin("pass", "cross", "take_on"))
    return gh.pass_counts(r, ["team"])


def presses(v, keep=None, wanted=None):
    e = v.action.select("game", "period", "team", "player", F.round(F.col("seconds") * 1000).cast("long").alias("ms"))
    return jn.band_pairs(e, ["game", "period", "team"], "player", "ms", 300_000, by=["team"], keep=keep, wanted=wanted)


def links(v):
    """Of the presses only what a link can need is kept: each player's most frequent ones and those of the pairs linked by passes."""
    given = checkpointed(passes(v))
    needed = checkpointed(presses(v, (2, 3), gh.kept_links(given, ["team"], least=2, partners=3)))
    return gh.merged_kinds(given, needed, ["team"], least=2, partners=3)


def nodes(v):
    return v.action.select("team", "player").distinct()


@query("U4_unordered_pair_counts", PASS_SQL)
def _(v):
    return passes(v)


@query("W14_kept_partners", f"with pc as ({PASS_SQL}) {KEPT.format(t='pc')}")
def _(v):
    return gh.kept_links(passes(v), ["team"], least=2, partners=3)


@query("U2_link_kinds", f"with {LINKS_SQL} select * from links")
def _(v):
    return links(v)


@query("M29_co_event_graph", f"""
    with {LINKS_SQL} select team, kind, count(*) as links, cast(sum(n_pass) as bigint) as n_pass,
         cast(sum(n_press) as bigint) as n_press from links group by 1, 2""")
def _(v):
    return links(v).groupBy("team", "kind").agg(
        F.count(F.lit(1)).alias("links"), F.sum("n_pass").alias("n_pass"), F.sum("n_press").alias("n_press"))


@query("J17_on_nodes", f"""
    with pc as ({PASS_SQL}), nd as (select team, player from v_action group by 1, 2 having count(*) >= 65)
    select pc.* from pc where exists (select 1 from nd where nd.team = pc.team and nd.player = player_a)
    and exists (select 1 from nd where nd.team = pc.team and nd.player = player_b)""")
def _(v):
    regular = v.action.groupBy("team", "player").agg(F.count(F.lit(1)).alias("n")).filter("n >= 65")
    return jn.on_nodes(passes(v), regular, ["team"], "player")


@query("A37_link_statistics", f"""
    with {LINKS_SQL}, nd as (select distinct team, player from v_action),
    e as (select team, player_a as player from links union all select team, player_b from links),
    d as (select nd.team, nd.player, count(e.player) as deg from nd left join e using (team, player) group by 1, 2),
    a as (select team, count(*) as nodes, avg(deg) as mean_degree, count(*) filter (where deg = 0) as isolated from d group by rollup(team)),
    k as (select team, count(*) filter (where kind = 'pass') as pass, count(*) filter (where kind = 'press') as press,
                 count(*) filter (where kind = 'both') as both from links group by rollup(team))
    select a.team, nodes, round(mean_degree, 6) as mean_degree, isolated, coalesce(pass, 0) as pass, coalesce(press, 0) as press,
           coalesce("both", 0) as "both" from a left join k on a.team is not distinct from k.team""".replace(" as both from", ' as "both" from'))
def _(v):
    return rounded(gh.link_report(nodes(v), checkpointed(links(v)), "team", ["team"], "player"))


@query("U3_unlinked_pairs", f"""
    with {LINKS_SQL}, n as (select team, count(distinct player) as k from v_action group by 1)
    select team, k * (k - 1) // 2 as pairs, (select count(*) from links where links.team = n.team) as linked,
           k * (k - 1) // 2 - (select count(*) from links where links.team = n.team) as unlinked from n""")
def _(v):
    return gh.unlinked_counts(nodes(v), links(v), ["team"])


FEATURES = """
    with_type as (select player, case when type in ('pass', 'shot', 'cross') then type end as kind, sum(value) as m from v_action group by 1, 2),
    main as (select player, coalesce(arg_min(kind, (-m, kind)) filter (where kind is not null), 'UNKNOWN') as kind from with_type group by 1),
    feat as (select player, coalesce(avg(start_x), 0) / 100 as x, coalesce(avg(end_y), 0) / 100 as y from v_action group by 1)"""
KINDS = ["cross", "pass", "shot"]


def features(v):
    return gh.node_features(v.action, "player", "type", KINDS, {"x": F.col("start_x") / 100, "y": F.col("end_y") / 100}, F.col("value"))


@query("M30_node_features", f"""
    with {FEATURES} select player, round(x, 6) as x, round(y, 6) as y, (kind = 'cross')::int as is_cross, (kind = 'pass')::int as is_pass, (kind = 'shot')::int as is_shot,
           (kind = 'UNKNOWN')::int as "is_UNKNOWN" from feat join main using (player)""")
def _(v):
    return rounded(features(v))


@query("M31_two_hop_means", f"""
    with {LINKS_SQL}, f as (select player, avg(start_x) / 100 as x from v_action group by 1),
    e as (select player_a as node, player_b as partner from links union all select player_b, player_a from links),
    one as (select f.player, any_value(f.x) as x, coalesce(avg(g.x), 0) as near_x from f left join e on e.node = f.player
            left join f g on g.player = e.partner group by 1)
    select o.player, round(o.x, 6) as x, round(o.near_x, 6) as near_x,
           (select round(coalesce(avg(p.x), 0), 6) from e join one p on p.player = e.partner where e.node = o.player) as near_x2,
           (select round(coalesce(avg(p.near_x), 0), 6) from e join one p on p.player = e.partner where e.node = o.player) as near_near_x
    from one o""")
def _(v):
    e = gh.both_ends(checkpointed(links(v)), [])
    f = features(v).select(F.col("player").alias("node"), "x")
    one = gh.neighbour_means(f, e, ["x"])
    two = gh.neighbour_means(one.withColumnRenamed("near_x", "m"), e, ["x", "m"])
    return rounded(two.select(F.col("node").alias("player"), "x", F.col("m").alias("near_x"),
                              F.col("near_x").alias("near_x2"), F.col("near_m").alias("near_near_x")))


HIDDEN_SQL = f"""
    {LINKS_SQL}, h as (select *, ('0x' || substr(md5('1-' || player_a || '-' || player_b), 1, 8))::bigint as hv from links),
    pos as (select team, player_a, player_b, 1 as y from h where hv < 429496729),
    asked as (select team, count(*) as n from pos group by 1),
    nd as (select team, player, row_number() over (partition by team order by player) as pos, count(*) over (partition by team) as n
           from (select distinct team, player from v_action)),
    free as (select team, max(n) * (max(n) - 1) // 2 - (select count(*) from links l where l.team = nd.team) as free from nd group by 1),
    want as (select asked.* from asked join free using (team) where free >= 2 * asked.n),
    dense as (select x.team, least(x.player, z.player) as player_a, greatest(x.player, z.player) as player_b, asked.n
              from asked join free using (team) join nd x on x.team = asked.team join nd z on z.team = x.team and z.pos > x.pos where free < 2 * asked.n),
    dk as (select *, row_number() over (partition by team order by ('0x' || substr(md5('0-' || team || '-' || player_a || '-' || player_b), 1, 8))::bigint, player_a, player_b) as place
           from dense where not exists (select 1 from links l where l.team = dense.team and l.player_a = dense.player_a and l.player_b = dense.player_b)),
    sl as (select w.team, k.n, unnest(range(0, 14 * w.n)) as slot from want w join (select distinct team, n from nd) k using (team)),
    hs as (select *, ('0x' || substr(md5('0-' || team || '-' || slot || '-a'), 1, 8))::bigint % n + 1 as i, ('0x' || substr(md5('0-' || team || '-' || slot || '-b'), 1, 8))::bigint % (n - 1) as d from sl),
    dr as (select team, least(i, 1 + (i + d) % n) as i, greatest(i, 1 + (i + d) % n) as j, min(slot) as slot from hs group by 1, 2, 3),
    pr as (select dr.team, slot, least(x.player, z.player) as player_a, greatest(x.player, z.player) as player_b from dr
           join nd x on x.team = dr.team and x.pos = i join nd z on z.team = dr.team and z.pos = j),
    fr as (select *, row_number() over (partition by team order by slot) as place from pr
           where not exists (select 1 from links l where l.team = pr.team and l.player_a = pr.player_a and l.player_b = pr.player_b)),
    neg as (select team, player_a, player_b, 0 as y from fr join want using (team) where place <= want.n
            union all select team, player_a, player_b, 0 from dk where place <= n)"""


def hidden_and_negatives(v):
    l = gh.split_links(checkpointed(links(v)), ["player_a", "player_b"], 0.1, seed=1)
    pos = l.filter("hidden").select("team", "player_a", "player_b", F.lit(1).alias("y"))
    neg = gh.balanced_negatives(nodes(v), l, pos.groupBy("team").agg(F.count(F.lit(1)).alias("n")), ["team"], "player")
    return l, pos.unionByName(neg.withColumn("y", F.lit(0)))


@query("M32_balanced_negatives", f"""
    with {HIDDEN_SQL} select * from pos union all select * from neg""")
def _(v):
    return hidden_and_negatives(v)[1]


@query("M32_link_prediction_auc", f"""
    with {HIDDEN_SQL}, f as (select player, avg(start_x) / 50 - 1 as a, avg(start_y) / 50 - 1 as b, avg(end_x) / 50 - 1 as c from v_action group by 1),
    s as (select y, round(x.a * z.a + x.b * z.b + x.c * z.c, 9) as score from (select * from pos union all select * from neg)
          join f x on x.player = player_a join f z on z.player = player_b),
    r as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2 as rk from s)
    select count(*) filter (where y = 1) as positives, count(*) filter (where y = 0) as negatives,
           round((sum(rk) filter (where y = 1) - count(*) filter (where y = 1) * (count(*) filter (where y = 1) + 1) / 2)
                 / nullif(count(*) filter (where y = 1) * count(*) filter (where y = 0), 0), 6) as auc
    from r""")
def _(v):
    pairs = hidden_and_negatives(v)[1]
    cols = {c: F.avg(s) / 50 - 1 for c, s in (("a", "start_x"), ("b", "start_y"), ("c", "end_x"))}
    f = v.action.groupBy("player").agg(*[c.alias(n) for n, c in cols.items()])
    vec = f.select("player", vector(["a", "b", "c"]).alias("vec"))
    scored = gh.pair_scores(pairs, vec, "player", "vec").withColumn("score", F.round("score", 9))
    return rounded(gh.auc(scored, [], F.col("y") == 1, "score"))


@query("M32_learned_link_scores")
def _(v):
    l, test = hidden_and_negatives(v)
    kept = l.filter("not hidden").select("team", "player_a", "player_b", F.lit(1).alias("y"))
    barred = test.select("team", "player_a", "player_b").unionByName(l.select("team", "player_a", "player_b"))
    count = kept.groupBy("team").agg(F.count(F.lit(1)).alias("n"))
    train = kept.unionByName(gh.balanced_negatives(nodes(v), barred, count, ["team"], "player", seed=2).withColumn("y", F.lit(0)))
    f = features(v)
    two = gh.two_hop(f.withColumnRenamed("player", "node"), gh.both_ends(kept, []), [c for c in f.columns if c != "player"])
    vec = two.select(F.col("node").alias("player"), F.array(F.lit(1.0), *[F.col(c).cast("double") for c in two.columns if c != "node"]).alias("vec"))
    scored = gh.learned_link_scores(train, test, vec, "player", "vec").withColumn("score", F.round("score", 9))
    return rounded(gh.auc(scored, ["team"], F.col("y") == 1, "score"))


# ---- cohorts

MAIN = """
    main as (select player, to_club as main_club from (select player, to_club, count(*) as n from v_move group by all)
             qualify row_number() over (partition by player order by n desc, to_club) = 1)"""


def main_clubs(v):
    n = v.move.groupBy("player", "to_club").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("player").agg(F.min_by("to_club", F.struct(-F.col("n"), "to_club")).alias("main_club"))


def day(s):
    return F.to_date(F.lit(s))


WINDOW = ("2024-01-05", "2024-01-20")
QUALIFYING = f"""
    q as (select m.* from v_move m join main on main.player = m.player and main_club = from_club
          where date between date '{WINDOW[0]}' and date '{WINDOW[1]}')"""


def qualifying(v):
    return co.qualifying_moves(v.move, main_clubs(v), between=(day(WINDOW[0]), day(WINDOW[1])))


@query("J11_earliest_move", f"""
    with {MAIN}, {QUALIFYING}
    select player, event_id, date, from_club, to_club, fee from q
    qualify row_number() over (partition by player order by date, to_club, event_id) = 1""")
def _(v):
    out = co.earliest_moves(qualifying(v), "player", ["date", "to_club", "event_id"])
    return out.select("player", "event_id", "date", "from_club", "to_club", "fee")


@query("J11_earliest_move_legacy", f"""
    with {MAIN}, {QUALIFYING}
    select player, min(date) as date, arg_min(to_club, (date, to_club, event_id)) as to_club,
           arg_min(fee, (date, to_club, event_id)) filter (where fee is not null) as fee from q group by 1""")
def _(v):
    out = co.earliest_moves(qualifying(v), "player", ["date", "to_club", "event_id"], legacy=True)
    return out.select("player", "date", "to_club", "fee")


MIRRORS = """
    mir as (select a.event_id, count(b.event_id) as n_mirrors,
                   coalesce(bool_or((b.fee is null or b.fee = 0) and b.date < a.date), false) as earlier,
                   coalesce(bool_or((b.fee is null or b.fee = 0) and b.date > a.date), false) as later,
                   coalesce(bool_or(b.date = a.date), false) as same_day
            from v_move a left join v_move b on b.player = a.player and b.from_club = a.to_club and b.to_club = a.from_club
                 and b.date between a.date - 3 and a.date + 3 group by 1),
    lab as (select v_move.*, n_mirrors, earlier, later, same_day,
                   case when fee > 0 and n_mirrors > 0 then 'paid_mirror' when fee > 0 then 'paid'
                        when earlier and later then 'both' when earlier then 'loan_return' when later then 'loan_out'
                        else 'free_other' end as label
            from v_move join mir using (event_id))"""


def labelled(v):
    d = F.col("date")
    return co.mirror_labels(v.move, v.move, ["event_id"], F.date_sub(d, 3), F.date_add(d, 3))


@query("J12_mirror_labels", f"with {MIRRORS} select event_id, n_mirrors, earlier, later, same_day, label from lab")
def _(v):
    return labelled(v).select("event_id", "n_mirrors", "earlier", "later", "same_day", "label")


@query("L6_mover_cohort", f"""
    with {MIRRORS} select event_id, label, label in ('paid', 'paid_mirror') or (label = 'free_other' and day(date) <> 15) as permanent,
         label = 'loan_out' as sensitivity, to_club in ('click', 'view') as in_scope from lab""")
def _(v):
    out = co.cohort_rules(labelled(v), F.dayofmonth("date") == 15)
    return out.select("event_id", "label", "permanent", "sensitivity", F.col("to_club").isin("click", "view").alias("in_scope"))


@query("A24_conversion_funnel", f"""
    with {MIRRORS}
    select to_club as club, count(*) as n1, count(*) filter (where fee > 0) as n2, count(*) filter (where fee > 0 and player % 2 = 0) as n3,
           count(*) filter (where fee > 0 and player % 2 = 0 and n_mirrors > 0) as n4 from lab group by rollup(to_club)""")
def _(v):
    steps = {"n1": F.lit(True), "n2": F.col("fee") > 0, "n3": F.col("player") % 2 == 0, "n4": F.col("n_mirrors") > 0}
    return gr.funnel(labelled(v).withColumnRenamed("to_club", "club"), "club", steps)


LABELS = ["paid", "paid_mirror", "both", "loan_return", "loan_out", "free_other"]


@query("C27_cohort_report", f"""
    with {MIRRORS}, l as (select label, 'moved' as level from lab union all select label, 'linked' from lab where player % 2 = 0
        union all select label, 'regular' from lab where player % 2 = 0 and event_id % 3 = 0)
    select level, {', '.join(f"count(*) filter (where label = '{x}') as {x}" for x in LABELS)} from l group by 1""")
def _(v):
    levels = {"moved": F.lit(True), "linked": F.col("player") % 2 == 0, "regular": F.col("event_id") % 3 == 0}
    return co.label_counts(labelled(v), levels, LABELS)


# ---- linkage: customers' and suppliers' names, blocked by nation


def left_names(v):
    c = v.table("customer")
    name = tx.fold(F.concat(F.lit("Supplier "), F.substring("c_name", -6, 6)))
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("block"), name.alias("name"),
                    tx.fold(F.col("c_name")).alias("nick"))


def right_names(v):
    s = v.table("supplier")
    return s.select(F.col("s_suppkey").alias("other"), F.col("s_nationkey").alias("block"), tx.fold(F.col("s_name")).alias("target"))


FOLDED = lambda text: f"trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'))"
NAMED = f"""
    l as (select c_custkey as id, c_nationkey as block, unnest([{FOLDED("'Supplier ' || right(c_name, 6)")}, {FOLDED("c_name")}]) as name from customer),
    r as (select s_suppkey as other, s_nationkey as block, {FOLDED("s_name")} as target from supplier),
    s as (select id, other, max(1 - levenshtein(name, target) / greatest(length(name), length(target))) as score from l join r using (block) group by 1, 2)"""


@query("L2_match_with_margin", f"""
    with {NAMED}, k as (select *, row_number() over (partition by id order by round(score, 9) desc, other) as n from s),
    b as (select id, max(other) filter (where n = 1) as other, max(score) filter (where n = 1) as score, coalesce(max(score) filter (where n = 2), 0) as second from k group by 1)
    select c_custkey as id, case when score >= 0.85 and score - second >= 0.05 - 1e-12 then other end as linked, round(coalesce(score, 0), 6) as score,
           round(coalesce(second, 0), 6) as second,
           case when score >= 0.85 and score - second >= 0.05 - 1e-12 then 'matched' when score >= 0.85 then 'ambiguous' else 'unmatched' end as status
    from customer left join b on id = c_custkey""")
def _(v):
    best = lk.best_two(left_names(v), right_names(v), ["block"], "id", "other", ["name", "nick"], "target")
    out = lk.match_with_margin(left_names(v).select("id"), best, "id", "other")
    return rounded(out.select("id", "linked", "score", "second", "status"))


@query("L3_match_unique_hit", f"""
    with {NAMED}, h as (select id, count(*) as n, min(other) as other from s where score >= 0.92 - 1e-12 group by 1)
    select c_custkey as id, case when n = 1 then other end as linked, coalesce(n, 0) as hits,
           case when n = 1 then 'linked' when n > 1 then 'ambiguous' when c_nationkey in (select block from r) then 'below_threshold' else 'no_candidate' end as status
    from customer left join h on id = c_custkey""")
def _(v):
    hits = lk.at_least(left_names(v), right_names(v), ["block"], "id", "other", ["name", "nick"], "target", 0.92)
    out = lk.match_unique_hit(left_names(v).select("id", "block"), hits, right_names(v), ["block"], "id", "other", 0.92 - 1e-12)
    return out.select("id", "linked", "hits", "status")


@query("L1_candidate_blocks", """
    select n_regionkey as league, o_orderstatus as club, count(distinct c_custkey) as players from orders
    join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 1, 2""")
def _(v):
    c = lk.season_candidates(v.game, ["league", "status"], "player", [])
    return c.groupBy("league", F.col("status").alias("club")).agg(F.count(F.lit(1)).alias("players"))


TOKENS = r"""
    l as (select c_custkey as id, c_nationkey as block, trim(regexp_replace(lower(c_mktsegment || ' ' || (c_custkey % 7)), '[^a-z0-9]+', ' ', 'g')) as name,
                 case when c_custkey % 4 = 0 then 'matched' else 'unmatched' end as status from customer),
    r as (select s_suppkey as other, s_nationkey as block, trim(regexp_replace(lower(
              case s_suppkey % 5 when 0 then 'BUILDING' when 1 then 'MACHINERY' when 2 then 'HOUSEHOLD' when 3 then 'FURNITURE' else 'AUTOMOBILE' end
              || ' ' || (s_suppkey % 7) || ' ' || ((s_suppkey + 3) % 7)), '[^a-z0-9]+', ' ', 'g')) as target from supplier)"""


@query("L4_token_pass", f"""
    with {TOKENS},
    h as (select id, count(*) as n, min(other) as other from l join r using (block) where status = 'unmatched'
          and len(list_filter(string_split(name, ' '), lambda x: not list_contains(string_split(target, ' '), x))) = 0 group by 1)
    select id, case when status = 'matched' then -id when n = 1 then other end as linked,
           case when status <> 'matched' and n = 1 then 2 when status = 'matched' then 1 end as link_pass,
           case when status = 'matched' or n = 1 then 'matched' else 'unmatched' end as status
    from l left join h using (id)""")
def _(v):
    k = F.col("c_custkey")
    first = v.table("customer").select(
        k.alias("id"), F.col("c_nationkey").alias("block"), tx.fold(F.concat_ws(" ", "c_mktsegment", (k % 7).cast("string"))).alias("name"),
        F.when(k % 4 == 0, "matched").otherwise("unmatched").alias("status"), F.when(k % 4 == 0, -k).alias("linked"))
    s = F.col("s_suppkey")
    word = (F.when(s % 5 == 0, "BUILDING").when(s % 5 == 1, "MACHINERY").when(s % 5 == 2, "HOUSEHOLD")
            .when(s % 5 == 3, "FURNITURE").otherwise("AUTOMOBILE"))
    right = v.table("supplier").select(
        s.alias("other"), F.col("s_nationkey").alias("block"),
        tx.fold(F.concat_ws(" ", word, (s % 7).cast("string"), ((s + 3) % 7).cast("string"))).alias("target"))
    out = lk.token_pass(first, right, ["block"], "id", "other", "name", ["target"], ["unmatched"])
    return out.select("id", "linked", "link_pass", "status")


@query("A29_name_overlap", """
    with m as (select n_regionkey as league, n_nationkey as team, n_nationkey as club from nation),
    p as (select n_regionkey as league, c_nationkey as team, c_custkey as id, 'n' || c_custkey % 40 as name
          from customer join nation on n_nationkey = c_nationkey),
    c as (select distinct n_regionkey as league, s_nationkey as club, 'n' || s_suppkey % 40 as name from supplier join nation on n_nationkey = s_nationkey),
    h as (select p.league, p.team, c.club, count(distinct id) as n from p join c on c.league = p.league and c.name = p.name group by all)
    select m.league, m.team, coalesce(max(n) filter (where h.club = m.club), 0) as own, coalesce(max(n) filter (where h.club <> m.club), 0) as other
    from m left join h on h.league = m.league and h.team = m.team group by 1, 2""")
def _(v):
    n = v.table("nation").select(F.col("n_regionkey").alias("league"), F.col("n_nationkey").alias("team"), F.col("n_nationkey").alias("club"))
    name = lambda c: F.concat(F.lit("n"), (F.col(c) % 40).cast("string"))
    players = v.entity.select("league", "team", F.col("player").alias("id"), name("player").alias("name"))
    s = v.table("supplier").join(n.select("league", F.col("club").alias("s_nationkey")), "s_nationkey")
    c = s.select("league", F.col("s_nationkey").alias("club"), name("s_suppkey").alias("name"))
    return lk.name_overlap(n, players, c, "league", "team", "club", ["name"], "name", "id")


ASSIGN = """
    s as (select a.n_regionkey as league, a.n_nationkey as team, b.n_nationkey as club,
                 ((a.n_nationkey * 31 + b.n_nationkey * 17 + a.n_nationkey * b.n_nationkey) % 97) / 97.0::double as score
          from nation a join nation b using (n_regionkey))"""


def club_scores(v):
    a = v.table("nation").select(F.col("n_regionkey").alias("league"), F.col("n_nationkey").alias("team"))
    b = a.select("league", F.col("team").alias("club"))
    t, c = F.col("team"), F.col("club")
    return a.join(b, "league").withColumn("score", ((t * 31 + c * 17 + t * c) % 97) / 97)


@query("L5_one_to_one_assignment", f"""
    with {ASSIGN}, r as (select *, row_number() over (partition by league, club order by team) as i,
                               dense_rank() over (partition by league order by team) as ti from s),
    p1 as (select league, club as c1, score as v from r where ti = 1),
    p2 as (select p.*, club as c2, v + score as v2 from p1 p join r using (league) where ti = 2 and club <> c1),
    p3 as (select p.*, club as c3, v2 + score as v3 from p2 p join r using (league) where ti = 3 and club not in (c1, c2)),
    p4 as (select p.*, club as c4, v3 + score as v4 from p3 p join r using (league) where ti = 4 and club not in (c1, c2, c3)),
    p5 as (select p.*, club as c5, v4 + score as v5 from p4 p join r using (league) where ti = 5 and club not in (c1, c2, c3, c4))
    select league, round(max(v5), 6) as total, 5::bigint as teams from p5 group by 1""")
def _(v):
    s = club_scores(v)
    out = lk.assign(s, ["league"], "team", "club").join(s, ["league", "team", "club"])
    return rounded(out.groupBy("league").agg(F.sum("score").alias("total"), F.count_distinct("club").alias("teams")))


@query("L5_independent_best", f"""
    with {ASSIGN} select league, team, arg_min(club, (-score, club)) as best from s group by 1, 2""")
def _(v):
    return lk.independent_best(club_scores(v), ["league"], "team", "club")


@query("L7_main_league", """
    select user_id, round(sum(value), 4) as minutes, arg_min(event_type, (-value, event_type)) as league from events group by 1""")
def _(v):
    return rounded(lk.main_league(v.table("events"), "user_id", "event_type", "value"), 4)


@query("X3_levenshtein_option", """
    select c_custkey, s_suppkey, levenshtein(c_name, s_name) as edits from customer join supplier on c_nationkey = s_nationkey""")
def _(v):
    c = v.table("customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("block"))
    s = v.table("supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("block"))
    return lk.block_edits(c, s, ["block"], "c_custkey", "s_suppkey", "c_name", "s_name")
