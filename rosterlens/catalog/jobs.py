"""Sources, sinks, learned models and whole jobs."""

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

from ..operators import checks as ck
from ..operators import exposure as ex
from ..operators import graph as gh
from ..operators import joins as jn
from ..operators import elastic as el
from ..operators import learners as ln
from ..operators import profiles as pf
from ..operators import replicates as rp
from ..operators import resample as rs
from ..operators import scoring as sc
from ..operators import search as se
from ..operators import sequences as sq
from ..session import checkpointed, scratch_folder
from ..sources import readers as rd
from .registry import query, rounded
from .sequences import ALL, HALF_SQL, PROFILE_SQL, halves, left_out, profiles

# ---- sources


@query("S1_csv_ingest", """
    select event_id, ts, nullif(event_type, 'click') as event_type, case when event_id % 3 = 0 then 'NA' else 'x' end as flag, value from events""")
def _(v):
    e = v.table("events")
    path = scratch_folder(v.spark, "csv")
    out = e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.nullif("event_type", F.lit("click")).alias("event_type"),
                   F.when(F.col("event_id") % 3 == 0, "NA").otherwise("x").alias("flag"), "value")
    out.write.option("header", True).option("compression", "gzip").option("nullValue", "").csv(path)
    schema = StructType([StructField("event_id", LongType()), StructField("ts", TimestampType()), StructField("event_type", StringType()),
                         StructField("flag", StringType()), StructField("value", DoubleType())])
    return rd.csv_table(v.spark, path, schema, ["ts"]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("S2_json_feed", """
    select cast(ts as date) as day, count(*) filter (where event_id % 500 <> 0) as events,
           count(*) filter (where event_id % 500 = 0) as failures from events group by 1""")
def _(v):
    line = F.to_json(F.struct("event_id", "user_id", "event_type", "value"))
    e = v.table("events").select(F.to_date("ts").alias("day"), F.when(F.col("event_id") % 500 == 0, F.substring(line, 1, 10)).otherwise(line).alias("value"))
    path = scratch_folder(v.spark, "feed")
    e.write.partitionBy("day").text(path)
    schema = StructType([StructField("event_id", LongType()), StructField("user_id", LongType()), StructField("event_type", StringType()), StructField("value", DoubleType())])
    good, bad = rd.json_feed(v.spark, path, schema, ["day"])
    n = good.groupBy("day").agg(F.count(F.lit(1)).alias("events"))
    m = bad.groupBy("day").agg(F.count(F.lit(1)).alias("failures"))
    return n.join(m, "day", "left").na.fill(0, ["failures"])


@query("S3_incremental_consolidation", """
    select 'left' as part, game, null as n_events from v_match where game % 4 = 0
    union all select 'done', m.game, n from v_match m left join (select game, count(*) as n from v_action where game % 3 > 0 group by 1) c
         on c.game = m.game where m.game % 4 <> 0""")
def _(v):
    g = v.match.select("game")
    done = g.filter("game % 4 <> 0")
    counts = v.action.filter("game % 3 > 0").groupBy("game").agg(F.count(F.lit(1)).alias("n_events"))
    left = rd.remaining(g, done, ["game"]).select(F.lit("left").alias("part"), "game", F.lit(None).cast("long").alias("n_events"))
    return left.unionByName(rd.consolidated(g, done, counts, ["game"]).select(F.lit("done").alias("part"), "game", "n_events"))


@query("S4_unicode_unescape", """
    select c_custkey, case when c_custkey % 2 = 0 then 'José ' || c_name else c_name end as name from customer
    where c_nationkey in (select s_nationkey from supplier)""")
def _(v):
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Jos\\u00e9 "), "c_name")).otherwise(F.col("c_name"))
    c = v.table("customer").select("c_custkey", F.col("c_nationkey").alias("s_nationkey"), raw.alias("name"))
    kept = c.join(v.table("supplier").select("s_nationkey"), "s_nationkey", "left_semi")
    return rd.decoded(kept, ["name"]).select("c_custkey", "name")


@query("S6_partitioned_lineups", """
    select p.game, p.league, case when team % 5 > 0 then 'NATION_' || team end as team_name, '1' as season from v_player_game p""")
def _(v):
    path = scratch_folder(v.spark, "lineups")
    rd.to_parquet(v.player_game.select("game", "team", "league"), path, ["league"])
    names = v.table("nation").filter("n_nationkey % 5 > 0").select(F.col("n_nationkey").alias("team"), F.col("n_name").alias("team_name"))
    return rd.partitioned_scan(v.spark, path, names, ["team"], "1").select("game", "league", "team_name", "season")


@query("S7_dated_valuation_scan", """
    select o_custkey, o_totalprice, o_orderdate from orders where o_orderdate <= timestamp '1998-08-31'""")
def _(v):
    return rd.dated_scan(v.table("orders"), ["o_custkey", "o_totalprice", "o_orderdate"], "o_orderdate", None,
                         F.lit("1998-08-31").cast("timestamp_ntz"))


@query("S8_dated_scan_with_list", """
    select o_orderkey, o_orderdate from orders where o_orderdate between timestamp '1997-07-01' and timestamp '1998-06-30'
    and o_orderpriority in ('1-URGENT', '5-LOW')""")
def _(v):
    return rd.dated_scan(v.table("orders"), ["o_orderkey", "o_orderdate"], "o_orderdate", F.lit("1997-07-01").cast("timestamp_ntz"),
                         F.lit("1998-06-30").cast("timestamp_ntz"), {"o_orderpriority": ["1-URGENT", "5-LOW"]})


@query("S9_window_bundle", """
    with g as (select game from (select game, league, game_day, max(game_day) over (partition by league) as m from v_match) where game_day <= ceil(0.6 * m))
    select 'actions' as part, count(*) as rows, count(distinct game) as games from v_action where type <> 'tackle' and game in (select game from g)
    union all select 'pressures', count(*), count(distinct game) from v_action where type = 'tackle' and game in (select game from g)""")
def _(v):
    g = ex.assign_windows(v.match, ["league"]).filter("win = 1")
    b = rd.window_bundle(g, {"actions": v.action.filter("type <> 'tackle'"), "pressures": v.action.filter("type = 'tackle'")}, ["game"])
    n = lambda d, p: d.groupBy("game").agg(F.count(F.lit(1)).alias("_n")).agg(F.sum("_n").alias("rows"), F.count("game").alias("games")).select(
        F.lit(p).alias("part"), "rows", "games")
    return n(b["actions"], "actions").unionByName(n(b["pressures"], "pressures"))


@query("S10_appearances_with_season", """
    select l_orderkey, l_linenumber, year(o_orderdate)::int as season from lineitem left join orders on o_orderkey = l_orderkey""")
def _(v):
    games = v.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("season"))
    return v.table("lineitem").select("l_orderkey", "l_linenumber").join(games, "l_orderkey", "left")


@query("S12_manifest")
def _(v):
    return rd.manifest(v.spark, f"{v.folder}/*.parquet", "tables").select("source", F.element_at(F.split("path", "/"), -1).alias("file"), "length")


@query("S15_feature_label_keys", """
    select count(*) filter (where l_orderkey is null) as only_features, count(*) filter (where o_orderkey is null) as only_labels
    from (select o_orderkey from orders) full join (select distinct l_orderkey from lineitem where l_quantity > 10) on l_orderkey = o_orderkey""")
def _(v):
    a = v.table("orders").select(F.col("o_orderkey").alias("k"))
    b = v.table("lineitem").filter("l_quantity > 10").select(F.col("l_orderkey").alias("k")).distinct()
    return rd.unmatched_keys(a, b, ["k"])


# ---- learned models

FEATURES = ["start_x", "start_y", "end_x", "end_y", "prev_x"]


def training(v):
    goal = (F.col("type") == "shot") & F.col("success")
    a = sq.outcome_labels(v.action.join(v.match.select("game", "home", "away"), "game"), goal)
    a = sq.previous_features(a, {"x": F.col("start_x")}, back=1)
    return a.select("action", "game", "league", "start_x", "start_y", "end_x", "end_y", F.col("x_1").alias("prev_x"),
                    F.col("scores").cast("double").alias("label"), (F.col("game") % 2).cast("int").alias("fold"))


@query("M7_boosted_classifier")
def _(v):
    rows = training(v)
    model = ln.classifier(rows.filter("fold = 0"), FEATURES, "label", depth=3, trees=3)
    p = ln.predicted(model, rows)
    return rounded(sc.probability_scores(p.withColumn("label", F.col("label").cast("int")), "label", "p", ["league"]))


@query("M8_out_of_fold_predictions")
def _(v):
    p = ln.out_of_fold(training(v), "fold", [0, 1], FEATURES, "label", depth=2, trees=2)
    return rounded(p.select("action", "fold", "p"))


@query("C32_shallower_fits")
def _(v):
    rows = training(v)
    model = ln.classifier(rows.filter("league = 0"), FEATURES, "label", depth=2, trees=2)
    p = ln.predicted(model, rows.filter("league = 1"))
    return rounded(p.groupBy("game").agg(F.avg("p").alias("p"), F.avg("label").alias("observed")))


GROUPS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL"]
# one class of each kind has no share of its own, as the shares add up to 1
SHARES = {"flag": ["A", "N"], "status": ["F"], "line": list(range(1, 7)), "year": list(range(1995, 2001)), "source": list(range(16))}
BASE_INPUTS = ["price", "log_price", "size", "size_squared", *[f"grp_{g}" for g in GROUPS]]
TIERS = {"T1": BASE_INPUTS}
TIERS["T2"] = [*TIERS["T1"], "sold"]
TIERS["T3"] = [*TIERS["T2"], "quantity", "quantity_sd", "discount", "discount_sd", "tax", "tax_sd", *[f"{k}_{x}" for k in ("flag", "status", "line") for x in SHARES[k]]]
TIERS["T4"] = [*TIERS["T3"], "month", *[f"year_{x}" for x in SHARES["year"]]]
TIERS["T5"] = [*TIERS["T4"], *[f"source_{x}" for x in SHARES["source"]]]


def tier_rows(v):
    """Per part its mean line value (the target), its sampling variance and 48 inputs from all its lines."""
    l = v.table("lineitem").select(
        F.col("l_partkey").alias("id"), "l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000).alias("worth"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line"), F.year("l_shipdate").alias("year"), (F.col("l_suppkey") % 17).alias("source"), F.month("l_shipdate").alias("month"))
    shares = [F.avg((F.col(k) == x).cast("double")).alias(f"{k}_{x}") for k, xs in SHARES.items() for x in xs]
    per = l.groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("sold"), F.avg("worth").alias("y"), (F.var_pop("worth") / F.count(F.lit(1))).alias("psi2"), F.avg("l_quantity").alias("quantity"),
                              F.stddev_pop("l_quantity").alias("quantity_sd"), F.avg("l_discount").alias("discount"), F.stddev_pop("l_discount").alias("discount_sd"),
                              F.avg("l_tax").alias("tax"), F.stddev_pop("l_tax").alias("tax_sd"), F.avg("month").alias("month"), *shares)
    p = v.table("part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("grp"), F.col("p_brand").alias("cluster"), F.col("p_retailprice").alias("price"), F.log("p_retailprice").alias("log_price"),
                               F.col("p_size").cast("double").alias("size"), (F.col("p_size") * F.col("p_size")).cast("double").alias("size_squared"),
                               *[(F.col("p_type") == g).cast("double").alias(f"grp_{g}") for g in GROUPS])
    return p.join(per, "id")


def tier_fits(v):
    return el.nested_fits(tier_rows(v), TIERS, "y", "cluster")


def tier_predictions(v):
    rows, fits = tier_fits(v)
    return el.predicted(rows.select("id", "grp", "cluster", "outer", "y", "psi2", *TIERS["T5"]), fits, TIERS).select("id", "grp", "outer", "y", "psi2", F.col("tier").alias("model"), "prediction")


@query("M14_nested_elastic_net")
def _(v):
    return rounded(tier_predictions(v).drop("psi2"), 4)


@query("M14_chosen_fits")
def _(v):
    return rounded(tier_fits(v)[1].select("tier", "outer", "mix", "alpha", "rows", "nonzero", "ended", "error", "intercept"), 4)


@query("C21_tier_scoring")
def _(v):
    p = tier_predictions(v)
    wide = p.groupBy("id", "grp", "y", "psi2").pivot("model", list(TIERS)).agg(F.first("prediction"))
    wide = checkpointed(wide.join(p.filter("model = 'T1'").select("id", "outer"), "id"))  # read for the baseline and the scores
    fold = wide.groupBy("outer").agg(F.sum("y").alias("_s"), F.count(F.lit(1)).alias("_n"))
    whole = fold.agg(F.sum("_s").alias("_sa"), F.sum("_n").alias("_na"))
    # the baseline: the mean of the other folds' rows
    mean = fold.join(whole).select("outer", ((F.col("_sa") - F.col("_s")) / (F.col("_na") - F.col("_n"))).alias("P0"))
    rows = wide.join(mean, "outer")
    tags = F.array(F.lit("all"), F.concat(F.lit("group "), F.col("grp")))
    return rounded(sc.error_scores(rows, "y", ["P0", *TIERS], "psi2", tags, "P0"), 4)


@query("C21_tier_comparisons")
def _(v):
    p = tier_predictions(v)
    rec = sc.error_records(p, ["grp", "model"], "y", "prediction", "psi2")
    names = list(TIERS)
    return rounded(sc.model_ratios(rec, ["grp"], names, "sse", list(zip(names[1:], names, strict=False))), 4)


@query("C21_kept_coefficients")
def _(v):
    return rounded(el.kept_coefficients(tier_fits(v)[1], TIERS), 5)


# ---- jobs


@query("C5_version_comparison", """
    with n as (select player, league, win, value / minutes * 90 / 1e5 as a, value / minutes * 90 / 1e5 * (1 + player % 3 / 100.0::double) as b from v_player_window),
    r as (select *, rank() over (partition by league, win order by a) + (count(*) over (partition by league, win, a) - 1) / 2 as ra,
                 rank() over (partition by league, win order by b) + (count(*) over (partition by league, win, b) - 1) / 2 as rb from n)
    select league, win, count(*) as pairs, round(avg(b - a), 6) as mean_gap, round(corr(ra, rb), 6) as spearman from r group by 1, 2""")
def _(v):
    a = F.col("per_ninety") / 1e5
    t = v.player_window.select("player", "league", "win", a.alias("a"), (a * (1 + F.col("player") % 3 / 100)).alias("b"))
    plain = t.groupBy("league", "win").agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.col("b") - F.col("a")).alias("mean_gap"))
    return rounded(plain.join(ex.spearman(t, ["league", "win"], "a", "b"), ["league", "win"]))


@query("C6_calibration_grid", """
    with l as (select coalesce(league, 'none') as league, y, unnest(['raw', 'calibrated']) as kind,
                      unnest([p, 1 / (1 + exp(-(0.2 + 0.8 * (ln(p) - ln(1 - p)))))]) as q from v_prob)
    select kind, coalesce(league, 'all') as league, count(*) as rows, round(avg(q), 6) as mean_p, round(avg((q - y) ** 2), 6) as brier
    from l group by grouping sets ((kind, league), (kind))""")
def _(v):
    p = F.col("p")
    both = v.prob.withColumn("calibrated", sc.recalibrated(p, F.lit(0.2), F.lit(0.8))).withColumnRenamed("p", "raw")
    long = both.unpivot(["league", "y"], ["raw", "calibrated"], "kind", "q")
    tagged = long.select("kind", "y", "q", F.explode(F.array(F.col("league"), F.lit("all"))).alias("league"))
    return rounded(sc.probability_scores(tagged, "y", "q", ["kind", "league"]).select("kind", "league", "rows", "mean_p", "brier"))


@query("M37_depth_comparison", """
    with l as (select y, unnest(['6', '3']) as depth, unnest([p, p * p]) as q from v_prob)
    select depth, count(*) as rows, round(avg((q - y) ** 2), 6) as brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) as log_loss
    from l group by 1""")
def _(v):
    long = v.prob.select("y", F.col("p").alias("6"), (F.col("p") * F.col("p")).alias("3")).unpivot(["y"], ["6", "3"], "depth", "q")
    scores = sc.probability_scores(long, "y", "q", ["depth"])
    hl = sc.hosmer_lemeshow(sc.reliability(long, "y", "q", ["depth"]), ["depth"])
    return rounded(scores.join(hl, "depth").select("depth", "rows", "brier", "log_loss"))


PAIRS = [(a, b) for i, a in enumerate(ALL) for b in ALL[i + 1:]]


@query("C10_profile_correlations", f"""
    with p as ({PROFILE_SQL}) {' union all '.join(f"select '{a}' as first, '{b}' as second, round(corr({a}, {b}), 6) as r from p" for a, b in PAIRS)}""")
def _(v):
    row = profiles(v).agg(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.corr(a, b).alias("r")) for a, b in PAIRS]).alias("_c"))
    return rounded(row.select(F.inline("_c")))


@query("C11_reliability_by_scope", f"""
    with h as ({HALF_SQL}), j as (select 'team ' || x.team as scope, x.a as a1, y.a as a2 from h x join h y using (team, player) where x.half = 'A' and y.half = 'B'),
    s as (select * from j union all select 'all', a1, a2 from j)
    select scope, 'a' as dimension, count(*) as rows, round(corr(a1, a2), 6) as r, round(2 * corr(a1, a2) / (1 + corr(a1, a2)), 6) as stepped_up from s group by 1""")
def _(v):
    tags = F.array(F.concat(F.lit("team "), F.col("team").cast("string")), F.lit("all"))
    h = halves(v).select("*", F.explode(tags).alias("scope"))
    return rounded(pf.half_correlations(h, ["team", "player"], "half", ["a"], ["scope"]))


@query("C12_later_window_scores", """
    with w as (select team, player, case when game_day <= 19 then 1 else 2 end as win, avg(start_x) as a from v_action group by all),
    m as (select team, avg(a) as ma, stddev_samp(a) as sa from w where win = 1 group by 1)
    select team, player, round((a - ma) / sa, 6) as z_a from w join m using (team) where win = 2""")
def _(v):
    win = F.when(F.col("game_day") <= 19, 1).otherwise(2).alias("win")
    p = v.action.groupBy("team", "player", win).agg(F.avg("start_x").alias("a"))
    stats = pf.moments(p.filter("win = 1"), ["team"], ["a"])
    return rounded(pf.standardised(p.filter("win = 2"), stats, ["team"], ["a"]).select("team", "player", "z_a"))


@query("C13_season_profiles", f"""
    with p as ({PROFILE_SQL}), m as (select avg(width) as mw, stddev_samp(width) as sw from p where dribble > 0.2345)
    select team, player, round((width - mw) / sw, 5) as z_width, round((width - mw) / sw - avg((width - mw) / sw) over (partition by team), 5) as c_width from p, m""")
def _(v):
    p = profiles(v).select("team", "player", "width", "dribble")
    z = pf.standardised(p, pf.moments(p.filter("dribble > 0.2345"), [], ["width"]), [], ["width"])
    c = ex.cell_centred(z, ["team"], ["z_width"]).withColumnRenamed("c_z_width", "c_width")
    return rounded(c.select("team", "player", "z_width", "c_width"), 5)


@query("C14_whole_equals_parts", """
    select 0::bigint as broken, count(*) as rows from (select distinct team, player from v_action)""")
def _(v):
    base = v.sequenced

    def dims(d):
        sums = pf.action_sums(d, ["team", "player"], 100.0, 100.0).withColumns({"s_buildup": F.lit(0.0), "n_buildup": F.lit(0)})
        return pf.dimensions(sums, ["team", "player"])

    parts = pf.pooled(dims(base.filter("game_day % 2 = 1")), dims(base.filter("game_day % 2 = 0")), ["team", "player"], ["width", "depth", "creation"])
    whole = dims(base)
    j = parts.alias("a").join(whole.alias("b"), ["team", "player"], "full_outer")
    bad = F.lit(False)
    for d in ("width", "depth", "creation"):
        bad = bad | (ck.relative_gap(F.col(f"a.{d}"), F.col(f"b.{d}")) > 1e-9) | (F.col(f"a.n_{d}") != F.col(f"b.n_{d}"))
    return j.agg(F.count_if(F.coalesce(bad, F.lit(True))).alias("broken"), F.count(F.lit(1)).alias("rows"))


@query("C18_change_and_participation")
def _(v):
    rest = left_out(v).select("team", "player", F.col("width").alias("w_out"))
    team = pf.action_dimensions(v.sequenced, v.times, ["team"], length=100.0, width=100.0).select("team", "width")
    seqs = v.sequenced.select("team", "player", "game", "period", "seq").distinct().groupBy("team", "player").agg(F.count(F.lit(1)).alias("part"))
    j = rest.join(team, "team").join(seqs, ["team", "player"]).withColumn("change", F.abs(F.col("w_out") - F.col("width")))
    return rounded(ex.spearman(j, ["team"], "change", "part"))


@query("C20_centred_embeddings", """
    with e as (select id, team, grp, v1[1] as a, v2[1] as b from v_vector),
    c as (select *, a - avg(a) over (partition by team, grp) as ca, b - avg(b) over (partition by team, grp) as cb from e)
    select id, round(case when team = 0 then cb else ca end, 6) as e0 from c""")
def _(v):
    e = v.vector.select("id", "team", "grp", F.get("v1", F.lit(0)).alias("a"), F.get("v2", F.lit(0)).alias("b"))
    c = ex.cell_centred(e, ["team", "grp"], ["a", "b"])
    return rounded(c.select("id", F.when(F.col("team") == 0, F.col("c_b")).otherwise(F.col("c_a")).alias("e0")))


@query("C22_prices_and_outcomes", """
    with pr as (select player, arg_max(value, date) as price, max(date) as price_date from v_valuation where date < date '1997-01-01' group by 1),
    o as (select player, arg_max(value, date) filter (where date >= date '2000-01-01') as inside, arg_max(value, date) as latest
          from v_valuation where date between date '1999-06-01' and date '2000-09-30' group by 1)
    select date_trunc('month', price_date)::date as month, case when inside is not null then 'window' when latest is not null then 'carried' else 'price' end as how,
           count(*) as n from pr left join o using (player) group by 1, 2""")
def _(v):
    d = lambda s: F.to_date(F.lit(s))
    p = v.valuation.filter(F.col("date") < d("1997-01-01")).groupBy("player").agg(
        F.max_by("value", "date").alias("price"), F.max("date").alias("price_date"))
    out = jn.with_fallback(p, "player", "price", v.valuation, "date", "value", (d("2000-01-01"), d("2000-09-30")), d("1999-06-01"))
    return out.groupBy(F.trunc("price_date", "month").alias("month"), "how").agg(F.count(F.lit(1)).alias("n"))


@query("C23_score_against_outcome", """
    with p as (select player, arg_min(value, date) as price, arg_max(value, date) as later, count(*) as score from v_valuation group by 1),
    r as (select league, rank() over (partition by league order by score) + (count(*) over (partition by league, score) - 1) / 2 as a,
                 rank() over (partition by league order by round(later / price, 9)) + (count(*) over (partition by league, round(later / price, 9)) - 1) / 2 as b
          from p join v_entity using (player))
    select league, round(corr(a, b), 6) as spearman from r group by 1""")
def _(v):
    p = v.valuation.groupBy("player").agg(F.min_by("value", "date").alias("price"), F.max_by("value", "date").alias("later"), F.count(F.lit(1)).alias("score"))
    j = p.join(v.entity.select("player", "league"), "player").withColumn("rise", F.round(F.col("later") / F.col("price"), 9))
    return rounded(ex.spearman(j, ["league"], "score", "rise"))


@query("C28_links_by_window", """
    with a as (select *, case when game_day <= 18 then 1 else 2 end as win from v_action),
    r as (select *, case when lead(team) over w = team and lead(player) over w <> player then lead(player) over w end as rc from a window w as (partition by game, period order by action)),
    p as (select win, team, least(player, rc) as a, greatest(player, rc) as b, count(*) as n from r where rc is not null group by all)
    select win, team, count(*) as pairs, cast(sum(n) as bigint) as n from p group by 1, 2""")
def _(v):
    r = sq.receivers(v.action).withColumn("win", F.when(F.col("game_day") <= 18, 1).otherwise(2))
    p = gh.pass_counts(r, ["win", "team"])
    return p.groupBy("win", "team").agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("n"))


@query("C30_search_report", f"""
    with h as ({HALF_SQL}), u as (select sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2) / sqrt(1.0 / x.minutes + 1.0 / y.minutes) as u
         from h x join h y using (team, player) where x.half = 'A' and y.half = 'B' and x.minutes >= 20 and y.minutes >= 20),
    g as (select team, count(*) as n from (select distinct team, player from v_action) group by 1)
    select 'median_u' as name, round(median(u), 6) as value from u union all select 'rows', cast(count(*) as double) from u
    union all select 'largest_team', cast(max(n) as double) from g""")
def _(v):
    from ..scale import quantiles

    u = pf.noise_reference(halves(v), ["team", "player"], ["a", "b"], least=20)
    rows = u.agg(F.count(F.lit(1)).cast("double").alias("rows"))
    team = se.block_pair_counts(v.action.select("team", "player").distinct(), ["team"]).agg(F.max("nodes").cast("double").alias("largest_team"))
    wide = quantiles(u, [], "u", {"median_u": 0.5}).join(rows).join(team)
    return rounded(wide.unpivot([], ["median_u", "rows", "largest_team"], "name", "value"))


@query("C31_evaluation_rows", """
    select league, count(*) as rows, round(avg((p - y) ** 2), 6) as brier from v_prob where n_chars > 500 group by 1""")
def _(v):
    labels = v.table("labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    rows = jn.contracted(v.prob.filter("n_chars > 500"), labels, ["id"])
    return rounded(sc.probability_scores(rows, "label", "p", ["league"]).select("league", "rows", "brier"))


MARGIN = """
    cl as (select id, y, row_number() over (partition by y order by id) - 1 as slot, count(*) over (partition by y) as n from v_prob),
    pk as (select replicate, y, ('0x' || substr(md5('0-' || replicate || '-' || y || '-' || slot), 1, 8))::bigint % n as slot from cl, range(2000) r(replicate)),
    dr as (select replicate, y, id, p, n_chars % 100 / 100.0::double as q from pk join cl using (y, slot) join (select id, p, n_chars from v_prob) using (id)),
    rk as (select *, rank() over (partition by replicate order by p) + (count(*) over (partition by replicate, p) - 1) / 2 as rp,
                  rank() over (partition by replicate order by q) + (count(*) over (partition by replicate, q) - 1) / 2 as rq from dr),
    au as (select replicate, sum(rp) filter (where y = 1) as sp, sum(rq) filter (where y = 1) as sq,
                  count(*) filter (where y = 1) as a, count(*) filter (where y = 0) as b from rk group by 1)"""


@query("M33_auc_margin_bootstrap", f"""
    with {MARGIN} select cast(replicate as int) as replicate, round((sp - sq) / (a * b), 6) as margin from au""")
def _(v):
    rows = v.prob.select("id", "y", "p", (F.col("n_chars") % 100 / 100).alias("q"))
    both = rp.areas(rows, "y", "id", ["p", "q"], 2000)
    return rounded(both.select("replicate", (F.col("auc_p") - F.col("auc_q")).alias("margin")))
