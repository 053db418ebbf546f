"""Domain views over the generated tables, as DataFrames and as the same SQL.

The library takes column names as arguments; these views give the registered queries entities,
games, exposures, actions, valuations, moves, vectors and prices drawn from whole tables.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.exposure import assign_windows, window_values
from ..operators.sequences import buildup_times, with_sequences
from ..scale import Ordered, settled

# How event types stand in for action types.
ACTION_TYPES = {
    "click": "pass", "signup": "cross", "view": "take_on", "purchase": "shot", "error": "tackle",
}
PITCH = (100.0, 100.0)


_SCHEMAS: dict[str, StructType] = {}


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        """A table's file, its schema read from the footer once per process."""
        path = f"{self.folder}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    @cached_property
    def entity(self) -> DataFrame:
        """One row per player with its league, team and group."""
        c, n = self.table("customer"), self.table("nation")
        return c.join(n, c.c_nationkey == n.n_nationkey).select(
            F.col("n_regionkey").alias("league"), F.col("c_nationkey").alias("team"),
            F.col("c_custkey").alias("player"), F.col("c_mktsegment").alias("grp"),
            F.col("c_name").alias("name"))

    @cached_property
    def game(self) -> DataFrame:
        """One row per game of a player: its day within the season and its date."""
        o = self.table("orders").select(
            F.col("o_orderkey").alias("game"), F.col("o_custkey").alias("player"),
            F.to_date("o_orderdate").alias("game_date"), F.col("o_orderstatus").alias("status"))
        o = o.withColumn(
            "game_day", F.datediff("game_date", F.lit("1995-01-01").cast("date")) + 1)
        return o.join(self.entity.drop("name"), "player")

    @cached_property
    def player_game(self) -> DataFrame:
        """Exposure and value per (player, game); games without lines have zero minutes."""
        return self._with_lines(self.game)

    @cached_property
    def windowed(self) -> DataFrame:
        """The same with each game's window, assigned before the lines are joined."""
        return self._with_lines(assign_windows(self.game, ["league"]))

    @cached_property
    def player_window(self) -> DataFrame:
        keys = ["league", "team", "player", "grp", "win"]
        return window_values(self.windowed, keys, ["value", "offensive", "defensive"])

    def _with_lines(self, games: DataFrame) -> DataFrame:
        price, cut = F.col("l_extendedprice"), F.col("l_discount")
        lines = self.table("lineitem").groupBy(F.col("l_orderkey").alias("game")).agg(
            F.sum("l_quantity").alias("minutes"), F.sum(price * (1 - cut)).alias("value"),
            F.sum(price).alias("offensive"), F.sum(-price * cut).alias("defensive"),
            F.count(F.lit(1)).alias("lines"))
        zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("minutes", "value", "offensive", "defensive")}
        return games.join(lines, "game", "left").withColumns(
            zero | {"lines": F.coalesce("lines", F.lit(0))})

    @cached_property
    def action(self) -> DataFrame:
        """Ordered actions of two-team games."""
        k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
        clock = F.expr("hour(ts) * 3600 + minute(ts) * 60 + cast(extract(SECOND FROM ts) AS double)")
        side = (F.col("user_id") % 4).cast("int")
        kind = F.create_map(*[F.lit(x) for p in ACTION_TYPES.items() for x in p])
        day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1
        league = F.floor(side / 2).cast("int")
        return self.table("events").select(
            "event_id", "ts", "event_type", "value",
            league.alias("league"), day.alias("game_day"), (day * 2 + league).alias("game"),
            F.when(F.hour("ts") < 12, 1).otherwise(2).alias("period"),
            F.col("event_id").alias("action"), clock.alias("seconds"), side.alias("team"),
            F.col("user_id").alias("player"), kind[F.col("event_type")].alias("type"),
            (k % 3 != 0).alias("success"), k.cast("double").alias("start_x"),
            ((k * 37 + 11) % 100).cast("double").alias("start_y"),
            ((k * 7 + 13) % 100).cast("double").alias("end_x"),
            ((k * 53 + 29) % 100).cast("double").alias("end_y"))

    @cached_property
    def sequenced(self) -> DataFrame:
        """Actions in their sequences, stored for queries that read them several times."""
        return settled(self.sequenced_once)

    @cached_property
    def sequenced_once(self) -> DataFrame:
        """The same, not stored: a query that reads it once carries its own columns alone."""
        return with_sequences(self.action.drop("event_id", "ts", "event_type", "value"))

    @cached_property
    def times(self) -> DataFrame:
        return buildup_times(self.sequenced)

    @cached_property
    def match(self) -> DataFrame:
        """One row per two-team game with its home and away team."""
        g = self.action.select("league", "game", "game_day").distinct()
        home = F.col("league") * 2 + F.col("game_day") % 2
        return g.withColumns({"home": home, "away": F.col("league") * 4 + 1 - home})

    @cached_property
    def valuation(self) -> DataFrame:
        """One value per player and day."""
        return self.table("orders").groupBy(
            F.col("o_custkey").alias("player"), F.to_date("o_orderdate").alias("date")
        ).agg(F.max("o_totalprice").alias("value"))

    @cached_property
    def move(self) -> DataFrame:
        """Moves between clubs: a player's successive events of different types."""
        e = self.table("events").select(
            F.col("user_id").alias("player"), "event_id", "ts",
            F.to_date("ts").alias("date"), F.col("event_type").alias("to_club"), "value")
        o = Ordered(e, ["player"], ["ts", "event_id"]).before(from_club=F.col("to_club"))
        m = o.df.filter("from_club is not null and from_club <> to_club")
        return m.select("player", "event_id", "ts", "date", "from_club", "to_club",
                        F.when(F.col("value") >= 20, F.col("value")).alias("fee"))

    @cached_property
    def vector(self) -> DataFrame:
        """Two 32-float vectors per entity with a group and a team."""
        e = F.col("embedding").cast("array<double>")
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"), F.col("label").alias("grp"),
            (F.col("vec_id") % 4).cast("int").alias("team"),
            F.slice(e, 1, 32).alias("v1"), F.slice(e, 33, 32).alias("v2"))

    @cached_property
    def prob(self) -> DataFrame:
        """A predicted probability and a label per row."""
        d = self.table("documents").select("doc_id", "lang", "source", "n_chars")
        p = 1 / (1 + F.exp(-(F.log(F.col("n_chars").cast("double")) - 6)))
        return self.table("labels").join(d, "doc_id").select(
            F.col("doc_id").alias("id"), F.col("lang").alias("league"),
            F.col("source").alias("team"), F.col("quality").alias("y"),
            F.col("toxic").alias("y2"), "n_chars", p.alias("p"))

    @cached_property
    def market(self) -> DataFrame:
        """Priced entities with a group, a cluster and a value."""
        line = self.table("lineitem").groupBy(F.col("l_partkey").alias("id")).agg(
            (F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / F.count(F.lit(1)))
            .alias("value"), F.count(F.lit(1)).alias("sold"))
        p = self.table("part").select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
            F.col("p_type").alias("grp"), F.col("p_brand").alias("cluster"),
            F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
        return p.join(line, "id")


VIEW_SQL = {
    "v_entity": """
        select n_regionkey as league, c_nationkey as team, c_custkey as player,
               c_mktsegment as grp, c_name as name
        from customer join nation on c_nationkey = n_nationkey""",
    "v_game": """
        select o_orderkey as game, player, cast(o_orderdate as date) as game_date,
               o_orderstatus as status,
               date_diff('day', date '1995-01-01', cast(o_orderdate as date)) + 1 as game_day,
               league, team, grp
        from orders join v_entity on o_custkey = player""",
    "v_lines": """
        select l_orderkey as game, sum(l_quantity) as minutes,
               sum(l_extendedprice * (1 - l_discount)) as value,
               sum(l_extendedprice) as offensive, sum(-l_extendedprice * l_discount) as defensive,
               count(*) as lines
        from lineitem group by 1""",
    "v_player_game": """
        select g.*, coalesce(minutes, 0) as minutes, coalesce(value, 0) as value,
               coalesce(offensive, 0) as offensive, coalesce(defensive, 0) as defensive,
               coalesce(lines, 0) as lines
        from v_game g left join v_lines l using (game)""",
    "v_action": """
        select event_id, ts, event_type, value, cast(side // 2 as int) as league, game_day,
               game_day * 2 + side // 2 as game,
               case when hour(ts) < 12 then 1 else 2 end as period, event_id as action,
               hour(ts) * 3600 + minute(ts) * 60 + microsecond(ts) / 1e6 as seconds,
               side as team, user_id as player,
               case event_type when 'click' then 'pass' when 'signup' then 'cross'
                    when 'view' then 'take_on' when 'purchase' then 'shot' else 'tackle' end as type,
               k % 3 <> 0 as success, cast(k as double) as start_x,
               cast((k * 37 + 11) % 100 as double) as start_y,
               cast((k * 7 + 13) % 100 as double) as end_x,
               cast((k * 53 + 29) % 100 as double) as end_y
        from (select *, cast(user_id % 4 as int) as side,
                     cast(regexp_extract(props, '(\\d+)', 1) as int) as k,
                     date_diff('day', date '2024-01-01', cast(ts as date)) + 1 as game_day
              from events)""",
    "v_match": """
        select distinct league, game, game_day, league * 2 + game_day % 2 as home,
               league * 4 + 1 - (league * 2 + game_day % 2) as away
        from v_action""",
    "v_valuation": """
        select o_custkey as player, cast(o_orderdate as date) as date, max(o_totalprice) as value
        from orders group by 1, 2""",
    "v_move": """
        select player, event_id, ts, date, from_club, to_club,
               case when value >= 20 then value end as fee
        from (select user_id as player, event_id, ts, cast(ts as date) as date,
                     event_type as to_club, value,
                     lag(event_type) over (partition by user_id order by ts, event_id) as from_club
              from events)
        where from_club is not null and from_club <> to_club""",
    "v_vector": """
        select vec_id as id, label as grp, cast(vec_id % 4 as int) as team,
               cast(embedding[1:32] as double[]) as v1, cast(embedding[33:64] as double[]) as v2
        from embeddings""",
    "v_prob": """
        select doc_id as id, lang as league, source as team, quality as y, toxic as y2, n_chars,
               1 / (1 + exp(-(ln(cast(n_chars as double)) - 6))) as p
        from labels join documents using (doc_id)""",
    "v_market": """
        select p_partkey as id, p_name as name, p_type as grp, p_brand as cluster, p_size as size,
               p_retailprice as price, value, sold
        from part join (select l_partkey, count(*) as sold,
                               sum(l_extendedprice * (1 - l_discount)) / count(*) as value
                        from lineitem group by 1) on p_partkey = l_partkey""",
    # sequences of actions
    "v_seq0": """
        select *, row_number() over w as pos, lag(team) over w is distinct from team as starts,
               lead(player) over w as next_player
        from v_action window w as (partition by game, period order by action)""",
    "v_seq1": """
        select *, sum(cast(starts as int)) over w as seq from v_seq0 window w as (partition by game, period order by action)""",
    "v_seq2": """
        select *, max(pos) over (partition by game, period, seq) as seq_end,
               max(pos) over (partition by game, period, run) as run_end,
               last_value(seconds) over s - first_value(seconds) over s as seq_duration,
               min(case when type = 'shot' then pos end) over (partition by game, period, seq
                   order by action rows between current row and unbounded following) as shot_pos
        from (select *, sum(r) over (partition by game, period order by action) as run
              from (select *, cast(starts or lag(player) over w is distinct from player as int) as r
                    from v_seq1 window w as (partition by game, period order by action)))
        window s as (partition by game, period, seq order by action
                     rows between unbounded preceding and unbounded following)""",
    "v_seq": """
        select *, pos < seq_end and next_player <> player and coalesce(
                   lead(shot_pos) over w <= lead(run_end) over w, false) as creates,
               pos < seq_end and next_player <> player and type in ('pass', 'cross') and success
               and lead(run_end) over w = seq_end
               and coalesce(last_value(type = 'shot' and success) over (partition by game, period, seq
                   order by action rows between unbounded preceding and unbounded following), false)
                   as assist
        from v_seq2 window w as (partition by game, period order by action)""",
    "v_times": """
        with f as (select game, period, seq, arg_min(start_x, pos) as x, min(seconds) as t0,
                          min(seconds) filter (where end_x >= 70) as t1 from v_seq group by all)
        select game, period, seq, t1 - t0 as seconds from f where x < 70 and t1 is not null""",
    # player-window exposure and value, used by many queries
    "v_windowed": """
        select *, case when game_day <= ceil(0.6 * max(game_day) over (partition by league))
                       then 1 else 2 end as win
        from v_player_game""",
    "v_player_window": """
        select league, team, player, grp, win, sum(minutes) as minutes,
               count(*) filter (where minutes > 0) as games, sum(value) as value,
               sum(offensive) as offensive, sum(defensive) as defensive
        from v_windowed group by all having sum(minutes) > 0""",
}


def with_views(sql: str) -> str:
    """Puts the definitions of the views a query names, and of those they name, before it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEW_SQL:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(VIEW_SQL[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{n} as ({VIEW_SQL[n]})" for n in needed)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {head},\n{body[5:]}"
    return f"with {head}\n{body}"
