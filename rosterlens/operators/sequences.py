"""Sequences of actions: gaps and islands, what follows, what came before.

Everything runs on one ordering of a period's actions; nothing is joined back. Positions count
from 1 within the period, and a sequence's start and end travel along the order as running values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import Ordered

# Action types by role, the pitch line of the final third.
PASSES = ["pass", "cross"]
OPEN_SHOTS = ["shot", "shot_freekick"]
SHOTS = ["shot", "shot_freekick", "shot_penalty"]
FINAL_THIRD = 70.0


def ordered(actions: DataFrame, block: Sequence[str] = ("game", "period"),
            order: Sequence[str] = ("action",), rows: int | None = None) -> Ordered:
    return Ordered(actions, block, order, rows)


def play_left_to_right(actions: DataFrame, games: DataFrame, game: str = "game",
                       length: float = 105.0, width: float = 68.0) -> DataFrame:
    """The away team's coordinates mirrored."""
    homes = games.select(game, F.col("home").alias("_home"))
    away = F.col("team") != F.col("_home")
    flip = {c: F.when(away, size - F.col(c)).otherwise(F.col(c))
            for c, size in (("start_x", length), ("end_x", length),
                            ("start_y", width), ("end_y", width))}
    return actions.join(homes, game).withColumns(flip).drop("_home")


def with_positions(o: Ordered, team: str = "team") -> Ordered:
    """Adds pos, seq (numbered within the block) and whether a row starts or ends its sequence."""
    o = o.before(_team_before=F.col(team)).after(_team_after=F.col(team))
    starts = F.coalesce(F.col("_team_before") != F.col(team), F.lit(True))
    ends = F.coalesce(F.col("_team_after") != F.col(team), F.lit(True))
    o = o.with_columns(_starts=starts, _ends=ends)
    return o.upto(pos=("sum", F.lit(1)), seq=("sum", F.col("_starts").cast("int")))


def with_spans(o: Ordered, seconds: str = "seconds") -> Ordered:
    """Adds the sequence's first and last position and its duration."""
    here = F.struct(F.col("pos"), F.col(seconds).alias("at"))
    o = o.upto(_first=("max", F.when(F.col("_starts"), here)))
    o = o.onward(_last=("min", F.when(F.col("_ends"), here)))
    return o.with_columns(seq_start=F.col("_first.pos"), seq_end=F.col("_last.pos"),
                          seq_duration=F.col("_last.at") - F.col("_first.at"))


def with_runs(o: Ordered, player: str = "player") -> Ordered:
    """Adds the next action's player and, for it, the end of that player's unbroken run."""
    o = o.after(next_player=F.col(player))
    stays = (F.col("next_player") == F.col(player)) & ~F.col("_ends")
    run_end = F.when(~F.coalesce(stays, F.lit(False)), F.col("pos"))
    o = o.onward(run_end=("min", run_end)).after(next_run_end=F.col("run_end"))
    passed_on = ~F.col("_ends") & (F.col("next_player") != F.col(player))
    return o.with_columns(passed_on=F.coalesce(passed_on, F.lit(False)))


def with_creation(o: Ordered, kind: str = "type", shots: Sequence[str] = tuple(SHOTS)) -> Ordered:
    """Flags actions whose followers, up to the sequence's first shot, are all one other player."""
    shot = F.when(F.col(kind).isin(*shots), F.col("pos"))
    o = o.onward(_shot=("min", shot)).after(_next_shot=F.col("_shot"))
    return o.with_columns(creates=F.col("passed_on") & F.coalesce(
        F.col("_next_shot") <= F.col("next_run_end"), F.lit(False)))


def with_outcome_flags(o: Ordered, kind: str = "type", success: str = "success") -> Ordered:
    """Flags open-play goals and shots, and assists: a completed pass after which one teammate
    takes every later action of the sequence, the last being that player's open-play goal."""
    shot = F.col(kind).isin(*OPEN_SHOTS)
    goal = shot & F.col(success)
    o = o.with_columns(open_shot=shot, open_goal=goal)
    o = o.onward(_close=("min", F.when(F.col("_ends"), F.struct("pos", "open_goal"))))
    passed = F.col(kind).isin(*PASSES) & F.col(success)
    assist = (passed & F.col("passed_on") & (F.col("next_run_end") == F.col("_close.pos"))
              & F.col("_close.open_goal"))
    return o.with_columns(assist=F.coalesce(assist, F.lit(False)))


def with_sequences(actions: DataFrame, block: Sequence[str] = ("game", "period"),
                   order: Sequence[str] = ("action",), rows: int | None = None) -> DataFrame:
    """Actions with sequence numbers, spans, durations and creation flags."""
    o = with_creation(with_runs(with_spans(with_positions(ordered(actions, block, order, rows)))))
    helper = [c for c in o.df.columns if c.startswith("_")]
    return o.df.drop(*helper)


def buildup_times(sequenced: DataFrame, block: Sequence[str] = ("game", "period"),
                  line: float = FINAL_THIRD) -> DataFrame:
    """Seconds from a sequence's start before the line to its first action ending beyond it."""
    at = F.struct(F.col("pos"), F.col("seconds").alias("at"), F.col("start_x").alias("x"))
    per = sequenced.groupBy(*block, "seq").agg(
        F.min(at).alias("_first"), F.min(F.when(F.col("end_x") >= line, at)).alias("_reach"))
    return per.filter((F.col("_first.x") < line) & F.col("_reach").isNotNull()).select(
        *block, "seq", (F.col("_reach.at") - F.col("_first.at")).alias("seconds"))


def receivers(actions: DataFrame, block: Sequence[str] = ("game", "period"),
              order: Sequence[str] = ("action",), rows: int | None = None) -> DataFrame:
    """The next action's player when that is another player of the same team, else null."""
    o = ordered(actions, block, order, rows).after(
        _team_after=F.col("team"), _player_after=F.col("player"))
    ok = (F.col("_team_after") == F.col("team")) & (F.col("_player_after") != F.col("player"))
    return o.df.withColumn("receiver", F.when(ok, F.col("_player_after"))).drop(
        "_team_after", "_player_after")


def completed_passes(received: DataFrame) -> DataFrame:
    return received.filter(F.col("type").isin(*PASSES) & F.col("success"))


def alternate(games: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "half",
              rows: int | None = None) -> DataFrame:
    """Per team, home games dealt A, B, A, … and away games B, A, B, … in the given order."""
    o = Ordered(games, [*keys, "at_home"], order, rows).upto(_n=("sum", F.lit(1)))
    first = (F.col("_n") % 2 == 1) == F.col("at_home")
    return o.df.withColumn(name, F.when(first, "A").otherwise("B")).drop("_n")


def fold_of(rows_df: DataFrame, keys: Sequence[str], order: Sequence[str], folds: int = 5,
            rows: int | None = None) -> DataFrame:
    """Folds dealt in turn over an order."""
    o = Ordered(rows_df, keys, order, rows).upto(_n=("sum", F.lit(1)))
    return o.df.withColumn("fold", ((F.col("_n") - 1) % folds).cast("int")).drop("_n")


def action_values(actions: DataFrame, score: str, concede: str, block: Sequence[str] = ("game",),
                  order: Sequence[str] = ("period", "action"), rows: int | None = None) -> DataFrame:
    """Change in the chances to score and concede against the previous action, whose chances
    swap sides when possession changed; the first action counts from zero."""
    o = ordered(actions, block, order, rows).before(
        _s=F.col(score), _c=F.col(concede), _t=F.col("team"))
    kept = F.col("_t") == F.col("team")
    before_s = F.coalesce(F.when(kept, F.col("_s")).otherwise(F.col("_c")), F.lit(0.0))
    before_c = F.coalesce(F.when(kept, F.col("_c")).otherwise(F.col("_s")), F.lit(0.0))
    out = o.df.withColumns({"offensive": F.col(score) - before_s,
                            "defensive": -(F.col(concede) - before_c)})
    return out.withColumn("action_value", F.col("offensive") + F.col("defensive")).drop("_s", "_c", "_t")


def outcome_labels(actions: DataFrame, goal: Column, window: int = 10,
                   block: Sequence[str] = ("game",), order: Sequence[str] = ("period", "action"),
                   teams: Sequence[str] = ("home", "away"), rows: int | None = None) -> DataFrame:
    """Whether the acting side, or the other, scores in the next ``window`` actions, this one
    included. The nearest later goal of each side travels back along the order."""
    side = {t: F.when(goal & (F.col("team") == F.col(t)), F.col("_pos")) for t in teams}
    o = ordered(actions, block, order, rows).upto(_pos=("sum", F.lit(1)))
    o = o.onward(**{f"_{t}_goal": ("min", c) for t, c in side.items()})
    near = {t: F.coalesce(F.col(f"_{t}_goal") < F.col("_pos") + window, F.lit(False)) for t in teams}
    first = F.col("team") == F.col(teams[0])
    a, b = near[teams[0]], near[teams[1]]
    out = o.df.withColumns({"scores": F.when(first, a).otherwise(b),
                            "concedes": F.when(first, b).otherwise(a)})
    return out.drop("_pos", *[f"_{t}_goal" for t in teams])


def previous_features(actions: DataFrame, values: Mapping[str, Column], back: int = 2,
                      block: Sequence[str] = ("game",), order: Sequence[str] = ("period", "action"),
                      rows: int | None = None) -> DataFrame:
    """Each value on the action itself (``_0``) and on the ones before it, the first action
    standing in where there is none."""
    o = ordered(actions, block, order, rows).with_columns(**{f"{n}_0": c for n, c in values.items()})
    for i in range(1, back + 1):
        o = o.before(**{f"{n}_{i}": F.col(f"{n}_{i - 1}") for n in values})
        o = o.with_columns(**{f"{n}_{i}": F.coalesce(f"{n}_{i}", f"{n}_{i - 1}") for n in values})
    return o.df


def one_hot(column: str, classes: Sequence[str], prefix: str) -> dict[str, Column]:
    return {f"{prefix}_{c}": (F.col(column) == c).cast("int") for c in classes}


def pressed_players(pressures: DataFrame, events: DataFrame) -> DataFrame:
    """The player of the first related event that exists and belongs to another team, with the
    pressure's place where its location is a list."""
    links = pressures.select("event_id", "team", F.posexplode("related_events").alias("_at", "_id"))
    others = events.select(F.col("event_id").alias("_id"), F.col("team").alias("_team"),
                           F.col("player").alias("_player"))
    first = links.join(others, "_id").filter(F.col("_team") != F.col("team")).groupBy("event_id").agg(
        F.min_by("_player", "_at").alias("pressed_player"))
    place = {"x": F.get("location", F.lit(0)), "y": F.get("location", F.lit(1))}
    return pressures.withColumns(place).join(first, "event_id", "left").drop("related_events", "location")
