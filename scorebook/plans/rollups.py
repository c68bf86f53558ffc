"""Day and season rollups: mergeable partial aggregates that later reads sum again."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from ..operators.core import explode_splits, merged, scoped_rollup, topn_per_group
from ..tables import Tables
from . import views

LEADERS_PER_DAY = 50


def _boards() -> dict[str, tuple[str, str, str, Column]]:
    c = F.col
    return {
        "longest_home_runs": ("batter_id", "pitcher_id", "total_distance", c("is_in_play") & (c("event_type") == "home_run") & c("total_distance").isNotNull()),
        "fastest_pitches": ("pitcher_id", "batter_id", "start_speed", c("start_speed").isNotNull()),
        "hardest_hit_balls": ("batter_id", "pitcher_id", "launch_speed", c("is_in_play") & c("launch_speed").isNotNull()),
    }


def event_leaders(t: Tables, board: str, n: int = LEADERS_PER_DAY) -> DataFrame:
    """Top events of each day; the day's limit covers the largest limit of any range query."""
    who, whom, value, where = _boards()[board]
    a = t.plays.select("game_pk", "at_bat_index", "event_type", "event", "total_distance")
    g = t.games.filter(M.tracked()).select("game_pk", "season", "official_date")
    e = t.pitches.drop("season", "total_distance").join(merged(g), "game_pk").join(merged(a), ["game_pk", "at_bat_index"], "left").filter(where)
    kind = "pitch_type_desc" if "pitch_type_desc" in e.columns else "pitch_type"  # pitches may come without the columns that are only shown
    shown = F.col("call_desc") if "call_desc" in e.columns else F.lit(None).cast("string")
    order = [F.col(value).desc(), F.col("game_pk"), F.col("at_bat_index"), F.col("pitch_index")]
    rows = e.select(
        F.lit(board).alias("board"), "season", "official_date", F.col(who).alias("player_id"), F.col(whom).alias("opponent_id"), F.col(value).cast("double").alias("value"), F.col(kind).alias("pitch_type"),
        F.concat(F.col("balls_before").cast("string"), F.lit("-"), F.col("strikes_before").cast("string")).alias("count"),
        F.when(F.col("is_in_play"), F.col("event")).otherwise(shown).alias("result"), "game_pk", "at_bat_index", "pitch_index",
    )
    return topn_per_group(rows, ["official_date"], [F.col("value").desc(), *order[1:]], n)


def batted_ball_days(t: Tables) -> DataFrame:
    return views.appearances_of(t).groupBy("season", "official_date", F.col("batter_id").alias("player_id")).agg(*M.batted_ball_totals(), F.sum("launch_speed").alias("launch_speed_sum"))


def pitch_outcome_days(t: Tables) -> DataFrame:
    return views.outcomes_of(t).groupBy("season", "official_date", F.col("pitcher_id").alias("player_id")).agg(*M.pitch_totals(), *M.swing_decision_counts())


def player_season_counts(t: Tables, role: str) -> DataFrame:
    key = [F.col("season"), F.col(f"{role}_id").alias("player_id")]
    batting = views.appearances_of(t).groupBy(*key).agg(*M.batting_counts())
    pitches = views.outcomes_of(t).groupBy(*key).agg(*M.pitch_counts(), *M.swing_decision_counts())
    return batting.join(pitches, ["season", "player_id"], "left").withColumn("role", F.lit(role))


def batter_splits() -> list[Column]:
    men = F.col("men_on_base")
    return [
        F.lit("all"),
        F.concat(F.lit("vs_"), "pitch_hand"),
        F.when(F.col("half") == "bottom", "home").otherwise("away"),
        F.when(men.isin("RISP", "Loaded"), "risp").when(men == "Empty", "bases_empty"),
    ]


def pitcher_splits() -> list[Column]:
    return [F.concat(F.lit("vs_"), "bat_side"), F.when(F.col("half") == "top", "home").otherwise("away")]


def _league_or_team() -> Column:
    return F.when(F.col("_g_team_id") == 1, "league").otherwise("team")


def _finish(df: DataFrame, scope: Column) -> DataFrame:
    return df.withColumn("scope", scope).filter("scope IS NOT NULL").drop(*(c for c in df.columns if c.startswith("_g_") or c == "is_starter"))


def team_season_batting(t: Tables) -> DataFrame:
    """Splits are opened and rolled up over sums for each team and situation, a few thousand rows, so no appearance is multiplied.

    Games are counted apart: a row for each game holds its teams and, for each, the splits that it has, so nothing wide is kept for a game.
    """
    key, situation = ["season", "split", "team_id"], ["pitch_hand", "half", "men_on_base"]
    df = views.appearances_of(t).withColumn("team_id", F.col("batting_team_id"))
    sums = df.groupBy("season", "team_id", *situation).agg(*M.batting_totals())
    names = [c for c in sums.columns if c not in ("season", "team_id", *situation)]
    rows = explode_splits(sums, batter_splits()).withColumn("_team", F.col("team_id"))
    measures = [F.greatest(F.countDistinct("_team"), F.lit(1)).alias("teams"), *M.sums(names)]
    out = scoped_rollup(rows, [key, key[:2]], measures)

    teams = df.select("season", "game_pk", F.struct("team_id", F.array_compact(F.array(*batter_splits())).alias("splits")).alias("_t")).groupBy("season", "game_pk").agg(F.collect_set("_t").alias("_ts"))
    each = F.transform("_ts", lambda x: F.transform(x["splits"], lambda s: F.struct(s.alias("split"), x["team_id"].alias("team_id"))))
    of_teams = F.transform(F.array_distinct(F.flatten(each)), lambda x: F.struct(x["split"].alias("split"), x["team_id"].alias("team_id"), F.lit(0).alias("_g")))
    of_league = F.transform(F.array_distinct(F.flatten(F.transform("_ts", lambda x: x["splits"]))), lambda s: F.struct(s.alias("split"), F.lit(None).alias("team_id"), F.lit(1).alias("_g")))
    games = teams.select("season", F.inline(F.concat(of_teams, of_league))).groupBy(*key, "_g").agg(F.count("*").alias("games"))

    same = (out["season"] == games["season"]) & (out["split"] == games["split"]) & out["team_id"].eqNullSafe(games["team_id"]) & (out["_g_team_id"] == games["_g"])
    out = out.join(games, same).select(*(out[c] for c in out.columns), games["games"])
    out = _finish(out, _league_or_team()).withColumn("exit_velocity", M.ratio("launch_speed_sum", "batted_balls")).drop("launch_speed_sum")
    front = ["season", "split", "team_id", "teams", "games"]
    return out.select(*front, *(c for c in out.columns if c not in front))


def team_season_swing_decisions(t: Tables) -> DataFrame:
    rows = views.outcomes_of(t).withColumn("team_id", F.col("batting_team_id"))
    return _finish(scoped_rollup(rows, [["season", "team_id"], ["season"]], M.swing_decision_counts()), _league_or_team())


def _role_scope() -> Column:
    return F.when(F.col("_g_team_id") == 1, "league").when(F.col("_g_is_starter") == 1, "team").when(F.col("is_starter"), "starters").when(~F.col("is_starter"), "relievers")


_ROLE_SETS = [["season", "team_id", "is_starter"], ["season", "team_id"], ["season"]]


def team_season_pitching(t: Tables) -> DataFrame:
    lines = views.tracked_lines(t.pitching, t.games).groupBy("season", "team_id", "is_starter").agg(*M.sums(M.PITCHING))
    rows = lines.withColumn("_team", F.col("team_id"))
    return _finish(scoped_rollup(rows, _ROLE_SETS, [F.greatest(F.countDistinct("_team"), F.lit(1)).alias("teams"), *M.sums(M.PITCHING)]), _role_scope())


def team_season_pitches(t: Tables) -> DataFrame:
    """Pitches without a known role count for the team and the league, not for starters or relievers.

    Pitches are summed for each game and pitcher before they meet the roles.
    """
    roles = t.pitching.select("game_pk", "team_id", F.col("player_id").alias("pitcher_id"), "is_starter")
    fast = F.when(F.col("is_fastball"), F.col("start_speed"))
    sums = views.outcomes_of(t).groupBy("season", "game_pk", F.col("fielding_team_id").alias("team_id"), "pitcher_id").agg(*M.pitch_totals(), F.sum(fast).alias("_fast_sum"), F.count(fast).alias("_fasts"))
    rows = sums.join(merged(roles), ["game_pk", "team_id", "pitcher_id"], "left")
    names = ["pitches", "swings", "whiffs", "called_strikes", "_fast_sum", "_fasts"]
    out = _finish(scoped_rollup(rows, _ROLE_SETS, M.sums(names)), _role_scope())
    return out.withColumn("fastball_velocity", M.ratio("_fast_sum", "_fasts")).drop("_fast_sum", "_fasts")


def every_event_leader(t: Tables) -> DataFrame:
    """The leaders of all boards."""
    every, *rest = [event_leaders(t, b) for b in _boards()]
    for more in rest:
        every = every.unionByName(more)
    return every


#: All rollups by season and day, and all by season, each a function of the tables.
DAY_ROLLUPS = {"batted_ball_days": batted_ball_days, "pitch_outcome_days": pitch_outcome_days, "event_leaders": every_event_leader}
SEASON_ROLLUPS = {
    "player_season_counts": lambda t: player_season_counts(t, "batter").unionByName(player_season_counts(t, "pitcher")),
    "team_season_batting": team_season_batting, "team_season_swing_decisions": team_season_swing_decisions,
    "team_season_pitching": team_season_pitching, "team_season_pitches": team_season_pitches, "teams": lambda t: views.team_dimension(t.game_teams),
}


def day_rollups(t: Tables, names: Iterable[str] = tuple(DAY_ROLLUPS)) -> dict[str, DataFrame]:
    return {n: DAY_ROLLUPS[n](t) for n in names if n in DAY_ROLLUPS}


def season_rollups(t: Tables, names: Iterable[str] = tuple(SEASON_ROLLUPS)) -> dict[str, DataFrame]:
    return {n: SEASON_ROLLUPS[n](t) for n in names if n in SEASON_ROLLUPS}
