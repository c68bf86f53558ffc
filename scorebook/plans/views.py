"""Enriched views of plays and pitches.  They are never written: Spark prunes what a query doesn't read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures as M
from ..operators.core import latest_per_key, merged
from ..tables import Tables

CONTACT = ("launch_speed", "launch_angle", "total_distance", "trajectory", "hardness", "hit_location", "hit_coord_x", "hit_coord_y")
GAME = ("season", "official_date", "game_type", "coded_state", "start_ms", "home_team_id", "away_team_id")


def _with_game(df: DataFrame, games: DataFrame) -> DataFrame:
    """In the top half the away team bats and the home team fields."""
    g = games.select("game_pk", *(c for c in GAME if c in games.columns and (c not in df.columns or c == "season")))
    top = F.col("half") == "top"
    return df.drop("season").join(merged(g), "game_pk").withColumns(
        {
            "batting_team_id": F.when(top, F.col("away_team_id")).otherwise(F.col("home_team_id")),
            "fielding_team_id": F.when(top, F.col("home_team_id")).otherwise(F.col("away_team_id")),
        }
    )


def team_plays(plays: DataFrame, games: DataFrame) -> DataFrame:
    return _with_game(plays, games)


def team_pitches(pitches: DataFrame, games: DataFrame) -> DataFrame:
    return _with_game(pitches, games)


def plate_appearances(plays: DataFrame, games: DataFrame, event_types: DataFrame) -> DataFrame:
    """Completed plate appearances with their event's flags; contact columns are null unless the ball was in play."""
    kinds = F.broadcast(event_types.filter("is_plate_appearance").drop("is_plate_appearance"))  # about 30 fixed rows
    df = team_plays(plays, games).join(kinds, "event_type")
    return df.withColumns({c: F.when(F.col("is_ball_in_play"), F.col(c)) for c in CONTACT if c in df.columns})


def pitch_outcomes(pitches: DataFrame, games: DataFrame) -> DataFrame:
    return team_pitches(pitches, games).withColumns(M.pitch_flags())


def game_starters(plays: DataFrame) -> DataFrame:
    """First pitcher of each fielding side."""
    side = F.when(F.col("half") == "top", "home").otherwise("away")
    return plays.groupBy("game_pk", side.alias("side")).agg(F.min_by("pitcher_id", "at_bat_index").alias("pitcher_id"))


def appearances_of(t: Tables) -> DataFrame:
    return plate_appearances(t.plays, t.games, t.event_types).filter(M.tracked())


def outcomes_of(t: Tables) -> DataFrame:
    return pitch_outcomes(t.pitches, t.games).filter(M.tracked())


def tracked_lines(lines: DataFrame, games: DataFrame) -> DataFrame:
    """Box-score lines of games that count."""
    return lines.join(merged(games.filter(M.tracked()).select("game_pk")), "game_pk", "left_semi")


def player_dimension(bios: DataFrame) -> DataFrame:
    """Newest bio of each player over all seasons."""
    order = [F.col("source_date").desc(), F.col("game_number").desc(), F.col("game_pk").desc()]
    return latest_per_key(bios, ["player_id"], order)


def team_dimension(game_teams: DataFrame) -> DataFrame:
    """Newest row of each team and season."""
    return latest_per_key(game_teams, ["team_id", "season"], [F.col("source_date").desc(), F.col("game_pk").desc()])


def season_teams(teams: DataFrame, seasons: DataFrame) -> DataFrame:
    """Each team as it stood in each season: its latest row not after the season.

    A row holds until the season before the team's next one, so its seasons are listed and met by equality.
    """
    last = seasons.agg(F.max("season").alias("_last"))  # one row
    until = F.lead("season").over(Window.partitionBy("team_id").orderBy("season")) - 1
    held = teams.withColumn("_until", until).crossJoin(F.broadcast(last)).withColumn("_until", F.least(F.coalesce("_until", "_last"), F.col("_last")))
    listed = held.filter(F.col("season") <= F.col("_until")).withColumn("season", F.explode(F.sequence("season", "_until"))).drop("_until", "_last")
    return listed.join(seasons, "season", "left_semi")
