"""Hitters and pitchers: season lines, splits, game logs, years, arsenals.  Without an id the plans cover all players."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from ..operators.core import explode_splits, latest_per_key, merged, weighted_rollup, with_share
from ..tables import Tables
from . import rollups, views


def _of(df: DataFrame, column: str, player_id: int | None) -> DataFrame:
    return df if player_id is None else df.filter(F.col(column) == player_id)


def hitter_seasons(t: Tables, player_id: int | None = None) -> DataFrame:
    """Box-score counts with contact and swing measures, a row for each player and season; missing parts count 0."""
    key = ["player_id", "season"]
    box = _of(views.tracked_lines(t.batting, t.games), "player_id", player_id).groupBy(*key).agg(*M.sums(M.BOX_BATTING))
    by = [F.col("batter_id").alias("player_id"), "season"]
    contact = _of(views.appearances_of(t), "batter_id", player_id).groupBy(*by).agg(*M.batted_ball_counts())
    swings = _of(views.outcomes_of(t), "batter_id", player_id).groupBy(*by).agg(*M.swing_decision_counts())
    df = box.join(contact, key, "left").join(swings, key, "left")
    counts = ["batted_balls", "hard_hits", "barrels", "out_of_zone_pitches", "chases", "zone_swings", "zone_contacts"]
    return df.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts})


def hitter_lines(t: Tables, player_id: int | None = None) -> DataFrame:
    rates = M.batting_rates() | M.swing_rates()
    return hitter_seasons(t, player_id).select("player_id", "season", "exit_velocity", *(v.alias(k) for k, v in rates.items()))


def hitter_splits(t: Tables, player_id: int | None = None) -> DataFrame:
    rows = explode_splits(_of(views.appearances_of(t), "batter_id", player_id), rollups.batter_splits())
    return rows.groupBy(F.col("batter_id").alias("player_id"), "season", "split").agg(*M.batting_counts())


def _opponents(lines: DataFrame, t: Tables) -> DataFrame:
    """The line's game with the team of that game that is not the player's own."""
    other = t.game_teams.select(F.col("game_pk").alias("_pk"), F.col("team_id").alias("_team"), F.col("abbreviation").alias("opponent"))
    g = t.games.filter(M.tracked()).select("game_pk", "official_date", "game_number", "home_team_id", "away_team_id")
    df = lines.join(merged(g), "game_pk")
    df = df.join(merged(other), (F.col("game_pk") == F.col("_pk")) & (F.col("_team") != F.col("team_id")), "left").drop("_pk", "_team")
    home = F.col("team_id") == F.col("home_team_id")
    return df.withColumns({"date": F.date_format("official_date", "yyyy-MM-dd"), "is_home": home, "opponent_id": F.when(home, F.col("away_team_id")).otherwise(F.col("home_team_id"))})


def hitter_game_log(t: Tables, player_id: int | None = None) -> DataFrame:
    df = _opponents(_of(t.batting, "player_id", player_id), t)
    return df.select("player_id", "game_pk", "date", "is_home", "opponent_id", "opponent", "plate_appearances", "at_bats", "hits", "doubles", "triples", "home_runs", "walks", "strikeouts")


def spray_chart(t: Tables, player_id: int | None = None) -> DataFrame:
    """Where balls in play landed, with the bases they were worth.  Only plays with a place go to their game."""
    placed = F.col("hit_coord_x").isNotNull() & F.col("hit_coord_y").isNotNull()
    in_play = F.broadcast(t.event_types.filter("is_ball_in_play").select("event_type"))  # about 25 fixed rows
    plays = t.plays.filter(placed).join(in_play, "event_type", "left_semi")
    df = _of(views.plate_appearances(plays, t.games, t.event_types), "batter_id", player_id).filter(M.tracked())
    return df.select(F.col("batter_id").alias("player_id"), "game_pk", "at_bat_index", "hit_coord_x", "hit_coord_y", "bases")


def _years_and_career(years: DataFrame, sums: list[str], means: dict[str, str]) -> DataFrame:
    """Seasons and a career row (null season) whose means are weighted."""
    career = weighted_rollup(years, ["player_id"], sums, means).withColumn("season", F.lit(None).cast("int"))
    cols = ["player_id", "season", *sums, *means]
    return years.select(*cols).unionByName(career.select(*cols))


def hitter_years(t: Tables, player_id: int | None = None) -> DataFrame:
    years = hitter_seasons(t, player_id).filter("plate_appearances > 0")
    return _years_and_career(years, [*M.BOX_BATTING, "batted_balls", "hard_hits", "barrels", "chases", "out_of_zone_pitches"], {"exit_velocity": "batted_balls"})


def pitcher_seasons(t: Tables, player_id: int | None = None) -> DataFrame:
    key = ["player_id", "season"]
    box = _of(views.tracked_lines(t.pitching, t.games), "player_id", player_id).groupBy(*key).agg(*M.sums(M.PITCHING))
    fast = F.count(F.when(F.col("is_fastball"), F.col("start_speed"))).alias("fastballs")
    pitches = _of(views.outcomes_of(t), "pitcher_id", player_id).groupBy(F.col("pitcher_id").alias("player_id"), "season").agg(*M.pitch_counts(), fast)
    df = box.join(pitches, key, "left")
    return df.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("pitches", "swings", "whiffs", "called_strikes", "fastballs")})


def pitcher_lines(t: Tables, player_id: int | None = None) -> DataFrame:
    rates = M.pitching_rates() | M.whiff_rates()
    return pitcher_seasons(t, player_id).select("player_id", "season", "fastball_velocity", *(v.alias(k) for k, v in rates.items()))


def pitcher_splits(t: Tables, player_id: int | None = None) -> DataFrame:
    rows = explode_splits(_of(views.appearances_of(t), "pitcher_id", player_id), rollups.pitcher_splits())
    return rows.groupBy(F.col("pitcher_id").alias("player_id"), "season", "split").agg(*M.batting_counts())


def pitcher_game_log(t: Tables, player_id: int | None = None) -> DataFrame:
    df = _opponents(_of(t.pitching, "player_id", player_id), t)
    c = F.col
    return df.select(
        "player_id", "game_pk", "date", "is_home", "opponent_id", "opponent", "is_starter", M.decisions(c("is_win"), c("is_loss"), c("is_save"), c("is_hold"), c("is_blown_save")).alias("decisions"),
        (c("outs") / 3).alias("innings"), "batters_faced", "hits", "runs", "earned_runs", "walks", "strikeouts", "home_runs",
    )


def pitcher_years(t: Tables, player_id: int | None = None) -> DataFrame:
    return _years_and_career(pitcher_seasons(t, player_id), [*M.PITCHING, "pitches", "swings", "whiffs", "called_strikes", "fastballs"], {"fastball_velocity": "fastballs"})


def arsenal(t: Tables, player_id: int | None = None) -> DataFrame:
    df = _of(views.outcomes_of(t), "pitcher_id", player_id).filter(F.col("pitch_type").isNotNull())
    mix = df.groupBy(F.col("pitcher_id").alias("player_id"), "season", "pitch_hand", "pitch_type").agg(*M.pitch_mix_counts(), F.avg("spin_rate").alias("spin_rate"), F.avg("induced_vertical_break").alias("ivb"), F.avg("horizontal_break").alias("hb"))
    return with_share(mix, "pitches", ["player_id", "season"])


def league_arsenal(t: Tables) -> DataFrame:
    df = views.outcomes_of(t).filter(F.col("pitch_type").isNotNull() & F.col("pitch_hand").isNotNull())
    return df.groupBy("season", "pitch_hand", "pitch_type").agg(F.avg("induced_vertical_break").alias("ivb"), F.avg("horizontal_break").alias("hb"), F.avg("start_speed").alias("velocity"))


def movement_vs_league(t: Tables, least: int = 20) -> DataFrame:
    """Each pitcher's pitch types against the league's of the same hand, where both have a measured break."""
    own = arsenal(t).filter((F.col("pitches") >= least) & F.col("ivb").isNotNull() & F.col("hb").isNotNull())
    league = league_arsenal(t).filter(F.col("ivb").isNotNull() & F.col("hb").isNotNull()).select("season", "pitch_hand", "pitch_type", F.col("ivb").alias("league_ivb"), F.col("hb").alias("league_hb"))
    df = own.join(league, ["season", "pitch_hand", "pitch_type"])
    return df.select("player_id", "season", "pitch_hand", "pitch_type", "pitches", (F.col("ivb") - F.col("league_ivb")).alias("ivb_diff"), (F.col("hb") - F.col("league_hb")).alias("hb_diff"))


def player_summaries(t: Tables) -> DataFrame:
    """Bio, latest team, number and position, seasons with plate appearances or batters faced, and primary role."""
    played = t.game_players.filter("played").select("player_id", "game_pk", "team_id", "jersey_number", "position")
    g = t.games.filter(M.tracked()).select("game_pk", "official_date", "game_number")
    order = [F.col("official_date").desc(), F.col("game_number").desc(), F.col("game_pk").desc(), F.col("team_id")]
    last = latest_per_key(played.join(merged(g), "game_pk"), ["player_id"], order).select("player_id", "game_pk", F.col("team_id").alias("latest_team_id"), "jersey_number", "position")
    names = t.game_teams.select("game_pk", F.col("team_id").alias("latest_team_id"), F.col("name").alias("latest_team"))
    last = last.join(merged(names), ["game_pk", "latest_team_id"], "left").drop("game_pk")

    def seasons(df: DataFrame, count: str, name: str) -> DataFrame:
        years = views.tracked_lines(df, t.games).groupBy("player_id", "season").agg(F.sum(count).alias("_n")).filter("_n > 0")
        return years.groupBy("player_id").agg(F.array_sort(F.collect_set("season")).alias(name))

    df = last.join(merged(t.players), "player_id", "left").join(merged(seasons(t.batting, "plate_appearances", "batting")), "player_id", "left").join(merged(seasons(t.pitching, "batters_faced", "pitching")), "player_id", "left")
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return df.select(
        "player_id", M.name_or(F.col("full_name"), "Player", F.col("player_id")).alias("name"), "bat_side", "pitch_hand", day("birth_date"), "height", "weight", day("mlb_debut_date"), "active", "latest_team_id", "latest_team", "jersey_number", "position",
        text("batting").alias("batting_seasons"), text("pitching").alias("pitching_seasons"), F.when(F.col("batting").isNull(), "pitching").otherwise("batting").alias("role"),
    )
