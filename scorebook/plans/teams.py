"""Teams: season statistics, trends, standings, records and schedules, for all teams and seasons at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures as M
from ..operators.core import current_streak, latest_per_key, merged, running_and_rolling, topn_per_group, unpivot_sides, with_share
from ..tables import Tables
from . import rollups, views

KEY = ["team_id", "season"]
PLAYED = ["start_ms", "game_number", "game_pk"]


def team_games(t: Tables) -> DataFrame:
    """Completed regular-season games, from either team's side."""
    keep = ["game_pk", "season", "official_date", "start_ms", "game_number", "inning"]
    return unpivot_sides(t.games.filter(M.regular()), keep)


def _latest_first() -> list[Column]:
    return [F.col(c).desc() for c in PLAYED]


def run_differential(t: Tables) -> DataFrame:
    df = team_games(t).withColumn("run_diff", F.col("runs_for") - F.col("runs_against"))
    df = running_and_rolling(df, KEY, [F.col(c) for c in PLAYED], "run_diff", 10)
    return df.select(*KEY, "game_pk", F.date_format("official_date", "yyyy-MM-dd").alias("date"), "run_diff", "cumulative", F.col("rolling").alias("rolling_10"))


def situational_records(t: Tables) -> DataFrame:
    """One-run, extra-inning, blowout, scoring-first, comeback and blown-lead records."""
    c = F.col
    total = c("home_score_after") + c("away_score_after")
    home_bats = c("half") == "bottom"
    ahead = c("home_score_after") > c("away_score_after")
    behind = c("home_score_after") < c("away_score_after")
    flow = t.plays.groupBy("game_pk").agg(F.bool_or(ahead).alias("home_led"), F.bool_or(behind).alias("away_led"), F.min_by(home_bats, F.when(total > 0, c("at_bat_index"))).alias("_first"), F.bool_or(total > 0).alias("_any"))
    df = team_games(t).join(merged(flow), "game_pk", "left")
    own, other = F.when(c("is_home"), c("home_led")).otherwise(c("away_led")), F.when(c("is_home"), c("away_led")).otherwise(c("home_led"))
    first = F.when(c("_any"), c("_first") == c("is_home"))
    margin = F.abs(c("runs_for") - c("runs_against"))
    df = df.withColumns({"led": own, "trailed": other, "scored_first": first, "margin": margin})

    def record(name: str, when: Column) -> list[Column]:
        return [F.count_if(when & c("won")).alias(f"{name}_wins"), F.count_if(when & ~c("won")).alias(f"{name}_losses")]

    return df.groupBy(*KEY).agg(
        *record("one_run", c("margin") == 1), *record("extra", c("inning") > 9), *record("blowout", c("margin") >= 5), *record("scoring_first", c("scored_first")),
        F.count_if(c("trailed") & c("won")).alias("comeback_wins"), F.count_if(c("led") & ~c("won")).alias("blown_leads"),
    )


def runs_by_inning(t: Tables) -> DataFrame:
    g = team_games(t).select("game_pk", *KEY, "is_home")
    df = t.linescores.select("game_pk", "inning", "half", "runs").join(merged(g), "game_pk").withColumn("inning", F.least("inning", F.lit(10)))
    own = (F.col("half") == "bottom") == F.col("is_home")
    runs = lambda when: F.coalesce(F.sum(F.when(when, F.col("runs"))), F.lit(0)).cast("long")
    return df.groupBy(*KEY, "inning").agg(runs(own).alias("scored"), runs(~own).alias("allowed"))


def challenges(t: Tables) -> DataFrame:
    """Ball-strike challenges of each team and of its opponents."""
    p = t.pitches.filter("abs_challenged").select("game_pk", "abs_challenge_team_id", "abs_overturned")
    df = p.join(merged(team_games(t).select("game_pk", *KEY)), "game_pk")
    own = F.col("abs_challenge_team_id") == F.col("team_id")
    over = F.col("abs_overturned")
    df = df.groupBy(*KEY).agg(F.count_if(own).alias("challenges"), F.count_if(own & over).alias("overturned"), F.count_if(~own).alias("opponent_challenges"), F.count_if(~own & over).alias("opponent_overturned"))
    return df.withColumns({"overturn_rate": M.ratio("overturned", "challenges"), "opponent_overturn_rate": M.ratio("opponent_overturned", "opponent_challenges")})


def relief_workload(t: Tables) -> DataFrame:
    """Pitches by others than the game's starters in the last 3 and 7 days up to the team's latest game."""
    games = team_games(t).select("game_pk", *KEY, "is_home", "official_date")
    latest = games.groupBy(*KEY).agg(F.max("official_date").alias("_day"))
    recent = games.join(latest, KEY).filter(F.col("official_date") > F.date_sub("_day", 7))
    fielding_home = F.col("half") == "top"
    pitches = t.pitches.select("game_pk", "half", "pitcher_id").join(merged(recent), "game_pk").filter(fielding_home == F.col("is_home"))
    relief = pitches.join(merged(views.game_starters(t.plays).select("game_pk", "pitcher_id").distinct()), ["game_pk", "pitcher_id"], "left_anti")
    df = relief.groupBy(*KEY, "pitcher_id").agg(F.count_if(F.col("official_date") > F.date_sub("_day", 3)).alias("last_3_days"), F.count("*").alias("last_7_days"))
    names = t.players.select(F.col("player_id").alias("pitcher_id"), "full_name")
    return df.join(merged(names), "pitcher_id", "left").select(*KEY, "pitcher_id", M.name_or(F.col("full_name"), "Player", F.col("pitcher_id")).alias("name"), "last_3_days", "last_7_days")


def records(t: Tables, teams: DataFrame | None = None) -> DataFrame:
    """Wins, losses, run difference, last ten and streak of every team and season; teams without games have none."""
    g = team_games(t)
    decided = g.filter(F.col("won").isNotNull())
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy(*_latest_first()))
    last = decided.withColumn("_n", nth)
    total = last.groupBy(*KEY).agg(F.count_if("won").alias("wins"), F.count_if(~F.col("won")).alias("losses"), F.sum(F.col("runs_for") - F.col("runs_against")).alias("run_diff"), F.count_if(F.col("won") & (F.col("_n") <= 10)).alias("last10_wins"), F.count_if(~F.col("won") & (F.col("_n") <= 10)).alias("last10_losses"), F.sum("runs_for").alias("runs_scored"), F.sum("runs_against").alias("runs_allowed"))
    streak = current_streak(decided, KEY, _latest_first(), "won").select(*KEY, F.concat(F.when(F.col("won"), "W").otherwise("L"), F.col("length").cast("string")).alias("streak"))
    teams = views.season_teams(t.teams, t.games.select("season").distinct()) if teams is None else teams
    df = teams.join(total, KEY, "left").join(streak, KEY, "left")
    zero = ["wins", "losses", "run_diff", "last10_wins", "last10_losses", "runs_scored", "runs_allowed"]
    df = df.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in zero})
    return df.withColumn("pct", M.win_pct(F.col("wins"), F.col("losses")))


def _order() -> list[Column]:
    return [F.col("pct").desc(), F.col("wins").desc(), F.col("name")]


def _behind(keys: list[str], order: list[Column]) -> Column:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return M.games_back(F.first("wins").over(w), F.first("losses").over(w), F.col("wins"), F.col("losses"))


def standings(t: Tables) -> DataFrame:
    """Division tables of all seasons; games back may be negative, as the order is by percentage."""
    df = records(t).filter(F.col("league_name").isNotNull() & F.col("division_id").isNotNull())
    group = ["season", "league_name", "division_id"]
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*_order()))
    df = df.withColumns({"place": place, "games_back": _behind(group, _order())})
    return df.select("season", "league_name", "division_id", "division_name", "place", "team_id", "name", "abbreviation", "wins", "losses", "pct", "games_back", "run_diff", "last10_wins", "last10_losses", "streak")


def wild_card(t: Tables, spots: int = 3) -> DataFrame:
    """All but the division leaders of each league, against the team in the last spot."""
    df = standings(t).filter("place > 1")
    group = ["season", "league_name"]
    w = Window.partitionBy(*group).orderBy(*_order())
    df = df.withColumn("rank", F.row_number().over(w))
    last = df.filter(F.col("rank") <= spots).groupBy(*group).agg(F.max_by("wins", "rank").alias("_w"), F.max_by("losses", "rank").alias("_l"))
    df = df.join(last, group)
    return df.select(*group, "rank", "team_id", "name", "wins", "losses", "pct", M.games_back(F.col("_w"), F.col("_l"), F.col("wins"), F.col("losses")).alias("games_back"))


def standings_seasons(t: Tables) -> DataFrame:
    return t.games.select("season").distinct()


def team_records(t: Tables) -> DataFrame:
    """Record with expected wins; missing scores count as 0 runs."""
    df = records(t).filter(F.col("wins") + F.col("losses") > 0)
    games = F.col("wins") + F.col("losses")
    expected = M.expected_wins(F.col("runs_scored"), F.col("runs_allowed"), games)
    return df.select(*KEY, "wins", "losses", "runs_scored", "runs_allowed", "run_diff", expected.cast("long").alias("expected_wins"), (games - expected).alias("expected_losses"), "streak", "last10_wins", "last10_losses")


def recent_games(t: Tables, n: int = 10) -> DataFrame:
    """The last games that each team completed in a season, of any type."""
    g = unpivot_sides(t.games.filter(M.completed()), ["game_pk", "season", "start_ms", "game_number"])
    return topn_per_group(g, KEY, _latest_first(), n, "rank").select(*KEY, "rank", "game_pk", "opponent_id", "is_home", "runs_for", "runs_against", "won")


def upcoming_games(t: Tables, n: int = 10) -> DataFrame:
    """The next games that each team has not completed."""
    g = unpivot_sides(t.games.filter(~M.completed()), ["game_pk", "season", "start_ms", "game_number"])
    return topn_per_group(g, KEY, [F.col(c) for c in PLAYED], n, "rank").select(*KEY, "rank", "game_pk", "opponent_id", "is_home")


def division_table(t: Tables) -> DataFrame:
    """Division order by wins above losses, then wins and name."""
    df = records(t)
    order = [(F.col("wins") - F.col("losses")).desc(), F.col("wins").desc(), F.col("name")]
    group = ["season", "division_id"]
    df = df.withColumns({"place": F.row_number().over(Window.partitionBy(*group).orderBy(*order)), "games_back": _behind(group, order)})
    return df.select(*group, "place", "team_id", "name", "wins", "losses", "pct", "games_back")


def team_seasons(t: Tables) -> DataFrame:
    """Seasons of each team's own rows, and the latest season in which it has a game."""
    g = unpivot_sides(t.games, ["season"]).groupBy("team_id").agg(F.max("season").alias("season"))
    return t.teams.select("team_id", "season").union(g.select("team_id", "season")).distinct()


def team_stats(t: Tables) -> DataFrame:
    """Batting of each team next to the league, whose totals are per team."""
    b, s = rollups.team_season_batting(t).filter("split = 'all'"), rollups.team_season_swing_decisions(t)
    df = b.join(s, (b["season"] == s["season"]) & (b["scope"] == s["scope"]) & b["team_id"].eqNullSafe(s["team_id"]), "left").drop(s["season"]).drop(s["scope"]).drop(s["team_id"])
    rates = M.batting_rates(F.when(F.col("scope") == "league", F.col("teams")).otherwise(F.lit(1))) | M.swing_rates()
    return df.select("season", "scope", "team_id", "exit_velocity", *(v.alias(k) for k, v in rates.items()))


def pitching_scopes(t: Tables) -> DataFrame:
    """Pitching of team, starters, relievers and league."""
    a, b = rollups.team_season_pitching(t), rollups.team_season_pitches(t)
    df = a.join(b, (a["season"] == b["season"]) & (a["scope"] == b["scope"]) & a["team_id"].eqNullSafe(b["team_id"]), "left").drop(b["season"]).drop(b["scope"]).drop(b["team_id"])
    rates = M.pitching_rates(F.when(F.col("scope") == "league", F.col("teams")).otherwise(F.lit(1))) | M.whiff_rates()
    return df.select("season", "scope", "team_id", "fastball_velocity", *(v.alias(k) for k, v in rates.items()))


def pitch_mix(t: Tables) -> DataFrame:
    df = views.outcomes_of(t).filter(F.col("pitch_type").isNotNull()).groupBy(F.col("fielding_team_id").alias("team_id"), "season", "pitch_type").agg(*M.pitch_mix_counts())
    return with_share(df, "pitches", KEY)


def busiest_hitters(t: Tables, n: int = 5) -> DataFrame:
    df = views.tracked_lines(t.batting, t.games).groupBy(*KEY, "player_id").agg(*M.sums(M.BOX_BATTING))
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("plate_appearances").desc(), "player_id"))).filter(F.col("rank") <= n)
    return df.select(*KEY, "rank", "player_id", "plate_appearances", "home_runs", (M.on_base() + M.ratio("total_bases", "at_bats")).alias("ops"))


def busiest_pitchers(t: Tables, n: int = 5) -> DataFrame:
    df = views.tracked_lines(t.pitching, t.games).groupBy(*KEY, "player_id").agg(*M.sums(M.PITCHING))
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("outs").desc(), "player_id"))).filter(F.col("rank") <= n)
    return df.select(*KEY, "rank", "player_id", (F.col("outs") / 3).alias("innings"), M.ratio(27 * F.col("earned_runs"), "outs").alias("era"))


def compared_to_league(t: Tables) -> DataFrame:
    """Tiles: each team's rates with better, worse or even against the league."""
    df = team_stats(t)
    better = {"ops": "higher", "strikeout_rate": "lower", "walk_rate": "higher", "hard_hit_rate": "higher"}
    league = df.filter("scope = 'league'").select("season", *(F.col(k).alias(f"_{k}") for k in better))
    out = df.filter("scope = 'team'").join(F.broadcast(league), "season")  # a row for each season
    r = lambda c: F.round(c, 9)
    return out.select("season", "team_id", *(M.compared(r(F.col(k)), r(F.col(f"_{k}")), b).alias(k) for k, b in better.items()))
