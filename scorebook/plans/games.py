"""Game lists and game pages, for all games at once; filter by day or key as needed and Spark prunes the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures as M
from ..operators.core import asof_left_join, contiguous_groups, merged, unpivot_sides, with_previous
from ..tables import Tables
from . import views


def _two_sided_records(t: Tables) -> DataFrame:
    """The record that each team showed at its last completed regular game of a season."""
    g = t.games.filter(M.regular())
    sides = g.select("season", "start_ms", "game_pk", F.inline(F.array(F.struct(F.col("home_team_id").alias("team_id"), F.col("home_record").alias("record")), F.struct(F.col("away_team_id").alias("team_id"), F.col("away_record").alias("record")))))
    return sides.groupBy("season", "team_id").agg(F.max_by("record", F.struct("start_ms", "game_pk")).alias("record"))


def pitcher_season_lines(t: Tables) -> DataFrame:
    p = views.tracked_lines(t.pitching, t.games)
    return p.groupBy("season", "player_id").agg(F.count_if("is_win").alias("wins"), F.count_if("is_loss").alias("losses"), M.ratio(27 * F.sum("earned_runs"), F.sum("outs")).alias("era"))


def game_list(t: Tables) -> DataFrame:
    """Every game with team names as of its season, records and the probable pitchers' lines.

    A postseason game shows both teams' final regular-season record.
    """
    df = t.games
    for side in ("home", "away"):
        names = t.teams.select(F.col("team_id").alias(f"{side}_team_id"), F.col("season").alias("_since"), F.col("team_name").alias(f"{side}_name"), F.col("abbreviation").alias(f"{side}_abbr"))
        df = asof_left_join(df, names, [f"{side}_team_id"], "season", "_since")
        final = _two_sided_records(t).select("season", F.col("team_id").alias(f"{side}_team_id"), F.col("record").alias("_final"))
        df = df.join(final, ["season", f"{side}_team_id"], "left")
        df = df.withColumn(f"{side}_record", F.when(F.col("game_type") == "R", F.col(f"{side}_record")).otherwise(F.col("_final"))).drop("_final")
        line = pitcher_season_lines(t).select("season", F.col("player_id").alias(f"{side}_probable_id"), *(F.col(c).alias(f"{side}_probable_{c}") for c in ("wins", "losses", "era")))
        df = df.join(merged(line), ["season", f"{side}_probable_id"], "left")
    state = M.game_status(F.col("coded_state"), F.col("abstract_state"))
    df = df.withColumn("status", state)
    c = F.col
    return df.select(
        "game_pk", "season", F.date_format("official_date", "yyyy-MM-dd").alias("official_date"), "game_type", "status", M.status_note(c("coded_state"), c("detailed_state")).alias("note"),
        *(M.name_or(c(f"{s}_name"), "Team", c(f"{s}_team_id")).alias(f"{s}_name") for s in ("home", "away")), *(F.coalesce(f"{s}_abbr", c(f"{s}_team_id").cast("string")).alias(f"{s}_abbr") for s in ("home", "away")),
        *(M.shown_score(c("status"), c(f"{s}_score")).alias(f"{s}_score") for s in ("home", "away")), "home_record", "away_record",
        *(f"{s}_probable_{x}" for s in ("home", "away") for x in ("wins", "losses", "era")),
        M.is_doubleheader(c("double_header")).alias("is_doubleheader"), M.makeup_date(c("rescheduled_from"), c("official_date")).alias("makeup_of"), M.postseason_label(c("game_type")).alias("round"),
        F.when(M.postseason_label(c("game_type")).isNotNull(), M.series_label(c("series_game_number"), c("games_in_series"))).alias("series_game"), M.scoreboard_bucket(c("status")).alias("bucket"),
    )


def scoreboard(t: Tables) -> DataFrame:
    """Games of each day in the buckets live, upcoming and done."""
    state = M.game_status(F.col("coded_state"), F.col("abstract_state"))
    return t.games.select("official_date", M.scoreboard_bucket(state).alias("bucket")).groupBy("official_date", "bucket").agg(F.count("*").alias("games"))


def game_headers(t: Tables) -> DataFrame:
    """The columns of the game list with the winning, losing and saving pitcher, by their names in that game."""
    df = game_list(t).join(merged(t.decisions.drop("season")), "game_pk", "left")
    for role in ("winner", "loser", "save"):
        names = t.bios.select("game_pk", F.col("player_id").alias(f"{role}_id"), F.col("full_name").alias(role), F.col("player_id").alias("_known"))
        df = df.join(merged(names), ["game_pk", f"{role}_id"], "left").withColumn(f"{role}_id", F.col("_known")).drop("_known")
    return df


def linescore(t: Tables, least: int = 9) -> DataFrame:
    """A row for each game and inning, ``least`` innings at least, with both halves' runs and the totals.

    ``x`` stands for a half that a completed game did not play.
    """
    c = F.col
    halves = {"away": "top", "home": "bottom"}
    of = lambda s, x: F.when(c("half") == halves[s], x)
    totals = [F.sum(of(s, c(x))).alias(f"{s}_{x}") for s in halves for x in ("runs", "hits", "errors")]
    lists = [F.collect_list(of(s, F.struct("inning", "runs"))).alias(f"_{s}") for s in halves]
    # a game's innings stay together, so its row, totals and lines need one shuffle of the halves and no join of innings
    games = t.linescores.join(merged(t.games.select("game_pk", "coded_state")), "game_pk").groupBy("game_pk", "coded_state").agg(F.max("inning").alias("_last"), *totals, *lists)
    df = games.withColumn("inning", F.explode(F.sequence(F.lit(1), F.greatest("_last", F.lit(least)))))
    runs = lambda s: F.array_max(F.transform(F.filter(f"_{s}", lambda x: x["inning"] == c("inning")), lambda x: x["runs"]))
    shown = lambda s: F.coalesce(runs(s).cast("string"), F.when(M.completed(), "x")).alias(s)
    return df.select("game_pk", "inning", shown("away"), shown("home"), *(F.coalesce(f"{s}_{c}", F.lit(0).cast("long")).alias(f"{s}_{c}") for s in ("away", "home") for c in ("runs", "hits", "errors")))


def play_steps(t: Tables) -> DataFrame:
    """Pitches and the events that are shown of every play, in order, with columns that only one of them has.  A pitch is a strike if it is marked as one."""
    c = F.col
    pitches = t.pitches.select(
        F.lit("pitch").alias("kind"), "game_pk", "at_bat_index", c("pitch_index").alias("step_index"), "pitch_number", F.concat_ws("-", "balls_before", "strikes_before").alias("count"), c("pitch_type_desc").alias("pitch_type"), "start_speed",
        c("call_desc").alias("call"), M.pitch_result(c("is_in_play"), c("is_strike")).alias("result"), M.challenge_result(c("abs_challenged"), c("abs_overturned")).alias("challenge"), "plate_x", "plate_z", c("sz_top").alias("zone_top"), c("sz_bottom").alias("zone_bottom"),
    )
    shown = t.play_events.filter(M.is_shown_event(F.col("kind"), F.col("event_type")))
    events = shown.select("kind", "game_pk", "at_bat_index", F.col("event_index").alias("step_index"), "event_type", "description")
    return pitches.unionByName(events, allowMissingColumns=True)


def play_by_play(t: Tables) -> DataFrame:
    """Plays with the players' names in that game, half-inning groups, pitching changes, and the score after scoring plays."""
    order = ["at_bat_index"]
    df = contiguous_groups(t.plays, ["game_pk"], order, ["inning", "half"], "half_inning")
    df = with_previous(df, ["game_pk", "half"], order, {"_pitcher": "pitcher_id"})
    for role in ("batter", "pitcher"):
        short = F.coalesce("boxscore_name", "full_name").alias(f"_{role}_name")
        df = df.join(merged(t.bios.select("game_pk", F.col("player_id").alias(f"{role}_id"), short, F.coalesce("last_name", "full_name").alias(f"_{role}_last"))), ["game_pk", f"{role}_id"], "left")
    changed = F.coalesce(F.col("pitcher_id") != F.col("_pitcher"), F.lit(False))
    score = lambda s: F.when(F.col("is_scoring_play"), F.col(f"{s}_score_after")).alias(f"{s}_score")
    name = lambda kind, role: M.name_or(F.col(f"_{role}_{kind}"), "Player", F.col(f"{role}_id"))
    return df.select("game_pk", "at_bat_index", "half_inning", "inning", "half", "batter_id", "pitcher_id", "description", "is_scoring_play", name("name", "batter").alias("batter"), name("name", "pitcher").alias("pitcher"), name("last", "pitcher").alias("pitcher_last"), changed.alias("pitching_change"), score("away"), score("home"))


def team_form(t: Tables, n: int = 10) -> DataFrame:
    """For each team's game, its last ``n`` completed games before it in the season: wins, losses and streak.

    Completed games carry the list of the last ``n`` up to themselves; a game takes that of the last one that began before
    it, a running maximum.  One shuffle by team and season serves both windows.
    """
    keep = ["game_pk", "season", "start_ms", "coded_state"]
    g = unpivot_sides(t.games, keep).repartition("team_id", "season")
    g = g.withColumns({"_done": M.completed(), "_won": F.coalesce("won", F.lit(False))})
    latest = Window.partitionBy("team_id", "season", "_done").orderBy(F.col("start_ms"), F.col("game_pk").desc()).rowsBetween(-(n - 1), 0)
    g = g.withColumn("_list", F.collect_list("_won").over(latest))
    before = Window.partitionBy("team_id", "season").orderBy("start_ms").rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("_done"), F.struct("start_ms", -F.col("game_pk"), "_list"))).over(before)
    df = g.withColumn("_form", F.reverse(F.coalesce(last["_list"], F.array().cast("array<boolean>"))))
    flags = F.col("_form")
    first = F.get(flags, F.lit(0))
    other = F.array_position(flags, ~first)
    length = F.when(other > 0, other - 1).otherwise(F.size(flags).cast("long"))
    streak = F.when(F.size(flags) > 0, F.concat(F.when(first, "W").otherwise("L"), length.cast("string")))
    wins = F.size(F.filter(flags, lambda x: x))
    return df.select("game_pk", "team_id", wins.alias("wins"), (F.size(flags) - wins).alias("losses"), streak.alias("streak"))


def head_to_head(t: Tables) -> DataFrame:
    """Completed games of the same two teams in the same season, for every game; later meetings count, itself does not.

    The season's meetings of a pair are summed once; each game takes the sums without its own result.
    """
    low, high = F.least("home_team_id", "away_team_id"), F.greatest("home_team_id", "away_team_id")
    home_is_low = F.col("home_team_id") <= F.col("away_team_id")
    own = lambda better, worse: F.coalesce(F.col("_done") & (F.col(better) > F.col(worse)), F.lit(False)).cast("long")
    g = t.games.select("game_pk", "season", low.alias("_low"), high.alias("_high"), home_is_low.alias("_home_low"), M.completed().alias("_done"), "home_score", "away_score")
    g = g.withColumns({"_home_won": own("home_score", "away_score"), "_away_won": own("away_score", "home_score")})
    low_won = F.when(F.col("_home_low"), F.col("_home_won")).otherwise(F.col("_away_won"))
    high_won = F.when(F.col("_home_low"), F.col("_away_won")).otherwise(F.col("_home_won"))
    sums = g.groupBy("season", "_low", "_high").agg(F.count_if("_done").alias("_n"), F.sum(low_won).alias("_low_won"), F.sum(high_won).alias("_high_won"))
    df = g.join(sums, ["season", "_low", "_high"]).withColumn("meetings", F.col("_n") - F.col("_done").cast("long")).filter("meetings > 0")
    wins = lambda yes, no, won: F.when(F.col("_home_low"), F.col(yes)).otherwise(F.col(no)) - F.col(won)
    return df.select("game_pk", "meetings", wins("_low_won", "_high_won", "_home_won").alias("home_wins"), wins("_high_won", "_low_won", "_away_won").alias("away_wins"))


def starters_before(t: Tables) -> DataFrame:
    """Each side's starter (actual, else probable) with wins, losses, starts and strikeouts before the game, in its season.

    All four counts come from one running sum over the pitcher's games of the season.
    """
    g = t.games.select("game_pk", "season", "start_ms")
    sides = t.games.select("game_pk", "season", "start_ms", F.inline(F.array(F.struct(F.lit("home").alias("side"), F.col("home_probable_id").alias("_probable")), F.struct(F.lit("away").alias("side"), F.col("away_probable_id").alias("_probable")))))
    sides = sides.join(merged(views.game_starters(t.plays)), ["game_pk", "side"], "left").withColumn("pitcher_id", F.coalesce("pitcher_id", "_probable"))
    fact = lambda df, who, name: df.select("game_pk", F.col(who).alias("pitcher_id"), *(F.lit(int(n == name)).alias(n) for n in ("wins", "losses", "starts", "strikeouts")))
    facts = fact(t.decisions, "winner_id", "wins").unionByName(fact(t.decisions, "loser_id", "losses")).unionByName(fact(views.game_starters(t.plays), "pitcher_id", "starts")).unionByName(fact(t.plays.filter(F.col("event_type").like("strikeout%")), "pitcher_id", "strikeouts"))
    counts = ["wins", "losses", "starts", "strikeouts"]
    per_game = facts.groupBy("game_pk", "pitcher_id").agg(*M.sums(counts)).join(merged(g), "game_pk")
    asked = sides.select("season", "pitcher_id", "start_ms", "game_pk", "side", *(F.lit(0).cast("long").alias(c) for c in counts))
    both = per_game.select("season", "pitcher_id", "start_ms", F.lit(None).cast("long").alias("game_pk"), F.lit(None).cast("string").alias("side"), *counts).unionByName(asked)
    w = Window.partitionBy("season", "pitcher_id").orderBy("start_ms").rangeBetween(Window.unboundedPreceding, -1)
    both = both.withColumns({f"prior_{c}": F.coalesce(F.sum(c).over(w), F.lit(0).cast("long")) for c in counts}).filter("side IS NOT NULL")
    return both.select("game_pk", "side", "pitcher_id", *(f"prior_{c}" for c in counts))


def _named_in_game(df: DataFrame, t: Tables) -> DataFrame:
    """Adds ``name``, the player's as of that game."""
    names = t.bios.select("game_pk", "player_id", F.coalesce("boxscore_name", "full_name").alias("_name"))
    return df.join(merged(names), ["game_pk", "player_id"], "left").withColumn("name", M.name_or(F.col("_name"), "Player", F.col("player_id"))).drop("_name")


def box_batting(t: Tables) -> DataFrame:
    """Batters of each side in lineup order, by their names in that game, with the side's totals."""
    place = t.game_players.select("game_pk", "player_id", "team_id", "position", "is_substitute", F.col("batting_order").alias("_order"))
    df = t.batting.join(merged(t.games.select("game_pk", "home_team_id")), "game_pk").withColumn("side", F.when(F.col("team_id") == F.col("home_team_id"), "home").otherwise("away"))
    df = _named_in_game(df.join(merged(place), ["game_pk", "player_id", "team_id"]), t)
    by_side = Window.partitionBy("game_pk", "side")
    slot = F.row_number().over(by_side.orderBy(F.col("_order").asc_nulls_last(), F.col("player_id")))
    df = df.withColumns({"slot": slot, "side_at_bats": F.sum("at_bats").over(by_side), "side_hits": F.sum("hits").over(by_side)})
    return df.select("game_pk", "side", "slot", "player_id", "name", "position", F.coalesce("is_substitute", F.lit(False)).alias("is_substitute"), "at_bats", "runs", "hits", "rbi", "home_runs", "walks", "strikeouts", "side_at_bats", "side_hits")


def box_pitching(t: Tables) -> DataFrame:
    """Pitchers of each side, the starter first, then by first appearance, by their names in that game, with their decision."""
    c = F.col
    seen = t.plays.groupBy("game_pk", c("pitcher_id").alias("player_id")).agg(F.min("at_bat_index").alias("_seen"))
    df = t.pitching.join(merged(t.games.select("game_pk", "home_team_id")), "game_pk").withColumn("side", F.when(c("team_id") == c("home_team_id"), "home").otherwise("away"))
    df = _named_in_game(df.join(merged(seen), ["game_pk", "player_id"], "left"), t)
    place = F.row_number().over(Window.partitionBy("game_pk", "side").orderBy(c("is_starter").desc(), c("_seen").asc_nulls_last(), c("player_id")))
    label = M.decision_label(c("is_win"), c("is_loss"), c("is_save"), c("is_blown_save"), c("is_hold"))
    return df.select("game_pk", "side", place.alias("place"), "player_id", "name", M.innings_text(c("outs")).alias("innings"), "hits", "runs", "earned_runs", "walks", "strikeouts", "home_runs", "pitches", label.alias("decision"))
