"""Per-game tables from nested documents.  Every function takes documents of any number of games with their typed
projection ``g`` (see ``feeds.parsed``); a batch equals its games one by one, in any order."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.changes import require
from . import schemas


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def completed_plays(parsed: DataFrame) -> DataFrame:
    plays = parsed.select("game_pk", "season", F.explode("g.liveData.plays.allPlays").alias("p"))
    return plays.filter("p.about.isComplete").select("game_pk", "season", F.col("p.about.atBatIndex").alias("at_bat_index"), "p.*")


def _review(prefix: str, r: str) -> list[Column]:
    return [F.col(f"{r}.{a}").alias(f"{prefix}_{b}") for a, b in (("reviewType", "type"), ("isOverturned", "overturned"), ("challengeTeamId", "challenge_team_id"), ("player.id", "player_id"))]


def plays(parsed: DataFrame) -> DataFrame:
    """One row for each completed play; contact is that of its last pitch with contact data."""
    pitch = F.filter("playEvents", lambda e: e["isPitch"])
    df = completed_plays(parsed).withColumns({"pitch_count": F.size(pitch), "hit": F.try_element_at(F.filter(pitch, lambda e: e["hitData"].isNotNull()), F.lit(-1))["hitData"]})
    return df.select(
        "game_pk", "season", "at_bat_index", F.col("about.inning").alias("inning"), F.col("about.halfInning").alias("half"), F.col("matchup.batter.id").alias("batter_id"), F.col("matchup.pitcher.id").alias("pitcher_id"),
        F.col("matchup.batSide.code").alias("bat_side"), F.col("matchup.pitchHand.code").alias("pitch_hand"), F.col("matchup.splits.menOnBase").alias("men_on_base"), F.col("result.event").alias("event"), F.col("result.eventType").alias("event_type"),
        F.col("result.description").alias("description"), F.col("result.rbi").alias("rbi"), F.col("result.isOut").alias("is_out"), F.col("about.isScoringPlay").alias("is_scoring_play"),
        F.col("count.balls").alias("final_balls"), F.col("count.strikes").alias("final_strikes"), F.col("count.outs").alias("outs_after"), F.col("result.homeScore").alias("home_score_after"), F.col("result.awayScore").alias("away_score_after"), "pitch_count",
        *(F.col(f"hit.{n}").alias(snake(n)) for n in ("launchSpeed", "launchAngle", "totalDistance", "trajectory", "hardness")), F.col("hit.location").alias("hit_location"), F.col("hit.coordinates.coordX").alias("hit_coord_x"), F.col("hit.coordinates.coordY").alias("hit_coord_y"),
        F.coalesce("about.hasReview", F.lit(False)).alias("has_review"), *_review("review", "reviewDetails"), F.col("about.startTime").alias("start_time"), F.col("about.endTime").alias("end_time"),
    )


def _before(plays: Column, key: Callable[[Column], Column]) -> Column:
    """For each of a document's completed plays, in order, the place from 0 of the play before it with the same ``key``, or null: one pass over the
    plays carries the last place of every key."""
    seen = F.struct(F.lit(None).cast("map<string,int>").alias("last"), F.array().cast("array<int>").alias("at"))

    def step(s: Column, p: Column) -> Column:
        name, here = key(p), F.size(s["at"])
        last = F.coalesce(s["last"], F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")))
        rest = F.map_filter(last, lambda k, _: ~k.eqNullSafe(name))
        return F.struct(F.map_concat(rest, F.create_map(name, here)).alias("last"), F.concat(s["at"], F.array(F.try_element_at(last, name))).alias("at"))

    return F.aggregate(plays, seen, step, lambda s: s["at"])


def pitches(parsed: DataFrame) -> DataFrame:
    """One row for each pitch, with the count before it and the pitcher who threw it.

    Pitches before the last substitution of their play are credited to the pitcher of the fielding side's play before.
    All that a pitch takes from earlier plays and events comes from the arrays of its own document, so nothing is shuffled.
    """
    none = F.lit("")
    half = lambda p: F.concat_ws("|", F.coalesce(p["about"]["inning"].cast("string"), none), F.coalesce(p["about"]["halfInning"], none))
    done = F.filter("g.liveData.plays.allPlays", lambda p: p["about"]["isComplete"])
    ordered = F.array_sort(done, lambda a, b: F.when(a["about"]["atBatIndex"] < b["about"]["atBatIndex"], -1).when(a["about"]["atBatIndex"] > b["about"]["atBatIndex"], 1).otherwise(0))
    df = parsed.select("game_pk", "season", ordered.alias("plays"))
    outs = F.transform("plays", lambda p: F.struct(p["about"].alias("about"), p["count"]["outs"].alias("outs"), p["matchup"].alias("matchup")))
    df = df.withColumn("context", outs).withColumns({"_half": _before(F.col("context"), half), "_side": _before(F.col("context"), lambda p: F.coalesce(p["about"]["halfInning"], none))})
    df = df.select("game_pk", "season", "context", "_half", "_side", F.posexplode("plays").alias("_n", "p"))
    at = lambda place: F.get("context", F.get(place, F.col("_n")))  # noqa: E731  a null place gives null
    substitution = F.try_element_at(F.filter("p.playEvents", lambda e: e["details"]["eventType"] == "pitching_substitution"), F.lit(-1))["index"]
    events = F.array_sort("p.playEvents", lambda a, b: F.when(a["index"] < b["index"], -1).when(a["index"] > b["index"], 1).otherwise(0))
    df = df.select(
        "game_pk", "season", F.col("p.about.atBatIndex").alias("at_bat_index"), "p.about", "p.matchup", "p.reviewDetails", F.coalesce(at("_half")["outs"], F.lit(0)).alias("outs_before_play"), at("_side")["matchup"].alias("previous"), substitution.alias("changed_at"),
        F.array_max(F.transform(F.filter("p.playEvents", lambda e: e["isPitch"]), lambda e: e["index"])).alias("last_pitch"), events.alias("events"),
    )
    df = df.select("*", F.posexplode("events").alias("_k", "e")).filter("e.isPitch")
    earlier = F.when(F.col("_k") > 0, F.get("events", F.col("_k") - 1)["count"])
    df = df.withColumns(
        {
            "is_last": F.col("e.index") == F.col("last_pitch"),
            "balls_before": F.coalesce(earlier["balls"], F.lit(0)),
            "strikes_before": F.coalesce(earlier["strikes"], F.lit(0)),
            "outs_before": F.coalesce(earlier["outs"], F.col("outs_before_play")),
            "by": F.when(F.col("e.index") < F.col("changed_at"), F.coalesce("previous", "matchup")).otherwise(F.col("matchup")),
        }
    )
    challenge = F.when(F.col("e.reviewDetails.reviewType") == "MJ", F.col("e.reviewDetails")).when(F.col("is_last") & (F.col("reviewDetails.reviewType") == "MJ"), F.col("reviewDetails"))
    df = df.withColumn("abs", challenge)
    data, hit = "e.pitchData", "e.hitData"
    return df.select(
        "game_pk", "season", "at_bat_index", F.col("e.index").alias("pitch_index"), F.col("e.playId").alias("play_id"), F.col("e.pitchNumber").alias("pitch_number"), F.col("about.inning").alias("inning"), F.col("about.halfInning").alias("half"),
        F.col("matchup.batter.id").alias("batter_id"), F.col("by.pitcher.id").alias("pitcher_id"), F.col("matchup.batSide.code").alias("bat_side"), F.col("by.pitchHand.code").alias("pitch_hand"), "balls_before", "strikes_before", "outs_before",
        F.col("e.details.type.code").alias("pitch_type"), F.col("e.details.type.description").alias("pitch_type_desc"), F.col("e.details.call.code").alias("call_code"), F.col("e.details.call.description").alias("call_desc"), F.col("e.details.description").alias("description"),
        *(F.col(f"e.details.{n}").alias(snake(n)) for n in ("isInPlay", "isStrike", "isBall", "isOut")), *(F.col(f"{data}.{n}").alias(snake(n)) for n in ("startSpeed", "endSpeed", "extension", "plateTime", "typeConfidence", "zone")),
        F.col(f"{data}.strikeZoneTop").alias("sz_top"), F.col(f"{data}.strikeZoneBottom").alias("sz_bottom"), F.col(f"{data}.coordinates.pX").alias("plate_x"), F.col(f"{data}.coordinates.pZ").alias("plate_z"), F.col(f"{data}.coordinates.pfxX").alias("pfx_x"), F.col(f"{data}.coordinates.pfxZ").alias("pfx_z"),
        *(F.col(f"{data}.coordinates.{n}").alias(n.lower()) for n in ("x0", "y0", "z0", "vX0", "vY0", "vZ0", "aX", "aY", "aZ")), *(F.col(f"{data}.breaks.{n}").alias(snake(n)) for n in ("breakAngle", "breakLength", "breakY", "breakVertical", "spinRate", "spinDirection")),
        F.col(f"{data}.breaks.breakVerticalInduced").alias("induced_vertical_break"), F.col(f"{data}.breaks.breakHorizontal").alias("horizontal_break"), *(F.col(f"{hit}.{n}").alias(snake(n)) for n in ("launchSpeed", "launchAngle", "totalDistance", "trajectory", "hardness")), F.col(f"{hit}.location").alias("hit_location"),
        F.col("abs").isNotNull().alias("abs_challenged"), F.col("abs.isOverturned").alias("abs_overturned"), F.col("abs.challengeTeamId").alias("abs_challenge_team_id"), F.col("abs.player.id").alias("abs_challenger_id"), F.col("e.startTime").alias("start_time"), F.col("e.endTime").alias("end_time"),
    )


def play_events(parsed: DataFrame) -> DataFrame:
    """Events that are known not to be pitches."""
    df = completed_plays(parsed).select("game_pk", "season", "at_bat_index", F.explode("playEvents").alias("e")).filter(~F.col("e.isPitch"))
    return df.select("game_pk", "season", "at_bat_index", F.col("e.index").alias("event_index"), F.col("e.type").alias("kind"), F.col("e.details.eventType").alias("event_type"), F.col("e.details.call.code").alias("call_code"), F.col("e.details.description").alias("description"), F.col("e.details.isScoringPlay").alias("is_scoring_play"), F.col("e.player.id").alias("player_id"), F.col("e.startTime").alias("start_time"))


def linescores(parsed: DataFrame) -> DataFrame:
    """A row for each half inning that has a line; a line without runs is a half that was not played."""
    df = parsed.select("game_pk", "season", F.explode("g.liveData.linescore.innings").alias("i"))
    halves = F.array(F.struct(F.lit("top").alias("half"), F.col("i.away").alias("line")), F.struct(F.lit("bottom").alias("half"), F.col("i.home").alias("line")))
    df = df.select("game_pk", "season", F.col("i.num").alias("inning"), F.inline(halves)).filter("line IS NOT NULL")
    return df.select("game_pk", "season", "inning", "half", *(F.col(f"line.{n}").alias(snake(n)) for n in ("runs", "hits", "errors", "leftOnBase")))


def decisions(parsed: DataFrame) -> DataFrame:
    d = "g.liveData.decisions"
    return parsed.filter(f"{d}.winner IS NOT NULL").select("game_pk", "season", *(F.col(f"{d}.{n}.id").alias(f"{n}_id") for n in ("winner", "loser", "save")))


def _played(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.size("g.liveData.plays.allPlays") > 0)


def box_players(parsed: DataFrame) -> DataFrame:
    df = _played(parsed).select("game_pk", "season", F.explode("g.liveData.boxscore.teams").alias("side", "box"))
    return df.select("game_pk", "season", "side", F.col("box.team.id").alias("team_id"), F.explode(F.map_values("box.players")).alias("p"))


def game_players(parsed: DataFrame) -> DataFrame:
    return box_players(parsed).select(
        "game_pk", "season", F.col("p.person.id").alias("player_id"), "team_id", "side", F.col("p.jerseyNumber").alias("jersey_number"), F.col("p.position.abbreviation").alias("position"),
        F.transform("p.allPositions", lambda x: x["abbreviation"]).alias("all_positions"), F.expr("try_cast(p.battingOrder AS INT)").alias("batting_order"), F.col("p.gameStatus.isSubstitute").alias("is_substitute"), F.col("p.allPositions").isNotNull().alias("played"),
    )


#: Counters whose table name differs from their field's.
RENAMED = {"baseOnBalls": "walks", "strikeOuts": "strikeouts", "hitByPitch": "hit_by_pitch", "groundIntoDoublePlay": "ground_into_double_plays", "battersFaced": "batters_faced", "numberOfPitches": "pitches"}


def _line(parsed: DataFrame, kind: str, counters: list[str]) -> DataFrame:
    s = f"p.stats.{kind}"
    df = box_players(parsed).filter(F.col(f"{s}.gamesPlayed") > 0)
    return df.select("game_pk", "season", F.col("p.person.id").alias("player_id"), "team_id", "side", *(F.col(f"{s}.{n}").alias(RENAMED.get(n, snake(n))) for n in counters))


def batting_lines(parsed: DataFrame) -> DataFrame:
    return _line(parsed, "batting", schemas.BATTING.split()[1:])


def pitching_lines(parsed: DataFrame) -> DataFrame:
    """Pitching counters, with starts and decisions as flags."""
    flags = {"gamesStarted": "is_starter", "wins": "is_win", "losses": "is_loss", "saves": "is_save", "holds": "is_hold", "blownSaves": "is_blown_save"}
    df = _line(parsed, "pitching", schemas.PITCHING.split()[1:])
    return df.select(*((F.col(snake(n)) > 0).alias(flags[n]) if (n := next((k for k in flags if snake(k) == c), None)) else F.col(c) for c in df.columns))


def game_teams(parsed: DataFrame) -> DataFrame:
    df = _played(parsed).select("game_pk", "season", F.col("g.gameData.datetime.officialDate").alias("source_date"), F.coalesce("g.gameData.game.gameNumber", F.lit(1)).alias("source_game_number"), F.explode(F.map_values("g.gameData.teams")).alias("t")).filter("t.id IS NOT NULL")
    names = [F.col(f"t.{n}").alias(snake(n)) for n in ("name", "teamName", "abbreviation", "locationName", "shortName", "teamCode")]
    more = [F.col(f"t.{n}.{a}").alias(f"{n}_{a}") for n in ("league", "division", "venue") for a in ("id", "name")]
    return df.select("game_pk", "season", F.col("t.id").alias("team_id"), *names, *more, "source_date", "source_game_number")


def bios(parsed: DataFrame) -> DataFrame:
    df = _played(parsed).select("game_pk", "season", F.col("g.gameData.datetime.officialDate").alias("source_date"), F.coalesce("g.gameData.game.gameNumber", F.lit(1)).alias("game_number"), F.explode(F.map_values("g.gameData.players")).alias("p")).filter("p.id IS NOT NULL")
    plain = [F.col(f"p.{n}").alias(snake(n)) for n in ("fullName", "firstName", "lastName", "boxscoreName", "birthDate", "height", "weight", "mlbDebutDate", "active")]
    return df.select("game_pk", "season", F.col("p.id").alias("player_id"), *plain, F.col("p.batSide.code").alias("bat_side"), F.col("p.pitchHand.code").alias("pitch_hand"), F.col("p.strikeZoneTop").alias("sz_top"), F.col("p.strikeZoneBottom").alias("sz_bottom"), "source_date", "game_number")


TABLES = {"plays": plays, "pitches": pitches, "play_events": play_events, "linescores": linescores, "decisions": decisions, "game_players": game_players, "batting": batting_lines, "pitching": pitching_lines, "game_teams": game_teams, "bios": bios}
#: Keys and domains that a derived table must keep, or the batch is refused and the old rows stay.
RULES = {
    "plays": {"not_null": ["game_pk", "at_bat_index"], "unique": ["game_pk", "at_bat_index"], "domains": {"half": ("top", "bottom"), "bat_side": ("L", "R", "S"), "pitch_hand": ("L", "R", "S")}},
    "pitches": {"not_null": ["game_pk", "at_bat_index", "pitch_index"], "unique": ["game_pk", "at_bat_index", "pitch_index"], "domains": {"half": ("top", "bottom")}},
}


def derive_all(parsed: DataFrame, check: bool = True) -> dict[str, DataFrame]:
    """All per-game tables of a batch; broken rules raise before anything is replaced."""
    out = {name: make(parsed) for name, make in TABLES.items()}
    return {name: require(df, **RULES[name]) if check and name in RULES else df for name, df in out.items()}


def replace_games(existing: dict[str, DataFrame], derived: dict[str, DataFrame], keys: DataFrame) -> dict[str, DataFrame]:
    """Existing tables with the rows of the batch's games replaced; a game that lost all rows of a table loses them here too."""
    return {n: existing[n].join(keys, "game_pk", "left_anti").unionByName(derived[n]) for n in derived}


def summary(parsed: DataFrame, final_keys: DataFrame) -> DataFrame:
    """Plays, pitches and seasons with final documents of a batch."""
    seasons = parsed.join(final_keys, "game_pk", "left_semi").agg(F.array_sort(F.collect_set("season")).alias("seasons"))
    return plays(parsed).agg(F.count("*").alias("plays")).crossJoin(pitches(parsed).agg(F.count("*").alias("pitches"))).crossJoin(seasons)
