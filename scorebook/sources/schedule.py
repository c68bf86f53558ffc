"""Schedule documents: one row for each game, upserts that write changed rows only, and probable pitchers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as M
from ..operators.changes import append_if_changed, changed_rows, replace_by_key, upsert_changed
from ..operators.core import latest_per_key, merged
from . import schemas
from .snapshots import Batch, Snapshots, again, listed

RESCHEDULED_STATES = ("D", "T", "U")
DAY = ["season", "official_date"]


def read_schedule(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Landed schedule documents: a file each, or a line each."""
    return spark.read.schema(schemas.SCHEDULE).json(path, multiLine=not lines)


def parse(documents: DataFrame) -> DataFrame:
    """Games of schedule documents; a key listed under several dates keeps the latest, and of equal dates the first."""
    days = documents.select(F.posexplode("dates").alias("_d", "day"))
    g = days.select(F.to_date("day.date").alias("_listed"), "_d", F.posexplode("day.games").alias("_n", "g"))
    g = latest_per_key(g.withColumn("_pk", F.col("g.gamePk")), ["_pk"], [F.col("_listed").desc(), F.col("_d"), F.col("_n")])
    start = F.to_timestamp("g.gameDate")

    def side(s: str) -> list[Column]:
        t, rec = f"g.teams.{s}", f"g.teams.{s}.leagueRecord"
        return [
            F.col(f"{t}.team.id").alias(f"{s}_team_id"), F.coalesce(f"{t}.score", f"g.linescore.teams.{s}.runs").alias(f"{s}_score"),
            F.concat(F.col(f"{rec}.wins").cast("string"), F.lit("-"), F.col(f"{rec}.losses").cast("string")).alias(f"{s}_record"),
            F.col(f"{t}.probablePitcher.id").alias(f"{s}_probable_id"), F.col(f"{t}.probablePitcher.fullName").alias(f"{s}_probable_name"),
        ]

    on = lambda base: F.col(f"g.linescore.offense.{base}").isNotNull()
    return g.select(
        F.col("g.gamePk").alias("game_pk"), F.expr("try_cast(g.season AS INT)").alias("season"), F.coalesce(F.to_date("g.officialDate"), M.official_date(start)).alias("official_date"), start.alias("start_utc"),
        F.col("g.gameType").alias("game_type"), F.coalesce("g.gameNumber", F.lit(1)).alias("game_number"), F.col("g.doubleHeader").alias("double_header"), F.to_date("g.rescheduledFromDate").alias("rescheduled_from"),
        F.col("g.status.abstractGameState").alias("abstract_state"), F.col("g.status.codedGameState").alias("coded_state"), F.col("g.status.detailedState").alias("detailed_state"), *side("home"), *side("away"),
        F.col("g.linescore.currentInning").alias("inning"), F.lower("g.linescore.inningHalf").alias("inning_half"), F.col("g.linescore.outs").alias("outs"), on("first").alias("on_first"), on("second").alias("on_second"), on("third").alias("on_third"),
        F.col("g.venue.name").alias("venue_name"), F.col("g.seriesGameNumber").alias("series_game_number"), F.col("g.gamesInSeries").alias("games_in_series"), F.col("g.seriesStatus.result").alias("series_result"),
    )


def window(start: Column, end: Column, as_of: Column) -> Column:
    """Whether official_date lies in yesterday to six days ahead, clamped to the season's days."""
    low, high = F.greatest(F.date_sub(as_of, 1), start), F.least(F.date_add(as_of, 6), end)
    return F.col("official_date").between(low, high)


def live_keys(games: DataFrame, as_of: Column) -> DataFrame:
    """Games under way, of yesterday or later."""
    return games.filter((F.col("abstract_state") == "Live") & ~M.completed() & (F.col("official_date") >= F.date_sub(as_of, 1))).select("game_pk")


def upsert_games(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    return upsert_changed(existing, incoming, ["game_pk"])


def completed_keys(games: DataFrame) -> DataFrame:
    return games.filter(M.completed()).select("game_pk")


def rescheduled_keys(games: DataFrame) -> DataFrame:
    return games.filter(F.col("coded_state").isin(*RESCHEDULED_STATES)).select("game_pk")


def probables(games: DataFrame) -> DataFrame:
    """Probable pitchers by side."""
    pick = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"{s}_probable_id").alias("pitcher_id"), F.col(f"{s}_probable_name").alias("pitcher_name"))
    return games.select("game_pk", F.inline(F.array(pick("home"), pick("away"))))


def record_probables(history: DataFrame, games: DataFrame, observed_at: Column) -> DataFrame:
    """Rows to append to the change log of probable pitchers."""
    now = probables(games).withColumn("observed_at", observed_at)
    return append_if_changed(history, now, ["game_pk", "side"], ["pitcher_id", "pitcher_name"], "observed_at")


def upsert_into(batch: Batch, name: str, incoming: DataFrame) -> tuple[bool, DataFrame]:
    """Upserts ``incoming`` games into a table by season within a batch: only seasons that a changed game leaves or enters are written.
    Gives whether any changed, and the changed games as they were and as they are."""
    existing = batch.held(name, incoming.schema)
    changed = batch.stage(changed_rows(existing, incoming, ["game_pk"]))
    both = batch.stage(changed.unionByName(existing.join(changed.select("game_pk"), "game_pk", "left_semi")))
    parts = listed(both.select("season"))
    if parts:
        batch.replace(name, replace_by_key(batch.held(name, incoming.schema, parts), changed, ["game_pk"]), parts)
    return bool(parts), both


def write_games(tables: Snapshots, incoming: DataFrame, name: str = "games") -> None:
    """Upserts ``incoming`` into a table of ``tables`` as one commit."""

    def work() -> None:
        with tables.begin() as batch:
            if upsert_into(batch, name, incoming)[0]:
                batch.commit()

    again(work)


def impacted(previous: DataFrame, incoming: DataFrame) -> DataFrame:
    """Partitions that a change of games touches: the game, its day and both teams, and once a game is completed the season and
    both teams' statistics."""
    changed = changed_rows(previous, incoming, ["game_pk"])
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("key"))
    done = lambda k: F.when(M.completed(), k)
    keys = F.array(key("game", "game_pk"), key("day", "official_date"), key("team", "home_team_id"), key("team", "away_team_id"), done(key("season", "season")), done(key("team_stats", "home_team_id")), done(key("team_stats", "away_team_id")))
    return changed.select(F.inline(F.array_compact(keys))).distinct()


def impacted_players(game_players: DataFrame, games: DataFrame) -> DataFrame:
    """Players who played in any of ``games``."""
    return game_players.filter("played").join(merged(games.select("game_pk").distinct()), "game_pk", "left_semi").select("player_id").distinct()
