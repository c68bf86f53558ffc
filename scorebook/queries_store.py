"""Queries of the written stores: landed documents, per-game tables, rollups and reads that take stored rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import testbed, testfeeds
from .plans import leaders
from .queries import END, QUERIES, SQL, START, rounded
from .queries_more import SPAN, _schedule_documents, _store, _stream, _pk
from .sources import feeds, schedule
from .sources.snapshots import Snapshots
from .streaming import ingest, live


# ---- landed files --------------------------------------------------------------------------------------------------
def landed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as compressed files, several in each here, and read as landed ones are."""
    path = f"{_store(spark)}/landed"
    testfeeds.stored(spark, sf_dir).filter("length(json) > 0").write.option("lineSep", "\x1e").option("compression", "gzip").option("maxRecordsPerFile", testfeeds.FILE).text(path)
    return feeds.with_header(feeds.read_documents(spark, path, "\x1e")).select(_pk(), "season", "feed_ts", "is_final", "valid")


def landed_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedule documents written as files and read again."""
    path = f"{_store(spark)}/schedule"
    _schedule_documents(spark, sf_dir).write.text(path)
    g = schedule.parse(schedule.read_schedule(spark, path, lines=True))
    return g.select(_pk(), "season", "official_date", "game_type", "coded_state", "home_team_id", "home_score", "away_team_id", "away_score")


QUERIES["landed_documents"] = landed_documents
SQL["landed_documents"] = SQL["feed_headers"]
QUERIES["landed_schedule"] = landed_schedule
SQL["landed_schedule"] = testbed.oracle("SELECT game_pk, season, official_date, game_type, coded_state, home_team_id, home_score, away_team_id, away_score FROM games")


# ---- from documents to rollups ------------------------------------------------------------------------------------
def _landing(spark: SparkSession, sf_dir: str, path: str, drop: int) -> None:
    """What lands first: earlier live copies of a third of the games; and then: all documents, some of them twice, and broken copies."""
    docs = testfeeds.stored(spark, sf_dir)
    pk = F.expr("try_cast(get_json_object(json, '$.gamePk') AS LONG)")
    early = docs.filter(pk % 3 == 0).select(F.regexp_replace(F.regexp_replace("json", "_120000", "_110000"), '"codedGameState":"."', '"codedGameState":"I"').alias("json"))
    cut = docs.filter(pk % 11 == 0).select(F.expr("substring(json, 1, length(json) - 40)").alias("json"))
    undated = docs.filter(pk % 13 == 0).select(F.regexp_replace("json", "timeStamp", "stamp").alias("json"))
    landed = early if drop == 0 else docs.unionByName(docs.filter(pk % 5 == 0)).unionByName(cut).unionByName(undated).unionByName(undated)
    landed.withColumn("source", F.lit(f"drop {drop}")).write.parquet(f"{path}/drop={drop}")


_stores: dict[tuple[str, str, str], object] = {}


def _once(make):
    """``make(spark, sf_dir)``, called once for a session and its tables."""

    def get(spark: SparkSession, sf_dir: str):
        key = (make.__name__, spark.sparkContext.applicationId, sf_dir)
        if key not in _stores:
            _stores[key] = make(spark, sf_dir)
        return _stores[key]

    return get


@_once
def followed(spark: SparkSession, sf_dir: str) -> tuple[ingest.GameStore, ingest.RollupStore]:
    """A store that followed the landed documents."""
    root, t = _store(spark), testbed.tables(spark, sf_dir)
    store, rolled = ingest.GameStore(spark, root, SPAN), ingest.RollupStore(spark, root, SPAN)
    store.put_games(t.games)
    _landing(spark, sf_dir, f"{root}/landing", 0)
    drops = spark.readStream.schema("json string, source string").parquet(f"{root}/landing").select("json", "source")
    live.run_batches(drops, store.work(), f"{root}/_streams/documents")
    _landing(spark, sf_dir, f"{root}/landing", 1)  # the same stream goes on with what is new
    store.run(drops, rolled, lambda: store.facts(t.games, t.event_types), f"{root}/_streams")
    return store, rolled


QUERIES["stream_rollups"] = lambda spark, sf_dir: rounded(followed(spark, sf_dir)[1].read("team_season_pitching"))
SQL["stream_rollups"] = SQL["team_season_pitching"]
QUERIES["stored_plays"] = lambda spark, sf_dir: followed(spark, sf_dir)[0].read("plays").select(_pk(), "season", "at_bat_index", F.col("batter_id").cast("long").alias("batter_id"), "event_type", "outs_after", "description")
SQL["stored_plays"] = testbed.oracle("SELECT game_pk, g.season, at_bat_index, batter_id, event_type, outs_after, description FROM plays p JOIN games g USING (game_pk) WHERE at_bat_index % 13 <> 12")
QUERIES["stored_documents"] = lambda spark, sf_dir: (lambda s: feeds.current(s.read("feeds_final"), s.read("feeds_live")).select(_pk(), "season", "feed_ts", "is_final"))(followed(spark, sf_dir)[0])
SQL["stored_documents"] = testbed.oracle("SELECT game_pk, season, strftime(official_date, '%Y%m%d') || '_120000' AS feed_ts, coded_state IN ('F','O','Q','R') AS is_final FROM games WHERE game_pk IN (SELECT game_pk FROM plays)")
QUERIES["stored_players"] = lambda spark, sf_dir: followed(spark, sf_dir)[0].tables.read("players").select(F.col("player_id").cast("long").alias("player_id"), _pk(), "season", "source_date", "full_name", "boxscore_name", "weight")
SQL["stored_players"] = testbed.oracle("SELECT player_id, game_pk, season, source_date, full_name, boxscore_name, weight FROM bios QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY source_date DESC, game_number DESC, game_pk DESC) = 1")
# a refused document counts once, however often it came; usable ones are all stored
QUERIES["quarantined"] = lambda spark, sf_dir: followed(spark, sf_dir)[0].read("quarantine").groupBy("reason", "source").agg(F.count("*").alias("documents"))
SQL["quarantined"] = testbed.oracle("WITH d AS (SELECT DISTINCT game_pk FROM plays) SELECT * FROM (SELECT 'no JSON' AS reason, 'drop 1' AS source, count(*) FILTER (game_pk % 11 = 0) AS documents FROM d UNION ALL SELECT 'no feed_ts', 'drop 1', count(*) FILTER (game_pk % 13 = 0) FROM d) WHERE documents > 0")


# ---- reads that take stored rollups ---------------------------------------------------------------------------------
@_once
def _rolled(spark: SparkSession, sf_dir: str) -> ingest.RollupStore:
    """Rollups of all games but those of 1997's second half and of season 1994: a read has stored and open days."""
    t, store = testbed.tables(spark, sf_dir), ingest.RollupStore(spark, _store(spark), SPAN)
    store.rebuild(ingest.within(t, t.games.filter("season <> 1994 AND NOT (season = 1997 AND month(official_date) > 6)"), ["game_pk"]))
    # season 1997 was rolled up when half of its games were there: these count as changed since
    with store.tables.begin() as batch:
        ingest.uncover(batch, t.games.filter("season = 1997 AND month(official_date) > 6").select("season", "official_date"))
        batch.commit()
    return store


def add_stored(name: str, read, like: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(read(testbed.tables(spark, sf_dir), _rolled(spark, sf_dir)))
    SQL[name] = SQL[like]


add_stored("stored_barrel_leaders", lambda t, s: leaders.barrel_rates(t, START, END, per_day=0.005, stored=s), "barrel_leaders")
add_stored("stored_whiff_leaders", lambda t, s: leaders.whiff_rates(t, START, END, per_day=0.05, stored=s), "whiff_leaders")
add_stored("stored_hardest_hit_balls", lambda t, s: leaders.event_board(t, "hardest_hit_balls", START, END, stored=s), "board_hardest_hit_balls")
add_stored("stored_percentiles_hitting", lambda t, s: leaders.season_percentiles(t, "batter", 0.02, stored=s), "percentiles_hitting")
add_stored("stored_percentiles_pitching", lambda t, s: leaders.season_percentiles(t, "pitcher", 0.3, stored=s), "percentiles_pitching")


# ---- histories and states -------------------------------------------------------------------------------------------
def probable_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three snapshots of the schedule, the last one like the second."""
    t, log = testbed.tables(spark, sf_dir), ingest.ProbableLog(spark, _store(spark))
    g = t.games.withColumns({f"{s}_probable_name": F.concat(F.lit("P"), F.col(f"{s}_probable_id").cast("string")) for s in ("home", "away")})
    later = g.withColumn("home_probable_id", F.when(F.col("game_pk") % 5 == 0, F.lit(None)).when(F.col("game_pk") % 7 == 0, F.col("home_probable_id") + 1).otherwise(F.col("home_probable_id")))
    for at, rows in enumerate((g.filter("game_pk % 3 <> 0"), later, later)):
        log.record(rows, F.lit(at))
    return log.history()


QUERIES["probable_history"] = probable_history
SQL["probable_history"] = testbed.oracle(
    "WITH s AS (SELECT game_pk, 0 AS observed_at, unnest(['home', 'away']) AS side, unnest([home_probable_id, away_probable_id]) AS pitcher_id, unnest(['P' || home_probable_id, 'P' || away_probable_id]) AS pitcher_name FROM games WHERE game_pk % 3 <> 0 "
    "UNION ALL SELECT game_pk, n, unnest(['home', 'away']), unnest([CASE WHEN game_pk % 5 = 0 THEN NULL WHEN game_pk % 7 = 0 THEN home_probable_id + 1 ELSE home_probable_id END, away_probable_id]), unnest(['P' || home_probable_id, 'P' || away_probable_id]) FROM games, (SELECT unnest([1, 2]) AS n)), "
    "l AS (SELECT *, lag((pitcher_id, pitcher_name)) OVER w AS before, row_number() OVER w AS k FROM s WINDOW w AS (PARTITION BY game_pk, side ORDER BY observed_at)) "
    "SELECT game_pk, side, pitcher_id, pitcher_name, observed_at FROM l WHERE CASE WHEN k = 1 THEN pitcher_id IS NOT NULL OR pitcher_name IS NOT NULL ELSE (pitcher_id, pitcher_name) IS DISTINCT FROM before END"
)


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, kept by a stream that writes only buckets of users that changed."""
    root = _store(spark)
    tables = Snapshots(spark, root, {"latest": ["bucket"]})
    work = lambda batch, turn: ingest.upsert_latest(tables, "latest", batch.select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id", 16)
    live.run_batches(_stream(spark, sf_dir), work, f"{root}/_streams")
    return tables.read("latest").drop("bucket")


QUERIES["stream_latest_state"] = stream_latest
SQL["stream_latest_state"] = SQL["latest_state"]
