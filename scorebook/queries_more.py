"""Queries of the change, document and streaming operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import testbed, testfeeds
from .functions import measures as M
from .operators import changes as C
from .operators import core
from .plans import rollups, views
from .queries import PA, PO, QUERIES, SQL, add, rounded
from .sources import derive, feeds, schedule, schemas
from .sources.sinks import shared_folder
from .sources.snapshots import Snapshots
from .streaming import ingest, live


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def add_events(name: str, query: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(_events(spark, sf_dir)))
    if sql:
        SQL[name] = sql


# ---- changes of rows ---------------------------------------------------------------------------------------------
GAME = ["game_pk", "season", "official_date", "coded_state", "home_score", "away_score"]
_later = lambda t: t.games.select(*GAME).filter("game_pk % 4 = 0").withColumns({"home_score": F.when(F.col("game_pk") % 8 == 0, F.col("home_score") + 1).otherwise(F.when(F.col("game_pk") % 12 == 0, F.lit(None)).otherwise(F.col("home_score")))})
_base = lambda t: t.games.select(*GAME).filter("game_pk % 5 <> 0")
COLS = ", ".join(GAME)
BASE_SQL = f"base AS (SELECT {COLS} FROM games WHERE game_pk % 5 <> 0)"
LATER_SQL = "later AS (SELECT game_pk, season, official_date, coded_state, CASE WHEN game_pk % 8 = 0 THEN home_score + 1 WHEN game_pk % 12 = 0 THEN NULL ELSE home_score END AS home_score, away_score FROM games WHERE game_pk % 4 = 0)"
CHANGED_SQL = "changed AS (SELECT l.* FROM later l LEFT JOIN base b USING (game_pk) WHERE b.game_pk IS NULL OR (l.season, l.official_date, l.coded_state, l.home_score, l.away_score) IS DISTINCT FROM (b.season, b.official_date, b.coded_state, b.home_score, b.away_score))"
add("changed_rows", lambda t: C.changed_rows(_base(t), _later(t), ["game_pk"]), f"WITH {BASE_SQL}, {LATER_SQL}, {CHANGED_SQL} SELECT * FROM changed")
add("upsert_games", lambda t: schedule.upsert_games(_base(t), _later(t))[0], f"WITH {BASE_SQL}, {LATER_SQL}, {CHANGED_SQL} SELECT * FROM base WHERE game_pk NOT IN (SELECT game_pk FROM changed) UNION ALL SELECT * FROM changed")
add("replace_rows", lambda t: C.substitute_rows(_base(t), _later(t), ["game_pk"]), f"WITH {BASE_SQL}, {LATER_SQL} SELECT * FROM base WHERE game_pk NOT IN (SELECT game_pk FROM later) UNION ALL SELECT * FROM later WHERE game_pk IN (SELECT game_pk FROM base)")
add("replace_by_key", lambda t: C.replace_by_key(_base(t), _later(t), ["game_pk"]), f"WITH {BASE_SQL}, {LATER_SQL} SELECT * FROM base WHERE game_pk NOT IN (SELECT game_pk FROM later) UNION ALL SELECT * FROM later")
add("snapshot_diff", lambda t: C.snapshot_diff(t.plays.select("game_pk", "at_bat_index", "event", "outs_after").filter("at_bat_index < 3"), t.plays.select("game_pk", "at_bat_index", "event", F.when(F.col("batter_id") % 10 == 0, 0).otherwise(F.col("outs_after")).alias("outs_after")), ["game_pk", "at_bat_index"]), "SELECT game_pk, at_bat_index, event, CASE WHEN batter_id % 10 = 0 THEN 0 ELSE outs_after END AS outs_after FROM plays WHERE at_bat_index >= 3 OR batter_id % 10 = 0")
add("reconcile", lambda t: C.reconcile(t.batting.groupBy("player_id").agg(F.sum("hits").alias("hits"), F.sum("home_runs").alias("home_runs")), views.plate_appearances(t.plays, t.games, t.event_types).filter("at_bat_index <> 7").groupBy(F.col("batter_id").alias("player_id")).agg(F.count_if(F.col("bases") > 0).alias("hits"), F.count_if(F.col("bases") == 4).alias("home_runs")), ["player_id"], ["hits", "home_runs"]), "SELECT a.*, b.hits AS other_hits, b.home_runs AS other_home_runs FROM (SELECT player_id, sum(hits) AS hits, sum(home_runs) AS home_runs FROM batting GROUP BY player_id) a LEFT JOIN (SELECT batter_id AS player_id, count(*) FILTER (bases > 0) AS hits, count(*) FILTER (bases = 4) AS home_runs FROM plate_appearances WHERE at_bat_index <> 7 GROUP BY batter_id) b USING (player_id) WHERE (a.hits, a.home_runs) IS DISTINCT FROM (b.hits, b.home_runs)", "", "hits home_runs")
add("unknown_category", lambda t: C.unknown_values(t.plays.withColumn("event_type", F.when(F.col("q") % 7 == 0, F.concat("event_type", F.lit("_x"))).otherwise(F.col("event_type"))), t.event_types, "event_type"), "SELECT DISTINCT event_type || '_x' AS event_type FROM plays WHERE q % 7 = 0")
add("constraint_checks", lambda t: C.check_constraints(t.plays.withColumn("half", F.when(F.col("q") == 7, "sideways").otherwise(F.col("half"))), ["launch_speed", "batter_id"], ["game_pk", "inning"], {"half": ("top", "bottom")}), "SELECT 'null:launch_speed' AS rule, count(*) FILTER (raw_speed IS NULL) AS violations FROM plays UNION ALL SELECT 'null:batter_id', count(*) FILTER (batter_id IS NULL) FROM plays UNION ALL SELECT 'domain:half', count(*) FILTER (q = 7) FROM plays UNION ALL SELECT 'unique:game_pk,inning', count(*) FROM (SELECT 1 FROM plays GROUP BY game_pk, inning HAVING count(*) > 1)")
add("asof_team", lambda t: core.asof_left_join(t.games.select("game_pk", "season", F.col("home_team_id").alias("team_id")), t.teams.select("team_id", F.col("season").alias("since"), "name"), ["team_id"], "season", "since"), "SELECT g.game_pk, g.season, g.home_team_id AS team_id, t.name FROM games g ASOF LEFT JOIN teams t ON t.team_id = g.home_team_id AND g.season >= t.season")
add("unpivot_sides", lambda t: core.unpivot_sides(t.games, ["game_pk", "season"]), "SELECT game_pk, season, unnest([home_team_id, away_team_id]) AS team_id, unnest([away_team_id, home_team_id]) AS opponent_id, unnest([true, false]) AS is_home, unnest([home_score, away_score]) AS runs_for, unnest([away_score, home_score]) AS runs_against, unnest([home_score > away_score, away_score > home_score]) AS won FROM games")
add("streak", lambda t: core.current_streak(core.unpivot_sides(t.games.filter(M.regular()), ["game_pk", "season", "start_ms"]), ["team_id", "season"], [F.col("start_ms").desc(), F.col("game_pk").desc()], "won"), "WITH g AS (SELECT season, start_ms, game_pk, unnest([home_team_id, away_team_id]) AS team_id, unnest([home_score > away_score, away_score > home_score]) AS won FROM regular), n AS (SELECT *, row_number() OVER (PARTITION BY team_id, season ORDER BY start_ms DESC, game_pk DESC) AS n FROM g), f AS (SELECT team_id, season, arg_min(won, n) AS won, count(*) AS games FROM n GROUP BY ALL) SELECT f.team_id, f.season, f.won, coalesce(min(n.n) - 1, any_value(games)) AS length FROM f LEFT JOIN n ON n.team_id = f.team_id AND n.season = f.season AND n.won <> f.won GROUP BY f.team_id, f.season, f.won")
add("rebuild_equals_days", lambda t: rollups.batted_ball_days(t).groupBy("season", "player_id").agg(F.sum("batted_balls").alias("batted_balls"), F.sum("barrels").alias("barrels")), f"SELECT season, batter_id AS player_id, count(launch_speed) AS batted_balls, count(*) FILTER (launch_speed >= 98 AND launch_angle BETWEEN greatest(8, 26 - (launch_speed - 98)) AND least(50, 30 + 1.5 * (launch_speed - 98))) AS barrels FROM {PA} GROUP BY ALL")
add("impacted_keys", lambda t: schedule.impacted(t.games.filter("game_pk % 50 <> 0").select(*GAME, "home_team_id", "away_team_id"), t.games.select(*GAME, "home_team_id", "away_team_id")), "WITH c AS (SELECT * FROM games WHERE game_pk % 50 = 0) SELECT DISTINCT unnest(['game', 'day', 'team', 'team']) AS kind, unnest([game_pk::VARCHAR, official_date::VARCHAR, home_team_id::VARCHAR, away_team_id::VARCHAR]) AS key FROM c UNION SELECT unnest(['season', 'team_stats', 'team_stats']), unnest([season::VARCHAR, home_team_id::VARCHAR, away_team_id::VARCHAR]) FROM c WHERE coded_state IN ('F','O','Q','R')")
_hist = lambda t: schedule.probables(t.games.withColumns({"home_probable_name": F.lit("x"), "away_probable_name": F.lit("x")}).filter("game_pk % 3 <> 0")).withColumns({"observed_at": F.lit(1), "pitcher_id": F.when(F.col("game_pk") % 7 == 0, F.col("pitcher_id") + 1).otherwise(F.col("pitcher_id"))})
add("record_probables", lambda t: schedule.record_probables(_hist(t), t.games.withColumns({"home_probable_name": F.lit("x"), "away_probable_name": F.lit("x"), "home_probable_id": F.when(F.col("game_pk") % 5 == 0, None).otherwise(F.col("home_probable_id"))}), F.lit(2)).drop("pitcher_name"), "WITH now AS (SELECT game_pk, unnest(['home', 'away']) AS side, unnest([CASE WHEN game_pk % 5 = 0 THEN NULL ELSE home_probable_id END, away_probable_id]) AS pitcher_id FROM games), hist AS (SELECT game_pk, unnest(['home', 'away']) AS side, unnest([home_probable_id, away_probable_id]) + CASE WHEN game_pk % 7 = 0 THEN 1 ELSE 0 END AS pitcher_id FROM games WHERE game_pk % 3 <> 0) SELECT n.game_pk, n.side, n.pitcher_id, 2 AS observed_at FROM now n LEFT JOIN hist h ON h.game_pk = n.game_pk AND h.side = n.side WHERE (n.pitcher_id, 'x') IS DISTINCT FROM (h.pitcher_id, CASE WHEN h.game_pk IS NOT NULL THEN 'x' END)")

# ---- versioned documents, on the change stream --------------------------------------------------------------------
_of = lambda e, kind: C.latest_state(e.filter(F.col("event_type") == kind).select("user_id", "event_id", "value"), ["user_id"], "event_id")
LATEST = "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = '{0}' GROUP BY user_id"
add_events("latest_state", lambda e: C.latest_state(e.select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id"), "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
add_events("versioned_upsert", lambda e: C.versioned_upsert(_of(e, "click"), _of(e, "view"), _of(e, "purchase"), "user_id", "event_id").drop("_stored"), f"WITH a AS ({LATEST.format('click')}), o AS ({LATEST.format('view')}), i AS ({LATEST.format('purchase')}), f AS (SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.user_id = i.user_id AND o.event_id >= i.event_id)) SELECT * FROM (SELECT *, 0 AS n FROM a UNION ALL SELECT *, 1 FROM f) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC, n) = 1".replace("SELECT * FROM (SELECT *, 0", "SELECT user_id, event_id, value FROM (SELECT *, 0"))
add_events("newer_of_two", lambda e: C.newer_of_two(_of(e, "click"), _of(e, "view"), "user_id", "event_id"), f"WITH a AS ({LATEST.format('click')}), b AS ({LATEST.format('view')}) SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = a.user_id AND b.event_id >= a.event_id) UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = b.user_id AND a.event_id > b.event_id)")
add_events("append_if_changed", lambda e: C.append_if_changed(e.filter("event_type = 'view'").select("user_id", F.floor(F.col("value") / 50).cast("int").alias("level"), F.col("event_id").alias("at")), _of(e, "click").select("user_id", F.floor(F.col("value") / 50).cast("int").alias("level"), F.col("event_id").alias("at")), ["user_id"], ["level"], "at"), f"SELECT c.user_id, floor(c.value / 50)::INTEGER AS level, c.event_id AS at FROM ({LATEST.format('click')}) c LEFT JOIN ({LATEST.format('view')}) v USING (user_id) WHERE floor(c.value / 50)::INTEGER IS DISTINCT FROM floor(v.value / 50)::INTEGER")
add_events("patch_state", lambda e: C.patch(_of(e, "click"), _of(e, "purchase").filter("user_id % 2 = 0").withColumn("value", F.when(F.col("user_id") % 4 == 0, None).otherwise(F.col("value"))), ["user_id"], ["value"]), f"SELECT c.user_id, c.event_id, CASE WHEN p.user_id IS NOT NULL AND c.user_id % 4 = 0 THEN NULL WHEN p.user_id IS NOT NULL THEN p.value ELSE c.value END AS value FROM ({LATEST.format('click')}) c LEFT JOIN ({LATEST.format('purchase')}) p ON p.user_id = c.user_id AND p.user_id % 2 = 0")
add_events("json_props", lambda e: e.select("event_id", F.from_json("props", "k INT")["k"].alias("k"), F.expr("try_cast(get_json_object(props, '$.k') AS INT)").alias("k_path")), "SELECT event_id, (props->>'$.k')::INTEGER AS k, (props->>'$.k')::INTEGER AS k_path FROM events")
add_events("dedupe_event_id", lambda e: e.unionByName(e.filter("event_id % 10 = 0")).dropDuplicates(["event_id"]).select("event_id", "user_id", "event_type"), "SELECT event_id, user_id, event_type FROM events")
add_events("version_changes", lambda e: live.changes_over_versions(e.select("user_id", "event_id", "event_type"), "event_id", ["user_id"]), "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 1 OR event_type <> before")
_runs = lambda e: e.select("user_id", "event_id", live.current_runs(F.floor("value"), F.when(F.col("event_id") % 3 != 0, F.col("event_id") * 5 % 60)).alias("home_runs"), live.current_runs(F.when(F.col("event_id") % 4 != 0, F.col("event_id") * 7 % 13), F.col("user_id") % 11).alias("away_runs"))
add_events("scoring_alerts", lambda e: live.scoring_alerts(_runs(e), ["user_id"], "event_id").select("user_id", "event_id", "scored"), "SELECT user_id, event_id, CASE WHEN a > lag_a THEN 'away' WHEN h > lag_h THEN 'home' END AS scored FROM (SELECT user_id, event_id, a, h, lag(a) OVER w AS lag_a, lag(h) OVER w AS lag_h FROM (SELECT user_id, event_id, greatest(CASE WHEN event_id % 4 <> 0 THEN event_id * 7 % 13 ELSE 0 END, user_id % 11) AS a, greatest(coalesce(floor(value), 0), CASE WHEN event_id % 3 <> 0 THEN event_id * 5 % 60 ELSE 0 END) AS h FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE a > lag_a OR h > lag_h")

# ---- documents ---------------------------------------------------------------------------------------------------
DONE = "(SELECT * FROM plays WHERE at_bat_index % 13 <> 12)"


_BAT = ["plate_appearances", "at_bats", "hits", "doubles", "triples", "home_runs", "total_bases", "walks", "hit_by_pitch", "sac_flies", "strikeouts", "runs", "rbi", "intentional_walks", "sac_bunts", "stolen_bases", "caught_stealing", "ground_into_double_plays", "left_on_base"]
_ARM, _FLAGS = ["outs", "batters_faced", "hits", "runs", "earned_runs", "home_runs", "walks", "strikeouts"], ["is_starter", "is_win", "is_loss", "is_save", "is_hold", "is_blown_save"]
_long = lambda c: F.col(c).cast("long").alias(c)
_pk = lambda: _long("game_pk")


def add_feed(name: str, query: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(query(testfeeds.parsed(spark, sf_dir)))
    SQL[name] = testbed.oracle(sql)


add_feed("feed_plays", lambda g: derive.plays(g).select(F.col("game_pk").cast("long").alias("game_pk"), "season", "at_bat_index", "inning", "half", F.col("batter_id").cast("long").alias("batter_id"), "event_type", "outs_after", "home_score_after", "pitch_count", "launch_speed", "has_review"), f"SELECT p.game_pk, g.season, at_bat_index, p.inning, half, batter_id, event_type, outs_after, home_score_after, (q % 4 + 1)::INTEGER AS pitch_count, CASE WHEN h.at_bat_index IS NOT NULL THEN raw_speed END AS launch_speed, false AS has_review FROM {DONE} p JOIN games g USING (game_pk) LEFT JOIN (SELECT DISTINCT game_pk, at_bat_index FROM pitches WHERE call_code IN ('X','D','E')) h USING (game_pk, at_bat_index)")
add_feed("pitch_context", lambda g: derive.pitches(g).select(F.col("game_pk").cast("long").alias("game_pk"), "at_bat_index", "pitch_index", F.col("pitcher_id").cast("long").alias("pitcher_id"), "pitch_hand", "balls_before", "strikes_before", "outs_before", "call_code", "start_speed", "zone", "pitch_number", "pitch_type_desc", "call_desc", "is_strike", "plate_x", "plate_z", "sz_top", "sz_bottom"), f"WITH d AS (SELECT *, coalesce(lag(outs_after) OVER (PARTITION BY game_pk, inning, half ORDER BY at_bat_index), 0) AS outs0, lag(pitcher_id) OVER (PARTITION BY game_pk, half ORDER BY at_bat_index) AS prev, lag(pitch_hand) OVER (PARTITION BY game_pk, half ORDER BY at_bat_index) AS prev_hand FROM {DONE}) SELECT p.game_pk, p.at_bat_index, p.pitch_index * 2 AS pitch_index, CASE WHEN p.at_bat_index % 6 = 5 AND p.pitch_index = 0 THEN coalesce(prev, d.pitcher_id) ELSE d.pitcher_id END AS pitcher_id, CASE WHEN p.at_bat_index % 6 = 5 AND p.pitch_index = 0 THEN coalesce(prev_hand, d.pitch_hand) ELSE d.pitch_hand END AS pitch_hand, CASE WHEN p.pitch_index = 0 OR (p.at_bat_index % 6 = 5 AND p.pitch_index = 1) THEN 0 ELSE (p.pitch_index - 1) % 4 END::INTEGER AS balls_before, CASE WHEN p.pitch_index = 0 OR (p.at_bat_index % 6 = 5 AND p.pitch_index = 1) THEN 0 ELSE (p.pitch_index - 1) % 3 END::INTEGER AS strikes_before, CASE WHEN p.pitch_index = 0 THEN outs0 ELSE p.at_bat_index % 3 END::INTEGER AS outs_before, call_code, start_speed, zone, pitch_number, pitch_type_desc, call_desc, is_strike, plate_x, plate_z, sz_top, sz_bottom FROM pitches p JOIN d ON d.game_pk = p.game_pk AND d.at_bat_index = p.at_bat_index")
add_feed("feed_events", lambda g: derive.play_events(g).select(F.col("game_pk").cast("long").alias("game_pk"), "at_bat_index", "event_index", "kind", "event_type"), f"SELECT game_pk, at_bat_index, 1 AS event_index, 'action' AS kind, 'pitching_substitution' AS event_type FROM {DONE} WHERE at_bat_index % 6 = 5")
add_feed("feed_linescores", lambda g: derive.linescores(g).select(F.col("game_pk").cast("long").alias("game_pk"), "inning", "half", "runs", "hits", "errors"), "SELECT * FROM linescores")
add_feed("feed_decisions", lambda g: derive.decisions(g).select(F.col("game_pk").cast("long").alias("game_pk"), "season", F.col("winner_id").cast("long").alias("winner_id"), F.col("loser_id").cast("long").alias("loser_id"), F.col("save_id").cast("long").alias("save_id")), "SELECT d.* FROM decisions d WHERE game_pk IN (SELECT game_pk FROM plays)")
add_feed("feed_teams", lambda g: derive.game_teams(g).select(F.col("game_pk").cast("long").alias("game_pk"), "season", "team_id", "source_date"), "SELECT game_pk, season, unnest([home_team_id, away_team_id]) AS team_id, official_date AS source_date FROM games WHERE game_pk IN (SELECT game_pk FROM plays)")
QUERIES["feed_headers"] = lambda spark, sf_dir: feeds.with_header(testfeeds.stored(spark, sf_dir)).select(F.col("game_pk").cast("long").alias("game_pk"), "season", "feed_ts", "is_final", "valid")
SQL["feed_headers"] = testbed.oracle("SELECT game_pk, season, strftime(official_date, '%Y%m%d') || '_120000' AS feed_ts, coded_state IN ('F','O','Q','R') AS is_final, true AS valid FROM games WHERE game_pk IN (SELECT game_pk FROM plays)")


add_feed("feed_batting", lambda g: derive.batting_lines(g).select(_pk(), _long("player_id"), "team_id", "side", *(_long(x) for x in _BAT)), f"SELECT b.game_pk, player_id, team_id, CASE WHEN team_id = home_team_id THEN 'home' ELSE 'away' END AS side, {', '.join(f'{x}::BIGINT AS {x}' for x in _BAT)} FROM batting b JOIN games g USING (game_pk)")
add_feed("feed_pitching", lambda g: derive.pitching_lines(g).select(_pk(), _long("player_id"), "team_id", *(_long(x) for x in _ARM), *_FLAGS), f"SELECT game_pk, player_id, team_id, {', '.join(_ARM + _FLAGS)} FROM pitching")
add_feed("feed_game_players", lambda g: derive.game_players(g).select(_pk(), _long("player_id"), "team_id", "jersey_number", "position", F.array_join("all_positions", ",").alias("positions"), "batting_order", "is_substitute", "played"), "SELECT game_pk, player_id, team_id, (player_id % 99)::VARCHAR AS jersey_number, '1B' AS position, '1B' AS positions, (batting_order * 100 + 100)::INTEGER AS batting_order, batting_order > 8 AS is_substitute, true AS played FROM batting UNION ALL SELECT game_pk, player_id, team_id, (player_id % 99)::VARCHAR, 'P', 'P', NULL, NOT is_starter, true FROM pitching")
add_feed("feed_bios", lambda g: derive.bios(g).select(_pk(), _long("player_id"), "season", "source_date", "game_number", "full_name", "boxscore_name", "last_name", "weight"), "SELECT game_pk, player_id, season, source_date, game_number, full_name, boxscore_name, last_name, weight FROM bios")
add_feed("feed_summary", lambda g: derive.summary(g, feeds.stored_keys(g.filter("is_final"))).select("plays", "pitches", F.array_join("seasons", ",").alias("seasons")), f"SELECT (SELECT count(*) FROM {DONE}) AS plays, (SELECT count(*) FROM pitches WHERE at_bat_index % 13 <> 12) AS pitches, (SELECT string_agg(season, ',' ORDER BY season) FROM (SELECT DISTINCT season FROM games WHERE coded_state IN ('F','O','Q','R') AND game_pk IN (SELECT game_pk FROM plays))) AS seasons")
add_feed("replace_games", lambda g: derive.replace_games({"linescores": derive.linescores(g).withColumn("runs", F.lit(99))}, {"linescores": derive.linescores(g.filter("game_pk % 3 = 0"))}, g.filter("game_pk % 3 = 0").select("game_pk"))["linescores"].select(_pk(), "inning", "half", "runs", "hits"), "SELECT game_pk, inning, half, CASE WHEN game_pk % 3 = 0 THEN runs ELSE 99 END AS runs, hits FROM linescores")
_earlier = lambda g: g.filter("game_pk % 3 <> 0").withColumn("g", F.col("g").withField("gameData.status.codedGameState", F.when(F.col("game_pk") % 4 == 0, "D").otherwise(F.col("g.gameData.status.codedGameState"))))
add_feed("live_state_changes", lambda g: live.state_changes(live.game_states(_earlier(g)), live.game_states(g)).select(_pk(), "status", "completed", F.size("innings").alias("innings")), "SELECT game_pk, CASE WHEN coded_state IN ('F','O','Q','R') THEN 'final' WHEN coded_state IN ('I','M','N') THEN 'live' WHEN coded_state IN ('S','P') THEN 'scheduled' WHEN coded_state = 'D' THEN 'postponed' WHEN coded_state = 'C' THEN 'cancelled' ELSE 'suspended' END AS status, coded_state IN ('F','O','Q','R') AS completed, (SELECT count(DISTINCT inning) FROM linescores l WHERE l.game_pk = g.game_pk)::INTEGER AS innings FROM games g WHERE game_pk IN (SELECT game_pk FROM plays) AND (game_pk % 3 = 0 OR (game_pk % 4 = 0 AND coded_state <> 'D'))")
_headers = lambda spark, sf_dir: feeds.with_header(testfeeds.stored(spark, sf_dir)).select("game_pk", "feed_ts", "is_final")


def current_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final copy of each game, or a live one that is newer."""
    h = _headers(spark, sf_dir)
    live_ = h.filter("game_pk % 2 = 0").withColumns({"feed_ts": F.concat("feed_ts", F.when(F.col("game_pk") % 4 == 0, "1").otherwise("")), "is_final": F.lit(False)})
    return feeds.current(h.filter("game_pk % 5 <> 0 AND is_final"), live_).select(_pk(), "feed_ts", "is_final")


QUERIES["current_documents"] = current_documents
SQL["current_documents"] = testbed.oracle("WITH h AS (SELECT game_pk, strftime(official_date, '%Y%m%d') || '_120000' AS feed_ts, coded_state IN ('F','O','Q','R') AS is_final FROM games WHERE game_pk IN (SELECT game_pk FROM plays)), f AS (SELECT * FROM h WHERE game_pk % 5 <> 0 AND is_final), l AS (SELECT game_pk, feed_ts || CASE WHEN game_pk % 4 = 0 THEN '1' ELSE '' END AS feed_ts, false AS is_final FROM h WHERE game_pk % 2 = 0) SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.game_pk = f.game_pk AND l.feed_ts >= f.feed_ts) UNION ALL SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.game_pk = l.game_pk AND f.feed_ts > l.feed_ts)")

# ---- schedules, players and written tables --------------------------------------------------------------------------
_day = lambda d: F.lit(d).cast("date")
add("schedule_window", lambda t: t.games.filter(schedule.window(_day("1997-01-01"), _day("1997-12-31"), _day("1997-12-28"))).select("game_pk"), "SELECT game_pk FROM games WHERE official_date BETWEEN DATE '1997-12-27' AND DATE '1997-12-31'")
add("live_keys", lambda t: schedule.live_keys(t.games, _day("1995-05-01")), "SELECT game_pk FROM games WHERE abstract_state = 'Live' AND coded_state NOT IN ('F','O','Q','R') AND official_date >= DATE '1995-04-30'")
add("rescheduled_keys", lambda t: schedule.rescheduled_keys(t.games), "SELECT game_pk FROM games WHERE coded_state IN ('D', 'T', 'U')")
add("completed_keys", lambda t: schedule.completed_keys(t.games), "SELECT game_pk FROM games WHERE coded_state IN ('F','O','Q','R')")
add("impacted_players", lambda t: schedule.impacted_players(t.game_players, t.games.filter("game_pk % 50 = 0")), "SELECT DISTINCT player_id FROM game_players WHERE played AND game_pk IN (SELECT game_pk FROM games WHERE game_pk % 50 = 0)")
add("refresh_players", lambda t: ingest.refresh_players(views.player_dimension(t.bios.filter("game_pk % 7 <> 0")), t.bios, t.bios.filter("game_pk % 7 = 0").select("game_pk").distinct()), "SELECT * FROM bios QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY source_date DESC, game_number DESC, game_pk DESC) = 1")
add("pending_plays", lambda t: live.pending_plays(t.plays.select("game_pk", "at_bat_index", "event", F.lit(1).alias("seq")).unionByName(t.plays.filter("q % 2 = 0").select("game_pk", "at_bat_index", F.lit("late").alias("event"), F.lit(2).alias("seq"))), F.lit(2), "seq"), "SELECT game_pk, at_bat_index, CASE WHEN q % 2 = 0 THEN 'late' ELSE event END AS event, CASE WHEN q % 2 = 0 THEN 2 ELSE 1 END AS seq FROM plays WHERE at_bat_index > 2")
add("player_ages", lambda t: t.players.select("player_id", M.age_on(F.col("birth_date"), _day("1997-07-01")).alias("age")), "SELECT player_id, date_sub('year', birth_date, DATE '1997-07-01')::INTEGER AS age FROM players")
add("range_starts", lambda t: t.games.select("game_pk", *(M.range_start(k, F.col("official_date")).alias(f"{k}_start") for k in ("today", "week", "month", "season"))), "SELECT game_pk, official_date AS today_start, official_date - 6 AS week_start, official_date - 29 AS month_start, date_trunc('year', official_date)::DATE AS season_start FROM games")


def _schedule_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedule documents, one for each day; every fifth game is listed again under an earlier day."""
    c, g = F.col, testbed.tables(spark, sf_dir).games
    side = lambda s: F.struct(F.struct(c(f"{s}_team_id").alias("id")).alias("team"), c(f"{s}_score").alias("score"), F.struct(c(f"{s}_probable_id").alias("id")).alias("probablePitcher")).alias(s)
    game = F.struct(
        c("game_pk").alias("gamePk"), c("game_type").alias("gameType"), c("season").cast("string").alias("season"), F.date_format("official_date", "yyyy-MM-dd").alias("officialDate"), c("game_number").alias("gameNumber"), c("double_header").alias("doubleHeader"),
        F.struct(c("abstract_state").alias("abstractGameState"), c("coded_state").alias("codedGameState"), c("detailed_state").alias("detailedState")).alias("status"), F.struct(side("home"), side("away")).alias("teams"),
    )
    listed = g.select(c("official_date").alias("day"), "game_pk", game.alias("g")).unionByName(g.filter("game_pk % 5 = 0").select(F.date_sub("official_date", 4).alias("day"), "game_pk", game.withField("gameType", F.lit("old")).alias("g")))
    days = listed.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("game_pk", "g"))).alias("gs")).select(F.struct(F.date_format("day", "yyyy-MM-dd").alias("date"), c("gs.g").alias("games")).alias("d"))
    return days.select(F.to_json(F.struct(F.array("d").alias("dates"))).alias("json"))


def schedule_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _schedule_documents(spark, sf_dir).select(F.from_json("json", schemas.SCHEDULE).alias("s")).select("s.dates")
    return schedule.parse(parsed).select(_pk(), "season", "official_date", "game_type", "game_number", "double_header", "coded_state", "home_team_id", "home_score", "away_team_id", "away_score", _long("home_probable_id"))


QUERIES["schedule_games"] = schedule_games
SQL["schedule_games"] = testbed.oracle("SELECT game_pk, season, official_date, game_type, game_number, double_header, coded_state, home_team_id, home_score, away_team_id, away_score, home_probable_id FROM games")


#: Days in a partition of the written per-game tables and day rollups: these queries' tables are small.
SPAN = 400


def _store(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"


def refreshed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day rollups, built without some games and refreshed on these games' days; they must equal a rebuild."""
    t, store = testbed.tables(spark, sf_dir), ingest.RollupStore(spark, _store(spark), SPAN)
    some = ingest.within(t, t.games.filter("game_pk % 400 <> 1"), ["game_pk"])
    store.rebuild(some, ["batted_ball_days"])
    store.refresh_days(t, t.games.filter("game_pk % 400 = 1"), ["batted_ball_days"])
    return store.read("batted_ball_days")


def rebuilt_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A season table written from wrong facts and rebuilt over all seasons."""
    t, store = testbed.tables(spark, sf_dir), ingest.RollupStore(spark, _store(spark))
    store.refresh_seasons(ingest.within(t, t.games.filter("game_pk % 2 = 0"), ["game_pk"]), t.games.select("season"), ["team_season_pitching"])
    store.rebuild(t, ["team_season_pitching"])
    return store.read("team_season_pitching")


def written_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two upserts into a table by season; only seasons that changed are written."""
    t, tables = testbed.tables(spark, sf_dir), Snapshots(spark, _store(spark), {"games": ["season"]})
    for rows in (_base(t), _later(t)):
        schedule.write_games(tables, rows)
    return tables.read("games")


QUERIES["refreshed_days"] = lambda spark, sf_dir: rounded(refreshed_days(spark, sf_dir))
SQL["refreshed_days"] = SQL["batted_ball_days"]
QUERIES["rebuilt_seasons"] = lambda spark, sf_dir: rounded(rebuilt_seasons(spark, sf_dir))
SQL["rebuilt_seasons"] = SQL["team_season_pitching"]
QUERIES["written_games"] = written_games
SQL["written_games"] = SQL["upsert_games"]


# ---- streams -----------------------------------------------------------------------------------------------------
def _source(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _source(spark, f"{sf_dir}/events*.parquet", _events(spark, sf_dir).schema)


def _run(stream: DataFrame, folder: str) -> DataFrame:
    """All available input through a stream into Parquet below ``folder``."""
    out = f"{folder}/out"
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def stream_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even versions arrive first, then odd ones and the even ones again: of these only what is above the last seen counts."""
    folder, events = _store(spark), _events(spark, sf_dir)
    even = events.filter("event_id % 2 = 0")
    for rows in (even, events):
        rows.write.mode("append").parquet(f"{folder}/in")
        out = _run(live.watch_versions(_source(spark, f"{folder}/in", events.schema), "user_id", "event_id", version_type="long"), folder)
    return out


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stream(spark, sf_dir)
    return _run(live.dedupe_ids(s.unionByName(s.filter("event_id % 10 = 0")), "event_id", "ts").select("event_id", "user_id"), _store(spark))


def stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = lambda c: F.unix_millis(c).alias(f"{c}_ms")
    return _run(live.debounce(_stream(spark, sf_dir), "user_id", "ts", "2 hours").select("user_id", ms("first"), ms("due"), "events"), _store(spark))


def stream_bursts_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(live.debounce_capped(_stream(spark, sf_dir), "user_id", "ts", 7200, 21600), _store(spark))


QUERIES["stream_version_watch"] = stream_versions
SQL["stream_version_watch"] = "WITH e AS (SELECT DISTINCT user_id, event_id FROM events WHERE user_id IS NOT NULL), m AS (SELECT user_id, max(event_id) AS last FROM e WHERE event_id % 2 = 0 GROUP BY user_id) SELECT e.* FROM e LEFT JOIN m USING (user_id) WHERE event_id % 2 = 0 OR last IS NULL OR event_id > last"
QUERIES["stream_dedupe"] = stream_dedupe
SQL["stream_dedupe"] = "SELECT event_id, user_id FROM events"
# what is given out is due before the last watermark: ten seconds before the last event
_MS = "SELECT user_id, epoch_us(ts::TIMESTAMP) // 1000 AS t FROM events"
QUERIES["stream_bursts"] = stream_bursts
SQL["stream_bursts"] = f"SELECT user_id, min(t) AS first_ms, max(t) + 7200000 AS due_ms, count(*) AS events FROM (SELECT *, sum(CASE WHEN before IS NULL OR t - before >= 7200000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS n FROM (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS before FROM ({_MS}))) GROUP BY user_id, n HAVING max(t) + 7200000 <= (SELECT max(t) - 10000 FROM ({_MS}))"
QUERIES["stream_bursts_capped"] = stream_bursts_capped
SQL["stream_bursts_capped"] = f"WITH RECURSIVE e AS ({_MS}), n AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k FROM e), w AS (SELECT user_id, k, t AS first, t AS last, 1 AS events, NULL::BIGINT AS out_first, NULL::BIGINT AS out_due, NULL::BIGINT AS out_n FROM n WHERE k = 1 UNION ALL SELECT n.user_id, n.k, CASE WHEN n.t >= least(last + 7200000, first + 21600000) THEN n.t ELSE first END, n.t, CASE WHEN n.t >= least(last + 7200000, first + 21600000) THEN 1 ELSE events + 1 END, CASE WHEN n.t >= least(last + 7200000, first + 21600000) THEN first END, CASE WHEN n.t >= least(last + 7200000, first + 21600000) THEN least(last + 7200000, first + 21600000) END, CASE WHEN n.t >= least(last + 7200000, first + 21600000) THEN events END FROM w JOIN n ON n.user_id = w.user_id AND n.k = w.k + 1) SELECT user_id, out_first AS first_ms, out_due AS due_ms, out_n AS events FROM w WHERE out_first IS NOT NULL UNION ALL SELECT user_id, first, least(last + 7200000, first + 21600000), events FROM w WHERE (user_id, k) IN (SELECT (user_id, max(k)) FROM n GROUP BY user_id) AND least(last + 7200000, first + 21600000) < (SELECT max(t) - 10000 FROM e)"
