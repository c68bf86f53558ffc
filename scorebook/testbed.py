"""Games, plays and pitches projected from a star schema of orders and line items.

An order is a game, its line items are plays, and each play has a few pitches.  All values come from the given tables by
integer arithmetic, so the work of every query grows with them.  ``SQL`` has the same projections as text, for
checks by another engine.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import measures as M
from .operators.core import asof_left_join, merged
from .sources.sinks import bucketed, made_once
from .tables import Tables

#: What the twelve remainders of a line's quantity stand for.
EVENTS = ["single", "double", "triple", "home_run", "field_out", "strikeout", "walk", "hit_by_pitch", "sac_fly", "force_out", "grounded_into_double_play", "field_error"]
PITCHER_BASE = 1_000_000
PLAYS_PER_TASK = 250_000
#: From so many plays on, facts are kept in buckets of games.
BUCKETS_FROM = 1_000_000
PLAY_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]

_EVENT_LIST = ", ".join(f"'{e}'" for e in EVENTS)
SQL = {
    "event_types": "SELECT event_type, true AS is_plate_appearance, event_type NOT IN ({no_ab}) AS is_at_bat, event_type NOT IN ({no_bip}) AS is_ball_in_play, event_type IN ('walk','intent_walk') AS is_walk, event_type IN ('strikeout','strike_out','strikeout_double_play','strikeout_triple_play') AS is_strikeout, CASE event_type WHEN 'single' THEN 1 WHEN 'double' THEN 2 WHEN 'triple' THEN 3 WHEN 'home_run' THEN 4 ELSE 0 END AS bases FROM (SELECT unnest([{pa}]) AS event_type)".format(
        no_ab=", ".join(f"'{e}'" for e in M.NO_AT_BAT), no_bip=", ".join(f"'{e}'" for e in M.NO_BALL_IN_PLAY), pa=", ".join(f"'{e}'" for e in M.PLATE_APPEARANCE_EVENTS)
    ),
    "teams": "SELECT n_nationkey AS team_id, s.season AS season, n_name || CASE WHEN s.season = 1998 THEN ' II' ELSE '' END AS name, 'T' || n_name AS team_name, 'N' || n_nationkey || CASE WHEN s.season = 1998 THEN 'X' ELSE '' END AS abbreviation, n_regionkey % 2 AS league_id, 'League ' || (n_regionkey % 2) AS league_name, n_regionkey AS division_id, r_name AS division_name FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT unnest([1995, 1998]) AS season) s WHERE s.season = 1995 OR n_nationkey % 2 = 0",
    "games": "SELECT o_orderkey AS game_pk, year(o_orderdate)::INTEGER AS season, o_orderdate::DATE AS official_date, epoch_ms(o_orderdate::DATE::TIMESTAMP) + (o_orderkey % 12) * 3600000 AS start_ms, CASE o_orderkey % 20 WHEN 0 THEN 'F' WHEN 1 THEN 'S' ELSE 'R' END AS game_type, 1 AS game_number, CASE WHEN o_orderstatus = 'P' THEN substr('IISPDCUTMN', (o_orderkey % 10 + 1)::INTEGER, 1) WHEN o_orderkey % 50 = 7 THEN 'O' WHEN o_orderkey % 50 = 21 THEN 'Q' WHEN o_orderkey % 50 = 33 THEN 'R' ELSE 'F' END AS coded_state, CASE WHEN o_orderstatus <> 'P' THEN 'Final' WHEN o_orderkey % 10 IN (2, 3) OR o_orderkey % 20 = 7 THEN 'Preview' WHEN o_orderkey % 10 IN (4, 5) THEN 'Final' ELSE 'Live' END AS abstract_state, CASE WHEN o_orderkey % 9 = 0 THEN 'Delayed: Rain' WHEN o_orderkey % 9 = 1 THEN 'Warmup' ELSE 'Running' END AS detailed_state, (o_orderkey % 7 + 1)::INTEGER AS series_game_number, (5 + 2 * (o_orderkey % 2))::INTEGER AS games_in_series, c_nationkey AS home_team_id, ((c_nationkey + 1 + o_orderkey % 24) % 25)::INTEGER AS away_team_id, ((o_orderkey * 7) % 11)::INTEGER AS home_score, ((o_orderkey * 13 + 1) % 11)::INTEGER AS away_score, (9 + CASE WHEN o_orderkey % 7 = 0 THEN 1 + o_orderkey % 3 ELSE 0 END)::INTEGER AS inning, (1000000 + o_orderkey * 3 % 100) AS home_probable_id, (1000000 + (o_orderkey * 5 + 1) % 100) AS away_probable_id, (o_orderkey % 90) || '-' || (o_orderkey % 70) AS home_record, (o_orderkey % 80) || '-' || (o_orderkey % 60) AS away_record, CASE WHEN o_orderkey % 11 = 0 THEN 'Y' ELSE 'N' END AS double_header, CASE WHEN o_orderkey % 13 = 0 THEN o_orderdate::DATE - 3 END AS rescheduled_from FROM orders JOIN customer ON o_custkey = c_custkey",
    "plays0": "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY " + ", ".join(PLAY_ORDER) + ") - 1 AS ab, CAST(l_quantity AS INTEGER) AS q FROM lineitem",
    "plays": f"SELECT l_orderkey AS game_pk, p.ab::INTEGER AS at_bat_index, (p.ab % 10 + 1)::INTEGER AS inning, CASE p.ab % 2 WHEN 0 THEN 'top' ELSE 'bottom' END AS half, l_partkey AS batter_id, 1000000 + l_suppkey AS pitcher_id, CASE l_partkey % 2 WHEN 0 THEN 'L' ELSE 'R' END AS bat_side, CASE l_suppkey % 3 WHEN 0 THEN 'L' ELSE 'R' END AS pitch_hand, ['Empty', 'RISP', 'Loaded', 'Men_On'][p.ab % 4 + 1] AS men_on_base, [{_EVENT_LIST}][q % 12 + 1] AS event_type, 'E' || (q % 12) AS event, 'Play ' || q AS description, CASE WHEN l_linenumber <> 3 THEN 60 + l_quantity END AS raw_speed, CASE WHEN l_linenumber <> 3 THEN (l_partkey % 70 - 10)::DOUBLE END AS raw_angle, 200 + 5 * l_quantity AS total_distance, CASE WHEN l_linenumber <> 3 THEN (l_partkey % 250)::DOUBLE END AS raw_x, CASE WHEN l_linenumber % 4 <> 1 THEN (l_suppkey % 200)::DOUBLE END AS raw_y, least((l_orderkey * 7) % 11, p.ab)::INTEGER AS home_score_after, least((l_orderkey * 13 + 1) % 11, p.ab + 1)::INTEGER AS away_score_after, (p.ab % 3 + 1)::INTEGER AS outs_after, q % 12 IN (4, 5, 8, 9, 10) AS is_out, p.ab % 5 = 0 AS is_scoring_play, q, l_partkey, l_suppkey FROM plays0 p",
    "pitches": "SELECT game_pk, at_bat_index, i::INTEGER AS pitch_index, inning, half, batter_id, pitcher_id, bat_side, pitch_hand, (i % 4)::INTEGER AS balls_before, (i % 3)::INTEGER AS strikes_before, substr('BCSFXWDTML', ((at_bat_index * 7 + i * 3 + q) % 10 + 1)::INTEGER, 1) AS call_code, 'Call ' || call_code AS call_desc, call_code <> 'B' AS is_strike, (i + 1)::INTEGER AS pitch_number, ((l_partkey + i) % 9 - 4)::DOUBLE AS plate_x, ((l_suppkey + i) % 5)::DOUBLE AS plate_z, (3 + l_partkey % 2)::DOUBLE AS sz_top, 1.5::DOUBLE AS sz_bottom, ((q + i * 5) % 14 + 1)::INTEGER AS zone, substr('FFSISLCUCH', (2 * ((l_suppkey + i) % 5) + 1)::INTEGER, 2) AS pitch_type, 'Type ' || pitch_type AS pitch_type_desc, 70 + (l_partkey * 3 + i * 7) % 35 + 0.5::DOUBLE AS start_speed, (2000 + (l_partkey * 11 + i * 13) % 700)::DOUBLE AS spin_rate, ((l_partkey + i) % 20)::DOUBLE AS induced_vertical_break, ((l_suppkey + i * 3) % 15)::DOUBLE AS horizontal_break, raw_speed AS launch_speed, (l_partkey + i) % 23 = 0 AS abs_challenged, (l_partkey + i) % 46 = 0 AS abs_overturned, (l_suppkey + i) % 2 AS abs_by_home FROM plays, (SELECT unnest(range(0, 4)) AS i) r WHERE i <= q % 4",
    "tracked": "SELECT * FROM games WHERE game_type IN ('R', 'F', 'D', 'L', 'W')",
    "regular": "SELECT * FROM games WHERE game_type = 'R' AND coded_state IN ('F', 'O', 'Q', 'R')",
    "team_plays": "SELECT p.*, g.season, g.official_date, g.game_type, g.coded_state, g.start_ms, CASE half WHEN 'top' THEN away_team_id ELSE home_team_id END AS batting_team_id, CASE half WHEN 'top' THEN home_team_id ELSE away_team_id END AS fielding_team_id FROM plays p JOIN games g USING (game_pk)",
    "team_pitches": "SELECT p.*, p.call_code IN ('X', 'D', 'E') AS is_in_play, CASE WHEN abs_challenged THEN CASE WHEN abs_by_home = 1 THEN home_team_id ELSE away_team_id END END AS abs_challenge_team_id, g.season, g.official_date, g.game_type, g.coded_state, CASE half WHEN 'top' THEN away_team_id ELSE home_team_id END AS batting_team_id, CASE half WHEN 'top' THEN home_team_id ELSE away_team_id END AS fielding_team_id FROM pitches p JOIN games g USING (game_pk)",
    "plate_appearances": "SELECT t.*, e.is_at_bat, e.is_ball_in_play, e.is_walk, e.is_strikeout, e.bases, CASE WHEN e.is_ball_in_play THEN raw_speed END AS launch_speed, CASE WHEN e.is_ball_in_play THEN raw_angle END AS launch_angle, CASE WHEN e.is_ball_in_play THEN raw_x END AS hit_coord_x, CASE WHEN e.is_ball_in_play THEN raw_y END AS hit_coord_y FROM team_plays t JOIN event_types e USING (event_type) WHERE e.is_plate_appearance",
    "pitch_outcomes": "SELECT *, call_code IN ('S','W','M','T','F','L','X','D','E') AS is_swing, call_code IN ('S','W','M') AS is_whiff, call_code = 'C' AS is_called_strike, zone BETWEEN 1 AND 9 AS is_in_zone, pitch_type IN ('FF', 'SI') AS is_fastball FROM team_pitches",
    "batting": "SELECT game_pk, season, batter_id AS player_id, batting_team_id AS team_id, count(*) AS plate_appearances, count(*) FILTER (is_at_bat) AS at_bats, count(*) FILTER (bases > 0) AS hits, count(*) FILTER (bases = 2) AS doubles, count(*) FILTER (bases = 3) AS triples, count(*) FILTER (bases = 4) AS home_runs, sum(bases)::BIGINT AS total_bases, count(*) FILTER (is_walk) AS walks, count(*) FILTER (event_type = 'hit_by_pitch') AS hit_by_pitch, count(*) FILTER (event_type LIKE 'sac_fly%') AS sac_flies, count(*) FILTER (is_strikeout) AS strikeouts, min(at_bat_index) AS batting_order, count(*) FILTER (bases = 4) AS runs, sum(CASE WHEN bases = 4 THEN 1 + at_bat_index % 3 ELSE 0 END)::BIGINT AS rbi, count(*) FILTER (is_walk AND at_bat_index % 2 = 0) AS intentional_walks, count(*) FILTER (event_type = 'force_out' AND at_bat_index % 3 = 0) AS sac_bunts, count(*) FILTER (at_bat_index % 6 = 3) AS stolen_bases, count(*) FILTER (at_bat_index % 7 = 2) AS caught_stealing, count(*) FILTER (event_type = 'grounded_into_double_play') AS ground_into_double_plays, count(*) FILTER (is_out) AS left_on_base FROM plate_appearances GROUP BY ALL",
    "starters": "SELECT game_pk, CASE half WHEN 'top' THEN 'home' ELSE 'away' END AS side, arg_min(pitcher_id, at_bat_index) AS pitcher_id FROM plays GROUP BY ALL",
    "pitching0": "SELECT a.game_pk, a.season, a.pitcher_id AS player_id, a.fielding_team_id AS team_id, s.pitcher_id IS NOT NULL AS is_starter, count(*) AS batters_faced, count(*) FILTER (is_out) AS outs, count(*) FILTER (bases > 0) AS hits, count(*) FILTER (bases = 4) AS runs, count(*) FILTER (bases = 4 AND at_bat_index % 4 <> 0) AS earned_runs, count(*) FILTER (bases = 4) AS home_runs, count(*) FILTER (is_walk) AS walks, count(*) FILTER (is_strikeout) AS strikeouts, min(at_bat_index) AS first_at_bat, sum(q % 4 + 1)::BIGINT AS pitches FROM plate_appearances a LEFT JOIN starters s ON s.game_pk = a.game_pk AND s.pitcher_id = a.pitcher_id AND s.side = CASE a.half WHEN 'top' THEN 'home' ELSE 'away' END GROUP BY ALL",
    "pitching": "SELECT p.*, is_starter AND CASE WHEN team_id = home_team_id THEN home_score > away_score ELSE away_score > home_score END AS is_win, is_starter AND CASE WHEN team_id = home_team_id THEN home_score < away_score ELSE away_score < home_score END AS is_loss, NOT is_starter AND player_id % 3 = 0 AS is_save, NOT is_starter AND player_id % 3 = 1 AS is_hold, NOT is_starter AND player_id % 3 = 2 AS is_blown_save FROM pitching0 p JOIN games g USING (game_pk)",
    "decisions": "SELECT game_pk, g.season, w.pitcher_id AS winner_id, l.pitcher_id AS loser_id, CASE WHEN g.game_pk % 3 = 0 THEN 1000000 + g.game_pk % 90 END AS save_id FROM games g JOIN starters w USING (game_pk) JOIN starters l USING (game_pk) WHERE coded_state = 'F' AND home_score <> away_score AND w.side = CASE WHEN home_score > away_score THEN 'home' ELSE 'away' END AND l.side <> w.side",
    "linescores": "SELECT game_pk, inning, half, count(*) FILTER (event_type = 'home_run')::INTEGER AS runs, count(*) FILTER (event_type IN ('single', 'double', 'triple', 'home_run'))::INTEGER AS hits, count(*) FILTER (event_type = 'field_error')::INTEGER AS errors FROM plays GROUP BY ALL",
    "bios": "SELECT player_id, game_pk, season, source_date, 1 AS game_number, max(w) AS weight, 'Full ' || player_id AS full_name, CASE WHEN player_id % 5 <> 0 THEN 'Box ' || player_id END AS boxscore_name, CASE WHEN player_id % 7 <> 0 THEN 'Last ' || player_id END AS last_name FROM (SELECT unnest([l_partkey, 1000000 + l_suppkey]) AS player_id, l_orderkey AS game_pk, year(o_orderdate)::INTEGER AS season, o_orderdate::DATE AS source_date, CAST(l_quantity AS INTEGER) + 60 AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey) b WHERE player_id % 17 <> 0 GROUP BY player_id, game_pk, season, source_date",
    "game_players": "SELECT game_pk, season, player_id, team_id, (player_id % 99)::VARCHAR AS jersey_number, ['C', '1B', 'SS', 'CF'][(player_id % 4 + 1)::INTEGER] AS position, true AS played, (batting_order * 100 + 100)::INTEGER AS batting_order, batting_order > 8 AS is_substitute FROM batting UNION ALL SELECT game_pk, season, player_id, team_id, (player_id % 99)::VARCHAR, 'P', player_id % 10 <> 0, NULL, NOT is_starter FROM pitching",
    "play_events": "SELECT game_pk, at_bat_index, 9 AS event_index, CASE WHEN at_bat_index % 6 = 1 THEN 'no_pitch' ELSE 'action' END AS kind, CASE at_bat_index % 6 WHEN 5 THEN 'pitching_substitution' WHEN 3 THEN 'stolen_base_2b' END AS event_type, event AS description FROM plays WHERE at_bat_index % 2 = 1",
    "players": "SELECT p_partkey AS player_id, p_name || ' ' || p_partkey AS full_name, CASE p_partkey % 2 WHEN 0 THEN 'L' ELSE 'R' END AS hand, hand AS bat_side, 'R' AS pitch_hand, DATE '1970-01-01' + (p_partkey % 9000)::INTEGER AS birth_date, '6 ' || p_partkey % 12 AS height, (150 + p_partkey % 100)::INTEGER AS weight, DATE '1994-04-01' + (p_partkey % 1500)::INTEGER AS mlb_debut_date, p_partkey % 3 = 0 AS active FROM part WHERE p_partkey % 17 <> 0 UNION ALL SELECT 1000000 + s_suppkey, s_name, CASE s_suppkey % 3 WHEN 0 THEN 'L' ELSE 'R' END AS h, 'R', h, DATE '1970-01-01' + (s_suppkey % 9000)::INTEGER, '6 ' || s_suppkey % 12, (150 + s_suppkey % 100)::INTEGER, DATE '1994-04-01' + (s_suppkey % 1500)::INTEGER, s_suppkey % 3 = 0 FROM supplier WHERE s_suppkey % 17 <> 0",
    "game_teams": "SELECT game_pk, g.season, t.team_id, arg_max(t.abbreviation, t.season) AS abbreviation, arg_max(t.name, t.season) AS name, official_date AS source_date FROM (SELECT game_pk, season, official_date, unnest([home_team_id, away_team_id]) AS team_id FROM games) g JOIN teams t ON t.team_id = g.team_id AND t.season <= g.season GROUP BY game_pk, g.season, t.team_id, official_date",
}


def oracle(query: str) -> str:
    """A query over the projections, as one statement."""
    tail = ",\n" + query.removeprefix("WITH ") if query.startswith("WITH ") else "\n" + query
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in SQL.items()) + tail


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_types(spark: SparkSession) -> DataFrame:
    """The static dimension of events, about 75 rows, as a local relation."""
    pa = set(M.PLATE_APPEARANCE_EVENTS)
    rows = [(e, e in pa, e in pa and e not in M.NO_AT_BAT, e in pa and e not in M.NO_BALL_IN_PLAY, e in M.WALKS, e in M.STRIKEOUTS, M.BASES.get(e, 0)) for e in [*M.PLATE_APPEARANCE_EVENTS, *M.OTHER_EVENTS]]
    values = ", ".join(str(r).replace("True", "true").replace("False", "false") for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(event_type, is_plate_appearance, is_at_bat, is_ball_in_play, is_walk, is_strikeout, bases)")


def _pick(values: list[str], at) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def parts_of_games(spark: SparkSession, sf_dir: str):
    """How rows of a game come together: ``part_of(df, key)`` shuffles them, ``by_game(fact)`` too unless facts lie in buckets of games
    already, as they do if ``buckets()`` is not 0.

    Lines of players are as many as plays: parts of a number of plays keep a task's groups small at any size, and what follows needs no
    other shuffle.
    """
    count = cache(lambda: _read(spark, sf_dir, "lineitem").count())
    parts = cache(lambda: max(int(spark.conf.get("spark.sql.shuffle.partitions")), count() // PLAYS_PER_TASK))
    buckets = lambda: parts() if count() >= BUCKETS_FROM else 0
    part_of = lambda df, key="game_pk": df.repartition(parts(), key)
    return part_of, lambda df: df if buckets() else part_of(df), buckets


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    from .plans import views

    c = F.col
    read = cache(lambda name: _read(spark, sf_dir, name))

    part_of, by_game, buckets = parts_of_games(spark, sf_dir)

    def parted(df: DataFrame, key: str) -> DataFrame:
        return part_of(df, key) if buckets() else df

    def once(make):  # facts are tables that queries read: they are projected once for a session, not by every query
        write = lambda df, folder: bucketed(df, folder, "game_pk", buckets())
        return cache(lambda: made_once(spark, (make.__name__, sf_dir), make, *([write] if buckets() else [])))

    k, later, waits = c("o_orderkey"), c("season") == 1998, c("o_orderstatus") == "P"
    day = F.to_date("o_orderdate")
    ab, q, line = c("ab"), c("q"), c("l_orderkey")
    hit = lambda n: F.count_if(c("bases") == n)

    @cache
    def teams_() -> DataFrame:
        return (
            read("nation").join(read("region"), c("n_regionkey") == c("r_regionkey")).withColumn("season", F.explode(F.array(F.lit(1995), F.lit(1998))))
            .filter((c("season") == 1995) | (c("n_nationkey") % 2 == 0))
            .select(
                c("n_nationkey").alias("team_id"), "season", F.concat("n_name", F.when(later, " II").otherwise("")).alias("name"), F.concat(F.lit("T"), "n_name").alias("team_name"),
                F.concat(F.lit("N"), c("n_nationkey").cast("string"), F.when(later, "X").otherwise("")).alias("abbreviation"), (c("n_regionkey") % 2).alias("league_id"),
                F.concat(F.lit("League "), (c("n_regionkey") % 2).cast("string")).alias("league_name"), c("n_regionkey").alias("division_id"), c("r_name").alias("division_name"),
            )
        )

    @once
    def games_() -> DataFrame:
        homes = read("orders").join(merged(read("customer").select("c_custkey", "c_nationkey")), c("o_custkey") == c("c_custkey"))
        return parted(homes.select("o_orderkey", "o_orderdate", "o_orderstatus", "c_nationkey"), "o_orderkey").select(
            k.alias("game_pk"), F.year(day).alias("season"), day.alias("official_date"), (F.unix_date(day) * F.lit(86400000).cast("long") + k % 12 * 3600000).alias("start_ms"),
            F.when(k % 20 == 0, "F").when(k % 20 == 1, "S").otherwise("R").alias("game_type"), F.lit(1).alias("game_number"),
            F.when(~waits, F.when(k % 50 == 7, "O").when(k % 50 == 21, "Q").when(k % 50 == 33, "R").otherwise("F")).otherwise(F.substr(F.lit("IISPDCUTMN"), (k % 10 + 1).cast("int"), F.lit(1))).alias("coded_state"),
            F.when(~waits, "Final").when((k % 10).isin(2, 3) | (k % 20 == 7), "Preview").when((k % 10).isin(4, 5), "Final").otherwise("Live").alias("abstract_state"),
            F.when(k % 9 == 0, "Delayed: Rain").when(k % 9 == 1, "Warmup").otherwise("Running").alias("detailed_state"), (k % 7 + 1).cast("int").alias("series_game_number"), (5 + 2 * (k % 2)).cast("int").alias("games_in_series"),
            c("c_nationkey").alias("home_team_id"), ((c("c_nationkey") + 1 + k % 24) % 25).cast("int").alias("away_team_id"),
            (k * 7 % 11).cast("int").alias("home_score"), ((k * 13 + 1) % 11).cast("int").alias("away_score"),
            (F.lit(9) + F.when(k % 7 == 0, 1 + k % 3).otherwise(0)).cast("int").alias("inning"),
            (PITCHER_BASE + k * 3 % 100).alias("home_probable_id"), (PITCHER_BASE + (k * 5 + 1) % 100).alias("away_probable_id"),
            F.concat((k % 90).cast("string"), F.lit("-"), (k % 70).cast("string")).alias("home_record"), F.concat((k % 80).cast("string"), F.lit("-"), (k % 60).cast("string")).alias("away_record"),
            F.when(k % 11 == 0, "Y").otherwise("N").alias("double_header"), F.when(k % 13 == 0, F.date_sub(day, 3)).alias("rescheduled_from"),
        )

    @once
    def plays_() -> DataFrame:
        return (
            parted(read("lineitem").select("l_orderkey", *PLAY_ORDER), "l_orderkey")
            .withColumn("ab", (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*PLAY_ORDER)) - 1).cast("int")).withColumn("q", c("l_quantity").cast("int"))
            .select(
                line.alias("game_pk"), ab.alias("at_bat_index"), (ab % 10 + 1).alias("inning"), F.when(ab % 2 == 0, "top").otherwise("bottom").alias("half"),
                c("l_partkey").alias("batter_id"), (PITCHER_BASE + c("l_suppkey")).alias("pitcher_id"), F.when(c("l_partkey") % 2 == 0, "L").otherwise("R").alias("bat_side"), F.when(c("l_suppkey") % 3 == 0, "L").otherwise("R").alias("pitch_hand"),
                _pick(["Empty", "RISP", "Loaded", "Men_On"], ab % 4).alias("men_on_base"), _pick(EVENTS, q % 12).alias("event_type"), F.concat(F.lit("E"), (q % 12).cast("string")).alias("event"), F.concat(F.lit("Play "), q.cast("string")).alias("description"),
                F.when(c("l_linenumber") != 3, 60 + c("l_quantity")).alias("launch_speed"), F.when(c("l_linenumber") != 3, (c("l_partkey") % 70 - 10).cast("double")).alias("launch_angle"), (200 + 5 * c("l_quantity")).alias("total_distance"),
                F.when(c("l_linenumber") != 3, (c("l_partkey") % 250).cast("double")).alias("hit_coord_x"), F.when(c("l_linenumber") % 4 != 1, (c("l_suppkey") % 200).cast("double")).alias("hit_coord_y"),
                F.least(line * 7 % 11, ab.cast("long")).cast("int").alias("home_score_after"), F.least((line * 13 + 1) % 11, ab.cast("long") + 1).cast("int").alias("away_score_after"),
                (ab % 3 + 1).alias("outs_after"), (q % 12).isin(4, 5, 8, 9, 10).alias("is_out"), (ab % 5 == 0).alias("is_scoring_play"), q.alias("q"), "l_partkey", "l_suppkey",
            )
        )

    @once
    def pitches_() -> DataFrame:
        i, part_key, supp = c("i"), c("l_partkey"), c("l_suppkey")
        call = F.substr(F.lit("BCSFXWDTML"), ((c("at_bat_index") * 7 + i * 3 + q) % 10 + 1).cast("int"), F.lit(1))
        kind = F.substr(F.lit("FFSISLCUCH"), (2 * ((supp + i) % 5) + 1).cast("int"), F.lit(2))
        by = F.when(c("abs_challenged"), F.when(c("abs_by_home") == 1, c("home_team_id")).otherwise(c("away_team_id")))
        teams_of = games_().select("game_pk", "home_team_id", "away_team_id")  # joined with plays, which are fewer than pitches
        pitches = plays_().join(merged(teams_of), "game_pk").withColumn("i", F.explode(F.sequence(F.lit(0), q % 4))).select(
            "home_team_id", "away_team_id", "game_pk", "at_bat_index", i.alias("pitch_index"), "inning", "half", "batter_id", "pitcher_id", "bat_side", "pitch_hand", (i % 4).alias("balls_before"), (i % 3).alias("strikes_before"),
            call.alias("call_code"), F.concat(F.lit("Call "), call).alias("call_desc"), (call != "B").alias("is_strike"), (i + 1).alias("pitch_number"), ((part_key + i) % 9 - 4).cast("double").alias("plate_x"), ((supp + i) % 5).cast("double").alias("plate_z"), (3 + part_key % 2).cast("double").alias("sz_top"), F.lit(1.5).alias("sz_bottom"), ((q + i * 5) % 14 + 1).alias("zone"), kind.alias("pitch_type"), F.concat(F.lit("Type "), kind).alias("pitch_type_desc"),
            (70 + (part_key * 3 + i * 7) % 35 + 0.5).cast("double").alias("start_speed"), (2000 + (part_key * 11 + i * 13) % 700).cast("double").alias("spin_rate"),
            ((part_key + i) % 20).cast("double").alias("induced_vertical_break"), ((supp + i * 3) % 15).cast("double").alias("horizontal_break"), "launch_speed",
            ((part_key + i) % 23 == 0).alias("abs_challenged"), ((part_key + i) % 46 == 0).alias("abs_overturned"), ((supp + i) % 2).alias("abs_by_home"), call.isin("X", "D", "E").alias("is_in_play"),
        )
        return pitches.withColumn("abs_challenge_team_id", by).drop("home_team_id", "away_team_id", "abs_by_home")

    kinds = cache(lambda: event_types(spark))
    own_plays = cache(lambda: plays_().drop("l_partkey", "l_suppkey"))
    first_pitcher = F.min_by("pitcher_id", "at_bat_index").over(Window.partitionBy("game_pk", "half"))
    appearances = cache(lambda: views.plate_appearances(by_game(own_plays()), by_game(games_()), kinds()))
    faced = cache(lambda: views.plate_appearances(by_game(own_plays()).withColumn("_first", first_pitcher), by_game(games_()), kinds()))
    starters = cache(lambda: views.game_starters(own_plays()))

    @once
    def batting_() -> DataFrame:
        nth = lambda n: c("at_bat_index") % n
        return appearances().groupBy("game_pk", "season", c("batter_id").alias("player_id"), c("batting_team_id").alias("team_id")).agg(
            *M.batting_counts()[:9], hit(2).alias("doubles"), hit(3).alias("triples"), F.min("at_bat_index").alias("batting_order"), hit(4).alias("runs"), F.sum(F.when(c("bases") == 4, 1 + nth(3)).otherwise(0)).alias("rbi"),
            F.count_if(c("is_walk") & (nth(2) == 0)).alias("intentional_walks"), F.count_if((c("event_type") == "force_out") & (nth(3) == 0)).alias("sac_bunts"), F.count_if(nth(6) == 3).alias("stolen_bases"), F.count_if(nth(7) == 2).alias("caught_stealing"),
            F.count_if(c("event_type") == "grounded_into_double_play").alias("ground_into_double_plays"), F.count_if("is_out").alias("left_on_base"),
        )

    @once
    def pitching_() -> DataFrame:
        lines = (
            faced().groupBy("game_pk", "season", c("pitcher_id").alias("player_id"), c("fielding_team_id").alias("team_id"), F.coalesce(c("pitcher_id") == c("_first"), F.lit(False)).alias("is_starter"))
            .agg(
                F.count("*").alias("batters_faced"), F.count_if("is_out").alias("outs"), F.count_if(c("bases") > 0).alias("hits"), hit(4).alias("runs"),
                F.count_if((c("bases") == 4) & (c("at_bat_index") % 4 != 0)).alias("earned_runs"), hit(4).alias("home_runs"), F.count_if("is_walk").alias("walks"), F.count_if("is_strikeout").alias("strikeouts"), F.min("at_bat_index").alias("first_at_bat"), F.sum(c("q") % 4 + 1).alias("pitches"),
            )
        )
        margin = F.when(c("team_id") == c("home_team_id"), c("home_score") - c("away_score")).otherwise(c("away_score") - c("home_score"))
        relief = ~c("is_starter")
        return lines.join(merged(by_game(games_().select("game_pk", "home_team_id", "home_score", "away_score"))), "game_pk").select(
            *lines.columns, (c("is_starter") & (margin > 0)).alias("is_win"), (c("is_starter") & (margin < 0)).alias("is_loss"),
            (relief & (c("player_id") % 3 == 0)).alias("is_save"), (relief & (c("player_id") % 3 == 1)).alias("is_hold"), (relief & (c("player_id") % 3 == 2)).alias("is_blown_save"),
        )

    @once
    def decisions_() -> DataFrame:
        won = F.when(c("home_score") > c("away_score"), "home").otherwise("away")
        each = games_().filter((c("coded_state") == "F") & (c("home_score") != c("away_score"))).select("game_pk", "season", won.alias("won"))
        w, l = (starters().select("game_pk", c("side").alias(f"{x}_side"), c("pitcher_id").alias(x)) for x in ("winner_id", "loser_id"))
        return each.join(merged(w), "game_pk").join(merged(l), "game_pk").filter((c("winner_id_side") == c("won")) & (c("loser_id_side") != c("won"))).select("game_pk", "season", "winner_id", "loser_id", F.when(c("game_pk") % 3 == 0, PITCHER_BASE + c("game_pk") % 90).alias("save_id"))

    @once
    def linescores_() -> DataFrame:
        is_ = lambda *e: F.count_if(c("event_type").isin(*e)).cast("int")
        return own_plays().groupBy("game_pk", "inning", "half").agg(is_("home_run").alias("runs"), is_("single", "double", "triple", "home_run").alias("hits"), is_("field_error").alias("errors"))

    @once
    def bios_() -> DataFrame:
        return (
            part_of(read("lineitem").select("l_orderkey", "l_quantity", "l_partkey", "l_suppkey"), "l_orderkey").join(merged(part_of(read("orders").select("o_orderkey", "o_orderdate"), "o_orderkey")), line == k)
            .withColumn("player_id", F.explode(F.array(c("l_partkey"), PITCHER_BASE + c("l_suppkey")))).filter(c("player_id") % 17 != 0)
            .groupBy("player_id", line.alias("game_pk"), F.year(day).alias("season"), day.alias("source_date")).agg((F.max(c("l_quantity").cast("int")) + 60).alias("weight"))
            .withColumns({"game_number": F.lit(1), "full_name": F.concat(F.lit("Full "), c("player_id").cast("string")), "boxscore_name": F.when(c("player_id") % 5 != 0, F.concat(F.lit("Box "), c("player_id").cast("string"))), "last_name": F.when(c("player_id") % 7 != 0, F.concat(F.lit("Last "), c("player_id").cast("string")))})
        )

    @cache
    def game_players_() -> DataFrame:
        who = lambda df, position, played, order, late: df.select("game_pk", "season", "player_id", "team_id", (c("player_id") % 99).cast("string").alias("jersey_number"), position.alias("position"), played.alias("played"), order.cast("int").alias("batting_order"), late.alias("is_substitute"))
        batters = who(batting_(), _pick(["C", "1B", "SS", "CF"], c("player_id") % 4), F.lit(True), c("batting_order") * 100 + 100, c("batting_order") > 8)
        return batters.unionByName(who(pitching_(), F.lit("P"), c("player_id") % 10 != 0, F.lit(None), ~c("is_starter")))

    def person(n) -> list:
        since = lambda first, days: F.date_add(F.to_date(F.lit(first)), (n % days).cast("int"))
        return [since("1970-01-01", 9000).alias("birth_date"), F.concat(F.lit("6 "), (n % 12).cast("string")).alias("height"), (150 + n % 100).cast("int").alias("weight"), since("1994-04-01", 1500).alias("mlb_debut_date"), (n % 3 == 0).alias("active")]

    @cache
    def players_() -> DataFrame:
        batters = read("part").filter(c("p_partkey") % 17 != 0).select(c("p_partkey").alias("player_id"), F.concat("p_name", F.lit(" "), c("p_partkey").cast("string")).alias("full_name"), F.when(c("p_partkey") % 2 == 0, "L").otherwise("R").alias("hand"), *person(c("p_partkey")))
        pitchers = read("supplier").filter(c("s_suppkey") % 17 != 0).select((PITCHER_BASE + c("s_suppkey")).alias("player_id"), c("s_name").alias("full_name"), F.when(c("s_suppkey") % 3 == 0, "L").otherwise("R").alias("hand"), *person(c("s_suppkey")))
        batters, pitchers = batters.withColumns({"bat_side": c("hand"), "pitch_hand": F.lit("R")}), pitchers.withColumns({"bat_side": F.lit("R"), "pitch_hand": c("hand")})
        return batters.unionByName(pitchers)

    @cache
    def game_teams_() -> DataFrame:
        sides = games_().select("game_pk", "season", "official_date", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"))
        return asof_left_join(sides, teams_().select("team_id", c("season").alias("since"), "abbreviation", "name"), ["team_id"], "season", "since").select("game_pk", "season", "team_id", "abbreviation", "name", c("official_date").alias("source_date"))

    @cache
    def play_events_() -> DataFrame:
        ab6 = c("at_bat_index") % 6
        return own_plays().filter(ab6 % 2 == 1).select("game_pk", "at_bat_index", F.lit(9).alias("event_index"), F.when(ab6 == 1, "no_pitch").otherwise("action").alias("kind"), F.when(ab6 == 5, "pitching_substitution").when(ab6 == 3, "stolen_base_2b").alias("event_type"), c("event").alias("description"))

    return Tables(games=games_, plays=own_plays, pitches=pitches_, play_events=play_events_, linescores=linescores_, decisions=decisions_, batting=batting_, pitching=pitching_, game_teams=game_teams_, game_players=game_players_, bios=bios_, players=players_, teams=teams_, event_types=kinds)
