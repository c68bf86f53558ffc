"""Plans on small seeds with known results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from scorebook.plans import games as G
from scorebook.plans import leaders, rollups, teams, views
from scorebook.tables import Tables
from scorebook.testbed import event_types

GAME = "game_pk int, official_date date, game_type string, coded_state string, home_team_id int, away_team_id int, home_score int, away_score int"


def games(spark, data):
    df = spark.createDataFrame([(g[0], dt.date.fromisoformat(g[1]), *g[2:]) for g in data], GAME)
    return df.withColumns({"season": F.year("official_date"), "game_number": F.lit(1), "inning": F.lit(9), "start_ms": F.unix_date("official_date").cast("long") * 100 + F.col("game_pk")})


@pytest.fixture(scope="module")
def board(spark):
    g = games(spark, [(1, "2026-09-28", "R", "F", 1, 2, 3, 1), (2, "2026-09-28", "F", "F", 1, 2, 3, 1), (3, "2026-09-28", "R", "I", 1, 2, 3, 1), (4, "2026-09-27", "R", "F", 1, 2, 3, 1), (5, "2026-09-28", "S", "F", 1, 2, 3, 1)])
    p = [(1, 0, 500, 601, "home_run", 410.0, 104.0, 28.0), (1, 1, 501, 601, "single", None, 98.7, 25.0), (1, 2, 502, 601, "field_out", None, 100.0, 30.0), (2, 0, 501, 600, "home_run", 452.0, 102.3, 30.0), (2, 1, 500, 600, "home_run", None, 95.0, 30.0), (3, 0, 500, 600, "home_run", 430.0, 110.0, 30.0), (4, 0, 500, 600, "home_run", 480.0, 118.0, 30.0), (5, 0, 500, 600, "home_run", 500.0, 120.0, 30.0)]
    plays = spark.createDataFrame(p, "game_pk int, at_bat_index int, batter_id int, pitcher_id int, event_type string, total_distance double, launch_speed double, launch_angle double").withColumns({"half": F.lit("top"), "inning": F.lit(1), "event": F.col("event_type"), "pitch_hand": F.lit("R"), "bat_side": F.lit("L"), "men_on_base": F.lit("Empty")})
    pitches = plays.select("game_pk", "at_bat_index", F.lit(0).alias("pitch_index"), "batter_id", "pitcher_id", "half", "pitch_hand", "launch_speed", F.lit(True).alias("is_in_play"), F.lit("X").alias("call_code"), F.lit("FF").alias("pitch_type"), F.lit(5).alias("zone"), (F.lit(95.0) + F.col("at_bat_index")).alias("start_speed"), F.lit(0).alias("balls_before"), F.lit(1).alias("strikes_before"))
    lines = spark.createDataFrame([(1, 500, 4, 3, 2, 5, 1, 1, 1), (5, 500, 5, 5, 5, 20, 5, 0, 0), (1, 501, 2, 2, 1, 1, 0, 0, 0), (3, 501, 3, 3, 2, 5, 1, 0, 1), (1, 502, 3, 3, 0, 0, 0, 0, 2), (4, 502, 5, 5, 5, 5, 0, 0, 0)], "game_pk int, player_id int, plate_appearances int, at_bats int, hits int, total_bases int, home_runs int, walks int, strikeouts int").withColumns({"hit_by_pitch": F.lit(0), "sac_flies": F.lit(0)})
    arms = spark.createDataFrame([(1, 601, 9, 12, 3, 1, 1, 4), (2, 600, 6, 8, 1, 0, 1, 3), (5, 600, 3, 8, 5, 5, 0, 0), (2, 602, 2, 3, 0, 0, 0, 2), (4, 602, 10, 12, 1, 0, 0, 5)], "game_pk int, player_id int, outs int, batters_faced int, hits int, earned_runs int, walks int, strikeouts int").withColumn("runs", F.col("earned_runs"))
    names = spark.createDataFrame([(500, "A")], "player_id int, full_name string")
    clubs = spark.createDataFrame([(1, 1, "HOM"), (1, 2, "AWY")], "game_pk int, team_id int, abbreviation string")
    return Tables(games=g, plays=plays, pitches=pitches, batting=lines, pitching=arms, players=names, game_teams=clubs, event_types=lambda: event_types(spark))


def test_event_boards(board):
    day = leaders.event_board(board, "longest_home_runs", "2026-09-28", "2026-09-28").collect()
    assert [(r["game_pk"], r["value"]) for r in day] == [(2, 452.0), (3, 430.0), (1, 410.0)]
    assert [r["name"] for r in day] == ["Player 501", "A", "A"] and [r["matchup"] for r in day] == ["Away @ Home", "Away @ Home", "AWY @ HOM"]
    both = leaders.event_board(board, "longest_home_runs", "2026-09-27", "2026-09-28", 2).collect()
    assert [(r["game_pk"], r["value"]) for r in both] == [(4, 480.0), (2, 452.0)]
    hard = leaders.event_board(board, "hardest_hit_balls", "2026-09-28", "2026-09-28").collect()
    assert [r["value"] for r in hard] == [110.0, 104.0, 102.3, 100.0, 98.7, 95.0]


def test_leaders_qualify_by_game_days(board):
    one = leaders.hitting_leaders(board, "2026-09-28", "2026-09-28").collect()
    assert [(r["player_id"], r["plate_appearances"]) for r in one] == [(500, 4), (501, 5)]
    assert one[0]["ops"] == pytest.approx(0.75 + 5 / 3) and one[1]["avg"] == pytest.approx(0.6)
    assert [r["player_id"] for r in leaders.hitting_leaders(board, "2026-09-27", "2026-09-28").collect()] == [502]
    arms = leaders.pitching_leaders(board, "2026-09-28", "2026-09-28").collect()
    assert [(r["player_id"], r["innings"], r["era"]) for r in arms] == [(600, 2.0, 0.0), (601, 3.0, 3.0)]
    assert [r["player_id"] for r in leaders.pitching_leaders(board, "2026-09-27", "2026-09-28").collect()] == [602, 600, 601]
    barrels = leaders.barrel_rates(board, "2026-09-28", "2026-09-28").collect()
    assert [(r["player_id"], r["batted_balls"], r["barrel_rate"]) for r in barrels] == [(502, 1, 1.0), (500, 3, pytest.approx(2 / 3)), (501, 2, 0.5)]


def test_day_limit_and_incremental_rebuild(board, as_rows):
    top = rollups.event_leaders(board, "fastest_pitches", 2)
    assert top.groupBy("official_date").count().agg(F.max("count")).first()[0] == 2
    whole = rollups.batted_ball_days(board)
    one = rollups.batted_ball_days(Tables(**{**board._tables, "games": board.games.filter("official_date = '2026-09-28'")}))
    assert as_rows(whole.filter("official_date = '2026-09-28'")) == as_rows(one)


def test_standings(spark):
    data = [(1, "2026-04-01", "R", "F", 147, 110, 5, 3), (2, "2026-04-02", "R", "F", 147, 141, 1, 4), (3, "2026-04-03", "R", "F", 110, 147, 2, 6), (4, "2026-04-04", "R", "F", 147, 121, 3, 2), (5, "2026-04-05", "R", "F", 111, 141, 7, 1), (6, "2026-04-06", "R", "F", 144, 121, 1, 0), (7, "2026-04-07", "R", "S", 147, 110, None, None), (8, "2026-04-08", "F", "F", 147, 111, 9, 0), (9, "2025-04-08", "R", "F", 147, 110, 0, 1)]
    clubs = [(147, "NYY", 1, 1), (110, "BAL", 1, 1), (141, "TOR", 1, 1), (111, "BOS", 1, 1), (121, "NYM", 2, 2), (144, "ATL", 2, 2)]
    t = spark.createDataFrame([(i, 2025, n, n, f"L{lg}", d, f"D{d}") for i, n, lg, d in clubs], "team_id int, season int, name string, abbreviation string, league_name string, division_id int, division_name string")
    tables = Tables(games=games(spark, data), teams=t)
    got = {(r["season"], r["name"]): (r["place"], r["wins"], r["losses"], r["pct"], r["games_back"], r["run_diff"], r["streak"]) for r in teams.standings(tables).collect()}
    assert got[2026, "BOS"] == (1, 1, 0, 1.0, 0.0, 6, "W1")
    assert got[2026, "NYY"] == (2, 3, 1, 0.75, -0.5, 4, "W2")
    assert got[2026, "TOR"] == (3, 1, 1, 0.5, 0.5, -3, "L1")
    assert got[2026, "BAL"] == (4, 0, 2, 0.0, 1.5, -6, "L2")
    wild = {(r["league_name"], r["name"]): r["games_back"] for r in teams.wild_card(tables).filter("season = 2026").collect()}
    assert wild == {("L1", "NYY"): -2.0, ("L1", "TOR"): -1.0, ("L1", "BAL"): 0.0, ("L2", "NYM"): 0.0}
    rec = {r["team_id"]: (r["wins"], r["losses"], r["runs_scored"], r["runs_allowed"], r["expected_wins"], r["streak"]) for r in teams.team_records(tables).filter("season = 2026").collect()}
    assert rec[147] == (3, 1, 15, 11, 3, "W2")


def test_form_before_a_game(spark):
    data = [(1, "2026-04-01", "R", "F", 1, 2, 5, 3), (2, "2026-04-02", "R", "F", 2, 1, 5, 3), (3, "2026-04-03", "R", "F", 1, 2, 5, 3), (4, "2026-04-04", "R", "S", 1, 2, None, None)]
    t = Tables(games=games(spark, data))
    got = {(r["game_pk"], r["team_id"]): (r["wins"], r["losses"], r["streak"]) for r in G.team_form(t).collect()}
    assert got[4, 1] == (2, 1, "W1") and got[4, 2] == (1, 2, "L1") and got[1, 1] == (0, 0, None)
    h = {r["game_pk"]: (r["meetings"], r["home_wins"], r["away_wins"]) for r in G.head_to_head(t).collect()}
    assert h[1] == (2, 1, 1) and h[4] == (3, 2, 1)


def test_dimensions_take_the_latest(spark, as_rows):
    bios = spark.createDataFrame([(1, 10, "2025-05-01", 1, 80), (1, 11, "2026-05-01", 1, 82), (1, 12, "2026-05-01", 2, 83)], "player_id int, game_pk int, source_date string, game_number int, weight int")
    assert [r["weight"] for r in views.player_dimension(bios).collect()] == [83]
