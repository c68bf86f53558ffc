"""Plans that must hold at any size, looked at over the smallest tables."""

import datetime as dt

import duckdb
import pytest

from scorebook import queries, testbed
from scorebook.plans import games, leaders, rollups
from scorebook.tables import Tables

SF = "/root/testdata/sf0.001"
FACT = "made/staged-"


def broadcast_sides(node):
    """Text of all plans whose rows a hash join would broadcast."""
    found = []
    if node.getClass().getSimpleName() == "BroadcastHashJoinExec":
        found.append((node.left() if "Left" in node.buildSide().toString() else node.right()).toString())
    for i in range(node.children().size()):
        found += broadcast_sides(node.children().apply(i))
    return found


@pytest.mark.parametrize("name", ["batted_ball_days", "board_fastest_pitches", "board_longest_home_runs", "box_score_batting", "box_score_pitching", "busiest_hitters", "challenges", "event_leaders_hardest_hit_balls", "feed_headers", "game_list", "hitter_years", "pitch_mix", "pitcher_splits", "pitching_scopes", "player_summary", "stored_barrel_leaders", "changed_rows", "game_header", "play_by_play"])
def test_facts_are_not_broadcast(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan()
    sides = [s for s in broadcast_sides(plan) if FACT in s or "part.parquet" in s]
    assert not [s for s in sides if "Limit" not in s and "TakeOrdered" not in s and "Aggregate" not in s]


def test_ranks_count_every_row(spark):
    """Two players under one id are two rows of a board, which still has no more rows than its limit."""
    t = testbed.tables(spark, SF)
    twice = t.players.unionByName(t.players.withColumn("full_name", t.players["hand"]))
    names = {n: (lambda n=n: getattr(t, n)) for n in t._tables}
    both = Tables(**{**names, "players": twice})
    for board in (leaders.pitching_leaders(both, "1997-01-01", "1997-12-31", 10, 0.01), leaders.barrel_rates(both, "1997-01-01", "1997-12-31", 10, 0.005), leaders.event_board(both, "fastest_pitches", "1997-01-01", "1997-12-31", 10)):
        assert [r["rank"] for r in board.collect()] == list(range(1, 11))


def test_boards_without_columns_that_are_only_shown(spark):
    t = testbed.tables(spark, SF)
    names = {n: (lambda n=n: getattr(t, n)) for n in t._tables}
    plain = Tables(**{**names, "pitches": t.pitches.drop("pitch_type_desc", "call_desc")})
    row = rollups.event_leaders(plain, "fastest_pitches").first()
    assert len(row["pitch_type"]) == 2


def test_bursts_count_in_milliseconds(spark, tmp_path):
    """Two hours apart by the millisecond, though not by the microsecond; and due at the last watermark but for microseconds."""
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=s)
    hour = 3_600_000_000
    found = [(1, at(900), 1), (2, at(2 * hour + 100), 1), (3, at(8 * hour + 400), 2), (4, at(10 * hour + 10_000_000), 3)]
    spark.createDataFrame([(e, t, u, "view", 1.0, "{}") for e, t, u in found], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    want = duckdb.connect().sql(queries.SQL["stream_bursts"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    got = queries.QUERIES["stream_bursts"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.select("user_id", "first_ms", "due_ms", "events").collect()) == sorted(want) and len(want) == 3


def test_team_rollup_keeps_nothing_wide_for_a_game(spark):
    """Rows that are multiplied for splits and grouping sets are sums of teams, not of games."""
    plan = queries.QUERIES["team_season_batting"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert not [line for line in plan.splitlines() if "Expand" in line and "game_pk" in line]


def test_players_lines_are_made_in_parts_of_a_number_of_plays(spark, monkeypatch):
    """The parts of a game's plays grow in number with the table, not in size, and starters need no join."""
    assert testbed.PLAYS_PER_TASK == 250_000
    seen = []
    monkeypatch.setattr(testbed, "PLAYS_PER_TASK", 500)
    monkeypatch.setattr(testbed, "made_once", lambda session, key, make: seen.append((key[0], make())) or seen[-1][1])
    t = testbed.tables(spark, SF)
    plays, _ = t.plays.count(), t.pitching
    plan = next(df for name, df in seen if name == "pitching_")._jdf.queryExecution().executedPlan().toString()
    assert f"hashpartitioning(game_pk" in plan and f", {plays // 500})" in plan and "side" not in plan


def test_linescore_shuffles_the_halves_once(spark):
    """One exchange of line scores and one of games; a half may have two rows, and an inning may be unknown."""
    plan = queries.QUERIES["linescore"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    lines = spark.createDataFrame([(1, 1, "top", 2, 1, 0), (1, 1, "top", 3, 1, 0), (1, 12, "bottom", 1, 1, 1), (1, None, "top", 4, 0, 0)], "game_pk long, inning int, half string, runs int, hits int, errors int")
    t = Tables(linescores=lines, games=spark.createDataFrame([(1, "F")], "game_pk long, coded_state string"))
    rows = sorted(tuple(r) for r in games.linescore(t).collect())
    assert [r[:4] for r in rows] == [(1, i, "3" if i == 1 else "x", "1" if i == 12 else "x") for i in range(1, 13)]
    assert {r[4:] for r in rows} == {(9, 2, 0, 1, 1, 1)}


def test_spray_chart_shuffles_only_plays_with_a_place(spark):
    plan = queries.QUERIES["spray_chart"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning(game_pk"):]
    assert "isnotnull(hit_coord_x" in below and "isnotnull(hit_coord_y" in below and "LeftSemi" in below
