"""Documents: schedules, headers, derivation, and live changes."""

import json

import pytest
from pyspark.sql import functions as F

from scorebook import testfeeds
from scorebook.sources import derive, feeds, schedule, schemas
from scorebook.streaming import live
from tests_feed import feed, pitch, play

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parsed(spark):
    sub = {"index": 1, "isPitch": False, "details": {"eventType": "pitching_substitution"}, "type": "action"}
    plays = [
        play(0, events=[pitch(0, 1, 0, {"reviewType": "MJ", "isOverturned": True, "challengeTeamId": 2}), pitch(1, 1, 1, None, {"launchSpeed": 99.5})]),
        play(1, pitcher=71, events=[pitch(0, 1, 0), sub, pitch(2, 1, 1)], outs=2),
        play(2, half="bottom", events=[]),
        play(3, complete=False),
    ]
    docs = spark.createDataFrame([feed(plays=plays), feed(pk=2, plays=[])], "json string")
    return feeds.parsed(feeds.split_valid(docs)[0])


def test_plays_and_pitches(parsed):
    plays = {r["at_bat_index"]: r for r in derive.plays(parsed).collect()}
    assert sorted(plays) == [0, 1, 2] and plays[0]["pitch_count"] == 2 and plays[0]["launch_speed"] == 99.5 and plays[2]["pitch_count"] == 0 and plays[0]["has_review"] is False
    got = {(r["at_bat_index"], r["pitch_index"]): r for r in derive.pitches(parsed).collect()}
    assert got[1, 0]["pitcher_id"] == 70 and got[1, 2]["pitcher_id"] == 71  # credited to the pitcher who left
    assert (got[0, 0]["balls_before"], got[0, 1]["balls_before"], got[0, 0]["outs_before"], got[1, 0]["outs_before"]) == (0, 1, 0, 1)
    assert got[0, 0]["abs_challenged"] and got[0, 0]["abs_overturned"] and not got[0, 1]["abs_challenged"]
    assert [(r["at_bat_index"], r["event_type"]) for r in derive.play_events(parsed).collect()] == [(1, "pitching_substitution")]


def test_other_tables(parsed, as_rows):
    lines = as_rows(derive.linescores(parsed).filter("game_pk = 1").select("inning", "half", "runs", "hits"))
    assert lines == [(1, "bottom", None, 0), (1, "top", 1, 2)]  # a half without runs was not played
    assert derive.decisions(parsed).count() == 2 and derive.game_teams(parsed).count() == 2  # none for the game without plays
    players = as_rows(derive.game_players(parsed).select("player_id", "side", "batting_order", "all_positions", "played"))
    assert players == [(7, "away", 100, ["P"], True), (7, "home", 100, ["P"], True)]
    bat = derive.batting_lines(parsed).first()
    assert (bat["hits"], bat["walks"]) == (2, 1)
    arm = derive.pitching_lines(parsed).first()
    assert (arm["is_starter"], arm["is_win"], arm["outs"]) == (True, False, 9)
    assert derive.bios(parsed).first()["weight"] == 90


def test_bad_domain_refuses_the_batch(spark):
    docs = spark.createDataFrame([feed(plays=[play(0, half="sideways")])], "json string")
    with pytest.raises(ValueError):
        derive.derive_all(feeds.parsed(feeds.split_valid(docs)[0]))


def test_headers_and_store(spark, as_rows):
    docs = spark.createDataFrame([feed(pk=1, ts="b"), feed(pk=2, ts="a", state="I"), ("{broken",)], "json string")
    good, bad = feeds.split_valid(docs)
    assert good.count() == 2 and bad.count() == 1
    empty = good.limit(0)
    final, alive, stored = feeds.store(empty, empty, good)
    assert as_rows(final.select("game_pk")) == [(1,)] and as_rows(alive.select("game_pk")) == [(2,)] and stored.count() == 2
    again = feeds.store(final, alive, good)
    assert again[2].count() == 0


def test_batch_equals_one_by_one(spark, as_rows):
    parsed = testfeeds.parsed(spark, SF).filter("game_pk < 6").persist()
    whole = derive.pitches(parsed)
    keys = [r[0] for r in parsed.select("game_pk").collect()]
    single = derive.pitches(parsed.filter(F.col("game_pk") == keys[0]))
    for k in keys[1:]:
        single = derive.pitches(parsed.filter(F.col("game_pk") == k)).unionByName(single)
    cols = ["game_pk", "at_bat_index", "pitch_index", "pitcher_id", "outs_before"]
    assert as_rows(whole.select(*cols)) == as_rows(single.select(*cols))
    parsed.unpersist()


def test_schedule(spark, as_rows):
    game = lambda pk, **k: {"gamePk": pk, "gameType": "R", "season": "2026", "gameDate": "2026-04-02T01:00:00Z", "officialDate": "2026-04-01", "status": {"abstractGameState": "Live", "codedGameState": "I", "detailedState": "x"}, "teams": {"home": {"team": {"id": 1}, "leagueRecord": {"wins": 3, "losses": 2}, "score": 4, "probablePitcher": {"id": 9, "fullName": "Nine"}}, "away": {"team": {"id": 2}}}, **k}
    doc = {"dates": [{"date": "2026-04-01", "games": [game(1), game(2)]}, {"date": "2026-04-05", "games": [game(1, gameNumber=2)]}]}
    docs = spark.createDataFrame([(json.dumps(doc),)], "v string").select(F.from_json("v", f"STRUCT<{schemas.SCHEDULE.replace('dates ', 'dates: ', 1)}>").alias("d")).select("d.*")
    got = schedule.parse(docs)
    assert as_rows(got.select("game_pk", "game_number", "season", "home_record", "away_record", "home_score")) == [(1, 2, 2026, "3-2", None, 4), (2, 1, 2026, "3-2", None, 4)]
    assert as_rows(schedule.probables(got.filter("game_pk = 1"))) == [(1, "away", None, None), (1, "home", 9, "Nine")]
    assert as_rows(schedule.live_keys(got, F.to_date(F.lit("2026-04-02")))) == [(1,), (2,)]
    assert as_rows(schedule.live_keys(got, F.to_date(F.lit("2026-04-09")))) == []


def test_live_changes(spark, as_rows):
    schema = "game_pk int, at_bat_index int, is_complete boolean, description string, outs int"
    a = spark.createDataFrame([(1, 0, True, "x", 1), (1, 1, False, "y", 1)], schema)
    b = spark.createDataFrame([(1, 0, True, "x", 1), (1, 1, True, "y", 2), (1, 2, True, "", 2)], schema)
    assert as_rows(live.feed_changes(a, b).select("at_bat_index")) == [(1,)]
    log = spark.createDataFrame([(1, 3, 1), (1, 4, 2), (1, 4, 3), (1, 2, 9)], "game_pk int, at_bat_index int, seq int")
    assert [(r["at_bat_index"], r["seq"]) for r in live.pending_plays(log, F.lit(2), "seq").collect()] == [(4, 3), (3, 1)]
    states = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 1, 1), (1, 3, 2, 1), (1, 4, 2, 1)], "g int, seq int, home_runs int, away_runs int")
    assert as_rows(live.scoring_alerts(states, ["g"], "seq").select("seq", "scored")) == [(2, "away"), (3, "home")]
