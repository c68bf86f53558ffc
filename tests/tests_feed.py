"""Small documents for the tests."""

import json


def feed(pk=1, ts="20260401_120000", state="F", plays=(), **more):
    doc = {"gamePk": pk, "metaData": {"timeStamp": ts}, "gameData": {"status": {"codedGameState": state}, "game": {"season": "2026"}, "datetime": {"officialDate": "2026-04-01"}, "teams": {"home": {"id": 1, "name": "H"}, "away": {"id": 2, "name": "A"}}, "players": {"ID7": {"id": 7, "fullName": "Seven", "weight": 90}}}, "liveData": {"plays": {"allPlays": list(plays)}, "linescore": {"innings": [{"num": 1, "away": {"runs": 1, "hits": 2}, "home": {"hits": 0}}]}, "decisions": {"winner": {"id": 7}}, "boxscore": {"teams": {s: {"team": {"id": t}, "players": {"ID7": {"person": {"id": 7}, "battingOrder": "100", "allPositions": [{"abbreviation": "P"}], "stats": {"batting": {"gamesPlayed": 1, "hits": 2, "baseOnBalls": 1}, "pitching": {"gamesPlayed": 1, "gamesStarted": 1, "wins": 0, "outs": 9}}}}} for s, t in (("home", 1), ("away", 2))}}}}
    doc["liveData"].update(more)
    return (json.dumps(doc),)


def play(i, half="top", pitcher=70, events=(), complete=True, outs=1, inning=1):
    return {"about": {"atBatIndex": i, "inning": inning, "halfInning": half, "isComplete": complete}, "matchup": {"batter": {"id": 50 + i}, "pitcher": {"id": pitcher}, "batSide": {"code": "L"}, "pitchHand": {"code": "R"}}, "result": {"eventType": "single"}, "count": {"outs": outs}, "playEvents": list(events)}


def pitch(i, balls=0, strikes=0, review=None, hit=None):
    return {"index": i, "isPitch": True, "count": {"balls": balls, "strikes": strikes, "outs": 0}, "details": {"call": {"code": "B"}}, "reviewDetails": review, "hitData": hit}
