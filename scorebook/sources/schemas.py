"""Schemas of the raw documents: only the fields that are read, typed once.

Numbers that documents give as strings (season, batting order) are declared as strings and cast afterwards, since JSON parsing
gives null for a number in quotes.
"""

from __future__ import annotations


def _ints(names: str) -> str:
    return ", ".join(f"{n}: INT" for n in names.split())


def _doubles(names: str) -> str:
    return ", ".join(f"{n}: DOUBLE" for n in names.split())


ID = "STRUCT<id: INT>"
CODE = "STRUCT<code: STRING, description: STRING>"
LINE = f"STRUCT<{_ints('runs hits errors leftOnBase')}>"
COUNT = f"STRUCT<{_ints('balls strikes outs')}>"
REVIEW = f"STRUCT<reviewType: STRING, isOverturned: BOOLEAN, challengeTeamId: INT, player: {ID}>"
NAMED = "STRUCT<id: INT, name: STRING>"
#: Counters of a batting and a pitching line.
BATTING = "gamesPlayed plateAppearances atBats runs hits doubles triples homeRuns totalBases rbi baseOnBalls intentionalWalks strikeOuts hitByPitch sacFlies sacBunts stolenBases caughtStealing groundIntoDoublePlay leftOnBase"
PITCHING = "gamesPlayed gamesStarted outs battersFaced numberOfPitches strikes hits runs earnedRuns homeRuns baseOnBalls intentionalWalks strikeOuts hitBatsmen wildPitches balks inheritedRunners inheritedRunnersScored wins losses saves holds blownSaves"

TEAM = f"STRUCT<id: INT, name: STRING, teamName: STRING, abbreviation: STRING, locationName: STRING, shortName: STRING, teamCode: STRING, league: {NAMED}, division: {NAMED}, venue: {NAMED}>"
PERSON = f"STRUCT<id: INT, fullName: STRING, firstName: STRING, lastName: STRING, boxscoreName: STRING, batSide: {CODE}, pitchHand: {CODE}, birthDate: DATE, height: STRING, weight: INT, mlbDebutDate: DATE, active: BOOLEAN, strikeZoneTop: DOUBLE, strikeZoneBottom: DOUBLE>"
BOX_PLAYER = f"STRUCT<person: {ID}, jerseyNumber: STRING, position: STRUCT<abbreviation: STRING>, battingOrder: STRING, gameStatus: STRUCT<isSubstitute: BOOLEAN>, allPositions: ARRAY<STRUCT<abbreviation: STRING>>, stats: STRUCT<batting: STRUCT<{_ints(BATTING)}>, pitching: STRUCT<{_ints(PITCHING)}>>>"
PITCH_DATA = f"STRUCT<{_doubles('startSpeed endSpeed extension plateTime typeConfidence')}, zone: INT, {_doubles('strikeZoneTop strikeZoneBottom')}, coordinates: STRUCT<{_doubles('pX pZ pfxX pfxZ x0 y0 z0 vX0 vY0 vZ0 aX aY aZ')}>, breaks: STRUCT<{_doubles('breakAngle breakLength breakY breakVertical breakVerticalInduced breakHorizontal spinRate spinDirection')}>>"
HIT_DATA = f"STRUCT<{_doubles('launchSpeed launchAngle totalDistance')}, trajectory: STRING, hardness: STRING, location: STRING, coordinates: STRUCT<{_doubles('coordX coordY')}>>"
EVENT = f"STRUCT<index: INT, isPitch: BOOLEAN, type: STRING, playId: STRING, pitchNumber: INT, startTime: TIMESTAMP, endTime: TIMESTAMP, player: {ID}, count: {COUNT}, details: STRUCT<call: {CODE}, type: {CODE}, description: STRING, eventType: STRING, isScoringPlay: BOOLEAN, isInPlay: BOOLEAN, isStrike: BOOLEAN, isBall: BOOLEAN, isOut: BOOLEAN>, pitchData: {PITCH_DATA}, hitData: {HIT_DATA}, reviewDetails: {REVIEW}>"
PLAY = f"STRUCT<about: STRUCT<atBatIndex: INT, inning: INT, halfInning: STRING, isComplete: BOOLEAN, isScoringPlay: BOOLEAN, hasReview: BOOLEAN, startTime: TIMESTAMP, endTime: TIMESTAMP>, matchup: STRUCT<batter: {ID}, pitcher: {ID}, batSide: {CODE}, pitchHand: {CODE}, splits: STRUCT<menOnBase: STRING>>, result: STRUCT<event: STRING, eventType: STRING, description: STRING, rbi: INT, isOut: BOOLEAN, homeScore: INT, awayScore: INT>, count: {COUNT}, reviewDetails: {REVIEW}, playEvents: ARRAY<{EVENT}>>"
FEED = f"""STRUCT<gamePk: INT, metaData: STRUCT<timeStamp: STRING>,
gameData: STRUCT<status: STRUCT<abstractGameState: STRING, codedGameState: STRING, detailedState: STRING>, game: STRUCT<season: STRING, gameNumber: INT>, datetime: STRUCT<officialDate: DATE>, teams: MAP<STRING, {TEAM}>, players: MAP<STRING, {PERSON}>>,
liveData: STRUCT<boxscore: STRUCT<teams: MAP<STRING, STRUCT<team: {ID}, players: MAP<STRING, {BOX_PLAYER}>>>>, linescore: STRUCT<innings: ARRAY<STRUCT<num: INT, home: {LINE}, away: {LINE}>>, currentInning: INT, inningHalf: STRING, outs: INT, teams: STRUCT<home: {LINE}, away: {LINE}>>, decisions: STRUCT<winner: {ID}, loser: {ID}, save: {ID}>, plays: STRUCT<allPlays: ARRAY<{PLAY}>>>>"""

SCHEDULE_TEAM = "STRUCT<team: STRUCT<id: INT, name: STRING, teamName: STRING, abbreviation: STRING>, leagueRecord: STRUCT<wins: INT, losses: INT>, score: INT, probablePitcher: STRUCT<id: INT, fullName: STRING>>"
SCHEDULE = f"dates ARRAY<STRUCT<date: STRING, games: ARRAY<STRUCT<gamePk: INT, gameType: STRING, season: STRING, gameDate: STRING, officialDate: STRING, gameNumber: INT, doubleHeader: STRING, rescheduledFromDate: STRING, status: STRUCT<abstractGameState: STRING, codedGameState: STRING, detailedState: STRING>, teams: STRUCT<home: {SCHEDULE_TEAM}, away: {SCHEDULE_TEAM}>, linescore: STRUCT<currentInning: INT, inningHalf: STRING, outs: INT, offense: STRUCT<first: {ID}, second: {ID}, third: {ID}>, teams: STRUCT<home: STRUCT<runs: INT>, away: STRUCT<runs: INT>>>, venue: {NAMED}, seriesGameNumber: INT, gamesInSeries: INT, seriesStatus: STRUCT<result: STRING>>>>>"
