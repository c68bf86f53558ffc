"""The tables that the analytic queries read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class Tables:
    """Current state of the facts and dimensions, each a lazy DataFrame or a function that gives one when it is first asked for.

    games, plays, pitches, play_events, linescores, decisions, batting and pitching (a line for each player and
    game), game_teams, game_players, bios (a player's bio as of each game), players (latest bio), teams (latest row of each team
    and season), event_types.
    """

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        self._tables = tables

    def __getattr__(self, name: str) -> DataFrame:
        try:
            found = self.__dict__["_tables"][name]
        except KeyError:
            raise AttributeError(name) from None
        if not isinstance(found, DataFrame):
            found = self._tables[name] = found()
        return found
