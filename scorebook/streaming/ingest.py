"""The incremental path: landed documents -> per-game tables -> day and season rollups.

All tables of a store are ``Snapshots``: each batch writes beside what is there, is checked, and is seen whole with its commit or not
at all.  Running a batch again changes nothing, and an older version never replaces a newer one, whatever order documents arrive in.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import latest_state
from ..operators.core import latest_per_key, merged
from ..plans import rollups, views
from ..sources import derive, feeds, schedule
from ..sources.schedule import DAY
from ..sources.snapshots import Snapshots, again, listed, span
from ..tables import Tables
from . import live

FEED = "game_pk int, season int, span int, feed_ts string, is_final boolean, json string"
QUARANTINE = "document string, reason string, source string, json string"
CHANGES = "game_pk long, is_final boolean, at timestamp"
COVERED = "season int, official_date date, span int"
COVERED_SEASONS = "season int, through date"
#: A store's tables and their partition columns: per-game tables by season and span of days, small dimensions whole.
BY = {
    **dict.fromkeys((*derive.TABLES, "feeds_final", "feeds_live", *rollups.DAY_ROLLUPS, "covered_days"), ("season", "span")),
    **dict.fromkeys((*rollups.SEASON_ROLLUPS, "covered_seasons", "games"), ("season",)),
    **dict.fromkeys(("players", "quarantine", "changes", "probables"), ()), "probables_latest": ("bucket",),
}
_FOLLOWED = "outbox"  # committed changes, for streams to read; a plain folder, as a stream's source is not a snapshot


class GameStore:
    """Documents, per-game tables, schedule and players of one root folder.

    Per-game tables are partitioned by season and by spans of ``days`` days, so a batch writes the spans of its games only.
    """

    def __init__(self, spark: SparkSession, root: str, days: int = 7):
        self.spark, self.root, self.days = spark, root.rstrip("/"), days
        self.tables = Snapshots(spark, root, BY, lookup={"feeds_final": "game_pk", "feeds_live": "game_pk"})

    @cached_property
    def schemas(self) -> dict:
        """Columns of the per-game tables, also before they are first written."""
        none = feeds.parsed(self.spark.createDataFrame([], FEED))
        return {n: make(none).withColumn("span", F.lit(0)).schema for n, make in derive.TABLES.items()}

    def read(self, name: str, schema=None) -> DataFrame:
        """A table as the newest commit left it."""
        known = {"feeds_final": FEED, "feeds_live": FEED, "quarantine": QUARANTINE, "changes": CHANGES}
        return self.tables.read(name, schema or known.get(name) or self.schemas.get(name))

    def document(self, game_pk: int) -> DataFrame:
        """The current document of a game.  Files are sorted by key and have bloom filters, so a lookup reads a row group or two."""
        return feeds.current(*(self.read(n).filter(F.col("game_pk") == game_pk) for n in ("feeds_final", "feeds_live")))

    def facts(self, games: DataFrame, event_types: DataFrame, **more: DataFrame) -> Tables:
        """The tables that plans read, all as of one commit."""
        version = self.tables.version()
        own = {n: (lambda n=n: self.tables.read(n, self.schemas[n], version=version).drop("span")) for n in derive.TABLES}
        players = lambda: self.tables.read("players", views.player_dimension(self.read("bios").drop("span")).schema, version=version)
        return Tables(**{**own, "players": players, "games": games, "event_types": event_types, **more})

    # -- documents ----------------------------------------------------------------------------------------------
    def ingest(self, documents: DataFrame, after: Callable[[DataFrame], None] | None = None) -> None:
        """One batch.  Unusable documents go to the quarantine, once each; of the others the newest version of each is stored, as final or
        live, if it is newer than what is there, and its games' rows and players are derived again.  One commit shows all of it;
        a broken rule in any table refuses the batch.  ``after`` gets the stored games (game_pk, is_final)."""
        self.publish()
        stored = again(lambda: self._ingest(documents))
        self.publish()
        if after and stored is not None:
            after(stored)

    def _ingest(self, documents: DataFrame) -> DataFrame | None:
        with self.tables.begin() as batch:
            good, bad = feeds.split_valid(batch.stage(feeds.with_header(documents)))  # headers are parsed once
            refused = bad.join(batch.held("quarantine", QUARANTINE), "document", "left_anti").dropDuplicates(["document"])
            batch.append("quarantine", refused.select("document", "reason", *(c if c in refused.columns else F.lit(None).cast("string").alias(c) for c in ("source", "json"))))
            day = span(F.try_to_timestamp(F.get_json_object("json", "$.gameData.datetime.officialDate")).cast("date"), self.days)
            landed = batch.stage(latest_state(good.withColumn("span", day).select("game_pk", "season", "span", "feed_ts", "is_final", "json"), ["game_pk"], "feed_ts"))
            there = [batch.held(n, FEED).select("game_pk", "season", "span") for n in ("feeds_final", "feeds_live")]  # keys only: no document is read
            known = there[0].union(there[1]).join(landed.select("game_pk"), "game_pk", "left_semi")
            parts = listed(known.union(landed.select("game_pk", "season", "span")).select("season", "span"))  # spans that the batch touches
            final, live_ = (batch.held(n, FEED, parts) for n in ("feeds_final", "feeds_live"))
            new_final, new_live, keys = feeds.store(final, live_, landed.select(*final.columns))
            keys = batch.stage(keys)
            if keys.isEmpty():
                batch.commit()
                return None
            stored = batch.stage(feeds.parsed(feeds.current(new_final, new_live).join(keys, "game_pk", "left_semi")))  # parsed once for all tables
            # the span goes with the season through every table's derivation, so none is joined with its games again
            marked = stored.withColumn("season", F.struct("season", "span"))
            new = {n: make(marked).withColumns({c: F.col(f"season.{c}") for c in ("season", "span")}) for n, make in derive.TABLES.items()}
            rest = {n: batch.held(n, self.schemas[n], parts).join(keys, "game_pk", "left_anti") for n in new}
            batch.replace_all({n: rest[n].unionByName(new[n].select(*rest[n].columns)) for n in new} | {"feeds_final": new_final, "feeds_live": new_live}, parts)
            for name, rules in derive.RULES.items():
                batch.check(name, **rules)
            self._players(batch, parts, keys)
            self._uncover(batch, keys)
            batch.replace("changes", stored.select(F.col("game_pk").cast("long").alias("game_pk"), "is_final", F.current_timestamp().alias("at")))
            batch.commit()
            return self.read("changes").select("game_pk", "is_final")

    def _players(self, batch, parts: list, keys: DataFrame) -> None:
        """The players table after the bios of ``keys`` changed: touched players are found in the touched spans, before and after.

        A player takes the newest of the new bios and the row there, unless that row came from a touched game and is no longer
        as new: only these players are picked again from all bios.
        """
        own = batch.read("bios").drop("span")
        before = batch.held("bios", self.schemas["bios"], parts).drop("span").join(keys, "game_pk", "left_semi")
        new = own.join(keys, "game_pk", "left_semi")
        players = batch.held("players", own.schema)
        touched = new.select("player_id").union(before.select("player_id")).distinct()
        current = players.join(touched, "player_id", "left_semi")
        kept = current.join(keys, "game_pk", "left_anti")
        best = views.player_dimension(kept.unionByName(new))
        rank = lambda: F.struct("source_date", "game_number", "game_pk")
        came = current.join(keys, "game_pk", "left_semi").select("player_id", rank().alias("_was"))
        lost = batch.stage(came.join(best.select("player_id", rank().alias("_is")), "player_id", "left").filter("_is IS NULL OR _is < _was").select("player_id"))
        if not lost.isEmpty():
            elsewhere = [p for p in self.tables.parts("bios", batch.began) if p not in set(parts)]
            every = own.unionByName(batch.held("bios", self.schemas["bios"], elsewhere).drop("span")).join(lost, "player_id", "left_semi")
            best = best.join(lost, "player_id", "left_anti").unionByName(views.player_dimension(every))
        batch.replace("players", players.join(touched, "player_id", "left_anti").unionByName(best.select(*players.columns)))

    def _uncover(self, batch, keys: DataFrame) -> None:
        """Days and seasons of changed games are no longer covered by rollups, until these are refreshed."""
        if self.tables.parts("games", batch.began):
            uncover(batch, batch.held("games").join(keys, "game_pk", "left_semi").select(*DAY))

    # -- schedule -----------------------------------------------------------------------------------------------
    def put_games(self, incoming: DataFrame) -> None:
        """Upserts rows of the schedule; days that a changed game leaves or enters are no longer covered."""

        def work() -> None:
            with self.tables.begin() as batch:
                changed, left = schedule.upsert_into(batch, "games", incoming)
                if changed:
                    uncover(batch, left.select(*DAY).union(batch.read("games").join(left.select("game_pk"), "game_pk", "left_semi").select(*DAY)))
                    batch.commit()

        again(work)

    # -- streams ------------------------------------------------------------------------------------------------
    def publish(self) -> None:
        """Copies the changes of the newest commit to the outbox, if they are not there yet.  A run that broke off between a commit and
        this move is made up for by the next."""
        fs = self.tables._fs()
        fs.mkdirs(self.tables._path(_FOLLOWED))
        for f in self.tables.folders("changes"):
            if fs.exists(self.tables._path("changes", f)) and not fs.exists(self.tables._path(_FOLLOWED, f)):
                self.spark.read.schema(CHANGES).parquet(f"{self.root}/changes/{f}").write.parquet(f"{self.root}/{_FOLLOWED}/.{f}")
                fs.rename(self.tables._path(_FOLLOWED, f".{f}"), self.tables._path(_FOLLOWED, f))

    def changed_games(self) -> DataFrame:
        """The stream of committed changes."""
        return self.spark.readStream.schema(CHANGES).parquet(f"{self.root}/{_FOLLOWED}/batch=*")

    def work(self, after: Callable[[DataFrame], None] | None = None) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``."""
        return lambda batch, turn: self.ingest(batch, after)

    def refresh(self, rolled: RollupStore, facts: Callable[[], Tables]) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: refreshes the days of changed games (game_pk), and the seasons of those that are final now."""

        def work(changed: DataFrame, turn: int) -> None:
            games = changed.select("game_pk").distinct()
            if not games.isEmpty():
                final = self.read("feeds_final").select("game_pk", F.lit(True).alias("is_final"))
                rolled.follow(facts(), games.join(final, "game_pk", "left").select("game_pk", F.coalesce("is_final", F.lit(False)).alias("is_final")))

        return work

    def follow(self, rolled: RollupStore, facts: Callable[[], Tables], checkpoint: str, quiet_s: float = 30, most_s: float = 120, every: str = "10 seconds") -> StreamingQuery:
        """The long-running stream from committed changes to rollups, with offsets of its own: a game's changes are gathered until it is quiet, and each
        burst refreshes its games once."""
        return live.start_batches(live.debounce_arrivals(self.changed_games(), "game_pk", quiet_s, most_s), self.refresh(rolled, facts), checkpoint, every)

    def run(self, documents: DataFrame, rolled: RollupStore, facts: Callable[[], Tables], checkpoint: str) -> None:
        """From a stream of landed documents to rollups, two chained streams through all that is available now.  Then nothing is waited for: the
        changes that are there are one burst."""
        live.run_batches(documents, self.work(), f"{checkpoint}/documents")
        live.run_batches(self.changed_games(), self.refresh(rolled, facts), f"{checkpoint}/changes")


def uncover(batch, days: DataFrame) -> None:
    days = batch.stage(days.distinct())
    for name, schema, on, keys in (("covered_days", COVERED, DAY, ["season", "span"]), ("covered_seasons", COVERED_SEASONS, ["season"], ["season"])):
        hit = batch.held(name, schema).join(days, on, "left_semi")
        parts = listed(hit.select(*keys))
        if parts:
            batch.replace(name, batch.held(name, schema, parts).join(days, on, "left_anti"), parts)


def refresh_players(players: DataFrame, bios: DataFrame, games: DataFrame) -> DataFrame:
    """The players table after bios of ``games`` changed: players sourced from them or in them are picked again from all bios."""
    games = merged(games)
    touched = players.join(games, "game_pk", "left_semi").select("player_id").union(bios.join(games, "game_pk", "left_semi").select("player_id")).distinct()
    again_ = views.player_dimension(bios.join(merged(touched), "player_id", "left_semi"))
    return players.join(merged(touched), "player_id", "left_anti").unionByName(again_.select(*players.columns))


class RollupStore:
    """Day and season rollups of one root folder, which may be a game store's.

    Day rollups are partitioned by season and spans of ``days`` days: with 1, a day's refresh replaces that day's files alone.  Every
    refresh computes the touched days or seasons from the facts and shows all its tables with one commit, so it can be repeated and
    equals a rebuild.  The store knows which days and seasons it covers, and reads compute the others.
    """

    def __init__(self, spark: SparkSession, root: str, days: int = 1):
        self.spark, self.root, self.days, self.tables = spark, root.rstrip("/"), days, Snapshots(spark, root, BY)

    def read(self, name: str, schema=None) -> DataFrame:
        found = self.tables.read(name, schema)
        return found.drop("span")

    def _days(self, batch, t: Tables, days: DataFrame, names: Sequence[str]) -> None:
        """Writes the day rollups of ``days`` into a batch; other days of a shared span keep their rows."""
        number = span("official_date", self.days)
        days = batch.stage(days.select(*DAY).distinct().withColumn("span", number))
        parts = listed(days.select("season", "span"))
        new = {n: df.withColumn("span", number) for n, df in rollups.day_rollups(within(t, days, DAY), names).items()}
        if self.days > 1:
            new = {n: batch.held(n, df.schema, parts).join(days.select(*DAY), DAY, "left_anti").unionByName(df) for n, df in new.items()}
        batch.replace_all(new, parts)
        if set(rollups.DAY_ROLLUPS) <= set(names):
            rest = batch.held("covered_days", COVERED, parts).join(days.select(*DAY), DAY, "left_anti")
            batch.replace("covered_days", rest.unionByName(days.select(F.col("season").cast("int").alias("season"), "official_date", "span")), parts)

    def _seasons(self, batch, t: Tables, seasons: DataFrame, names: Sequence[str]) -> None:
        seasons = batch.stage(seasons.select("season").distinct())
        parts = listed(seasons)
        batch.replace_all(rollups.season_rollups(within(t, seasons, ["season"]), names), parts)
        if set(rollups.SEASON_ROLLUPS) <= set(names):
            through = t.games.groupBy("season").agg(F.max("official_date").alias("through"))
            batch.replace("covered_seasons", seasons.join(through, "season", "left").select(F.col("season").cast("int").alias("season"), "through"), parts)

    def _committed(self, work: Callable[[object], None]) -> None:
        def once() -> None:
            with self.tables.begin() as batch:
                work(batch)
                batch.commit()

        again(once)

    def refresh_days(self, t: Tables, games: DataFrame, names: Sequence[str] = rollups.DAY_ROLLUPS) -> None:
        """The day rollups of the days on which ``games`` (game_pk) are played."""
        days = t.games.join(games.select("game_pk"), "game_pk", "left_semi")
        self._committed(lambda b: self._days(b, t, days, names))

    def refresh_seasons(self, t: Tables, seasons: DataFrame, names: Sequence[str] = rollups.SEASON_ROLLUPS) -> None:
        """Season rollups of ``seasons`` (season), in one job for each table however many there are."""
        self._committed(lambda b: self._seasons(b, t, seasons, names))

    def rebuild(self, t: Tables, names: Sequence[str] = (*rollups.DAY_ROLLUPS, *rollups.SEASON_ROLLUPS)) -> None:
        """Every season that games, teams' rows or plays name, days and seasons in one commit."""
        found = t.games.select("season").union(t.game_teams.select("season"))
        if "season" in t.plays.columns:
            found = found.union(t.plays.select("season"))
        day_names, season_names = ([n for n in names if n in every] for every in (rollups.DAY_ROLLUPS, rollups.SEASON_ROLLUPS))

        def work(batch) -> None:
            if day_names:
                self._days(batch, t, t.games, day_names)
            if season_names:
                self._seasons(batch, t, found, season_names)

        self._committed(work)

    def follow(self, t: Tables, changed: DataFrame) -> None:
        """After the per-game tables of ``changed`` games (game_pk, is_final) were replaced: their days, and the seasons of final ones, in one commit."""
        days = t.games.join(changed.select("game_pk"), "game_pk", "left_semi")
        finals = t.games.join(changed.filter("is_final").select("game_pk"), "game_pk", "left_semi").select("season")

        def work(batch) -> None:
            self._days(batch, t, days, rollups.DAY_ROLLUPS)
            if not finals.isEmpty():
                self._seasons(batch, t, finals, rollups.SEASON_ROLLUPS)

        self._committed(work)

    # -- reads --------------------------------------------------------------------------------------------------
    def day_rows(self, t: Tables, name: str, where) -> DataFrame:
        """Rows of a day rollup on the days that ``where`` (a condition on official_date) picks: stored ones where the day is covered, computed from
        the facts for the others.  If all are covered, no fact is read."""
        version = self.tables.version()
        covered = self.tables.read("covered_days", COVERED, version=version).filter(where).select(*DAY)
        open_days = t.games.filter(where).select(*DAY).distinct().join(covered, DAY, "left_anti")
        if name not in self.tables.manifest(version):
            return rollups.day_rollups(within(t, open_days, DAY), [name])[name]
        stored = self.tables.read(name, version=version).drop("span").filter(where)
        if open_days.isEmpty():
            return stored
        fresh = rollups.day_rollups(within(t, open_days, DAY), [name])[name]
        return stored.join(covered, DAY, "left_semi").unionByName(fresh.select(*stored.columns))

    def season_rows(self, t: Tables, name: str) -> DataFrame:
        """Rows of a season rollup: stored ones of covered seasons, and the others computed."""
        version = self.tables.version()
        covered = self.tables.read("covered_seasons", COVERED_SEASONS, version=version).select("season")
        open_seasons = t.games.select("season").distinct().join(covered, "season", "left_anti")
        if name not in self.tables.manifest(version):
            return rollups.season_rollups(within(t, open_seasons, ["season"]), [name])[name]
        stored = self.tables.read(name, version=version)
        if open_seasons.isEmpty():
            return stored
        fresh = rollups.season_rollups(within(t, open_seasons, ["season"]), [name])[name]
        return stored.join(covered, "season", "left_semi").unionByName(fresh.select(*stored.columns))


def within(t: Tables, keep: DataFrame, by: list[str]) -> Tables:
    """``t`` with the games of some days or seasons only; facts follow their games."""
    games = t.games.join(merged(keep.select(*by).distinct()), by, "left_semi")
    facts = {n: (lambda n=n: getattr(t, n).join(merged(games.select("game_pk")), "game_pk", "left_semi")) for n in ("plays", "pitches", "batting", "pitching", "game_teams")}
    return Tables(games=games, **facts, **{n: (lambda n=n: getattr(t, n)) for n in ("event_types", "players", "bios", "teams")})


class ProbableLog:
    """The append-only history of probable pitchers, with the latest row of each key beside it, in one commit each."""

    KEYS = ["game_pk", "side"]

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.tables, self.buckets = Snapshots(spark, root, BY), buckets

    def record(self, games: DataFrame, observed_at) -> None:
        """Appends the probables of ``games`` that differ from the latest recorded; only the side table is compared, never the history."""

        def work() -> None:
            with self.tables.begin() as batch:
                now = schedule.probables(games).withColumns({"observed_at": observed_at, "bucket": F.pmod(F.xxhash64(F.col("game_pk")), F.lit(self.buckets)).cast("int")})
                latest = batch.held("probables_latest", now.schema)
                new = batch.stage(schedule.append_if_changed(latest, now, self.KEYS, ["pitcher_id", "pitcher_name"], "observed_at"))
                parts = listed(new.select("bucket"))
                if parts:
                    batch.append("probables", new.drop("bucket"))
                    both = batch.held("probables_latest", now.schema, parts).unionByName(new)
                    batch.replace("probables_latest", latest_per_key(both, self.KEYS, [F.col("observed_at").desc()]), parts)
                    batch.commit()

        again(work)

    def history(self) -> DataFrame:
        return self.tables.read("probables")


def upsert_latest(tables: Snapshots, name: str, rows: DataFrame, keys: list[str], seq: str, buckets: int = 64) -> None:
    """The latest row of each key, kept in ``name`` (partitioned by bucket): only buckets with a key that changed are written."""

    def work() -> None:
        with tables.begin() as batch:
            number = F.pmod(F.xxhash64(*(F.col(k) for k in keys)), F.lit(buckets)).cast("int")
            new = batch.stage(latest_state(rows, keys, seq).withColumn("bucket", number))
            held = batch.held(name, new.schema, listed(new.select("bucket")))
            old = held.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(seq).alias("_seq"))
            same = F.lit(True)
            for k in keys:
                same = same & (F.col(k) == F.col(f"_{k}"))
            changed = new.join(old, same & (F.col("_seq") >= F.col(seq)), "left_anti")
            parts = listed(changed.select("bucket"))
            if parts:
                batch.replace(name, latest_state(batch.held(name, new.schema, parts).unionByName(new.join(changed.select("bucket").distinct(), "bucket", "left_semi")), [*keys, "bucket"], seq).select(*new.columns), parts)
                batch.commit()

    again(work)
