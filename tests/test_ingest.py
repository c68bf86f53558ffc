"""The incremental path equals a rebuild, in any order of arrival, and shows each batch whole or not at all."""

import json
import os

import pytest
from pyspark.sql import functions as F

from scorebook.plans import leaders, rollups
from scorebook.sources import derive, feeds
from scorebook.sources.snapshots import Batch, Conflict, Snapshots
from scorebook.streaming import live
from scorebook.streaming.ingest import GameStore, ProbableLog, RollupStore, refresh_players, upsert_latest
from scorebook.tables import Tables
from tests_feed import feed, pitch, play


@pytest.fixture(scope="module", autouse=True)
def small(spark):
    """These tables are tiny: few partitions, and no time spent on compiling plans."""
    saved = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.codegen.wholeStage")}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    yield
    for k, v in saved.items():
        spark.conf.set(k, v)


@pytest.fixture
def few(monkeypatch):
    """Four of the per-game tables: enough to see that they change together."""
    monkeypatch.setattr(derive, "TABLES", {n: derive.TABLES[n] for n in ("plays", "pitches", "batting", "bios")})


def rows(store, name, cols):
    return sorted(tuple(r) for r in store.read(name).select(*cols).collect())


def state(store):
    return rows(store, "plays", ["game_pk", "at_bat_index"]), rows(store, "pitches", ["game_pk", "at_bat_index", "pitch_index"]), rows(store, "feeds_final", ["game_pk", "feed_ts"]), rows(store, "batting", ["game_pk", "side"])


def land(spark, *docs):
    return spark.createDataFrame([(d[0] if isinstance(d, tuple) else d, f"file {i}") for i, d in enumerate(docs)], "json string, source string")


OLD = feed(1, "20260401_100000", "I", [play(0, events=[pitch(0)])])
NEW = feed(1, "20260401_110000", "F", [play(0, events=[pitch(0)]), play(1, events=[pitch(0), pitch(1)])])
OTHER = feed(2, "20260401_100000", "F", [play(0, events=[pitch(0)])])


def test_versions_and_order(spark, tmp_path, few):
    found = []
    for n, order in enumerate(([(OLD,), (NEW, OTHER)], [(NEW, OTHER), (OLD,)])):
        store = GameStore(spark, f"file://{tmp_path}/s{n}")
        for docs in order:
            store.ingest(land(spark, *docs))
        found.append(state(store))
    assert found[0] == found[1]
    assert found[0][0] == [(1, 0), (1, 1), (2, 0)] and found[0][2] == [(1, "20260401_110000"), (2, "20260401_100000")]


def test_batch_that_breaks_between_tables_changes_nothing(spark, tmp_path, monkeypatch, few):
    store = GameStore(spark, f"file://{tmp_path}/s")
    store.ingest(land(spark, OLD, OTHER))
    before, version = state(store), store.tables.version()
    write = Batch._write

    def broken(self, name, rows):
        if name == "batting":
            raise OSError("lost")
        write(self, name, rows)

    monkeypatch.setattr(Batch, "_write", broken)
    with pytest.raises(OSError):
        store.ingest(land(spark, NEW))
    assert state(store) == before and store.tables.version() == version  # plays were written, and nobody sees them
    monkeypatch.setattr(Batch, "_write", write)
    store.ingest(land(spark, NEW))
    assert state(store)[0] == [(1, 0), (1, 1), (2, 0)] and not os.listdir(f"{tmp_path}/s/_work")
    # the leftovers of the broken batch go, tables stay
    now = state(store)
    assert store.tables.vacuum(1) > 0 and state(store) == now and store.tables.vacuum(1) == 0


def test_broken_rule_refuses_the_whole_batch(spark, tmp_path, few):
    store = GameStore(spark, f"file://{tmp_path}/s")
    store.ingest(land(spark, OLD))
    before = state(store)
    bad = feed(2, "20260401_100000", "F", [play(0, half="sideways", events=[pitch(0)])])
    with pytest.raises(ValueError, match="half"):
        store.ingest(land(spark, NEW, bad))
    assert state(store) == before


def test_quarantine_keeps_each_refused_document_once(spark, tmp_path, few):
    store = GameStore(spark, f"file://{tmp_path}/s")
    undated = NEW[0].replace("timeStamp", "stamp")
    for _ in range(2):
        store.ingest(land(spark, NEW, "{broken", "", undated, undated))
    assert rows(store, "quarantine", ["reason"]) == [("empty",), ("no JSON",), ("no feed_ts",)]
    assert {("empty", "file 2"), ("no JSON", "file 1")} <= set(rows(store, "quarantine", ["reason", "source"]))
    assert rows(store, "plays", ["game_pk"]) == [(1,), (1,)]
    good, bad = feeds.split_valid(land(spark, NEW, "{broken", ""))
    assert good.count() + bad.count() == 3


def test_commits_of_others(spark, tmp_path):
    tables = Snapshots(spark, f"file://{tmp_path}/t", {"a": ["k"], "b": []})
    df = spark.range(4).select((F.col("id") % 2).cast("int").alias("k"), "id")
    with tables.begin() as one, tables.begin() as two, tables.begin() as three:
        one.replace("a", df, [(0,), (1,)])
        two.append("b", df)
        three.replace("a", df.filter("k = 0"), [(0,)])
        assert one.commit() == 1 and two.commit() == 2  # different tables: both stay
        with pytest.raises(Conflict):
            three.commit()
    assert tables.read("a").count() == 4 and tables.read("b").count() == 4 and tables.version() == 2
    assert tables.read("a", version=1).count() == 4 and tables.parts("b", 1) == []
    kept = {f for f in tables.folders("a") if "k=1" in f}
    with tables.begin() as batch:
        batch.replace("a", df.filter("id < 0"), [(0,)])
        batch.commit()
    assert set(tables.folders("a")) == kept  # an empty partition goes, the other keeps its files
    for _ in range(3):
        with tables.begin() as batch:
            batch.MOST_FOLDERS = 2
            batch.append("b", df)
            batch.commit()
    assert tables.read("b").count() == 16 and len(tables.folders("b")) == 2


def test_stream_of_files_and_lookup(spark, tmp_path, few):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(feed(i, plays=[play(0, events=[pitch(0)])])[0])
    store = GameStore(spark, f"file://{tmp_path}/store")
    for _ in range(2):  # the second run finds nothing new
        live.run_batches(feeds.stream_documents(spark, f"file://{tmp_path}/in"), store.work(), f"file://{tmp_path}/checkpoint")
    assert rows(store, "plays", ["game_pk"]) == [(0,), (1,), (2,)] and store.tables.version() == 1
    assert json.loads(store.document(1).first()["json"])["gamePk"] == 1
    assert len(os.listdir(f"{tmp_path}/store/outbox")) == 1


def test_lookup_reads_one_row_group(spark, tmp_path):
    """Documents lie sorted by key, so a point filter's row groups are told apart by their statistics."""
    tables = Snapshots(spark, f"file://{tmp_path}/t", {"docs": ["season"]}, lookup={"docs": "game_pk"})
    df = spark.range(3000).select(F.col("id").alias("game_pk"), F.lit(2026).alias("season"), F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(700)), lambda i: F.sha2((F.col("id") * 1000 + i).cast("string"), 256))).alias("json")).repartition(8)
    with tables.begin() as batch:
        batch.replace("docs", df, [(2026,)])
        batch.commit()
    import pyarrow.parquet as pq

    groups, total = [], 0
    for folder, _, files in os.walk(f"{tmp_path}/t/docs"):
        for f in (f for f in files if f.endswith(".parquet")):
            meta = pq.ParquetFile(os.path.join(folder, f)).metadata
            for g in range(meta.num_row_groups):
                stats = meta.row_group(g).column(0).statistics
                groups.append((stats.min, stats.max, meta.row_group(g).num_rows))
                total += meta.row_group(g).num_rows
    assert total == 3000 and len(groups) > 4
    assert all(sum(lo <= k <= hi for lo, hi, _ in groups) <= 1 + 8 // 4 for k in range(0, 3000, 50))
    assert tables.read("docs").filter("game_pk = 1234").count() == 1


# ---- rollups ---------------------------------------------------------------------------------------------------------
def small_facts(spark, store, events):
    """Games of two days and seasons for the documents below."""
    g = spark.createDataFrame([(pk, season, day, "R", 1, 2, "F") for pk, season, day in GAMES], "game_pk long, season int, day string, game_type string, home_team_id int, away_team_id int, coded_state string")
    return store.facts(g.withColumn("official_date", F.to_date("day")).drop("day"), events)


GAMES = [(1, 2026, "2026-04-01"), (2, 2026, "2026-04-01"), (3, 2026, "2026-04-02"), (4, 2025, "2025-05-05")]


def on(pk, day, state="F", ts="120000", hits=1):
    doc = json.loads(feed(pk, f"20260401_{ts}", state, [play(i, events=[pitch(0), dict(pitch(1, hit={"launchSpeed": 99.0, "launchAngle": 28.0}), details={"call": {"code": "X"}, "isInPlay": True})]) for i in range(hits)])[0])
    doc["gameData"]["game"]["season"], doc["gameData"]["datetime"]["officialDate"] = day[:4], day
    return json.dumps(doc)


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame([("single", True, True, True, False, False, 1)], "event_type string, is_plate_appearance boolean, is_at_bat boolean, is_ball_in_play boolean, is_walk boolean, is_strikeout boolean, bases int")


def test_chained_streams_equal_a_rebuild_and_keep_other_days_files(spark, tmp_path, as_rows, events):
    root = f"file://{tmp_path}/s"
    store, rolled = GameStore(spark, root), RollupStore(spark, root)
    facts = lambda: small_facts(spark, store, events)
    store.put_games(facts().games)
    (tmp_path / "in").mkdir()
    put = lambda name, doc: (tmp_path / "in" / name).write_text(doc)
    run = lambda: store.run(feeds.stream_documents(spark, f"file://{tmp_path}/in"), rolled, facts, f"file://{tmp_path}/c")
    for pk, _, day in GAMES:
        put(f"{pk}.json", on(pk, day))
    run()
    covered = rows(rolled, "covered_days", ["season", "official_date"])
    assert len(covered) == 3 and len(rows(rolled, "covered_seasons", ["season"])) == 2
    files = set(rolled.tables.folders("batted_ball_days"))
    put("3b.json", on(3, "2026-04-02", ts="130000", hits=3))  # a later version of one game
    run()
    now = set(rolled.tables.folders("batted_ball_days"))
    assert len(files & now) == 2 and len(files - now) == 1  # the files of the other days keep their names
    fresh = RollupStore(spark, f"file://{tmp_path}/again")
    fresh.rebuild(facts())
    for name in (*rollups.DAY_ROLLUPS, *rollups.SEASON_ROLLUPS):
        got = rolled.read(name)
        assert as_rows(got) == as_rows(fresh.read(name).select(got.columns)), name
    assert [r["batted_balls"] for r in rolled.read("batted_ball_days").filter("official_date = '2026-04-02'").collect()] == [1, 1, 1]

    # reads: all days covered, so no fact is read; then one is open
    t = facts()
    seen = []
    spied = Tables(**{n: (lambda n=n: seen.append(n) or getattr(t, n)) for n in ("plays", "pitches", "games", "event_types", "players", "bios", "game_teams", "batting", "pitching")})
    read = lambda tables, stored: as_rows(leaders.barrel_rates(tables, "2026-04-01", "2026-04-30", per_day=0.1, stored=stored))
    want = read(facts(), None)
    assert read(spied, rolled) == want and not {"plays", "pitches"} & set(seen)
    assert as_rows(leaders.season_percentiles(spied, "batter", 0.1, stored=rolled)) == as_rows(leaders.season_percentiles(facts(), "batter", 0.1)) and not {"plays", "pitches"} & set(seen)
    store.ingest(land(spark, on(3, "2026-04-02", ts="140000", hits=5)))  # not followed yet
    assert len(rows(rolled, "covered_days", ["season"])) == 2 and len(rows(rolled, "covered_seasons", ["season"])) == 1
    t = facts()
    assert read(facts(), rolled) == read(facts(), None) != want
    assert as_rows(rolled.season_rows(facts(), "team_season_pitching")) == as_rows(rollups.team_season_pitching(facts()).select(rolled.read("team_season_pitching").columns))


def test_debounced_arrivals(spark, tmp_path):
    """A burst is given out once, after its quiet time, and nothing is late."""
    import time

    (tmp_path / "in").mkdir()
    got = []
    df = spark.readStream.schema("game_pk long").json(f"file://{tmp_path}/in")
    q = live.start_batches(live.debounce_arrivals(df, "game_pk", quiet_s=2, most_s=30), lambda b, _: got.extend((r["game_pk"], r["events"]) for r in b.collect()), f"file://{tmp_path}/c", "300 milliseconds")
    try:
        for n in range(2):
            (tmp_path / "in" / f"{n}.json").write_text('{"game_pk": 7}\n{"game_pk": 7}\n')
            time.sleep(0.2)
        until = time.time() + 60
        while time.time() < until and sum(n for _, n in got) < 4:
            time.sleep(0.3)
    finally:
        q.stop()
    assert {k for k, _ in got} == {7} and sum(n for _, n in got) == 4 and len(got) <= 2


def test_players_follow_their_games(spark, tmp_path, few):
    store = GameStore(spark, f"file://{tmp_path}/s")
    bio = lambda pk, day, weight, ts: json.dumps({**(d := json.loads(on(pk, day, ts=ts))), "gameData": {**d["gameData"], "players": {"ID7": {"id": 7, "fullName": "Seven", "weight": weight}}}})
    weight = lambda: [tuple(r) for r in store.tables.read("players").select("game_pk", "weight").collect()]
    store.ingest(land(spark, bio(4, "2025-05-05", 80, "1"), bio(1, "2026-04-01", 90, "1")))
    assert weight() == [(1, 90)]
    store.ingest(land(spark, bio(3, "2026-04-20", 95, "1")))
    assert weight() == [(3, 95)]
    store.ingest(land(spark, bio(3, "2024-04-20", 70, "2")))  # the newest game moved before the others: picked again from all bios
    assert weight() == [(1, 90)]


def test_refresh_players(spark, as_rows):
    schema = "player_id int, game_pk int, source_date string, game_number int, weight int"
    bios = spark.createDataFrame([(1, 10, "2025", 1, 80), (1, 11, "2026", 1, 84), (2, 10, "2025", 1, 70)], schema)
    players = spark.createDataFrame([(1, 12, "2027", 1, 99), (2, 10, "2025", 1, 70)], schema)
    got = refresh_players(players, bios, spark.createDataFrame([(12,)], "game_pk int"))
    assert as_rows(got.select("player_id", "weight")) == [(1, 84), (2, 70)]


def test_latest_rows_write_changed_buckets_only(spark, tmp_path):
    tables = Snapshots(spark, f"file://{tmp_path}/t", {"latest": ["bucket"]})
    put = lambda *r: upsert_latest(tables, "latest", spark.createDataFrame(r, "k long, seq long, v string"), ["k"], "seq", 8)
    put(*((k, 5, "a") for k in range(40)))
    files = set(tables.folders("latest"))
    put((3, 6, "b"), (4, 4, "old"))  # one key is newer, one older
    now = set(tables.folders("latest"))
    assert len(files - now) == 1 and {r["v"] for r in tables.read("latest").filter("k IN (3, 4)").collect()} == {"a", "b"} and tables.read("latest").count() == 40
    version = tables.version()
    put((3, 6, "b"))
    assert tables.version() == version


def test_probable_log(spark, tmp_path, as_rows):
    log = ProbableLog(spark, f"file://{tmp_path}/p")
    cols = "game_pk long, home_probable_id int, away_probable_id int, home_probable_name string, away_probable_name string"
    for at, row in enumerate([(1, 5, None, "a", None), (1, 5, None, "a", None), (1, None, 6, None, "b")]):
        log.record(spark.createDataFrame([row], cols), F.lit(at))
    assert as_rows(log.history().select("side", "pitcher_id", "observed_at")) == [("away", 6, 2), ("home", None, 2), ("home", 5, 0)]
    assert log.tables.read("probables_latest").count() == 2 and len(log.tables.folders("probables")) == 2


def test_pitches_need_no_shuffle(spark):
    g = feeds.parsed(feeds.split_valid(land(spark, NEW))[0])
    assert "Exchange" not in derive.pitches(g)._jdf.queryExecution().executedPlan().toString()
