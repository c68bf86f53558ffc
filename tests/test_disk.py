"""What large tables leave on disk: facts in buckets of games, so that documents and what is joined or grouped by game shuffle nothing."""

import pytest

from scorebook import queries, queries_more, testbed, testfeeds
from scorebook.sources import derive, feeds, sinks, snapshots
from scorebook.streaming import ingest

SF = "/root/testdata/sf0.001"
FACTS = ["games", "plays", "pitches", "linescores", "decisions", "batting", "pitching", "bios"]


@pytest.fixture
def large(monkeypatch):
    """The smallest tables are handled as large ones are, and facts made again."""
    monkeypatch.setattr(testbed, "BUCKETS_FROM", 1)
    monkeypatch.setattr(sinks, "_made", {})


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_of_large_tables_shuffle_nothing(spark, large):
    made = testfeeds.documents(spark, SF)
    assert "Exchange" not in plan(made) and "Join" in plan(made)


def test_large_facts_and_documents_have_the_same_rows(spark, monkeypatch):
    t, docs = testbed.tables(spark, SF), testfeeds.stored(spark, SF)
    small = {n: getattr(t, n) for n in FACTS}
    monkeypatch.setattr(testbed, "BUCKETS_FROM", 1)
    monkeypatch.setattr(sinks, "_made", {})
    t, again = testbed.tables(spark, SF), testfeeds.stored(spark, SF)
    for a, b in [*((small[n], getattr(t, n)) for n in FACTS), (docs, again)]:
        assert a.columns == b.columns and a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_lines_and_pitches_of_large_tables_are_joined_without_a_shuffle(spark, large):
    t = testbed.tables(spark, SF)
    for df in (t.pitches, t.batting, t.pitching, t.linescores):
        assert "Exchange" not in plan(df.join(t.games.select("game_pk", "official_date").hint("merge"), "game_pk").groupBy("game_pk").count())


def test_staged_tables_are_small_files(spark, tmp_path):
    out = sinks.staged(spark.range(10).coalesce(1), str(tmp_path), 4)
    assert len(out.inputFiles()) == 3 and all(f.endswith(".zstd.parquet") for f in out.inputFiles()) and out.count() == 10


def test_pitches_are_made_after_their_plays_met_the_games(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(testbed, "made_once", lambda session, key, make: made.setdefault(key[0], make()))
    _ = testbed.tables(spark, SF).pitches
    text = plan(made["pitches_"])
    assert text.index("Generate explode") < text.index("SortMergeJoin")


def test_landed_documents_are_compressed_files(spark, monkeypatch):
    seen = []
    real = feeds.read_documents
    monkeypatch.setattr(feeds, "read_documents", lambda session, path, *more: seen.append(path) or real(session, path, *more))
    found = queries.QUERIES["landed_documents"](spark, SF)
    files = spark.read.text(seen[0]).inputFiles()
    assert found.count() == testfeeds.stored(spark, SF).count() and all(f.endswith(".gz") for f in files) and len(files) > 1


def test_a_batch_parses_headers_once_and_joins_no_table_with_its_games(spark, monkeypatch):
    plans, real = {}, snapshots.Batch._write

    def write(batch, name, rows):
        plans[name] = plan(rows)
        real(batch, name, rows)

    monkeypatch.setattr(snapshots.Batch, "_write", write)
    store = ingest.GameStore(spark, queries_more._store(spark), 400)
    store.ingest(testfeeds.stored(spark, SF).filter("length(json) % 20 = 0"))
    assert store.read("plays").count() > 0 and store.read("plays").filter("span < 0 OR season IS NULL").isEmpty()
    assert "metaData" not in plans["quarantine"]
    assert {plans[n].count("Join") for n in derive.TABLES} == {1}  # with the games of the batch, whose old rows go
