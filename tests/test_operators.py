"""Generic operators on small tables, with ties, nulls, repeated rows and empty input."""

import pytest
from pyspark.sql import functions as F

from scorebook.operators import changes as C
from scorebook.operators import core


def test_latest_per_key_and_topn(spark, as_rows):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 1, None), (None, 2, "n")], "k int, v int, s string")
    assert as_rows(core.latest_per_key(df, ["k"], [F.col("v").desc()])) == [(None, 2, "n"), (1, 7, "b"), (2, 1, None)]
    ties = spark.createDataFrame([(1, 9), (1, 9), (1, 8), (1, 7)], "k int, v int")
    assert as_rows(core.topn_per_group(ties, ["k"], [F.col("v").desc()], 2, "r")) == [(1, 9, 1), (1, 9, 1)]
    assert core.latest_per_key(df.limit(0), ["k"], [F.col("v")]).count() == 0


def test_asof_left_join(spark, as_rows):
    left = spark.createDataFrame([(1, 1994), (1, 1995), (1, 1999), (2, 2000)], "team int, season int")
    right = spark.createDataFrame([(1, 1995, "A"), (1, 1998, "B")], "team int, since int, name string")
    assert as_rows(core.asof_left_join(left, right, ["team"], "season", "since")) == [(1, 1994, None), (1, 1995, "A"), (1, 1999, "B"), (2, 2000, None)]


def test_sides_streak_and_rolling(spark, as_rows):
    g = spark.createDataFrame([(1, 10, 20, 3, 1), (2, 20, 10, 2, 2), (3, 10, 20, 4, 0), (4, 10, 20, None, None)], "game_pk int, home_team_id int, away_team_id int, home_score int, away_score int")
    sides = core.unpivot_sides(g, ["game_pk"])
    assert sides.filter("team_id = 10").count() == 4
    assert [r["won"] for r in sides.filter("team_id = 20").orderBy("game_pk").collect()] == [False, False, False, None]  # a tie is not won
    streak = core.current_streak(sides, ["team_id"], [F.col("game_pk").desc()], "won")
    assert as_rows(streak) == [(10, True, 1), (20, False, 3)]
    diff = sides.filter("won IS NOT NULL").withColumn("d", F.col("runs_for") - F.col("runs_against"))
    out = core.running_and_rolling(diff, ["team_id"], ["game_pk"], "d", 2).filter("team_id = 10").orderBy("game_pk")
    assert [(r["cumulative"], r["rolling"]) for r in out.collect()] == [(2, 2), (2, 2), (6, 4)]


def test_splits_rollup_share_and_percentiles(spark, as_rows):
    df = spark.createDataFrame([(1, "x", 2.0), (1, None, 4.0), (2, "x", None)], "t int, s string, v double")
    assert as_rows(core.explode_splits(df, [F.lit("all"), F.col("s")]).groupBy("split").count()) == [("all", 3), ("x", 2)]
    out = core.scoped_rollup(df, [["t"], []], [F.count("*").alias("n")])
    assert as_rows(out.select("t", "n", "_g_t")) == [(None, 3, 1), (1, 2, 0), (2, 1, 0)]
    assert as_rows(core.with_share(out.filter("_g_t = 0").select("t", "n"), "n")) == [(1, 2, pytest.approx(2 / 3)), (2, 1, pytest.approx(1 / 3))]
    p = core.qualified_percentiles(df.withColumn("q", F.lit(True)), {"a": (F.col("v"), "higher"), "b": (F.col("v"), "lower")}, F.col("q"))
    assert as_rows(p.select("v", "a_percentile", "b_percentile")) == [(None, None, None), (2.0, 0, 100), (4.0, 100, 0)]


def test_weighted_and_previous_and_groups(spark, as_rows):
    df = spark.createDataFrame([(1, 90.0, 1), (1, None, 5), (1, 100.0, 3)], "k int, v double, w int")
    assert as_rows(core.weighted_rollup(df, ["k"], ["w"], {"v": "w"})) == [(1, 9, 97.5)]
    seq = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "a"), (1, 5, None)], "k int, i int, x string")
    assert [r["p"] for r in core.with_previous(seq, ["k"], ["i"], {"p": "x"}, {"p": "-"}).orderBy("i").collect()] == ["-", "a", "a", "b", "a"]
    assert [r["g"] for r in core.contiguous_groups(seq, ["k"], ["i"], ["x"], "g").orderBy("i").collect()] == [0, 0, 1, 2, 3]


def test_changed_rows_are_null_safe(spark, as_rows):
    old = spark.createDataFrame([(1, None, "a"), (2, 5, "b"), (3, 6, None)], "k int, v int, s string")
    new = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, 6, "c"), (4, 1, None)], "k int, v int, s string")
    assert as_rows(C.changed_rows(old, new, ["k"])) == [(2, None, "b"), (3, 6, "c"), (4, 1, None)]
    state, changed = C.upsert_changed(old, new, ["k"])
    assert state.count() == 4 and changed.count() == 3
    assert as_rows(C.upsert_changed(state, new, ["k"])[1]) == []  # again: nothing changes
    assert as_rows(C.substitute_rows(old, new, ["k"])) == [(1, None, "a"), (2, None, "b"), (3, 6, "c")]


def test_store_feeds_versions(spark, as_rows):
    schema = "k int, v string, body string"
    final = spark.createDataFrame([(1, "20260101_1", "old")], schema)
    live = spark.createDataFrame([(2, "20260101_5", "live2"), (3, "20260101_1", "live3")], schema)
    batch = spark.createDataFrame([(1, "20260101_0", "older", True), (2, "20260101_6", "final2", True), (3, "20260101_1", "same", False), (4, "20260101_1", "new", False), (1, "20260101_2", "resumed", False)], schema + ", f boolean")
    new_final, new_live, stored = C.store_feeds(final, live, batch, "k", "v", "f")
    assert as_rows(new_final) == [(1, "20260101_1", "old"), (2, "20260101_6", "final2")]
    assert as_rows(new_live) == [(1, "20260101_2", "resumed"), (3, "20260101_1", "live3"), (4, "20260101_1", "new")]
    assert as_rows(stored) == [(1,), (2,), (4,)]
    assert as_rows(C.newer_of_two(new_final, new_live, "k", "v").select("k", "body")) == [(1, "resumed"), (2, "final2"), (3, "live3"), (4, "new")]


def test_append_patch_checks(spark, as_rows):
    history = spark.createDataFrame([(1, "home", 7, 1), (1, "home", 8, 2), (2, "home", 9, 1)], "g int, side string, p int, at int")
    now = spark.createDataFrame([(1, "home", 8, 3), (2, "home", None, 3), (3, "home", None, 3), (4, "home", 5, 3)], "g int, side string, p int, at int")
    assert as_rows(C.append_if_changed(history, now, ["g", "side"], ["p"], "at")) == [(2, "home", None, 3), (4, "home", 5, 3)]
    snap = spark.createDataFrame([(1, 5, "x"), (2, 6, "y")], "g int, runs int, s string")
    state = C.latest_state(spark.createDataFrame([(1, None, 2), (1, 4, 1)], "g int, runs int, seq int"), ["g"], "seq")
    assert as_rows(C.patch(snap, state, ["g"], ["runs"])) == [(1, None, "x"), (2, 6, "y")]
    bad = spark.createDataFrame([(1, "top"), (1, "sideways"), (None, "top")], "k int, half string")
    assert as_rows(C.check_constraints(bad, ["k"], ["k"], {"half": ("top", "bottom")})) == [("domain:half", 1), ("null:k", 1), ("unique:k", 1)]
    with pytest.raises(ValueError):
        C.require(bad, domains={"half": ("top", "bottom")})
    dim = spark.createDataFrame([("top",)], "half string")
    assert as_rows(C.unknown_values(bad, dim, "half")) == [("sideways",)]
