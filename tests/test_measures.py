"""Formulas and classifications."""

import pytest
from pyspark.sql import functions as F

from scorebook.functions import measures as M


def values(spark, columns, data, schema):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*columns).collect()]


def test_barrel_window(spark):
    data = [(98.0, 26.0), (98.0, 25.0), (105.0, 40.0), (116.0, 50.0), (97.9, 28.0)]
    assert [r[0] for r in values(spark, [M.is_barrel(F.col("s"), F.col("a"))], data, "s double, a double")] == [True, False, True, True, False]


def test_rates_and_zero_denominators(spark):
    schema = "hits int, at_bats int, walks int, hit_by_pitch int, sac_flies int, total_bases int"
    got = values(spark, [M.ratio("hits", "at_bats"), M.on_base(), M.ratio("total_bases", "at_bats")], [(3, 5, 1, 0, 0, 6), (0, 0, 0, 0, 0, 0)], schema)
    assert got == [(0.6, pytest.approx(4 / 6), 1.2), (None, None, None)]


def test_records(spark):
    got = values(spark, [M.expected_wins(F.col("s"), F.col("a"), F.col("g")), M.win_pct(F.col("g"), F.lit(0)), M.games_back(F.lit(1), F.lit(0), F.lit(3), F.lit(1))], [(15, 11, 4), (0, 0, 2)], "s int, a int, g int")
    assert got == [(3, 1.0, -0.5), (0, 1.0, -0.5)]


def test_text_and_status(spark):
    assert values(spark, [M.innings_text(F.col("o"))], [(10,), (9,), (0,)], "o int") == [("3.1",), ("3.0",), ("0.0",)]
    codes = [("S", "Preview", ""), ("P", "Preview", "Delayed Start"), ("I", "Live", "In Progress"), ("M", "Live", ""), ("F", "Final", ""), ("Q", "Final", ""), ("D", "Final", ""), ("T", "Preview", ""), ("T", "Live", ""), ("U", "Live", ""), ("C", "Final", ""), ("?", "Final", "")]
    got = values(spark, [M.game_status(F.col("c"), F.col("a")), M.status_note(F.col("c"), F.col("d"))], codes, "c string, a string, d string")
    assert got == [("scheduled", None), ("scheduled", "Delayed"), ("live", None), ("live", "Review"), ("final", None), ("final", "Forfeit"), ("postponed", None), ("scheduled", None), ("suspended", None), ("suspended", None), ("cancelled", None), ("final", None)]
    assert values(spark, [M.inning_label(F.col("i"), F.col("h"))], [(3, "Top"), (9, "bottom"), (None, "top"), (5, None)], "i int, h string") == [("Top 3",), ("Bot 9",), ("",), ("5",)]


def test_days_and_decisions(spark):
    got = values(spark, [F.date_format(M.range_start(k, F.to_date(F.lit("2026-09-28"))), "yyyy-MM-dd") for k in ("today", "week", "month", "season")], [(1,)], "x int")
    assert got == [("2026-09-28", "2026-09-22", "2026-08-30", "2026-01-01")]
    assert values(spark, [F.date_format(M.official_date(F.to_timestamp(F.lit("2026-07-22T02:10:00Z"))), "yyyy-MM-dd")], [(1,)], "x int") == [("2026-07-21",)]
    flags = "w boolean, l boolean, s boolean, b boolean, h boolean"
    cols = [F.col(c) for c in "wlsbh"]
    assert values(spark, [M.decision_label(*cols), M.decisions(cols[0], cols[1], cols[2], cols[4], cols[3])], [(False, False, True, True, True), (False, None, False, False, False)], flags) == [("S", ["S", "H", "BS"]), (None, [])]
    assert values(spark, [M.compared(F.col("a"), F.col("b"), "lower")], [(1, 2), (2, 1), (1, 1), (None, 1)], "a int, b int") == [("better",), ("worse",), ("even",), (None,)]
