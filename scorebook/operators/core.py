"""Relational building blocks that SQL lacks a single word for.  All are lazy and distributed over their keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def _window(keys: Keys, order: Sequence[Column | str] = ()):
    w = Window.partitionBy(*keys)
    return w.orderBy(*order) if order else w


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is sorted and merged, never broadcast.

    The planner takes the size of compressed files for the size of rows: ten million games in narrow columns look like less than
    10 MB, and would pass the driver.  For facts and whole tables of keys; small dimensions need it not.
    """
    return df.hint("merge")


def latest_per_key(df: DataFrame, keys: Keys, order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``.  The rank filter is pushed below the shuffle by Spark's group limit."""
    return df.withColumn("_n", F.row_number().over(_window(keys, order))).filter("_n = 1").drop("_n")


def topn_per_group(df: DataFrame, keys: Keys, order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """Rows whose rank in ``order`` is at most ``n``; ties share a rank."""
    ranked = df.withColumn("_r", F.rank().over(_window(keys, order))).filter(F.col("_r") <= n)
    return ranked.withColumnRenamed("_r", rank) if rank else ranked.drop("_r")


def asof_left_join(left: DataFrame, right: DataFrame, on: Keys, left_time: str, right_time: str) -> DataFrame:
    """Each left row with the right row of the same keys and the latest ``right_time`` not after ``left_time``.

    The right side becomes intervals by ``lead``, so the join is an equi join with a range residual and keeps one row
    per left row without a sort of the left side.  ``right`` has one row for each key and time.
    """
    until = F.lead(right_time).over(_window(on, [right_time]))
    r = right.withColumn("_until", until).withColumnRenamed(right_time, "_from")
    r = r.select(*(F.col(k).alias(f"_r_{k}") for k in on), *(c for c in r.columns if c not in on))
    matched = [F.col(k) == F.col(f"_r_{k}") for k in on]
    inside = (F.col(left_time) >= F.col("_from")) & (F.col("_until").isNull() | (F.col(left_time) < F.col("_until")))
    condition = inside
    for m in matched:
        condition = m & condition
    return left.join(r, condition, "left").drop("_from", "_until", *(f"_r_{k}" for k in on))


def unpivot_sides(games: DataFrame, keep: Keys = ()) -> DataFrame:
    """Two rows for each game, one for each team, with runs for and against and ``won`` (a tie is not won; null scores give null)."""

    def side(own: str, other: str) -> Column:
        return F.struct(
            F.col(f"{own}_team_id").alias("team_id"),
            F.col(f"{other}_team_id").alias("opponent_id"),
            F.lit(own == "home").alias("is_home"),
            F.col(f"{own}_score").alias("runs_for"),
            F.col(f"{other}_score").alias("runs_against"),
            (F.col(f"{own}_score") > F.col(f"{other}_score")).alias("won"),
        )

    return games.select(*keep, F.inline(F.array(side("home", "away"), side("away", "home"))))


def explode_splits(df: DataFrame, splits: Sequence[Column], name: str = "split") -> DataFrame:
    """One row for each group that a row belongs to; null memberships are dropped."""
    return df.withColumn(name, F.explode(F.array_compact(F.array(*splits))))


def scoped_rollup(df: DataFrame, sets: Sequence[Keys], measures: Sequence[Column]) -> DataFrame:
    """Aggregates over grouping sets, with ``_g_<key>`` = 1 where a key is rolled up."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    marks = [F.grouping(k).alias(f"_g_{k}") for k in keys]
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(*measures, *marks)


def running_and_rolling(df: DataFrame, keys: Keys, order: Sequence[Column], value: str, n: int) -> DataFrame:
    """Adds ``cumulative`` and ``rolling`` (this row and the n-1 before) sums of ``value``."""
    w = _window(keys, order)
    return df.withColumns(
        {
            "cumulative": F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "rolling": F.sum(value).over(w.rowsBetween(-(n - 1), 0)),
        }
    )


def current_streak(df: DataFrame, keys: Keys, latest_first: Sequence[Column], flag: str) -> DataFrame:
    """(keys, flag, length) of the leading run of equal flags, latest row first.  Null flags take no part.

    The run ends where the number of changes so far leaves 0, so no arrays are collected.
    """
    w = _window(keys, latest_first)
    rows = df.filter(F.col(flag).isNotNull())
    change = (F.col(flag) != F.lag(flag).over(w)).cast("int")
    rows = rows.withColumn("_c", F.coalesce(change, F.lit(0)))
    rows = rows.withColumn("_c", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter("_c = 0").groupBy(*keys, flag).agg(F.count("*").alias("length"))


def qualified_percentiles(df: DataFrame, stats: dict[str, tuple[Column, str]], qualifier: Column, keys: Keys = ()) -> DataFrame:
    """Value and rounded percentile rank of each statistic among the rows that qualify; a null value has no percentile.

    ``stats`` maps a name to (value, 'higher' or 'lower' is better); ``keys`` divide the pools.
    """
    out = df.filter(qualifier).withColumns({k: v.cast("double") for k, (v, _) in stats.items()})
    for k, (_, better) in stats.items():
        w = Window.partitionBy(*keys, F.col(k).isNull()).orderBy(F.col(k).asc() if better == "higher" else F.col(k).desc())
        out = out.withColumn(f"{k}_percentile", F.when(F.col(k).isNotNull(), F.round(100 * F.percent_rank().over(w)).cast("int")))
    return out


def with_share(df: DataFrame, count: str, keys: Keys = (), name: str = "share") -> DataFrame:
    """Adds each row's share of the sum of ``count`` over its keys."""
    total = F.sum(count).over(_window(keys))
    return df.withColumn(name, F.when(total > 0, F.col(count) / total))


def weighted_rollup(df: DataFrame, keys: Keys, sums: Sequence[str], means: dict[str, str]) -> DataFrame:
    """Sums, and means of ``value`` weighted by ``weight`` that skip rows without a value."""
    weighted = [
        F.try_divide(F.sum(F.col(v) * F.col(w)), F.sum(F.when(F.col(v).isNotNull(), F.col(w)).cast("double"))).alias(v)
        for v, w in means.items()
    ]
    return df.groupBy(*keys).agg(*(F.sum(s).alias(s) for s in sums), *weighted)


def with_previous(df: DataFrame, keys: Keys, order: Sequence[Column | str], columns: dict[str, str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Adds the previous row's value of columns under new names ({new: column}), or the default."""
    w = _window(keys, order)
    add = {}
    for new, old in columns.items():
        v = F.lag(old).over(w)
        add[new] = F.coalesce(v, F.lit(defaults[new])) if defaults and new in defaults else v
    return df.withColumns(add)


def contiguous_groups(df: DataFrame, keys: Keys, order: Sequence[Column | str], by: Keys, name: str) -> DataFrame:
    """Numbers the contiguous runs of equal ``by`` values, from 0."""
    w = _window(keys, order)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    changed = F.when(F.row_number().over(w) == 1, 0).otherwise((~same).cast("int"))
    return df.withColumn("_d", changed).withColumn(name, F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")
