"""Change detection, versioned upserts, replacement by key, and checks.

Each returns the new state as a DataFrame; the caller stages it, checks it and swaps the touched partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import merged

Keys = Sequence[str]


def _differs(columns: Keys, a: str, b: str) -> Column:
    return ~F.struct(*(F.col(f"{a}.{c}") for c in columns)).eqNullSafe(F.struct(*(F.col(f"{b}.{c}") for c in columns)))


def changed_rows(previous: DataFrame, incoming: DataFrame, keys: Keys) -> DataFrame:
    """Incoming rows that are new or differ in any column, nulls being equal to nulls."""
    rest = [c for c in incoming.columns if c not in keys]
    a, b = incoming.alias("a"), previous.select(*keys, *rest).withColumn("_there", F.lit(True)).alias("b")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(merged(b), on, "left").filter(F.col("b._there").isNull() | _differs(rest, "a", "b")).select("a.*")


def replace_by_key(existing: DataFrame, new: DataFrame, keys: Keys) -> DataFrame:
    """``existing`` without the rows of the keys in ``new``, and ``new``."""
    return existing.join(merged(new.select(*keys).distinct()), list(keys), "left_anti").unionByName(new)


def substitute_rows(rows: DataFrame, replacements: DataFrame, keys: Keys) -> DataFrame:
    """Rows with those of the same key in ``replacements`` put in their place; replacements for absent keys are ignored."""
    there = rows.select(*keys).distinct()
    return rows.join(merged(replacements.select(*keys).distinct()), list(keys), "left_anti").unionByName(replacements.join(merged(there), list(keys), "left_semi"))


def upsert_changed(existing: DataFrame, incoming: DataFrame, keys: Keys) -> tuple[DataFrame, DataFrame]:
    """(new state, changed rows): only changed rows replace existing ones."""
    changed = changed_rows(existing, incoming, keys)
    return replace_by_key(existing, changed, keys), changed


def versioned_upsert(existing: DataFrame, other: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """The newest version of each key among ``existing`` and those of ``incoming`` that ``other`` does not cover.

    ``other`` covers what it has at the same version or later; of equal versions the existing row stays.  Arrival
    order does not matter.
    """
    o = other.select(F.col(key).alias("_k"), F.col(version).alias("_v"))
    fresh = incoming.join(merged(o), (F.col(key) == F.col("_k")) & (F.col("_v") >= F.col(version)), "left_anti")
    both = existing.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col(version).desc(), F.col("_new"))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").withColumnRenamed("_new", "_stored").withColumn("_stored", F.col("_stored") == 1)


def store_feeds(final: DataFrame, live: DataFrame, incoming: DataFrame, key: str, version: str, is_final: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(final table, live table, stored keys) after a batch: finals first; a stored final deletes its live copy."""
    cols = final.columns
    f = versioned_upsert(final, live, incoming.filter(is_final).select(*cols), key, version)
    new_final, stored_final = f.drop("_stored"), f.filter("_stored").select(key)
    live_left = live.join(merged(stored_final), key, "left_anti")
    v = versioned_upsert(live_left, new_final, incoming.filter(~F.col(is_final)).select(*cols), key, version)
    return new_final, v.drop("_stored"), stored_final.union(v.filter("_stored").select(key)).distinct()


def newer_of_two(a: DataFrame, b: DataFrame, key: str, version: str) -> DataFrame:
    """One row for each key: ``a`` wins unless ``b`` has the same version or a later one."""
    def uncovered(x: DataFrame, y: DataFrame, cover) -> DataFrame:
        o = y.select(F.col(key).alias("_k"), F.col(version).alias("_v"))
        return x.join(merged(o), (F.col(key) == F.col("_k")) & cover(F.col("_v"), F.col(version)), "left_anti")

    return uncovered(a, b, lambda v, own: v >= own).unionByName(uncovered(b, a, lambda v, own: v > own))


def append_if_changed(history: DataFrame, current: DataFrame, keys: Keys, values: Keys, observed_at: str) -> DataFrame:
    """The rows to append: current values that differ from the latest recorded ones.  A first all-null value is not recorded."""
    w = Window.partitionBy(*keys).orderBy(F.col(observed_at).desc())
    last = history.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(v).alias(f"_{v}") for v in values))
    on, same = F.lit(True), F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"_{v}"))
    return current.join(merged(last), on, "left").filter(~same).select(*current.columns)


def latest_state(log: DataFrame, keys: Keys, seq: str) -> DataFrame:
    """The last message of each key, by partial aggregation (no sort)."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_s")).select(*keys, "_s.*")


def patch(snapshot: DataFrame, state: DataFrame, keys: Keys, columns: Keys) -> DataFrame:
    """``snapshot`` with ``columns`` taken from ``state`` where it has the key, even if they are null there."""
    s = state.select(*keys, F.struct(*columns).alias("_s"))
    joined = snapshot.join(merged(s), list(keys), "left")
    return joined.select(*(F.when(F.col("_s").isNotNull(), F.col(f"_s.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in snapshot.columns))


def snapshot_diff(previous: DataFrame, following: DataFrame, keys: Keys) -> DataFrame:
    """Rows of ``following`` that are new or changed since ``previous``."""
    return changed_rows(previous, following, keys)


def reconcile(a: DataFrame, b: DataFrame, keys: Keys, columns: Keys) -> DataFrame:
    """Keys of ``a`` whose columns differ from those of ``b``, with both values."""
    x = b.select(*keys, *(F.col(c).alias(f"other_{c}") for c in columns))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"other_{c}"))
    return a.select(*keys, *columns).join(merged(x), list(keys), "left").filter(~same)


def unknown_values(df: DataFrame, dim: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``column`` that the dimension lacks."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().join(dim.select(column), column, "left_anti")


def check_constraints(df: DataFrame, not_null: Keys = (), unique: Keys = (), domains: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(rule, violations) of one batch: null columns, repeated keys, values outside their domain."""
    counts = [F.count_if(F.col(c).isNull()).alias(f"null:{c}") for c in not_null]
    counts += [F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(list(d))).alias(f"domain:{c}") for c, d in (domains or {}).items()]
    out = df.agg(*counts).unpivot([], [F.col(f"`{c}`") for c in [f"null:{x}" for x in not_null] + [f"domain:{x}" for x in (domains or {})]], "rule", "violations") if counts else None
    if unique:
        again = df.groupBy(*unique).count().filter("count > 1").agg(F.count("*").alias("violations")).select(F.lit("unique:" + ",".join(unique)).alias("rule"), "violations")
        out = again if out is None else out.unionByName(again)
    return out


def require(df: DataFrame, **rules) -> DataFrame:
    """``df`` itself if no rule is violated, else an error, so that the old rows stay."""
    broken = check_constraints(df, **rules).filter("violations > 0").collect()  # a row for each rule at most
    if broken:
        raise ValueError("constraint violations: " + ", ".join(f"{r['rule']} ({r['violations']})" for r in broken))
    return df
