"""Op 10: nearest neighbours by shifted space-filling curves.

Each of several curves has its own random rotation to a few dimensions and its own shift; a vector's key is its
place on a Hilbert curve over that box.  Spark range-partitions all vectors, as codes of one byte a component, by
(curve, key).  A query is laid into the same orders and compared with the vectors around it; what the curves find is
merged and ranked again by the exact measure on the original vectors.  The largest inner product becomes the least
distance by one more coordinate that lifts all vectors to the same length.

How far a window reaches is measured, not guessed: for a bounded pilot of queries the true neighbours are found
by scanning all vectors, and the window is the least that catches the share ``recall`` of them.  Its share of the table falls as
the table grows; how fast depends on the structure of the vectors.  Equal vectors are searched once, as a class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows of ``grid``, coordinates below 2 ** bits)."""
    x = grid.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns and mirrors of each level, from the coarsest
        p = q - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            x[high, 0] ^= p
            swap = (x[:, 0] ^ x[:, i]) & p
            swap[high] = 0
            x[:, 0] ^= swap
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t[(x[:, n - 1] & q) != 0] ^= q - 1
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


class Curves:
    """Rotations, boxes and shifts of all curves."""

    def __init__(self, sample: np.ndarray, longest: float, count: int, dims: int, bits: int):
        rng = np.random.default_rng(10)
        wide = sample.shape[1] + 1
        self.longest, self.bits, self.turns, self.low, self.size = longest, bits, [], [], []
        for _ in range(count):
            turn = np.linalg.qr(rng.normal(size=(wide, min(dims, wide))))[0]
            y = self.lifted(sample, False) @ turn
            low, high = np.quantile(y, [0.005, 0.995], axis=0)
            size = np.maximum(high - low, 1e-12) * 1.5
            self.turns.append(turn)
            self.low.append(low - rng.uniform(0, 1, len(low)) * size / 3)
            self.size.append(size)

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        norms = np.sqrt((x * x).sum(1))
        if query:
            return np.column_stack([x * (self.longest / norms)[:, None], np.zeros(len(x))])
        return np.column_stack([x, np.sqrt(np.maximum(self.longest**2 - norms**2, 0))])

    def keys(self, x: np.ndarray, query: bool) -> list[np.ndarray]:
        y, most = self.lifted(x, query), (1 << self.bits) - 1
        return [hilbert_keys(np.clip((y @ t - a) / s * (most + 1), 0, most).astype(np.int64), self.bits) for t, a, s in zip(self.turns, self.low, self.size)]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in column]) if len(column) else np.zeros((0, 1))


def window_for(apart: np.ndarray, recall: float) -> int:
    """Places to either side of a query that hold the share ``recall`` of true neighbours so far ``apart``."""
    return int(np.ceil(np.quantile(apart, recall))) + 1 if len(apart) else 1


def coded(x: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Vectors as signed bytes, and the scale of each: within half a scale of every component."""
    scale = np.maximum(np.abs(x).max(1), 1e-300) / 127
    return [r.tobytes() for r in np.rint(x / scale[:, None]).astype(np.int8)], scale


def nearest(vectors: DataFrame, queries, k: int = 20, **how) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each query, by largest inner product.

    ``vectors`` has vec_id and embedding; ``queries`` is a condition on vec_id.  Vectors that are null, zero, or hold
    null or non-finite components take no part, nor do rows without vec_id.  Of rows with one vec_id the least vector
    counts.  Vectors of each dimension are searched among their own.  Ties go to the smaller vec_id.  An empty table, or
    one without queries, gives no rows.  Other columns are ignored.
    """
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    ok = F.col("embedding").isNotNull() & F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull()).filter(ok).groupBy("vec_id").agg(F.min("embedding").alias("v"))
    rows = stage(rows, "vectors")
    out = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in rows.groupBy(F.size("v").alias("d")).count().collect():  # a row for each dimension that occurs
        out = out.unionByName(_search(rows.filter(F.size("v") == r["d"]), queries, k, **how))
    return out


def _search(rows: DataFrame, queries, k: int, curves: int = 32, dims: int = 8, bits: int = 7, recall: float = 0.95, pilot: int = 64, sample_rows: int = 4000, least_block: int = 256) -> DataFrame:
    """``nearest`` among vectors of one dimension.  ``sample_rows`` bounds the vectors that set the curves' boxes,
    ``pilot`` the queries that set the window; blocks are as wide as the window, ``least_block`` at least."""
    spark = rows.sparkSession
    classes = rows.groupBy("v").agg(F.min("vec_id").alias("cid"), F.count_if(queries(F.col("vec_id"))).alias("asks"))
    classes = stage(classes, "classes")
    members = rows.join(classes.select("v", "cid"), "v").select("cid", "vec_id")

    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    longest = float(np.sqrt(classes.agg(F.max(norm2)).first()[0]))
    sample = matrix(classes.orderBy(F.xxhash64("cid"), "cid").select("v").limit(sample_rows).toPandas()["v"])
    plan = Curves(sample, longest, curves, dims, bits)

    # pilot: true neighbours of a few queries
    some = classes.filter("asks > 0").orderBy(F.xxhash64("cid", F.lit(1)), "cid").select("cid", "v").limit(pilot).toPandas()
    if not len(some):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked, asked_ids = matrix(some["v"]), some["cid"].to_numpy()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top: list[tuple] = [(np.zeros(0), np.zeros(0, np.int64))] * len(asked)
        for pdf in batches:
            s, cid = asked @ matrix(pdf["v"]).T, pdf["cid"].to_numpy()
            for i in range(len(asked)):
                both, names = np.concatenate([top[i][0], s[i][cid != asked_ids[i]]]), np.concatenate([top[i][1], cid[cid != asked_ids[i]]])
                at = best(both, names, k)
                top[i] = both[at], names[at]
        yield pd.DataFrame({"q": np.repeat(asked_ids, [len(t[0]) for t in top]), "cid": np.concatenate([t[1] for t in top]), "score": np.concatenate([t[0] for t in top])})

    order = Window.partitionBy("q").orderBy(F.desc("score"), "cid")
    truth = classes.select("cid", "v").mapInPandas(scan, "q long, cid long, score double").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("q", "cid").toPandas()

    # all vectors, and the queries among them, in the order of every curve
    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, cid = matrix(pdf["v"]), pdf["cid"].to_numpy()
            q = pdf["asks"].to_numpy() > 0
            codes, scale = coded(x)
            exact = [r.tobytes() for r in x[q].astype("<f4")]
            for c, (own, asking) in enumerate(zip(plan.keys(x, False), plan.keys(x[q], True) if q.any() else [np.zeros(0, np.int64)] * curves)):
                yield pd.DataFrame({"curve": c, "key": own, "query": False, "cid": cid, "code": codes, "scale": scale})
                if q.any():
                    yield pd.DataFrame({"curve": c, "key": asking, "query": True, "cid": cid[q], "code": exact, "scale": 1.0})

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, before, curve = TaskContext.get().partitionId(), 0, -1
        for pdf in batches:
            for c, piece in pdf.groupby("curve", sort=False):
                if c != curve:
                    curve, before = c, 0
                real = (~piece["query"]).to_numpy().astype(np.int64)
                yield piece.drop(columns="key").assign(part=part, place=before + np.cumsum(real) - real)
                before += int(real.sum())

    laid = classes.mapInPandas(lay, "curve int, key long, query boolean, cid long, code binary, scale double")
    laid = laid.repartitionByRange("curve", "key", "cid").sortWithinPartitions("curve", "key", "cid")
    laid = stage(laid.mapInPandas(number, "curve int, query boolean, cid long, code binary, scale double, part int, place long"), "curves")
    sizes = laid.groupBy("curve", "part").agg(F.count_if(~F.col("query")).alias("n")).toPandas().sort_values(["curve", "part"])  # a row for each partition and curve in it
    sizes["base"] = sizes.groupby("curve")["n"].cumsum() - sizes["n"]
    base = spark.createDataFrame(sizes[["curve", "part", "base"]].astype({"curve": "int32", "part": "int32", "base": "int64"}), "curve int, part int, base long")
    laid = laid.join(F.broadcast(base), ["curve", "part"]).select("curve", "query", "cid", "code", "scale", (F.col("place") + F.col("base")).alias("place"))

    # the window that catches the wanted share of the pilot's true neighbours
    wanted = spark.createDataFrame(pd.DataFrame({"cid": np.union1d(truth["cid"].to_numpy(np.int64), asked_ids)}), "cid long")
    at = laid.join(F.broadcast(wanted), "cid").select("curve", "query", "cid", "place").toPandas()  # curves x pilot x k rows at most
    found = truth.merge(at[~at["query"]], on="cid").merge(at[at["query"]].rename(columns={"cid": "q", "place": "from"})[["curve", "q", "from"]], on=["curve", "q"])
    apart = (found["place"] - found["from"]).abs().groupby([found["q"], found["cid"]]).min()
    reach = window_for(apart.to_numpy(), recall)
    block = max(least_block, reach)

    lows, highs = F.greatest(F.col("place") - reach, F.lit(0)), F.col("place") + reach
    blocks = F.sequence(F.floor(lows / block), F.floor(highs / block))
    asking = laid.filter("query").select("curve", "query", "cid", "code", "scale", "place", F.explode(blocks).alias("block"))
    placed = laid.filter("not query").select("curve", "query", "cid", "code", "scale", "place", F.floor(F.col("place") / block).alias("block"))
    deep = 3 * k  # codes rank roughly, so more than k go on to the exact measure

    def rank_block(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c = pdf[pdf["query"]].sort_values("place"), pdf[~pdf["query"]].sort_values("place")
        out = []
        if len(q) and len(c):
            x = np.frombuffer(b"".join(c["code"]), np.int8).reshape(len(c), -1).astype(np.float32) * c["scale"].to_numpy(np.float32)[:, None]
            y = np.frombuffer(b"".join(q["code"]), "<f4").reshape(len(q), -1)
            names, place, from_ = c["cid"].to_numpy(), c["place"].to_numpy(), q["place"].to_numpy()
            low, high = np.searchsorted(place, from_ - reach), np.searchsorted(place, from_ + reach, side="right")
            for name, v, a, b in zip(q["cid"], y, low.tolist(), high.tolist()):  # only the window
                s = x[a:b] @ v
                if len(s) > deep:
                    some = np.argpartition(-s, deep)[:deep]
                    out.append((name, names[a:b][some].tolist(), s[some].astype(float).tolist()))
                elif len(s):
                    out.append((name, names[a:b].tolist(), s.astype(float).tolist()))
        return pd.DataFrame(out, columns=["q", "cids", "scores"])

    tops = placed.unionByName(asking).groupBy("curve", "block").applyInPandas(rank_block, "q long, cids array<long>, scores array<double>")
    rough = tops.select("q", F.inline(F.arrays_zip("cids", "scores"))).toDF("q", "cid", "score").groupBy("q", "cid").agg(F.max("score").alias("score"))
    rough = rough.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= deep).select("q", "cid")
    left, right = classes.select(F.col("cid").alias("q"), F.col("v").alias("a")), classes.select("cid", F.col("v").alias("b"))
    exact = F.aggregate(F.zip_with("a", "b", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)
    near = rough.join(left, "q").join(right, "cid").select("q", "cid", exact.alias("score"))
    near = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).drop("r")
    few = members.withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy("vec_id"))).filter(F.col("r") <= k + 1).drop("r")
    by_class = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    listed = near.join(few, "cid").withColumn("r", F.row_number().over(by_class)).filter(F.col("r") <= k + 1).drop("r", "cid")
    askers = members.filter(queries(F.col("vec_id"))).select(F.col("cid").alias("q"), F.col("vec_id").alias("query_id"))
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    result = askers.join(listed, "q").filter(F.col("vec_id") != F.col("query_id")).withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
    return result.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
