"""Op 4: quality rules with robust multivariate outliers, in DataFrame functions only.

Counts of every whole text become four transformed statistics.  For each language and source the minimum
covariance determinant estimate of their centre and scatter is found from three starts (medians and quartiles, the
correlation of squashed scores, spatial signs) by concentration steps: keep the share ``keep`` of documents
with the least Mahalanobis distances, take their mean and covariance, and repeat.  Two steps choose the start with
the least determinant, and this one goes on until no group's determinant falls.  Documents whose distance from
the last estimate is above the chi-squared cutoff are rejected.  Steps aggregate sums and approximate quantiles only,
so a source that holds a third of all rows is summed by every task before it is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, stage

SPACE = r"[ \x09-\x0D]+"
WORD = r"[^ \x09-\x0D]"
MIN_WORDS = 50  # fewer fail the base rules
#: Statistics and the standard deviation that is added to each against rounding.
FEATURES = {"f_word_length": 1e-6, "f_symbols": 1e-6, "f_dup_lines": 1e-6, "f_repeats": 1e-6}
#: The least standard deviation of each: what one word of twice the length, one symbol, line or three-word window changes
#: at most in the shortest judged text.  As the logarithm of lines flattens, a line counts as a fifth of five lines.
LEAST = {"f_word_length": math.log1p(1 / MIN_WORDS), "f_symbols": math.log1p(1 / MIN_WORDS), "f_dup_lines": math.log1p(5) / 5, "f_repeats": 3 / MIN_WORDS}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def chi2_survival(x: float, df: int) -> float:
    """P(chi-squared with an even number of degrees of freedom > x)."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(df // 2))


def chi2_quantile(q: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - chi2_survival(mid, df) < q else (low, mid)
    return low


def text_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts of each whole text.  Null or empty text has no words; counts are then 0.

    Repeated words are found in the row itself: 64-bit hashes of all 3-word windows are sorted with their
    positions packed below them, equal neighbours are compared again by the whole hash, and the union of the
    windows' positions is summed.
    """
    low = (1 << 30) - 1  # positions; the bits above sort the hashes
    df = docs.withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    df = df.withColumn("_w", F.array_remove(F.split("_t", SPACE), ""))
    three = lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2))
    df = df.withColumn("_k", F.sort_array(F.slice(F.transform("_w", lambda w, i: three(w, i).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))), F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0)))))

    def twin(keys: Column) -> Column:
        high = lambda x: F.shiftright(x, 30)
        return F.filter(keys, lambda x, i: F.coalesce(high(x) == high(F.get(keys, i - 1)), F.lit(False)) | F.coalesce(high(x) == high(F.get(keys, i + 1)), F.lit(False)))

    df = df.withColumn("_c", twin(F.col("_k")))
    at = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    df = df.withColumn("_s", F.array_sort(F.transform("_c", lambda x: F.struct(three(F.get("_w", at(x)), at(x)).alias("h"), at(x).alias("i")))))
    same = lambda x, i, by: F.coalesce(x["h"] == F.get("_s", i + by)["h"], F.lit(False))
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"])))
    repeats = F.aggregate("_p", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).cast("long").alias("n"), p.alias("last")), lambda a: a["n"])
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD))
    df = df.withColumn("_l", lines)
    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]", ""))).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": repeats,
        }
    )
    return df.drop("_t", "_w", "_k", "_c", "_s", "_p", "_l")


def with_features(counted: DataFrame) -> DataFrame:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return counted.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "f_word_length": F.log1p(F.col("word_chars") / words),
            "f_symbols": F.log1p(F.col("n_symbols") / words),
            "f_dup_lines": F.log1p(F.col("n_dup_lines").cast("double")),
            "f_repeats": F.col("n_repeat_words") / words,
        }
    )


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution through the Cholesky factor columns l<i><j>."""
    solved: list[Column] = []
    for i, f in enumerate(FEATURES):
        z = F.col(f) - F.col(f"m{i}")
        for j in range(i):
            z = z - F.col(f"l{i}{j}") * F.col(f"z{j}")
        df = df.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
        solved.append(F.col(f"z{i}") * F.col(f"z{i}"))
    return df.withColumn("d2", sum(solved[1:], solved[0])).drop(*(f"z{i}" for i in range(len(FEATURES))))


def _factor(df: DataFrame, scale: float) -> DataFrame:
    """Cholesky factor columns l<i><j> of the scatter c<i><j> times ``scale``, and the logarithm of its determinant.

    A statistic that varies less than its ``LEAST``, given those before it, is set to vary by that much; a larger
    scatter stays as it is.
    """
    floors, least, made = list(FEATURES.values()), list(LEAST.values()), []
    for i in range(len(floors)):
        for j in range(i + 1):
            v = F.col(f"c{j}{i}") * scale + (floors[i] ** 2 if i == j else 0.0)
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(least[i] ** 2))) if i == j else v / F.col(f"l{j}{j}"))
            made.append(f"l{i}{j}")
    logs = [2 * F.log(F.col(f"l{i}{i}")) for i in range(len(floors))]
    return df.select("_g", "_start", *(f"m{i}" for i in range(len(floors))), *made, sum(logs[1:], logs[0]).alias("log_det"))


def _small(found: DataFrame, most: int = 20_000) -> DataFrame:
    """A hint to broadcast the groups' estimates if they are few: a counted, staged table of some numbers for each."""
    return F.broadcast(found) if found.count() <= most else found


def starts(stats: DataFrame) -> DataFrame:
    """Three first estimates for each group ``_g``, told apart by _start: all at the medians, with the scatter of
    0 the quartiles alone (0.7413 times their distance is a normal distribution's standard deviation),
    1 the correlations of tanh scores, 2 the directions from the medians (spatial signs)."""
    names, p = list(FEATURES), len(FEATURES)
    quartiles = stats.groupBy("_g").agg(*(F.percentile_approx(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i, f in enumerate(names)))
    wide = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) * 0.7413, F.lit(v)) for i, v in enumerate(LEAST.values())]
    at = stage(quartiles.select("_g", *(F.col(f"q{i}")[1].alias(f"m{i}") for i in range(p)), *(w.alias(f"w{i}") for i, w in enumerate(wide))), "quartiles")
    df = stats.join(_small(at), "_g")
    z = [(F.col(f) - F.col(f"m{i}")) / F.col(f"w{i}") for i, f in enumerate(names)]
    df = df.withColumns({f"z{i}": x for i, x in enumerate(z)})
    length = F.sqrt(sum(F.col(f"z{i}") * F.col(f"z{i}") for i in range(p)))
    df = df.withColumns({f"t{i}": F.tanh(f"z{i}") for i in range(p)} | {f"u{i}": F.when(length > 0, F.col(f"z{i}") / length).otherwise(0.0) for i in range(p)})
    pairs = [(j, i) for i in range(p) for j in range(i + 1)]
    sums = df.groupBy("_g").agg(*(F.avg(f"t{i}").alias(f"t{i}") for i in range(p)), *(F.avg(F.col(f"t{j}") * F.col(f"t{i}")).alias(f"tt{j}{i}") for j, i in pairs), *(F.avg(F.col(f"u{j}") * F.col(f"u{i}")).alias(f"uu{j}{i}") for j, i in pairs))
    one = sums.join(_small(at), "_g")
    cov = lambda j, i: F.col(f"tt{j}{i}") - F.col(f"t{j}") * F.col(f"t{i}")
    both = lambda j, i: F.col(f"w{j}") * F.col(f"w{i}")
    kinds = [
        lambda j, i: both(j, i) if i == j else F.lit(0.0),
        lambda j, i: both(j, i) * (F.lit(1.0) if i == j else F.coalesce(F.try_divide(cov(j, i), F.sqrt(cov(j, j) * cov(i, i))), F.lit(0.0))),
        lambda j, i: both(j, i) * F.col(f"uu{j}{i}") * p,
    ]
    centre = [F.col(f"m{i}").alias(f"m{i}") for i in range(p)]
    rows = [F.struct(F.lit(k).alias("_start"), *centre, *(c(j, i).alias(f"c{j}{i}") for j, i in pairs)) for k, c in enumerate(kinds)]
    return stage(_factor(one.select("_g", F.inline(F.array(*rows))), 1.0), "starts")


def concentrated(stats: DataFrame, now: DataFrame, keep: float) -> DataFrame:
    """The next estimates: mean and scaled covariance of the share ``keep`` of each group nearest to those in ``now``."""
    names, p = list(FEATURES), len(FEATURES)
    q = chi2_quantile(keep, p)
    grow = keep / (1 - chi2_survival(q, p + 2))  # makes the scatter of the inner share consistent for normal data
    near = _distance(stats.join(_small(now), "_g"))
    cut = stage(near.groupBy("_g", "_start").agg(F.percentile_approx("d2", keep).alias("_cut")), "cut")
    inner = near.join(_small(cut), ["_g", "_start"]).filter(F.col("d2") <= F.col("_cut"))
    y = [F.col(f) - F.col(f"m{i}") for i, f in enumerate(names)]  # sums of small numbers lose nothing
    sums = inner.groupBy("_g", "_start").agg(
        *(F.avg(y[i]).alias(f"y{i}") for i in range(p)),
        *(F.avg(y[i] * y[j]).alias(f"s{j}{i}") for i in range(p) for j in range(i + 1)),
        *(F.first(f"m{i}").alias(f"m{i}") for i in range(p)),
    )
    moved = sums.select("_g", "_start", *((F.col(f"m{i}") + F.col(f"y{i}")).alias(f"m{i}") for i in range(p)), *((F.col(f"s{j}{i}") - F.col(f"y{i}") * F.col(f"y{j}")).alias(f"c{j}{i}") for i in range(p) for j in range(i + 1)))
    return stage(_factor(moved, grow), "mcd")


def _least(found: DataFrame) -> DataFrame:
    """Of each group's estimates the one with the least determinant; of equal ones that of the first start."""
    rest = [c for c in found.columns if c != "_g"]
    return found.groupBy("_g").agg(F.min_by(F.struct(*rest), F.struct("log_det", "_start")).alias("_b")).select("_g", "_b.*")


def estimates(stats: DataFrame, keep: float = 0.75, tolerance: float = 1e-6) -> DataFrame:
    """One row for each group ``_g``: centre m<i> and Cholesky factor l<i><j> of the robust scatter with the least determinant found."""
    now = starts(stats)
    for _ in range(2):
        now = concentrated(stats, now, keep)
    now = stage(_least(now), "best")
    while True:
        following = concentrated(stats, now, keep)
        fall = following.join(now.select("_g", F.col("log_det").alias("_before")), "_g").agg(F.max(F.col("_before") - F.col("log_det"))).first()[0]
        if fall is None or fall <= tolerance:
            return now
        now = stage(_least(now.unionByName(following)), "best")


def _judged(own: DataFrame, cutoff: float, min_group: int, **how) -> DataFrame:
    """``own`` (_id, text, lang, source) with counts and verdict, without the text."""
    key = lambda c: F.coalesce(F.hex(F.col(c).cast("string")), F.lit("-"))
    keys = own.select("_id", "text", key("lang").alias("_lang"), key("source").alias("_source"))
    stats = stage(with_features(text_counts(keys)).drop("text"), "stats")
    pool = stats.filter(~F.col("base_failed"))
    large = stage(pool.groupBy("_lang", "_source").count().filter(F.col("count") >= min_group).select("_lang", "_source", F.lit(True).alias("_own")), "groups")
    keyed = stats.join(_small(large), ["_lang", "_source"], "left").withColumn("_g", F.concat_ws(":", "_lang", F.when(F.col("_own"), F.col("_source")).otherwise(F.lit("*"))))
    found = estimates(keyed.filter(~F.col("base_failed")).select("_g", *FEATURES), **how)
    judged = _distance(keyed.join(_small(found), "_g", "left"))
    limit = chi2_quantile(cutoff, len(FEATURES))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= limit, F.lit(True))
    return judged.select("_id", *COUNTS, "base_failed", kept.alias("kept"), F.col("d2").alias("distance2"))


def judge(docs: DataFrame, cutoff: float = 0.99999, min_group: int = 200, **how) -> DataFrame:
    """One row for each document: doc_id, the base counts, base_failed, kept and the distance.

    ``docs`` has doc_id, text, lang and source.  A null lang or source is a value of its own.  Sources with fewer than
    ``min_group`` judged documents in a language are estimated together.  Documents that fail the base rules are
    rejected and take no part in the estimates.  Null and empty texts have no words and fail; very long texts are counted
    whole.  Repeated rows and ids count each; of estimates with equal determinants the first start's counts; an empty
    table gives no rows; other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), "text", "lang", "source")
    return _judged(own, cutoff, min_group, **how).withColumnRenamed("_id", "doc_id")


def keep_documents(docs: DataFrame, cutoff: float = 0.99999, min_group: int = 200, **how) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns, of any name.

    Every row is judged by itself, also under a null or repeated doc_id; equal rows share a verdict.  Null and empty
    texts go.  An empty table stays empty.
    """
    known = numbered(docs, ("text", "lang", "source"))
    own = known.select("_id", "row.text", "row.lang", "row.source")
    rejected = _judged(own, cutoff, min_group, **how).filter(~F.col("kept")).select("_id").distinct()
    return known.join(rejected, "_id", "left_anti").select("row.*")
