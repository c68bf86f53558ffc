"""Op 9: exact n-gram Jaccard join in metric space.

1 - Jaccard is a metric on shingle sets.  Equal sets are one point.  The first pivots are single shingles, rare ones
nearest: a document's home region is that of its rarest shingle, and it is replicated into the regions of as many
further shingles as a partner at distance ``radius`` might lack, so every linked pair meets in some region.  The
regions of one least document are joined into one.

A region too large for a task is cut by document pivots (``cut_regions``): every member is measured against several
and belongs to the Voronoi cell of the nearest one it is linked with.  Members of a cell are connected
through its pivot, so by the triangle inequality only members near the border remain, together with the replicas of
unconnected documents whose distance to the pivot lies in the cell's window.  Members far from all pivots
meet those that their sketches can't tell apart (``close_regions``); where they are too many for a task, those that may be linked at all
get shingle pivots again, by their rarity inside the region.  Cells and new regions are cut in turn; a part
that is still over half of its region meets by sketches, block by block, so a region of m members
takes a number of steps that grows as log m.

In a region that fits, members that no other can be linked with are taken out first: a shingle more or less changes
the counts of a set's hashes in a few buckets by one, so the distance of two count vectors bounds the symmetric
difference of the sets from below.  Then the same recursion runs in memory, one pivot at a time.  The components
of all links are found on Spark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, by_bucket, characters, counted, numbered, partitions, slices, stage, texts_of
from .components import components
from .repeats import block_hashes, bucket_of, from6, low6, mix, own_bytes, runs, split_sorted, word_codes

SLICES = 16  # in which the table of shingle frequencies is added up


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``size``-word shingles, A-Z lower-cased; fewer words are one shingle, no words none."""
    x, counts = word_codes([t.lower() for t in texts])
    grams = mix(block_hashes(x, size)) if len(x) >= size else x[:0]
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(grams[at : at + n - size + 1]))
        elif n:
            out.append(mix(mix(block_hashes(x[at : at + n], n)) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def signature(s: np.ndarray) -> tuple[int, int]:
    return int(s.sum().view(np.int64)) if len(s) else 0, int(np.bitwise_xor.reduce(mix(s)).view(np.int64)) if len(s) else 0


def counters_for(chars: int) -> int:
    """Counters of shingle frequencies: they follow the input from 2 ** 18 to 2 ** 23, as a byte of each is broadcast."""
    return 1 << min(max((chars // 512).bit_length(), 18), 23)


def counter_of(s: np.ndarray, counters: int) -> np.ndarray:
    return (s >> np.uint64(20)).astype(np.int64) & (counters - 1)


def sketch(s: np.ndarray) -> bytes:
    """Hashes of the set in each of B buckets, B the power of two next above a quarter of its size."""
    buckets = 1 << min(max((max(len(s), 1) // 4).bit_length(), 4), 12)
    return np.minimum(np.bincount((s & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets), 255).astype(np.uint8).tobytes()


def possible(n: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """Which sets may be linked with another one, by the lower bound that their sketches give."""
    out = np.zeros(len(n), bool)
    counts = [np.frombuffer(x, np.uint8).astype(np.int32) for x in sketches]
    order = np.argsort(n, kind="stable")
    for at, i in enumerate(order):
        end = at + 1 + int(np.searchsorted(n[order[at + 1 :]], 100 * n[i] // percent, side="right"))
        partners = order[at + 1 : end]  # not smaller, and not too large
        if out[i]:
            partners = partners[~out[partners]]
        if not len(partners):
            continue
        width = len(counts[i])
        # a larger set has as many buckets or more, which fold
        rest = np.minimum(np.stack([counts[j] if len(counts[j]) == width else counts[j].reshape(-1, width).sum(0) for j in partners]), 255)
        apart = np.abs(rest - counts[i]).sum(1)
        near = (100 + percent) * apart <= (100 - percent) * (n[i] + n[partners])
        if near.any():
            out[i] = True
            out[partners[near]] = True
    return out


def close(n: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """A symmetric matrix of which two sets may be linked, by the lower bound that their sketches give."""
    counts = [np.frombuffer(x, np.uint8).astype(np.int32) for x in sketches]
    order, out = np.argsort(n, kind="stable"), np.zeros((len(n), len(n)), bool)
    widths, folded = np.array([len(counts[i]) for i in order]), {}
    for w in np.unique(widths).tolist():  # those of larger sets fold
        folded[w] = np.minimum(np.stack([counts[i].reshape(-1, w).sum(0) for i in order[np.searchsorted(widths, w) :]]), 255).astype(np.int16)
    sizes = n[order]
    ends = np.searchsorted(sizes, 100 * sizes // percent, side="right")
    for at, end in enumerate(ends.tolist()):
        if end > at + 1:
            w = int(widths[at])
            rows = folded[w][at - len(order) + len(folded[w]) : end - len(order) + len(folded[w])]
            apart = np.abs(rows[1:] - rows[0]).sum(1, dtype=np.int64)
            found = order[at + 1 : end][(100 + percent) * apart <= (100 - percent) * (sizes[at] + sizes[at + 1 : end])]
            out[order[at], found] = out[found, order[at]] = True
    return out


def close_sets(near: np.ndarray, most: int) -> list[np.ndarray]:
    """Sets of at most ``most`` rows such that any two rows with an entry in ``near`` meet in one of them.

    A row and those of its neighbours that it did not meet yet are a set, the row with most neighbours first: a group of copies is one
    set, a few neighbours are a few small ones.  They hold no more rows in all than comparing block by block would take.
    """

    def blocks(rows: np.ndarray) -> list[np.ndarray]:
        if len(rows) <= most:
            return [rows]
        parts = np.array_split(rows, -(-2 * len(rows) // most))
        return [np.concatenate([a, b]) for i, a in enumerate(parts) for b in parts[i + 1 :]]

    degree, left, out = near.sum(1), near.copy(), []
    for v in np.argsort(-degree, kind="stable"):
        others = np.flatnonzero(left[v])
        if len(others):
            rows = np.concatenate([[v], others])
            left[np.ix_(rows, rows)] = False
            out += blocks(rows)
    plain = blocks(np.flatnonzero(degree))
    return out if sum(map(len, out)) <= sum(map(len, plain)) else plain


def meetable(heads: np.ndarray, n: np.ndarray, left: np.ndarray, percent: int) -> np.ndarray:
    """Rows of runs (beginning at ``heads``, in the order of n) that share their shingle as the first one with another row they
    might be linked with.

    Before the first shared shingle nothing is shared, so two sets share at most what is ``left`` of either from it on.  With
    the slack a = (100 + percent) left - percent n, rows i and j might be linked if a[i] >= percent n[j] and a[j] >= percent n[i]:
    of the rows whose n is small enough for i, the largest slack of another one decides.
    """
    run = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(n)))
    slack = (100 + percent) * left - percent * n
    low = run * (1 << 40)  # keeps what is accumulated inside its run
    upto = np.searchsorted(low + n, low + np.maximum(slack // percent, 0), side="right") - 1
    most = np.maximum.accumulate(low + slack)
    before = np.concatenate([[-1], most[:-1]])
    before[heads] = low[heads] - (1 << 39)
    second = np.maximum.accumulate(np.minimum(low + slack, before))
    other = np.where(most[upto] == low + slack, second[upto], most[upto])
    return np.flatnonzero((upto >= heads[run]) & (other >= low + percent * n))


def needed(n: int, percent: int) -> int:
    """Shingles that two sets must share at least for a link if one of them has n."""
    return -(-n * percent // 100)


def overlaps(one: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Shingles that ``one`` shares with each of the sets that stand in ``flat`` in a row."""
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    return np.add.reduceat((one[at] == flat).astype(np.int64), starts)


def linked(shared: np.ndarray, a: int, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (a + b - shared)


def join_region(ids: np.ndarray, sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges that connect exactly what the links among ``sets`` connect, where equal numbers in ``known`` are connected already."""
    radius = 1 - percent / 100 + 1e-9
    boss = np.arange(len(ids)) if known is None else np.unique(known, return_inverse=True)[1]
    pool, pivot, edges = np.arange(len(ids)), int(np.argmin(ids)), []
    while len(pool) > 1:
        rest = pool[pool != pivot]
        lens = np.array([len(sets[i]) for i in rest])
        shared = overlaps(sets[pivot], np.concatenate([sets[i] for i in rest]), np.concatenate([[0], np.cumsum(lens)[:-1]]))
        link = linked(shared, len(sets[pivot]), lens, percent)
        apart = 1 - shared / (len(sets[pivot]) + lens - shared)
        for i in rest[link]:
            if boss[i] != boss[pivot]:
                edges.append((int(ids[pivot]), int(ids[i])))
                boss[boss == boss[i]] = boss[pivot]
        inside = boss[rest] == boss[pivot]
        far = np.sort(apart[~inside])
        if not len(far):
            break
        near = np.searchsorted(far, apart - radius) < np.searchsorted(far, apart + radius, side="right")
        stay = ~inside | near
        pool, apart = rest[stay], apart[stay]
        pivot = int(pool[np.argmin(apart)])  # the centre of a group of copies is the nearest to any of them
    return edges


def by_group(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Whole groups of sorted rows, across batches."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        cuts = np.flatnonzero(runs(pdf[key].to_numpy())).tolist() if len(pdf) else []
        for a, b in zip(cuts, [*cuts[1:], len(pdf)]):
            part = pdf.iloc[a:b]
            if held and held[-1][key].iloc[0] != part[key].iloc[0]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def join(docs: DataFrame, size: int = 4, percent: int = 85, **how) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    component_id is the least doc_id that links reach.  Every row is a document of its own, also under a null or repeated
    doc_id; a null is no least doc_id unless the group has nothing else.  Texts without words, empty or null, have no
    shingles and are linked with nothing.  Very long texts take part whole; equal sets, ties and repeated rows are
    linked like any other.  An empty table gives no rows; other columns are ignored.
    """
    found = _components(numbered(docs.select("doc_id", "text"), each=True), size, percent, **how)
    # both staged, so that a hot component is split in the join
    found = stage(found, "found")
    least = stage(found.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    return found.join(least, "component").select("doc_id", "n_shingles", "component_id")


def _components(known: DataFrame, size: int = 4, percent: int = 85, leaf_rows: int = 256, pivots: int = 16, held_entries: int = 500_000) -> DataFrame:
    """_id, doc_id, n_shingles and component (the least _id that links reach) of ``numbered`` rows.

    ``leaf_rows`` bounds the members of a region that one task joins, ``pivots`` is the number of document pivots of a larger
    one in each step, ``held_entries`` bounds what a task holds before it sends.
    """
    own = texts_of(known)
    spark, chars = known.sparkSession, characters(own)
    buckets, counters = buckets_for(spark, chars), counters_for(chars)
    doc = F.col("row.doc_id").cast("long")
    read = known.select("_id", F.coalesce(doc, F.lit(0).cast("long")).alias("_doc"), doc.isNull().alias("_null"), F.coalesce("row.text", F.lit("")).alias("_text"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        counts, task = np.zeros(counters, np.uint32), TaskContext.get().partitionId()
        none = {"slice": -1, "task": -1}
        for pdf in slices(batches):
            sets = shingle_sets(own_bytes(pdf["_text"]), size)
            counts += np.bincount(counter_of(np.concatenate(sets), counters), minlength=counters).astype(np.uint32)
            signs = [signature(s) for s in sets]
            yield pd.DataFrame({"_id": pdf["_id"], "_doc": pdf["_doc"], "_null": pdf["_null"], "n": [len(s) for s in sets], "s1": [s[0] for s in signs], "s2": [s[1] for s in signs], **none, "counts": [sketch(s) for s in sets]})
        parts = [zlib.compress(c.astype("<u8").tobytes(), 1) for c in np.split(counts, SLICES)]
        yield pd.DataFrame({"_id": 0, "_doc": 0, "_null": False, "n": 0, "s1": 0, "s2": 0, "slice": range(SLICES), "task": task, "counts": parts})

    measured = stage(read.mapInPandas(measure, "_id long, _doc long, _null boolean, n long, s1 long, s2 long, slice int, task int, counts binary"), "sets")
    points = measured.filter("slice = -1").select("_id", F.expr("if(_null, null, _doc)").alias("doc_id"), "n", "s1", "s2")
    sketches = measured.filter("slice = -1").select(F.col("_id").alias("doc"), "n", F.col("counts").alias("sketch"))

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), "<u8").astype(np.uint64) for c in pdf["counts"])
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "task": pdf["task"].iloc[:1] // 128, "counts": [zlib.compress(total.astype("<u8").tobytes(), 1)]})

    tables, tasks = measured.filter("slice >= 0").select("slice", "task", "counts"), own.rdd.getNumPartitions()
    while True:  # at most 128 tables are added up in one task
        tables = tables.groupBy("slice", F.floor(F.col("task") / 128).alias("k")).applyInPandas(add, "slice int, task int, counts binary")
        tasks = -(-tasks // 128)
        if tasks <= 1:
            break
    frequency = np.zeros((SLICES, counters // SLICES), np.uint64)
    for r in tables.collect():  # SLICES rows
        frequency[r["slice"]] = np.frombuffer(zlib.decompress(r["counts"]), "<u8")
    frequency = frequency.ravel()
    level = np.floor(np.log2(np.maximum(frequency, max(2 * frequency.mean(), 1)))).astype(np.uint8)
    levels = spark.sparkContext.broadcast(level.tobytes())  # a byte for each counter

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rare, seen, held, count = np.frombuffer(levels.value, np.uint8), set(), [], 0

        def flush() -> pd.DataFrame:
            e = np.concatenate([h[2] for h in held])
            sizes = np.array([len(h[2]) for h in held])
            ids, n = np.repeat([h[0] for h in held], sizes), np.repeat([h[1] for h in held], sizes)
            place = np.concatenate([np.arange(k) for k in sizes])
            bucket = bucket_of(e, buckets)
            rows = []
            for p in split_sorted(bucket):
                head = np.flatnonzero(runs(ids[p]))
                rows.append((int(bucket[p[0]]), ids[p[head]].astype("<i8").tobytes(), n[p[head]].astype("<u4").tobytes(), np.diff(head, append=len(p)).astype("<u4").tobytes(), place[p].astype("<u4").tobytes(), low6(e[p])))
            held.clear()
            return pd.DataFrame(rows, columns=["bucket", "ids", "n", "counts", "place", "e"])

        for pdf in slices(batches):
            for i, s in zip(pdf["_id"].tolist(), shingle_sets(own_bytes(pdf["_text"]), size)):
                sign = (len(s), *signature(s))
                if not len(s) or sign in seen:
                    continue  # the same point went out from this task
                if len(seen) < held_entries:
                    seen.add(sign)
                first = np.lexsort((s, rare[counter_of(s, counters)]))[: len(s) - needed(len(s), percent) + 1]
                held.append((i, len(s), s[first]))
                count += len(first)
                if count >= held_entries:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = [np.frombuffer(c, "<u4").astype(np.int64) for c in pdf["counts"]]
        ids = np.concatenate([np.repeat(np.frombuffer(i, "<i8"), c) for i, c in zip(pdf["ids"], sizes)])
        n = np.concatenate([np.repeat(np.frombuffer(x, "<u4").astype(np.int64), c) for x, c in zip(pdf["n"], sizes)])
        e, left = from6(b"".join(pdf["e"])), n - np.frombuffer(b"".join(pdf["place"]), "<u4").astype(np.int64)
        order = np.lexsort((ids, n, e))
        e, n, ids, left = e[order], n[order], ids[order], left[order]
        new = runs(e)
        new[1:] |= 100 * n[:-1] < percent * n[1:]  # sizes too far apart for a link
        keep = meetable(np.flatnonzero(new), n, left, percent)
        new = runs(np.cumsum(new)[keep])
        ids, head = ids[keep], np.flatnonzero(new)
        if not len(ids):
            return pd.DataFrame({"p": np.zeros(0, np.int64), "x": np.zeros(0, np.int64)})
        pivot = np.repeat(np.minimum.reduceat(ids, head), np.diff(head, append=len(ids)))
        pairs = np.unique(np.stack([pivot, ids], 1)[pivot != ids], axis=0) if (pivot != ids).any() else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"p": pairs[:, 0], "x": pairs[:, 1]})

    packed = own.mapInPandas(send, "bucket int, ids binary, n binary, counts binary, place binary, e binary")
    pairs = by_bucket(packed, buckets).applyInPandas(meet, "p long, x long").distinct()

    # equal sets are one point, named by its least document
    names = stage(points.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("_id").alias("point")), "classes")  # staged, so that a hot class is split in the join
    named = stage(points.join(names, ["n", "s1", "s2"], "left").select("_id", "doc_id", "n", F.coalesce("point", "_id").alias("point")), "points")
    to = named.select("_id", "point")
    pairs = pairs.join(to.select(F.col("_id").alias("p"), F.col("point").alias("region")), "p").join(to.select(F.col("_id").alias("x"), F.col("point").alias("doc")), "x").select("region", "doc").filter("region <> doc").distinct()
    pairs = stage(pairs, "regions")
    members = pairs.unionByName(pairs.select("region", F.col("region").alias("doc")).distinct())
    members = members.withColumn("boss", F.col("doc")).withColumn("parent", F.lit(None).cast("long"))

    # regions too large for one task are cut until they are not
    fit, edges, turn, texts = [], [], 0, None
    while True:
        sizes = stage(members.groupBy("region").agg(F.count("*").alias("rows"), F.max("parent").alias("parent")).filter(F.col("rows") > leaf_rows), "sizes")
        if sizes.isEmpty():
            fit.append(members.select("region", "doc", "boss"))
            break
        fit.append(members.join(sizes, "region", "left_anti").select("region", "doc", "boss"))
        still = F.coalesce(2 * F.col("rows") > F.col("parent"), F.lit(False))
        fit.append(close_regions(members.join(sizes.filter(still).select("region"), "region").join(sketches, "doc"), percent, leaf_rows))
        cut = stage(sizes.filter(~still), "cut")
        if cut.isEmpty():
            break
        if texts is None:  # later steps need no other texts than the first one
            needed_docs = stage(members.join(cut.select("region"), "region").select(F.col("doc").alias("_id")).distinct(), "needed")
            texts = stage(own.join(counted(needed_docs), "_id", "left_semi"), "texts")
        members, more = cut_regions(members, cut, texts, size, percent, leaf_rows, pivots, turn)
        edges.append(more)
        turn += 1
    members = fit[0]
    for more in fit[1:]:
        members = members.unionByName(more)

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in by_group(batches, "region"):
            group = group[possible(group["n"].to_numpy(), group["sketch"].tolist(), percent)]
            if len(group):
                yield group[["region", "doc", "boss"]]

    drawn = members.join(sketches, "doc").select("region", "doc", "boss", "n", "sketch").repartition(partitions(spark), "region").sortWithinPartitions("region")
    members = stage(drawn.mapInPandas(prune, "region long, doc long, boss long"), "members")

    def join_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in by_group(batches, "region"):
            got = join_region(group["doc"].to_numpy(), shingle_sets(own_bytes(group["_text"]), size), percent, group["boss"].to_numpy())
            if got:
                yield pd.DataFrame(got, columns=["a", "b"])

    shipped = own.join(counted(members), F.col("doc") == F.col("_id")).select("region", "doc", "boss", "_text")
    found = shipped.repartition(partitions(spark), "region").sortWithinPartitions("region").mapInPandas(join_all, "a long, b long")
    for more in edges:
        found = found.unionByName(more)
    labels = components(found)
    return named.join(labels, named["point"] == labels["node"], "left").select("_id", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "point").alias("component"))


def in_pairs(far: DataFrame, rows: int) -> DataFrame:
    """``far`` (region, doc, boss, n, sketch) with the blocks of about half ``rows`` that regions are dealt to, a ``pair`` for each two of them."""
    blocks = F.when(F.col("rows") > rows, F.ceil(2 * F.col("rows") / rows)).otherwise(1).cast("long")
    sized = far.groupBy("region").agg(F.count("*").alias("rows")).withColumn("_blocks", blocks)
    dealt = far.select("region", "doc", "boss", "n", "sketch").join(sized, "region").withColumn("block", F.pmod(F.xxhash64("doc"), "_blocks"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    two = F.xxhash64("region", F.least("block", "_o"), F.greatest("block", "_o")).alias("pair")
    return dealt.select(two, "region", "doc", "boss", "n", "sketch", "block").repartition(partitions(far.sparkSession), "pair").sortWithinPartitions("pair")


def close_regions(far: DataFrame, percent: int, leaf_rows: int) -> DataFrame:
    """Regions of at most ``leaf_rows`` members in which all members of a region of ``far`` meet that may be linked.

    Documents may share most of their text without being linked, as filled-in forms do.  No distance to a pivot parts them, and every
    shingle gathers them again; their sketches do part them.  A task compares the sketches of two blocks; texts don't move before that.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in by_group(batches, "pair"):
            near, boss, block = close(group["n"].to_numpy(), group["sketch"].tolist(), percent), group["boss"].to_numpy(), group["block"].to_numpy()
            near &= boss[:, None] != boss  # connected already
            if (block != block[0]).any():
                near &= block[:, None] != block  # a block meets itself in a pair of its own
            sets = close_sets(near, leaf_rows)
            if sets:
                rows = group.iloc[np.concatenate(sets)]
                yield rows[["pair", "doc", "boss"]].assign(k=np.repeat(np.arange(len(sets)), [len(x) for x in sets]))

    found = in_pairs(far, 8 * leaf_rows).mapInPandas(compare, "pair long, doc long, boss long, k long")
    return found.select(F.xxhash64("pair", "k").alias("region"), "doc", "boss")


def pairable(far: DataFrame, percent: int, leaf_rows: int) -> DataFrame:
    """region and doc of the members in ``far`` that some other one of their region may be linked with."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in by_group(batches, "pair"):
            yield group.loc[possible(group["n"].to_numpy(), group["sketch"].tolist(), percent), ["region", "doc"]]

    return in_pairs(far, 8 * leaf_rows).mapInPandas(compare, "region long, doc long").distinct()


def cut_regions(members: DataFrame, sizes: DataFrame, own: DataFrame, size: int, percent: int, leaf_rows: int, pivots: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """One step of the recursion for the regions in ``sizes`` (region, rows), spread over tasks: (members of their parts, edges found).

    ``members`` has region, doc and boss; members of one boss are connected already.
    """
    radius = 1 - percent / 100 + 1e-9
    big = members.select("region", "doc", "boss").join(sizes.select("region", "rows"), "region")
    heads = big.groupBy("region", "boss").agg(F.min_by("doc", F.xxhash64("doc", F.lit(turn))).alias("pivot"), F.first("rows").alias("rows"))
    # the least document leads, as copies mostly follow what they were made from; the others are drawn by a hash
    first = big.groupBy("region").agg(F.min("doc").alias("_first"))
    heads = heads.join(first, "region").join(big.select("region", F.col("doc").alias("_first"), F.col("boss").alias("_lead")), ["region", "_first"])
    heads = heads.withColumn("pivot", F.when(F.col("boss") == F.col("_lead"), F.col("_first")).otherwise(F.col("pivot")))
    order = Window.partitionBy("region").orderBy(F.col("pivot") != F.col("_first"), F.xxhash64("pivot", F.lit(turn)), "pivot")
    chosen = stage(heads.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= pivots).select("region", "boss", "pivot", "rows"), "pivots")
    salts = F.ceil(F.col("rows") / leaf_rows)
    rows = big.withColumn("salt", F.pmod(F.xxhash64("doc"), salts)).join(own.select(F.col("_id").alias("doc"), F.col("_text").alias("text")), "doc").select("region", "salt", "doc", "boss", "text")
    shown = chosen.join(own.select(F.col("_id").alias("pivot"), F.col("_text").alias("shown")), "pivot").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).select("region", "salt", "pivot", "boss", "shown")

    def measure(pdf: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame(columns=["region", "doc", "boss", "n", "near", "shingles", "sketch"])
        sets, centres, out = shingle_sets(own_bytes(pdf["text"]), size), shingle_sets(own_bytes(at["shown"]), size), []
        flat, lens = np.concatenate(centres), np.array([len(c) for c in centres])
        starts = np.cumsum(lens) - lens
        for doc, boss, s in zip(pdf["doc"].tolist(), pdf["boss"].tolist(), sets):
            shared = overlaps(s, flat, starts)
            link, apart = linked(shared, len(s), lens, percent), 1 - shared / (len(s) + lens - shared)
            near = [{"p": p, "d": float(d), "link": bool(k), "same": b == boss} for p, b, d, k in zip(at["pivot"].tolist(), at["boss"].tolist(), apart, link)]
            alone = not any(x["link"] or x["same"] for x in near)
            out.append((pdf["region"].iloc[0], doc, boss, len(s), near, s.astype(np.int64).tolist() if alone else None, sketch(s) if alone else None))
        return pd.DataFrame(out, columns=["region", "doc", "boss", "n", "near", "shingles", "sketch"])

    schema = "region long, doc long, boss long, n long, near array<struct<p: long, d: double, link: boolean, same: boolean>>, shingles array<long>, sketch binary"
    got = rows.groupBy("region", "salt").cogroup(shown.groupBy("region", "salt")).applyInPandas(measure, schema)
    mine = F.filter("near", lambda x: x["link"] | x["same"])
    got = stage(got.withColumn("home", F.array_min(F.transform(mine, lambda x: F.struct(x["d"].alias("d"), x["p"].alias("p"), x["link"].alias("link"))))), f"measured{turn}")

    # pivots that some member connects are one
    touched = got.filter("home IS NOT NULL").select("region", F.col("home.p").alias("a"), F.explode(F.transform(mine, lambda x: x["p"])).alias("b")).distinct()

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:  # at most pivots ** 2 rows
        boss = {p: p for p in pdf["a"].tolist() + pdf["b"].tolist()}
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            x, y = boss[a], boss[b]
            boss = {p: x if q == y else q for p, q in boss.items()}
        return pd.DataFrame({"region": pdf["region"].iloc[0], "p": list(boss), "whole": list(boss.values())})

    wholes = stage(touched.groupBy("region").applyInPandas(unite, "region long, p long, whole long"), f"wholes{turn}")
    linked_to = F.filter("near", lambda x: x["link"])
    edges = got.filter("home.link AND home.p <> doc").select(F.col("doc").alias("a"), F.col("home.p").alias("b"))
    edges = edges.unionByName(got.filter(F.size(linked_to) > 0).select(F.col("home.p").alias("h"), "boss", "doc", F.explode(F.transform(linked_to, lambda x: x["p"])).alias("b")).filter("h <> b AND doc <> b").select(F.col("doc").alias("a"), "b"))

    # cells: connected members, and unconnected ones inside the window
    inner = got.filter("home IS NOT NULL").select("region", F.col("home.p").alias("p"), "doc", F.col("home.d").alias("d"))
    inner = inner.join(wholes, ["region", "p"])
    placed = got.join(wholes.select(F.col("region").alias("_r"), F.col("p").alias("_p"), F.col("whole").alias("_own")), (F.col("region") == F.col("_r")) & (F.col("home.p") == F.col("_p")), "left").select("region", "doc", F.coalesce("_own", "boss").alias("boss"), "_own", F.inline(F.transform("near", lambda x: F.struct(x["p"].alias("p"), x["d"].alias("d")))))
    reach = inner.groupBy("region", "p").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.first("whole").alias("whole"))
    outer = placed.join(reach, ["region", "p"]).filter("_own IS NULL OR _own <> whole").filter((F.col("d") >= F.col("low") - radius) & (F.col("d") <= F.col("high") + radius)).select("region", "p", "doc", "d", "boss")
    outer = stage(outer, f"outer{turn}")
    window = outer.groupBy("region", "p").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    border = inner.join(window, ["region", "p"]).filter((F.col("d") >= F.col("low") - radius) & (F.col("d") <= F.col("high") + radius)).select("region", "p", "doc", F.col("whole").alias("boss"))
    cells = border.unionByName(outer.select("region", "p", "doc", "boss"))
    sized = sizes.select(F.col("region"), F.col("rows").alias("parent"))
    cells = cells.join(sized, "region").select(F.xxhash64("region", "p", F.lit(turn)).alias("region"), "doc", "boss", "parent")

    # members far from all pivots: those of one task's worth meet by their sketches; of more, those that another one of them may be
    # linked with get shingle pivots again, in the order of their rarity here
    far = got.filter("home IS NULL")
    counts = far.groupBy("region").agg((F.count("*") > 8 * leaf_rows).alias("many"))
    met = close_regions(far.join(counts.filter("not many"), "region"), percent, leaf_rows)
    far = far.join(counts.filter("many").select("region"), "region")
    far = far.join(stage(pairable(far, percent, leaf_rows), f"pairable{turn}"), ["region", "doc"], "left_semi")
    lone = far.select("region", "doc", "boss", "n", F.explode("shingles").alias("s"))
    common = stage(lone.groupBy("region", "s").count().filter("count > 1"), f"common{turn}")
    shared = lone.join(common, ["region", "s"]).groupBy("region", "doc", "boss").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("count", "s"))).alias("q"))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("q"))  # shingles of its own come before
    sent = stage(shared.filter(first > 0).select("region", "doc", "boss", F.explode(F.slice("q", F.lit(1), first.cast("int"))["s"]).alias("s")), f"sent{turn}")
    groups = sent.groupBy("region", "s").agg(F.min("doc").alias("p"), F.count("*").alias("_c")).filter("_c > 1").drop("_c")
    parts = sent.join(groups, ["region", "s"]).select("region", "p", "doc", "boss").distinct()
    parts = parts.join(sized, "region").select(F.xxhash64("region", "p", F.lit(turn), F.lit("s")).alias("region"), "doc", "boss", "parent")
    parts = cells.unionByName(parts).unionByName(met.withColumn("parent", F.lit(None).cast("long")))
    return stage(parts.distinct(), f"parts{turn}"), edges


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with all columns: of the rows that links connect, the one with the least doc_id stays.

    Rows with a null doc_id come first, and rows under one doc_id in a fixed order, so exactly one row of each group stays.
    Texts without words are in no group.  Columns of any name are left as they are; an empty table gives no rows.
    """
    known = numbered(docs, each=True)
    extra = _components(known, **how).filter("_id <> component").select("_id")
    return known.join(extra, "_id", "left_anti").select("row.*")
