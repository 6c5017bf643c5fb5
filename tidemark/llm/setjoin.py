"""Links between texts by the Jaccard similarity of their shingles, exactly: a prefix-filter join (Chaudhuri et al., 2006; Wang et al., 2012).

A text is the set of its shingles' 64-bit hashes. All sets are put in one order, hashes that are frequent in a sample of the sets last. Two
sets of n and m hashes that reach similarity t share o = t / (1 + t) * (n + m) of them or more, so they share min(o, SHARED) of the first
n - ceil(t n) + SHARED of each: texts that meet that often, in runs of equal hashes of these prefixes, are candidates. The order only sets
the cost: any one is right. Texts are shuffled for candidates alone, and hashes never leave a task.

Links are wanted for the groups that they make, so a candidate is checked only while its texts are in different groups. In each of
``ROUNDS`` each group has the candidate checked that shares most with another one; then all that are open yet are checked.

A run of more than ``BIG`` rows would give too many candidates. Its rows are first compared with three of them; then, in rounds again, each
row that is outside the run's largest group with the likest row of another group; at last all pairs of different groups. Bitmaps rule pairs
out before (Sandes et al., 2019): a bit is the parity of the hashes that fall on it, so two bitmaps differ in at most as many bits as the
sets do in hashes, and sets of similarity t differ in at most (1 - t) / (1 + t) * (n + m). Runs over ``RUN`` rows are cut into blocks, and
each pair of blocks is a run of its own.

Edge cases: a text without words links with nothing; a text is no link of itself; an empty table has no links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, store
from .components import components
from .rolling import Rolling

#: Rows of a run that gives all its pairs at once, and of one that a task compares at most; rounds before all pairs are checked.
BIG, RUN, ROUNDS = 32, 8192, 3
#: Hashes that two texts must share in their prefixes.
SHARED = 4
#: Bits of a bitmap.
BITS = 1024
#: Share of the texts whose hashes are counted for the order, and most hashes that are put last.
SAMPLE, COMMON = 0.05, 65_536
#: Bounds are lowered by this much, so that rounding never loses a pair.
SLACK = 1e-6
#: Texts in a task's hands at once.
STEP = 512


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(ids, sorted distinct hashes of each text) for slices of batches (id, text)."""
    rolling = Rolling()
    for batch in batches:
        for k in range(0, batch.num_rows, STEP):
            ids, texts = (batch.column(c).slice(k, STEP) for c in (0, 1))
            found = [np.unique(rolling.shingles(x.as_buffer().to_pybytes(), shingle)) if x.is_valid else np.zeros(0, np.uint64) for x in texts]
            yield ids.to_numpy(zero_copy_only=False), [g.view(np.int64) for g in found]


def _common(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes that several texts of a sample have, sorted; about how many of all texts have each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, shingle):
            g, n = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], ["g", "n"])

    some = texts.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(SAMPLE * (1 << 30)))
    counts = some.mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where("n > 1")
    rows = sorted((r["g"], r["n"]) for r in counts.orderBy(F.desc("n"), "g").limit(COMMON).collect())
    return np.array([g for g, _ in rows], np.int64), np.array([k for _, k in rows], np.int64) / SAMPLE


def _prefixes(texts: DataFrame, similarity: float, shingle: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(gram, salt, id, place): the hashes of each set's prefix; place is the set's size << 32 | position.

    Hashes of too many sets for one run have a salt, the others -1.
    """
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        for own, sets in _sets(batches, shingle):
            cols: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.int64, np.int32, np.int64, np.int64)]
            for i, g in zip(own, sets, strict=True):
                if not len(g):
                    continue
                count = np.zeros(len(g))
                if len(known):
                    at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                    count = np.where(known[at] == g, often[at], 0.0)
                p = len(g) - math.ceil(similarity * len(g) - SLACK) + SHARED
                first = np.lexsort((g, count))[:p]
                parts = np.ceil(count[first] / RUN).astype(np.int64)
                salt = np.where(parts > 1, (int(i) * 0x9E3779B1 >> 7) % np.maximum(parts, 1), -1)
                new = g[first], salt.astype(np.int32), np.full(len(first), i), (len(g) << 32) + np.arange(len(first))
                for c, x in zip(cols, new, strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["gram", "salt", "id", "place"])

    return texts.mapInArrow(run, "gram long, salt int, id long, place long")


def _least(n1: np.ndarray, n2: np.ndarray, t: float) -> np.ndarray:
    """Hashes that sets of n1 and n2 of them share at least if they reach t."""
    return np.ceil(t / (1 + t) * (n1.astype(np.int64) + n2) - SLACK)


def _possible(n1: np.ndarray, p1: np.ndarray, n2: np.ndarray, p2: np.ndarray, t: float) -> np.ndarray:
    """Where sets of n1 and n2 hashes that share those at p1 and p2, one of the first SHARED that they share, can reach t."""
    return np.minimum(n1 - p1, n2 - p2) >= _least(n1, n2, t) - SHARED + 1


def _most(n1: np.ndarray, n2: np.ndarray, t: float) -> np.ndarray:
    """Bits by which the bitmaps of sets of n1 and n2 hashes of similarity t can differ."""
    return (1 - t) / (1 + t) * (n1.astype(np.int64) + n2) + SLACK


def _bitmaps(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, n, bits): the number of each text's hashes and its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, sets in _sets(batches, shingle):
            bits = [np.packbits(np.bincount(g & (BITS - 1), minlength=BITS) & 1).tobytes() for g in sets]
            n = np.array([len(g) for g in sets], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n), pa.array(bits, pa.binary())], ["id", "n", "bits"])

    return texts.mapInArrow(run, "id long, n int, bits binary")


def _matrix(bits: list[bytes] | np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(bits), np.uint64).reshape(-1, BITS // 64)


def _runs(keys: int, f: Callable[[list[np.ndarray], np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]):
    """For mapInArrow over rows sorted by the first columns: f gets whole runs of equal keys, as columns, starts and lengths."""

    def split(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.logical_or.reduce([np.diff(c) != 0 for c in cols[:keys]])) + 1
        start = np.concatenate(([0], cut))
        yield from f(cols, start, np.diff(np.concatenate((start, [len(cols[0])]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []  # the last run may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if kept and all(k[0] == c[-1] for k, c in zip(kept[-1][:keys], cols, strict=False)):
                kept.append(cols)
                continue
            at = int(np.argmax(np.logical_and.reduce([c == c[-1] for c in cols[:keys]])))
            kept.append([c[:at] for c in cols])
            yield from split([np.concatenate(c) for c in zip(*kept, strict=True)]) if sum(len(k[0]) for k in kept) else ()
            kept = [[c[at:] for c in cols]]
        if kept:
            yield from split([np.concatenate(c) for c in zip(*kept, strict=True)])

    return run


def _met(prefixes: DataFrame, t: float) -> DataFrame:
    """(gram, a, b, place): with a null gram, pairs that met (place: how often << 32 | how often they must); else rows (a) of long runs."""

    def meet(cols: list[np.ndarray], start: np.ndarray, length: np.ndarray) -> Iterator[pa.RecordBatch]:
        gram, salt, own, place = cols
        n, pos = place >> 32, place & 0xFFFFFFFF
        for size in np.unique(length[length > 1]).tolist():
            at = start[(length == size) & (salt[start] < 0)] if size <= BIG else np.zeros(0, np.int64)
            i, j = np.triu_indices(size, 1) if len(at) else (np.zeros(0, np.int64),) * 2
            step = max(1, 500_000 // max(len(i), 1))
            for k in range(0, len(at), step):
                x, y = (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
                good = _possible(n[x], pos[x], n[y], pos[y], t) & (own[x] != own[y])
                x, y = x[good], y[good]
                if not len(x):
                    continue
                must = np.minimum(_least(n[x], n[y], t), SHARED).astype(np.int64)
                ends = np.stack((np.minimum(own[x], own[y]), np.maximum(own[x], own[y]), must))
                (a, b, must), times = np.unique(ends, axis=1, return_counts=True)
                yield batch(None, a, b, times << 32 | must)
        for k, size in zip(start, length, strict=True):
            if size > BIG or salt[k] >= 0:
                rows = slice(k, k + size)
                yield batch(gram[rows], own[rows], None, place[rows])

    def batch(*cols: np.ndarray | None) -> pa.RecordBatch:
        size = max(len(c) for c in cols if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in cols], ["gram", "a", "b", "place"])

    ordered = prefixes.repartition("gram", "salt").sortWithinPartitions("gram", "salt")
    return ordered.mapInArrow(_runs(2, meet), "gram long, a long, b long, place long")


def similar_pairs(texts: DataFrame, edges: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The rows of edges (a, b) whose texts (id, text; a written table, an id once) have at least this Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        last, sets = b"", np.zeros(0, np.uint64)
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                text = x.as_buffer().to_pybytes()
                if text != last:  # a text with many pairs comes with all of them
                    last, sets = text, np.unique(rolling.shingles(text, shingle))
                other = np.unique(rolling.shingles(y.as_buffer().to_pybytes(), shingle))
                union = len(np.union1d(sets, other))
                good.append(union > 0 and len(sets) + len(other) - union >= similarity * union)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    first = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    second = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    return edges.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


class Groups:
    """Groups of texts by the links that were found so far."""

    def __init__(self, texts: DataFrame, similarity: float, shingle: int) -> None:
        self.texts, self.similarity, self.shingle = texts, similarity, shingle
        self.roots = store(texts.sparkSession.createDataFrame([], "node long, root long"), "roots")

    def check(self, edges: DataFrame) -> bool:
        """Check edges (a, b) and unite the groups of those that are links; whether any are."""
        links = store(similar_pairs(self.texts, edges, self.similarity, self.shingle), "links")
        found = not links.isEmpty()
        if found:
            old = self.roots
            self.roots = components(old.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))
            release(old)
        release(links)
        return found

    def of(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        """rows with the root of the text in column."""
        here = self.roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
        return rows.join(here, F.col(column) == F.col("__node"), "left").withColumn(name, F.coalesce("__root", column)).drop("__node", "__root")

    def open(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b, ...) between different groups, with ra and rb."""
        return self.of(self.of(pairs, "a", "ra"), "b", "rb").where("ra != rb")


def _by_pairs(groups: Groups, pairs: DataFrame) -> None:
    """Check pairs (a, b, times; a written table, released here) until none is between different groups."""
    for k in range(ROUNDS + 1):
        left = store(groups.open(pairs), "open")
        release(pairs)
        if left.isEmpty():
            release(left)
            return
        if k == ROUNDS:
            groups.check(left)
            release(left)
            return
        best = left.groupBy(F.greatest("ra", "rb").alias("r")).agg(F.max(F.struct("times", -F.least("ra", "rb"), "a", "b")).alias("x"))
        chosen = store(best.select("x.a", "x.b"), "chosen")
        groups.check(chosen)
        rest = left.select("a", "b", "times").join(chosen.select(F.col("a").alias("__a"), F.col("b").alias("__b")), (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b")), "left_anti")
        pairs = store(rest, "pairs")
        release(left, chosen)


def _leaders(rows: DataFrame, bitmaps: DataFrame, t: float) -> DataFrame:
    """(a, b): each row of a run with the likest of three of the run's rows."""
    three = [F.min("id"), F.max("id"), F.min_by("id", F.xxhash64("id"))]
    heads = rows.groupBy("gram").agg(F.array_distinct(F.array(*three)).alias("heads"))
    pairs = rows.join(heads, "gram").select("id", F.explode("heads").alias("b")).where("id != b").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (_matrix(batch.column(k).to_pylist()) for k in (3, 5))
                gap = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) / _most(batch.column(2).to_numpy(), batch.column(4).to_numpy(), t)
                out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gap)], ["a", "b", "gap"])
                yield out.filter(pa.array(gap <= 1))

    one = bitmaps.select("id", F.col("n").alias("n1"), F.col("bits").alias("bits1"))
    other = bitmaps.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("bits2"))
    known = pairs.join(one, "id").join(other, "b").select("id", "b", "n1", "bits1", "n2", "bits2").mapInArrow(run, "a long, b long, gap double")
    return known.groupBy("a").agg(F.min(F.struct("gap", "b")).alias("x")).select("a", "x.b")


def _apart(rows: DataFrame, t: float, likest: bool) -> DataFrame:
    """(a, b): pairs of rows (gram, id, n, pos, bits, root) that have a gram in common, can reach t and are of different roots: all of
    them, or of each row outside its run's largest group the one whose bitmaps are likest."""
    crowds = rows.groupBy("gram").agg(F.count("*").alias("rows"), F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    blocks = F.when(F.col("rows") > RUN, F.ceil(F.col("rows") / RUN * 2)).otherwise(1).cast("int")
    crowds = store(crowds.select("gram", blocks.alias("blocks")), "crowds")
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(mine, j).alias("x"), F.greatest(mine, j).alias("y")))
    dealt = rows.join(crowds, "gram").withColumn("p", F.explode(pairs)).select("gram", "p.x", "p.y", "id", "n", "pos", "bits", "root")

    def compare(cols: list[np.ndarray], start: np.ndarray, length: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, _, _, own, n, pos, bits, root = cols
        for k, size in zip(start, length, strict=True):
            m, p, r, o = n[k : k + size], pos[k : k + size], root[k : k + size], own[k : k + size]
            names, count = np.unique(r, return_counts=True)
            if len(names) == 1:
                continue
            maps = _matrix(bits[k : k + size])
            minor = np.flatnonzero(r != names[count.argmax()])  # a pair of different groups has an end among these
            step = max(1, 1_000_000 // size)
            for i in range(0, len(minor), step):
                at = minor[i : i + step]
                x, y = np.nonzero(_possible(m[at, None], p[at, None], m, p, t) & (r[at, None] != r))
                x = at[x]
                pieces = [np.bitwise_count(maps[x[h : h + 100_000]] ^ maps[y[h : h + 100_000]]).sum(1, dtype=np.int64) for h in range(0, len(x), 100_000)]
                gap = np.concatenate([np.zeros(0, np.int64), *pieces])
                most = _most(m[x], m[y], t)
                good = gap <= most
                x, y, close = x[good], y[good], (gap / most)[good]
                if likest:
                    best = np.lexsort((o[y], close, x))
                    best = best[np.unique(x[best], return_index=True)[1]]
                    x, y = x[best], y[best]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(o[x], o[y])), pa.array(np.maximum(o[x], o[y]))], ["a", "b"])

    key = ["gram", "x", "y"]
    out = store(dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_runs(3, compare), "a long, b long").distinct(), "candidates")
    release(crowds)
    return out


def _by_crowds(groups: Groups, crowd: DataFrame, bitmaps: DataFrame) -> None:
    """Check the rows of long runs (gram, id, place; a written table) until no two that can be links are in different groups."""
    t = groups.similarity
    heads = store(_leaders(crowd, bitmaps, t), "leaders")
    first = store(groups.open(heads).select("a", "b"), "open")
    groups.check(first)
    release(heads, first)
    split = groups.of(crowd, "id", "root").select("gram", "id", (F.col("place").bitwiseAND(0xFFFFFFFF)).cast("int").alias("pos"), "root")
    k = 0
    while k <= ROUNDS:
        open_ = store(split.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("gram"), "open-runs")
        if open_.isEmpty():
            release(open_)
            return
        rows = store(split.join(open_, "gram").join(bitmaps, "id").select("gram", "id", "n", "pos", "bits", "root"), "crowd")
        edges = _apart(rows, t, k < ROUNDS)
        found = groups.check(edges)
        release(open_, rows, edges)
        split = groups.of(crowd, "id", "root").select("gram", "id", (F.col("place").bitwiseAND(0xFFFFFFFF)).cast("int").alias("pos"), "root")
        k = k + 1 if found or k == ROUNDS else ROUNDS  # the last round takes all pairs


def linked(texts: DataFrame, similarity: float, shingle: int, likely: DataFrame) -> DataFrame:
    """(node, root) as of components, over all links of texts (id, text as binary; an id once).

    likely: pairs (a, b; a written table) that are checked first, as they make large groups cheaply.
    """
    met = store(_met(_prefixes(texts, similarity, shingle, _common(texts, shingle)), similarity), "met")
    times, must = F.shiftright("place", 32), F.col("place").bitwiseAND(0xFFFFFFFF)
    counted = met.where("gram is null").groupBy("a", "b").agg(F.sum(times).alias("times"), F.max(must).alias("must"))
    pairs = store(counted.where("times >= must").select("a", "b", "times"), "pairs")
    crowd = store(met.where("gram is not null").select("gram", F.col("a").alias("id"), "place"), "crowd-rows")
    release(met)
    ids = likely.unionByName(pairs.select("a", "b")).select(F.explode(F.array("a", "b")).alias("__id")).unionByName(crowd.select(F.col("id").alias("__id")))
    ids = store(ids.distinct(), "ids")  # written ids are known to be few where they are, and then the other texts are not shuffled
    picked = store(texts.join(ids, F.col("id") == F.col("__id"), "left_semi"), "picked")
    groups = Groups(picked, similarity, shingle)
    if not likely.isEmpty():
        groups.check(likely)
    _by_pairs(groups, pairs)
    if not crowd.isEmpty():
        some = store(crowd.select(F.col("id").alias("__id")).distinct(), "ids")
        bitmaps = store(_bitmaps(picked.join(some, F.col("id") == F.col("__id"), "left_semi"), shingle), "bitmaps")
        _by_crowds(groups, crowd, bitmaps)
        release(some, bitmaps)
    release(crowd, ids, picked)
    return groups.roots
