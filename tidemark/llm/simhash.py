"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits come from one pass over whole texts. Bits that vary together (correlations over all distinct fingerprints) form
groups of eight; neighbouring groups are merged into m partitions. If thresholds t_i >= -1 add up to max_bits - m + 1, two fingerprints
within max_bits differ in some partition i by at most t_i bits. For each m, a dynamic program allocates the thresholds with the least
estimated cost (probes plus candidates, from exact histograms over all fingerprints), and the cheapest m is used: with more fingerprints
it moves to fewer, wider partitions by itself. Probes meet stored values in sorted runs of equal partition values, where all pairs are
verified on all 64 bits, but only spanning forests of the links leave the task. Runs over ``RUN`` rows are first cut into blocks, and each
pair of blocks is a run of its own.

Edge cases: a null or wordless text has fingerprint zero; with fewer words than a shingle the whole sequence is the one shingle; equal
texts share a fingerprint and meet only once; a null doc_id is never a component's name unless nothing else is; an empty table gives an
empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, release, store, table
from .components import components
from .rolling import Rolling
from .setjoin import linked

BITS, GROUP = 64, 8
#: Rows of a run that one task compares at most; longer ones are cut into blocks.
RUN = 8192
#: Bits by which a probe may differ from its own partition value at most, by the partition's width.
MOST_PROBES = 600


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 hashes of the shingles, repeats included."""
    words = (text or b"").lower().split()  # bytes: lower-cases A-Z and splits at \x20 and \x09-\x0D only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, 42)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1)).tolist()
    ends = np.concatenate((gaps, [len(line)])).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=False)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None, shingle) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    chosen = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, fp long")


def _counted(fps: DataFrame, count: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all fingerprints of count(array) -> array of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += count(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["i", "n"])

    out = np.zeros(size, np.int64)
    for row in fps.select("fp").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # at most size rows
        out[row["i"]] = row["n"]
    return out


def _bit_counts(fp: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
    return np.rint(bits.T @ bits).astype(np.int64).ravel()


def bit_groups(together: np.ndarray, n: int) -> list[list[int]]:
    """Eight groups of eight bits each; a group grows by the bit that correlates most with those it has. together[i, j]: rows with both."""
    p = together / max(n, 1)
    one = np.diag(p)
    spread = np.sqrt(np.maximum(one * (1 - one), 1e-12))
    corr = np.abs((p - np.outer(one, one)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    while free:
        left = sorted(free)
        group = [left[int(np.argmax(corr[np.ix_(left, left)].max(1)))]]
        while len(group) < GROUP:
            rest = sorted(free - set(group))
            group.append(rest[int(np.argmax(corr[np.ix_(rest, group)].sum(1)))])
        free -= set(group)
        groups.append(sorted(group))
    return groups


def _gather(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The values of these bits, packed."""
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _distances(histogram: np.ndarray) -> np.ndarray:
    """Of two random rows, the probability of each distance 0-8 in a group with this histogram of 256 values."""
    apart = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :])
    p = histogram / max(histogram.sum(), 1)
    joint = np.outer(p, p)
    return np.array([joint[apart == k].sum() for k in range(GROUP + 1)])


def _probes(width: int, t: int) -> int:
    return sum(math.comb(width, k) for k in range(t + 1))


def allocate(distances: list[np.ndarray], n: int, max_bits: int) -> tuple[list[int], list[int]]:
    """(groups in each partition, threshold of each partition) with the least estimated cost. A pair's check costs 1, a row of a probe 60."""
    best: tuple[float, list[int], list[int]] | None = None
    for m in range(1, min(len(distances), max_bits + 1) + 1):
        counts = [len(distances) // m + (k < len(distances) % m) for k in range(m)]
        at, costs = 0, []
        for c in counts:
            spread = np.ones(1)
            for d in distances[at : at + c]:
                spread = np.convolve(spread, d)
            at += c
            width, cost = c * GROUP, {-1: 0.0}
            for t in range(min(width, max_bits) + 1):
                if t and _probes(width, t) > MOST_PROBES:
                    break
                cost[t] = n * 60.0 * (1 + _probes(width, t) * (t > 0)) + n * n / 2.0 * float(spread[: t + 1].sum()) * (2 if t else 1)
            costs.append(cost)
        table_: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # by the sum of t + 1
        for cost in costs:
            new: dict[int, tuple[float, list[int]]] = {}
            for used, (c0, ts) in table_.items():
                for t, c1 in cost.items():
                    k = used + t + 1
                    if k <= max_bits + 1 and (k not in new or c0 + c1 < new[k][0]):
                        new[k] = (c0 + c1, [*ts, t])
            table_ = new
        if max_bits + 1 in table_ and (best is None or table_[max_bits + 1][0] < best[0]):
            best = (table_[max_bits + 1][0], counts, table_[max_bits + 1][1])
    assert best is not None, "max_bits is too large for the probes allowed"
    return best[1], best[2]


def _hooked(r: np.ndarray, c: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Positions of the edges (r, c) that make a forest on top of label (each node's tree, updated in place)."""
    taken, left = [], np.arange(len(r))
    while True:
        x, y = label[r[left]], label[c[left]]
        apart = x != y
        left, x, y = left[apart], x[apart], y[apart]
        if not len(left):
            return np.concatenate(taken) if taken else left
        high, first = np.unique(np.maximum(x, y), return_index=True)
        taken.append(left[first])
        parent = np.arange(len(label))
        parent[high] = np.minimum(x, y)[first]  # a tree joins one of a smaller label: no circles
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label[:] = parent[label]


def _links(stored: np.ndarray, probing: np.ndarray, names: tuple[np.ndarray, np.ndarray], max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between stored and probing fingerprints as pairs of their names: a spanning forest of them."""
    own, at = np.unique(np.concatenate(names), return_inverse=True)
    here, there = at[: len(stored)], at[len(stored) :]
    label = np.arange(len(own))
    step = max(1, 1_000_000 // max(len(stored), 1))
    for i in range(0, len(probing), step):
        apart = np.bitwise_count(probing[i : i + step, None] ^ stored[None, :])
        r, c = np.nonzero(apart <= max_bits)
        x, y = there[i + r], here[c]
        k = _hooked(x, y, label)
        yield own[x[k]], own[y[k]]


def near_pairs(fps: DataFrame, max_bits: int = 3, name: str = "fp") -> DataFrame:
    """(a, b): links between the rows of fps (fp and the column name, a long), by their names, that join all within max_bits."""
    n = fps.count()
    groups = bit_groups(_counted(fps, _bit_counts, BITS * BITS).reshape(BITS, BITS), n)
    histograms = _counted(fps, lambda fp: np.concatenate([np.bincount(_gather(fp, g).astype(np.int64), minlength=256) for g in groups]), GROUP * 256)
    counts, thresholds = allocate([_distances(h) for h in histograms.reshape(GROUP, 256)], n, max_bits)
    ends = list(itertools.accumulate(counts))
    parts = [([b for g in groups[e - c : e] for b in g], t) for e, c, t in zip(ends, counts, thresholds, strict=True)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, (bits, t) in enumerate(parts):
                if t < 0:
                    continue
                own = _gather(fp, bits)
                masks = [sum(1 << k for k in chosen) for r in range(t + 1) for chosen in itertools.combinations(range(len(bits)), r)] if t else []
                for kind, mask in [(0, 0), *((1, x) for x in masks)]:
                    size = len(fp)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(size, i, np.int32)), pa.array((own ^ np.uint64(mask)).view(np.int64)), pa.array(np.full(size, kind, np.int8)), *batch.columns], ["part", "value", "kind", "fp", "name"]
                    )

    probing = {i: t > 0 for i, (_, t) in enumerate(parts)}
    rows = store(fps.select("fp", F.col(f"`{name}`").alias("name")).mapInArrow(spread, "part int, value long, kind tinyint, fp long, name long"), "probes")
    crowds = store(rows.groupBy("part", "value").agg(F.count("*").alias("rows")).where(F.col("rows") > RUN).withColumn("blocks", F.ceil(F.col("rows") / RUN * 2).cast("int")), "crowds")
    one, many = F.lit(0), F.lit(None).cast("int")
    if crowds.count():
        joined = rows.join(crowds, ["part", "value"], "left")
        mine = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(mine, j).alias("x"), F.greatest(mine, j).alias("y")))
        split = joined.where("blocks is not null").select("part", "value", "kind", "fp", "name", mine.alias("mine"), F.explode(pairs).alias("p")).select("part", "value", "kind", "fp", "name", "mine", "p.x", "p.y")
        rows = joined.where("blocks is null").select("part", "value", "kind", "fp", "name", many.alias("mine"), one.alias("x"), one.alias("y")).unionByName(split)
    else:
        rows = rows.select("part", "value", "kind", "fp", "name", many.alias("mine"), one.alias("x"), one.alias("y"))
    key = ["part", "value", "x", "y"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; the end of a batch is kept until the next one, as a run may go on."""
        kept: list[np.ndarray] = []

        def pairs(cols: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            part, value, x, y, kind, mine, fp, own = cols
            cut = np.flatnonzero((np.diff(part) != 0) | (np.diff(value) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1
            first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(fp)]))
            for a, b in zip(first[last - first > 1], last[last - first > 1], strict=True):
                f, o, k = fp[a:b], own[a:b], kind[a:b] == 1
                if not probing[int(part[a])]:
                    yield from _links(f, f, (o, o), max_bits)
                elif k.any() and not k.all():
                    yield from _links(f[~k], f[k], (o[~k], o[k]), max_bits)

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols[6] = cols[6].view(np.uint64)
            if kept:
                cols = [np.concatenate((k, c)) for k, c in zip(kept, cols, strict=True)]
            ends = [c[-1] for c in cols[:4]] if len(cols[0]) else []
            going = np.logical_and.reduce([c == e for c, e in zip(cols[:4], ends, strict=True)]) if ends else np.zeros(0, bool)
            at = int(np.argmax(going)) if len(going) else 0
            kept = [c[at:] for c in cols]
            yield _batch(pairs([c[:at] for c in cols])) if at else _batch([])
        if kept and len(kept[0]):
            yield _batch(pairs(kept))

    ordered = rows.select(*key, "kind", F.coalesce("mine", F.lit(0)).alias("mine"), "fp", "name").repartition(*key).sortWithinPartitions(*key)
    return ordered.mapInArrow(compare, "a long, b long")


def _batch(pairs) -> pa.RecordBatch:
    found = list(pairs)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *(p[i] for p in found)])) for i in (0, 1)], ["a", "b"])


def classes(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of prints (doc_id, fp; a written table)."""
    distinct = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(near_pairs(distinct, max_bits))
    named = store(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    names = store(named.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    return named.join(names, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of docs."""
    prints = store(fingerprints(docs, id_col, text_col, shingle), "prints")
    found = store(classes(prints, max_bits), "classes")
    return prints.join(found, "fp").select("doc_id", "fp", "component_id")


def _marks(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, digest of the lower-cased words, fp of their distinct shingles): fp is for finding candidates only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1)]
            digests = [xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in texts]
            prints = np.array([majority(np.unique(rolling.shingles(t, shingle))) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(prints.view(np.int64))], ["doc_id", "digest", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, digest binary, fp long")


def _likely(texts: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): texts (digest, fp, least; a written table) whose fingerprints are within max_bits, as few pairs as join them all."""
    own = store(texts.groupBy("fp").agg(F.min("least").alias("name")), "fingerprints")
    near = near_pairs(own.select("fp", "name"), max_bits, "name")
    same = texts.join(own, "fp").where("least != name").select(F.col("name").alias("a"), F.col("least").alias("b"))
    out = store(near.unionByName(same), "likely")
    release(own)
    return out


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, max_bits: int = 3) -> DataFrame:
    """docs with one document of each group: that with the smallest doc_id, and all rows that repeat it with the same words once.

    Texts of equal words are one. Pairs whose SimHash fingerprints are within max_bits are checked first; fingerprints this close can't show
    most links at 0.8, so every other pair that can reach similarity is found by the prefix-filter join and checked as well. Links make the
    groups. Documents without words are one text; a row without doc_id is neither compared nor dropped; rows that repeat a doc_id with
    other words stay or go together, by the longest of their texts. Only ids that go are joined with the texts.
    """
    own = docs.where("doc_id is not null")
    marks = store(_marks(own, shingle), "marks")
    repeated = not marks.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty()
    if repeated:
        return _with_repeats(docs, similarity, shingle, max_bits)
    texts = store(marks.groupBy("digest", "fp").agg(F.min("doc_id").alias("least")), "texts")
    # few ids go, so that joins with them rarely have to shuffle texts
    copies = store(marks.select(F.col("doc_id").alias("__id")).join(texts, F.col("__id") == F.col("least"), "left_anti").distinct(), "copies")
    sets = own.join(copies, F.col("doc_id") == F.col("__id"), "left_anti").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text"))
    likely = _likely(texts, max_bits)
    release(marks)
    roots = linked(sets, similarity, shingle, likely)
    # roots holds the texts that give way to one of a smaller doc_id
    gone = store(copies.unionByName(roots.select(F.col("node").alias("__id"))), "gone")
    release(texts, copies, likely, roots)
    return own.join(gone, F.col("doc_id") == F.col("__id"), "left_anti").unionByName(docs.where("doc_id is null"))


def _with_repeats(docs: DataFrame, similarity: float, shingle: int, max_bits: int) -> DataFrame:
    """For tables that repeat a doc_id: one row stands for all that repeat it, and rows of a doc_id that stays are compared by words."""
    own = docs.where("doc_id is not null")
    words = F.concat_ws(" ", F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), SPACE), ""))
    one = own.groupBy("doc_id").agg(F.max(F.struct(F.length(F.coalesce("text", F.lit(""))), F.col("text"))).alias("x")).select("doc_id", "x.text")
    stay = store(drop_near_duplicates(store(one, "one-each"), similarity, shingle, max_bits).select(F.col("doc_id").alias("__id")), "stay")
    kept = own.join(stay, F.col("doc_id") == F.col("__id"), "left_semi").withColumn("__words", F.sha2(words, 256))
    return kept.dropDuplicates(["doc_id", "__words"]).drop("__words").unionByName(docs.where("doc_id is null"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
