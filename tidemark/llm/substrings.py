"""Duplicate passages by relative Lempel-Ziv parsing.

The reference is the corpus itself: a document is parsed against all documents of smaller doc_id. A window (``window`` consecutive words) is
known to a document if it also starts in such a document; known windows next to each other are a run, and a run is parsed greedily from
left to right. Its first window, every ``window``-th one and its last are looked up in the index of the reference, which says where each
starts first (document and position); from there on document and reference are compared word by word, as far as they agree: that is a
factor, with its source. A seed that lies in the factor before it is part of that one; where the source breaks off, the next seed's factor
goes on, so passages that continue in another document are not lost at a boundary: seeds are no farther apart than a factor is long, and
factors of at least ``window`` words must cover a run without a gap. Words that no factor covers stay.

The index is dealt into blocks by content. Of the ``seed``-word grams of a window the one with the least hash is its anchor, so equal windows
have equal anchors, and about one position in 22 is an anchor. Anchors that start in two documents or more mark bits in a bitmap of a fixed
size (``BITMAP_BITS``), the only thing that is broadcast; a window whose anchor's bit is clear is unknown anywhere else. The others are
hashed, and each block of the index (a partition by window hash) keeps the smallest document and position for each window, partly
summed before the shuffle, so a passage that a third of all documents share is no hot key. Which windows are known is found by sending each
document the windows that it owns: a candidate that it does not own is known from an earlier one.

Hashes (64 bits) only find candidates; words decide. Edge cases: a null text has no words; documents of fewer words than a window lose
none; a null doc_id neither loses words nor is a reference; rows that repeat a doc_id don't count as earlier than each other and share
what the index holds of it, so that a window known only by another of these rows counts as their own; an empty table gives an empty
result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, store, table
from .rolling import Rolling

WINDOW, SEED = 50, 8
#: Bits of the map of shared anchors; more anchors only make it less selective.
BITMAP_BITS = 1 << 26

class Parser(Rolling):
    """Hashes of a document's windows and anchors."""

    def __init__(self, window: int = WINDOW, seed: int = SEED) -> None:
        super().__init__()
        self.window, self.seed = window, seed

    def anchors(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(prefix sums, anchor hash of each window)."""
        sums = self.sums(words)
        grams = self.grams(sums, self.seed)
        return sums, _sliding_min(grams, self.window - self.seed + 1)

    def windows(self, sums: np.ndarray) -> np.ndarray:
        return self.grams(sums, self.window)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for each i, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _words(x: pa.Scalar) -> list[bytes]:
    return x.as_buffer().to_pybytes().split() if x.is_valid else []  # at \x20 and \x09-\x0D only


def _shared_anchors(docs: DataFrame, window: int, seed: int) -> np.ndarray:
    """The bitmap, as bytes: bit h % BITMAP_BITS is set if an anchor of that hash lies in two documents or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(window, seed)
        for batch in batches:
            ids, found = [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = _words(x)
                if i is not None and len(words) >= window:
                    a = parser.anchors(words)[1]
                    a = np.unique(a[np.concatenate(([True], a[1:] != a[:-1]))])
                    found.append(a)
                    ids.append(np.full(len(a), i, np.int64))
            for k in range(0, len(found), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found[k : k + 2000]).view(np.int64)), pa.array(np.concatenate(ids[k : k + 2000]))], ["anchor", "doc_id"])

    anchors = docs.mapInArrow(run, "anchor long, doc_id long").groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    bit = F.col("anchor").bitwiseAND(BITMAP_BITS - 1)
    chunks = anchors.where("a < b").select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("chunk")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(32767)).alias("bits"))
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for row in chunks.collect():  # at most BITMAP_BITS / 32768 rows of 4 KB
        out[row["chunk"] * 4096 : (row["chunk"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def _candidates(parser: Parser, bitmap: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(which windows have a shared anchor, all windows' hashes)."""
    sums, a = parser.anchors(words)
    bit = (a & np.uint64(BITMAP_BITS - 1)).astype(np.int64)
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1, parser.windows(sums)


def runs(known: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """(start, end) in words of the runs of known windows: known[i] tells whether the window at i is known."""
    at = np.flatnonzero(known)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    firsts, lasts = at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))]
    return [(int(a), int(b) + window) for a, b in zip(firsts, lasts, strict=True)]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _index(docs: DataFrame, bitmap, window: int, seed: int) -> DataFrame:
    """(w, source: (doc_id, at), last): where each window that may be shared starts first, and the largest doc_id that has it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(window, seed)
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = _words(x)
                if i is None or len(words) < window:
                    continue
                some, w = _candidates(parser, bitmap.value, words)
                at = np.flatnonzero(some)
                if len(at):
                    own, first = np.unique(w[at], return_index=True)
                    columns = [pa.array(own.view(np.int64)), pa.array(np.full(len(own), i, np.int64)), pa.array(at[first])]
                    yield pa.RecordBatch.from_arrays(columns, ["w", "doc_id", "at"])

    rows = docs.mapInArrow(emit, "w long, doc_id long, at long")
    return rows.groupBy("w").agg(F.min(F.struct("doc_id", "at")).alias("source"), F.max("doc_id").alias("last"))


def _known(docs: DataFrame, index: DataFrame, bitmap, window: int, seed: int) -> DataFrame:
    """(doc_id, n_words, runs, text): text is that of the words, one space between them."""
    owned = index.groupBy(F.col("source.doc_id").alias("owner")).agg(F.collect_list("w").alias("owned"))
    joined = docs.join(owned, docs.doc_id == owned.owner, "left").select("doc_id", "text", "owned")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(window, seed)
        for batch in batches:
            out: list[tuple] = []
            for i, x, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = _words(x)
                found: list[tuple[int, int]] = []
                if i is not None and len(words) >= window:
                    some, w = _candidates(parser, bitmap.value, words)
                    at = np.flatnonzero(some)
                    if len(at):
                        mine = own.values.to_numpy(zero_copy_only=False).view(np.uint64) if own.is_valid else np.zeros(0, np.uint64)
                        some[at[np.isin(w[at], mine)]] = False
                        found = runs(some, window)
                out.append((i, len(words), [{"start": a, "end": b} for a, b in found], b" ".join(words)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["doc_id", "n_words", "runs", "text"])

    kinds = [pa.int64(), pa.int64(), _RUNS, pa.binary()]
    return joined.mapInArrow(find, "doc_id long, n_words long, runs array<struct<start:long,end:long>>, text binary")


def _seeds(found: DataFrame, window: int) -> DataFrame:
    """(row, run, k, w): of each run (row, its start) the hash of every window-th window and of the last one, k words from the start."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            rows = []
            for row, spans, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                hashes = rolling.grams(rolling.sums(_words(x)), window).view(np.int64)
                for a, b in ((s["start"], s["end"]) for s in spans):
                    at = [*range(0, b - a - window, window), b - a - window]
                    rows += [(row, a, k, int(hashes[a + k])) for k in at]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["row", "run", "k", "w"])

    return found.mapInArrow(cut, "row long, run long, k long, w long")


def _texts_of_runs(found: DataFrame) -> DataFrame:
    """(row, run, own): each run's words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, spans, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = _words(x)
                rows += [(row, s["start"], b" ".join(words[s["start"] : s["end"]])) for s in spans]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["row", "run", "own"])

    return found.mapInArrow(cut, "row long, run long, own binary")


def extended(mine: list[bytes], words: list[bytes], seeds: list[tuple[int, int]], window: int) -> list[tuple[int, int, int]]:
    """(start, end, source start) of the factors from seeds (place in mine, place in words, in order): as far as both agree, word by word.

    A seed inside the factor before it, at the same offset, is part of that one.
    """
    out: list[tuple[int, int, int]] = []
    for k, at in seeds:
        if out and k < out[-1][1] and k - at == out[-1][0] - out[-1][2] and k + window <= out[-1][1]:
            continue
        size, most = 0, min(len(mine) - k, len(words) - at)
        while size < most and mine[k + size] == words[at + size]:
            size += 1
        if size >= window:
            out.append((k, k + size, at))
    return out


def factors(found: DataFrame, index: DataFrame, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, start, end, source, source_start): the factors of all runs of found (row, runs, text), words compared."""
    some = found.where(F.size("runs") > 0).select("row", "runs", "text")
    located = _seeds(some, window).join(index, "w").groupBy("row", "run", F.col("source.doc_id").alias("source"))
    located = store(located.agg(F.sort_array(F.collect_list(F.struct("k", F.col("source.at").alias("at")))).alias("seeds")), "located")
    needed = store(located.select(F.col("source").alias("__id")).distinct(), "sources")
    refs = docs.join(needed, F.col("doc_id") == F.col("__id"), "left_semi").select(F.col("doc_id").alias("source"), F.col("text").alias("ref"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, words = None, []
        for batch in batches:
            rows = []
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for (row, run, source, seeds), own, ref in zip(zip(*columns, strict=True), batch.column(4), batch.column(5), strict=True):
                text = ref.as_buffer()
                if last is None or not last.equals(text):
                    last, words = text, _words(ref)
                got = extended(_words(own), words, [(x["k"], x["at"]) for x in seeds], window)
                rows += [(row, run + a, run + b, source, at) for a, b, at in got]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["row", "start", "end", "source", "source_start"])

    # rows that repeat a doc_id are sources together: the longest factors stay, and each has to agree by itself
    met = located.join(_texts_of_runs(some), ["row", "run"]).join(refs, "source").select("row", "run", "source", "seeds", "own", "ref")
    out = store(met.mapInArrow(extend, "row long, start long, end long, source long, source_start long"), "factors")
    release(located, needed)
    return out


def parsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, factors: array of (start, end) in words, kept: the words left, joined by spaces), a row for each of docs.

    Where factors cover every run, as they do unless two windows share a hash, runs are what is removed, and texts need not be joined with
    factors; else the rows that are short of factors get theirs by a join.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(_shared_anchors(docs, window, seed))
    index = store(_index(docs, bitmap, window, seed), "index")
    found = store(_known(docs, index, bitmap, window, seed).withColumn("row", F.monotonically_increasing_id()), "known", "zstd")
    shared = store(index.where("source.doc_id < last").select("w", "source"), "shared")
    release(index)
    got = factors(found, shared, docs, window)
    covered = got.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("got"))
    claimed = found.where(F.size("runs") > 0).select("row", "runs").join(covered, "row", "left")
    short = store(claimed.where(~_covers(F.coalesce("got", F.array().cast("array<struct<start:long,end:long>>")), F.col("runs"))).select(F.col("row").alias("__row"), "got"), "short")
    if short.isEmpty():
        return _without(found, F.col("runs"), window)
    whole = found.join(short.select("__row"), F.col("row") == F.col("__row"), "left_anti")
    rest = found.join(short, F.col("row") == F.col("__row")).withColumn("runs", F.coalesce("got", F.array().cast("array<struct<start:long,end:long>>"))).select(*found.columns)
    return _without(whole, F.col("runs"), window).unionByName(_without(rest, F.col("runs"), window))


def _covers(parts, spans):
    """Whether parts, in order of their starts, cover each of spans."""

    def reach(span):
        return F.aggregate(parts, span["start"], lambda at, x: F.when((x["start"] <= at) & (x["end"] > at), x["end"]).otherwise(at)) >= span["end"]

    return F.forall(spans, reach)


def _without(found: DataFrame, spans, window: int) -> DataFrame:
    """parsed()'s columns: found with the words of spans (which may touch or overlap) taken out."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, n, gone, x in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                merged: list[list[int]] = []
                for s in sorted((s["start"], s["end"]) for s in gone):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                words = _words(x)
                for a, b in reversed(merged):
                    del words[a:b]
                out.append((i, n, n - len(words), [{"start": a, "end": b} for a, b in merged], b" ".join(words)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["doc_id", "n_words", "n_removed", "factors", "kept"])

    kinds = [pa.int64(), pa.int64(), pa.int64(), _RUNS, pa.binary()]
    chosen = found.select("doc_id", "n_words", spans.alias("runs"), "text")
    some = chosen.where(F.size("runs") > 0).mapInArrow(take, "doc_id long, n_words long, n_removed long, factors array<struct<start:long,end:long>>, kept binary")
    whole = chosen.where(F.size("runs") == 0).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("runs").alias("factors"), F.col("text").alias("kept"))
    return whole.unionByName(some)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parsed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
known AS (SELECT r, i FROM g QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
gone AS (SELECT DISTINCT r, i + k AS p FROM known, range({WINDOW}) AS x(k)),
pos AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS words, count(*) AS n FROM pos ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.r = kept.r
"""
