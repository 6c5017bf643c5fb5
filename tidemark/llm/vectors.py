"""Near-duplicate embeddings by a robust-pruned flat graph.

Equal vectors meet first and stand for each other; vectors of different lengths are separate tables. K-means on a bounded sample gives the
cluster centres; a vector belongs to each shard whose centre is within ``margin`` of its best one, and its best is its home. Its best two
also have it as a node of their graph: a node's candidates are its nearest nodes and some far ones, robust pruning drops a candidate that a
kept one is closer to. The adjacency lists of a node from its overlapping shards are united. In each of its shards a vector searches
greedily from medoids (farthest-first entry points), then expands the range: every node found within the radius is expanded in turn until
no new one is found. Hits near the radius are verified in double precision, and count only where their home is, so no pair counts twice. A
hit whose node can't reach the query's home in turn, or that only one of two rows of a block found, counts for both.

For two samples of queries brute force over all vectors gives the true links: the first sets the margin that reaches their homes, the second
audits the recall; both are means over queries, so no large group hides the rest, and are drawn larger while few queries have links.
Short of ``target`` the margin doubles and the search runs again; a recall under ``LEAST`` at the widest margin is an error. Shards of more
than ``BLOCK`` rows are cut into blocks, searched from each other block in its own task: beyond about ``SHARDS`` * ``BLOCK`` different
vectors, work grows with the square of a shard's rows.

Edge cases: vectors that are null, zero, or hold null or non-finite components link with nothing; repeated rows link with each other; rows
that repeat a vec_id are vectors of their own; a null vec_id is its own component; an empty table gives an empty result; other columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, store, table
from .components import components

#: Vectors of a shard on average, most shards, vectors that k-means sees, most rows of a block.
SHARD, SHARDS, SAMPLE, BLOCK = 160, 2048, 16_384, 3072
#: Shards whose graphs have a vector as a node.
OVERLAP = 2
#: Queries of a sample that must have links, if there are any; most queries of a sample; least recall.
LINKED, QUERIES, LEAST = 40, 4096, 0.9
#: Margin where no query of the sample has a link; hundredths of a margin, at most 2 between unit vectors.
WIDE, GAPS = 0.12, 202
NEAREST, FAR, DEGREE, ALPHA, ENTRIES, BEAM = 40, 16, 24, 1.2, 24, 12


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [p.flatten().to_numpy(zero_copy_only=False) for p in parts]
    return np.concatenate(flat).reshape(-1, dim) if flat else np.zeros((0, dim))


def centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means, started from evenly spread rows."""
    c = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), c)
    return c


def build(x: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Robust-pruned neighbours of each row of unit vectors x, with the reverse edges."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, int)] * n
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    take = min(NEAREST, n - 1)
    near = np.argpartition(-sims, take - 1, axis=1)[:, :take]
    cand = np.concatenate((near, rng.integers(0, n, (n, FAR))), axis=1)
    rows = np.arange(n)
    own = sims[rows[:, None], cand]
    alive = own > -2
    order = np.argsort(-own, axis=1, kind="stable")
    cand, own, alive = (np.take_along_axis(a, order, axis=1) for a in (cand, own, alive))
    picked: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(DEGREE):
        some = alive.any(1)
        if not some.any():
            break
        at = alive.argmax(1)
        p = cand[rows, at]
        picked.append((rows[some], p[some]))
        between = sims[p[:, None], cand]
        alive &= ALPHA * (1 - between) > (1 - own)
        alive[rows, at] = False
        alive &= cand != p[:, None]
    a, b = (np.concatenate([q[i] for q in picked]) for i in (0, 1))
    back = np.repeat((0, 1), len(a))
    a, b = np.concatenate((a, b)), np.concatenate((b, a))
    order = np.lexsort((-sims[a, b], back, a))  # a node's own edges, then those that came back to it, the nearest first
    a, b = a[order], b[order]
    first = np.sort(np.unique(a * n + b, return_index=True)[1])
    return np.split(b[first], np.searchsorted(a[first], np.arange(1, n)))


def entry_points(x: np.ndarray, k: int) -> np.ndarray:
    """The medoid, then farthest-first."""
    at = [int((x @ x.mean(0)).argmax())]
    nearest = x @ x[at[0]]
    while len(at) < min(k, len(x)):
        at.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[at[-1]])
    return np.array(at)


def search(x: np.ndarray, lists: list[np.ndarray], queries: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query rows, node rows, cosines) within radius, for blocks of queries; lists: the neighbours of each node.

    The greedy phase follows the first 2 * DEGREE neighbours of a node, the range expansion all of them.
    """
    n, entries = len(x), entry_points(x, ENTRIES)
    neighbours = np.full((n, 2 * DEGREE), -1, np.int64)
    for k, v in enumerate(lists):
        neighbours[k, : len(v[: 2 * DEGREE])] = v[: 2 * DEGREE]
    flat = np.concatenate(lists).astype(np.int64) if n else np.zeros(0, np.int64)
    lengths = np.array([len(v) for v in lists], np.int64)
    starts = np.cumsum(lengths) - lengths
    for lo in range(0, len(queries), 512):
        q = queries[lo : lo + 512]
        m, rows = len(q), np.arange(len(q))
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def visit(r: np.ndarray, c: np.ndarray, q=q, seen=seen, found=found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            seen[r, c] = True
            s = np.einsum("ij,ij->i", q[r], x[c])
            hit = s >= radius
            found.append((r[hit], c[hit], s[hit]))
            return r, c, s

        start = np.repeat(rows, len(entries)), np.tile(entries, m)
        _, _, s = visit(*start)
        beam, score = np.tile(entries, (m, 1)), s.reshape(m, -1)
        done = np.zeros(beam.shape, bool)
        active = rows
        for _ in range(64):  # greedy: the best node of the beam that isn't expanded yet
            keep = np.argsort(-score[active], axis=1, kind="stable")[:, :BEAM]
            beam_a, score_a, done_a = (np.take_along_axis(v[active], keep, axis=1) for v in (beam, score, done))
            open_ = np.where(done_a, -9.0, score_a)
            best = open_.argmax(1)
            going = open_[np.arange(len(active)), best] > -9
            # a query ends when its best node is expanded and no open one is among the first few
            going &= best < BEAM // 2
            active, beam_a, score_a, done_a, best = active[going], beam_a[going], score_a[going], done_a[going], best[going]
            if not len(active):
                break
            i = np.arange(len(active))
            done_a[i, best] = True
            nb = neighbours[beam_a[i, best]]
            nb = np.where(nb < 0, n, nb)
            fresh = ~seen[active[:, None], nb]
            at, col = np.nonzero(fresh)
            new = np.full(nb.shape, -9.0)
            if len(at):
                new[at, col] = visit(active[at], nb[at, col])[2]
            width = BEAM + nb.shape[1]
            nxt = [np.full((m, width), f) for f in (0, -9.0, True)]
            for v, a, b in zip(nxt, (beam_a, score_a, done_a), (np.where(nb == n, 0, nb), new, ~fresh), strict=True):
                v[active, : a.shape[1]] = a
                v[active, BEAM:] = b
            beam, score, done = nxt
        frontier = [np.concatenate([f[k] for f in found]) for k in (0, 1)]
        while len(frontier[0]):  # range expansion
            size = lengths[frontier[1]]
            r = np.repeat(frontier[0], size)
            c = flat[np.repeat(starts[frontier[1]] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            fresh = ~seen[r, c]
            key = np.unique(r[fresh] * (n + 1) + c[fresh])
            if not len(key):
                break
            r, c, s = visit(key // (n + 1), key % (n + 1))
            hit = s >= radius
            frontier = [r[hit], c[hit]]
        yield tuple(np.concatenate([f[k] for f in found]) + (lo if k == 0 else 0) for k in (0, 1, 2))


def _nodes(sims: np.ndarray) -> np.ndarray:
    """The shards that have each row as a node, from its cosines with the centres."""
    return sims >= np.partition(sims, -OVERLAP, axis=1)[:, -OVERLAP, None] if sims.shape[1] > OVERLAP else np.ones(sims.shape, bool)


def _members(reps: DataFrame, c: np.ndarray, margin: float, dim: int) -> DataFrame:
    """(shard, home: the home shard, node, rep, copies, vec) for each shard of each vector."""
    shared = reps.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                sims = _unit(_matrix(part.column(2), dim)) @ shared.value.T
                home = sims.argmax(1)
                node = _nodes(sims)
                r, s = np.nonzero(node | (sims >= sims.max(1, keepdims=True) - margin))
                taken = part.take(pa.array(r))
                yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(home[r].astype(np.int32)), pa.array(node[r, s]), *taken.columns], ["shard", "home", "node", "rep", "copies", "vec"])

    return reps.mapInArrow(run, "shard int, home int, node boolean, rep long, copies long, vec array<double>")


def _links(reps: DataFrame, c: np.ndarray, margin: float, cosine: float, dim: int) -> DataFrame:
    """(rep, n, root): of each vector, for each shard with hits, their number and a vector that is linked with it."""
    members = store(_members(reps, c, margin, dim), "members")
    sizes = {r["shard"]: r["count"] for r in members.groupBy("shard").count().collect()}  # at most SHARDS rows
    large = {k: -(-n // (BLOCK // 2)) for k, n in sizes.items() if n > BLOCK}
    blocks = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sorted(large.items()) for x in kv]), F.col("shard")), F.lit(1)) if large else F.lit(1)
    rows = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))

    def grow(key: tuple, t: pa.Table) -> pa.Table:
        x = _unit(_matrix(t.column("vec"), dim)).astype(np.float32)
        ids = t.column("rep").to_numpy()
        order = np.argsort(ids)
        lists = build(x[order], np.random.default_rng(abs(hash((int(key[0].as_py()), int(key[1].as_py()))))))
        own = ids[order]
        return pa.table({"rep": own, "next": pa.array([own[v] for v in lists], pa.list_(pa.int64()))})

    lists = rows.where("node").select("shard", "block", "rep", "vec").groupBy("shard", "block").applyInArrow(grow, "rep long, next array<long>")
    united = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"))
    linked = rows.where("node").join(store(united, "adjacency"), "rep", "left")
    only_asks = rows.where("not node").withColumn("next", F.lit(None).cast("array<long>"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)

    def placed(d: DataFrame, i: str, j: str, node: bool, query: str) -> DataFrame:
        """Rows for the cell of block i's nodes and block j's queries."""
        return d.select("shard", F.expr(i).alias("i"), F.expr(j).alias("j"), "rep", "copies", "home", F.lit(node).alias("node"), F.expr(query).alias("query"), "vec", "next")

    cells = placed(linked.where("blocks = 1"), "0", "0", True, "true").unionByName(placed(only_asks.where("blocks = 1"), "0", "0", False, "true"))
    if large:
        many, asking = (d.where("blocks > 1").withColumn("other", F.explode(others)) for d in (linked, only_asks))
        cells = cells.unionByName(placed(many, "block", "other", True, "block = other")).unionByName(placed(many.where("other != block"), "other", "block", False, "true"))
        cells = cells.unionByName(placed(asking, "other", "block", False, "true"))

    centre = reps.sparkSession.sparkContext.broadcast(c)
    near = max(1e-5, dim * 1.2e-7)  # what 32-bit products may be off by

    def look(key: tuple, t: pa.Table) -> pa.Table:
        shard = int(key[0].as_py())
        x = _unit(_matrix(t.column("vec"), dim))
        ids, copies, home = (t.column(k).to_numpy() for k in ("rep", "copies", "home"))
        node, query = np.flatnonzero(t.column("node").to_numpy()), np.flatnonzero(t.column("query").to_numpy())
        if not len(node) or not len(query):
            return pa.table({"rep": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        node = node[np.argsort(ids[node])]
        lists = t.column("next").to_pylist()
        own = ids[node]
        local = []
        for k in node:
            v = np.array(lists[k] or [], np.int64)
            at = np.minimum(np.searchsorted(own, v), len(own) - 1)
            local.append(at[own[at] == v])
        linked = np.zeros((len(ids), len(ids)), bool)
        for r, c_, s in search(x[node].astype(np.float32), local, x[query].astype(np.float32), cosine - near):
            r, c_ = query[r], node[c_]
            close = s < cosine + near
            good = (ids[r] != ids[c_]) & (home[c_] == shard)
            good[close & good] &= np.einsum("ij,ij->i", x[r[close & good]], x[c_[close & good]]) >= cosine
            linked[r[good], c_[good]] = True
        both = np.flatnonzero((home == shard) & t.column("node").to_numpy() & t.column("query").to_numpy())
        linked[np.ix_(both, both)] |= linked[np.ix_(both, both)].T
        n = linked @ copies
        r, c_ = np.nonzero(linked & (home != shard)[:, None])
        if len(r):  # nodes that don't search in the home of a query from elsewhere
            those, at = np.unique(c_, return_inverse=True)
            sims = x[those] @ centre.value.T
            absent = ~_nodes(sims) & (sims < sims.max(1, keepdims=True) - margin)
            alone = absent[at, home[r]]
            np.add.at(n, c_[alone], copies[r[alone]])
        label = np.arange(len(ids))
        r, c_ = np.nonzero(linked)
        while len(r):  # the smallest label of all that are linked
            new = label.copy()
            np.minimum.at(new, r, label[c_])
            np.minimum.at(new, c_, label[r])
            new = new[new]
            if (new == label).all():
                break
            label = new
        root = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(root, label, ids)
        at = np.flatnonzero(linked.any(0) | linked.any(1))
        return pa.table({"rep": ids[at], "n": n[at], "root": root[label[at]]})

    return cells.groupBy("shard", "i", "j").applyInArrow(look, "rep long, n long, root long")


def _true_links(reps: DataFrame, sample: np.ndarray, c: np.ndarray, cosine: float, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Brute force over all vectors for a sample of queries, in blocks: (weighted neighbours of each, itself included; of each query, by
    hundredths of the margin that it takes, the neighbours whose home it reaches, itself not included)."""
    shared = reps.sparkSession.sparkContext.broadcast((sample, c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, centre = shared.value
        to_centres = queries @ centre.T
        gaps = to_centres.max(1, keepdims=True) - to_centres
        out = np.zeros((len(queries), GAPS + 1), np.int64)
        for batch in batches:
            x, copies = _unit(_matrix(batch.column(2), dim)), batch.column(1).to_numpy()
            for lo in range(0, len(x), 4096):
                y = x[lo : lo + 4096]
                sims = y @ queries.T
                hits = sims >= cosine
                out[:, GAPS] += copies[lo : lo + 4096] @ hits
                some = np.flatnonzero(hits.any(1))
                r, q = np.nonzero(hits[some] & (sims[some] < 1 - 1e-12))
                home = (y[some] @ centre.T).argmax(1)
                np.add.at(out, (q, (gaps[q, home[r]] * 100).astype(np.int64)), 1)
        at = np.flatnonzero(out.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out.ravel()[at])], ["i", "n"])

    out = np.zeros(len(sample) * (GAPS + 1), np.int64)
    for r in reps.mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[r["i"]] = r["n"]
    out = out.reshape(len(sample), GAPS + 1)
    return out[:, GAPS], out[:, :GAPS]


def _margin(reach: np.ndarray) -> float:
    """The margin at which queries reach 999 of 1,000 of their true links on average, and two hundredths more; WIDE without links."""
    total = reach.sum(1)
    if not total.any():
        return WIDE
    share = (reach[total > 0] / total[total > 0, None]).mean(0)
    return (int(np.searchsorted(np.cumsum(share), 0.999)) + 1) / 100 + 0.02


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95, target: float = 0.99, audit: int = 256) -> DataFrame:
    """(vec_id, n_links, component_id, recall), a row for each row of vectors; recall is that of the vector's length."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    raw = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vec.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    ok = F.coalesce(finite & F.col("vec_id").isNotNull(), F.lit(False))
    keyed = raw.withColumn("dim", F.when(ok, F.size("vec"))).withColumn("k1", F.xxhash64("vec")).withColumn("k2", F.xxhash64(F.lit(1), "vec"))
    keyed = store(keyed, "vectors")
    out = keyed.where("dim is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(1.0).alias("recall"))
    for row in keyed.where("dim is not null").groupBy("dim").count().orderBy("dim").collect():  # a row for each length of vectors
        known, recall = _of_length(keyed.where(F.col("dim") == row["dim"]), row["dim"], cosine, target, audit)
        some = keyed.where(F.col("dim") == row["dim"]).select("vec_id", "k1", "k2").join(known, ["k1", "k2"])
        out = out.unionByName(some.select("vec_id", "n_links", "component_id", F.lit(recall).alias("recall")))
    return out


def _of_length(keyed: DataFrame, dim: int, cosine: float, target: float, audit: int) -> tuple[DataFrame, float]:
    """((k1, k2, n_links, component_id), recall) for vectors (vec_id, vec, k1, k2) of one length."""
    equal = keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    reps = store(equal.withColumn("rep", F.monotonically_increasing_id()), "representatives")
    n = reps.count()
    plain = reps.select("rep", "copies", "vec")
    chance = F.pmod(F.xxhash64("vec"), F.lit(1 << 20))
    some = plain if n <= SAMPLE else plain.where(chance <= int((1 << 20) * 1.2 * SAMPLE / n))
    ordered = some.orderBy(F.xxhash64("vec"), "rep").limit(SAMPLE).collect()
    sample = _unit(np.array([r["vec"] for r in ordered]))
    c = centres(sample, max(1, min(SHARDS, len(sample), n // SHARD)))
    weights = np.array([r["copies"] for r in ordered])

    def measured(first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of a sample of queries, their true links, their reach): larger while few have links."""
        size = audit
        while True:
            at = np.arange(first, min(2 * size, len(sample)), 2)
            links, reach = _true_links(plain, sample[at], c, cosine, dim)
            links = links - weights[at]
            if (links > 0).sum() >= LINKED or 2 * size >= len(sample) or size >= QUERIES:
                return at, links, reach
            size *= 4

    margin = _margin(measured(0)[2])
    at, truth, _ = measured(1)
    ids = [ordered[k]["rep"] for k in at]
    while True:
        links = store(_links(plain, c, margin, cosine, dim), "links")
        got = {r["rep"]: r["n"] for r in links.where(F.col("rep").isin(ids)).groupBy("rep").agg(F.sum("n").alias("n")).collect()} if ids else {}
        shares = [min(got.get(i, 0), t) / t for i, t in zip(ids, truth.tolist(), strict=True) if t > 0]
        recall = float(np.mean(shares)) if shares else 1.0
        if recall >= target or margin > 2:
            break
        release(links)
        margin *= 2
    if recall < LEAST:
        raise RuntimeError(f"the search found {recall:.3f} of the true links of its sample at the widest margin")
    roots = components(links.where("rep != root").select("rep", "root"))
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    known = reps.select("k1", "k2", "rep", "copies", "least").join(counts, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    known = store(known.select("k1", "k2", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("group")), "known")
    names = store(known.groupBy("group").agg(F.min("least").alias("component_id")), "names")
    return known.join(names, "group").select("k1", "k2", "n_links", "component_id"), recall


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"), "recall")


#: All pairs; its recall is 1 by definition.
OP3_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT r, vec_id, e FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND list_bool_and(list_transform(e, lambda x: x IS NOT NULL AND isfinite(x)))
  AND list_bool_or(list_transform(e, lambda x: x <> 0))),
l AS MATERIALIZED (SELECT a.r, b.r AS s FROM ok a JOIN ok b ON len(a.e) = len(b.e) AND a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT r, r AS s FROM ok UNION SELECT reach.r, l.s FROM reach JOIN l ON reach.s = l.r),
c AS (SELECT reach.r, min(ok.vec_id) AS component_id FROM reach JOIN ok ON reach.s = ok.r GROUP BY reach.r),
n AS (SELECT r, count(*) AS n FROM l GROUP BY r)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id = vec_id, TRUE) AS kept,
  CAST(1 AS DOUBLE) AS recall FROM v LEFT JOIN c ON v.r = c.r LEFT JOIN n ON v.r = n.r
"""
