"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree over permuted blocks.

Sizes are words. A source's target is its weight's share of all words, at most ``most_repeats`` times its own size, the excess reshared by
weight. A source's documents are dealt into blocks by hash; the blocks stand in a hashed permutation. Whole passes over a source come
first; the part of a pass that is left takes blocks in permuted order, and inside the block where the target falls sub-blocks and then
documents, so a source misses its target by at most half of one document.

What is drawn of a source, pass after pass, is an exact quota of blocks. The splitting tree divides the quotas of all sources among the output
shards: at each node, so many of the node's blocks as its left half shall hold are drawn without replacement (those of least hash), and
counting them by source gives the left quotas, the rest are the right ones. A leaf's quotas are then met with the next blocks of each source
in permuted order, so shards hold disjoint blocks; a copy of a document goes where its block went. Inside a shard rows are ordered by hash.

Every step is a join or an aggregate of Spark tables, whatever the number of sources, blocks and shards: a node's draw counts hashes in
``BINS`` ranges, and only the range in which the draw ends is sorted. Windows over the sources or over one source's blocks hold one row
for each source, or at most four blocks for each shard.

Edge cases: a null text has size 0, a null source is a source (last in order), repeated rows are taken alike, an empty table gives an empty
mix, and a source without words has target 0 and is not taken. Other columns are carried along under any name but those beginning with "__".
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import release, store, table, words

WEIGHTS = (5, 2, 1)
#: Blocks of a source at least (if it has eight documents for each), and sub-blocks of a block.
BLOCKS = 200
#: Words of an output shard, and shards at least.
SHARD_WORDS, SHARDS = 16 << 20, 16
#: Ranges of hashes in which a node's draw is counted.
BINS = 4096
#: Most rows of a lookup table that is broadcast.
SMALL = 20_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = 3) -> DataFrame:
    """(__src, __source_size, __docs, __target) for each source of sizes (source, __size); a written table.

    The reshare has a closed form: with the sources in order of cap / weight, those before the water level are at their caps.
    """
    per = sizes.groupBy(F.col("source").alias("__src")).agg(F.sum("__size").alias("__source_size"), F.count("*").alias("__docs"))
    code = F.encode(F.coalesce("__src", F.lit("")), "UTF-8")
    rank = F.row_number().over(W.orderBy(F.col("__src").isNull(), code)) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank, F.lit(len(weights))))
    per = per.withColumn("__weight", weight)
    by_level = W.orderBy(F.col("__source_size") / F.col("__weight"), F.col("__src").isNull(), code)
    before, rest = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    capped = most_repeats * F.coalesce(F.sum("__source_size").over(before), F.lit(0))
    level = (F.sum("__source_size").over(everything) - capped) / F.sum("__weight").over(rest)
    free = F.when(most_repeats * F.col("__source_size") >= level * F.col("__weight"), level)
    per = per.withColumn("__level", free).withColumn("__level", F.max("__level").over(everything))
    cap = (most_repeats * F.col("__source_size")).cast("double")
    target = F.least(F.coalesce(F.col("__level") * F.col("__weight"), F.lit(0.0)), cap)
    return store(per.select("__src", "__source_size", "__docs", target.alias("__target")), "targets")


def _digit(level: int, seed: int) -> Column:
    return F.xxhash64("doc_id", F.lit(seed), F.lit(level))


def _lookup(d: DataFrame, small: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """d with the columns of small, a written table that has a row for each value of the keys; broadcast if it is small enough."""
    on = F.lit(True)
    for x, y in pairs.items():
        on = on & F.col(x).eqNullSafe(F.col(y))
    return d.join(F.broadcast(small) if small.limit(SMALL + 1).count() <= SMALL else small, on, "left").drop(*pairs.values())


def _placed(sizes: DataFrame, per: DataFrame, most_blocks: int, seed: int) -> DataFrame:
    """sizes with the source's numbers, __b (block) and __c (sub-block)."""
    d = _lookup(sizes, per, {"source": "__src"})
    passes = F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(0)
    d = d.withColumn("__passes", passes).withColumn("__left", F.col("__target") - F.col("__passes") * F.col("__source_size"))
    blocks = F.greatest(F.lit(1), F.least(F.lit(most_blocks), F.ceil(F.col("__docs") / 8))).cast("long")
    return d.withColumn("__b", F.pmod(_digit(1, seed), blocks)).withColumn("__c", F.pmod(_digit(2, seed), F.lit(BLOCKS)))


def _edge() -> Column:
    """A block is whole if it ends within what is left of a pass, and cut if what is left ends inside it."""
    return (F.col("__after") < 0) & (F.col("__room") > 0)


def permuted(sizes: DataFrame, per: DataFrame, most_blocks: int = BLOCKS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(blocks, sub-blocks of cut blocks) of sizes (doc_id, source, __size), in permuted order with what is left after them (__after) and
    before them (__room). Every sum is partial first, so a large source makes no large task."""
    d = _placed(sizes, per, most_blocks, seed)
    of_source = W.partitionBy("source").orderBy(F.xxhash64("source", "__next", F.lit(seed)), "__next")
    upto = of_source.rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = [F.sum("__size").alias("__sum"), F.max("__left").alias("__left"), F.max("__passes").alias("__passes")]
    first = d.groupBy("source", F.col("__b").alias("__next")).agg(*sums)
    after = F.col("__left") - F.sum("__sum").over(upto)
    first = first.withColumn("__order", F.row_number().over(of_source) - 1).withColumn("__after", after)
    room = (F.col("__after") + F.col("__sum")).alias("__room")
    first = store(first.select(F.col("source").alias("__s1"), F.col("__next").alias("__b1"), "__order", "__after", room, "__passes"), "blocks")
    d = _lookup(d, first.drop("__passes"), {"source": "__s1", "__b": "__b1"})
    inner = d.where(_edge()).groupBy("source", F.col("__c").alias("__next")).agg(F.sum("__size").alias("__sum"), F.max("__room").alias("__left"))
    after = F.col("__left") - F.sum("__sum").over(upto)
    inner = inner.select(F.col("source").alias("__s2"), F.col("__next").alias("__c2"), after.alias("__after2"), (after + F.col("__sum")).alias("__room2"))
    return first, store(inner, "sub-blocks")


def draw(docs: DataFrame, per: DataFrame, blocks: tuple[DataFrame, DataFrame], most_blocks: int = BLOCKS, seed: int = 7) -> DataFrame:
    """docs (doc_id, source, __size, ...) with __source_size, __target, __order (the block's place) and __copies (how often it is taken)."""
    first, inner = blocks
    d = _lookup(_placed(docs, per, most_blocks, seed), first.drop("__passes"), {"source": "__s1", "__b": "__b1"})
    d = _lookup(d, inner, {"source": "__s2", "__c": "__c2"})
    edge2 = _edge() & (F.col("__after2") < 0) & (F.col("__room2") > 0)
    each = W.partitionBy("source").orderBy(_digit(3, seed), "doc_id", "__size").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = d.where(edge2).withColumn("__upto", F.sum("__size").over(each))
    near = F.abs(F.col("__upto") - F.col("__room2")) <= F.abs(F.col("__upto") - F.col("__size") - F.col("__room2"))
    inside = F.when(F.coalesce(F.col("__after2") >= 0, F.lit(False)), 1).otherwise(0)
    whole = F.when(F.col("__after") >= 0, 1).when(_edge(), inside).otherwise(0)
    rest = d.where(~F.coalesce(edge2, F.lit(False))).withColumn("__copies", F.col("__passes") + whole)
    fits = F.when((F.col("__upto") <= F.col("__room2")) | near, 1).otherwise(0)
    taken = rest.unionByName(last.withColumn("__copies", F.col("__passes") + fits).drop("__upto"))
    return taken.withColumn("__copies", F.when(F.col("__source_size") > 0, F.col("__copies")).otherwise(0))


def split(quotas: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """(__src, __shard, __n): the quotas (__src, __n: blocks of each source) divided among shards, of nearly as many blocks each.

    A node is a range of shards, here from __from on and __wide shards long. Levels are as many as a binary tree of so many leaves has.
    """
    nodes = store(quotas.where("__n > 0").select(F.lit(0).alias("__from"), F.lit(shards).alias("__wide"), "__src", "__n"), "node-quotas")
    for level in range(math.ceil(math.log2(max(shards, 1)))):
        inner = nodes.where("__wide > 1")
        total = inner.groupBy("__from", "__wide").agg(F.sum("__n").alias("__all"))
        take = F.floor(F.col("__all") * F.floor(F.col("__wide") / 2) / F.col("__wide"))
        blocks = inner.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
        blocks = blocks.withColumn("__h", F.xxhash64("__from", "__src", "__i", F.lit(level), F.lit(seed)))
        blocks = blocks.withColumn("__bin", F.pmod(F.shiftrightunsigned("__h", 32), F.lit(BINS)))
        upto = W.partitionBy("__from").orderBy("__bin").rowsBetween(W.unboundedPreceding, W.currentRow)
        bins = blocks.groupBy("__from", "__bin").agg(F.count("*").alias("__k")).withColumn("__upto", F.sum("__k").over(upto))
        bins = bins.join(total.select("__from", take.alias("__take")), "__from")
        # the draw takes all of a bin, none of it, or as many as are left where it ends
        drawn = F.greatest(F.lit(0), F.least(F.col("__k"), F.col("__take") - F.col("__upto") + F.col("__k")))
        bins = store(bins.select("__from", "__bin", "__k", drawn.alias("__d")), "draws")
        left = blocks.join(bins, ["__from", "__bin"])
        within = W.partitionBy("__from", "__bin").orderBy("__h", "__src", "__i")
        cut = left.where("__d > 0 AND __d < __k").withColumn("__r", F.row_number().over(within)).where("__r <= __d").drop("__r")
        got = left.where("__d = __k").unionByName(cut).groupBy("__from", "__src").agg(F.count("*").alias("__l"))
        got = got.select(F.col("__from").alias("__f"), F.col("__src").alias("__s"), "__l")
        both = inner.join(got, (F.col("__from") == F.col("__f")) & F.col("__src").eqNullSafe(F.col("__s")), "left")
        half, l_ = F.floor(F.col("__wide") / 2).cast("int"), F.coalesce("__l", F.lit(0))
        sides = F.array(
            F.struct(F.col("__from").alias("f"), half.alias("w"), l_.alias("n")),
            F.struct((F.col("__from") + half).alias("f"), (F.col("__wide") - half).alias("w"), (F.col("__n") - l_).alias("n")),
        )
        children = both.select("__src", F.explode(sides).alias("x")).select(F.col("x.f").alias("__from"), F.col("x.w").alias("__wide"), "__src", F.col("x.n").alias("__n"))
        new = store(children.where("__n > 0").unionByName(nodes.where("__wide = 1")), "node-quotas")
        release(nodes, bins)
        nodes = new
    out = nodes.select("__src", F.col("__from").alias("__shard"), "__n")
    out._stored = nodes._stored
    return out


def deal(blocks: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """(__src, __order, __shards): the shards of each drawn block, one for each time. A source's blocks, pass after pass in permuted order,
    go to the shards as its quotas there say."""
    count = blocks.groupBy("__src").agg(F.sum("__times").alias("__n"), F.count("*").alias("__width"))
    given = split(count.select("__src", "__n"), shards, seed)
    upto = W.partitionBy("__src").orderBy("__shard").rowsBetween(W.unboundedPreceding, W.currentRow)
    places = given.withColumn("__end", F.sum("__n").over(upto))
    place = F.explode(F.sequence(F.col("__end") - F.col("__n"), F.col("__end") - 1)).alias("__at")
    places = places.select("__src", "__shard", place)
    width = count.select(F.col("__src").alias("__s"), "__width")
    places = places.join(width, F.col("__src").eqNullSafe(F.col("__s"))).drop("__s")
    keyed = places.select("__src", F.pmod("__at", "__width").cast("int").alias("__order"), F.floor(F.col("__at") / F.col("__width")).alias("__pass"), "__shard")
    grouped = keyed.groupBy("__src", "__order").agg(F.sort_array(F.collect_list(F.struct("__pass", "__shard"))).alias("x"))
    out = store(grouped.select("__src", "__order", F.col("x.__shard").alias("__shards")), "dealt")
    release(given)
    return out


def drawn(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = 3, shards: int | None = None, seed: int = 7) -> DataFrame:
    """docs with __size, __source_size, __target, __block (number of its block) and __shards (array): the output shard of each copy that the mix
    takes."""
    size = F.size(words(F.col("text"))).cast("long") if size is None else size
    light = store(docs.select("doc_id", "source", size.alias("__size")), "sizes")
    per = targets(light, weights, most_repeats)
    if shards is None:
        total = per.agg(F.sum("__target")).first()[0] or 0
        shards = max(SHARDS, math.ceil(total / SHARD_WORDS))
    most = max(BLOCKS, 4 * shards)
    blocks = permuted(light, per, most, seed)
    times = F.col("__passes") + F.when(F.col("__room") > 0, 1).otherwise(0)
    dealt = deal(blocks[0].select(F.col("__s1").alias("__src"), "__order", times.alias("__times")), shards, seed)
    taken = draw(docs.withColumn("__size", size), per, blocks, most, seed)
    dealt_ = dealt.select(F.col("__src").alias("__s3"), F.col("__order").alias("__o3"), F.col("__shards").alias("__dealt"))
    dealt_._stored = dealt._stored
    taken = _lookup(taken, dealt_, {"source": "__s3", "__order": "__o3"})
    release(light)
    none = F.array().cast("array<int>")
    got = F.coalesce(F.slice("__dealt", F.lit(1), F.col("__copies").cast("int")), none)
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns], "__size", "__source_size", "__target", F.col("__b").alias("__block"), got.alias("__shards"))


def mix(docs: DataFrame, size: Column | None = None, shards: int | None = None, weights: tuple[int, ...] = WEIGHTS, most_repeats: int = 3, seed: int = 7) -> DataFrame:
    """One row for each copy that the mix takes: the columns of docs, __shard (output shard) and __rank (order inside the shard)."""
    taken = drawn(docs, size, weights, most_repeats, shards, seed)
    copies = taken.select(*[F.col(f"`{c}`") for c in docs.columns], F.posexplode("__shards").alias("__pass", "__shard"))
    return copies.withColumn("__rank", F.xxhash64("doc_id", "__pass", F.lit(seed), F.lit(4))).drop("__pass")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    docs = store(docs, "sizes")
    taken = drawn(docs, F.col("size"))
    copies = F.size("__shards").cast("long")
    return taken.select("doc_id", "size", F.col("__source_size").cast("long").alias("source_size"), F.col("__target").alias("target"), (copies * F.col("size")).alias("taken"), F.col("__shards").alias("shards"))
