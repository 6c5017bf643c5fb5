"""URL rules by Bloom filter cascades.

A url's keys are its host's suffixes joined with those beginnings of its path that are as long as some listed path. The universe is every
distinct key of the corpus. A cascade's first filter holds the listed keys; the second the unlisted keys of the universe that pass the first;
the third the listed keys that pass the second, and so on until nothing is left to tell apart. A key is listed if the first filter that
rejects it is an even one (counted from 1), which is exact for every key of the universe. Only keys that pass a filter are compared with the
list when the next one is made.

A filter is blocked: a key's bits lie in one chunk of ``CHUNK`` bits, and chunks are bitmaps from built-in aggregates. Cascades of up to
``MOST_BYTES`` are literals, and urls are judged in one map without any join. Larger ones are tables of chunks, whatever their size: the
universe meets each filter by the number of its chunk, and urls get the listed ones among their keys.

Rules (host, path, action) each have a cascade for allow and one for block, a third holds the blocked hosts, which decide where no rule fits.
A rule's path may be empty; it then fits its host and all subdomains whatever the path.

Edge cases: a null url, or one without "://", has empty host and path, fits no rule and is allowed; repeated rows are judged alike; an empty
table gives an empty result; other columns are carried along under any name but those beginning with "__".
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store, table

#: The contract's rules.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Hosts that are blocked with their subdomains unless a rule allows the url.
BLOCKED_HOSTS = ("casino-win.example.com", "ads-track.example.com", "free-bets.example.com", "spam-farm.example.org", "cheap-pills.example.com", "adult-x.example.net")
#: Most bytes of a cascade that is a literal, bits of a chunk, and keys of a chunk on average.
MOST_BYTES, CHUNK, KEYS = 1 << 20, 32_768, 3_000
#: Bits for each key of a filter, and hash functions.
BITS_PER_KEY, HASHES = 8, 4
#: Each filter lets about one key in forty pass, so that this many filters are never needed.
LEVELS = 40


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)


def keys_of(host: Column, path: Column, lengths: tuple[int, ...]) -> Column:
    """Candidate keys: each suffix of the host with each beginning of the path of a listed length, the longest first."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))

    def begin(n: int) -> Column:
        start = F.substring(path, 1, n)
        return F.when(F.length(start) == n, F.transform(suffixes, lambda s: F.concat(s, start))).otherwise(F.array().cast("array<string>"))

    parts = [begin(n) for n in sorted(lengths, reverse=True)]
    return F.when(host != "", F.array_sort(F.concat(*parts), lambda a, b: F.length(b) - F.length(a))).otherwise(F.array().cast("array<string>"))


class Filter:
    """One level: (chunks, bits of a chunk) and either the bits as a hexadecimal literal or a written table (chunk, map)."""

    def __init__(self, level: int, chunks: int, bits: int, hexed: str | None, rows: DataFrame | None) -> None:
        self.level, self.chunks, self.bits, self.hexed, self.rows = level, chunks, bits, hexed, rows

    def chunk(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.level), F.lit(-1)), F.lit(self.chunks))

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.level), F.lit(k)), F.lit(self.bits)) for k in range(HASHES)]

    def _set(self, filled: Column, at: Column) -> Column:
        byte = F.conv(F.hex(F.substring(filled, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        mask = F.element_at(F.array(*[F.lit(1 << b) for b in range(8)]), (at.bitwiseAND(7) + 1).cast("int"))
        return byte.bitwiseAND(mask) != 0

    def passes(self, key: Column, filled: Column | None = None) -> Column:
        """Whether key passes; filled: its chunk, or without it the literal."""
        start = F.lit(0) if filled is not None else self.chunk(key) * self.bits
        filled = F.unhex(F.lit(self.hexed)) if filled is None else filled
        out = F.lit(True)
        for at in self.places(key):
            out = out & self._set(filled, start + at)
        return out

    def passing(self, keys: DataFrame, name: str = "__passes") -> DataFrame:
        """keys (key, ...) with a column that says which of them pass."""
        if self.rows is None:
            return keys.withColumn(name, self.passes(F.col("key")))
        met = keys.withColumn("__chunk", self.chunk(F.col("key"))).join(self.rows, F.col("__chunk") == F.col("chunk"), "left")
        return met.withColumn(name, F.coalesce(self.passes(F.col("key"), F.col("map")), F.lit(False))).drop("__chunk", "chunk", "map")

    @classmethod
    def build(cls, level: int, keys: DataFrame, n: int, literal: bool) -> Filter:
        """A filter of the n keys (key; a written table)."""
        chunks = max(1, math.ceil(n / KEYS))
        bits = CHUNK if chunks > 1 else max(64, 8 * math.ceil(n * BITS_PER_KEY / 8))
        made = cls(level, chunks, bits, None, None)
        at = F.explode(F.array(*made.places(F.col("key")))).alias("at")
        maps = keys.select(made.chunk(F.col("key")).alias("chunk"), at).groupBy("chunk").agg(F.bitmap_construct_agg("at").alias("map"))
        if literal:
            filled = bytearray(-(-chunks * bits // 8))
            for r in maps.collect():  # of MOST_BYTES together at most
                filled[r["chunk"] * bits // 8 : (r["chunk"] + 1) * bits // 8] = r["map"][: bits // 8]
            made.hexed = bytes(filled).hex().upper()
        else:
            made.rows = store(maps, "filter")
        return made


class Cascade:
    """Filters whose answers alternate."""

    def __init__(self, levels: list[Filter]) -> None:
        self.levels = levels

    @property
    def literal(self) -> bool:
        return all(x.rows is None for x in self.levels)

    def contains(self, key: Column) -> Column:
        """True if key, of the universe, is listed; for literal cascades."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            verdict = F.when(self.levels[i].passes(key), verdict).otherwise(F.lit(i % 2 == 1))
        return verdict

    def listed(self, keys: DataFrame) -> DataFrame:
        """The listed ones of keys (key), of the universe."""
        out, left = None, keys
        for i, level in enumerate(self.levels):
            both = store(level.passing(left), "tested")
            if i % 2 == 1:  # what an even filter rejects is listed
                here = both.where(~F.col("__passes")).drop("__passes")
                out = here if out is None else out.unionByName(here)
            left = both.where("__passes").drop("__passes")
        last = left if len(self.levels) % 2 == 1 else left.where("false")
        return last if out is None else out.unionByName(last)

    @classmethod
    def build(cls, universe: DataFrame, listed: DataFrame) -> Cascade:
        """The cascade for listed (key) within universe (key; both written tables, a key once)."""
        levels: list[Filter] = []
        inside, others = listed, None
        literal = True
        while n := inside.count():
            if len(levels) == LEVELS:
                raise RuntimeError(f"{n} keys pass {LEVELS} filters")
            literal = literal and n * BITS_PER_KEY * 2 // 8 + CHUNK // 8 <= MOST_BYTES // 2
            level = Filter.build(len(levels), inside, n, literal)
            levels.append(level)
            if others is None:  # of the universe, only what passes the first filter has to be told from the listed keys
                wrong = store(level.passing(universe).where("__passes").drop("__passes").join(listed, "key", "left_anti"), "false-positives")
            else:
                wrong = store(level.passing(others).where("__passes").drop("__passes"), "false-positives")
            inside, others = wrong, inside
        return cls(levels)


def judged(urls: DataFrame, url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, blocked: tuple[str, ...] | DataFrame = BLOCKED_HOSTS) -> DataFrame:
    """urls with __host, __path, __rule (the longest rule that fits, or null) and __verdict. blocked: hosts, or a table (host) of any size."""
    spark = urls.sparkSession
    host, path = host_and_path(F.col(f"`{url_col}`"))
    lengths = tuple({len(p) for _, p, _ in rules} | {0})
    d = urls.withColumn("__host", host).withColumn("__path", path).withColumn("__keys", keys_of(F.col("__host"), F.col("__path"), lengths))
    universe = store(d.select(F.explode("__keys").alias("key")).distinct(), "universe")
    one = lambda keys: spark.createDataFrame([(x,) for x in keys], "key string")
    lists = {a: one([h + p for h, p, action in rules if action == a]) for a in ("block", "allow")}
    lists["hosts"] = blocked.select(F.col("host").alias("key")) if isinstance(blocked, DataFrame) else one(blocked)
    cascades = {name: Cascade.build(universe, store(listed.distinct(), f"list-{name}")) for name, listed in lists.items()}
    if not all(c.literal for c in cascades.values()):
        return _met(d, universe, cascades)
    tests = {name: c.contains for name, c in cascades.items()}
    rule = F.get(F.filter("__keys", lambda k: tests["block"](k) | tests["allow"](k)), F.lit(0))
    d = d.withColumn("__rule", rule)
    by_method = F.when(F.exists("__keys", lambda k: tests["hosts"](k)), "block").otherwise("allow")
    verdict = F.when(F.col("__rule").isNull(), by_method).when(tests["block"](F.col("__rule")), "block").otherwise("allow")
    return d.withColumn("__verdict", verdict).drop("__keys")


def _met(d: DataFrame, universe: DataFrame, cascades: dict[str, Cascade]) -> DataFrame:
    """For cascades that are tables: which keys of the universe are listed says the cascade; the urls, numbered, get those by their keys."""
    rows = store(d.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = None
    for name, cascade in cascades.items():
        here = cascade.listed(universe).withColumn("name", F.lit(name))
        found = here if found is None else found.unionByName(here)
    hits = rows.select("__row", F.explode("__keys").alias("key")).join(store(found, "listed"), "key")
    best = F.max(F.when(F.col("name") != "hosts", F.struct(F.length("key"), F.col("key"), F.col("name")))).alias("__best")
    met = hits.groupBy("__row").agg(best, F.count(F.when(F.col("name") == "hosts", 1)).alias("__hosts"))
    out = rows.join(met, "__row", "left").withColumn("__rule", F.col("__best.key"))
    by_method = F.when(F.coalesce("__hosts", F.lit(0)) > 0, "block").otherwise("allow")
    verdict = F.when(F.col("__best").isNotNull(), F.col("__best.name")).otherwise(by_method)
    return out.withColumn("__verdict", verdict).drop("__keys", "__row", "__best", "__hosts")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = judged(table(spark, sf_dir, "pages").select("page_id", "url"))
    return d.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"))


def _values(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


OP2_SQL = f"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM a),
rules(h, p, action) AS (VALUES {_values(list(RULES))}),
hosts(h) AS (VALUES {_values([(x,) for x in BLOCKED_HOSTS])}),
fit AS (SELECT DISTINCT b.host, b.path, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action FROM (SELECT DISTINCT host, path FROM b) b
  JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1, 2)
SELECT page_id, b.host, b.path, fit.rule, CASE WHEN fit.rule IS NOT NULL THEN fit.action
  WHEN EXISTS (SELECT 1 FROM hosts WHERE b.host = h OR ends_with(b.host, '.' || h)) THEN 'block' ELSE 'allow' END AS verdict
FROM b LEFT JOIN fit ON b.host = fit.host AND b.path = fit.path
"""
