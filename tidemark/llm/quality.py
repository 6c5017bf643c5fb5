"""Quality rules with adaptive thresholds: log-bucket quantile sketches per language and source, merged upwards, then joined filtering.

A sketch holds, for each metric, the counts of logarithmic buckets (relative error ``ERROR``); two sketches merge by adding counts, so the
sketch of a language is the sum over its sources and the global one the sum over languages. A group's limits are q25 - spread * (q75 - q25)
and q75 + spread * (q75 - q25) of its own sketch. Where the quartiles coincide, as most documents have none of what is measured, the scale
comes from the documents beyond: the upper limit is t50 + 2 * spread * (t50 - t25) of their quantiles (twice the lower half of their
spread, as the upper half may be what is to be rejected), and there is no lower one. A group with fewer than ``min_docs`` documents, or
fewer than ``min_tail`` beyond coinciding quartiles, uses the next wider sketch; the global one is used whatever it holds. Nothing is
compared finer than a bucket: a value is rejected if its bucket lies outside those of the limits. No limit is a fixed number.

Edge cases: null text is the empty text; null language or source is a group of its own; repeated rows are judged alike, each for itself;
an empty table gives an empty result; columns that the operator doesn't read, whatever their names but for a leading "__", don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, store, table, words

#: Relative error of the sketches.
ERROR = 0.02
#: Bits of a packed trigram entry that hold its position in the document.
POSITION_BITS = 28
#: Ratios are per word (bangs, symbols, repeated words) or per line with a word.
METRICS = ("symbols", "repeats", "dup_lines", "bangs", "word_length")
#: Most rows of thresholds that are broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 20_000


def _repeated_words(trigrams: str, shift: int) -> Column:
    """Positions of the trigrams that share 36 bits of their hash with another one: sorted longs, neighbours compared."""
    mask = (1 << POSITION_BITS) - 1
    last = F.greatest(F.size(trigrams) - 1, F.lit(0))
    near = F.zip_with(
        F.slice(trigrams, F.lit(1), last),
        F.slice(trigrams, F.lit(2), last),
        lambda x, y: F.when(F.shiftright(x, POSITION_BITS) == F.shiftright(y, POSITION_BITS), F.array(x.bitwiseAND(mask), y.bitwiseAND(mask))),
    )
    return F.flatten(F.array_compact(near))


def measure(docs: DataFrame) -> DataFrame:
    """docs with __w (number of words), __chars, __symbols, __dup, __repeat, __lines and __bangs; all in built-in functions, in one pass.

    A trigram's 64-bit hash is packed twice with its position into a long, once by its upper and once by its lower 36 bits, and primitive
    sorts bring equals together; a position counts when both sorts find it a partner.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("__words", words(F.col("text"))).withColumn("__rows", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn(
        "__hash",
        F.transform(F.slice("__words", F.lit(1), F.greatest(F.size("__words") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(F.col("__words"), i + 1), F.get(F.col("__words"), i + 2))),
    )
    low = (1 << POSITION_BITS) - 1
    d = d.withColumn("__one", F.sort_array(F.transform("__hash", lambda x, i: F.shiftleft(x, POSITION_BITS).bitwiseOR(i.cast("long"))))).withColumn(
        "__two", F.sort_array(F.transform("__hash", lambda x, i: x.bitwiseAND(~low).bitwiseOR(i.cast("long"))))
    )
    d = d.withColumn("__at", F.array_intersect(_repeated_words("__one", 1), _repeated_words("__two", 2)))
    counted = {
        "__w": F.size("__words").cast("long"),
        "__chars": F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "__symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"),
        "__bangs": (F.char_length(text) - F.char_length(F.replace(text, F.lit("!"), F.lit("")))).cast("long"),
        "__lines": F.size("__rows").cast("long"),
        "__dup": (F.size("__rows") - F.size(F.array_distinct("__rows"))).cast("long"),
        "__repeat": F.size(F.array_distinct(F.flatten(F.transform("__at", lambda p: F.array(p, p + 1, p + 2))))).cast("long"),
    }
    return d.select(*[F.col(f"`{c}`") for c in docs.columns], *[v.alias(k) for k, v in counted.items()])


def base_failed() -> Column:
    return (F.col("__w") < 50) | (100 * F.col("__repeat") > 50 * F.col("__w"))


def _metrics() -> dict[str, Column]:
    per_word = lambda c: F.col(c) / F.greatest("__w", F.lit(1))
    return {"symbols": per_word("__symbols"), "repeats": per_word("__repeat"), "dup_lines": F.col("__dup") / F.greatest("__lines", F.lit(1)), "bangs": per_word("__bangs"), "word_length": per_word("__chars")}


_GAMMA = (1 + ERROR) / (1 - ERROR)


def _bucket(v: Column) -> Column:
    """0 holds values up to 1e-6, bucket b those up to 1e-6 * gamma ** b."""
    return F.when(v <= 1e-6, F.lit(0)).otherwise(F.ceil(F.log(v / 1e-6) / math.log(_GAMMA)).cast("int"))


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n)."""
    entries = F.array(*[F.struct(F.lit(k).alias("metric"), _bucket(v).alias("bucket")) for k, v in _metrics().items()])
    return measured.select("lang", "source", F.explode(entries).alias("x")).groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count("*").alias("n"))


def _at(buckets: Column, docs: Column, q: float) -> Column:
    """The bucket of the quantile q of an array of (bucket, n) in order."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("bucket"))

    def step(acc: Column, x: Column) -> Column:
        seen = acc["seen"] + x["n"]
        return F.struct(seen.alias("seen"), F.coalesce(acc["bucket"], F.when(seen >= q * docs, x["bucket"])).alias("bucket"))

    return F.aggregate(buckets, start, step)["bucket"]


def _value(bucket: Column) -> Column:
    return F.when(bucket == 0, F.lit(0.0)).otherwise(1e-6 * F.pow(F.lit(_GAMMA), bucket) * 2 / (1 + _GAMMA))


def _limits(sketch: DataFrame, keys: list[str], min_docs: int, min_tail: int, spread: float) -> DataFrame:
    """(keys, metric, own, low, high): the buckets of the limits from a sketch merged to keys, whose groups are arrays of their few buckets;
    own: whether the group has documents enough for them."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    one = merged.groupBy(*keys, "metric").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.sum("n").alias("docs"))
    one = one.withColumn("b1", _at(F.col("b"), F.col("docs"), 0.25)).withColumn("b3", _at(F.col("b"), F.col("docs"), 0.75))
    one = one.withColumn("tail", F.filter("b", lambda x: x["bucket"] > F.col("b3")))
    one = one.withColumn("beyond", F.aggregate("tail", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    one = one.withColumn("t1", _at(F.col("tail"), F.col("beyond"), 0.25)).withColumn("t2", _at(F.col("tail"), F.col("beyond"), 0.5))
    q1, q3, t1, t2 = (_value(F.col(c)) for c in ("b1", "b3", "t1", "t2"))
    same = F.col("b1") == F.col("b3")
    high = F.when(~same, q3 + spread * (q3 - q1)).when(F.col("beyond") > 0, t2 + 2 * spread * (t2 - t1))
    low = F.when(~same & (q1 > spread * (q3 - q1)), q1 - spread * (q3 - q1))
    own = (F.col("docs") >= min_docs) & (~same | (F.col("beyond") == 0) | (F.col("beyond") >= min_tail))
    return one.select(*keys, "metric", own.alias("own"), F.coalesce(_bucket(low), F.lit(0)).alias("low"), F.greatest(_bucket(high), F.col("b3")).alias("high"))


def thresholds(measured: DataFrame, min_docs: int = 50, spread: float = 4.0, min_tail: int = 20) -> DataFrame:
    """(lang, source, low_<metric>, high_<metric>): the buckets that each metric's value must lie between, ends included."""
    sketch = store(sketches(measured), "sketch")
    limits = [_limits(sketch, keys, min_docs, min_tail, spread) for keys in (["lang", "source"], ["lang"], [])]
    a, b, c = limits
    b = b.select(F.col("lang").alias("lang1"), F.col("metric").alias("metric1"), *[F.col(x).alias(f"{x}1") for x in ("own", "low", "high")])
    c = c.select(F.col("metric").alias("metric2"), *[F.col(x).alias(f"{x}2") for x in ("low", "high")])
    on = F.col("lang").eqNullSafe(F.col("lang1")) & (F.col("metric") == F.col("metric1"))
    joined = a.join(b, on, "left").join(c, F.col("metric") == F.col("metric2"), "left")
    pick = lambda x: F.when(F.col("own"), F.col(x)).when(F.col("own1"), F.col(f"{x}1")).otherwise(F.col(f"{x}2"))
    each = [F.max(F.when(F.col("metric") == k, pick(x))).alias(f"{x}_{k}") for k in METRICS for x in ("low", "high")]
    out = store(joined.groupBy("lang", "source").agg(*each), "thresholds")
    release(sketch)
    return out


def judge(measured: DataFrame, min_docs: int = 50, spread: float = 4.0) -> DataFrame:
    """measured with __base_failed and __kept. measured must be cheap to read again (a written table)."""
    limits = thresholds(measured, min_docs, spread)
    small = limits.count() <= BROADCAST_ROWS
    names = [f"{x}_{k}" for k in METRICS for x in ("low", "high")]
    limits = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[F.col(k).alias(f"__{k}") for k in names])
    on = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    joined = measured.join(F.broadcast(limits) if small else limits, on, "left")
    inside = F.lit(True)
    for k, v in _metrics().items():
        inside = inside & (_bucket(v) >= F.col(f"__low_{k}")) & (_bucket(v) <= F.col(f"__high_{k}"))
    return joined.withColumn("__base_failed", base_failed()).withColumn("__kept", ~base_failed() & inside)


def filter_documents(docs: DataFrame, min_docs: int = 50, spread: float = 4.0) -> DataFrame:
    """The rows of docs that pass the base rules and the adaptive thresholds, with the columns of docs."""
    judged = judge(store(measure(docs), "measured"), min_docs, spread)
    return judged.where("__kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    measured = store(measure(docs).drop("text"), "measured")
    names = {"__w": "n_words", "__chars": "word_chars", "__symbols": "n_symbols", "__dup": "n_dup_lines", "__repeat": "n_repeat_words"}
    names |= {"__base_failed": "base_failed", "__kept": "kept"}
    return judge(measured).select("doc_id", *[F.col(k).alias(v) for k, v in names.items()])


def _sql(spread: float = 4.0, min_docs: int = 50, min_tail: int = 20) -> str:
    """The rows of op10_quality_rules in DuckDB SQL."""
    bucket = lambda v: f"(CASE WHEN {v} <= 1e-6 THEN 0 ELSE CAST(ceil(ln({v} / 1e-6) / {math.log(_GAMMA)!r}) AS INTEGER) END)"
    value = lambda b: f"(CASE WHEN {b} = 0 THEN 0.0 ELSE 1e-6 * pow({_GAMMA!r}::DOUBLE, {b}) * 2 / {1 + _GAMMA!r} END)"
    level = lambda n, lang, source: f"SELECT {n} AS level, {lang} AS lang, {source} AS source, metric, bucket, count(*) AS n FROM e GROUP BY ALL"
    low, high = f"v1 - {spread} * (v3 - v1)", f"v3 + {spread} * (v3 - v1)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS rows FROM d),
tri AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
twice AS (SELECT r, i FROM tri QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(3) AS x(k) GROUP BY r),
m AS (SELECT s.r, doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols, length(t) - length(replace(t, '!', '')) AS bangs,
  len(rows) AS lines, len(rows) - len(list_distinct(rows)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM s LEFT JOIN rep ON s.r = rep.r),
e AS (SELECT r, lang, source, metric, {bucket("v")} AS bucket FROM (SELECT r, lang, source, unnest(['symbols', 'repeats', 'dup_lines', 'bangs', 'word_length']) AS metric,
  unnest([n_symbols / greatest(n_words, 1), n_repeat_words / greatest(n_words, 1), n_dup_lines / greatest(lines, 1), bangs / greatest(n_words, 1),
    word_chars / greatest(n_words, 1)]) AS v FROM m)),
sk AS ({level(0, "lang", "source")} UNION ALL {level(1, "lang", "NULL")} UNION ALL {level(2, "NULL", "NULL")}),
c AS (SELECT *, sum(n) OVER g AS docs, sum(n) OVER (g ORDER BY bucket) AS seen FROM sk WINDOW g AS (PARTITION BY level, lang, source, metric)),
q AS (SELECT *, min(bucket) FILTER (seen >= 0.25 * docs) OVER g AS b1, min(bucket) FILTER (seen >= 0.75 * docs) OVER g AS b3 FROM c
  WINDOW g AS (PARTITION BY level, lang, source, metric)),
u AS (SELECT *, docs - max(seen) FILTER (bucket <= b3) OVER g AS beyond, max(seen) FILTER (bucket <= b3) OVER g AS before FROM q
  WINDOW g AS (PARTITION BY level, lang, source, metric)),
z AS (SELECT level, lang, source, metric, docs, b1, b3, beyond, min(bucket) FILTER (bucket > b3 AND seen - before >= 0.25 * beyond) AS t1,
  min(bucket) FILTER (bucket > b3 AND seen - before >= 0.5 * beyond) AS t2 FROM u GROUP BY ALL),
x AS (SELECT *, {value("b1")} AS v1, {value("b3")} AS v3, CASE WHEN t1 IS NOT NULL THEN {value("t1")} END AS x1, CASE WHEN t2 IS NOT NULL THEN {value("t2")} END AS x2 FROM z),
f AS (SELECT level, lang, source, metric, docs >= {min_docs} AND (b1 <> b3 OR beyond = 0 OR beyond >= {min_tail}) AS own,
  CASE WHEN b1 <> b3 AND v1 > {spread} * (v3 - v1) THEN {bucket("(" + low + ")")} ELSE 0 END AS low,
  greatest(b3, CASE WHEN b1 <> b3 THEN {bucket("(" + high + ")")} WHEN beyond > 0 THEN {bucket(f"(x2 + 2 * {spread} * (x2 - x1))")} END) AS high FROM x),
o AS (SELECT e.r, bool_and(CASE WHEN a.own THEN e.bucket BETWEEN a.low AND a.high WHEN b.own THEN e.bucket BETWEEN b.low AND b.high ELSE e.bucket BETWEEN g.low AND g.high END) AS inside
  FROM e JOIN f a ON a.level = 0 AND a.metric = e.metric AND a.lang IS NOT DISTINCT FROM e.lang AND a.source IS NOT DISTINCT FROM e.source
  JOIN f b ON b.level = 1 AND b.metric = e.metric AND b.lang IS NOT DISTINCT FROM e.lang JOIN f g ON g.level = 2 AND g.metric = e.metric GROUP BY e.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND inside AS kept FROM m JOIN o ON m.r = o.r
"""


OP10_SQL = _sql()
