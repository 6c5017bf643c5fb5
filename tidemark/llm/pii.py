"""Personal data by weak supervision, in DataFrame and SQL functions only.

Candidate spans come from the four base patterns and from three wider shapes (national phone numbers, spelt-out mail addresses, social
security numbers). Labelers vote yes, no or not at all on each candidate: the pattern's own check, digit counts, gazetteers of endings,
issuers and reserved ranges, cue words before the span, and what the span is glued to. Expectation-maximisation over the counts of vote
patterns (at most 3 ** labelers for each kind, whatever the input) estimates each labeler's reliability; its posteriors are the soft labels
of the final span classifier, a naive Bayes over discrete span features whose sums are taken over all candidates. A candidate of a wider
shape is added if the classifier gives it ``CERTAIN`` or more and it overlaps no base span. Base spans always stay, failing matches of the
base patterns are never added.

The patterns' forms below find the same matches as the plain ones of the contract: they only begin where a run of their characters
begins (or the last match ended) and never give back characters, which keeps them linear on long texts. Starts are sums of the lengths of
the pieces between matches, so offsets count code points.

Edge cases: a null text has no spans; repeated rows each get their own row; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import store, table

#: Kinds in the contract's order, then the added ones.
KINDS = ("email", "ip", "card", "phone", "ssn")
#: Candidate shapes: name -> (kind, pattern, text that must occur, whether it is a base pattern).
SHAPES = {
    "email": ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True),
    "ip": ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", True),
    "card": ("card", r"[0-9](?:[\x20-]?[0-9])++", "", True),
    "phone": ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", True),
    "spelt": ("email", r"(?i)\b[a-z0-9][a-z0-9._%+-]{0,63}\s?[\[(]at[\])]\s?[a-z0-9-]{1,63}\s?[\[(]dot[\])]\s?[a-z]{2,24}\b", "at", False),
    "national": ("phone", r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])", "", False),
    "ssn": ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", False),
}
#: Words that announce personal data, in the corpus's languages.
CUES = {
    "email": "mail|e-mail|contact|kontakt|contacto|courriel|correo|write|schreib",
    "ip": "ip|host|server|address|adresse|from|login",
    "card": "card|karte|carte|tarjeta|visa|master|amex|credit|kredit",
    "phone": "phone|tel|call|fax|mobile|handy|telefon|fon|appel|llama|movil",
    "ssn": "ssn|social|security|insurance",
}
#: Last labels of host names.
ENDINGS = ("com", "org", "net", "edu", "gov", "info", "biz", "io", "de", "fr", "es", "uk", "eu", "us", "ch", "at", "it", "nl", "mx")
LABELERS = ("check", "digits", "gazetteer", "cue", "edges")
CERTAIN = 0.9
ROUNDS = 25


def _plain(text: Column, shape: str) -> Column:
    """A cheap test that rules out most texts."""
    _, _, has, _ = SHAPES[shape]
    test = F.contains(text, F.lit(has)) if has else F.lit(True)
    return test if shape in ("email", "spelt") else test & text.rlike("[0-9]")


def _valid(kind: str, s: Column) -> Column:
    digits = F.regexp_replace(s, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(s, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.coalesce(part(x).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return (n >= 14) & (n <= 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, "y").when(no, "n").otherwise("-")


def _votes(shape: str, s: Column, before: Column, after: Column, ok: Column) -> Column:
    kind = SHAPES[shape][0]
    digits = F.regexp_replace(s, "[^0-9]", "")
    n = F.length(digits)
    usual = {"email": n <= 6, "ip": (n >= 4) & (n <= 12), "card": (n >= 15) & (n <= 16), "phone": (n >= 10) & (n <= 13), "ssn": n == 9}[kind]
    known = {
        "email": s.rlike(rf"(?i)[.\s\])](?:{'|'.join(ENDINGS)})$"),
        "ip": ~s.rlike(r"^(?:0|127|255)\."),
        "card": digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"),
        "phone": digits.rlike(r"^(?:1[0-9]{10}|[2-9][0-9]{9,})$"),
        "ssn": ~s.rlike(r"^(?:000|666|9)|-00-|-0000$"),
    }[kind]
    cue = before.rlike(rf"(?i)\b(?:{CUES[kind]})[^A-Za-z0-9]{{0,12}}(?:[a-z]{{1,4}}[^A-Za-z0-9]{{1,3}})?$")
    glued = before.rlike(r"[A-Za-z0-9_]$") | after.rlike("^[A-Za-z0-9_]")
    return F.concat(_vote(ok, ~ok), _vote(usual, ~usual), _vote(known, ~known), _vote(cue, F.lit(False)), _vote(~glued, glued))


def _features(shape: str, s: Column, before: Column, after: Column) -> Column:
    """Discrete, from small sets."""
    digits = F.length(F.regexp_replace(s, "[^0-9]", ""))
    around = lambda c: F.when(c.rlike("[A-Za-z]"), "a").when(c.rlike("[0-9]"), "0").when(c.rlike(r"\s"), "_").when(c == "", "^").otherwise(".")
    return F.array(
        F.concat(F.lit(f"{shape}:d"), F.least(digits, F.lit(20)).cast("string")),
        F.concat(F.lit(f"{shape}:l"), F.least(F.floor(F.length(s) / 4), F.lit(12)).cast("string")),
        F.concat(F.lit(f"{shape}:b"), around(F.right(before, F.lit(1)))),
        F.concat(F.lit(f"{shape}:a"), around(F.left(after, F.lit(1)))),
        F.concat(F.lit(f"{shape}:s"), F.when(s.rlike("[ ()]"), "s").when(s.rlike("[.-]"), "p").otherwise("n")),
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running sums, maxima, ... of an array of ints, by doubling: n log n steps, where a growing aggregate would copy n * n values."""

    def doubled(step: int) -> Callable[[Column], Column]:
        def double(a: Column) -> Column:
            tail = F.zip_with(F.slice(a, F.lit(step + 1), F.size(a) - step), F.slice(a, F.lit(1), F.size(a) - step), op)
            return F.when(F.size(a) > step, F.concat(F.slice(a, F.lit(1), F.lit(step)), tail)).otherwise(a)

        return double

    out = values
    for k in range(31):
        out = _let(out, doubled(1 << k))
    return out


def _spans(shape: str) -> Column:
    """array<struct<kind, start, end, base, ok, shape, votes, features>> from __m_<shape> (matches), __p_<shape> (pieces) and __ends (running
    sums of the lengths of all shapes' matches and pieces, one shape after the other)."""
    kind, _, _, base = SHAPES[shape]
    m, p = F.col(f"__m_{shape}"), F.col(f"__p_{shape}")
    before = [F.size(f"__m_{x}") for x in SHAPES][: list(SHAPES).index(shape)]
    first = sum(before, F.lit(0))  # of this shape's ends among those of all
    at = F.coalesce(F.get("__ends", first - 1), F.lit(0))

    def full(reached: Column, i: Column) -> Column:
        end = (reached - at).cast("int")
        s, before, after = F.get(m, i), F.right(F.get(p, i), F.lit(32)), F.left(F.get(p, i + 1), F.lit(2))
        ok = _valid(kind if base else "", s)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), (end - F.length(s)).alias("start"), end.alias("end"), F.lit(base).alias("base"), ok.alias("ok"), F.lit(shape).alias("shape"),
            _votes(shape, s, before, after, ok).alias("votes"), _features(shape, s, before, after).alias("features"),
        )

    empty = F.array().cast("array<struct<kind:int,start:int,end:int,base:boolean,ok:boolean,shape:string,votes:string,features:array<string>>>")
    return F.when(F.size(m) > 0, F.transform(F.slice("__ends", first + 1, F.size(m)), full)).otherwise(empty)


def _lengths(shape: str) -> Column:
    """Of each match, its length and that of the piece before it."""
    m, p = F.col(f"__m_{shape}"), F.col(f"__p_{shape}")
    return F.zip_with(F.slice(p, F.lit(1), F.size(m)), m, lambda x, y: (F.length(x) + F.length(y)).cast("long"))


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with __spans, all candidates of each text; one pass."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    d = docs
    for shape, (_, pattern, _, _) in SHAPES.items():
        there = _plain(text, shape)
        none = F.array().cast("array<string>")
        d = d.withColumn(f"__m_{shape}", F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    for shape, (_, pattern, _, _) in SHAPES.items():
        d = d.withColumn(f"__p_{shape}", F.when(F.size(f"__m_{shape}") > 0, F.split(text, pattern)).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("__ends", _scan(F.concat(*[_lengths(x) for x in SHAPES]), lambda x, y: x + y))
    return d.select(*[F.col(f"`{c}`") for c in docs.columns], F.concat(*[_spans(x) for x in SHAPES]).alias("__spans"))


def reliabilities(patterns: list[tuple[str, str, int]], rounds: int = ROUNDS) -> dict[tuple[str, str], float]:
    """(shape, votes, count) of every vote pattern -> the posterior of each (shape, votes). Labelers are independent given the truth.

    The start is the share of yes votes; rates are smoothed by one vote each way, so no labeler becomes infallible.
    """
    out: dict[tuple[str, str], float] = {}
    for shape in sorted({s for s, _, _ in patterns}):
        own = sorted((v, n) for s, v, n in patterns if s == shape)
        post = {v: (v.count("y") + 0.5) / (len(v.replace("-", "")) + 1) for v, _ in own}
        for _ in range(rounds):
            yes, no = sum(n * post[v] for v, n in own), sum(n * (1 - post[v]) for v, n in own)
            prior = (yes + 1) / (yes + no + 2)
            rates = []
            for k in range(len(LABELERS)):
                cast = [(v, n) for v, n in own if v[k] != "-"]
                a = (sum(n * post[v] for v, n in cast if v[k] == "y") + 2) / (sum(n * post[v] for v, n in cast) + 3)
                b = (sum(n * (1 - post[v]) for v, n in cast if v[k] == "y") + 1) / (sum(n * (1 - post[v]) for v, n in cast) + 3)
                rates.append((a, b))
            for v, _ in own:
                odds = math.log(prior / (1 - prior))
                for x, (a, b) in zip(v, rates, strict=True):
                    odds += 0 if x == "-" else math.log(a / b) if x == "y" else math.log((1 - a) / (1 - b))
                post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        out |= {(shape, v): p for v, p in post.items()}
    return out


def _literal_map(pairs: dict[str, float]) -> Column:
    return F.create_map(*[x for k, v in sorted(pairs.items()) for x in (F.lit(k), F.lit(v))]) if pairs else F.lit(None).cast("map<string,double>")


def classified(found: DataFrame) -> DataFrame:
    """found (a written table of candidates()) with __base and __added: sorted arrays of structs (start, kind, end).

    Sent to the driver: counts of vote patterns and of features, both from fixed small sets.
    """
    flat = found.select(F.explode("__spans").alias("x")).select("x.*")
    counts = [(r["shape"], r["votes"], r["n"]) for r in flat.groupBy("shape", "votes").agg(F.count("*").alias("n")).collect()]
    post = reliabilities(counts)
    soft = _literal_map({f"{s} {v}": p for (s, v), p in post.items()})
    scored = flat.withColumn("p", F.round(F.element_at(soft, F.concat_ws(" ", "shape", "votes")) * 1_000_000).cast("long"))
    sums = scored.select("shape", "p", F.explode("features").alias("f")).groupBy("shape", "f").agg(F.sum("p").alias("yes"), F.count("*").alias("n")).collect()
    total: dict[str, list[float]] = {}
    for s, v, n in counts:
        t = total.setdefault(s, [1.0, 1.0])
        t[0] += n * post[s, v]
        t[1] += n * (1 - post[s, v])
    weights = {}
    for r in sums:
        yes, no = total[r["shape"]]
        weights[r["f"]] = math.log((r["yes"] / 1e6 + 1) / (yes + 20)) - math.log((r["n"] - r["yes"] / 1e6 + 1) / (no + 20))
    votes = {f"{s} {v}": math.log(p / (1 - p)) for (s, v), p in ((k, min(max(p, 1e-9), 1 - 1e-9)) for k, p in post.items())}
    # the votes are evidence of their own; the features, less telling and not independent of them, weigh half
    by_votes, by_feature = _literal_map(votes), _literal_map(weights)
    score = lambda x: F.element_at(by_votes, F.concat_ws(" ", x["shape"], x["votes"])) + 0.5 * F.aggregate(x["features"], F.lit(0.0), lambda a, f: a + F.coalesce(F.element_at(by_feature, f), F.lit(0.0)))
    place = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    base = F.array_sort(F.transform(F.filter("__spans", lambda x: x["base"] & x["ok"]), place))
    bound = math.log(CERTAIN / (1 - CERTAIN))
    likely = F.filter("__spans", lambda x: ~x["base"] & (score(x) >= bound)) if votes else F.filter("__spans", lambda x: F.lit(False))
    d = found.withColumn("__base", base).withColumn("__likely", F.array_sort(F.transform(likely, place)))
    return d.withColumn("__added", F.when(F.size("__likely") > 0, _free()).otherwise(F.col("__likely"))).drop("__likely", "__spans")


def _free() -> Column:
    """The spans of __likely that overlap none of __base: from both in order, the greatest end of a base span so far and the least start of
    one from here on."""
    both = F.array_sort(F.concat(
        F.transform("__base", lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("own"), x["kind"].alias("kind"), x["end"].alias("end"))),
        F.transform("__likely", lambda x: F.struct(x["start"].alias("start"), F.lit(1).alias("own"), x["kind"].alias("kind"), x["end"].alias("end"))),
    ))
    far = (1 << 31) - 1

    def judged(spans: Column) -> Column:
        ends = _scan(F.transform(spans, lambda x: F.when(x["own"] == 0, x["end"]).otherwise(-1)), lambda x, y: F.greatest(x, y))
        starts = F.reverse(_scan(F.reverse(F.transform(spans, lambda x: F.when(x["own"] == 0, x["start"]).otherwise(far))), lambda x, y: F.least(x, y)))
        tagged = F.arrays_zip(spans.alias("s"), ends.alias("e"), starts.alias("n"))
        free = F.filter(tagged, lambda x: (x["s"]["own"] == 1) & (x["e"] <= x["s"]["start"]) & (x["n"] >= x["s"]["end"]))
        return F.transform(free, lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["kind"].alias("kind"), x["s"]["end"].alias("end")))

    return _let(both, judged)


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


#: Characters of a piece of a text that is cut many times.
PIECE = 1024


def _between(text: Column, pieces: Column, start: Column, end: Column) -> Column:
    """text from start to end, from its pieces: counting characters begins in the piece and not at the text's beginning."""
    first = F.floor(start / PIECE).cast("int")
    count = F.floor(end / PIECE).cast("int") - first + 1
    some = F.array_join(F.slice(pieces, first + 1, count), "")
    return F.when(end <= start, "").otherwise(F.substring(some, start - first * PIECE + 1, end - start))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of text replaced by its kind in brackets; of overlapping spans the first one's, from its start to their last end."""
    d = classified(store(candidates(docs), "candidates"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text, pieces = F.col("text"), F.col("__pieces")

    def replaced(spans: Column) -> Column:
        ends = _scan(F.transform(spans, lambda x: x["end"]), lambda x, y: F.greatest(x, y))
        before = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
        fresh = F.filter(F.arrays_zip(spans.alias("s"), before.alias("b")), lambda x: x["s"]["start"] >= x["b"])
        parts = F.transform(fresh, lambda x: F.concat(_between(text, pieces, x["b"], x["s"]["start"]), F.get(names, x["s"]["kind"])))
        return F.concat(F.array_join(parts, ""), _between(text, pieces, F.array_max(ends), F.length(text)))

    d = d.withColumn("__all", F.array_sort(F.concat("__base", "__added")))
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    d = d.withColumn("__pieces", F.when(F.size("__all") > 0, cut).otherwise(F.array().cast("array<string>")))
    out = F.when(F.size("__all") > 0, _let(F.col("__all"), replaced)).otherwise(text)
    return d.select(*[out.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = classified(store(candidates(docs).drop("text"), "candidates"))
    count = lambda kind: F.size(F.filter("__base", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    spans = F.array_sort(F.concat("__base", "__added"))
    return d.select("doc_id", count("email"), count("ip"), count("card"), count("phone"), F.sha2(_written(F.col("__base")), 256).alias("base_sha256"), _written(spans).alias("spans"))
