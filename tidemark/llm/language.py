"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are the byte n-grams (``GRAMS``) of its lower-cased letters, with each word bordered by spaces; n-grams that reach over a
border don't count. Hashed into ``BUCKETS`` embeddings and averaged, they go through a linear softmax. Both layers are trained together by
stochastic gradient descent in numpy on a sample of labelled documents (whole texts, as evenly by label as there are; a documented bound:
at most ``SAMPLE``, or ``EACH`` of each label if these are more), of which the last part is kept to fit a temperature and the score below which a prediction is rejected (column ``rejected``).

Prediction covers whole texts of all documents. Edge cases: a text that is null or has no letter is "und" with score 0; with no labelled
document at all everything is "und"; repeated rows are predicted each for themselves; an empty table gives an empty result; only the text
is an input of a prediction. Other columns are carried along, but those named like a new one give way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import store, table

BUCKETS, DIMENSIONS, GRAMS, SAMPLE, EACH = 4096, 16, (2, 3, 4), 3000, 10
#: Share of the kept-back documents that calibrated rejection may reject.
REJECTED = 0.01
_LETTER = regex.compile(r"\p{L}")
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def subwords(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams; None if there is no letter."""
    if not text or not _LETTER.search(text):
        return None
    b = np.frombuffer((" " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " ").encode(), np.uint8).astype(np.uint32)
    space = b == 32
    out = np.zeros(BUCKETS, np.int64)
    for n in GRAMS:
        size = len(b) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        inside = np.zeros(size, bool)
        for k in range(n):
            h = (h ^ b[k : k + size]) * np.uint32(0x01000193)
            if 0 < k < n - 1:
                inside |= space[k : k + size]
        h ^= h >> np.uint32(15)
        out += np.bincount((h[~inside] % np.uint32(BUCKETS)).astype(np.int64), minlength=BUCKETS)
    return out if out.sum() else None


class Model:
    """labels, the weights of each bucket for each label (embedding times softmax layer), bias, temperature and rejection score."""

    def __init__(self, labels: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float, least: float) -> None:
        self.labels, self.weights, self.bias, self.temperature, self.least = labels, weights, bias, temperature, least

    def predict(self, counts: np.ndarray) -> tuple[str, float]:
        z = (counts @ self.weights / counts.sum() + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.labels[k], float(p[k])


def train(counts: np.ndarray, names: list[str], seed: int = 5, epochs: int = 25, batch: int = 32, rate: float = 0.5) -> Model:
    """counts: a row of subword counts for each labelled document."""
    labels = sorted(set(names))
    y = np.array([labels.index(x) for x in names])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held = order[: len(y) // 5]
    used = order[len(y) // 5 :] if len(y) >= 5 else order
    mean = (counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)
    e = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w = rng.normal(0, 0.1, (DIMENSIONS, len(labels))).astype(np.float32)
    bias = np.zeros(len(labels), np.float32)
    scale = np.float32(100.0)  # averages of thousands of grams are small
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs))
        for rows in np.array_split(rng.permutation(used), max(1, len(used) // batch)):
            x = mean[rows] * scale
            h = x @ e
            z = h @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            grad_e = x.T @ (p @ w.T)
            w -= step * (h.T @ p)
            e -= step * grad_e
            bias -= step * p.sum(0)
    weights = (e @ w).astype(np.float64) * float(scale)
    check = held if len(held) else used
    z = mean[check] @ weights + bias

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(check)), y[check]]))

    temperature = min(np.geomspace(0.05, 20, 120).tolist(), key=loss)
    model = Model(labels, weights, bias.astype(np.float64), temperature, 0.0)
    scores = sorted(model.predict(counts[i])[1] for i in check)
    model.least = scores[int(len(scores) * REJECTED)] if scores else 0.0
    return model


def learned(labelled: DataFrame) -> Model | None:
    """A model from the sample of labelled (doc_id, text, lang), every label included; None without any."""
    sizes = store(labelled.groupBy("lang").agg(F.count("*").alias("__n")), "labels").withColumnRenamed("lang", "__lang")
    labels = sizes.count()
    if not labels:
        return None
    each = max(EACH, SAMPLE // labels)
    # a few more than needed, of which the driver keeps those of least hash
    share = F.least(F.lit(1.0), (1.2 * each + 20) / F.col("__n")) * (1 << 30)
    chance = F.xxhash64("doc_id", F.lit(11))
    small = F.broadcast(sizes) if labels <= 20_000 else sizes
    chosen = labelled.join(small, F.col("lang") == F.col("__lang")).where(F.pmod(chance, F.lit(1 << 30)) < share).withColumn("chance", chance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            found = [(n, h, c) for n, h, c in ((n, h, subwords(t)) for n, t, h in rows) if c is not None]
            at = [np.flatnonzero(c) for _, _, c in found]
            counts = [c[k] for (_, _, c), k in zip(found, at, strict=True)]
            columns = [pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["lang", "chance", "at", "n"])

    # a row has BUCKETS entries at most, whatever the text's length
    found = chosen.select("lang", "text", "chance").mapInArrow(run, "lang string, chance long, at array<int>, n array<int>").collect()
    found.sort(key=lambda r: (r["lang"], r["chance"], r["at"], r["n"]))
    seen: Counter = Counter()
    rows = []
    for r in found:
        seen[r["lang"]] += 1
        if seen[r["lang"]] <= each:
            rows.append(r)
    if not rows:
        return None
    counts = np.zeros((len(rows), BUCKETS), np.int32)
    for k, r in enumerate(rows):
        counts[k, r["at"]] = r["n"]
    return train(counts, [r["lang"] for r in rows])


def identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs without text, with lang_pred, score and rejected."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    made = ["lang_pred", "score", "rejected"]
    others = [c for c in docs.columns if c != text_col and c not in made]
    names = [*others, *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = []
            for x in batch.column(len(others)):
                counts = subwords(x.as_py())
                label, score = m.predict(counts) if m is not None and counts is not None else ("und", 0.0)
                out.append((label, score, label == "und" or score < m.least))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *[pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]], names)

    schema = T.StructType([*[docs.schema[c] for c in others], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`")).mapInArrow(run, schema)


def held_out() -> Column:
    """True for the documents that learning never sees; a null doc_id is one of them."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learned(docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang"))
    return identified(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
