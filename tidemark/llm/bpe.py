"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of parts over its bytes. Each merge rank has a bucket of the positions whose pair merges at that rank;
a bitmap tree of 256-bit words tells which buckets are filled, and find-first-set on each level gives the lowest rank in two steps. Entries
are never deleted: when a popped position's pair no longer merges at that rank it is stale and skipped. A pre-token of n bytes takes
O(n log n) steps, so very long ones are no special case. Pre-tokens already seen by a worker come from a bounded memory.

Edge cases: a null text is the empty text, with no tokens; repeated rows are encoded each for themselves; an empty table gives an empty
result; other columns are carried along, but those named like a new one give way. Text is encoded whole; special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Pre-tokens in each of the two generations that a worker remembers.
REMEMBERED = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merger:
    """Merges pre-tokens by one rank queue: buckets of positions by rank, found through two levels of words:
    256 bits below, and above one bit for each of these words.

    The queue is empty between pre-tokens, so its words are made once. A bucket of one position is that number, a larger one a heap.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.leaf = [0] * ((max(ranks.values(), default=0) >> 8) + 1)  # bit r & 255 of word r >> 8: bucket r has positions
        self.bit = [1 << k for k in range(max(256, len(self.leaf)))]
        self.pairs = [ranks.get(bytes((x >> 8, x & 255))) for x in range(1 << 16)]

    def __call__(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: of all adjacent parts that together are a token, the pair of lowest rank merges first, the leftmost among equals."""
        ranks, leaf, pairs, bit = self.ranks, self.leaf, self.pairs, self.bit
        get = ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        n, top = len(piece), 0
        end = list(range(1, n + 1))  # of the part that starts here
        before = list(range(-1, n - 1))
        pair = [pairs[x << 8 | y] for x, y in zip(piece, piece[1:])]  # noqa: B905, RUF007  the rank at which the part that starts here merges with the next one
        pair.append(None)
        buckets: dict = {}

        def push(r: int, i: int) -> None:
            nonlocal top
            if r in buckets:
                bucket = buckets[r]
                if bucket.__class__ is int:
                    buckets[r] = [bucket, i] if bucket < i else [i, bucket]
                else:
                    heappush(bucket, i)
            else:
                buckets[r] = i
                a = r >> 8
                top |= bit[a]
                leaf[a] |= bit[r & 255]

        for i, r in enumerate(pair):
            if r is not None:
                push(r, i)
        while top:
            a = (top & -top).bit_length() - 1  # find-first-set on both levels
            word = leaf[a]
            low = word & -word
            rank = (a << 8) + low.bit_length() - 1
            bucket = buckets[rank]
            if bucket.__class__ is int:
                i = bucket
                bucket = None
            else:
                i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                leaf[a] = word ^ low
                if word == low:
                    top ^= bit[a]
            if pair[i] != rank:
                continue  # stale
            j = end[i]
            end[i] = k = end[j]
            pair[j] = None
            if k < n:
                before[k] = i
                pair[i] = r = get(piece[i : end[k]])
                if r is not None:
                    push(r, i)
            else:
                pair[i] = None
            h = before[i]
            if h >= 0:
                pair[h] = r = get(piece[h:k])
                if r is not None:
                    push(r, h)
        out, i = [], 0
        while i < n:
            j = end[i]
            out.append(ranks[piece[i:j]])
            i = j
        return out


#: The pattern's pieces for texts of these characters only, on which its classes are plain sets: the standard library's engine is faster on them.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_OTHER_TEXT = re.compile(f"[^\\x00-\\x1b\\x20-\\x7e{_LETTERS}]")
_PLAIN_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s0-9{_LETTERS}]+|\\s+(?!\\S)|\\s+")
_PLAIN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Codec:
    """Encodes texts to packed little-endian 32-bit ids and decodes them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.merge = Merger(ranks)
        self.split = regex.compile(pattern).findall
        self.plain = _PLAIN_SPLIT.findall if pattern == _PLAIN_PATTERN else None
        self.bytes = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            self.bytes[v] = k
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _new(self, piece: str) -> bytes:
        """The ids of a pre-token that isn't among the recent ones: two generations keep the frequent."""
        ids = self.older.get(piece)
        if ids is None:
            ids = array("I", self.merge(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self.seen) >= REMEMBERED:
                self.older, self.seen = self.seen, {}
            self.seen[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        split = self.plain if self.plain and not _OTHER_TEXT.search(text) else self.split
        get, new = self.seen.get, self._new
        out, last = [], self.seen
        for piece in split(text):
            ids = get(piece)
            if ids is None:
                ids = new(piece)
                if self.seen is not last:
                    last, get = self.seen, self.seen.get
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[str, Codec] = {}


def _codec(key: str, ranks: dict[bytes, int], pattern: str) -> Codec:
    """A worker's codec, with what it remembers, serves all tasks of a query."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def tokenized(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """docs without text, with n_tokens, ids (array<int>, if keep_ids), ids_sha256 and decoded_sha256 (of what the ids decode to).

    The ranks are read on the driver and broadcast; a vocabulary's size doesn't depend on the data.
    """
    spark = docs.sparkSession
    shared, key = spark.sparkContext.broadcast((load_ranks(ranks_path), pattern)), uuid.uuid4().hex
    made = ["n_tokens", *(["ids"] if keep_ids else []), "ids_sha256", "decoded_sha256"]
    others = [c for c in docs.columns if c != text_col and c not in made]
    names = [*others, *made]
    fields = [docs.schema[c] for c in others]
    schema = T.StructType([*fields, T.StructField("n_tokens", T.LongType()), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(key, *shared.value)
        for batch in batches:
            packed = [codec.encode(x.as_py() or "") for x in batch.column(len(others))]
            columns = [*batch.columns[: len(others)], pa.array([len(x) // 4 for x in packed], pa.int64())]
            if keep_ids:
                columns.append(pa.array([np.frombuffer(x, "<i4") for x in packed], pa.list_(pa.int32())))
            columns += [pa.array([hashlib.sha256(f(x)).hexdigest() for x in packed], pa.string()) for f in (lambda x: x, codec.decode)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`")).mapInArrow(run, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenized(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)
