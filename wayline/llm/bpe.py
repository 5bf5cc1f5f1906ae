"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is cut by the vocabulary's pattern; each piece that is no token itself
is merged pair by pair. The leaves of a segment tree hold, for the live token
that starts at a byte, the rank of its merge with the next live token; the
root is then the leftmost pair of least rank. A merge changes three leaves,
each updated along one path to the root. Short pieces are merged many at a
time, a row of a matrix for each tree; longer ones one at a time.

Token ids travel as little-endian unsigned 32-bit integers in a binary column.

Defined cases: a null or empty text has no ids (an empty binary); null ids
decode to an empty binary; equal rows get equal ids; all other columns pass
through untouched, whatever their names and types; an empty table gives an
empty result. Texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from importlib.util import find_spec

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from wayline.llm.common import small_batches, table, whole

#: Pieces of up to so many bytes are merged many at a time.
SHORT = 64
#: Segments whose ids a worker keeps in each of two stores: when the newer is full it takes the place of the older.
KEPT = 60_000
NONE = np.int64(1) << 40


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks of a rank file: a line for each token, in base64, and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


class Codec:
    """Encoder and decoder of one vocabulary and pattern; ``separable`` says that no match of the pattern goes over a blank that follows a visible character."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, separable: bool = False):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.separable = separable
        # Other texts are cut before each blank that follows a visible character, so that a repeated segment is encoded once.
        self.odd_gap = regex.compile(r"[\s\x1c-\x1f](?= )").search
        self.token = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            self.token[i] = b
        self.base = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.pairs: dict[tuple[int, int], int] = {}
        for b, i in ranks.items():
            for k in range(1, len(b)):
                left, right = ranks.get(b[:k]), ranks.get(b[k:])
                if left is not None and right is not None:
                    self.pairs[left, right] = i
        keys = np.array([a << 32 | b for a, b in self.pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.fromiter(self.pairs.values(), dtype=np.int64)[order]
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.values[at], NONE)

    def _merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of 2 to ``width`` bytes; ``width`` is a power of two."""
        n = len(pieces)
        length = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
        place = np.arange(width)
        tok = np.where(place < length[:, None], self.base[raw], -1)
        tok = np.concatenate([tok, np.full((n, 1), -1)], axis=1)  # the last column stands for no token
        after = np.tile(np.arange(1, width + 1), (n, 1))
        after = np.concatenate([np.where(after < length[:, None], after, width), np.full((n, 1), width)], axis=1)
        before = np.tile(np.arange(-1, width), (n, 1))  # and takes what is said of no place
        tree = np.full((n, 2 * width), NONE)
        rank = self._rank(tok[:, : width - 1], tok[:, 1:width])
        tree[:, width : 2 * width - 1] = np.where(rank < NONE, rank * width + place[:-1], NONE)
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

        def put(r: np.ndarray, leaf: np.ndarray, rank) -> None:
            node = leaf + width
            tree[r, node] = np.where(rank < NONE, rank * width + leaf, NONE)
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            rank, at = np.divmod(tree[rows, 1], width)
            gone = after[rows, at]
            following = after[rows, gone]
            tok[rows, at], tok[rows, gone] = rank, -1
            after[rows, at] = following
            before[rows, following] = at
            put(rows, gone, NONE)
            put(rows, at, self._rank(rank, tok[rows, following]))
            prev = before[rows, at]
            has = prev >= 0
            put(rows[has], prev[has], self._rank(tok[rows[has], prev[has]], rank[has]))
            rows = rows[tree[rows, 1] < NONE]
        live = tok[:, :width] >= 0
        flat = tok[:, :width][live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _merge_one(self, piece: bytes) -> bytes:
        """Ids of a piece of any length over 1, by one tree in lists."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        none = (1 << 60, -1)
        tok = self.base[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        pairs, tree = self.pairs, [none] * (2 * width)
        for i in range(n - 1):
            if (r := pairs.get((tok[i], tok[i + 1]))) is not None:
                tree[width + i] = (r, i)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        while (top := tree[1]) is not none:
            rank, i = top
            j = after[i]
            k = after[i] = after[j]
            tok[i], tok[j], p = rank, -1, before[i]
            if k >= 0:
                before[k] = i
            for leaf, pair in ((j, None), (i, k >= 0 and (rank, tok[k])), (p, p >= 0 and (tok[p], rank))):
                if leaf < 0:
                    continue
                r = pairs.get(pair) if pair else None
                node = width + leaf
                tree[node] = none if r is None else (r, leaf)
                node >>= 1
                while node:
                    low = min(tree[2 * node], tree[2 * node + 1])
                    if tree[node] == low:
                        break
                    tree[node] = low
                    node >>= 1
        return np.array([t for t in tok if t >= 0], dtype="<u4").tobytes()

    def _learn(self, segments: list[str]) -> None:
        """Put the ids of the segments into the store."""
        cut = [[p.encode() for p in self.split(s)] for s in segments]
        done: dict[bytes, bytes] = {}
        short: dict[int, list[bytes]] = {}
        for p in {p for ps in cut for p in ps}:
            if (i := self.ranks.get(p)) is not None:
                done[p] = i.to_bytes(4, "little")
            elif len(p) <= SHORT:
                short.setdefault(1 << (len(p) - 1).bit_length(), []).append(p)
            else:
                done[p] = self._merge_one(p)
        for width, pieces in short.items():
            step = max(1, 1_000_000 // (width * 20))  # bounds the matrices
            for k in range(0, len(pieces), step):
                done.update(zip(pieces[k : k + step], self._merge_many(pieces[k : k + step], width), strict=True))
        for s, ps in zip(segments, cut, strict=True):
            self.kept[s] = b"".join([done[p] for p in ps])

    def segments(self, text: str) -> list[str]:
        """Parts of the text that the pattern cuts independently of each other; the whole text for a pattern of which none are known."""
        if not text:
            return []
        if not self.separable:
            return [text]
        if text[0] != " " and not self.odd_gap(text):
            first, *rest = text.split(" ")
            return [first, *[" " + x for x in rest]]
        return regex.split(r"(?<=[^\s\x1c-\x1f])(?= )", text, flags=regex.V1)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.segments(t) for t in texts]
        new: set[str] = set()
        for c in cut:
            new.update(c)
        if len(self.kept) > KEPT:
            self.older, self.kept = self.kept, {}
        new -= self.kept.keys()
        known = new & self.older.keys()
        self.kept.update({x: self.older[x] for x in known})
        if new := list(new - known):
            self._learn(new)
        return [b"".join([self.kept[x] for x in c]) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


_CODECS: dict[tuple[int, str, bool], Codec] = {}


def _codec(content: bytes, pattern: str, separable: bool) -> Codec:
    key = (hash(content), pattern, separable)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(read_ranks(content), pattern, separable)
    return _CODECS[key]


def _in_slices(values: list, most: int = 1_000_000) -> Iterator[list]:
    """The values in lists of a bounded total length, or of one value."""
    part, total = [], 0
    for v in values:
        if part and total + len(v) > most:
            yield part
            part, total = [], 0
        part.append(v)
        total += len(v)
    yield part


def encoder(spark: SparkSession, ranks_path: str, pattern: str):
    """Column function from text to ids. The rank file, whose size the vocabulary bounds, is sent to the executors."""
    small_batches(spark)
    with open(ranks_path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    cut = is_separable(pattern)

    @pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(content.value, pattern, cut)
        for texts in batches:
            yield pd.Series([ids for part in _in_slices(texts.tolist()) for ids in codec.encode(part)], dtype=object)

    return lambda text: encode(whole(text))


def decoder(spark: SparkSession, ranks_path: str, pattern: str):
    """Column function from ids to the bytes they stand for."""
    small_batches(spark)
    with open(ranks_path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    cut = is_separable(pattern)

    @pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(content.value, pattern, cut)
        for ids in batches:
            yield pd.Series([codec.decode(x) for x in ids], dtype=object)

    return lambda ids: decode(F.coalesce(ids, F.lit(b"")))


def round_trip(spark: SparkSession, ranks_path: str, pattern: str):
    """Column function from text to the struct of its ids and the bytes that these decode to, by one pass through Python."""
    small_batches(spark)
    with open(ranks_path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    cut = is_separable(pattern)

    @pandas_udf("struct<ids:binary,decoded:binary>")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(content.value, pattern, cut)
        for texts in batches:
            ids = [x for part in _in_slices(texts.tolist()) for x in codec.encode(part)]
            yield pd.DataFrame({"ids": ids, "decoded": [codec.decode(x) for x in ids]}, dtype=object)

    return lambda text: code(whole(text))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The rows with the ids of the whole text as ``ids``."""
    return docs.withColumn(ids, encoder(docs.sparkSession, ranks_path, pattern)(F.col(text)))


def decode_documents(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The rows with the bytes of ``ids`` as ``decoded``."""
    return df.withColumn(decoded, decoder(df.sparkSession, ranks_path, pattern)(F.col(ids)))


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """Path and pattern of a vocabulary that the machine offers."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def is_separable(pattern: str) -> bool:
    """Whether the pattern is the public one, of which it is known where it never joins."""
    return find_spec("public_tokenizers") is not None and pattern == public_vocabulary()[1]


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = docs.select("doc_id", round_trip(spark, path, pattern)(F.col("text")).alias("c")).select("doc_id", "c.*")
    return coded.select(
        "doc_id",
        n_tokens(F.col("ids")).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
