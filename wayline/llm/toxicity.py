"""Toxicity by a factorization machine over hashed terms.

A text is the set of its lower-case words and of their first letters, hashed
to a fixed number of buckets. The machine adds to the weights of the buckets
the products of their factor vectors for each pair, so that two terms can be
toxic together where neither is alone.

It is fitted on the driver on a bounded sample of labelled rows (at most
``FIT_ROWS`` are expected; which are taken depends on a hash of their ids
alone), on the buckets whose use differs most between the labels by a
chi-squared statistic, and on those that differ in pairs: of the ``PAIRED``
buckets that most toxic rows have, every pair is counted, and both buckets of
a pair that differs by far more than either does alone are taken. Every text is
scored whole.

Defined cases: a null or empty text has no term and gets the score of the bias
alone; labels that are null, and labels without a document, are not learned
from; a document labelled several times is learned from several times; if one
label or both are missing the score is the share of toxic rows (0 for none);
rows are scored each on their own, so repeats agree; an empty table gives an
empty result; columns of the caller with the names of added ones are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from wayline.llm.common import fold, small_batches, table, whole

BUCKETS = 1 << 20
#: Leading letters that are a term beside the whole word.
PREFIXES = (4, 5, 6, 7)
#: Labelled rows that the machine is fitted on, at most as expected by the hash of ids.
FIT_ROWS = 16_000
#: Buckets that it keeps.
MOST_TERMS = 4096
#: Chi-squared statistic that a bucket must reach: one in a hundred thousand would by chance.
LEAST_CHI = 19.5
#: Buckets of which all pairs are tried, share of rows that such a one has at most, and the statistic that a pair must reach.
PAIRED, COMMON, LEAST_PAIR_CHI = 2048, 0.5, 40.0
FACTORS = 8
EPOCHS = 60
KEPT = 200_000
WORDS = regex.compile(r"\p{L}+")


def terms_of(word: str) -> tuple[str, ...]:
    return (word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k))


def buckets_of(word: str) -> list[int]:
    return [zlib.crc32(t.encode()) % BUCKETS for t in terms_of(word)]


def words_of(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


class Machine:
    """Scores of sets of kept buckets, whose places ``kept`` lists in ascending order."""

    def __init__(self, kept: np.ndarray, bias: float):
        self.kept, self.bias = kept, bias
        self.w = np.zeros(len(kept))
        self.v = np.random.default_rng(5).normal(0, 0.05, (len(kept), FACTORS))
        self.known: dict[str, tuple[int, ...]] = {}
        self.place: dict[int, int] | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}, "place": None}

    def places(self, word: str) -> tuple[int, ...]:
        if (got := self.known.get(word)) is None:
            if self.place is None:
                self.place = {int(b): i for i, b in enumerate(self.kept)}
            if len(self.known) > KEPT:
                self.known.clear()
            got = self.known[word] = tuple({self.place[b] for b in buckets_of(word) if b in self.place})
        return got

    def score(self, flat: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The sums for ``n`` texts whose places, one after the other, are ``flat``; and the factor sums of each text."""
        linear = np.bincount(doc, weights=self.w[flat], minlength=n)
        sums = np.zeros((n, FACTORS))
        rows = self.v[flat]
        for k in range(FACTORS):
            sums[:, k] = np.bincount(doc, weights=rows[:, k], minlength=n)
        squares = np.bincount(doc, weights=(rows * rows).sum(axis=1), minlength=n)
        return self.bias + linear + ((sums * sums).sum(axis=1) - squares) / 2, sums

    def proba(self, texts: list[str]) -> np.ndarray:
        found = [set().union(*(p for w in words_of(t) if (p := self.places(w)))) for t in texts]
        doc = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        flat = np.fromiter((i for f in found for i in sorted(f)), dtype=np.int64, count=len(doc))
        return 1 / (1 + np.exp(-np.clip(self.score(flat, doc, len(texts))[0], -30, 30)))


def telling(a: np.ndarray, toxic: np.ndarray, n: int, n1: int) -> np.ndarray:
    """Chi-squared statistic of what ``a`` of n rows have, ``toxic`` of them among the n1 toxic ones."""
    cross = toxic * (n - n1) - (a - toxic) * n1
    return cross * cross * n / np.maximum(a * (n - a) * n1 * (n - n1), 1.0)


def paired(sets: list[np.ndarray], labels: np.ndarray, of_all: np.ndarray, of_toxic: np.ndarray, chi: np.ndarray) -> np.ndarray:
    """Buckets that tell in pairs, the most telling pairs first, repeats among them."""
    n, n1 = len(labels), int(labels.sum())
    usable = np.flatnonzero((of_all >= 5) & (of_all <= COMMON * n))
    tried = np.sort(usable[np.argsort(-of_toxic[usable], kind="stable")[:PAIRED]])
    m = len(tried)
    place = np.full(BUCKETS, -1)
    place[tried] = np.arange(m)
    both, both_toxic = np.zeros((m, m)), np.zeros((m, m))
    for lo in range(0, n, 2048):
        x = np.zeros((len(sets[lo : lo + 2048]), m), dtype=np.float32)
        for i, s in enumerate(sets[lo : lo + 2048]):
            p = place[s]
            x[i, p[p >= 0]] = 1
        both += x.T @ x
        x = x[labels[lo : lo + 2048] == 1]
        both_toxic += x.T @ x
    pair = telling(both, both_toxic, n, n1)
    alone = chi[tried]
    good = (pair >= LEAST_PAIR_CHI) & (pair >= 4 * np.maximum(alone[:, None], alone[None, :])) & (both >= 5)
    a, b = np.nonzero(np.triu(good, 1))
    order = np.argsort(-pair[a, b], kind="stable")
    return tried[np.stack([a[order], b[order]], axis=1).reshape(-1)]


def train(sets: list[np.ndarray], labels: np.ndarray) -> Machine:
    """A machine for sets of buckets and labels 0 and 1: stochastic steps on the logistic loss, with a rate for each weight."""
    n, n1 = len(labels), int(labels.sum())
    rate = n1 / n if n else 0.0
    bias = float(np.log(max(rate, 1e-9) / max(1 - rate, 1e-9)))
    if n1 in (0, n):
        return Machine(np.zeros(0, dtype=np.int64), bias)
    size = np.array([len(s) for s in sets])
    flat, doc = np.concatenate(sets).astype(np.int64), np.repeat(np.arange(n), size)
    of_all = np.bincount(flat, minlength=BUCKETS).astype(float)
    of_toxic = np.bincount(flat[labels[doc] == 1], minlength=BUCKETS).astype(float)
    chi = telling(of_all, of_toxic, n, n1)
    kept = np.flatnonzero((of_all >= 3) & (chi >= LEAST_CHI))
    kept = kept[np.argsort(-chi[kept], kind="stable")[: MOST_TERMS * 3 // 4]]
    kept = np.unique(np.concatenate([kept, paired(sets, labels, of_all, of_toxic, chi)[: MOST_TERMS // 4]]))
    m = Machine(kept, bias)
    if not len(kept):
        return m
    place = np.full(BUCKETS, -1)
    place[kept] = np.arange(len(kept))
    sets = [p[p >= 0] for p in (place[s] for s in sets)]
    weight = np.where(labels == 1, min(4.0, (n - n1) / n1), 1.0)
    rng = np.random.default_rng(7)
    gw, gv, gb = np.full(len(kept), 1e-2), np.full((len(kept), FACTORS), 1e-2), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for lo in range(0, n, 128):
            at = order[lo : lo + 128]
            size = np.array([len(sets[i]) for i in at])
            flat, doc = np.concatenate([sets[i] for i in at]), np.repeat(np.arange(len(at)), size)
            z, sums = m.score(flat, doc, len(at))
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[at]) * weight[at] / len(at)
            used, back = np.unique(flat, return_inverse=True)
            dw = np.bincount(back, weights=d[doc], minlength=len(used)) + 1e-5 * m.w[used]
            each = d[doc, None] * (sums[doc] - m.v[flat])
            dv = np.stack([np.bincount(back, weights=each[:, k], minlength=len(used)) for k in range(FACTORS)], axis=1) + 1e-4 * m.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            m.w[used] -= 0.3 * dw / np.sqrt(gw[used])
            m.v[used] -= 0.05 * dv / np.sqrt(gv[used])
            db = d.sum()
            gb += db * db
            m.bias -= 0.1 * db / np.sqrt(gb)
    return m


def _sample(labels: DataFrame, most_rows: int) -> DataFrame:
    n = labels.count()
    u = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return labels.where(u < min(1.0, most_rows / max(n, 1)))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = FIT_ROWS) -> Machine:
    """A machine for ``doc_id, text`` and the labels ``doc_id, toxic`` to learn from."""

    @pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            sets = [{b for w in words_of(t) for b in buckets_of(w)} for t in texts]
            yield pd.Series([np.array(sorted(s), dtype="<i4").tobytes() for s in sets], dtype=object)

    wanted = F.broadcast(_sample(labels.where("toxic is not null"), most_rows))  # of about most_rows rows
    rows = docs.select("doc_id", whole(F.col("text")).alias("text")).join(wanted.select("doc_id", "toxic"), "doc_id")
    got = rows.select("doc_id", "toxic", packed("text").alias("x")).toPandas().sort_values(["doc_id", "toxic", "x"], ignore_index=True)
    return train([np.frombuffer(b, dtype="<i4") for b in got["x"]], (got["toxic"].to_numpy() > 0).astype(int))


def scorer(spark: SparkSession, machine: Machine):
    """Column function from text to the chance that it is toxic."""
    sent = spark.sparkContext.broadcast(machine)  # at most MOST_TERMS weights and their factors

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        for texts in batches:
            values = texts.tolist()
            yield pd.Series(np.concatenate([m.proba(values[i : i + 500]) for i in range(0, len(values), 500)] or [np.zeros(0)]))

    return lambda text: score(whole(text))


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, most_rows: int = FIT_ROWS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows with ``score`` and ``predicted``; ``learn`` says of a label's ``doc_id`` whether it may be learned from."""
    small_batches(docs.sparkSession)
    known = labels.select("doc_id", "toxic").where(learn)
    machine = fit(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), known, most_rows)
    scored = docs.withColumn("score", scorer(docs.sparkSession, machine)(F.col(text)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
