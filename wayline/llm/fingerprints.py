"""Document fingerprints by consistent weighted sampling.

A document is the weighted set of its word n-grams, weighted by how often each
occurs. For each of ``SAMPLES`` samples a term draws from its hash a gamma
variate c, a gamma variate r and a uniform shift; r and the shift give the
term's weight a quantised value y, and of all terms the one with the least
ratio c / (y exp(r)) is the sample. The chance that two documents draw the same
term at the same quantised value is their generalised Jaccard similarity, the
sum of the lesser weights over the sum of the greater. A ratio depends on the
term and the quantised value alone, so equal ratios tell equal samples, and 16
bits of a ratio's hash stand for it in the fingerprint.

The gamma variates (of shape 2) are made as sums of exponential ones, in such a
way that the ratio of a term of weight one is itself the first of these, an
exponential variate: c = a + e and r = ln(c / a) + e' for independent a, e and
e', with e' / r as the shift. Ratios are compared by their place in that
distribution, 32 bits; so terms of weight one need their hash only.

Defined cases: a null text is the empty text; texts without a word have the
same fingerprint, which shares a sample with another by a chance collision of
16 bits only; a text of fewer words
than n has one term, all its words; equal texts have equal fingerprints,
wherever they are; an empty table gives an empty result; columns of the caller
with the names of added ones are replaced. Texts are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from wayline.llm.common import small_batches, table, whole
from wayline.llm.shingles import mixed, word_hashes

N = 5
SAMPLES = 64
#: Bits of a 64-bit key that tell the texts of a slice apart; the others tell terms apart.
DOC_BITS = 12
#: Characters of text that are sampled at a time.
SLICE = 40_000
#: Characters of consecutive rows that are compared at a time.
BLOCK = 600_000
#: Stands for a null id in comparisons.
LEAST = -(1 << 63)
#: Odd factors for the words of an n-gram by their places, n at most as many.
PLACE = np.random.default_rng(99).integers(0, 1 << 63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: For each sample a factor and a number to add, odd.
FACTOR, SHIFT = np.random.default_rng(4242).integers(0, 1 << 31, (2, SAMPLES), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _unit(bits: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1 from 32 bits."""
    return (bits.astype(np.float64) + 0.5) * 2.0**-32


def ratio_places(terms: np.ndarray, log_weights: np.ndarray, several: np.ndarray, j: int) -> np.ndarray:
    """32 bits of the place of each term's ratio for sample j. ``several`` are the terms of a weight over one, ``log_weights`` theirs."""
    place = terms * FACTOR[j]
    place += SHIFT[j]
    place ^= place >> np.uint32(16)
    place *= np.uint32(0x7FEB352D)
    place ^= place >> np.uint32(15)
    if len(several):
        low = place[several]
        more = mixed((terms[several].astype(np.uint64) << np.uint64(32)) | low)
        a, e, e2 = -np.log1p(-_unit(low)), -np.log(_unit(more >> np.uint64(32))), -np.log(_unit(more & np.uint64(0xFFFFFFFF)))
        c = a + e
        r = np.log(c / a) + e2
        beta = e2 / r
        t = np.floor(log_weights / r + beta)
        ratio = c * np.exp(-r * (t - beta) - r)
        place[several] = np.where(t > 0, (-np.expm1(-ratio) * 2.0**32).astype(np.uint32), low)
    return place


def weighted_grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct word n-grams, how often each occurs in it, and where each text's begin (and the end)."""
    flat, count = word_hashes([t.encode() for t in texts])
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    flat = np.concatenate([flat, np.zeros(n, dtype=np.uint64)])
    doc = np.repeat(np.arange(len(texts)), grams)
    at = np.arange(len(doc)) - (np.cumsum(grams) - grams)[doc] + (np.cumsum(count) - count)[doc]
    width = np.minimum(count, n)
    if (width[grams > 0] == n).all():
        h = sum((flat[at + k] * PLACE[k] for k in range(n)), np.uint64(n))
    else:
        own = width[doc]
        h = sum((np.where(k < own, flat[at + k], np.uint64(0)) * PLACE[k] for k in range(n)), own.astype(np.uint64))
    key = np.sort((mixed(h) >> np.uint64(DOC_BITS)) | (doc.astype(np.uint64) << np.uint64(64 - DOC_BITS)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    doc = (key[first] >> np.uint64(64 - DOC_BITS)).astype(np.int64)
    return key[first] << np.uint64(DOC_BITS), np.diff(first, append=len(key)), np.searchsorted(doc, np.arange(len(texts) + 1))


def samples(texts: list[str], n: int = N) -> np.ndarray:
    """16 bits for each text and sample; fewer than ``1 << DOC_BITS`` texts."""
    terms, weights, ends = weighted_grams(texts, n)
    out = np.full((len(texts), SAMPLES), 1 << 32, dtype=np.uint64)
    full = np.flatnonzero(np.diff(ends) > 0)
    if len(full):
        terms, starts, several = (mixed(terms) >> np.uint64(32)).astype(np.uint32), ends[full], np.flatnonzero(weights > 1)
        log_weights = np.log(weights[several])
        for j in range(SAMPLES):
            out[full, j] = np.minimum.reduceat(ratio_places(terms, log_weights, several, j), starts)
    return (mixed(out + np.uint64(1)) >> np.uint64(48)).astype(np.uint16)


def all_samples(texts: list[str], n: int = N) -> np.ndarray:
    """As ``samples``, a bounded part of the texts at a time (or one text)."""
    parts, lo, total = [], 0, 0
    for i, t in enumerate(texts):
        if i > lo and (total + len(t) > SLICE or i - lo >= 1 << (DOC_BITS - 1)):
            parts.append(samples(texts[lo:i], n))
            lo, total = i, 0
        total += len(t)
    parts.append(samples(texts[lo:], n))
    return np.concatenate(parts)


def hexed(values: np.ndarray) -> list[str]:
    """Fingerprints as text, four hexadecimal digits a sample."""
    return [row.tobytes().hex() for row in values.astype(">u2")]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def fingerprint_documents(docs: DataFrame, n: int = N, text: str = "text", fingerprint: str = "fingerprint") -> DataFrame:
    """The rows with the fingerprint of the whole text."""

    @pandas_udf("string")
    def printed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(hexed(all_samples(texts.tolist(), n)) if len(texts) else [], dtype=object)

    return docs.withColumn(fingerprint, printed(whole(F.col(text))))


def cuts_below(key: Column, cuts: np.ndarray) -> Column:
    """How many of the ascending cuts are not above the key; the cuts go to the tasks beside the plan, not in it."""

    @pandas_udf("int")
    def below(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy(), side="right").astype(np.int32))

    return below(key)


#: Ids for each partition that its bounds are taken from.
DRAWN = 20


def _cuts(keys: DataFrame, parts: int) -> np.ndarray:
    """Bounds of as many ranges of about equal size, from some ids for each, drawn by a hash."""
    n = keys.count()
    if not n:
        return np.zeros(0)
    share = min(1.0, DRAWN * parts / n)
    drawn = keys.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int(share * (1 << 30))).toPandas()["k"].to_numpy().copy()  # some numbers a partition
    drawn.sort()
    return np.unique(drawn[np.arange(1, parts) * len(drawn) // parts]) if len(drawn) else np.zeros(0)


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """``doc_id, text, extra`` by ascending id in ``parts`` partitions or fewer, each followed by a copy of the next one's first row, marked ``extra``.

    The last partition is followed by the first row of all. The bounds are
    quantiles of some of the ids; only the first row of each partition is copied, and
    the plan does not grow with the partitions.
    """
    docs = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)))
    cuts = _cuts(docs.select(F.col("_key").cast("double").alias("k")), parts) if parts > 1 else np.zeros(0)
    placed = docs.withColumn("_part", cuts_below(F.col("_key").cast("double"), cuts))
    heads = placed.groupBy("_part").agg(F.min("_key").alias("_key"))  # a row a partition
    before = F.coalesce(F.lag("_part").over(Window.orderBy("_part")), F.max("_part").over(Window.partitionBy()))
    heads = heads.select("_key", before.alias("_before"))
    extra = placed.join(F.broadcast(heads), "_key").groupBy("_key", "_before").agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text"))
    extra = extra.select("doc_id", "text", F.col("_before").alias("_part"), F.lit(True).alias("extra"))
    rows = placed.select("doc_id", "text", "_part", F.lit(False).alias("extra")).union(extra)
    return rows.repartitionById(parts, F.col("_part")).sortWithinPartitions("extra", "doc_id", "text")


def _compare(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    """Rows in order, a partition's extra row last; the row before is held back until its next is known."""

    def told(rows: list[tuple]) -> pd.DataFrame:
        texts = [r[1] for r in rows]
        own = texts[:-1]
        edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(own, texts[1:], strict=True)]
        values, b = all_samples(texts, n), all_samples(edited, n)
        a, c = values[:-1], values[1:]
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if pd.isna(r[0]) else int(r[0]) for r in rows[:-1]], dtype="Int64"),
                "n_chars": [len(t) for t in own],
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                "fingerprint": hexed(a),
                "edited_fingerprint": hexed(b),
                "near_edited": likeness(a, b),
                "near_next": likeness(a, c),
            }
        )

    held: list[tuple] = []
    chars = 0
    for batch in batches:
        for row in zip(batch["doc_id"], batch["text"], batch["extra"], strict=True):
            held.append(row)
            chars += len(row[1])
            if len(held) > 1 and (row[2] or chars > BLOCK):
                yield told(held)
                held, chars = ([], 0) if row[2] else ([row], len(row[1]))


def compare_neighbours(docs: DataFrame, n: int = N, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """For each document its fingerprint, that of its edited text, and how alike they and the next document's are."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), whole(F.col(text)).alias("text"))
    parts = max(1, docs.rdd.getNumPartitions())
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, parts).mapInPandas(lambda batches: _compare(batches, n), schema)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))
