"""Importance resampling towards a target distribution.

Features of a text are its runs of one and two words, each hashed to a bucket.
A bucket's gain is the logarithm of how much commoner it is in the target texts
than among all documents; a text's weight is the mean gain of its features. A
draw without replacement takes the documents with the highest weight plus
Gumbel noise.

Identical texts are collapsed first, by grouping the full text: features are
computed once for each distinct text and kept as packed bucket numbers, counts
are multiplied by how often the text occurs, the weight comes from the packed
numbers, and the weights are joined back to the documents by the text's SHA-256
before the noise, which is each document's own, is added. Only the counts of
the buckets, as many as there are buckets, reach the driver. Ranks come from a
range partitioning by score and the sizes of its partitions.

Defined cases: a null text is the empty text, which has no features and the
weight 0; a text of one word has one feature; an empty table gives an empty
result, as no documents are drawn; without target texts the gains tell rare
from frequent buckets only; equal scores are ordered by id, a null id last,
and its noise is that of an empty id; rows of equal id and text have equal
scores and ranks next to each other. Columns of the caller with the names of
added ones are replaced. Texts are taken whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.llm.asciiwords import words
from wayline.llm.common import checkpointed, small_batches, table, whole

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: A gain or a noise of 1 is this many.
SCALE = 1000


def feature_buckets(ws: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each run of one or two words, in ascending order."""
    one = list(map(zlib.crc32, ws))
    two = map(zlib.crc32, map(b"".join, zip(repeat(b" "), ws[1:])), one)  # the checksum of a word is carried on through the blank and the next
    all_ = np.array([*one, *two], dtype=np.uint32) % np.uint32(buckets)
    all_.sort()
    return all_


def packed(sorted_buckets: np.ndarray) -> bytes:
    """Ascending numbers as compressed differences."""
    return zlib.compress(np.diff(sorted_buckets, prepend=np.uint32(0)).astype("<u4").tobytes(), 1)


def unpacked(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(b), dtype="<u4"), dtype=np.int64)


def text_features(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``digest, copies, n_words, n_features, packed`` for each distinct whole text, written to the shared folder."""
    small_batches(docs.sparkSession)
    once = docs.groupBy(whole(F.col(text)).alias("text")).agg(F.count("*").alias("copies"))
    once = once.select(F.unhex(F.sha2("text", 256)).alias("digest"), "copies", F.col("text").cast("binary").alias("text"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, out = [], []
            for t in b["text"]:
                ws = words(t.as_py())
                n.append(len(ws))
                out.append(packed(feature_buckets(ws, buckets)))
            counts = np.array(n, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b["digest"], b["copies"], pa.array(counts), pa.array(counts + np.maximum(counts - 1, 0)), pa.array(out, pa.binary())], ["digest", "copies", "n_words", "n_features", "packed"])

    return checkpointed(once.mapInArrow(told, "digest binary, copies long, n_words long, n_features long, packed binary"))


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: features in each bucket over all texts and their copies; each task sends a row a bucket at most."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for x, copies in zip(b["packed"], b["copies"].to_pylist(), strict=True):
                total += np.bincount(unpacked(x.as_py()), minlength=buckets) * copies
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return features.select("copies", "packed").mapInArrow(summed, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket from the bucket counts of both sides."""
    s, t = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
    for side, counts in ((s, corpus), (t, target)):
        for r in counts.collect():  # a row a bucket
            side[r["bucket"]] = r["n"]
    all_s, all_t = float(s.sum()), float(t.sum())
    return np.array([math.floor(SCALE * math.log((float(b) + 1) * (all_s + buckets) / ((float(a) + 1) * (all_t + buckets)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)], dtype=np.int64)


def weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """``digest, n_words, n_features, weight`` of each distinct text."""

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b["n_features"].to_pylist()
            out = [int(gain[unpacked(x.as_py())].sum()) // k if k else 0 for x, k in zip(b["packed"], n, strict=True)]
            yield pa.RecordBatch.from_arrays([b["digest"], b["n_words"], b["n_features"], pa.array(out, pa.int64())], ["digest", "n_words", "n_features", "weight"])

    return features.select("digest", "n_words", "n_features", "packed").mapInArrow(mean, "digest binary, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a document, in whole thousandths, from the first 32 bits of SHA-256 of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-float(SCALE) * F.log(-F.log((h + 0.5) / float(1 << 32)))).cast("long")


def _order(doc_id: str) -> list[Column]:
    return [F.col("_drawable").desc(), F.col("score").desc(), F.col(doc_id).asc_nulls_last()]


def _scored(docs: DataFrame, weights: DataFrame, seed: int, least_words: int, text: str, doc_id: str) -> DataFrame:
    """The rows with ``n_features, weight, score`` and ``_drawable``; copies of one text meet its weight by its digest."""
    own = [c for c in docs.columns if c not in ("n_features", "weight", "score", "_drawable")]
    rows = docs.select(F.struct(*own).alias("row"), F.col(doc_id).alias("id"), F.unhex(F.sha2(whole(F.col(text)), 256)).alias("digest"))
    both = rows.join(weights, "digest")
    return both.select("row.*", "n_features", "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("_drawable"))


def _prepared(docs: DataFrame, target: DataFrame, percent: int, least_words: int, text: str) -> tuple[DataFrame, int]:
    """The weights of the distinct texts, and how many documents are drawn."""
    features = text_features(docs, text)
    gain = gains(bucket_counts(features), bucket_counts(text_features(target.select(F.col(text)), text)))
    drawable = features.agg(F.sum(F.when(F.col("n_words") >= least_words, F.col("copies")))).first()[0] or 0
    return weighed(features, gain), percent * drawable // 100


def _placed(scored: DataFrame, doc_id: str) -> DataFrame:
    """The rows in the order of the draw with ``_place`` from 1: the place in a range partition, and the rows in those before."""
    rows = scored.repartitionByRange(*_order(doc_id)).sortWithinPartitions(*_order(doc_id))
    rows = checkpointed(rows.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_part", before.alias("_before"))  # a row a partition
    rows = rows.withColumn("_part", part).join(F.broadcast(sizes), "_part")
    return rows.withColumn("_place", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_at", "_part", "_before")


def importance(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; ``rank`` is null where the draw leaves it."""
    weights, wanted = _prepared(docs, target, percent, least_words, text)
    rows = _placed(_scored(docs.select(doc_id, text), weights, seed, least_words, text, doc_id).drop(text), doc_id)
    rank = F.when(F.col("_drawable") & (F.col("_place") <= wanted), F.col("_place"))
    return rows.select(doc_id, "n_features", "weight", "score", rank.alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The drawn documents with all their columns and ``n_features, weight, score``.

    The last place drawn gives the least score (and its greatest id), so whole
    texts are filtered, never sorted; rows of that very score and id all stay.
    """
    weights, wanted = _prepared(docs, target, percent, least_words, text)
    places = _placed(_scored(docs.select(doc_id, text), weights, seed, least_words, text, doc_id).drop(text), doc_id)
    last = places.where(F.col("_place") == wanted).select("score", doc_id).first()
    rows = _scored(docs, weights, seed, least_words, text, doc_id)
    if last is None:
        return rows.drop("_drawable").limit(0)
    tied = F.lit(True) if last[1] is None else F.col(doc_id) <= F.lit(last[1])
    keep = F.col("_drawable") & ((F.col("score") > last[0]) | ((F.col("score") == last[0]) & tied))
    return rows.where(keep).drop("_drawable")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
