"""Scores of whole documents by a gated recurrent language model and by unigram counts.

The words of all documents to learn from are counted on Spark. The most
frequent ones, whose number and length are bounded, go to every task; what
documents hold of the others is joined with the counts by a shuffle. The
recurrent model knows ``WORDS`` words one by one; any other word has the chance
of its class by the model times its share of the class's counts.

Each text is turned into numbers once, which are stored. The model is trained
by parallel passes of truncated backpropagation. A hash of id and text deals
the documents to learn from out to shards of about ``SHARD`` words, and these
to rounds of one, two, four shards and so on, so that rounds grow in number
with the corpus. In a round every shard's documents, in the order of their ids,
are trained on from the same parameters; the results, and the squares of the
gradients that the steps are measured by, are averaged by the number of words
and go on to the next round. So each document is trained on once, and how the
input is split changes neither shards nor, but for rounding, scores.

Defined cases: a null or empty text has the one token that ends a text; a null
id is learned from; repeated rows are counted and trained on as often as they
occur, and score alike; without a document to learn from every count is zero;
a word that no training document has gets half a count, in the model as in the
base score; an empty table gives an empty result. Texts are scored whole,
however long, with the state carried to their end. Extra columns of the
documents are not returned, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import recurrent
from wayline.llm.common import checkpointed, fold, small_batches, stored_by, table, whole

#: Words whose counts every task has, at most, and their length in bytes.
KNOWN, LONGEST = 1 << 18, 64
#: Tokens that the recurrent model knows one by one.
WORDS = 1024
END = b""
RATE = 0.01
#: Words of a shard of a round, about.
SHARD = 1 << 19
#: Partitions of a round, at most; each holds whole shards, one after the other.
MOST_PARTS = 10_000
#: Words that a task counts before it passes the counts on.
COUNTED = 4_000_000
#: Words that are scored at a time.
BLOCK = 3_000_000


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts with A to Z in lower case, one text after the other, and the number of words of each; the ends are not among them."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    words, bounds = split.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
    real = pc.greater(pc.binary_length(words), 0)  # blanks at a text's ends leave empty words
    so_far = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return words.filter(real), np.diff(so_far[bounds])


def count_words(docs: DataFrame) -> DataFrame:
    """``word, c`` for each token of the texts, the end of a text as the empty word; checkpointed."""

    def counted(held: list[pa.Array], ends: int) -> pa.RecordBatch:
        both = pc.value_counts(pa.concat_arrays([*held, pa.array([], pa.large_string())]))
        words, n = both.field("values").cast(pa.binary()), both.field("counts")
        return pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([END], pa.binary())]), pa.concat_arrays([n, pa.array([ends], pa.int64())])], ["word", "c"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        ends = 0
        for batch in batches:
            held.append(tokens(batch.column(0))[0])
            ends += batch.num_rows
            if sum(map(len, held)) > COUNTED:
                yield counted(held, ends)
                held, ends = [], 0
        yield counted(held, ends)

    rows = docs.select("text").mapInArrow(count, "word binary, c long")
    return checkpointed(rows.where("c > 0").groupBy("word").agg(F.sum("c").alias("c")))


class Vocabulary:
    """The frequent words with their counts, the sums of all, and what the model needs of the rest."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int, rare: np.ndarray, rare_distinct: np.ndarray):
        """``words`` begins with the end of a text; ``rare`` and ``rare_distinct`` are of the classes, without the first WORDS words."""
        self.words, self.counts, self.total, self.distinct = words, counts, total, distinct
        self.rare, self.rare_distinct = rare, rare_distinct

    def built(self) -> Vocabulary:
        if not hasattr(self, "values"):
            self.values = pa.array(self.words, pa.large_binary())
            number = self._others(self.values)
            number[:WORDS] = np.arange(min(WORDS, len(number)))
            self.number = number
            self.log_count = np.log10(self.counts + 0.5)
            self.norm = math.log10(self.total + 0.5 * (self.distinct + 1))
            self.log_share = np.log10(self.rare + 0.5 * (self.rare_distinct + 1))
        return self

    @property
    def frequent(self) -> int:
        """Numbers below this are words that the model knows."""
        return -(-min(WORDS, len(self.words)) // recurrent.IN) * recurrent.IN

    def _others(self, words: pa.Array) -> np.ndarray:
        """Numbers of words that the model does not know."""
        ends, content = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1], words.buffers()[2]
        content = np.frombuffer(content, dtype=np.uint8) if content is not None else np.zeros(0, dtype=np.uint8)
        if not len(content):
            return np.zeros(len(words), dtype=np.int32)
        rows, classes = recurrent.tail_rows(content, ends), recurrent.rare_classes(content, ends)
        return (self.frequent + rows * recurrent.RARE + classes).astype(np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of the words and the end of each text, one text after the other: numbers for the model, places among the frequent words (-1: none), and places among the words met (-1: the end); where each text's begin (and the end); and the words met."""
        words, count = tokens(texts)
        met = words.dictionary_encode()
        own = met.dictionary.cast(pa.large_binary())
        place = np.concatenate([met.indices.to_numpy(), [0]]).astype(np.int64) if len(words) else np.zeros(1, dtype=np.int64)
        bounds = np.concatenate([[0], np.cumsum(count + 1)])
        at = np.full(bounds[-1], -1, dtype=np.int64)  # the end of a text
        at[np.arange(len(words)) + np.repeat(np.arange(len(count)), count)] = place[:-1]
        known = pc.fill_null(pc.index_in(own, value_set=self.values), -1).to_numpy().astype(np.int64)
        number = np.where(known >= 0, self.number[known], self._others(own))
        return np.append(number, 0).astype(np.int32)[at], np.append(known, 0)[at], at, bounds, own

    def start(self) -> recurrent.Params:
        return recurrent.start(self.counts[:WORDS].astype(float), self.rare + 0.5 * self.rare_distinct)


def vocabulary(counts: DataFrame, known: int = KNOWN) -> tuple[Vocabulary, Column]:
    """The vocabulary, and the condition on counts that holds for its frequent words."""
    words = counts.where(F.octet_length("word") > 0)
    c, short = F.col("c"), F.octet_length("word") <= LONGEST
    bin_ = F.when(c < 1024, c).otherwise(1024 + F.floor(F.log2(c / 1024.0) * 64)).cast("long")  # a few thousand bins at most
    bins = sorted(((r["bin"], r["n"], r["least"]) for r in words.where(short).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()), reverse=True)
    least, seen = 1 << 62, 0
    for _, n, lowest in bins:
        seen += n
        if seen > known:
            break
        least = lowest
    frequent = (c >= least) & short
    top = words.where(frequent).toPandas().sort_values(["c", "word"], ascending=[False, True])  # KNOWN words at most
    sums = counts.agg(F.sum("c").alias("total"), F.count("*").alias("distinct"), F.sum(F.when(F.octet_length("word") == 0, c)).alias("ends")).first()
    pair = F.conv(F.rpad(F.hex(F.substring("word", 1, 2)), 4, "0"), 16, 10).cast("long")
    cls = F.floor((pair * 40503 % 65536) * recurrent.RARE / 65536).cast("int")  # recurrent.rare_class_of
    rare, rare_distinct = np.zeros(recurrent.RARE), np.zeros(recurrent.RARE)
    for r in words.groupBy(cls.alias("cls")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        rare[r["cls"]], rare_distinct[r["cls"]] = r["c"], r["n"]
    listed = [END, *(bytes(w) for w in top["word"])]
    listed_counts = np.array([sums["ends"] or 0, *top["c"]], dtype=np.int64)
    for w, k in zip(listed[1:WORDS], listed_counts[1:WORDS], strict=True):
        rare[recurrent.rare_class(w)] -= k
        rare_distinct[recurrent.rare_class(w)] -= 1
    return Vocabulary(listed, listed_counts, sums["total"] or 0, sums["distinct"] or 0, rare, rare_distinct), frequent


def encoded(docs: DataFrame, vocab: Vocabulary, shard_words: int = SHARD) -> DataFrame:
    """``doc_id, text, learn`` in numbers, stored by rounds of training (of what is not learned from: -1).

    ``row`` tells rows apart; ``words`` and ``times`` are those that no task knows,
    whose part ``base`` and ``model`` still lack; ``model`` lacks the network's part too.
    """
    shards = max(1, round(vocab.total / shard_words))
    place = F.pmod(F.xxhash64(F.lit("recurrent"), "doc_id", "text"), F.lit(shards)) + 1
    number = F.length(F.bin(place)) - 1  # the greatest power of two that fits
    round_ = F.when(F.col("learn"), number).otherwise(-1).cast("int")
    shard = (place - F.pow(F.lit(2), number).cast("long")).cast("int")
    sent = docs.sparkSession.sparkContext.broadcast(vocab)
    schema = "row long, doc_id long, round int, shard int, numbers binary, n_tokens long, known long, base double, model double, words array<binary>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value.built()
        for batch in batches:
            if not batch.num_rows:
                continue
            number, known, at, bounds, own = v.encode(batch.column(4))
            sums = lambda values, starts=bounds[:-1]: np.add.reduceat(values, starts)
            size = np.diff(bounds)
            logs = np.where(known >= 0, v.log_count[known], 0.0)
            rare = number >= v.frequent
            shares = np.where(rare, v.log_share[np.where(rare, number - v.frequent, 0) % recurrent.RARE], 0.0)
            unknown = np.flatnonzero(known < 0)
            doc = np.repeat(np.arange(len(size)), size)[unknown]
            pairs, times = np.unique(doc * max(1, len(own)) + at[unknown], return_counts=True)
            ends = pa.array(np.searchsorted(pairs // max(1, len(own)), np.arange(len(size) + 1)).astype(np.int32))
            words = own.take(pa.array(pairs % max(1, len(own)))).cast(pa.binary())
            numbers = [n.tobytes() for n in np.split(number.astype(np.uint16), bounds[1:-1])]
            arrays = [
                *(batch.column(i) for i in range(4)), pa.array(numbers, pa.binary()), pa.array(size), pa.array(sums((known >= 0) & (v.counts[known] > 0)).astype(np.int64)),
                pa.array(sums(logs) - size * v.norm), pa.array(sums(np.where(rare, logs, 0.0) - shares)),
                pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "round", "shard", "numbers", "n_tokens", "known", "base", "model", "words", "times"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", round_.alias("round"), shard.alias("shard"), "text")
    return stored_by(rows.mapInArrow(run, schema), "numbers", "round")


def numbers_of(column: pa.Array) -> list[np.ndarray]:
    """The numbers of each text's words."""
    return [np.frombuffer(b, dtype=np.uint16).astype(np.int32) for b in column.to_pylist()]


def train(texts: DataFrame, vocab: Vocabulary) -> recurrent.Params:
    """Parameters after the rounds of parallel training on what ``encoded`` gave; each row is in one shard of one round."""
    params, spark = vocab.start(), texts.sparkSession
    weighted = "shard int, n double, content binary"
    shapes = {k: v.shape for k, v in params.items()}

    def one(flat: np.ndarray, square: np.ndarray | None, k: int):
        begin = spark.sparkContext.broadcast((flat, square))
        lanes = min(recurrent.LANES, recurrent.FIRST_LANES << min(k, 10))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flat, square = begin.value
            start = recurrent.unpacked(flat, {k: np.empty(s) for k, s in shapes.items()})
            rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), numbers_of(batch.column(1)), strict=True))
            for shard, own in groupby(rows, lambda row: row[0]):
                trainer = recurrent.Trainer(start, RATE / (1 + k), square)
                n = trainer.train(recurrent.pieces(number for _, number in own), lanes)
                content = (np.concatenate([trainer.flat, trainer.spread]) * np.float64(n)).astype(np.float32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([float(n)]), pa.array([content], pa.binary())], ["shard", "n", "content"])

        return run

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        total = sum(np.frombuffer(c, dtype=np.float32).astype(np.float64) for c in rows["content"])
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "n": [rows["n"].sum()], "content": [total.astype(np.float32).tobytes()]})

    flat, square = recurrent.flattened(params), None
    last = texts.agg(F.max("round")).first()[0]
    for k in range((-1 if last is None else last) + 1):
        taken = texts.where(F.col("round") == k).select("shard", "doc_id", "numbers").repartitionById(min(1 << k, MOST_PARTS), F.col("shard")).sortWithinPartitions("shard", "doc_id", F.xxhash64("numbers"))
        results = taken.select("shard", "numbers").mapInArrow(one(flat, square, k), weighted)
        for slots in (512, 8):  # sums of up to 512 and then of 8 rows; as many reach the driver
            if 1 << k > slots:
                results = results.groupBy((F.col("shard") % slots).alias("slot")).applyInPandas(added, weighted)
        got = sorted(results.collect(), key=lambda r: r["shard"])
        n = sum(r["n"] for r in got)
        if n:
            both = (sum(np.frombuffer(r["content"], dtype=np.float32).astype(np.float64) for r in got) / n).astype(np.float32)
            flat, square = both[: len(flat)], both[len(flat) :]
    return recurrent.unpacked(flat, params)


def score_documents(docs: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` for each row, learned from the rows for which ``learn`` holds.

    Columns that ``learn`` names must be among the documents'.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), whole(F.col(text)).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    counts = count_words(docs.where("learn"))
    vocab, frequent = vocabulary(counts)
    texts = encoded(docs, vocab)
    sent = docs.sparkSession.sparkContext.broadcast(train(texts, vocab))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = recurrent.Network(sent.value)
        held: list[pa.RecordBatch] = []
        numbers: list[np.ndarray] = []

        def done() -> Iterator[pa.RecordBatch]:
            log_p, at = net.score(numbers) / math.log(10), 0
            for batch in held:
                yield batch.append_column("network", pa.array(log_p[at : at + batch.num_rows]))
                at += batch.num_rows
            held.clear()
            numbers.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch.select(["row", "doc_id", "n_tokens", "known", "base", "model"]))
            numbers += numbers_of(batch.column("numbers"))
            if sum(map(len, numbers)) > BLOCK:
                yield from done()
        if held:
            yield from done()

    scored = texts.select("row", "doc_id", "n_tokens", "known", "base", "model", "numbers").mapInArrow(score, "row long, doc_id long, n_tokens long, known long, base double, model double, network double")
    rest = texts.select("row", F.inline(F.arrays_zip("words", "times"))).join(counts.where(~frequent).withColumnRenamed("word", "words"), "words", "left")
    found = rest.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"), F.sum(F.when(F.col("c").isNotNull(), F.col("times"))).alias("more"))
    both = scored.join(found, "row", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return both.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("model") + F.col("network") + logs).alias("score"),
    )


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    scored = score_documents(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
