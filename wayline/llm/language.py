"""Language identification by hierarchical discrimination.

A text becomes a vector of hashed letter n-grams (one to three letters, blanks
between words included). Linear support vector machines, one for each family
against the rest, choose the family first; within it, machines for each pair
of its languages vote, and a tie goes to the larger sum of margins. A language
that the table of families does not name is a family of its own.

The machines are fitted on the driver on a bounded sample of labelled rows: at
most ``FIT_ROWS`` are expected, shared equally among the languages; which rows
are taken depends on a hash of their ids alone. Every text is predicted whole.

Defined cases: a null text or one without a letter gets ``und`` with score 0;
so does every text if no row to learn from has a language; with one language
to learn, every text with a letter gets it with score 1; rows are judged each
on their own, so repeats agree; a null id is learned from; an empty table
gives an empty result; columns of the caller with the names of added ones are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from wayline.llm.common import fold, small_batches, table, whole

# Families of languages, by their two-letter codes.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indo_aryan": ("bn", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("ar", "he", "mt"),
}
UNKNOWN = "und"
BITS = 12
DIM = 1 << BITS
#: Labelled rows that the machines are fitted on, at most as expected by the hash of ids.
FIT_ROWS = 4000
EPOCHS = 12
REGULAR = 1e-4
_LETTERS: list[np.ndarray] = []


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def _slices(texts: list[str], most_chars: int = 400_000, most_rows: int = 256) -> Iterator[list[str]]:
    part, total = [], 0
    for t in texts:
        if part and (total + len(t) > most_chars or len(part) >= most_rows):
            yield part
            part, total = [], 0
        part.append(t)
        total += len(t)
    if part:
        yield part


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of square-rooted n-gram counts, and the number of letters of each text."""
    low = [t.lower() for t in texts]
    size = np.fromiter((len(t) + 2 for t in low), dtype=np.int64, count=len(low))
    codes = np.frombuffer("".join(f" {t} " for t in low).encode("utf-32-le"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(low), dtype=np.int64), size)
    alpha = _letters()[codes]
    letters = np.bincount(doc, weights=alpha, minlength=len(low)).astype(np.int64)
    keep = alpha.copy()
    keep[1:] |= alpha[:-1]  # of the blanks and signs between two words one blank stays
    keep[0] = True
    starts = np.cumsum(size) - size
    keep[starts] = True
    codes, doc = np.where(alpha, codes, np.uint32(32))[keep], doc[keep] << BITS
    out = np.zeros(len(low) * DIM)
    h = np.zeros(len(codes), dtype=np.uint32)
    for n in (1, 2, 3):
        if len(codes) < n:
            break
        h = (h[: len(codes) - n + 1] + codes[n - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        own = doc[: len(codes) - n + 1]
        within = own == doc[n - 1 :]
        bucket = ((h * np.uint32(0x85EBCA6B) + np.uint32(n * 0x1B873593 & 0xFFFFFFFF)) >> np.uint32(32 - BITS)).astype(np.int64)
        out += np.bincount((own + bucket)[within], minlength=len(out))
    x = np.sqrt(out.reshape(len(low), DIM)).astype(np.float32)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(norm, 1e-9), letters


def _machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear machine for labels -1 and 1: averaged stochastic steps on the hinge loss, both labels weighing the same."""
    rng = np.random.default_rng(11)
    n, w, mean, steps, t = len(y), np.zeros(DIM + 1), np.zeros(DIM + 1), 0, 0
    weight = np.where(y > 0, n / max(1, 2 * (y > 0).sum()), n / max(1, 2 * (y < 0).sum()))
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        for lo in range(0, n, 64):
            at = order[lo : lo + 64]
            t += 1
            rate = 1.0 / (1.0 + 0.02 * t)
            wrong = y[at] * (x[at] @ w[:-1] + w[-1]) < 1
            push = (y[at] * weight[at] * wrong)[:, None]
            w[:-1] += rate * ((push * x[at]).mean(axis=0) * 8 - REGULAR * w[:-1])
            w[-1] += rate * push.mean()
            if epoch >= EPOCHS // 2:
                mean += w
                steps += 1
    return mean / max(1, steps)


class Hierarchy:
    """Machines of the families, and of the pairs of languages within each."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family(s) for s in self.langs})
        own = np.array([family(s) for s in langs])
        lang = np.array(langs)
        several = len(self.families) > 1
        self.top = np.stack([_machine(x, np.where(own == f, 1.0, -1.0)) for f in self.families]) if several else None
        self.pairs: dict[str, list[tuple[str, str]]] = {}
        self.machines: dict[tuple[str, str], np.ndarray] = {}
        for f in self.families:
            inside = [s for s in self.langs if family(s) == f]
            self.pairs[f] = list(combinations(inside, 2))
            for a, b in self.pairs[f]:
                at = (lang == a) | (lang == b)
                self.machines[a, b] = _machine(x[at], np.where(lang[at] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language of each vector, and a score from 0 to 1: the product of the logistic margins that it won by."""
        sure = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -8, 8)))
        if self.top is None:
            chosen, score = np.zeros(len(x), dtype=np.int64), np.ones(len(x))
        else:
            margins = x @ self.top[:, :-1].T + self.top[:, -1]
            chosen = margins.argmax(axis=1)
            score = sure(margins.max(axis=1))
        out = np.empty(len(x), dtype=object)
        for i, f in enumerate(self.families):
            at = np.flatnonzero(chosen == i)
            inside = [s for s in self.langs if family(s) == f]
            votes = np.zeros((len(at), len(inside)))
            worst = np.ones((len(at), len(inside)))
            for a, b in self.pairs[f]:
                w = self.machines[a, b]
                m = x[at] @ w[:-1] + w[-1]
                ia, ib = inside.index(a), inside.index(b)
                votes[:, ia] += (m > 0) + np.tanh(m) * 1e-3
                votes[:, ib] += (m <= 0) - np.tanh(m) * 1e-3
                worst[:, ia] = np.minimum(worst[:, ia], sure(m))
                worst[:, ib] = np.minimum(worst[:, ib], sure(-m))
            best = votes.argmax(axis=1)
            out[at] = np.array(inside, dtype=object)[best]
            score[at] *= worst[np.arange(len(at)), best]
        return out, score


def _sample(rows: DataFrame, most_rows: int) -> DataFrame:
    """About ``most_rows`` rows at most, as many of each language; a row stays or goes by the hash of its id."""
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return rows.limit(0)
    each = max(1, most_rows // len(counts))
    share = F.create_map(*(F.lit(v) for s, n in counts.items() for v in (s, min(1.0, each / n))))
    u = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(u < share[F.col("lang")])


def fit(rows: DataFrame, most_rows: int = FIT_ROWS) -> Hierarchy | None:
    """A model of the columns ``doc_id, text, lang``; None if no row has a language."""

    @pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([v.astype(np.float16).tobytes() for part in _slices(texts.tolist()) for v in vectors(part)[0]], dtype=object)

    sample = _sample(rows.where(F.col("lang").isNotNull()), most_rows).where(F.col("text").rlike(r"\p{L}"))
    got = sample.select("doc_id", "lang", packed("text").alias("x")).toPandas()
    got = got.sort_values(["lang", "doc_id", "x"], ignore_index=True)
    if got.empty:
        return None
    x = np.stack([np.frombuffer(b, dtype=np.float16) for b in got["x"]]).astype(np.float32)
    return Hierarchy(x, got["lang"].tolist())


def predictor(spark: SparkSession, model: Hierarchy | None):
    """Column function from text to the struct ``lang_pred, score``."""
    sent = spark.sparkContext.broadcast(model)  # some machines of a fixed size

    @pandas_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for texts in batches:
            langs, scores = [], []
            for part in _slices(texts.tolist()):
                x, letters = vectors(part)
                s, p = model.predict(x) if model else (np.full(len(part), UNKNOWN, dtype=object), np.zeros(len(part)))
                langs += np.where(letters > 0, s, UNKNOWN).tolist()
                scores += np.where(letters > 0, p, 0.0).tolist()
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return lambda text: predict(whole(text))


def identify(docs: DataFrame, learn: Column, most_rows: int = FIT_ROWS, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """The rows with ``lang_pred`` and ``score``, learned from those for which ``learn`` holds."""
    small_batches(docs.sparkSession)
    rows = docs.where(learn).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    predict = predictor(docs.sparkSession, fit(rows, most_rows))
    told = docs.withColumn("_told", predict(F.col(text)))
    return told.withColumns({"lang_pred": F.col("_told.lang_pred"), "score": F.col("_told.score")}).drop("_told")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    told = identify(docs, ~held_out)
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
