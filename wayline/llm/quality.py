"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule rejects a document or passes it on. A bounded sample tells how
costly each rule is and how many of the documents still in play it rejects;
the rules then run in the order of most rejections per cost, and a document
that one rule rejects is not shown to the next. The order changes the time
a document takes and which rule is named, never whether it is kept.

Defined cases: a null or empty text has no words and is rejected by
``few_words``; repeated rows are judged alike, each on its own; nulls in other
columns have no effect; an empty table gives an empty result; columns of the
caller with the names of added ones are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import checkpointed, let, table, whole, words

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
#: Words that a document must have.
LEAST_WORDS = 20
#: Rows of the sample on which costs and rejections are estimated.
SAMPLE_ROWS = 500
SEED = 23


class Measures:
    """What rules tell by, each made from a text and the array of its words; those that are known are columns already."""

    def __init__(self, text: Column, words: Column, known: Mapping[str, Column] | None = None):
        self.text, self.words, self.known = text, words, known or {}

    def _of(self, name: str, make: Callable[[], Column]) -> Column:
        return self.known[name] if name in self.known else make()

    @property
    def n_words(self) -> Column:
        return self._of("n_words", lambda: F.size(self.words).cast("long"))

    @property
    def word_chars(self) -> Column:
        return self._of("word_chars", lambda: word_chars(self.words))

    @property
    def n_symbols(self) -> Column:
        return self._of("n_symbols", lambda: symbol_count(self.text))

    @property
    def n_dup_lines(self) -> Column:
        return self._of("n_dup_lines", lambda: duplicate_lines(self.text))

    @property
    def n_repeat_words(self) -> Column:
        return self._of("n_repeat_words", lambda: repeated_words(self.words))

    def matches(self, pattern: str) -> Column:
        return F.regexp_count(self.text, F.lit(pattern))


@dataclass(frozen=True)
class Rule:
    """``rejects`` makes a condition of a text's measures."""

    name: str
    rejects: Callable[[Measures], Column]


def word_chars(w: Column) -> Column:
    return F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + F.length(x))


def symbol_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more in the text.

    Windows are compared by 64-bit hashes; the hashes are sorted with their
    places only where some hash occurs twice, so a text costs n log n at most.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(
            placed,
            lambda p: F.filter(p, lambda x, i: (F.get(p, i - 1)["h"] == x["h"]) | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False))),
        )
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return let(
            starts,
            lambda s: F.aggregate(
                s,
                F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last")),
                lambda a, x: F.struct((a["n"] + F.least(F.lit(window), x - a["last"])).alias("n"), x.alias("last")),
                lambda a: a["n"],
            ),
        )

    return F.when(
        F.size(w) > window,
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long"))),
    ).otherwise(F.lit(0).cast("long"))


def prepared(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the whole text as ``_text`` and its words as ``_words``."""
    return docs.withColumn("_text", whole(F.col(text))).withColumn("_words", words(F.col(text)))


def default_rules() -> list[Rule]:
    """Rules that a clean document of ordinary prose passes in any language."""
    return [
        Rule("few_words", lambda m: m.n_words < LEAST_WORDS),
        Rule("many_symbols", lambda m: m.n_symbols * 10 > m.n_words * 3),
        Rule("odd_word_length", lambda m: (m.word_chars > m.n_words * 20) | (m.word_chars < m.n_words * 2)),
        Rule("shouting", lambda m: m.matches(r"\p{Lu}") * 2 > m.matches(r"\p{L}")),
        Rule("repeated_lines", lambda m: m.n_dup_lines * 10 > F.size(F.split(m.text, "\n")) * 5),
        Rule("repeated_windows", lambda m: m.n_repeat_words * 100 > m.n_words * 30),
    ]


def sampled(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """About so many rows, drawn from all, with their words; written once, for every rule reads them."""
    n = docs.count()
    drawn = docs.select(text) if n <= rows else docs.select(text).sample(fraction=rows / n, seed=SEED)
    return checkpointed(prepared(drawn, text).coalesce(1))


def ordered(rules: Sequence[Rule], cost: Mapping[str, float], seen: Sequence[tuple[Mapping[str, bool], int]]) -> list[Rule]:
    """The rules by rejections per cost among the rows that the rules before have left; of those that reject none the cheapest first.

    ``seen`` holds combinations of rejections with the number of rows that have them.
    """
    left, order, todo = [*seen], [], [*rules]
    while todo:
        best = max(todo, key=lambda r: (sum(c for x, c in left if x[r.name]) / cost[r.name], -cost[r.name]))
        order.append(best)
        todo.remove(best)
        left = [(x, c) for x, c in left if not x[best.name]]
    return order


def order_rules(docs: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per cost, estimated on about ``sample_rows`` rows.

    One small job for each rule times it, after one that warms it up; one more
    counts the combinations of rejections (at most the rows of the sample).
    """
    base = sampled(docs, text, sample_rows)
    m = Measures(F.col("_text"), F.col("_words"))

    def seconds(df: DataFrame) -> float:
        began = time.perf_counter()
        df.collect()
        return time.perf_counter() - began

    def timed(df: DataFrame) -> float:
        df.collect()
        return min(seconds(df) for _ in range(2))

    floor = timed(base.agg(F.sum(F.size("_words"))))
    cost = {r.name: max(timed(base.agg(F.sum(F.size("_words")), F.count_if(r.rejects(m)))) - floor, 1e-4) for r in rules}
    seen = base.select(*(F.coalesce(r.rejects(m), F.lit(False)).alias(r.name) for r in rules)).groupBy(*(r.name for r in rules)).count().collect()
    return ordered(rules, cost, [(row.asDict(), row["count"]) for row in seen])


def rejected_by(rules: Sequence[Rule], measures: Measures) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated."""
    verdict = F.lit(None).cast("string")
    for r in reversed(rules):
        verdict = F.when(r.rejects(measures), F.lit(r.name)).otherwise(verdict)
    return verdict


def apply_rules(docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows with ``rejected_by``, the rule that ended the cascade, or null."""
    return _judged(docs, rules, text).drop("_text", "_words", "_at")


def _judged(docs: DataFrame, rules: Sequence[Rule] | None, text: str) -> DataFrame:
    rules = order_rules(docs, default_rules() if rules is None else rules, text)
    rows = prepared(docs, text).withColumn("_at", F.spark_partition_id())
    return rows.withColumn("rejected_by", rejected_by(rules, Measures(F.col("_text"), F.col("_words"))))


def quality_filter(docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with the columns they came with.

    The filter names the partition's number, a value that the optimiser must
    not compute twice; else it would move below the projection that cuts the
    text into words, and cut the text anew for every rule and window.
    """
    judged = _judged(docs, rules, text)
    return judged.where(F.col("rejected_by").isNull() & (F.col("_at") >= 0)).select(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures, which the contract asks for, and the cascade's verdict by them: a rule that needs no further measure costs nothing more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = order_rules(docs, default_rules())
    m = Measures(F.col("_text"), F.col("_words"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    measured = prepared(docs).select("doc_id", "_text", "_words", *(getattr(m, n).alias(n) for n in names))
    passed = rejected_by(rules, Measures(F.col("_text"), F.col("_words"), {n: F.col(n) for n in names})).isNull()
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return measured.select("doc_id", *names, failed.alias("base_failed"), (~failed & passed).alias("kept"))
