"""Removal of repeated and nearly repeated lines, in DataFrame functions only.

A line of at least ``min_chars`` code points goes if an earlier line of the
corpus (by document id, then place) equals it or is within ``edits`` edits of
it. Equal lines are found by their hashes. For the others the segment-partition
join is used: a line is cut into ``edits + 1`` segments, of which a line within
that many edits must contain one unchanged, at a place that the two lengths and
the segment's number confine; so each line is entered under its segments and
looks up those few of its substrings that could be a segment of a line as long
or shorter. Under a key that very many lines share, what is left of each line
is cut and looked up in the same way, again and again while it is long enough. Pairs that meet are verified by a
bit-parallel edit distance restricted to the band of ``2 * edits + 1`` diagonals.

Defined cases: a null text has no lines and stays null; shorter lines always
stay; a document that loses all of its lines keeps its row with an empty text
(``least_words`` removes it); repeated rows, having equal id and text, count
as one document and stay alike; nulls among ids come first; an empty table
gives an empty result; other columns pass through whatever their names.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import checkpointed, let, sized, table, whole, words

EDITS = 1
MIN_CHARS = 20
#: Distinct lines under a key from which on the rest of each is looked at too.
CROWD = 32
#: From the third time on that a crowd is cut anew, so many.
LARGE_CROWD = 2048
#: Code points that every segment of a rest must have for a crowd to be cut anew.
LEAST_PART = 2


def _segments(length: Column, edits: int) -> list[tuple[Column, Column]]:
    """Start (from 0) and length of each segment; the last ones are the longer by one."""
    parts, out, start = edits + 1, [], F.lit(0)
    short = F.floor(length / parts).cast("int")
    longer = (length - short * parts).cast("int")
    for i in range(parts):
        size = short + (F.lit(i) >= parts - longer).cast("int")
        out.append((start, size))
        start = start + size
    return out


def _entries(s: Column, seed: Column, edits: int) -> list[tuple[Column, bool, Column]]:
    """Keys of a string, each with whether it is entered (or looked up) and the rest of the string beside its part.

    Entered are the string's own segments; a key is null where the string is too short for it.
    """
    n = F.length(s)
    out = []
    for less in range(edits + 1):
        length = n - less
        for i, (start, size) in enumerate(_segments(length, edits)):
            lowest, highest = max(-i, less - (edits - i)), min(i, less + (edits - i))
            for shift in range(lowest, highest + 1):
                at = start + shift
                valid = (size > 0) & (at >= 0) & (at + size <= n)
                key = F.when(valid, F.xxhash64(seed, length, F.lit(i), F.substring(s, at + 1, size)))
                rest = F.concat(F.substring(s, F.lit(1), at), F.substring(s, at + size + 1, n))
                out.append((key, less == 0 and shift == 0, rest))
    return out


def _emitted(df: DataFrame, keep: list[str], s: str, seed: Column, edits: int, with_rest: bool) -> DataFrame:
    """The kept columns and ``key, own, more`` for each key of the string; ``more`` is the rest, or the key's place in the list.

    The keys are columns of a projection first: there the string's length and
    its parts are computed once, while a generator computes each anew.
    """
    entries = _entries(F.col(s), seed, edits)
    wide = df.select(*keep, *(k.alias(f"_k{j}") for j, (k, _, _) in enumerate(entries)), *((r.alias(f"_r{j}") for j, (_, _, r) in enumerate(entries)) if with_rest else ()))
    flat = [x for j, (_, own, _) in enumerate(entries) for x in (F.col(f"_k{j}"), F.lit(own), F.col(f"_r{j}") if with_rest else F.lit(j))]
    return wide.select(*keep, F.stack(F.lit(len(entries)), *flat).alias("key", "own", "more")).where("key is not null")


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings whose lengths differ by at most ``edits`` are within so many edits.

    Hyyro's banded form of the bit-parallel distance: a word of
    ``2 * edits + 2`` bits holds the vertical differences on the diagonals
    around the current one, whose value is followed down to the last row and
    then along it. ``a`` must be the longer, and longer than ``edits``.
    """
    bits = 2 * edits + 2
    full, top = (1 << bits) - 1, 1 << (bits - 1)
    long = lambda x: F.lit(x).cast("long")

    def run(x: Column) -> Column:
        first, second = x["a"], x["b"]
        n = F.size(first)

        def step(st: Column, i: Column) -> Column:
            ch = F.get(second, i)
            eq = long(0)
            for t in range(bits):
                at = i + (edits - t)
                eq = eq.bitwiseOR(F.when((at >= 0) & (F.get(first, at) == ch), long(1 << (bits - 1 - t))).otherwise(long(0)))

            def first_words(v: Column) -> Column:
                e, vp, vn = v["eq"], v["vp"], v["vn"]
                d0 = ((e.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(e).bitwiseOR(vn).bitwiseAND(long(full))
                return F.struct(d0.alias("d0"), vp.alias("vp"), vn.alias("vn"))

            def second_words(v: Column) -> Column:
                hp = v["vn"].bitwiseOR(long(full).bitwiseXOR(v["d0"].bitwiseOR(v["vp"])))
                return F.struct(v["d0"].alias("d0"), hp.alias("hp"), v["d0"].bitwiseAND(v["vp"]).alias("hn"), F.shiftright(v["d0"], 1).alias("x"))

            def third_words(v: Column) -> Column:
                down = i < n - edits
                bit = F.call_function("shiftright", long(top), F.greatest(i - (n - edits) + 1, F.lit(0)))
                change = F.when(down, (v["d0"].bitwiseAND(long(top)) == 0).cast("int")).otherwise(
                    (v["hp"].bitwiseAND(bit) != 0).cast("int") - (v["hn"].bitwiseAND(bit) != 0).cast("int")
                )
                vp = v["hn"].bitwiseOR(long(full).bitwiseXOR(v["x"].bitwiseOR(v["hp"])))
                return F.struct(vp.alias("vp"), v["x"].bitwiseAND(v["hp"]).alias("vn"), (st["d"] + change).alias("d"))

            words = let(F.struct(eq.alias("eq"), st["vp"].alias("vp"), st["vn"].alias("vn")), first_words)
            return let(let(words, second_words), third_words)

        start = F.struct(long(full - (1 << (bits - 1 - edits)) + 1).alias("vp"), long(0).alias("vn"), F.lit(edits).alias("d"))
        steps = F.when(F.size(second) > 0, F.sequence(F.lit(0), F.size(second) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, step, lambda st: st["d"] <= edits)

    return let(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b")), run)


def occurrences(docs: DataFrame, text: str, doc_id: str, min_chars: int) -> DataFrame:
    """The long lines: ``doc_id, text_hash, line_no, line, h, h2``."""
    t = F.col(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(t).alias("text_hash"), F.posexplode(F.split(t, "\n")).alias("line_no", "line"))
    return rows.where(F.length("line") >= min_chars).withColumns({"h": F.xxhash64("line"), "h2": F.hash("line")})


def _met(rows: DataFrame) -> DataFrame:
    """Pairs of distinct lines that share a key that one of them is entered under."""
    a = rows.where("entered").select("key", F.col("h").alias("u"))
    b = rows.select("key", F.col("h").alias("v"))
    return a.join(b, "key").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def near_lines(lines: DataFrame, edits: int) -> DataFrame:
    """Pairs ``u, v`` of line hashes whose lines differ and are within ``edits`` edits."""
    zero = F.lit(0).cast("long")
    emitted = _emitted(lines, ["h"], "line", zero, edits, False).select("h", "key", F.col("own").alias("entered"), F.col("more").alias("slot"))
    shared = emitted.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.bool_or("entered").alias("any")).where("lo <> hi and any")
    rows = emitted.join(sized(shared.select("key")), "key", "left_semi").dropDuplicates(["key", "entered", "h"])
    found = []
    for depth in count():
        rows = checkpointed(rows)
        crowd = rows.groupBy("key").agg(F.count_distinct("h").alias("n"), *([F.min(F.length("rest")).alias("least")] if depth else []))
        crowd = crowd.where(F.col("n") > (CROWD if depth < 3 else LARGE_CROWD))
        if depth:  # rests become shorter each time; those too short to be cut stay in the crowd they are in
            crowd = crowd.where(F.col("least") >= LEAST_PART * (edits + 1))
        crowd = sized(crowd.select("key"))
        found.append(_met(rows.join(crowd, "key", "left_anti")))
        if crowd.isEmpty():
            break
        deep = rows.join(crowd, "key", "left_semi")
        if depth == 0:
            own = sized(deep.select("h").distinct())
            texts = lines.join(own, "h", "left_semi").select("h", "line").dropDuplicates(["h"])
            rests = F.array(*(r for _, _, r in _entries(F.col("line"), zero, edits)))
            deep = deep.join(texts, "h").withColumn("rest", F.get(rests, F.col("slot")))
        deep = _emitted(deep.withColumnRenamed("key", "seed"), ["h", "entered"], "rest", F.col("seed"), edits, True)
        rows = deep.select("h", "key", (F.col("entered") & F.col("own")).alias("entered"), F.col("more").alias("rest")).dropDuplicates(["key", "entered", "h"])
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    pairs = checkpointed(pairs.distinct())
    wanted = sized(pairs.select(F.col("u").alias("h")).union(pairs.select("v")).distinct())
    texts = checkpointed(lines.join(wanted, "h", "left_semi").select("h", "line").dropDuplicates(["h"]))
    both = pairs.join(texts.select(F.col("h").alias("u"), F.col("line").alias("x")), "u").join(texts.select(F.col("h").alias("v"), F.col("line").alias("y")), "v")
    swap = F.length("x") >= F.length("y")
    both = both.select("u", "v", F.when(swap, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(swap, F.col("y")).otherwise(F.col("x")).alias("b"))
    differ = lambda x, y: F.size(F.array_except(F.split(x, " "), F.split(y, " "))) <= 2 * edits  # noqa: E731  an edit changes two words at most
    close = (F.length("a") - F.length("b") <= edits) & differ("a", "b") & differ("b", "a")
    return both.where(F.when(close, within(F.col("a"), F.col("b"), edits)).otherwise(F.lit(False))).select("u", "v")


def repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, text_hash, gone``: for each document that loses lines, their numbers from 0."""
    lines = occurrences(docs, text, doc_id, min_chars)
    place = F.struct("doc_id", "text_hash", "line_no")
    last = F.struct(*(F.col(c) for c in ("doc_id", "text_hash", "line_no")))
    firsts = lines.groupBy("h", "h2").agg(F.min(place).alias("first"), (F.max(last) != F.min(place)).alias("again"))
    near = checkpointed(near_lines(lines, edits))
    ends = sized(near.select(F.col("u").alias("h")).union(near.select("v")).distinct())
    at = checkpointed(firsts.join(ends, "h", "left_semi").select("h", "first").groupBy("h").agg(F.min("first").alias("first")))
    both = near.join(at.select(F.col("h").alias("u"), F.col("first").alias("p")), "u").join(at.select(F.col("h").alias("v"), F.col("first").alias("q")), "v")
    later = sized(both.select(F.when(F.col("p") < F.col("q"), F.col("v")).otherwise(F.col("u")).alias("h")).distinct().withColumn("near", F.lit(True)))
    struck = firsts.join(later, "h", "left").where(F.col("again") | F.col("near"))
    struck = sized(struck.select("h", "h2", F.when(F.col("near"), F.lit(None)).otherwise(F.col("first")).alias("stays")))
    gone = lines.select("doc_id", "text_hash", "line_no", "h", "h2").join(struck, ["h", "h2"]).where(~place.eqNullSafe(F.col("stays")))
    return gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("gone"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, text: str = "text", doc_id: str = "doc_id", least_words: int = 0) -> DataFrame:
    """The rows with the repeated lines taken out of the text, and ``lines_gone``, their number.

    A document that has lost lines and is left with fewer than ``least_words``
    words goes.
    """
    gone = sized(repeated_lines(docs, edits, min_chars, text, doc_id).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash", "gone": "_gone"}), F.size("_gone"))
    rows = docs.join(gone, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash")), "left")
    numbers = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("_gone"))
    left = let(F.split(text, "\n"), lambda x: F.array_join(F.transform(numbers(x), lambda i: F.get(x, i)), "\n"))
    out = rows.withColumns({text: F.when(F.col("_gone").isNull(), F.col(text)).otherwise(left), "lines_gone": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")})
    if least_words:
        out = out.where((F.col("lines_gone") == 0) | (F.size(words(F.col(text))) >= least_words))
    return out.select(*[c for c in docs.columns if c != "lines_gone"], "lines_gone")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = dedup_lines(docs)
    n_lines = F.size(F.split(whole(F.col("text")), "\n")).cast("long")
    return left.select("doc_id", "lines_gone", n_lines.alias("n_lines"), F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
