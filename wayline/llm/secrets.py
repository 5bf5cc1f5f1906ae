"""Secret scans: fixed patterns, and a battery of randomness tests, in DataFrame functions only.

Fixed patterns find assignments, access keys and long hexadecimal runs. Beside
them every unbroken run of at least ``SHORTEST`` key characters is a candidate,
and so is every part of one between its separators that is as long. Its
encoding is inferred as the smallest known alphabet that holds it, and a
battery asks how far it is from a random draw of that alphabet: a chi-squared
test of uniform use, a test of the share of marked characters (vowels; of
hexadecimal digits the upper half), a runs test of marked and other characters
(in words they alternate), a test of serial correlation and, in alphabets of
both cases, a test of the share of capitals (identifiers have few). The tests'
normal deviates are summed, so that short strings are told by all tests
together.

What the sum is for ordinary text is learned from the corpus, and from strings
of some common words that are the same for every table, so that a table of keys
alone has something to be held against. Every document gives one string of each
length class, cut from its shorter words at a place drawn by a hash, written as
one word, with capitals or with hyphens. Candidates are grouped by encoding and
length; the share of such strings at or below a candidate's sum is the chance
that ordinary text looks as random, and within a group the Benjamini-Hochberg
rule bounds the share of ordinary text among the candidates that are reported by
``FALSE_RATE``. A group with fewer than ``ENOUGH`` such strings of its own is
held against those of all encodings.

Histograms of bounded size over the whole corpus hold both, so the second pass
needs only a threshold for each group.

Limits: of random strings of 20 letters of one case about nine in ten can be
told from words, of 24 and more or of other alphabets nearly all. Digits alone
are numbers and never reported. Keys that are written in one case with
separators, such as universally unique identifiers, pass for identifiers and are
not reported, unless a part between separators is long enough to be judged by
itself.

Defined cases: a null text is empty and holds nothing; rows are judged each on
their own, so repeats give equal results; the texts are scanned whole; places
are counted in code points, ends exclusive; an empty table gives an empty
result; columns of the caller with the names of added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import let, table, whole

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
LONG_HEX = r"[0-9a-f]{32,}"  # the same as longer runs among all leftmost runs
SHORTEST = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
PART = r"[A-Za-z0-9]{20,}"
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_REST = _DIGITS + "+/-_"
VOWELS = "AEIOUaeiou"
#: Name, alphabet in order of value, and the characters that are marked.
ALPHABETS = (
    ("digits", _DIGITS, "56789"),
    ("hex", _DIGITS + "abcdef", "89abcdef"),
    ("hex_upper", _DIGITS + "ABCDEF", "89ABCDEF"),
    ("lower", _LOWER, VOWELS),
    ("upper", _UPPER, VOWELS),
    ("base32", _UPPER + "234567", VOWELS),
    ("lower36", _LOWER + _DIGITS, VOWELS),
    ("upper36", _UPPER + _DIGITS, VOWELS),
    ("letters", _UPPER + _LOWER, VOWELS),
    ("base62", _UPPER + _LOWER + _DIGITS, VOWELS),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/", VOWELS),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_", VOWELS),
)
# Common words, for the strings that every table is held against.
COMMON = (
    "the of and to in is you that it he was for on are as with his they at be this have from or one had by word but not what all were we when your can said there use an each which she do how their if will up other "
    "about out many then them these so some her would make like him into time has look two more write go see number no way could people my than first water been call who oil its now find long down day did get come made may part "
    "value name index table user count list error state order node data file path key test item event config version total request response default"
).split()
#: Strings of each length class made of them.
COMMON_STRINGS = 4_000
#: Share of ordinary text among what is reported, at most.
FALSE_RATE = 0.05
#: Sums above this are never reported, whatever the corpus: of random strings fewer than one in a hundred have one.
MOST_SUM = 6.0
#: Strings of ordinary text that a group needs to be judged by its own.
ENOUGH = 200
#: Least length of each class of lengths.
LENGTHS = (20, 23, 27, 32, 46, 64)
BINS_A_UNIT, LEAST_BIN, MOST_BIN = 4, -40, 120

SPAN = "array<struct<s:int,k:int,e:int,m:string>>"


def matches(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches with their places, from the pieces between them."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def placed(x: Column) -> Column:
        def add(st: Column, i: Column) -> Column:
            begin = st["at"] + F.length(F.get(x["p"], i))
            end = begin + F.length(F.get(x["m"], i))
            here = F.struct(begin.alias("s"), F.lit(kind).alias("k"), end.alias("e"), F.get(x["m"], i).alias("m"))
            return F.struct(end.alias("at"), F.array_append(st["out"], here).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(x["m"]) - 1), start, add, lambda st: st["out"])

    return F.when(text.rlike(pattern), let(found, placed)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start, then kind."""
    groups = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = F.when(
        text.rlike(ASSIGN),
        let(F.struct(matches(text, ASSIGN, 0).alias("m"), groups.alias("g")), lambda x: F.filter(x["m"], lambda _, i: F.length(F.get(x["g"], i)) >= 8)),
    ).otherwise(F.array().cast(SPAN))
    access = F.filter(matches(text, ACCESS, 1), lambda x: x["e"] - x["s"] >= 16)
    return F.array_sort(F.concat(assign, access, matches(text, LONG_HEX, 2)))


def _of(values: list, i: Column) -> Column:
    return F.get(F.array(*(F.lit(x) for x in values)), i)


def encoding(token: Column) -> Column:
    """Index of the smallest alphabet that holds the token, null if none does."""
    enc = F.lit(None).cast("int")
    for i, (_, letters, _) in reversed([*enumerate(ALPHABETS)]):
        enc = F.when(F.translate(token, letters, "") == "", F.lit(i)).otherwise(enc)
    return enc


def distance(token: Column, enc: Column) -> Column:
    """Sum of the battery's deviates: about zero for a random draw of the alphabet, above for structured text. The token has two characters at least."""
    marked = [sum(c in m for c in a) / len(a) for _, a, m in ALPHABETS]
    even = [m != VOWELS for _, _, m in ALPHABETS]  # halves of digits: fewer marked ones are as odd as more

    def tests(x: Column) -> Column:
        k, share = x["k"].cast("double"), x["share"]
        chars = F.split(x["t"], "")
        n = F.length(x["t"]).cast("double")

        def told(y: Column) -> Column:
            v, m = y["v"], y["m"]
            counts = F.transform(F.array_distinct(v), lambda c: F.size(F.filter(v, lambda o: o == c)).cast("double"))
            chi = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c) * k / n - n
            df = k - 1
            third = F.cbrt(F.greatest(chi, F.lit(0.0)) / df)
            z_chi = (third - (F.lit(1.0) - F.lit(2.0) / (df * 9))) / F.sqrt(F.lit(2.0) / (df * 9))
            z_chi = F.when(z_chi < -2.5, -z_chi).otherwise(z_chi)  # more even than chance: an alphabet in order, a cycle
            apart = share * (F.lit(1.0) - share)
            ones = F.aggregate(m, F.lit(0), lambda s, o: s + o).cast("double")
            z_share = (ones - n * share) / F.sqrt(n * apart)
            steps = F.sequence(F.lit(1), F.size(v) - 1)
            changes = F.aggregate(steps, F.lit(0), lambda s, i: s + (F.get(m, i) != F.get(m, i - 1)).cast("int")).cast("double")
            change = apart * 2
            spread = (n - 1) * change * (F.lit(1.0) - change) + (n - 2) * 2 * (apart - change * change)
            z_runs = (changes - (n - 1) * change) / F.sqrt(F.greatest(spread, F.lit(0.1)))
            mean = F.aggregate(v, F.lit(0.0), lambda s, o: s + o) / n

            def alike(mean: Column) -> Column:
                wide = F.aggregate(v, F.lit(0.0), lambda s, o: s + (o - mean) * (o - mean))
                lag = F.aggregate(steps, F.lit(0.0), lambda s, i: s + (F.get(v, i) - mean) * (F.get(v, i - 1) - mean))
                return let(F.struct(wide.alias("wide"), lag.alias("lag")), lambda w: F.when(w["wide"] > 0, w["lag"] / w["wide"] + F.lit(1.0) / n).otherwise(1.0))

            r = let(mean, alike)  # once, not in every step
            square = lambda z: (z * z - 1) / 1.4142135623730951  # noqa: E731  also of mean 0 and deviation 1 for a random draw
            capitals, small = (F.length(F.translate(x["t"], others, "")).cast("double") for others in (_LOWER + _REST, _UPPER + _REST))
            letters = capitals + small
            z_case = F.when(x["cased"] & (letters > 0), square((capitals - small) / F.sqrt(letters))).otherwise(0.0)
            sided = F.when(x["even"], square(z_share) + square(z_runs)).otherwise(z_share + z_runs)
            return z_chi + sided + square(r * F.sqrt(n)) / 2 + z_case

        values = F.transform(chars, lambda c: (F.position(c, x["letters"]) - 1).cast("double"))
        marks = F.transform(chars, lambda c: (F.position(c, x["marked"]) > 0).cast("int"))
        return let(F.struct(values.alias("v"), marks.alias("m")), told)

    given = F.struct(
        token.alias("t"), _of([a for _, a, _ in ALPHABETS], enc).alias("letters"), _of([m for _, _, m in ALPHABETS], enc).alias("marked"),
        _of([_UPPER + _LOWER in a for _, a, _ in ALPHABETS], enc).alias("cased"), _of([len(a) for _, a, _ in ALPHABETS], enc).alias("k"), _of(marked, enc).alias("share"), _of(even, enc).alias("even"),
    )
    return let(given, tests)


def _class(n: Column) -> Column:
    """Class of a length, from 0."""
    return sum(((n >= least).cast("int") for least in LENGTHS[1:]), F.lit(0))


def _judged(token: Column) -> Column:
    """``grp`` (encoding and length class) and ``d`` of a token; null if it fits no alphabet or has digits only."""

    def scored(y: Column) -> Column:
        return F.when(y["enc"] > 0, F.struct((y["enc"] * len(LENGTHS) + _class(F.length(y["t"]))).alias("grp"), distance(y["t"], y["enc"]).alias("d")))

    return let(F.struct(encoding(token).alias("enc"), token.alias("t")), scored)


def candidates(text: Column, base: Column) -> Column:
    """Spans that overlap no base span: ``s, k, e, whole``, and ``grp, d`` (null: not judged). Parts come after the runs they are in."""

    def judged(x: Column, whole_run: bool) -> Column:
        token = F.rtrim(x["m"], F.lit("=")) if whole_run else x["m"]
        told = lambda j: F.struct(x["s"].alias("s"), F.lit(3).alias("k"), x["e"].alias("e"), F.lit(whole_run).alias("whole"), j["grp"].alias("grp"), j["d"].alias("d"))
        return let(_judged(token), told)

    def free(pattern: str) -> Column:
        return F.filter(matches(text, pattern, 3), lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))

    both = F.struct(free(CANDIDATE).alias("runs"), free(PART).alias("parts"))
    parts = lambda x: F.filter(x["parts"], lambda q: ~F.exists(x["runs"], lambda r: (r["s"] == q["s"]) & (r["e"] == q["e"])))
    found = let(both, lambda x: F.concat(F.transform(x["runs"], lambda r: judged(r, True)), F.transform(parts(x), lambda q: judged(q, False))))
    return F.when(text.rlike(CANDIDATE), found).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,whole:boolean,grp:int,d:double>>"))


def _cut(x: Column) -> Column:
    """``grp, d`` of a string of each class of lengths, cut from a longer one at a place drawn by its hash."""
    at = lambda n: F.pmod(F.xxhash64(x, F.lit(n)), F.length(x) - (n - 1)).cast("int") + 1
    each = F.array(*(F.when(F.length(x) >= n, F.substring(x, at(n), F.lit(n))) for n in LENGTHS))
    return F.filter(F.transform(F.filter(each, lambda t: t.isNotNull()), _judged), lambda j: j.isNotNull())


def common_strings(spark: SparkSession) -> DataFrame:
    """``grp, d`` of strings of common words, in six ways of writing them; the same for every table."""
    known = F.array(*(F.lit(w) for w in COMMON))
    pick = lambda i: F.get(known, F.pmod(F.xxhash64("id", i), F.lit(len(COMMON))).cast("int"))
    own = F.transform(F.sequence(F.lit(0), F.lit(29)), pick)
    number = F.pmod(F.xxhash64("id"), F.lit(1000)).cast("string")
    capital = F.transform(own, F.initcap)
    ways = [F.array_join(own, ""), F.array_join(capital, ""), F.array_join(own, "-"), F.concat(F.array_join(own, "_"), F.lit("_"), number), F.array_join(own, "/"), F.concat(F.array_join(F.slice(own, 1, 1), ""), F.array_join(F.slice(capital, 2, 29), ""), number)]
    way = F.pmod("id", F.lit(len(ways)))
    written = F.array(*ways)[way.cast("int")]
    return spark.range(COMMON_STRINGS).select(F.inline(let(written, _cut)))


def ordinary(text: Column) -> Column:
    """Of the text's own words a string of each class of lengths, as ``grp, d``: what structure looks like here."""
    way = F.pmod(F.xxhash64(text), F.lit(3))
    text = F.when(text.rlike(CANDIDATE), F.regexp_replace(text, CANDIDATE, " ")).otherwise(text)  # what may be a key is no ordinary text
    joined = F.when(way == 0, F.lower(F.regexp_replace(text, "[^A-Za-z]+", ""))).when(way == 1, F.regexp_replace(F.initcap(text), "[^A-Za-z0-9]+", "")).otherwise(F.regexp_replace(text, "[^A-Za-z0-9]+", "-"))

    return let(joined, _cut)


def thresholds(scanned: DataFrame, text: Column, false_rate: float = FALSE_RATE) -> list[float]:
    """For each group the sum up to which its candidates are reported."""
    flagged = F.transform(ordinary(text), lambda j: F.struct(j["grp"].alias("grp"), j["d"].alias("d"), F.lit(True).alias("plain")))
    found = F.transform(F.filter("_cand", lambda c: c["d"].isNotNull()), lambda c: F.struct(c["grp"].alias("grp"), c["d"].alias("d"), F.lit(False).alias("plain")))
    each = scanned.select(F.inline(F.concat(flagged, found))).union(common_strings(scanned.sparkSession).select("grp", "d", F.lit(True)))
    bins = F.least(F.greatest(F.ceil(F.col("d") * BINS_A_UNIT), F.lit(LEAST_BIN)), F.lit(MOST_BIN)).cast("int")  # d is at most bin / BINS_A_UNIT
    groups, classes = len(ALPHABETS) * len(LENGTHS), len(LENGTHS)
    width = MOST_BIN - LEAST_BIN + 1
    plain, there = [[0] * width for _ in range(groups)], [[0] * width for _ in range(groups)]
    for row in each.groupBy("grp", "plain", bins.alias("bin")).count().collect():  # a few thousand rows at most
        (plain if row["plain"] else there)[row["grp"]][row["bin"] - LEAST_BIN] = row["count"]
    out = []
    for g in range(groups):
        own = plain[g]
        if sum(own) < ENOUGH:
            own = [sum(plain[h][b] for h in range(g % classes, groups, classes)) for b in range(width)]
        total, seen, false, limit = sum(there[g]), 0, 0, float("-inf")
        for b in range(width):
            seen, false = seen + there[g][b], false + own[b]
            upper = (b + LEAST_BIN) / BINS_A_UNIT
            if seen and upper <= MOST_SUM and (1 + false) / (1 + sum(own)) * total <= false_rate * seen:
                limit = upper
        out.append(limit)
    return out


def find_secrets(docs: DataFrame, text: str = "text", false_rate: float = FALSE_RATE) -> DataFrame:
    """The rows with ``base`` and ``random``: arrays of spans with ``s``, ``k`` (an index of KINDS) and ``e``."""
    t = whole(F.col(text))
    scanned = docs.withColumn("_base", base_spans(t)).withColumn("_cand", candidates(t, F.col("_base")))
    limit = F.array(*(F.lit(x) for x in thresholds(scanned, t, false_rate)))
    bare = lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))

    def reported(found: Column) -> Column:
        inside = lambda x: F.exists(found, lambda r: r["whole"] & (r["s"] <= x["s"]) & (x["e"] <= r["e"]))
        return F.transform(F.filter(found, lambda x: x["whole"] | ~inside(x)), bare)

    passed = F.filter("_cand", lambda x: x["d"] <= F.get(limit, x["grp"]))
    return scanned.withColumns({"base": F.transform("_base", bare), "random": let(passed, reported)}).drop("_base", "_cand")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans by start, then kind, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.concat("base", "random")).alias("spans"),
    )
