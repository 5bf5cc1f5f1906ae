"""N-gram Jaccard join by MinHash banding, with pairs verified on full n-gram sets.

Documents with equal sets of word n-grams form one class from the start. The
MinHash values of each class are cut into bands; classes that agree on a whole
band meet in its bucket. Each bucket picks as leader the member that meets
most others, and every member is verified against it; in buckets that verified
links leave in several components, the members outside the leader's component
are verified against all others, in blocks. So a bucket of thousands of near
copies costs about a pair for each member, every linked pair of a bucket ends
in one component, and only pairs that reach the threshold link. Links are
counted afterwards: all pairs of a component are compared, in blocks that pass
on a number for each member and no pairs.

Defined cases: a null text is the empty text; texts without a word form one
class; a text of fewer words than n has one n-gram, all its words; nulls and
repeats among ids are harmless, since classes are named by their n-gram sets;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from wayline.llm.common import checkpointed, sized, small_batches, table, whole
from wayline.llm.graph import components

N = 5
THRESHOLD = 0.8
RECALL = 0.999
#: MinHash values a document may have.
MOST_HASHES = 160
#: Members of one side of a block in which all pairs are compared, and their n-grams, as expected by the hash that deals them out.
BLOCK, BLOCK_GRAMS = 1024, 1_000_000
_KEPT = 300_000
_WORDS: dict[bytes, int] = {}


def choose_bands(threshold: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """Bands and rows: the most rows for which few enough bands find a pair at the threshold with the given recall."""
    for rows in range(32, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("too few hashes for this threshold and recall")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit n-gram hashes of each text, ascending, one after the other, and where each text's begin (and the end)."""
    split = [t.encode().split() for t in texts]
    if len(_WORDS) > _KEPT:
        _WORDS.clear()
    known = _WORDS
    for ws in split:
        for w in set(ws).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
    count = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    flat = np.fromiter((known[w] for ws in split for w in ws), dtype=np.uint64, count=int(count.sum()))
    flat = np.concatenate([flat, np.zeros(n, dtype=np.uint64)])
    begin = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(split)), grams)
    first = np.cumsum(grams) - grams
    at = np.arange(len(doc)) - first[doc] + begin[doc]
    h = np.zeros(len(doc), dtype=np.uint64)
    width = np.minimum(count, n)[doc]
    for k in range(n):
        h = _mixed(h + np.where(k < width, flat[at + k], np.uint64(0)) + np.uint64(k + 1))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(split) + 1))


def set_keys(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set of hashes."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(h + np.uint64(0x9E3779B97F4A7C15)))])
    size = np.diff(ends).astype(np.uint64)
    return _mixed((sums[ends[1:]] - sums[ends[:-1]]) + size * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def band_keys(h: np.ndarray, ends: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit name of each band's MinHash values, a row for each set; zeros for an empty set."""
    rng = np.random.default_rng(20240229)
    factor = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    full = np.flatnonzero(np.diff(ends) > 0)
    out = np.zeros((len(ends) - 1, bands), dtype=np.uint64)
    if not len(full):
        return out.view(np.int64)
    starts = ends[full]
    for b in range(bands):
        name = np.full(len(full), b + 1, dtype=np.uint64)
        for j in range(b * rows, b * rows + rows):
            low = np.minimum.reduceat((h * factor[j] + shift[j]) >> np.uint64(32), starts)
            name = _mixed(name * np.uint64(0x9E3779B97F4A7C15) + low)
        out[full, b] = name
    return out.view(np.int64)


def _slices(texts: pd.Series, most: int = 3_000_000) -> Iterator[list[str]]:
    part, total = [], 0
    for t in texts:
        if part and total + len(t) > most:
            yield part
            part, total = [], 0
        part.append(t)
        total += len(t)
    if part:
        yield part


def signatures(text, n: int, bands: int, rows: int):
    """Struct of the class key, the number of distinct n-grams and the band keys."""

    @pandas_udf("struct<k:long,n:int,bands:array<long>>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = []
            for part in _slices(texts):
                h, ends = gram_sets(part, n)
                keys = band_keys(h, ends, bands, rows)
                parts.append(pd.DataFrame({"k": set_keys(h, ends), "n": np.diff(ends).astype(np.int32), "bands": list(keys)}))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"k": [], "n": [], "bands": []})

    return sign(whole(text))


def gram_arrays(text, n: int):
    """Struct of the class key and the sorted distinct n-gram hashes."""

    @pandas_udf("struct<k:long,grams:array<long>>")
    def grams(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = []
            for part in _slices(texts):
                h, ends = gram_sets(part, n)
                parts.append(pd.DataFrame({"k": set_keys(h, ends), "grams": np.split(h.view(np.int64), ends[1:-1])}))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"k": [], "grams": []})

    return grams(whole(text))


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``u, v`` whose sets reach the threshold."""
    a = sets.select(F.col("k").alias("u"), F.col("grams").alias("a"))
    b = sets.select(F.col("k").alias("v"), F.col("grams").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "u").join(b, "v").where(both >= (F.size("a") + F.size("b") - both) * threshold).select("u", "v")


def _overlaps(left: pd.Series, right: pd.Series, threshold: float) -> np.ndarray:
    """Whether each set of the left and each of the right reach the threshold."""
    flat = [np.asarray(g) for g in [*left, *right]]
    size = np.array([len(g) for g in flat])
    names, at = np.unique(np.concatenate(flat), return_inverse=True)
    owner = np.repeat(np.arange(len(flat)), size)
    often = np.bincount(at, minlength=len(names)) > 1
    place = np.cumsum(often) - 1
    keep = often[at]
    owner, at = owner[keep], place[at[keep]]
    shared, width, m = np.zeros((len(left), len(right)), dtype=np.float32), int(often.sum()), len(left)
    for lo in range(0, width, 4096):
        part = (at >= lo) & (at < lo + 4096)
        x = np.zeros((len(flat), min(4096, width - lo)), dtype=np.float32)
        x[owner[part], at[part] - lo] = 1
        shared += x[:m] @ x[m:].T
    return shared >= threshold * (size[:m, None] + size[None, m:] - shared) - 1e-4


def _compare(threshold: float):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        """Links between components, as many as join them, from pairs of the two sides of a block."""
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if left.empty or right.empty:
            return pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64")})
        linked = _overlaps(left["grams"], right["grams"], threshold)
        lk, rk, lc, rc = (s.to_numpy() for s in (left["k"], right["k"], left["c"], right["c"]))
        linked &= lc[:, None] != rc[None, :]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        out = []
        for i, j in zip(*np.nonzero(linked), strict=True):
            a, b = find(int(lc[i])), find(int(rc[j]))
            if a != b:
                root[a] = b
                out.append((lk[i], rk[j]))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return compare


def _counted(threshold: float):
    def count(rows: pd.DataFrame) -> pd.DataFrame:
        """For each member of a block, how many documents its links across the block lead to."""
        left = rows[rows["side"] == 0]
        if (rows["i"] == rows["j"]).all():
            linked = _overlaps(left["grams"], left["grams"], threshold)
            np.fill_diagonal(linked, False)
            return pd.DataFrame({"k": left["k"], "links": linked @ left["copies"].to_numpy()})
        right = rows[rows["side"] == 1]
        if left.empty or right.empty:
            return pd.DataFrame({"k": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64")})
        linked = _overlaps(left["grams"], right["grams"], threshold)
        there, back = linked @ right["copies"].to_numpy(), left["copies"].to_numpy() @ linked
        return pd.DataFrame({"k": [*left["k"], *right["k"]], "links": [*there, *back]})

    return count


def _blocks(members: str, grams: str) -> Column:
    """Blocks that so many members with so many n-grams are dealt out to."""
    return F.greatest(F.ceil(F.col(members) / BLOCK), F.ceil(F.col(grams) / BLOCK_GRAMS), F.lit(1)).cast("long")


def _dealt(blocks: str) -> Column:
    return F.pmod(F.xxhash64("k"), F.col(blocks)).cast("long")


def _numbers(blocks: str) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)


def link_counts(classes: DataFrame, named: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``k, links``: for each class of ``k, copies, n`` in a component of ``k, c``, the documents of other classes that reach the threshold with it."""
    own = checkpointed(named.join(classes, "k"))
    large = own.groupBy("c").agg(F.count("*").alias("m"), F.sum("n").alias("g")).where((F.col("m") > BLOCK) | (F.col("g") > BLOCK_GRAMS))
    dealt = own.join(sized(large.select("c", _blocks("m", "g").alias("blocks"))), "c", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    dealt = dealt.select("k", "c", "copies", _dealt("blocks").alias("own"), F.explode(_numbers("blocks")).alias("other"))
    i, j = F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    rows = dealt.select("k", "c", "copies", i, j, (F.col("own") > F.col("other")).cast("int").alias("side")).join(sets, "k")
    counted = rows.groupBy("c", "i", "j").applyInPandas(_counted(threshold), "k long, links long")
    return counted.groupBy("k").agg(F.sum("links").alias("links"))


def _joined(named: DataFrame, links: DataFrame) -> DataFrame:
    """``k, c``: the components after more links, which name classes."""
    links = checkpointed(links.distinct())
    if links.isEmpty():
        return named
    nodes = named.union(links.select(F.explode(F.array("u", "v")).alias("k")).distinct().join(named, "k", "left_anti").select("k", F.col("k").alias("c")))
    of = lambda end: nodes.select(F.col("k").alias(end), F.col("c").alias(f"{end}c"))
    tops = components(links.join(of("u"), "u").join(of("v"), "v").select(F.col("uc").alias("u"), F.col("vc").alias("v")))
    return checkpointed(nodes.join(tops.withColumnRenamed("node", "c"), "c", "left").select("k", F.coalesce("component", "c").alias("c")))


def ngram_links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as ``doc_id, text_hash, k, n`` (their class), ``k, c`` of all linked classes (their component), and ``k, grams`` of all classes that met another."""
    small_batches(docs.sparkSession)
    bands, rows = choose_bands(threshold, recall, MOST_HASHES)
    read = docs.select(F.col(doc_id).alias("doc_id"), whole(F.col(text)).alias("text"))
    signed = read.withColumn("s", signatures(F.col("text"), n, bands, rows))
    signed = checkpointed(signed.select("doc_id", F.xxhash64("text").alias("text_hash"), "s.*"))
    classes = signed.where("n > 0").groupBy("k").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    spread = classes.select("k", "n", "first_id", F.explode("bands").alias("band"))
    met = sized(spread.groupBy("band").agg(F.count("*").alias("met")).where("met > 1"))
    members = checkpointed(spread.join(met, "band"))

    central = members.groupBy("k").agg(F.sum("met").alias("central"))
    led = members.join(central, "k").groupBy("band").agg(F.max(F.struct("central", "k", "n")).alias("l"))
    led = sized(led.select("band", F.col("l.k").alias("leader"), F.col("l.n").alias("leader_n")))  # a table of its own, so that a crowded band's join can be split
    members = checkpointed(members.join(led, "band"))
    like = F.least("n", "leader_n") >= F.greatest("n", "leader_n") * (threshold - 1e-9)
    pairs = members.where((F.col("k") != F.col("leader")) & like).select(F.col("k").alias("u"), F.col("leader").alias("v")).distinct()

    wanted = members.select("first_id").distinct()
    found = read.join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    sets = checkpointed(found.select(gram_arrays(F.col("text"), n).alias("g")).select("g.*").dropDuplicates(["k"]))
    named = checkpointed(components(verified(pairs, sets, threshold)).select(F.col("node").alias("k"), F.col("component").alias("c")))

    placed = members.where("met > 2").select("band", "k", "n", "leader", "met").join(named, "k", "left").withColumn("c", F.coalesce("c", "k"))
    heads = placed.where("k = leader").select("band", F.col("c").alias("leader_c"))
    placed = checkpointed(placed.join(sized(heads), "band"))
    apart = F.col("c") != F.col("leader_c")
    sizes = placed.groupBy("band").agg(F.count_if(apart).alias("lm"), F.sum(F.when(apart, F.col("n"))).alias("lg"), F.count("*").alias("rm"), F.sum("n").alias("rg"))
    sizes = sized(sizes.where("lm > 0").select("band", _blocks("lm", "lg").alias("lb"), _blocks("rm", "rg").alias("rb")))
    placed = placed.where("k <> leader").join(sizes, "band")
    right = F.transform(_numbers("lb"), lambda i: F.struct(F.lit(1).alias("side"), i.alias("i"), _dealt("rb").alias("j")))
    left = F.transform(_numbers("rb"), lambda j: F.struct(F.lit(0).alias("side"), _dealt("lb").alias("i"), j.alias("j")))
    sides = F.when(apart, F.concat(right, left)).otherwise(right)
    blocks = placed.select("band", "k", "c", F.inline(sides)).join(sets, "k")
    more = blocks.groupBy("band", "i", "j").applyInPandas(_compare(threshold), "u long, v long")
    return signed.select("doc_id", "text_hash", "k", "n"), _joined(named, more), sets


def _classes(signed: DataFrame, named: DataFrame) -> DataFrame:
    """``k, n, copies, class_id, first_hash``: its documents, and the first document of all that links connect with it."""
    sizes = signed.groupBy("k").agg(F.first("n").alias("n"), F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_hash")).alias("first"))
    sizes = sizes.join(named, "k", "left").withColumn("c", F.coalesce("c", "k"))
    firsts = sizes.groupBy("c").agg(F.min("first").alias("head"))
    return sizes.join(firsts, "c").select("k", "n", "copies", F.col("head.doc_id").alias("class_id"), F.col("head.text_hash").alias("first_hash"))


def ngram_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each document: ``doc_id, text_hash, class_id, n_links``, and ``first_hash`` of the class's first document.

    ``class_id`` is the least id of the documents that verified links and equal
    n-gram sets connect; ``n_links`` counts the other documents of equal n-gram
    set and all those of the class whose n-gram sets reach the threshold.
    """
    signed, named, sets = ngram_links(docs, n, threshold, recall, text, doc_id)
    by_class = checkpointed(_classes(signed, named))
    degree = link_counts(by_class.select("k", "n", "copies"), named, sets, threshold)
    by_class = by_class.drop("n").join(degree, "k", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    return signed.join(by_class, "k").select("doc_id", "text_hash", "class_id", "first_hash", "n_links")


def drop_near_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each class, the one of least id, with the columns it came with."""
    signed, named, _ = ngram_links(docs, n, threshold, recall, text, doc_id)
    heads = _classes(signed, named).select(F.col("class_id").alias("_id"), F.col("first_hash").alias("_hash")).distinct()
    rows = docs.withColumn("_own", F.xxhash64(whole(F.col(text))))
    kept = rows.join(heads, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left_semi")
    return kept.dropDuplicates([doc_id, "_own"]).select(*docs.columns)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join(docs).select("doc_id", "class_id", "n_links")
