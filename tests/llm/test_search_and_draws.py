"""Hard negatives, license scans and importance resampling against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from wayline.llm import fingerprints, licenses, negatives, resampling
from wayline.llm.asciiwords import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha Beta gamma software license of the and copy É漢字 x2 conditions".split()) for _ in range(n))


def edge_rows():
    texts = [None, "", " \t\n", "one", prose(0, 9_000), prose(1, 60), prose(1, 60), prose(2, 60) + " extra", "É ü 漢字 😀 " * 30, "x" * 50_000, "\x00a\x7fb", "Under the MIT, License! cc-by-nc"]
    rows = [(i, t, "en" if i % 2 else None, "a" if i % 3 else None, None) for i, t in enumerate(texts)]
    return [*rows, (None, prose(3, 50), "de", "b", 3), (5, prose(1, 60), "en", "a", 1), (5, prose(1, 60), "en", "a", 1), (12, prose(2, 60), None, None, 0), (-4, prose(3, 50), "de", "b", 3)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    return df.withColumns({c: F.lit("own") for c in ("score", "weight", "rank", "digest", "copies", "n_words", "labels", "matches", "word", "n", "_digest", "_drawable", "bucket", "packed", "_key")})


def test_words_are_those_of_the_pattern():
    for text in ["", "A b-C_d", prose(4, 50), "\x00a\x7fb\x80é É0 9/:@z[`{|", "漢字 Σ ß"]:
        assert [w.decode() for w in words(text.encode())] == plain_words(text)


# importance resampling


def plain_resampling(docs, target, percent=25, least=20):
    def features(text):
        ws = plain_words(text)
        return len(ws), [zlib.crc32(f.encode()) % 10_000 for f in [*ws, *map(" ".join, zip(ws, ws[1:]))]]

    own, s, t = [features(x) for _, x in docs], Counter(), Counter()
    for _, f in own:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in s}
    rows = []
    for (i, _), (n, f) in zip(docs, own):
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    can = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = percent * len(can) // 100
    return sorted(((*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(can)), key=str) + sorted(((*r[:4], None) for r in rows if not r[4]), key=str)


def test_importance_against_brute_force(edge):
    docs, target = [r[:2] for r in edge_rows()], ["gamma software the", "gamma software conditions É漢字", None, ""]
    frame = edge.sparkSession.createDataFrame([(x,) for x in target], "text string")
    for percent in (25, 60, 100, 0):
        got = [tuple(r) for r in resampling.importance(edge, frame, percent).collect()]
        assert sorted(got, key=str) == sorted(plain_resampling(docs, target, percent), key=str)


def test_resampled_rows_are_the_ranked_ones(edge, empty):
    target = edge.select("text").where("doc_id = 7")
    rows = resampling.resample(clashing(edge), target, 50)
    ranked = resampling.importance(edge, target, 50).where("rank is not null")
    got = Counter(tuple(r) for r in rows.select("doc_id", "weight", "score").collect())
    assert got == Counter(tuple(r) for r in ranked.select("doc_id", "weight", "score").collect())
    assert {"text", "lang", "source", "n_chars", "copies"} <= set(rows.columns)
    assert resampling.resample(edge, target, 0).count() == 0
    assert resampling.importance(empty, target).count() == resampling.resample(empty, empty.select("text")).count() == 0
    assert resampling.importance(edge, empty.select("text")).count() == edge.count()


def test_copies_count_as_often_as_they_occur(spark):
    many = spark.range(3_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(prose(8, 40))).otherwise(F.concat(F.lit("w "), F.col("id"))).alias("text"))
    counts = {r["bucket"]: r["n"] for r in resampling.bucket_counts(resampling.text_features(many)).collect()}
    plain = Counter()
    for ws in [plain_words(prose(8, 40))] * 1_000 + [["w", str(i)] for i in range(3_000) if i % 3]:
        plain.update(zlib.crc32(f.encode()) % 10_000 for f in [*ws, *map(" ".join, zip(ws, ws[1:]))])
    assert counts == plain


def test_packing_is_reversible():
    for n in (0, 1, 2, 5_000):
        b = np.sort(np.random.default_rng(n).integers(0, 10_000, n).astype(np.uint32))
        assert resampling.unpacked(resampling.packed(b)).tolist() == b.tolist()


# license scans


def plain_base(text):
    ws = plain_words(text)
    hits = [(i, label) for p, label in licenses.BASE for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in hits]
    return len(ws), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in hits}))


def test_base_phrases_against_brute_force(spark, edge):
    rng = random.Random(5)
    bits = [*"under the mit license apache version 2 cc by nc".split(), "Under THE mit-License", "cc_by/nc", "\n"]
    texts = [" ".join(rng.choice(bits) for _ in range(200)) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[2:7] for r in licenses.scan_licenses(df).collect()}
    assert got == {i: plain_base(t) for i, t in enumerate(texts)}
    rows = licenses.scan_licenses(clashing(edge)).collect()
    assert sorted((str(r["text"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows) == sorted((str(t), *plain_base(t)) for _, t, *_ in edge_rows())
    assert all(r["score"] == (1.0 if r["n_base"] else 0.0) and r["copies"] == "own" for r in rows)


def scanned(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r for _, r in sorted((r["doc_id"], r) for r in licenses.scan_licenses(df).collect())]


def test_every_template_is_found_and_edited_ones_too(spark):
    texts = []
    for t in licenses.TEMPLATES:
        ws = t.text.split()
        texts += [f"{prose(1, 300)} {t.text} {prose(2, 300)}", " * ".join(ws), "Copyright 2020 somebody\n\n" + t.text.upper()]
    for r, t in zip(scanned(spark, texts), [t for t in licenses.TEMPLATES for _ in range(3)]):
        assert t.label in r["labels"].split(","), (t.label, r["labels"])
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0.7 <= r["score"] <= 1.0
        m = next(m for m in r["matches"] if m["label"] == t.label and m["end"] - m["start"] > 4)
        assert m["end"] - m["start"] == len(plain_words(t.text))
    edited = licenses.TEMPLATES[0].text.replace("any person obtaining", "any and every person at all obtaining").replace("The above copyright notice and", "The")
    assert scanned(spark, [prose(3, 50) + " " + edited])[0]["labels"] == "mit"


def test_parts_of_templates_are_not_found(spark):
    mit, bsd3 = licenses.TEMPLATES[0].text, next(t for t in licenses.TEMPLATES if t.label == "bsd-3-clause").text
    half = " ".join(mit.split()[:40])
    shuffled = mit.split()
    random.Random(1).shuffle(shuffled)
    apart = mit[:200] + " " + prose(1, 400) + " " + mit[200:]
    rows = scanned(spark, [half, " ".join(shuffled), apart, bsd3, "the general public enjoys free software and a license to copy"] + [prose(9, 20)] * 30)
    assert [r["labels"] for r in rows[:5]] == ["", "", "", "bsd-3-clause", ""] and rows[4]["score"] == 0.0


def test_long_files_keep_all_their_licenses(spark):
    """Rare words of one template do not crowd out another's, however many there are."""
    mit, mpl, zlib_ = (next(t.text for t in licenses.TEMPLATES if t.label == x) for x in ("mit", "mpl-2", "zlib"))
    text = " ".join([prose(i, 500) + " " + mpl for i in range(40)] + [mit, prose(77, 4_000), zlib_])
    (row,) = scanned(spark, [text])
    assert row["labels"] == "mit,mpl-2,zlib" and sum(m["label"] == "mpl-2" for m in row["matches"]) == 40


def test_index_takes_words_of_highest_document_frequency_rank(spark):
    """The index holds the rarest words over all documents: common ones drop out of it."""
    common = sorted(set(plain_words(licenses.TEMPLATES[0].text)))[:20]
    df = spark.createDataFrame([(i, " ".join(common)) for i in range(50)], "doc_id long, text string").repartition(5)
    v = licenses.Vocabulary()
    counts, n = licenses.document_counts(df, v)
    assert n == 50 and {v.word_list[i].decode() for i in counts} == set(common) and set(counts.values()) == {50}
    index = licenses.Index(v, counts, n)
    of_mit = {v.word_list[w].decode() for w in range(len(v.word_list)) for p in range(index.first[w], index.first[w + 1]) if index.template[p] == 0}
    assert len(of_mit) == licenses.RARE and not of_mit & set(common)


def test_no_rows_no_licenses(empty):
    assert licenses.scan_licenses(empty).count() == 0
    with pytest.raises(ValueError, match="key phrase"):
        licenses.Index(licenses.Vocabulary([licenses.Template("x", "some words", ("other words",))]), {}, 0)


# hard negatives


def plain_negatives(rows, positives=5, negatives=10, low=30, high=90):
    sound = [(i, (x + 1) % 10 if i % 7 == 0 else x, [math.floor(256 * float(c)) for c in v]) for i, x, v in rows if i is not None and x is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    anchors = {}
    for r in sound:
        if r[0] % 100 == 0 and (r[0] not in anchors or r[1:] < anchors[r[0]][1:]):
            anchors[r[0]] = r
    out = []
    for a in anchors.values():
        scored = sorted(((sum(p * q for p, q in zip(a[2], r[2])), r[0], r[1]) for r in sound if r[0] != a[0]), key=lambda x: (-x[0], x[1]))
        for p in [x for x in scored if x[2] == a[1]][:positives]:
            fit = [x for x in scored if x[2] != a[1] and low * p[0] <= 100 * x[0] <= high * p[0]]
            out += [(a[0], p[1], k + 1, x[1], p[0], x[0]) for k, x in enumerate(fit[:negatives])]
    return out


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("score", F.lit("own")).repartition(3)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in negatives.mine(negatives.stepped(df, label_of=moved), F.col("vec_id") % 100 == 0, **more).collect())


def drawn_vectors(seed, n, dims, spread=0.2):
    rng = np.random.default_rng(seed)
    return [(i, int(rng.integers(0, 10)), [float(np.float32(x)) for x in rng.normal(0.05, spread, dims)]) for i in range(n)]


@pytest.mark.parametrize("dims", [1, 7, 16])
def test_negatives_against_brute_force(spark, dims):
    rows = drawn_vectors(dims, 900, dims)
    assert mined(spark, rows) == sorted(plain_negatives(rows))
    assert mined(spark, rows, positives=2, negatives=3, low=0, high=100) == sorted(plain_negatives(rows, 2, 3, 0, 100))


def test_negatives_of_many_blocks(spark, monkeypatch):
    """Small blocks: what is kept of an anchor is carried from block to block and merged over the lanes."""
    monkeypatch.setattr(negatives, "ROWS", 37)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    rows = drawn_vectors(3, 1_500, 6)
    assert mined(spark, rows) == sorted(plain_negatives(rows))


def test_negatives_with_ties_nulls_and_ragged_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = drawn_vectors(11, 300, 5, 0.3)
    same = [0.5, 0.25, 0.0, -0.25, 0.125]
    rows += [(1000 + i, i % 3, same) for i in range(60)] + [(1100, 1, same), (1100, 1, same), (1100, 0, [0.5, 0.5]), (1200, 2, []), (1300, 2, [0.5]), (1301, 2, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5])]
    rows += [(None, 1, same), (1400, None, same), (1401, 1, None), (1500, 1, [0.5, None, 0.0, 0.0, 0.0]), (1501, 1, [nan, 0.0, 0.0, 0.0, 0.0]), (1502, 1, [inf, 0.0, 0.0, 0.0, 0.0]), (1503, 1, [-inf] * 5), (200, 4, same), (-700, 3, same), (-100, 3, same)]
    got = mined(spark, rows)
    assert got == sorted(plain_negatives(rows))
    assert any(r[0] == 1100 for r in got) and {r[4:] for r in got if r[0] == 1200} == {(0, 0)}  # an empty vector scores 0 with all


def test_bounds_hold_for_rows_outside_the_sample():
    rng = np.random.default_rng(0)
    v = rng.integers(-3_000, 3_000, (500, 9))
    cells = negatives.Cells(v[:40], v.min(axis=0), v.max(axis=0))
    codes = cells.codes(v)
    assert codes.shape == (5, 500)
    for q in v[:20]:
        lower, upper = negatives.score_bounds(codes, cells.tables(q))
        assert (lower <= v @ q).all() and (v @ q <= upper).all() and (upper - lower).mean() < np.abs(v @ q).max() * 2


def test_few_rows_are_scored_exactly():
    """Bounds leave a small part of the rows for exact scores."""
    rng = np.random.default_rng(1)
    v = rng.normal(0, 32, (4_000, 16)).astype(np.int64)
    cells = negatives.Cells(v[:1_000], v.min(axis=0), v.max(axis=0))
    lower, upper = negatives.score_bounds(cells.codes(v), cells.tables(v[0]))
    assert (upper >= negatives.kth(lower, 10)).mean() < 0.2


def test_no_anchors_no_negatives(spark):
    schema = "vec_id long, label int, embedding array<float>"
    none = spark.createDataFrame([], schema)
    assert negatives.mine(negatives.stepped(none), F.col("vec_id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(1, 1, [0.5]), (2, 2, [0.5])], schema)
    assert negatives.mine(negatives.stepped(one), F.col("vec_id") % 100 == 0).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        negatives.mine(negatives.stepped(spark.createDataFrame([(1, 1, [3e9])], schema)), F.lit(True))


# order of documents


def test_places_among_cuts_and_plans_of_many_partitions(spark):
    for cuts in ([], [3.0], [-1.0, 0.0, 5.5, 9.0], [float(i) for i in range(0, 999, 3)]):
        df = spark.createDataFrame([(float(k),) for k in range(-3, 1_005, 7)] + [(5.5,)], "k double")
        for r in df.select("k", fingerprints.cuts_below(F.col("k"), np.array(cuts)).alias("n")).collect():
            assert r["n"] == sum(c <= r["k"] for c in cuts)
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    began = time.time()
    plan = fingerprints.in_order(docs, 100_000)._jdf.queryExecution().executedPlan()
    assert plan is not None and time.time() - began < 60


def test_strings_as_ids(spark):
    """Fingerprints of neighbours are taken by numbers of documents; other ids are an error that says so."""
    df = spark.createDataFrame([("a", "x y"), ("b", "z")], "doc_id string, text string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        fingerprints.compare_neighbours(df).count()
