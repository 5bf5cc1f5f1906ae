"""Pieces of words against brute force."""

from __future__ import annotations

import itertools
import random

import pytest
from wayline.operators import subwords


def cuts(w):
    """Every way to cut a word into parts."""
    for k in range(len(w)):
        for at in itertools.combinations(range(1, len(w)), k):
            yield [w[i:j] for i, j in zip((0, *at), (*at, len(w)))]


def random_pieces(seed, mark):
    rng = random.Random(seed)
    names = {rng.choice(["", mark]) + "".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(30)}
    return {p: (10 + i, float(rng.randint(-9, -1))) for i, p in enumerate(sorted(names))}


def parts_of(w, pieces, mark):
    for c in cuts(w):
        named = [p if i == 0 else mark + p for i, p in enumerate(c)]
        if all(n in pieces and (not mark or i > 0 or not n.startswith(mark)) for i, n in enumerate(named)):
            yield c, [pieces[n][0] for n in named], sum(pieces[n][1] for n in named)


@pytest.mark.parametrize("mark", ["##", ""])
def test_words_against_every_cut(mark):
    for seed in range(12):
        pieces = random_pieces(seed, mark)
        greedy, best = (subwords.Pieces(pieces, how, mark) for how in (subwords.GREEDY, subwords.BEST))
        rng = random.Random(seed + 100)
        for w in {"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(60)}:
            every = list(parts_of(w, pieces, mark))
            got = best.word(w)
            if not every:
                assert got == greedy.word(w) == [1]
                continue
            top = max(s for *_, s in every)
            wanted = max((c for c in every if c[2] == top), key=lambda c: [len(p) for p in reversed(c[0])])
            assert got == wanted[1]
            longest, at = [], 0
            while at < len(w):
                names = [w[at:e] if at == 0 else mark + w[at:e] for e in range(len(w), at, -1)]
                name = next((n for n in names if n in pieces), None)
                if name is None:
                    longest = [1]
                    break
                longest.append(pieces[name][0])
                at += len(name) - (len(mark) if at else 0)
            assert greedy.word(w) == longest


def test_texts(spark):
    p = subwords.Pieces({x: (10 + i, 0.0) for i, x in enumerate(["go", "##ing", "##al", ".", "é", "_", "a"])})
    assert p.encode("Going, GOAL. é_a goes") == [10, 11, 1, 10, 12, 13, 14, 15, 16, 1] and p.encode("") == []
    df = spark.createDataFrame([(0, "going goal ."), (1, None), (2, ""), (3, "go " * 50), (4, "漢 go")], "id int, text string")
    got = {r["id"]: tuple(r["k"]) for r in df.select("id", subwords.tokens(df["text"], p, 6).alias("k")).collect()}
    assert got[0] == ([2, 10, 11, 10, 12, 3], [1] * 6) and got[1] == got[2] == ([2, 3, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0])
    assert got[3] == ([2, 10, 10, 10, 10, 3], [1] * 6) and got[4] == ([2, 1, 10, 3, 0, 0], [1, 1, 1, 1, 0, 0])
    assert subwords.decoded(got[0][0], p) == "going goal"
    bare = subwords.Pieces(p.pieces, first=None, last=None)
    assert bare.framed("go", 2) == ([10, 0], [1, 0])
    with pytest.raises(ValueError, match="no room"):
        p.framed("go", 1)
    with pytest.raises(ValueError, match="way to cut"):
        subwords.Pieces({}, "longest")
    v = spark.createDataFrame([("a", 3, -1.5)], "piece string, id int, score double")
    assert subwords.vocabulary(v, score="score") == {"a": (3, -1.5)}


def test_bounds(monkeypatch):
    monkeypatch.setattr(subwords, "MOST_WORDS", 2)
    p = subwords.Pieces({"a": (5, 0.0), "##a": (6, 0.0)})
    assert [p.word("a" * k) for k in (1, 2, 3, 1)] == [[5], [5, 6], [5, 6, 6], [5]] and len(p._known) <= 2
    monkeypatch.setattr(subwords, "MOST_PIECES", 1)
    with pytest.raises(ValueError, match="too large"):
        subwords.Pieces({"a": (5, 0.0), "b": (6, 0.0)})
