"""Token ids of texts by the pieces of a vocabulary, found through a trie.

``GREEDY`` takes at each place of a word the longest piece there is; pieces
that continue a word are marked in the vocabulary by a prefix. ``BEST`` takes
the pieces of a word whose scores sum highest (of equal sums the one whose last
piece is longest, then the piece before, and so on; sums are of doubles). Words are runs of letters
and digits, or single other characters but blanks, in lower case. A word that
cannot be put together is one unknown token. Texts get a first and a last
token, are cut to a length and filled up to it, with a mask of what is real.

A null text is the empty text. Vocabularies reach every task, so their size is
checked (``MOST_PIECES``); words seen before are looked up in a bounded store.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

GREEDY, BEST = "greedy", "best"
MOST_PIECES = 1_000_000
#: Words whose ids a task keeps.
MOST_WORDS = 200_000
WORD = re.compile(r"[^\W_]+|[^\w\s]|_")
TOKENS = "struct<input_ids:array<int>,attention_mask:array<int>>"


class Trie:
    """Pieces by their characters."""

    def __init__(self, pieces: Mapping[str, tuple[int, float]]):
        self.root: dict = {}
        for piece, value in pieces.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = value

    def from_(self, text: str, start: int) -> Iterator[tuple[int, int, float]]:
        """End, id and score of each piece that stands at a place, the shortest first."""
        node = self.root
        for end in range(start, len(text)):
            node = node.get(text[end])
            if node is None:
                return
            if "" in node:
                yield end + 1, *node[""]


@dataclass
class Pieces:
    """A vocabulary: ids and scores of pieces, the mark of those that continue a word, and the ids of special tokens."""

    pieces: Mapping[str, tuple[int, float]]
    how: str = GREEDY
    mark: str = "##"
    unknown: int = 1
    first: int | None = 2
    last: int | None = 3
    padding: int = 0
    _known: dict[str, list[int]] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        if self.how not in (GREEDY, BEST):
            raise ValueError(f"unknown way to cut words: {self.how}")
        if len(self.pieces) > MOST_PIECES:
            raise ValueError(f"a vocabulary of {len(self.pieces)} pieces is too large to send to every task")
        if not self.mark:
            self._begin = self._on = Trie(self.pieces)
        else:
            marked = {p: v for p, v in self.pieces.items() if p.startswith(self.mark) and p != self.mark}
            self._on = Trie({p[len(self.mark) :]: v for p, v in marked.items()})
            self._begin = Trie({p: v for p, v in self.pieces.items() if p not in marked})

    def word(self, w: str) -> list[int]:
        ids = self._known.get(w)
        if ids is None:
            if len(self._known) >= MOST_WORDS:
                self._known.clear()
            ids = self._known[w] = (self._greedy(w) if self.how == GREEDY else self._best(w)) or [self.unknown]
        return ids

    def _greedy(self, w: str) -> list[int] | None:
        at, out = 0, []
        while at < len(w):
            longest = None
            for longest in (self._on if at else self._begin).from_(w, at):  # noqa: B007  the last is the longest
                pass
            if longest is None:
                return None
            at = longest[0]
            out.append(longest[1])
        return out

    def _best(self, w: str) -> list[int] | None:
        # for each place: the sum, and where the piece that ends there begins
        sums: list[tuple[float, int, int] | None] = [None] * (len(w) + 1)
        sums[0] = (0.0, 0, -1)
        for at in range(len(w)):
            if sums[at] is None:
                continue
            for end, i, score in (self._on if at else self._begin).from_(w, at):
                total = sums[at][0] + score
                if sums[end] is None or total > sums[end][0]:
                    sums[end] = (total, at, i)
        if sums[len(w)] is None:
            return None
        out, at = [], len(w)
        while at:
            _, before, i = sums[at]
            out.append(i)
            at = before
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        return [i for w in WORD.findall(text.lower()) for i in self.word(w)]

    def framed(self, text: str, max_length: int) -> tuple[list[int], list[int]]:
        """Ids and mask, ``max_length`` of each."""
        ends = [[x] if x is not None else [] for x in (self.first, self.last)]
        room = max_length - len(ends[0]) - len(ends[1])
        if room < 0:
            raise ValueError("no room for the first and last token")
        ids = [*ends[0], *self.encode(text)[:room], *ends[1]]
        rest = max_length - len(ids)
        return ids + [self.padding] * rest, [1] * len(ids) + [0] * rest


def vocabulary(df: DataFrame, piece: str = "piece", id_: str = "id", score: str | None = None) -> dict[str, tuple[int, float]]:
    """A vocabulary table, brought to the driver; an error if it is larger than can be sent to every task."""
    rows = df.select(piece, id_, *([score] if score else [])).limit(MOST_PIECES + 1).collect()
    if len(rows) > MOST_PIECES:
        raise ValueError(f"a vocabulary of over {MOST_PIECES} pieces is too large to send to every task")
    return {r[0]: (r[1], float(r[2]) if score else 0.0) for r in rows}


def tokens(text: Column, pieces: Pieces, max_length: int) -> Column:
    """Struct ``input_ids, attention_mask`` of a text."""

    @pandas_udf(TOKENS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [pieces.framed(t, max_length) for t in batch]
            yield pd.DataFrame(rows, columns=["input_ids", "attention_mask"])

    return run(F.coalesce(text, F.lit("")))


def decoded(ids: Sequence[int], pieces: Pieces) -> str:
    """The words of ids, special ones left out."""
    by_id = {i: p for p, (i, _) in pieces.pieces.items()}
    out: list[str] = []
    for i in ids:
        if i in (pieces.first, pieces.last, pieces.padding):
            continue
        p = by_id.get(i, "?")
        if pieces.mark and p.startswith(pieces.mark) and out:
            out[-1] += p[len(pieces.mark) :]
        else:
            out.append(p)
    return " ".join(out)
