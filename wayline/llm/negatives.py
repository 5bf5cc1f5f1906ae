"""Hard-negative mining with a vector-approximation file.

For an anchor and one of its nearest rows of the same label (a positive), the
hard negatives are the best-scored rows of another label whose score lies
within a window about the positive's. Scores are inner products of the vectors
in whole steps, floor(256 x).

Every row is in the index: each dimension is cut into 16 cells, two dimensions
share a byte, and rows lie packed in blocks with their approximations. Cell
bounds are quantiles of a bounded sample (``SAMPLE`` rows, by hash of the id);
the outermost are the least and greatest values of all rows, so bounds hold for
every row whatever the sample. Anchors are packed in blocks too and meet the
blocks of rows, block against block, dealt into lanes by the block's number. For
an anchor a table of the least and greatest product of each cell gives every
row's lower and upper score bound by lookup; only rows that can still enter the
anchor's window, or pass the worst of those kept in it, are scored exactly. So
results are exact, not approximate. Each lane keeps a few rows an anchor, and
the best of those of all lanes are the result. Positives are found in a first
pass in the same way.

Defined cases: rows with a null id, label or vector, or a null or non-finite
component, take no part; a shorter vector is continued by zeros; ties go by the
smaller id; repeated rows are rows of their own, but a row with the anchor's id
is neither its positive nor its negative, and an anchor id that occurs several
times is one anchor, with the least label, then vector; a window below zero is
empty; anchors without positives, and positives without negatives, give no
rows; an empty table gives an empty result. Scores must fit 64 bits, otherwise
there is an error. Columns besides id, label and vector are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.llm.common import checkpointed, table

#: Steps of a component.
STEPS = 256
CELLS = 16
#: Rows by which cell bounds are fitted.
SAMPLE = 10_000
#: Rows and anchors in a block.
ROWS, ANCHORS = 8_192, 256
POSITIVES, NEGATIVES = 5, 10
#: The window in hundredths of the positive's score.
LOW, HIGH = 30, 90
NO_SCORE = np.iinfo(np.int64).min


def stepped(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", label_of: Column | None = None) -> DataFrame:
    """``vec_id, label, v`` of the rows that take part, the components in whole steps."""
    v = F.col(vector)
    sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    kept = rows.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & sound)
    steps = F.transform(v, lambda x: F.floor(x.cast("double") * STEPS).cast("long"))
    own = F.col(label) if label_of is None else label_of
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), own.cast("long").alias("label"), steps.alias("v"))


def matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows, shorter ones continued by zeros."""
    sizes, flat = np.asarray(lists.value_lengths(), dtype=np.int64), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dims), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Cells:
    """Cells of each dimension: the least and greatest step in each."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, greatest: np.ndarray):
        cuts = np.quantile(sample, np.arange(1, CELLS) / CELLS, axis=0, method="lower").astype(np.int64) if len(sample) else np.zeros((CELLS - 1, len(least)), dtype=np.int64)
        self.cuts = np.sort(cuts, axis=0)  # a value belongs to the cell after the last cut that it is above
        self.low = np.vstack([least, self.cuts + 1])
        self.high = np.vstack([self.cuts, greatest])
        # a cell no value falls in keeps bounds in order
        self.low, self.high = np.minimum(self.low, self.high), np.maximum(self.low, self.high)
        self.dims = len(least)
        self.kind = np.dtype(np.int32 if max([0, *np.abs(least).tolist(), *np.abs(greatest).tolist()]) < 1 << 31 else np.int64)

    def codes(self, v: np.ndarray) -> np.ndarray:
        """A byte for two dimensions."""
        cell = np.zeros((v.shape[0], self.dims + self.dims % 2), dtype=np.uint8)
        for d in range(self.dims):
            cell[:, d] = np.searchsorted(self.cuts[:, d], v[:, d], side="left")
        return np.ascontiguousarray((cell[:, ::2] * CELLS + cell[:, 1::2]).T)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each pair of dimensions and byte, the least and greatest sum of products with the anchor."""
        a, b = self.low * q, self.high * q
        both = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=-1)  # cell, dimension, bound
        if self.dims % 2:
            both = np.concatenate([both, np.zeros((CELLS, 1, 2), dtype=np.int64)], axis=1)
        return np.ascontiguousarray((both[:, None, ::2] + both[None, :, 1::2]).transpose(2, 3, 0, 1)).reshape(-1, 2, CELLS * CELLS)


def score_bounds(codes: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of each row's score."""
    out = np.zeros((2, codes.shape[1]), dtype=np.int64)
    for code, t in zip(codes, tables, strict=True):
        out[0] += t[0].take(code)
        out[1] += t[1].take(code)
    return out[0], out[1]


def packed_rows(rows: DataFrame, cells: Cells, size: int) -> DataFrame:
    """``block, ids, labels, vectors, codes``, and ``positives`` where the rows have them: so many rows in one, each task packing its own.

    Partitions are put together where they are smaller than a block.
    """
    extra = [c for c in ("positives",) if c in rows.columns]
    parts = rows.rdd.getNumPartitions()
    wanted = max(1, -(-rows.count() // size))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        count = 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            v = matrix(t["v"].combine_chunks(), cells.dims)
            parts = [x.tobytes() for x in (t["vec_id"].to_numpy(), t["label"].to_numpy(), v.astype(cells.kind), cells.codes(v))]
            more = [pa.array([t[c].to_pylist()], pa.list_(t.schema.field(c).type)) for c in extra]
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + n]), *(pa.array([x], pa.binary()) for x in parts), *more], ["block", "ids", "labels", "vectors", "codes", *extra])

        for b in batches:
            while len(b):
                taken = b.slice(0, size - count)
                held.append(taken)
                count, b = count + len(taken), b.slice(len(taken))
                if count == size:
                    yield block()
                    held, count, n = [], 0, n + 1
        if count:
            yield block()

    schema = "block long, ids binary, labels binary, vectors binary, codes binary" + "".join(f", {c} array<{rows.schema[c].dataType.simpleString()}>" for c in extra)
    return rows.coalesce(max(1, min(parts, wanted))).select("vec_id", "label", "v", *extra).mapInArrow(pack, schema)


def fitted(rows: DataFrame) -> Cells:
    """Cells from the hashed sample, with the least and greatest steps of all rows; a row a dimension reaches the driver."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = np.zeros(0, dtype=np.int64)
        for b in batches:
            if len(b):
                sizes = np.asarray(b["v"].value_lengths())
                v = matrix(b["v"], max(int(sizes.max()), len(low)))
                low, high = (np.pad(x, (0, v.shape[1] - len(x))) for x in (low, high))  # zeros are values of shorter vectors
                low, high = np.minimum(low, v.min(axis=0)), np.maximum(high, v.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low))), pa.array(low), pa.array(high)], ["dim", "low", "high"])

    each = rows.select("v").mapInArrow(ends, "dim long, low long, high long").groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    got = sorted(each.collect())
    least, greatest = (np.array([r[c] for r in got], dtype=np.int64) for c in ("low", "high"))
    most = np.maximum(np.abs(least.astype(np.float64)), np.abs(greatest.astype(np.float64)))
    if (most**2).sum() >= 2.0**62:
        raise ArithmeticError("scores do not fit 64 bits")
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    sample = matrix(pa.array([r["v"] for r in drawn], pa.list_(pa.int64())), len(least)) if drawn else np.zeros((0, len(least)), dtype=np.int64)
    return Cells(sample, least, greatest)


class Block:
    """An unpacked block of rows."""

    def __init__(self, r: dict, cells: Cells):
        self.ids, self.labels = (np.frombuffer(r[c], dtype=np.int64) for c in ("ids", "labels"))
        self.v = np.frombuffer(r["vectors"], dtype=cells.kind).reshape(len(self.ids), cells.dims)
        self.codes = np.frombuffer(r["codes"], dtype=np.uint8).reshape(-1, len(self.ids))

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        return self.v[at].astype(np.int64) @ q


#: Scores and ids of the rows kept.
Kept = tuple[np.ndarray, np.ndarray]
_NONE: Kept = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


def merged(kept: Kept, scores: np.ndarray, ids: np.ndarray, k: int) -> Kept:
    """The k best, by score and then the smaller id."""
    scores, ids = np.concatenate([kept[0], scores]), np.concatenate([kept[1], ids])
    if len(scores) > 4 * k:
        good = scores >= kth(scores, k)
        scores, ids = scores[good], ids[good]
    best = np.lexsort((ids, -scores))[:k]
    return scores[best], ids[best]


def kth(values: np.ndarray, k: int) -> int:
    """The k-th greatest value, or less than any where there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else NO_SCORE


def nearest_in(block: Block, q: np.ndarray, tables: np.ndarray, rows: np.ndarray, kept: Kept, k: int) -> Kept:
    """The k best of those kept and the given rows of the block."""
    lower, upper = score_bounds(block.codes[:, rows], tables)
    least = max(kth(lower, k), kth(kept[0], k))
    at = rows[upper >= least]
    return merged(kept, block.scores(at, q), block.ids[at], k)


def windowed_in(block: Block, q: np.ndarray, tables: np.ndarray, rows: np.ndarray, windows: list[tuple[int, int]], kept: list[Kept], k: int) -> list[Kept]:
    """For each window the k best within it of those kept and the given rows of the block."""
    lower, upper = score_bounds(block.codes[:, rows], tables)
    may = np.zeros(len(rows), dtype=bool)
    for (low, high), own in zip(windows, kept, strict=True):
        if low <= high:
            surely = lower[(lower >= low) & (upper <= high)]
            may |= (upper >= max(low, kth(surely, k), kth(own[0], k))) & (lower <= high)
    at = rows[may]
    exact, ids = block.scores(at, q), block.ids[at]
    out = []
    for (low, high), own in zip(windows, kept, strict=True):
        fits = (exact >= low) & (exact <= high)
        out.append(merged(own, exact[fits], ids[fits], k))
    return out


def _met(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Every block of anchors beside every block of rows: the stated queries against all rows, in blocks dealt into lanes by the block of rows."""
    lanes = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = anchors.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    right = rows.select(F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int").alias("lane"), F.struct("ids", "labels", "vectors", "codes").alias("rows"))
    return left.hint("merge").join(right, "lane").drop("lane")


_FOUND = "anchor_id long, place long, positive_id long, positive_score long, score long, row_id long"


class Pass:
    """One block of anchors as the blocks of rows come by; what is kept of an anchor is a few rows for each of its windows."""

    def __init__(self, r: dict, cells: Cells):
        self.number, self.anchors = r["block"], Block(r, cells)
        self.queries = self.anchors.v.astype(np.int64)
        self.tables = [cells.tables(q) for q in self.queries]

    def found(self) -> pa.RecordBatch:
        out = [(int(a), *key, s, x) for a, per in zip(self.anchors.ids, self.kept, strict=True) for key, (scores, ids) in per for s, x in zip(scores.tolist(), ids.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 6)], ["anchor_id", "place", "positive_id", "positive_score", "score", "row_id"])


class Nearest(Pass):
    """Rows of the anchor's label."""

    def __init__(self, r: dict, cells: Cells, k: int):
        super().__init__(r, cells)
        self.k, self.kept = k, [[((None,) * 3, _NONE)] for _ in self.queries]

    def meet(self, rows: Block) -> None:
        of_label = {x: np.flatnonzero(rows.labels == x) for x in np.unique(self.anchors.labels).tolist()}
        for i, q in enumerate(self.queries):
            own = of_label[int(self.anchors.labels[i])]
            own = own[rows.ids[own] != self.anchors.ids[i]]
            if len(own):
                self.kept[i] = [((None,) * 3, nearest_in(rows, q, self.tables[i], own, self.kept[i][0][1], self.k))]


class Windowed(Pass):
    """Rows of other labels in windows about the positives."""

    def __init__(self, r: dict, cells: Cells, k: int, low: int, high: int):
        super().__init__(r, cells)
        self.k = k
        self.kept = [[((p["place"], p["positive_id"], p["score"]), _NONE) for p in per] for per in r["positives"]]
        self.windows = [[(-(-low * p["score"] // 100), high * p["score"] // 100) for p in per] for per in r["positives"]]

    def meet(self, rows: Block) -> None:
        for i, q in enumerate(self.queries):
            other = np.flatnonzero((rows.labels != self.anchors.labels[i]) & (rows.ids != self.anchors.ids[i]))
            if len(other) and any(a <= b for a, b in self.windows[i]):
                found = windowed_in(rows, q, self.tables[i], other, self.windows[i], [x for _, x in self.kept[i]], self.k)
                self.kept[i] = [(key, x) for (key, _), x in zip(self.kept[i], found, strict=True)]


def _run(met: DataFrame, start: Callable[[dict], Pass], cells: Cells) -> DataFrame:
    """What each run of one block of anchors keeps; where such a block comes up again its rows are sent twice, and the best of all are taken later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Pass | None = None
        for b in batches:
            for i in range(len(b)):
                r = b.slice(i, 1).to_pylist()[0]
                if now is None or r["block"] != now.number:
                    if now is not None:
                        yield now.found()
                    now = start(r)
                now.meet(Block(r["rows"], cells))
        if now is not None:
            yield now.found()

    return met.mapInArrow(run, _FOUND)


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of all lanes; a lane has sent k at most."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "row_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of the anchors among the rows (``vec_id, label, v`` as ``stepped`` makes them)."""
    rows = checkpointed(rows)
    cells = fitted(rows)
    file = checkpointed(packed_rows(rows, cells, ROWS))
    anchors = checkpointed(rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select("vec_id", "m.*"))
    near = _run(_met(packed_rows(anchors, cells, ANCHORS), file), lambda r: Nearest(r, cells, positives), cells)
    near = _top(near, ["anchor_id"], positives).groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("rank").alias("place"), F.col("row_id").alias("positive_id"), "score")).alias("positives"))
    queries = checkpointed(anchors.join(near, anchors["vec_id"] == near["anchor_id"]).drop("anchor_id"))
    hard = _run(_met(packed_rows(queries, cells, ANCHORS), file), lambda r: Windowed(r, cells, negatives, low, high), cells)
    best = _top(hard, ["anchor_id", "place"], negatives)
    return best.select("anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = stepped(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), label_of=moved)
    return mine(rows, F.col("vec_id") % 100 == 0)
