"""Stateful windows over streams whose steps come late, on arbitrary state processing.

A key's steps are taken in the order of ``t`` whatever the order in which
micro-batches bring them: a step waits, in the state store, until the one
before it has been taken. With ``patience``, a gap that stays open is given up
when a timer runs out, so many milliseconds of processing time after the key
last got a row; then the waiting steps are taken across gaps, and whatever comes
below them afterwards is ``late``: it gives a row of its own, without a value,
and changes nothing. Such a query looks at its timers for as long as it runs, so
it takes a trigger by time: with ``availableNow`` it would not end. Without
patience steps wait for as long as it takes.

Defined cases: a step that comes again, waiting or taken, is late; steps count
from 0; a null value waits and is taken as any other; an empty batch gives no
rows. The state of a key is what waits, in blocks of ``BLOCK`` numbers of steps,
and one value with the number of the next step and the few items that the
operator keeps: every call to the state store takes as long as some hundred
steps do, so a batch reads and writes a block once, however many of its steps come; it goes ``forget`` milliseconds after the last
row of the key, if that and ``patience`` are set. The session needs the RocksDB state store
(``use_state_store``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Numbers of steps that wait in one entry of the state.
BLOCK = 256
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Have the session keep state where lists, maps and timers can be kept."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class InOrder(StatefulProcessor):
    """Takes vectors of a key in order; ``taken`` says what a step gives and what is kept."""

    def __init__(self, patience: int | None, forget: int | None = None):
        self.patience, self.forget = patience, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "block int", "t array<int>, x array<array<double>>")
        self.place = handle.getValueState("place", "next int, waits int, due long, gone long, kept array<array<double>>")

    def close(self) -> None:
        pass

    def taken(self, t: int, x: list | None, kept: list[list]) -> tuple[tuple, list[list]]:
        """The columns after ``traj, t, late`` for the step, and what is kept after it."""
        raise NotImplementedError

    nothing: tuple = ()
    columns: tuple[str, ...] = ()

    def _block(self, blocks: dict[int, dict[int, list | None]], t: int) -> dict[int, list | None]:
        """What waits in a step's block, read from the state when it is first asked for."""
        b = t // BLOCK
        if b not in blocks:
            blocks[b] = dict(zip(*held, strict=True)) if (held := self.waiting.getValue((b,))) else {}
        return blocks[b]

    def _release(self, key: tuple, t: int, fresh: dict[int, list | None], kept: list[list], waits: int, blocks: dict[int, dict[int, list | None]], over_gaps: bool, rows: list[tuple]) -> tuple[int, list[list], int]:
        """Takes what can be taken of what has just come and what waits; the next step to come, what is kept, and how many wait on."""
        changed, after = set(), t
        left = iter(sorted(k for (b,) in list(self.waiting.keys()) for k in self._block(blocks, b * BLOCK))) if over_gaps else None
        while True:
            if left is not None and (t := next(left, -1)) < 0:
                break
            if t in fresh:
                x = fresh.pop(t)
            elif waits and t in self._block(blocks, t):
                x = blocks[t // BLOCK].pop(t)
                changed.add(t // BLOCK)
                waits -= 1
            else:
                break
            out, kept = self.taken(t, x, kept)
            rows.append((key[0], t, False, *out))
            t += 1
            after = t
        for k, x in fresh.items():
            (self._block(blocks, k) if waits else blocks.setdefault(k // BLOCK, {}))[k] = x
            changed.add(k // BLOCK)
        for b in changed:
            if blocks[b]:
                self.waiting.updateValue((b,), ([*blocks[b]], [*blocks[b].values()]))
            else:
                self.waiting.removeKey((b,))
        return after, kept, waits + len(fresh)

    def _rows(self, rows: list[tuple]) -> Iterator[Row]:
        of = Row("traj", "t", "late", *self.columns)
        return (of(*r) for r in rows)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802  the interface's name
        following, waits, due, gone, kept = self.place.get() or (0, 0, None, None, [])
        late: list[tuple] = []
        blocks: dict[int, dict[int, list | None]] = {}
        fresh: dict[int, list | None] = {}
        for t, x in ((r["t"], r["x"]) for r in rows):
            if t < following or t in fresh or waits and t in self._block(blocks, t):
                late.append((key[0], t, True, *self.nothing))
            else:
                fresh[t] = x
        out = sorted(late, key=lambda r: r[1])
        following, kept, waits = self._release(key, following, fresh, [list(k) for k in kept], waits, blocks, False, out)
        if self.patience is not None:
            now = timerValues.getCurrentProcessingTimeInMs()
            for old in (due, gone):
                if old is not None:
                    self.handle.deleteTimer(old)
            due = now + self.patience if waits else None
            gone = None if self.forget is None else now + max(self.forget, self.patience + 1)
            for new in (due, gone):
                if new is not None:
                    self.handle.registerTimer(new)
        self.place.update((following, waits, due, gone, kept))
        yield from self._rows(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        following, waits, _, gone, kept = self.place.get()
        out: list[tuple] = []
        following, kept, waits = self._release(key, following, {}, [list(k) for k in kept], waits, {}, True, out)
        if gone is not None and expiredTimerInfo.getExpiryTimeInMs() >= gone:
            for state in (self.waiting, self.place):
                state.clear()
        else:
            self.place.update((following, waits, None, gone, kept))
        yield from self._rows(out)


class History(InOrder):
    """The last vectors up to the step; before the first its own."""

    columns, nothing = ("history", "mask"), (None, None)

    def __init__(self, size: int, patience: int | None, forget: int | None = None):
        super().__init__(patience, forget)
        self.size = size

    def taken(self, t, x, kept):
        kept = [*kept, x or []][-self.size :]
        return ([kept[0]] * (self.size - len(kept)) + kept, [i >= self.size - len(kept) for i in range(self.size)]), kept


class Ensemble(InOrder):
    """The mean of what the last chunks say of the step, weighing ``exp(-decay i)``, i = 0 for the oldest."""

    columns, nothing = ("action",), (None,)

    def __init__(self, horizon: int, decay: float, patience: int | None, forget: int | None = None):
        super().__init__(patience, forget)
        self.horizon, self.decay = horizon, decay

    def taken(self, t, x, kept):
        # what is kept begins with the step at which a chunk was made, so that gaps do not shift it
        kept = [c for c in [*kept, [float(t), *(x or [])]] if t - c[0] < self.horizon]
        said = [c[1 + t - int(c[0])] for c in kept if len(c) > 1 + t - int(c[0])]
        w = [math.exp(-self.decay * i) for i in range(len(said))]
        return (sum(a * b for a, b in zip(w, said, strict=True)) / sum(w) if said else None,), kept


def _stream(df: DataFrame, value: str, processor: InOrder, schema: str) -> DataFrame:
    rows = df.select("traj", F.col("t").cast("int").alias("t"), F.col(value).cast("array<double>").alias("x"))
    return rows.groupBy("traj").transformWithState(processor, f"traj long, t int, late boolean, {schema}", "append", "None" if processor.patience is None else "ProcessingTime")


def histories(df: DataFrame, size: int, patience: int | None = None, forget: int | None = None) -> DataFrame:
    """``traj, t, late, history, mask`` of a stream ``traj, t, x`` of vectors."""
    return _stream(df, "x", History(size, patience, forget), "history array<array<double>>, mask array<boolean>")


def ensembles(df: DataFrame, horizon: int, decay: float = 0.0, patience: int | None = None, forget: int | None = None) -> DataFrame:
    """``traj, t, late, action`` of a stream ``traj, t, chunk``."""
    return _stream(df, "chunk", Ensemble(horizon, decay, patience, forget), "action double")


def executions(df: DataFrame, exec_horizon: int) -> DataFrame:
    """``traj, chunk_no, i, action, reward, done, reward_so_far`` of chunks ``traj, t, chunk, rewards, dones`` in a stream or a table.

    A chunk's actions up to and with the first that ends the episode are
    executed, at most ``exec_horizon`` of them. Each chunk tells this by
    itself, so there is no state, and late chunks come out when they come.
    """
    n = F.least(F.lit(exec_horizon), F.size("chunk"))
    ends = F.array_position(F.slice("dones", 1, exec_horizon), True)
    last = F.when(ends > 0, ends).otherwise(n).cast("int")
    so_far = lambda i: F.aggregate(F.slice("rewards", 1, i + 1), F.lit(0.0), lambda a, r: a + r)
    done = F.transform(
        F.sequence(F.lit(0), last - 1), lambda i: F.struct(i.alias("i"), F.get("chunk", i).alias("action"), F.get("rewards", i).alias("reward"), F.get("dones", i).alias("done"), so_far(i).alias("reward_so_far"))
    )
    return df.select("traj", F.col("t").alias("chunk_no"), F.inline(F.when(last > 0, done)))
