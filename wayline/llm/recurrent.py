"""A gated recurrent language model in numpy, with a class-factored softmax.

Words have numbers: the frequent ones in the order of their counts, ``IN`` of
them to a class; every other word is in one of the rare classes, by its first
two bytes. The state predicts the class, and within a frequent class the word by a
softmax of its own; within a rare class words keep their shares of the counts,
which the caller adds. The input of a frequent word is a row of its own, that
of another word the row of its last bytes' hash.

Texts run in lanes, many side by side; a lane takes the next text when its own
ends. A text begins with the state zero and keeps its state from window to
window until it ends (in training, for ``PIECE`` words at most). Training
propagates errors back within a window. One gate decides how much of the state
stays; the candidate for the rest sees the state and the word before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Words of a frequent class.
IN = 32
#: Rare classes.
RARE = 64
#: Input rows of rare words; all numbers of words fit two bytes.
TAILS = 1000
HIDDEN = 16
#: Lanes of training at first and at most, and of scoring at most: the fewer, the more steps are made on as many words.
FIRST_LANES, LANES = 64, 512
#: Words of a text in training after which the state begins anew, so that lanes of long texts end with the others.
PIECE = 2048
WINDOW = 16
#: Windows that are laid out at a time.
LAID = 16
#: Logits are cut at so much, so that their exponentials stay finite.
MOST = np.float32(60)

Params = dict[str, np.ndarray]


def rare_class(word: bytes) -> int:
    """Number of the rare class of a word: of its first two bytes."""
    return rare_class_of(word[0] * 256 + (word[1] if len(word) > 1 else 0))


def rare_class_of(pair):
    """The class of two bytes as a number: multiplicative hashing of a number, an array or a column."""
    return (pair * 40503 % 65536) * RARE // 65536


def rare_classes(content: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``rare_class`` of each word of bytes that lie one after the other; of an empty one any."""
    first = content[np.minimum(ends[:-1], len(content) - 1)].astype(np.int64)
    second = np.where(ends[:-1] + 1 < ends[1:], content[np.minimum(ends[:-1] + 1, len(content) - 1)], 0)
    return rare_class_of(first * 256 + second)


def tail_rows(content: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Input rows, from 0, of words that are not frequent, by their last three bytes."""
    tail = np.zeros(len(ends) - 1, dtype=np.uint64)
    starts = np.maximum(ends[:-1], ends[1:] - 3)
    for k in range(3):
        at = starts + k
        tail |= np.where(at < ends[1:], content[np.minimum(at, len(content) - 1)], 0).astype(np.uint64) << np.uint64(8 * k)
    return ((tail * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)) * np.uint64(TAILS) >> np.uint64(32)).astype(np.int64)


def start(counts: np.ndarray, rare: np.ndarray) -> Params:
    """Parameters that give every word its share of the counts: of the frequent words, and the sums of the rare classes.

    The last row of ``class`` and of each part of ``word`` is a bias.
    """
    rng = np.random.default_rng(3)
    classes = -(-len(counts) // IN)
    padded = np.zeros((classes, IN))
    padded.reshape(-1)[: len(counts)] = counts
    padded = np.where(np.arange(classes * IN).reshape(classes, IN) < len(counts), padded + 0.5, 0)
    sums = np.concatenate([padded.sum(axis=1), rare + 0.5])
    with np.errstate(divide="ignore"):
        inner = np.log(padded / padded.sum(axis=1, keepdims=True)) if classes else padded
    small = lambda *shape: rng.normal(0, 0.08, shape)
    out = {
        "in": small(classes * IN + TAILS, 2 * HIDDEN),
        "first": small(1, 2 * HIDDEN),
        "state": small(HIDDEN, 2 * HIDDEN) * 2,
        "class": np.concatenate([np.zeros((HIDDEN, len(sums))), np.log(sums / sums.sum())[None]]),
        "word": np.concatenate([np.zeros((classes, HIDDEN, IN)), np.maximum(inner, -1e4)[:, None]], axis=1),
    }
    return {k: v.astype(np.float32) for k, v in out.items()}


class Lanes:
    """Texts, as arrays of word numbers, dealt out to lanes that run side by side.

    A number below ``n_frequent`` is a frequent word, ``n_frequent + row *
    RARE + rare class`` any other. Each text gives the words to predict; the
    input of its first is the row that begins a text.
    """

    def __init__(self, texts: Iterable[np.ndarray], lanes: int):
        self.source = enumerate(texts)
        self.over = False
        self.now: list[tuple[int, np.ndarray, int] | None] = [None] * lanes
        self.before = np.full(lanes, -1, dtype=np.int32)

    def _next(self) -> tuple[int, np.ndarray, int] | None:
        if not self.over:
            for k, text in self.source:
                if len(text):
                    return k, text, 0
            self.over = True
        return None

    def blocks(self, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int, bool]]]]:
        """Of each block of steps the words before, the words (-1: none) and where texts begin, by step and lane; and the pieces.

        A piece is a text's number, where its part begins in the block's words, one lane after the other, and whether the text ends there.
        """
        lanes = len(self.now)
        while True:
            word = np.full((lanes, steps), -1, dtype=np.int32)
            begins = np.zeros((lanes, steps), dtype=bool)
            pieces: list[tuple[int, int, int, bool]] = []
            for lane in range(lanes):
                at, row = 0, word[lane]
                while at < steps:
                    if (held := self.now[lane] or self._next()) is None:
                        break
                    k, text, done = held
                    part = text[done : done + steps - at]
                    row[at : at + len(part)] = part
                    begins[lane, at] = done == 0
                    done += len(part)
                    pieces.append((k, lane * steps + at, len(part), done == len(text)))
                    self.now[lane] = None if done == len(text) else (k, text, done)
                    at += len(part)
            if not pieces:
                return
            before = np.concatenate([self.before[:, None], word[:, :-1]], axis=1)
            self.before = word[:, -1].copy()
            yield np.ascontiguousarray(before.T), np.ascontiguousarray(word.T), np.ascontiguousarray(begins.T), pieces


class Network:
    """The network of some parameters."""

    def __init__(self, params: Params):
        self.p = params
        self.n_frequent = len(params["in"]) - TAILS
        self.classes = self.n_frequent // IN

    def rows(self, before: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Input rows of the words before; the last row for the beginning of a text."""
        row = np.where(before < self.n_frequent, before, self.n_frequent + (before - self.n_frequent) // RARE)
        return np.where(begins, len(self.p["in"]), row)

    def forward(self, table: np.ndarray, rows: np.ndarray, begins: np.ndarray, state: np.ndarray, keep: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States after each step, before the word to predict, with a one beside them; and the last.

        ``keep`` gets the states before, and the gate and the candidate beside each other.
        """
        h, w, out = state, self.p["state"], np.ones((*rows.shape, HIDDEN + 1), dtype=np.float32)
        some = begins.any(axis=1)
        for t in range(len(rows)):
            if some[t]:
                h = h * ~begins[t][:, None]
            x = np.take(table, rows[t], axis=0)
            x += h @ w
            z, c = x[:, :HIDDEN], x[:, HIDDEN:]
            np.negative(z, out=z)
            np.exp(z, out=z)
            z += 1
            np.reciprocal(z, out=z)
            np.tanh(c, out=c)
            if keep is not None:
                keep[0][t], keep[1][t] = h, x
            h = h - c
            h *= z
            h += c
            out[t, :, :HIDDEN] = h
        return out, h

    def outputs(self, h: np.ndarray, word: np.ndarray, grads: Params | None = None, scale: np.float32 = np.float32(1)) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural logarithms of the chance of each word (of its class alone, if rare) given states with a one beside them.

        With ``grads``, which then gets the gradients of the loss times the scale, also the error of the states.
        """
        top, inner_of = self.p["class"], self.p["word"]
        cls = np.where(word < self.n_frequent, word // IN, self.classes + (word - self.n_frequent) % RARE).astype(np.int16)
        order = np.argsort(cls, kind="stable")
        h, word, cls = np.take(h, order, axis=0), word[order], cls[order]
        log_p, dh = _softmax(h, top, cls, None if grads is None else grads["class"], scale)
        bounds = np.searchsorted(cls, np.arange(self.classes + 1, dtype=np.int16))
        within = word - cls.astype(np.int32) * IN
        for c in range(self.classes):
            part = slice(bounds[c], bounds[c + 1])
            if part.start < part.stop:
                more, d = _softmax(h[part], inner_of[c], within[part], None if grads is None else grads["word"][c], scale)
                log_p[part] += more
                if dh is not None:
                    dh[part] += d
        out = np.empty_like(log_p)
        out[order] = log_p
        if dh is None:
            return out, None
        error = np.empty_like(dh)
        error[order] = dh
        return out, error

    def score_stream(self, texts: Iterable[np.ndarray], lanes: int) -> Iterator[tuple[int, float]]:
        """Number and natural logarithm of the chance (of rare words' classes) of each whole text that has a word, as texts end."""
        table = np.concatenate([self.p["in"], self.p["first"]])
        state = np.zeros((lanes, HIDDEN), dtype=np.float32)
        so_far: dict[int, float] = {}
        for before, word, begins, pieces in Lanes(texts, lanes).blocks(WINDOW * LAID):
            values = np.zeros(word.shape, dtype=np.float32)
            for lo in range(0, len(word), WINDOW):
                part = slice(lo, lo + WINDOW)
                used = np.flatnonzero(word[lo] >= 0)
                if not len(used):
                    break
                if len(used) == lanes:
                    w, b, h = word[part], begins[part], before[part]
                else:
                    w, b, h = word[part][:, used], begins[part][:, used], before[part][:, used]
                out, state[used] = self.forward(table, self.rows(h, b), b, state[used])
                real = w >= 0
                got = np.zeros(w.shape, dtype=np.float32)
                got[real], _ = self.outputs(out[real], w[real])
                values[part, used] = got
            flat = np.ascontiguousarray(values.T).reshape(-1)
            sums = np.add.reduceat(flat, [at for _, at, _, _ in pieces], dtype=np.float64)  # what lies between two pieces is zero
            for (k, _, _, ended), s in zip(pieces, sums.tolist(), strict=True):
                total = so_far.pop(k, 0.0) + s
                if ended:
                    yield k, total
                else:
                    so_far[k] = total

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural logarithm of the chance of each whole text (of rare words' classes)."""
        size = np.array([len(t) for t in texts])
        out = np.zeros(len(texts))
        lanes = int(np.clip(size.sum() // max(1, size.max(initial=1)), 64, LANES))  # so many that no text is much longer than a lane
        order = np.argsort(-size, kind="stable")
        for k, v in self.score_stream((texts[i] for i in order), lanes):
            out[order[k]] = v
        return out


def _softmax(h: np.ndarray, w: np.ndarray, target: np.ndarray, grad: np.ndarray | None, scale: np.float32) -> tuple[np.ndarray, np.ndarray | None]:
    """Logarithms of the targets' chances; with a gradient of the weights to fill in, also the error of the states."""
    z = h @ w
    if (np.abs(w[:-1]).sum(axis=0) + w[-1]).max() > MOST:  # states lie between -1 and 1
        np.minimum(z, MOST, out=z)
    at = np.arange(len(target))
    chosen = z[at, target]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], dtype=np.float32)
    log_p = chosen - np.log(total)
    if grad is None:
        return log_p, None
    z *= (scale / total)[:, None]
    z[at, target] -= scale
    np.matmul(h.T, z, out=grad)
    return log_p, z @ w[:-1].T


class Trainer:
    """Steps of stochastic descent with moment estimates; the gradient's length is bounded.

    ``square`` are the squares of gradients to go on from, as ``spread`` gave them.
    """

    def __init__(self, params: Params, rate: float, square: np.ndarray | None = None):
        self.like, self.rate, self.steps = params, rate, 0
        self.flat = flattened(params)
        self.net = Network(unpacked(self.flat, params))
        self.grad = np.zeros_like(self.flat)
        self.into = unpacked(self.grad, params)
        self.mean, self.square = np.zeros_like(self.flat), np.zeros_like(self.flat) if square is None else square.astype(np.float32)
        self.anew = square is None

    @property
    def weight(self) -> float:
        """The share of gradients, rather than of the zero begun with, in the squares."""
        return 1 - 0.99**self.steps if self.anew else 1.0

    @property
    def spread(self) -> np.ndarray:
        """Mean squares of gradients."""
        return self.square / np.float32(self.weight or 1.0)

    def _step(self) -> None:
        g = self.grad
        length = float(np.sqrt(g @ g))
        if length > 1:
            g /= np.float32(length)
        self.steps += 1
        self.mean += np.float32(0.1) * (g - self.mean)
        change = g * g
        change -= self.square
        change *= np.float32(0.01)
        self.square += change
        size = np.sqrt(self.square)
        size *= np.float32(self.weight**-0.5)
        size += np.float32(1e-5)
        np.divide(self.mean, size, out=size)
        size *= np.float32(self.rate / (1 - 0.9**self.steps))
        self.flat -= size

    def train(self, texts: Iterable[np.ndarray], lanes: int = LANES) -> int:
        """One pass over the texts; the number of their words."""
        net, state, n = self.net, np.zeros((lanes, HIDDEN), dtype=np.float32), 0
        for before, word, begins, _ in Lanes(texts, lanes).blocks(WINDOW * LAID):
            for lo in range(0, len(word), WINDOW):
                part = slice(lo, lo + WINDOW)
                used = np.flatnonzero(word[lo] >= 0)
                if not len(used):
                    break
                state[used], k = self._window(before[part][:, used], word[part][:, used], begins[part][:, used], state[used])
                n += k
        return n

    def _window(self, before: np.ndarray, word: np.ndarray, begins: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, int]:
        """A step on a window: the states after it, and how many words it had."""
        net, p, into = self.net, self.net.p, self.into
        table = np.concatenate([p["in"], p["first"]])
        rows = net.rows(before, begins)
        shape = rows.shape
        prev, x = np.empty((*shape, HIDDEN), dtype=np.float32), np.empty((*shape, 2 * HIDDEN), dtype=np.float32)
        out, last = net.forward(table, rows, begins, state, (prev, x))
        real = word >= 0
        n = int(real.sum())
        self.grad[:] = 0
        _, dh = net.outputs(out[real], word[real], into, np.float32(1.0 / n))
        error = np.zeros((*shape, HIDDEN), dtype=np.float32)
        error[real] = dh
        z, c = x[..., :HIDDEN], x[..., HIDDEN:]
        # What the error of a step's state is multiplied by, for the gate and for the candidate.
        by = np.empty_like(x)
        np.multiply(prev - c, z * (1 - z), out=by[..., :HIDDEN])
        np.multiply(1 - z, 1 - c * c, out=by[..., HIDDEN:])
        dx = np.empty_like(x)
        after = np.zeros_like(state)
        back = np.ascontiguousarray(p["state"].T)
        ends = begins.any(axis=1)
        for t in range(shape[0] - 1, -1, -1):
            e, g = error[t], dx[t]
            e += after
            np.multiply(e, by[t, :, :HIDDEN], out=g[:, :HIDDEN])
            np.multiply(e, by[t, :, HIDDEN:], out=g[:, HIDDEN:])
            after = g @ back
            e *= z[t]
            after += e
            if ends[t]:
                after *= ~begins[t][:, None]
        flat, dx = rows.reshape(-1), dx.reshape(-1, 2 * HIDDEN)
        np.matmul(prev.reshape(-1, HIDDEN).T, dx, out=into["state"])
        order = np.argsort(flat.astype(np.int16), kind="stable")
        flat = flat[order]
        firsts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        grad, names = np.add.reduceat(np.take(dx, order, axis=0), firsts, axis=0), flat[firsts]
        if names[-1] == len(table) - 1:
            into["first"][:] = grad[-1:]
            grad, names = grad[:-1], names[:-1]
        into["in"][names] = grad
        self._step()
        return last, n


def pieces(texts: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """The texts, long ones in parts."""
    for t in texts:
        for lo in range(0, len(t), PIECE):
            yield t[lo : lo + PIECE]


def flattened(params: Params) -> np.ndarray:
    return np.concatenate([params[k].reshape(-1) for k in sorted(params)]).astype(np.float32)


def unpacked(flat: np.ndarray, like: Params) -> Params:
    """Views of the parts of a flat array."""
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out
