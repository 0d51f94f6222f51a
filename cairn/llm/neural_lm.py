"""A log-bilinear language model, trained in numpy by noise-contrastive estimation, and exact counts beneath it.

The model's words are all that training texts hold MIN_COUNT times or more, up to MODEL_WORDS of the most frequent, and the end. Each has an input
and an output vector. The CONTEXT tokens before a token, each through its place's own diagonal, sum to a predicted vector. A probability has
two steps, so that normalising takes about the square root of the words: over the most frequent words, one class for each run of words of like
frequency, and GROUPS groups of all other words by their last two bytes; then over the words of the class. Only a word of a group
takes its smoothed share of the group's count. Counts cover every training text. Every training token is a target once: in a few rounds
each task continues from the model so far on its own texts, TASK_TOKENS of them or more, and the tasks' parameters are averaged by tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import arrow_schema, lean, stage
from cairn.llm.token_files import slices
from cairn.llm.words import spans_hash, word_spans

MODEL_WORDS, MIN_COUNT, SINGLES, CLASSES, GROUPS = 1 << 14, 32, 48, 96, 48
CONTEXT, WIDTH = 8, 16
SMOOTH = 0.1
#: The most frequent words, whose counts every task holds; the rest are looked up by a join.
HEAD = 1 << 18
#: A batch is RUNS runs of neighbouring tokens.
BATCH, RUNS, NOISE, CLASS_NOISE, RATE, SEED = 1024, 16, 64, 6, 0.25, 7
#: Rounds of training take texts up to these shares of all, by hash; every text is in one.
ROUNDS = (0.2, 1.0)
#: Distinct tokens that a counting task holds before it passes them on.
HELD_COUNTS = 1_000_000
#: A task learns from so many tokens at least, where there are as many: fewer tasks make less of an average.
TASK_TOKENS = 2_000_000
#: Texts whose bytes are made into tokens at once: numbers of a few hundred kilobytes of text stay near the core.
NEAR_TEXTS = 64
#: Numbers of a model's piece, as models are averaged.
PIECE = 1 << 16
END_HASH = np.uint64(0x5BD1E995A3C59AC3)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and groups of all texts' tokens in a row, each text's end among them, and where texts begin and the last ends."""
    parts = [_tokens(texts[a : a + NEAR_TEXTS]) for a in range(0, max(1, len(texts)), NEAR_TEXTS)]
    h, group, upto = zip(*parts, strict=True)
    before = np.cumsum([0, *(len(x) for x in h)])
    return np.concatenate(h), np.concatenate(group), np.concatenate([[0], *(u[1:] + b for u, b in zip(upto, before[:-1], strict=True))])


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    joined, starts, ends, upto = word_spans([t.lower() for t in texts])
    h = spans_hash(joined, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    last = joined[ends - 1].astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    before = np.where(ends - starts > 1, joined[ends - 2], 0).astype(np.int64) if len(starts) else last
    group = (last * 31 + before * 17 + (before >> 3)) % GROUPS
    at = upto[1:]  # an end goes in after each text's words
    return np.insert(h, at, END_HASH), np.insert(group, at, 0), upto + np.arange(len(upto))


class Table:
    """Values by 64-bit hash, in an open table that numpy probes side by side."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.values, self.used = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, values.dtype), np.zeros(1 << self.bits, bool)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = ~self.used[at]
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[free[first]]
            self.keys[at[first]], self.values[at[first]], self.used[at[first]] = keys[todo[first]], values[todo[first]], True
            left = np.ones(len(todo), bool)
            left[first] = False
            todo, at = todo[left], at[left]
            at = np.where(self.used[at], (at + 1) % len(self.keys), at)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, default) -> np.ndarray:
        out, todo, at = np.full(len(keys), default, self.values.dtype), np.arange(len(keys)), self._slot(keys)
        while len(todo):
            hit = self.used[at] & (self.keys[at] == keys[todo])
            out[todo[hit]] = self.values[at[hit]]
            on = self.used[at] & ~hit
            todo, at = todo[on], (at[on] + 1) % len(self.keys)
        return out


@dataclass
class Words:
    """The model's words by rank, 0 the most frequent, then its groups, then START, which stands before a text's first token.

    The first `singles` words are outputs of their own; the others are in runs of `run`, each run an output; the groups are the last outputs.
    """

    words: int
    singles: int
    run: int

    @classmethod
    def of(cls, words: int) -> Words:
        singles = min(words, SINGLES)
        return cls(words, singles, max(1, -(-(words - singles) // CLASSES)))

    @property
    def start(self) -> int:
        return self.words + GROUPS

    @property
    def classes(self) -> int:
        return -(-(self.words - self.singles) // self.run)

    @property
    def outputs(self) -> int:
        return self.singles + self.classes + GROUPS

    def output(self, ids: np.ndarray) -> np.ndarray:
        """The output of each word or group."""
        inner = self.singles + (ids - self.singles) // self.run
        return np.where(ids < self.singles, ids, np.where(ids < self.words, inner, ids - self.words + self.singles + self.classes))

    def span(self, c):
        """First word of class c, and the first after it."""
        lo = self.singles + c * self.run
        return lo, np.minimum(lo + self.run, self.words)


@dataclass
class Counts:
    """What the training texts hold: tokens, distinct tokens, the head's words by hash with their counts and ids, and counts of ids and smoothed sizes of groups."""

    total: int
    distinct: int
    words: Words
    model: Table
    head: Table
    head_n: np.ndarray
    head_id: np.ndarray
    n: np.ndarray
    sizes: np.ndarray


def distinct(keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in the order that sorts them, and where each begins there."""
    keys = keys.take(order)
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, np.int64)
    return keys.take(first), first


def training(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 != 0, F.lit(True))


def token_counts(texts: DataFrame) -> DataFrame:
    """(h, g, n) per distinct token of the column t of texts: its hash, group and count."""

    def add(parts: list) -> list:
        """Counts (h, g, n) of several slices as those of one."""
        h, g, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h)
        h, first = distinct(h, order)
        return [h, g.take(order.take(first)), np.add.reduceat(n.take(order), first)]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, row = [], 0
        for b in slices(batches, 0, 2048, 4 << 20):
            h, g, _ = tokens([t or b"" for t in b.column(0).cast(pa.binary()).to_pylist()])
            order = np.argsort(h)  # equal tokens have equal groups, whichever comes first
            u, first = distinct(h, order)
            held.append([u, g.take(order.take(first)).astype(np.int16), np.diff(first, append=len(h))])
            row += len(u)
            if row > HELD_COUNTS:
                held = [add(held)]
                row = len(held[0][0])
                if row > HELD_COUNTS // 2:
                    yield _count_batch(held.pop())
                    row = 0
        if held:
            yield _count_batch(add(held))

    return texts.select("t").mapInArrow(run, "h long, g short, n long").groupBy("h").agg(F.first("g").alias("g"), F.sum("n").alias("n"))


def _count_batch(part: list) -> pa.RecordBatch:
    h, g, n = part
    return pa.record_batch([pa.array(h.view(np.int64)), pa.array(g), pa.array(n)], names=["h", "g", "n"])


def gather(counts: DataFrame) -> Counts:
    """The bounded part of staged token_counts: at most HEAD rows and a row a group come to the driver."""
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    top = 4096
    by_n = dict(counts.groupBy(F.least("n", F.lit(top)).alias("n")).count().collect())
    least, held = top, by_n.get(top, 0)
    while least > 1 and held + by_n.get(least - 1, 0) <= HEAD:
        least -= 1
        held += by_n.get(least, 0)
    frequent = counts.where(F.col("n") >= least)
    if held > HEAD:
        frequent = frequent.orderBy(F.desc("n"), "h").limit(HEAD)
    rows = frequent.select("h", "g", "n").toArrow()
    h, g, n = (np.asarray(rows.column(c).combine_chunks()) for c in ("h", "g", "n"))
    h = h.view(np.uint64)
    order = np.lexsort((h, -n))
    h, g, n = h[order], g[order], n[order]
    words = Words.of(int(min(MODEL_WORDS, (n >= MIN_COUNT).sum())))
    used = np.zeros(words.start, np.int64)
    sizes = np.zeros(GROUPS)
    for k, all_n, many in counts.groupBy("g").agg(F.sum("n"), F.count("*")).collect():
        used[words.words + k], sizes[k] = all_n, all_n + SMOOTH * many
    top = slice(0, words.words)
    np.subtract.at(used, words.words + g[top], n[top])
    np.subtract.at(sizes, g[top], n[top] + SMOOTH)
    used[top] = n[top]
    ids = np.where(np.arange(len(h)) < words.words, np.arange(len(h)), -1)
    sizes = np.maximum(sizes, 0) + SMOOTH  # room for a word that no training text has
    return Counts(int(total or 0), int(distinct), words, Table(h[top], ids[top]), Table(h, np.arange(len(h))), np.append(n, 0), np.append(ids, -1), used, sizes)


def wide(place: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each place of the context the rows that stand there, several side by side in a line as numpy has a cost a line, and the place's diagonal as often."""
    n = len(vectors) - CONTEXT
    many = math.gcd(n, 64)
    return np.concatenate([place] * many, 1), [vectors[a : a + n].reshape(n // many, many * WIDTH) for a in range(CONTEXT - 1, -1, -1)]


class Model:
    """in_: input vectors, place: a diagonal for each place of the context, out and bias by output, own and own_bias by word; all float32.

    squares: what AdaGrad has seen, a number for each row of each.
    """

    def __init__(self, words: Words, parts: list[np.ndarray], squares: list[np.ndarray]):
        self.words, self.parts, self.squares = words, parts, squares
        self.in_, self.place, self.out, self.bias, self.own, self.own_bias = parts

    @staticmethod
    def shapes(words: Words) -> list[tuple]:
        return [(words.start + 1, WIDTH), (CONTEXT, WIDTH), (words.outputs, WIDTH), (words.outputs,), (words.words, WIDTH), (words.words,)]

    @classmethod
    def start(cls, words: Words, n: np.ndarray) -> Model:
        r, shapes = np.random.default_rng(SEED), cls.shapes(words)
        by_output = np.bincount(words.output(np.arange(words.start)), n + 1.0, words.outputs)
        parts = [r.normal(0, 0.3, shapes[0]), np.full(shapes[1], 0.3), r.normal(0, 0.1, shapes[2]), np.log(by_output / by_output.sum()), r.normal(0, 0.1, shapes[4]), np.zeros(shapes[5])]
        own = n[: words.words] + 1.0
        for c in range(words.classes):
            lo, hi = words.span(c)
            parts[5][lo:hi] = np.log(own[lo:hi] / own[lo:hi].sum())
        return cls(words, [x.astype(np.float32) for x in parts], [np.full(s[0], 0.05, np.float32) for s in shapes])

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.parts, *self.squares)])

    @classmethod
    def of(cls, words: Words, flat: np.ndarray) -> Model:
        parts, at = [], 0
        shapes = cls.shapes(words)
        for s in [*shapes, *((s[0],) for s in shapes)]:
            n = int(np.prod(s))
            parts.append(np.array(flat[at : at + n], np.float32).reshape(s))
            at += n
        return cls(words, parts[:6], parts[6:])

    def predicted(self, place: np.ndarray, seen: list[np.ndarray]) -> np.ndarray:
        """The predicted vector at each row of input vectors but the first CONTEXT; of what wide() gives."""
        q = seen[0] * place[0]
        more = np.empty_like(q)
        for i in range(1, CONTEXT):
            q += np.multiply(seen[i], place[i], out=more)
        return q.reshape(-1, WIDTH)

    def log_probabilities(self, stream: np.ndarray) -> np.ndarray:
        """The natural logarithm of the probability of each word or group of a stream() after its context; over all of them it sums to 1. At START it means nothing."""
        w, ids = self.words, np.minimum(stream[CONTEXT:], self.words.start - 1)
        # a 1 stands after each vector, for the bias
        result, q = np.empty(len(ids), np.float64), np.ones((len(ids), WIDTH + 1), np.float32)
        out, output = np.concatenate([self.out.T, self.bias[None]]), w.output(ids)
        for a in range(0, len(ids), 1024):
            q[a : a + 1024, :WIDTH] = self.predicted(*wide(self.place, self.in_.take(stream[a : a + 1024 + CONTEXT], 0)))
            result[a : a + 1024] = _log_softmax(q[a : a + 1024], out, output[a : a + 1024])
        inner = np.nonzero((ids >= w.singles) & (ids < w.words))[0]
        c = (ids[inner] - w.singles) // w.run
        order = np.argsort(c.astype(np.int16), kind="stable")
        inner, c = inner[order], c[order]
        ends = np.searchsorted(c, np.arange(w.classes + 1)).tolist()
        own_ids, share = ids.take(inner), np.empty(len(inner), np.float64)
        for k in range(w.classes):
            lo, hi = w.span(k)
            own = np.concatenate([self.own[lo:hi].T, self.own_bias[None, lo:hi]])
            for a in range(ends[k], ends[k + 1], 1024):
                b = min(a + 1024, ends[k + 1])
                share[a:b] = _log_softmax(q.take(inner[a:b], 0), own, own_ids[a:b] - lo)
        result[inner] += share
        return result


def _log_softmax(q: np.ndarray, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log softmax of each row of q @ m at one column."""
    s = q @ m
    own = s[np.arange(len(at)), at].astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        total = np.exp(s, out=s) @ np.ones(s.shape[1], np.float32)
    if not np.isfinite(total).all() or not (total > 0).all():
        s = q @ m
        top = s.max(1)
        return own - top - np.log(np.exp(s - top[:, None]).sum(1))
    return own - np.log(total)


def token_ids(h: np.ndarray, group: np.ndarray, words: Words, model: Table) -> np.ndarray:
    ids = model.get(h, -1)
    return np.where(ids >= 0, ids, words.words + group)


def stream(ids: np.ndarray, upto: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids in a row with CONTEXT times `start` before each text, so that a token's context is what stands before it; and the place of each token, less CONTEXT."""
    n = len(upto) - 1
    at = np.arange(len(ids)) + CONTEXT * np.repeat(np.arange(n), np.diff(upto))
    out = np.full(len(ids) + CONTEXT * n, start, np.int32)
    out[at + CONTEXT] = ids
    return out, at


def batches_of(row: np.ndarray, start: int, seed: int) -> Iterator[np.ndarray]:
    """The row's tokens in batches of RUNS runs in random order, a run a line with the CONTEXT tokens before it; the last is filled with start."""
    n = BATCH // RUNS
    many = max(1, -(-(len(row) - CONTEXT) // n))
    row = np.concatenate([row, np.full(CONTEXT + many * n - len(row), start, np.int32)])
    lines = np.lib.stride_tricks.sliding_window_view(row, n + CONTEXT)[::n]
    order = np.random.default_rng(seed).permutation(many)
    for a in range(0, many, RUNS):
        yield lines[order[a : a + RUNS]]


class Targets:
    """Rows that go to places of a part, some to the same: the distinct places, and the sum of what goes to each."""

    def __init__(self, at: np.ndarray, size: int):
        at = at.astype(np.uint16) if size <= 1 << 16 else at  # those are sorted by radix
        order = np.argsort(at, kind="stable")
        at = at.take(order)
        edge = np.ones(len(at) + 1, bool)
        np.not_equal(at[1:], at[:-1], out=edge[1:-1])
        # most places get one row; only the others' rows are summed
        self.rest = order.take((~(edge[1:] & edge[:-1])).nonzero()[0])
        edge = edge.nonzero()[0]
        first, many = edge[:-1], edge[1:] - edge[:-1]
        self.at, self.first, self.more = at.take(first).astype(np.int64), order.take(first), (many > 1).nonzero()[0]
        many = many.take(self.more)
        self.begin = many.cumsum() - many

    def sums(self, rows: np.ndarray) -> np.ndarray:
        g = rows.take(self.first, 0)
        if len(self.more):
            rest = rows.take(self.rest, 0)
            if rest.ndim > 1:  # two numbers at a time
                g[self.more] = np.add.reduceat(rest.view(np.complex64), self.begin).view(np.float32)
            else:
                g[self.more] = np.add.reduceat(rest, self.begin)
        return g


class Trainer:
    """AdaGrad steps on the noise-contrastive objective: an output against NOISE draws that a batch shares, a word of a class against CLASS_NOISE of its class."""

    def __init__(self, model: Model, n: np.ndarray, seed: int = SEED):
        self.model, self.rng = model, np.random.default_rng(seed)
        w = model.words
        p = np.bincount(w.output(np.arange(w.start)), np.maximum(n, 0.5), w.outputs)
        self.noise_p = p / p.sum()
        self.noise_upto = np.cumsum(self.noise_p) / np.cumsum(self.noise_p)[-1]
        self.log_noise = np.log(NOISE * self.noise_p).astype(np.float32)
        # of every word: its output, the first word of its class and how many the class has
        every = np.arange(w.start + 1)
        lo, hi = w.span((every - w.singles) // w.run)
        self.output, self.lo, self.many = w.output(every), lo, np.maximum(hi - lo, 1)
        self.log_share = np.log(CLASS_NOISE / self.many).astype(np.float32)

    def step(self, lines: np.ndarray) -> None:
        """One batch, as batches_of() cuts it; where START stands there is nothing to learn."""
        m, w = self.model, self.model.words
        row = lines.ravel()
        x = m.in_.take(row, 0)
        # the runs stand in one row; at the places between two there is no target
        target = lines != w.start
        target[:, :CONTEXT] = False
        there = np.nonzero(target.ravel())[0]
        ids, there = row.take(there), there - CONTEXT
        place, seen = wide(m.place, x)
        q = m.predicted(place, seen).take(there, 0)
        q_1 = np.ones((len(q), WIDTH + 1), np.float32)  # a 1 after each vector, for the bias
        q_1[:, :WIDTH] = q
        at = self.output.take(ids)
        noise = self.noise_upto.searchsorted(self.rng.random(NOISE), side="right")
        out, drawn = m.out.take(at, 0), m.out.take(noise, 0)
        less = m.bias - self.log_noise
        g_own = _sigmoid(np.einsum("bw,bw->b", q, out) + less.take(at)) - 1
        g_other = _sigmoid(q_1 @ np.concatenate([drawn.T, less.take(noise)[None]]))
        dq = g_other @ drawn
        dq += np.multiply(out, g_own[:, None], out=out)
        to = Targets(np.concatenate([at, noise]), w.outputs)
        g_drawn = g_other.T @ q_1
        self._move(2, to.at, to.sums(np.concatenate([g_own[:, None] * q, g_drawn[:, :WIDTH]])))
        self._move(3, to.at, to.sums(np.concatenate([g_own, g_drawn[:, WIDTH]])))
        inner = np.nonzero((ids >= w.singles) & (ids < w.words))[0]
        if len(inner):
            own, qi = ids.take(inner), q.take(inner, 0)
            lo, many = self.lo.take(own)[:, None], self.many.take(own)[:, None]
            both = np.empty((len(inner), 1 + CLASS_NOISE), np.int64)
            both[:, 0] = own
            draws = (self.rng.random((len(inner), CLASS_NOISE), np.float32) * many.astype(np.float32)).astype(np.int64)
            both[:, 1:] = np.minimum(draws, many - 1) + lo
            vectors = m.own.take(both, 0)
            s = np.einsum("bw,bkw->bk", qi, vectors)
            s += m.own_bias.take(both)
            s -= self.log_share.take(own)[:, None]
            g = _sigmoid(s)
            g[:, 0] -= 1
            _put(dq, inner, dq.take(inner, 0) + np.matmul(g[:, None], vectors)[:, 0])
            rows, g = np.repeat(qi, 1 + CLASS_NOISE, 0), g.ravel()
            rows *= g[:, None]
            to = Targets(both.ravel(), w.words)
            self._move(4, to.at, to.sums(rows))
            self._move(5, to.at, to.sums(g))
        back, g_in = np.zeros((len(row) - CONTEXT, WIDTH), np.float32), np.zeros_like(x)
        _put(back, there, dq)
        gets, back = wide(m.place, g_in)[1], back.reshape(seen[0].shape)
        g_place, more = np.empty_like(place), np.empty_like(back)
        for i in range(CONTEXT):
            gets[i] += np.multiply(back, place[i], out=more)
            g_place[i] = np.einsum("nw,nw->w", back, seen[i])
        to = Targets(row, w.start + 1)
        self._move(0, to.at, to.sums(g_in))
        self._move(1, np.arange(CONTEXT), g_place.reshape(CONTEXT, -1, WIDTH).sum(1))

    def _move(self, k: int, at: np.ndarray, g: np.ndarray) -> None:
        """A step of part k against what its rows get, each once; g is used up."""
        g *= np.float32(32 / BATCH)
        x, s = self.model.parts[k], self.model.squares[k]
        now = s.take(at) + ((g * g) @ np.full(WIDTH, 1 / WIDTH, np.float32) if g.ndim > 1 else g * g)
        np.put(s, at, now)
        rate = RATE / np.sqrt(now)
        g *= rate[:, None] if g.ndim > 1 else rate
        now = x.take(at, 0)
        now -= g
        _put(x, at, now)


def _put(x: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """x[at] = rows; a row of a table is copied as one value."""
    if x.ndim > 1:
        x, rows = (y.view(f"V{y.itemsize * y.shape[1]}").reshape(-1) for y in (x, rows))
    np.put(x, at, rows)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def train(texts: DataFrame, counts: Counts) -> Model:
    """The model after all ROUNDS over texts (column t). In each the tasks' models are averaged by how many tokens they have seen, piece by piece; a model's length of numbers comes to the driver."""
    words, table, n = counts.words, counts.model, counts.n
    model = Model.start(words, n)
    if not counts.total:
        return model
    share = F.pmod(F.xxhash64(F.coalesce("t", F.lit(""))), F.lit(1000))
    before = 0
    for upto_share in ROUNDS:
        part = texts.where((share >= before) & (share < int(1000 * upto_share))).select("t")
        part = part.coalesce(max(1, int(counts.total * (upto_share - before / 1000)) // TASK_TOKENS))
        before = int(1000 * upto_share)
        model = _round(part, model.flat(), words, table, n)
    return model


def _round(texts: DataFrame, flat: np.ndarray, words: Words, table: Table, n: np.ndarray) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, seen = Trainer(Model.of(words, flat), n), 0
        for b in slices(batches, 0, 2048, 2 << 20):
            h, g, upto = tokens([t or b"" for t in b.column(0).cast(pa.binary()).to_pylist()])
            for lines in batches_of(stream(token_ids(h, g, words, table), upto, words.start)[0], words.start, seen):
                trainer.step(lines)
            seen += len(h)
        if seen:
            now = trainer.model.flat()
            parts = [now[a : a + PIECE].astype("<f4").tobytes() for a in range(0, len(now), PIECE)]
            yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array([float(seen)] * len(parts)), pa.array(parts, pa.binary())], names=["k", "n", "x"])

    def mean(pieces: pa.Table) -> pa.Table:
        total, weight = 0.0, 0.0
        for batch in pieces.to_batches(16):
            for w, x in zip(batch.column("n").to_pylist(), batch.column("x").to_pylist(), strict=True):
                total, weight = total + w * np.frombuffer(x, "<f4").astype(np.float64), weight + w
        return pa.table({"k": pieces.column("k").slice(0, 1), "n": pa.array([weight]), "x": pa.array([(total / weight).astype("<f4").tobytes()], pa.binary())}).cast(schema)

    ddl = "k int, n double, x binary"
    schema = arrow_schema(ddl)
    models = texts.mapInArrow(run, ddl)
    # first over salted parts, so that no task holds a piece of every model
    salted = models.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = salted.groupBy("k", "salt").applyInArrow(lambda t: mean(t.select(["k", "n", "x"])), ddl)
    rows = some.groupBy("k").applyInArrow(mean, ddl).select("k", "x").collect()
    return Model.of(words, np.concatenate([np.frombuffer(bytes(x), "<f4") for _, x in sorted(rows)]) if rows else flat)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; both scores are base-10 logarithms.

    Texts whose crc32(id) mod 10 is 0 are held out of counts and training; a null id is not. A null text is empty: its one token is its
    end. Rows that repeat are texts of their own. Without training texts all counts are 0 and the model is where it starts.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    learn = docs.where(training(id_col)).select(F.col(text_col).alias("t"))
    words = stage(token_counts(learn))
    counts = gather(words)
    model = train(learn, counts)
    given, head, head_id, log_sizes = counts.words, counts.head, counts.head_id, np.log10(counts.sizes)
    head_own, head_tail = np.log10(counts.head_n + SMOOTH), counts.head_n == 0
    flat = model.flat()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(given, flat)
        for b in slices(batches, 2, 1024, 1 << 20):
            h, g, upto = tokens([t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()])
            at = head.get(h, -1)  # -1 is also where the appended count 0 and id -1 are
            ids, own, tail = head_id[at], head_own[at], head_tail[at]
            grouped = ids < 0
            ids = np.where(grouped, given.words + g, ids)
            row, place = stream(ids, upto, given.start)
            context = model.log_probabilities(row)[place] / np.log(10) - np.where(grouped, log_sizes[g], 0.0)
            sums = lambda x: np.add.reduceat(x, upto[:-1])  # noqa: E731  every text has its end
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sums(tail.astype(np.int64)))]).astype(np.int32), h[tail].view(np.int64))
            base = sums(np.where(tail, 0.0, own))
            score = sums(context + np.where(grouped & ~tail, own, 0.0))
            cols = [*b.columns[:2], pa.array(np.diff(upto)), pa.array(sums((~tail).astype(np.int64))), pa.array(base), pa.array(score), lists]
            yield pa.record_batch(cols, names=["uid", "id", "n_tokens", "n_known", "base", "score", "tail"])

    texts = stage(rows.mapInArrow(run, "uid long, id long, n_tokens long, n_known long, base double, score double, tail array<long>"))
    rare = texts.select("uid", F.explode("tail").alias("h")).join(words.select("h", "n").hint("merge"), "h", "left")
    rare = rare.groupBy("uid").agg(F.count("n").alias("more"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("rest"))
    norm = float(np.log10(counts.total + SMOOTH * (counts.distinct + 1)))
    out = texts.drop("tail").join(rare, "uid", "left").fillna(0, ["more", "rest"])
    return out.select(
        F.col("id").alias("doc_id"), (~training("id")).alias("held_out"), "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rest") - F.col("n_tokens") * norm).alias("base_score"), (F.col("score") + F.col("rest")).alias("score"),
    )
