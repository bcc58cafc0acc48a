"""A hidden Markov model of texts.

Tokens are lower-cased words and one end. Words above a share of all training tokens, and above a few, are
symbols of their own, every other word is one of a few classes of endings; within a class a word has its add-one share.
Latent states emit symbols and follow each other; they are trained by Baum-Welch:
each step of the corpus gives expected counts of its own stretches, which are summed over partitions, and
every pass reads all training texts, and passes go on until their summed log likelihood settles
(``SETTLED``). Texts of more than ``STRETCH`` tokens are trained on in stretches, whose first states have a
distribution of their own. The first model is seeded noise around the shares of the symbols. A text's likelihood is exact, by the scaled forward recursion over all of
its tokens. Counts of words cover the whole corpus. Words above a share of all tokens, of which
there can be ``1 / share``, are known in every task; all others meet their counts in a shuffle.

Null and empty texts have one token, the end; repeated rows are scored each; rows without ``doc_id`` are
training rows; without training rows every word is unknown; an empty table gives no rows; other columns
are not read. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgespark.llm.common import lower, mix, numbered, record, signed, steps, stored, text_of, word_hashes, words

STATES, CLASSES = 12, 256
SETTLED = 1e-3  # gain of a pass, as a share of the log likelihood, at which training ends
SYMBOL_SHARE, SYMBOL_LEAST, KNOWN_SHARE = 1e-5, 5, 5e-7
STEP_BYTES = 2 << 20  # of text in a step, which holds a few numbers for each token and state
SYMBOL_BYTES = 2 << 20  # of symbols in a step of training, four a token
STRETCH = 2048  # tokens that one training sequence has at most; the next one follows from any state
PAIRS = 4096  # tokens whose pairs of states are summed in the model's precision
RESCALE = 8  # times after which a forward recursion in double precision is scaled
END = np.uint64(0xE0D0E0D0E0D0E0D1)
_SMOOTH, _FOLLOW = 10.0, 0.1


class Tokens(NamedTuple):
    """The tokens of a step, documents one after another: word hashes, classes, and where each begins."""

    hash: np.ndarray
    kind: np.ndarray
    first: np.ndarray


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    data = lower(data)
    starts, ends, first = words(data, offsets)
    n_docs = len(offsets) - 1
    place = np.arange(len(starts)) + np.repeat(np.arange(n_docs), np.diff(first))
    out = np.full(len(starts) + n_docs, END, np.uint64)
    out[place] = word_hashes(data, starts, ends)
    kind = np.zeros(len(out), np.int32)
    last = data[ends - 1].astype(np.uint64)
    before = data[np.maximum(ends - 2, starts)].astype(np.uint64)
    long = np.minimum((ends - starts) // 4, 4).astype(np.uint64)
    kind[place] = (mix((last << np.uint64(16)) | (before << np.uint64(8)) | long) % np.uint64(CLASSES)).astype(np.int32)
    return Tokens(out, kind, first + np.arange(n_docs + 1))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of a task and how often each occurs, folded as the task goes."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fold():
        h, c, k = (np.concatenate(x) for x in zip(*held))
        unique, at, which = np.unique(h, return_index=True, return_inverse=True)
        return unique, np.bincount(which, c).astype(np.int64), k[at]

    def out(part):
        return record({"word": signed(part[0]), "n": part[1], "kind": part[2]})

    for _, data, offsets in steps(batches):
        t = tokens(data, offsets)
        unique, at, n = np.unique(t.hash, return_index=True, return_counts=True)
        held.append((unique, n, t.kind[at]))
        if sum(len(h) for h, _, _ in held) > 2_000_000:
            held = [fold()]
            if len(held[0][0]) > 1_000_000:
                yield out(held.pop())
    if held:
        yield out(fold())


class Vocabulary(NamedTuple):
    """Words known in every task, ascending by hash: counts and symbols (-1: its class), and class totals."""

    word: np.ndarray
    n: np.ndarray
    symbol: np.ndarray
    total: int
    distinct: int
    class_mass: np.ndarray

    @property
    def symbols(self) -> int:
        return int(self.symbol.max(initial=-1)) + 1

    def look_up(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """The symbol of each token, classes after the words, and its place in ``word``, -1 if not there."""
        at = np.searchsorted(self.word, t.hash)
        at = np.where(at < len(self.word), at, 0)
        at = np.where(self.word[at] == t.hash, at, -1) if len(self.word) else np.full(len(t.hash), -1)
        own = np.where(at >= 0, self.symbol[at], -1) if len(self.word) else at
        return np.where(own >= 0, own, self.symbols + t.kind), at

    def base(self) -> np.ndarray:
        """Share of each symbol in the training tokens, unknown words included."""
        mass = np.concatenate([np.zeros(self.symbols), self.class_mass])
        own = self.symbol >= 0
        mass[self.symbol[own]] = self.n[own] + 1
        return mass / mass.sum()


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    known = counts.where(F.col("n") > total * F.lit(KNOWN_SHARE)).orderBy("word").toArrow()
    word, n = known.column("word").to_numpy().view(np.uint64), known.column("n").to_numpy()
    order = np.argsort(word)
    word, n = word[order], n[order]
    least = max(total * SYMBOL_SHARE, SYMBOL_LEAST - 1)
    own = n > least
    mass = np.ones(CLASSES)  # for unknown words
    rest = counts.where(F.col("n") <= F.lit(least))
    for kind, m in rest.groupBy("kind").agg(F.sum(F.col("n") + 1)).collect():
        mass[kind] += m
    return Vocabulary(word, n, np.where(own, np.cumsum(own) - 1, -1), total, distinct, mass)


class Model(NamedTuple):
    """Distributions of a text's first state, of a stretch's first state, of the next state, of symbols by state."""

    start: np.ndarray
    any: np.ndarray
    follow: np.ndarray
    emit: np.ndarray  # symbols x states


def _by_time(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences by length, longest first; how many are still going at each time; tokens ordered by time."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    going = np.cumsum(np.bincount(length, minlength=1)[::-1])[::-1][1:]
    begin = np.concatenate([[0], np.cumsum(going)])
    time = np.repeat(np.arange(len(going)), going)
    which = np.arange(len(time)) - begin[time]
    return order, begin, first[:-1][order][which] + time


def expected_counts(model: Model, symbol: np.ndarray, first: np.ndarray, begins: np.ndarray):
    """Baum-Welch counts of sequences: of start, any, follow and emit, and the log likelihood.

    ``begins`` tells which sequences begin a text. Tables of the model's precision, sums in double precision.
    """
    order, begin, token = _by_time(first)
    seen = symbol[token].astype(np.intp)  # once, not for each state
    emit = model.emit.take(seen, axis=0)
    kind, states = emit.dtype, emit.shape[1]
    ones, alpha, scale = np.ones(states, kind), np.empty_like(emit), np.empty(len(seen), kind)
    at = begin.tolist()
    steps_ = len(at) - 1
    texts = begins[order][: at[1] if steps_ else 0]
    for t in range(steps_):
        now = alpha[at[t] : at[t + 1]]
        if t:
            np.matmul(alpha[at[t - 1] : at[t - 1] + len(now)], model.follow, out=now)
        else:
            now[:] = np.where(texts[:, None], model.start, model.any)
        now *= emit[at[t] : at[t + 1]]
        s = np.matmul(now, ones, out=scale[at[t] : at[t + 1]])
        now /= s[:, None]
    # Backward: `emit` becomes emission times beta over scale, what a state sees of the next token; `alpha` becomes gamma.
    emit /= scale[:, None]
    back, beta = model.follow.T.copy(), np.ones_like(emit)
    for t in range(steps_ - 2, -1, -1):
        later = emit[at[t + 1] : at[t + 2]]
        a, b = at[t], at[t] + len(later)
        emit[a:b] *= np.matmul(later, back, out=beta[a:b])
    # A token's last one lies as far before it as there are sequences at that time.
    follow, going = np.zeros((states, states)), np.diff(begin)
    last = np.arange(begin[1], begin[-1]) - np.repeat(going[:-1], going[1:]) if steps_ else np.zeros(0, np.int64)
    for k in range(0, len(last), PAIRS):
        follow += alpha.take(last[k : k + PAIRS], axis=0).T @ emit[begin[1] + k : begin[1] + k + len(last[k : k + PAIRS])]
    follow *= model.follow
    alpha *= beta
    counts = np.empty(model.emit.shape)
    for k in range(states):
        counts[:, k] = np.bincount(seen, alpha[:, k], minlength=len(counts))
    head = alpha[: len(texts)][texts].sum(0, dtype=np.float64)
    return Model(head, counts.sum(0), follow, counts), float(np.log(scale).sum(dtype=np.float64))


def log_likelihoods(model: Model, symbol: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The natural log of each sequence's probability, by the scaled forward recursion."""
    order, begin, token = _by_time(first)
    out = np.zeros(len(first) - 1)
    seen, scale, ones, at = symbol[token], np.ones(len(token)), np.ones(model.emit.shape[1]), begin.tolist()
    emit, room, last = model.emit.take(seen, axis=0), np.empty((at[1] if len(at) > 1 else 0, len(ones))), len(at) - 2
    for t in range(len(at) - 1):
        a, b = at[t], at[t + 1]
        now = emit[a:b]
        now *= np.matmul(state[: b - a], model.follow, out=room[: b - a]) if t else model.start
        state = now
        # Where a sequence ends, and every few times: so few factors stay far from the least double.
        if t % RESCALE == 0 or t == last or at[t + 2] - b < b - a:
            now /= np.matmul(now, ones, out=scale[a:b])[:, None]
    # Tokens lie by time, sequences in one order at every time: a token's sequence is its place there.
    which = np.arange(len(scale)) - np.repeat(begin[:-1], np.diff(begin))
    out[order] = np.bincount(which, np.log(scale), minlength=len(out))
    return out


def from_counts(c: Model, base: np.ndarray) -> Model:
    one = lambda x: (x + _FOLLOW) / (x + _FOLLOW).sum(-1, keepdims=True)
    emit = c.emit + _SMOOTH * base[:, None]
    return Model(one(c.start), one(c.any), one(c.follow), emit / emit.sum(0))


def _stretches(t: Tokens, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Where sequences of at most ``most`` tokens begin, and which of them begin a text."""
    pieces = -(-np.diff(t.first) // most)
    at = np.repeat(t.first[:-1], pieces) + most * (
        np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    )
    return np.append(at, t.first[-1]), np.isin(at, t.first[:-1])


def first_model(vocab: Vocabulary, states: int) -> Model:
    """Seeded noise around the shares of the symbols."""
    base, rng = vocab.base(), np.random.default_rng(7)
    noise = rng.gamma(1.0, 1.0, (len(base), states)) + 0.2
    emit = base[:, None] * noise
    follow = np.full((states, states), 1.0 / states) + 3 * np.eye(states)
    return Model(np.full(states, 1 / states), np.full(states, 1 / states), follow / follow.sum(1, keepdims=True), emit / emit.sum(0))


def _encode(vocab: Vocabulary):
    """The symbols of each text, four bytes each, so that no pass looks words up again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in steps(batches, limit=STEP_BYTES):
            t = tokens(data, offsets)
            symbol = vocab.look_up(t)[0].astype(np.int32)
            yield record({"symbols": pa.array([symbol[a:b].tobytes() for a, b in zip(t.first[:-1], t.first[1:])], pa.binary())})

    return run


def _expect(model: Model):
    """Expected counts of a task: ``(kind, state, to, n)``; kinds 0 start, 1 any, 2 follow, 3 emit, 4 log likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, log, half = None, 0.0, Model(*(x.astype(np.float32) for x in model))
        for _, data, offsets in steps(batches, "symbols", SYMBOL_BYTES):
            first = offsets // 4
            t = Tokens(data.view(np.int32), data[:0], first)
            counts, gain = expected_counts(half, t.hash, *_stretches(t, STRETCH))
            total = counts if total is None else Model(*(a + b for a, b in zip(total, counts)))
            log += gain
        if total is None:
            return
        tables = (total.start[:, None], total.any[:, None], total.follow, total.emit.T, np.array([[log]]))
        for kind, table in enumerate(tables):
            state, to = np.nonzero(table)
            yield record(
                {
                    "kind": np.full(len(to), kind, np.int32),
                    "state": state.astype(np.int32),
                    "to": to.astype(np.int32),
                    "n": table[state, to],
                }
            )

    return run


def train(texts: DataFrame, vocab: Vocabulary, states: int = STATES, settled: float = SETTLED) -> Model:
    """Baum-Welch over all of ``texts`` (a column ``text``) until a pass gains at most ``settled`` of the log likelihood."""
    coded = stored(texts.select("text").mapInArrow(_encode(vocab), "symbols binary"))
    model, base, before = first_model(vocab, states), vocab.base(), -math.inf
    while True:
        parts = coded.mapInArrow(_expect(model), "kind int, state int, to int, n double")
        # At most (symbols + states + 2) * states + 1 rows: symbols are bounded by their share.
        sums = parts.groupBy("kind", "state", "to").agg(F.sum("n").alias("n")).toArrow()
        kind, state, to, n = (sums.column(c).to_numpy() for c in ("kind", "state", "to", "n"))
        tables = [np.zeros((states, w)) for w in (1, 1, states, len(base))]
        for i, table in enumerate(tables):
            table[state[kind == i], to[kind == i]] = n[kind == i]
        model = from_counts(Model(tables[0][:, 0], tables[1][:, 0], tables[2], tables[3].T), base)
        log = float(n[kind == 4].sum())
        if log - before <= settled * abs(log):
            return model
        before = log


_PARTS = "_row long, n_tokens long, known long, base double, score double, rare array<struct<word:long,n:int>>"


def _score(vocab: Vocabulary, model: Model):
    """What a task knows of each text's scores, and the words whose counts it doesn't know."""
    log_all = math.log10(vocab.total + vocab.distinct + 1)
    log_mass = np.log10(vocab.class_mass)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches, limit=STEP_BYTES):
            t = tokens(data, offsets)
            symbol, at = vocab.look_up(t)
            n = np.diff(t.first)
            counted = np.append(np.log10(vocab.n + 1.0), 0.0)[at]  # -1, unknown here, adds nothing yet
            in_class = symbol >= vocab.symbols
            of = lambda x: np.add.reduceat(x, t.first[:-1])
            score = log_likelihoods(model, symbol, t.first) / math.log(10)
            score += of(np.where(in_class, counted - log_mass[t.kind], 0.0))
            doc = np.repeat(np.arange(len(n)), n)
            rare = np.flatnonzero(at < 0)
            order = rare[np.lexsort((t.hash[rare], doc[rare]))]
            head = np.ones(len(order), bool)
            head[1:] = (doc[order[1:]] != doc[order[:-1]]) | (t.hash[order[1:]] != t.hash[order[:-1]])
            heads = np.flatnonzero(head)
            times = np.diff(np.append(heads, len(order))).astype(np.int32)
            heads = order[heads]
            bounds = np.searchsorted(doc[heads], np.arange(len(n) + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(signed(t.hash[heads])), pa.array(times)], ["word", "n"])
            yield record(
                {
                    "_row": rows.column(0),
                    "n_tokens": n,
                    "known": of((at >= 0).astype(np.int64)),
                    "base": of(counted) - n * log_all,
                    "score": score,
                    "rare": pa.ListArray.from_arrays(pa.array(bounds), pairs),
                }
            )

    return run


def scores(docs: DataFrame, train_on: Column, states: int = STATES, settled: float = SETTLED) -> DataFrame:
    """Per row of ``docs`` (a stored table): ``doc_id, trained, n_tokens, n_known, train_tokens, base_score, score``,
    both scores log10 probabilities; ``train_on`` tells the training rows."""
    rows = numbered(docs).select("_row", "doc_id", F.coalesce(train_on, F.lit(True)).alias("trained"), text_of().alias("text"))
    texts = rows.where("trained").select("text")
    counted = texts.mapInArrow(_counts, "word long, n long, kind int")
    counts = stored(counted.groupBy("word").agg(F.sum("n").alias("n"), F.min("kind").alias("kind")))
    vocab = vocabulary(counts)
    model = train(texts, vocab, states, settled)
    parts = stored(rows.select("_row", "text").mapInArrow(_score(vocab, model), _PARTS))
    # No rare word has more than KNOWN_SHARE of all tokens, so no key of this join is large.
    rare = parts.select("_row", F.explode("rare").alias("r")).select("_row", F.col("r.word").alias("word"), F.col("r.n").alias("times"))
    rest = counts.where(F.col("n") <= vocab.total * F.lit(KNOWN_SHARE)).select("word", "n")
    met = rare.join(rest, "word").groupBy("_row").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("gain")
    )
    out = parts.drop("rare").join(met, "_row", "left").na.fill({"more": 0, "gain": 0.0})
    out = rows.select("_row", "doc_id", "trained").join(out, "_row")
    return out.select(
        "doc_id",
        "trained",
        "n_tokens",
        (F.col("known") + F.col("more")).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("gain")).alias("base_score"),
        (F.col("score") + F.col("gain")).alias("score"),
    )
