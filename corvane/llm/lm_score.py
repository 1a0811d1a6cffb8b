"""Language-model scores: a log-bilinear model trained in numpy by noise-contrastive estimation.

Counts: every training token is counted, by a 64-bit hash of the word, with
partial sums per task; beside the hash goes the word's spelling, four hashed
trigrams.

Words: each of the ``head_words`` most frequent words is an event of its own.
Rarer words share one event for each suffix; in it a word has (c + 1) / Z, and
all words that training never saw have 1 / Z together.

Model: a word's vector is the sum of the vectors of its trigrams and, for the
most frequent words (their number grows with the vocabulary), one of its own,
apart for words that predict and words that are predicted.  The two words
before, and the mean of the words before, predict r = a1 x1 + a2 x2 + a3 m.
The most frequent words are classes of their own, all others are dealt to
``SHARED`` classes, and those to groups of about ``MEMBERS`` events, as many as
the vocabulary needs: P(word) = P(class | r) P(group | class) P(word | group, r).
Class and word have scores r . q + b, trained by noise contrast: classes against
draws by their counts, words against even draws from their group.  Groups are
dealt at random, so that no context prefers one, and have their share.

Training: each token is used once, in ``ROUNDS`` of growing parts of the texts.
In a round tasks start from the same parameters and train apart; a tree of sums
averages each row of the parameters by the gradient that it met in each task.
There is one task for each ``TASK_TOKENS`` training tokens begun, of which it meets
a round's share: an eighth in the first, five eighths in the last.  A cut into
many small tasks learns less than one task does.

Scores: batched matrix products give both normalisers for every token, so its
log-probabilities are normalised over all words.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.llm import store
from corvane.llm.kernel import BLANK_WORDS, blocks, hash_word, runs, tidy

#: The token after each text; no word holds a blank.
END = hash_word(b" end ")
#: Words that are events of their own; the counts of rarer ones are joined.
HEAD_WORDS = 1 << 19
#: Words that are classes of their own, classes of the others, events of a group of these.
TOP, SHARED, MEMBERS = 96, 32, 256
#: Words with vectors of their own for each root of the number of words.
OWN = 16
#: Hashed trigrams; hashed suffixes, each the event of the rare words that end so.
TRIGRAMS, SUFFIXES = 1 << 13, 1 << 10
#: Vector size, tokens in a mini-batch, noise draws shared by a batch, noise draws of one token in its group, step.
DIMENSION, BATCH, NOISE, MEMBER_NOISE, RATE = 8, 4096, 64, 1, 0.12
#: Words before that the mean takes.
WINDOW = 64
#: Parts (of 8) of the texts in each round of training; training tokens for which there is one task.
ROUNDS, TASK_TOKENS = (1, 2, 5), 1_000_000

_SPELL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def spelling(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(n, 4): three trigrams from the first on, evenly placed, and the suffix, all hashed; words of fewer than three bytes are one."""
    out = np.zeros((len(start), 4), dtype=np.int64)
    if not len(start):
        return out
    eight = np.ndarray(shape=(len(low) - 7,), dtype="<u8", buffer=low, strides=(1,))
    spare = np.maximum(end - start - 3, 0)
    mask = (np.uint64(1) << (np.minimum(end - start, 3) * 8).astype(np.uint64)) - np.uint64(1)
    for i in range(3):
        out[:, i] = ((eight[start + spare * i // 3] & mask) * _SPELL[0] >> np.uint64(40)) % np.uint64(TRIGRAMS)
    out[:, 3] = TRIGRAMS + (((eight[start + spare] & mask) * _SPELL[1] >> np.uint64(40)) % np.uint64(SUFFIXES)).astype(np.int64)
    return out


#: Spelling of the end of a text.
_END_SPELLING = np.array([0, 0, 0, TRIGRAMS])


def _packed(f: np.ndarray) -> np.ndarray:
    return f[:, 0] | f[:, 1] << 16 | f[:, 2] << 32 | f[:, 3] << 48


def _unpacked(p: np.ndarray) -> np.ndarray:
    return np.column_stack([p >> (16 * i) & 0xFFFF for i in range(4)])


def _counter(schema: pa.Schema):
    """Partial (h, s, c): sums over runs of blocks."""

    def run(batches):
        held, size = [], 0

        def flush():
            h, s, c = (np.concatenate(x) for x in zip(*held))
            by = np.argsort(h)
            start, _ = runs(h[by])
            return h[by][start], s[by][start], np.add.reduceat(c[by], start)

        def rows(h, s, c):
            return pa.RecordBatch.from_arrays([pa.array(_signed(h)), pa.array(s), pa.array(c)], schema=schema)

        with np.errstate(over="ignore"):
            for batch in batches:
                for a, b, words in blocks(batch.column(0), BLANK_WORDS):
                    by = np.argsort(words.hash)
                    start, count = runs(words.hash[by])
                    some = by[start]
                    held += [(words.hash[some], _packed(spelling(words.low, words.start[some], words.end[some])), count)]
                    held += [(np.array([END], dtype=np.uint64), _packed(_END_SPELLING[None]), np.array([b - a]))]
                    size += len(start) + 1
                    if size > 1_500_000:
                        held = [flush()]
                        size = len(held[0][0])
                        if size > 750_000:
                            yield rows(*held[0])
                            held, size = [], 0
            if held:
                yield rows(*flush())

    return run


def count_words(docs: DataFrame) -> DataFrame:
    """(h, s, c) of every word of ``text``, and of the end of each text; s is the packed spelling."""
    store.ship(docs.sparkSession)
    schema = T.StructType().add("h", T.LongType()).add("s", T.LongType()).add("c", T.LongType())
    return docs.select("text").mapInArrow(tidy(_counter(to_arrow_schema(schema))), schema).groupBy("h").agg(F.min("s").alias("s"), F.sum("c").alias("c"))


class Vocabulary:
    """The head words, the events and their classes, and the totals; arrays only, so that it can be broadcast.

    Events below ``n_head`` are the head words by their place in ``hashes``;
    the others are suffixes.  Members are the events that share classes, group
    by group.
    """

    def __init__(self, hashes: np.ndarray, spelled: np.ndarray, counts: np.ndarray, total: int, distinct: int, rare: np.ndarray | None = None, top: int = TOP):
        """rare: tokens and words of each suffix that aren't in the head."""
        by = np.argsort(hashes)
        self.hashes, self.counts = hashes[by], counts[by].astype(np.int64)
        self.total, self.distinct = int(total), int(distinct)
        n = self.n_head = len(by)
        rare = np.zeros((2, SUFFIXES), dtype=np.int64) if rare is None else rare
        #: c + 1 of each word; in a suffix 1 for unknown words.
        weight = np.concatenate((self.counts + 1, rare.sum(axis=0) + 1)).astype(np.float64)
        suffix = np.arange(SUFFIXES)
        #: Trigrams and suffix of each event; a suffix has its own vector four times.
        self.spelled = np.concatenate((_unpacked(spelled[by]), np.repeat(TRIGRAMS + suffix[:, None], 4, axis=1))).astype(np.uint16)
        rank = np.lexsort((self.hashes, -self.counts))
        own = min(n, math.ceil(OWN * math.sqrt(max(1, distinct))))
        self.n_own = own
        #: Own vector of each event; n_own: none.
        self.own = np.full(len(weight), own, dtype=np.int32)
        self.own[rank[:own]] = np.arange(own)
        tops, rest = rank[:top], np.concatenate((rank[top:], n + suffix))
        self.n_top, groups = len(tops), math.ceil(len(rest) / MEMBERS)
        self.n_shared = min(SHARED, groups)
        #: Class of each event, and its place among the members (-1: a class of its own).
        self.cls, self.place = np.empty(len(weight), dtype=np.int32), np.full(len(weight), -1, dtype=np.int32)
        self.cls[tops] = np.arange(len(tops))
        group = np.arange(len(rest)) % groups
        self.cls[rest] = len(tops) + group % self.n_shared
        order = np.argsort(group, kind="stable")
        #: Events of the members, and the bounds of each group.
        self.members = rest[order].astype(np.int32)
        self.bounds = np.searchsorted(group[order], np.arange(groups + 1))
        self.place[self.members] = np.arange(len(rest))
        self.group = group[order].astype(np.int32)
        reach = np.concatenate(([0.0], np.cumsum(weight[self.members])))
        per_group = np.diff(reach[self.bounds])
        per_class = np.concatenate((weight[tops], np.bincount(np.arange(groups) % self.n_shared, per_group)))
        self.class_share = per_class / per_class.sum()
        self.class_reach = np.cumsum(self.class_share)
        self.group_log = np.log(per_group / per_class[len(tops) + np.arange(groups) % self.n_shared])
        self.member_log = np.log(weight[self.members] / per_group[self.group]).astype(np.float32)
        self.suffix_weight = weight[n:]
        self.shift = np.uint64(64 - (max(1, n).bit_length() + 2))
        self.bucket = np.searchsorted(self.hashes >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index into the head words, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1, dtype=np.int64)
        cell = (h >> self.shift).astype(np.int64)
        at, end = self.bucket[cell].astype(np.int64), self.bucket[cell + 1]
        last = len(self.hashes) - 1
        found = np.where((at < end) & (self.hashes[np.minimum(at, last)] == h), at, -1)
        todo = np.flatnonzero((found < 0) & (at + 1 < end))
        at, end, want = at[todo] + 1, end[todo], h[todo]
        while len(todo):
            hit = self.hashes[at] == want
            found[todo[hit]] = at[hit]
            more = ~hit & (at + 1 < end)
            todo, at, end, want = todo[more], at[more] + 1, end[more], want[more]
        return found

    @classmethod
    def of(cls, parts: dict) -> Vocabulary:
        made = cls.__new__(cls)
        made.__dict__.update(parts)
        return made


def vocabulary(counts: DataFrame, head_words: int = HEAD_WORDS, top: int = TOP) -> Vocabulary:
    """Totals over all counts; the head is the words at or above the least count that at most ``head_words`` reach."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = 0
    if distinct > head_words:
        steps = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(200_000).toArrow()
        c, reach = steps["c"].to_numpy(), np.cumsum(steps["n"].to_numpy())
        fits = np.flatnonzero(reach <= head_words)
        least = int(c[fits[-1]]) if len(fits) else int(c[0]) + 1
    head = counts.where(F.col("c") >= least).toArrow()
    rare = np.zeros((2, SUFFIXES), dtype=np.int64)
    if head.num_rows < distinct:
        cells = counts.where(F.col("c") < least).groupBy((F.shiftrightunsigned("s", 48) - TRIGRAMS).alias("i")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).toArrow()
        rare[:, cells["i"].to_numpy()] = cells["c"].to_numpy(), cells["n"].to_numpy()
    return Vocabulary(head["h"].to_numpy().view(np.uint64), head["s"].to_numpy(), head["c"].to_numpy(), total, distinct, rare, top)


class Tokens:
    """The tokens of a block, ends included: place in their text, hash, index in the head (-1: not there), event, spelling, own vector."""

    __slots__ = ("within", "hash", "index", "event", "spelled", "own", "first", "text")

    def __init__(self, words, n: int, vocab: Vocabulary):
        length = np.diff(words.first)
        end = np.cumsum(length + 1) - 1
        self.first, self.text = end - length, np.repeat(np.arange(n), length + 1)
        total = len(words.hash) + n
        self.within = np.arange(total) - np.repeat(self.first, length + 1)
        is_word = np.ones(total, dtype=bool)
        is_word[end] = False
        self.hash = np.full(total, np.uint64(END), dtype=np.uint64)
        self.hash[is_word] = words.hash
        self.spelled = np.tile(_END_SPELLING.astype(np.uint16), (total, 1))
        self.spelled[is_word] = spelling(words.low, words.start, words.end)
        self.index = vocab.find(self.hash)
        self.event = np.where(self.index >= 0, self.index, vocab.n_head + self.spelled[:, 3].astype(np.int64) - TRIGRAMS)
        self.own = vocab.own[self.event]


class Model:
    """Parameters of the log-bilinear model; the last row of ``eu`` and ``eq`` (no own vector) stays zero."""

    #: Contexts, position weights, classes, targets; of each the rows move together.
    NAMES = ("u", "eu", "a", "q", "b", "t", "eq", "eb")

    def __init__(self, vocab: Vocabulary, seed: int = 1):
        rng = np.random.default_rng(seed)
        normal = lambda n, s: (rng.standard_normal((n, DIMENSION)) * s).astype(np.float32)
        zeros = lambda n, d=DIMENSION: np.zeros((n, d), dtype=np.float32)
        spelled, classes = TRIGRAMS + SUFFIXES, vocab.n_top + vocab.n_shared
        self.u, self.eu = normal(spelled, 0.15), zeros(vocab.n_own + 1)
        self.a = np.array([[0.3], [0.3], [1.0]], dtype=np.float32) * np.ones(DIMENSION, dtype=np.float32)
        self.q, self.b = normal(classes, 0.1), np.log(vocab.class_share).astype(np.float32)[:, None]
        self.t, self.eq, self.eb = normal(spelled, 0.05), zeros(vocab.n_own + 1), zeros(vocab.n_own + 1, 1)
        self.energy = {x: np.full(len(getattr(self, x)), 1e-6, dtype=np.float32) for x in self.NAMES}

    def values(self) -> np.ndarray:
        return np.concatenate([getattr(self, x).ravel() for x in self.NAMES])

    def energies(self) -> np.ndarray:
        return np.concatenate([self.energy[x] for x in self.NAMES])

    def widths(self) -> np.ndarray:
        """Values of each row."""
        return np.concatenate([np.full(len(getattr(self, x)), getattr(self, x).shape[1]) for x in self.NAMES])

    def load(self, values: np.ndarray, energies: np.ndarray) -> None:
        at = row = 0
        for x in self.NAMES:
            old = getattr(self, x)
            setattr(self, x, values[at : at + old.size].reshape(old.shape).astype(np.float32))
            self.energy[x] = energies[row : row + len(old)].astype(np.float32)
            at, row = at + old.size, row + len(old)

    def vectors(self, spelled: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Of words that predict."""
        return _composed(self.u, self.eu, spelled, own)

    def slots(self, x: np.ndarray, within: np.ndarray) -> list[np.ndarray]:
        """For each token the vectors of the word before, of the one before that, and the mean of those before; zero before the text."""
        one, two = np.zeros_like(x), np.zeros_like(x)
        one[1:] = x[:-1]
        one[np.flatnonzero(within < 1)] = 0
        two[2:] = x[:-2]
        two[np.flatnonzero(within < 2)] = 0
        sums = np.zeros((len(x) + 1, DIMENSION))
        np.cumsum(x, axis=0, out=sums[1:])
        at = np.arange(len(x))
        taken = np.minimum(np.minimum(within, WINDOW), at)
        mean = (sums[:-1] - _take(sums, at - taken)).astype(np.float32)
        mean *= (1 / np.maximum(taken, 1)).astype(np.float32)[:, None]
        return [one, two, mean]

    def predict(self, x: np.ndarray, within: np.ndarray) -> np.ndarray:
        one, two, mean = self.slots(x, within)
        return one * self.a[0] + two * self.a[1] + mean * self.a[2]

    def targets(self, vocab: Vocabulary, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vector and bias of members by their place."""
        events = _take(vocab.members, members)
        return self._targets(vocab, members, _take(vocab.spelled, events), _take(vocab.own, events))

    def _targets(self, vocab: Vocabulary, members: np.ndarray, spelled: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _composed(self.t, self.eq, spelled, own), _take(vocab.member_log, members) + _take(self.eb[:, 0], own)

    def _move(self, name: str, rows: np.ndarray, gradient: np.ndarray) -> None:
        """Adds the gradients of each row up and takes one step there.  rows: one of each gradient, or four."""
        value, energy = getattr(self, name), self.energy[name]
        at, g = _row_sums(rows, gradient, len(value))
        met = _take(energy, at) + np.einsum("rd,rd->r", g, g) / g.shape[1]
        energy[at] = met
        g *= (np.float32(RATE) / np.sqrt(met))[:, None]
        g += _take(value, at)
        value[at] = g

    def step(self, vocab: Vocabulary, within: np.ndarray, event: np.ndarray, spelled: np.ndarray, own: np.ndarray, rng: np.random.Generator) -> None:
        """One ascent step of noise-contrastive estimation on consecutive tokens."""
        n = len(event)
        scale = np.float32(1 / n)
        slots = self.slots(self.vectors(spelled, own), within)
        r = sum(s * a for s, a in zip(slots, self.a))
        # Classes: NOISE draws for the whole batch.
        target = _take(vocab.cls, event)
        noise = np.searchsorted(vocab.class_reach, rng.random(NOISE) * vocab.class_reach[-1], side="right").clip(max=len(self.q) - 1)
        log_noise = np.log(NOISE * vocab.class_share).astype(np.float32)
        bias = self.b[:, 0] - log_noise
        qw, qn = _take(self.q, target), _take(self.q, noise)
        up = _sigmoid(-np.einsum("td,td->t", r, qw) - _take(bias, target)) * scale
        over = r @ qn.T
        over += bias[noise]
        down = _sigmoid(over)
        down *= -scale
        dr = down @ qn
        dr += up[:, None] * qw
        rows = np.concatenate((target, noise))
        moves = [("q", rows, np.concatenate((up[:, None] * r, (r.T @ down).T))), ("b", rows, np.concatenate((up, np.ones(n, dtype=np.float32) @ down))[:, None])]
        # Members: MEMBER_NOISE draws for each token in its group.
        place = _take(vocab.place, event)
        inner = np.flatnonzero(place >= 0)
        if len(inner):
            ri, real = _take(r, inner), _take(place, inner)
            group = _take(vocab.group, real)
            low, high = _take(vocab.bounds, group), _take(vocab.bounds, group + 1)
            size = (high - low)[:, None]
            fake = low[:, None] + (rng.random((len(inner), MEMBER_NOISE), dtype=np.float32) * size).astype(np.int64)
            both = np.concatenate((real[:, None], np.minimum(fake, high[:, None] - 1)), axis=1).ravel()
            events = _take(vocab.members, both)
            spells, owns = _take(vocab.spelled, events), _take(vocab.own, events)
            vector, bias = self._targets(vocab, both, spells, owns)
            vector, bias = vector.reshape(len(inner), -1, DIMENSION), bias.reshape(len(inner), -1)
            over = np.einsum("td,tkd->tk", ri, vector) + bias + np.log(size / MEMBER_NOISE).astype(np.float32)
            pull = -_sigmoid(over) * scale
            pull[:, 0] += scale
            dr[inner] += np.einsum("tk,tkd->td", pull, vector)
            pull = pull.reshape(-1, 1)
            g = np.repeat(ri, 1 + MEMBER_NOISE, axis=0)
            g *= pull
            moves.append(("t", spells, g))
            some = np.flatnonzero(owns < vocab.n_own)
            moves += [("eq", _take(owns, some), _take(g, some)), ("eb", _take(owns, some), _take(pull, some))]
        # Contexts: each word is the one before, two before, and in the means of those that follow.
        dx, g = np.zeros_like(r), dr * self.a[0]
        g[np.flatnonzero(within < 1)] = 0
        dx[:-1] = g[1:]
        g = dr * self.a[1]
        g[np.flatnonzero(within < 2)] = 0
        dx[:-2] += g[2:]
        at = np.arange(n)
        taken = np.minimum(np.minimum(within, WINDOW), at)
        share = ((taken > 0) / np.maximum(taken, 1)).astype(np.float32)
        g = dr * self.a[2]
        g *= share[:, None]
        sums = np.zeros((n + 1, DIMENSION))
        np.cumsum(g, axis=0, out=sums[1:])
        dx += (_take(sums, np.searchsorted(at - taken, at, side="right")) - sums[1:]).astype(np.float32)
        some = np.flatnonzero(own < vocab.n_own)
        moves += [("a", np.arange(3), np.stack([np.einsum("td,td->d", dr, s) for s in slots])), ("u", spelled, dx), ("eu", _take(own, some), _take(dx, some))]
        for name, rows, g in moves:
            if len(rows):
                self._move(name, rows, g)


def _take(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The rows of these numbers, all of them in the table, so that they need no check; ten times as fast as an index."""
    return table.take(rows, axis=0, mode="clip")


def _composed(shared: np.ndarray, own: np.ndarray, spelled: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = _take(own, rows)
    for i in range(4):
        out += _take(shared, spelled[:, i])
    return out


def _row_sums(rows: np.ndarray, gradient: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a table of ``n`` that are met, and the sum of each one's gradients.  rows: one of each gradient, or four."""
    flat = rows.ravel().astype(np.uint16 if n <= 1 << 16 else np.int32)
    by = np.argsort(flat, kind="stable")  # of 16 bits by radix
    flat = _take(flat, by)
    start = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    return _take(flat, start), np.add.reduceat(_take(gradient, by >> 2 if rows.ndim == 2 else by), start, axis=0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.negative(x, dtype=np.float32)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


def _log_sums(r: np.ndarray, q: np.ndarray, pieces: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Of exp(r . q[k]) over the k of each row's piece, shifted by the largest where that is out of range.

    pieces: first row, row after the last, first k, k after the last; biases are
    a last column of ``q``, with ones in ``r``.
    """
    out, ones = np.empty(len(r), dtype=np.float32), np.ones(max((d - c for _, _, c, d in pieces), default=0), dtype=np.float32)
    with np.errstate(over="ignore", divide="ignore"):
        for a, b, c, d in pieces:
            qt, one = q[c:d].T, ones[: d - c]
            for i in range(a, b, 128):
                s = r[i : min(i + 128, b)] @ qt
                np.exp(s, out=s)
                out[i : i + len(s)] = s @ one
        out = np.log(out, dtype=np.float64)
    if not np.isfinite(out).all():
        for a, b, c, d in pieces:
            odd = a + np.flatnonzero(~np.isfinite(out[a:b]))
            for some in np.array_split(odd, -(-len(odd) // 128)) if len(odd) else []:
                s = r[some] @ q[c:d].T
                top = s.max(axis=1, keepdims=True)
                out[some] = np.log(np.exp(s - top).sum(axis=1)) + top[:, 0]
    return out


class Scorer:
    """A model with the vectors of all members composed once."""

    def __init__(self, vocab: Vocabulary, model: Model):
        self.vocab, self.model = vocab, model
        self.member, self.cls = np.column_stack(model.targets(vocab, np.arange(len(vocab.members)))), np.column_stack((model.q, model.b))

    def log_p(self, tokens: Tokens) -> np.ndarray:
        """Natural log-probability of each token's event."""
        vocab, model = self.vocab, self.model
        x = np.empty((len(tokens.event), DIMENSION), dtype=np.float32)
        for i in range(0, len(x), 1 << 15):
            x[i : i + (1 << 15)] = model.vectors(tokens.spelled[i : i + (1 << 15)], tokens.own[i : i + (1 << 15)])
        return self.log_event(model.predict(x, tokens.within), tokens.event)

    def log_event(self, r: np.ndarray, event: np.ndarray) -> np.ndarray:
        """The same after given predictions."""
        vocab = self.vocab
        place = _take(vocab.place, event)
        r = np.column_stack((r, np.ones(len(r), dtype=np.float32)))
        out = np.einsum("td,td->t", r, _take(self.cls, _take(vocab.cls, event))) - _log_sums(r, self.cls, [(0, len(r), 0, len(self.cls))])
        by = np.flatnonzero(place >= 0)
        by = _take(by, np.argsort(_take(place, by)))
        place, r = _take(place, by), _take(r, by)
        group = _take(vocab.group, place)
        start, count = runs(group)
        met = group[start]
        pieces = list(zip(start.tolist(), (start + count).tolist(), vocab.bounds[met].tolist(), vocab.bounds[met + 1].tolist()))
        out[by] += np.einsum("td,td->t", r, _take(self.member, place)) + vocab.group_log[group] - _log_sums(r, self.member, pieces)
        return out


def _trainer(vocab_block, start_block, seed: int, schema: pa.Schema):
    def run(batches):
        vocab = Vocabulary.of(vocab_block.value)
        model, rng = Model(vocab), np.random.default_rng(seed)
        if start_block is not None:
            model.load(*start_block.value)
        before, held = model.energies(), None

        def steps(rows, least):
            i = 0
            while len(rows[0]) - i >= least:
                model.step(vocab, *(x[i : i + BATCH] for x in rows), rng)
                i += BATCH
            return [x[i:] for x in rows]

        with np.errstate(over="ignore"):
            for batch in batches:
                for a, b, words in blocks(batch.column(0), BLANK_WORDS, block_bytes=1 << 20):
                    tokens = Tokens(words, b - a, vocab)
                    fresh = [tokens.within, tokens.event, tokens.spelled, tokens.own]
                    held = steps([np.concatenate(x) for x in zip(held, fresh)] if held else fresh, BATCH)
            if held:
                steps(held, 1)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([1]), pa.array([model.values().tobytes()], pa.binary()), pa.array([(model.energies() - before).tobytes()], pa.binary())], schema=schema)

    return run


def _averages(tasks, values, energies, widths) -> tuple[int, np.ndarray, np.ndarray]:
    """Of parts: the number of tasks, the mean of each row by the energy it met, and the energies' sum."""
    total = weight = None
    count = 0
    for n, v, e in zip(tasks, values, energies):
        e = np.frombuffer(e, dtype=np.float32).astype(np.float64)
        x = np.frombuffer(v, dtype=np.float32) * np.repeat(e + 1e-12, widths)
        count, total, weight = count + n, x if total is None else total + x, e + 1e-12 if weight is None else weight + e + 1e-12
    return count, (total / np.repeat(weight, widths)).astype(np.float32), weight.astype(np.float32)


def _adder(widths_block, schema: pa.Schema):
    def run(batches):
        held = [(n, v, e) for batch in batches for n, v, e in zip(*(batch.column(i).to_pylist() for i in range(3)))]
        if held:
            count, values, energies = _averages(*zip(*held), widths_block.value)
            yield pa.RecordBatch.from_arrays([pa.array([count]), pa.array([values.tobytes()], pa.binary()), pa.array([energies.tobytes()], pa.binary())], schema=schema)

    return run


def train(docs: DataFrame, vocab: Vocabulary) -> Model:
    """A model of all texts of ``docs``; in each round tasks train apart and a tree of at most 32 to 1 averages them."""
    spark = docs.sparkSession
    model = Model(vocab)
    widths = model.widths()
    vocab_block, widths_block = spark.sparkContext.broadcast(vocab.__dict__), spark.sparkContext.broadcast(widths)
    schema = T.StructType().add("tasks", T.LongType()).add("data", T.BinaryType()).add("energy", T.BinaryType())
    arrow = to_arrow_schema(schema)
    part, low, start = F.pmod(F.xxhash64("text"), F.lit(sum(ROUNDS))), 0, None
    for number, size in enumerate(ROUNDS):
        texts = docs.select("text").where((part >= low) & (part < low + size))
        texts = texts.coalesce(max(1, math.ceil(vocab.total / TASK_TOKENS)))
        low += size
        sums = store.publish(texts.mapInArrow(tidy(_trainer(vocab_block, start, number, arrow)), schema), "lbl")
        left = sums.count()
        while left > 1:
            left = math.ceil(left / 32)
            wider = sums
            sums = store.publish(wider.repartition(left).mapInArrow(tidy(_adder(widths_block, arrow)), schema), "lbl")
            store.discard(wider)
            left = sums.count()
        row = sums.first()
        store.discard(sums)
        if row is not None:
            energies = model.energies() + np.frombuffer(row["energy"], dtype=np.float32) / row["tasks"]
            model.load(np.frombuffer(row["data"], dtype=np.float32), energies)
        start = spark.sparkContext.broadcast((model.values(), model.energies()))
    return model


#: The scorer of one model, kept while a Python worker lives.
_SCORERS: dict[str, Scorer] = {}


def _scorer(vocab_block, values_block, mark: str, whole_head: bool, fields: list[str], schema: pa.Schema):
    def run(batches):
        if mark not in _SCORERS:
            _SCORERS.clear()
            vocab = Vocabulary.of(vocab_block.value)
            model = Model(vocab)
            model.load(values_block.value, model.energies())
            _SCORERS[mark] = Scorer(vocab, model)
        scorer = _SCORERS[mark]
        vocab = scorer.vocab
        head_log = np.log10(vocab.counts + 1.0)
        per_token, log_suffix = math.log10(vocab.total + vocab.distinct + 1), np.log10(vocab.suffix_weight)
        with np.errstate(over="ignore"):
            for batch in batches:
                for a, b, words in blocks(batch.column(batch.schema.get_field_index("__cv_text")), BLANK_WORDS, block_bytes=1 << 20):
                    n = b - a
                    tokens = Tokens(words, n, vocab)
                    known = tokens.index >= 0
                    log_c = np.where(known, head_log[tokens.index] if len(head_log) else 0.0, 0.0)
                    log_p = scorer.log_p(tokens) / math.log(10)
                    log_p -= np.where(known, 0.0, log_suffix[np.where(known, 0, tokens.event - vocab.n_head)])
                    made = {
                        "n_tokens": pa.array(np.diff(words.first) + 1, pa.int64()),
                        "n_known": pa.array(np.add.reduceat(known.astype(np.int64), tokens.first)),
                        "base_score": pa.array(np.add.reduceat(log_c - per_token, tokens.first)),
                        "score": pa.array(np.add.reduceat(log_p, tokens.first)),
                    }
                    if not whole_head:
                        rare = np.flatnonzero(~known)
                        offsets = np.concatenate(([0], np.cumsum(np.bincount(tokens.text[rare], minlength=n)))).astype(np.int32)
                        made["__cv_rare"] = pa.ListArray.from_arrays(offsets, pa.array(_signed(tokens.hash[rare]))).cast(schema.field("__cv_rare").type)
                    part = batch.slice(a, n)
                    yield pa.RecordBatch.from_arrays([made[f] if f in made else part.column(f).cast(schema.field(f).type) for f in fields], schema=schema)

    return run


ADDED = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def score_texts(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` with n_tokens, n_known, train_tokens, base_score and score (log10).

    keep: the columns to return (all by default); columns named as the added
    ones are replaced.  Null counts as the empty text, which has one token, its
    end.  Repeated rows score alike.  Without training texts all words are
    unknown.
    """
    spark = docs.sparkSession
    store.ship(spark)
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in ADDED]
    whole_head = vocab.distinct <= vocab.n_head
    source = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__cv_text"), *([] if whole_head else [F.monotonically_increasing_id().alias("__cv_row")]))
    schema = T.StructType([source.schema[c] for c in source.columns if c != "__cv_text"])
    schema = schema.add("n_tokens", T.LongType()).add("n_known", T.LongType()).add("base_score", T.DoubleType()).add("score", T.DoubleType())
    if not whole_head:
        schema = schema.add("__cv_rare", T.ArrayType(T.LongType()))
    blocks_sent = spark.sparkContext.broadcast(vocab.__dict__), spark.sparkContext.broadcast(model.values())
    scored = source.mapInArrow(tidy(_scorer(*blocks_sent, uuid.uuid4().hex, whole_head, schema.names, to_arrow_schema(schema))), schema)
    if not whole_head:  # a table, so that row numbers are the same in both uses
        scored = store.publish(scored, "scored")
        rare = scored.select("__cv_row", F.explode("__cv_rare").alias("h")).join(counts.select("h", "c"), "h")
        sums = rare.groupBy("__cv_row").agg(F.count("*").alias("__cv_n"), F.sum(F.log10(F.col("c") + 1)).alias("__cv_s"))
        scored = scored.drop("__cv_rare").join(sums, "__cv_row", "left").withColumns({
            "n_known": F.col("n_known") + F.coalesce("__cv_n", F.lit(0)),
            "base_score": F.col("base_score") + F.coalesce("__cv_s", F.lit(0.0)),
            "score": F.col("score") + F.coalesce("__cv_s", F.lit(0.0)),
        })
    return scored.select(*kept, "n_tokens", "n_known", F.lit(vocab.total).cast("long").alias("train_tokens"), "base_score", "score")


def fit(training: DataFrame, text: str = "text", head_words: int = HEAD_WORDS, top: int = TOP) -> tuple[DataFrame, Vocabulary, Model]:
    """Counts, vocabulary and model of all rows of ``training``; null counts as the empty text."""
    plain = training.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = store.publish(count_words(plain), "counts")
    vocab = vocabulary(counts, head_words, top)
    return counts, vocab, train(plain, vocab)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    fitted = fit(docs.where(~held_out))
    return score_texts(docs.withColumn("held_out", held_out), *fitted, keep=["doc_id", "held_out"])


QUERIES = {"op1_lm_scores": query}
ORACLES: dict[str, str] = {}
