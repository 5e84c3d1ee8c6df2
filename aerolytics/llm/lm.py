"""Language-model scores: a causal self-attention model over subword ids, trained in numpy.

A text is a sequence of lower-cased words and one end. The model's probability of a word is a mixture, with weights
fitted by EM on texts kept from the attention's training, of
  attention  the product over the word's subword ids (a public byte-level vocabulary, given by its path; never trained)
             of a one-head causal self-attention model with a two-level softmax over the most frequent ids, buckets
             of the others (each with a unigram inside), and the end;
  words      the relative frequency of the word in the training documents;
  kinds      the same within kinds of documents (languages, say), each by its probability given the words so far. Kinds
             are found on the starting documents; every training document then counts for its most likely kind; and
  text       its relative frequency among the words of the text before it.
All are normalised, so the score of a text is a log10 probability. Texts are cut into overlapping windows: each
scores its last `stride` ids with at least `context` ids before them (fewer at a text's start), so every id is scored
once, by batched masked attention over many windows at a time.

What is learnt from the corpus: counts of all words and of all subword ids of all training documents (distributed sums);
attention weights, started on four fifths of `start_rows` documents and then trained in one streamed pass over all
training documents, each partition by itself, and averaged by ids seen (one round of federated averaging). Which classes
share a group of the softmax is found on the same four fifths; it bounds the cost only, every class has its outputs. Only the
last fifth of the starting documents, 300 at most, is kept from it, as the mixture is fitted on these. Averages are
formed on the executors in at most 64 streams, so the driver sees 64 sets of weights at most. The averaged weights are
always the model's; `held_out` has what attention alone scores with them and with those of the start.

Words, kinds and the add-one unigram base need the count of every training word. The most frequent words (at most
`top_words`, a fixed size) are looked up where the text is; where there are more, the counts of the rest come to each
text by a join on the word's hash before it is scored, so no score depends on `top_words`.

Defined cases: null is an empty text, whose only token is its end; without training documents every count is 0, the
base is 0 per token with N = 0 and V = 0, and the model is uniform over ids; repeated rows are scored alike; an empty
table gives no rows; a text or a word of any length is read whole; of equally frequent ids or words at the edge of a
table the smaller id has a class of its own, and all words of one count are in the table or none; extra columns are not read.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of, written
from .words import buffers, split_bytes, words

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


STAGES = 10


@dataclass(frozen=True)
class LM:
    vocabulary: str = VOCABULARY
    width: int = 24
    context: int = 12
    stride: int = 12
    frequent: int = 224  # ids with an output of their own
    buckets: int = 63  # outputs for the other ids, by how they begin; then the end
    top_words: int = 1 << 20
    start_rows: int = 1_500
    start_ids: int = 2_500_000
    rate: float = 0.001  # of the pass over all training documents
    kinds: int = 4  # of documents
    kind_words: int = 20_000  # words that tell kinds apart, of the starting documents
    fold: int = 7
    held: int = 2

    @property
    def outputs(self) -> int:
        return self.frequent + self.buckets + 1

    @property
    def window(self) -> int:
        return self.context + self.stride


class Subwords:
    """Words to ids by a rank file, many distinct words at a time. A word is read with a space before it."""

    def __init__(self, ranks: bytes):
        self.ranks, self.encoding = ranks, None
        table = dict(self._parse())
        self.size = max(table.values()) + 1
        self.end = self.size  # the id of an end
        self.head, self.begins = np.zeros(self.size, bool), np.zeros(self.size, np.int64)
        for token, i in table.items():
            self.head[i] = token[:1] == b" "
            self.begins[i] = 256 * self.head[i] + (token.removeprefix(b" ")[:1] or b" ")[0]

    def _parse(self) -> Iterator[tuple[bytes, int]]:
        for line in self.ranks.splitlines():
            if line:
                a, b = line.split()
                yield base64.b64decode(a), int(b)

    def __getstate__(self):
        return self.__dict__ | {"encoding": None}

    def encode(self, many: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of word i are ids[first[i]:first[i + 1]]."""
        if self.encoding is None:
            self.encoding = Coded.of(self).encoding
        if not many:
            return np.empty(0, np.int64), np.zeros(1, np.int64)
        text = b" " + b" ".join(many)
        ids = np.asarray(self.encoding.encode_to_numpy(text.decode("utf-8", "replace"))).astype(np.int64)
        first = np.flatnonzero(self.head[ids])
        if len(first) != len(many):  # a word with white space of other kinds inside
            each = [self.encoding.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in many]
            return np.array([i for x in each for i in x], np.int64), np.append(0, np.cumsum([len(x) for x in each]))
        return ids, np.append(first, len(ids))


class Coded:
    """The encoding, and the ids of words met before, kept by a process for all its batches and tasks: up to `limit` words."""

    kept: Coded | None = None

    def __init__(self, subwords: Subwords, limit: int = 1 << 20):
        import tiktoken

        self.ranks, self.limit = subwords.ranks, limit
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=dict(subwords._parse()), special_tokens={})
        self.words = np.empty(0, np.uint64)  # hashes, ascending
        self.first, self.length = np.empty(0, np.int32), np.empty(0, np.int32)  # their places in ids
        self.ids, self.used = np.empty(1 << 16, np.int32), 0

    @classmethod
    def of(cls, subwords: Subwords) -> Coded:
        if cls.kept is None or cls.kept.ranks != subwords.ranks:
            cls.kept = cls(subwords)
        return cls.kept

    def __call__(self, subwords: Subwords, hashes: np.ndarray, raw: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, length) for words of ascending hashes that stand in `raw` from `starts` to `stops`, and then the end."""
        at = np.searchsorted(self.words, hashes)
        near = np.minimum(at, len(self.words) - 1)
        new = np.flatnonzero(self.words[near] != hashes) if len(self.words) else np.arange(len(hashes))
        ids, cut = subwords.encode([raw[a:b].lower() for a, b in zip(starts[new].tolist(), stops[new].tolist(), strict=True)])
        first, length = np.empty(len(hashes) + 1, np.int64), np.ones(len(hashes) + 1, np.int64)
        if len(self.words):
            first[:-1], length[:-1] = self.first[near], self.length[near]
        used = self.used
        first[new], length[new] = used + cut[:-1], np.diff(cut)
        first[-1] = used + len(ids)
        # the new ones, then the end, are written after those that are kept; they stay if there is room
        if used + len(ids) + 1 > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.empty(used // 2 + len(ids) + 1, np.int32)])
        self.ids[used : used + len(ids)], self.ids[used + len(ids)] = ids, subwords.end
        if len(self.words) + len(new) <= self.limit:
            self.words = np.insert(self.words, at[new], hashes[new])
            self.first, self.length = np.insert(self.first, at[new], first[new]), np.insert(self.length, at[new], length[new])
            self.used += len(ids)
        return self.ids, first, length


class Read:
    """A batch of texts as words and subword ids, ends included."""

    def __init__(self, texts: pa.Array, subwords: Subwords | None):
        data, _ = buffers(texts)
        h, first, starts, stops = words(texts, True)
        self.first = first
        # one stable sort gives the distinct words and, for so_far(), each word's places in order
        self.order = np.argsort(h, kind="stable")
        ranked = h[self.order]
        new = np.append(True, ranked[1:] != ranked[:-1])[: len(h)]
        heads = np.flatnonzero(new)
        self.distinct, at, self.which = ranked[heads], self.order[heads], np.empty(len(h), np.int64)
        self.which[self.order] = np.cumsum(new) - 1
        if subwords is None:
            return
        ids, begin, many = Coded.of(subwords)(subwords, self.distinct, data.tobytes(), starts[at], stops[at])
        # the distinct word after the last is the end; one follows every text's words
        self.word = np.insert(self.which, first[1:], len(self.distinct))
        self.word_first = first + np.arange(len(first))
        length = many[self.word]
        self.piece_first = np.append(0, np.cumsum(length))
        self.ids = ids[np.repeat(begin[self.word] - self.piece_first[:-1], length) + np.arange(int(length.sum()))].astype(np.int64)
        self.id_first = self.piece_first[self.word_first]


    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, words before it) of every word and end."""
        n = np.diff(self.word_first)
        text = np.repeat(np.arange(len(n)), n)
        return text, np.arange(len(self.word)) - self.word_first[:-1][text]

    def stage(self) -> np.ndarray:
        return np.minimum(np.frexp(self.places()[1].astype(np.float64))[1], STAGES - 1)

    def so_far(self) -> np.ndarray:
        """For each word: how often it occurs among the words of its text before it, by their number; 0 for ends and first words."""
        n = np.diff(self.first)
        text = np.repeat(np.arange(len(n)), n)
        t, w = text[self.order], self.which[self.order]
        first = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (w[1:] != w[:-1]))[: len(t)])
        before = np.empty(len(t), np.int64)
        before[self.order] = np.arange(len(t)) - np.repeat(first, np.diff(np.append(first, len(t))))
        return np.insert(before / np.maximum(np.arange(len(t)) - self.first[:-1][text], 1), self.first[1:], 0.0)


@dataclass
class Kinds:
    """A mixture of unigrams: which of a few kinds a text is."""

    words: np.ndarray  # hashes, ascending
    logs: np.ndarray  # [word, kind]
    prior: np.ndarray

    @classmethod
    def fit(cls, r: Read, p: LM, rounds: int = 25) -> Kinds:
        texts, n = len(r.first) - 1, np.bincount(r.which, minlength=len(r.distinct))
        used = np.sort(np.argsort(-n, kind="stable")[: p.kind_words])
        used = used[n[used] > 1]
        row = np.full(len(r.distinct) + 1, -1)
        row[used] = np.arange(len(used))
        text = np.repeat(np.arange(texts), np.diff(r.first))
        word = row[r.which]
        pair, tf = np.unique(text[word >= 0] * np.int64(len(used) + 1) + word[word >= 0], return_counts=True)
        text, word = np.divmod(pair, len(used) + 1)
        total = np.bincount(word, tf, len(used)) + 0.1
        logs = np.log(total / total.sum())[:, None] + np.random.default_rng(5).normal(0, 0.5, (len(used), p.kinds))
        prior = np.full(p.kinds, 1 / p.kinds)
        for _ in range(rounds):
            like = np.stack([np.bincount(text, tf * logs[word, k], texts) for k in range(p.kinds)], axis=1) + np.log(prior)
            q = np.exp(like - np.logaddexp.reduce(like, axis=1, keepdims=True))
            prior = (q.sum(0) + 1) / (texts + p.kinds)
            sums = np.stack([np.bincount(word, tf * q[text, k], len(used)) for k in range(p.kinds)], axis=1)
            smooth = sums + 50 * (total / total.sum())[:, None]
            logs = np.log(smooth / smooth.sum(0))
        return cls(r.distinct[used], logs, prior)

    def of(self, r: Read) -> np.ndarray:
        """The most likely kind of each text."""
        logs = np.zeros((len(r.distinct), len(self.prior)))
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, r.distinct), len(self.words) - 1)
            hit = self.words[at] == r.distinct
            logs[hit] = self.logs[at[hit]]
        out = np.zeros((len(r.first) - 1, len(self.prior)))
        some = np.flatnonzero(np.diff(r.first))
        if len(some):
            out[some] = np.add.reduceat(logs[r.which], r.first[some], axis=0)
        return np.argmax(out + np.log(self.prior), axis=1)


def group_sizes(n: int) -> tuple[int, int]:
    """(classes in a group, groups) of the softmax over n classes; the last group may have fewer."""
    size = math.isqrt(n - 1) + 1
    return size, -(-n // size)


class Attention:
    """One head over windows of class numbers; classes: frequent ids, the buckets, the end; the input has a start too.

    The softmax has two levels: a class has the probability of its group times its own within the group, so a step computes
    two short softmaxes instead of one over all classes, which all keep outputs of their own. Groups are runs of class numbers;
    the class before also speaks for each group by itself, which makes up for the factoring.
    Inputs, queries, keys and values are sums of a row for the class and a row for the place in the window, so they are looked up."""

    NAMES = ("E", "P", "A", "B", "O", "c", "D")

    def __init__(self, p: LM, log_unigram: np.ndarray, seed: int = 0):
        r, d, n = np.random.default_rng(seed), p.width, p.outputs
        self.p, self.n = p, n
        self.size, self.groups = group_sizes(n)
        side = math.isqrt(n) + 1
        self.unit = np.eye(side, dtype=np.float32)[np.arange(n + 1) % side]
        self.later = np.where(np.arange(p.window)[None, :] > np.arange(p.stride)[:, None] + p.context, np.float32(-1e9), np.float32(0))
        f = np.float32
        self.E, self.P = r.normal(0, 0.3, (n + 1, d)).astype(f), r.normal(0, 0.1, (p.window, d)).astype(f)
        self.A, self.B = r.normal(0, 0.3, (d, 3 * d)).astype(f), r.normal(0, 0.2, (d, d)).astype(f)
        # outputs of the groups, then of the classes
        self.O, self.c = r.normal(0, 0.1, (d, self.groups + n)).astype(f), np.zeros(self.groups + n, f)
        self.D = np.zeros((n + 1, self.groups), f)  # by the class before, to the groups
        whole = np.logaddexp.reduceat(log_unigram, np.arange(0, n, self.size))
        self.c[: self.groups], self.c[self.groups :] = whole, log_unigram - np.repeat(whole, self.size)[:n]

    def weights(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def load(self, flat: np.ndarray) -> Attention:
        at = 0
        for k in self.NAMES:
            old = getattr(self, k)
            setattr(self, k, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def windows(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts first[i]:first[i + 1]: (start of the scored block, text start, text end) for each window."""
        n = -(-np.diff(first) // self.p.stride)
        text = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(text)) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n)
        return first[text] + k * self.p.stride, first[text], first[text + 1]

    def _read(self, classes: np.ndarray, block: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(input classes, classes to tell or -1, number of places before the text) of windows."""
        classes = classes.astype(np.int16 if self.n < 1 << 15 else np.int64)  # numpy sorts 16-bit numbers in linear time
        at = block[:, None] + np.arange(-self.p.context, self.p.stride)
        inputs = classes[np.clip(at - 1, 0, len(classes) - 1)]
        inputs[at == low[:, None]] = self.n  # the start stands before a text's first id
        at = at[:, self.p.context :]
        target = classes[np.minimum(at, len(classes) - 1)]
        target[at >= high[:, None]] = -1
        return inputs, target, np.maximum(low - block + self.p.context, 0)

    def _tables(self) -> tuple[np.ndarray, ...]:
        """Rows of keys, values and 1 by class and by place; rows of inputs, queries and what goes to the groups by class and by scored place."""
        d, f = self.p.width, self.E.dtype
        query, out = self.A[:, :d] * f.type(1 / math.sqrt(d)), []
        for x, one, scored, more in ((self.E, 1, self.E, self.D), (self.P, 0, self.P[self.p.context :], 0)):
            kv, xq = np.empty((len(x), 2 * d + 1), f), np.empty((len(scored), 2 * d + self.groups), f)
            kv[:, :-1], kv[:, -1] = x @ self.A[:, d:], one
            xq[:, :d], xq[:, d : 2 * d], xq[:, 2 * d :] = scored, scored @ query, more
            out += [kv, xq]
        return tuple(out)

    def _hidden(self, tables: tuple[np.ndarray, ...], inputs: np.ndarray, free: np.ndarray):
        p, d = self.p, self.p.width
        kv = tables[0].take(inputs, axis=0)
        kv += tables[2]
        xq = tables[1].take(inputs[:, p.context :], axis=0)
        xq += tables[3]
        s = np.matmul(xq[:, :, d : 2 * d], kv[:, :, :d].transpose(0, 2, 1))
        near = max(s.max(), -s.min()) < 40  # exponents of these and their sums need no shift
        s += self.later
        if free.any():
            some = np.flatnonzero(free)
            s[some] += np.where(np.arange(p.window) < free[some, None], s.dtype.type(-1e9), s.dtype.type(0))[:, None]
        if not near:
            s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        z = np.matmul(s, kv[:, :, d:])  # the sum of the weights comes as one more value
        total = z[:, :, d:]
        z = z[:, :, :d] / total
        hid = (z.reshape(-1, d) @ self.B).reshape(z.shape)
        hid += xq[:, :, :d]
        return kv, xq, s, total, z, hid

    def _outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Outputs over biases: [width + 1, group], and [group, width + 1, place in the group]; free places have zeros."""
        both = np.concatenate([self.O, self.c[None]])
        own = np.zeros((len(both), self.groups * self.size), both.dtype)
        own[:, : self.n] = both[:, self.groups :]
        return np.ascontiguousarray(both[:, : self.groups]), own.reshape(len(both), self.groups, self.size).transpose(1, 0, 2).copy()

    @staticmethod
    def _sorted(numbers: np.ndarray, size: int, groups: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """(places of the numbers that are not -1 in ascending order, these, (group, from, to) of the groups among them)."""
        order = np.argsort(numbers, kind="stable")
        ranked = numbers[order]
        cuts = np.searchsorted(ranked, np.arange(0, groups * size + 1, size, dtype=ranked.dtype))
        order, ranked, cuts = order[cuts[0] :], ranked[cuts[0] :], (cuts - cuts[0]).tolist()
        return order, ranked, [(g, cuts[g], cuts[g + 1]) for g in range(groups) if cuts[g] < cuts[g + 1]]

    def _parts(self, outputs: tuple[np.ndarray, np.ndarray], hid: np.ndarray, xq: np.ndarray, order: np.ndarray, ranked: np.ndarray, runs: list[tuple[int, int, int]]):
        """Of the ids in that order, a row each: what the outputs read; and for both softmaxes the exponents, their sums and
        the place told; and the log probabilities, in all."""
        read = np.ones((len(order), self.p.width + 1), hid.dtype)
        read[:, :-1] = hid.reshape(-1, self.p.width).take(order, axis=0)
        whole, own = read @ outputs[0], np.empty((len(order), self.size), hid.dtype)
        whole += xq.reshape(-1, xq.shape[2])[:, 2 * self.p.width :].take(order, axis=0)
        for g, a, b in runs:
            np.matmul(read[a:b], outputs[1][g], out=own[a:b])
        logs, parts = np.zeros(len(order), hid.dtype), []
        # places of the last group that no class has weigh nothing
        free = own[runs[-1][1] :, self.n - (self.groups - 1) * self.size :] if runs and runs[-1][0] == self.groups - 1 else own[:0]
        free[:] = own[len(own) - len(free) :, :1]
        for x, places in ((whole, ranked // self.size), (own, ranked % self.size)):
            at = np.arange(0, x.size, x.shape[1]) + places
            if x.size and max(x.max(), -x.min()) >= 40:
                x -= x.max(axis=1, keepdims=True)
            logs += x.ravel()[at]
            np.exp(x, out=x)
            if x is own:
                free[:] = 0
            sums = x @ np.ones(x.shape[1], x.dtype)
            logs -= np.log(sums)
            parts.append((x, sums, at))
        return read, parts, logs

    def score(self, classes: np.ndarray, first: np.ndarray, chunk: int = 192) -> np.ndarray:
        """Natural log probability of each class given those before it in its text."""
        out, tables, outputs = np.zeros(len(classes), np.float32), self._tables(), self._outputs()
        block, low, high = self.windows(first)
        inputs, target, free = self._read(classes, block, low, high)
        for a in range(0, len(inputs), chunk):
            part = slice(a, a + chunk)
            _, xq, *_, hid = self._hidden(tables, inputs[part], free[part])
            order, *runs = self._sorted(target[part].ravel(), self.size, self.groups)
            window, k = np.divmod(order, self.p.stride)
            out[block[part][window] + k] = self._parts(outputs, hid, xq, order, *runs)[-1]
        return out

    def step(self, classes: np.ndarray, block: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over the scored ids, and the gradients."""
        return self._step(*self._read(classes, block, low, high))

    def _step(self, inputs: np.ndarray, target: np.ndarray, free: np.ndarray) -> tuple[float, list[np.ndarray]]:
        p, d, g = self.p, self.p.width, self.groups
        kv, xq, s, total, z, hid = self._hidden(self._tables(), inputs, free)
        f = hid.dtype
        order, ranked, runs = self._sorted(target.ravel(), self.size, g)
        outputs, share = self._outputs(), f.type(1 / max(1, len(order)))
        read, parts, logs = self._parts(outputs, hid, xq, order, ranked, runs)
        for x, sums, at in parts:
            x *= (share / sums)[:, None]
            x.ravel()[at] -= share
        (whole, _, _), (own, _, _) = parts
        down, down_own = whole @ outputs[0][:d].T, np.empty((len(order), d), f)
        of_own, back = np.zeros_like(outputs[1]), outputs[1][:, :d].transpose(0, 2, 1).copy()
        for i, a, b in runs:
            np.matmul(read[a:b].T, own[a:b], out=of_own[i])
            np.matmul(own[a:b], back[i], out=down_own[a:b])
        down += down_own
        dOc = np.concatenate([read.T @ whole, of_own.transpose(1, 0, 2).reshape(d + 1, -1)[:, : self.n]], axis=1)
        dxq, dkv = np.empty_like(xq), np.empty((len(kv), p.window, 2 * d), f)
        dh = np.zeros((target.size, d), f)
        dh[order] = down
        dxq[:, :, :d], dxq[:, :, 2 * d :] = dh.reshape(hid.shape), 0
        dxq.reshape(-1, dxq.shape[2])[order, 2 * d :] = whole
        dB = z.reshape(-1, d).T @ dh
        dz = np.empty((*hid.shape[:2], d + 1), f)  # times values and 1: the gradient of the weights less its mean under them
        dz[:, :, :d] = (dh @ self.B.T).reshape(hid.shape)
        z *= dz[:, :, :d]
        dz[:, :, d] = -(z.reshape(-1, d) @ np.ones(d, f)).reshape(hid.shape[:2])
        dz /= total
        ds = np.matmul(dz, kv[:, :, d:].transpose(0, 2, 1))
        ds *= s
        dkv[:, :, :d] = np.matmul(ds.transpose(0, 2, 1), xq[:, :, d : 2 * d])
        dkv[:, :, d:] = np.matmul(s.transpose(0, 2, 1), dz[:, :, :d])
        dxq[:, :, d : 2 * d] = np.matmul(ds, kv[:, :, :d])
        scale = f.type(1 / math.sqrt(d))
        of_class, of_place = np.empty((self.n + 1, 3 * d), f), np.zeros((p.window, 3 * d), f)
        of_input, in_place = self._sums(inputs[:, p.context :], dxq), dxq.sum(axis=0)
        of_class[:, :d], of_class[:, d:] = of_input[:, d : 2 * d] * scale, self._sums(inputs, dkv)
        of_place[p.context :, :d], of_place[:, d:] = in_place[:, d : 2 * d] * scale, dkv.sum(axis=0)
        dE, dP = of_class @ self.A.T, of_place @ self.A.T
        dE += of_input[:, :d]
        dP[p.context :] += in_place[:, :d]
        return -float(logs.sum() * share), [dE, dP, self.E.T @ of_class + self.P.T @ of_place, dB, dOc[:-1], dOc[-1], of_input[:, 2 * d :]]

    def _sums(self, inputs: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The sum of the rows of each input class, by products with 0 and 1 in groups of classes: numpy's own sums of runs are slower."""
        size, width = self.unit.shape[1], rows.shape[2]
        order, ranked, runs = self._sorted(inputs.ravel(), size, size)
        rows, places = rows.reshape(-1, width).take(order, axis=0), self.unit.take(ranked, axis=0)
        out = np.zeros((size, size, width), rows.dtype)
        for g, a, b in runs:
            out[g] = places[a:b].T @ rows[a:b]
        return out.reshape(-1, width)[: self.n + 1]

    def train(self, classes: np.ndarray, first: np.ndarray, epochs: int, rate: float, seed: int = 0, batch: int = 96) -> Attention:
        """Adam over shuffled windows."""
        inputs, target, free = self._read(classes, *self.windows(first))
        r = np.random.default_rng(seed)
        flat, at = self.weights(), 0
        for k in self.NAMES:  # the weights become parts of one array
            old = getattr(self, k)
            setattr(self, k, flat[at : at + old.size].reshape(old.shape))
            at += old.size
        m, v = np.zeros_like(flat), np.zeros_like(flat)
        t, steps = 0, max(1, epochs * -(-len(inputs) // batch))
        for _ in range(epochs):
            order = r.permutation(len(inputs))
            for a in range(0, len(order), batch):
                pick = order[a : a + batch]
                _, grads = self._step(inputs[pick], target[pick], free[pick])
                t += 1
                now = rate * (1 - 0.9 * t / steps)
                g = np.concatenate([x.ravel() for x in grads])
                m += np.float32(0.1) * (g - m)
                g *= g
                v += np.float32(0.01) * (g - v)
                np.sqrt(v * np.float32(1 / (1 - 0.99**t)), out=g)
                g += np.float32(1e-8)
                np.divide(m, g, out=g)
                g *= np.float32(now / (1 - 0.9**t))
                flat -= g
                np.clip(flat, -12, 12, out=flat)
        return self


@dataclass
class Rare:
    """Counts of training words that the table of frequent ones lacks."""

    words: np.ndarray  # hashes, ascending
    counts: np.ndarray
    by_kind: np.ndarray  # [word, kind]

    @classmethod
    def of(cls, columns: list[pa.Array]) -> Rare:
        """From columns key, n, z0, z1, ...; a word may be there many times."""
        key, at = np.unique(columns[0].to_numpy(zero_copy_only=False).astype(np.uint64), return_index=True)
        n, *by = (c.to_numpy(zero_copy_only=False)[at] for c in columns[1:])
        return cls(key, n, np.stack(by, axis=1).astype(np.float64))


@dataclass
class Model:
    p: LM
    subwords: Subwords
    of_id: np.ndarray  # class of each subword id, the end included
    log_rest: np.ndarray  # natural log probability of an id given its class, by the likeliest kind of text so far
    attention: Attention
    top: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))  # hashes of the most frequent words, ascending
    top_counts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    ends: int = 0  # training documents
    held_out: tuple[float, float] | None = None  # log10 probability a token by attention alone, of the texts that fit the mixture: with the weights of the start, and with the averaged ones
    trained: int = 0  # subword ids that the pass over the training documents took
    tokens: int = 0  # N
    kinds: int = 0  # V
    whole: bool = True  # whether top holds every training word
    #: Weights of attention, words, kinds and the text so far, by how many words come before: 0, 1, 2-3, 4-7, ...
    mixture: np.ndarray = field(default_factory=lambda: np.tile([0.4, 0.3, 0.2, 0.1], (STAGES, 1)))
    top_by_kind: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.float32))  # counts [word, kind]
    ends_by_kind: np.ndarray = field(default_factory=lambda: np.zeros(1))
    of_kind: np.ndarray = field(default_factory=lambda: np.zeros(1))  # tokens of each kind
    prior: np.ndarray = field(default_factory=lambda: np.ones(1))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words in the table of frequent ones, -1 where it has none."""
        if not len(self.top):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.top, hashes), len(self.top) - 1)
        return np.where(self.top[at] == hashes, at, -1)

    def counts(self, hashes: np.ndarray, rare: Rare | None) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of words, and last of the end: in all, and [word, kind]; `rare` has the training words outside the table."""
        places = self.places(hashes)
        n, by = np.zeros(len(hashes) + 1, np.int64), np.zeros((len(hashes) + 1, len(self.prior)))
        n[-1], by[-1] = self.ends, self.ends_by_kind
        hit = np.flatnonzero(places >= 0)
        n[hit], by[hit] = self.top_counts[places[hit]], self.top_by_kind[places[hit]]
        if rare is not None and len(rare.words):
            at = np.minimum(np.searchsorted(rare.words, hashes), len(rare.words) - 1)
            hit = np.flatnonzero((rare.words[at] == hashes) & (places < 0))
            n[hit], by[hit] = rare.counts[at[hit]], rare.by_kind[at[hit]]
        return n, by

    def kind_logs(self, r: Read, counts: np.ndarray, by_kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word and end: its natural log probability by the kinds, weighed by the words of the text before it; and the likeliest kind by these."""
        known = counts > 0
        table = np.zeros((len(self.prior), len(known)))  # a row for each kind
        table[:, known] = np.log((by_kind[known].T + 1000 * counts[known] / self.tokens) / (self.of_kind + 1000)[:, None])
        own = table.take(r.word, axis=1)  # 0 for words that no training document has: they say nothing of the kind
        seen = np.zeros((len(own), own.shape[1] + 1))
        np.cumsum(own, axis=1, out=seen[:, 1:])
        starts = seen.take(r.word_first[:-1], axis=1) - np.log(self.prior)[:, None]
        seen = seen[:, :-1]
        seen -= np.repeat(starts, np.diff(r.word_first), axis=1)
        likeliest = seen.argmax(axis=0)
        seen -= seen.max(axis=0)
        np.exp(seen, out=seen)
        own = np.exp(table).take(r.word, axis=1)
        own *= seen
        with np.errstate(divide="ignore"):
            return np.where(known[r.word], np.log(own.sum(axis=0) / seen.sum(axis=0)), -np.inf), likeliest

    def word_logs(self, r: Read, rare: Rare | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Natural logs of the four parts [part, word or end] of the batch, and counts of the distinct words and the end."""
        counts, by_kind = self.counts(r.distinct, rare)
        out = np.empty((4, len(r.word)))
        with np.errstate(divide="ignore"):
            out[1] = np.log(counts / max(1, self.tokens))[r.word]
            out[2], kind = self.kind_logs(r, counts, by_kind) if self.ends else (-np.inf, np.zeros(len(r.word), np.int64))
            out[3] = np.log(r.so_far())
        pieces = self.attention.score(self.of_id[r.ids], r.id_first) + self.log_rest[np.repeat(kind, np.diff(r.piece_first)), r.ids]
        out[0] = np.add.reduceat(pieces.astype(np.float64), r.piece_first[:-1]) if len(pieces) else 0
        return out, counts

    def mixed(self, logs: np.ndarray, stage: np.ndarray) -> np.ndarray:
        parts = np.log(self.mixture).T.take(stage, axis=1)
        parts += logs
        top = parts.max(axis=0)  # that of attention is finite
        parts -= top
        return np.log(np.exp(parts, out=parts).sum(axis=0)) + top


def classes(seen: np.ndarray, subwords: Subwords, p: LM) -> tuple[np.ndarray, np.ndarray]:
    """(class of every subword id, log probability [kind, id] given the class) from corpus counts seen[kind, id]: the most
    frequent ids have a class each; the others share buckets by their first byte and whether they begin a word, the
    lightest buckets one."""
    total = seen.sum(axis=0)
    order = np.argsort(-total[:-1], kind="stable")[: p.frequent]
    of_id = np.full(subwords.size + 1, -1, np.int64)
    of_id[order], of_id[subwords.end] = np.arange(len(order)), p.outputs - 1
    rest = np.flatnonzero(of_id < 0)
    weight = np.bincount(subwords.begins[rest], total[rest] + 0.5, 512)
    named = np.argsort(-weight, kind="stable")[: p.buckets - 1]
    bucket = np.full(512, p.buckets - 1)
    bucket[named] = np.arange(len(named))
    of_id[rest] = p.frequent + bucket[subwords.begins[rest]]
    mass = np.bincount(of_id[rest], total[rest] + 0.5, p.outputs)
    share = (total[rest] + 0.5) / mass[of_id[rest]]
    log_rest = np.zeros((len(seen), subwords.size + 1), np.float32)
    for log, own in zip(log_rest, seen, strict=True):
        log[rest] = np.log((own[rest] + 20 * share) / (np.bincount(of_id[rest], own[rest], p.outputs)[of_id[rest]] + 20))
    return of_id, log_rest


def alike(classes: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """A new number for each class, such that classes which follow the same ones share a group of the softmax: halves along
    the main axis of the (square roots of) shares of the classes before, again and again."""
    size, groups = group_sizes(n)
    inside = np.ones(len(classes), bool)
    inside[first[first < len(classes)]] = False
    at = np.flatnonzero(inside)
    pairs = np.bincount(classes[at - 1] * np.int64(n) + classes[at], minlength=n * n).reshape(n, n).T.astype(float)
    weight = np.bincount(classes, minlength=n) + 1.0
    rows = np.sqrt((pairs + 0.5 * weight / weight.sum()) / (pairs.sum(axis=1, keepdims=True) + 0.5))
    parts, out = [(np.arange(n), groups)], []
    while parts:
        own, many = parts.pop()
        if many == 1:
            out.append(own)
            continue
        x = rows[own] - np.average(rows[own], axis=0, weights=weight[own])
        axis = np.linalg.svd(x * np.sqrt(weight[own])[:, None], full_matrices=False)[2][0]
        own = own[np.argsort(x @ axis, kind="stable")]
        parts += [(own[many // 2 * size :], many - many // 2), (own[: many // 2 * size], many // 2)]
    number = np.empty(n, np.int64)
    number[np.concatenate(out)] = np.arange(n)
    return number


def _training(p: LM) -> Column:
    return crc_of(F.col("doc_id")) % p.fold != p.held


def _pairs(a: np.ndarray, b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of small numbers, and how often each occurs."""
    counts = np.bincount(a * np.int64(max(1, width)) + b)
    have = np.flatnonzero(counts)
    return *np.divmod(have, max(1, width)), counts[have]


def _counted(subwords: Subwords, kinds: Kinds):
    """(kind 0, word hash, count, kind of text), (kind 1, subword id, count) and (kind 2, 0, texts) of a partition's batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in split_bytes(batches, limit=3 << 20):
            r = Read(batch.column(0), subwords)
            of = kinds.of(r)
            z, w, n = _pairs(np.repeat(of, np.diff(r.first)), r.which, len(r.distinct))
            z_ids, ids, k = _pairs(np.repeat(of, np.diff(r.id_first)), r.ids, subwords.size + 1)
            ends = np.bincount(of, minlength=len(kinds.prior))
            kind = np.repeat(np.array([0, 1, 2], np.int8), [len(n), len(ids), len(ends)])
            key = np.concatenate([r.distinct[w].astype(np.int64), ids, np.zeros(len(ends), np.int64)])
            group = np.concatenate([z, z_ids, np.arange(len(ends))]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), pa.array(np.concatenate([n, k, ends]).astype(np.int64)), pa.array(group)], ["kind", "key", "n", "z"])

    return run


def _local(model: Model, rounds: int = 1):
    """A partition's own training from the shared start; one row: its weights times the ids seen, and these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Attention(model.p, np.zeros(model.p.outputs)).load(model.attention.weights())
        seen = 0
        for batch in split_bytes(batches, limit=2 << 20):
            r = Read(batch.column(0), model.subwords)
            a.train(model.of_id[r.ids], r.id_first, rounds, model.p.rate, seed=seen)
            seen += len(r.ids)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([(a.weights().astype(np.float64) * seen).tobytes()], pa.binary()), pa.array([seen], pa.int64())], ["w", "n"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, seen = None, 0
    for batch in batches:
        for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            w = np.frombuffer(w, np.float64)
            total, seen = w.copy() if total is None else total + w, seen + n
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([seen], pa.int64())], ["w", "n"])


def _mixture(model: Model, texts: pa.Array, rare: Rare | None = None) -> np.ndarray:
    """The weights of the parts that fit texts which the attention was not trained on best, by EM."""
    r = Read(texts, model.subwords)
    logs, _ = model.word_logs(r, rare)
    stage = r.stage()
    w, n = model.mixture.copy(), np.bincount(stage, minlength=STAGES)[:, None]
    prior = 20.0  # words that a stage borrows from the mean of all
    for _ in range(60):
        parts = np.log(w)[stage].T + logs
        share = np.exp(parts - np.logaddexp.reduce(parts, axis=0))
        sums = np.stack([np.bincount(stage, part, STAGES) for part in share], axis=1)
        w = (sums + prior * sums.sum(0) / n.sum()) / (n + prior)
        w = np.maximum(w, 0.005)
        w /= w.sum(1, keepdims=True)
    return w


def train(docs: DataFrame, p: LM = LM()) -> tuple[Model, DataFrame]:  # noqa: B008
    """The model, and the table of word counts (key, n, and z0, z1, ... by kind) of the training documents."""
    spark = docs.sparkSession
    subwords = Subwords(Path(p.vocabulary).read_bytes())  # on the driver; the ranks travel with the functions
    rows = docs.filter(_training(p))
    place = F.xxhash64(F.lit(11), F.col("doc_id").cast("string"), F.col("text"))
    edge = rows.select(place.alias("h")).orderBy("h").limit(p.start_rows).agg(F.max("h")).first()[0]
    sample = rows.filter(place <= edge).select("text", place.alias("h")).orderBy("h", "text").limit(p.start_rows).toArrow()
    texts = sample["text"].combine_chunks() if sample.num_rows else pa.array([], pa.string())
    kinds = Kinds.fit(Read(texts, None), p)
    sums = [F.sum(F.when(F.col("z") == z, F.col("n")).otherwise(0)).alias(f"z{z}") for z in range(p.kinds)]
    counted = rows.select("text").mapInArrow(_counted(subwords, kinds), "kind byte, key long, n long, z byte")
    counts = written(counted.groupBy("kind", "key").agg(F.sum("n").alias("n"), *sums), "lm-counts")
    z_names = [f"z{z}" for z in range(p.kinds)]
    table = counts.filter("kind = 0").select("key", "n", *z_names)
    totals = counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("k"), *[F.sum(z).alias(z) for z in z_names]).collect()
    n, k = ({r["kind"]: r[c] for r in totals} for c in ("n", "k"))
    ends, distinct = n.get(2, 0), k.get(0, 0)
    # subword ids: one row an id, 50 thousand at most
    ids = counts.filter("kind = 1").select("key", *[f"z{z}" for z in range(p.kinds)]).toArrow()
    seen = np.zeros((p.kinds, subwords.size + 1), np.int64)
    for z in range(p.kinds):
        seen[z, ids["key"].to_numpy()] = ids[f"z{z}"].to_numpy()
    of_id, log_rest = classes(seen, subwords, p)
    by_class = np.bincount(of_id, seen.sum(axis=0) + 0.01, p.outputs) + 1e-6
    log_class = np.log(by_class / by_class.sum())
    model = Model(p, subwords, of_id, log_rest, Attention(p, log_class))
    # the most frequent words: the least count at which at most top_words words are left
    least = 1
    if distinct > p.top_words:
        sizes = sorted(((r["n"], r["k"]) for r in table.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True)  # a row for each distinct count
        room, least = p.top_words, sizes[0][0] + 1
        for count, words_with in sizes:
            if words_with > room:
                break
            room, least = room - words_with, count
    top = counts.filter((F.col("kind") == 0) & (F.col("n") >= least)).select("key", "n", *[F.col(f"z{z}").cast("float").alias(f"z{z}") for z in range(p.kinds)]).toArrow()
    hashes = top["key"].to_numpy().astype(np.uint64)
    by = np.argsort(hashes)
    model.top, model.top_counts, model.whole = hashes[by], top["n"].to_numpy()[by], distinct <= top.num_rows
    model.ends, model.tokens, model.kinds = int(ends), int(n.get(0, 0) + ends), int(distinct + (ends > 0))
    if ends:
        by_kind = {r["kind"]: np.array([r[z] for z in z_names], float) for r in totals}
        model.ends_by_kind, model.of_kind = by_kind[2], by_kind[2] + by_kind.get(0, 0.0)
        model.top_by_kind = np.stack([top[z].to_numpy()[by] for z in z_names], axis=1)
        model.prior = (by_kind[2] + 1) / (ends + p.kinds)
        del top
        cut = max(1, len(texts) * 4 // 5)
        r = Read(texts.slice(0, cut), subwords)
        limit = r.id_first[min(len(r.id_first) - 1, max(1, int(np.searchsorted(r.id_first, p.start_ids))))]
        keep = r.id_first[r.id_first <= limit]
        number = alike(of_id[r.ids[:limit]], keep, p.outputs)
        model.of_id = of_id = number[of_id]
        model.attention = Attention(p, log_class[np.argsort(number)])
        model.attention.train(of_id[r.ids[:limit]], keep, int(np.clip(2 * p.start_ids // max(1, limit), 2, 10)), 0.02)
        # the texts that fit the mixture do not train, nor do their repeated rows
        fits = F.lit(False) if cut == len(texts) else place.between(sample["h"][cut].as_py(), edge)
        others = rows.filter(~fits)
        local = others.select("text").mapInArrow(_local(model), "w binary, n long").withColumn("g", F.pmod(F.spark_partition_id(), F.lit(64)))
        sums = local.repartition(min(64, int(spark.conf.get("spark.sql.shuffle.partitions"))), "g").select("w", "n").mapInArrow(_added, "w binary, n long").collect()
        held = texts.slice(cut) if cut < len(texts) else texts
        if sums:
            alone = lambda: float(model.word_logs(Read(held, subwords))[0][0].mean() / math.log(10))
            before = alone()
            model.trained = sum(s["n"] for s in sums)
            model.attention.load(sum(np.frombuffer(s["w"], np.float64) for s in sums) / model.trained)
            model.held_out = (before, alone())
        rare = None
        if not model.whole:  # the words of 300 texts at most
            asked = Read(held, None).distinct
            asked = spark.createDataFrame(pa.table({"key": asked[model.places(asked) < 0].astype(np.int64)}))
            rare = Rare.of([c.combine_chunks() for c in table.join(asked, "key").select("key", "n", *z_names).toArrow().columns])
        model.mixture = _mixture(model, held, rare)
    return model, table


def _asked(model: Model):
    """(rid, key) of the distinct words of each text that the table of frequent words lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in split_bytes(batches, limit=3 << 20):
            r = Read(batch.column(1), None)
            text = np.repeat(np.arange(batch.num_rows), np.diff(r.first))
            odd = (model.places(r.distinct) < 0)[r.which]
            t, w = np.divmod(np.unique(text[odd] * np.int64(len(r.distinct) + 1) + r.which[odd]), len(r.distinct) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(t)), pa.array(r.distinct[w].astype(np.int64))], ["rid", "key"])

    return run


def _scored(model: Model):
    """A row for each text; where the table of frequent words is not whole, the last column has the counts of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "score"]
        for batch in split_bytes(batches, limit=3 << 20):
            r = Read(batch.column(2), model.subwords)
            logs, counts = model.word_logs(r, None if model.whole else Rare.of(batch.column(3).flatten().flatten()))
            at = r.word_first[:-1]  # every text has its end, so no range is empty
            score = np.add.reduceat(model.mixed(logs, r.stage()), at) / math.log(10)
            c = counts[r.word]
            base = np.add.reduceat(np.log10(c + 1), at)
            seen = np.add.reduceat((c > 0).astype(np.int64), at)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(2)], pa.array(np.diff(r.word_first)), pa.array(seen), pa.array(base), pa.array(score)], names)

    return run


def score_documents(docs: DataFrame, p: LM = LM()) -> DataFrame:  # noqa: B008
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    model, table = train(docs, p)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~_training(p)).alias("held_out"), "text")
    if not model.whole:
        rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "lm-texts")
        found = rows.select("rid", "text").mapInArrow(_asked(model), "rid long, key long").join(table, "key")
        found = found.groupBy("rid").agg(F.collect_list(F.struct(*table.columns)).alias("known"))
        rows = rows.join(found, "rid", "left").select("doc_id", "held_out", "text", "known")
    out = written(rows.mapInArrow(_scored(model), "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"), "lm-scores")
    rest = math.log10(model.tokens + model.kinds + 1)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * rest).alias("base_score"), "score")
