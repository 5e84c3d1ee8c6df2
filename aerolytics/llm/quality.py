"""Quality from weak labels: overlapping heuristics vote, expectation-maximisation weighs them, a hashed linear scorer learns the result.

1. Twelve labellers vote good, bad or nothing on every document. Votes of a document form a pattern (at most 3^12), and
   the patterns of all documents are counted.
2. EM over the pattern counts estimates the share of good documents and each labeller's vote probabilities for good
   and for bad ones (a Dawid-Skene model; no hand labels). It gives each pattern the posterior probability of good.
3. A logistic model over hashed word, word-shape and repetition features, normalised by length, learns the posteriors
   of at most `most_rows` documents, the least by hash. It scores every whole text.

Defined cases: null and empty texts have no votes but "too short" and score by the intercept alone; repeated rows are
scored alike; a text of any length is read whole; of documents with one hash at the edge of the sample the texts of
least order are taken, and a score of 0.5 keeps; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import buffers, split_bytes, words

LABELLERS = "word_length symbols capitals variety repeated_lines top_word shouting length line_ends letters loose_signs signed_words".split()
_GOOD, _BAD, _NONE = 2, 0, 1
BITS = 18

_KIND = np.zeros(256, np.int64)  # 0 space, 1 lower, 2 upper, 3 digit, 4 sentence signs, 5 ! and ?, 6 other signs, 7 beyond ASCII
_KIND[33:127] = 6
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[ord(c) for c in ".,;:'\"()-"]] = 4
_KIND[[ord("!"), ord("?")]] = 5
_KIND[128:] = 7


def _vote(bad: bool, good: bool) -> int:
    return _BAD if bad else _GOOD if good else _NONE


def votes(texts: pa.Array) -> np.ndarray:
    """A row of twelve votes (0 bad, 1 none, 2 good) for each text."""
    data, offsets = buffers(texts)
    h, first, starts, ends = words(texts, True)
    out = np.full((len(texts), len(LABELLERS)), _NONE, np.int64)
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        n = int(b - a)
        if not n:
            out[i, 7] = _BAD
            continue
        raw = data[offsets[i] : offsets[i + 1]]
        kinds = np.bincount(_KIND[raw], minlength=8)
        solid = max(1, int(kinds[1:].sum()))
        letters = max(1, int(kinds[1] + kinds[2] + kinds[7]))
        mean = float((ends[a:b] - starts[a:b]).mean())
        _, counts = np.unique(h[a:b], return_counts=True)
        lines = [x for x in raw.tobytes().split(b"\n") if x.strip()]
        whole = sum(x.rstrip()[-1:] in b".!?:\"'" for x in lines) / len(lines)
        again = 1 - len(set(lines)) / len(lines)
        tail, head = _KIND[data[ends[a:b] - 1]] == 6, _KIND[data[starts[a:b]]] == 6
        loose, signed = (tail & head).mean(), tail.mean()
        signs, upper, variety, top, cry = kinds[6] / solid, kinds[2] / letters, len(counts) / n, counts.max() / n, kinds[5] / solid
        out[i] = (
            _vote(mean < 2.5 or mean > 14, 3.5 <= mean <= 10), _vote(signs > 0.04, signs < 0.01), _vote(upper > 0.35, upper < 0.15),
            _vote(n >= 30 and variety < 0.2, n >= 30 and variety > 0.35), _vote(again > 0.3, len(lines) >= 3 and again < 0.1), _vote(n >= 20 and top > 0.2, n >= 20 and top < 0.12),
            _vote(cry > 0.03, cry < 0.01), _vote(n < 3, n >= 20), _vote(whole < 0.3, whole > 0.7), _vote(letters / solid < 0.7, letters / solid > 0.88),
            _vote(loose > 0.08, loose < 0.01), _vote(signed > 0.12, signed < 0.02),
        )
    return out


@dataclass
class LabelModel:
    share: float
    table: np.ndarray  # [labeller, class, vote]

    def posterior(self, v: np.ndarray) -> np.ndarray:
        j = np.arange(v.shape[1])
        logs = np.log(self.table)
        good = np.log(self.share) + logs[j, 1, v].sum(1)
        bad = np.log(1 - self.share) + logs[j, 0, v].sum(1)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))

    @property
    def accuracies(self) -> dict[str, float]:
        """How often a labeller that votes is right."""
        t, p = self.table, np.array([1 - self.share, self.share])
        right = p[0] * t[:, 0, _BAD] + p[1] * t[:, 1, _GOOD]
        cast = sum(p[c] * (t[:, c, _BAD] + t[:, c, _GOOD]) for c in (0, 1))
        return dict(zip(LABELLERS, right / cast, strict=True))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """patterns: rows of votes, counts: how often each occurs."""
    n = patterns.shape[1]
    table = np.empty((n, 2, 3))
    table[:, 0], table[:, 1] = (0.5, 0.35, 0.15), (0.04, 0.3, 0.66)
    model = LabelModel(0.85, table)
    hot = np.eye(3)[patterns]  # [pattern, labeller, vote]
    for _ in range(rounds):
        q = model.posterior(patterns) * counts
        share = float(np.clip(q.sum() / counts.sum(), 0.02, 0.98))
        new = np.stack([np.einsum("p,plv->lv", counts - q, hot), np.einsum("p,plv->lv", q, hot)], axis=1) + 0.5
        new /= new.sum(2, keepdims=True)
        done = np.abs(new - model.table).max() < 1e-7
        model = LabelModel(share, new)
        if done:
            break
    return model


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, first, n): feature indices of text i are index[first[i]:first[i + 1]], three for each of its n words: word, shape, repetition."""
    data, _ = buffers(texts)
    h, first, starts, ends = words(texts, True)
    n = np.diff(first)
    if not len(h):
        return np.empty(0, np.int64), first * 3, n
    size = np.minimum(ends - starts, 15)
    shape = ((_KIND[data[starts]] * 8 + _KIND[data[ends - 1]]) * 16 + size) * 8 + _KIND[data[(starts + ends) // 2]]
    same = np.zeros(len(h), np.int64)
    same[1:] = h[1:] == h[:-1]
    inner = first[1:-1][first[1:-1] < len(h)]
    same[inner] = 0
    base = 1 << BITS
    return np.stack([(h & np.uint64(base - 1)).astype(np.int64), base + shape, base + 8192 + same], axis=1).ravel(), first * 3, n


WIDTH = (1 << BITS) + 8192 + 2


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        index, first, n = hashed(texts)
        sums = np.append(0.0, np.cumsum(self.weights[index], dtype=np.float64))
        z = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)
        return 1 / (1 + np.exp(-(z + self.bias)))


def fit_scorer(texts: pa.Array, target: np.ndarray, rounds: int = 120, rate: float = 0.5, l2: float = 1e-7) -> Scorer:
    """Adagrad on the logistic loss with the posteriors as targets."""
    parts = [hashed(t) for t in _sliced(texts)]
    n = np.concatenate([x for _, _, x in parts])
    used, at = np.unique(np.concatenate([x.astype(np.int32) for x, _, _ in parts]), return_inverse=True)
    at, doc = at.astype(np.int32), np.repeat(np.arange(len(n), dtype=np.int32), n * 3)
    each = (1 / np.maximum(n, 1)).astype(np.float32)[doc]
    del parts
    w, g2, b, b2 = np.zeros(len(used)), np.full(len(used), 1e-8), 0.0, 1e-8
    for _ in range(rounds):
        z = np.bincount(doc, w[at] * each, minlength=len(n)) + b
        err = (1 / (1 + np.exp(-z)) - target) / max(1, len(n))
        g = np.bincount(at, err[doc] * each, minlength=len(used)) + l2 * w
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
        gb = err.sum()
        b2 += gb * gb
        b -= rate * gb / np.sqrt(b2)
    weights = np.zeros(WIDTH, np.float32)
    weights[used] = w
    return Scorer(weights, float(b))


def _sliced(texts: pa.Array, rows: int = 200) -> Iterator[pa.Array]:
    for a in range(0, len(texts), rows):
        yield texts.slice(a, rows)


def _patterns(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in split_bytes(batches):
            v = votes(batch.column(0))
            keys, n = np.unique(v @ 3 ** np.arange(v.shape[1]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pattern", "n"])

    return docs.select("text").mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def _unpack(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


@dataclass
class Model:
    labels: LabelModel
    scorer: Scorer


def train(docs: DataFrame, most_rows: int = 4_000) -> Model | None:
    """The label model sees the vote patterns of all documents; the scorer at most most_rows texts, a bounded sample by hash."""
    got = _patterns(docs).toArrow()
    if not got.num_rows:
        return None
    labels = expectation_maximisation(_unpack(got["pattern"].to_numpy()), got["n"].to_numpy().astype(float))
    order = F.xxhash64(F.lit(3), F.col("doc_id").cast("string"))
    edge = docs.select(order.alias("h")).orderBy("h").limit(most_rows).agg(F.max("h")).first()[0]
    rows = docs.filter(order <= edge).select("doc_id", "text", order.alias("h")).orderBy("h", "text").limit(most_rows).toArrow()
    texts = rows["text"].combine_chunks() if rows.num_rows else pa.array([], pa.string())
    texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    return Model(labels, fit_scorer(texts, labels.posterior(np.concatenate([votes(t) for t in _sliced(texts)]))))


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score (probability of good), keep (score >= 0.5), posterior (of the labellers' votes alone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in split_bytes(batches):
            s = model.scorer.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(s >= 0.5), pa.array(model.labels.posterior(votes(batch.column(1))))], ["doc_id", "score", "keep", "posterior"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, keep boolean, posterior double")
