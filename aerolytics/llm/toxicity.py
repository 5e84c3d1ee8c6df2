"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration. numpy only.

Features of a text: densities and sums of hits in a fixed list of insults and in a lexicon learnt from labelled texts
(words, and beginnings of words, whose document frequency is much higher in toxic ones), how many hits stand near the
second person, and rates of capitals, shouted words, exclamation and question marks, punctuation and obfuscation
(letters mixed with digits or signs, insults after undoing such signs, spelled-out words, drawn-out letters).

Training reads labelled rows only, at most `most_rows` of them, the least by hash, in one task; the driver gets the model alone. It is cross-fitted at every size: the
features of a fold's rows come from a lexicon that the other folds taught, and the calibration from the scores of trees
that the other folds grew; the final lexicon and trees learn from all rows. Boosting starts from a fixed rule on the
insult list (log odds PRIOR or -PRIOR) and calibration is drawn to the uncalibrated score, so with few labels, one class only or none
the score goes over into that rule without a switch. Scoring reads whole texts, batch by batch, in one pass; its time is
linear in the text, however long an unbroken run of signs is.

Defined cases: null and empty texts have all-zero features and get the score of such texts; a document labelled more
than once is toxic if any label says so; labels without a document, or null, are ignored; repeated rows of a document
are scored alike, and each that is labelled teaches; of equal scores none is preferred, as a row goes by its own score; an
empty table gives no rows; columns other than doc_id and text are not read and come back as they are, whatever their names.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of, free
from .words import split_bytes

# Common insults, and second-person words of four languages.
INSULTS = frozenset("idiot idiots moron morons stupid loser losers pathetic worthless trash scum clown disgusting dumb ugly filthy vermin garbage imbecile coward pig freak jerk fool retard bastard bitch asshole shit fuck".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu toi te vous votre vos ton ta tes ti usted ustedes vosotros".split())

_SPLIT = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_SIGN = re.compile(r"[0-9@$!|+*#%&][^\W\d_]")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\w)")
_DRAWN = re.compile(r"([^\W\d_])\1\1")
_LEET = str.maketrans("013457@$!|+", "oieastasiit")
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 3
_CLASS[ord("!")] = 4
_CLASS[ord("?")] = 5
_CLASS[[ord(c) for c in "*%$#&@|+=<>^~_/\\[]{}"]] = 6
_CLASS[48:58] = 7
NEAR = 5
PREFIXES = (4, 5, 6)

NAMES = "words insults insult_density learnt learnt_sum learnt_max learnt_density starts starts_sum starts_max starts_density second near_second capitals shouted exclaim question punctuation signs digits mixed leet spaced drawn".split()


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    starts: dict[str, float] = field(default_factory=dict)


def features(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    out = np.zeros((len(texts), len(NAMES)))
    known, starts = lexicon.words, lexicon.starts
    for row, text in zip(out, texts, strict=True):
        if not text:
            continue
        words = _SPLIT.findall(text.lower())
        n = max(1, len(words))
        count = Counter(words)
        insults = sum(count[w] for w in INSULTS & count.keys())
        hits = [(known[w], count[w]) for w in known.keys() & count.keys()] if known else []
        begin = []
        if starts:
            for w, c in count.items():
                for k in PREFIXES:
                    if len(w) >= k and (v := starts.get(w[:k])) is not None:
                        begin.append((v, c))
                        break
        near = 0
        if (insults or hits or begin) and not SECOND.isdisjoint(count):
            bad = np.array([i for i, w in enumerate(words) if w in INSULTS or w in known or any(w[:k] in starts for k in PREFIXES)])
            you = np.array([i for i, w in enumerate(words) if w in SECOND])
            at = np.searchsorted(you, bad)
            gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - bad), np.abs(you[np.maximum(at - 1, 0)] - bad)) if len(bad) else np.empty(0)
            near = int((gap <= NEAR).sum())
        raw = text.encode()
        kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8)
        size, letters = len(raw), max(1, kinds[1] + kinds[2])
        shouted = len(re.findall(r"\b[A-Z]{3,}\b", text)) if kinds[1] > 2 else 0
        # what stands between white space and has a digit or a sign before a letter
        mixed = [(m, c) for m, c in Counter(text.split()).items() if _SIGN.search(m)] if kinds[4] + kinds[6] + kinds[7] else []
        leet = sum(c for m, c in mixed if not INSULTS.isdisjoint(re.findall(r"[a-z]+", m.lower().translate(_LEET))))
        row[:] = (
            np.log1p(len(words)), insults, insults / n, sum(c for _, c in hits), sum(v * c for v, c in hits), max((v for v, _ in hits), default=0), sum(c for _, c in hits) / n,
            sum(c for _, c in begin), sum(v * c for v, c in begin), max((v for v, _ in begin), default=0), sum(c for _, c in begin) / n, sum(count[w] for w in SECOND & count.keys()) / n, near,
            kinds[1] / letters, shouted / n, kinds[4] / size, kinds[5] / size, kinds[3] / size, kinds[6] / size, kinds[7] / size, sum(c for _, c in mixed) / n, leet,
            len(_SPACED.findall(text)), len(_DRAWN.findall(text)) / n,
        )
    return out


LEAST_TOXIC = 4  # texts, for a word of the lexicon
Seen = dict[str, tuple[Counter, Counter]]


def _beginnings(words: set[str]) -> set[str]:
    return {w[:k] for w in words for k in PREFIXES if len(w) >= k}


def document_frequencies(texts: Iterable[str | None], labels: Iterable[int], only: dict[str, set[str]] | None = None) -> Seen:
    """How many clean and how many toxic texts hold each word, and each beginning of a word; of clean texts those in `only`, or none."""
    seen: Seen = {"words": (Counter(), Counter()), "starts": (Counter(), Counter())}
    for text, y in zip(texts, labels, strict=True):
        if not y and only is None:
            continue
        words = set(_SPLIT.findall((text or "").lower()))
        for kind, found in (("words", words), ("starts", _beginnings(words))):
            seen[kind][y].update(found if y else found & only[kind])
    return seen


def learn_lexicon(parts: list[Seen], texts: tuple[int, int], most: int = 400, ratio: float = 4.0) -> Lexicon:
    """Words and beginnings of words whose smoothed document frequency is `ratio` times higher in toxic texts, the strongest
    `most` of each; texts: how many clean and toxic ones the parts have."""
    n = [max(1, k) for k in texts]
    found = {}
    for kind in ("words", "starts"):
        bad = sum((p[kind][1] for p in parts), Counter())
        scored = []
        for w, k in bad.items():
            if k < LEAST_TOXIC:
                continue
            odds = np.log(((k + 0.1) / n[1]) / ((sum(p[kind][0][w] for p in parts) + 0.5) / n[0]))
            if odds >= np.log(ratio):
                scored.append((odds * np.sqrt(k), w, float(odds)))
        scored.sort(key=lambda x: (-x[0], x[1]))
        found[kind] = {w: odds for _, w, odds in scored[:most]}
    return Lexicon(**found)


class Trees:
    """Boosted regression trees on the logistic loss, by histograms of quantile bins."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 2.0, least: int = 5):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least
        self.cuts: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature (-1: leaf), cut, value of each node in heap order
        self.start = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, offset: np.ndarray | None = None) -> Trees:
        """offset: log odds to start from, by default those of the mean of y."""
        for j in range(x.shape[1]):
            self.cuts.append(np.unique(np.quantile(np.unique(x[:, j]), np.linspace(0, 1, self.bins + 1)[1:-1])))
        b, n, d = self._binned(x), len(y), x.shape[1]
        width = self.bins + 1
        if offset is None:
            rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
            self.start = float(np.log(rate / (1 - rate)))
        f = np.full(n, self.start) if offset is None else offset.astype(float)
        slots = b + np.arange(d) * width
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            size = 2 ** (self.depth + 1) - 1
            feature, cut, value, node = np.full(size, -1), np.zeros(size), np.zeros(size), np.zeros(n, np.int64)
            for k in range(size):
                rows = np.flatnonzero(node == k)
                if len(rows) < self.least:  # of the first node only: others are cut so that they hold as many
                    continue
                gs, hs = g[rows].sum(), h[rows].sum()
                value[k] = self.rate * gs / (hs + self.l2)
                if 2 * k + 2 >= size or len(rows) < 2 * self.least:
                    continue
                at = slots[rows].ravel()
                gh = np.bincount(at, np.repeat(g[rows], d), d * width).reshape(d, width).cumsum(1)
                hh = np.bincount(at, np.repeat(h[rows], d), d * width).reshape(d, width).cumsum(1)
                nh = np.bincount(at, minlength=d * width).reshape(d, width).cumsum(1)
                gain = gh**2 / (hh + self.l2) + (gs - gh) ** 2 / (hs - hh + self.l2) - gs**2 / (hs + self.l2)
                gain[(nh < self.least) | (len(rows) - nh < self.least)] = -1
                j, c = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, c] <= 1e-6 or c >= len(self.cuts[j]):
                    continue
                feature[k], cut[k] = j, self.cuts[j][c]
                node[rows] = 2 * k + 1 + (b[rows, j] > c)
            f += value[node]
            self.trees.append((feature, cut, value))
        return self

    def raw(self, x: np.ndarray, offset: np.ndarray | None = None) -> np.ndarray:
        f = np.full(len(x), self.start) if offset is None else offset.astype(float)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                j = feature[node]
                node = np.where(j >= 0, 2 * node + 1 + (x[np.arange(len(x)), np.maximum(j, 0)] > cut[node]), node)
            f += value[node]
        return f


def _odds(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -50, 50)))


class Isotonic:
    """Pool adjacent violators, linear in between. A case at each point of a grid of uncalibrated scores stands beside the
    rows, and each block is drawn to its mean uncalibrated score by `prior` cases: few rows move the score little."""

    GRID = np.linspace(-6, 6, 25)

    def __init__(self, prior: float = 1.5):
        self.prior, self.x, self.y = prior, self.GRID, _odds(self.GRID)

    def fit(self, s: np.ndarray, y: np.ndarray) -> Isotonic:
        s, y = np.append(s, self.GRID), np.append(y, _odds(self.GRID))
        order = np.argsort(s, kind="stable")
        blocks: list[list[float]] = []  # mean of s, sum of y, cases, sum of uncalibrated scores
        for x, v, o in zip(s[order], y[order], _odds(s[order]), strict=True):
            blocks.append([x, float(v), 1.0, o])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
                x2, v2, n2, o2 = blocks.pop()
                x1, v1, n1, o1 = blocks[-1]
                blocks[-1] = [(x1 * n1 + x2 * n2) / (n1 + n2), v1 + v2, n1 + n2, o1 + o2]
        self.x = np.array([b[0] for b in blocks])
        self.y = np.maximum.accumulate(np.array([(b[1] + self.prior * b[3] / b[2]) / (b[2] + self.prior) for b in blocks]))
        return self

    def __call__(self, s: np.ndarray) -> np.ndarray:
        # a slope of 1e-6 of the logit keeps the order among equal blocks
        return np.clip(0.998 * np.interp(s, self.x, self.y) + 0.002 * _odds(s), 0, 1)


PRIOR = 2.5
FOLDS = 5


def _prior(x: np.ndarray) -> np.ndarray:
    """Log odds before any label is seen: whether an insult of the list stands there, plain or disguised."""
    return np.where(x[:, NAMES.index("insults")] + x[:, NAMES.index("leet")] > 0, PRIOR, -PRIOR)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    calibrated: Isotonic

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = features(texts, self.lexicon)
        return self.calibrated(self.trees.raw(x, _prior(x)))


def fit(texts: list[str | None] | pa.ChunkedArray, labels: np.ndarray, part: np.ndarray) -> Model:
    """part: 0 to 9 for each row, two to a fold. Texts are read some at a time, and clean ones counted only for words that
    enough toxic ones hold, so that little beside the texts is in memory."""
    texts = texts if isinstance(texts, pa.ChunkedArray) else pa.chunked_array([pa.array(texts, pa.string())])
    fold, y = part // 2, labels.astype(float)
    rows = [np.flatnonzero(fold == j) for j in range(FOLDS)]

    def each(own: np.ndarray, size: int = 200) -> Iterator[list[str | None]]:
        for at in range(0, len(own), size):
            yield texts.take(pa.array(own[at : at + size])).to_pylist()

    toxic = [document_frequencies(chain.from_iterable(each(own)), labels[own]) for own in (r[labels[r] > 0] for r in rows)]
    often = {kind: {w for w, k in sum((s[kind][1] for s in toxic), Counter()).items() if k >= LEAST_TOXIC} for kind in ("words", "starts")}
    seen = [document_frequencies(chain.from_iterable(each(own)), labels[own], often) for own in rows]
    n = [(int((labels[own] == 0).sum()), int(labels[own].sum())) for own in rows]
    total = tuple(map(sum, zip(*n, strict=True)))
    x, raw = np.zeros((len(texts), len(NAMES))), np.zeros(len(texts))
    for j, own in enumerate(rows):
        others = learn_lexicon([s for i, s in enumerate(seen) if i != j], (total[0] - n[j][0], total[1] - n[j][1]))
        if len(own):
            x[own] = np.concatenate([features(some, others) for some in each(own)])
    grown = lambda which: Trees(least=max(5, len(which) // 300)).fit(x[which], y[which], _prior(x[which])) if len(which) else Trees()
    for own in rows:
        raw[own] = grown(np.setdiff1d(np.arange(len(texts)), own)).raw(x[own], _prior(x[own]))
    return Model(learn_lexicon(seen, total), grown(np.arange(len(texts))), Isotonic().fit(raw, y))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of the rows (doc_id, text, toxic) of the one partition that a limit leaves, its parts' values pickled; none without rows."""
    held = [batch for batch in batches if batch.num_rows]
    if held:
        rows = pa.Table.from_batches(held)
        part = (rows["doc_id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(10)
        model = fit(rows["text"], (rows["toxic"].to_numpy() > 0).astype(int), part.astype(int))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps([vars(x) for x in (model.lexicon, model.trees, model.calibrated)])], pa.binary())], ["model"])


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 8_000, fold: int = 5, held: int = 0) -> Model:
    """Learns from labelled documents whose crc32(doc_id) mod fold is not `held`: at most most_rows, a bounded sample by hash.
    One task of an executor fits the model; neither texts nor counts reach the driver."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("toxic"))
    known = known.filter(crc_of(F.col("id")) % fold != held).orderBy(F.xxhash64("id"), "id").limit(most_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), F.col("doc_id") == F.col("id")).select("doc_id", "text", "toxic")
    found = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most_rows).mapInArrow(_fitted, "model binary").collect()
    if not found:
        return fit([], np.empty(0, int), np.empty(0, int))
    model = Model(Lexicon(), Trees(), Isotonic())
    for part, values in zip((model.lexicon, model.trees, model.calibrated), pickle.loads(found[0].model), strict=True):
        vars(part).update(values)
    return model


def scored(docs: DataFrame, model: Model, fold: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in split_bytes(batches):
            s = model.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc_of(F.col("doc_id")) % fold == held).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that score 0.5 or more, in one pass; all columns are kept as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in split_bytes(batches, name):
            at = batch.schema.get_field_index(name)
            keep = pa.array(model.score(batch.column(at).to_pylist()) < 0.5)
            yield batch.select([n for n in batch.schema.names if n != name]).filter(keep)

    name = free(docs, "text")
    return docs.withColumn(name, F.col("text")).mapInArrow(run, docs.schema)
