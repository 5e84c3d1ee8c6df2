"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, signature shingles, exact verification.

Items and documents are read as lower-cased words. Anchors are the words whose hash is least among `around` words in a
row, so a copy of an item has the anchors of the item whatever stands about it. A window runs from an anchor over the
longest length of a geometric ladder that the item allows: every anchor in the item's first half, and so every window of
half the item or more, is indexed; documents get windows of all ladder lengths at all their anchors. A window's
fingerprint is the SimHash of its words; words that a twentieth of the whole benchmark's items share weigh less,
however the items are dealt to passes.

Fingerprints are cut into blocks; two that differ in at most `radius` bits agree up to radius // blocks bits in one
block at least, so looking up each block with all its neighbours at that distance finds every fingerprint within the
radius (multi-index hashing). Windows alone lose copies that are edited where the anchors stand. Therefore every shingle
of a document is also looked up among the items' signatures: an item's signature is those of its 5-word shingles, least
shared among items first, that together weigh more than the part that a similar stretch may lack (1 - `similarity`), so
every stretch that reaches the similarity holds one of them at least.

What is found is verified by the exact weighted Jaccard similarity of 5-word shingles (a shingle weighs the sum of its
words): the best stretch near what was found, of half to about twice the item's words, that begins and ends with a
shingle of the item.

The index of a block of at most `items_a_pass` items travels to the executors (its size is bounded by that); more
items take more passes over the documents. Documents are read in one scan a pass, without a shuffle.

Defined cases: items without words match nothing; items shorter than a shingle are one shingle, looked up at every word;
items and texts of any length are searched whole; null and empty texts are clean; repeated rows, repeated items and equal
ids are all reported; of equally similar stretches the first is reported, and the longer of two that begin together only if it is more similar; empty
tables give no rows, or leave the documents as they are; extra columns are not read and come back whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, free, written
from .words import mix64, split_bytes, words


@dataclass(frozen=True)
class Decontaminate:
    similarity: float = 0.8
    shingle: int = 5
    radius: int = 7
    blocks: int = 4
    around: int = 5
    ratio: float = 1.25
    items_a_pass: int = 4_000

    def ladder(self, top: int) -> list[int]:
        """Window lengths up to `top`."""
        out, x = [], 1.0
        while round(x) <= top:
            if not out or round(x) > out[-1]:
                out.append(round(x))
            x = max(x * self.ratio, x + 1)
        return out


def _shingled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word runs."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = mix64(h[:n])
    for i in range(1, k):
        out = mix64(out * np.uint64(0x9FB21C651E98DF25) + h[i : i + n])
    return out


def _anchors(h: np.ndarray, around: int) -> np.ndarray:
    """Positions that are least among `around` words in a row."""
    n = len(h) - around + 1
    if n <= 0:
        return np.arange(min(1, len(h)))
    least = reduce(np.minimum, (h[i : i + n] for i in range(around)))
    flag = np.zeros(len(h), bool)
    for i in range(around):
        flag[i : i + n] |= h[i : i + n] == least
    return np.flatnonzero(flag)


class Weights:
    """4 for a word, 1 for one that a twentieth of all items of the benchmark or more hold (`common`: their hashes, ascending)."""

    def __init__(self, common: np.ndarray):
        self.common = common

    @classmethod
    def of(cls, items: list[np.ndarray]) -> Weights:
        seen, n = np.unique(np.concatenate([np.unique(h) for h in items] or [np.empty(0, np.uint64)]), return_counts=True)
        return cls(seen[n >= cls.least(len(items))])

    @staticmethod
    def least(items: int) -> int:
        """Items that hold a common word, at the least."""
        return max(2, -(-items // 20))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.full(len(h), 4, np.int16)
        at = np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)
        return np.where(self.common[at] == h, 1, 4).astype(np.int16)


def _spread(width: int) -> np.ndarray:
    """For each group of 64 // width bits, those bits in lanes of `width` bits of a 64-bit number."""
    n = 64 // width
    bits = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    return (bits.astype(np.uint64) << (np.arange(n, dtype=np.uint64) * np.uint64(width))).sum(axis=1, dtype=np.uint64)


_SPREAD = {8: _spread(8), 16: _spread(16), 32: _spread(32)}
_LANE = {8: np.uint8, 16: np.uint16, 32: np.uint32}


class Sums:
    """Running sums of the word weights for each of 64 hash bits, packed in lanes. Sums wrap as 64-bit numbers, yet the
    difference over a window is exact, lane by lane, as long as a window's weights fit a lane."""

    def __init__(self, h: np.ndarray, w: np.ndarray, width: int):
        self.width = width
        octets = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8).T
        bits = 64 // width  # of a hash in one packed number
        groups = octets if bits == 8 else np.concatenate([octets >> b & ((1 << bits) - 1) for b in range(0, 8, bits)])
        packed = _SPREAD[width][groups] * w.astype(np.uint64)
        self.sums = np.zeros((len(packed), len(h) + 1), np.uint64)
        np.cumsum(packed, axis=1, out=self.sums[:, 1:])
        self.total = np.append(0, np.cumsum(w, dtype=np.int64))

    def simhash(self, at: np.ndarray, length: int) -> np.ndarray:
        """Of the windows of `length` words from `at`: bit by bit, whether words with the bit weigh more than half."""
        inside = np.stack([row[at + length] - row[at] for row in self.sums], axis=1)
        half = (self.total[at + length] - self.total[at]) // 2
        kind = _LANE[self.width]
        return np.packbits(inside.view(kind) > half.astype(kind)[:, None], axis=1).view(np.uint64).ravel()


def _neighbours(bits: int, flips: int) -> np.ndarray:
    """All masks of at most `flips` ones."""
    out = [0]
    for _ in range(flips):
        out = sorted({m ^ (1 << b) for m in out for b in range(bits)} | set(out))
    return np.array(out, np.uint64)


class Multi:
    """Multi-index hashing over fingerprints: pairs (query, entry) within the radius."""

    def __init__(self, prints: np.ndarray, radius: int, blocks: int):
        self.prints, self.radius, self.blocks, self.bits = prints, radius, blocks, 64 // blocks
        masks = _neighbours(self.bits, radius // blocks)
        self.starts, self.lists = [], []
        for b in range(blocks):
            keys = (self._key(prints, b)[:, None] ^ masks[None]).ravel().astype(np.int64)
            order = np.argsort(keys, kind="stable")
            self.starts.append(np.searchsorted(keys[order], np.arange((1 << self.bits) + 1)).astype(np.int32))
            self.lists.append((order // len(masks)).astype(np.int32))

    def _key(self, prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(b * self.bits)) & np.uint64((1 << self.bits) - 1)

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for b in range(self.blocks):
            key = self._key(queries, b).astype(np.int64)
            a = self.starts[b][key]
            n = self.starts[b][key + 1] - a
            hit = np.flatnonzero(n)
            if not len(hit):
                continue
            a, n = a[hit].astype(np.int64), n[hit].astype(np.int64)
            q = np.repeat(hit, n)
            e = self.lists[b][np.repeat(a - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))]
            near = np.bitwise_count(queries[q] ^ self.prints[e]) <= self.radius
            found.append(np.stack([q[near], e[near]], axis=1))
        got = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        return got[:, 0], got[:, 1]


class Index:
    """What a pass needs of its items. Small when pickled: the lookup tables are built where they are used."""

    def __init__(self, ids: list[int], texts: list[str | None], p: Decontaminate, weights: Weights | None = None):
        """weights: those of the whole benchmark; without them, these items are the whole."""
        self.p = p
        h, first = words(pa.array(texts, pa.large_string()))
        self.items = [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        keep = [i for i, x in enumerate(self.items) if len(x)]
        self.ids, self.items = [ids[i] for i in keep], [self.items[i] for i in keep]
        self.weights = weights or Weights.of(self.items)
        ladder = p.ladder(max(map(len, self.items), default=0))
        self.width = next(w for w in _LANE if 4 * max(ladder, default=0) < 1 << w)
        self.windows: dict[int, list[tuple[int, int, int]]] = {}  # length -> (fingerprint, item, offset of the anchor)
        for i, x in enumerate(self.items):
            sums = Sums(x, self.weights(x), self.width)
            for at in _anchors(x, p.around):
                length = max(n for n in ladder if n <= len(x) - at)
                if length >= len(x) // 2 or at == 0:
                    self.windows.setdefault(length, []).append((int(sums.simhash(np.array([at]), length)[0]), i, int(at)))
        self.built = None

    def __getstate__(self):
        return self.__dict__ | {"built": None}

    def _prepare(self) -> None:
        if self.built is None:
            self.built = {n: Multi(np.array([f for f, _, _ in w], np.uint64), self.p.radius, self.p.blocks) for n, w in self.windows.items()}
            self.shingles = [self._set(x) for x in self.items]
            self.signatures = self._signatures()

    def _set(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles and their weights."""
        k = min(self.p.shingle, len(h))
        w = np.convolve(self.weights(h).astype(np.int64), np.ones(k, np.int64), "valid") if k else np.empty(0, np.int64)
        s, at = np.unique(_shingled(h, k) if k else np.empty(0, np.uint64), return_index=True)
        return s, w[at]

    def _signatures(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words of a shingle -> (signature shingles, ascending; their items; whether any has these first 22 bits)."""
        every, df = np.unique(np.concatenate([s for s, _ in self.shingles] or [np.empty(0, np.uint64)]), return_counts=True)
        lists: dict[int, list[tuple[np.ndarray, int]]] = {}
        for i, (s, w) in enumerate(self.shingles):
            order = np.lexsort((s, df[np.searchsorted(every, s)]))
            heavy = np.cumsum(w[order]) > (1 - self.p.similarity) * w.sum() + 1e-6
            lists.setdefault(min(self.p.shingle, len(self.items[i])), []).append((s[order[: int(heavy.argmax()) + 1]], i))
        out = {}
        for k, parts in lists.items():
            keys, items = np.concatenate([s for s, _ in parts]), np.repeat([i for _, i in parts], [len(s) for s, _ in parts])
            order, flags = np.argsort(keys, kind="stable"), np.zeros(1 << 22, bool)
            flags[keys >> np.uint64(42)] = True
            out[k] = keys[order], items[order], flags
        return out

    def _best(self, item: int, s: np.ndarray, w: np.ndarray) -> tuple[float, int, int]:
        """(similarity, first word, words) of the best stretch of a run of shingles s with weights w; similarity 0 if none is similar."""
        own, own_w = self.shingles[item]
        size, k, whole = len(self.items[item]), min(self.p.shingle, len(self.items[item])), int(own_w.sum())
        inside = np.isin(s, own)
        shared = np.append(0, np.cumsum(w * inside))
        order = np.argsort(s, kind="stable")
        before = np.full(len(s), -1)  # the place of the same shingle before
        same = s[order[1:]] == s[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        best = (0.0, 0, 0)
        for i in np.flatnonzero(inside):
            to = min(i + 2 * size, len(s))
            if shared[to] - shared[i] < self.p.similarity * whole - 1e-6:
                continue
            new = w[i:to] * (before[i:to] < i)
            both, total = np.cumsum(new * inside[i:to]), np.cumsum(new)
            value = np.where(inside[i:to] & (2 * (np.arange(to - i) + k) >= size), both / (whole + total - both), 0)
            j = int(value.argmax())
            if value[j] >= self.p.similarity - 1e-12 and value[j] > best[0]:
                best = (float(value[j]), int(i), j + k)
                if best[0] == 1:
                    break
        return best

    def search(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(text, item id, similarity, first word, words), the best stretch of each text and item."""
        self._prepare()
        if not len(h) or not self.items:
            return []
        weights = self.weights(h)
        sums, at = Sums(h, weights, self.width), _anchors(h, self.p.around)
        starts = first[:-1][first[:-1] < first[1:]]
        at = np.union1d(at, starts)  # a short text's first word stands in for an anchor
        text = np.searchsorted(first, at, side="right") - 1
        found = []  # (text, item, word)
        for length, multi in self.built.items():
            ok = at + length <= first[text + 1]
            here, of = at[ok], text[ok]
            if not len(here):
                continue
            q, e = multi.search(sums.simhash(here, length))
            found.append(np.stack([of[q], np.array([i for _, i, _ in self.windows[length]])[e], here[q]], axis=1))
        runs = {k: _shingled(h, k) for k in self.signatures}
        for k, (keys, items, flags) in self.signatures.items():
            s = runs[k]
            hit = np.flatnonzero(flags[s >> np.uint64(42)])
            a, b = (np.searchsorted(keys, s[hit], side=side) for side in ("left", "right"))
            n = b - a
            here = np.repeat(hit, n)
            of = np.searchsorted(first, here, side="right") - 1
            item = items[np.repeat(a - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))] if len(here) else here
            ok = here + k <= first[of + 1]
            found.append(np.stack([of[ok], item[ok], here[ok]], axis=1))
        found = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        weighs: dict[int, np.ndarray] = {}
        heads = np.flatnonzero(np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))[: len(found)])
        for part in np.split(found, heads[1:]) if len(found) else []:
            t, item, reach = int(part[0, 0]), int(part[0, 1]), 2 * len(self.items[part[0, 1]])
            k = min(self.p.shingle, len(self.items[item]))
            if k not in weighs:
                weighs[k] = np.convolve(weights.astype(np.int64), np.ones(k, np.int64), "valid") if len(h) >= k else np.empty(0, np.int64)
            for near in np.split(part[:, 2], np.flatnonzero(np.diff(part[:, 2]) > 2 * reach) + 1):
                a, b = max(int(first[t]), int(near[0]) - reach), min(int(first[t + 1]) - k + 1, int(near[-1]) + reach)
                if a < b:
                    s, word, n = self._best(item, runs[k][a:b], weighs[k][a:b])
                    if s > best.get((t, item), (0.0,))[0]:
                        best[t, item] = (s, a + word - int(first[t]), n)
        return [(t, self.ids[i], *v) for (t, i), v in sorted(best.items())]


def _words_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each item."""
    for batch in split_bytes(batches):
        h, first = words(batch.column(0))
        each = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each).astype(np.int64))], ["h"])


def weights(items: DataFrame, n: int) -> Weights:
    """Of all n items. A twentieth of the items holds each common word, so these are at most twenty times the words of a mean item."""
    found = items.filter(F.col("text").rlike(WORD)).select("text").mapInArrow(_words_of_items, "h long").groupBy("h").agg(F.count("*").alias("n"))
    return Weights(np.sort(found.filter(F.col("n") >= Weights.least(n)).select("h").toArrow()["h"].to_numpy().astype(np.uint64)))


def _passes(benchmark: DataFrame, p: Decontaminate) -> Iterator[tuple[Index, bool]]:
    """The index of each pass, and whether it is the only one."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    worded = items.filter(F.col("text").rlike(WORD)).count()
    n = max(1, -(-worded // p.items_a_pass))
    common = weights(items, worded)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for b in range(n):
        rows = (items if n == 1 else items.filter(block == b)).orderBy("item_id", "text").toArrow()
        yield Index(rows["item_id"].to_pylist(), rows["text"].to_pylist(), p, common), n == 1


def matches(docs: DataFrame, benchmark: DataFrame, p: Decontaminate = Decontaminate()) -> DataFrame:  # noqa: B008
    """doc_id, item_id, similarity, first_word (from 0) and n_words of the best stretch, for every document and item that match."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"

    def found(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in split_bytes(batches, limit=1 << 20):
                got = index.search(*words(batch.column(1)))
                if got:
                    t, *cols = zip(*got, strict=True)
                    kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(t)), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        return rows.mapInArrow(run, schema)

    # with several passes each is written before the next, so that one index at a time is held
    return reduce(DataFrame.unionAll, [found(i) if alone else written(found(i), "matches") for i, alone in _passes(benchmark, p)])


def without_matches(docs: DataFrame, benchmark: DataFrame, p: Decontaminate = Decontaminate()) -> DataFrame:  # noqa: B008
    """docs without those that hold an item; columns of any name are kept as they are. A scan a pass, no shuffle."""
    name = free(docs, "text")

    def clean(d: DataFrame, one: tuple[Index, bool]) -> DataFrame:
        index, alone = one

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in split_bytes(batches, name, 1 << 20):
                keep = np.ones(batch.num_rows, bool)
                keep[[t for t, *_ in index.search(*words(batch.column(batch.schema.get_field_index(name))))]] = False
                yield batch.select([n for n in batch.schema.names if n != name]).filter(pa.array(keep))

        out = d.withColumn(name, F.col("text")).mapInArrow(run, docs.schema)
        return out if alone else written(out, "clean")

    return reduce(clean, _passes(benchmark, p), docs)
