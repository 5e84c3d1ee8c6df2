"""Removal of repeated 50-byte strings by multi-document suffix sorting, a column of symbols at a time.

A byte goes if it lies in a 50-byte string that also starts in a document with a smaller doc_id.

1. Copies. Of equal texts only the least doc_id goes on; the others (of 50 bytes or more) are removed whole.
2. Anchors. Each 50-byte window is keyed by the least hash of its 16-byte substrings, so equal windows have equal
   keys. Windows in a row with one key form a segment. Keys are dealt by hash, packed; those that occur in one text
   only go no further: their windows are unique.
3. Segments of the other keys are dealt by key; of equal ones in a batch only the least document's, as the others go in
   any case. In each task the distinct segments are the documents of a collection
   whose Burrows-Wheeler transform is built column-wise (Bauer, Cox and Rosone): each round prepends one symbol to
   every document and places all suffixes by their first symbol, stably; symbol by symbol the transform is read from
   one column (a file, when it is large) and written to the next in order. Segments that cannot share a window, by
   the bytes next to their key, are left out. After the last round the suffixes are sorted and neighbours that share
   50 symbols form the classes of equal windows; the least doc_id of a class keeps them.
4. Marked windows go back to their documents, are merged to spans and cut out.

Segments hold at most 50 + `run` - 1 bytes, so there are as many rounds at most, however long a document is.

Defined cases: null is an empty text; null doc_id counts as larger than any; texts below 50 bytes keep all; rows with
one doc_id are no smaller than each other, so repeated rows keep what they share; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written
from .words import buffers, mix64, split_bytes

_BASE = 0x9E3779B97F4A7C15
_LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Repeats:
    length: int = 50
    inner: int = 16
    run: int = 35
    block: int = 2_000_000  # symbols of a collection
    flush: int = 400_000  # anchors that a task packs at a time


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    size = 1 << max(10, n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[size] = tuple(both)
    return _POWERS[size]


def segments(data: np.ndarray, offsets: np.ndarray, p: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, first byte, windows) of each run of windows with one key; a run of n windows spans length + n - 1 bytes."""
    none = (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    n = len(data)
    if n < p.length:
        return none
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    least = mix64((sums[p.inner :] - sums[: -p.inner]) * inverse[: n - p.inner + 1])
    wide, have = p.length - p.inner + 1, 1
    while 2 * have <= wide:
        least, have = np.minimum(least[:-have], least[have:]), 2 * have
    if have < wide:
        least = np.minimum(least[: len(least) - (wide - have)], least[wide - have :])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    ok = np.arange(len(least)) + p.length <= offsets[1:][text]
    at = np.flatnonzero(ok)
    if not len(at):
        return none
    key, text = least[at], text[at]
    new = np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1]))
    head = np.flatnonzero(new)
    far = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
    head = np.flatnonzero(far % p.run == 0)
    return key[head], text[head], at[head], np.diff(np.append(head, len(at)))


def _anchors(p: Repeats, parts: int):
    """Packed (part; keys; the texts they are in): a text that a task meets again is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, texts, held = [], [], 0

        def packed() -> pa.RecordBatch:
            k, x = np.concatenate(keys), np.concatenate(texts)
            part = (k >> np.uint64(32)).astype(np.int64) % parts
            order = np.argsort(part, kind="stable")
            k, x, part = k[order], x[order], part[order]
            cut = np.searchsorted(part, np.arange(parts + 1))
            have = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays([pa.array(have.astype(np.int32)), *[pa.array([v[cut[i] : cut[i + 1]].tobytes() for i in have], pa.binary()) for v in (k, x)]], ["part", "keys", "texts"])

        for batch in split_bytes(batches, limit=1 << 20):
            x1 = batch.column(0).to_numpy()
            if len(seen) > 500_000:
                seen.clear()
            fresh = []
            for i, x in enumerate(x1.tolist()):
                if x not in seen:
                    seen.add(x)
                    fresh.append(i)
            key, text, _, _ = segments(*buffers(batch.column(1).take(pa.array(fresh, pa.int64()))), p)
            if len(key):
                keys.append(key)
                texts.append(x1[np.array(fresh)][text])
                held += len(key)
            if held >= p.flush:
                yield packed()
                keys, texts, held = [], [], 0
        if held:
            yield packed()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, key) for keys that occur in two texts at least. A task's anchors: two longs each."""
    got = [(np.frombuffer(k, np.uint64), np.frombuffer(x, np.int64)) for b in batches for k, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
    if not got:
        return
    key, text = np.concatenate([k for k, _ in got]), np.concatenate([x for _, x in got])
    del got
    order = np.argsort(key, kind="stable")
    key, text = key[order], text[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    many = np.minimum.reduceat(text, first) != np.maximum.reduceat(text, first)
    keep = np.repeat(many, np.diff(np.append(first, len(key))))
    pairs = np.unique(np.stack([text[keep], key[keep].astype(np.int64)], axis=1), axis=0)
    for a in range(0, len(pairs), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[a : a + (1 << 16), i])) for i in (0, 1)], ["x1", "key"])


def _binary(ends: np.ndarray, body: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])


def _cut(p: Repeats):
    """The segments of documents whose keys are shared, with all their places; and, without bytes and dealt anyhow, the
    places of those that are already known to go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in split_bytes(batches, limit=1 << 20):
            data, offsets = buffers(batch.column(2))
            key, text, at, windows = segments(data, offsets, p)
            lists = batch.column(3)
            wanted = lists.flatten().to_numpy().astype(np.uint64)
            of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            want = np.unique(mix64(wanted) + of.astype(np.uint64))
            hit = np.isin(mix64(key) + text.astype(np.uint64), want)
            key, text, at, windows = key[hit], text[hit], at[hit], windows[hit]
            if not len(key):
                continue
            size = windows + p.length - 1
            cuts = np.append(0, np.cumsum(size))
            pos = np.arange(cuts[-1]) - np.repeat(cuts[:-1], size)
            body = data[np.repeat(at, size) + pos]
            # what a document holds several times travels once, with all its places
            prints = np.add.reduceat((body.astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()) + 1)[0][pos], cuts[:-1])
            prints = mix64(prints ^ key) + size.astype(np.uint64)
            _, first, which = np.unique(prints + mix64(text.astype(np.uint64)), return_index=True, return_inverse=True)
            starts = (at - offsets[text])[np.argsort(which, kind="stable")].astype(np.int32)
            own = np.append(0, np.cumsum(np.bincount(which)))
            # a segment that a smaller document of the batch holds, too, goes as it is: only the least one's bytes travel
            doc = batch.column(0).to_numpy()[text[first]]
            _, same = np.unique(prints[first], return_inverse=True)
            least = np.full(int(same.max()) + 1, _LAST, np.int64)
            np.minimum.at(least, same, doc)
            gone = doc > least[same]
            for rows in (np.flatnonzero(~gone), np.flatnonzero(gone)):
                if not len(rows):
                    continue
                held = own[rows + 1] - own[rows]
                at_ = np.append(0, np.cumsum(held))
                mine = starts[np.repeat(own[rows] - at_[:-1], held) + np.arange(at_[-1])]
                seg = first[rows]
                n = size[seg]
                if gone[rows[0]]:
                    deal, column = mix64(np.arange(len(rows)).astype(np.uint64) + key[seg]), pa.nulls(len(rows), pa.binary())
                else:
                    deal, ends = key[seg], np.append(0, np.cumsum(n))
                    column = _binary(ends, body[np.repeat(cuts[seg] - ends[:-1], n) + np.arange(ends[-1])])
                of = pa.array(text[seg])
                yield pa.RecordBatch.from_arrays([pa.array(deal.astype(np.int64)), batch.column(0).take(of), batch.column(1).take(of), _binary(4 * at_, mine), column, pa.array(n.astype(np.int32))], ["key", "doc_id", "x1", "starts", "segment", "n"])

    return run


class Column:
    """Suffix starts in order, doubled, odd for an end: a file, or an array while it is small."""

    def __init__(self, in_memory: bool):
        self.file = None if in_memory else tempfile.NamedTemporaryFile(prefix="columns-")
        self.array = np.empty(0, np.int32)

    def write(self, n: int) -> np.ndarray:
        if self.file is not None:
            return np.memmap(self.file.name, np.int32, "w+", shape=(n,))
        if len(self.array) < n:
            self.array = np.empty(2 * n, np.int32)
        return self.array[:n]

    def read(self, a: int, n: int) -> np.ndarray:
        return self.array[a : a + n] if self.file is None else np.fromfile(self.file.name, np.int32, n, offset=4 * a)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def sorted_suffixes(body: np.ndarray, cuts: np.ndarray, block: int = 1 << 16, in_memory: int = 1 << 25) -> np.ndarray:
    """Starts of all suffixes of the documents body[cuts[i]:cuts[i + 1]], sorted; symbols must be above 0.

    Round j holds the transform of all suffixes of at most j symbols as a column of suffix starts, in order (a file, if
    there are more than in_memory symbols). A suffix's symbol is the one before its start; prepending it to all at
    once, stably by symbol, is the order of round j + 1 (with the empty suffixes first). The old column is read and
    the new one written in blocks, each symbol's part in order."""
    before = np.zeros(len(body) + 1, np.uint8)  # symbol before a start; 0 at a document's first
    before[1:] = body
    before[cuts[:-1]] = 0
    last = body[cuts[1:] - 1]  # before an end stands its own document's last symbol
    ends = (2 * cuts[1:] + 1).astype(np.int32)
    rounds, n = int(np.diff(cuts).max()), len(ends)
    here, there = (Column(len(body) + n <= in_memory) for _ in range(2))
    try:
        here.write(n)[:] = ends
        for j in range(rounds):
            blocks, counts = range(0, n, block), np.zeros(256, np.int64)
            symbols = []
            for a in blocks:
                starts = here.read(a, min(block, n - a))
                symbol = before[starts >> 1]
                if a < len(ends):  # the empty suffixes come first
                    symbol[: len(ends) - a] = last[a : a + len(starts)]
                counts += np.bincount(symbol, minlength=256)
                symbols.append(symbol)
            place = len(ends) + np.append(0, np.cumsum(counts[1:]))
            out = there.write(int(place[-1]))
            out[: len(ends)] = ends
            for a, symbol in zip(blocks, symbols, strict=True):
                starts = here.read(a, len(symbol))
                order = np.argsort(symbol, kind="stable")
                got = np.bincount(symbol, minlength=256)
                moved = ((starts >> 1)[order] - 1) << 1
                at = int(got[0])
                for c in np.flatnonzero(got[1:]):
                    k = int(got[c + 1])
                    out[place[c] : place[c] + k] = moved[at : at + k]
                    place[c] += k
                    at += k
            n = len(out)
            del out
            here, there = there, here
        final = here.read(0, n)
        return final[final & 1 == 0] >> 1
    finally:
        here.close()
        there.close()


def _chunks(cuts: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `limit` symbols."""
    i, n = 0, len(cuts) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = j


def _candidates(key: np.ndarray, body: np.ndarray, cuts: np.ndarray, p: Repeats) -> np.ndarray:
    """Which segments (distinct, sorted by key) can share a window with another of their key.

    A shared window holds the key's substring and, on its left or on its right, at least half of the other bytes. So
    one of two longer substrings around it must be equal, too. Segments that hold the key more than once all stay."""
    times, sides, more = np.zeros(len(key), np.int64), ([], []), (p.length - p.inner + 1) // 2
    for i, j in _chunks(cuts):
        text, own, mine = body[cuts[i] : cuts[j]], cuts[i : j + 1] - cuts[i], key[i:j]
        power, inverse = _powers(len(text) + 1)
        sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[: len(text)], out=sums[1:])
        part = lambda a, b: mix64((sums[b] - sums[a]) * inverse[a])  # noqa: B023, E731
        seg = np.repeat(np.arange(j - i), np.diff(own))
        at = np.flatnonzero(part(np.arange(len(text) - p.inner + 1), np.arange(p.inner, len(text) + 1)) == mine[seg[: len(text) - p.inner + 1]])
        at = at[at + p.inner <= own[seg[at] + 1]]
        times[i:j] = np.bincount(seg[at], minlength=j - i)
        at = at[times[i:j][seg[at]] == 1]
        of = seg[at]
        for side, (a, b) in zip(sides, ((at - more, at + p.inner), (at, at + p.inner + more)), strict=True):
            ok = (a >= own[of]) & (b <= own[of + 1])
            side.append((of[ok] + i, part(a[ok], b[ok]) + mix64(mine[of[ok]])))
    keep = times != 1
    for side in sides:
        of, h = (np.concatenate([x[i] for x in side]) for i in (0, 1))
        _, which, count = np.unique(h, return_inverse=True, return_counts=True)
        keep[of] |= count[which] > 1
    # one that holds the key more often can match any other of the key
    odd = np.unique(key[times != 1])
    return keep | np.isin(key, odd)


def _classes(starts: np.ndarray, body: np.ndarray, length: int) -> np.ndarray:
    """Numbers the runs of neighbours in sorted order that share their first `length` symbols."""
    padded = np.append(body, np.zeros(8, np.uint8))
    eight = np.lib.stride_tricks.as_strided(padded, (len(body) + 1, 8), (1, 1))
    same = np.ones(max(0, len(starts) - 1), bool)
    for o in [*range(0, length - 7, 8), length - 8]:
        words = np.ascontiguousarray(eight[starts + o]).view(np.uint64).ravel()
        same &= words[1:] == words[:-1]
    return np.append(0, np.cumsum(~same)) if len(starts) else np.empty(0, np.int64)


def marks(key: np.ndarray, doc: np.ndarray, body: np.ndarray, cuts: np.ndarray, p: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first byte in it, bytes): the spans that smaller documents hold too. Segments come sorted by key."""
    size, prints = np.diff(cuts), []
    for i, j in _chunks(cuts):
        pos = np.arange(cuts[j] - cuts[i]) - np.repeat(cuts[i:j] - cuts[i], size[i:j])
        value = (body[cuts[i] : cuts[j]].astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()) + 1)[0][pos]
        prints.append(np.add.reduceat(value, cuts[i:j] - cuts[i]))
    print_ = np.concatenate(prints or [np.empty(0, np.uint64)])
    _, first, which = np.unique(print_, return_index=True, return_inverse=True)  # equal segments are one document of the collection
    least = np.full(len(first), _LAST, np.int64)
    np.minimum.at(least, which, doc)
    whole = doc > least[which]
    spans = [(np.flatnonzero(whole), np.zeros(int(whole.sum()), np.int64), size[whole])]
    # keys with one distinct segment hold no other equal windows
    _, inverse, count = np.unique(key[first], return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[inverse] > 1)
    some = some[np.argsort(key[first[some]], kind="stable")]
    if len(some):
        length = size[first[some]]
        own = np.append(0, np.cumsum(length))
        some = some[_candidates(key[first[some]], body[np.repeat(cuts[first[some]] - own[:-1], length) + np.arange(own[-1])], own, p)]
    weight = np.cumsum(size[first[some]])
    edge = np.append(True, key[first[some]][1:] != key[first[some]][:-1])
    block = np.zeros(len(some), np.int64)
    if len(some):
        # blocks end between keys
        block = (weight // p.block)[np.flatnonzero(edge)][np.cumsum(edge) - 1]
    for b in np.unique(block):
        part = some[block == b]
        seg = first[part]
        length = size[seg]
        own = np.append(0, np.cumsum(length))
        text = body[np.repeat(cuts[seg] - own[:-1], length) + np.arange(own[-1])]
        text = np.where(text == 0, 255, text)  # 0 and 255 are no bytes of well-formed text but 0 itself
        starts = sorted_suffixes(text, own)
        of = np.searchsorted(own, starts, side="right") - 1
        long = own[of + 1] - starts >= p.length
        starts, of = starts[long].astype(np.int64), of[long]
        cls = _classes(starts, text, p.length)
        low = np.full(int(cls[-1]) + 1, _LAST, np.int64)
        np.minimum.at(low, cls, least[part][of])
        hit = low[cls] < least[part][of]
        at = np.sort(starts[hit])
        of = np.searchsorted(own, at, side="right") - 1
        new = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1]))) if len(at) else np.empty(0, np.int64)
        n = np.diff(np.append(new, len(at))) + p.length - 1 if len(at) else np.empty(0, np.int64)
        # the span holds for every occurrence of the segment in its least document
        owner, offset = part[of[new]], at[new] - own[of[new]]
        by = np.argsort(which, kind="stable")
        lo, hi = np.searchsorted(which[by], owner, side="left"), np.searchsorted(which[by], owner, side="right")
        k = hi - lo
        occurrence = by[np.repeat(lo - np.append(0, np.cumsum(k)[:-1]), k) + np.arange(int(k.sum()))]
        keep = ~whole[occurrence]
        spans.append((occurrence[keep], np.repeat(offset, k)[keep], np.repeat(n, k)[keep]))
    return tuple(np.concatenate([s[i] for s in spans]) for i in range(3))


def _marked(p: Repeats):
    """Spans (doc_id, x1, start, n) of a task's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        key, doc, x1, size = (np.concatenate([b.column(i).to_numpy() for b in batches]) for i in (0, 1, 2, 5))
        places, column = (pa.concat_arrays([b.column(i).cast(pa.large_binary()) for b in batches]) for i in (3, 4))
        del batches
        known = column.is_null().to_numpy(zero_copy_only=False)
        here = np.flatnonzero(~known)
        body, cuts = buffers(column.take(pa.array(here)))
        starts, own = buffers(places)
        starts, own = np.frombuffer(starts.tobytes(), np.int32), own // 4
        seg, offset, n = marks(key[here].astype(np.uint64), doc[here], body, cuts, p)
        gone = np.flatnonzero(known)
        seg, offset, n = np.concatenate([here[seg], gone]), np.append(offset, np.zeros(len(gone), np.int64)), np.append(n, size[gone])
        if len(seg):
            k = own[seg + 1] - own[seg]
            start = starts[np.repeat(own[seg] - np.append(0, np.cumsum(k)[:-1]), k) + np.arange(int(k.sum()))] + np.repeat(offset, k)
            seg, n = np.repeat(seg, k), np.repeat(n, k)
            yield pa.RecordBatch.from_arrays([pa.array(doc[seg]), pa.array(x1[seg]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["doc_id", "x1", "start", "n"])

    return run


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in split_bytes(batches, limit=2 << 20):
        out = []
        for doc, body, whole, spans in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            body = body or b""
            merged: list[list[int]] = []
            if whole:
                merged = [[0, len(body)]]
            else:
                for a, n in sorted((s["start"], s["n"]) for s in spans or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], a + n)
                    else:
                        merged.append([a, a + n])
            kept, last = [], 0
            for a, b in merged:
                kept.append(body[last:a])
                last = b
            kept.append(body[last:])
            gone = sum(b - a for a, b in merged)
            out.append((None if doc == _LAST else doc, len(body), gone, len(merged), hashlib.sha256(b"".join(kept)).hexdigest(), [{"start": a, "end": b} for a, b in merged]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:  # noqa: B008
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (first and past-the-end byte of each removed run)."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    body = F.coalesce("text", F.lit(""))
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64(F.lit(1), body).alias("x1"), body.cast("binary").alias("text"))
    names = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64(F.lit(1), body).alias("x1"), F.xxhash64(F.lit(2), body).alias("x2"), F.octet_length(body).alias("size"))
    long = names.filter(F.col("size") >= p.length)
    classes = written(long.groupBy("x1", "x2").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")), "repeat-classes")
    # a deal of the packed anchors by part, then (text, key) of shared keys, and with the class's least document (doc_id, x1, keys)
    packed = d.filter(F.octet_length("text") >= p.length).select("x1", "text").mapInArrow(_anchors(p, 4 * parts), "part int, keys binary, texts binary")
    shared = packed.repartition(parts, "part").mapInArrow(_shared, "x1 long, key long")
    lists = shared.join(classes.select("x1", F.col("low").alias("doc_id")), "x1").groupBy("doc_id", "x1").agg(F.collect_list("key").alias("keys"))
    lists = written(lists, "repeat-keys")
    found = d.join(lists, ["doc_id", "x1"]).select("doc_id", "x1", "text", "keys")
    cut = found.mapInArrow(_cut(p), "key long, doc_id long, x1 long, starts binary, segment binary, n int")
    spans = written(cut.repartition(parts, "key").mapInArrow(_marked(p), "doc_id long, x1 long, start int, n int"), "repeat-spans")
    drop_written(lists)
    twice = classes.filter("copies > 1").select(F.col("x1").alias("c1"), F.col("x2").alias("c2"), "low")
    copies = long.join(twice, (F.col("x1") == F.col("c1")) & (F.col("x2") == F.col("c2"))).filter("doc_id > low").select("doc_id", "x1").distinct()
    by = spans.groupBy("doc_id", "x1").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    gone = by.withColumn("whole", F.lit(False)).unionByName(copies.withColumns({"whole": F.lit(True), "spans": F.lit(None).cast(by.schema["spans"].dataType)}))
    gone = gone.groupBy("doc_id", "x1").agg(F.max("whole").alias("whole"), F.first("spans", ignorenulls=True).alias("spans"))
    out = d.join(gone, ["doc_id", "x1"], "left").select("doc_id", "text", "whole", "spans")
    return out.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>")
