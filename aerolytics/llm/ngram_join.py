"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their sets of k-word shingles is at least num / den. The result is
exact (up to 64-bit hashes of shingles) and names connected components, so copies are never expanded into pairs.

1. Equal sets are one class; its least doc_id stands for it. Copies go no further.
2. Distribution. Two sets that link differ in at most D elements, D following from their sizes. A set's elements are
   dealt by hash into more than D groups, so one group at least is equal in both: it is the signature under which
   they meet. How many elements a shared group must have at least is set for each document, as high as its own sizes
   of groups allow. Shingles that are very frequent, by counts over all documents, take no part where the others
   fill more than D groups. Sizes within the threshold fall into the same or the next size class; a set signs for
   its own class and the one below. Sets that meet under a signature are compared by sketches (64 bytes: of each of
   64 groups of a set's shingles the least hash), and a pair goes where more bytes differ than do in sets that link. Few
   that meet are compared pair by pair; many are searched for the sets similar to one, then to these, and so on, and what
   a bound on that search leaves is linked unseen. The components of these edges are the candidate clusters. A signature
   holds several tokens, so passages and words that many documents share join little; without the sketches, pairs that
   share no more than a passage, whose number grows with the square of the documents, would chain most of a large corpus
   into one cluster.
3. Verification, inside a cluster. Tokens are ordered by their frequency there. A document's prefix at level l holds
   n - ceil(t n) + l of its rarest tokens; two that link share at least min(l, l') tokens of their prefixes. Each
   document's level is the one of least estimated cost: tokens scanned plus verifications, estimated from the
   frequencies in the prefix, which fall with l as more shared tokens are asked for. Pairs that share enough and are
   not yet connected are verified by the exact similarity; what is similar to one of a few pivots is connected
   beforehand, so that near-copies are not compared with each other. A cluster above `budget` tokens is split into blocks and
   every pair of blocks is a group of its own, so that no task holds more than two blocks and no pair is lost.
4. Components of the links, by minimum doc_id, are joined back to all documents by class.

The chance that a document's groups are so uneven that step 2 misses a pair is below 1e-9 for each document; that
the sketches of two sets that link differ so much is below 1e-12 for each pair, and 0 for sets that may differ in few shingles.

Defined cases: words are runs of bytes other than ASCII white space, A-Z lower-cased; fewer than k words make one
shingle of all; null or empty texts have an empty set and link with nothing; a very long text is a set like any other, and the longest
word is one word; repeated rows are equal documents; equal
doc_ids with different texts are separate nodes that answer to the same id; a null doc_id counts as larger than any
and comes back null; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, written
from .components import components
from .words import mix64, shingle_sets, split_bytes

#: Ids above this many are joined by a shuffle and not broadcast.
BROADCAST_IDS = 1_000_000
#: At most so many shingles, the most frequent by batch counts, are kept out of signatures. Which ones changes no result.
HEAVY = 100_000
#: Up to so many sets that meet under a signature are compared pair by pair; of more, that many comparisons are made.
PAIRED, SEARCHED = 16, 1 << 24
#: Longs of a sketch, of eight groups each.
SKETCH = 8


@dataclass(frozen=True)
class Join:
    k: int = 3
    num: int = 90
    den: int = 100
    budget: int = 4_000_000  # shingles of a block

    @property
    def t(self) -> float:
        return self.num / self.den

    def linked(self, a: int, b: int, both: int) -> bool:
        return self.den * both >= self.num * (a + b - both)

    def most_apart(self, groups: int = 8 * SKETCH, chance: float = 1e-12) -> int:
        """Groups of a sketch in which two sets that link differ at most, but for that chance: each is alike with probability t at least."""
        q, tail = 1 - self.t, 0.0
        for k in range(groups, 0, -1):
            tail += math.comb(groups, k) * q**k * self.t ** (groups - k)
            if tail > chance:
                return k
        return 0


_LAST = (1 << 63) - 1


_SKETCHED = [f"s{i}" for i in range(SKETCH)]
CLASSES = "kind byte, doc_id long, x long, n long, f1 long, f2 long, " + ", ".join(f"{c} long" for c in _SKETCHED)


def _id():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))


def _prints(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    a = np.add.reduce(mix64(s)) + np.uint64(len(s))
    b = np.bitwise_xor.reduce(mix64(s * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))) if len(s) else np.uint64(0)
    return int(np.int64(a.astype(np.int64))), int(np.int64(b.astype(np.int64)))


def sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH signed longs: for each of eight groups a byte of the least hash of the set's elements there, 0 where it has none."""
    h = np.sort(mix64(s ^ np.uint64(0x3C6EF372FE94F82B)))  # the group is in the leading bits
    group = (h >> np.uint64(58)).astype(np.int64)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(h)])
    out = np.zeros(8 * SKETCH, np.uint8)
    out[group[first]] = mix64(h[first]) & np.uint64(255)
    return out.view(np.int64)


def _apart(a: list[str], b: list[str]) -> Column:
    """In how many groups two sketches (columns of longs) differ."""

    def differing(x: Column) -> Column:
        for n in (4, 2, 1):  # the last bit of each byte becomes whether any bit of it is set
            x = x.bitwiseOR(F.shiftrightunsigned(x, n))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    return reduce(lambda x, y: x + y, [differing(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b, strict=True)])


def _groups(s: np.ndarray, groups: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Deals a set to groups by hash: (signature of each group that has elements, how many it has)."""
    group = (mix64(s ^ np.uint64(0x5BD1E995 + salt)) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)
    order = np.argsort(group, kind="stable")
    g = group[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    sums = np.add.reduceat(mix64(s[order]), first)
    return mix64(sums ^ mix64(g[first] + np.uint64(salt << 40))), np.diff(np.append(first, len(s)))


def signatures(s: np.ndarray, join: Join, heavy: np.ndarray | None = None) -> np.ndarray:
    """The signatures of a set (uint64), as the smaller of a pair under its own size class and as the larger under the class
    below: the last bit says which, the others must agree.

    Of two that link, at most D elements differ, so at most D groups do. A set whose light elements (those that are not
    `heavy`) fill more than D groups signs with these alone; one that has fewer signs with all its elements, too. It
    signs with its largest groups, the least size being the one that more than D groups reach: whichever of a pair
    asks for more has a group that is equal in the other, and the other signs with it as well."""
    n, out = len(s), []
    width = math.log(1 / join.t) * 1.001
    own = int(math.log(n) / width)
    light = s if heavy is None or not len(heavy) else s[heavy[np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)] != s]
    for role, c in enumerate((own, own - 1)):
        if c < 0:
            continue
        differ = int(math.exp((c + 1) * width) * (1 / join.t - 1) + 1e-9)
        groups = differ + 7 + differ // 4
        for salt in range(2 if n <= 64 else 1):
            for kind, part in enumerate((light, s)):
                if not len(part):
                    continue
                sigs, sizes = _groups(part, groups, (c + 1) * 4 + 2 * salt + kind)
                enough = len(sizes) > differ
                chosen = sigs[sizes >= np.sort(sizes)[-differ - 1]] if enough else sigs
                out.append(chosen & ~np.uint64(1) | np.uint64(role))
                if enough or part is s:
                    break
    return np.concatenate(out)


def _classes(join: Join, often: int = 4):
    """(kind 0) doc_id, x, n, f1, f2 and the sketch of each text; (kind 1) hash and count of shingles that `often` texts of a batch hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "x", "n", "f1", "f2", *_SKETCHED]
        for batch in split_bytes(batches):
            sets = shingle_sets(batch.column(1), join.k)
            f = [_prints(s) for s in sets]
            columns = [[len(s) for s in sets], [x for x, _ in f], [x for _, x in f], *np.array([sketch(s) for s in sets], np.int64).reshape(-1, SKETCH).T]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int8)), batch.column(0), batch.column(2), *[pa.array(c, pa.int64()) for c in columns]], names)
            distinct = dict(zip(f, sets, strict=True))  # copies count once
            token, count = np.unique(np.concatenate(list(distinct.values()) or [np.empty(0, np.uint64)]), return_counts=True)
            token, count = token[count >= often].astype(np.int64), count[count >= often]
            none = pa.nulls(len(token), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(token), np.int8)), none, none, pa.array(count), pa.array(token), *[none] * (1 + SKETCH)], names)

    return run


def _signed(join: Join, parts: int, heavy: np.ndarray, flush: int = 1_000_000):
    """Signatures dealt by part and packed: (part; signatures; the classes that signed). A class is named by f1; should
    two share it, they meet as well and are told apart when the names are joined back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # copies within a task sign once
        sigs, names, held = [], [], 0

        def packed() -> pa.RecordBatch:
            s, f = np.concatenate(sigs), np.concatenate(names)
            part = (s >> np.uint64(32)).astype(np.int64) % parts  # without the last bit
            order = np.argsort(part, kind="stable")
            s, f = s[order], f[order]
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            have = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays([pa.array(have.astype(np.int32)), *[pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in have], pa.binary()) for x in (s, f)]], ["part", "sigs", "names"])

        for batch in split_bytes(batches):
            for s in shingle_sets(batch.column(1), join.k):
                f = _prints(s)
                if not len(s) or f in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(f)
                sigs.append(signatures(s, join, heavy))
                names.append(np.full(len(sigs[-1]), f[0], np.int64))
                held += len(sigs[-1])
                if held >= flush:
                    yield packed()
                    sigs, names, held = [], [], 0
        if held:
            yield packed()

    return run


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes that share a signature, unless all sign as the larger, who meet under their own size: up to PAIRED of them
    as pairs (null, fa, fb), more as members (signature, null, fb). One partition of two longs a signature."""
    got = [(np.frombuffer(s, np.uint64), np.frombuffer(f, np.int64)) for b in batches for s, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
    if not got:
        return
    sig, name = np.concatenate([s for s, _ in got]), np.concatenate([f for _, f in got])
    del got
    order = np.argsort(sig, kind="stable")
    sig, name = sig[order], name[order]
    own = sig >> np.uint64(1)
    same = np.append(own[1:] == own[:-1], False)
    keep = same | np.append(False, same[:-1])  # signatures that occur twice at least
    sig, name = sig[keep], name[keep]
    order = np.lexsort((name, sig >> np.uint64(1)))
    sig, name = sig[order], name[order]
    new = np.append(True, (sig[1:] != sig[:-1]) | (name[1:] != name[:-1]))[: len(sig)]  # copies that signed in other tasks
    larger, sig, name = (sig[new] & np.uint64(1)).astype(bool), sig[new] >> np.uint64(1), name[new]
    first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])[: len(sig)])
    count = np.diff(np.append(first, len(sig)))
    edges = [np.empty((0, 2), np.int64)]
    for k in range(2, PAIRED + 1):
        at = first[count == k]
        for i in range(k if len(at) else 0):
            for j in range(i + 1, k):
                pair = at[~(larger[at + i] & larger[at + j])]
                edges.append(np.stack([name[pair + i], name[pair + j]], axis=1))
        if sum(map(len, edges)) > 1 << 22:
            edges = [np.unique(np.concatenate(edges), axis=0)]
    pairs = np.unique(np.concatenate(edges), axis=0)
    alone = np.repeat(np.logical_and.reduceat(larger, first), count) if len(first) else larger
    many = np.repeat(count > PAIRED, count) & ~alone
    if len(pairs):
        yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), *[pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)]], ["sig", "fa", "fb"])
    if many.any():
        yield pa.RecordBatch.from_arrays([pa.array(sig[many].astype(np.int64)), pa.nulls(int(many.sum()), pa.int64()), pa.array(name[many])], ["sig", "fa", "fb"])


def search(ids: np.ndarray, size: np.ndarray, sketches: np.ndarray, join: Join, most: int = SEARCHED) -> list[np.ndarray]:
    """Pairs [a, b] of ids that connect all whose sketches allow a link; after `most` comparisons what is left is linked unseen."""
    out, left, near, done = [], np.arange(len(ids)), [], 0
    link = lambda i, js: out.append(np.stack([np.full(len(js), ids[i]), ids[js]], axis=1))
    while len(left):
        if not near:
            near, left = [int(left[0])], left[1:]
        i = near.pop()
        done += len(left)
        if done > most:
            link(i, left)
            break
        alike = (sketches[left] != sketches[i]).sum(axis=1) <= np.minimum((join.den - join.num) * (size[left] + size[i]) // (join.den + join.num), join.most_apart())
        if alike.any():
            link(i, left[alike])
            near += left[alike].tolist()
            left = left[~alike]
    return out


def _searched(join: Join):
    """Edges (a, b) among the members of each signature; rows come sorted by it: signature, id, size, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        found: list[np.ndarray] = [np.empty((0, 2), np.int64)]

        def ended(rows: np.ndarray) -> None:
            first = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
            for a, b in zip(first, np.append(first[1:], len(rows)), strict=True):
                found.extend(search(rows[a:b, 1], rows[a:b, 2], np.ascontiguousarray(rows[a:b, 3:]).view(np.uint8), join))
            if len(found) > 100_000:
                found[:] = [np.unique(np.concatenate(found), axis=0)]

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            if not len(rows):
                continue
            if held and held[-1][-1, 0] != rows[0, 0]:
                ended(np.concatenate(held))
                held = []
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # the last signature may go on in the next batch
            if last:
                ended(np.concatenate([*held, rows[:last]]))
                held = []
            held.append(rows[last:])
        if held:
            ended(np.concatenate(held))
        edges = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(edges[:, i])) for i in (0, 1)], ["a", "b"])

    return run


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all the ranges starts[i] : starts[i] + counts[i], one after the other."""
    return np.repeat(starts - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(int(counts.sum()))


def _levels(size: np.ndarray, need: np.ndarray, freq: np.ndarray, token: np.ndarray, at: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """The level of each document's prefix, by least estimated cost, and whether enough of its tokens are shared at all."""
    m = len(size)
    cost = np.append(0, np.cumsum(freq[token] - 1))
    lone = np.add.reduceat(freq[token] < 2, at[:-1])
    keep = size - lone >= need
    steps = np.arange(1, levels + 1)
    ends = at[:-1, None] + np.minimum((size - need)[:, None] + steps, size[:, None])
    scan = cost[ends] - cost[at[:-1], None]
    total = np.where(steps <= np.minimum(levels, need)[:, None], scan + scan / steps * (size[:, None] / 8), np.inf)
    return np.where(keep, 1 + np.argmin(total, axis=1), np.ones(m, np.int64)), keep


def _digests(sets: list[np.ndarray], size: np.ndarray, differ: int) -> np.ndarray:
    """[group, set]: a byte for each group of a set's elements, dealt by hash. Sets that differ in n elements differ in n
    groups at most; the number of groups follows from how many a typical pair may differ in."""
    groups = int(np.clip(1 << (4 * differ).bit_length(), 32, 512))
    hashes = mix64(np.concatenate(sets) ^ np.uint64(0x2545F4914F6CDD1D))
    at = (hashes >> np.uint64(32)).astype(np.int64) % groups + groups * np.repeat(np.arange(len(sets)), size)
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1]))
    out = np.zeros(groups * len(sets), np.uint8)
    out[at[order][first]] = np.add.reduceat(hashes[order], first) & np.uint64(255)
    return np.ascontiguousarray(out.reshape(len(sets), groups).T)


def adapt_join(sets: list[np.ndarray], join: Join, levels: int = 12, pivots: int = 64, misses: int = 8) -> list[tuple[int, int]]:
    """Links (i, j) that connect what is connected among the (non-empty) sets; see step 3 above.

    First some pivots, of the densest neighbourhoods that have none, are compared with all sets at once: what is similar to a
    pivot is one component from then on. The largest component's sets are not compared with each other; every other set
    looks for partners among all: by the prefix lists or, where these hold most sets anyhow, by digests of groups of
    elements, which leave out no partner either. What is left is verified exactly."""
    m, size = len(sets), np.array([len(s) for s in sets])
    if m < 2:
        return []
    doc = np.repeat(np.arange(m), size)
    _, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    freq = np.sort(df)  # by rank
    token = rank[inverse]
    token = token[np.lexsort((token, doc))]  # each document's tokens, the rarest first
    at = np.append(0, np.cumsum(size))
    need = -(-join.num * size // join.den)  # of a document's tokens that a partner must hold
    level, keep = _levels(size, need, freq, token, at, levels)
    may_differ = lambda i: (join.den - join.num) * (size + size[i]) // (join.den + join.num)
    digests = _digests(sets, size, int(np.median((join.den - join.num) * 2 * size // (join.den + join.num))))
    holds = np.zeros(len(df), bool)

    def partners(i: int, js: np.ndarray) -> np.ndarray:
        """Those of js that are similar to i, exactly."""
        if not len(js):
            return js
        mine = token[at[i] : at[i + 1]]
        holds[mine] = True
        both = np.add.reduceat(holds[token[_ranges(at[js], size[js])]].astype(np.int64), np.append(0, np.cumsum(size[js])[:-1]))
        holds[mine] = False
        return js[join.den * both >= join.num * (size[js] + size[i] - both)]

    def scan(i: int) -> np.ndarray:
        """The sets that the digests allow."""
        most, apart = may_differ(i), np.zeros(m, np.uint16)
        for row in digests:
            apart += row != row[i]
        return np.flatnonzero(keep & (apart <= most))

    links: list[tuple[int, int]] = []
    comp, linked, missed = np.arange(m), np.zeros(m, bool), 0
    shared = keep[doc] & (freq[token] > 1)
    dense = np.add.reduceat(np.where(shared, freq[token], 0), at[:-1])
    for i in np.argsort(-dense, kind="stable")[: int(keep.sum())]:
        if pivots == 0 or missed == misses:
            break
        if linked[i] or not keep[i]:
            continue
        js = partners(i, scan(i))
        js = js[js != i]
        _, one = np.unique(comp[js], return_index=True)  # a link for each component that it meets
        links += [(int(i), int(j)) for j in js[one]]
        comp[np.isin(comp, comp[js])] = comp[i]
        linked[i] = linked[js] = True
        pivots, missed = pivots - 1, 0 if len(js) else missed + 1
    # links name single members of a component, so all that a pivot joined are linked to it by name as well
    links = [(int(c), int(j)) for c, j in zip(comp, range(m), strict=True) if c != j] if links else []

    root = comp.copy()

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    largest = np.bincount(comp, minlength=m).argmax()
    prefix = size - need + level
    inside = shared & (np.arange(len(token)) - at[doc] < prefix[doc])
    by = np.flatnonzero(inside)[np.argsort(token[inside], kind="stable")]
    starts, lists = np.searchsorted(token[by], np.arange(len(df) + 1)), doc[by]
    for i in np.lexsort((np.arange(m), size)):
        if not keep[i] or comp[i] == largest:
            continue
        head = token[at[i] : at[i + 1]][: prefix[i]]
        n = starts[head + 1] - starts[head]
        if 2 * int(n.sum()) > m:
            js = scan(i)
        else:
            js, met = np.unique(lists[_ranges(starts[head], n)], return_counts=True)
            js = js[met >= np.minimum(level[js], level[i])]
        # pairs outside of the largest component are met from the side of the larger one
        js = js[(comp[js] == largest) | (size[js] < size[i]) | ((size[js] == size[i]) & (js < i))]
        js = js[(join.den * np.minimum(size[js], size[i]) >= join.num * np.maximum(size[js], size[i])) & (comp[js] != comp[i])]
        for j in partners(i, js):
            if (theirs := find(comp[j])) != (own := find(comp[i])):
                links.append((int(i), int(j)))
                root[theirs] = own
    return links


def _sets(join: Join):
    """Sets of the documents that stand for their class in a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in split_bytes(batches):
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            sets = shingle_sets(c["text"], join.k)
            same = [f == (a, b) for f, a, b in zip(map(_prints, sets), c["f1"].to_pylist(), c["f2"].to_pylist(), strict=True)]
            take = pa.array(np.flatnonzero(same))
            if len(take):
                yield pa.RecordBatch.from_arrays([*[c[n].take(take) for n in ("cluster", "blocks", "doc_id")], pa.array([s.tobytes() for s, y in zip(sets, same, strict=True) if y], pa.binary())], ["cluster", "blocks", "doc_id", "shingles"])

    return run


def _verified(join: Join):
    """Rows come sorted by (cluster, i, j); each such group is joined by itself."""

    def links(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch | None:
        got = adapt_join(sets, join)
        if got:
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in got], pa.int64()), pa.array([ids[j] for _, j in got], pa.int64())], ["a", "b"])
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for c, i, j, doc_id, raw in zip(*cols, strict=True):
                if (c, i, j) != key:
                    if len(ids) > 1 and (out := links(ids, sets)):
                        yield out
                    key, ids, sets = (c, i, j), [], []
                ids.append(doc_id)
                sets.append(np.frombuffer(raw, np.uint64))
        if len(ids) > 1 and (out := links(ids, sets)):
            yield out

    return run


def candidates(signed: DataFrame, classes: DataFrame, join: Join, parts: int) -> DataFrame:
    """a, b: edges whose components hold all sets that link."""
    met = written(signed.mapInArrow(_meeting, "sig long, fa long, fb long"), "join-met")
    known = classes.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id"), *[F.min(c).alias(c) for c in _SKETCHED])  # of equal sets the sketches are equal
    side = lambda x: known.select(F.col("f1").alias(f"f{x}"), F.col("id").alias(x), F.col("n").alias(f"n{x}"), *[F.col(c).alias(f"{x}{c}") for c in _SKETCHED])
    pairs = met.filter("sig is null").select("fa", "fb").distinct().join(side("a"), "fa").join(side("b"), "fb")
    may = F.least(F.floor((join.den - join.num) * (F.col("na") + F.col("nb")) / (join.den + join.num) + 1e-6), F.lit(join.most_apart()))
    pairs = pairs.filter(_apart([f"a{c}" for c in _SKETCHED], [f"b{c}" for c in _SKETCHED]) <= may).select("a", "b")
    many = met.filter("sig is not null").select("sig", "fb").join(side("b"), "fb").select("sig", "b", "nb", *[f"b{c}" for c in _SKETCHED])
    return pairs.unionAll(many.repartition(parts, "sig").sortWithinPartitions("sig").mapInArrow(_searched(join), "a long, b long"))


def linked(docs: DataFrame, join: Join = Join()) -> DataFrame:  # noqa: B008
    """doc_id (null: _LAST), x (a hash of the text), n_shingles, component_id (the least doc_id reachable by links, itself included)."""
    spark = docs.sparkSession
    d = docs.select(_id().alias("doc_id"), "text", F.xxhash64("text").alias("x"))
    read = written(d.mapInArrow(_classes(join), CLASSES), "join-classes")
    rows = read.filter("kind = 0").drop("kind", *_SKETCHED)
    often = read.filter("kind = 1").groupBy("f1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "f1").limit(HEAVY).select("f1").toArrow()["f1"]
    heavy = np.sort(often.to_numpy().astype(np.uint64))
    reps = rows.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    signed = d.select("doc_id", "text").mapInArrow(_signed(join, parts, heavy), "part int, sigs binary, names binary").repartition(parts, "part")
    clusters = components(candidates(signed, read.filter("kind = 0 and n > 0"), join, parts))
    members = clusters.join(reps, "id")
    weight = members.groupBy("component").agg(F.sum("n").alias("tokens"))
    members = written(members.join(weight, "component").select("id", F.col("component").alias("cluster"), F.greatest(F.lit(1), F.ceil(F.col("tokens") / join.budget)).cast("int").alias("blocks"), "f1", "f2"), "join-members")
    small = members.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    side = F.broadcast(members) if small else members
    found = d.join(side, d["doc_id"] == side["id"]).select("doc_id", "text", "cluster", "blocks", "f1", "f2")
    sets = found.mapInArrow(_sets(join), "cluster long, blocks int, doc_id long, shingles binary")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("own"), o).alias("i"), F.greatest(F.col("own"), o).alias("j")))
    dealt = sets.withColumn("own", own).withColumn("p", F.explode(pairs)).select("cluster", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "doc_id", "shingles")
    dealt = dealt.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    links = components(dealt.mapInArrow(_verified(join), "a long, b long"))
    named = reps.join(links, "id", "left").select(F.col("f1").alias("_f1"), F.col("f2").alias("_f2"), F.coalesce("component", "id").alias("component_id"))
    out = rows.join(named, (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2")), "left")
    return out.select("doc_id", "x", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def join_documents(docs: DataFrame, join: Join = Join()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id."""
    known = lambda c: F.when(F.col(c) != _LAST, F.col(c)).alias(c)
    return linked(docs, join).select(known("doc_id"), "n_shingles", known("component_id"))


def one_of_each(docs: DataFrame, join: Join = Join()) -> DataFrame:  # noqa: B008
    """docs with one document of each group of linked ones, the least doc_id (of its texts the least by hash, once);
    documents without words all stay. All columns are kept as they are, whatever their names."""
    found = written(linked(docs, join), "join-components")
    words = found.filter("n_shingles > 0")
    chosen = words.groupBy("component_id").agg(F.min(F.struct("doc_id", "x")).alias("c")).select(F.col("c.doc_id").alias("k"), F.col("c.x").alias("kx"))
    match = (F.col("doc_id") == F.col("k")) & (F.col("x") == F.col("kx"))
    gone = written(words.join(chosen, match, "left_anti").select(F.col("doc_id").alias("k"), F.col("x").alias("kx")).distinct(), "join-gone")
    again = written(words.join(chosen, match).groupBy("k", "kx").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "join-again")
    side = lambda t: F.broadcast(t) if t.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else t
    on = (F.col("id") == F.col("k")) & (F.col("x") == F.col("kx"))
    rows = packed(docs)
    d = rows.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64("row.text").alias("x")).join(side(gone), on, "left_anti")
    if again.isEmpty():
        return d.select("row.*")
    # rows that repeat a chosen document: the least by hash of them stays, found by partial minima
    twice = side(again)
    place = F.xxhash64(*[F.col(f"row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    once = d.join(twice, on, "left_semi").groupBy("id", "x").agg(F.min_by("row", place).alias("row"))
    return d.join(twice, on, "left_anti").select("row.*").unionAll(once.select("row.*"))
