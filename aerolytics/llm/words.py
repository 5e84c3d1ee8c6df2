"""Words of Arrow string columns as 64-bit hashes, by numpy over the column's buffers.

Lower-cases A-Z; words are runs of bytes other than ASCII white space, so that UTF-8 sequences stay whole.
Everything is linear in the bytes and holds one batch; batches are bounded by split_bytes()."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
BATCH_BYTES = 2 << 20


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(256)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): text i is bytes[offsets[i]:offsets[i + 1]]; null has none."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.empty(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


def words(texts: pa.Array, where: bool = False) -> tuple[np.ndarray, ...]:
    """(hashes, first): the words of text i are hashes[first[i]:first[i + 1]]. where: also each word's first and end byte."""
    data, offsets = buffers(texts)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]
    at = np.flatnonzero(inside)
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        empty = np.empty(0, np.int64)
        return (np.empty(0, np.uint64), first, *([empty, empty] if where else []))
    heads = np.searchsorted(at, starts) if len(starts) < len(at) // 64 else np.flatnonzero(begins[at])
    lengths = np.diff(np.append(heads, len(at)))
    pos = np.arange(len(at), dtype=np.int64) - np.repeat(heads, lengths)
    top = int(lengths.max())
    power = _POW if top <= len(_POW) else _powers(top)
    value = (_LOWER[data[at]].astype(np.uint64) + np.uint64(1)) * power[pos]
    hashes = mix64(np.add.reduceat(value, heads) ^ (lengths.astype(np.uint64) << np.uint64(56)))
    return (hashes, first, starts, starts + lengths) if where else (hashes, first)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; fewer words make one shingle, none an empty set."""
    h, first = words(texts)
    out, salt = [], [mix64(np.array([0xA5A5A5A5 + 7919 * i], np.uint64))[0] | np.uint64(1) for i in range(k)]
    n = len(h) - k + 1
    if n > 0:
        joined = h[:n] * salt[0]
        for i in range(1, k):
            joined += mix64(h[i : i + n] + np.uint64(i)) * salt[i]
        joined = mix64(joined)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(joined[a : b - k + 1]))
        elif b > a:
            short = np.array([0x51ED270B + b - a], np.uint64)
            for i, x in enumerate(h[a:b]):
                short = mix64(short * salt[i] + x)
            out.append(short)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def split_bytes(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        _, offsets = buffers(column)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, min(to, batch.num_rows) - at)
            at = to
