"""Sets of word shingles as sorted 64-bit hashes, and their minwise signatures."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2**64 divided by the golden ratio


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):  # arithmetic modulo 2**64
        x = np.asarray(x, dtype=np.uint64) * _STEP
        x = (x ^ (x >> np.uint64(29))) * _ODD[0, 0]
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The text's distinct k-word shingles, sorted; with fewer words the whole sequence is one.

    Bytes fold A-Z only and split at the blanks x20 and x09-x0D only.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    width = min(k, n)
    out = mix(hashes[: n - width + 1])
    for j in range(1, width):
        out = mix(out + hashes[j: n - width + 1 + j])
    return np.unique(out if width == k else mix(out ^ np.uint64(width)))


def digest(values: np.ndarray) -> bytes | None:
    """128 bits that name the set; None for the empty set."""
    return xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None


def signature(values: np.ndarray, size: int) -> np.ndarray:
    """Minwise values: the least of each of ``size`` hash functions over the set."""
    out = np.full(size, 0xFFFFFFFF, dtype=np.uint64)
    for start in range(0, len(values), 4096):
        part = values[start: start + 4096, None] * _ODD[0, :size] + _ODD[1, :size]
        np.minimum(out, (part >> np.uint64(32)).min(axis=0), out=out)
    return out.astype(np.uint32)


def groups_of(batches, key: str):
    """The rows of each key, as record batch slices, from batches sorted by key."""
    import pyarrow as pa

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        for a, b in zip(starts[:-1], starts[1:]):
            yield batch.slice(a, b - a)
        rest = batch.slice(starts[-1])
    if rest is not None:
        yield rest


def labels_of(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric neighbour matrix the first row of its component."""
    label = np.arange(len(near))
    open_ = near.any(axis=1)
    for first in np.flatnonzero(open_):
        if not open_[first]:
            continue
        front = np.array([first])
        while len(front):  # each row is spread from once
            open_[front] = False
            label[front] = first
            reached = near[front[:256]].any(axis=0)
            for start in range(256, len(front), 256):
                reached |= near[front[start: start + 256]].any(axis=0)
            front = np.flatnonzero(reached & open_)
    return label
