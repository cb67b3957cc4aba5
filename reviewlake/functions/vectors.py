"""Tokens, hashed text features and cosine as column expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat
from typing import Tuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fv

# White space as text splitting sees it, readable by Java regex and RE2.
WHITE = (
    r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)


def tokens(text: Column, stop_words=None) -> Column:
    stop = fv.STOP_WORDS if stop_words is None else stop_words
    words = F.transform(
        F.split(text, WHITE, -1), lambda w: F.lower(F.btrim(w, F.lit(fv.TOKEN_STRIP)))
    )
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(stop))


def _word_hashes(word: str) -> list[tuple[int, float]]:
    """Bucket (md5 modulo the buckets) and signed weight (sha1 parity) per hash."""
    out = []
    for i in range(fv.HASHES_PER_WORD):
        salted = f"{word}_{i}".encode()
        bucket = int.from_bytes(hashlib.md5(salted).digest(), "big") % fv.HASH_BUCKETS
        odd = hashlib.sha1(salted).digest()[-1] & 1
        out.append((bucket, (-1.0 if odd else 1.0) / (i + 1)))
    return out


class _Hashes:
    """Buckets and weights of the words a task has seen, up to a bound."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.table = np.zeros((1 << 12, fv.HASHES_PER_WORD, 2))

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.place) > REMEMBERED:
            self.__init__()
        at = np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            new = [words[i] for i in fresh.tolist()]
            at[fresh] = np.arange(len(self.place), len(self.place) + len(new))
            self.place.update(zip(new, at[fresh].tolist()))
            while len(self.place) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at[fresh]] = [_word_hashes(w) for w in new]
        return self.table[at]


CELLS = T.ArrayType(
    T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("v", T.DoubleType())])
)
REMEMBERED = 300_000  # words, of about 250 bytes each with their hashes
_SLICE_ROWS = 512


def _sums(batches: Iterator[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of every few rows their summed features, a line of all dimensions each, and which are there.

    Spark has no 128-bit numbers, and text repeats its words: each word of a few
    rows is looked up once, and words the task has seen before are not hashed.
    """
    hashes, width = _Hashes(), fv.EMBEDDING_DIM
    for words, strengths in batches:
        for start in range(0, len(words), _SLICE_ROWS):
            rows = words.slice(start, _SLICE_ROWS)
            sizes = np.nan_to_num(rows.value_lengths().to_numpy(zero_copy_only=False)).astype(int)
            coded = rows.flatten().dictionary_encode()
            mine = hashes.of(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            row = np.repeat(np.arange(len(rows)), sizes)[:, None]
            place = (row * width + mine[:, :, 0].astype(int)).ravel()
            there = np.bincount(place, minlength=len(rows) * width).reshape(-1, width) > 0
            total = np.bincount(place, weights=mine[:, :, 1].ravel(), minlength=len(rows) * width).reshape(-1, width).astype(float)
            strong = strengths.slice(start, _SLICE_ROWS).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            strong = np.repeat(strong, fv.CLUSTER_WIDTH, axis=1)
            clusters = slice(fv.HASH_BUCKETS, fv.HASH_BUCKETS + strong.shape[1])
            total[:, clusters], there[:, clusters] = strong, strong > 0
            yield total, there


def _as_cells(total: np.ndarray, there: np.ndarray) -> pa.Array:
    dims = np.nonzero(there)[1].astype(np.int32)
    structs = pa.StructArray.from_arrays([pa.array(dims), pa.array(total[there])], names=["dim", "v"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *there.sum(axis=1)]), pa.int32()), structs)


@F.arrow_udf(CELLS)
def summed_features(batches: Iterator[Tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Summed features of every row's words and cluster strengths, sorted by dim."""
    for total, there in _sums(batches):
        yield _as_cells(total, there)


@F.arrow_udf(CELLS)
def unit_features(batches: Iterator[Tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The same as vectors of unit length, rounded to six digits, halves away from zero."""
    for total, _ in _sums(batches):
        norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
        np.divide(total, norm, out=total, where=norm > 0)
        total = np.copysign(np.floor(np.abs(total) * 1e6 + 0.5) / 1e6, total)
        yield _as_cells(total, total != 0)


def cluster_strength(joined: Column, keywords: list[str]) -> Column:
    """How many of the keywords occur inside any of the joined words, capped."""
    n = sum((F.when(joined.contains(k), 1).otherwise(0) for k in keywords), F.lit(0))
    return F.least(n, F.lit(fv.CLUSTER_CAP)).cast("double")


def dense(cells: Column, dim: int = fv.EMBEDDING_DIM) -> Column:
    """Sorted (dim, v) structs as a full vector, gap by gap."""
    zero = F.lit(0.0)
    last = F.when(F.size(cells) > 0, F.element_at(cells, -1)["dim"]).otherwise(-1)
    body = F.flatten(
        F.transform(
            cells,
            lambda x, i: F.concat(
                F.array_repeat(
                    zero, x["dim"] - F.when(i > 0, F.get(cells, i - 1)["dim"]).otherwise(-1) - 1
                ),
                F.array(x["v"]),
            ),
        )
    )
    return F.concat(body, F.array_repeat(zero, F.lit(dim - 1) - last))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def cosine(a: Column, b: Column) -> Column:
    """0 for missing, empty, unequal or zero vectors; clipped to [-1, 1]."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fit = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(
        fit & (norms > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms))
    ).otherwise(F.lit(0.0))
