"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or not at all on every document. Expectation
maximisation over the counts of vote patterns of all documents estimates how far
each heuristic is to be trusted, and with that the probability that a document is
good. These probabilities are the labels of a hashed linear scorer, which reads
the text itself and decides.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import lean_batches

BAD, NONE, GOOD = 0, 1, 2
LABELLERS = ("repeats", "symbols", "separators", "letters", "variety", "shouting", "lengths", "lines", "prose", "singles")
DIM = 1 << 12
REMEMBERED = 100_000  # words a task keeps
_MARKS = regex.compile(r"[^\w\s\p{M}]{2,}")
# Letters of scripts that are written without blanks; so many of them make a word.
_UNBROKEN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]")
UNBROKEN_WORD = 5


def _is_letter(c: str) -> bool:
    """A letter or digit, or a sign that combines with one."""
    return c.isalnum() or unicodedata.category(c)[0] == "M"


class Reader:
    """Statistics and shape features of texts; remembers words, up to a bound."""

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.table = np.zeros((1 << 14, 6), dtype=np.int64)

    @staticmethod
    def _word(word: str) -> tuple:
        """Hash of the shape, signs, letters and digits, and whether marks, a separator, loud."""
        body = word[:-1] if word[-1] in ".,;:!?" else word
        if body.isalpha() and (body.islower() or body.istitle()):
            shape = ("x" if body.islower() else "Xx" if len(body) > 1 else "X") + word[len(body):]
            return zlib.crc32(shape.encode()), len(word), len(body), False, False, False
        # letters without case count as small ones
        signs = ["X" if c.isupper() else "9" if c.isdigit() else "x" if _is_letter(c) else c for c in word]
        shape = "".join(s for i, s in enumerate(signs) if not i or s != signs[i - 1])
        letters, size = sum(map(_is_letter, word)), len(word)
        unbroken = 0 if word.isascii() else len(_UNBROKEN.findall(word))
        if unbroken > UNBROKEN_WORD:
            # a sentence without blanks is as long as a word, with as large a share of letters
            rest = size - unbroken
            marks = regex.sub(r"\p{P}", "", word) if rest else word
            letters, size = UNBROKEN_WORD + sum(map(_is_letter, marks)) - unbroken, UNBROKEN_WORD + max(0, len(marks) - unbroken)
        return (
            zlib.crc32(shape.encode()), size, letters, bool(_MARKS.search(word)),
            letters == 0, letters > 1 and word.isupper(),
        )

    def _ids(self, text: str) -> np.ndarray:
        words = text.split()
        if len(self.place) > REMEMBERED:
            self._forget()
        place, ids = self.place, []
        for w in words:
            at = place.get(w)
            if at is None:
                at = place[w] = len(place)
                if at == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[at] = self._word(w)
            ids.append(at)
        return np.array(ids, dtype=np.int64)

    def stats(self, text: str) -> tuple[dict, np.ndarray, np.ndarray]:
        ids = self._ids(text)
        n, table = len(ids), self.table[ids]
        size = max(n, 1)
        lines = [x for x in text.split("\n") if x.strip()]
        return {
            "n": n,
            "repeats": float((ids[1:] == ids[:-1]).sum()) / size,
            "symbols": float(table[:, 3].sum()) / size,
            "separators": float(table[:, 4].sum()) / size,
            "letters": float(table[:, 2].sum()) / max(float(table[:, 1].sum()), 1.0),
            "variety": len(np.unique(ids)) / size,
            "shouting": float(table[:, 5].sum()) / size,
            "lengths": float(table[:, 1].sum()) / size,
            "singles": float((table[:, 1] == 1).sum()) / size,
            "lines": 1 - len(set(lines)) / max(len(lines), 1),
            "n_lines": len(lines),
        }, ids, table

    @staticmethod
    def votes(s: dict) -> list[int]:
        def vote(bad: bool, good: bool = False) -> int:
            return BAD if bad else GOOD if good else NONE

        enough = s["n"] >= 3
        return [
            vote(s["n"] >= 8 and s["repeats"] > 0.25, enough and s["repeats"] < 0.05),
            vote(s["symbols"] > 0.25, enough and s["symbols"] < 0.02),
            vote(s["separators"] > 0.15, enough and s["separators"] < 0.02),
            vote(s["letters"] < 0.7, s["letters"] > 0.92),
            vote(s["n"] >= 40 and s["variety"] < 0.12, s["n"] >= 40 and s["variety"] > 0.4),
            vote(s["shouting"] > 0.3, enough and s["shouting"] < 0.05),
            vote(s["n"] == 0 or not 2.2 <= s["lengths"] <= 14),
            vote(s["n_lines"] >= 4 and s["lines"] > 0.6, s["n_lines"] >= 4 and s["lines"] < 0.1),
            vote(False, enough and s["repeats"] < 0.15 and s["letters"] > 0.8 and s["separators"] < 0.05 and s["symbols"] < 0.05),
            vote(s["n"] >= 4 and s["singles"] > 0.3, enough and s["singles"] < 0.15),
        ]

    @staticmethod
    def features(stats: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Hashed sparse features: shares of word shapes and shape pairs, and graded statistics."""
        s, ids, table = stats
        size = max(len(ids), 1)
        shapes = table[:, 0]
        pairs = (shapes[:-1] * 1_000_003 + shapes[1:]) % ((1 << 31) - 1)
        graded = [
            zlib.crc32(f"{k}:{min(int(s[k] * 10), 9) if k != 'lengths' else min(int(s[k]), 20)}".encode())
            for k in ("repeats", "symbols", "separators", "letters", "variety", "shouting", "lengths", "lines", "singles")
        ]
        at = np.concatenate([shapes, pairs, np.array(graded, dtype=np.int64)]) % DIM
        value = np.concatenate([np.full(len(shapes), 1 / size), np.full(len(pairs), 1 / size), np.full(len(graded), 0.5)])
        where, back = np.unique(at, return_inverse=True)
        return where, np.bincount(back, weights=value)


def pattern(votes: list[int]) -> int:
    return sum(v * 3 ** i for i, v in enumerate(votes))


def estimate(patterns: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """The probability of good for each vote pattern, by EM over the patterns' counts.

    Two classes; given the class, heuristics vote independently, and one that does not
    vote says nothing. It starts from the votes themselves: any bad vote outweighs the
    good ones.
    """
    if not patterns:
        return {}
    keys = np.array(sorted(patterns), dtype=np.int64)
    weight = np.array([patterns[k] for k in keys.tolist()], dtype=float)
    votes = np.stack([keys // 3 ** i % 3 for i in range(len(LABELLERS))], axis=1)
    bad, good = (votes == BAD).sum(axis=1), (votes == GOOD).sum(axis=1)
    p = np.where(bad > 0, 0.05, np.where(good > 0, 0.95, 0.7))
    one_hot = votes[:, :, None] == np.array([BAD, GOOD])
    # what is believed beforehand, worth a fifth of the rows: a heuristic seldom blames
    # a good document, and is blind to most other kinds of bad ones
    belief = 0.2 * weight.sum() * np.array([[[0.3, 0.7]], [[0.002, 0.998]]])
    for _ in range(rounds):
        classes = np.stack([(1 - p) * weight, p * weight])
        prior = (classes.sum(axis=1) + 1) / (weight.sum() + 2)
        rates = np.einsum("cp,pjv->cjv", classes, one_hot) + belief
        rates /= rates.sum(axis=2, keepdims=True)
        logs = np.log(prior)[:, None] + np.einsum("cjv,pjv->cp", np.log(rates), one_hot)
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return dict(zip(keys.tolist(), p.tolist()))


def fit_linear(rows: list[tuple], rounds: int = 400, rate: float = 4.0, decay: float = 1e-5) -> np.ndarray:
    """Logistic weights (the bias is last) for rows of (places, values, probability)."""
    weights = np.zeros(DIM + 1)
    if not rows:
        weights[-1] = 1.0
        return weights
    sizes = np.array([len(r[0]) for r in rows])
    at = np.concatenate([np.asarray(r[0], dtype=np.int64) for r in rows])
    value = np.concatenate([np.asarray(r[1], dtype=float) for r in rows])
    label = np.array([r[2] for r in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    squares = np.full(DIM + 1, 1e-8)
    for _ in range(rounds):
        score = np.bincount(row, weights=value * weights[at], minlength=len(rows)) + weights[-1]
        error = 1 / (1 + np.exp(-np.clip(score, -50, 50))) - label
        slope = np.append(np.bincount(at, weights=value * error[row], minlength=DIM), error.sum())
        slope = slope / len(rows) + decay * weights
        squares += slope ** 2
        weights -= rate / 10 * slope / np.sqrt(squares)
    return weights


def vote(text_col: str):
    """A column function: text -> vote pattern."""
    kept: dict = {}

    @F.pandas_udf("int")
    def read(texts: pd.Series) -> pd.Series:
        reader = kept.setdefault("it", Reader())
        return pd.Series([pattern(reader.votes(reader.stats(t or "")[0])) for t in texts.tolist()], dtype="int32")

    return read(F.col(text_col))


class Model:
    def __init__(self, posterior: dict[int, float], weights: np.ndarray):
        self.posterior, self.weights = posterior, weights


def fit(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", train_rows: int = 20_000
) -> Model:
    """Estimate the heuristics on all rows and train the scorer on a bounded sample.

    A null text counts as an empty one; repeated rows count again, ids may be null or
    repeat, other columns do not matter. Texts are read whole, however long. Without a
    row the scorer finds everything good.

    Vote patterns are counted over every row. The linear scorer is trained on about
    ``train_rows`` rows, those with the smallest hash of id and text (all rows of a
    smaller table); only their sparse features, and one count a pattern, reach the
    driver.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    counts = docs.select(vote(text_col).alias("votes")).groupBy("votes").count().collect()
    patterns = {r[0]: r[1] for r in counts}
    posterior = estimate(patterns)
    total = sum(patterns.values())
    share = min(1.0, train_rows / max(total, 1))
    shared = spark.sparkContext.broadcast(posterior)

    @F.pandas_udf("at array<int>, value array<double>, p double")
    def featurise(texts: pd.Series) -> pd.DataFrame:
        reader, out = Reader(), []
        for text in texts.tolist():
            stats = reader.stats(text or "")
            at, value = reader.features(stats)
            out.append((at.tolist(), value.tolist(), shared.value.get(pattern(reader.votes(stats[0])), 0.5)))
        return pd.DataFrame(out, columns=["at", "value", "p"])

    drawn = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = docs.where(drawn).select(featurise(F.col(text_col)).alias("f")).select("f.*").collect()
    shared.unpersist()
    return Model(posterior, fit_linear([tuple(r) for r in rows]))


def scored(model: Model, spark):
    """A column function: text -> struct(votes, posterior, score)."""
    shared = spark.sparkContext.broadcast(model)
    kept: dict = {}

    @F.pandas_udf("votes int, posterior double, score double")
    def score(texts: pd.Series) -> pd.DataFrame:
        reader, m, out = kept.setdefault("it", Reader()), shared.value, []
        for text in texts.tolist():
            stats = reader.stats(text or "")
            at, value = reader.features(stats)
            votes = pattern(reader.votes(stats[0]))
            z = float(value @ m.weights[at] + m.weights[-1])
            out.append((votes, m.posterior.get(votes, 0.5), 1 / (1 + np.exp(-np.clip(z, -50, 50)))))
        return pd.DataFrame(out, columns=["votes", "posterior", "score"])

    return score


def classify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5
) -> DataFrame:
    """``id, votes, posterior, score, kept`` of every row.

    ``score`` is the linear scorer's probability of good, ``posterior`` that of the
    votes alone. A null text counts as empty. A row is kept from ``threshold`` on. Repeated
    rows and ids are rows of their own, extra columns are left out, an empty table stays empty.
    """
    s = docs.select(id_col, scored(model, docs.sparkSession)(F.col(text_col)).alias("_s"))
    return s.select(id_col, "_s.*", (F.col("_s.score") >= threshold).alias("kept"))
