"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class). The most frequent words
are classes of their own; all others share classes by their last letters. The
class is predicted by a maximum-entropy model over hashed features of the history
(the word before, the two words before, and the word before the last, skipping
one). The word in its class is predicted by a second softmax over features of the word
before and the two words before. It runs along a Huffman tree over the words of the class: at every inner node a softmax
chooses one of two sides. The bias of a node is the logarithm of the counts (plus one)
below its sides, so that without features a word has its share of the counts, and each
feature (the node, hashed to a slot of the history's row) moves the choice from there. The
words beyond the most frequent ones are one leaf of their class, in which a word has
its share of the counts, with one more share for words that training never met.

Training is one pass over all training tokens, in rounds: tasks start from the
same weights, follow the gradient in small batches, and send what they changed;
changes are averaged by how often a feature was met. Scoring runs in batches of
sparse feature rows.

Counts cover every training token. Only the most frequent words, a table of
bounded size, are handed to the tasks; the counts of all other words are joined.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.work import new_dir, written
from .base import lean_batches, most_frequent, utf8
from .shingles import mix

END = b"\n"  # the end of a text as a token; words hold no blanks, so it is no word
OWN, SHARED = 56, 8
CLASSES = OWN + SHARED
BUCKETS = 1 << 14
SLOTS = 64  # weights of a bucket for the choices inside classes
BATCH = 4096
SENT = 1024  # weight rows that go in one piece
HELD = 250_000  # words that a task counts before it sends them on


def tokens_of(text: bytes) -> list[bytes]:
    """Words, A-Z folded, parted by blanks only; then the end."""
    words = text.lower().split()
    words.append(END)
    return words


def shared_class(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % SHARED


def counts(docs: DataFrame, text: Column) -> DataFrame:
    """``token, c`` over all texts."""

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found.update(tokens_of(t))
                if len(found) > HELD:
                    yield send(found)
                    found = Counter()
        yield send(found)

    def send(found):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["token", "c"]
        )

    partial = docs.select(utf8(text)).mapInArrow(count, "token binary, c bigint")
    return partial.groupBy("token").agg(F.sum("c").alias("c"))


class Words:
    """Leaf and hash of words: shipped ones have a leaf each, all others that of their class."""

    def __init__(self, table: tuple):
        """``table`` as ``word_table`` makes it."""
        words, self.hashes, self.classes, self.tree = table
        self.shipped = len(words)
        self.place = dict(zip(words, range(len(words))))

    def look(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        leaves = np.fromiter(map(self.place.get, tokens, repeat(-1)), dtype=np.int64, count=len(tokens))
        hashes = self.hashes[leaves]
        other = np.flatnonzero(leaves < 0)
        new = [tokens[i] for i in other.tolist()]
        hashes[other] = np.fromiter(map(zlib.crc32, new), dtype=np.uint64, count=len(new))
        leaves[other] = self.shipped + np.fromiter(map(shared_class, new), dtype=np.int64, count=len(new))
        return leaves, hashes


def word_table(frequent: list[tuple[bytes, int]], rest: list[int]) -> tuple:
    """Words, and hashes, classes and trees of their leaves, for tasks.

    After the leaves of the words comes one for each shared class: all its other words,
    which have ``rest`` shares together.
    """
    words = [w for w, _ in frequent]
    hashes = np.array([*map(zlib.crc32, words), *[0] * SHARED], dtype=np.uint64)
    classes = [i if i < OWN else OWN + shared_class(w) for i, w in enumerate(words)] + list(range(OWN, CLASSES))
    return words, hashes, np.array(classes), trees([c + 1 for _, c in frequent] + list(rest), classes)


def trees(shares: list[int], classes: list[int]) -> tuple:
    """A Huffman tree over the leaves of each class, so that frequent words need few choices.

    Returns for each leaf where its path begins in the steps and how many there are, and for
    each step its slot (doubled, plus the side taken) and the node's log odds of side 1.
    """
    n = len(shares)
    up, side = np.full(2 * n, -1), np.zeros(2 * n, dtype=np.int64)
    odds: list[float] = []
    heaps: dict[int, list] = {}
    for leaf, c in enumerate(classes):
        heaps.setdefault(c, []).append((shares[leaf], leaf))
    for heap in heaps.values():
        heapq.heapify(heap)
        while len(heap) > 1:
            zero, node = heapq.heappop(heap), n + len(odds)
            one = heapq.heapreplace(heap, (zero[0] + heap[0][0], node))
            up[zero[1]] = up[one[1]] = node
            side[one[1]] = 1
            odds.append(np.log(one[0] / zero[0]))
    leaves, at, parts = np.arange(n), np.arange(n), []
    while len(leaves):
        leaves, at = leaves[up[at] >= 0], at[up[at] >= 0]
        parts.append((leaves, (up[at] - n) * 2 + side[at]))
        at = up[at]
    owner, steps = (np.concatenate(x) for x in zip(*parts))
    counted = np.bincount(owner, minlength=n)
    steps = steps[np.argsort(owner, kind="stable")]
    slots = (mix(steps >> 1) % np.uint64(SLOTS)).astype(np.uint8) * 2 + (steps & 1)
    return np.cumsum(counted) - counted, counted, slots.astype(np.uint8), np.array(odds, dtype=np.float32)[steps >> 1]


def features(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Weight rows of each token's history, for texts that end at ``ends``."""
    one = np.concatenate([[0], hashes[:-1]]).astype(np.uint64)
    two = np.concatenate([[0, 0], hashes[:-2]])[: len(hashes)].astype(np.uint64)
    starts = np.concatenate([[0], ends[:-1]])
    one[starts] = 0
    two[starts] = 0
    later = starts[starts + 1 < np.append(starts[1:], len(hashes))] + 1
    two[later] = 0
    keys = (one << np.uint64(2), mix(one) + two * np.uint64(4) + np.uint64(1), (two << np.uint64(2)) + np.uint64(2))
    return np.stack([1 + (mix(k) % np.uint64(BUCKETS - 1)).astype(np.int64) for k in keys])


def chances(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """P(class | history) for a batch of sparse rows; row 0 of the weights is the bias."""
    score = weights.take(rows[0], axis=0)
    for row in rows[1:]:
        score += weights.take(row, axis=0)
    score += weights[0]
    with np.errstate(over="ignore"):
        raised = np.exp(score)
        total = raised.sum(axis=1)
    if not (np.isfinite(total) & (total > 1e-30)).all():
        raised = np.exp(score - score.max(axis=1, keepdims=True))
        total = raised.sum(axis=1)
    raised *= (1 / total)[:, None]
    return raised


def powers(weights: np.ndarray) -> np.ndarray:
    """Each row of the weights, with its part of the bias, as factors of at most one."""
    rows = weights + weights[0] / 3
    return np.exp(rows - rows.max(axis=1, keepdims=True))


def class_logs(weights: np.ndarray, factors: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """log10 P(class | history) of one class a token: the rows' factors are multiplied instead of raised anew."""
    product = factors.take(rows[0], axis=0)
    for row in rows[1:]:
        product *= factors.take(row, axis=0)
    total = product.sum(axis=1)
    chance = product[np.arange(len(classes)), classes] / np.maximum(total, 1e-30)
    low = np.flatnonzero((chance < 1e-20) | (total < 1e-20))
    if len(low):  # too small for the products
        chance[low] = chances(weights, rows[:, low])[np.arange(len(low)), classes[low]]
    return np.log10(np.maximum(chance, 1e-30))


def choices(tree: tuple, leaves: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """All choices on the tokens' paths: how many a token has, side, log odds without features, and the weights in use."""
    starts, counted, slots, odds = tree
    n = counted[leaves]
    step = np.repeat(starts[leaves] - (np.cumsum(n) - n), n)
    step += np.arange(len(step))
    slot = slots[step]
    at = [np.repeat(row * SLOTS, n) for row in rows[:2]]
    for a in at:
        a += slot >> 1
    return n, slot & 1, odds[step], at


def chosen(weights: np.ndarray, base: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    """The log odds of side 1."""
    score = base + weights[at[0]]
    for a in at[1:]:
        score += weights[a]
    return score


def leaf_logs(tree: tuple, weights: np.ndarray, leaves: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """log10 P(leaf | class, history) of each token: the choices of its path together."""
    n, side, base, at = choices(tree, leaves, rows)
    score = chosen(weights, base, at)
    score *= np.float32(1) - np.float32(2) * side
    costs = np.maximum(score, 0) + np.log(1 + np.exp(-np.abs(score)))
    sums = np.concatenate([[0], np.cumsum(costs, dtype=float)])
    ends = np.cumsum(n)
    return (sums[ends - n] - sums[ends]) / np.log(10)


def group_sums(values: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows ``values[order]`` from each start to the next.

    Groups are cut into pieces of eight rows; the second rows of all pieces are added at
    once, then their third rows, and so on, and the sums of pieces are summed the same way.
    """
    sizes = np.diff(np.append(starts, len(order)))
    pieces = (sizes + 7) // 8
    before = np.cumsum(pieces) - pieces
    rank = (np.arange(pieces.sum()) - np.repeat(before, pieces)) * 8
    first = np.repeat(starts, pieces) + rank
    left = np.repeat(sizes, pieces) - rank
    out = values.take(order[first], axis=0)
    more = np.arange(len(first))
    for rank in range(1, 8):
        more = more[left[more] > rank]
        if not len(more):
            break
        out[more] += values.take(order[first[more] + rank], axis=0)
    return out if len(first) == len(starts) else group_sums(out, np.arange(len(out)), before)


def _slices(batches, size: int = 2_000_000):
    """Pieces of the batches with about ``size`` bytes of text, at least one text each."""
    for batch in batches:
        sizes = np.cumsum([len(t) for t in batch.column("text").to_pylist()])
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + size, side="right")))
            yield batch.slice(start, end - start)
            start = end


def _texts(batch, words: Words):
    """Leaves and hashes of the batch's tokens, one text after the other, where each text ends, and the tokens."""
    tokens: list[bytes] = []
    ends = []
    for text in batch.column("text").to_pylist():
        tokens += tokens_of(text)
        ends.append(len(tokens))
    return *words.look(tokens), np.array(ends, dtype=np.int64), tokens


class Learner:
    """Weights of both softmaxes that follow the gradient, and how often each row was met."""

    def __init__(self, classes: np.ndarray, slots: np.ndarray, rate: float):
        self.rate = np.float32(rate)
        # made anew with this very dtype: numpy's add.at is ten times slower on arrays that were pickled
        self.classes, self.slots = np.empty(classes.shape, np.float32), np.empty(slots.shape, np.float32)
        self.classes[:], self.slots[:] = classes, slots
        self.squares = np.ones(BUCKETS, dtype=np.float32)
        self.met = np.zeros(BUCKETS, dtype=np.int64)
        self.faced = np.ones(slots.size, dtype=np.float32)

    def learn_classes(self, rows: np.ndarray, classes: np.ndarray) -> None:
        error = chances(self.classes, rows)
        error[np.arange(len(classes)), classes] -= 1
        flat = rows.ravel()
        order = np.argsort(flat.astype(np.uint16), kind="stable")  # by digits: there are 2^14 rows
        flat = flat[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        self._step(flat[first], group_sums(error, order % len(classes), first), np.diff(np.append(first, len(flat))))
        self._step(np.array([0]), error.sum(axis=0, keepdims=True), len(classes))

    def _step(self, where: np.ndarray, slope: np.ndarray, n) -> None:
        squares = self.squares[where] + np.einsum("ij,ij->i", slope, slope) / 4
        self.squares[where] = squares
        slope *= (-self.rate / np.sqrt(squares))[:, None]
        slope += self.classes.take(where, axis=0)
        self.classes[where] = slope
        self.met[where] += n

    def learn_choices(self, tree: tuple, leaves: np.ndarray, rows: np.ndarray) -> None:
        weights, one = self.slots.reshape(-1), np.float32(1)
        _, side, base, at = choices(tree, leaves, rows)
        step = self.rate * (side - one / (one + np.exp(-chosen(weights, base, at))))
        for a in at:
            np.add.at(self.faced, a, one)
            np.add.at(weights, a, step / np.sqrt(self.faced.take(a)))


def _as_lines(rows: np.ndarray, met: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
    """Weight rows, how often they were met, and the bytes of their changes."""
    width = change.shape[1] * change.itemsize
    whole = pa.py_buffer(np.ascontiguousarray(change))
    ends = pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32))
    lines = pa.Array.from_buffers(pa.binary(), len(rows), [None, ends, whole])
    return pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(met), lines], names=["row", "met", "change"])


def _changes(lines: pa.Array, kind: type) -> np.ndarray:
    """The changes that ``_as_lines`` wrote, a line each."""
    ends = np.frombuffer(lines.buffers()[1], np.int32, len(lines) + 1, lines.offset * 4)
    return np.frombuffer(lines.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(lines), -1)


def averages(batches):
    """The mean change of every row, weighted by how often each task met it; all changes of a row are in these batches."""
    place = np.full(BUCKETS, -1)
    met, total = np.zeros(0, dtype=np.int64), np.zeros((0, CLASSES + SLOTS))
    for batch in batches:
        if not batch.num_rows:
            continue
        rows, times = batch.column("row").to_numpy(), batch.column("met").to_numpy()
        order = np.argsort(rows, kind="stable")
        mine, first = np.unique(rows[order], return_index=True)
        fresh = mine[place[mine] < 0]
        if len(fresh):
            place[fresh] = np.arange(len(met), len(met) + len(fresh))
            met = np.concatenate([met, np.zeros(len(fresh), dtype=np.int64)])
            total = np.concatenate([total, np.zeros((len(fresh), CLASSES + SLOTS))])
        change = _changes(batch.column("change"), np.float32) * times[:, None].astype(float)
        total[place[mine]] += np.add.reduceat(change[order], first, axis=0)
        met[place[mine]] += np.add.reduceat(times[order], first)
    where = np.flatnonzero(place >= 0)
    for some in (where[at : at + SENT] for at in range(0, len(where), SENT)):
        yield _as_lines(some, met[place[some]], total[place[some]] / met[place[some], None])


def train(
    docs: DataFrame, text: Column, slice_of: Column, known, slices: int = 8, rate: float = 0.3
) -> tuple[np.ndarray, np.ndarray]:
    """The weights of both softmaxes after one pass: first over one slice of the texts, then over all others.

    ``known`` is a broadcast ``word_table``.
    """
    spark = docs.sparkSession
    weights = np.zeros((BUCKETS, CLASSES + SLOTS), dtype=np.float32)
    rows = docs.select(utf8(text).alias("text"), F.pmod(slice_of, F.lit(slices)).alias("slice"))
    # every task sends its weights: the slice, a small part of the input, goes to fewer tasks than the rest
    tasks = rows.rdd.getNumPartitions()
    fewer = max(tasks // slices, min(tasks, spark.sparkContext.defaultParallelism), 1)
    for part in (rows.where("slice = 0").coalesce(fewer), rows.where("slice <> 0")):
        start = spark.sparkContext.broadcast(weights)

        def descend(batches, start=start):
            words = Words(known.value)
            own = Learner(start.value[:, :CLASSES], start.value[:, CLASSES:], rate)
            for batch in _slices(batches):
                leaves, hashes, ends, _ = _texts(batch, words)
                rows_, classes = features(hashes, ends), words.classes[leaves]
                parts = [slice(at, at + BATCH) for at in range(0, len(leaves), BATCH)]
                for now in parts:
                    own.learn_classes(rows_[:, now], classes[now])
                for now in parts:
                    own.learn_choices(words.tree, leaves[now], rows_[:, now])
            where = np.flatnonzero(own.met)
            for some in (where[at : at + SENT] for at in range(0, len(where), SENT)):
                change = np.concatenate([own.classes[some], own.slots[some]], axis=1) - start.value[some]
                yield _as_lines(some, own.met[some], change)

        sent = part.select("text").mapInArrow(descend, "row int, met bigint, change binary")
        # every bucket's changes meet in one task; at most one line a bucket reaches the driver
        mean = sent.repartition("row").mapInArrow(averages, "row int, met bigint, change binary").toArrow()
        if mean.num_rows:
            weights = weights.copy()
            weights[mean.column("row").to_numpy()] += _changes(mean.column("change").combine_chunks(), np.float64).astype(np.float32)
        start.unpersist()
    return weights[:, :CLASSES].copy(), weights[:, CLASSES:].copy()


def score(
    docs: DataFrame,
    held_out: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    frequent_words: int = 200_000,
) -> DataFrame:
    """log10 probability of every whole text, learnt from the rows that are not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (counts plus
    one over all tokens) and score (the model's). A null text is empty and has the
    end only. Rows that repeat an id are scored one by one; extra columns are left
    out. Without training rows every token is unknown: base_score is 0.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    taught = docs.where(~held_out)
    vocabulary = written(counts(taught, F.col(text_col)), new_dir(spark, "counts"))
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = most_frequent(vocabulary, "c", frequent_words).toArrow()
    frequent = sorted(zip(top.column("token").to_pylist(), top.column("c").to_pylist()), key=lambda x: (-x[1], x[0]))
    share = F.crc32(F.when(F.length("token") > 2, F.substring("token", -2, 2)).otherwise(F.col("token"))) % SHARED
    sums = {r[0]: r[1] for r in vocabulary.groupBy(share).agg(F.sum(F.col("c") + 1)).collect()}
    for word, c in frequent:
        sums[shared_class(word)] -= c + 1
    # what the other words of each shared class have, with one share for unknown words
    rest = [sums.get(i, 0) + 1 for i in range(SHARED)]
    known = spark.sparkContext.broadcast(word_table(frequent, rest))
    model = spark.sparkContext.broadcast(train(taught, F.col(text_col), F.xxhash64(id_col, text_col), known))
    shipped = len(frequent)
    count_logs = np.log10(np.array([c + 1 for _, c in frequent] + [1] * SHARED, dtype=float))
    rest_logs = np.concatenate([np.zeros(shipped), np.log10(np.array(rest, dtype=float))])
    whole = float(np.log10(total + distinct + 1))

    def run(batches):
        words, (weights, slots) = Words(known.value), model.value
        factors = powers(weights)
        for batch in _slices(batches):
            leaves, hashes, ends, every = _texts(batch, words)
            rows, classes = features(hashes, ends), words.classes[leaves]
            logs = -rest_logs[leaves]
            parts = [slice(at, at + BATCH) for at in range(0, len(leaves), BATCH)]
            for now in parts:
                logs[now] += class_logs(weights, factors, rows[:, now], classes[now])
            for now in parts:
                logs[now] += leaf_logs(words.tree, slots.reshape(-1), leaves[now], rows[:, now])
            of = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
            add = lambda x: np.bincount(of, weights=x, minlength=len(ends))
            met = leaves < shipped
            others = np.flatnonzero(~met)
            cuts = [0, *np.searchsorted(others, ends).tolist()]
            others = [every[i] for i in others.tolist()]
            rare = [Counter(others[a:b]) for a, b in zip(cuts, cuts[1:])]
            lists = lambda values, kind: pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, rare)]), pa.int32()), pa.array([v for r in rare for v in values(r)], kind)
            )
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "n_tokens": pa.array(np.diff(np.concatenate([[0], ends])), pa.int64()),
                "n_known": pa.array(add(met).astype(np.int64)),
                "base": pa.array(add(count_logs[leaves])),
                "model": pa.array(add(logs)),
                "rare": lists(Counter.keys, pa.binary()), "times": lists(Counter.values, pa.int64()),
            })

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), utf8(F.col(text_col)).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, model double, "
        "rare array<binary>, times array<bigint>",
    )
    # one pass over the texts; the counts of words that are not shipped are joined from here
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()), new_dir(spark, "scored"))
    rare = scored.select("row", F.inline(F.arrays_zip(F.col("rare").alias("token"), F.col("times").alias("times"))))
    found = rare.join(vocabulary, "token").groupBy("row").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more")
    )
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("rare", "times").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
