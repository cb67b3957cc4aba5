"""Language identification: words first, then shorter and shorter character n-grams.

A taught word scores by its log frequency in each language. An unseen word falls
back to its 5-grams; only words without a known one go on to 4-grams, and so on,
until some length has a known one. Scores of words add up.

The log frequency of an entry is that of a count of one half, the same for every
entry, and what its counts add to it in the languages that have it. So an entry is
kept, sent and summed as the few languages it occurs in, however many are taught.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.work import new_dir, written
from .base import lean_batches, most_frequent, small_side

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
FAMILIAR = 4  # an unseen word is familiar if it shares an n-gram of this length
UNKNOWN = "und"
HELD = 250_000  # entries that a task counts before it sends them on
# what is summed for a text beside its languages: words that no n-gram of is known, and unfamiliar words
UNSCORED, STRANGE = -1, -2
CELLS = "array<struct<lang:int,gain:double>>"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word between two blanks."""
    marked = f" {word} "
    return [marked[i: i + n] for i in range(len(marked) - n + 1)]


def has_letter(text: str, words) -> bool:
    return any(w.isalpha() for w in words) or any(c.isalpha() for c in text)


class Model:
    """The taught languages, and the tables of what each word and n-gram adds."""

    def __init__(self, totals: dict[str, int], words: DataFrame, grams_: DataFrame, frequent: list[tuple]):
        self.langs = sorted(totals)
        share = np.array([totals[x] for x in self.langs], dtype=float)
        self.prior = np.log((share + 1) / (share.sum() + len(share))) if len(share) else share
        # the log frequency of half a count
        self.base = np.log(0.5 / np.maximum(share, 1.0))
        self.words, self.grams, self.frequent = words, grams_, frequent


class Reader:
    """Adds up the frequent words of texts and returns the others with their counts."""

    def __init__(self, frequent: list[tuple], n_langs: int):
        self.n_langs = n_langs
        self.place = {w: i for i, (w, _, _, _) in enumerate(frequent)}
        self.total = np.array([t for _, t, _, _ in frequent], dtype=np.int64)
        self.start = np.cumsum([0, *(len(x) for _, _, x, _ in frequent)])
        self.lang = np.array([x for _, _, langs, _ in frequent for x in langs], dtype=np.int64)
        self.gain = np.array([g for _, _, _, gains in frequent for g in gains], dtype=float)

    def read(self, text: str | None) -> tuple[bool, int, int, list[float], Counter]:
        """Whether there is a letter, the words, the strange ones among the frequent, gains, other words."""
        counts = Counter(words_of(text)) if text else Counter()
        at, times, rest = [], [], Counter()
        for word, n in counts.items():
            i = self.place.get(word)
            if i is None:
                rest[word] = n
            else:
                at.append(i)
                times.append(n)
        at, times = np.array(at, dtype=np.int64), np.array(times, dtype=np.int64)
        # a word that no other text has is strange, as the text itself may have taught it
        strange = int(times[self.total[at] <= times].sum())
        sizes = self.start[at + 1] - self.start[at]
        cell = np.repeat(self.start[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        gains = np.bincount(self.lang[cell], weights=self.gain[cell] * np.repeat(times, sizes), minlength=self.n_langs)
        return bool(text) and has_letter(text, counts), sum(counts.values()), strange, gains.tolist(), rest


def _counted(parts: DataFrame) -> DataFrame:
    """Of each entry its count in all and by language."""
    counts = parts.groupBy("entry", "lang").agg(F.sum("n").alias("n"))
    return counts.groupBy("entry").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("counts"))


def _cells(langs: list[str], counts: Column) -> Column:
    """What the counts add to the log frequency of half a count, by the language's number."""
    order = F.array(*map(F.lit, langs)) if langs else F.array().cast("array<string>")
    return F.transform(counts, lambda c: F.struct(
        (F.array_position(order, c["lang"]) - 1).cast("int").alias("lang"), F.log(2 * c["n"] + 1).alias("gain")
    ))


def _send(by_lang: dict[str, Counter]):
    for lang, counts in by_lang.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array([lang] * len(counts), pa.string()),
             pa.array(list(counts.values()), pa.int64())],
            names=["entry", "lang", "n"],
        )


def _counting(add):
    """A task's function that counts entries by language over all its batches, and sends some on when they get many."""

    def count(batches):
        by_lang: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                add(by_lang, *row)
                if sum(map(len, by_lang.values())) > HELD:
                    yield from _send(by_lang)
                    by_lang = defaultdict(Counter)
        yield from _send(by_lang)

    return count


def _add_words(by_lang, text: str, lang: str) -> None:
    by_lang[lang].update(words_of(text))


def _add_grams(by_lang, word: str, lang: str, n: int) -> None:
    own = by_lang[lang]
    for size in range(1, LONGEST + 1):
        for g in grams(word, size):
            own[g] += n


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", known_words: int = 200_000) -> Model:
    """Count words and n-grams of all labelled rows; all counts are written as tables.

    The most frequent ``known_words`` are handed to tasks, all others are joined; their
    number changes the time only. Rows with a null language or text teach nothing; a very
    long text is counted whole, repeated rows count again. Other columns do not matter.
    Without a labelled row nothing is taught.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    schema = "entry string, lang string, n bigint"
    taught = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    taught = taught.where("text IS NOT NULL AND lang IS NOT NULL")
    words = written(_counted(taught.mapInArrow(_counting(_add_words), schema)), new_dir(spark, "words"))
    each = words.select("entry", F.inline("counts").alias("lang", "n"))
    totals = {r[0]: r[1] for r in each.groupBy("lang").agg(F.sum("n")).collect()}
    # neighbours share their first letters, and with them n-grams
    spread = each.repartitionByRange(2 * spark.sparkContext.defaultParallelism, "entry")
    found = written(_counted(spread.mapInArrow(_counting(_add_grams), schema)), new_dir(spark, "grams"))
    langs = sorted(totals)
    gains = lambda df: df.select("entry", "total", _cells(langs, F.col("counts")).alias("cells"))
    words, found = gains(words), gains(found)
    top = most_frequent(words, "total", known_words)
    frequent = top.select("entry", "total", F.col("cells.lang").alias("langs"), F.col("cells.gain").alias("gains")).toArrow()
    return Model(totals, words, found, list(zip(*(c.to_pylist() for c in frequent.columns))))


def _backed_off(model: Model, words: DataFrame) -> DataFrame:
    """``word, size, cells`` of words that have a known n-gram: those of the longest such size, in the mean."""
    spark, out = words.sparkSession, None
    words = written(words, new_dir(spark, "unseen"))
    for size in range(LONGEST, 0, -1):
        def cut(batches, size=size):
            for batch in batches:
                rows = [(w, g, c) for w in batch.column("word").to_pylist() for g, c in Counter(grams(w, size)).items()]
                columns = zip((0, 1, 2), (pa.string(), pa.string(), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in columns], names=["word", "entry", "times"])

        table = model.grams.where(F.char_length("entry") == size).select("entry", "cells")
        met = words.mapInArrow(cut, "word string, entry string, times bigint").join(table, "entry")
        # every known n-gram has a language at least; the number of n-grams rides along as language -1
        each = met.select("word", "times", F.inline(F.concat("cells", F.array(F.struct(F.lit(-1).alias("lang"), F.lit(1.0).alias("gain"))))))
        sums = each.groupBy("word", "lang").agg(F.sum(F.col("gain") * F.col("times")).alias("gain"))
        whole = sums.groupBy("word").agg(
            F.max(F.when(F.col("lang") < 0, F.col("gain"))).alias("n"), F.collect_list(F.struct("lang", "gain")).alias("cells")
        )
        mean = F.transform(F.filter("cells", lambda c: c["lang"] >= 0), lambda c: F.struct(
            c["lang"].alias("lang"), (c["gain"] / F.col("n")).alias("gain")
        ))
        found = written(whole.select("word", F.lit(size).alias("size"), mean.alias("cells")), new_dir(spark, f"grams{size}"))
        out = found if out is None else out.unionByName(found)
        if size > 1:
            words = written(words.join(found.select("word"), "word", "left_anti"), new_dir(spark, "unseen"))
    return out


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``given`` (a struct of the ``keep`` columns, all if not named), ``lang_pred, score, familiar`` of every row.

    ``lang_pred`` and ``score`` are as in ``identify``. ``familiar`` is the share of the text's words that other
    texts have taught, or that are unseen but share an n-gram of four letters or more with taught ones; it does
    not grow with the length of the text. A text without words, or a model without languages, has 0.
    """
    spark, n = docs.sparkSession, len(model.langs)
    lean_batches(spark)
    given = F.struct(*(docs.columns if keep is None else keep)).alias("given")
    if not n:
        return docs.select(given, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("familiar"))
    shared = spark.sparkContext.broadcast(model.frequent)
    kept: dict = {}

    @F.pandas_udf("letter boolean, n bigint, strange bigint, gains array<double>, rest array<string>, times array<bigint>")
    def read(texts: pd.Series) -> pd.DataFrame:
        if "it" not in kept:
            kept["it"] = Reader(shared.value, n)
        rows = [kept["it"].read(t) for t in texts.tolist()]
        return pd.DataFrame({
            "letter": [r[0] for r in rows], "n": [r[1] for r in rows], "strange": [r[2] for r in rows], "gains": [r[3] for r in rows],
            "rest": [list(r[4]) for r in rows], "times": [list(r[4].values()) for r in rows],
        })

    rows = docs.select(given, read(F.col(text_col)).alias("p")).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, new_dir(spark, "read"))
    rest = rows.select("row", F.inline(F.arrays_zip(F.col("p.rest").alias("word"), F.col("p.times").alias("times"))))
    met = rest.join(model.words.withColumnRenamed("entry", "word"), "word", "left")
    met = written(
        met.select("row", "times", "cells", (F.col("total") <= F.col("times")).alias("strange"), F.when(F.col("total").isNull(), F.col("word")).alias("word")),
        new_dir(spark, "met"),
    )
    unseen = met.where("word IS NOT NULL").select("row", "times", "word")
    back = written(_backed_off(model, unseen.select("word").distinct()), new_dir(spark, "back"))
    later = unseen.join(small_side(back), "word", "left").select("row", "times", "cells", (F.coalesce("size", F.lit(0)) < FAMILIAR).alias("strange"))
    every = met.where("word IS NULL").drop("word").unionByName(later)
    mark = lambda at, hit: F.when(hit, F.array(F.struct(F.lit(at).alias("lang"), F.lit(1.0).alias("gain"))))
    none = F.array().cast(CELLS)
    cells = F.concat(*[
        F.coalesce(x, none) for x in (F.col("cells"), mark(STRANGE, F.col("strange")), mark(UNSCORED, F.col("cells").isNull()))
    ])
    sums = every.select("row", "times", F.inline(cells)).groupBy("row", "lang").agg(F.sum(F.col("gain") * F.col("times")).alias("gain"))
    sums = sums.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("lang", "gain"))).alias("more"))
    more = lambda at: F.coalesce(F.try_element_at("more", F.lit(at)), F.lit(0.0))
    scored = F.col("p.n") - more(UNSCORED)
    found = rows.join(sums, "row", "left").withColumn("s", F.array(*[
        scored * F.lit(float(b)) + F.col("p.gains")[i] + more(i) + F.lit(float(p)) for i, (b, p) in enumerate(zip(model.base, model.prior))
    ])).withColumn("m", F.array_max("s"))
    odds = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("m")))
    best = F.element_at(F.array(*map(F.lit, model.langs)), F.array_position("s", F.col("m")).cast("int"))
    letter = F.col("p.letter")
    familiar = F.when(F.col("p.n") > 0, 1 - (F.col("p.strange") + more(STRANGE)) / F.col("p.n"))
    return found.select(
        "given", F.when(letter, best).otherwise(UNKNOWN).alias("lang_pred"), F.when(letter, 1 / odds).otherwise(0.0).alias("score"),
        F.coalesce(familiar, F.lit(0.0)).alias("familiar"),
    )


def predicted(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``predict`` with the given columns in its place; given ones of the names lang_pred, score, familiar are left out."""
    out = predict(docs, model, text_col, keep)
    names = [c for c in (docs.columns if keep is None else keep) if c not in out.columns[1:]]
    return out.select(*[F.col("given")[c].alias(c) for c in names], *out.columns[1:])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score, familiar`` of every row, from its text alone.

    The score is the share of the language's likelihood, 0 to 1. A text that is null
    or has no letter is ``und`` with score 0, and so is everything if nothing was taught.
    Without any known n-gram the most taught language wins; ties go to the first
    language by name. Rows are told apart by themselves, so ids may repeat or be null;
    extra columns are left out, and an empty table stays empty.
    """
    return predicted(docs, model, text_col, [id_col])
