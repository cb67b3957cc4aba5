"""Order MinHash fingerprints of texts, in plain column expressions.

The units are words; signs of scripts that are written without blanks are words of
their own, and longer stretches without a blank are cut into pieces. Every k-mer of neighbouring words is numbered by its
occurrence in the text, and hashed with that number. The hashes are dealt to
``bins`` classes by some of their bits; in each class the two smallest are
selected, put back into text order, and hashed as a tuple. Equal tuples need
equal k-mers in equal order, so the share of equal tuples falls with the edits
between two texts and not only with the words they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fixed
from .base import BLANKS

POSITION, RANK, BIN = 32, 24, 7  # bits of a packed entry: bin, rank, position of the k-mer
KMER = 2
UNBROKEN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"
PIECE = 24  # signs of a piece of a stretch that is longer


def _low(value: Column, bits: int) -> Column:
    return value.bitwiseAND(F.lit((1 << bits) - 1))


def units(text: Column) -> Column:
    """The text's words; a text without one has the empty word."""
    parted = F.when(text.rlike(UNBROKEN), F.regexp_replace(text, f"({UNBROKEN})", " $1 ")).otherwise(text)
    long = f"[^{BLANKS}]{{{PIECE}}}"
    parted = F.when(parted.rlike(f"{long}[^{BLANKS}]"), F.regexp_replace(parted, f"({long})(?=[^{BLANKS}])", "$1 ")).otherwise(parted)
    return F.split(F.btrim(parted, F.lit(" \t\n\x0b\f\r")), f"[{BLANKS}]+")


def fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Replace the text column by ``name``: an array of (class, tuple hash) numbers."""
    df = fixed(df.withColumn("_u", F.col(text)).drop(text), _u=F.col("_u"))
    words = units(F.col("_u"))
    df = fixed(df.withColumn("_w", words).drop("_u"), _w=F.col("_w"))
    # the k-mer at i, and i itself; the last ones hold the end of the text
    kmer = lambda w, i: F.xxhash64(w, *[F.get("_w", i + j) for j in range(1, KMER)])
    packed = F.transform(
        "_w",
        lambda w, i: F.shiftleft(_low(kmer(w, i), 63 - POSITION), POSITION)
        .bitwiseOR(i.cast("bigint")),
    )
    df = fixed(df.withColumn("_p", F.sort_array(packed)).drop("_w"), _p=F.col("_p"))
    of = lambda x: F.shiftright(x, POSITION)
    starts = F.filter(
        F.sequence(F.lit(0), F.size("_p") - 1),
        lambda i: (i == 0) | (of(F.get("_p", i - 1)) != of(F.get("_p", i))),
    )
    df = fixed(df, _s=starts)
    # runs of one k-mer are numbered 0, 1, 2, ... in text order
    numbers = F.flatten(F.transform(
        "_s", lambda s, j: F.sequence(F.lit(0), F.coalesce(F.get("_s", j + 1), F.size("_p")) - s - 1)
    ))
    value = lambda x, o: F.xxhash64(of(x), o)
    entry = lambda x, o: (
        F.shiftleft(_low(value(x, o), BIN), RANK + POSITION)
        .bitwiseOR(F.shiftleft(F.shiftrightunsigned(value(x, o), 64 - RANK), POSITION))
        .bitwiseOR(_low(x, POSITION))
    )
    df = fixed(df.withColumn("_e", F.sort_array(F.zip_with("_p", numbers, entry))).drop("_p", "_s"), _e=F.col("_e"))
    part = lambda x: F.shiftright(x, RANK + POSITION)
    two = F.filter("_e", lambda x, i: (i < 2) | (part(F.get("_e", i - 2)) != part(x)))
    df = fixed(df.withColumn("_t", two).drop("_e"), _t=F.col("_t"))
    first = F.filter(
        F.sequence(F.lit(0), F.size("_t") - 1),
        lambda i: (i == 0) | (part(F.get("_t", i - 1)) != part(F.get("_t", i))),
    )

    def tuple_hash(i: Column) -> Column:
        a, b = F.get("_t", i), F.get("_t", i + 1)
        b = F.when(part(a) == part(b), b)
        rank = lambda x: F.shiftright(x, POSITION)
        swap = _low(b, POSITION) < _low(a, POSITION)
        ordered = F.when(swap, F.xxhash64(rank(b), rank(a))).otherwise(F.xxhash64(rank(a), rank(b)))
        return F.shiftleft(part(a), 16).bitwiseOR(_low(ordered, 16)).cast("int")

    return fixed(df.withColumn(name, F.transform(first, tuple_hash)).drop("_t"), **{name: F.col(name)})


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among the classes that either has, 0 to 1."""
    bins = lambda x: F.transform(x, lambda t: F.shiftright(t, 16))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(bins(a), bins(b)))


def _written(tuples: Column) -> Column:
    return F.array_join(F.transform(tuples, lambda t: F.lpad(F.hex(t), 6, "0")), "")


class _Blocks:
    """Cuts of the id order into as many ranges as a shuffle has partitions."""

    def __init__(self, ids: DataFrame):
        spark = ids.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranges = ids.where("doc_id IS NOT NULL").repartitionByRange(parts, "doc_id")
        ends = ranges.groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("low")).collect()
        self.lows = sorted(r[1] for r in ends)
        self.nulls = not ids.where("doc_id IS NULL").isEmpty()

    def of(self, doc_id: Column) -> Column:
        """Number of the range; ids are counted off against every 128th bound, then the 128 below."""
        kind = "array<bigint>"
        coarse = self.lows[::128]
        groups = [self.lows[i: i + 128] for i in range(0, len(self.lows), 128)] or [[]]
        nested = F.array(*[F.array(*[F.lit(x) for x in g]).cast(kind) for g in groups])
        high = F.greatest(F.size(F.filter(F.array(*[F.lit(x) for x in coarse]).cast(kind), lambda b: b <= doc_id)) - 1, F.lit(0))
        low = F.size(F.filter(F.get(nested, high), lambda b: b <= doc_id))
        return F.when(doc_id.isNull(), F.lit(len(self.lows))).otherwise(high * 128 + low - 1).cast("int")

    def head_of(self, doc_id: Column, block: Column) -> Column:
        """The block before, for rows with the first id of a block; else null."""
        last = len(self.lows) if self.nulls else len(self.lows) - 1
        before = F.when(block == 0, F.lit(last)).otherwise(block - 1)
        lows = F.array(*[F.lit(x) for x in self.lows]).cast("array<bigint>")
        return F.when(F.get(lows, block).eqNullSafe(doc_id), before)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``block, rank, tail, doc_id, text, next_text``: each document beside the next one by id.

    Texts are shuffled once, by ranges of ids. The first row of a range also goes to
    the range before, as its tail. Rows with one id follow each other by the hash of
    their text; null ids come last; after the last document the first one follows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = _Blocks(docs.select(F.col(id_col).alias("doc_id")))
    rows = rows.withColumn("_b", blocks.of(F.col("doc_id")))
    ahead = F.struct(F.col("_b").alias("block"), F.lit(0).alias("tail"))
    behind = F.struct(blocks.head_of(F.col("doc_id"), F.col("_b")).cast("int").alias("block"), F.lit(1).alias("tail"))
    rows = rows.select("doc_id", "text", F.inline(F.filter(F.array(ahead, behind), lambda x: x["block"].isNotNull())))
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    order = Window.partitionBy("block").orderBy("tail", F.col("doc_id").asc_nulls_last(), "_tie")
    return rows.select(
        "block", F.row_number().over(order).alias("rank"), "tail", "doc_id", "text",
        F.lead("text").over(order).alias("next_text"),
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last half replaced by the first half of the next document
    (by id; after the last comes the first). Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. Ids are integers; they may
    repeat or be null (see ``with_next``). A null text counts as empty; a text without
    words has one k-mer of its own; texts are read whole. Extra columns are left out; an
    empty table stays empty.
    """
    rows = with_next(docs, id_col, text_col)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left(F.coalesce("next_text", F.lit("")), half))
    rows = rows.select("block", "rank", "tail", "doc_id", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited"))
    kinds = F.inline(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")),
        F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")),
    ))
    rows = rows.select("block", "rank", "tail", "doc_id", "n_chars", kinds)
    rows = rows.withColumn("sha", F.when(F.col("kind") == 1, F.sha2("text", 256)))
    rows = fingerprint(rows, "text", "tuples")
    order = Window.partitionBy("block").orderBy("rank", "kind")
    rows = rows.select(
        "tail", "kind", "doc_id", "n_chars", "tuples", F.lead("sha", 1).over(order).alias("edited_sha256"),
        F.lead("tuples", 1).over(order).alias("edited"), F.lead("tuples", 2).over(order).alias("next"),
    ).where("tail = 0 AND kind = 0")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", _written(F.col("tuples")).alias("fingerprint"),
        _written(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("tuples"), F.col("edited")).alias("near_edited"),
        likeness(F.col("tuples"), F.col("next")).alias("near_next"),
    )
