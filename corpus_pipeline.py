"""From raw documents to token ids: five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import bpe, chosen_path, langid, mixing, quality
from reviewlake.llm.base import small_side
from reviewlake.plans.work import new_dir, written

KEEP = 0.5  # least probability of good quality, and of the best language
FAMILIAR = 0.25  # least share of words that other texts have taught, or that resemble taught ones


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the weak-label model finds bad.

    A null text counts as an empty one, which is bad. Every row is judged by its own whole
    text, so ids may be null or repeat and equal rows go or stay together. All columns come
    back; an empty table stays empty.
    """
    score = quality.scored(quality.fit(docs), spark)
    return docs.where(score(F.col("text"))["score"] >= KEEP)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter, those whose language stays in doubt, and those that resemble no taught text.

    Rows with a null language teach nothing and are judged like others; where no row has
    one nothing can be told and all rows go. The probability of a long text is near one
    whatever it holds, so the share of familiar words decides as well, at any length. All
    columns come back, whatever their names; ids may be null or repeat.
    """
    found = langid.predict(docs, langid.fit(docs))
    return found.where((F.col("score") >= KEEP) & (F.col("familiar") >= FAMILIAR)).select("given.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of texts that share 0.8 of their 5-word shingles.

    It is the row of the smallest id, nulls last. Texts without words stay.
    """
    return chosen_path.deduplicate(docs, k=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix does; a document taken twice is two rows.

    Rows are told apart by a tag, so those of one id, or of none, are taken each as often
    as the mix says. A text without words is never taken. All columns come back, whatever
    their names; an empty table stays empty.
    """
    tagged = written(docs.select(F.struct("*").alias("given"), F.monotonically_increasing_id().alias("tag")), new_dir(spark, "tagged"))
    slim = tagged.select(*[F.col(f"given.`{c}`").alias(c) for c in ("doc_id", "text", "source")], "tag")
    taken = mixing.mix(slim, tag_col="tag").where("copies > 0").select("tag", "copies")
    taken = small_side(written(taken, new_dir(spark, "taken")))
    rows = tagged.join(taken, "tag")
    return rows.select("given", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("given.*")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their decoding, and digests of both.

    A null text counts as an empty one, without ids; other columns than the id are left out.
    """
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language id", language_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("mixing sources", mixing_stage),
    ("bpe encoding and decoding", encoding_stage),
]

# Trained models, signatures and merges have no SQL form: tests hold each stage
# against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), new_dir(spark, "stage"))
    return STAGES[-1][1](spark, docs, sf_dir)
