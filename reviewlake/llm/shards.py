"""Jump consistent hashing of rows to shards, in plain column expressions.

The jump generator multiplies modulo 2**64. Spark's bigint would overflow there,
so the state is kept as two 32-bit halves and multiplied in pieces that fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.work import new_dir, written
from .running import running

# The multiplier of the published generator, cut into the pieces multiplied with.
MULTIPLIER = 2862933555777941757
_HIGH, _MID, _LOW = MULTIPLIER >> 32, (MULTIPLIER >> 16) & 0xFFFF, MULTIPLIER & 0xFFFF
_MASK = 0xFFFFFFFF


def _bits(value: Column) -> Column:
    return value.bitwiseAND(F.lit(_MASK))


def _step(state: Column) -> Column:
    """One jump: the generator moves on and names the next candidate shard."""
    high, low = state["high"], state["low"]
    a = low * _LOW + 1
    b = low * _MID
    full = a + F.shiftleft(b.bitwiseAND(F.lit(0xFFFF)), 16)
    carry = F.shiftright(full, 32) + F.shiftright(b, 16)
    new_high = _bits(
        carry + _bits(low * _HIGH) + _bits(high * _LOW)
        + F.shiftleft((high * _MID).bitwiseAND(F.lit(0xFFFF)), 16)
    )
    draw = F.shiftright(new_high, 1) + 1
    jump = ((state["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / draw.cast("double")))
    return F.struct(
        new_high.alias("high"), _bits(full).alias("low"),
        state["next"].alias("shard"), jump.cast("bigint").alias("next"),
    )


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, of an integer key; a null key counts as 0.

    A jump goes up by one shard at least, so ``shards`` steps are always enough.
    """
    key = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    start = F.struct(
        _bits(F.shiftright(key, 32)).alias("high"), _bits(key).alias("low"),
        F.lit(-1).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("next"),
    )
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(shards)), start,
        lambda state, _: F.when(state["next"] < shards, _step(state)).otherwise(state),
        lambda state: state["shard"].cast("int"),
    )


def shard_documents(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row's shard, its place in it, and its shard once one more is appended.

    Returns id, size (UTF-8 bytes + 1), text_crc32, shard, slot, grown_shard. Ids
    and the number of shards alone decide. Slots run from 0 without a gap, by id,
    then checksum and size; repeated rows are alike, so any order among them gives
    the same result. A null text has no bytes (size 1, checksum 0); a null id goes
    where 0 goes. Extra columns are left out; an empty table stays empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    # the texts are read once; what follows sorts three numbers a row
    narrow = written(narrow, new_dir(docs.sparkSession, "shards"))
    placed = narrow.select(
        "*", jump_hash(F.col("doc_id"), shards).alias("shard"),
        jump_hash(F.col("doc_id"), shards + 1).alias("grown_shard"),
        F.lit(1).cast("bigint").alias("_one"),
    )
    return running(placed, ["shard"], ["doc_id", "text_crc32", "size"], {"slot": "_one"}).drop("_one")
