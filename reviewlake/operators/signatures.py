"""Signatures of events by keyed hashes (HMAC-SHA256), from column expressions.

A key is hashed to its two pads once; every event then costs two hashes a key that is
valid at its time. Keys are rows of a table, so that no secret stands in a query's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the keyed hash: block size in bytes, and what its two pads are mixed with.
BLOCK, INNER, OUTER = 64, 0x36, 0x5C
MAX_KEYS = 1000
SIGNED_FIELDS = ["id", "event_type", "repo_name", "commit_sha", "rule_id", "ts"]
PREFIX = "sha256="


def pad(key: Column, byte: int) -> Column:
    """The key's bytes (its hash, if it is longer than a block) filled up with zeros, each mixed with ``byte``."""
    short = F.when(F.length(key) > BLOCK, F.unhex(F.sha2(key, 256))).otherwise(key)
    digits = F.rpad(F.hex(short), 2 * BLOCK, "0")

    def mixed(i: Column) -> Column:
        value = F.conv(F.substr(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint")
        return F.lpad(F.hex(value.bitwiseXOR(F.lit(byte).cast("bigint"))), 2, "0")

    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), mixed), ""))


def keyed_hash(inner: Column, outer: Column, message: Column) -> Column:
    """The HMAC in hexadecimal, from the key's pads and a binary message."""
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def hmac_sha256(key: Column, message: Column) -> Column:
    return keyed_hash(pad(key, INNER), pad(key, OUTER), message)


def canonical(columns: list[Column]) -> Column:
    """The bytes that are signed: each value as its length and its text, so that none can run into the next.

    A null is a lone sign; a time counts in microseconds.
    """
    parts = []
    for text in columns:
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts).cast("binary")


def message_of(events: DataFrame, fields: list[str] = SIGNED_FIELDS) -> Column:
    kinds = dict(events.dtypes)
    return canonical([
        F.unix_micros(F.col(c).cast("timestamp")).cast("string") if kinds[c].startswith("timestamp") else F.col(c).cast("string")
        for c in fields
    ])


def _ring(keys: DataFrame) -> Column:
    """All keys with their pads as one array, by id."""
    if keys.limit(MAX_KEYS + 1).count() > MAX_KEYS:
        raise ValueError(f"more than {MAX_KEYS} keys")
    padded = keys.select(
        "key_id", F.col("valid_from").cast("timestamp").alias("valid_from"), F.col("valid_to").cast("timestamp").alias("valid_to"),
        pad(F.col("key"), INNER).alias("inner"), pad(F.col("key"), OUTER).alias("outer"),
    )
    return padded.agg(F.array_sort(F.collect_list(F.struct("key_id", "valid_from", "valid_to", "inner", "outer")))).scalar()


def sign(events: DataFrame, keys: DataFrame, *, fields: list[str] = SIGNED_FIELDS, key_id: str = "key_id", out: str = "signature") -> DataFrame:
    """Add the signature by the key that the row names; null where there is no such key."""
    rows = events.withColumns({"_ring": _ring(keys), "_message": message_of(events, fields)})
    own = F.get(F.filter("_ring", lambda k: k["key_id"] == F.col(key_id)), F.lit(0))
    value = F.concat(F.lit(PREFIX), keyed_hash(own["inner"], own["outer"], F.col("_message")))
    return rows.withColumn(out, value).drop("_ring", "_message")


def check_signatures(
    events: DataFrame, keys: DataFrame, *, fields: list[str] = SIGNED_FIELDS, signature: str = "signature", time: str = "ts"
) -> DataFrame:
    """Add ``signature_status`` (valid, forged or unsigned) and the ``signed_by`` of valid rows.

    ``keys`` has key_id, key (bytes), valid_from and valid_to (exclusive; null: open), up
    to 1000 of them; several may be valid at once, as while keys are changed. A signature
    by a key that is not valid at the row's time is forged. It may stand in either case,
    with or without its prefix; a null or empty one is none.
    """
    rows = events.withColumns({"_ring": _ring(keys), "_message": message_of(events, fields)})
    given = F.regexp_replace(F.lower(F.trim(F.col(signature))), f"^{PREFIX}", "")
    at = F.col(time).cast("timestamp")
    valid = lambda k: (k["valid_from"].isNull() | (k["valid_from"] <= at)) & (k["valid_to"].isNull() | (at < k["valid_to"]))
    fits = F.filter("_ring", lambda k: valid(k) & (keyed_hash(k["inner"], k["outer"], F.col("_message")) == F.col("_given")))
    rows = rows.withColumn("_given", F.coalesce(given, F.lit("")))
    rows = rows.withColumn("signed_by", F.when(F.col("_given") != "", F.get(fits, F.lit(0))["key_id"]))
    status = F.when(F.col("_given") == "", "unsigned").when(F.col("signed_by").isNotNull(), "valid").otherwise("forged")
    return rows.withColumn("signature_status", status).drop("_ring", "_message", "_given")


def split_signed(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events to be trusted, all others): only the first may move weights."""
    ok = F.col("signature_status") == "valid"
    return checked.where(ok).drop("signature_status"), checked.where(~ok)
