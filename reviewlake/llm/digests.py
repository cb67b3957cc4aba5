"""URL filter over a sorted digest array.

Entries are strings with a value. Their 64-bit xxhash keys are sorted into one
flat file beside the strings themselves; tasks map the file into memory, probe
whole batches by binary search, and compare the stored string before they
believe a hit, so that two strings with one key cannot be mistaken.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import ship, shipped_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pack(entries: dict[bytes, int]) -> bytes:
    """The file: entry count, then keys, values, string ends and strings, by key."""
    keyed = sorted((xxhash.xxh64_intdigest(s), s, v) for s, v in entries.items())
    keys = np.array([k for k, _, _ in keyed], dtype="<u8")
    values = np.array([v for _, _, v in keyed], dtype="<i8")
    ends = np.cumsum([len(s) for _, s, _ in keyed], dtype="<i8")
    head = np.array([len(keyed)], dtype="<i8")
    return b"".join([x.tobytes() for x in (head, keys, values, ends)] + [s for _, s, _ in keyed])


class DigestArray:
    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r").view(np.ndarray)
        n = int(raw[:8].view("<i8")[0])
        self.keys, self.values, self.ends = (
            raw[8 + 8 * n * i: 8 + 8 * n * (i + 1)].view(kind) for i, kind in enumerate(("<u8", "<i8", "<i8"))
        )
        self.strings = raw[8 + 24 * n:]

    def string(self, at: int) -> bytes:
        start = int(self.ends[at - 1]) if at else 0
        return self.strings[start: int(self.ends[at])].tobytes()

    def find(self, wanted: list[bytes], hash_of=xxhash.xxh64_intdigest) -> np.ndarray:
        """The place of each string, -1 where it is not stored."""
        keys = np.fromiter(map(hash_of, wanted), dtype=np.uint64, count=len(wanted))
        at = np.searchsorted(self.keys, keys)
        out = np.full(len(wanted), -1, dtype=np.int64)
        inside = at < len(self.keys)
        hits = np.flatnonzero(inside)[self.keys[at[inside]] == keys[inside]]
        for i in hits.tolist():
            place = int(at[i])
            while place < len(self.keys) and self.keys[place] == keys[i]:
                if self.string(place) == wanted[i]:
                    out[i] = place
                    break
                place += 1
        return out


@lru_cache(maxsize=4)
def _opened(name: str) -> DigestArray:
    return DigestArray(shipped_path(name))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Verdict on every URL: that of the longest rule that fits, else ``default``.

    A rule is a host, then a path that starts with ``/``. It fits its host and all
    subdomains where the URL's path starts with the rule's. The rules are a list a
    caller holds; their number, not that of the pages, bounds the file that is
    shipped. Returns id, host, path, rule, verdict, one row for each given row. A
    null, empty or odd URL gets no rule; no rules, no hits.
    """
    spark = pages.sparkSession
    texts, verdicts = [r for r, _ in rules], [v for _, v in rules]
    if len(dict(rules)) != len(set(rules)):
        raise ValueError("one rule has two verdicts")
    entries = {r.encode(): i for i, r in enumerate(texts)}
    name = ship(spark, "rules", pack(entries))
    # only suffixes of as many labels, and prefixes as long, as some rule has can be one
    shapes = sorted({(r.partition("/")[0].count(".") + 1, len(r) - r.index("/")) for r in texts})

    def probe(batches):
        known = _opened(name)
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            best = np.full(len(hosts), -1, dtype=np.int64)
            length = np.zeros(len(hosts), dtype=np.int64)
            for labels, chars in shapes:
                rows, wanted = [], []
                for i, (host, path) in enumerate(zip(hosts, paths)):
                    parts = host.rsplit(".", labels)[-labels:]
                    if len(path) >= chars and len(parts) == labels:
                        rows.append(i)
                        wanted.append((".".join(parts) + path[:chars]).encode())
                at = known.find(wanted)
                for i, place, text in zip(rows, at.tolist(), wanted):
                    if place >= 0 and len(text.decode()) > length[i]:
                        best[i], length[i] = known.values[place], len(text.decode())
            rule = [texts[b] if b >= 0 else None for b in best.tolist()]
            verdict = [verdicts[b] if b >= 0 else default for b in best.tolist()]
            columns = [batch.column("id"), batch.column("host"), batch.column("path")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=["id", "host", "path", "rule", "verdict"],
            )

    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(probe, f"id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)
