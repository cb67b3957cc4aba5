"""BPE encoding and decoding of a public word-end vocabulary.

Frequent pieces of the corpus are compiled, with their ids, into the automaton
of ``lexicon``; tasks map it into memory. Every other piece is merged by rank,
so the ids are the vocabulary's own whichever way they are found. Tasks keep a
bounded memory of the pieces they have met.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections import Counter
from functools import lru_cache
from struct import unpack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.work import new_dir, written
from .base import lean_batches, most_frequent, ship, shipped_path
from .lexicon import Lexicon, build

END = "</w>"  # fixed value: the mark of a word's last symbol
REMEMBERED = 150_000  # pieces a task keeps
HELD = 250_000  # pieces that a task counts before it sends them on


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 signs stand for themselves, the others follow from 256 on.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """What the vocabulary file says: ids, merge ranks, pattern, special texts."""

    def __init__(self, content: str):
        data = json.loads(content)
        model = data["model"]
        steps = data["normalizer"]["normalizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or data["decoder"] is not None:
            raise ValueError("another kind of vocabulary")
        self.ids = model["vocab"]
        # a pair of ids, as one number, leads to its rank and the id it merges to
        self.pairs = {
            self.ids[a] << 32 | self.ids[b]: i << 32 | self.ids[a + b] for i, (a, b) in enumerate(model["merges"])
        }
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.inner = [self.ids[c] for c in byte_signs()]
        self.last = [self.ids[c + END] for c in byte_signs()]
        size = max(self.names) + 1
        self.id_bytes = [i.to_bytes(4, "little") for i in range(size)]
        self.name_bytes = [self.names.get(i, "").encode() for i in range(size)]
        # \s of the file's pattern is white space by property
        pattern = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

    def normal(self, text: str) -> str:
        """Composed and lower-cased sign by sign; white space only parts pieces, so it may stay."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def parts(self, text: str) -> list[str]:
        """The pieces of a text; special texts are pieces of their own."""
        if self.split is None or not any(s in text for s in self.special):
            return self.pieces(self.normal(text))
        out = []
        for i, part in enumerate(self.split(text)):
            if i % 2:
                out.append("\0" + part)  # no other piece has this form: see merge
            else:
                out.extend(self.pieces(self.normal(part)))
        return out

    def merge(self, piece: str) -> list[int]:
        """The ids of one piece: the leftmost pair of the lowest rank is merged until none is left."""
        if piece[:1] == "\0" and piece[1:] in self.special:
            return [self.special[piece[1:]]]
        raw = piece.encode()
        word = [self.inner[b] for b in raw[:-1]]
        word.append(self.last[raw[-1]])
        rank, none = self.pairs.get, 1 << 62
        found = [rank(a << 32 | b, none) for a, b in zip(word, word[1:])]
        while found:
            low = min(found)
            if low == none:
                break
            i = found.index(low)
            word[i: i + 2] = [low & 0xFFFFFFFF]
            del found[i]
            if i:
                found[i - 1] = rank(word[i - 1] << 32 | word[i], none)
            if i < len(found):
                found[i] = rank(word[i] << 32 | word[i + 1], none)
        return word

    def decode(self, ids: list[int]) -> str:
        """The library's decoding of a vocabulary without decoder: names with a blank between."""
        return " ".join(self.names[i] for i in ids if i in self.names)


@lru_cache(maxsize=2)
def _vocabulary(name: str) -> Vocabulary:
    with open(shipped_path(name), encoding="utf-8") as f:
        return Vocabulary(f.read())


@lru_cache(maxsize=2)
def _lexicon(name: str) -> Lexicon:
    return Lexicon(shipped_path(name))


def ids_bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class Encoder:
    """Finds pieces in the lexicon, merges the others, remembers both for a while."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.met: dict[str, tuple[bytes, bytes]] = {}

    def _learn(self, pieces: set[str]) -> None:
        if len(self.met) > REMEMBERED:
            self.met.clear()
        new = [p for p in pieces if p not in self.met]
        numbers = self.lexicon.numbers([p.encode() for p in new]).tolist() if self.lexicon else [-1] * len(new)
        v, met = self.vocabulary, self.met
        for piece, number in zip(new, numbers):
            if number >= 0:
                raw = self.lexicon.output(number)
                ids = unpack(f"<{len(raw) // 4}I", raw)
            else:
                ids = v.merge(piece)
                raw = b"".join([v.id_bytes[i] for i in ids])
            met[piece] = raw, b" ".join([v.name_bytes[i] for i in ids])

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """For each text its ids as little-endian 32-bit integers, and the decoding in UTF-8.

        Texts are taken a few at a time, so that their new pieces are looked up together.
        """
        out, parts, size = [], [], 0
        for i, text in enumerate(texts):
            parts.append(self.vocabulary.parts(text or ""))
            size += len(text or "")
            if size > 2_000_000 or i == len(texts) - 1:
                self._learn(set().union(*parts))
                met = self.met
                for pieces in parts:
                    found = [met[p] for p in pieces]
                    out.append((b"".join([f[0] for f in found]), b" ".join([f[1] for f in found])))
                parts, size = [], 0
        return out


def piece_counts(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``piece, n``: how often each piece occurs in all texts."""

    def count(batches):
        parts = _vocabulary(vocabulary).parts
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(parts(text or ""))
                if len(counts) > HELD:
                    yield send(counts)
                    counts = Counter()
        yield send(counts)

    def send(counts):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["piece", "n"]
        )

    partial = docs.select(text_col).mapInArrow(count, "piece string, n bigint")
    return partial.groupBy("piece").agg(F.sum("n").alias("n"))


def encode(
    docs: DataFrame,
    vocabulary_path: str,
    lexicon_size: int = 1 << 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = True,
) -> DataFrame:
    """Ids of every text and what they decode to.

    Returns id, n_tokens, ids (array, unless ``keep_ids`` is off), ids_sha256,
    decoded (with ``keep_ids``), decoded_sha256; a row for each given row. The
    lexicon holds up to ``lexicon_size`` most frequent pieces of all texts (the only
    rows that reach the driver); its size changes the speed only. A null text
    counts as empty: no ids, an empty decoding. Texts are encoded whole; ids may be null
    or repeat. Extra columns are left out; an empty table stays empty.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    with open(vocabulary_path, encoding="utf-8") as f:
        content = f.read()
    vocabulary = ship(spark, "vocabulary", content.encode())
    own = Vocabulary(content)
    counts = written(piece_counts(docs, vocabulary, text_col), new_dir(spark, "pieces"))
    frequent = most_frequent(counts, "n", lexicon_size).select("piece").toArrow().column(0).to_pylist()
    lexicon = ship(
        spark, "lexicon",
        build([p.encode() for p in frequent], [ids_bytes(own.merge(p)) for p in frequent]),
    )

    def run(batches):
        encoder = Encoder(_vocabulary(vocabulary), _lexicon(lexicon))
        for batch in batches:
            found = encoder.encode(batch.column("text").to_pylist())
            ids, decoded = [f[0] for f in found], [f[1] for f in found]
            sha = lambda values: pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string())
            columns = {
                "id": batch.column("id"),
                "n_tokens": pa.array([len(a) // 4 for a in ids], pa.int64()),
                "ids_sha256": sha(ids), "decoded_sha256": sha(decoded),
            }
            if keep_ids:
                ends = np.cumsum([0] + [len(a) // 4 for a in ids], dtype=np.int32)
                flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)
                columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                columns["decoded"] = pa.array([d.decode() for d in decoded], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", ids array<int>, decoded string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
