"""WARC records in ZIP packages: written by tasks, read back by ranges.

A package holds ``archive/data.warc.gz`` (stored, every record a gzip member of its
own), ``indexes/index.cdxj`` (a line a record with its offset and length) and
``datapackage.json``. Reading starts at the package's central directory, takes the
index, cuts the records into ranges of a few megabytes, and deals the ranges out to
tasks, so that one large package is read by many. Nothing is unpacked to disk.

Packages go to the shared folder by Arrow's file systems (local or mounted paths,
``file:``, ``hdfs:``, ``s3:``, ``gs:``). A task names its packages anew at each
attempt; only those of attempts that ended well are in the manifest.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.work import new_dir, written
from . import zipdir
from .base import utf8
from .groups import of_group
from .ranged import Ranged, located

# Names in a package, and the profile of records that repeat a payload.
ARCHIVE, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = b"\r\n"
NULL_ID = "~"  # the name of a null id; the sign is written %7E in others

MANIFEST = "package string, records bigint, bytes bigint"
RECORD = (
    "package string, offset bigint, length bigint, record_id string, record_type string, target_uri string, "
    "payload binary, payload_bytes bigint, payload_digest string, refers_to string, error string"
)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def name_of(row_id: str | None, number: int) -> str:
    """The record's URI, from the row's id and a number that no other row has."""
    text = NULL_ID if row_id is None else quote(row_id, safe="").replace("~", "%7E")
    return f"urn:row:{text}:{number}"


def _header(value: str) -> bytes:
    """A header's value: one line of ASCII, whatever the text holds; other signs are percent-encoded."""
    return quote(value, safe="!#$%&'()*+,-./:;<=>?@[]_~").encode()


def record(name: str, url: str, date: str, payload: bytes | None, digest: str, size: int, refers: tuple[str, str] | None) -> bytes:
    """A response with its payload or, with ``refers`` (record, URL), a revisit without one."""
    block = BREAK.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % size, b"", b""])
    head = [
        b"WARC/1.1", b"WARC-Type: " + (b"revisit" if refers else b"response"),
        b"WARC-Record-ID: <" + name.encode() + b">", b"WARC-Date: " + date.encode(),
        b"WARC-Target-URI: " + _header(url), b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"Content-Type: application/http; msgtype=response",
    ]
    if refers:
        head += [
            b"WARC-Profile: " + REVISIT.encode(), b"WARC-Refers-To: <" + refers[0].encode() + b">",
            b"WARC-Refers-To-Target-URI: " + _header(refers[1]),
        ]
    else:
        block += payload
    head += [b"Content-Length: %d" % len(block), b"", b""]
    return BREAK.join(head) + block + BREAK * 2


class Package:
    """A package that is being written, front to back."""

    def __init__(self, path: str):
        system, at = located(path)
        self.path, self.out = path, system.open_output_stream(at)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.archive = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.at, self.index = 0, []

    def add(self, raw: bytes, **about) -> None:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = pack.compress(raw) + pack.flush()
        self.archive.write(member)
        self.index.append(about | {"offset": self.at, "length": len(member), "filename": ARCHIVE.rpartition("/")[2]})
        self.at += len(member)

    def close(self, date: str) -> tuple[str, int, int]:
        self.archive.close()
        stamp = "".join(c for c in date if c.isdigit())
        entries = sorted((x["url"], stamp, json.dumps(x, ensure_ascii=True)) for x in self.index)
        with self.zip.open(zipfile.ZipInfo(INDEX), "w") as out:
            for url, *rest in entries:
                out.write((" ".join([quote(url, safe=""), *rest]) + "\n").encode())
        about = {"profile": "data-package", "resources": [{"path": p} for p in (ARCHIVE, INDEX)], "records": len(self.index)}
        self.zip.writestr(ABOUT, json.dumps(about))
        self.zip.close()
        size = self.out.tell()
        self.out.close()
        return self.path, len(self.index), size


def first_of_payload(narrow: DataFrame) -> DataFrame:
    """Of each payload (``sha1, bytes``) its number of rows and the first of them by id, nulls last."""
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag", "url")).alias("first")
    return narrow.groupBy("sha1", "bytes").agg(F.count(F.lit(1)).alias("n"), first)


def write(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_bytes: int = 0,
    date: str = "2000-01-01T00:00:00Z",
    package_records: int = 20_000,
    package_bytes: int = 1 << 28,
) -> DataFrame:
    """Write a record for every row into packages in ``folder``; the manifest of the packages.

    The payload is the column's text in UTF-8, or its bytes; null is empty. Of rows with
    equal payloads of at least ``least_bytes`` the one with the smallest id (nulls last; of
    rows that repeat an id any one) is the response, the others revisit it; below that size
    all are responses. Payloads are equal if their SHA-1 and length are. Only one payload of each kind is shuffled, and the copies meet in map
    tasks first. A null URL counts as empty. Extra columns are left out; an empty table
    makes no package.
    """
    spark = pages.sparkSession
    payload = utf8(F.col(payload_col))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "bytes": F.length("payload").cast("bigint")})
    narrow = written(
        rows.select("id", "url", "sha1", "bytes", F.monotonically_increasing_id().alias("tag")), new_dir(spark, "narrow")
    )
    kinds = written(first_of_payload(narrow.where(F.col("bytes") >= least_bytes)), new_dir(spark, "kinds"))
    bodies = rows.where(F.col("bytes") >= least_bytes).groupBy("sha1", "bytes").agg(F.any_value("payload").alias("payload"))
    none = F.lit(None)
    f = F.col("first")
    shape = lambda df, **columns: df.select(*[c.alias(k) for k, c in columns.items()])
    responses = shape(
        bodies.join(kinds, ["sha1", "bytes"]), id=f["id"].cast("string"), url=f["url"], payload=F.col("payload"),
        tag=f["tag"], bytes=F.col("bytes"), of_id=none.cast("string"), of_tag=none.cast("bigint"), of_url=none.cast("string"),
    )
    met = of_group(narrow.where(F.col("bytes") >= least_bytes), kinds, ["sha1", "bytes"], "n")
    revisits = shape(
        met.where(F.col("tag") != f["tag"]), id=F.col("id").cast("string"), url=F.col("url"),
        payload=F.unhex("sha1"), tag=F.col("tag"), bytes=F.col("bytes"), of_id=f["id"].cast("string"), of_tag=f["tag"], of_url=f["url"],
    )
    every = responses.unionByName(revisits)
    if least_bytes > 0:
        small = rows.where(F.col("bytes") < least_bytes)
        every = every.unionByName(shape(
            small, id=F.col("id").cast("string"), url=F.col("url"), payload=F.col("payload"),
            tag=-F.monotonically_increasing_id() - 1, bytes=F.col("bytes"), of_id=none.cast("string"), of_tag=none.cast("bigint"),
            of_url=none.cast("string"),
        ))
    system, at = located(folder)
    system.create_dir(at, recursive=True)

    def save(batches):
        package, attempt, n, taken = None, uuid.uuid4().hex, 0, 0
        for batch in batches:
            done = []
            for row in zip(*(batch.column(c) for c in ("id", "url", "payload", "tag", "bytes", "of_id", "of_tag", "of_url"))):
                row_id, url, body, tag, size, of_id, of_tag, of_url = (x.as_py() for x in row)
                if package is None:
                    package, n, taken = Package(f"{folder}/part-{attempt}-{n}.wacz"), n + 1, 0
                # a revisit brings the digest of its payload, a response the payload
                again = of_tag is not None
                digest = base64.b32encode(body).decode() if again else digest_of(body)
                name = name_of(row_id, tag)
                package.add(
                    record(name, url, date, body, digest, size, (name_of(of_id, of_tag), of_url) if again else None),
                    url=url, digest=f"sha1:{digest}", record=name,
                )
                taken += 0 if again else size
                if len(package.index) >= package_records or taken >= package_bytes:
                    done.append(package.close(date))
                    package = None
            if done:
                yield _batch(done, ("package", "records", "bytes"))
        if package:
            yield _batch([package.close(date)], ("package", "records", "bytes"))

    return written(every.mapInArrow(save, MANIFEST), new_dir(spark, "manifest"))


def _batch(rows: list[tuple], names: tuple, kinds: dict | None = None) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, (kinds or {}).get(k)) for k, c in zip(names, columns)], names=list(names))


def gzip_members(f: Ranged, start: int, n: int) -> Iterator[tuple[int, int]]:
    """Offset and length of each gzip member of a range, where there is no index."""
    at, end = start, start + n
    while at < end:
        unpack, used = zlib.decompressobj(31), 0
        while not unpack.eof:
            raw = f.read(at + used, min(zipdir.STEP, end - at - used))
            if not raw:
                raise ValueError("the last record is cut off")
            used += len(raw)
            while raw and not unpack.eof:
                unpack.decompress(raw, zipdir.STEP)
                raw = unpack.unconsumed_tail
        used -= len(unpack.unused_data)
        yield at - start, used
        at += used


def entries(f: Ranged) -> Iterator[tuple[int, int]]:
    """Where each record of a package starts, and its length, from its indexes.

    Archives that no index names are searched for the starts of their records.
    """
    found = list(zipdir.members(f))
    archives = {m.name.rpartition("/")[2]: m for m in found if m.name.startswith("archive/") and m.size}
    for name, m in archives.items():
        if m.method != zipdir.STORED or m.encrypted:
            raise ValueError(f"{m.name}: not stored, its records cannot be read by ranges")
    base = {name: zipdir.data_at(f, m) for name, m in archives.items()}
    named = set()
    for index in found:
        if index.name.startswith("indexes/") and index.name.endswith((".cdxj", ".cdx")):
            for line in zipdir.lines(f, index):
                at = line.find(b"{")
                if at < 0:
                    continue
                entry = json.loads(line[at:])
                start, n, name = int(entry["offset"]), int(entry["length"]), entry["filename"]
                if name not in archives or start < 0 or n <= 0 or start + n > archives[name].size:
                    raise ValueError(f"{index.name}: an entry outside of its archive")
                named.add(name)
                yield base[name] + start, n
    for name in sorted(set(archives) - named):
        for start, n in gzip_members(f, base[name], archives[name].size):
            yield base[name] + start, n


def ranges(places: Iterator[tuple[int, int]], most_bytes: int, most: int, gap: int = 1 << 16) -> Iterator[list[tuple[int, int]]]:
    """Neighbouring records together, up to a size; of an index's entries 100,000 are sorted at a time."""
    def cut(some: list[tuple[int, int]]):
        now: list[tuple[int, int]] = []
        for start, n in sorted(some):
            if now and (len(now) == most or start + n - now[0][0] > most_bytes or start - sum(now[-1]) > gap):
                yield now
                now = []
            now.append((start, n))
        if now:
            yield now

    some = []
    for place in places:
        some.append(place)
        if len(some) == 100_000:
            yield from cut(some)
            some = []
    yield from cut(some)


def parse(member: bytes, payload: bool = True) -> dict:
    """What a record says; a response's payload is checked against its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(BREAK * 2)
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    if len(block) < int(fields["content-length"]):
        raise ValueError("the record's block is cut off")
    body, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, _, body = block.partition(BREAK * 2)
        size = len(body)
        for line in http.split(BREAK)[1:]:
            key, _, value = line.partition(b":")
            if key.strip().lower() == b"content-length":
                size = int(value)
    kind = fields["warc-type"]
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    digest = said if kind == "revisit" else digest_of(body)
    wrong = kind == "response" and (size != len(body) or said not in (None, digest))
    return {
        "record_id": fields["warc-record-id"].strip("<>"), "record_type": kind,
        "target_uri": fields.get("warc-target-uri", ""),
        "payload": body if payload and kind != "revisit" else None, "payload_bytes": size, "payload_digest": digest,
        "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
        "error": "the payload is not that of its digest" if wrong else None,
    }


def read(packages: DataFrame, payload: bool = True, range_bytes: int = 4 << 20, range_records: int = 512) -> DataFrame:
    """Every record of the packages whose paths are in the column ``package``.

    Returns package, offset, length (of the record in the package), record_id,
    record_type, target_uri, payload (null for revisits, and without ``payload``),
    payload_bytes, payload_digest, refers_to (a record's id), error. A package that
    is missing, cut off or no ZIP gives one row that has its path and error only; so
    does a record that cannot be read, with its place. Null paths are left out.
    """
    names = [c.split()[0] for c in RECORD.split(", ")]
    kinds = {c.split()[0]: {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in RECORD.split(", ")}

    def locate(batches):
        for batch in batches:
            for path in batch.column("package").to_pylist():
                try:
                    with Ranged(path) as f:
                        for some in ranges(entries(f), range_bytes, range_records):
                            yield _places([(path, [s for s, _ in some], [n for _, n in some], None)])
                except (OSError, ValueError, KeyError, TypeError, zlib.error) as e:
                    yield _places([(path, [], [], f"{type(e).__name__}: {e}")])

    def _places(rows):
        many = pa.list_(pa.int64())
        return _batch(rows, ("package", "starts", "lengths", "error"), {"starts": many, "lengths": many, "error": pa.string()})

    def fetch(batches):
        for batch in batches:
            for row in batch.to_pylist():
                path, starts, lengths = row["package"], row["starts"], row["lengths"]
                if row["error"] is not None:
                    yield _batch([tuple({"package": path, "error": row["error"]}.get(c) for c in names)], names, kinds)
                    continue
                out = []
                with Ranged(path) as f:
                    first = starts[0]
                    raw = f.read(first, starts[-1] + lengths[-1] - first)
                for start, n in zip(starts, lengths):
                    place = {"package": path, "offset": start, "length": n}
                    try:
                        place |= parse(raw[start - first: start - first + n], payload)
                    except (ValueError, KeyError, zlib.error) as e:
                        place["error"] = f"{type(e).__name__}: {e}"
                    out.append(tuple(place.get(c) for c in names))
                yield _batch(out, names, kinds)

    spark = packages.sparkSession
    paths = packages.where(F.col("package").isNotNull()).select("package")
    found = paths.repartition(_tasks(spark), F.xxhash64("package")).mapInArrow(
        locate, "package string, starts array<bigint>, lengths array<bigint>, error string"
    )
    return found.repartition(_tasks(spark)).mapInArrow(fetch, RECORD)


def _tasks(spark) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def round_trip(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Write the rows' records, read the packages back, and tell what was read of each row.

    Returns id, payload_bytes, payload_digest, record_type, refers_to (the id of the row
    whose response a revisit names). A record that cannot be read is an error.
    """
    folder = new_dir(pages.sparkSession, "packages")
    found = read(write(pages, folder, id_col, **options), payload=False)
    kind = pages.schema[id_col].dataType.simpleString()
    checked = F.when(F.col("error").isNull(), F.col("record_id")).otherwise(
        F.raise_error(F.concat_ws(": ", "package", "error")).cast("string")
    )
    return found.select(
        _row_id(checked).cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type",
        _row_id(F.col("refers_to")).cast(kind).alias("refers_to"),
    )


def _row_id(name: Column) -> Column:
    """The row's id in ``name_of`` a record."""
    text = F.split(name, ":")[2]
    return F.when(text != NULL_ID, F.url_decode(text))
