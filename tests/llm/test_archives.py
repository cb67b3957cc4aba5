"""WARC packages: the directory reader against zipfile's packages, and whole round trips."""

import base64
import hashlib
import io
import os
import random
import zipfile

import pytest

from reviewlake.llm import warc, zipdir
from reviewlake.llm.ranged import Ranged


def made(tmp_path, build, name="a.zip"):
    path = str(tmp_path / name)
    with zipfile.ZipFile(path, "w") as z:
        build(z)
    return path


@pytest.mark.parametrize("wide", [False, True])
def test_directory_equals_zipfile(tmp_path, monkeypatch, wide):
    if wide:  # the library then writes 64-bit fields and end records into small packages too
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3)
    rng = random.Random(3)
    content = {f"folder/ä{i}.bin": rng.randbytes(rng.randrange(300)) for i in range(40)} | {"empty": b""}

    def build(z):
        for i, (name, data) in enumerate(content.items()):
            z.writestr(name, data, zipfile.ZIP_DEFLATED if i % 3 == 0 else zipfile.ZIP_STORED)
        z.comment = b"a comment with a mark PK\x05\x06 in it"

    path = made(tmp_path, build)
    with Ranged(path) as f:
        found = list(zipdir.members(f))
        assert [m.name for m in found] == list(content)
        for m in found:
            assert b"".join(zipdir.chunks(f, m)) == content[m.name]
            assert m.size == len(content[m.name])
            if m.method == zipdir.STORED:
                assert f.read(zipdir.data_at(f, m), m.packed) == content[m.name]


def test_broken_packages_are_errors(tmp_path):
    path = made(tmp_path, lambda z: z.writestr("x", b"y" * 1000))
    raw = open(path, "rb").read()
    for name, data in (("cut", raw[:-5]), ("empty", b""), ("text", b"no package" * 50), ("mark", raw.replace(b"PK\x01\x02", b"PK\x01\x03"))):
        (tmp_path / name).write_bytes(data)
        with Ranged(str(tmp_path / name)) as f, pytest.raises(ValueError):
            list(zipdir.members(f))


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(8)
    rows = [(i, f"http://h{i % 7}.org/ä {i}?q=%41", "".join(rng.choice("<pé>\n ab") for _ in range(rng.randrange(400)))) for i in range(300)]
    rows += [(1000 + i, "http://hot.org/", "the same page") for i in range(250)]
    rows += [(500 - i, None, "the same page, too") for i in range(5)]
    rows += [(2000, "u", None), (2001, "u", ""), (2002, "u", "x" * 3_000_000), (None, "u", "null id"), (None, None, "null id")]
    rows += [(3000, "u", "repeated row")] * 3 + [(2999, "v", "repeated row")] + [(None, "u", "the same page")]
    return rows, spark.createDataFrame(
        [(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, tag string, payload int"
    )


def expected(rows, least=0):
    """Of each row what is read, the response of repeated rows being any one of them."""
    first = {}
    for i, _, html in rows:
        body = (html or "").encode()
        first[body] = min([first[body], i] if body in first else [i], key=lambda x: (x is None, x))
    out, used = [], set()
    for i, _, html in rows:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        response = len(body) < least or (i == first[body] and body not in used)
        if response and len(body) >= least:
            used.add(body)
        out.append((i, len(body), digest, "response" if response else "revisit", None if response else first[body]))
    return out


@pytest.mark.parametrize("least", [0, 13, 10**9])
def test_round_trip(pages, least):
    rows, df = pages
    got = [tuple(r) for r in warc.round_trip(df, least_bytes=least, package_records=90).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(expected(rows, least), key=key)


def test_records_come_back_whole(spark, pages, tmp_path):
    rows, df = pages
    manifest = warc.write(df, str(tmp_path / "packages"), package_records=100)
    got = warc.read(manifest).collect()
    assert len(got) == len(rows) == sum(r.records for r in manifest.collect())
    assert {r.error for r in got} == {None}
    assert sorted(r.payload.decode() for r in got if r.record_type == "response") == sorted({h or "" for _, _, h in rows})
    assert all(r.payload is None for r in got if r.record_type == "revisit")
    names = {r.record_id for r in got}
    assert len(names) == len(rows) and {r.refers_to for r in got} - {None} <= names
    one = next(r for r in manifest.collect() if r.records > 50)
    assert os.path.getsize(one.package) == one.bytes
    with zipfile.ZipFile(one.package) as z:
        assert z.testzip() is None and z.getinfo(warc.ARCHIVE).compress_type == zipfile.ZIP_STORED
        assert len(z.read(warc.INDEX).splitlines()) == one.records


def test_archives_without_index_and_broken_ones(spark, tmp_path):
    record = lambda i: warc.record(f"urn:row:{i}:{i}", "u", "2000-01-01T00:00:00Z", b"body %d" % i, warc.digest_of(b"body %d" % i), 6, None)
    out = io.BytesIO()
    import gzip

    for i in range(5):
        out.write(gzip.compress(record(i)))
    bare = made(tmp_path, lambda z: z.writestr("archive/x.warc.gz", out.getvalue()), "bare.wacz")
    packed = made(tmp_path, lambda z: z.writestr("archive/x.warc.gz", out.getvalue(), zipfile.ZIP_DEFLATED), "packed.wacz")
    wrong = gzip.compress(record(1).replace(b"body 1", b"BODY 1"))
    bad = made(tmp_path, lambda z: z.writestr("archive/x.warc.gz", gzip.compress(record(0)) + wrong + gzip.compress(b"no record")), "bad.wacz")
    paths = [bare, packed, bad, str(tmp_path / "missing.wacz"), None]
    got = warc.read(spark.createDataFrame([(p,) for p in paths], "package string")).collect()
    of = lambda p: sorted((r for r in got if r.package == p), key=lambda r: r.offset or 0)
    assert [r.payload for r in of(bare)] == [b"body %d" % i for i in range(5)]
    assert len(of(packed)) == 1 and "not stored" in of(packed)[0].error
    assert [r.error is None for r in of(bad)] == [True, False, False]
    assert len(of(paths[3])) == 1 and of(paths[3])[0].error
    assert len(got) == 10


def test_empty_table(spark, pages):
    assert warc.round_trip(pages[1].limit(0)).collect() == []
