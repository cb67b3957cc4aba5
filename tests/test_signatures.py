"""Keyed hashes against published test vectors, and the check of signed events."""

import datetime as dt
import hashlib
import hmac

from pyspark.sql import functions as F

from reviewlake.operators import signatures as sg

# Key, message and HMAC-SHA256 of the test cases 1-4, 6 and 7 of RFC 4231.
VECTORS = [
    (b"\x0b" * 20, b"Hi There", "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"),
    (b"Jefe", b"what do ya want for nothing?", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
    (b"\xaa" * 20, b"\xdd" * 50, "773ea91e36800e46854db8ebd09181a72959098b3ef8c122d9635514ced565fe"),
    (bytes(range(1, 26)), b"\xcd" * 50, "82558a389a443c0ea4cc819899f2083a85f0faa3e578f8077a2e3ff46729665b"),
    (b"\xaa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First", "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"),
    (b"\xaa" * 131, b"This is a test using a larger than block-size key and a larger than block-size data. The key needs to be hashed before being used by the HMAC algorithm.", "9b09ffa71b942fcb27635fbcd5b0e944bfdc63644f0713938a7f51535c3a35e2"),
]


def test_published_vectors(spark):
    df = spark.createDataFrame([(bytearray(k), bytearray(m)) for k, m, _ in VECTORS], "k binary, m binary")
    got = [r[0] for r in df.select(sg.hmac_sha256(F.col("k"), F.col("m"))).collect()]
    assert got == [v for _, _, v in VECTORS]


def test_any_key_length(spark):
    keys = [b"", b"\x00", b"\xff" * 63, b"\x01" * 64, b"\x80" * 65, bytes(range(256))]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "k binary")
    got = [r[0] for r in df.select(sg.hmac_sha256(F.col("k"), F.lit(b"x" * 200))).collect()]
    assert got == [hmac.new(k, b"x" * 200, hashlib.sha256).hexdigest() for k in keys]


DAY = dt.datetime(2024, 1, 1)
SCHEMA = "id string, event_type string, repo_name string, commit_sha string, rule_id string, ts timestamp, signature string"


def signed(key, *fields):
    parts = []
    for f in fields:
        text = None if f is None else str(round(f.timestamp() * 1_000_000)) if isinstance(f, dt.datetime) else f
        parts.append("-" if text is None else f"{len(text.encode())}:{text}")
    return hmac.new(key, "".join(parts).encode(), hashlib.sha256).hexdigest()


def test_statuses(spark):
    keys = spark.createDataFrame(
        [("old", bytearray(b"a"), None, DAY + dt.timedelta(2)), ("new", bytearray(b"b" * 100), DAY + dt.timedelta(1), None), ("twin", bytearray(b"a"), None, None)],
        "key_id string, key binary, valid_from timestamp, valid_to timestamp",
    )
    rows, want = [], {}

    def add(name, key, day, status, by=None, change=None, form="{}"):
        row = [name, "T", "répo", None, "1:R", DAY + dt.timedelta(day)]
        mac = None if key is None else form.format(signed(key, *(change or row)))
        rows.append((*row, mac))
        want[name] = (status, by)

    add("a", b"a", 0, "valid", "old", form="sha256={}")
    add("b", b"a", 3, "valid", "twin")
    add("c", b"b" * 100, 0, "forged")
    add("d", b"b" * 100, 1, "valid", "new", form="  SHA256={} ")
    add("e", None, 1, "unsigned")
    add("f", b"zz", 1, "forged")
    add("g", b"a", 1, "forged", change=["g", "T", "répo", "", "1:R", DAY + dt.timedelta(1)])
    add("h", b"a", 1, "forged", change=["h", "T", "répo", None, "1:", "R", DAY + dt.timedelta(1)])
    df = spark.createDataFrame(rows, SCHEMA)
    checked = sg.check_signatures(df, keys)
    assert {r.id: (r.signature_status, r.signed_by) for r in checked.collect()} == want
    good, bad = sg.split_signed(checked)
    assert {r.id for r in good.collect()} == {"a", "b", "d"} and bad.count() == 5
    none = sg.check_signatures(df, keys.limit(0))
    assert {r.signature_status for r in none.collect()} == {"forged", "unsigned"}
    assert sg.check_signatures(df.limit(0), keys).collect() == []


def test_secrets_stay_out_of_the_plan(spark, capsys):
    keys = spark.createDataFrame([("k", bytearray(b"very secret"), None, None)], "key_id string, key binary, valid_from timestamp, valid_to timestamp")
    keys.write.mode("overwrite").parquet(path := "/tmp/reviewlake-test-keys")
    df = spark.createDataFrame([], SCHEMA)
    sg.check_signatures(df, spark.read.parquet(path)).explain(True)
    assert b"very secret".hex() not in capsys.readouterr().out.lower()
