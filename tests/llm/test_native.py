"""Mixing, sharding, fingerprints and URL rules against plain versions."""

import collections
import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from reviewlake.llm import digests, mixing, order_minhash, shards
from reviewlake.llm.queries import URL_RULES
from reviewlake.llm.running import running


def words(text):
    return len((text or "").encode().split())


def sample_texts(rng, n):
    return [" ".join(f"w{rng.randrange(50)}" for _ in range(int(rng.paretovariate(1.1) * 4) % 400)) for _ in range(n)]


# --- running sums ----------------------------------------------------------------


def test_running_sums_cross_blocks_and_partitions(spark):
    df = spark.range(20_000).select(
        (F.col("id") % 3).alias("k"), F.pmod(F.xxhash64("id"), F.lit(10_000)).alias("o"), "id", (F.col("id") % 7).alias("v")
    )
    got = running(df, ["k"], ["o", "id"], {"before": "v"}).collect()
    total = collections.defaultdict(int)
    for r in sorted(got, key=lambda r: (r.k, r.o, r.id)):
        assert r.before == total[r.k]
        total[r.k] += r.v
    assert len(got) == 20_000


# --- mixing ----------------------------------------------------------------------


def targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = total - sum(full.values())
        open_ = {s: w for s, w in weight.items() if s not in full}
        share = {s: w * rest / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return {s: float(x) for s, x in (share | full).items()}
        full |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("n", [1, 40, 3000])
def test_mix_meets_its_targets(docs_of, n):
    rng = random.Random(n)
    names = ["a", "B", "é", "zz", "tiny", "", None]
    rows = [(i, t, "en", rng.choices(names, [9, 2, 2, 1, 0.2, 1, 1])[0]) for i, t in enumerate(sample_texts(rng, n))]
    rows += [(n + 1, None, "en", "a"), (n + 2, " \t", "en", None), (n + 3, "x " * 500, "en", "tiny")]
    got = mixing.mix(docs_of(rows)).collect()
    sizes, biggest = collections.Counter(), collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += words(t)
        biggest[s] = max(biggest[s], words(t))
    want, taken = targets(sizes), collections.Counter()
    assert len(got) == len(rows)
    by_id = {i: (words(t), s) for i, t, _, s in rows}
    for r in got:
        size, source = by_id[r.doc_id]
        assert (r.size, r.source_size) == (size, sizes[source])
        assert r.target == pytest.approx(want[source], rel=1e-12)
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 3 * size
        taken[source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest[s] / 2 + 1e-6
    again = mixing.mix(docs_of(rows[::-1])).collect()
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in again}


def test_longer_documents_are_likelier_and_sampling_follows_the_odds(docs_of):
    rows = [(i, "w " * (3 if i % 2 else 300), "en", s) for i in range(4000) for s in ("a" if i % 4 < 2 else "b",)]
    got = mixing.mix(docs_of(rows), weights=(1, 3)).collect()
    mean = lambda long: sum(r.copies for r in got if r.source == "a" and (r.size > 100) == long) / 1000
    # expected copies are in proportion to the bits of the size, 9 and 2
    assert mean(True) / mean(False) == pytest.approx(4.5, rel=0.25)


def test_mix_of_nothing_and_of_repeated_rows(docs_of):
    assert mixing.mix(docs_of([])).count() == 0
    got = mixing.mix(docs_of([(1, "a b", None, None)] * 4 + [(None, None, None, None)])).collect()
    assert sorted((r.size, r.source_size, r.taken) for r in got) == [(0, 8, 0)] + [(2, 8, 2)] * 4


# --- shards ----------------------------------------------------------------------


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * shards.MULTIPLIER + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_are_those_of_the_published_method(docs_of, spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 123456789, *range(50), *[random.Random(1).getrandbits(63) for _ in range(200)]]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for n in (1, 2, 16, 17, 100):
        got = df.select("k", shards.jump_hash(F.col("k"), n).alias("s")).collect()
        assert all(r.s == jump(r.k, n) for r in got)


def test_slots_have_no_gap_and_growth_moves_into_the_new_shard(docs_of):
    rng = random.Random(9)
    rows = [(rng.randrange(10**12), t, "en", "s") for t in sample_texts(rng, 1500)]
    rows += [(None, None, None, None), (5, None, None, None), (5, "é", None, None), rows[0], rows[0], (6, "x" * 300_000, None, None)]
    got = shards.shard_documents(docs_of(rows), 16).collect()
    assert len(got) == len(rows)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.shard == jump(r.doc_id or 0, 16)
        assert r.grown_shard in (r.shard, 16) and r.grown_shard == jump(r.doc_id or 0, 17)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sums = collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got)
    assert sums == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert shards.shard_documents(docs_of([]), 16).count() == 0


# --- fingerprints ----------------------------------------------------------------


def test_edited_texts_and_neighbours(docs_of):
    rng = random.Random(10)
    texts = sample_texts(rng, 120) + ["", None, "ü" * 7, "one", "日本 語", "a b " * 40_000, "x" * 100_000] + ["same text again"] * 5
    ids = rng.sample(range(10**6), len(texts))
    got = {r.doc_id: r for r in order_minhash.fingerprints(docs_of([(i, t, "en", "s") for i, t in zip(ids, texts)])).collect()}
    rows = sorted((i, t or "") for i, t in zip(ids, texts))
    assert len(got) == len(rows)
    for at, (i, t) in enumerate(rows):
        following = rows[(at + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.fingerprint == got[rows[(at + 1) % len(rows)][0]].fingerprint) == (r.near_next == 1) or t != following
    assert len({got[i].fingerprint for i, t in rows if t == "same text again"}) == 1


def plain_fingerprint(spark, text):
    """The same classes and choices from the same hashes, by a loop over rows."""
    units = [w for w in text.split(" ") if w] or [""]
    rows = [(i, units[i], units[i + 1] if i + 1 < len(units) else None) for i in range(len(units))]
    df = spark.createDataFrame(rows, "i int, a string, b string").select("i", F.xxhash64("a", "b").alias("h"))
    cut = [(r.i, r.h & (1 << 31) - 1) for r in df.collect()]
    seen, numbered = collections.Counter(), []
    for i, h in sorted(cut):
        numbered.append((i, h, seen[h]))
        seen[h] += 1
    df = spark.createDataFrame(numbered, "i int, h bigint, o int").select("i", F.xxhash64("h", "o").alias("v"))
    bins = collections.defaultdict(list)
    for r in df.collect():
        v = r.v % 2**64
        bins[v & 127].append((v >> 40, r.i))
    out = []
    for b, entries in sorted(bins.items()):
        chosen = sorted(sorted(entries)[:2], key=lambda x: x[1])
        out.append((b, [(b << 24) | rank for rank, _ in chosen]))
    return out


def test_fingerprint_keeps_text_order(docs_of, spark):
    rng = random.Random(11)
    text = " ".join(f"w{rng.randrange(40)}" for _ in range(300))
    got = order_minhash.fingerprint(spark.createDataFrame([(text,)], "t string"), "t", "f").first().f
    want = plain_fingerprint(spark, text)
    flat = spark.createDataFrame([(b, *(c + [None])[:2]) for b, c in want], "b int, x bigint, y bigint")
    hashed = flat.select("b", F.xxhash64("x", "y").alias("h")).collect()
    assert sorted(got) == sorted((r.b << 16) | (r.h & 0xFFFF) for r in hashed)


def test_texts_without_blanks_have_units(spark):
    text = "秋天的北京非常美丽树叶变成了金黄色人们喜欢在公园里散步孩子们在草地上奔跑老人们坐在长椅上聊天天气凉爽阳光温暖而明亮"
    blob = "".join(f"{i * i:x}" for i in range(5000))
    rows = [(0, text), (1, text[:20] + "X" + text[21:]), (2, text[::-1]), (3, blob), (4, blob[:300] + "#" + blob[301:])]
    f = {r.i: r.f for r in order_minhash.fingerprint(spark.createDataFrame(rows, "i int, t string"), "t", "f").collect()}
    pairs = spark.createDataFrame([(a, b, f[a], f[b]) for a, b in ((0, 1), (0, 2), (3, 4))], "i int, j int, a array<int>, b array<int>")
    near = {(r.i, r.j): r.s for r in pairs.select("i", "j", order_minhash.likeness(F.col("a"), F.col("b")).alias("s")).collect()}
    assert near[0, 1] > 0.6 and near[0, 2] < 0.2 and near[3, 4] > 0.9
    got = spark.createDataFrame([("a " + "x" * 50 + " 中b", ), ("",), (" \n",)], "t string").select(order_minhash.units(F.col("t"))).collect()
    assert [r[0] for r in got] == [["a", "x" * 24, "x" * 24, "xx", "中", "b"], [""], [""]]


def test_likeness_falls_with_edits_and_sees_order(docs_of, spark):
    rng = random.Random(12)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    few, many = list(base), list(base)
    for i in rng.sample(range(400), 8):
        few[i] = "changed"
    for i in rng.sample(range(400), 120):
        many[i] = "changed"
    turned = base[200:] + base[:200]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([base, few, many, turned, base])], "i int, t string")
    f = {r.i: r.f for r in order_minhash.fingerprint(df, "t", "f").collect()}
    pairs = spark.createDataFrame([(i, f[0], f[i]) for i in f], "i int, a array<int>, b array<int>")
    near = {r.i: r.s for r in pairs.select("i", order_minhash.likeness(F.col("a"), F.col("b")).alias("s")).collect()}
    assert near[0] == near[4] == 1
    assert 0.75 < near[1] < 1 and near[2] < 0.5 < near[1]
    assert near[3] < 0.8  # the same k-mers in another order


def test_fingerprints_of_few_rows(docs_of):
    assert order_minhash.fingerprints(docs_of([])).count() == 0
    r = order_minhash.fingerprints(docs_of([(7, "ab cd", None, None)])).first()
    assert r.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest()  # its own successor
    got = order_minhash.fingerprints(docs_of([(None, "x", None, None), (None, None, None, None), (1, "y", None, None), (1, "y", None, None)])).collect()
    assert len(got) == 4


# --- URLs ------------------------------------------------------------------------


def judged(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = []
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), rule, verdict))
    _, rule, verdict = max(fits, default=(0, None, default))
    return host, path, rule, verdict


def test_rules_fit_hosts_subdomains_and_paths(spark):
    rng = random.Random(13)
    hosts = ["net", "a.net", "example.net", "x.example.NET", "badexample.net", "example.com", "m.example.com", "org", "q.org", "org.uk", "", ".net", "é.Net", "a..net"]
    paths = ["", "/", "/en/", "/en", "/en/x/y", "/de/1?x=/en/", "#/fr/", "?/de/", "/fr/#a", "/FR/", "/de/é", "/fr/\nx"]
    urls = [f"{s}{h}{p}" for s in ("http://", "://", "x://y://") for h in hosts for p in paths]
    urls += [None, "", "no scheme", "http:/net/", "http://", "http://" + "a." * 3000 + "net/" + "z" * 5000]
    urls += rng.sample(urls, 20)
    df = spark.createDataFrame([(i, u, "h", "r", "v") for i, u in enumerate(urls)], "page_id bigint, url string, host string, rule string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in digests.judge(df, URL_RULES).collect()}
    assert got == {i: judged(u, URL_RULES) for i, u in enumerate(urls)}
    assert digests.judge(df.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in digests.judge(df, [], default="block").collect()} == {"block"}
    with pytest.raises(ValueError):
        digests.judge(df, [("net/", "allow"), ("net/", "block")])


def test_equal_keys_are_confirmed_by_the_stored_string(tmp_path, monkeypatch):
    monkeypatch.setattr(digests.xxhash, "xxh64_intdigest", lambda s: len(s) % 3)
    entries = {f"rule{i}".encode() * (i % 4 + 1): i for i in range(60)}
    (tmp_path / "d").write_bytes(digests.pack(entries))
    known = digests.DigestArray(str(tmp_path / "d"))
    wanted = [*entries, b"", b"rule", b"rule60"]
    at = known.find(wanted, hash_of=lambda s: len(s) % 3).tolist()
    assert [int(known.values[a]) for a in at[:60]] == list(entries.values())
    assert at[60:] == [-1] * 3
