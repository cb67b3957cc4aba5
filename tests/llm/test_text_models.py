"""Language model, language identification, quality and BPE against plain versions."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reviewlake.llm import bpe, langid, lexicon, maxent, quality

ODD = [None, "", " \t\n ", "...", "123 456", "ABC abc", "É", "ﬁ ½ x² Ⅷ", "a" * 50_000, "one two " * 20_000, "\x85\u2003x\x1cy", "日本語 テキスト"]


def is_held(i, n, k):
    return zlib.crc32(str(i).encode()) % n == k


# --- language model ------------------------------------------------------------


def test_base_scores_are_exact_and_the_model_beats_them(docs_of):
    rng = random.Random(1)
    after = {f"w{i}": [f"w{(i * 7 + j) % 60}" for j in range(3)] for i in range(60)}
    texts = []
    for _ in range(600):
        w, out = "w0", []
        for _ in range(40):
            w = rng.choice(after[w])
            out.append(w.upper() if rng.random() < 0.1 else w)
        texts.append(" ".join(out))
    rows = list(enumerate(texts + ODD + texts[:3]))
    docs = docs_of([(i, t, "en", "s") for i, t in rows])
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    c = collections.Counter(w for i, t in rows if not is_held(i, 7, 2) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in maxent.score(docs, held, frequent_words=70).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        own, r = tokens(t), got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (is_held(i, 7, 2), len(own), sum(c[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
    held_out = [got[i] for i, _ in rows[:600] if is_held(i, 7, 2)]
    assert sum(r.score for r in held_out) > 0.75 * sum(r.base_score for r in held_out)


def test_probabilities_of_all_next_words_sum_to_one(docs_of):
    docs = docs_of([(i, "a b c d " * 5 + f"x{i % 9}", "en", "s") for i in range(60)])
    probes = docs_of([(1000 + i, f"a b {w}", "en", "s") for i, w in enumerate(["a", "b", "c", "d", *[f"x{i}" for i in range(9)]])])
    both = docs.union(probes)
    got = maxent.score(both, F.col("doc_id") >= 1000, frequent_words=6).where("doc_id >= 1000").collect()
    prefix = maxent.score(docs.union(docs_of([(2000, "a b", "en", "s")])), F.col("doc_id") >= 1000, frequent_words=6)
    ended = [r.score for r in prefix.where("doc_id = 2000").collect()]
    # P(a b w) without its end is at least P(a b w end); with the end itself they stay within one
    assert sum(10 ** r.score for r in got) + 10 ** ended[0] < 1


def test_choices_in_a_class_sum_to_one_and_start_from_the_counts():
    rng = np.random.default_rng(7)
    frequent = [(f"w{i}ab".encode(), 900 - i) for i in range(300)]
    rest = [5, 1, 700, 1, 1, 1, 30, 1]
    _, _, classes, tree = maxent.word_table(frequent, rest)
    shares = np.array([c + 1 for _, c in frequent] + rest, dtype=float)
    whole = np.bincount(classes, weights=shares)[classes]
    leaves, rows = np.arange(308), np.repeat(rng.integers(1, maxent.BUCKETS, size=(3, 1)), 308, axis=1)
    weights = rng.normal(size=maxent.BUCKETS * maxent.SLOTS).astype(np.float32)
    plain = maxent.leaf_logs(tree, 0 * weights, leaves, rows)
    assert np.allclose(plain, np.log10(shares / whole), atol=1e-5)
    moved = maxent.leaf_logs(tree, weights, leaves, rows)
    assert np.allclose(np.bincount(classes, weights=10**moved), 1, atol=1e-5) and not np.allclose(moved, plain, atol=0.1)


def test_factors_give_the_softmax_also_for_large_weights():
    rng = np.random.default_rng(8)
    rows, classes = rng.integers(1, maxent.BUCKETS, size=(3, 500)), rng.integers(0, maxent.CLASSES, size=500)
    for scale in (0.5, 60):
        weights = rng.normal(scale=scale, size=(maxent.BUCKETS, maxent.CLASSES)).astype(np.float32)
        score = (weights[rows].sum(axis=0) + weights[0]).astype(float)
        plain = score[np.arange(500), classes] - np.log(np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1)) - score.max(axis=1)
        got = maxent.class_logs(weights, maxent.powers(weights), rows, classes)
        assert np.allclose(got, np.maximum(plain / np.log(10), -30), atol=1e-3)


def test_history_tells_words_of_one_class_apart(docs_of):
    rng = random.Random(4)
    # 56 frequent words are classes of their own; nine and ten share one, and each has its own word before
    common = [f"f{i}" for i in range(60)]
    texts = [" ".join([*rng.sample(common, 45), *rng.choice([("left", "ninexy"), ("right", "tenxy")])]) for _ in range(3000)]
    probes = ["left ninexy", "right tenxy", "left tenxy", "right ninexy"]
    docs = docs_of([(i, t, "en", "s") for i, t in enumerate(texts + probes)])
    got = {r.doc_id - 3000: r.score for r in maxent.score(docs, F.col("doc_id") >= 3000).where("doc_id >= 3000").collect()}
    assert got[0] + got[1] > got[2] + got[3] + 1.5


def test_group_sums_equal_plain_sums():
    rng = np.random.default_rng(5)
    values = rng.normal(size=(900, 7))
    row = np.concatenate([rng.integers(0, 60, size=500), np.full(300, 3), rng.integers(100, 900, size=100)])
    order = np.argsort(row, kind="stable")
    where, first = np.unique(row[order], return_index=True)
    got = maxent.group_sums(values, order, first)
    for w, g in zip(where.tolist(), got):
        assert np.allclose(g, values[row == w].sum(axis=0))


def test_language_model_of_nothing(docs_of):
    assert maxent.score(docs_of([]), F.lit(False)).count() == 0
    r = maxent.score(docs_of([(1, "a b", "en", "s"), (None, None, None, None)]), F.lit(True)).orderBy(F.desc("n_tokens")).collect()
    assert [(x.n_tokens, x.n_known, x.train_tokens, x.base_score) for x in r] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]


# --- language identification -----------------------------------------------------


def test_languages_are_told_apart_and_odd_texts_are_und(docs_of):
    rng = random.Random(2)
    parts = {"en": ["th", "er", "ing", "ou", "wh"], "de": ["sch", "ung", "ei", "ß", "ü"], "es": ["ción", "ñ", "llo", "que", "os"]}
    word = lambda x: "".join(rng.choice(parts[x]) for _ in range(rng.randrange(1, 5)))
    rows = [(i, " ".join(word(x) for _ in range(12)), x, "s") for i, x in enumerate(rng.choices(sorted(parts), k=400))]
    rows += [(1000 + i, t, None, None) for i, t in enumerate(ODD)] + [(2000, None, "en", "s")]
    docs = docs_of(rows)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = langid.fit(docs.where(~held), known_words=50)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert len(got) == len(rows)
    out = [(got[i].lang_pred, x) for i, _, x, _ in rows[:400] if is_held(i, 5, 0)]
    assert sum(a == b for a, b in out) >= 0.98 * len(out) > 50
    for i, t in enumerate(ODD):
        r = got[1000 + i]
        if t is None or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in parts and 0 < r.score <= 1


def plain_language(rows, texts):
    """Prediction, score and familiar share of each text, word by word, with all counts in memory."""
    counts = {"w": collections.defaultdict(collections.Counter), "g": collections.defaultdict(collections.Counter)}
    totals: collections.Counter = collections.Counter()
    for t, x in rows:
        for w in langid.words_of(t):
            totals[x] += 1
            counts["w"][w][x] += 1
            for n in range(1, 6):
                for g in langid.grams(w, n):
                    counts["g"][g][x] += 1
    langs = sorted(totals)
    logs = lambda c: np.array([math.log((c[x] + 0.5) / totals[x]) for x in langs])
    prior = np.array([math.log((totals[x] + 1) / (sum(totals.values()) + len(langs))) for x in langs])
    out = []
    for t in texts:
        score, familiar, words = prior.copy(), 0, collections.Counter(langid.words_of(t))
        for w, n in words.items():
            if w in counts["w"]:
                score += n * logs(counts["w"][w])
                familiar += n * (sum(counts["w"][w].values()) > n)
                continue
            for size in range(5, 0, -1):
                found = [logs(counts["g"][g]) for g in langid.grams(w, size) if g in counts["g"]]
                if found:
                    score += n * np.mean(found, axis=0)
                    familiar += n * (size >= 4)
                    break
        odds = np.exp(score - score.max())
        out.append((langs[score.argmax()], odds.max() / odds.sum(), familiar / max(1, sum(words.values()))))
    return out


def test_unseen_words_fall_back_to_shorter_grams(docs_of):
    docs = docs_of([(1, "known unknowable", "a", "s"), (2, "known shown zip", "b", "s"), (3, "zap", None, "s"), (4, "qqq", None, "s"), (5, "shownow", None, "s")])
    got = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert got[5].lang_pred == "b" and got[5].familiar == 1.0  # its four- and five-grams
    assert got[3].lang_pred == "b" and got[3].familiar == 0.0  # its " z"
    assert got[4].lang_pred == "b" and got[4].familiar == 0.0  # nothing known: the most taught language
    assert got[1].familiar == 0.5  # of its two words one has been taught by another text


@pytest.mark.parametrize("known", [0, 4, 10**6])
def test_every_taught_word_and_gram_counts_however_few_are_handed_to_tasks(docs_of, monkeypatch, known):
    rng = random.Random(8)
    monkeypatch.setattr(langid, "HELD", 20)
    parts = {"en": ["th", "er", "ing"], "xx": ["er", "sch", "ung", "ing"]}
    word = lambda x: "".join(rng.choice(parts[x]) for _ in range(rng.randrange(1, 5)))
    rows = [(i, " ".join(word(x) for _ in range(12)), x, "s") for i, x in enumerate(rng.choices(["en", "xx"], weights=[9, 1], k=200))]
    texts = [" ".join(word(rng.choice("en xx".split())) + rng.choice(["", "", "q"]) for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    texts += ["zzz", "qqq erq erq", "日本語 thing", "sch " * 50]
    model = langid.fit(docs_of(rows), known_words=known)
    got = {r.doc_id: r for r in langid.identify(docs_of([(i, t, None, "s") for i, t in enumerate(texts)]), model).collect()}
    for i, (lang, score, familiar) in enumerate(plain_language([(t, x) for _, t, x, _ in rows], texts)):
        assert (got[i].lang_pred, got[i].score, got[i].familiar) == (lang, pytest.approx(score, rel=1e-9), pytest.approx(familiar)), texts[i]


def test_language_without_teaching(docs_of):
    docs = docs_of([(1, "hello", None, None)])
    assert [tuple(r) for r in langid.identify(docs, langid.fit(docs)).collect()] == [(1, "und", 0.0, 0.0)]
    assert langid.identify(docs_of([]), langid.fit(docs_of([]))).count() == 0


# --- quality -------------------------------------------------------------------


def quality_rows(rng):
    word = lambda: "".join(rng.choice(["ther", "ing", "an", "so", "mel", "ti"]) for _ in range(rng.randrange(1, 4)))
    prose = lambda n: " ".join(word() + rng.choice(["", "", "", ",", "."]) for _ in range(n)).capitalize()
    good = [prose(rng.randrange(3, 300)) for _ in range(300)]
    bad = [" ".join([word()] * rng.randrange(30, 200)) for _ in range(25)]
    bad += [" ".join(word() + rng.choice(["&&&", "%%%", "***"]) for _ in range(60)) for _ in range(25)]
    bad += [" | ".join(word() for _ in range(60)) for _ in range(25)]
    return good, bad


def test_weak_labels_find_the_bad_and_leave_the_good(docs_of):
    good, bad = quality_rows(random.Random(3))
    rows = list(enumerate(good + bad + ODD))
    docs = docs_of([(i, t, "en", "s") for i, t in rows])
    got = {r.doc_id: r for r in quality.classify(docs, quality.fit(docs)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept for i in range(len(good)))
    assert sum(not got[i].kept for i in range(len(good), len(good) + len(bad))) >= 0.95 * len(bad)


def test_estimate_matches_plain_expectation_maximisation():
    rng = random.Random(4)
    rows = []
    for _ in range(2000):
        y = rng.random() < 0.8
        rows.append([quality.GOOD if rng.random() < (0.9 if y else 0.5) else quality.BAD if not y and rng.random() < 0.7 else quality.NONE for _ in quality.LABELLERS])
    counts = collections.Counter(map(quality.pattern, rows))
    got = quality.estimate(dict(counts))
    # the same, row by row
    n = len(rows)
    p = [0.05 if quality.BAD in r else 0.95 if quality.GOOD in r else 0.7 for r in rows]
    for _ in range(100):
        good = sum(p)
        rate = {}
        for j in range(len(quality.LABELLERS)):
            for c, base in ((0, (0.3, 0.7)), (1, (0.002, 0.998))):
                w = [x if c else 1 - x for x in p]
                b = 0.2 * n * base[0] + sum(x for x, r in zip(w, rows) if r[j] == quality.BAD)
                g = 0.2 * n * base[1] + sum(x for x, r in zip(w, rows) if r[j] == quality.GOOD)
                rate[c, j, quality.BAD], rate[c, j, quality.GOOD] = b / (b + g), g / (b + g)
        new = []
        for r in rows:
            s = [(n - good + 1) / (n + 2), (good + 1) / (n + 2)]
            for c in (0, 1):
                for j, v in enumerate(r):
                    s[c] *= rate.get((c, j, v), 1)
            new.append(s[1] / (s[0] + s[1]))
        if max(abs(a - b) for a, b in zip(p, new)) < 1e-9:
            break
        p = new
    for r, x in zip(rows, p):
        assert got[quality.pattern(r)] == pytest.approx(x, abs=1e-6)


def test_quality_of_nothing(docs_of):
    empty = docs_of([])
    assert quality.classify(empty, quality.fit(empty)).count() == 0


# --- BPE -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("word_bpe_49k.json")


def test_encoding_is_the_librarys(docs_of, path):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCÉéßüñΣσçあ漢é0189½²'’.,!?&%<>|/\\ \t\n\x85\xa0\u2003\x00\x1c"
    texts = ODD + ["<|endoftext|>", "x<|endoftext|>y <|startoftext|>Z", "<|ENDOFTEXT|>", "it's we'LL ΟΔΟΣ İstanbul", "e\u0301a\u0308"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(300)]
    texts += ["".join(rng.choice("aeintshr") for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    library = Tokenizer.from_file(path)
    docs = docs_of([(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in bpe.encode(docs, path, lexicon_size=200).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        r = got[i]
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), text), repr(t)[:80]
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_encoding_of_nothing(docs_of, path):
    assert bpe.encode(docs_of([]), path).count() == 0


def test_lexicon_numbers_words_and_shares_suffixes(tmp_path):
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))).encode() for _ in range(2000)})
    outputs = [w[::-1] + b"!" for w in words]
    order = list(range(len(words)))
    rng.shuffle(order)
    data = lexicon.build([words[i] for i in order], [outputs[i] for i in order])
    (tmp_path / "x").write_bytes(data)
    known = lexicon.Lexicon(str(tmp_path / "x"))
    others = [b"", b"zzz", b"abcdabcdabcd", words[5] + b"q", words[9][:-1] + b"\xff"]
    assert known.numbers(words + others).tolist() == list(range(len(words))) + [-1] * len(others)
    assert [known.output(i) for i in range(len(words))] == outputs
    assert known.numbers([]).tolist() == []
    tails = lexicon.build([b"xsuffix", b"ysuffix"], [b"1", b"2"])
    assert int(np.frombuffer(tails[8:16], dtype="<i8")[0]) == 8  # the root, and one state for each letter of the shared ending and its end
    (tmp_path / "y").write_bytes(lexicon.build([], []))
    assert lexicon.Lexicon(str(tmp_path / "y")).numbers([b"a"]).tolist() == [-1]


def test_weight_changes_leave_tasks_in_small_pieces(monkeypatch):
    sent = []
    monkeypatch.setattr(maxent, "_as_lines", lambda *a, f=maxent._as_lines: sent.append(f(*a)) or sent[-1])
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.permutation(maxent.BUCKETS)[:n]) for n in (5000, 9000, maxent.BUCKETS)]
    met = [rng.integers(1, 50, len(r)) for r in rows]
    change = [rng.normal(size=(len(r), maxent.CLASSES + maxent.SLOTS)).astype(np.float32) for r in rows]
    lines = [maxent._as_lines(*x).slice(3) for x in zip(rows, met, change)] + [maxent._as_lines(rows[0][:0], met[0][:0], change[0][:0])]
    sent.clear()
    got = list(maxent.averages(iter(lines)))
    assert got == sent and max(b.num_rows for b in got) <= maxent.SENT
    total, times = np.zeros((maxent.BUCKETS, maxent.CLASSES + maxent.SLOTS)), np.zeros(maxent.BUCKETS, dtype=np.int64)
    for r, m, c in zip(rows, met, change):
        total[r[3:]] += c[3:] * m[3:, None].astype(float)
        times[r[3:]] += m[3:]
    at = np.concatenate([b.column("row").to_numpy() for b in got])
    assert at.tolist() == np.flatnonzero(times).tolist()
    assert np.concatenate([b.column("met").to_numpy() for b in got]).tolist() == times[at].tolist()
    mean = np.concatenate([maxent._changes(b.column("change"), np.float64) for b in got])
    assert np.allclose(mean, total[at] / times[at, None])
