"""The stages of the corpus pipeline against plain versions of them, and the registry."""

import collections
import random

import corpus_pipeline
import public_tokenizers
import pytest
from compare import compare, connect
from tokenizers import Tokenizer

from reviewlake.llm.catalog import ORACLES, QUERIES

STAGES = [name for name, _ in corpus_pipeline.STAGES]
STAGE = dict(corpus_pipeline.STAGES)
CALLS = {"quality": 0, "language": 1, "dedup": 2, "mix": 3, "encode": 4}


def stage(name):
    return STAGE[STAGES[CALLS[name]]]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(21)
    parts = {"en": ["ther", "ing", "an", "so", "wh"], "de": ["sch", "ung", "ei", "ver"], "es": ["cion", "que", "os", "lla"]}
    word = lambda x: "".join(rng.choice(parts[x]) for _ in range(rng.randrange(1, 4)))
    rows = []
    for _ in range(260):
        x = rng.choice(sorted(parts))
        rows.append((" ".join(word(x) for _ in range(rng.randrange(8, 120))) + ".", x))
    good = len(rows)
    rows += [(" ".join(["same"] * 80), "en"), (" | ".join(word("en") for _ in range(60)), "en")] * 6
    rows += [("", "en"), (None, None), ("12 34 56", "en")]
    copies = []
    for i in range(20):
        text = rows[i][0].split()
        if i % 2 and len(text) > 60:
            text[-1] = "changed"
        copies.append((" ".join(text), rows[i][1]))
    rows += copies
    full = [(i, t, x, rng.choice(["a", "b", "c", None])) for i, (t, x) in enumerate(rows)]
    return full, good


def test_stages_come_in_order():
    assert [n.split()[0] for n in STAGES] == ["quality", "language", "minhash", "mixing", "bpe"]


def test_filters_drop_the_bad_and_keep_the_clean(spark, docs_of, corpus):
    rows, good = corpus
    docs, given = docs_of(rows), set(range(len(rows)))
    for name in ("quality", "language"):
        kept = stage(name)(spark, docs, "")
        assert kept.columns == docs.columns
        ids = {r.doc_id for r in kept.collect()}
        assert set(range(good)) <= ids
        gone = given - ids
        if name == "quality":
            assert {i for i in range(good, good + 12)} <= gone
        else:
            assert gone == {i for i, t, _, _ in rows if i in given and not any(c.isalpha() for c in t or "")}
        docs, given = kept, ids


def test_one_document_of_each_group_stays(spark, docs_of, corpus):
    rows, _ = corpus

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t, _, _ in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = a, b
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
    kept = stage("dedup")(spark, docs_of(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in root if root[i] == i)


def test_mixed_rows_are_whole_copies(spark, docs_of, corpus):
    rows, _ = corpus
    docs = docs_of(rows)
    mixed = stage("mix")(spark, docs, "")
    assert mixed.columns == docs.columns
    counts = collections.Counter(r.doc_id for r in mixed.collect())
    from reviewlake.llm.mixing import mix

    assert counts == {r.doc_id: r.copies for r in mix(docs).collect() if r.copies}


# Names that the operators use themselves; the columns hold nothing of use to them.
CLASHES = (
    "_row _copies _n _id tag given score lang_pred familiar copies size row p s m word words times cells entry total n lang2 target "
    "_place _best component_id kept node rec signature label _text id digest"
).split()


@pytest.mark.parametrize("name", sorted(CALLS))
def test_columns_of_any_name_come_back(spark, docs_of, corpus, name):
    rows, _ = corpus
    base = spark.createDataFrame([(i, t, x, src, len(t or "")) for i, t, x, src in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = base.selectExpr("*", *[f"'{c}' AS `{c}`" for c in CLASHES])
    got = stage(name)(spark, docs, "")
    plain = stage(name)(spark, base, "")
    if name != "encode":
        assert got.columns == docs.columns
        assert {tuple(r)[5:] for r in got.collect()} == {tuple(CLASHES)}
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(got) == ids(plain) != []


def test_rows_of_one_id_are_mixed_each_for_itself(spark, docs_of):
    text = "one two three four five six"
    rows = [(7, "", "en", "a"), (7, " ", "en", "a"), (7, text, "en", "a"), (None, "", "en", "a"), (None, text + " seven", "en", "a")]
    rows += [(i, text, "en", "b") for i in range(20)] + [(3, "x " * 200_000, "en", "c"), (3, None, "en", "c")]
    taken = collections.Counter(r.text for r in stage("mix")(spark, docs_of(rows), "").collect())
    assert not {"", " ", None} & set(taken)
    assert taken["x " * 200_000] <= 3 and taken[text + " seven"] <= 3


def test_untaught_languages_and_gibberish_go(spark, docs_of, corpus):
    rows, good = corpus
    rng = random.Random(4)
    odd = {
        1000: "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και τρέχει μακριά",
        1001: " ".join("".join(rng.choice("bcdfgjkpqvxz") for _ in range(rng.randrange(3, 12))) for _ in range(60)),
        1002: "北京的秋天很美 人们在公园里散步",
    }
    docs = docs_of(rows + [(i, t, None, "a") for i, t in odd.items()])
    ids = {r.doc_id for r in stage("language")(spark, docs, "").collect()}
    assert set(range(good)) <= ids and not set(odd) & ids


CLEAN = {
    "chinese": "秋天的北京非常美丽，树叶变成了金黄色。人们喜欢在公园里散步，孩子们在草地上奔跑，老人们坐在长椅上聊天。天气凉爽，阳光温暖而明亮，是一年中最好的季节。",
    "japanese": "春になると桜の花が咲き、人々は公園に集まってお花見を楽しみます。子どもたちは走り回り、大人たちは食事をしながら話をします。日本の春はとても美しい季節です。",
    "thai": "ฤดูใบไม้ผลิเป็นช่วงเวลาที่สวยงามที่สุดของปี ผู้คนออกมาเดินเล่นในสวนสาธารณะ เด็ก ๆ วิ่งเล่นกันอย่างสนุกสนาน และดอกไม้บานสะพรั่งไปทั่วทุกแห่ง",
    "hindi": "वसंत ऋतु में मौसम बहुत सुहावना होता है। लोग बगीचों में टहलते हैं, बच्चे खेलते हैं और चारों ओर रंग बिरंगे फूल खिलते हैं। यह साल का सबसे सुंदर समय है।",
    "greek": "Την άνοιξη ο καιρός είναι πολύ ευχάριστος. Οι άνθρωποι περπατούν στα πάρκα, τα παιδιά παίζουν και τα λουλούδια ανθίζουν παντού.",
}


def test_clean_texts_of_other_scripts_stay(spark, docs_of, corpus):
    rows, good = corpus
    docs = docs_of(rows + [(2000 + i, t, None, "a") for i, t in enumerate(CLEAN.values())])
    ids = {r.doc_id for r in stage("quality")(spark, docs, "").collect()}
    assert {2000 + i for i in range(len(CLEAN))} <= ids
    assert set(range(good)) <= ids and not set(range(good, good + 12)) & ids


def test_last_stage_encodes_every_row(spark, docs_of, corpus):
    rows, _ = corpus
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = stage("encode")(spark, docs_of(rows + rows[:3]), "").collect()
    assert len(got) == len(rows) + 3
    for r in got:
        assert r.ids == library.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids


def test_stages_take_an_empty_table(spark, docs_of):
    docs = docs_of([])
    for _, run in corpus_pipeline.STAGES:
        assert run(spark, docs, "").count() == 0


def test_whole_pipeline_runs(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns) and out.count() > 50


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    problem, rows, _, _ = compare(spark, connect(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir)
    assert problem is None and rows > 0


def test_each_operator_is_registered():
    numbers = {int(n[2:].split("_")[0]) for n in QUERIES}
    assert numbers == set(range(1, 14))


def test_native_operators_run_no_python(spark, sf_dir):
    for name in ("op1_pareto_mix", "op6_order_minhash", "op10_jump_shards"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop")), name
