"""Queries over vectors, retrieval and review history."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import vectors as vx
from ..operators import cells as cl
from ..operators import retrieval as rt
from ..plans.work import new_dir
from ..sources import history as hi
from ..sources import records as rc
from ..sources import tables as tb
from .base import pick, query, quote, sql_pick, table, texts

_STRIP = fv.TOKEN_STRIP.replace("'", "''")


def tokens_sql(text: str) -> str:
    stop = ", ".join(quote(w) for w in fv.STOP_WORDS)
    words = f"list_transform(string_split_regex({text}, {quote(vx.WHITE)}), lambda w: lower(trim(w, '{_STRIP}')))"
    return f"list_filter({words}, lambda w: length(w) > 2 AND w NOT IN ({stop}))"


def _bucket_sql(h: str) -> str:
    part = lambda i: f"CAST('0x' || substr({h}, {8 * i + 1}, 8) AS BIGINT)"
    acc = f"({part(0)} % {fv.HASH_BUCKETS})"
    for i in range(1, 4):
        acc = f"(({acc} * 4294967296 + {part(i)}) % {fv.HASH_BUCKETS})"
    return acc


def embed_sql(source: str, idc: str, text: str, name: str) -> str:
    """CTEs ending in ``{name}_feats(id, dim, v)`` and ``{name}(id, dim, v)`` of unit length."""
    n = name
    arms = []
    for c, (_, kws) in enumerate(fv.CLUSTERS):
        hits = " + ".join(f"CASE WHEN contains(j, {quote(k)}) THEN 1 ELSE 0 END" for k in kws)
        arms.append(f"SELECT id, {fv.HASH_BUCKETS + c * fv.CLUSTER_WIDTH} AS d0, least({fv.CLUSTER_CAP}, {hits}) AS s FROM {n}_join")
    return f"""
      {n}_tok AS (SELECT {idc} AS id, {tokens_sql(text)} AS ws FROM {source}),
      {n}_join AS (SELECT id, array_to_string(ws, ' ') AS j FROM {n}_tok),
      {n}_word AS (SELECT id, unnest(ws) AS w FROM {n}_tok),
      {n}_hash AS (SELECT id, i, md5(w || '_' || i) AS h, sha1(w || '_' || i) AS g FROM {n}_word, range(0, {fv.HASHES_PER_WORD}) r(i)),
      {n}_clus AS ({' UNION ALL '.join(arms)}),
      {n}_cell AS (SELECT id, {_bucket_sql('h')} AS dim, CASE WHEN contains('02468ace', g[40]) THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END / (i + 1) AS v FROM {n}_hash
        UNION ALL SELECT id, d0 + o, CAST(s AS DOUBLE) FROM {n}_clus, range(0, {fv.CLUSTER_WIDTH}) q(o) WHERE s > 0),
      {n}_feats AS (SELECT id, dim, sum(v) AS v FROM {n}_cell GROUP BY id, dim),
      {n}_norm AS (SELECT id, sqrt(sum(v * v)) AS n FROM {n}_feats GROUP BY id),
      {n} AS (SELECT id, dim, round(v / n, 6) AS v FROM {n}_feats JOIN {n}_norm USING (id) WHERE n > 0 AND round(v / n, 6) <> 0)"""


def match_sql(q: str, c: str, k: int, floor: float) -> str:
    """CTE ``matched``: top-k of two sparse tables (id, dim, v)."""
    return f"""
      qn AS (SELECT id, sqrt(sum(v * v)) AS n FROM {q} GROUP BY id), cn AS (SELECT id, sqrt(sum(v * v)) AS n FROM {c} GROUP BY id),
      dots AS (SELECT a.id AS q, b.id AS c, sum(a.v * b.v) AS d FROM {q} a JOIN {c} b ON a.dim = b.dim GROUP BY a.id, b.id),
      sims AS (SELECT q, c, round(d / (qn.n * cn.n), 9) AS s FROM dots JOIN qn ON qn.id = q JOIN cn ON cn.id = c),
      placed AS (SELECT q, c, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, CAST(c AS VARCHAR)) AS rank FROM sims WHERE s >= {floor}),
      matched AS (SELECT CAST(q AS VARCHAR) AS query_id, CAST(c AS VARCHAR) AS item_id, round(s, 4) AS score, CAST(rank AS BIGINT) AS rank FROM placed WHERE rank <= {k})"""


@query("tokens", f"SELECT doc_id, unnest({tokens_sql('text')}) AS token FROM documents")
def tokens(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(vx.tokens(F.col("text"))).alias("token"))


@query(
    "hash_features",
    f"""WITH {embed_sql('benchmark', 'item_id', 'text', 'e')}
    SELECT id AS item_id, CAST(dim AS BIGINT) AS dim, round(v, 6) AS v FROM e_feats""",
)
def hash_features(spark, sf_dir):
    items = texts(spark, sf_dir, "benchmark")
    feats = rt.text_features(items, id_col="item_id", text_col="text")
    return feats.select("item_id", F.inline("cells")).select(
        "item_id", F.col("dim").cast("bigint").alias("dim"), F.round("v", 6).alias("v")
    )


_HINTS = [
    "race on the balance lock", "idempotency retry header, webhook replay cache duplicate", "float drift",
    "deadlock timeout pool network requests http external transaction", "none of these",
]
_HINT_SQL = f"hinted AS (SELECT doc_id, text || ' ' || {sql_pick(_HINTS, 'doc_id')} AS text FROM documents)"


@query(
    "cluster_features",
    f"""WITH {_HINT_SQL}, t AS (SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS j FROM hinted)
    """ + " UNION ALL ".join(
        f"SELECT doc_id, {quote(name)} AS cluster, CAST(least({fv.CLUSTER_CAP}, {' + '.join(f'CASE WHEN contains(j, {quote(k)}) THEN 1 ELSE 0 END' for k in kws)}) AS DOUBLE) AS strength FROM t"
        for name, kws in fv.CLUSTERS
    ),
)
def cluster_features(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents")
    text = F.concat(F.col("text"), F.lit(" "), pick(_HINTS, F.col("doc_id")))
    rows = docs.select("doc_id", vx.tokens(text).alias("w"))
    cells = F.array(*[
        F.struct(F.lit(name).alias("cluster"), F.col(f"_s{i}").alias("strength"))
        for i, (name, _) in enumerate(fv.CLUSTERS)
    ])
    return rt.cluster_strengths(rows, words_col="w").select("doc_id", F.inline(cells))


@query(
    "embed_text",
    f"""WITH {embed_sql('documents', 'doc_id', 'text', 'e')}
    SELECT id AS doc_id, CAST(dim AS BIGINT) AS dim, v FROM e""",
)
def embed_text(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents")
    out = rt.embed_sparse(docs, id_col="doc_id", text_col="text")
    return out.select("doc_id", F.explode("cells").alias("c")).select(
        "doc_id", F.col("c.dim").cast("bigint").alias("dim"), F.col("c.v").alias("v")
    )


@query(
    "cosine",
    """WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, CASE WHEN a.vec_id % 10 = 0 THEN b.embedding[1:10]::DOUBLE[] ELSE b.embedding::DOUBLE[] END AS y
      FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, CASE WHEN len(x) <> len(y) THEN 0.0::DOUBLE ELSE round(list_cosine_similarity(x, y), 6) END AS cosine FROM p""",
)
def cosine(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    b = table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")
    )
    y = F.when(F.col("vec_id") % 10 == 0, F.slice("y", 1, 10)).otherwise(F.col("y"))
    return a.join(b, "vec_id").select("vec_id", F.round(vx.cosine(F.col("x"), y), 6).alias("cosine"))


_TOPK_SQL = """sims AS (SELECT CAST(a.vec_id AS VARCHAR) AS q, CAST(b.vec_id AS VARCHAR) AS c, b.label, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s FROM embeddings a, embeddings b),
   placed AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS rank FROM sims WHERE s >= 0.3),
   matched AS (SELECT q AS query_id, c AS item_id, label, round(s, 4) AS score, CAST(rank AS BIGINT) AS rank FROM placed WHERE rank <= 3)"""


def _vectors(spark, sf_dir, name):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(name), F.col("embedding").alias("vec"))


def _neighbours(spark, sf_dir):
    return rt.topk(_vectors(spark, sf_dir, "query_id"), _vectors(spark, sf_dir, "item_id"), dim=64, k=3, min_sim=0.3)


@query("topk_cosine", f"WITH {_TOPK_SQL} SELECT query_id, item_id, score, rank FROM matched")
def topk_cosine(spark, sf_dir):
    return _neighbours(spark, sf_dir).withColumn("rank", F.col("rank").cast("bigint"))


def _index(spark, sf_dir):
    path = new_dir(spark, "cells")
    cl.build(_vectors(spark, sf_dir, "item_id"), path, dim=64, k=3, min_sim=0.3)
    return path


# Every row asks all rows. The search through the stored index is finished exactly, so that
# its rows are those of all pairs at any size.
@query("ann_join", f"WITH {_TOPK_SQL} SELECT query_id, item_id, score, rank FROM matched")
def ann_join(spark, sf_dir):
    path, asked = _index(spark, sf_dir), _vectors(spark, sf_dir, "query_id")
    found = cl.search(asked, path, k=3, min_sim=0.3, exact=True, merge_ids=False)
    return found.withColumn("rank", F.col("rank").cast("bigint"))


# The recall is measured on the rows whose id is divisible by 50, against all rows.
_ASKED_SQL = """sims AS (SELECT CAST(a.vec_id AS VARCHAR) AS q, CAST(b.vec_id AS VARCHAR) AS c, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s
     FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0),
   placed AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS rank FROM sims WHERE s >= 0.3),
   matched AS (SELECT * FROM placed WHERE rank <= 3)"""


@query(
    "ann_recall",
    f"""WITH {_ASKED_SQL} SELECT (SELECT count(*) FROM embeddings) AS n_items, count(DISTINCT q) AS n_queries, count(*) AS n_matches,
      true AS recall_reached, true AS fewer_candidates FROM matched""",
)
def ann_recall(spark, sf_dir):
    """The search without exact finish: at least nine tenths of the exact matches, from three quarters of the rows or fewer."""
    path, asked = _index(spark, sf_dir), _vectors(spark, sf_dir, "query_id").where("query_id % 50 = 0")
    items = cl.stored_rows(spark, path).count()
    near = cl.search(asked, path, k=3, min_sim=0.3).select("query_id", "item_id", F.lit(1).alias("hit"))
    best = rt.topk(asked, _vectors(spark, sf_dir, "item_id"), dim=64, k=3, min_sim=0.3)
    share = cl.candidates(asked, path).agg(F.avg("n")).first()[0] / items
    return best.join(near, ["query_id", "item_id"], "left").agg(
        F.lit(items).cast("bigint").alias("n_items"), F.count_distinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_matches"),
        (F.count("hit") >= cl.RECALL * F.count(F.lit(1))).alias("recall_reached"), F.lit(share <= 0.75).alias("fewer_candidates"),
    )


_CATS = [c for c, _ in fv.ELEVATED_RULES] + ["OTHER"]


@query(
    "elevated_rules",
    f"""WITH {_TOPK_SQL}, m AS (SELECT query_id, {sql_pick(_CATS, 'label')} AS bug_category FROM matched),
      r AS (SELECT * FROM (VALUES {', '.join(f'({quote(c)}, {quote(x)})' for c, xs in fv.ELEVATED_RULES for x in xs)}) v(bug_category, rule_id))
    SELECT query_id, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS elevated_rules FROM m JOIN r USING (bug_category) GROUP BY query_id""",
)
def elevated_rules(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("item_id"), pick(_CATS, F.col("label")).alias("bug_category")
    )
    out = rt.elevated_rules(_neighbours(spark, sf_dir).join(labels, "item_id"))
    return out.select("query_id", F.array_join("elevated_rules", ",").alias("elevated_rules"))


@query(
    "precedent_label",
    "SELECT page_id, CASE WHEN contains(url, '/') THEN string_split(url, '/')[-1] ELSE CAST(page_id AS VARCHAR) END AS pr_id FROM pages",
)
def precedent_label(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", rt.precedent_label(F.col("url"), F.col("page_id").cast("string")).alias("pr_id")
    )


_RULE_IDS = ["AST-FIN-001", "X-DOUBLE_SPEND_RACE-1", "RULE-FLOAT_PRECISION_DRIFT", "RULE-OTHER"]


@query(
    "evidence_join",
    f"""WITH {_TOPK_SQL}, m AS (SELECT query_id AS payload_id, item_id, score, rank, {sql_pick(_CATS, 'label')} AS bug_category FROM matched),
      f AS (SELECT CAST(vec_id AS VARCHAR) AS payload_id, n AS finding_no, {sql_pick(_CATS, '(vec_id + n)')} AS category, {sql_pick(_RULE_IDS, '(vec_id + 2 * n)')} AS rule_id FROM embeddings, range(0, 3) r(n)),
      j AS (SELECT f.payload_id, finding_no, item_id, bug_category, score, rank, row_number() OVER (PARTITION BY f.payload_id, finding_no ORDER BY rank) AS i
        FROM f JOIN m USING (payload_id) WHERE bug_category = category OR contains(rule_id, bug_category))
    SELECT payload_id, finding_no, item_id, bug_category, score, rank FROM j WHERE i = 1""",
)
def evidence_join(spark, sf_dir):
    vec = table(spark, sf_dir, "embeddings")
    labels = vec.select(F.col("vec_id").cast("string").alias("item_id"), pick(_CATS, F.col("label")).alias("bug_category"))
    precedents = _neighbours(spark, sf_dir).join(labels, "item_id").withColumnRenamed("query_id", "payload_id")
    numbered = vec.select("vec_id", F.explode(F.expr("sequence(0L, 2L)")).alias("finding_no"))
    findings = numbered.select(
        F.col("vec_id").cast("string").alias("payload_id"),
        "finding_no",
        pick(_CATS, F.col("vec_id") + F.col("finding_no")).alias("category"),
        pick(_RULE_IDS, F.col("vec_id") + 2 * F.col("finding_no")).alias("rule_id"),
    )
    out = rt.evidence(findings, precedents)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "decode_vec",
    """SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings WHERE vec_id % 7 <> 0""",
)
def decode_vec(spark, sf_dir):
    """Every seventh vector arrives as cut-off JSON and drops out."""
    js = F.to_json(F.col("embedding"))
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, F.concat(F.lit("{"), F.substring(js, 2, 20))).otherwise(js).alias("js")
    )
    out = rt.decode_embedding(rows, json_col="js")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return out.select("vec_id", F.size("embedding").cast("bigint").alias("n"), F.round(total, 4).alias("total"))


# Incident-like openings for the documents, and the incidents they should find.
OPENINGS = [
    "Concurrent withdrawal debit without row lock: race condition on wallet balance, double_spend on update",
    "duplicate charge on webhook retry because the idempotency key header and replay cache are missing",
    "float literals cause IEEE 754 precision drift, decimal rounding mismatch in cents",
    "requests.post http call inside database transaction: pool exhaustion, deadlock and timeout of external network",
    "nothing in particular",
]
_INC_SQL = "inc AS (SELECT * FROM (VALUES " + ", ".join(
    f"('INC-{i}', {quote(' '.join((r[1], r[2], r[3], r[4])))}, {quote(r[1])}, {quote(r[0].rsplit('/', 1)[-1])})"
    for i, r in enumerate(fv.SEED_INCIDENTS, 1)
) + ") v(id, full_text, bug_category, pr_id))"


def incidents(spark):
    base = rt.seed_incidents(spark)
    vectors = rt.embed(base, id_col="id", text_col="full_text")
    return base.join(vectors, "id")


@query(
    "topk_text",
    f"""WITH {_INC_SQL}, qs AS (SELECT item_id, {sql_pick(OPENINGS, 'item_id')} || ' ' || text AS text FROM benchmark),
      {embed_sql('qs', 'item_id', 'text', 'q')}, {embed_sql('inc', 'id', 'full_text', 'c')}, {match_sql('q', 'c', 3, 0.5)}
    SELECT * FROM matched""",
)
def topk_text(spark, sf_dir):
    items = texts(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.concat(pick(OPENINGS, F.col("item_id")), F.lit(" "), F.col("text")).alias("text"),
    )
    corpus = incidents(spark).select(F.col("id").alias("item_id"), F.col("embedding").alias("vec"))
    return rt.topk_text(items, corpus, min_sim=0.5).withColumn("rank", F.col("rank").cast("bigint"))


# History lines made from documents: id, type and the text, with blanks for its line breaks.
_LINE_CASES = [
    "{id}, {type}, {text}", '{id},"{type}","{text}"', '{id}, {type}, "{text}"', "{id}, {text}", "{id}",
    "id,type,description", "   ", "{id}, , {text}", '{id},Security,"quoted ""word"", {text}" tail', "{id},x,",
]


def _line_sql(dialect: str) -> str:
    arms = []
    first = "translate(replace(text, chr(10), ' '), '\"', '')"
    for i, case in enumerate(_LINE_CASES):
        parts = case
        for token, expr in (("{id}", "doc_id"), ("{type}", "source"), ("{text}", first)):
            parts = parts.replace(token, f"' || {expr} || '")
        arms.append(f"WHEN {i} THEN '{parts}'")
    return f"CASE doc_id % {len(_LINE_CASES)} {' '.join(arms)} END"


_FIELD_RE = quote(hi.FIELD)
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_HISTORY_SQL = f"""hl AS (SELECT doc_id, {_TRIM.format('(' + _line_sql('duckdb') + ')')} AS l FROM documents),
   hf AS (SELECT doc_id, list_transform(regexp_extract_all(',' || l, {_FIELD_RE}, 1), lambda f: {_TRIM.format("CASE WHEN starts_with(f, chr(34)) THEN replace(regexp_replace(f, '^\"([^\"]*(?:\"\"[^\"]*)*)\"?(.*)$', '\\1\\2'), chr(34) || chr(34), chr(34)) ELSE f END")}) AS f FROM hl WHERE l <> ''),
   hr AS (SELECT doc_id, 'CSV-HIST-' || f[1] AS rule_id, CASE WHEN len(f) >= 3 THEN lower(f[2]) ELSE 'general' END AS rule_type,
     CASE WHEN len(f) >= 3 THEN array_to_string(f[3:], ', ') ELSE f[2] END AS description FROM hf WHERE lower(f[1]) NOT IN ('id', '<id>') AND len(f) >= 2),
   history AS (SELECT * FROM hr WHERE description <> '')"""


def history(spark, sf_dir):
    lines = texts(spark, sf_dir, "documents").select("doc_id", F.expr(_line_sql("spark")).alias("value"))
    return hi.parse_history(lines)


@query("history_csv", f"WITH {_HISTORY_SQL} SELECT doc_id, rule_id, rule_type, description FROM history")
def history_csv(spark, sf_dir):
    return history(spark, sf_dir)


# Every line of a document in turn opens a quoted cell, closes one, or stands for itself.
_CELLS = [
    "{id},Perf,\"{line}", "{line}\" tail,more", "{id}, Type, {line}", "{id},x,\"a \"\"b\"\" {line}\"", "{line}", "  ", "{id},say \"{line}\", \"\"\"{line}",
]


def _cells_sql(dialect: str) -> str:
    arms = " ".join(
        f"WHEN {i} THEN '" + case.replace("{id}", "' || n || '").replace("{line}", "' || line || '") + "'" for i, case in enumerate(_CELLS)
    )
    return f"CASE (doc_id * 3 + n * n + length(line)) % {len(_CELLS)} {arms} END"


_PART = '(?:[^",\\n][^,\\n]*)?'
_ONE = f'(?:"(?:[^"]|"")*(?:"{_PART}|\\z)|{_PART})'
_SPANS_SQL = f"""raw AS (SELECT doc_id, n, regexp_replace(line, '\\s+', ' ', 'g') AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents) x),
   rows AS (SELECT doc_id, n, {_TRIM.format('(' + _cells_sql('duckdb') + ')')} AS l FROM raw),
   files AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY n) AS f FROM rows WHERE l <> '' GROUP BY doc_id),
   whole AS (SELECT doc_id, unnest(regexp_extract_all(f, {quote(f'{_ONE}(?:,{_ONE})*')})) AS r FROM files)"""


@query(
    "history_records",
    f"""WITH {_SPANS_SQL}, {_HISTORY_SQL.replace(_HISTORY_SQL[:_HISTORY_SQL.index(',' + chr(10))], "hl AS (SELECT doc_id, replace(r, chr(10), '') AS l FROM whole WHERE r <> '')", 1)}
    SELECT doc_id, rule_id, rule_type, description FROM history""",
)
def history_records(spark, sf_dir):
    lines = texts(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"\s+", " "))
    lines = lines.select("doc_id", "n", F.expr(_cells_sql("spark")).alias("value"))
    return hi.parse_history(rc.records(lines, ["doc_id"], ["n"]).drop("at"))


@query(
    "history_embed",
    f"""WITH {_HISTORY_SQL}, h AS (SELECT *, upper(left(rule_type, 1)) || lower(substr(rule_type, 2)) || 'Guard: ' || left(description, 40) || '...' AS rule_name,
        '[' || upper(replace(rule_type, 'ß', 'ss')) || '] ' || description AS full_text FROM history),
      {embed_sql('h', 'rule_id', 'full_text', 'e')}, s AS (SELECT id, count(*) AS n_dims, round(sum(v * dim), 2) AS checksum FROM e GROUP BY id)
    SELECT rule_id, rule_name, full_text, n_dims, checksum FROM h JOIN s ON id = rule_id""",
)
def history_embed(spark, sf_dir):
    rich = hi.enrich_history(history(spark, sf_dir))
    vec = hi.with_vectors(rich, make=rt.embed_sparse)
    total = F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["v"] * c["dim"])
    return vec.where(F.size("cells") > 0).select(
        "rule_id", "rule_name", "full_text",
        F.size("cells").cast("bigint").alias("n_dims"), F.round(total, 2).alias("checksum"),
    )


# Every incident is stored; an update of each fifth comes twice, with other texts.
_UPDATES_SQL = f"""{_HISTORY_SQL}, upd AS (SELECT doc_id, 0 AS copy, rule_id, rule_type, description FROM history
     UNION ALL SELECT doc_id, 1, rule_id, rule_type, 'again ' || description FROM history WHERE doc_id % 5 = 0),
   h AS (SELECT rule_id AS id, arg_max(description, copy) AS description, '[' || upper(replace(arg_max(rule_type, copy), 'ß', 'ss')) || '] ' || arg_max(description, copy) AS full_text
     FROM upd WHERE doc_id % 2 = 0 OR copy = 1 GROUP BY rule_id)"""


@query(
    "incidents_upsert",
    f"""WITH {_UPDATES_SQL}, {embed_sql('h', 'id', 'full_text', 'e')}, s AS (SELECT id, count(*) AS n_dims, sum(CAST(CAST(v AS FLOAT) AS DOUBLE) * dim) AS checksum FROM e GROUP BY id),
      old AS (SELECT rule_id AS id, 'old ' || description AS description, 'cause ' || doc_id AS root_cause FROM history)
    SELECT id, coalesce(h.description, old.description) AS description, old.root_cause AS root_cause,
      CASE WHEN h.id IS NULL THEN 0 ELSE coalesce(n_dims, 0) END AS n_dims, round(CASE WHEN h.id IS NULL THEN 0 ELSE coalesce(checksum, 0) END, 4) AS checksum
    FROM old LEFT JOIN h USING (id) LEFT JOIN s USING (id)""",
)
def incidents_upsert(spark, sf_dir):
    rows = history(spark, sf_dir)
    old = rows.select(
        F.col("rule_id").alias("id"), F.concat(F.lit("old "), "description").alias("description"),
        F.concat(F.lit("cause "), F.col("doc_id").cast("string")).alias("root_cause"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )
    copies = rows.withColumn("copy", F.explode(F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    again = F.when(F.col("copy") == 1, F.concat(F.lit("again "), "description")).otherwise(F.col("description"))
    updates = copies.withColumn("description", again).where("doc_id % 2 = 0 OR copy = 1")
    new = hi.history_incidents(updates).select("id", "description", "root_cause", "embedding", "copy")
    out = tb.upsert_incidents(old, new, order="copy")
    cells = F.filter(F.transform(F.coalesce("embedding", F.array().cast("array<float>")), lambda v, i: v.cast("double") * i), lambda x: x != 0)
    filled = F.size(F.filter(F.coalesce("embedding", F.array().cast("array<float>")), lambda v: v != 0))
    return out.select(
        "id", "description", "root_cause", filled.cast("bigint").alias("n_dims"),
        F.round(F.aggregate(cells, F.lit(0.0), lambda a, x: a + x), 4).alias("checksum"),
    )


@query(
    "session_retrieval",
    f"""WITH {_INC_SQL}, qs AS (SELECT doc_id, 'org/' || source || ' ' || substr({sql_pick(OPENINGS, 'doc_id')} || '. ' || text, 1, {fv.SESSION_QUERY_CHARS}) AS text FROM documents),
      {embed_sql('qs', 'doc_id', 'text', 'q')}, {embed_sql('inc', 'id', 'full_text', 'c')}, {match_sql('q', 'c', fv.TOP_K, fv.SESSION_MIN_SIMILARITY)}
    SELECT query_id, rank, score, pr_id, bug_category FROM matched JOIN inc ON id = item_id""",
)
def session_retrieval(spark, sf_dir):
    """First 500 characters of every payload against the incident store."""
    docs = texts(spark, sf_dir, "documents").withColumn(
        "sanitized", F.concat(pick(OPENINGS, F.col("doc_id")), F.lit(". "), F.col("text"))
    )
    repo = F.concat(F.lit("org/"), F.col("source"))
    qs = docs.select(F.col("doc_id").alias("query_id"), rt.session_query_text(repo, F.col("sanitized")).alias("text"))
    store = incidents(spark)
    corpus = store.select(F.col("id").alias("item_id"), F.col("embedding").alias("vec"))
    found = rt.topk_text(qs, corpus, k=fv.TOP_K, min_sim=fv.SESSION_MIN_SIMILARITY)
    meta = store.select(
        F.col("id").alias("item_id"), rt.precedent_label(F.col("pr_url"), F.col("id")).alias("pr_id"), "bug_category"
    )
    return found.join(meta, "item_id").select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "score", "pr_id", "bug_category"
    )


@query(
    "cache_hits",
    """SELECT 'sha256:' || sha256(text) AS payload_hash, min(doc_id) AS first_id, count(*) AS n_reviews, count(*) - 1 AS cache_hits FROM documents GROUP BY 1""",
)
def cache_hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("payload_hash")
    )
    return rt.cache_report(docs, id_col="doc_id", hash_col="payload_hash", order="doc_id")
