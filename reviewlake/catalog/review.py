"""Queries over whole reviews, prompts, reports and free-text findings."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import diffs as df_
from ..operators import growth as gr
from ..operators import report as rp
from ..operators import scoring as sc
from ..plans.cached import review_cached
from ..plans.review import review
from ..plans.work import new_dir
from ..sources.files import decode_source
from ..sources.files import scan_sources as scan_files_below
from ..sources import tables as tb
from ..sources.findings_json import extract_findings
from . import feedback as fb
from . import scan as sn
from .base import pick, query, quote, sql_pick, table, texts
from .redaction import inspect_sql

_PAY = """'org/' || (doc_id % 9) AS repo_name, md5('r' || doc_id) AS commit_sha, 'dev-' || (doc_id % 40) AS author_id,
   'U-' || (doc_id % 30) AS user_id, CASE WHEN doc_id % 5 = 0 THEN 'go' ELSE 'python' END AS language"""


_SESSIONS = f"""WITH {sn._WANT_SQL},
      pay AS (SELECT doc_id, '--- a/src/m.py' || chr(10) || '+++ b/src/m.py' || chr(10) || '@@ -0,0 +1,' || (length(source) - length(replace(source, chr(10), '')) + CASE WHEN ends_with(source, chr(10)) THEN 0 ELSE 1 END) || ' @@' || chr(10)
        || '+' || replace(CASE WHEN ends_with(source, chr(10)) THEN source[1:length(source) - 1] ELSE source END, chr(10), chr(10) || '+') AS text, {_PAY} FROM (SELECT file_id AS doc_id, source FROM src)),
      {inspect_sql('pay', 'doc_id, repo_name, commit_sha, author_id, user_id, language')},
      n AS (SELECT file_id, count(*) AS n, sum(CASE WHEN rule_id = 'AST-FIN-002' THEN 15 ELSE 25 END) AS p FROM findings GROUP BY file_id),
      j AS (SELECT i.*, CASE WHEN language = 'python' AND dlp_status <> 'QUARANTINED' THEN coalesce(n, 0) ELSE 0 END AS n, CASE WHEN language = 'python' AND dlp_status <> 'QUARANTINED' THEN coalesce(p, 0) ELSE 0 END AS p
        FROM inspected i LEFT JOIN n ON file_id = doc_id)
    SELECT doc_id AS id, repo_name, left(commit_sha, 8) AS pr_id, author_id, integrity_hash AS payload_hash, CAST(n AS INTEGER) AS findings_count, dlp_status,
      CAST(greatest(10, least(100, 100 - p)) AS DOUBLE) / 10 AS quality_score, user_id, language, commit_sha, (doc_id % 400)::BIGINT AS execution_duration_ms,
      TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS created_at FROM j"""


def payloads(spark, sf_dir):
    src = sn.sources(spark, sf_dir).withColumnRenamed("file_id", "doc_id")
    rows = src.selectExpr(
        "doc_id AS payload_id", "source", "'org/' || (doc_id % 9) AS repo_name", "md5('r' || doc_id) AS commit_sha",
        "'dev-' || (doc_id % 40) AS author_id", "'U-' || (doc_id % 30) AS user_id",
        "CASE WHEN doc_id % 5 = 0 THEN 'go' ELSE 'python' END AS language", "TIMESTAMP_NTZ '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, doc_id) AS created_at",
        "doc_id % 400 AS execution_duration_ms",
    )
    return rows.withColumn("diff", df_.as_added(F.lit("src/m.py"), F.col("source"))).drop("source")


@query("sessions_build", _SESSIONS)
def sessions_build(spark, sf_dir):
    return review(payloads(spark, sf_dir), work_path=new_dir(spark, "inspected")).sessions


@query("sessions_cached", _SESSIONS)
def sessions_cached(spark, sf_dir):
    """Two runs over one store of results: the second finds the texts of even ids there and reviews the others."""
    store, rows = new_dir(spark, "reviews"), payloads(spark, sf_dir)
    review_cached(rows.where("payload_id % 2 = 0"), store, version="1")
    return review_cached(rows, store, version="1").sessions


@query(
    "kpis",
    f"""WITH {fb.FEED_SQL},
      a AS (SELECT count(*) AS n_sessions, CAST(quantile_cont(doc_id % 400, 0.5) AS DOUBLE) AS median_duration_ms FROM documents),
      b AS (SELECT round(count(*) FILTER (event_type = 'POST_DEPLOY_REVERT') * 100.0 / count(*), 4) AS revert_rate_pct FROM feed)
    SELECT n_sessions, median_duration_ms, CAST(revert_rate_pct AS DOUBLE) AS revert_rate_pct, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in fv.PILOT_TARGETS.items())} FROM a, b""",
)
def kpis(spark, sf_dir):
    """From the sessions that a review has written."""
    at = new_dir(spark, "sessions")
    tb.append_sessions(review(payloads(spark, sf_dir), work_path=new_dir(spark, "inspected")).sessions, at)
    out = gr.kpis(spark.read.parquet(at), fb.feed(spark, sf_dir))
    return out.withColumn("revert_rate_pct", F.col("revert_rate_pct").cast("double"))


_STATS_FIELDS = ("n_files", "latency_ms", "rules_fired", "dlp_status")


@query(
    "findings_stats_export",
    f"""WITH {fb.FINDINGS_SQL}, f0 AS (SELECT {fb._FILES} FROM lineitem),
      r AS (SELECT review_id, count(*) AS n_files, round(sum(latency_ms), 2) AS latency_ms, CAST(sum(rules_fired) AS BIGINT) AS rules_fired,
        coalesce(arg_max(dlp_status, (file_no, dlp_status)) FILTER (dlp_status <> 'CLEAN'), 'CLEAN') AS dlp_status FROM f0 GROUP BY review_id),
      l AS (SELECT payload_id, list((finding_no || ':' || severity || ':' || category) ORDER BY finding_no, severity, category) AS fs FROM findings GROUP BY payload_id)
    SELECT payload_id, n_files, latency_ms, rules_fired, dlp_status, array_to_string(fs, ',') AS findings FROM r JOIN l ON payload_id = review_id""",
)
def findings_stats_export(spark, sf_dir):
    """The export of findings with the statistics of their review, written as JSON and read back."""
    files = table(spark, sf_dir, "lineitem").selectExpr(*fb._split_columns(fb._FILES))
    rolled = sc.rollup_reviews(files).withColumnRenamed("review_id", "payload_id")
    at = new_dir(spark, "export")
    rp.export_report(rolled, fb.findings(spark, sf_dir), fields=_STATS_FIELDS).select("report").write.text(at)
    item = "array<struct<finding_no:int,severity:string,category:string>>"
    schema = f"payload_id bigint, part int, n_files bigint, latency_ms double, rules_fired bigint, dlp_status string, findings {item}"
    rows = spark.read.schema(schema).json(at)
    parts = rows.groupBy("payload_id", *_STATS_FIELDS).agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("part", "findings"))), lambda p: p["findings"]
    )).alias("all"))
    lines = F.transform("all", lambda f: F.concat_ws(":", f["finding_no"].cast("string"), f["severity"], f["category"]))
    return parts.select("payload_id", *_STATS_FIELDS, F.array_join(lines, ",").alias("findings"))


_ITEM = {
    "severity": "HIGH", "category": "IDEMPOTENCY", "file_path": "a.py", "summary": "no guard [x]", "detailed_analysis": "d",
}
_NESTED = {**_ITEM, "summary": "nested", "line_range": [3, 9], "suggested_patch": {"diff": "-a", "explanation": "e"}}
_FENCE = "`" * 3
TALKS = [
    ("Here you go:\n" + _FENCE + "json\n" + json.dumps([_ITEM]) + "\n" + _FENCE + "\nThanks", [(0, _ITEM)]),
    (_FENCE + "\n" + json.dumps([_ITEM, _NESTED], indent=1) + "\n" + _FENCE, [(0, _ITEM), (1, _NESTED)]),
    ("plain " + json.dumps([_NESTED]) + " end", [(0, _NESTED)]),
    (json.dumps([{**_ITEM, "severity": "SEVERE"}, 7, _ITEM, {"summary": "x"}]), [(2, _ITEM)]),
    (json.dumps([{**_NESTED, "suggested_patch": {"diff": "-a"}}, _NESTED]), [(1, _NESTED)]),
    (json.dumps({"summary": "not a list"}), []),
    ("cut " + json.dumps([_ITEM])[:-9], []),
    ("nothing at all", []),
]
_TALK_ROWS = [
    (i, n, f["severity"], f["category"], f["file_path"], f["summary"], f.get("line_range", [1, 1])[1])
    for i, (_, found) in enumerate(TALKS)
    for n, f in found
]


@query(
    "json_findings",
    f"""WITH want AS (SELECT * FROM {sn._values(_TALK_ROWS, 'c, n, severity, category, file_path, summary, line_end')})
    SELECT conv_id, turn, CAST(n AS BIGINT) AS item_no, severity, category, file_path, summary, CAST(line_end AS BIGINT) AS line_end
    FROM conversations JOIN want ON c = (conv_id + turn) % {len(TALKS)}""",
)
def json_findings(spark, sf_dir):
    """Model answers stand after the text of each turn."""
    at = F.col("conv_id") + F.col("turn")
    talk = texts(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        F.concat(F.translate("text", "[]`{}", "     "), F.lit("\n"), pick([t for t, _ in TALKS], at)).alias("text"),
    )
    out = extract_findings(talk)
    return out.select(
        "conv_id", "turn", F.col("item_no").cast("bigint").alias("item_no"), "severity", "category", "file_path", "summary",
        F.col("line_range")[1].cast("bigint").alias("line_end"),
    )


@query(
    "remediation_join",
    f"""WITH {fb.FINDINGS_SQL}, t AS (SELECT * FROM {sn._values(fv.EXPECTED_FAILURES, 'cat, expected')})
    SELECT payload_id, finding_no, category, CASE WHEN finding_no = 2 THEN 'given' ELSE coalesce(expected, '{fv.DEFAULT_EXPECTED_FAILURE}') END AS expected_failure,
      CASE WHEN finding_no = 3 THEN 'done by hand' ELSE '{fv.PATCH_EXPLANATION_PREFIX}' || category END AS patch_explanation,
      CASE WHEN finding_no = 3 THEN '' ELSE 'PENDING' END AS verification_status
    FROM findings LEFT JOIN t ON cat = category""",
)
def remediation_join(spark, sf_dir):
    given = (
        fb.findings(spark, sf_dir)
        .withColumn("expected_failure", F.when(F.col("finding_no") == 2, "given"))
        .withColumn("patch_explanation", F.when(F.col("finding_no") == 3, "done by hand"))
    )
    return rp.fill_remediation(given).select(
        "payload_id", "finding_no", "category", "expected_failure", "patch_explanation",
        F.coalesce("verification_status", F.lit("")).alias("verification_status"),
    )


@query(
    "report_export",
    f"""WITH {fb.FINDINGS_SQL}, {fb._COUNTS_SQL},
      {fb.REVIEWED_SQL}, p AS (SELECT payload_id, greatest(10, least(100, 100 - coalesce(25 * c + 15 * h + 8 * m + 3 * l, 0))) AS s FROM reviewed LEFT JOIN counts USING (payload_id)),
      f AS (SELECT payload_id, string_agg('{{"finding_no":' || finding_no || ',"severity":"' || severity || '","category":"' || category || '"}}', ',' ORDER BY finding_no, severity, category) AS fs FROM findings GROUP BY payload_id)
    SELECT payload_id, CAST(0 AS INTEGER) AS part, '{{"payload_id":' || payload_id || ',"part":0,"score":' || CAST(s AS DOUBLE) / 10 || ',"grade":"' || {fb._GRADE.format(*[quote(g[1]) for g in fv.GRADES])} || '","findings":[' || coalesce(fs, '') || ']}}' AS report
    FROM p LEFT JOIN f USING (payload_id)""",
)
def report_export(spark, sf_dir):
    found = fb.findings(spark, sf_dir)
    return rp.export_report(sc.rate(fb.reviewed(spark, sf_dir), found), found)


@query(
    "scan_sources",
    r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '[^\x{00}-\x{FF}]', '?', 'g') END AS source FROM documents""",
)
def scan_sources(spark, sf_dir):
    """Every other text comes as Latin-1 bytes."""
    narrow = F.regexp_replace("text", r"[^\x{00}-\x{FF}]", "?")
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode(narrow, "ISO-8859-1"))
    return table(spark, sf_dir, "documents").select("doc_id", decode_source(raw).alias("source"))


# A file for every 64 documents; those of more than so many bytes are not read.
_FILE_BYTES = 200_000


@query(
    "scan_files",
    f"""WITH f AS (SELECT doc_id // 64 AS part, string_agg(replace(coalesce(text, ''), chr(13), ' ') || chr(10), '' ORDER BY doc_id, text) AS source FROM documents GROUP BY part)
    SELECT part, strlen(source)::BIGINT AS bytes, CASE WHEN strlen(source) <= {_FILE_BYTES} THEN sha256(source) END AS digest,
      CASE WHEN strlen(source) > {_FILE_BYTES} THEN 'larger than {_FILE_BYTES} bytes' END AS error FROM f""",
)
def scan_files(spark, sf_dir):
    """All documents written as text files, then read back as source files; too large ones become error rows."""
    at = new_dir(spark, "files")
    lines = table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 64).alias("part"), "doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit(" ")).alias("value")
    )
    ordered = lines.repartition("part").sortWithinPartitions("part", "doc_id", "value")
    ordered.select("part", "value").write.partitionBy("part").text(at)
    files = scan_files_below(spark, at, glob="part-*", max_bytes=_FILE_BYTES)
    return files.select(
        F.regexp_extract("path", r"/part=(\d+)/", 1).cast("bigint").alias("part"), "bytes", F.sha2("source", 256).alias("digest"), "error"
    )


_PROMPT_LANGS = ["python", "go", "Java", "other"]
_MESSAGES = ["too toxic", "low quality"]


def _sql_fill(template: str, **values: str) -> str:
    out, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [quote(head), values[name]]
    return " || ".join([*out, quote(rest)])


_INC_ROWS = [(i, *r) for i, r in enumerate(fv.SEED_INCIDENTS)]
_GUIDE_ROWS = [(n, "; ".join(b), "; ".join(a), t) for n, b, a, t in fv.GUIDELINES]
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
PROMPT_SQL = f"""WITH d AS (SELECT doc_id, source, text, {sql_pick(_PROMPT_LANGS, 'doc_id')} AS language FROM documents),
   g AS (SELECT * FROM {sn._values(_GUIDE_ROWS, 'lang, best, against, note')}),
   inc AS (SELECT * FROM {sn._values(_INC_ROWS, 'i, url, cat, descr, cause, fix, sha')}),
   fr AS (SELECT l.doc_id, n, row_number() OVER (PARTITION BY l.doc_id ORDER BY n) AS i FROM labels l, range(0, 2) r(n) WHERE (n = 0 AND toxic = 1) OR (n = 1 AND quality = 0)),
   f AS (SELECT doc_id, string_agg({_sql_fill(fv.PROMPT_FINDING, n='i', rule_id="'R-' || n", category=quote('SECURITY_DLP'), file_path="'f' || doc_id || '.py'", line='n + 1', severity=quote('HIGH'), message=sql_pick(_MESSAGES, 'n'), snippet=quote('x = 1'))}, chr(10) ORDER BY i) AS body FROM fr GROUP BY doc_id),
   pr AS (SELECT doc_id, j AS rank, i, cat, descr, cause, fix, sha, url FROM documents, range(1, 3) r(j), inc WHERE doc_id % 3 <> 0 AND i = (doc_id + j) % 4),
   p AS (SELECT doc_id, string_agg({_sql_fill(fv.PROMPT_PRECEDENT, n='rank', pr_id="string_split(url, '/')[-1]", score="CAST(0.5 + rank * 0.125 AS DOUBLE)", bug_category='cat', description='descr', root_cause='cause', remediation='fix', fix_commit_sha='sha')}, chr(10) ORDER BY rank) AS body FROM pr GROUP BY doc_id),
   e AS (SELECT doc_id, {_sql_fill(fv.PROMPT_RULE, rule="'E-' || (doc_id % 7)")} AS body FROM documents WHERE doc_id % 4 = 1)
   SELECT d.doc_id, sha256(concat_ws(chr(10), {_sql_fill(fv.PROMPT_HEADER, repo="'org/' || source", language='upper(d.language)', commit=quote('head'))},
     {_sql_fill(fv.PROMPT_GUIDELINES, language='upper(d.language)')}, {quote(fv.PROMPT_BEST)} || coalesce(g.best, y.best), {quote(fv.PROMPT_ANTI)} || coalesce(g.against, y.against), {quote(fv.PROMPT_NOTE)} || coalesce(g.note, y.note),
     {quote(fv.PROMPT_PAYLOAD)}, {_TRIM.format('text')}, {quote(fv.PROMPT_PAYLOAD_END)},
     {quote(fv.PROMPT_FINDINGS)} || chr(10) || f.body || chr(10) || {quote(fv.PROMPT_FINDINGS_END)},
     {quote(fv.PROMPT_RULES)} || chr(10) || e.body || chr(10), {quote(fv.PROMPT_PRECEDENTS)} || chr(10) || p.body || chr(10) || {quote(fv.PROMPT_PRECEDENTS_END)}, {quote(fv.PROMPT_END)})) AS prompt_hash
   FROM d LEFT JOIN g ON g.lang = lower(d.language) LEFT JOIN f USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN e USING (doc_id), (SELECT * FROM g WHERE lang = 'python') y"""


@query("prompts", PROMPT_SQL)
def prompts(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents")
    key = F.col("doc_id")
    payloads = docs.select(
        "doc_id", F.concat(F.lit("org/"), "source").alias("repo_name"), F.lit("head").alias("commit_sha"),
        pick(_PROMPT_LANGS, key).alias("language"), F.col("text").alias("sanitized"),
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality", F.explode(F.expr("array(0, 1)")).alias("n"))
    findings = labels.where("(n = 0 AND toxic = 1) OR (n = 1 AND quality = 0)").select(
        "doc_id", F.col("n").alias("finding_no"), F.concat(F.lit("R-"), F.col("n").cast("string")).alias("rule_id"),
        F.lit("SECURITY_DLP").alias("category"), F.concat(F.lit("f"), key.cast("string"), F.lit(".py")).alias("file_path"),
        (F.col("n") + 1).alias("line_start"), F.lit("HIGH").alias("severity"), pick(_MESSAGES, F.col("n")).alias("message"),
        F.lit("  x = 1").alias("snippet"),
    )
    inc = spark.createDataFrame(
        _INC_ROWS, "i int, pr_url string, bug_category string, description string, root_cause string, remediation string, fix_commit_sha string"
    )
    ids = table(spark, sf_dir, "documents").select("doc_id")
    ranked = ids.where("doc_id % 3 <> 0").select("doc_id", F.explode(F.expr("array(1, 2)")).alias("rank"))
    precedents = ranked.withColumn("i", ((key + F.col("rank")) % 4).cast("int")).join(F.broadcast(inc), "i").select(
        "doc_id", "rank", F.element_at(F.split("pr_url", "/"), -1).alias("pr_id"),
        (F.col("rank") * F.lit(0.125) + F.lit(0.5)).alias("score"), "bug_category", "description", "root_cause", "remediation", "fix_commit_sha",
    )
    rules = ids.where("doc_id % 4 = 1").select("doc_id", F.concat(F.lit("E-"), (key % 7).cast("string")).alias("rule_id"))
    out = rp.build_prompts(payloads, findings, rules, precedents, key="doc_id")
    return out.select("doc_id", F.sha2("prompt", 256).alias("prompt_hash"))
