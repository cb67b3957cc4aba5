"""Queries over feedback events, rule weights, scores and developer progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import growth as gr
from ..operators import retrieval as rt
from ..operators import scoring as sc
from ..operators import signatures as sg
from ..operators import weights as wt
from ..plans.work import new_dir, written
from ..sources import events as ev
from ..sources import keyed as kt
from ..sources import tables as tb
from .base import query, quote, table

# --- event data ---------------------------------------------------------------
# Driver events become feedback events. ``signup`` is no known type; every
# fifteenth user is a rule without a row in the rule table.

KINDS = {
    "error": "POST_DEPLOY_REVERT",
    "click": "DEV_REJECTED_FINDING",
    "purchase": "DEV_ACCEPTED_PATCH",
    "signup": "SIGNED_UP",
}
_KIND_SQL = (
    "CASE "
    + " ".join(f"WHEN event_type = {quote(a)} THEN {quote(b)}" for a, b in KINDS.items())
    + " WHEN event_id % 4 = 0 THEN 'CI_BUILD_FLAKINESS' ELSE 'DEV_REJECTED_FINDING' END"
)
_FEED_COLS = f"""'EVT-' || event_id AS id, {_KIND_SQL} AS event_type, 'org/repo' || (event_id % 7) AS repo_name,
   md5('c' || event_id) AS commit_sha, 'RULE-' || user_id AS rule_id, ts, event_id, user_id"""
FEED_SQL = f"feed AS (SELECT {_FEED_COLS} FROM events WHERE event_type <> 'signup')"
RULES_SQL = """rules AS (SELECT DISTINCT 'RULE-' || user_id AS rule_id, 'Rule ' || user_id AS rule_name,
   1.0 + (user_id % 5) * 0.5 AS base_weight, 1.0 + (user_id % 5) * 0.5 AS current_weight,
   (user_id % 4) * 0.05 AS ci_flakiness_correlation, CAST(user_id % 3 AS BIGINT) AS revert_count FROM events WHERE user_id % 15 <> 14)"""


def valid_feed(raw):
    """All driver events as feedback events; those of no known type are sorted out as rejected."""
    typed = raw.selectExpr(*[c.strip() for c in _split_columns(_FEED_COLS)])
    reason = ev.reject_reason(F.col("rule_id"), F.col("event_type"), F.lit(False))
    return ev.split_events(typed.withColumn("reject_reason", reason))[0]


def feed(spark, sf_dir):
    return valid_feed(table(spark, sf_dir, "events"))


def _split_columns(text: str) -> list[str]:
    """The select list cut at commas outside brackets."""
    out, depth, cur = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def rules(spark, sf_dir):
    return (
        table(spark, sf_dir, "events").where("user_id % 15 <> 14").select("user_id").distinct()
        .selectExpr(
            "'RULE-' || user_id AS rule_id", "'Rule ' || user_id AS rule_name",
            "CAST(1.0 + (user_id % 5) * 0.5 AS DOUBLE) AS base_weight",
            "CAST(1.0 + (user_id % 5) * 0.5 AS DOUBLE) AS current_weight",
            "CAST((user_id % 4) * 0.05 AS DOUBLE) AS ci_flakiness_correlation",
            "CAST(user_id % 3 AS BIGINT) AS revert_count",
        )
    )


_DELTA_SQL = "CASE " + " ".join(
    f"WHEN event_type = {quote(k)} THEN {v}" for k, v in wt.deltas().items()
) + " ELSE 0 END"
_FOLD = "list_reduce({list}, lambda a, x: least(50000, greatest(2000, a + x)), {start})"

# JSON lines with gaps and faults: cut text, no rule, unknown type, defaults left out.
_JSON_SQL = """CASE
   WHEN event_id % 50 = 0 THEN '{"event_type": "POST_DEPLOY_REVERT", "rule_id": "R'
   WHEN event_id % 50 = 1 THEN '{"event_type": "POST_DEPLOY_REVERT", "repo_name": "org/x"}'
   WHEN event_id % 50 < 10 THEN '{"event_type": "' || kind || '", "rule_id": "RULE-' || user_id || '"}'
   ELSE '{"id": "EVT-' || event_id || '", "event_type": "' || kind || '", "rule_id": "RULE-' || user_id
     || '", "repo_name": "org/repo' || (event_id % 7) || '", "pr_id": "' || (event_id % 100) || '", "details": ' || props || '}' END"""


@query(
    "events_validate",
    f"""WITH j AS (SELECT event_id, {_JSON_SQL.replace('kind', '(' + _KIND_SQL + ')')} AS line FROM events),
      p AS (SELECT event_id, line, CASE WHEN json_valid(line) THEN line ELSE '{{}}' END AS ok FROM j)
    SELECT event_id, coalesce(json_extract_string(ok, '$.event_type'), '') AS event_type, coalesce(json_extract_string(ok, '$.rule_id'), '') AS rule_id,
      coalesce(json_extract_string(ok, '$.repo_name'), 'org/payments') AS repo_name, coalesce(json_extract_string(ok, '$.pr_id'), '') AS pr_id,
      coalesce(json_extract_string(ok, '$.details.k'), '') AS k,
      CASE WHEN NOT json_valid(line) THEN 'unreadable' WHEN json_extract_string(ok, '$.rule_id') IS NULL OR json_extract_string(ok, '$.event_type') IS NULL THEN 'missing field'
        WHEN json_extract_string(ok, '$.event_type') NOT IN ({', '.join(quote(k) for k in fv.EVENT_FACTORS)}) THEN 'unknown event type' ELSE '' END AS reject_reason
    FROM p""",
)
def events_validate(spark, sf_dir):
    lines = table(spark, sf_dir, "events").withColumn("kind", F.expr(_KIND_SQL))
    lines = lines.select("event_id", F.expr(_JSON_SQL).alias("value"))
    parsed = ev.parse_events(lines)
    return parsed.select(
        "event_id",
        F.coalesce("event_type", F.lit("")).alias("event_type"),
        F.coalesce("rule_id", F.lit("")).alias("rule_id"),
        "repo_name",
        F.coalesce("pr_id", F.lit("")).alias("pr_id"),
        F.coalesce(F.element_at("details", "k"), F.lit("")).alias("k"),
        F.coalesce("reject_reason", F.lit("")).alias("reject_reason"),
    )


@query(
    "event_delta",
    f"WITH {FEED_SQL} SELECT id, rule_id, event_type, CAST({_DELTA_SQL} AS DOUBLE) / 10000 AS delta FROM feed",
)
def event_delta(spark, sf_dir):
    return wt.event_deltas(feed(spark, sf_dir)).select("id", "rule_id", "event_type", "delta")


_FOLDED_SQL = f"""{FEED_SQL}, {RULES_SQL},
  steps AS (SELECT rule_id, list({_DELTA_SQL} ORDER BY ts, id) AS ds FROM feed GROUP BY rule_id),
  folded AS (SELECT r.*, s.ds, CASE WHEN s.ds IS NULL THEN CAST(r.current_weight AS DOUBLE) ELSE
    CAST({_FOLD.format(list='s.ds', start='CAST(round(r.current_weight * 10000) AS INTEGER)')} AS DOUBLE) / 10000 END AS w
    FROM rules r LEFT JOIN steps s USING (rule_id))"""


@query(
    "weight_fold",
    f"WITH {_FOLDED_SQL} SELECT rule_id, CAST(current_weight AS DOUBLE) AS previous_weight, w AS current_weight FROM folded",
)
def weight_fold(spark, sf_dir):
    return wt.fold_weights(feed(spark, sf_dir), rules(spark, sf_dir)).select(
        "rule_id", "previous_weight", "current_weight"
    )


@query(
    "weight_history",
    f"""WITH {_FOLDED_SQL},
      n AS (SELECT f.id, f.rule_id, f.event_type, f.repo_name, r.ds, CAST(round(r.current_weight * 10000) AS INTEGER) AS w0,
        row_number() OVER (PARTITION BY f.rule_id ORDER BY f.ts, f.id) AS i FROM feed f JOIN folded r USING (rule_id)),
      s AS (SELECT *, CASE WHEN i = 1 THEN w0 ELSE {_FOLD.format(list='ds[1:i-1]', start='w0')} END AS a, {_FOLD.format(list='ds[1:i]', start='w0')} AS b FROM n)
    SELECT id, rule_id, CAST(a AS DOUBLE) / 10000 AS previous_weight, CAST(b AS DOUBLE) / 10000 AS updated_weight, CAST(b - a AS DOUBLE) / 10000 AS delta,
      event_type = 'POST_DEPLOY_REVERT' AS revert_incremented,
      CASE event_type {' '.join('WHEN ' + quote(k) + ' THEN replace(' + quote(m) + ", '{repo}', repo_name)" for k, m in fv.EVENT_MESSAGES.items())} END AS message
    FROM s""",
)
def weight_history(spark, sf_dir):
    return wt.weight_history(feed(spark, sf_dir), rules(spark, sf_dir)).drop(
        "ts", "event_type", "repo_name", "commit_sha"
    )


# Findings at all times of the events; a third of them are of one rule.
_DATED = """l_orderkey AS payload_id, l_linenumber AS finding_no, CASE WHEN l_orderkey % 3 = 0 THEN 'RULE-1' WHEN l_linenumber = 7 THEN NULL ELSE 'RULE-' || (l_partkey % 180) END AS rule_id,
   timestampadd(SECOND, CAST((l_orderkey * 7919 + l_linenumber * 104729) % 2700000 AS INTEGER), TIMESTAMP '2023-12-31 12:00:00') AS found_at"""
_DATED_SQL = _DATED.replace("timestampadd(SECOND, CAST(", "TIMESTAMP '2023-12-31 12:00:00' + to_seconds(CAST(").replace(
    " AS INTEGER), TIMESTAMP '2023-12-31 12:00:00')", " AS INTEGER))"
)


@query(
    "finding_weights",
    f"""WITH {_FOLDED_SQL}, dated AS (SELECT {_DATED_SQL} FROM lineitem),
      n AS (SELECT f.id, f.rule_id, f.ts, r.ds, CAST(round(r.current_weight * 10000) AS INTEGER) AS w0, row_number() OVER (PARTITION BY f.rule_id ORDER BY f.ts, f.id) AS i
        FROM feed f JOIN folded r USING (rule_id)),
      s AS (SELECT rule_id, ts, arg_max(CAST({_FOLD.format(list='ds[1:i]', start='w0')} AS DOUBLE) / 10000, i) AS w FROM n GROUP BY rule_id, ts),
      a AS (SELECT d.*, s.w FROM dated d ASOF LEFT JOIN s ON d.rule_id = s.rule_id AND d.found_at >= s.ts)
    SELECT payload_id, finding_no, a.rule_id, found_at, coalesce(a.w, CAST(r.current_weight AS DOUBLE), CAST({fv.DEFAULT_WEIGHT} AS DOUBLE)) AS weight
    FROM a LEFT JOIN rules r USING (rule_id)""",
)
def finding_weights(spark, sf_dir):
    dated = table(spark, sf_dir, "lineitem").selectExpr(*_split_columns(_DATED))
    return wt.weight_as_of(dated, feed(spark, sf_dir), rules(spark, sf_dir), time="found_at")


# Two keys that take turns, one longer than a block of the hash; a third is nobody's.
_TURN = "TIMESTAMP '2024-01-10'"
_KEYS = {
    "k1": ("md5('first')", "NULL", "TIMESTAMP '2024-01-12'"), "k2": ("repeat(md5('second'), 4)", _TURN, "NULL"),
    "kx": ("md5('third')", "TIMESTAMP '2034-01-01'", "NULL"),
}
_SIGNER = "CASE WHEN event_id % 8 IN (2, 3) THEN 'k2' WHEN event_id % 8 = 6 THEN 'kx' ELSE 'k1' END"
_PAD_SQL = """unhex(array_to_string([printf('%02x', xor({byte}, ('0x' || substr(rpad(hex(CASE WHEN octet_length(encode(key)) > 64 THEN unhex(sha256(key)) ELSE encode(key) END), 128, '0'), 2 * i + 1, 2))::INTEGER)) FOR i IN range(64)], ''))"""
_FIELD_SQL = " || ".join(
    f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("id", "{kind}", "repo_name", "commit_sha", "rule_id", "CAST(epoch_us(ts) AS VARCHAR)")
)


@query(
    "events_signed",
    f"""WITH {FEED_SQL}, keys AS (SELECT key_id, valid_from, valid_to, {_PAD_SQL.format(byte=0x36)} AS ipad, {_PAD_SQL.format(byte=0x5C)} AS opad FROM (VALUES
        {', '.join(f"('{k}', {a}, CAST({b} AS TIMESTAMP), CAST({c} AS TIMESTAMP))" for k, (a, b, c) in _KEYS.items())}) v(key_id, key, valid_from, valid_to)),
      m AS (SELECT *, {_SIGNER} AS signer, {_FIELD_SQL.format(kind='event_type')} AS message,
        {_FIELD_SQL.format(kind="CASE WHEN event_id % 8 = 1 THEN 'DEV_ACCEPTED_PATCH ' ELSE event_type END")} AS signed FROM feed),
      s AS (SELECT m.id, ts, event_id, sha256(opad || unhex(sha256(ipad || encode(signed)))) AS mac, signer FROM m JOIN keys ON signer = key_id),
      g AS (SELECT *, CASE event_id % 8 WHEN 0 THEN NULL WHEN 5 THEN ' ' WHEN 4 THEN upper(mac) ELSE 'sha256=' || mac END AS signature FROM s),
      c AS (SELECT g.*, min(k.key_id) FILTER (sha256(opad || unhex(sha256(ipad || encode(message)))) = replace(lower(signature), 'sha256=', '')) AS signed_by
        FROM g JOIN m USING (id) JOIN keys k ON (valid_from IS NULL OR valid_from <= g.ts) AND (valid_to IS NULL OR g.ts < valid_to) GROUP BY ALL)
    SELECT id, signature, signed_by, CASE WHEN trim(coalesce(signature, '')) = '' THEN 'unsigned' WHEN signed_by IS NULL THEN 'forged' ELSE 'valid' END AS signature_status FROM c""",
)
def events_signed(spark, sf_dir):
    """Every eighth event lacks a signature, one was changed after, one is by a key that is not valid."""
    keys = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("key_id"), *[F.expr(f"CAST({e} AS {t})").alias(n) for e, t, n in zip(v, ("BINARY", "TIMESTAMP", "TIMESTAMP"), ("key", "valid_from", "valid_to"))])
        for k, v in _KEYS.items()
    ])))
    rows = feed(spark, sf_dir).withColumn("key_id", F.expr(_SIGNER))
    kind = F.col("event_type")
    rows = rows.withColumns({"event_type": F.when(F.col("event_id") % 8 == 1, "DEV_ACCEPTED_PATCH ").otherwise(kind), "_kind": kind})
    rows = sg.sign(rows, keys).withColumn("event_type", F.col("_kind")).drop("_kind")
    turn, mac = F.col("event_id") % 8, F.col("signature")
    rows = rows.withColumn(
        "signature", F.when(turn == 5, " ").when(turn == 4, F.upper(F.substring(mac, 8, 64))).when(turn != 0, mac)
    )
    return sg.check_signatures(rows, keys).select("id", "signature", "signed_by", "signature_status")


@query(
    "rule_counters",
    f"""WITH {FEED_SQL}, {RULES_SQL}, n AS (SELECT rule_id, count(*) FILTER (event_type = 'CI_BUILD_FLAKINESS') AS ci,
        count(*) FILTER (event_type = 'POST_DEPLOY_REVERT') AS rv FROM feed GROUP BY rule_id)
    SELECT rule_id, CASE WHEN coalesce(ci, 0) = 0 THEN CAST(ci_flakiness_correlation AS DOUBLE) ELSE least(1.0, round(CAST(ci_flakiness_correlation AS DOUBLE) + ci * CAST(0.1 AS DOUBLE), 6)) END AS ci_flakiness_correlation,
      CAST(revert_count + coalesce(rv, 0) AS BIGINT) AS revert_count FROM rules LEFT JOIN n USING (rule_id)""",
)
def rule_counters(spark, sf_dir):
    return wt.rule_counters(feed(spark, sf_dir), rules(spark, sf_dir)).select(
        "rule_id", "ci_flakiness_correlation", "revert_count"
    )


_UNKNOWN_SQL = f"""unknown AS (SELECT rule_id, CAST(least(50000, greatest(2000, 10000 + arg_max(d, (ts, id)))) AS DOUBLE) / 10000 AS weight
   FROM (SELECT *, {_DELTA_SQL} AS d FROM feed) x WHERE rule_id NOT IN (SELECT rule_id FROM rules) GROUP BY rule_id)"""


@query("weight_unknown_rule", f"WITH {FEED_SQL}, {RULES_SQL}, {_UNKNOWN_SQL} SELECT rule_id, weight FROM unknown")
def weight_unknown_rule(spark, sf_dir):
    return wt.unknown_rule_weights(feed(spark, sf_dir), rules(spark, sf_dir))


@query(
    "ledger",
    f"""WITH {_FOLDED_SQL}, {_UNKNOWN_SQL}
    SELECT rule_id, w AS weight FROM folded WHERE ds IS NOT NULL UNION ALL SELECT rule_id, weight FROM unknown""",
)
def ledger(spark, sf_dir):
    return wt.ledger(feed(spark, sf_dir), rules(spark, sf_dir))


@query(
    "retro_entries",
    f"""WITH {_FOLDED_SQL},
      n AS (SELECT f.*, r.ds, CAST(round(r.current_weight * 10000) AS INTEGER) AS w0, row_number() OVER (PARTITION BY f.rule_id ORDER BY f.ts, f.id) AS i
        FROM feed f JOIN folded r USING (rule_id))
    SELECT 'REVERT-' || left(commit_sha, 8) AS id, 'Post-deploy revert on ' || repo_name || ' (commit ' || left(commit_sha, 8) || ') correlated with rule ' || rule_id
      || '. Weight elevated to ' || CAST({_FOLD.format(list='ds[1:i]', start='w0')} AS DOUBLE) / 10000 || '.' AS summary,
      'Prioritize ' || rule_id || ' in future AST and prompt grounding passes' AS first_action
    FROM n WHERE event_type = 'POST_DEPLOY_REVERT'""",
)
def retro_entries(spark, sf_dir):
    hist = wt.weight_history(feed(spark, sf_dir), rules(spark, sf_dir))
    return wt.retro_entries(hist).select("id", "summary", F.col("action_items")[0].alias("first_action"))


@query(
    "rules_ranked",
    f"WITH {_FOLDED_SQL} SELECT row_number() OVER (ORDER BY w DESC, rule_id) AS place, rule_id, w AS current_weight FROM folded",
)
def rules_ranked(spark, sf_dir):
    return wt.rank_rules(wt.fold_weights(feed(spark, sf_dir), rules(spark, sf_dir))).select("place", "rule_id", "current_weight")


# --- findings and scores --------------------------------------------------------

_SEV_SQL = "CASE WHEN l_returnflag = 'A' THEN 'critical' WHEN l_returnflag = 'R' THEN 'HIGH' WHEN l_linestatus = 'O' THEN 'Medium' WHEN l_linenumber % 2 = 0 THEN 'AUDIT_NOTE' ELSE 'note' END"
_CAT_SQL = "CASE l_linenumber % 6 " + " ".join(f"WHEN {i} THEN {quote(c)}" for i, c in enumerate(fv.CATEGORIES)) + " END"
_FIND_COLS = f"""l_orderkey AS payload_id, l_linenumber AS finding_no, {_SEV_SQL} AS severity, {_CAT_SQL} AS category"""
FINDINGS_SQL = f"findings AS (SELECT {_FIND_COLS} FROM lineitem)"
# Reviews of parts have no findings, so the left join has work to do.
REVIEWED_SQL = "reviewed AS (SELECT o_orderkey AS payload_id FROM orders UNION ALL SELECT -1 - p_partkey FROM part)"
_COUNTS_SQL = """counts AS (SELECT payload_id, count(*) FILTER (upper(severity) = 'CRITICAL') AS c, count(*) FILTER (upper(severity) = 'HIGH') AS h,
   count(*) FILTER (upper(severity) = 'MEDIUM') AS m, count(*) FILTER (upper(severity) NOT IN ('CRITICAL', 'HIGH', 'MEDIUM')) AS l,
   count(*) FILTER (upper(severity) IN ('LOW', 'AUDIT_NOTE')) AS shown FROM findings GROUP BY payload_id)"""


def findings(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*_split_columns(_FIND_COLS))


def reviewed(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("payload_id"))
    return orders.union(table(spark, sf_dir, "part").select((-1 - F.col("p_partkey")).alias("payload_id")))


@query(
    "severity_counts",
    f"WITH {FINDINGS_SQL}, {_COUNTS_SQL} SELECT payload_id, c AS critical_defects, h AS high_defects, m AS medium_defects, l AS low_defects, shown AS low_shown FROM counts",
)
def severity_counts(spark, sf_dir):
    return sc.severity_counts(findings(spark, sf_dir))


_GRADE = "CASE " + " ".join(f"WHEN s >= {sc.tenths(g[0])} THEN {{}}" for g in fv.GRADES) + " END"


@query(
    "quality_score",
    f"""WITH {FINDINGS_SQL}, {_COUNTS_SQL},
      {REVIEWED_SQL}, p AS (SELECT payload_id, coalesce(25 * c + 15 * h + 8 * m + 3 * l, 0) AS p FROM reviewed LEFT JOIN counts USING (payload_id)),
      q AS (SELECT *, greatest(10, least(100, 100 - p)) AS s FROM p)
    SELECT payload_id, CAST(p AS DOUBLE) / 10 AS penalty_points, CAST(s AS DOUBLE) / 10 AS score,
      {_GRADE.format(*[quote(g[1]) for g in fv.GRADES])} AS grade, {_GRADE.format(*[quote(g[2]) for g in fv.GRADES])} AS verdict FROM q""",
)
def quality_score(spark, sf_dir):
    return sc.rate(reviewed(spark, sf_dir), findings(spark, sf_dir)).select(
        "payload_id", "penalty_points", "score", "grade", "verdict"
    )


_RANK_SQL = "CASE upper(severity) " + " ".join(f"WHEN {quote(k)} THEN {v}" for k, v in fv.SEVERITY_RANK.items()) + " ELSE 2 END"


@query(
    "severity_filter",
    f"WITH {FINDINGS_SQL} SELECT payload_id, finding_no, severity FROM findings WHERE {_RANK_SQL} >= 3",
)
def severity_filter(spark, sf_dir):
    return sc.filter_severity(findings(spark, sf_dir), "high").select("payload_id", "finding_no", "severity")


@query(
    "gate",
    f"""WITH {FINDINGS_SQL}, {REVIEWED_SQL}, k AS (SELECT payload_id, count(*) AS n FROM findings WHERE {_RANK_SQL} >= 2 GROUP BY payload_id)
    SELECT payload_id, coalesce(n, 0) AS n_kept, coalesce(n, 0) > 0 AS blocked, CASE WHEN coalesce(n, 0) > 0 THEN 1 ELSE 0 END AS exit_code
    FROM reviewed LEFT JOIN k USING (payload_id)""",
)
def gate(spark, sf_dir):
    return sc.gate(reviewed(spark, sf_dir), findings(spark, sf_dir))


_FILES = """l_orderkey AS review_id, l_linenumber AS file_no, CAST(l_quantity AS BIGINT) AS n_findings, l_tax AS latency_ms, CAST(l_linenumber AS BIGINT) AS rules_fired,
   CASE l_returnflag WHEN 'A' THEN 'QUARANTINED' WHEN 'R' THEN 'REDACTED' ELSE 'CLEAN' END AS dlp_status"""


@query(
    "review_rollup",
    f"""WITH f AS (SELECT {_FILES} FROM lineitem)
    SELECT review_id, count(*) AS n_files, CAST(sum(n_findings) AS BIGINT) AS n_findings, round(sum(latency_ms), 2) AS latency_ms, CAST(sum(rules_fired) AS BIGINT) AS rules_fired,
      coalesce(arg_max(dlp_status, (file_no, dlp_status)) FILTER (dlp_status <> 'CLEAN'), 'CLEAN') AS dlp_status FROM f GROUP BY review_id""",
)
def review_rollup(spark, sf_dir):
    files = table(spark, sf_dir, "lineitem").selectExpr(*_split_columns(_FILES))
    return sc.rollup_reviews(files)


_META = "named_struct('dlp_status', 'CLEAN', 'redacted_entities', cast(array() as array<string>), 'latency_ms', 15.0D)"


@query(
    "findings_enrich",
    f"""WITH {FINDINGS_SQL} SELECT f.payload_id, finding_no, CASE WHEN o_orderstatus = 'F' THEN 'REDACTED' ELSE 'CLEAN' END AS dlp_status,
      CASE WHEN o_orderstatus = 'F' THEN 'CREDIT_CARD_NUMBER,' || o_orderpriority ELSE '' END AS entities, CAST(15.0 AS DOUBLE) AS latency_ms
    FROM findings f JOIN orders ON o_orderkey = f.payload_id""",
)
def findings_enrich(spark, sf_dir):
    pay = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS payload_id",
        "CASE WHEN o_orderstatus = 'F' THEN 'REDACTED' ELSE 'CLEAN' END AS dlp_status",
        "CASE WHEN o_orderstatus = 'F' THEN array('CREDIT_CARD_NUMBER', o_orderpriority) ELSE cast(array() as array<string>) END AS info_types",
    )
    out = sc.enrich_findings(findings(spark, sf_dir).withColumn("audit_metadata", F.expr(_META)), pay)
    return out.select(
        "payload_id", "finding_no", "audit_metadata.dlp_status",
        F.array_join("audit_metadata.redacted_entities", ",").alias("entities"), "audit_metadata.latency_ms",
    )


# --- sessions and growth ----------------------------------------------------------

_SESSION_COLS = """'S-' || event_id AS id, 'org/repo' || (event_id % 7) AS repo_name, left(md5('c' || event_id), 8) AS pr_id, md5('c' || event_id) AS commit_sha,
   'U-' || ((user_id * 7 + event_id) % 160) AS author_id, 'sha256:' || event_id AS payload_hash, CAST(event_id % 5 AS INTEGER) AS findings_count,
   CASE WHEN event_id % 9 = 0 THEN 'REDACTED' ELSE 'CLEAN' END AS dlp_status, CAST(event_id % 400 AS INTEGER) AS execution_duration_ms,
   CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(CAST(floor(value * 10) AS BIGINT) % 100 AS DOUBLE) / 10 END AS quality_score,
   'U-' || user_id AS user_id, CASE event_type WHEN 'view' THEN NULL WHEN 'error' THEN 'go' WHEN 'click' THEN 'java' ELSE 'python' END AS language, ts AS created_at"""
SESSIONS_SQL = f"sessions AS (SELECT {_SESSION_COLS} FROM events)"
_US_SQL = f"""{SESSIONS_SQL}, us AS (SELECT DISTINCT u AS "user", s.* EXCLUDE (quality_score, language), coalesce(language, 'python') AS language,
   CAST(round(CASE WHEN coalesce(quality_score, 0) = 0 THEN 10.0 ELSE quality_score END * 10) AS BIGINT) AS t
   FROM (SELECT *, unnest([user_id, author_id]) AS u FROM sessions) s)"""
_GROWTH_SQL = f"""{_US_SQL}, g AS (SELECT "user" AS user_id, count(*) AS total_reviews, CAST((sum(t) * 2 + count(*)) // (count(*) * 2) AS DOUBLE) / 10 AS average_score,
   CAST(arg_min(t, (created_at, id)) AS DOUBLE) / 10 AS initial_score, CAST(arg_max(t, (created_at, id)) AS DOUBLE) / 10 AS latest_score,
   CAST(arg_max(t, (created_at, id)) - arg_min(t, (created_at, id)) AS DOUBLE) / 10 AS improvement_delta FROM us GROUP BY "user"),
   gv AS (SELECT *, 'Tracked ' || total_reviews || ' reviews. Trajectory delta: ' || CASE WHEN improvement_delta >= 0 THEN '+' ELSE '' END || CAST(CAST(improvement_delta AS DECIMAL(9, 1)) AS VARCHAR) || ' points.' AS verdict FROM g)"""


def sessions(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(*_split_columns(_SESSION_COLS))


@query("user_growth", f"WITH {_GROWTH_SQL} SELECT * FROM gv")
def user_growth(spark, sf_dir):
    return gr.growth(sessions(spark, sf_dir))


@query(
    "improvement_pct",
    f"""WITH {_GROWTH_SQL} SELECT user_id, initial_score, latest_score, round((CAST(round(latest_score * 10) AS INTEGER) - CAST(round(initial_score * 10) AS INTEGER)) * 100.0::DOUBLE
      / greatest(1, CAST(round(initial_score * 10) AS INTEGER)), 2) AS improvement_pct FROM g""",
)
def improvement_pct(spark, sf_dir):
    return gr.improvement(sessions(spark, sf_dir))


@query(
    "user_growth_default",
    f"""WITH {_GROWTH_SQL} SELECT 'U-' || c_custkey AS user_id, coalesce(total_reviews, 0) AS total_reviews, coalesce(average_score, 10.0) AS average_score,
      coalesce(improvement_delta, 0.0) AS improvement_delta, coalesce(verdict, {quote(fv.NEW_USER_VERDICT)}) AS verdict
    FROM customer LEFT JOIN gv ON user_id = 'U-' || c_custkey""",
)
def user_growth_default(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("U-"), F.col("c_custkey").cast("string")).alias("user_id")
    )
    return gr.growth_for(asked, sessions(spark, sf_dir))


@query(
    "trajectory",
    f"""WITH {_US_SQL} SELECT "user", id, pr_id, created_at, CAST(t AS DOUBLE) / 10 AS quality_score, findings_count, language,
      row_number() OVER (PARTITION BY "user" ORDER BY created_at, id) AS seq FROM us""",
)
def trajectory(spark, sf_dir):
    return gr.trajectory(sessions(spark, sf_dir))


@query("lang_dist", f"""WITH {_US_SQL} SELECT "user", language, count(*) AS n FROM us GROUP BY ALL""")
def lang_dist(spark, sf_dir):
    return gr.language_distribution(sessions(spark, sf_dir))


@query(
    "recent_sessions",
    f"""WITH {_US_SQL}, r AS (SELECT "user", id, CAST(row_number() OVER (PARTITION BY "user" ORDER BY created_at DESC, id DESC) AS BIGINT) AS rank FROM us)
    SELECT * FROM r WHERE rank <= 6""",
)
def recent_sessions(spark, sf_dir):
    return gr.recent(sessions(spark, sf_dir)).select("user", "id", F.col("rank").cast("bigint").alias("rank"))


@query(
    "rolling_growth",
    f"""WITH {_US_SQL}, w AS (SELECT "user", id, t, row_number() OVER o AS seq, sum(t) OVER f AS st, count(*) OVER f AS n, lag(t) OVER o AS p FROM us
        WINDOW o AS (PARTITION BY "user" ORDER BY created_at, id), f AS (PARTITION BY "user" ORDER BY created_at, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT "user", seq, id, CAST((st * 2 + n) // (n * 2) AS DOUBLE) / 10 AS rolling_score, CAST(t - p AS DOUBLE) / 10 AS change FROM w""",
)
def rolling_growth(spark, sf_dir):
    return gr.rolling(sessions(spark, sf_dir))


@query(
    "defect_freq",
    f"WITH {FINDINGS_SQL} SELECT o_custkey AS user_id, category, count(*) AS n FROM findings JOIN orders ON o_orderkey = payload_id GROUP BY ALL",
)
def defect_freq(spark, sf_dir):
    owners = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("payload_id"), F.col("o_custkey").alias("user_id")
    )
    return gr.defect_frequency(findings(spark, sf_dir).join(owners, "payload_id"))


@query(
    "lookup",
    f"""WITH {SESSIONS_SQL} SELECT id, repo_name, pr_id, author_id, dlp_status, quality_score, coalesce(language, 'python') AS language
    FROM sessions WHERE id IN ('S-7', 'S-42', 'S-77777777')""",
)
def lookup(spark, sf_dir):
    """From the table as it is stored: of its folders only those of the ids are opened."""
    at = new_dir(spark, "sessions")
    kt.create(sessions(spark, sf_dir), at, "id")
    found = kt.lookup(spark, at, "id", ["S-7", "S-42", "S-77777777"])
    return found.select(
        "id", "repo_name", "pr_id", "author_id", "dlp_status", "quality_score",
        F.coalesce("language", F.lit("python")).alias("language"),
    )


# --- session and rule tables ---------------------------------------------------------


@query(
    "sessions_append",
    f"""WITH {SESSIONS_SQL}, old AS (SELECT * FROM sessions WHERE created_at < TIMESTAMP '2024-01-16'), new AS (SELECT * FROM sessions WHERE created_at >= TIMESTAMP '2024-01-15'),
      clash AS (SELECT id FROM new WHERE id IN (SELECT id FROM old))
    SELECT id, repo_name, 'stored' AS state FROM (SELECT id, repo_name FROM old UNION ALL SELECT id, repo_name FROM new WHERE id NOT IN (SELECT id FROM clash)) x
    UNION ALL SELECT id, repo_name, 'duplicate' FROM new WHERE id IN (SELECT id FROM clash)""",
)
def sessions_append(spark, sf_dir):
    """Stored by appends; the second half comes in with one day that is there already, and is refused as a whole."""
    all_rows, at = sessions(spark, sf_dir), new_dir(spark, "sessions")
    tb.append_sessions(all_rows.where("created_at < TIMESTAMP '2024-01-16'"), at)
    new = all_rows.where("created_at >= TIMESTAMP '2024-01-15'")
    fresh, clash = tb.split_duplicates(spark.read.parquet(at), new, "id")
    refused = written(clash.select("id", "repo_name", F.lit("duplicate").alias("state")), new_dir(spark, "refused"))
    try:
        tb.append_sessions(new, at)
    except ValueError:
        tb.append_sessions(written(fresh, new_dir(spark, "fresh")), at)
    return spark.read.parquet(at).select("id", "repo_name", F.lit("stored").alias("state")).unionByName(refused)


@query(
    "incidents_insert",
    "SELECT 'INC-' || page_id AS id, CASE WHEN page_id % 2 = 0 THEN 'FLOAT_PRECISION_DRIFT' ELSE 'OTHER' END AS bug_category, url AS pr_url, 768 AS n FROM pages",
)
def incidents_insert(spark, sf_dir):
    """A page is an incident; odd ones are inserted after the others, with their vectors."""
    rows = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("INC-"), F.col("page_id").cast("string")).alias("id"), "page_id",
        F.when(F.col("page_id") % 2 == 0, "FLOAT_PRECISION_DRIFT").otherwise("OTHER").alias("bug_category"), F.col("url").alias("pr_url"),
    )
    vectors = rt.embed(rows.select("id", F.col("pr_url").alias("text")), id_col="id", text_col="text")
    full, at = written(rows.join(vectors, "id"), new_dir(spark, "made")), new_dir(spark, "incidents")
    for odd in (0, 1):
        tb.append_sessions(full.where(F.col("page_id") % 2 == odd).drop("page_id"), at, partition="bug_category")
    return spark.read.parquet(at).select("id", "bug_category", "pr_url", F.size("embedding").alias("n"))


@query(
    "sessions_evolve",
    f"""WITH {SESSIONS_SQL} SELECT id, 10.0::DOUBLE AS quality_score, 'default_user' AS user_id, 'python' AS language FROM sessions WHERE id LIKE '%1'
    UNION ALL SELECT id, coalesce(quality_score, 10.0), user_id, coalesce(language, 'python') FROM sessions WHERE NOT id LIKE '%1'""",
)
def sessions_evolve(spark, sf_dir):
    all_rows = sessions(spark, sf_dir)
    old = all_rows.where("id LIKE '%1'").drop("quality_score", "user_id", "language")
    new = all_rows.where("NOT id LIKE '%1'")
    return tb.evolve_sessions(old, new).select("id", "quality_score", "user_id", "language")


_UPD = """'RULE-' || (o_custkey % 200) AS rule_id, 'Renamed ' || o_orderkey AS rule_name, o_totalprice AS current_weight, o_orderdate AS last_updated, o_orderkey AS input_order"""


@query(
    "rules_upsert",
    f"""WITH {RULES_SQL}, upd AS (SELECT {_UPD} FROM orders),
      last AS (SELECT rule_id, arg_max(rule_name, input_order) AS rule_name, arg_max(current_weight, input_order) AS current_weight FROM upd GROUP BY rule_id)
    SELECT rule_id, coalesce(l.rule_name, r.rule_name) AS rule_name, coalesce(CAST(r.base_weight AS DOUBLE), l.current_weight) AS base_weight,
      coalesce(l.current_weight, CAST(r.current_weight AS DOUBLE)) AS current_weight, coalesce(CAST(r.ci_flakiness_correlation AS DOUBLE), 0.0) AS ci_flakiness_correlation, coalesce(r.revert_count, 0) AS revert_count
    FROM rules r FULL JOIN last l USING (rule_id)""",
)
def rules_upsert(spark, sf_dir):
    updates = table(spark, sf_dir, "orders").selectExpr(*_split_columns(_UPD))
    return tb.upsert_rules(rules(spark, sf_dir), updates, order="input_order").drop("last_updated")


@query(
    "rules_upsert_stored",
    f"""WITH {RULES_SQL}, upd AS (SELECT {_UPD} FROM orders),
      last AS (SELECT rule_id, arg_max(rule_name, input_order) AS rule_name, arg_max(current_weight, input_order) AS current_weight FROM upd WHERE rule_id LIKE '%7' GROUP BY rule_id)
    SELECT rule_id, coalesce(l.rule_name, r.rule_name) AS rule_name, coalesce(CAST(r.base_weight AS DOUBLE), l.current_weight) AS base_weight,
      coalesce(l.current_weight, CAST(r.current_weight AS DOUBLE)) AS current_weight, coalesce(r.revert_count, 0) AS revert_count
    FROM rules r FULL JOIN last l USING (rule_id)""",
)
def rules_upsert_stored(spark, sf_dir):
    """Updates of every tenth rule, into the stored table and twice over; folders without one keep their files."""
    at = new_dir(spark, "rules")
    kt.create(rules(spark, sf_dir), at, "rule_id")
    updates = table(spark, sf_dir, "orders").selectExpr(*_split_columns(_UPD)).where("rule_id LIKE '%7'")
    updates = updates.withColumns({
        "base_weight": F.col("current_weight"), "ci_flakiness_correlation": F.lit(0.0), "revert_count": F.lit(0).cast("bigint"),
    })
    for _ in range(2):
        kt.upsert_stored(updates, at, "rule_id", ["rule_name", "current_weight"], order="input_order")
    return kt.stored(spark, at).select("rule_id", "rule_name", "base_weight", "current_weight", "revert_count")


@query(
    "seed_defaults",
    f"""WITH {RULES_SQL} SELECT 'filled' AS target, rule_id, CAST(current_weight AS DOUBLE) AS current_weight FROM rules
    UNION ALL SELECT 'empty', * FROM (VALUES {', '.join(f"({quote(i)}, CAST({w} AS DOUBLE))" for i, _, w in fv.SEED_RULES)}) v(a, b)""",
)
def seed_defaults(spark, sf_dir):
    have = rules(spark, sf_dir)
    none = have.where("rule_id = ''")
    seed = wt.seed_rules(spark)
    cols = ["rule_id", "current_weight"]
    return (
        tb.seed_if_empty(have, seed).select(F.lit("filled").alias("target"), *cols)
        .unionByName(tb.seed_if_empty(none, seed).select(F.lit("empty").alias("target"), *cols))
    )
