"""Queries over the rule scan and the keyword tags.

Whole documents become Python sources: their text as docstring or as comments,
then one of the planted snippets. What each snippet must give is written next
to it, read off the rules' definitions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import lines as ln
from ..operators import rules as rl
from ..operators import tags as tg
from .base import pick, plant, query, quote, sql_pick, sql_plant, table, texts

F1, FA, F2, F3, F4 = "AST-FIN-001", "AST-FIN-001-ASSIGN", "AST-FIN-002", "AST-FIN-003", "AST-FIN-004"


class Case:
    """A snippet, its findings (text key, line, values), spans and depths.

    A finding's column is that of its line's first sign, if ``col`` does not say otherwise.
    """

    def __init__(self, code, findings=(), spans=(), depths=()):
        self.code, self.findings, self.spans, self.depths = code, findings, spans, depths


CASES = [
    Case("from decimal import Decimal\nfee = Decimal('0.5')\nok = account.debit(fee)"),
    Case(
        "def calculate_fee(amount):\n    fee = amount * 0.025\n    return fee",
        [(F1, 2, {"value": "0.025", "op": "*", "col": 10})],
        [("def", "calculate_fee", 1, None)],
        [(2, "calculate_fee", 0, 0), (3, "calculate_fee", 0, 0)],
    ),
    Case(
        "def add(balance, x):\n    return balance + float(x)",
        [(F1, 2, {"value": "float(...)", "op": "+", "col": 11})],
        [("def", "add", 1, None)],
        [(2, "add", 0, 0)],
    ),
    Case(
        "def add(balance, x):\n    return balance + float(x)  # noqa: AST-FIN-001\n",
        [], [("def", "add", 1, None)], [(2, "add", 0, 0)],
    ),
    Case(
        "current_balance += 10.5\ndiscount = 0.5\nrate: float = 1e-3\ntotal = -1.5\nself.balance = 2.5\npercent = 1.5  # review: disable=all",
        [(FA, 1, {"value": "10.5", "name": "current_balance"}), (FA, 3, {"value": "0.001", "name": "rate"})],
    ),
    Case(
        "def f(total, x):\n    log(total, x * 0.5)\n    y = (total + x) * 0.5\n    q = total * 0.5 ** 2\n    w = -0.5 * total\n    return round(\n        total *\n        0.25, 2)",
        [(F1, 3, {"value": "0.5", "op": "*", "col": 8}), (F1, 7, {"value": "0.25", "op": "*", "rows": 1})],
        [("def", "f", 1, None)],
        [(i, "f", 0, 0) for i in (2, 3, 4, 5, 6)],
    ),
    Case(
        "def settle(total):\n    z = total - 0.5 - 0.5\n    t = latency * 2.5",
        [(F1, 2, {"value": "0.5", "op": "-", "col": 8}), (F1, 2, {"value": "0.5", "op": "-", "col": 8}), (F1, 3, {"value": "2.5", "op": "*", "col": 8})],
        [("def", "settle", 1, None)],
        [(2, "settle", 0, 0), (3, "settle", 0, 0)],
    ),
    Case(
        '@app.post("/pay/process")\nasync def pay(\n    payload: dict,\n    rate: float = 1.5 * 2,\n):\n    pass',
        [(F2, 2, {"name": "/pay/process", "value": "pay", "rows": 3})],
        [("def", "pay", 2, None)],
        [(6, "pay", 0, 0)],
    ),
    Case(
        '@app.post("/pay/process")\ndef pay(payload, idempotency_key: str = Header(...)):\n    pass\n@app.get("/transfer")\ndef read(a):\n    pass',
        [], [("def", "pay", 2, 4), ("def", "read", 5, None)], [(3, "pay", 0, 0), (6, "read", 0, 0)],
    ),
    Case(
        '@app.route("/v1/Transfer", methods=["GET", "POST"])\n@cached\ndef move(a):\n    pass\n@api.put(path="/pay/v2/execute")\ndef run(a): pass\n@api.post("/users")\ndef user(a): pass',
        [(F2, 3, {"name": "/v1/Transfer", "value": "move"}), (F2, 6, {"name": "/pay/v2/execute", "value": "run"})],
        [("def", "move", 3, 5), ("def", "run", 6, 7), ("def", "user", 8, None)],
        [(4, "move", 0, 0)],
    ),
    Case(
        "def save(db):\n    requests.get(u)\n    with db.begin() as s:\n        requests.post(u)\n        stripe.Charge.create(x)\n        my_client.put(x)\n    requests.post(u)",
        [(F3, 4, {"name": "requests.post"}), (F3, 6, {"name": "my_client.put"})],
        [("def", "save", 1, None), ("txn", "", 3, 7)],
        [(2, "save", 0, 0), (3, "save", 0, 0), (4, "save", 1, 0), (5, "save", 1, 0), (6, "save", 1, 0), (7, "save", 0, 0)],
    ),
    Case(
        "async def charge(db):\n    async with db.transaction():\n        urllib.request.urlopen(u)\n        charge(1)\n        dispatch(2)\n        requests.post(u)  # noqa",
        [(F3, 3, {"name": "request.urlopen"}), (F3, 5, {"name": "dispatch"})],
        [("def", "charge", 1, None), ("txn", "", 2, None)],
        [(2, "charge", 0, 0), (3, "charge", 1, 0), (4, "charge", 1, 0), (5, "charge", 1, 0), (6, "charge", 1, 0)],
    ),
    Case(
        "def pay(account):\n    account.debit(10)\n    await account.withdraw(f(x))\n    if not account.debit(5):\n        pass\n    try:\n        account.debit(1)\n    except E:\n        deduct(2)\n    else:\n        deduct(3)\n    get(x).debit(4)\n    account.debit(5).commit()",
        [(F4, 2, {"name": "account.debit"}), (F4, 3, {"name": "account.withdraw"}), (F4, 12, {"name": "obj.debit"})],
        [("def", "pay", 1, None), ("try", "", 6, 8), ("try", "", 8, 10), ("try", "", 10, 12)],
        [(2, "pay", 0, 0), (3, "pay", 0, 0), (4, "pay", 0, 0), (5, "pay", 0, 0), (6, "pay", 0, 0), (7, "pay", 0, 1),
         (8, "pay", 0, 0), (9, "pay", 0, 1), (10, "pay", 0, 0), (11, "pay", 0, 1), (12, "pay", 0, 0), (13, "pay", 0, 0)],
    ),
    Case(
        "def settle_fee(db, account, amount):\n    fee = amount * 0.02\n    with transaction.atomic():\n        httpx.post(u)\n        account.debit(fee)",
        [(F1, 2, {"value": "0.02", "op": "*", "col": 10}), (F3, 4, {"name": "httpx.post"}), (F4, 5, {"name": "account.debit"})],
        [("def", "settle_fee", 1, None), ("txn", "", 3, None)],
        [(2, "settle_fee", 0, 0), (3, "settle_fee", 0, 0), (4, "settle_fee", 1, 0), (5, "settle_fee", 1, 0)],
    ),
    Case(
        "def deep_fee(account, a):\n    x = a * float(f(g(h(i(j(k(1)))))))\n    account.debit(f(g(h(i(j(k(1)))))))\n    with db.begin(f(g(h(i(j(k(1))))))):\n        requests.post(u)",
        [(F1, 2, {"value": "float(...)", "op": "*", "col": 8}), (F4, 3, {"name": "account.debit"}), (F3, 5, {"name": "requests.post"})],
        [("def", "deep_fee", 1, None), ("txn", "", 4, None)],
        [(2, "deep_fee", 0, 0), (3, "deep_fee", 0, 0), (4, "deep_fee", 0, 0), (5, "deep_fee", 1, 0)],
    ),
    Case(
        "def one(total, account):\n    if ok: account.debit(5)\n    x = 1; account.withdraw(5); total = 2.5\n    log(f'{total * 0.5:.2f}')",
        [(F4, 2, {"name": "account.debit", "col": 11}), (F4, 3, {"name": "account.withdraw", "col": 11}), (FA, 3, {"value": "2.5", "name": "total", "col": 32}),
         (F1, 4, {"value": "0.5", "op": "*", "col": 11})],
        [("def", "one", 1, None)],
        [(2, "one", 0, 0), (3, "one", 0, 0), (4, "one", 0, 0)],
    ),
    Case(
        "def g(total, x):\n    a = 0.5 + x * total\n    b = 1.5 * x + 0.25 - total\n    c = x * total * float(x) + 2.5\n    d = f(0.5 * x, total) * x, total[x * 0.5] * 3\n"
        "    e = (0.5) ** total | (lambda rate=0.5 * total: 1.5 << x)(total=x * 0.5)\n    é = 'ß'; h = 1 if x else total // 1_0.5e1",
        [(F1, 2, {"value": "0.5", "op": "+", "col": 8}), (F1, 4, {"value": "float(...)", "op": "*", "col": 8}), (F1, 4, {"value": "2.5", "op": "+", "col": 8}),
         (F1, 6, {"value": "0.5", "op": "**", "col": 8}), (F1, 7, {"value": "105.0", "op": "//", "col": 31})],
        [("def", "g", 1, None)],
        [(i, "g", 0, 0) for i in range(2, 8)],
    ),
]
SNIPPETS = [c.code for c in CASES]
_META = {r[0]: r for r in fv.RULES}


def _expected_rows():
    for i, case in enumerate(CASES):
        for key, line, values in case.findings:
            rule = key.removesuffix("-ASSIGN")
            message, fix = (t.format(**{"value": "", "name": "", "op": "", **values}) for t in fv.RULE_TEXTS[key])
            text = case.code.split("\n")[line - 1]
            yield i, rule, line, message, fix, values.get("col", len(text) - len(text.lstrip())), line + values.get("rows", 0)


def _values(rows, names) -> str:
    cell = lambda v: quote(v) if isinstance(v, str) or v is None else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows) + f") v({names})"


_SRC_SQL = f"""src AS (SELECT doc_id AS file_id, doc_id % {len(CASES)} AS c, length(text) - length(replace(text, chr(10), '')) + CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS skip,
   CASE WHEN doc_id % 2 = 0 THEN '\"\"\"' || replace(text, '\"', ' ') || chr(10) || '\"\"\"' || chr(10) ELSE '# ' || replace(text, chr(10), chr(10) || '# ') || chr(10) END
     || {sql_pick(SNIPPETS, 'doc_id')} AS source FROM documents)"""
_WANT_SQL = f"""{_SRC_SQL}, want AS (SELECT * FROM {_values(_expected_rows(), 'c, rule_id, line, message, suggested_fix, col_offset, line_to')}),
   findings AS (SELECT file_id, rule_id, CAST(line + skip AS INTEGER) AS line_start, CAST(line_to + skip AS INTEGER) AS line_end, col_offset, message, suggested_fix FROM src JOIN want USING (c))"""


def sources(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents")
    doc = F.concat(F.lit('"""'), F.replace("text", F.lit('"'), F.lit(" ")), F.lit('\n"""\n'))
    comment = F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# ")), F.lit("\n"))
    head = F.when(F.col("doc_id") % 2 == 0, doc).otherwise(comment)
    return docs.select(
        F.col("doc_id").alias("file_id"), F.concat(head, pick(SNIPPETS, F.col("doc_id"))).alias("source")
    )


_BREAKS = f"string_split(source, chr(10))"


@query(
    "lines",
    f"""WITH {_SRC_SQL}, l AS (SELECT file_id, CASE WHEN {_BREAKS}[-1] = '' THEN {_BREAKS}[1:len({_BREAKS}) - 1] ELSE {_BREAKS} END AS ls FROM src)
    SELECT file_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS text FROM l""",
)
def lines(spark, sf_dir):
    return ln.explode_lines(sources(spark, sf_dir)).select("file_id", F.col("line_no").cast("bigint").alias("line_no"), "text")


@query(
    "block_spans",
    f"""WITH {_SRC_SQL}, want AS (SELECT * FROM {_values(((i, *s) for i, c in enumerate(CASES) for s in c.spans), 'c, kind, name, a, b')})
    SELECT file_id, kind, name, CAST(a + skip AS BIGINT) AS line_start, coalesce(CAST(b AS BIGINT) + skip, -1) AS end_before FROM src JOIN want USING (c)""",
)
def block_spans(spark, sf_dir):
    out = ln.block_spans(sources(spark, sf_dir))
    return out.select(
        "file_id", "kind", "name", F.col("line_start").cast("bigint").alias("line_start"),
        F.coalesce("end_before", F.lit(-1)).cast("bigint").alias("end_before"),
    )


@query(
    "in_block",
    f"""WITH {_SRC_SQL}, want AS (SELECT * FROM {_values(((i, *d) for i, c in enumerate(CASES) for d in c.depths), 'c, line, fn, t, y')})
    SELECT file_id, CAST(line + skip AS BIGINT) AS line_start, fn AS function, CAST(t AS BIGINT) AS txn_depth, CAST(y AS BIGINT) AS try_depth FROM src JOIN want USING (c)""",
)
def in_block(spark, sf_dir):
    out = ln.in_block(sources(spark, sf_dir)).where(F.col("function").isNotNull())
    return out.select(
        "file_id", F.col("line_start").cast("bigint").alias("line_start"), "function", "txn_depth", "try_depth"
    )


def _rule_query(name, rule_id):
    sql = f"WITH {_WANT_SQL} SELECT file_id, line_start, line_end, col_offset, message, suggested_fix FROM findings WHERE rule_id = '{rule_id}'"

    @query(name, sql)
    def run(spark, sf_dir):
        found = rl.find(sources(spark, sf_dir)).where(F.col("rule_id") == rule_id)
        return found.select("file_id", "line_start", "line_end", "col_offset", "message", "suggested_fix")

    return run


for _name, _id in (
    ("rule_float", F1), ("rule_idempotency", F2), ("rule_net_in_txn", F3), ("rule_unchecked_debit", F4),
):
    _rule_query(_name, _id)


_STATUS_SQL = f"""{_WANT_SQL}, n AS (SELECT file_id, count(*) AS n, count(*) FILTER (rule_id <> '{F2}') AS crit FROM findings GROUP BY file_id)"""


@query(
    "scan_status",
    f"""WITH {_STATUS_SQL} SELECT file_id, coalesce(n, 0) AS findings_count, coalesce(crit, 0) AS critical_count,
      CASE WHEN crit >= 3 THEN 'SHORT_CIRCUIT_CRITICAL' WHEN n IS NULL THEN 'CLEAN' ELSE 'PROCEED_TO_LLM' END AS status,
      CASE WHEN crit >= 3 THEN greatest(250, CAST(floor(length(source) / 3.5) AS INTEGER)) ELSE 0 END AS token_savings FROM src LEFT JOIN n USING (file_id)""",
)
def scan_status(spark, sf_dir):
    src = sources(spark, sf_dir)
    return rl.scan_status(src, rl.find(src))


@query(
    "rule_meta",
    f"""WITH {_WANT_SQL}, r AS (SELECT * FROM {_values(fv.RULES, 'rule_id, rule_name, severity, category, description')})
    SELECT file_id, line_start, rule_id, rule_name, severity, category FROM findings JOIN r USING (rule_id)""",
)
def rule_meta(spark, sf_dir):
    return rl.find(sources(spark, sf_dir)).select("file_id", "line_start", "rule_id", "rule_name", "severity", "category")


@query(
    "findings_view",
    f"""WITH {_WANT_SQL}, r AS (SELECT * FROM {_values([x[:2] for x in fv.RULES], 'rule_id, rule_name')})
    SELECT file_id, rule_id AS id, 'TRANSACTION_ISOLATION' AS category, line_start, message AS summary, rule_name || ' - ' || message AS detailed_analysis, suggested_fix AS explanation
    FROM findings JOIN r USING (rule_id)""",
)
def findings_view(spark, sf_dir):
    out = rl.findings_view(rl.find(sources(spark, sf_dir)))
    return out.select(
        "file_id", "id", "category", F.col("line_range")[0].alias("line_start"), "summary", "detailed_analysis", "explanation"
    )


@query(
    "scan_records",
    f"""WITH {_WANT_SQL}, r AS (SELECT * FROM {_values([(x[0], x[2], x[3]) for x in fv.RULES], 'rule_id, severity, category')})
    SELECT file_id, severity, CASE WHEN category IN ({', '.join(quote(c) for c in fv.CATEGORIES)}) THEN category ELSE 'AST_SYNTAX' END AS category, 'app/main.py' AS file_path,
      line_start, line_start + 2 AS line_to, message AS summary FROM findings JOIN r USING (rule_id)""",
)
def scan_records(spark, sf_dir):
    """The scan's findings as finding records."""
    out = tg.scan_to_findings(rl.find(sources(spark, sf_dir)))
    return out.select(
        "file_id", "severity", "category", "file_path", F.col("line_range")[0].alias("line_start"),
        F.col("line_range")[1].alias("line_to"), "summary",
    )


NAMES = ["account", "discount", "percent", "recent", "generate", "Total_Fee", "items", "x", "latency_rate", "netting", ""]


@query(
    "fin_names",
    f"""WITH w AS (SELECT doc_id, unnest(list_distinct(string_split_regex(text, '[^A-Za-z_]+')) || [{sql_pick(NAMES, 'doc_id')}]) AS name FROM documents)
    SELECT doc_id, name, regexp_matches(lower(name), '{'|'.join(fv.FINANCIAL_KEYWORDS)}') AND NOT regexp_matches(lower(name), '{'|'.join(fv.NON_FINANCIAL_TOKENS)}') AS is_financial FROM w""",
)
def fin_names(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents")
    names = F.concat(F.array_distinct(F.split("text", "[^A-Za-z_]+", -1)), F.array(pick(NAMES, F.col("doc_id"))))
    return docs.select("doc_id", F.explode(names).alias("name")).withColumn(
        "is_financial", rl.is_financial(F.col("name"))
    )


REMARKS = [
    "x = 1", "x = 1  # noqa", "x = 1  # NOQA: ast-fin-001", "x = 1  # NOQA: AST-FIN-002", "noqa", "# review: disable=AST-FIN-001",
    "# Review: Disable=all", "# review: disable=AST-FIN-003", "x  #noqa",
]
_LOW = "lower(line)"


@query(
    "suppress",
    f"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
      n AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS line_no FROM s),
      d AS (SELECT doc_id, line_no, ls[line_no] || ' ' || {sql_pick(REMARKS, '(doc_id + line_no)')} AS line FROM n)
    SELECT doc_id, line_no, (contains({_LOW}, 'noqa') AND (contains({_LOW}, 'ast-fin-001') OR trim({_LOW}) = 'noqa' OR contains(line, '# noqa')))
      OR (contains({_LOW}, 'review: disable') AND (contains({_LOW}, 'ast-fin-001') OR contains({_LOW}, 'all'))) AS suppressed FROM d""",
)
def suppress(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    lines = lines.withColumn("line_no", (F.col("at") + 1).cast("bigint"))
    line = F.concat("line", F.lit(" "), pick(REMARKS, F.col("doc_id") + F.col("line_no")))
    return lines.select("doc_id", "line_no", rl.suppressed(line, F1).alias("suppressed"))


RISKS = [
    "nothing here", "wallet debit without lock", "wallet debit SELECT ... FOR UPDATE", "POST /v1/charge", "async with db: stripe.pay()",
    "float fee", "customer_PAN", "select * FROM x where template", "db.execute(card)", "balance -= 1",
]
# Payloads 0, 7, 14, ... have a finding of the category that stands first here.
_HAVE = [("IDEMPOTENCY", "a"), ("SECURITY_DLP", "SQL Injection in route"), ("LEDGER_INTEGRITY", "b")]


def _risk_sql() -> str:
    arms = []
    for category, severity, summary, groups, absent in [*fv.RISK_TAGS, fv.SQL_INJECTION_TAG]:
        conds = ["(" + " OR ".join(f"contains(t, {quote(w)})" for w in g) + ")" for g in groups]
        conds += [f"NOT contains(t, {quote(w)})" for w in absent]
        taken = "contains(h.summary, 'SQL Injection')" if summary == fv.SQL_INJECTION_TAG[2] else f"h.category = {quote(category)}"
        arms.append(
            f"SELECT doc_id, {quote(category)} AS category, {quote(severity)} AS severity, {quote(summary)} AS summary FROM p WHERE {' AND '.join(conds)} "
            f"AND NOT EXISTS (SELECT 1 FROM have h WHERE h.doc_id = p.doc_id AND {taken})"
        )
    return " UNION ALL ".join(arms)


@query(
    "risk_tags",
    f"""WITH p AS (SELECT doc_id, lower({sql_plant('text', RISKS, 'doc_id')}) AS t FROM documents),
      have AS (SELECT doc_id, ({[c for c, _ in _HAVE]})[doc_id % 3 + 1] AS category, ({[s for _, s in _HAVE]})[doc_id % 3 + 1] AS summary FROM documents WHERE doc_id % 7 = 0)
    {_risk_sql()}""",
)
def risk_tags(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents")
    payloads = docs.select("doc_id", plant(F.col("text"), RISKS, F.col("doc_id")).alias("sanitized"))
    have = table(spark, sf_dir, "documents").where("doc_id % 7 = 0").select(
        "doc_id",
        pick([c for c, _ in _HAVE], F.col("doc_id")).alias("category"),
        pick([s for _, s in _HAVE], F.col("doc_id")).alias("summary"),
    )
    return tg.tag_risks(payloads, key="doc_id", findings=have)
