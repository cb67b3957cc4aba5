"""The four rules as predicates over statements with their enclosing blocks.

The scan is lexical: patterns over masked statements stand in for a syntax
tree. Every file is shuffled once; all rules read the same statement rows and
give their findings as arrays, which are exploded together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import contains_any, fixed
from .lines import in_block, pieces, top_level
from .operands import operations_of

_FIN = "|".join(fv.FINANCIAL_KEYWORDS)
_NOT_FIN = "|".join(fv.NON_FINANCIAL_TOKENS)
FINANCIAL = rf"(?is)^(?!.*(?:{_NOT_FIN})).*(?:{_FIN})"

_NUMBER = (
    r"(?<![\w.])(?:\d[\d_]*\.(?:\d[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?"
    r"|\d[\d_]*[eE][+-]?\d+)(?![\w.])"
)
MAY_FLOAT = rf"(?:{_NUMBER}|(?<![\w.])float\s*\()"
FLOAT = f"(?:{_NUMBER}|(?<![\\w.])float\\s*\\( *\\))"  # where the inside of brackets is blank

ASSIGN = (
    r"^\s*((?:[A-Za-z_]\w*\s*=\s*)*[A-Za-z_]\w*)\s*(?::[^=\n]+)?(?:=|\+=|-=|//=|\*\*=|\*=|/=|%=)\s*("
    + FLOAT + r")\s*$"
)
_METHODS = "|".join(sorted(fv.NETWORK_METHODS, key=len, reverse=True))
CALL_ON_NAME = rf"(?<![\w.)\]\"'])([A-Za-z_]\w*)\s*\.\s*({_METHODS})\s*\("
CALL_ON_REQUEST = rf"\.\s*request\s*\.\s*({_METHODS})\s*\("
BARE_CALL = rf"(?<![\w.)\]])(?<!def\s)({_METHODS})\s*\("
LONE_CALL = r"^\s*(?:await\s+)?((?:[\w.\s]|\( *\)|\[ *\])*?\.\s*)?(?:\b)([A-Za-z_]\w*)\s*\( *\)\s*$"
DECORATOR = r"^\s*@"
ROUTE = r"^\s*@[\w.]*\.(post|put|patch|route)\s*\("
PATH = r"""(?:\(|,|\b(?:path|rule)\s*=)\s*[rRuU]?["']([^"']*)["']"""
POST_METHODS = r"""methods\s*=\s*[\[({][^\])}]*["'](?:POST|PUT|PATCH)["']"""
GUARD_NAME = r"(?i)[(,]\s*\w*idempoten[ct]\w*\s*(?:[:=,]|\)?$)"


def is_financial(name: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike(FINANCIAL)


def suppressed(line: Column, rule_id: str, marker: str = fv.SUPPRESS_MARKER) -> Column:
    """An inline comment takes the rule out on its line."""
    low = F.lower(line)
    named = low.contains(rule_id.lower())
    noqa = low.contains("noqa") & (named | (F.trim(low) == "noqa") | line.contains("# noqa"))
    return noqa | (low.contains(marker) & (named | low.contains("all")))


def _fill(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        if "{" + name + "}" in template:
            out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def _finding(rule_id, line_start, line_end, col, line_text, text_key=None, **values) -> Column:
    """A finding; its column counts the bytes before it on its line, as compilers do."""
    message, fix = fv.RULE_TEXTS[text_key or rule_id]
    return F.struct(
        F.lit(rule_id).alias("rule_id"),
        line_start.cast("int").alias("line_start"),
        line_end.cast("int").alias("line_end"),
        F.octet_length(F.left(line_text, col)).cast("int").alias("col_offset"),
        _fill(message, **values).alias("message"),
        _fill(fix, **values).alias("suggested_fix"),
        line_text.alias("line_text"),
    )


def _float_text(literal: Column) -> Column:
    """A number as its value is printed; a cast as ``float(...)``."""
    number = F.regexp_replace(literal, "_", "").try_cast("double").cast("string")
    return F.when(literal.startswith("float"), "float(...)").otherwise(number)


def float_operations(stmts: DataFrame) -> DataFrame:
    """Add ``_ops``: the operations of every statement that holds a float and may be financial.

    An operation holds names of its statement only, so statements without a financial
    name outside financial functions are left out.
    """
    is_def = F.coalesce(F.col("kind") == "def", F.lit(False))
    names = F.regexp_extract_all("code", F.lit(r"([A-Za-z_]\w*)"), F.lit(1))
    financial = is_financial(F.when(is_def, F.col("name")).otherwise(F.col("function"))) | F.exists(names, is_financial)
    has = F.col("code").rlike(MAY_FLOAT) & financial
    out = fixed(stmts, _float_code=F.when(has, F.col("code")))
    return fixed(out, _ops=operations_of(F.col("_float_code"), is_def)).drop("_float_code")


def _rule_float(s: dict[str, Column]) -> Column:
    fin_function = is_financial(F.when(s["kind"].eqNullSafe("def"), s["name"]).otherwise(s["function"]))
    hits = F.filter("_ops", lambda o: fin_function | F.exists(o["names"], is_financial))

    def operation(o: Column) -> Column:
        first, last = F.get(s["parts"], o["row"]), F.get(s["parts"], o["row_end"])
        return _finding("AST-FIN-001", first["line_no"], last["line_no"], o["col"], first["text"], value=o["value"], op=o["op"])

    targets = lambda p: F.split(
        F.regexp_replace(F.regexp_extract(p["top"], ASSIGN, 1), r"\s", ""), "=", -1
    )
    may = s["code"].rlike(rf"=\s*{MAY_FLOAT}")
    assigned = F.filter(
        F.when(may, s["pieces"]).otherwise(F.array().cast(_PIECES)),
        lambda p: p["top"].rlike(ASSIGN) & (fin_function | F.exists(targets(p), is_financial)),
    )

    def assignment(p: Column) -> Column:
        part = F.get(s["parts"], p["row"])
        return _finding(
            "AST-FIN-001", part["line_no"], s["line_end"], p["col"], part["text"], "AST-FIN-001-ASSIGN",
            value=_float_text(F.regexp_extract(p["top"], ASSIGN, 2)), name=F.array_join(targets(p), ", "),
        )

    return F.concat(F.transform(hits, operation), F.transform(assigned, assignment))


def _rule_idempotency(s: dict[str, Column]) -> Column:
    flat = F.regexp_replace(s["code"], "\n", " ")
    top = F.when((s["kind"] == "def") & s["route.group"].isNotNull(), top_level(flat))
    # the parameters stand in the first brackets; with what nests in them blank, only
    # names are left before : = , and those before a lone / cannot be named by a caller
    start = F.length(F.regexp_extract(top, r"^[^(]*\(", 0))
    args = F.substr(flat, start + 1, F.length(F.regexp_extract(top, r"^[^(]*\( *", 0)) - start)
    inside = F.concat(F.lit("("), top_level(args), F.lit(")"))
    guarded = F.regexp_replace(inside, r"^\(.*,\s*/\s*(?=[,)])", "(").rlike(GUARD_NAME)
    hit = (s["kind"] == "def") & (s["route.group"] == s["group"]) & ~guarded
    one = _finding(
        "AST-FIN-002", s["line_start"], F.coalesce(s["block_end"], s["line_end"]), _lead(s["parts"][0]["code"]), s["parts"][0]["text"],
        name=s["route.path"], value=s["name"],
    )
    return F.when(hit, F.array(one)).otherwise(F.array().cast(_ARRAY))


def _rule_network(s: dict[str, Column]) -> Column:
    in_txn = (s["txn_depth"] > 0) | (s["kind"] == "txn")

    def found(code: Column, pattern: str, name) -> Column:
        """Name and place of every call that the pattern matches."""
        gaps, hits = F.split(code, pattern, -1), F.regexp_extract_all(code, F.lit(f"({pattern})"), F.lit(1))
        width = lambda texts, n: F.aggregate(F.slice(texts, F.lit(1), n), F.lit(0), lambda w, x: w + F.length(x))

        def one(hit: Column, i: Column) -> Column:
            # what is called may be an attribute of what stands before
            chain = F.length(F.regexp_extract(F.get(gaps, i), r"[\w.]*$", 0)) if pattern is CALL_ON_REQUEST else F.lit(0)
            return F.struct(name(hit).alias("name"), (width(gaps, i + 1) + width(hits, i) - chain).alias("col"))

        return F.transform(hits, one)

    def calls(part: Column) -> Column:
        code, bare = part["code"], lambda hit: F.regexp_extract(hit, BARE_CALL, 1)
        owner = lambda c: F.element_at(F.split(c["name"], r"\."), 1)
        named = F.filter(
            found(code, CALL_ON_NAME, lambda hit: F.concat_ws(".", F.regexp_extract(hit, CALL_ON_NAME, 1), F.regexp_extract(hit, CALL_ON_NAME, 2))),
            lambda c: owner(c).isin(fv.NETWORK_MODULES) | contains_any(F.lower(owner(c)), ["client", "session"]),
        )
        requested = found(
            code, CALL_ON_REQUEST, lambda hit: F.concat(F.lit("request."), F.regexp_extract(hit, CALL_ON_REQUEST, 1))
        )
        alone = F.filter(
            found(code, BARE_CALL, bare), lambda c: (c["name"] == "urlopen") | ~c["name"].eqNullSafe(s["function"])
        )
        return F.transform(
            F.concat(named, requested, alone),
            lambda c: _finding("AST-FIN-003", part["line_no"], s["line_end"], c["col"], part["text"], name=c["name"]),
        )

    return F.when(in_txn, F.flatten(F.transform(s["parts"], calls))).otherwise(F.array().cast(_ARRAY))


def _rule_debit(s: dict[str, Column]) -> Column:
    method = lambda p: F.regexp_extract(p["top"], LONE_CALL, 2)
    may = contains_any(F.lower(s["code"]), fv.DEBIT_NAMES) & (s["try_depth"] == 0) & ~s["of_try"]
    hits = F.filter(
        F.when(may, s["pieces"]).otherwise(F.array().cast(_PIECES)), lambda p: F.lower(method(p)).isin(fv.DEBIT_NAMES)
    )

    def one(p: Column) -> Column:
        part = F.get(s["parts"], p["row"])
        receiver = F.regexp_replace(F.regexp_extract(p["top"], LONE_CALL, 1), r"\s", "")
        owner = F.regexp_extract(receiver, r"(\w+)\.$", 1)
        name = (
            F.when(receiver == "", method(p))
            .when(owner == "", F.concat(F.lit("obj."), method(p)))
            .otherwise(F.concat_ws(".", owner, method(p)))
        )
        return _finding("AST-FIN-004", part["line_no"], s["line_end"], p["col"], part["text"], name=name)

    return F.transform(hits, one)


def _lead(code: Column) -> Column:
    """Number of blanks that a line begins with."""
    return F.length(F.regexp_extract(code, r"^\s*", 0))


_PIECES = "array<struct<code:string,top:string,row:int,col:int>>"
_ARRAY = (
    "array<struct<rule_id:string,line_start:int,line_end:int,col_offset:int,message:string,suggested_fix:string,line_text:string>>"
)


def worth_scanning(source: Column, low: Column) -> Column:
    """What the findings of each rule need somewhere in the file; ``low`` is the source in lower case."""
    floats = source.rlike(r"\d[.eE]|\.\d|float\s*\(") & contains_any(low, fv.FINANCIAL_KEYWORDS)
    route = source.contains("@") & contains_any(low, fv.PAYMENT_SEGMENTS)
    network = contains_any(source, fv.TRANSACTION_NAMES) & contains_any(source, fv.NETWORK_METHODS)
    return floats | route | network | contains_any(low, fv.DEBIT_NAMES)


def routes(stmts: DataFrame) -> DataFrame:
    """Put the last payment route above a statement into ``route`` (group, path)."""
    raw = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    is_dec = F.col("code").rlike(DECORATOR)
    paths = F.filter(
        F.regexp_extract_all(raw, F.lit(PATH), F.lit(1)),
        lambda p: contains_any(F.lower(p), fv.PAYMENT_SEGMENTS),
    )
    verb = F.regexp_extract(F.col("code"), ROUTE, 1)
    mutates = (verb != "") & ((verb != "route") | F.upper(raw).rlike(f"(?i){POST_METHODS}"))
    path = F.when(is_dec & mutates, F.try_element_at(paths, F.lit(-1)))
    w = Window.partitionBy("file_id").orderBy("stmt")
    # A decorator shares its group with the next statement that is none.
    group = F.sum((~F.col("_dec")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = stmts.withColumns({"_dec": is_dec, "_path": path})
    out = out.withColumn("group", F.coalesce(group, F.lit(0)))
    last = F.last(
        F.when(F.col("_path").isNotNull(), F.struct(F.col("group"), F.col("_path").alias("path"))), ignorenulls=True
    ).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("route", last).drop("_dec", "_path")


def find(files: DataFrame, *, source_col="source", marker: str = fv.SUPPRESS_MARKER) -> DataFrame:
    """All findings of a table of files (``file_id``, source), without suppressed ones."""
    # a filter works out again what it names: the source and its lower case stand fixed before it
    texts = fixed(files.select("file_id", source_col), **{source_col: F.col(source_col)})
    texts = fixed(texts, _low=F.lower(source_col))
    worth = texts.where(worth_scanning(F.col(source_col), F.col("_low"))).drop("_low")
    stmts = float_operations(routes(in_block(worth, source_col=source_col)))
    parted = F.col("code").rlike(MAY_FLOAT) | contains_any(F.lower("code"), fv.DEBIT_NAMES)
    stmts = fixed(stmts, pieces=F.when(parted, pieces(F.col("code"))))
    in_txn = (F.col("txn_depth") > 0) | (F.col("kind") == "txn")
    guarded = (F.col("kind") == "def") & F.col("route").isNotNull()
    stmts = stmts.where((F.size("_ops") > 0) | F.col("pieces").isNotNull() | F.coalesce(in_txn | guarded, F.lit(False)))
    s = {c: F.col(c) for c in stmts.columns} | {
        "route.group": F.col("route.group"), "route.path": F.col("route.path"),
        "block_end": F.lit(None).cast("int"),
    }
    found = F.concat(_rule_float(s), _rule_idempotency(s), _rule_network(s), _rule_debit(s))
    rows = stmts.select("file_id", F.inline(found))
    keep = ~_any_suppressed(marker)
    return attach_rules(rows.where(keep).drop("line_text"))


def _any_suppressed(marker: str) -> Column:
    chain = F.lit(False)
    for rule in fv.RULES:
        chain = chain | ((F.col("rule_id") == rule[0]) & suppressed(F.col("line_text"), rule[0], marker))
    return chain


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        fv.RULES, "rule_id string, rule_name string, severity string, category string, description string"
    )


def attach_rules(findings: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Name, severity and category of the rule. The built-in registry has four rows."""
    table = F.broadcast(rule_table(findings.sparkSession)) if table is None else table
    return findings.join(table.drop("description"), "rule_id", "left")


def scan_status(files: DataFrame, findings: DataFrame, *, source_col="source", threshold=fv.SHORT_CIRCUIT_CRITICALS) -> DataFrame:
    """Status per file and the tokens saved where the scan alone decides."""
    counts = findings.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("severity") == "CRITICAL").alias("_c")
    )
    n, c = F.coalesce("_n", F.lit(0).cast("bigint")), F.coalesce("_c", F.lit(0).cast("bigint"))
    short = c >= threshold
    saved = F.greatest(
        F.lit(fv.MIN_TOKEN_SAVINGS), F.floor(F.col("_len") / fv.CHARS_PER_TOKEN).cast("int")
    )
    slim = files.select("file_id", F.length(source_col).alias("_len"))
    return slim.join(counts, "file_id", "left").select(
        "file_id",
        n.alias("findings_count"),
        c.alias("critical_count"),
        F.when(short, "SHORT_CIRCUIT_CRITICAL").when(n == 0, "CLEAN").otherwise("PROCEED_TO_LLM").alias("status"),
        F.when(short, saved).otherwise(0).alias("token_savings"),
    )


def findings_view(findings: DataFrame) -> DataFrame:
    """The printed form, with its own coarse category labels."""
    label = F.when(F.col("rule_id").contains("IDEM"), "IDEMPOTENCY").otherwise("TRANSACTION_ISOLATION")
    return findings.select(
        "file_id",
        F.col("rule_id").alias("id"),
        "severity",
        label.alias("category"),
        F.array("line_start", "line_end").alias("line_range"),
        F.col("message").alias("summary"),
        F.concat_ws(" - ", "rule_name", "message").alias("detailed_analysis"),
        F.col("suggested_fix").alias("explanation"),
    )
