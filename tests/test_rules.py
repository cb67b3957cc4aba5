"""The rule scan on example files."""

import pytest

from reviewlake.operators import rules

CASES = {
    "clean": ("from decimal import Decimal\ndef fee(a):\n    f = a * Decimal('0.5')\n    if not account.debit(f):\n        raise E\n", []),
    "fee": ("def calculate_fee(amount):\n    fee = amount * 0.025\n    return fee\n", [("001", 2)]),
    "cast": ("def f(balance, adjustment):\n    return balance + float(adjustment)\n", [("001", 2)]),
    "noqa": ("def f(balance, a):\n    return balance + float(a)  # noqa: AST-FIN-001\n", []),
    "marker": ("total = 1.5  # review: disable=all\n", []),
    "route": ('@router.post("/pay/process")\nasync def pay(payload):\n    pass\n', [("002", 2)]),
    "route_ok": ('@router.post("/pay/process")\nasync def pay(payload, idempotency_key: str):\n    pass\n', []),
    "route_kw": ('@router.put(path="/pay/v2/execute")\ndef run(a):\n    pass\n', [("002", 2)]),
    "route_get": ('@app.get("/users/profile")\ndef p(a):\n    pass\n', []),
    "multi_line_signature": (
        '@app.post(\n    "/refund",\n)\ndef refund(\n    a: int = Depends(idempotent),\n    b=None,\n):\n    pass\n', [("002", 4)]),
    "network": ("def s(db):\n    with db.begin():\n        requests.post(u)\n", [("003", 3)]),
    "network_before": ("def s(db):\n    requests.post(u)\n    with db.begin():\n        x = 1\n", []),
    "network_attr": ("with db.begin():\n    self.client.post(u)\n    stripe.Charge.create(x)\n", []),
    "debit": ("def s(account):\n    account.debit(5)\n", [("004", 2)]),
    "debit_await": ("async def s(account):\n    await account.debit(5)\n", [("004", 2)]),
    "debit_checked": ("def s(account):\n    if not account.debit(5):\n        raise E\n", []),
    "debit_try": ("def s(account):\n    try:\n        account.debit(5)\n    except E:\n        pass\n", []),
    "augmented": ("current_balance += 10.5\n", [("001", 1)]),
    "traps": ("account = 1.5\ndiscount = 0.5\npercent = 0.5\nx.balance = 1.5\n", [("001", 3)]),
    "defaults": ("def calculate(amount: float = 0.5 * 2, rate=1.5):\n    return amount * rate\n", []),
    "strings": ("s = 'fee = amount * 0.5'  # total * 0.5\nt = '''\nfee = 1.5\n'''\n", []),
    "two_operands": ("def fee(a):\n    return 0.5 * 0.3 + a\n", [("001", 2)]),
    "chain": ("def fee(a):\n    return a * 0.5 * 0.3 - 0.1\n", [("001", 2)] * 3),
    "nested_call": ("print(round(amount * 0.5, 2) + x)\n", [("001", 1)]),
    "three": (
        "def settle_fee(db, account, amount):\n    fee = amount * 0.02\n    with db.begin():\n        httpx.post(u)\n        account.debit(fee)\n",
        [("001", 2), ("003", 4), ("004", 5)]),
    "crlf": ("def fee(a):\r\n    return a * 0.5\r\n", [("001", 2)]),
    "tabs": ("def s(db):\n\twith db.begin():\n\t\trequests.post(u)\n\trequests.get(u)\n", [("003", 3)]),
}


@pytest.fixture(scope="module")
def result(spark):
    files = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "file_id string, source string")
    found = rules.find(files)
    by_file = {k: [] for k in CASES}
    for r in found.collect():
        by_file[r["file_id"]].append((r["rule_id"][-3:], r["line_start"]))
    status = {r["file_id"]: r for r in rules.scan_status(files, found).collect()}
    return by_file, status


@pytest.mark.parametrize("name", sorted(CASES))
def test_findings(result, name):
    assert sorted(result[0][name]) == sorted(CASES[name][1])


def test_status(result):
    status = result[1]
    assert status["clean"]["status"] == "CLEAN"
    assert status["fee"]["status"] == "PROCEED_TO_LLM" and status["fee"]["token_savings"] == 0
    assert status["three"]["status"] == "SHORT_CIRCUIT_CRITICAL" and status["three"]["token_savings"] == 250


def test_thousand_lines(spark):
    code = "".join(
        f"def step_{i}(x):\n    a = x + 1\n    b = a - 2\n    return b\n\n" for i in range(200)
    )
    files = spark.createDataFrame([(1, code)], "file_id long, source string")
    assert rules.find(files).count() == 0


DEEP = "f(g(h(i(j(1)))))"
LOST = {
    "deep_cast": (f"def fee(a):\n    return a * float({DEEP})\n", [("001", 2)]),
    "cast_in_cast": ("def fee(a):\n    return float(b(float(a * 0.5)))\n", [("001", 2)]),
    "deep_debit": (f"account.debit({DEEP})\n", [("004", 1)]),
    "deep_txn": (f"with db.begin({DEEP}):\n    requests.post(u)\n", [("003", 2)]),
    "grouped_with": ("with (open(p) as f, db.begin() as s):\n    requests.post(u)\n", [("003", 2)]),
    "no_txn_inside": ("with wrap(db.begin()):\n    requests.post(u)\n", []),
    "one_line_if": ("if ok: account.debit(5)\n", [("004", 1)]),
    "one_line_checked": ("if account.debit(5): pass\n", []),
    "semicolon": ("x = 1; account.debit(5); total = 1.5\n", [("001", 1), ("004", 1)]),
    "one_line_def": ("def calc_fee(a): b = 0.5; return a * 0.5\n", [("001", 1), ("001", 1)]),
    "one_line_try": ("try: account.debit(5)\nexcept E: deduct(2)\nelse: deduct(1)\n", []),
    "one_line_else": ("if a:\n    pass\nelse: deduct(1)\n", [("004", 3)]),
    "split_call": ("x = 1; account.debit(\n    5,\n    (6, [7]))\n", [("004", 1)]),
    "fstring": ("s = f'{balance * 0.5:.2f} and {{total * 1.5}}'\n", [("001", 1)]),
    "fstring_long": ('s = f"""\na {x}\nb {price + 0.25!r}\n"""\n', [("001", 3)]),
    "plain_string": ("s = '{balance * 0.5}'\n", []),
    "positional_guard": ('@app.post("/pay")\ndef pay(idempotency_key, /, a):\n    pass\n', [("002", 2)]),
    "keyword_guard": ('@app.post("/pay")\ndef pay(a, /, *, idempotency_key=f(g(h(i(1)))) / 2):\n    pass\n', []),
    "guard_in_default": ('@app.post("/pay")\ndef pay(a=Depends(f(g(h(idempotent))))):\n    pass\n', [("002", 2)]),
    "far_sign": ("def fee(a):\n    x =" + " " * 90 + "-0.5 * a\n    return b(" + " " * 90 + "-0.5)\n", []),
    "dict_colon": ("x = {'a': account.debit(5)}\n", []),
    "lambda_colon": ("y = lambda a: account.debit(a)\n", []),
}


@pytest.fixture(scope="module")
def once_lost(spark):
    files = spark.createDataFrame([(k, v[0]) for k, v in LOST.items()], "file_id string, source string")
    by_file = {k: [] for k in LOST}
    for r in rules.find(files).collect():
        by_file[r["file_id"]].append((r["rule_id"][-3:], r["line_start"]))
    return by_file


@pytest.mark.parametrize("name", sorted(LOST))
def test_nested_and_one_line_statements(once_lost, name):
    assert sorted(once_lost[name]) == sorted(LOST[name][1])
