"""The operand fold against Python's own syntax tree, on made-up expressions."""

import ast
import random
import warnings

import pytest

from reviewlake.operators.operands import operations

SIGNS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.FloorDiv: "//", ast.Mod: "%", ast.Pow: "**"}


def by_tree(code):
    out = []

    def as_float(node):
        if isinstance(node, ast.Constant):
            return str(node.value) if isinstance(node.value, float) else None
        return "float(...)" if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == "float" else None

    class Visitor(ast.NodeVisitor):
        def visit_arguments(self, node):
            pass

        def visit_BinOp(self, node):
            value = as_float(node.left) or as_float(node.right)
            if value is not None:
                names = tuple(sorted({n.id for n in ast.walk(node) if isinstance(n, ast.Name)}))
                out.append((node.lineno - 1, node.col_offset, node.end_lineno - 1, value, SIGNS.get(type(node.op), "arithmetic"), names))
            self.generic_visit(node)

    Visitor().visit(ast.parse(code))
    return sorted(out)


class Maker:
    def __init__(self, seed):
        self.rng = random.Random(seed)

    def atom(self, d):
        e, r = self.expr, self.rng.random()
        if r < 0.3 or not d:
            return self.rng.choice(["0.5", "1.25e-3", "2.", "1_0.5", ".5", "3", "0x1f", "2j", "1e3", "total", "x", "obj.total", "...", "None", "'  '"])
        forms = [
            lambda: f"float({e(d - 1)})", lambda: f"f({e(d - 1)}, total={e(d - 1)}, *{self.atom(d - 1)})", lambda: f"({e(d - 1)})",
            lambda: f"[{e(d - 1)}, {e(d - 1)}]", lambda: f"x[{e(d - 1)}:{e(d - 1)}]", lambda: f"{{{e(d - 1)}: {e(d - 1)}}}",
            lambda: f"({e(d - 1)} for i in {e(d - 1)} if {e(d - 1)})", lambda: f"(lambda a, *b, c=0.5*total: {e(d - 1)})",
            lambda: f"({e(d - 1)},)", lambda: f"(y := {e(d - 1)})", lambda: f"a.b({e(d - 1)}).c",
        ]
        return self.rng.choice(forms)()

    def expr(self, d):
        r = self.rng.random()
        if r < 0.45 and d:
            op = self.rng.choice(["+", "-", "*", "/", "//", "%", "**", "|", "&", "^", "<<", ">>", "@", "+", "*"])
            return f"{self.expr(d - 1)}{self.rng.choice([' ', ''])} {op}{self.rng.choice([' ', ''])}{self.expr(d - 1)}"
        if r < 0.55 and d:
            return self.rng.choice(["-", "+", "~", "- "]) + self.expr(d - 1)
        if r < 0.62 and d:
            return f"({self.expr(d - 1)}{self.rng.choice([' and ', ' or ', ' < ', ' == ', ' in ', ' is not '])}{self.expr(d - 1)})"
        if r < 0.66 and d:
            return f"({self.expr(d - 1)} if {self.expr(d - 1)} else {self.expr(d - 1)})"
        return self.atom(d)


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_syntax_tree(seed):
    maker, n = Maker(seed), 0
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        while n < 1500:
            form = maker.rng.choice(["x = %s", "total += %s", "y: int = %s", "print(%s)[0]", "if %s: z = 1", "(\n  %s\n)", "return_(a,\n%s)"])
            code = form % maker.expr(4)
            try:
                want = by_tree(code)
            except SyntaxError:
                continue
            n += 1
            got = sorted((o["row"], o["col"], o["row_end"], o["value"], o["op"], tuple(sorted(set(o["names"])))) for o in operations(code))
            assert got == want, code


@pytest.mark.parametrize("code", ["", ")", "((", "a +", "* 0.5", "0.5 * (", "lambda", "total * 0.5)", "x[", "'", "def f(a=0.5 * total", "0.5 ** -", "@", "a 0.5 * b }"])
def test_broken_code_ends(code):
    operations(code)
    operations(code, signature=True)


def test_a_signature_does_not_count():
    code = "def fee(a=0.5 * 2, b: float = {1: 2.5 * 3}[1]) -> x: return a * 0.5"
    assert [(o["value"], o["op"]) for o in operations(code, signature=True)] == [("0.5", "*")]
    assert len(operations(code)) == 3


def test_deep_nesting():
    assert operations("(" * 100_000 + "0.5 * 2") == []
    code = "x = " + "(" * 150 + "total * 0.5" + ")" * 150
    assert [o["value"] for o in operations(code)] == ["0.5"]
