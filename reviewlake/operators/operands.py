"""Binary operations of a statement with their operands, for the few statements that may need them.

The statement's masked code becomes a list of tokens, and one pass over the list folds
operators by precedence. What is kept of an operation: where it starts and ends, its
operator, the names in it, and the float among its two operands, if one is.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""(?P<float>(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d[\d_]*)?(?![\w.])|\d[\d_]*\.(?:[eE][+-]?\d[\d_]*)?(?![\w.])|\d[\d_]*[eE][+-]?\d[\d_]*(?![\w.]))
    |(?P<number>\.?\d[\w.]*)|(?P<name>[^\W\d]\w*)|(?P<string>"[^"\n]*"|'[^'\n]*')|(?P<ellipsis>\.\.\.)
    |(?P<other>\*\*=|//=|>>=|<<=|\*\*|//|<<|>>|:=|->|[-+*/%@&|^<>=!]=|[^\s\\])""",
    re.X,
)
# How strongly operators bind; the right side of a power may have a sign.
BINDS = {"|": 1, "^": 2, "&": 3, "<<": 4, ">>": 4, "+": 5, "-": 5, "*": 6, "/": 6, "//": 6, "%": 6, "@": 6, "**": 8}
SIGN = 7
CLOSE = {"(": ")", "[": "]", "{": "}"}
WORDS = {
    "and", "or", "not", "if", "elif", "else", "return", "in", "is", "for", "while", "await", "yield", "lambda", "assert", "del", "raise",
    "from", "import", "with", "as", "except", "async", "def", "class", "global", "nonlocal", "pass", "break", "continue", "None", "True", "False",
}
RESULT = "array<struct<row:int,col:int,row_end:int,value:string,op:string,names:array<string>>>"
CAST = "float(...)"
SIGNS = ("+", "-", "*", "/", "//", "%", "**")  # all other operators are just called arithmetic


class _Fold:
    """Tokens of one statement: kind, text, place."""

    def __init__(self, code: str):
        self.tokens = [(m.lastgroup, m.group(), m.start(), m.end()) for m in TOKEN.finditer(code)]
        self.at, self.found, self.parameters = 0, [], set()

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else ""

    def stretch(self, close: str) -> int:
        """Everything up to the closing bracket: expressions and what stands between them. Their number, 2 for more."""
        parts, plain = 0, True
        while self.at < len(self.tokens) and self.peek() != close:
            kind, text = self.tokens[self.at][:2]
            if text == "lambda":
                self._parameters()
                plain = False
            elif kind == "other" and text not in CLOSE and text not in "+-~" or text in WORDS and text not in ("None", "True", "False", "await"):
                plain = False
                self.at += 1
            else:
                self.last = self.expression(0)
                parts += 1
        self.at += 1
        return parts if plain else 2

    def _parameters(self) -> None:
        """Skip the parameters of a lambda, defaults included."""
        depth = 0
        while self.at < len(self.tokens) and (depth or self.peek() != ":"):
            depth += (self.peek() in CLOSE) - (self.peek() in ")]}")
            if depth < 0:
                return
            before = self.at - 2 if self.tokens[self.at - 1][1] in ("*", "**") else self.at - 1
            if not depth and self.tokens[self.at][0] == "name" and self.tokens[before][1] in ("lambda", ","):
                self.parameters.add(self.at)
            self.at += 1

    def expression(self, least: int):
        """Fold an expression of operators that bind more than ``least``; the float it is, if it is one."""
        first = self.at
        value = self.operand()
        while BINDS.get(self.peek(), 0) > least:
            op = self.peek()
            self.at += 1
            if self.at >= len(self.tokens) or self.peek() in ")]}":
                return None
            right = self.expression(SIGN - 1 if op == "**" else BINDS[op])
            self.found.append((first, self.at, op, value or right))
            value = None
        return value

    def operand(self):
        if self.at >= len(self.tokens):
            return None
        kind, text = self.tokens[self.at][:2]
        self.at += 1
        if text in ("+", "-", "~"):
            self.expression(SIGN)
            return None
        if text == "await":
            self.operand()
            return None
        value, name = None, text
        if kind == "float":
            value = str(float(text.replace("_", "")))
        elif text in CLOSE:
            self.last = None
            parts = self.stretch(CLOSE[text])
            value, name = (self.last if text == "(" and parts == 1 else None), ""
        elif kind != "name":
            name = ""
        while self.at < len(self.tokens):
            if self.peek() in ("(", "[") and kind != "number":
                cast = name == "float" and self.peek() == "("
                close = CLOSE[self.peek()]
                self.at += 1
                self.stretch(close)
                value, name = (CAST if cast else None), ""
            elif self.peek() == "." and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][0] == "name":
                self.at += 2
                value, name = None, ""
            else:
                break
        return value

    def names(self, first: int, last: int) -> list[str]:
        """Names between two tokens, without attributes and the keywords of arguments."""
        out = []
        for i in range(first, min(last, len(self.tokens))):
            kind, text = self.tokens[i][:2]
            if kind == "name" and text not in WORDS and i not in self.parameters and not (i and self.tokens[i - 1][1] == "."):
                if not (i > first and i + 1 < last and self.tokens[i + 1][1] == "=" and self.tokens[i - 1][1] in ("(", ",")):
                    out.append(text)
        return out


def operations(code: str, signature: bool = False) -> list[dict]:
    """Operations with a float as direct operand, in the order of their ends; of a signature nothing counts."""
    fold = _Fold(code)
    if signature:
        depth = 0
        for kind, text, _, _ in fold.tokens:
            depth += (text in CLOSE) - (text in ")]}")
            fold.at += 1
            if text == ":" and depth == 0:
                break
    try:
        while fold.at < len(fold.tokens):
            fold.stretch("")
    except RecursionError:  # brackets nested hundreds deep are no code that any interpreter reads
        return []
    out = []
    for first, last, op, value in fold.found:
        if value is not None:
            start, end = fold.tokens[first][2], fold.tokens[min(last, len(fold.tokens)) - 1][3]
            out.append({
                "row": code.count("\n", 0, start), "col": start - code.rfind("\n", 0, start) - 1, "row_end": code.count("\n", 0, end),
                "value": value, "op": op if op in SIGNS else "arithmetic", "names": fold.names(first, last),
            })
    return out


def operations_of(code: Column, signature: Column) -> Column:
    """``operations`` of each statement as a column; null code gives none."""

    @F.pandas_udf(RESULT)
    def found(codes: pd.Series, signatures: pd.Series) -> pd.Series:
        return pd.Series([operations(c, bool(s)) if c is not None else [] for c, s in zip(codes, signatures)])

    return found(code, signature)
