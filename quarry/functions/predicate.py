"""Boolean filter strings in DataFrame-query style, as Spark columns.

The text is read with Python's own ``ast``; comparisons with a missing value are false, except ``!=``
which is true, so the same rows survive as in a DataFrame query.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.columns import name

_COMPARE = {
    ast.Eq: lambda a, b: a == b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
}
_ARITHMETIC = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: _quotient(a, b),
    ast.FloorDiv: lambda a, b: _whole_quotient(a, b),
    ast.Mod: lambda a, b: F.try_mod(a, b),
    ast.Pow: lambda a, b: F.pow(a, b),
}


def _quotient(a: Column, b: Column) -> Column:
    """Division as in a DataFrame query: infinite by zero; 0 / 0 compares like a missing value."""
    a, b = a.cast("double"), b.cast("double")
    beyond = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b == 0, beyond).otherwise(F.try_divide(a, b))


def _whole_quotient(a: Column, b: Column) -> Column:
    found = _quotient(a, b)
    return F.when(F.abs(found) < 2.0 ** 53, F.floor(found).cast("double")).otherwise(found)


def predicate(df: DataFrame, where: str) -> Column:
    quoted: dict[str, str] = {}

    def placeholder(found: re.Match) -> str:
        key = f"_quoted_{len(quoted)}"
        quoted[key] = found.group(1)
        return key

    text = re.sub(r"`([^`]+)`", placeholder, where.strip())
    # & and | bind like and/or in a query string
    swapped = {"&": "and", "|": "or"}
    tokens = [
        (tokenize.NAME, swapped[t.string]) if t.type == tokenize.OP and t.string in swapped else (t.type, t.string)
        for t in tokenize.generate_tokens(io.StringIO(text).readline)
    ]
    try:
        tree = ast.parse(tokenize.untokenize(tokens).strip(), mode="eval").body
    except SyntaxError as problem:
        raise ValueError(f"cannot read filter '{where}': {problem}") from None

    def operand(node: ast.expr) -> Column:
        if isinstance(node, ast.Name):
            col = quoted.get(node.id, node.id)
            if col not in df.columns:
                raise ValueError(f"no such column in filter: {col}")
            return name(col)
        if isinstance(node, ast.Constant):
            return F.lit(node.value)
        if isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC:
            return _ARITHMETIC[type(node.op)](operand(node.left), operand(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -operand(node.operand)
        raise ValueError(f"not supported in a filter: {ast.unparse(node)}")

    def compare(op: ast.cmpop, left: ast.expr, right: ast.expr, plain: bool) -> Column:
        def settled(test: Column) -> Column:
            # A filter drops null like false; only below a negation must the two be told apart. Plain
            # comparisons reach the file scan.
            return test if plain else F.coalesce(test, F.lit(False))

        if isinstance(op, (ast.In, ast.NotIn)) or isinstance(right, (ast.List, ast.Tuple)):
            choices = [ast.literal_eval(e) for e in right.elts]
            if isinstance(op, (ast.NotIn, ast.NotEq)):
                return ~F.coalesce(operand(left).isin(choices), F.lit(False))
            return settled(operand(left).isin(choices))
        a, b = operand(left), operand(right)
        if isinstance(op, ast.NotEq):
            constant = isinstance(right, ast.Constant) and right.value is not None
            return ~a.eqNullSafe(b) if constant else F.coalesce(a != b, F.lit(True))
        return settled(_COMPARE[type(op)](a, b))

    def condition(node: ast.expr, plain: bool = True) -> Column:
        if isinstance(node, ast.BoolOp):
            parts = [condition(v, plain) for v in node.values]
            return reduce((lambda x, y: x & y) if isinstance(node.op, ast.And) else (lambda x, y: x | y), parts)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.Not, ast.Invert)):
            return ~condition(node.operand, plain=False)
        if isinstance(node, ast.Compare):
            sides = [node.left, *node.comparators]
            return reduce(lambda x, y: x & y, [compare(op, sides[i], sides[i + 1], plain) for i, op in enumerate(node.ops)])
        return F.coalesce(operand(node).cast("boolean"), F.lit(False))

    return condition(tree)
