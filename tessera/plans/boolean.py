"""Boolean query language: words, & | ! and brackets; ! binds before &, & before |.

``parse`` gives a tree; ``plan`` turns one tree into joins; ``truth`` gives the truth table of each
query of a column, for joins that answer many queries at once.
"""

from __future__ import annotations

import re
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEXEME = re.compile(r"\w+|[()&|!]")
#: A query of more different terms gets no truth table; it is evaluated on each set of matching terms.
MAX_TERMS = 14


class QueryError(ValueError):
    """The text is no boolean query."""


def lex(text: str) -> list[str]:
    return LEXEME.findall(text.lower())


def parse(text: str):
    """Tree of ("term", w), ("not", t), ("and", a, b), ("or", a, b). Neighbouring words without an operator are joined by and."""
    items = lex(text)
    at = 0

    def peek():
        return items[at] if at < len(items) else None

    def disjunction():
        nonlocal at
        left = conjunction()
        while peek() == "|":
            at += 1
            left = ("or", left, conjunction())
        return left

    def conjunction():
        nonlocal at
        left = negation()
        while peek() is not None and peek() not in "|)":
            if peek() == "&":
                at += 1
            left = ("and", left, negation())
        return left

    def negation():
        nonlocal at
        item = peek()
        if item is None or item in "&|)":
            raise QueryError(f"a term is missing in {text!r}")
        at += 1
        if item == "!":
            return ("not", negation())
        if item == "(":
            inner = disjunction()
            if peek() != ")":
                raise QueryError(f"a bracket isn't closed in {text!r}")
            at += 1
            return inner
        return ("term", item)

    tree = disjunction()
    if at < len(items):
        raise QueryError(f"a bracket isn't opened in {text!r}")
    return tree


def terms_of(tree) -> list[str]:
    found, todo = {}, [tree]
    while todo:
        node = todo.pop()
        if node[0] == "term":
            found[node[1]] = None
        else:
            todo.extend(reversed(node[1:]))
    return list(found)


def postfix(tree) -> list[tuple[str, str | None]]:
    """The tree's nodes, each after its parts; chains of any length need no recursion."""
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        out.append((node[0], node[1] if node[0] == "term" else None))
        if node[0] != "term":
            todo.extend(node[1:])
    return out[::-1]


def holds(tree, present) -> bool:
    return satisfied(postfix(tree), present)


def satisfied(steps: list[tuple[str, str | None]], present) -> bool:
    """Whether the set of terms satisfies a query given by ``postfix``."""
    stack: list[bool] = []
    for kind, term in steps:
        if kind == "term":
            stack.append(term in present)
        elif kind == "not":
            stack.append(not stack.pop())
        else:
            a, b = stack.pop(), stack.pop()
            stack.append(a and b if kind == "and" else a or b)
    return stack.pop()


def push_not(tree, negate: bool = False):
    """Negations moved to the terms."""
    kind = tree[0]
    if kind == "not":
        return push_not(tree[1], not negate)
    if kind == "term":
        return ("not", tree) if negate else tree
    kind = {"and": "or", "or": "and"}[kind] if negate else kind
    return (kind, *(push_not(t, negate) for t in tree[1:]))


def plan(tree, terms: DataFrame, universe: DataFrame) -> DataFrame:
    """Distinct keys that satisfy the tree: and = left semi, and not = left anti, or = union, not alone = anti against the universe."""

    def flatten(t, kind):
        return [u for part in t[1:] for u in flatten(part, kind)] if t[0] == kind else [t]

    def run(t) -> DataFrame:
        if t[0] == "term":
            return terms.filter(F.col("term") == t[1]).select("key")
        if t[0] == "not":
            return universe.select("key").join(run(t[1]), "key", "left_anti")
        if t[0] == "or":
            parts = flatten(t, "or")
            words = [p[1] for p in parts if p[0] == "term"]
            out = terms.filter(F.col("term").isin(words)).select("key") if words else None
            for p in parts:
                if p[0] != "term":
                    out = run(p) if out is None else out.unionByName(run(p))
            return out.distinct()
        parts = flatten(t, "and")
        yes = [p for p in parts if p[0] != "not"]
        out = run(yes[0]) if yes else universe.select("key")
        for p in yes[1:]:
            out = out.join(run(p), "key", "left_semi")
        for p in parts:
            if p[0] == "not":
                out = out.join(run(p[1]), "key", "left_anti")
        return out

    return run(push_not(tree))


_TRUTH = T.StructType([T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("truth", T.StringType()), T.StructField("on_empty", T.BooleanType())])


def truth_table(text: str | None):
    """(terms, a 0 or 1 for each set of terms, whether the empty set satisfies); the k-th term is bit k.

    With more than ``MAX_TERMS`` terms the table is None: ``judged`` evaluates such queries. All are None if the text is no query.
    """
    if text is None:
        return None, None, None
    try:
        tree = parse(text)
    except QueryError:
        return None, None, None
    words, steps = terms_of(tree), postfix(tree)
    if len(words) > MAX_TERMS:
        return words, None, satisfied(steps, set())
    table = ["0"] * (1 << len(words))
    for bits in product((0, 1), repeat=len(words)):
        if satisfied(steps, {w for w, b in zip(words, bits) if b}):
            table[sum(b << k for k, b in enumerate(bits))] = "1"
    return words, "".join(table), table[0] == "1"


@F.pandas_udf(_TRUTH)
def truth(queries: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([truth_table(q) for q in queries], columns=["terms", "truth", "on_empty"])


@F.pandas_udf(T.BooleanType())
def judged(queries: pd.Series, present: pd.Series) -> pd.Series:
    """Whether each set of terms satisfies its query."""
    steps = {q: postfix(parse(q)) for q in queries.unique()}
    return pd.Series([satisfied(steps[q], set(found)) for q, found in zip(queries, present)], dtype=bool)
