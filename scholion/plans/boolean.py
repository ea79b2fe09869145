"""Boolean queries in the providers' own syntax, compiled into one Column.

A query is a tree of AND, OR, NOT over terms; the dialects differ in how operators bind and how fields are named. The
compiled Column holds over folded texts (``normalize.title``), in which a term is a run of whole words and ``word*`` a word's
beginning, so a query runs inside the scan's stage with everything else that filters it.

Dialects (fixed values): ``pubmed`` binds from left to right without precedence, fields in brackets after the term; ``europe_pmc`` and
``arxiv`` bind NOT before AND before OR, fields before a colon. Terms side by side are joined by AND.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from scholion.functions import normalize as n

#: The providers' names of the fields that can be evaluated here.
FIELDS = {
    "pubmed": {"ti": ("title",), "title": ("title",), "ab": ("abstract",), "tiab": ("title", "abstract"), "title/abstract": ("title", "abstract"), "all fields": None, "tw": None},
    "europe_pmc": {"title": ("title",), "abstract": ("abstract",), "title_abs": ("title", "abstract")},
    "arxiv": {"ti": ("title",), "abs": ("abstract",), "all": None},
}
STRENGTH = {"pubmed": {"OR": 1, "AND": 1, "NOT": 1}, "europe_pmc": {"OR": 1, "AND": 2, "NOT": 3}, "arxiv": {"OR": 1, "AND": 2, "NOT": 3}}
_TOKEN = re.compile(r'\s*(?:([()])|((?:[A-Za-z_]+:)?"[^"]*"(?:\[[^\]]*\])?)|([^\s()"\[]+(?:\[[^\]]*\])?)|(\S))')


class BooleanError(ValueError):
    """A query that can't be read: the code and where."""


@dataclass(frozen=True)
class Term:
    words: str
    fields: tuple[str, ...] | None  # None: any
    prefix: bool


@dataclass(frozen=True)
class Op:
    name: str
    left: object
    right: object | None = None


def parse(query: str, dialect: str):
    """The tree of a query."""
    tokens, at = [], 0
    while at < len(query.rstrip()):
        found = _TOKEN.match(query, at)
        bracket, quoted, plain, stray = found.groups()
        if stray:
            raise BooleanError(f"unexpected_character at {found.start(4)}")
        word = bracket or quoted or plain
        upper = "ANDNOT" if dialect == "arxiv" and plain == "ANDNOT" else plain if plain in ("AND", "OR", "NOT") else None
        tokens += ["AND", "NOT"] if upper == "ANDNOT" else [upper or (bracket if bracket else _term(word, dialect))]
        at = found.end()
    strength = STRENGTH[dialect]
    tree, rest = _expression(tokens, 0, 0, strength)
    if rest < len(tokens):
        raise BooleanError("unbalanced_parenthesis")
    return tree


def _term(word: str, dialect: str) -> Term:
    names, field = FIELDS[dialect], None
    if dialect == "pubmed" and word.endswith("]"):
        word, _, field = word[:-1].partition("[")
    elif dialect != "pubmed" and re.match(r"[A-Za-z_]+:", word):
        field, _, word = word.partition(":")
    if field is not None and field.lower() not in names:
        raise BooleanError(f"unknown_field {field}")
    words = word.strip('"')
    return Term(words.rstrip("*"), names[field.lower()] if field else None, words.endswith("*"))


def _expression(tokens: list, at: int, least: int, strength: dict[str, int]):
    """Precedence climbing: operators that bind at least as strongly as ``least``."""
    if at >= len(tokens):
        raise BooleanError("trailing_boolean_operator")
    if tokens[at] == "NOT":
        inner, at = _expression(tokens, at + 1, strength["NOT"] + 1, strength)
        left = Op("NOT", inner)
    elif tokens[at] == "(":
        left, at = _expression(tokens, at + 1, 0, strength)
        if at >= len(tokens) or tokens[at] != ")":
            raise BooleanError("unbalanced_parenthesis")
        at += 1
    elif isinstance(tokens[at], Term):
        left, at = tokens[at], at + 1
    else:
        raise BooleanError("misplaced_boolean_operator" if tokens[at] != ")" else "unbalanced_parenthesis")
    while at < len(tokens) and tokens[at] != ")":
        token = tokens[at]
        name, after = (token, at + 1) if token in ("AND", "OR", "NOT") else ("AND", at)
        if name == "NOT":  # A NOT B: and it isn't B
            if strength["NOT"] < least:
                break
            right, at = _expression(tokens, after, strength["NOT"] + 1, strength)
            left = Op("AND", left, Op("NOT", right))
            continue
        if strength[name] < least:
            break
        right, at = _expression(tokens, after, strength[name] + 1, strength)
        left = Op(name, left, right)
    return left, at


def compiled(tree, folded: dict[str, Column]) -> Column:
    """The tree as a Column over folded texts by field; a null text holds nothing."""
    if isinstance(tree, Term):
        words = n.title(F.lit(tree.words))
        sought = F.concat(F.lit(" "), words, F.lit("" if tree.prefix else " "))
        out = F.lit(False)
        for field in tree.fields or tuple(folded):
            out = out | F.coalesce(F.concat(F.lit(" "), folded[field], F.lit(" ")).contains(sought), F.lit(False))
        return out & (words != "")
    if tree.name == "NOT":
        return ~compiled(tree.left, folded)
    left, right = compiled(tree.left, folded), compiled(tree.right, folded)
    return left & right if tree.name == "AND" else left | right


def matches(query: str, dialect: str, title: Column, abstract: Column) -> Column:
    """Does a record with these folded texts answer the query?"""
    return compiled(parse(query, dialect), {"title": title, "abstract": abstract})
