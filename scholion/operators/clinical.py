"""Cohorts and results named in an abstract, read by small grammars over its tokens.

A text is cut into numbers, words and marks once; phrases are then patterns over tokens: tuples whose items are sets of
words, ``NUMBER``, or optional items. Nothing is resolved or rounded: numbers are compared as canonical decimals.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from dataclasses import dataclass
from decimal import Decimal

import pandas as pd

from scholion.functions.arrow import arrow_udf
from scholion.operators.words import STOP_WORDS

_DASHES = str.maketrans({"≥": ">=", "≤": "<=", "–": "-", "−": "-", "—": "-"})
_PIECE = re.compile(r"(?P<number>\d[\d,]*(?:\.\d+)?|\.\d+)|(?P<word>[^\W\d_]\w*)|(?P<mark>>=|<=|\S)")


def clinical_text(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "").translate(_DASHES)


def number(text: str) -> str:
    """Canonical decimal."""
    return format(Decimal(text.replace(",", "")).normalize(), "f")


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int

    @property
    def low(self) -> str:
        return self.text.casefold()


def tokens_of(text: str) -> list[Token]:
    return [Token(m.lastgroup, m[0], m.start(), m.end()) for m in _PIECE.finditer(text)]


# ---------------------------------------------------------------- patterns


class _Number:
    pass


NUMBER = _Number()


@dataclass(frozen=True)
class Maybe:
    item: object


def _fits(item, token: Token) -> bool:
    if item is NUMBER:
        return token.kind == "number" and "." not in token.text
    return token.low in item


def match(tokens: list[Token], at: int, pattern: tuple) -> tuple[int, list[str]] | None:
    """Where the pattern ends when it begins at ``at``, and its numbers; optional items are tried first with, then without."""
    if not pattern:
        return at, []
    item, rest = pattern[0], pattern[1:]
    if isinstance(item, Maybe):
        inner = item.item if isinstance(item.item, tuple) else (item.item,)
        return match(tokens, at, (*inner, *rest)) or match(tokens, at, rest)
    if at >= len(tokens) or not _fits(item, tokens[at]):
        return None
    found = match(tokens, at + 1, rest)
    return found and (found[0], [tokens[at].text] * (item is NUMBER) + found[1])


#: Who is counted, how a total is introduced, what names a population.
PEOPLE = frozenset("patients participants subjects children adults individuals".split())
TREATED = frozenset("patients participants subjects children adults".split())
TOTALS = (
    (Maybe({"a"}), {"total"}, Maybe({"of"}), NUMBER, PEOPLE | {"records", "cases"}),
    ({"enrolled", "included", "recruited", "involving"}, Maybe(({"a"}, {"total"}, {"of"})), NUMBER, PEOPLE),
    (NUMBER, PEOPLE, {"were"}, {"included", "enrolled", "recruited", "analysed", "analyzed"}),
    ({"total", "overall", "cohort", "sample"}, Maybe({"size"}), Maybe({"("}), Maybe({"n"}), {"=", ":"}, NUMBER),
)
POPULATION = {
    "age": {"pediatric": "pediatric paediatric children child", "adult": "adult adults", "neonatal": "neonat* newborn newborns"},
    "species": {"mouse": "mice mouse murine", "rat": "rat rats rodent"},
    "design": {"retrospective": "retrospective", "prospective": "prospective"},
}
_TRIAL = re.compile(r"nct\d{8}|isrctn\d{8}|actrn\d{14}")
_YEAR = re.compile(r"(?:19|20)\d\d")


def _methods(tokens: list[Token]) -> list[Token]:
    """From the first word 'method(s)' to the first 'result(s)' or 'conclusion(s)' behind it; everything without it."""
    begin = next((k for k, t in enumerate(tokens) if t.low in ("method", "methods")), None)
    if begin is None:
        return tokens
    stop = next((k for k in range(begin + 1, len(tokens)) if tokens[k].low in ("result", "results", "conclusion", "conclusions")), len(tokens))
    return tokens[begin + 1 : stop]


def _named(words: set[str], names: str) -> bool:
    return any(any(w.startswith(x[:-1]) for w in words) if x.endswith("*") else x in words for x in names.split())


def _conditions(text: str, scope: list[Token]) -> list[list[str]]:
    """What the people studied have or undergo: the words after it up to a mark or the next clause, as a sorted set."""
    out = []
    for k, t in enumerate(scope):
        if t.low not in TREATED:
            continue
        at = match(scope, k + 1, (Maybe({"diagnosed"}), {"with", "undergoing"})) or match(scope, k + 1, (Maybe({"diagnosed"}), {"admitted"}, {"for"}))
        if not at or at[0] >= len(scope):
            continue
        first = last = at[0]
        while last < len(scope) and scope[last].text not in ".;," and not (last > first and scope[last].low in ("from", "between", "during", "who", "were")):
            last += 1
        if not 3 <= scope[last - 1].end - scope[first].start <= 120:
            continue
        words = {x.low for x in scope[first:last] if x.kind != "mark"} - set(STOP_WORDS)
        if words:
            out.append(sorted(words))
    return sorted(out)


def cohort(abstract: str | None) -> dict:
    """Explicit totals, population words by dimension, conditions, recruitment windows and trial ids of an abstract."""
    tokens = tokens_of(clinical_text(abstract).casefold())
    scope = _methods(tokens)
    words = {t.text for t in scope if t.kind == "word"}
    found = (match(tokens, k, pattern) for k in range(len(tokens)) for pattern in TOTALS)
    years = (match(scope, k, ({"between", "from", "during"}, NUMBER, {"and", "to", "-"}, NUMBER)) for k in range(len(scope)))
    return {
        "sizes": sorted({number(x) for m in found if m for x in m[1]}),
        "population": {d: sorted(label for label, names in labels.items() if _named(words, names)) for d, labels in POPULATION.items()},
        "conditions": _conditions("", scope),
        "windows": sorted({"-".join(m[1]) for m in years if m and all(_YEAR.fullmatch(y) for y in m[1])}),
        "trials": sorted({t.text for t in tokens if t.kind == "word" and _TRIAL.fullmatch(t.text)}),
    }


# ---------------------------------------------------------------- results

#: Statistics and their signs, names that aren't strata, words that don't tell contexts apart.
SIGNS = {"OR": "or", "HR": "hr", "RR": "rr", "IRR": "irr", "SMD": "smd", "MD": "md"}
RATIOS = {"odds": "or", "hazard": "hr", "risk": "rr", "rate": "irr"}
NOT_STRATA = frozenset("p or hr rr irr ci n".split())
PLAIN_CONTEXT = frozenset(
    "adjusted odds hazard ratio risk confidence interval patients participants values value received receiving treatment significantly increased "
    "decreased higher lower ci or hr rr p mmol when whereas those both either overall similarly similar findings observed total".split()
) | frozenset(STOP_WORDS)
NEAR, FAR, BACK, AHEAD = 160, 500, 320, 65


def _signed(tokens: list[Token], at: int) -> tuple[int, str] | None:
    """A number with its sign, where it begins at ``at``."""
    sign = ""
    if at < len(tokens) and tokens[at].text in "+-" and at + 1 < len(tokens) and tokens[at + 1].start == tokens[at].end:
        sign, at = tokens[at].text, at + 1
    if at < len(tokens) and tokens[at].kind == "number" and "," not in tokens[at].text:
        return at + 1, sign + tokens[at].text
    return None


def _skip(tokens: list[Token], at: int, marks: str) -> int:
    return at + 1 if at < len(tokens) and tokens[at].text in marks else at


def _bounds(tokens: list[Token], at: int) -> tuple[int, str, str] | None:
    """low and high behind '95 % CI', which begins at ``at``."""
    if at + 2 >= len(tokens) or tokens[at].text != "95" or tokens[at + 1].text != "%":
        return None
    named = match(tokens, at + 2, ({"ci"},)) or match(tokens, at + 2, ({"confidence"}, {"interval"}))
    low = named and _signed(tokens, _skip(tokens, _skip(tokens, named[0], ":="), "[("))
    if not low or low[0] >= len(tokens) or tokens[low[0]].low not in ("-", "to"):
        return None
    high = _signed(tokens, low[0] + 1)
    return high and (high[0], low[1], high[1])


def _statistic(tokens: list[Token]) -> str | None:
    """The last statistic named."""
    for k in range(len(tokens) - 1, -1, -1):
        here, before = tokens[k], tokens[k - 1].low if k else ""
        if here.text in SIGNS:
            return SIGNS[here.text]
        if here.low in ("ratio", "ratios") and before in RATIOS:
            return RATIOS[before]
        if here.low in ("difference", "differences") and before == "mean":
            return "smd" if k > 1 and tokens[k - 2].low == "standardized" else "md"
    return None


def _stratum(tokens: list[Token]) -> str:
    """The last comparison of a name with a number, such as ``sodium levels >= 145``."""
    for k in range(len(tokens) - 1, -1, -1):
        if tokens[k].text not in (">=", "<=", ">", "<", "="):
            continue
        value, name = _signed(tokens, k + 1), k - 1
        if name > 0 and tokens[name].low in ("was", "is", "level", "levels") and tokens[name - 1].kind == "word":
            name -= 1
        if value and name >= 0 and tokens[name].kind == "word" and tokens[name].text[0].isascii() and tokens[name].low not in NOT_STRATA:
            return f"{tokens[name].low}{tokens[k].text}{number(value[1])}"
    return ""


def effects(abstract: str | None) -> list[dict]:
    """Every point estimate with a 95 % interval that holds it: the statistic named in the 160 characters before, the last
    stratum named in the 500 before, and the telling words around it."""
    text = clinical_text(abstract)
    tokens, out, done = tokens_of(text), [], 0
    for k, token in enumerate(tokens):
        if k < done or token.kind != "number" or "," in token.text or not (0 < k + 1 < len(tokens)) or tokens[k + 1].text not in ",;([":
            continue
        interval = _bounds(tokens, k + 2) or (tokens[k + 2].text == "(" and _bounds(tokens, k + 3) if k + 2 < len(tokens) else None)
        if not interval:
            continue
        stop, low, high = interval
        signed = k > 0 and tokens[k - 1].text in "+-" and tokens[k - 1].end == token.start
        begin, end = tokens[k - 1].start if signed else token.start, tokens[stop - 1].end
        done = stop
        point, low, high = number(text[begin : token.end]), number(low), number(high)
        behind = [t for t in tokens[: k - signed] if t.start >= begin - FAR]
        statistic = _statistic([t for t in behind if t.start >= begin - NEAR])
        if not statistic or not Decimal(low) <= Decimal(point) <= Decimal(high):
            continue
        from_ = text.rfind(" ", 0, max(0, begin - BACK)) + 1
        to = text.find(" ", min(len(text), end + AHEAD))
        around = "".join(ch if ch.isalnum() else " " for ch in text[from_ : to if to >= 0 else len(text)].casefold()).split()
        context = sorted({w for w in around if len(w) >= 4 and not w.isdigit() and w not in PLAIN_CONTEXT})
        out.append({"statistic": statistic, "point": point, "low": low, "high": high, "stratum": _stratum(behind), "context": context})
    return out


# ---------------------------------------------------------------- comparison


def _signature(e: dict) -> tuple:
    return e["statistic"], e["point"], e["low"], e["high"]


def compare(a: str | None, b: str | None) -> dict:
    """Fields in which two abstracts contradict each other, and how many results they share; two shared results without a
    contradiction are strong evidence for one work."""
    left, right = cohort(a), cohort(b)
    conflicts = [name for name in ("sizes", "trials", "windows") if left[name] and right[name] and left[name] != right[name]]
    conflicts += [f"population_{d}" for d in POPULATION if left["population"][d] and right["population"][d] and left["population"][d] != right["population"][d]]
    if left["conditions"] and right["conditions"]:
        if not any(2 * len(set(x) & set(y)) >= min(len(x), len(y)) for x in left["conditions"] for y in right["conditions"]):
            conflicts.append("condition")
    found = effects(a), effects(b)
    scoped = [defaultdict(set), defaultdict(set)]
    for place, held in zip(scoped, found):
        for e in held:
            if e["stratum"]:
                place[e["statistic"], e["stratum"]].add(_signature(e))
    conflicts += ["stratified_result" for scope in sorted(set(scoped[0]) & set(scoped[1])) if not scoped[0][scope] & scoped[1][scope]]
    shared = set()
    for x in found[0]:
        for y in found[1]:
            common = set(x["context"]) & set(y["context"])
            other_stratum = x["stratum"] and y["stratum"] and x["stratum"] != y["stratum"]
            if _signature(x) == _signature(y) and not other_stratum and len(common) >= 4 and 10 * len(common) >= 4 * min(len(x["context"]), len(y["context"])):
                shared.add(_signature(x))
    return {"conflicts": conflicts, "shared_results": len(shared), "strong": len(shared) >= 2 and not conflicts}


@arrow_udf("array<struct<statistic:string,point:string,low:string,high:string,stratum:string,context:array<string>>>")
def effects_of(texts: pd.Series) -> pd.Series:
    return texts.map(effects)


@arrow_udf(
    "sizes array<string>, population struct<age:array<string>,species:array<string>,design:array<string>>, conditions array<array<string>>, windows array<string>, trials array<string>"
)
def cohort_of(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([cohort(t) for t in texts])


@arrow_udf("conflicts array<string>, shared_results int, strong boolean")
def clinical_evidence(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([compare(x, y) for x, y in zip(a, b)])


@arrow_udf("string")
def canonical_numbers(texts: pd.Series) -> pd.Series:
    """Text with numbers as canonical decimals, dashes and ranges in one spelling: what abstracts are compared by."""

    def one(text):
        text = re.sub(r"(?<![\w.])\d+(?:\.\d+)?(?![\w.])", lambda m: number(m[0]), clinical_text(text))
        return re.sub(r"(?<=\d)\s+to\s+(?=\d)", "-", text, flags=re.I)

    return texts.map(one)
