"""Rules by which two names may mean one player, as one Arrow-batched function over distinct pairs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that join the parts of a name (fixed values).
PARTICLES = {"da", "de", "del", "di", "dos", "van", "von"}
#: Likeness of a variant, of a loose one and of a long spelling; least letters of a long spelling (fixed values).
VARIANT, LOOSE, LONG, LONG_LETTERS = 0.84, 0.78, 0.78, 8
#: The rules, in the order in which they are tried.
RULES = ["containment", "token_set", "prefix", "surname_variant", "single_variant", "single_token", "orthographic"]


def _like(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def is_variant(a: str, b: str) -> bool:
    """Equal words, one that begins the other, or near spellings with the same first letter."""
    if not a or not b or a[0] != b[0]:
        return False
    low, high = sorted((a, b), key=len)
    return a == b or len(low) >= 2 and high.startswith(low) or _like(a, b) >= VARIANT


def is_loose_variant(a: str, b: str) -> bool:
    """Like :func:`is_variant`, or a common beginning of four letters (three of a short word), or a looser spelling."""
    if is_variant(a, b):
        return True
    low = min(len(a), len(b))
    if low < 4 or a[0] != b[0]:
        return False
    return a[:3] == b[:3] and low <= 5 or a[:4] == b[:4] or _like(a, b) >= LOOSE


def is_long_spelling(a: str, b: str) -> bool:
    return a != b and min(len(a), len(b)) >= LONG_LETTERS and a[:2] == b[:2] and _like(a, b) >= LONG


def rules_of(left: str, right: str, ambiguous: frozenset[str] = frozenset()) -> dict[str, bool]:
    """Which of :data:`RULES` hold for two aliases (words joined by ``_``); one-word rules skip ambiguous words.

    containment: the words of one stand in a row in the other. token_set: the words without particles are
    the same, one set holds the other, or two are shared. prefix: as many words, pairwise equal or variants,
    at least one of either. surname_variant: the same last word beside loosely like first ones. single_variant:
    one word loosely like the other's first. single_token: one word among the other's. orthographic: as many
    words, all equal but one long spelling.
    """
    a, b = ([t for t in x.split("_") if t] for x in (left, right))
    x, y = ([t for t in w if t not in PARTICLES] for w in (a, b))
    out = dict.fromkeys(RULES, False)
    if len(a) >= 2 and len(b) >= 2:
        low, high = sorted((a, b), key=len)
        out["containment"] = any(high[i : i + len(low)] == low for i in range(len(high) - len(low) + 1))
        if len(a) == len(b):
            uneven = [(p, q) for p, q in zip(a, b) if p != q]
            some = 0 < len(uneven) < len(a)
            out["prefix"] = some and all(is_variant(p, q) for p, q in uneven)
            out["orthographic"] = some and len(uneven) == 1 and is_long_spelling(*uneven[0])
    if len(x) >= 2 and len(y) >= 2:
        out["token_set"] = len(set(x) & set(y)) >= 2 or set(x) == set(y)
        out["surname_variant"] = x[-1] == y[-1] and is_loose_variant(x[0], y[0])
    for one, many in ((a, b), (b, a)):
        if len(one) == 1 and len(many) > 1 and one[0] not in ambiguous:
            out["single_token"] = out["single_token"] or one[0] in many
    for one, many in ((x, y), (y, x)):
        if len(one) == 1 and len(many) > 1 and one[0] not in ambiguous:
            out["single_variant"] = out["single_variant"] or is_loose_variant(one[0], many[0])
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def name_rules(left: pd.Series, right: pd.Series) -> pd.Series:
    """The rules that hold for two aliases, ``equal`` for the same one; none for a NULL or empty one. Repeated pairs are compared once."""
    memo: dict[tuple[str, str], list[str]] = {}
    out = []
    for pair in zip(left, right):
        if pair not in memo:
            a, b = pair
            memo[pair] = [] if not a or not b else ["equal"] if a == b else [r for r, holds in rules_of(a, b).items() if holds]
        out.append(memo[pair])
    return pd.Series(out)


def differs_in_given_name(left: str, right: str) -> bool:
    """The same family name beside given names that are not alike: two persons."""
    x, y = ([t for t in w.split("_") if t and t not in PARTICLES] for w in (left, right))
    if len(x) < 2 or len(y) < 2 or x[-1] != y[-1] or is_loose_variant(x[0], y[0]):
        return False
    held = rules_of(left, right)
    return not (held["containment"] or held["prefix"])
