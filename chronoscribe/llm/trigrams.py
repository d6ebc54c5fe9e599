"""Boolean trigram queries of regular expressions.

A query is an OR of ANDs: a set of sets of trigrams. A text can match the expression only if it has all
trigrams of one of the sets. ``ANY`` says nothing about a text. Everything is in lower case, for an index
of texts in lower case. This runs once for each rule, not for texts.
"""

from __future__ import annotations

import re
from itertools import product

ANY = frozenset({frozenset()})
#: Strings that are spelled out side by side; beyond it an expression is taken in parts.
SPELLED = 64


def of(pattern: str) -> frozenset[frozenset[str]]:
    """The query of a regular expression in Python's (and Java's) common syntax."""
    state = _State()
    state.walk(re._parser.parse(pattern))
    state.flush()
    return state.query


def both(a: frozenset, b: frozenset) -> frozenset:
    return _least(x | y for x, y in product(a, b))


def _least(sets) -> frozenset:
    """Without sets that hold another one: they add nothing to an OR."""
    sets = set(sets)
    return frozenset(s for s in sets if not any(t < s for t in sets))


class _State:
    """A run of spelled strings that grows item by item, and the query of what came before it."""

    def __init__(self):
        self.strings, self.query = {""}, ANY

    def flush(self) -> None:
        if min(map(len, self.strings)) >= 3:
            self.query = both(self.query, _least(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in self.strings))
        self.strings = {""}

    def add(self, strings: set[str] | None) -> None:
        """The next item is one of these strings, or (None) something unknown."""
        if strings is None:
            self.flush()
            return
        if len(strings) * len(self.strings) > SPELLED:
            self.flush()
        self.strings = {a + b for a in self.strings for b in strings} if len(strings) <= SPELLED else {""}

    def walk(self, items) -> None:
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                self.add({chr(arg).lower()})
            elif name == "IN":
                self.add(_members(arg))
            elif name == "SUBPATTERN":
                self.branch([arg[-1]])
            elif name == "BRANCH":
                self.branch(arg[1])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                self.repeat(*arg)
            elif name == "AT":
                continue
            else:
                self.add(None)

    def branch(self, ways) -> None:
        states = []
        for way in ways:
            s = _State()
            s.walk(way)
            states.append(s)
        if all(s.query == ANY for s in states) and not any(_open(w) for w in ways):
            self.add(set().union(*(s.strings for s in states)))
            return
        self.flush()
        for s in states:
            s.flush()
        self.query = both(self.query, _least(x for s in states for x in s.query))

    def repeat(self, least: int, most, item) -> None:
        if _open(item):
            if least:
                self.branch([item])
            self.add(None)
            return
        one = _State()
        one.walk(item)
        if one.query != ANY:
            self.add(None)
        elif most == 1:
            self.add(one.strings | ({""} if not least else set()))
        else:
            for _ in range(min(least, 8)):
                self.add(one.strings)
            if least != most or least > 8:
                self.add(None)


def _members(items) -> set[str] | None:
    out = set()
    for op, arg in items:
        if str(op) == "LITERAL":
            out.add(chr(arg).lower())
        elif str(op) == "RANGE" and arg[1] - arg[0] < 10:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 10 else None


def _open(items) -> bool:
    """Whether an expression can stand for strings that are not spelled out."""
    for op, arg in items:
        name = str(op)
        if name == "IN" and _members(arg) is None:
            return True
        if name == "SUBPATTERN" and _open(arg[-1]):
            return True
        if name == "BRANCH" and any(map(_open, arg[1])):
            return True
        if name.endswith("REPEAT") and (arg[0] != arg[1] and arg[1] != 1 or arg[0] > 8 or _open(arg[2])):
            return True
        if name not in ("LITERAL", "IN", "SUBPATTERN", "BRANCH", "AT") and not name.endswith("REPEAT"):
            return True
    return False
