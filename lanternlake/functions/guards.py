"""What texts must hold for patterns to be found in them: words that are looked for before a pattern is tried.

A pattern's parse tree says which words every match has: all parts of a sequence give one, of an alternation's branches one
does.  The words of a text are looked up once for all patterns, and a pattern is tried only where what it needs is there.
"""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser

#: Most texts that a part of a pattern is spelled out to, and the shortest part of a word that is looked for.
MOST, SHORTEST = 300, 5
#: A need is ("any", marks), ("all", needs) or ("one", needs).  A mark is a whole word, or "~" and a part of the text.
Need = tuple[str, "frozenset[str] | list[Need]"]


def _apart(node) -> bool:
    """Whether what stands next to node can't be a letter that goes on: a word's edge, or white space."""
    kind, value = node
    if kind is K.AT:
        return value is K.AT_BOUNDARY
    if kind is K.MAX_REPEAT and value[0] >= 1 and len(value[2]) == 1:
        kind, value = value[2][0]
    return kind is K.IN and all(x == (K.CATEGORY, K.CATEGORY_SPACE) for x in value)


def _mark(run: str, start: bool, end: bool) -> Need | None:
    """A run's longest whole word, or its longest part."""
    words = re.findall("[a-z0-9_]+", run)
    if not words:
        return None
    start, end = start or not re.match("[a-z0-9_]", run), end or not re.search("[a-z0-9_]$", run)
    whole = [w for i, w in enumerate(words) if (i or start) and (i < len(words) - 1 or end)]
    part = max(words, key=len)
    return ("any", frozenset([max(whole, key=len) if whole else "~" + part])) if whole or len(part) >= SHORTEST else None


def _spelled(nodes) -> list[str] | None:
    """All texts that nodes match, with a space for white space and for marks that may part words; None if they are too many."""
    out = [""]
    for kind, value in nodes:
        if kind is K.LITERAL:
            more = [chr(value).lower()]
        elif kind is K.AT and value is K.AT_BOUNDARY:
            more = [""]
        elif _apart((kind, value)):
            more = [" "]
        elif kind is K.IN and all(x[0] is K.LITERAL or x == (K.CATEGORY, K.CATEGORY_SPACE) for x in value):
            more = sorted({chr(x[1]).lower() if x[0] is K.LITERAL else " " for x in value})
        elif kind is K.BRANCH:
            parts = [_spelled(b) for b in value[1]]
            more = [x for p in parts for x in p] if all(p is not None for p in parts) else None
        elif kind is K.SUBPATTERN:
            more = _spelled(value[3])
        elif kind is K.MAX_REPEAT and value[1] == 1:
            more = _spelled(value[2])
            more = more if more is None or value[0] else ["", *more]
        else:
            more = None
        if more is None or len(out) * len(more) > MOST:
            return None
        out = [x + y for x in out for y in more]
    return out


def _needs(nodes, left: bool, right: bool) -> Need | None:
    """What every match of nodes needs; None: nothing is known."""
    nodes, found, i = list(nodes), [], 0
    while i < len(nodes):
        start = (left if i == 0 else _apart(nodes[i - 1])) or _apart(nodes[i])
        j, texts = i, None
        while j < len(nodes) and (more := _spelled(nodes[i : j + 1])) is not None:
            j, texts = j + 1, more
        j = max(j, i + 1)
        end = (right if j == len(nodes) else _apart(nodes[j])) or _apart(nodes[j - 1])
        kind, value = nodes[i]
        need = None
        if texts is not None:
            marks = [_mark(x, start, end) for x in texts]
            need = ("any", frozenset().union(*(m[1] for m in marks))) if all(marks) else None
        elif kind is K.BRANCH:
            parts = [_needs(b, start, end) for b in value[1]]
            if all(parts):
                marks = frozenset().union(*(p[1] for p in parts if p[0] == "any"))
                rest = [p for p in parts if p[0] != "any"]
                need = ("one", [*([("any", marks)] if marks else []), *rest]) if rest else ("any", marks)
        elif kind is K.SUBPATTERN:
            need = _needs(value[3], start, end)
        elif kind is K.MAX_REPEAT and value[0] >= 1:
            need = _needs(value[2], start and value[1] == 1, end and value[1] == 1)
        if need:
            found.append(need)
        i = j
    return None if not found else found[0] if len(found) == 1 else ("all", found)


def needs_of(pattern: str) -> Need | None:
    """What a text needs for pattern, which ignores case, to be found in it."""
    return _needs(_parser.parse(pattern, re.I), False, False)


def _marks(need: Need | None) -> frozenset[str]:
    if need is None:
        return frozenset()
    return need[1] if need[0] == "any" else frozenset().union(*map(_marks, need[1]))


class Guards:
    """The needs of several patterns, by name."""

    def __init__(self, patterns: dict[str, str]):
        self.needs = {k: needs_of(p) for k, p in patterns.items()}
        marks = frozenset().union(*map(_marks, self.needs.values()))
        self.words = sorted(m for m in marks if m[0] != "~")
        self.parts = sorted(m for m in marks if m[0] == "~")
