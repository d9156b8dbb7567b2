"""Patterns on whole batches of texts: RE2 tells in one pass over a text whether a pattern is found, and it runs only on texts
that hold the words which every match has.  Texts go to Python once for all patterns of a query."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from .fixed import DEGREES_A, DEGREES_B, ENGLISH_LENGTH, ENGLISH_SHARE, ENGLISH_WORDS, NAMED_ORGANISATION, ORGANISATION_WINDOW, PROGRAM_OR_OUTCOME
from .guards import Guards

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package on their path

#: White space as Unicode has it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: What single spaces don't look like.
_UNEVEN = re.compile(f"  |[{WHITE.replace(' ', '')}]")
_SPACES = re.compile(f"[{WHITE}]+")
#: Texts that are worked on at a time.
STEP = 1024


class _Plain(dict):
    """Letters and digits outside ASCII as '_', spaces as ' ', all else as it is."""

    def __missing__(self, c: int) -> int:
        kind = unicodedata.category(chr(c))[0]
        self[c] = 95 if kind in "LNM" else 32 if kind == "Z" or c == 0x85 else c
        return self[c]


_PLAIN = _Plain({ord(a): ord(b) for a, b in zip("İıſK", "iisk", strict=True)})
_OUTSIDE = re.compile("[^\x00-\x7f]+")
_LOWER = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789_" else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_NOT_LETTERS = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122))


def plain_words(t: str) -> str:
    """As text.plain_words(): a text on which ASCII patterns find what Unicode ones find in t, of equal length."""
    if not t.isascii():
        t = _OUTSIDE.sub(lambda m: m[0].translate(_PLAIN), t)
    return t.replace("\x0b", " ")  # which RE2's \s doesn't know


def squeeze(t: str) -> str:
    return (_SPACES.sub(" ", t) if _UNEVEN.search(t) else t).strip(WHITE)


def crawl_text(t: str) -> str:
    t = t.lower()
    for a, b in DEGREES_A:
        t = t.replace(a, b)
    return squeeze(t)


_DASHES, _MARKS = re.compile("[‐-–—]"), re.compile(r"[!?.]{2,}")


def legit_text(t: str) -> str:
    t = t.lower()
    t = t if t.isascii() else _DASHES.sub("-", t)
    t = _MARKS.sub(" ", _SPACES.sub(" ", t) if _UNEVEN.search(t) else t)
    for a, b in DEGREES_B:
        t = t.replace(a, b)
    return t.strip(WHITE)


def re2(pattern: str) -> str:
    return "(?i)" + pattern


def texts_of(column: pa.Array) -> list[str]:
    """Null as an empty text; bytes that aren't UTF-8 don't stop the rest."""
    return ["" if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def _test(need) -> Callable[[set], bool]:
    if need is None:
        return lambda found: True
    if need[0] == "any":
        marks = frozenset(m.encode() for m in need[1])
        return lambda found: not marks.isdisjoint(found)
    tests = [_test(n) for n in need[1]]
    return (lambda found: all(t(found) for t in tests)) if need[0] == "all" else (lambda found: any(t(found) for t in tests))


class Search:
    """Which of several patterns, by name, are found in texts.  before: for a name, a pattern that is found wherever that one is,
    and fast to look for."""

    def __init__(self, patterns: dict[str, str], before: dict[str, str], words: list[str], parts: list[str], needs: dict):
        self.patterns, self.before = patterns, before
        self.words, self.parts = frozenset(w.encode() for w in words), [(p[1:].encode(), p.encode()) for p in parts]
        self.allowed = {k: _test(need) for k, need in needs.items()}

    def marks(self, plain: str) -> set[bytes]:
        low = plain.encode("latin-1", "replace").translate(_LOWER)
        return set(self.words.intersection(low.split())).union(mark for part, mark in self.parts if part in low)

    def places(self, marks: list[set], name: str) -> list[int]:
        """Numbers of the texts in which the pattern of that name may be found."""
        allowed = self.allowed[name]
        return [i for i, m in enumerate(marks) if allowed(m)]

    def found(self, plain: list[str], names: list[str] | None = None, marks: list[set] | None = None) -> dict[str, np.ndarray]:
        """name to a boolean a text of plain_words()."""
        marks, array = marks or list(map(self.marks, plain)), pa.array(plain, pa.string())
        out = {}
        for name in self.patterns if names is None else names:
            at = np.array(self.places(marks, name), dtype=np.int64)
            for pattern in (*filter(None, [self.before.get(name)]), self.patterns[name]):
                if len(at):
                    at = at[pc.match_substring_regex(array.take(pa.array(at)), re2(pattern)).to_numpy(zero_copy_only=False)]
            out[name] = np.zeros(len(plain), dtype=bool)
            out[name][at] = True
        return out


def search_of(patterns: dict[str, str], before: dict[str, str] | None = None) -> Search:
    guard = Guards(patterns)
    return Search(patterns, before or {}, guard.words, guard.parts, guard.needs)


def by_steps(column: pa.Array, work: Callable[[list[str]], pa.Array]) -> pa.Array:
    """work on STEP texts at a time."""
    parts = [work(texts_of(column[k : k + STEP])) for k in range(0, max(1, len(column)), STEP)]
    return pa.concat_arrays(parts)


def struct_of(columns: dict[str, np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(v).cast(kind) for v in columns.values()], names=list(columns))


# ---------------------------------------------------------------------------------------------------- organisations

#: What texts that organisation_link() may be true for hold: each name has one of these, and there is a term.
ORGANISATION_HINT = f"(?:universit|institute|hochschule|school|daad|tum|tuhh|bsbi|assist).*{PROGRAM_OR_OUTCOME}"
_KEY = re.compile("universit|institute|hochschule|school|daad|tum|tuhh|bsbi|assist", re.I)
_NAMED = re.compile(NAMED_ORGANISATION, re.I)
_TERM = re.compile(PROGRAM_OR_OUTCOME, re.I)
_EDGE = re.compile(r"\b(?=[^\W\d_])")
#: Most words before a name's last one.
_BEFORE = 8


def organisations(t: str) -> list[tuple[int, int]]:
    """Bounds of the named organisations of a squeezed text, from left to right.  A name has at most seven words before the one that
    makes it a name, so only these are tried as its beginning."""
    out, at = [], 0
    for key in _KEY.finditer(t):
        if key.start() < at:
            continue
        begin = key.start()
        for _ in range(_BEFORE):
            begin = t.rfind(" ", 0, max(0, begin))
            if begin < 0:
                break
        for edge in _EDGE.finditer(t, max(at, begin, 0), key.end()):
            if m := _NAMED.match(t, edge.start()):
                out.append(m.span())
                at = m.end()
                break
    return out


def organisation_link(text: str) -> bool:
    """Whether a named organisation has a programme or outcome term within ORGANISATION_WINDOW characters."""
    t, w = squeeze(text), ORGANISATION_WINDOW
    return any(_TERM.search(t[max(0, s - w) : e + w]) for s, e in organisations(t))


# ---------------------------------------------------------------------------------------------------- columns


def flags(text: Column, patterns: dict[str, str], before: dict[str, str] | None = None, checks: dict[str, Callable[[str], bool]] | None = None) -> Column:
    """Struct of one 0/1 number a pattern.  checks: for a name, a function of the text that decides where its pattern may be found."""
    search, checks = search_of(patterns, before), checks or {}
    names = [k for k in patterns if k not in checks]

    def work(texts: list[str]) -> pa.Array:
        plain = list(map(plain_words, texts))
        marks = list(map(search.marks, plain))
        found = search.found(plain, names, marks)
        for name, check in checks.items():
            found[name] = np.zeros(len(texts), dtype=bool)
            at = search.places(marks, name)
            found[name][at] = [check(texts[i]) for i in at]
        return struct_of({k: found[k] for k in patterns}, pa.int32())

    @arrow_udf("struct<" + ",".join(f"`{k}`:int" for k in patterns) + ">")
    def run(column: pa.Array) -> pa.Array:
        return by_steps(column, work)

    return run(text)


def tests(text: Column, normal: Callable[[str], str], any_of: dict[str, str]) -> Column:
    """Struct of one boolean a pattern of any_of, tried on the normalised text, and english_like of the text itself."""
    search = search_of(any_of)

    def work(texts: list[str]) -> pa.Array:
        found = search.found([plain_words(normal(t)) for t in texts])
        return struct_of(found | {"english_like": np.fromiter(map(looks_english, texts), bool, len(texts))}, pa.bool_())

    @arrow_udf("struct<" + ",".join(f"`{k}`:boolean" for k in (*any_of, "english_like")) + ">")
    def run(column: pa.Array) -> pa.Array:
        return by_steps(column, work)

    return run(text)


def english(text: Column) -> Column:
    """looks_english() of each text."""

    @arrow_udf("boolean")
    def run(column: pa.Array) -> pa.Array:
        return by_steps(column, lambda texts: pa.array(list(map(looks_english, texts)), pa.bool_()))

    return run(text)


_ENGLISH = re.compile(ENGLISH_WORDS, re.A)


def looks_english(t: str) -> bool:
    """At least 40 characters, three quarters of the letters ASCII, and a common word."""
    if len(t.strip(WHITE)) < ENGLISH_LENGTH:
        return False
    ascii_letters = len(t.encode("ascii", "ignore").translate(None, _NOT_LETTERS))
    letters = ascii_letters + (0 if t.isascii() else sum(c.isalpha() for run in _OUTSIDE.findall(t) for c in run))
    return letters > 0 and ascii_letters >= ENGLISH_SHARE * letters and _ENGLISH.search(plain_words(t.lower())) is not None


def spans(text: Column, patterns: dict[str, str]) -> Column:
    """array<struct<start,end,text,label,score>> of the matches of each label's pattern, by start, end and label."""
    search = search_of(patterns)
    exact = {k: re.compile(p, re.I | re.A) for k, p in patterns.items()}
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("label", pa.string()), ("score", pa.float64())]))

    def work(texts: list[str]) -> pa.Array:
        plain = [plain_words(t) for t in texts]
        out: list[list[tuple]] = [[] for _ in texts]
        for label, found in search.found(plain).items():
            for i in np.flatnonzero(found):
                out[i] += [(*m.span(), label) for m in exact[label].finditer(plain[i])]
        return pa.array([[(s, e, t[s:e], x, 1.0) for s, e, x in sorted(o)] for t, o in zip(texts, out, strict=True)], kind)

    @arrow_udf("array<struct<start:int,end:int,text:string,label:string,score:double>>")
    def run(column: pa.Array) -> pa.Array:
        return by_steps(column, work)

    return run(text)
