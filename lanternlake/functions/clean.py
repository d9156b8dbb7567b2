"""Captions to clean text and to marked text for models.  A caption goes to Python once, for NFKC, and all other steps are taken
there: what a step looks for is first looked up as a plain string."""

from __future__ import annotations

import re
import sys
import unicodedata

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from .fixed import AGE, ANY_ACCOUNT, EMOJI, HASHTAG, LIKES_PREFIX, MENTION, ON_DATE, TRAILING_TAGS, UI_NOISE, URL
from .search import STEP, WHITE, squeeze, texts_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package on their path


def _rx(pattern: str) -> re.Pattern:
    """Pattern that ignores case, with Unicode's white space."""
    return re.compile(pattern.replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]"), re.I)


_QUOTES = str.maketrans("‘’“”–—", "''\"\"--")
_LIKES, _URL, _NOISE, _TAGS, _OTHER = map(_rx, (LIKES_PREFIX, URL, UI_NOISE, TRAILING_TAGS, r"^\s*@?" + ANY_ACCOUNT + r"\s+" + AGE))
_MENTION, _HASHTAG = re.compile(MENTION), re.compile(HASHTAG)
_EMOJI = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), EMOJI))
_BARS, _SPACES, _MARK = re.compile(f"[{WHITE}]*[|•·]+[{WHITE}]*"), re.compile(f"[{WHITE}]+"), re.compile(" ([,.;:!?])")
_RUNS = [(f"[{m}]", re.compile(rf"(?:\[{m}\][ \t\n\x0b\f\r]*){{2,}}")) for m in ("URL", "MENTION", "EMOJI")]
_ENDS = " \t\n\r\"'.,;:-–—"


def unify(t: str, compose: bool = True) -> str:
    """Plain punctuation, and NFKC unless the text is known to be stable."""
    if t.isascii():
        return t
    t = t.replace("\xa0", " ")
    return (unicodedata.normalize("NFKC", t) if compose else t).translate(_QUOTES).replace("…", "...")


def strip_ui(t: str) -> str:
    t = _LIKES.sub("", t).strip(WHITE)
    t = t[1:].strip(WHITE) if t.startswith('"') else t
    if t.endswith('".'):
        return t[:-2].rstrip(WHITE) + "."
    return t[:-1].strip(WHITE) if t.endswith('"') else t


def strip_account(t: str, account: str, heads: dict[str, list[re.Pattern]]) -> str:
    """heads: the patterns of accounts that were met."""
    t, name = t.strip(WHITE), account.strip(" ").lstrip("@").lower()
    if name and t.lstrip(" @").lower().startswith(name):
        if name not in heads:
            heads[name] = [_rx(r"^\s*@?" + re.escape(name) + x) for x in (ON_DATE, r"\s+" + AGE)]
        for head in heads[name]:
            t = head.sub("", t).strip(WHITE)
    return _OTHER.sub("", t).strip(WHITE)


def links(t: str, by: str) -> str:
    low = t.lower()
    return _URL.sub(by, t) if "http" in low or "www." in low else t


def core(t: str, account: str, compose: bool, heads: dict) -> str:
    """The caption's core: no UI text, prefixes, links, mentions, hashtags, emoji; single spaces; no marks at the ends."""
    t = strip_account(strip_ui(unify(t, compose)), account, heads)
    if "#" in t or "＃" in t:
        t = _TAGS.sub("", t).strip(WHITE)
    t = links(t, " ")
    t = _MENTION.sub(" ", t) if "@" in t else t
    t = _HASHTAG.sub(" ", t).replace("#", " ") if "#" in t else t
    t = t if t.isascii() else _EMOJI.sub(" ", t)
    low = t.lower().replace("ſ", "s")
    if any(x in low for x in ("view", "comment", "translat", "edited")):
        t = _NOISE.sub(" ", t)
    if "|" in t or "•" in t or "·" in t:
        t = _BARS.sub(" ", t)
    return _MARK.sub(r"\1", _SPACES.sub(" ", t)).strip(_ENDS)


def marked(t: str, tags: str, link: str, compose: bool) -> str:
    """Marked text for models; exact links and mentions are replaced by markers."""
    t = links(unify(t, compose), " [URL] ")
    t = _MENTION.sub(" [MENTION] ", t) if "@" in t else t
    t = _HASHTAG.sub(r" \1 ", t) if "#" in t else t
    t = t if t.isascii() else _EMOJI.sub(" [EMOJI] ", t)
    for mark, runs in _RUNS:
        t = runs.sub(f"{mark} ", t) if mark in t else t
    t = squeeze(t)
    parts = " ".join([*(["[CAPTION] " + t] if t else []), *(["[HASHTAGS] " + tags] if tags else [])])
    extra = ["[EXTERNAL_LINK] [URL]"] if link.strip(WHITE) and "[URL]" not in parts else []
    return " ".join([*([parts] if parts else []), *extra])


def clean_text(text: Column, account: Column, compose: bool = True) -> Column:
    @arrow_udf("string")
    def run(texts: pa.Array, accounts: pa.Array) -> pa.Array:
        heads: dict[str, list[re.Pattern]] = {}
        steps = range(0, max(1, len(texts)), STEP)
        return pa.concat_arrays([pa.array([core(t, a, compose, heads) for t, a in zip(texts_of(texts[k : k + STEP]), texts_of(accounts[k : k + STEP]), strict=True)], pa.string()) for k in steps])

    return run(text.cast("string"), account.cast("string"))


def model_text(text: Column, tags: Column, link: Column, compose: bool = True) -> Column:
    @arrow_udf("string")
    def run(*columns: pa.Array) -> pa.Array:
        steps = range(0, max(1, len(columns[0])), STEP)
        return pa.concat_arrays([pa.array([marked(t, x, y, compose) for t, x, y in zip(*(texts_of(c[k : k + STEP]) for c in columns), strict=True)], pa.string()) for k in steps])

    return run(text.cast("string"), tags.cast("string"), link.cast("string"))
