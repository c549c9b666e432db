"""Wikitext to prose: pattern rules as expressions, nesting by one Arrow UDF over a token stack."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values, which decide what counts as prose: link targets that are none, redirect words, headings after which nothing is, elements
# without any, and the patterns of markup in the order in which they apply.
NO_PROSE_TARGETS = "파일|그림|이미지|분류|틀|File|Image|Category|Template|미디어|Media"
REDIRECTS = "redirect|넘겨주기"
TAIL_HEADINGS = "각주|주석|참고 ?문헌|외부 ?링크|같이 ?보기|더 ?보기|참조|출처"
NO_PROSE_ELEMENTS = "gallery table math score timeline syntaxhighlight source imagemap".split()
COMMENT, REFERENCE, REFERENCE_SPAN, ELEMENT_SPAN = r"<!--.*?-->", r"<ref[^>]*/>", r"<ref[^>]*>.*?</ref>", r"<{0}[^>]*>.*?</{0}>"
LABELLED_URL, BARE_URL, OPEN_URL = r"\[(?:https?|ftp)://\S+?\s+([^\]]*)\]", r"\[(?:https?|ftp)://\S+?\]", r"\[(?:https?|ftp)://\S+"
ELEMENT = r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>"
HEADING, BULLET, QUOTES, RULE, BLANKS, GAP = r"^\s*=+\s*(.*?)\s*=+\s*$", r"^[*#:;]+\s*", r"'{2,}", r"^\s*-{4,}\s*$", r"[ \t]+", r"\n{3,}"

_TARGET = re.compile(rf"^(?:{NO_PROSE_TARGETS}):", re.I)
_TAIL = re.compile(rf"^(?:{TAIL_HEADINGS})\s*$", re.M)
_TAKEN_OUT = [re.compile(COMMENT, re.S), re.compile(REFERENCE, re.I), re.compile(REFERENCE_SPAN, re.S | re.I)]
_TAKEN_OUT += [re.compile(ELEMENT_SPAN.format(e), re.S | re.I) for e in NO_PROSE_ELEMENTS]
_EXTERNAL = [(re.compile(LABELLED_URL), r"\1"), (re.compile(BARE_URL), ""), (re.compile(OPEN_URL), "")]
_ELEMENT = re.compile(ELEMENT)
_LINES = [(re.compile(p, re.M), by) for p, by in ((HEADING, r"\1"), (BULLET, ""), (QUOTES, ""), (RULE, ""), (BLANKS, " "), (GAP, "\n\n"))]


def without_nested(text: str, opening: str, closing: str) -> str:
    """Drop balanced spans, inner ones with them. A span that never closes loses its opening sign only and keeps the rest."""
    marks = re.compile(f"({re.escape(opening)})|{re.escape(closing)}")
    kept, depth, begun, at = [], 0, 0, 0
    for m in marks.finditer(text):
        if m.group(1):
            if depth == 0:
                kept.append(text[at : m.start()])
                begun = m.start()
            depth += 1
        elif depth:
            depth -= 1
            at = m.end()
    return "".join(kept) + (text[begun + len(opening) :] if depth else text[at:])


def with_labels(text: str) -> str:
    """Links as their labels, those to no prose dropped. Each open link is a frame; a link that never closes is only its sign.

    A label is what follows the last bar of the raw link, inner links included: a bar inside an inner link counts too, and then
    the end of that inner link stays as it stands.
    """
    pairs, open_at = {}, []
    for m in re.finditer(r"\[\[|\]\]", text):
        if m.group() == "[[":
            open_at.append(m.start())
        elif open_at:
            pairs[open_at.pop()] = m.start()
    return _labels(text, 0, len(text), pairs)


def _labels(text: str, a: int, b: int, pairs: dict[int, int]) -> str:
    out = []
    while (at := text.find("[[", a, b)) >= 0:
        out.append(text[a:at])
        end = pairs.get(at)
        if end is None or end + 2 > b:
            a = at + 2
            continue
        inner = text[at + 2 : end]
        if not _TARGET.match(inner.strip()):
            bar = inner.rfind("|")
            start = at + 2 + bar + 1
            out.append(_labels(text, start, end, pairs))
        a = end + 2
    out.append(text[a:b])
    return "".join(out)


def prose(body: str) -> str:
    """Prose of an article's wikitext, up to its lists of references and links."""
    for pattern in _TAKEN_OUT:
        body = pattern.sub("", body)
    body = with_labels(without_nested(without_nested(body, "{|", "|}"), "{{", "}}"))
    for pattern, by in _EXTERNAL:
        body = pattern.sub(by, body)
    body = html.unescape(_ELEMENT.sub("", body))
    for pattern, by in _LINES:
        body = pattern.sub(by, body)
    body = body.strip()
    tail = _TAIL.search(body)
    return body[: tail.start()].strip() if tail else body


@F.pandas_udf(T.StringType())
def wikitext_to_prose(bodies: pd.Series) -> pd.Series:
    """``prose`` of each body."""
    return bodies.map(prose, na_action="ignore")
