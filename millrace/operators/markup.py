"""Protecting what must pass through a rewrite unchanged: tags that are not HTML, in texts; and shell commands."""

from __future__ import annotations

import re
import shlex

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tags that are HTML.
HTML_TAGS = frozenset(
    "html base head link meta style title body address article aside footer h1 h2 h3 h4 h5 h6 header hgroup main nav section search blockquote dd div dl dt figcaption figure hr li menu ol p pre ul"
    " a abbr b bdi bdo br cite code data dfn em i kbd mark q rp rt ruby s samp small span strong sub sup time u var wbr area audio img map track video embed iframe object param picture portal source svg math"
    " canvas noscript script del ins caption col colgroup table tbody td tfoot th thead tr button datalist fieldset form input label legend meter optgroup option output progress select textarea details dialog summary slot template".split()
)
TAG = re.compile(r"""<(?:/([A-Za-z_][\w.:-]*)\s*>|([A-Za-z_][\w.:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>)""", re.A)


def is_html_tag(name: Column) -> Column:
    return F.lower(name).isin(*sorted(HTML_TAGS))


def spans(text: str, markers_only: bool = False) -> list[tuple[int, int]]:
    """The outermost stretches of custom tags: whole blocks and empty elements, or with markers_only the tags alone.

    A closing tag ends the last open one of its name, and what was open inside is text again."""
    found: list[tuple[int, int]] = []
    open_tags: list[tuple[str, int]] = []
    for m in TAG.finditer(text):
        closing, opening, rest = m.groups()
        name = (closing or opening).lower()
        if name in HTML_TAGS:
            continue
        if opening and rest.endswith("/"):
            found.append(m.span())
        elif opening:
            open_tags.append((name, m.start()))
            if markers_only:
                found.append(m.span())
        else:
            at = next((k for k in range(len(open_tags) - 1, -1, -1) if open_tags[k][0] == name), None)
            if at is None:
                continue
            begin = open_tags[at][1]
            del open_tags[at:]
            if markers_only:
                found.append(m.span())
            else:
                found = [s for s in found if s[0] < begin] + [(begin, m.end())]
    return found


def protected(text: str, markers_only: bool = False) -> tuple[str, list[str]]:
    """The text with a placeholder for each span, and the originals in order. The placeholder's
    name is lengthened until the text does not hold it."""
    name = "{{TAG_"
    while name in text:
        name += "X_"
    out, blocks, at = [], [], 0
    for begin, end in spans(text, markers_only):
        out += [text[at:begin], f"{name}{len(blocks)}}}}}"]
        blocks.append(text[begin:end])
        at = end
    return "".join([*out, text[at:]]), blocks


def protect(texts: DataFrame, markers_only: bool = False) -> DataFrame:
    """doc_id, text with placeholders, blocks (array of placeholder and original). texts: doc_id, text."""

    def run(batches):
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                clean, blocks = protected(text or "", markers_only)
                names = re.findall(r"\{\{TAG_(?:X_)*\d+\}\}", clean)[-len(blocks) :] if blocks else []
                rows.append((clean, [{"placeholder": n, "original": b} for n, b in zip(names, blocks, strict=True)]))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [r[0] for r in rows], "blocks": [r[1] for r in rows]})

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, text string, blocks array<struct<placeholder:string,original:string>>")


def restored(text: Column, blocks: Column) -> Column:
    """The text with its originals back."""
    return F.aggregate(blocks, text, lambda t, b: F.replace(t, b["placeholder"], b["original"]))


def shell_parts(command: str) -> list[tuple[str, str]]:
    """(operator before, segment) of a command line, outside of quotes: && || | ;"""
    quoted = r"""(?:\\.|'[^']*'|"(?:\\.|[^"\\])*"|&(?!&)|[^\\'"&|;])"""
    out, operator = [], ""
    for m in re.finditer(rf"(&&|\|\||\||;)|({quoted}+)", command):
        if m[1]:
            operator = m[1]
        elif m[2].strip():
            out.append((operator, m[2].strip()))
            operator = ""
    return out


def rewritten(command: str, supported, prefix: str) -> str:
    """A command line whose supported parts run behind `prefix`; a part that reads a pipe is left, redirects stay behind."""
    out = []
    for operator, part in shell_parts(command):
        m = re.match(r"""((?:\\.|'[^']*'|"(?:\\.|[^"\\])*"|[^\\'"<>])*)(.*)""", part, re.S)
        body, redirects = m[1].strip(), m[2].strip()
        try:
            words = shlex.split(body)
        except ValueError:
            words = []
        if operator:
            out.append(operator)
        if words and operator != "|" and supported(" ".join(words)):
            out.append(" ".join(x for x in (prefix, body, redirects) if x))
        else:
            out.append(part)
    return " ".join(out)
