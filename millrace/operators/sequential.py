"""The few scans that depend on the order of a document's lines: stack traces and log templates.

Each document goes through one ordered pass in an Arrow batch (applyInPandas by document).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

TRACE_LINES, SIMILAR, MIN_LINES, MIN_RUN, MIN_CONSTANT = 20, 0.4, 20, 3, 2
# How a frame of each kind of trace begins, and what goes on with it.
OPENS = [
    ("python", re.compile(r'^\s*(Traceback \(most recent call last\)|File ".*", line .*\d$)')),
    ("js", re.compile(r"^\s*at (?=.*\()(?=.*\)).*:\d+:\d")),
    ("java", re.compile(r"^\s*at [A-Za-z0-9._$]+\(")),
    ("rust", re.compile(r"^\s*--> .*:\d+:\d")),
    ("go", re.compile(r"^\s*\d+: *0x[0-9a-fA-F]")),
]
#: Any of them, for the engine's own regular expressions: logs without such a line have no trace.
OPENING = "(?U)" + "|".join(f"(?:{shape.pattern})" for _, shape in OPENS)
STAYS = {
    "python": re.compile(r"^([ \t]|$|Traceback|File |During handling|The above exception|[^\W\d_a-z])"),
    "js": re.compile(r"^(\s*at |$)"),
    "java": re.compile(r"^(\s*at |$)"),
    "rust": re.compile(r"^(\s*--> |$)"),
    "go": re.compile(r"^(\s*\d|$)"),
}


def opening(line: str) -> str | None:
    return next((kind for kind, shape in OPENS if shape.search(line)), None)


def trace_flags(lines: list[str], most: int = TRACE_LINES) -> list[bool]:
    """Which lines belong to a stack trace; a trace ends with its kind, or after `most` lines."""
    flags, active, n = [], None, 0
    for line in lines:
        if active and n < most and STAYS[active].search(line):
            n += 1
        else:
            active, n = opening(line), 1
        flags.append(active is not None)
    return flags


def stack_traces(lines: DataFrame) -> DataFrame:
    """doc_id, pos, trace_no of the lines that belong to stack traces. lines: doc_id, pos, content."""
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        flag = pd.Series(trace_flags(pdf["content"].tolist()), index=pdf.index)
        number = (flag & ~flag.shift(fill_value=False)).cumsum()
        return pd.DataFrame({"doc_id": key[0], "pos": pdf["pos"][flag], "trace_no": number[flag]})

    kind = lines.schema["doc_id"].dataType.simpleString()
    return lines.groupBy("doc_id").applyInPandas(run, f"doc_id {kind}, pos long, trace_no long")


def templated(text: str) -> str:
    """A log with runs of alike lines as one template and the values that vary; the text itself if that is not shorter."""
    lines = text.split("\n")
    if text.endswith("\n"):
        lines.pop()
    if len(lines) < MIN_LINES:
        return text
    out, run, template, made = [], [], [], 0

    def flush() -> None:
        nonlocal made
        constant = sum(t is not None for t in template)
        if len(run) >= MIN_RUN and constant >= MIN_CONSTANT and constant < len(template):
            made += 1
            out.append(f"[Template T{made}: {' '.join('<*>' if t is None else t for t in template)}] ({len(run)} occurrences)")
            out.extend(" ".join(w for w, t in zip(lines[i].split(), template, strict=True) if t is None) for i in run)
        else:
            out.extend(lines[i] for i in run)

    for i, line in enumerate(lines):
        words = line.split()
        alike = sum(t is None or t == w for w, t in zip(words, template, strict=False)) if len(words) == len(template) else 0
        if words and run and len(words) == len(template) and alike / len(words) >= SIMILAR:
            run.append(i)
            template = [t if t == w else None for w, t in zip(words, template, strict=True)]
            continue
        if run:
            flush()
        run, template = ([i], words) if words else ([], [])
        if not words:
            out.append(line)
    if run:
        flush()
    found = "\n".join(out) + ("\n" if text.endswith("\n") else "")
    return found if len(found.encode()) < len(text.encode()) else text


def log_templates(texts: DataFrame) -> DataFrame:
    """doc_id, text with alike lines folded. texts: doc_id, text."""
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": pdf["text"].map(templated)})

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, text string")
