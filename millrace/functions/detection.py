"""Content detection: confidences per type as columns, and the ordered gate chain over them.

All probes are per-line predicates over array columns of the first lines of a text, so
detection is one projection: no shuffle, no UDF.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns and thresholds that define each content type.
SEARCH = r"^[^\s:]+:\d+:"
DIFF_HEADER = r"^(diff --git|diff --combined |diff --cc |--- a/|@@\s+-\d+,\d+\s+\+\d+,\d+\s+@@|@@@+\s+-\d+(?:,\d+)?\s+(?:-\d+(?:,\d+)?\s+)+\+\d+(?:,\d+)?\s+@@@+)"
DIFF_CHANGE = r"^[+-][^+-]"
LOG = [
    r"(?i)\b(ERROR|FAIL|FAILED|FATAL|CRITICAL)\b",
    r"(?i)\b(WARN|WARNING)\b",
    r"(?i)\b(INFO|DEBUG|TRACE)\b",
    r"^\s*\d{4}-\d{2}-\d{2}",
    r"^\s*\[\d{2}:\d{2}:\d{2}\]",
    r"^={3,}|^-{3,}",
    r"^\s*PASSED|^\s*FAILED|^\s*SKIPPED",
    r"^npm ERR!|^yarn error|^cargo error",
    r"Traceback \(most recent call last\)",
    r"^\s*at\s+[\w.$]+\(",
]
CODE = {
    "python": [r"^\s*(def|class|import|from|async def)\s+\w+", r"^\s*@\w+", r'^\s*"""', r"^\s*if __name__\s*=="],
    "javascript": [r"^\s*(function|const|let|var|class|import|export)\s+", r"^\s*(async\s+function|=>\s*\{)", r"^\s*module\.exports"],
    "typescript": [r"^\s*(interface|type|enum|namespace)\s+\w+", r"^:\s*(string|number|boolean|any|void)\b"],
    "go": [r"^\s*(func|type|package|import)\s+", r"^\s*func\s+\([^)]+\)\s+\w+"],
    "rust": [r"^\s*(fn|struct|enum|impl|mod|use|pub)\s+", r"^\s*#\["],
    "java": [r"^\s*(public|private|protected)\s+(class|interface|enum)", r"^\s*@\w+", r"^\s*package\s+[\w.]+;"],
}
DOCTYPE, HTML, HEAD, BODY = r"(?i)^\s*<!doctype\s+html", r"(?i)<html[\s>]", r"(?i)<head[\s>]", r"(?i)<body[\s>]"
STRUCTURE = r"(?i)<(div|span|script|style|link|meta|nav|header|footer|aside|article|section|main)[\s>]"
HTML_SAMPLE = 3000


#: The classes that patterns mean by these letters: of all scripts, not of ASCII.
_CLASSES = {r"\w": r"\p{L}\p{M}\p{N}_", r"\s": r"\t\n\x0b\f\r \x85\p{Z}", r"\d": r"\p{Nd}"}
SPACE, FILLED = f"[{_CLASSES[chr(92) + 's']}]", f"[^{_CLASSES[chr(92) + 's']}]"


def of_all_scripts(pattern: str) -> str:
    """A pattern with its classes and word boundaries spelled out, alike for every regular expression engine."""
    out, inside, i = "", False, 0
    word = _CLASSES[r"\w"]
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b":
            out += f"(?:^|[^{word}])" if out in ("", "(?i)") else f"(?:$|[^{word}])"
        elif two in _CLASSES:
            out += _CLASSES[two] if inside else f"[{_CLASSES[two]}]"
        elif two[0] == "\\":
            out += two
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out += two[0]
            i -= 1
        i += 2
    return out


SEARCH, DIFF_HEADER, DOCTYPE = map(of_all_scripts, (SEARCH, DIFF_HEADER, DOCTYPE))
HTML, HEAD, BODY, STRUCTURE = map(of_all_scripts, (HTML, HEAD, BODY, STRUCTURE))
LOG = [of_all_scripts(p) for p in LOG]
CODE = {name: [of_all_scripts(p) for p in patterns] for name, patterns in CODE.items()}


def any_of(patterns: list[str]) -> str:
    """One pattern for several; a case-insensitive member keeps its flag to itself."""
    return "|".join(f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for p in patterns)


def anchored(patterns: list[str]) -> str:
    """One pattern for several that all match at the begin of a line; it is tried there only."""
    return f"^(?:{any_of(patterns)})"


#: Words without which no pattern of levels matches, in lower case.
LEVEL_ROOTS = ["error", "fail", "fatal", "critical", "warn", "info", "debug", "trace"]
TRACEBACK = "Traceback (most recent call last)"


def log_hits(lines: Column, levels: Column) -> Column:
    """How many lines match a pattern of logs; levels: whether a text has any of LEVEL_ROOTS."""
    begins = anchored([p for p in LOG[3:] if p.startswith("^")])
    return F.when(levels, F.size(F.filter(lines, lambda x: x.rlike(begins) | x.contains(TRACEBACK) | x.rlike(any_of(LOG[:3]))))).otherwise(F.size(F.filter(lines, lambda x: x.rlike(begins) | x.contains(TRACEBACK))))


def stripped(text: Column) -> Column:
    """text without white space of any script at its ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def blank(text: Column) -> Column:
    return ~text.rlike(FILLED)


def lines_of(text: Column, most: int) -> Column:
    """The first lines of a text; what follows them is not split."""
    return F.slice(F.split(text, "\n", most + 1), 1, most)


def count_lines(lines: Column, pattern: str) -> Column:
    return F.size(F.filter(lines, lambda x: x.rlike(pattern)))


def filled(lines: Column) -> Column:
    return F.size(F.filter(lines, lambda x: ~blank(x)))


def json_confidence(text: Column) -> Column:
    """1 for a non-empty array of objects, 0.8 for another array, null else."""
    body = F.when(text.rlike(f"^{SPACE}*\\["), stripped(text))
    parsed = F.try_parse_json(body)
    items = F.when(parsed.isNotNull(), F.from_json(body, "array<string>"))
    dicts = (F.size(items) > 0) & F.forall(items, lambda x: F.coalesce(x.rlike(f"^{SPACE}*\\{{"), F.lit(False)))
    return F.when(parsed.isNotNull(), F.when(dicts, 1.0).otherwise(0.8))


def diff_confidence(text: Column) -> Column:
    lines = lines_of(text, 500)
    headers, changes = count_lines(lines, DIFF_HEADER), count_lines(lines, DIFF_CHANGE)
    return F.when(headers > 0, F.least(F.lit(1.0), 0.5 + headers * 0.2 + changes * 0.05))


def byte_prefix(text: Column, most: int) -> Column:
    """The longest prefix of at most `most` bytes that ends with a whole character."""
    head = F.substring(text.cast("binary"), 1, most)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.regexp_replace(F.decode(head, "UTF-8"), "�+$", ""))


def html_confidence(text: Column) -> Column:
    sample = F.left(text, F.lit(HTML_SAMPLE))
    tags = F.regexp_count(sample, F.lit(STRUCTURE))
    doctype, html = sample.rlike(DOCTYPE), sample.rlike(HTML)
    score = F.least(F.lit(1.0), F.when(doctype, 0.5).otherwise(0.0) + F.when(html, 0.3).otherwise(0.0) + F.when(sample.rlike(HEAD), 0.1).otherwise(0.0) + F.when(sample.rlike(BODY), 0.1).otherwise(0.0) + F.least(F.lit(0.3), tags * 0.03))
    return F.when((doctype | html | (tags >= 3)) & (score >= 0.5), score)


def search_confidence(text: Column) -> Column:
    lines = lines_of(text, 100)
    hits, full = count_lines(lines, SEARCH), filled(lines)
    ratio = hits / F.nullif(full, F.lit(0))
    return F.when((hits > 0) & (ratio >= 0.3), F.least(F.lit(1.0), 0.4 + ratio * 0.6))


def log_confidence(text: Column) -> Column:
    lines = lines_of(text, 200)
    hits, errors, full = count_lines(lines, any_of(LOG)), count_lines(lines, any_of(LOG[:2])), filled(lines)
    ratio = hits / F.nullif(full, F.lit(0))
    return F.when((hits > 0) & (ratio >= 0.1), F.least(F.lit(1.0), 0.3 + ratio * 0.5 + errors * 0.05))


def _places(lines: Column, pattern: str) -> Column:
    """The indices of the lines that match."""
    return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(pattern), i)), lambda i: i.isNotNull())


def code_scores(text: Column) -> Column:
    """array of (lines matched, -index of the first such line, -rank, language)."""
    lines = lines_of(text, 100)
    made = []
    for rank, (name, patterns) in enumerate(CODE.items()):
        hits = _places(lines, any_of(patterns))
        made.append(F.struct(F.size(hits).alias("n"), (-F.coalesce(F.get(hits, F.lit(0)), F.lit(1000))).alias("first"), F.lit(-rank).alias("rank"), F.lit(name).alias("language")))
    return F.array_max(F.array(*made))


def code_confidence(text: Column) -> Column:
    best = code_scores(text)["n"]
    full = F.greatest(filled(lines_of(text, 100)), F.lit(1))
    return F.when(best >= 3, F.least(F.lit(1.0), 0.4 + best / full * 0.4 + best * 0.02))


def content_type(text: Column) -> Column:
    """json_array, diff, html, search, build, source_code or text, first gate first."""
    return (
        F.when(blank(F.coalesce(text, F.lit(""))), "text")
        .when(json_confidence(text).isNotNull(), "json_array")
        .when(diff_confidence(text) >= 0.7, "diff")
        .when(html_confidence(text) >= 0.7, "html")
        .when(search_confidence(text) >= 0.6, "search")
        .when(log_confidence(text) >= 0.5, "build")
        .when(code_confidence(text) >= 0.5, "source_code")
        .otherwise("text")
    )


def with_content_type(df: DataFrame, text: str = "text", out: str = "content_type") -> DataFrame:
    """df with the content type of a text, as content_type gives it, in steps.

    Lines are split once and bounded, counts that a score uses twice are columns of their own,
    and a gate's patterns run only on texts that no earlier gate has taken."""
    body, c = F.coalesce(F.col(text), F.lit("")), F.col
    d = df.withColumn("__t", F.when(blank(body), "text"))
    d = d.withColumn("__t", F.when(c("__t").isNull() & json_confidence(body).isNotNull(), "json_array").otherwise(c("__t")))
    d = d.withColumn("__lines", F.when(c("__t").isNull(), lines_of(body, 500)))
    d = d.withColumn("__n", count_lines(c("__lines"), DIFF_HEADER))
    changes = count_lines(c("__lines"), DIFF_CHANGE)
    d = d.withColumn("__t", F.when((c("__n") > 0) & (0.5 + c("__n") * 0.2 + changes * 0.05 >= 0.7), "diff").otherwise(c("__t")))
    sample = F.left(body, F.lit(HTML_SAMPLE))
    d = d.withColumn("__t", F.when(c("__t").isNull() & sample.contains("<"), F.when(html_confidence(body) >= 0.7, "html")).otherwise(c("__t")))
    d = d.withColumn("__lines", F.when(c("__t").isNull(), F.slice("__lines", 1, 200)))
    few = F.slice("__lines", 1, 100)
    d = d.withColumns({"__n": count_lines(few, SEARCH), "__filled": filled(few)})
    low = d.withColumn("__low", F.when(c("__t").isNull(), F.lower(body)))
    d = low.withColumn("__levels", reduce(or_, [c("__low").contains(w) for w in LEVEL_ROOTS])).drop("__low")
    ratio = c("__n") / F.nullif(c("__filled"), F.lit(0))
    d = d.withColumn("__t", F.when((c("__n") > 0) & (ratio >= 0.3) & (0.4 + ratio * 0.6 >= 0.6), "search").otherwise(c("__t")))
    d = d.withColumns({"__n": F.when(c("__t").isNull(), log_hits(c("__lines"), c("__levels"))), "__all": F.when(c("__t").isNull(), filled(c("__lines")))})
    ratio, errors = c("__n") / F.nullif(c("__all"), F.lit(0)), count_lines(c("__lines"), any_of(LOG[:2]))
    d = d.withColumn("__t", F.when((c("__n") > 0) & (ratio >= 0.1) & (0.3 + ratio * 0.5 + errors * 0.05 >= 0.5), "build").otherwise(c("__t")))
    # A language needs three lines, so texts with fewer lines of any language have none.
    d = d.withColumn("__n", F.when(c("__t").isNull(), count_lines(few, anchored([p for some in CODE.values() for p in some]))))
    d = d.withColumn("__n", F.when(c("__n") >= 3, F.greatest(*[count_lines(few, anchored(p)) for p in CODE.values()])))
    code = (c("__n") >= 3) & (0.4 + c("__n") / F.greatest(c("__filled"), F.lit(1)) * 0.4 + c("__n") * 0.02 >= 0.5)
    return d.withColumn(out, F.when(c("__t").isNull() & code, "source_code").otherwise(F.coalesce(c("__t"), F.lit("text")))).drop("__t", "__lines", "__n", "__filled", "__all", "__levels")


# Labels of an outer detector by content type.
LABELS = {
    "json_array": ["json", "jsonl"],
    "diff": ["diff"],
    "html": ["html", "xml"],
    "source_code": ["rust", "python", "javascript", "typescript", "go", "java", "c", "cpp", "cs", "php", "ruby", "swift", "kotlin", "scala", "haskell", "lua", "dart", "perl", "shell", "powershell", "batch", "sql", "css", "vue", "groovy", "clojure", "asm", "cmake", "dockerfile", "makefile", "yaml", "toml", "ini", "hcl", "jinja"],
}


def type_of_label(label: Column) -> Column:
    out = F.when(F.lit(False), "text")
    for name, labels in LABELS.items():
        out = out.when(label.isin(labels), name)
    return out.otherwise("text")


def looks_like_yaml(text: Column) -> Column:
    """Two keyed lines, or one and an indented list item, in the first fifty lines."""
    lines = F.filter(lines_of(text, 50), lambda x: ~blank(x) & ~x.rlike(f"^{SPACE}*#"))
    listed = F.size(F.filter(lines, lambda x: x.rlike(r"^ +- ")))
    keyed = F.size(F.filter(lines, lambda x: ~x.rlike(r"^ +- ") & x.rlike(f"^{SPACE}*[A-Za-z0-9_-]+:")))
    return (keyed >= 2) | ((keyed >= 1) & (listed >= 1))


def looks_like_source(text: Column) -> Column:
    low = F.lower(text)
    hit = text.rlike(f"^{SPACE}*#!") | low.rlike("const |let |async |=>|def |class ") | (low.contains("select ") & low.contains(" from ")) | (low.contains(" where ") & low.contains(" join "))
    return hit | looks_like_yaml(text)


def fallback_type(text: Column) -> Column:
    """The type by the gates above, but any JSON counts, and source is tried once more by its words."""
    gate = content_type(text)
    return F.when(text == "", "text").when(diff_confidence(text).isNotNull(), "diff").when(F.try_parse_json(text).isNotNull(), "json_array").when(gate != "text", gate).when(looks_like_source(text), "source_code").otherwise("text")
