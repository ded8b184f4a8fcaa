"""Nested documents and raw requests: recursive tables, opaque strings as markers, and edits of single byte spans.

JSON is edited in its own text: a scanner yields each string with its place, so everything
outside a replaced span stays byte for byte what it was, number literals and key order too.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from millrace.functions.text import HTML_TAGS, OPAQUE_BYTES, OPAQUE_LETTERS, OPAQUE_SHARE, SENSITIVE

from .sequential import templated

LEAST_BYTES, DEPTH = 512, 50
#: Fields whose strings are content, in requests of any shape.
CONTENT_KEYS = {"content", "text", "input", "output", "tool_output", "arguments"}
OUTPUT_TYPES = {"function_call_output", "local_shell_call_output", "apply_patch_call_output"}
_SPACE = re.compile(r"[ \t\n\r]*")
_OTHER = re.compile(r"[^,\]}\s]+")
_OUTSIDE = re.compile(r'("(?:[^"\\]|\\.)*")|\s+')


def strings(raw: str) -> Iterator[tuple[tuple, int, int, str]]:
    """(path, begin, end, value) of every string value of a JSON text, quotes included in the span."""

    def value(at: int, path: tuple) -> Iterator:
        at = _SPACE.match(raw, at).end()
        c = raw[at : at + 1]
        if c == '"':
            text, end = json.decoder.scanstring(raw, at + 1)
            yield path, at, end, text
            return end
        if c in ("{", "["):
            close, k = ("}" if c == "{" else "]"), 0
            at = _SPACE.match(raw, at + 1).end()
            while raw[at : at + 1] != close:
                key = k
                if c == "{":
                    if raw[at : at + 1] != '"':
                        raise ValueError("a key is missing")
                    key, at = json.decoder.scanstring(raw, at + 1)
                    at = _SPACE.match(raw, at).end()
                    if raw[at : at + 1] != ":":
                        raise ValueError("a colon is missing")
                    at += 1
                at = yield from value(at, (*path, key))
                at, k = _SPACE.match(raw, at).end(), k + 1
                if raw[at : at + 1] == ",":
                    at = _SPACE.match(raw, at + 1).end()
                elif raw[at : at + 1] != close:
                    raise ValueError("the text ends too early")
            return at + 1
        return _OTHER.match(raw, at).end()

    yield from value(0, ())


def spliced(raw: str, edits: list[tuple[int, int, str]]) -> str:
    """raw with spans replaced; edits do not overlap."""
    out, at = [], 0
    for begin, end, text in sorted(edits):
        out += [raw[at:begin], text]
        at = end
    return "".join([*out, raw[at:]])


def tokens(text: str) -> int:
    return 0 if not text else max(1, int(len(text) / 4 + 0.5))


def shorter(text: str) -> str:
    """The lossless rewrite of a block that needs fewer tokens, or the block itself."""
    small = templated(text)
    if text.lstrip()[:1] in ("[", "{"):
        try:
            json.loads(text)
            small = _OUTSIDE.sub(r"\1", text)
        except ValueError:
            pass
    return small if tokens(small) < tokens(text) else text


class _Literal(float):
    """A number that is written as it was read."""

    def __new__(cls, literal: str):
        made = super().__new__(cls, float(literal))
        made.literal = literal
        return made


def dumped(v) -> str:
    """Compact JSON with keys in order and numbers as they were read."""
    if isinstance(v, _Literal):
        return v.literal
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dumped(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(dumped, v)) + "]"
    return json.dumps(v, ensure_ascii=False)


def rewritten(raw: str, chosen: Callable[[tuple, str], bool], compress: Callable[[str], str] = shorter) -> tuple[str, int, int]:
    """(request, blocks changed, tokens saved): chosen strings of a request, each replaced if that needs fewer tokens."""
    edits, saved = [], 0
    for path, begin, end, text in strings(raw):
        if len(text.encode()) >= LEAST_BYTES and chosen(path, text):
            small = compress(text)
            if tokens(small) < tokens(text):
                edits.append((begin, end, json.dumps(small, ensure_ascii=False)))
                saved += tokens(text) - tokens(small)
    return spliced(raw, edits), len(edits), saved


def live_strings(raw: str) -> Callable[[tuple, str], bool]:
    """Chooses the live blocks of a request: of `messages` the strings of the latest user or tool
    message behind the last cache mark, of `input` the outputs of calls (but those of retrieve calls)."""
    body = json.loads(raw)
    messages, items = body.get("messages") or [], body.get("input")
    marked = [i for i, m in enumerate(messages) if "cache_control" in json.dumps(m.get("content", ""))]
    floor = marked[-1] + 1 if marked else 0
    live = {max((i for i, m in enumerate(messages) if i >= floor and m.get("role") == role), default=-1) for role in ("user", "tool")} - {-1}
    retrieves = {x.get("call_id") for x in items if isinstance(x, dict) and "retrieve" in str(x.get("name"))} if isinstance(items, list) else set()
    outputs = {i for i, x in enumerate(items) if isinstance(x, dict) and x.get("type") in OUTPUT_TYPES and x.get("call_id") not in retrieves} if isinstance(items, list) else set()

    def chosen(path: tuple, text: str) -> bool:
        if path[:1] == ("messages",):
            return path[1] in live and path[-1] in ("content", "text")
        return path[:1] == ("input",) and len(path) > 1 and path[1] in outputs and path[-1] == "output"

    return chosen


def any_content(path: tuple, text: str) -> bool:
    return any(isinstance(k, str) and k in CONTENT_KEYS for k in path[-2:])


def rewrite_requests(requests: DataFrame) -> DataFrame:
    """req_id, body, blocks, tokens_saved, status: each request with its live blocks shortened; one
    that does not parse passes unchanged with its status. requests: req_id, body."""

    def run(batches):
        for pdf in batches:
            rows = []
            for raw in pdf["body"]:
                try:
                    rows.append((*rewritten(raw, live_strings(raw)), "ok"))
                except (ValueError, AttributeError, TypeError):
                    rows.append((raw, 0, 0, "unparsed"))
            yield pd.DataFrame({"req_id": pdf["req_id"], **{n: [r[i] for r in rows] for i, n in enumerate(("body", "blocks", "tokens_saved", "status"))}})

    kind = requests.schema["req_id"].dataType.simpleString()
    return requests.select("req_id", "body").mapInPandas(run, f"req_id {kind}, body string, blocks long, tokens_saved long, status string")


def opaque_kind(text: str) -> str | None:
    if len(text.encode()) <= OPAQUE_BYTES:
        return None
    if len(re.findall(r"[A-Za-z0-9+/=_-]", text)) >= OPAQUE_SHARE * len(text) and len(set(text)) >= OPAQUE_LETTERS:
        return "base64"
    return "html" if len(re.findall(r"<[A-Za-z/!]", text)) >= HTML_TAGS else "string"


def marker(text: str, kind: str) -> str:
    n = len(text.encode())
    size = f"{n}B" if n < 1024 else f"{n / 1024:.1f}KB" if n < 1 << 20 else f"{n / (1 << 20):.1f}MB"
    return f"<<ccr:{hashlib.sha256(text.encode()).hexdigest()[:12]},{kind},{size}>>"


def _cell(v) -> str:
    if v is None:
        return ""
    text = "true" if v is True else "false" if v is False else v if isinstance(v, str) else dumped(v)
    return '"' + text.replace('"', '""') + '"' if re.search('[,"\n\r]', text) else text


def _tag(v) -> str:
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, _Literal):
        return "int" if re.fullmatch(r"-?\d+", v.literal) else "float"
    return "string" if isinstance(v, str) else "json"


MOST_INNER = 6


def flattened(items: list[dict]) -> list[dict]:
    """Items whose dicts of one shape (at most MOST_INNER keys, in one order) are columns `name.key`; one level deep."""
    shapes: dict[str, set] = {}
    for x in items:
        for k, v in x.items():
            if v is not None:
                shapes.setdefault(k, set()).add(tuple(v) if isinstance(v, dict) else None)
    flat = {k: next(iter(s)) for k, s in shapes.items() if len(s) == 1 and None not in s and 0 < len(next(iter(s))) <= MOST_INNER}
    if not flat:
        return items
    out = []
    for x in items:
        row: dict = {}
        for k, v in x.items():
            row.update({f"{k}.{inner}": None if v is None else v[inner] for inner in flat[k]} if k in flat else {k: v})
        out.append(row)
    return out


def table(items: list[dict]) -> str:
    """`[N]{name:type?,...}` and a CSV row per item; columns by frequency, then name."""
    items = flattened(items)
    freq: dict[str, int] = {}
    for x in items:
        for k in x:
            freq[k] = freq.get(k, 0) + 1
    keys = sorted(freq, key=lambda k: (-freq[k], k))
    specs = []
    for k in keys:
        tags = {_tag(x[k]) for x in items if x.get(k) is not None}
        nullable = freq[k] < len(items) or any(k in x and x[k] is None for x in items)
        specs.append(f"{k}:{tags.pop() if len(tags) == 1 else 'json' if tags else 'string'}{'?' if nullable else ''}")
    return f"[{len(items)}]{{{','.join(specs)}}}\n" + "".join(",".join(_cell(x.get(k)) for k in keys) + "\n" for x in items)


def compacted(v, store: dict[str, str], depth: int = 0):
    """A document with its arrays of dicts as tables and opaque strings as markers; store takes what markers name."""
    if depth > DEPTH:
        return v
    if isinstance(v, dict):
        return {k: compacted(x, store, depth + 1) for k, x in v.items()}
    if isinstance(v, list):
        inner = [compacted(x, store, depth + 1) for x in v]
        return table(inner) if len(inner) >= 2 and all(isinstance(x, dict) for x in inner) else inner
    if isinstance(v, str):
        if v.lstrip()[:1] in ("{", "["):
            try:
                found = compacted(json.loads(v, parse_float=_Literal, parse_int=_Literal), store, depth + 1)
                return found if isinstance(found, str) else dumped(found)
            except ValueError:
                pass
        kind = opaque_kind(v)
        if kind:
            made = marker(v, kind)
            store[made[6:18]] = v
            return made
    return v


def compact_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text, kept (map of hash to what a marker names). docs: doc_id, text; what is no JSON stays."""

    def run(batches):
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                store: dict[str, str] = {}
                try:
                    found = compacted(json.loads(text, parse_float=_Literal, parse_int=_Literal), store)
                    out.append((found if isinstance(found, str) else dumped(found), store))
                except (ValueError, TypeError):
                    out.append((text, {}))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [t for t, _ in out], "kept": [s for _, s in out]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, text string, kept map<string,string>")


def pretty(v, margin: str = "\n") -> str:
    """JSON indented by two blanks, with keys in order and numbers as they were read."""
    inner = margin + "  "
    if isinstance(v, dict) and v:
        return "{" + inner + f",{inner}".join(f"{json.dumps(k, ensure_ascii=False)}: {pretty(x, inner)}" for k, x in v.items()) + margin + "}"
    if isinstance(v, list) and v:
        return "[" + inner + f",{inner}".join(pretty(x, inner) for x in v) + margin + "]"
    return dumped(v)


def sanitized(v, longest: int, done: list[int]):
    """A document with sensitive fields redacted and texts of `longest` bytes or more replaced, at any
    depth; done counts the fields and the texts."""
    if isinstance(v, dict):
        out = {}
        for k, x in v.items():
            hidden = re.sub("[^A-Za-z0-9]", "", k).lower() in SENSITIVE
            done[0] += hidden
            out[k] = "__REDACTED__" if hidden else sanitized(x, longest, done)
        return out
    if isinstance(v, list):
        return [sanitized(x, longest, done) for x in v]
    if isinstance(v, str) and len(v.encode()) >= longest:
        done[1] += 1
        return "__LARGE_JSON_ARRAY__" if v.lstrip()[:1] in ("{", "[") else "__LONG_STRING__"
    return v


def sanitized_documents(docs: DataFrame, longest: int = 512) -> DataFrame:
    """doc_id, text (indented, with a line break at its end), redacted_fields, placeholder_strings; all
    null but doc_id for what is no JSON. docs: doc_id, text."""

    def run(batches):
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                done = [0, 0]
                try:
                    found = sanitized(json.loads(text, parse_float=_Literal, parse_int=_Literal), longest, done)
                    out.append((pretty(found) + "\n", *done))
                except (ValueError, TypeError, RecursionError):
                    out.append((None, None, None))
            made = pd.DataFrame(out, columns=["text", "redacted_fields", "placeholder_strings"]).astype({"redacted_fields": "Int64", "placeholder_strings": "Int64"})
            made.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield made

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, text string, redacted_fields long, placeholder_strings long")


def crushed_object(obj: dict, k: int, errors: list[str], least_tokens: int = 200) -> dict:
    """An object of nine keys or more with errors, small values, both ends and an even stride of its keys; others whole."""
    text = {key: json.dumps(v, separators=(",", ":"), ensure_ascii=False) for key, v in obj.items()}
    cost = {key: len(t.encode()) // 4 + len(key.encode()) // 4 + 2 for key, t in text.items()}
    keys, n = list(obj), len(obj)
    if n <= 8 or sum(cost.values()) < least_tokens or k >= n:
        return obj
    bad = {key for key in keys if any(w in text[key].lower() for w in errors)}
    keep = bad | {key for key in keys if cost[key] <= 12} | set(keys[: max(1, round(k * 0.3))]) | set(keys[-max(1, round(k * 0.15)) :])
    room = max(0, k - len(keep))
    if room:
        for i in range(0, n, max(1, (n - 1) // (room + 1))):
            if len(keep) >= k + len(keep & bad):
                break
            keep.add(keys[i])
            bad_now = any(w in text[keys[i]].lower() for w in errors)
            bad |= {keys[i]} if bad_now else set()
    return {key: v for key, v in obj.items() if key in keep}


def hashed_vector(text: str, dims: int = 256) -> list[float]:
    """Signed hashed features of tokens (1) and their byte trigrams (0.35), of unit length. The hash is
    BLAKE2b: BLAKE3 is in neither Spark nor the standard library."""
    out = [0.0] * dims

    def add(feature: bytes, weight: float) -> None:
        h = hashlib.blake2b(feature, digest_size=9).digest()
        out[int.from_bytes(h[:8], "little") % dims] += weight if h[8] % 2 == 0 else -weight

    for token in re.findall(r"[A-Za-z0-9_-]+", text.lower()):
        raw = token.encode()
        add(raw, 1.0)
        if len(raw) >= 4:
            for i in range(len(raw) - 2):
                add(raw[i : i + 3], 0.35)
    norm = sum(x * x for x in out) ** 0.5
    return [x / norm for x in out] if norm else out


def hashed_vectors(texts: DataFrame, key: str) -> DataFrame:
    """key, vector. texts: key, text."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "vector": [hashed_vector(t or "") for t in pdf["text"]]})

    return texts.select(key, "text").mapInPandas(run, f"{key} {texts.schema[key].dataType.simpleString()}, vector array<double>")
