"""Scalar text functions: token estimates, keys, minifying, voice clean-up, markers, images."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters per token by model family, key lengths, filler words, sensitive keys.
CHARS_PER_TOKEN = {"claude-": 3.5, "gemini": 4.0, "palm": 4.0, "command": 4.0}
DEFAULT_CHARS = 4.0
BPE_MODELS = ["gpt-4o", "gpt-4", "gpt-3.5", "o1", "o3", "text-embedding", "text-davinci", "davinci", "curie", "babbage", "ada", "code-"]
FILLERS = ["um", "uh", "erm", "ah", "like", "basically", "actually"]
SENSITIVE = ["apikey", "authorization", "bearer", "token", "accesstoken", "refreshtoken", "secret", "secretkey", "clientsecret", "password", "privatekey", "signature"]
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
NUMBER_ID = r"\b\d{4,}\b"
HOST = r"\b[a-zA-Z0-9][-a-zA-Z0-9]*\.[a-zA-Z0-9][-a-zA-Z0-9]*(?:\.[a-zA-Z]{2,})?\b"
QUOTED = r"['\"]([^'\"]{1,50})['\"]"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
TERMS = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|\b\d{4,}\b|[a-zA-Z0-9_]+"
OPAQUE_BYTES, OPAQUE_SHARE, OPAQUE_LETTERS, HTML_TAGS = 256, 0.95, 16, 3


def estimated_tokens(text: Column, chars_per_token: Column | float = DEFAULT_CHARS) -> Column:
    """Characters over characters per token, halves up; 1 at least for a non-empty text."""
    return F.when(text == "", 0).otherwise(F.greatest(F.lit(1), F.floor(F.char_length(text) / chars_per_token + 0.5))).cast("long")


def chars_per_token(model: Column) -> Column:
    m, out = F.lower(model), F.when(F.lit(False), DEFAULT_CHARS)
    for prefix, n in CHARS_PER_TOKEN.items():
        out = out.when(m.startswith(prefix), n)
    return out.otherwise(DEFAULT_CHARS)


def backend(model: Column) -> Column:
    m, hit = F.lower(model), F.lit(False)
    for prefix in BPE_MODELS:
        hit = hit | m.startswith(prefix)
    return F.when(hit, "bpe").otherwise("estimate")


def key(text: Column, kind: str) -> Column:
    """Content keys: payload (24 of MD5), row (12 of SHA-256), item (16 of MD5), field (8 of SHA-256), cluster (8 of MD5)."""
    algorithm, n = {"payload": ("md5", 24), "row": ("sha256", 12), "item": ("md5", 16), "field": ("sha256", 8), "cluster": ("md5", 8)}[kind]
    return F.left(F.md5(text.cast("binary")) if algorithm == "md5" else F.sha2(text.cast("binary"), 256), F.lit(n))


def minified_json(text: Column) -> Column:
    """JSON without white space outside of strings, if that is shorter; key order and numbers stay as written."""
    small = F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|\s+', "$1")
    return F.when(F.try_parse_json(text).isNotNull() & (F.octet_length(small) < F.octet_length(text)), small).otherwise(text)


def voice_words(text: Column) -> Column:
    """The words of a transcript without fillers."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.filter(words, lambda w: ~F.lower(F.regexp_replace(w, r"^[^A-Za-z0-9']+|[^A-Za-z0-9']+$", "")).isin(FILLERS))


def sanitized(values: Column, longest: int) -> Column:
    """A map of fields with sensitive ones redacted and long texts replaced."""
    def clean(k, v):
        plain = F.lower(F.regexp_replace(k, "[^A-Za-z0-9]", ""))
        payload = F.ltrim(v).startswith("[") | F.ltrim(v).startswith("{")
        return F.when(plain.isin(SENSITIVE), "__REDACTED__").when(F.octet_length(v) >= longest, F.when(payload, "__LARGE_JSON_ARRAY__").otherwise("__LONG_STRING__")).otherwise(v)

    return F.transform_values(values, clean)


def query_anchors(text: Column) -> Column:
    """What a query names: UUIDs, numbers of four digits, hosts, quoted texts, mail addresses; lower case."""
    def found(pattern, group=0):
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.lower(x))

    hosts = F.filter(found(HOST), lambda x: ~x.isin("e.g", "i.e", "etc."))
    quoted = F.filter(found(QUOTED, 1), lambda x: F.octet_length(F.trim(x)) >= 2)
    return F.array_sort(F.array_distinct(F.concat(found(UUID), found(NUMBER_ID), hosts, quoted, found(EMAIL))))


def hybrid_alpha(query: Column, base: float = 0.5) -> Column:
    """The weight of exact terms against similarity, by what the query names."""
    n = lambda p, c=query: F.regexp_count(c, F.lit(p))
    found = F.when(n(UUID) > 0, 0.85).when(n(NUMBER_ID) >= 2, 0.75).when(n(NUMBER_ID) == 1, 0.65).when((n(HOST, F.lower(query)) > 0) | (n(EMAIL, F.lower(query)) > 0), 0.6).otherwise(base)
    return F.least(F.lit(0.9), F.greatest(F.lit(0.3), F.greatest(F.lit(base), found)))


def opaque_kind(text: Column) -> Column:
    """base64, html or string for a text too long to show; null for others."""
    squeezed = F.regexp_replace(text, "[A-Za-z0-9+/=_-]", "")
    letters = F.size(F.array_distinct(F.split(text, "")))
    base64 = ((F.char_length(text) - F.char_length(squeezed)) >= OPAQUE_SHARE * F.char_length(text)) & (letters >= OPAQUE_LETTERS)
    html = F.regexp_count(text, F.lit("<[A-Za-z/!]")) >= HTML_TAGS
    return F.when(F.octet_length(text) > OPAQUE_BYTES, F.when(base64, "base64").when(html, "html").otherwise("string"))


def readable_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(n < 1 << 20, F.concat(F.format_string("%.1f", F.bround(n / 1024, 1)), F.lit("KB"))).otherwise(F.concat(F.format_string("%.1f", F.bround(n / (1 << 20), 1)), F.lit("MB")))


def opaque_marker(text: Column) -> Column:
    """<<ccr:HASH,kind,size>> for an opaque text, the text itself otherwise."""
    kind = opaque_kind(text)
    return F.when(kind.isNull(), text).otherwise(F.concat(F.lit("<<ccr:"), key(text, "row"), F.lit(","), kind, F.lit(","), readable_size(F.octet_length(text)), F.lit(">>")))


def marker_keys(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit("<<ccr:([0-9a-fA-F]+)"), F.lit(1))


def image_header(data: Column) -> Column:
    """struct(format, width, height) of PNG and GIF bytes; other formats are unknown here (see image_size)."""
    def number(*at):
        return F.conv(F.concat(*[F.hex(F.substring(data, a, 1)) for a in at]), 16, 10).cast("int")

    size = F.octet_length(data)
    png = F.hex(F.substring(data, 1, 8)) == "89504E470D0A1A0A"
    gif = F.hex(F.substring(data, 1, 3)) == "474946"
    return F.when(png & (size >= 24), F.struct(F.lit("png").alias("format"), number(17, 18, 19, 20).alias("width"), number(21, 22, 23, 24).alias("height"))).when(gif & (size >= 10), F.struct(F.lit("gif").alias("format"), number(8, 7).alias("width"), number(10, 9).alias("height"))).otherwise(F.struct(F.lit("unknown").alias("format"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height")))


_MARKER = re.compile(rb"\xff+([^\xff])", re.S)
#: The JPEG markers of a frame with a size, and those without a length.
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
BARE = {0xD8, 0xD9}


def _jpeg(data: bytes | None) -> tuple[int | None, int | None]:
    """(width, height) of the first frame; segments before it are stepped over by their lengths."""
    at = 2
    while data and (m := _MARKER.search(data, at)) and m.start() + 9 < len(data):
        at, kind = m.end(), m[1][0]
        if kind in BARE:
            continue
        length = int.from_bytes(data[at : at + 2], "big")
        if length < 2 or at + length > len(data):
            break
        if kind in FRAMES:
            if at + 7 >= len(data):
                break
            return int.from_bytes(data[at + 5 : at + 7], "big"), int.from_bytes(data[at + 3 : at + 5], "big")
        at += length
    return None, None


def _jpeg_sizes(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_jpeg(x) for x in data], columns=["width", "height"], dtype="Int32")


def image_size(data: Column) -> Column:
    """struct(format, width, height) of PNG, GIF and JPEG bytes. Only JPEG bytes go to Python:
    where a frame stands depends on the lengths of all segments before it."""
    jpeg = (F.hex(F.substring(data, 1, 2)) == "FFD8") & (F.octet_length(data) >= 4)
    size = F.pandas_udf(_jpeg_sizes, "width int, height int")(F.when(jpeg, data))
    return F.when(jpeg, F.struct(F.lit("jpeg").alias("format"), size["width"].alias("width"), size["height"].alias("height"))).otherwise(image_header(data))


def image_advice(n_bytes: Column, width: Column, height: Column) -> Column:
    pixels = F.coalesce(width.cast("double") * height / 1e6, F.lit(0.0))
    return F.when((n_bytes > 2_000_000) | (pixels > 4), "large").when(n_bytes > 500_000, "medium").otherwise("small")


def auth_mode(agent: Column, authorization: Column, clients: list[str]) -> Column:
    """subscription, oauth or payg, from the headers of a request."""
    known = F.lit(False)
    for c in clients:
        known = known | F.lower(F.coalesce(agent, F.lit(""))).contains(c)
    auth = F.coalesce(authorization, F.lit(""))
    token = F.substring(auth, 8, 1 << 30)
    bearer = auth.startswith("Bearer ")
    return F.when(known, "subscription").when(bearer & token.startswith("sk-ant-oat-"), "oauth").when(bearer & token.startswith("sk-"), "payg").when(bearer & (F.size(F.split(token, r"\.")) >= 3), "oauth").when(~bearer & (auth != ""), "oauth").otherwise("payg")


WRITE, READ = 1.25, 0.1


def mutation_gain(delta: Column, suffix: Column, reads: Column, alive: Column) -> Column:
    """Net gain in cached tokens of rewriting a prefix."""
    return delta * (WRITE + READ * (F.greatest(reads, F.lit(0.0)) - 1)) - F.least(F.lit(1.0), F.greatest(F.lit(0.0), alive)) * (WRITE - READ) * (suffix + delta)


def break_even_reads(delta: Column, suffix: Column) -> Column:
    return F.when(delta == 0, 0.0).otherwise((WRITE - READ) / READ * (suffix / delta))
