"""Positional anchors of an array: how many, where, and which; and items that a query or a kept field asks for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shares of the front and the back by pattern, and words that move them.
SHARES = {"search_results": (0.75, 0.15), "logs": (0.15, 0.75), "time_series": (0.45, 0.45), "generic": (0.5, 0.4)}
BUDGET, LEAST, MOST, SHIFT = 0.25, 3, 12, 0.15
RECENT = ["latest", "recent", "last", "newest", "current", "now"]
EARLY = ["first", "oldest", "earliest", "original", "initial", "beginning"]


def budget(n: int, most_items: int) -> int:
    return 0 if n <= most_items else min(n, MOST, max(LEAST, int(most_items * BUDGET)))


def slots(n: int, most_items: int, pattern: str, query: str = "") -> tuple[int, int, int]:
    """Front, middle and back slots of an array of n items."""
    front, back = SHARES.get(pattern, SHARES["generic"])
    middle = 1 - front - back
    low = query.lower()
    recent, early = any(w in low for w in RECENT), any(w in low for w in EARLY)
    if recent != early:
        front, back = (max(0.1, front - SHIFT), min(0.8, back + SHIFT)) if recent else (min(0.8, front + SHIFT), max(0.1, back - SHIFT))
    total, b = front + middle + back, budget(n, most_items)
    f, k = max(1, int(b * front / total)), max(1, int(b * back / total))
    m = max(0, b - f - k)
    over = f + m + k - b
    if over > 0:
        cut = min(m, over)
        m, k = m - cut, max(1, k - (over - cut))
    return f, m, k


def _spread(begin: int, end: int, count: int, hashes: list, seen: set) -> list[int]:
    """Evenly spaced places of a region; one whose content is taken gives way to a neighbour."""
    size, out = end - begin, []
    if count <= 0 or size <= 0:
        return out
    wanted = range(begin, end) if count >= size else [min(end - 1, begin + int((i + 1) * size / (count + 1))) for i in range(count)]
    for at in wanted:
        for place in [at] if count >= size else [at, at + 1, at - 1, at + 2, at - 2]:
            if begin <= place < end and hashes[place] not in seen:
                seen.add(hashes[place])
                out.append(place)
                break
    return out


def choose(hashes: list, scores: list[float], most_items: int, pattern: str, query: str = "") -> list[int]:
    """The anchor places of one array."""
    n = len(hashes)
    if n <= most_items:
        return list(range(n))
    f, m, k = slots(n, most_items, pattern, query)
    seen: set = set()
    front = _spread(0, min(f * 2, n // 3), f, hashes, seen)
    back = _spread(max(n - k * 2, 2 * n // 3), n, k, hashes, seen)
    begin, end = len(front), n - len(back)
    count = min(m * 3, max(0, end - begin))
    places = [min(end - 1, begin + int((i + 1) * (end - begin) / (count + 1))) for i in range(count)]
    middle = []
    for place in sorted((p for p in places if hashes[p] not in seen), key=lambda p: -scores[p])[:m]:
        if hashes[place] not in seen:
            seen.add(hashes[place])
            middle.append(place)
    return sorted({*front, *back, *middle})


def anchors(items: DataFrame, content: Column, score: Column, pattern: str, most_items: int = 15, query: str = "") -> DataFrame:
    """array_id, idx of the anchors of each array; one ordered pass per array."""
    d = items.select("array_id", "idx", F.md5(content.cast("binary")).alias("h"), score.cast("double").alias("s"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        found = choose(pdf["h"].tolist(), pdf["s"].tolist(), most_items, pattern, query)
        return pd.DataFrame({"array_id": [key[0]] * len(found), "idx": [pdf["idx"].iloc[i] for i in found]})

    return d.groupBy("array_id").applyInPandas(run, f"array_id {d.schema['array_id'].dataType.simpleString()}, idx long")


def matches_anchors(text: Column, found: list[str]) -> Column:
    """Whether an item's text holds one of the things a query names."""
    hit = F.lit(False)
    for a in found:
        hit = hit | F.lower(text).contains(a)
    return hit


def matches_preserved(fields: dict[str, Column], hashes: list[str], query: Column) -> Column:
    """Whether a kept field, known by the first eight of its name's SHA-256, holds the query or is part of it."""
    import hashlib

    hit, low = F.lit(False), F.lower(query)
    for name, value in fields.items():
        if hashlib.sha256(name.encode()).hexdigest()[:8] in hashes:
            v = F.lower(value.cast("string"))
            hit = hit | F.coalesce(v.contains(low) | low.contains(v), F.lit(False))
    return hit & (query != "")
