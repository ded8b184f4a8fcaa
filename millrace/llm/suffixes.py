"""Deep-shallow sorting of byte strings, and what repeats around a shared anchor.

Multikey quicksort on eight-byte letters sorts to a shallow depth. Strings that still agree
there go into a blind trie, which keeps branching bytes only: a descent looks at one byte per
node, one comparison with the leaf reached tells where the new string leaves the trie, and
the leaves in order are sorted, with the longest common prefixes at the nodes between them.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 24
LETTER = 8
TRY = 16


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, step = 0, TRY
    while a[low : low + step] == b[low : low + step]:
        low, step = low + step, step * 2
    high = min(most, low + step)
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _blind_trie(strings: list[bytes], group: list[int]) -> tuple[list[int], list[int]]:
    """(sorted group, common prefix of each with the one before it, 0 for the first).

    A node is [depth, {byte or -1: child}], a leaf the list of the strings that are equal."""
    root: list = [group[0]]
    for i in group[1:]:
        new, node = strings[i], root
        while isinstance(node[-1], dict):
            depth, children = node
            byte = new[depth] if depth < len(new) else -1
            node = children.get(byte) or next(iter(children.values()))
        other = strings[node[0]]
        shared = common_prefix(new, other)
        if shared == len(new) == len(other):
            node.append(i)
            continue
        # Down again, to the node that the new string leaves: the first that is not above `shared`.
        parent, key, node = None, None, root
        while isinstance(node[-1], dict) and node[0] < shared:
            parent, key = node, new[node[0]]
            node = node[1][key]
        ours = new[shared] if shared < len(new) else -1
        if isinstance(node[-1], dict) and node[0] == shared:
            node[1][ours] = [i]
            continue
        theirs = other[shared] if shared < len(other) else -1
        made = [shared, {theirs: node, ours: [i]}]
        if parent is None:
            root = made
        else:
            parent[1][key] = made
    order, prefixes, stack = [], [], [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if isinstance(node[-1], dict):
            depth, children = node
            keys = sorted(children)
            stack.extend((children[k], depth) for k in reversed(keys[1:]))
            stack.append((children[keys[0]], shared))
        else:
            order.extend(node)
            prefixes.extend([shared, *[len(strings[node[0]])] * (len(node) - 1)])
    return order, prefixes


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """(order, prefixes): the sorted order, and the common prefix of each with the one before it."""
    order: list[int] = []
    prefixes: list[int] = []

    def put(group: list[int], inner: list[int]) -> None:
        if order:
            inner[0] = common_prefix(strings[order[-1]], strings[group[0]])
        order.extend(group)
        prefixes.extend(inner)

    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            put(group, [0])
        elif depth >= SHALLOW:
            put(*_blind_trie(strings, group))
        elif group:
            letters = [strings[i][depth : depth + LETTER] for i in group]
            pivot = letters[len(letters) // 2]
            less = [i for i, x in zip(group, letters, strict=True) if x < pivot]
            same = [i for i, x in zip(group, letters, strict=True) if x == pivot]
            more = [i for i, x in zip(group, letters, strict=True) if x > pivot]
            stack.append((more, depth))
            # A short letter ends its strings: all of them are equal.
            if len(pivot) < LETTER:
                stack.append((same, SHALLOW))
            else:
                stack.append((same, depth + LETTER))
            stack.append((less, depth))
    return order, prefixes


class _Least:
    """Least value of any range of an array."""

    def __init__(self, values: list[int]):
        self.levels = [np.asarray(values, np.int64)]
        while len(x := self.levels[-1]) > (step := 1 << (len(self.levels) - 1)):
            self.levels.append(np.minimum(x[:-step], x[step:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least of values[low : high + 1], element by element."""
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][low[at]], self.levels[k][high[at] - (1 << int(k)) + 1])
        return out


def _intervals(prefixes: list[int]) -> list[tuple[int, int, int, int]]:
    """(first, last, depth, depth of the parent) of the groups of two or more that agree to a
    depth, in an array sorted with these common prefixes; the parent of the top is -1."""
    out, stack = [], []
    for i, d in enumerate([*prefixes[1:], -1], start=1):
        first = i - 1
        while stack and stack[-1][1] > d:
            first, depth = stack.pop()
            out.append((first, i - 1, depth, max(d, stack[-1][1] if stack else -1)))
        if d >= 0 and (not stack or stack[-1][1] < d):
            stack.append((first, d))
    return out


def repeats(lefts: list[bytes], rights: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each context, the offsets l (as ranges) at which its string of `length` bytes that
    begins l bytes before the anchor equals that of another context at the same offset.

    lefts: the bytes before the anchor, nearest first; rights: the bytes from the anchor on.
    Contexts that agree in l bytes to the left are a range of the sorted lefts; among them the
    best partner to the right is a neighbour in the order of the sorted rights."""
    m = len(lefts)
    out: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    if m == 2:
        left, right = common_prefix(*lefts), common_prefix(*rights)
        if left + right >= length:
            out[0].append((max(0, length - right), left))
            out[1].append((max(0, length - right), left))
        return out
    order, prefixes = deep_shallow(rights)
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    least = _Least(prefixes)
    by_left, agree = deep_shallow(lefts)
    by_left = np.asarray(by_left, np.int64)
    for first, last, depth, above in _intervals(agree):
        ranks = np.sort(rank[by_left[first : last + 1]])
        beside = least.of(ranks[:-1] + 1, ranks[1:])
        if beside.max(initial=-1) + depth < length:
            continue
        best = np.maximum(np.concatenate([[0], beside]), np.concatenate([beside, [0]]))
        for k in np.flatnonzero(best + depth >= length).tolist():
            low = max(above + 1, length - int(best[k]))
            if low <= depth:
                out[order[ranks[k]]].append((low, depth))
    return out
