"""Tags, shell commands and anchors, by hand and at random."""

import random

from millrace.operators import anchors, markup


def test_protected_blocks_come_back():
    rng = random.Random(4)
    parts = ["<a>", "</a>", "<x>", "</x>", "<y k='>'>", "</y>", "<z/>", "text", "<", "</", "{{TAG_", " "]
    for _ in range(500):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        for markers in (False, True):
            clean, blocks = markup.protected(text, markers)
            assert len(clean) - len(text) <= 40 * len(blocks)
            found = markup.spans(text, markers)
            assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
            assert "".join(text[x:y] for x, y in found) == "".join(blocks)


def test_outer_blocks_take_their_inner_ones():
    assert markup.protected("a <x>1 <y>2</y> </x> <b>c</b>") == ("a {{TAG_0}} <b>c</b>", ["<x>1 <y>2</y> </x>"])
    assert markup.protected("</x> lone <y>")[1] == []


def test_shell_rewrites_only_what_it_may():
    supported = lambda c: c.split()[0] in ("git", "cargo")
    assert markup.rewritten("git status && cargo test 2>&1 | grep 'a|b' ; ls", supported, "run --").startswith("run -- git status && run -- cargo test")
    assert markup.rewritten("git log > out.txt", supported, "run --") == "run -- git log > out.txt"
    assert markup.rewritten("ls | git apply", supported, "run --") == "ls | git apply"
    assert markup.rewritten("echo 'git status; x' && git diff", supported, "run --") == "echo 'git status; x' && run -- git diff"


def test_anchor_slots_and_places():
    assert anchors.budget(10, 15) == 0 and anchors.budget(100, 15) == 3 and anchors.budget(100, 60) == 12
    assert sum(anchors.slots(100, 60, "generic")) <= 12
    assert anchors.slots(100, 60, "generic", "the latest")[2] > anchors.slots(100, 60, "generic")[2]
    found = anchors.choose([i // 2 for i in range(100)], [float(i) for i in range(100)], 60, "generic")
    assert len({i // 2 for i in found}) == len(found) and max(found) >= 66 and min(found) < 33
