"""Radix trees against dictionaries, and the trie of conversations against brute force."""

import hashlib
import random
import re
import zlib

import pytest

from plumbline.llm.prefix_trie import prefix_trie
from plumbline.llm.radix import Tree

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int"


@pytest.mark.parametrize("spread", [2, 5, 17, 49, 256])
def test_tree_totals(spread):
    rng = random.Random(spread)
    width, tree, plain = 2, Tree(), {}
    for i in range(600):
        key = bytes(rng.randrange(spread) for _ in range(width * rng.randrange(6)))
        if i % 3 == 0 and plain:  # prefixes and repeats of what is there
            other = rng.choice([k for k in plain])
            key = other[: width * rng.randrange(len(other) // width + 1)]
        weight = rng.randrange(5)
        tree.add(key, 1000 - i, [1, weight])
        for ids in range(len(key) // width + 1):
            n = plain.setdefault(key[: ids * width], [10**9, 0, 0])
            plain[key[: ids * width]] = [min(n[0], 1000 - i), n[1] + 1, n[2] + weight]
    out = sorted((ids, *own) for ids, own in tree.totals(width))
    assert out == sorted((len(k) // width, *v) for k, v in plain.items())


def test_tree_layouts_grow():
    tree = Tree()
    for n, layout in ((4, 4), (5, 16), (17, 48), (49, 256)):
        for b in range(n):
            tree.add(bytes([255 - b, 7]), b, [1])
        assert tree.root.layout == layout and sum(1 for _ in tree.root.branches()) == n
    assert all(tree.root.child(255 - b).prefix == b"\x07" for b in range(49)) and tree.root.child(3) is None


def brute(rows, lend=True):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if lend else 0
        lender = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(lender, [])[:h] + ts[h:]
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    words = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text))
    saved = {p: (len(m) - 1) * (words(p[-1][1]) if p else 0) for p, m in nodes.items()}
    children, leaves, sums = {p: 0 for p in nodes}, {p: 0 for p in nodes}, {p: 0 for p in nodes}
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    for p in nodes:
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            sums[p[:d]] += saved[p]
    out = []
    for p, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(p)))
        parent = min(nodes[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), children[p], leaves[p], sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes_of(spark, rows, **how):
    frame = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in prefix_trie(frame, **how).collect()), key=str)


def conversations(seed, n=60, longest=9, ids=None):
    rng = random.Random(seed)
    openings = [[("system", "be good"), ("user", "hi there you")], [("user", "one two"), ("assistant", "three")], []]
    rows = []
    for c in ids or range(n):
        turns = list(rng.choice(openings)) + [(rng.choice(["user", "assistant", None]), rng.choice(["a", "a b", "", None, "c\td  e"])) for _ in range(rng.randrange(longest))]
        rows += [(c, i, *t, 1) for i, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("how", [{}, {"length": 2, "limit": 3}, {"lend": False}])
def test_equals_brute_force(spark, how):
    rows = conversations(7)
    expected = brute(rows, how.get("lend", True))
    assert len(expected) > 50 and nodes_of(spark, rows, **how) == expected


def test_long_copies_and_prefixes(spark):
    turns = [("user" if i % 2 else "assistant", f"w{i % 7} x") for i in range(150)]
    rows = [(c, i, *t, 1) for c, n in ((1, 150), (2, 150), (3, 100), (4, 64), (5, 65), (40, 150), (41, 1)) for i, t in enumerate(turns[:n])]
    rows += [(6, i, *turns[i], 1) for i in range(64)] + [(6, 64, "user", "else", 1)]
    assert nodes_of(spark, rows) == brute(rows)
    assert nodes_of(spark, rows, length=8, limit=2) == brute(rows)


def test_null_turns_ties_repeats_and_negative_ids(spark):
    rows = conversations(9, ids=[-45, -40, -3, 0, 19, 20, 25, 10**12])
    rows += [(0, None, "user", "first", 1), (0, 1, "user", "tie b", 1), (0, 1, "user", "tie a", 1), (0, 1, "user", "tie a", 1)]
    rows += [(None, 0, "user", "nobody", 1), (None, None, None, None, None), (77, 0, "user", "퟿ x", None)]
    assert nodes_of(spark, rows) == brute(rows)


def test_conversations_left_without_turns(spark):
    rows = [(c, 0, "user", "only", 1) for c in range(1, 20)]  # whoever borrows has no lender and loses the turn
    out = nodes_of(spark, rows)
    assert out == brute(rows) and any(n[1] == 0 and n[7] != hashlib.sha256(b"").hexdigest() for n in out)


def test_most_rows_in_one_conversation_and_one_turn(spark):
    rows = [(3, i % 5, "user", "same", 1) for i in range(500)] + conversations(11, n=30)
    assert nodes_of(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert nodes_of(spark, []) == [] and nodes_of(spark, [(None, 1, "user", "x", 1)]) == []
