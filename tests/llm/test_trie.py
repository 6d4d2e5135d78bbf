import hashlib
import random

import pytest

from convomill.llm import trie

NAMES = [c.split()[0] for c in trie.NODE.split(", ")]


def brute_force(conversations):
    """conversations: id to turns (role, text), in order."""
    nodes = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(r[: len(q)] == q and len(r) > len(q) for r in below)]
        saved = sum((len(nodes[q]) - 1) * len((q[-1][1]).encode().split()) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if len(conversations[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=str)


def frame(spark, rows, more=""):
    return spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string{more}")


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_trie_equals_brute_force(spark, shards):
    rng = random.Random(shards)
    conversations = {c: [(rng.choice("ua"), rng.choice(["x", "y y", ""])) for _ in range(rng.choice([1, 1, 2, 3, 6]))] for c in range(150)}
    conversations |= {1000 + i: [("u", "long")] * 70 + [("a", str(i % 3))] * 5 for i in range(9)}  # a long common path
    conversations |= {2000 + i: [("u", "same a b"), ("a", "copy")] for i in range(60)}  # a large group of copies
    rows = [(c, i, *t) for c, turns in conversations.items() for i, t in enumerate(turns)]
    rng.shuffle(rows)
    got = trie.prefix_trie(trie.conversation_paths(frame(spark, rows)), shards)
    assert got.columns == NAMES and found(got) == brute_force(conversations)


def test_splitters_deeper_than_their_bound(spark, monkeypatch):
    monkeypatch.setattr(trie, "DEPTH", 3)
    conversations = {i: [("u", "s")] * 5 + [("a", f"{i}"), ("u", "t")] for i in range(40)} | {100 + i: [("u", f"{i % 7} w")] * (1 + i % 4) for i in range(40)}
    rows = [(c, i, *t) for c, turns in conversations.items() for i, t in enumerate(turns)]
    assert found(trie.prefix_trie(trie.conversation_paths(frame(spark, rows)), 6)) == brute_force(conversations)


def test_odd_rows(spark):
    """Null turns first, ties by role, then text; null roles and texts empty; no conv_id: left out; role and text are told apart; columns of our own names."""
    rows = [(1, None, "u", "first"), (1, 0, None, None), (1, 0, "a", "b"), (1, 0, "a", "a"), (2, 5, "ab", "c"), (3, 5, "a", "bc"), (None, 0, "u", "nobody"), (4, 1, "u", "same"), (4, 1, "u", "same"), (5, -70, "u", "z"), (5, 70, "u", "long " * 20_000)]
    df = frame(spark, [(*r, "x", 1) for r in rows], ", path string, block int")
    want = {1: [("u", "first"), ("", ""), ("a", "a"), ("a", "b")], 2: [("ab", "c")], 3: [("a", "bc")], 4: [("u", "same")] * 2, 5: [("u", "z"), ("u", "long " * 20_000)]}
    assert found(trie.prefix_trie(trie.conversation_paths(df), 3)) == brute_force(want)
    assert trie.prefix_trie(trie.conversation_paths(df.limit(0))).count() == 0


def test_heads(spark):
    """The first turns of another path; without one they go; a path that is left without turns is a member of the root."""
    rows = [(20, 0, "u", "a"), (20, 1, "a", "b b"), (21, 0, "u", "x"), (21, 1, "a", "y"), (21, 2, "u", "z z z"), (45, 0, "u", "only"), (46, 0, "u", "p"), (46, 1, "u", "q")]
    paths = trie.conversation_paths(frame(spark, rows)).selectExpr("*", "conv_id - conv_id % 20 AS base", "CASE conv_id WHEN 21 THEN 2 WHEN 20 THEN 3 WHEN 45 THEN 1 ELSE 1 END AS h")
    got = found(trie.prefix_trie(trie.headed(paths, paths.where("conv_id = 20"), "base", "h"), 4))
    assert got == brute_force({20: [("u", "a"), ("a", "b b")], 21: [("u", "a"), ("a", "b b"), ("u", "z z z")], 45: [], 46: [("u", "q")]})
