import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from pressroom.llm import prefix_trie
from pressroom.llm.oracles import ORACLE
from pressroom.llm.queries import QUERIES
from tests.compare import connect, differences


def brute(rows):
    """The definition with dictionaries of whole prefixes: sorted rows of all columns."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in turns.items()}
    if not turns:
        return []
    members = defaultdict(list)
    whole = {}
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 4
        head = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(turns.get(head, [])[:h] + turns[c][h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in children[node])
        ends = ",".join(str(c) for c in members[node] if len(whole[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]),
                    leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string, owner string, depth string, key int, c int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "o", "d", 3, 4) for r in rows], SCHEMA)


def got(spark, rows, parts):
    out = prefix_trie.trie(table(spark, rows).repartition(parts))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def family(n, seed=5):
    """Conversations that share beginnings of many lengths, with copies and empty turns."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(0, 7)):
            rows.append((c * rng.choice([1, 1, 1, 2]), t, rng.choice(["user", "user", None]), rng.choice(["yes", "yes please", "", None, f"own {c % 9}"])))
    return rows


EDGES = [
    (40, None, "user", "null first"), (40, 2, "user", "b"), (40, 2, "user", "a"), (40, 2, "user", "a"), (40, 2, None, "a"), (41, 0, "user", "x"), (41, 1, "user", "y"),
    (59, 5, "user", " \t\n "), (59, 9, "user", None), (61, 0, None, None), (62, 0, "user", "only"), (63, 0, "", ""), (-5, 0, "user", "minus"), (-25, 0, "user", "minus"),
    (-25, 1, "user", "minus"), (None, 0, "user", "nobody"), (None, 1, "user", "nobody"), (0, 0, "user", "zero words here"), (7, 1, "user", "seven"), (7, 1, "user", "seven"),
    (80, 0, "user", "w " * 200_000), (100, 0, "us", "er"), (120, 0, "use", "r"), (9_000_000_000, 0, "user", "far"),
]


@pytest.mark.parametrize("first, step, spill, parts", [(1024, 32, 4096, 3), (2, 2, 1, 5), (8, 4, 3, 8)])
def test_against_brute_force(spark, monkeypatch, first, step, spill, parts):
    monkeypatch.setattr(prefix_trie, "FIRST", first)
    monkeypatch.setattr(prefix_trie, "STEP", step)
    monkeypatch.setattr(prefix_trie.Messages.__init__, "__defaults__", (spill,))
    rows = family(150) + EDGES
    assert got(spark, rows, parts) == brute(rows)


def test_one_conversation_over_many_ranges(spark):
    """Half of all turns belong to one conversation and a copy of it, so both run over range borders."""
    rows = [(20 * i, t, "user", f"turn {t % 50}") for i in (4, 5) for t in range(700)] + family(200)
    assert got(spark, rows, 8) == brute(rows)


def test_empty(spark):
    assert prefix_trie.trie(table(spark, [])).collect() == []
    assert prefix_trie.trie(table(spark, [(None, 1, "user", "nobody")])).collect() == []
    assert got(spark, [(3, 0, "user", "hi")], 1) == brute([(3, 0, "user", "hi")])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 3), st.integers(0, 9), st.integers(0, 99)), max_size=80), st.integers(1, 20))
def test_queue_delivers_every_message_once(messages, spill):
    queue, want = prefix_trie.Messages(spill), defaultdict(lambda: [0, 0])
    for depth, key, leaves, saved in messages:
        queue.send(depth, key.to_bytes(16, "big"), leaves, saved)
        want[-depth, key][0] += leaves
        want[-depth, key][1] += saved
        assert len(queue.heap) <= spill
    assert len(queue) == len(messages)
    for (depth, key), sums in sorted(want.items()):
        assert list(queue.receive(-depth, key.to_bytes(16, "big"))) == sums
    assert len(queue) == 0


def test_sql(spark, sf_dir):
    assert differences(spark, connect(sf_dir), sf_dir, QUERIES["op12_prefix_trie"], ORACLE["op12_prefix_trie"]) is None
