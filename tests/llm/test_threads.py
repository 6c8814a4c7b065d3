"""The conversation trie against a plain one: shared prefixes, long conversations, ties and nulls."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from gleanframe.llm.double_array import DoubleArray, Paths
from gleanframe.llm.queries.threads import rebuilt
from gleanframe.llm.turn_tries import prefix_nodes

SCHEMA = "conv_id long, turn long, role string, text string, depth long, a string"


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, r or "", x or ""))
    for c, own in convs.items():
        own.sort(key=lambda v: (v[0] is not None, v[0] or 0, hashlib.md5(f"{len(v[1])}:{v[1]}{v[2]}".encode()).hexdigest()))
        convs[c] = [v[1:] for v in own]
    seqs = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        seqs[c] = tuple(convs.get(base, [])[:h] + own[h:])
    nodes, kids, leaves, saved = {}, {}, {}, {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p in sorted(nodes, key=len, reverse=True):
        own = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in kids[p]) if p in kids else 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + (len(nodes[p]) - 1) * own
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p)).encode()).hexdigest())
                   for p, m in nodes.items()), key=repr)


def fixture():
    draw = random.Random(3)
    rows = [(c, t if draw.random() < 0.95 else None, draw.choice(["user", "assistant", None]), draw.choice(["a", "b b", "c c c", None]))
            for c in range(70) for t in range(draw.randrange(1, 12))]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 240) for t in range(20)]
    rows += [(c, t, "user", f"long {t}" if t < 120 or c == 500 else "other") for c in (500, 501) for t in range(150)]
    return rows + [(None, 1, "x", "y"), (7, 3, "user", "dup"), (7, 3, "user", "dup"), (-25, 0, "u", "x"), (-20, 0, "u", "y"),
                   (321, 0, "u", "word " * 50_000)]


@pytest.mark.parametrize("how", [{}, {"segment": 16, "shard_turns": 3}, {"segment": 1, "shard_turns": 1}])
def test_matches_plain_trie(spark, how):
    rows = fixture()
    table = spark.createDataFrame([(*r, 9, "z") for r in rows], SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in prefix_nodes(*rebuilt(table), **how).collect()), key=repr)
    assert got == brute(rows)


def test_empty_and_turnless(spark):
    table = spark.createDataFrame([(5, 0, "u", "x", 1, "z")], SCHEMA)
    assert prefix_nodes(*rebuilt(table.limit(0))).count() == 0
    # The first turn is taken from conversation 0, which is not there: nothing is left but the root.
    short = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    only = spark.createDataFrame([(short, 0, "u", "x", 1, "z")], SCHEMA)
    assert [tuple(r)[:7] for r in prefix_nodes(*rebuilt(only)).collect()] == [(short, 0, None, 1, 0, 1, 0)]
    with pytest.raises(ValueError):
        prefix_nodes(*rebuilt(only), segment=3)


def test_double_array_holds_its_paths():
    draw = np.random.default_rng(1)
    lengths = draw.integers(0, 9, 3000)
    firsts = np.append(0, np.cumsum(lengths))
    ids, roots = draw.integers(0, 50, firsts[-1]) ** 2, draw.integers(0, 3, 3000)
    paths = Paths(roots, ids, firsts)
    trie = DoubleArray(paths)
    distinct = {(r, *ids[a : a + k]) for r, a, n in zip(roots, firsts, lengths) for k in range(1, n + 1)}
    assert (trie.check >= 0).sum() == len(distinct) and len(set(trie.slot)) == len(trie.slot)
    state = roots.copy()
    for number in range(paths.longest):
        own, places = paths.step(number)
        state[own] = trie.walk(state[own], ids[places])
    ends = {}
    for row in range(3000):
        assert ends.setdefault(int(state[row]), (roots[row], *ids[firsts[row] : firsts[row + 1]])) == (
            roots[row], *ids[firsts[row] : firsts[row + 1]])
    assert len(trie.check) < 20 * len(distinct)
