"""The prefix trie against one built turn by turn in memory."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from marlstone.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Nodes of rebuilt conversations, from a dictionary of prefixes."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((-(10**30) if turn is None else turn), said, role, text))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
    members = {}
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for key, of in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        for d in range(len(key) + 1):
            leaves[key[:d]] += not kids[key]
            saved[key[:d]] += (len(of) - 1) * words
    out = []
    for key, of in members.items():
        ends = sorted(c for c in of if len(rebuilt[c]) == len(key))
        out.append((min(of), len(key), min(members[key[:-1]]) if key else None, len(of), kids[key], leaves[key], saved[key], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return Counter(out)


def made(spark, rows):
    df = spark.createDataFrame([(*r, "own d", "own c") for r in rows], SCHEMA + ", d string, c string")
    numbered = trie.number_turns(df.repartition(3))
    return Counter(tuple(r) for r in trie.trie(*trie.rebuild(numbered)).collect())


def conversations(seed, n, turns, texts):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]) if t else "user", rng.choice(texts)) for c in range(n) for t in range(rng.randint(0, turns))]


@pytest.mark.parametrize("bits", [12, 1])
def test_against_plain(spark, monkeypatch, bits):
    monkeypatch.setattr(trie, "BLOCK_BITS", bits)
    rows = conversations(1, 90, 9, ["a b", "c", ""])
    rows += [(200, None, None, None), (200, None, "user", "x y"), (200, 3, "user", "tie"), (200, 3, "user", "tie"), (200, 3, "assistant", "tie"), (None, 1, "user", "nobody's")]
    rows += [(-7, 0, "user", "a b"), (-7, 1, "user", "long " * 50000)] + [(c, t, "user", "same") for c in range(300, 330) for t in range(5)]
    assert made(spark, rows) == plain(rows)


def test_long_chains_and_copies(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK_BITS", 3)
    # chain hangs from chain: each conversation follows the one before it for a little longer
    rows = [(100 * c, t, "user", "w w" if t < 3 * c + 4 else f"own {c} {t}") for c in range(12) for t in range(40)]
    rows += [(100 * c + 50, t, "user", f"w w {t}") for c in range(20) for t in range(70)]
    got = made(spark, rows)
    assert got == plain(rows) and max(r[1] for r in got) == 70


def test_turnless_and_empty(spark):
    # conversations whose own turns all fall off and whose group has no first: they end at the root
    few = [c for c in range(401, 420) if zlib.crc32(str(c).encode()) % 4][:3]
    rows = [(c, 0, "user", "gone") for c in few]
    got = made(spark, rows)
    assert got == plain(rows) and len(got) == 1
    assert made(spark, [(None, 0, "user", "x")]) == Counter() == made(spark, [])
