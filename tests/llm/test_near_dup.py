import random
import re

import pytest

from graphloom.llm import near_dup as N


def runs(text, k):
    w = re.findall("[a-z0-9_]+", (text or "").lower())
    return frozenset(zip(*[w[i:] for i in range(k)]))


def brute(rows, k, g):
    sets = [(i, runs(t, k)) for i, t in rows]
    return {(min(i, j), max(i, j)) for i, a in sets for j, b in sets if i != j and a and b and len(a & b) / len(a | b) >= g}


def texts(seed, n):
    """Variants of a few base texts with small edits, among texts of common words."""
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randrange(4, 90))] for _ in range(n // 8)]
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = rng.choice(["x", "y", *vocabulary])
        if rng.random() < 0.3:
            at = rng.randrange(len(words))
            words[at:at] = ["if", "err", "nil", "return"] * rng.randrange(1, 4)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("k, g", [(3, 0.7), (5, 0.8)])
def test_against_brute_force(frame, monkeypatch, k, g):
    monkeypatch.setattr(N, "MIN_COMMON", 5)
    rows = texts(k, 160) + [(900, None), (901, ""), (902, "a b"), (903, "Same text here TWICE over and over again"), (904, "same text, here twice; over and over again"), (904, "same text, here twice; over and over again"), (905, "z " * 5000)]
    df = frame([(i, t, "clash") for i, t in rows], "id bigint, body string, cls string")
    members, links = N.near_duplicates(df, "id", "body", k=k, threshold=g)
    assert {tuple(r) for r in N.expand_pairs(members, links).collect()} == brute(dict(rows).items(), k, g)


def test_hot_common_words(frame, monkeypatch):
    monkeypatch.setattr(N, "MIN_COMMON", 2)  # nearly every word is common, so that the exact way for the rest does the work
    rows = texts(7, 60)
    members, links = N.near_duplicates(frame(rows, "id bigint, body string"), "id", "body", k=3, threshold=0.7)
    assert {tuple(r) for r in N.expand_pairs(members, links).collect()} == brute(rows, 3, 0.7)


def test_empty(frame):
    members, links = N.near_duplicates(frame([], "id bigint, body string"), "id", "body")
    assert members.count() == 0 and links.count() == 0


def test_bands():
    table = N.bands(0.7)
    assert all(a[1] + 1 == b[0] for a, b in zip(table, table[1:])) and table[-1][0] > 2**31


@pytest.mark.parametrize("k, g", [(3, 0.7), (5, 0.8)])
def test_hot_groups_by_enumerated_subsets(frame, monkeypatch, k, g):
    monkeypatch.setattr(N, "MIN_COMMON", 5)
    monkeypatch.setattr(N, "HOT", 3)
    monkeypatch.setattr(N, "CROWD", 3)
    monkeypatch.setattr(N, "BLOCK", 4)
    rng = random.Random(k)
    base = [f"b{i}" for i in range(70)]
    rows = texts(k, 60)
    for i in range(60):  # many records that nearly equal one
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(30)}"
        rows.append((500 + i, " ".join(words)))
    members, links = N.near_duplicates(frame(rows, "id bigint, body string"), "id", "body", k=k, threshold=g)
    assert {tuple(r) for r in N.expand_pairs(members, links).collect()} == brute(rows, k, g)


def test_enumerated_signatures_miss_no_pair():
    import numpy as np

    rng = random.Random(1)
    sets = []
    for _ in range(60):
        base = [rng.getrandbits(60) << 2 | 3 for _ in range(rng.randrange(1, 120))]
        sets.append(base)
        other = [x for x in base if rng.random() > 0.12] + [rng.getrandbits(60) << 2 | 3 for _ in range(len(base) // 12)]
        sets.append(other or base)
    offsets = np.cumsum([0, *map(len, sets)])
    for g in (0.7, 0.8):
        sig, owner, short = N.enumerated_arrays(offsets, np.array([x for s in sets for x in s], dtype=np.int64), g, N.bands(g))
        of = [set(sig[owner == i].tolist()) for i in range(len(sets))]
        similar = [(i, j) for i in range(len(sets)) for j in range(i) if len(set(sets[i]) & set(sets[j])) >= g * len(set(sets[i]) | set(sets[j]))]
        assert len(similar) > 15 and all(of[i] & of[j] for i, j in similar) and short < len(sets)


def test_classes_of_one_hash_are_told_apart(frame, spark):
    from graphloom.plans.lineage import SharedTables

    sets = frame([(1, 7, 1, [1, 2]), (2, 7, 1, [1, 2]), (3, 7, 2, [1, 3]), (4, 8, 1, [4])], "id bigint, cls bigint, other bigint, sh array<bigint>")
    got = {r["id"]: r["cls"] for r in N.distinct_classes(sets, SharedTables(spark, "test")).collect()}
    assert got[1] == got[2] == 7 and got[3] not in (7, 8) and got[4] == 8
