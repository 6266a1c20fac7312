import random

from pyspark.sql import functions as F

from graphloom.operators import similarity as M


def test_bands_miss_no_pair(frame):
    rng = random.Random(2)
    base = [[rng.randrange(10**6) for _ in range(128)] for _ in range(8)]
    rows = [(0, None), (1, [1, 2, 3])]
    for i in range(80):
        sig = list(rng.choice(base))
        for at in rng.sample(range(128), rng.choice([0, 5, 30, 37, 38, 39, 45])):
            sig[at] = rng.randrange(10**6)
        rows.append((10 + i, sig))
    members, links = M.similar_signatures(frame(rows, "id bigint, s array<bigint>"), "id", "s")
    of = {r["id"]: r["cls"] for r in members.collect()}
    assert set(of) == {i for i, s in rows if s and len(s) == 128}
    sets = dict(rows)
    want = {tuple(sorted((of[i], of[j]))) for i in of for j in of if of[i] != of[j] and sum(a == b for a, b in zip(sets[i], sets[j])) >= 0.7 * 128}
    assert {tuple(sorted((r["a"], r["b"]))) for r in links.collect()} == want and len(want) > 20
    counted = {r["id"]: r["copies"] for r in M.class_links(members, links).collect()}
    assert all(counted[i] == sum(of[j] == of[i] for j in of) for i in of)


def test_structural_tokens(frame):
    texts = frame([(1, "int f(a) { // no\n  s = \"x { y\"; /* z */ return a+1; } # end"), (2, ""), (3, None), (4, "'" * 3 + "\\")], "id bigint, t string")
    got = {r["id"]: r["k"] for r in texts.select("id", M.structural_tokens(F.col("t")).alias("k")).collect()}
    assert got[1] == ["int", "f", "a", "s", "return", "a", "1"] and got[2] == [] and got[3] is None and isinstance(got[4], list)


def test_signatures(frame):
    rows = [(1, [5, 9, 9]), (2, [9, 5]), (3, []), (4, None), (5, [123_456_789])]
    got = {r["id"]: r["sig"] for r in M.signatures(frame(rows, "id bigint, h array<bigint>"), "id", "h").collect()}
    assert set(got) == {1, 2, 5} and got[1] == got[2]
    assert got[5] == [(123_456_789 * a + b) % M.P for a, b in zip(M.MULTIPLIERS, M.OFFSETS)]
    assert M.signatures(frame([], "id bigint, h array<bigint>"), "id", "h").count() == 0


def test_common_values_meet_nothing(frame):
    """Slots whose value nearly all signatures share make no pairs; nulls agree with nothing; the few similar ones are found."""
    rng = random.Random(3)
    rows = [(i, [7] * 40 + [rng.randrange(10**9) for _ in range(88)]) for i in range(1000)]
    for i in range(40):
        sig, at = list(rows[i][1]), rng.sample(range(128), rng.choice([1, 20, 38, 39, 60]))
        for j in at:
            sig[j] = None if i % 3 == 0 else -1 - rng.randrange(10**9)
        rows += [(5000 + i, sig), (6000 + i, list(sig))]
    few = rows[:40] + rows[1000:]
    want = sorted((a, b) for a, x in few for b, y in few if a < b and x != y and sum(p is not None and p == q for p, q in zip(x, y)) >= 90)
    sets = frame(rows, "id bigint, s array<bigint>")
    assert M._candidates(sets.select(F.xxhash64("s").alias("cls"), "s"), 128, 90).count() < 500
    members, links = M.similar_signatures(sets, "id", "s")
    ids = links.join(members.withColumnsRenamed({"id": "x", "cls": "a"}), "a").join(members.withColumnsRenamed({"id": "y", "cls": "b"}), "b")
    got = sorted((min(r["x"], r["y"]), max(r["x"], r["y"])) for r in ids.collect())
    assert got == want and len(want) > 20


def test_no_agreement_needed(frame):
    _, links = M.similar_signatures(frame([(i, [i] * 128) for i in range(40)], "id bigint, s array<bigint>"), "id", "s", threshold=0.0)
    assert links.count() == 780


def test_signatures_are_made_once(spark):
    """The pairs are sought in stored signatures: no plan after these lexes texts again."""
    from graphloom.queries import services

    plan = services.QUERIES["ep24_similar_functions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "body_text" not in plan and "MapInArrow" not in plan


def test_small_and_empty_signatures(frame):
    none, links = M.similar_signatures(frame([], "id bigint, s array<bigint>"), "id", "s")
    assert none.count() == 0 and links.count() == 0
    rows = [(1, [1, 2, 3, 4]), (2, [1, 2, 3, 5]), (3, [1, 2, 9, 9]), (4, [None, 2, 3, 4]), (5, [None] * 4), (6, [1, 2])]
    members, links = M.similar_signatures(frame(rows, "id bigint, s array<int>"), "id", "s", 0.75, 4)
    assert members.count() == 5 and links.count() == 2  # 1 with 2 and with 4
