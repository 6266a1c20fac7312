import random
import re

from graphloom.llm import leakage as L


def brute(docs, items, n):
    cut = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t or "")]
    grams = lambda t: {tuple(w[i : i + n]) for w in [cut(t)] for i in range(len(w) - n + 1)}
    held = {i: grams(t) for i, t in items}
    return {(d, i) for d, t in docs for i in held if grams(t) & held[i]}


def test_against_brute_force(frame):
    rng = random.Random(1)
    word = lambda: rng.choice("alpha beta gamma delta Über eins dos tres".split())
    items = [(i, " ".join(word() for _ in range(rng.randrange(3, 40)))) for i in range(12)] + [(50, None), (51, ""), (52, "one two three")]
    docs = []
    for i in range(80):
        source = (rng.choice(items)[1] or "").split()
        a = rng.randrange(len(source) + 1)
        docs.append((i, " ".join(word() for _ in range(9)) + ", \n> " + "; ".join(source[a : a + rng.randrange(0, 20)]).upper() + " ... " + " ".join(word() for _ in range(9))))
    docs += [(900, None), (901, ""), (902, "x" * 100000), (0, docs[0][1])]
    got = L.leaks(frame([(d, t, 1) for d, t in docs], "doc_id bigint, text string, item_id int"), frame(items, "item_id bigint, text string"), n=6)
    assert {tuple(r) for r in got.collect()} == brute(docs, items, 6)
    assert got.count() == len(brute(docs, items, 6))


def test_passes_and_empty(frame, monkeypatch):
    monkeypatch.setattr(L, "PASS_CHARS", 30)
    docs, items = frame([(1, "a b c d e"), (2, "c d e f g")], "doc_id bigint, text string"), frame([(1, "a b c x"), (2, "d e f y"), (3, "q r s")], "item_id bigint, text string")
    assert {tuple(r) for r in L.leaks(docs, items, n=3).collect()} == {(1, 1), (2, 2)}
    assert L.leaks(docs.limit(0), items, n=3).count() == 0 and L.leaks(docs, items.limit(0), n=3).count() == 0


def test_words():
    assert L.words("Größe_x 12½ İx don't") == ["größe", "x", "12", "i̇x", "don", "t"]
