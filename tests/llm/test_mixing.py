import numpy as np

from graphloom.llm import mixing as M


def test_permutation():
    for size in (1, 2, 3, 17, 64, 1000):
        out = M.permuted(np.arange(size), np.full(size, size), np.full(size, 5))
        assert sorted(out) == list(range(size))
    assert list(M.permuted(np.arange(50), np.full(50, 50), np.full(50, 1))) != list(M.permuted(np.arange(50), np.full(50, 50), np.full(50, 2)))


def test_allot():
    assert M.allot(10, {"a": 0.5, "b": 0.5}, {"a": 100, "b": 2}) == {"a": 8, "b": 2}
    assert M.allot(10, {"a": 1.0, "b": 0.0}, {"a": 3, "b": 9}) == {"a": 3, "b": 0}
    assert sum(M.allot(101, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, dict.fromkeys("abc", 1000)).values()) == 101


def test_mixture(frame):
    texts = {"code": 60, "Issue ": 12, "adr": 3}
    docs = [(i, s, f"record {i} " + " ".join(f"w{j * i}" for j in range(30))) for i, s in enumerate([s for s, n in texts.items() for _ in range(n)])] + [(900, None, "x"), (901, "code", None), (902, "other", "y"), (903, "code", "")]
    df = frame(docs, "doc_id bigint, source string, text string")
    targets = frame([("code", 0.6, 2), ("issue", 0.3, 1), ("adr", 0.1, 3), (None, 0.5, 1)], "source string, target_share double, max_repeat int")
    mixed = M.mixture(df, targets, total_tokens=3000, block=32, slots_per_shard=16)
    report = {r["source"]: r for r in M.shares(mixed, targets).collect()}
    assert set(report) == {"code", "issue", "adr"} and abs(report["code"]["share"] - 0.6) < 0.05 and abs(report["adr"]["share"] - 0.1) < 0.03
    used = mixed.groupBy("doc_id", "start", "n").count().join(df.select("doc_id", "source"), "doc_id").collect()
    assert all(r["count"] <= {"code": 2, "issue": 1, "adr": 3}[r["source"].strip().lower()] for r in used)
    again = M.mixture(df, targets, total_tokens=3000, block=32, slots_per_shard=16)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, again.collect()))
    whole = M.materialize(M.packed_blocks(M.token_counts(df, "doc_id", "text"), 32), df).collect()
    encode = M.encoder(M.VOCABULARY).encode_ordinary
    for i, _, text in docs:
        pieces = sorted((r["start"], r["tokens"]) for r in whole if r["doc_id"] == i)
        assert [t for _, p in pieces for t in p] == (encode(text) if text and i != 900 else [])
    assert M.shares(M.mixture(df.limit(0), targets, 100), targets).count() == 3


def test_shard_counts():
    totals = [700, 250, 51, 0]
    counts, first = M.shard_counts(totals, 16, 64, 3, np.arange(16))
    assert counts.sum(axis=0).tolist() == totals and counts.sum(axis=1).tolist() == [64] * 15 + [41]
    assert first.tolist() == (np.cumsum(counts, axis=0) - counts).tolist() and len({tuple(c) for c in counts.tolist()}) > 8
    some, at = M.shard_counts(totals, 16, 64, 3, np.array([11, 2]))  # a shard doesn't need the others
    assert some.tolist() == counts[[11, 2]].tolist() and at.tolist() == first[[11, 2]].tolist()
    big = [6 * 10**9, 4 * 10**9 + 7]
    counts, first = M.shard_counts(big, -(-sum(big) // 1024), 1024, 0, np.array([0, 5_000_000, sum(big) // 1024]))
    assert counts.sum(axis=1).tolist() == [1024, 1024, sum(big) % 1024] and ((0.45 < counts[:, 0] / counts.sum(axis=1)) | (counts.sum(axis=1) < 64)).all()
    assert first[2].sum() + counts[2].sum() == sum(big)


def test_slots_hold_blocks(frame, spark, tmp_path):
    from graphloom.llm.queries import QUERIES

    frame([(i, ["Code ", "adr"][i % 2], f"{i} " + "word " * (50 * i)) for i in range(80)], "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    frame([("code", 0.7, 3), ("adr", 0.3, 2)], "source string, target_share double, max_repeat int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    slots = QUERIES["p7_mixture_slots"](spark, str(tmp_path)).collect()
    shares = {r["source"]: r for r in QUERIES["p7_mixture_shares"](spark, str(tmp_path)).collect()}
    assert {s: sum(r["tokens"] for r in slots if r["source"] == s) for s in shares} == {s: r["tokens"] for s, r in shares.items()}
    assert all(r["tokens"] <= 2048 for r in slots)
    same = {}
    for r in slots:  # the same block has the same content wherever it is repeated
        assert same.setdefault((r["source"], r["block"]), (r["tokens"], r["records"], r["content"])) == (r["tokens"], r["records"], r["content"])


def test_documents_without_id_and_clashing_columns(frame):
    docs = frame([(1, "code", "a b c d", 7, "x"), (None, "code", "e f g h", 7, "x"), (2, "adr", "one two " * 5000, 7, "x"), (3, "adr", "", 7, "x")], "doc_id bigint, source string, text string, n int, block string")
    targets = frame([("code", 0.5, 2), ("code", 0.4, 1), ("adr", 0.5, None)], "source string, target_share double, max_repeat int")
    mixed = M.mixture(docs, targets, total_tokens=8, block=4)
    assert {r["doc_id"] for r in mixed.collect()} == {1}
    assert [r["tokens"] for r in M.materialize(mixed, docs).collect()] == [M.encoder(M.VOCABULARY).encode_ordinary("a b c d")] * 2
