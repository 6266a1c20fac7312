from graphloom.llm import mixing as M
from graphloom.llm.queries import QUERIES

DOCS = "doc_id bigint, source string, text string"
TARGETS = "source string, target_share double, max_repeat int"


def test_total_of_the_corpus(frame):
    docs = frame([(i, s, " ".join(f"w{j * i}" for j in range(40))) for i, s in enumerate(["code"] * 80 + ["issue"] * 10 + ["adr"] * 2 + ["other"] * 50)], DOCS)
    targets = frame([("code", 0.5, 2), ("issue", 0.3, 4), ("adr", 0.2, 3)], TARGETS)
    counts = {r["source"]: r["n"] for r in M.token_counts(docs, "doc_id", "text").groupBy("source").sum("n_tokens").toDF("source", "n").collect()}
    total = sum(n for s, n in counts.items() if s != "other")
    mixed = M.mixture(docs, targets, block=32, slots_per_shard=16).cache()
    report = {r["source"]: r for r in M.shares(mixed, targets).collect()}
    assert abs(sum(r["tokens"] for r in report.values()) - total) < 0.05 * total and mixed.select("shard").distinct().count() > 3
    assert report["adr"]["most_repeats"] == 3 and report["adr"]["tokens"] == 3 * counts["adr"]  # at its cap
    assert 1 < report["issue"]["most_repeats"] <= 4 and report["code"]["most_repeats"] == 1


def test_query_draws_as_much_as_there_is(frame, spark, tmp_path):
    docs = [(i, "code" if i % 3 else "adr", " ".join(f"w{j * i}" for j in range(400))) for i in range(60)]
    frame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    frame([("code", 0.5, 9), ("adr", 0.5, 9)], TARGETS).write.parquet(f"{tmp_path}/mix_targets.parquet")
    encode = M.encoder(M.VOCABULARY).encode_ordinary
    total = sum(len(encode(t)) for _, _, t in docs)
    drawn = sum(r["tokens"] for r in QUERIES["p7_mixture_shares"](spark, str(tmp_path)).collect())
    assert abs(drawn - total) <= 2 * 2048
