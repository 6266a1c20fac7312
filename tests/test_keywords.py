from graphloom.functions import fixed
from graphloom.queries import texts


def test_all_keywords_of_a_long_text(spark, tmp_path):
    words = [f"Word_{i}," for i in range(40)]
    rows = [(1, "The " + " of\t".join(words) + "\n(x)"), (2, None), (3, ""), (4, "same same"), (4, "same same")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text in rows:
        if text is not None:
            cleaned = ["".join(c for c in w.lower() if c.isalnum() or c == "_") for w in text.split()]
            want.append((i, " ".join(w for w in cleaned if len(w.encode()) > 1 and w not in fixed.STOP_WORDS)))
    got = [tuple(r) for r in texts.QUERIES["fp15_keywords"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(dict(got)[1].split()) == 40
