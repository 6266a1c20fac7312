"""Search over nodes and texts: token filters, ranked tiers, boolean and BM25 retrieval."""

from __future__ import annotations

import functools
import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import fixed
from graphloom.functions.columns import path_penalty

TOKENS = r"[^\p{L}\p{N}]+"


def matches(query: str) -> Column:
    """Whether name or qualified name contains every token of the query, ignoring case."""
    both = lambda t: F.contains(F.lower("name"), F.lit(t)) | F.contains(F.lower("qualified_name"), F.lit(t))
    return reduce(lambda a, b: a & b, [both(t.lower()) for t in query.split()], F.lit(True))


def suffix_of(suffix: str) -> Column:
    """Whether the qualified name is the suffix or ends in it at a dot."""
    return (F.col("qualified_name") == suffix) | F.col("qualified_name").endswith(f".{suffix}")


def ranked_symbols(nodes: DataFrame, query: str, limit: int, label: str | None = None) -> DataFrame:
    """Nodes by tier: qualified name 1.0, name 0.9, suffix 0.7, contained 0.4, less path penalties; 0.3 and more is kept."""
    test, mock = path_penalty(F.col("file_path"))
    tier = F.when(F.col("qualified_name") == query, 1.0).when(F.col("name") == query, 0.9).when(suffix_of(query), 0.7).when(matches(query), 0.4)
    found = nodes if label is None else nodes.where(F.col("label") == label)
    scored = found.withColumn("tier", tier).where("tier is not null").withColumn("score", F.col("tier") - test - mock).where("score >= 0.3")
    return scored.orderBy(F.desc("score"), "qualified_name", "id").limit(limit)


def layered(layers: list[DataFrame], key: str, limit: int) -> DataFrame:
    """Union of result layers; a key found in several keeps its first, and earlier layers fill the limit first."""
    tagged = [layer.withColumn("layer", F.lit(i)) for i, layer in enumerate(layers)]
    every = reduce(lambda a, b: a.unionByName(b), tagged)
    first = every.withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy("layer"))).where("rn = 1").drop("rn")
    return first.orderBy("layer", key).limit(limit)


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, term, tf, dl) of every document; terms are runs of letters and digits in lower case."""
    terms = docs.select(F.col(doc_id).alias("doc"), F.filter(F.split(F.lower(text), TOKENS), lambda x: x != "").alias("t"))
    return terms.select("doc", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def boolean_and(docs: DataFrame, doc_id: str, text: str, query: str) -> DataFrame:
    """(doc) of the documents that hold every term of the query."""
    wanted = sorted(set(query.lower().split()))
    hits = postings(docs, doc_id, text).where(F.col("term").isin(wanted))
    return hits.groupBy("doc").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(wanted)).select("doc")


def bm25(docs: DataFrame, doc_id: str, text: str, query: str, limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc, score) of the best documents for any of the query's terms.

    Term counts come from one pass that keeps only the query's terms; document lengths and their mean from the same
    tokens. Ties go to the lesser id.
    """
    wanted = sorted(set(query.lower().split()))
    t = docs.select(F.col(doc_id).alias("doc"), F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), TOKENS), lambda x: x != "").alias("t"))

    def times(word: str) -> Column:
        return F.size(F.filter("t", lambda x: x == word))

    counted = t.select("doc", F.size("t").alias("dl"), *[times(w).alias(f"tf{i}") for i, w in enumerate(wanted)])
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(wanted))])
    any_hit = reduce(lambda x, y: x | y, [F.col(f"tf{i}") > 0 for i in range(len(wanted))])
    hit = counted.where(any_hit).join(F.broadcast(stats))  # one row of statistics
    idf = lambda i: F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
    term = lambda i: idf(i) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hit.select("doc", reduce(lambda x, y: x + y, [term(i) for i in range(len(wanted))]).alias("score"))
    return scored.orderBy(F.desc("score"), "doc").limit(limit)


def with_metadata(nodes: DataFrame, label: str | None = None, test: bool | None = None, exported: bool | None = None, entry_point: bool | None = None, least_complexity: int | None = None) -> DataFrame:
    """Nodes whose label and properties fit all of the given conditions."""
    held = lambda key: F.lower(F.get_json_object("properties", f"$.{key}"))
    kept = nodes if label is None else nodes.where(F.col("label") == label)
    for key, value in (("is_test", test), ("is_exported", exported), ("is_entry_point", entry_point)):
        if value is not None:
            kept = kept.where(F.coalesce(held(key), F.lit("false")) == str(value).lower())
    return kept if least_complexity is None else kept.where(F.expr("try_cast(get_json_object(properties, '$.complexity') as int)") >= least_complexity)


def link_suggestions(projects: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, score, reasons) of pairs of projects that seem related.

    Pairs come from what two projects have in common - a stem of the name, a word of it, a type's name - and from names of
    which one holds the other, looked up by the shorter one's first three letters; projects without any of these don't
    meet. Points: 25 for names, 10 for each shared type up to 30, 8 for each shared word up to 15.
    """
    words = F.filter(F.split(F.lower("name"), "[-_.]"), lambda x: (F.length(x) > 2) & ~x.isin(*fixed.GENERIC_NAME_WORDS))
    stem = F.regexp_replace(F.lower("name"), "|".join(fixed.PROJECT_SUFFIXES), "")
    p = projects.select("name", words.alias("words"), stem.alias("stem"))
    low, size = F.lower("name"), F.length("name")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(size - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3)))
    keyed = lambda kind, key: p.select("name", F.lit(kind).alias("kind"), key.alias("key"))
    keys = keyed("word", F.explode("words")).unionByName(keyed("stem", F.col("stem"))).unionByName(keyed("gram", F.explode(F.array_distinct(grams))))
    shared = nodes.where(F.col("label").isin("Class", "Interface")).select(F.col("project").alias("x"), F.col("name").alias("type")).distinct()
    types = shared.join(shared.withColumnRenamed("x", "y"), "type").where("x < y").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.count("*").alias("n"))
    met = keys.select(F.col("name").alias("a"), "kind", "key").join(keys.select(F.col("name").alias("b"), "kind", "key"), ["kind", "key"]).where("a < b").select("a", "b").unionByName(types.select("a", "b")).distinct()
    side = lambda n: p.select(F.col("name").alias(n), F.col("words").alias(f"w_{n}"), F.col("stem").alias(f"s_{n}"))
    both = met.join(side("a"), "a").join(side("b"), "b").join(types, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    related = F.contains(F.lower("a"), F.lower("b")) | F.contains(F.lower("b"), F.lower("a")) | (F.col("s_a") == F.col("s_b"))
    common = F.size(F.filter("w_a", lambda x: F.array_contains("w_b", x)))
    points = F.when(related, 25).otherwise(0) + F.least(F.lit(30), 10 * F.col("n")) + F.least(F.lit(15), 8 * common)
    reasons = F.array_join(F.array_compact(F.array(F.when(related, "related names"), F.when(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" shared types"))), F.when(common > 0, "common words"))), ", ")
    return both.select("a", "b", F.round(points / 100, 2).alias("score"), reasons.alias("reasons")).where("score > 0")


def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks that stand for a plain letter with a mark, and those letters."""
    found = [(chr(c), unicodedata.normalize("NFD", chr(c))) for lo, hi in ((0xC0, 0x250), (0x1E00, 0x1F00)) for c in range(lo, hi)]
    kept = [(c, d[0]) for c, d in found if len(d) > 1 and d[0].isascii() and all(unicodedata.combining(m) for m in d[1:])]
    return "".join(c for c, _ in kept), "".join(d for _, d in kept)


ACCENTED, PLAIN = _accents()


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case, with the marks of Latin letters taken off."""
    return F.filter(F.split(F.translate(F.lower(text), ACCENTED, PLAIN), TOKENS), lambda x: x != "")


def stem(word: str) -> str:
    """The stem of an English word, by Porter's algorithm of 1980."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word

    def form(w: str) -> str:
        return "".join("v" if c in "aeiou" or (c == "y" and i and w[i - 1] not in "aeiou") else "c" for i, c in enumerate(w))

    measure = lambda w: len(re.findall("v+c+", form(w)))
    has_vowel = lambda w: "v" in form(w)
    double = lambda w: len(w) > 1 and w[-1] == w[-2] and form(w)[-1] == "c"
    closed = lambda w: form(w)[-3:] == "cvc" and w[-1] not in "wxy"

    def replaced(w: str, rules: tuple, least: int) -> str:
        for end, new in rules:
            if w.endswith(end):
                base = w[: len(w) - len(end)]
                return base + new if measure(base) > least and (end != "ion" or base[-1:] in ("s", "t")) else w
        return w

    w = replaced(word, (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")), -1)
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if has_vowel(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif measure(w) == 1 and closed(w):
                        w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    # The algorithm's endings, longest first where one ends in another.
    w = replaced(w, (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")), 0)
    w = replaced(w, (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")), 0)
    w = replaced(w, tuple((e, "") for e in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")), 1)
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not closed(w[:-1]))):
        w = w[:-1]
    return w[:-1] if measure(w) > 1 and double(w) and w[-1] == "l" else w


def stemmed(rows: DataFrame, column: str) -> DataFrame:
    """The rows with the words of an array column replaced by their stems, batch by batch."""

    def run(batches):
        known = functools.lru_cache(maxsize=100_000)(stem)
        for pdf in batches:
            pdf[column] = [None if words is None else [known(w) for w in words] for words in pdf[column]]
            yield pdf

    return rows.mapInPandas(run, rows.schema)


def weighted_bm25(docs: DataFrame, doc_id: str, fields: dict[str, float], query: str, limit: int | None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc, score) of the documents for any keyword of the query; a field's occurrences count by its weight.

    Lengths are those of all fields together. Keywords are words without stop words; ties go to the lesser id.
    """
    wanted = sorted({w for w in (re.sub(r"[^\w]", "", x.lower()) for x in query.split()) if len(w) > 1 and w not in fixed.STOP_WORDS})
    t = docs.select(F.col(doc_id).alias("doc"), *[tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"t{i}") for i, f in enumerate(fields)])
    count = lambda i, w: F.size(F.filter(f"t{i}", lambda x: x == w))
    total = reduce(lambda x, y: x + y, [F.size(f"t{i}") for i in range(len(fields))])
    tf = [reduce(lambda x, y: x + y, [count(i, w) * weight for i, weight in enumerate(fields.values())]).alias(f"tf{j}") for j, w in enumerate(wanted)]
    counted = t.select("doc", total.alias("dl"), *tf)
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{j}") > 0).alias(f"df{j}") for j in range(len(wanted))])
    hit = counted.where(reduce(lambda x, y: x | y, [F.col(f"tf{j}") > 0 for j in range(len(wanted))], F.lit(False))).join(F.broadcast(stats))  # one row of statistics
    idf = lambda j: F.log(1 + (F.col("n") - F.col(f"df{j}") + 0.5) / (F.col(f"df{j}") + 0.5))
    part = lambda j: idf(j) * F.col(f"tf{j}") * (k1 + 1) / (F.col(f"tf{j}") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hit.select("doc", reduce(lambda x, y: x + y, [part(j) for j in range(len(wanted))], F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "doc")
    return scored if limit is None else scored.limit(limit)


def broad_search(nodes: DataFrame, contents: DataFrame, query: str, limit: int) -> DataFrame:
    """(id, layer, score): nodes by name (layer 0, score 100), by the text kept for them (1, BM25), by properties (2, 0).

    ``contents(project, qualified_name, content)`` is joined to nodes by project and qualified name; a node found in several
    layers keeps its first, and earlier layers fill the limit first.
    """
    named = nodes.where(matches(query)).select("id", F.lit(0).alias("layer"), F.lit(100.0).alias("score"))
    texts = contents.join(nodes.select("id", "project", "qualified_name"), ["project", "qualified_name"])
    told = weighted_bm25(texts, "id", {"qualified_name": 1.0, "content": 5.0}, query, None).select(F.col("doc").alias("id"), F.lit(1).alias("layer"), "score")
    rest = nodes.where(F.contains(F.lower("properties"), F.lit(query.lower()))).select("id", F.lit(2).alias("layer"), F.lit(0.0).alias("score"))
    every = named.unionByName(told).unionByName(rest)
    first = every.withColumn("rn", F.row_number().over(W.partitionBy("id").orderBy("layer"))).where("rn = 1").drop("rn")
    return first.orderBy("layer", F.desc("score"), "id").limit(limit)
