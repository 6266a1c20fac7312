"""Queries of the training-data operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import source_filter as S
from graphloom.llm.doc_pairs import described_symbols
from graphloom.llm.leakage import leaks
from graphloom.llm.mixing import materialize, mixture, shares
from graphloom.llm.near_dup import expand_pairs, near_duplicates
from graphloom.llm.residue import residues
from graphloom.llm.source_filter import not_hand_written
from graphloom.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that are not hand-written, by the layout of their symbols' texts, size and lines, header and place."""
    bodies = table(spark, d, "ts_symbols").where("body_text is not null").select("project", F.col("file_path").alias("rel_path"), F.col("body_text").alias("content"))
    return not_hand_written(table(spark, d, "file_hashes"), table(spark, d, "nodes"), bodies, fragments=True).select("project", "rel_path")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of functions and methods of eight or more lines whose three-word runs are similar to 0.7 or more."""
    bodies = table(spark, d, "ts_symbols").where(F.col("label").isin("Function", "Method") & (F.regexp_count("body_text", F.lit("\r\n|\r|\n")) >= 7))
    members, links = near_duplicates(bodies, "symbol_id", "body_text", k=3, threshold=0.7)
    return expand_pairs(members, links).select(F.col("a").alias("symbol_a"), F.col("b").alias("symbol_b"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Functions and methods whose documentation tells what they do."""
    return described_symbols(table(spark, d, "ts_symbols"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items whose passages they hold."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_mixture_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached by a mixture of all documents that is as large as they are."""
    targets = table(spark, d, "mix_targets")
    return shares(mixture(table(spark, d, "documents"), targets), targets)


def p7_mixture_slots(spark: SparkSession, d: str) -> DataFrame:
    """Every slot of that mixture with its tokens: how many, from how many records, and a hash of them in order."""
    docs = table(spark, d, "documents")
    spans = materialize(mixture(docs, table(spark, d, "mix_targets")), docs).select("shard", "slot", "source", "repeat", "block", "doc_id", "start", F.size("tokens").alias("n"), F.xxhash64("tokens").alias("h"))
    return spans.groupBy("shard", "slot", "source", "repeat", "block").agg(F.sum("n").alias("tokens"), F.count("*").alias("records"), F.bit_xor(F.xxhash64("doc_id", "start", "h")).alias("content"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with template residue, filler or error-page text."""
    return residues(table(spark, d, "documents")).select("doc_id").distinct()


QUERIES = {
    "p1_found": p1_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p7_mixture_shares": p7_mixture_shares, "p7_mixture_slots": p7_mixture_slots, "p8_found": p8_found,
}


def _matches(column: str, patterns) -> str:
    return f"coalesce(regexp_matches({column}, '" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''") + "'), false)"


def _folder(names) -> str:
    return "coalesce(regexp_matches(p, '(^|/)(" + "|".join(re.escape(n) for n in names) + ")/'), false)"


# p1 in SQL judges by place, header, size and lines; the lexed texts, which SQL can't judge, add nothing on these tables.
# p4 in SQL compares all sets that share a run. p6 in SQL lists all 13-word runs of either side. p5 and p8 judge text in
# ways that SQL can't express; their tests hold cases of known answer.
ORACLES: dict[str, str] = {
    "p1_found": rf"""
WITH f AS (SELECT project, rel_path, max(size) AS size, regexp_replace(regexp_replace(rel_path, '[\\/]+', '/', 'g'), '^(\./)*/?', '') AS at FROM file_hashes WHERE rel_path IS NOT NULL GROUP BY project, rel_path),
n AS (SELECT project, regexp_replace(regexp_replace(file_path, '[\\/]+', '/', 'g'), '^(\./)*/?', '') AS at, max(json_extract_string(properties, '$.header')) AS header,
  max(coalesce(TRY_CAST(json_extract_string(properties, '$.line_count') AS BIGINT), end_line)) AS line_count FROM nodes WHERE label = 'File' AND file_path IS NOT NULL GROUP BY ALL),
k AS (SELECT f.project, f.rel_path, lower(f.at) AS p, regexp_extract(lower(f.at), '[^/]*$') AS name, lower(n.header) AS h, CASE WHEN n.line_count > 0 THEN f.size / {float(S.CANONICAL_WIDTH)} / n.line_count END AS x
  FROM f LEFT JOIN n ON n.project IS NOT DISTINCT FROM f.project AND n.at = f.at)
SELECT project, rel_path FROM k WHERE {_matches('h', S.COPY_HEADERS)} OR {_matches('h', S.TOOL_HEADERS)} OR {_folder(S.VENDOR_FOLDERS)} OR {_folder(S.OUTPUT_FOLDERS)}
  OR (regexp_matches(p, '(^|/)vendor/[^/]+/') AND NOT regexp_matches(p, '(^|/)(java|kotlin|scala)/(.*/)?vendor/')) OR regexp_matches(p, '(^|/)(assets|public|static|web|www|js|css)/vendor/')
  OR {_matches('name', (S.RELEASE_NAME, *S.OUTPUT_NAMES, *S.DELIVERY_NAMES))} OR regexp_matches(regexp_extract(name, '{S.HASHED_NAME}', 1), '[0-9]')
  OR (x IS NULL AND regexp_matches(p, '(^|/)(data|fixtures|testdata)/[^/]*_(map|table|dump|blob)\.[a-z]+$')) OR coalesce(x, 0) >= {S.EXPANDED}
""",
    "p4_found": r"""
WITH b AS (SELECT DISTINCT symbol_id, regexp_extract_all(lower(body_text), '[a-z0-9_]+') AS w FROM ts_symbols
  WHERE label IN ('Function', 'Method') AND len(regexp_extract_all(body_text, '\r\n|\r|\n')) >= 7),
runs AS (SELECT DISTINCT symbol_id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS run FROM b WHERE len(w) >= 3),
n AS (SELECT symbol_id, count(*) AS n FROM runs GROUP BY symbol_id),
met AS (SELECT a.symbol_id AS a, b.symbol_id AS b, count(*) AS m FROM runs a JOIN runs b ON a.run = b.run AND a.symbol_id < b.symbol_id GROUP BY ALL)
SELECT a AS symbol_a, b AS symbol_b FROM met JOIN n x ON x.symbol_id = a JOIN n y ON y.symbol_id = b WHERE m / (x.n + y.n - m)::DOUBLE >= 0.7
""",
    "p6_found": r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') FROM eval_items WHERE text IS NOT NULL
),
runs AS (
  SELECT DISTINCT side, id, array_to_string(w[p:p + 12], ' ') AS run FROM (SELECT side, id, w, unnest(generate_series(1, len(w) - 12)) AS p FROM w WHERE len(w) >= 13)
)
SELECT DISTINCT a.id AS doc_id, b.id AS item_id FROM runs a JOIN runs b ON a.run = b.run AND a.side = 'd' AND b.side = 'i'
""",
}
