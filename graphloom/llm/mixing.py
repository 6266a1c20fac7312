"""Mixing sources to target weights, in tokens.

The tokens of each source, laid end to end in a pseudorandom order of its records, are packed into blocks of fixed
length. The wanted total is cut into slots of one block, and slots into output shards; each shard draws how many of its
slots each source gets from the multinomial conditioned on the sources' totals, so the shares come out exactly. A
range of shards is halved again and again, each time by the seed of the range, so every shard finds its own counts, and
the numbers of its first slots, by itself. A slot's running number within its source is mapped to a block by a pseudorandom
permutation of the source's block indexes, a fresh one for each repetition, and blocks are joined to slots by index.
"""

from __future__ import annotations

import base64
import functools
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.plans.lineage import SharedTables

#: The public vocabulary that counts tokens, as the driver finds it; executors get it with the job.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Records of one bucket when offsets are summed; a source has as many buckets as it needs.
BUCKET_RECORDS = 20_000
#: Slots over which counts are drawn at random; a longer mixture is a row of such stretches with proportional counts.
STRETCH_SLOTS = 2**29


@functools.lru_cache(maxsize=4)
def encoder(vocabulary: str):
    """The tokenizer of a vocabulary of base64 pieces and ranks, one for each Python worker."""
    import tiktoken

    shipped = SparkFiles.get(os.path.basename(vocabulary)) if SparkFiles._is_running_on_worker else vocabulary
    with open(shipped if os.path.exists(shipped) else vocabulary, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("graphloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ship(docs: DataFrame, vocabulary: str) -> None:
    """Send the vocabulary to the executors, once a session."""
    context = docs.sparkSession.sparkContext
    if not any(f.endswith("/" + os.path.basename(vocabulary)) for f in context.listFiles):
        context.addFile(vocabulary)


def clean_source(source: Column) -> Column:
    return F.lower(F.trim(source))


def token_counts(docs: DataFrame, doc_id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of every document, counted over its whole text; null and empty texts have none."""
    kind = docs.schema[doc_id].dataType.simpleString()
    ship(docs, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["d"], "source": pdf["s"], "n_tokens": [len(encode(t)) if t else 0 for t in pdf["t"]]})

    return docs.select(F.col(doc_id).alias("d"), clean_source(F.col("source")).alias("s"), F.col(text).alias("t")).mapInPandas(run, f"doc_id {kind}, source string, n_tokens bigint")


def packed_blocks(counts: DataFrame, block: int, seed: int = 0) -> DataFrame:
    """(source, block, doc_id, start, n): which tokens of which record make up each block of a source.

    Records follow each other in the order of a hash. Offsets are running sums within hash buckets on top of the buckets'
    totals, so no task orders a whole source. Records that cross a block's end continue in the next one; the last block
    of a source may be shorter.
    """
    live = counts.where("n_tokens > 0 and source is not null")
    n = max(1, math.ceil(live.count() / BUCKET_RECORDS))
    keyed = live.select("*", F.xxhash64(F.lit(seed), "doc_id").alias("h")).withColumn("bucket", F.expr(f"pmod(h, {n})"))
    totals = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    order = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(F.col("source").alias("bs"), F.col("bucket").alias("bb"), F.coalesce(F.sum("t").over(order), F.lit(0)).alias("base"))
    within = W.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("off", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    at = placed.join(base, (F.col("source") == F.col("bs")) & (F.col("bucket") == F.col("bb"))).select("source", "doc_id", "n_tokens", (F.col("base") + F.col("off")).alias("at"))
    spans = at.select("*", F.explode(F.expr(f"sequence(at div {block}, (at + n_tokens - 1) div {block})")).alias("block"))
    low, high = F.greatest(F.col("at"), F.col("block") * block), F.least(F.col("at") + F.col("n_tokens"), (F.col("block") + 1) * block)
    return spans.select("source", "block", "doc_id", (low - F.col("at")).alias("start"), (high - low).alias("n"))


def allot(slots: int, shares: dict[str, float], capacity: dict[str, int]) -> dict[str, int]:
    """Slots for each source: its share of them, but no more than its capacity; what is cut goes to the others by share.

    If all sources are at capacity, fewer slots are filled. Rounding goes by the largest remainder, ties by name.
    """
    got: dict[str, int] = {s: 0 for s in shares}
    free = {s: w for s, w in shares.items() if w > 0 and capacity.get(s, 0) > 0}
    left = slots
    while free:
        total = sum(free.values())
        full = {s for s, w in free.items() if left * w / total >= capacity[s]}
        if not full:
            break
        for s in full:
            got[s] = capacity[s]
            left -= capacity[s]
            free.pop(s)
    if free and left > 0:
        total = sum(free.values())
        exact = {s: left * w / total for s, w in free.items()}
        for s, x in exact.items():
            got[s] = min(math.floor(x), capacity[s])
        for s in sorted(exact, key=lambda s: (got[s] - exact[s], s))[: left - sum(got[s] for s in free)]:
            got[s] += 1
    return got


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each key, applied to index: a Feistel network that walks its cycles."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.ones(len(index), dtype=bool)
    with np.errstate(over="ignore"):
        while todo.any():
            left, right = out[todo] >> half[todo], out[todo] & mask[todo]
            for r in range(4):
                x = (right + key[todo].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((x ^ (x >> np.uint64(32))) & mask[todo])
            out[todo] = (left << half[todo]) | right
            todo = out >= size.astype(np.uint64)
    return out.astype(np.int64)


def shard_counts(totals: list[int], shards: int, slots_per_shard: int, seed: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, first) of the wanted shards: slots of each source in the shard, and in all shards before it.

    The shards hold ``slots_per_shard`` slots each, the last one the rest. A range of shards is halved, and what of each
    source falls into the lower half is a multivariate hypergeometric draw: the multinomial given the totals.
    """
    counts, first = np.zeros((len(wanted), len(totals)), dtype=np.int64), np.zeros((len(wanted), len(totals)), dtype=np.int64)
    total = np.array(totals, dtype=np.int64)
    last = int(total.sum())
    # (lower end, upper end, totals of the range, totals before it, which of the wanted shards lie in it)
    ranges = [(0, shards, total, np.zeros_like(total), np.arange(len(wanted)))] if len(wanted) else []
    while ranges:
        low, high, held, before, inside = ranges.pop()
        if high - low == 1:
            counts[inside], first[inside] = held, before
            continue
        middle = (low + high) // 2
        size = min(middle * slots_per_shard, last) - low * slots_per_shard
        if held.sum() > STRETCH_SLOTS:  # whole stretches get their share exactly
            exact = [divmod(int(h) * size, int(held.sum())) for h in held]
            lower = np.array([q for q, _ in exact], dtype=np.int64)
            for i in sorted(range(len(exact)), key=lambda i: -exact[i][1])[: size - int(lower.sum())]:
                lower[i] += 1
        else:
            lower = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(held, size, method="marginals")
        for ends, part, offset, chosen in (((low, middle), lower, before, wanted[inside] < middle), ((middle, high), held - lower, before + lower, wanted[inside] >= middle)):
            if chosen.any():
                ranges.append((*ends, part, offset, inside[chosen]))
    return counts, first


def mixture(
    docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, block: int = 2048, slots_per_shard: int = 1024, seed: int = 0,
    doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY,
) -> DataFrame:
    """(shard, slot, source, repeat, block, doc_id, start, n): the token spans of each slot of the mixture.

    Each source of ``targets(source, target_share, max_repeat)`` gets its share of ``total_tokens`` (without it, of as
    many tokens as the documents of these sources have), counted in blocks; no block, and so no token of a record, is
    used more than max_repeat times. A source that is too small is used up to its cap and the others fill in by share;
    if none can, the mixture is smaller. Defined cases: sources are compared in lower case without blanks around them;
    documents without an id or a source, of a source without target or without text are left out; null shares and repeats count
    as 0; a target given twice takes the larger share; ids must be unique; further columns are ignored.
    """
    spark = docs.sparkSession
    tables = SharedTables(spark, "mixture")
    wanted = {r["s"]: (r["w"], r["m"]) for r in targets.where("source is not null").groupBy(clean_source(F.col("source")).alias("s")).agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("w"), F.max(F.coalesce("max_repeat", F.lit(0))).alias("m")).collect()}
    held = docs.where(clean_source(F.col("source")).isin(list(wanted)) & F.col(doc_id).isNotNull())
    blocks = tables.put(packed_blocks(tables.put(token_counts(held, doc_id, text, vocabulary)), block, seed))
    held_by = blocks.groupBy("source").agg(F.max("block").alias("m"), F.sum("n").alias("n")).collect()
    sizes = {r["source"]: r["m"] + 1 for r in held_by}
    if total_tokens is None:
        total_tokens = sum(r["n"] for r in held_by)
    names = sorted(wanted)
    slots = math.ceil(total_tokens / block)
    got = allot(slots, {s: wanted[s][0] for s in names}, {s: sizes.get(s, 0) * wanted[s][1] for s in names})
    totals = [got[s] for s in names]
    shards = math.ceil(sum(totals) / slots_per_shard)
    size_of = np.array([sizes.get(s, 1) for s in names], dtype=np.int64)

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            wanted = pdf["id"].to_numpy()
            for shard, counted, start in zip(wanted, *shard_counts(totals, shards, slots_per_shard, seed, wanted)):
                which = np.repeat(np.arange(len(names)), counted)
                number = np.concatenate([np.arange(c) + f for c, f in zip(counted, start)]).astype(np.int64)
                repeat, index = number // size_of[which], number % size_of[which]
                place = np.random.default_rng([seed, int(shard)]).permutation(len(which))  # sources mixed within the shard
                chosen = permuted(index, size_of[which], which * 1_000_003 + repeat + seed * 7919)
                yield pd.DataFrame({"shard": shard, "slot": place, "source": [names[w] for w in which], "repeat": repeat, "block": chosen})

    drawn = spark.range(0, shards, 1, max(1, min(shards, 4 * spark.sparkContext.defaultParallelism))).mapInPandas(fill, "shard bigint, slot bigint, source string, repeat bigint, block bigint")
    return drawn.join(blocks, ["source", "block"]).select("shard", "slot", "source", "repeat", "block", "doc_id", "start", "n")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """The shares reached: (source, target_share, tokens, share, blocks, most_repeats) for each source of the targets."""
    by_source = mixed.groupBy("source").agg(F.sum("n").alias("tokens"), F.count_distinct("shard", "slot").alias("blocks"), (F.max("repeat") + 1).alias("most_repeats"))
    total = by_source.agg(F.sum("tokens").alias("all"))
    wanted = targets.where("source is not null").groupBy(clean_source(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"))
    return (
        wanted.join(by_source, "source", "left").join(total)
        .select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("share"), F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
    )


def materialize(mixed: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The mixture's spans with their token ids: ``mixed`` plus tokens array<int>.

    A record is encoded once, whatever number of spans and repeats the mixture takes from it; its spans are cut from the
    result and joined to the slots. The list of a record's spans is no longer than the record has blocks.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    ship(docs, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary).encode_ordinary
        for pdf in batches:
            rows = []
            for i, t, spans in zip(pdf["doc_id"], pdf["__text"], pdf["spans"]):
                ids = encode(t)
                rows += [(i, x["start"], ids[x["start"] : x["start"] + x["n"]]) for x in spans]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "tokens"])

    spans = mixed.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    cut = texts.join(spans, "doc_id").mapInPandas(run, f"doc_id {kind}, start bigint, tokens array<int>")
    return mixed.join(cut, ["doc_id", "start"]).select(*mixed.columns, "tokens")
