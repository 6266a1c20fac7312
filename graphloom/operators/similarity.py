"""Similar functions by MinHash: structural tokens, signatures, and pairs found by rare values instead of all against all.

Two signatures of SLOTS values that agree in a share of g or more differ in at most d = SLOTS - ceil(g * SLOTS) slots. In
one order of all values of all slots, the first d + 1 values of either hold one in common, so signatures that meet by these
miss no pair, and with rare values first few meet. Those that meet are compared by bits where they meet, which misses no
pair either, and only what passes is held against the signatures. Equal signatures are one class, and only classes meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.lineage import SharedTables

SLOTS = 128
# The prime and the multipliers and offsets of the permutations h -> (a * h + b) mod P.
P = 2_147_483_647
MULTIPLIERS = [(1_103_515_245 * (i + 1) + 12_345) % (P - 1) + 1 for i in range(SLOTS)]
OFFSETS = [(1_664_525 * (i + 1) + 1_013_904_223) % P for i in range(SLOTS)]
#: Buckets in which values are counted, buckets added up at once, and values that a task compares at once.
COUNTED, SLICE, TASK_VALUES = 1 << 20, 1 << 12, 1_000_000
#: Members from which on those of a value are compared as a block of at most CELLS pairs; similar classes that go by broadcast.
BLOCK, CELLS, BROADCAST = 32, 1 << 21, 1_000_000
#: Lines from which on a function is compared, and the similarity of a pair.
LEAST_LINES, SIMILAR = 8, 0.7
# Comments and strings, and what separates tokens.
MASKED = r"//[^\n]*|#[^\n]*|/\*[\s\S]*?\*/|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\""
SEPARATORS = r"[\s(){}\[\];,.:<>=+\-*/&|!?@^~%]+"


def structural_tokens(source: Column) -> Column:
    """The tokens of a source text without its comments and strings."""
    return F.filter(F.split(F.regexp_replace(source, MASKED, " "), SEPARATORS), lambda t: t != "")


def token_hash(token: Column) -> Column:
    """A 31-bit hash that other systems compute as well: the first 28 bits of the MD5."""
    return F.conv(F.substring(F.md5(token), 1, 7), 16, 10).cast("bigint")


def token_hashes(tokens: Column) -> Column:
    """The hashes of the different tokens."""
    return F.transform(F.array_distinct(tokens), token_hash)


def signatures(rows: DataFrame, id_col: str, hashes: str) -> DataFrame:
    """(id, sig): the MinHash signature of an array of hashes, for each permutation the least value.

    Rows whose array is null or empty have none. Each permutation is applied to a whole Arrow batch at once.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
            out = np.empty((batch.num_rows, SLOTS), dtype=np.int64)
            for i, (a, b) in enumerate(zip(MULTIPLIERS, OFFSETS)):
                out[:, i] = np.minimum.reduceat((values * a + b) % P, offsets[:-1])
            sig = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * SLOTS), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), sig], names=["id", "sig"])

    return rows.where(F.size(hashes) > 0).select(id_col, hashes).mapInArrow(run, f"id {kind}, sig array<bigint>")


def agreement(a: Column, b: Column) -> Column:
    """The share of slots in which two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.size(a)


def _mixed(batch: pa.RecordBatch, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each slot with its value, and which values aren't null."""
    flat = batch.column("s").flatten()
    known = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, slots)
    h = flat.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, slots) * np.uint64(0x9E3779B97F4A7C15)
    h += np.arange(1, slots + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    for shift, odd in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB), (32, 1)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(odd)
    return h, known


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNTED.bit_length() + 1)).astype(np.int64)


def _frequencies(sets: DataFrame, slots: int) -> np.ndarray:
    """How many values of all signatures are in each bucket: as many at least as there are equal ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTED, dtype=np.int64)
        for batch in batches:
            h, known = _mixed(batch, slots)
            total += np.bincount(_bucket(h[known]), minlength=COUNTED)
        if total.any():
            offsets = pa.array(np.arange(0, COUNTED + 1, SLICE, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(COUNTED // SLICE, dtype=np.int32)), pa.ListArray.from_arrays(offsets, pa.array(total))], names=["slice", "n"])

    def add(parts: pa.Table) -> pa.Table:
        n = parts.column("n").combine_chunks().flatten().to_numpy().reshape(-1, SLICE).sum(axis=0)
        return pa.table({"slice": parts.column("slice")[:1], "n": pa.ListArray.from_arrays(pa.array([0, SLICE], pa.int32()), pa.array(n))})

    added = sets.select("s").mapInArrow(count, "slice int, n array<bigint>").groupBy("slice").applyInArrow(add, "slice int, n array<bigint>").toArrow()
    out = np.zeros(COUNTED, dtype=np.int64)
    if added.num_rows:
        out.reshape(-1, SLICE)[added.column("slice").to_numpy()] = added.column("n").combine_chunks().flatten().to_numpy().reshape(-1, SLICE)
    return out


def _bits(h: np.ndarray) -> np.ndarray:
    """Words of one bit for each slot, and a last word of a second bit for the first 64: equal values have equal bits."""
    out = np.zeros((len(h), -(-h.shape[1] // 64) + 1, 64), dtype=np.uint8)
    out[:, :-1].reshape(len(h), -1)[:, : h.shape[1]] = h & np.uint64(1)
    out[:, -1, : h.shape[1]] = (h[:, :64] >> np.uint64(1)) & np.uint64(1)
    return np.packbits(out, axis=2).view(np.uint64)[:, :, 0]


def _keyed(sets: DataFrame, slots: int, least: int) -> DataFrame:
    """(part, cls, bits, key, at): the signatures that have keys in a part, their bits, and keys with the places of their signatures.

    A signature's keys are its first slots - least + 1 values, rare ones first, without those that no other has. Null values
    equal none, so they are the first and no keys. Where not even one slot need agree, all have the same key.
    """
    counts = _frequencies(sets, slots)
    prefix, width = min(slots - least + 1, slots), (slots - 1).bit_length()
    parts = max(1, round(int(counts.sum()) / slots * prefix / TASK_VALUES))
    shared = sets.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 27) - 1).astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, known = _mixed(batch, slots)
            # number of equal ones, hash, slot: one order over all values, and no two of a signature are equal
            order = shared.value[_bucket(h)].astype(np.uint64) << np.uint64(36) | (h & np.uint64((1 << (36 - width)) - 1)) << np.uint64(width)
            order = np.where(known, order, np.uint64(0)) | np.arange(slots, dtype=np.uint64)
            first = np.partition(order, prefix - 1, axis=1)[:, :prefix]
            row, column = np.nonzero(first >> np.uint64(36) > 1)
            key = first[row, column]
            if least <= 0:
                row, key = np.arange(len(h)), np.zeros(len(h), dtype=np.uint64)
            key = (key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(32)
            part = (key >> np.uint64(32)) % np.uint64(parts)
            by = np.argsort(part, kind="stable")
            cls, bits, key, row = batch.column("cls").to_numpy(), _bits(h).view(np.int64), key.astype(np.uint32).view(np.int32), row[by]
            key, (names, starts) = key[by], np.unique(part[by], return_index=True)
            for name, lo, hi in zip(names, starts, [*starts[1:], len(key)]):
                own, at = np.unique(row[lo:hi], return_inverse=True)
                lists = [cls[own], bits[own].reshape(-1), key[lo:hi], at.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in lists)], names=["part", "cls", "bits", "key", "at"])

    return sets.select("cls", "s").mapInArrow(run, "part int, cls array<bigint>, bits array<bigint>, key array<int>, at array<int>")


def _near(bits: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Which of the pairs (i, j) differ in the bits of at most so many slots."""
    x = bits[:, i] ^ bits[:, j]
    x[0] |= x[-1]
    return np.bitwise_count(x[:-1]).sum(axis=0, dtype=np.int32) <= most


def _met(key: np.ndarray, bits: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places, key being sorted, that have the same key and differ in the bits of at most so many slots."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    after = np.repeat(starts + sizes, sizes) - np.arange(len(key)) - 1
    i = np.flatnonzero(np.repeat(sizes < BLOCK, sizes))
    for step in range(1, BLOCK):
        i = i[after[i] >= step]
        found = i[_near(bits, i, i + step, most)]
        yield found, found + step
    for start, size in zip(starts[sizes >= BLOCK], sizes[sizes >= BLOCK]):
        end, rows = start + size, max(1, CELLS // size)
        for lo in range(start, end, rows):
            differ = sum(np.bitwise_count(w[lo : min(lo + rows, end), None] ^ w[None, lo:end]).astype(np.uint16) for w in bits[:-1])
            i, j = np.nonzero(differ <= most)
            i, j = i[i < j] + lo, j[i < j] + lo
            same = _near(bits, i, j, most)
            yield i[same], j[same]


def _candidates(sets: DataFrame, slots: int, least: int) -> DataFrame:
    """(a, b) with a < b: pairs of classes that have a key in common and whose bits don't rule out that they are similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(batches)
        sizes = [np.diff(got.column(c).combine_chunks().offsets.to_numpy()) for c in ("cls", "key")]
        cls, bits, key, at = (got.column(c).combine_chunks().flatten().to_numpy() for c in ("cls", "bits", "key", "at"))
        at = at + np.repeat(np.cumsum(sizes[0]) - sizes[0], sizes[1])
        by = np.lexsort((cls[at], key))
        key, at = key[by], at[by]
        own = np.r_[True, (key[1:] != key[:-1]) | (cls[at[1:]] != cls[at[:-1]])]  # equal signatures have the same keys
        key, at = key[own], at[own]
        bits = np.ascontiguousarray(bits.view(np.uint64).reshape(len(cls), -1)[at].T)
        held, n = [], 0

        def pairs() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*held))
            both = np.sort(np.stack([cls[at[a]], cls[at[b]]], axis=1), axis=1)
            both = both[np.lexsort((both[:, 1], both[:, 0]))]
            both = both[np.r_[True, (both[1:] != both[:-1]).any(axis=1)]]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, i])) for i in (0, 1)], names=["a", "b"])

        for i, j in _met(key, bits, slots - least):
            if len(i):
                held.append((i, j))
                n += len(i)
            if n > TASK_VALUES:
                yield pairs()
                held, n = [], 0
        if held:
            yield pairs()

    return _keyed(sets, slots, least).groupBy("part").applyInArrow(compare, "a bigint, b bigint").distinct()


def similar_signatures(rows: DataFrame, id_col: str, column: str, threshold: float = SIMILAR, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(members, links): (id, cls) of each signature, equal ones being one class, and (a, b, similarity) of similar classes.

    The rows are read several times: put them into a table if they take long to make.

    Defined cases: null signatures and those of another length belong to no class; an id with several signatures belongs
    to several classes; empty tables give empty results.
    """
    sets = rows.where(F.size(column) == slots).select(F.col(id_col).alias("id"), F.xxhash64(column).alias("cls"), F.col(column).cast("array<bigint>").alias("s"))
    members = sets.select("id", "cls").distinct()
    met, n = SharedTables(rows.sparkSession, "minhash").counted(_candidates(sets, slots, math.ceil(threshold * slots - 1e-9)))
    wanted = met.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    one = sets.join(F.broadcast(wanted) if n <= BROADCAST else wanted, "cls", "left_semi").groupBy("cls").agg(F.first("s").alias("s"))
    both = met.join(one.select(F.col("cls").alias("a"), F.col("s").alias("sa")), "a").join(one.select(F.col("cls").alias("b"), F.col("s").alias("sb")), "b")
    links = both.select("a", "b", agreement(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= threshold)
    return members, links


def class_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, copies, links): of each member how many share its class, and how many classes its class is similar to."""
    size = members.groupBy("cls").agg(F.count_distinct("id").alias("copies"))
    both = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("links"))
    return members.join(size, "cls").join(both, "cls", "left").select("id", "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
