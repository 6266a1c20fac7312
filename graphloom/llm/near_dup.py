"""Near-duplicate records with small edits, by PartEnum signatures over size bands.

A record is the set of its runs of k consecutive words. Two sets of sizes a <= b with Jaccard similarity g or more differ
in at most (1 - g) / (1 + g) * (a + b) elements. The sizes are cut into bands of ratio 1 / g^2; for each band the element
domain is partitioned by hash into somewhat more parts than elements may differ, so two sufficiently similar sets agree
in a part that holds elements of both, and the elements of that part are their common signature. A set takes part in its
own band and, where a larger partner may lie in the next, in that one too. By the pigeonhole principle it needs to emit
only its first d + 1 non-empty parts in an order that is the same for all sets (parts with more uncommon words first),
d being the number of elements that may differ.

A signature that very many sets share sorts out little. Such groups don't meet as they are: their members are given
PartEnum's full signatures instead, the enumerated subsets. The domain is cut into first-level parts, so few that in one
of them similar sets differ in at most LOOSE elements; that part is cut into SECOND second-level parts, and the elements
of every choice of SECOND - LOOSE of these are a signature. What still is a large group then meets block by block, a task
for each pair of blocks.

Words that very many records hold ("return nil err") would give signatures shared by everything. Elements made of such
words alone are left out of the partitioned domain; that keeps the bound, since the sets differ in no more elements of
a smaller domain. The few sets that then have too few parts for the guarantee go through the same join once more with
every element as a part of its own. Equal sets are one class from the start, so copies never meet in a signature.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.plans.lineage import SharedTables

WORD = "[a-z0-9_]+"
#: Words in more than this share of the records (and in at least MIN_COMMON of them) are common.
COMMON_SHARE, MIN_COMMON = 0.005, 64
#: At most so many common words are kept in the plan; the share is raised until they fit.
MAX_COMMON = 2000
#: Parts of a band's domain for each element of its largest set.
PARTS = 0.6
#: Sets of one batch that share a signature from which on it counts as hot; members from which on a group is crowded and
#: gives way to enumerated signatures; members of a block of a group. Results depend on none of them.
HOT, CROWD, BLOCK = 64, 1000, 2000
#: Second-level parts of a first-level part, those that may differ, and first-level parts for each one that is needed.
SECOND, LOOSE, SPARE = 3, 1, 1.2


def words(text: Column) -> Column:
    """The longest runs of a-z, 0-9 and underscore of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def common_words(records: DataFrame, text: str) -> list[str]:
    """Words of more than COMMON_SHARE of the records, counted over all of them; the list is bounded by MAX_COMMON.

    Its length can't exceed (mean words a record) / share, whatever the collection's size.
    """
    # the empty word stands for the record itself, so that one pass counts records and words
    held = F.array_append(F.array_distinct(words(F.col(text))), F.lit(""))
    counts = records.select(F.explode(held).alias("w")).groupBy("w").count()
    rows = counts.where((F.col("count") >= MIN_COMMON) | (F.col("w") == "")).orderBy(F.desc("count"), "w").limit(MAX_COMMON + 2).collect()
    n = next((r["count"] for r in rows if not r["w"]), 0)
    least = max(MIN_COMMON, math.ceil(n * COMMON_SHARE))
    if len(rows) > MAX_COMMON + 1:  # keep whole counts only, so that the list doesn't depend on ties
        least = max(least, rows[-1]["count"] + 1)
    return [r["w"] for r in rows if r["w"] and r["count"] >= least]


def word_sets(records: DataFrame, id_col: str, text: str, k: int, common: list[str]) -> DataFrame:
    """(id, cls, other, sh): the set of hashes of all runs of k words, sorted, and two hashes of its own; the lowest two bits
    of an element hold min(3, words not common).

    Texts that are null or have fewer than k words have no runs and give no row.
    """
    w = records.select(F.col(id_col).alias("id"), words(F.col(text)).alias("w")).where(F.size("w") >= k)
    literal = ",".join(f"'{x}'" for x in common) or "''"
    flags = w.select("id", "w", F.expr(f"transform(w, x -> case when x in ({literal}) then 0L else 1L end)").alias("c"))
    at = [f"w[i + {j}]" for j in range(k)]
    rare = " + ".join(f"c[i + {j}]" for j in range(k))
    run = f"shiftleft(xxhash64({', '.join(at)}), 2) + least(3, {rare})"
    sets = flags.select("id", F.expr(f"sort_array(array_distinct(transform(sequence(0, size(w) - {k}), i -> {run})))").alias("sh"))
    return sets.select("id", F.xxhash64("sh").alias("cls"), F.xxhash64(F.lit("second"), "sh").alias("other"), "sh")


def bands(threshold: float) -> list[tuple[int, int, int]]:
    """(least size, largest size, parts) of each band, for all sizes an array can have."""
    out, low = [], 1
    while not out or out[-1][0] <= 2**31 / threshold:
        high = max(low, math.floor(low / threshold**2 + 1e-9))
        out.append((low, high, max(4, math.ceil(PARTS * high))))
        low = high + 1
    return out


def classes(sets: DataFrame) -> DataFrame:
    """(cls, n, sh): one row for each distinct set, named by its hash; ``distinct_classes`` has made the names unique."""
    return sets.groupBy("cls").agg(F.first("sh").alias("sh")).select("cls", F.size("sh").alias("n"), "sh")


def distinct_classes(sets: DataFrame, tables: SharedTables) -> DataFrame:
    """The sets with names that no two different sets share.

    Different sets of one hash are told apart by comparing the sets themselves: they are ranked within the hash, and all
    but the first get a further hash as their name. As a rule there are none, and the sets stay as they are. What two
    hashes take for one set is one: that is 128 bits.
    """
    check = sets.groupBy("cls").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi").select("cls")
    met = tables.put(check)
    if met.isEmpty():
        return sets
    own = sets.join(met.withColumn("met", F.lit(True)), "cls", "left")
    rank = F.dense_rank().over(W.partitionBy("cls").orderBy("sh"))
    told = own.where("met").withColumn("k", rank).select("id", F.when(F.col("k") == 1, F.col("cls")).otherwise(F.xxhash64("cls", "k", "sh")).alias("cls"), "other", "sh")
    return distinct_classes(tables.put(own.where("met is null").select("id", "cls", "other", "sh").unionByName(told)), tables)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, applied to each element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature_arrays(offsets: np.ndarray, values: np.ndarray, threshold: float, table: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """(signatures, record numbers, records without the guarantee) of the sets laid end to end in ``values``."""
    n = np.diff(offsets)
    rec = np.repeat(np.arange(len(n)), n)
    x = values.astype(np.int64).view(np.uint64)
    weight, x = (x & np.uint64(3)).astype(np.int64), x >> np.uint64(2)
    rare = weight > 0
    high, parts = np.array([r[1] for r in table]), np.array([r[2] for r in table], dtype=np.uint64)
    own = np.searchsorted(high, n)
    most = np.floor(n / threshold + 1e-9).astype(np.int64)  # the largest size of a partner
    ratio = (1 - threshold) / (1 + threshold)
    sigs, owners, short = [], [], np.zeros(len(n), dtype=bool)
    for step in (0, 1):
        inst = np.minimum(own + step, len(table) - 1)
        live = (n > 0) if step == 0 else (most > high[own])
        differ = np.floor(ratio * (n + np.minimum(most, high[inst])) + 1e-9).astype(np.int64)
        held = rare & live[rec]
        r, e, w = rec[held], x[held], weight[held]
        part = e % parts[inst[r]]
        order = np.lexsort((part, r))
        r, e, w, part = r[order], e[order], w[order], part[order]
        first = np.ones(len(r), dtype=bool)
        first[1:] = (r[1:] != r[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(first)
        filled = np.bincount(r[at], minlength=len(n))
        short |= live & (filled <= differ)
        if len(at):
            place = (inst[r[at]].astype(np.uint64) << np.uint64(40)) | (part[at] + np.uint64(1))
            sig, r, w = _mixed(_mixed(place) ^ np.bitwise_xor.reduceat(e, at)), r[at], np.add.reduceat(w, at)
            order = np.lexsort((sig, -w, r))  # parts with more uncommon words first: an order of signatures, the same for all sets
            sig, r = sig[order], r[order]
            kept = np.arange(len(r)) - (np.cumsum(filled) - filled)[r] <= differ[r]
            sigs.append(sig[kept])
            owners.append(r[kept])
    if short.any():  # exactly: these meet by elements
        sig, owner = _element_signatures(n, rec, x, weight, short, np.floor(ratio * (n + most) + 1e-9).astype(np.int64))
        sigs.append(sig)
        owners.append(owner)
    empty = np.zeros(0, dtype=np.uint64)
    return np.concatenate(sigs or [empty]).view(np.int64), np.concatenate(owners or [empty.astype(np.int64)]), int(short.sum())


def enumerated_arrays(offsets: np.ndarray, values: np.ndarray, threshold: float, table: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """(signatures, record numbers, records without the guarantee): PartEnum's enumerated signatures of sets laid end to end.

    With n1 first-level parts two sets that differ in d elements differ in more than LOOSE of them in at most
    d // (LOOSE + 1) parts. A set with more first-level parts than that of which at least LOOSE + 1 second-level parts hold
    elements shares a signature that isn't empty with any similar one. Sets that lack so many parts meet by elements.
    """
    n = np.diff(offsets)
    rec = np.repeat(np.arange(len(n)), n)
    x = values.astype(np.int64).view(np.uint64) >> np.uint64(2)
    high = np.array([r[1] for r in table])
    own = np.searchsorted(high, n)
    most = np.floor(n / threshold + 1e-9).astype(np.int64)
    ratio = (1 - threshold) / (1 + threshold)
    first_level = np.ceil(SPARE * (np.floor(2 * ratio * high + 1e-9) // (LOOSE + 1))).astype(np.int64) + 1
    chosen = list(itertools.combinations(range(SECOND), SECOND - LOOSE))
    sigs, owners, short = [], [], np.zeros(len(n), dtype=bool)
    for step in (0, 1):
        inst = np.minimum(own + step, len(table) - 1)
        live = (n > 0) if step == 0 else (most > high[own])
        differ = np.floor(ratio * (n + np.minimum(most, high[inst])) + 1e-9).astype(np.int64)
        held = live[rec]
        r, e = rec[held], x[held]
        h = _mixed(e)
        part = (h % first_level[inst[r]].astype(np.uint64)).astype(np.int64)
        slot = ((h >> np.uint64(40)) % np.uint64(SECOND)).astype(np.int64)
        cell, back = np.unique(np.stack([r, part]), axis=1, return_inverse=True)
        back = back.reshape(-1)
        sums = np.zeros((cell.shape[1], SECOND), dtype=np.uint64)
        np.bitwise_xor.at(sums, (back, slot), _mixed(h))
        filled = np.zeros((cell.shape[1], SECOND), dtype=bool)
        filled[back, slot] = True
        good = np.bincount(cell[0][filled.sum(axis=1) > LOOSE], minlength=len(n))
        short |= live & (good <= differ // (LOOSE + 1))
        for number, subset in enumerate(chosen):
            kept = filled[:, subset].any(axis=1)
            place = (inst[cell[0]].astype(np.uint64) << np.uint64(44)) | (cell[1].astype(np.uint64) << np.uint64(4)) | np.uint64(number)
            sig = _mixed(place ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            for k in subset:
                sig = _mixed(sig ^ sums[:, k])
            sigs.append(sig[kept])
            owners.append(cell[0][kept])
    if short.any():
        sig, owner = _element_signatures(n, rec, x, np.zeros(len(x), dtype=np.int64), short, np.floor(ratio * (n + most) + 1e-9).astype(np.int64))
        sigs.append(sig)
        owners.append(owner)
    empty = np.zeros(0, dtype=np.uint64)
    return np.concatenate(sigs or [empty]).view(np.int64), np.concatenate(owners or [empty.astype(np.int64)]), int(short.sum())


def _element_signatures(n: np.ndarray, rec: np.ndarray, x: np.ndarray, weight: np.ndarray, short: np.ndarray, differ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of single elements: a set's first d + 1, those with rare words first, an order that all sets share."""
    held = short[rec]
    r, e = rec[held], x[held]
    order = np.lexsort((e, -weight[held], r))
    r, e = r[order], e[order]
    size = np.bincount(r, minlength=len(n))
    kept = np.arange(len(r)) - (np.cumsum(size) - size)[r] <= differ[r]
    return _mixed(e[kept] + np.uint64(0x9E3779B97F4A7C15)), r[kept]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(cls, offsets, values) of each batch, a set that a batch holds several times once."""
    for batch in batches:
        first = np.unique(batch.column(0).to_numpy(), return_index=True)[1]
        kept = batch if len(first) == batch.num_rows else batch.take(pa.array(first))
        lists = kept.column(1)
        offsets = lists.offsets.to_numpy()
        yield kept.column(0), offsets - offsets[0], lists.flatten().to_numpy()


def signatures(sets: DataFrame, threshold: float, enumerated: bool = False) -> DataFrame:
    """(sig, cls, hot): the signatures of each set, hot where many sets of one batch share one.

    Of the rows of a hot signature in a batch all are marked, and two are given unmarked as well: so whoever groups the
    unmarked rows alone still finds the group, and no task has to hold all of it.
    """
    table, arrays = bands(threshold), enumerated_arrays if enumerated else signature_arrays

    def emit(batches):
        for cls, offsets, values in _batches(batches):
            sig, owner, _ = arrays(offsets, values, threshold, table)
            own, back, count = np.unique(sig, return_inverse=True, return_counts=True)
            many = count >= HOT
            hot = many[back]
            again = np.zeros(0, dtype=np.int64)
            if many.any():
                at = np.flatnonzero(hot)
                at = at[np.argsort(back[at], kind="stable")]
                place = np.arange(len(at)) - np.searchsorted(back[at], back[at])
                again = at[place < 2]
            rows = np.concatenate([np.arange(len(sig)), again])
            marks = np.concatenate([hot, np.zeros(len(again), dtype=bool)])
            yield pa.RecordBatch.from_arrays([pa.array(sig[rows]), cls.take(pa.array(owner[rows])), pa.array(marks)], names=["sig", "cls", "hot"])

    return sets.select("cls", "sh").mapInArrow(emit, "sig bigint, cls bigint, hot boolean")


def sketch_arrays(offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words of bits for each set: bit i is the parity of the elements hashed to i (of 128)."""
    at = _mixed(values.view(np.uint64) >> np.uint64(2)) & np.uint64(127)
    bit = np.uint64(1) << (at & np.uint64(63))
    halves = [np.where((at >> np.uint64(6)) == h, bit, np.uint64(0)) for h in (np.uint64(0), np.uint64(1))]
    return tuple(np.bitwise_xor.reduceat(h, offsets[:-1]).view(np.int64) if len(values) else np.zeros(0, dtype=np.int64) for h in halves)


def sketches(sets: DataFrame) -> DataFrame:
    """(cls, n, p0, p1): size and parity bits of each set. Sets that differ in d elements differ in d bits at most."""

    def emit(batches):
        for cls, offsets, values in _batches(batches):
            p0, p1 = sketch_arrays(offsets, values)
            yield pa.RecordBatch.from_arrays([cls, pa.array(np.diff(offsets).astype(np.int32)), pa.array(p0), pa.array(p1)], names=["cls", "n", "p0", "p1"])

    every = sets.select("cls", "sh").mapInArrow(emit, "cls bigint, n int, p0 bigint, p1 bigint")
    return every.groupBy("cls").agg(F.max("n").alias("n"), F.max("p0").alias("p0"), F.max("p1").alias("p1"))


def met_signatures(sets: DataFrame, threshold: float, tables: SharedTables, enumerated: bool = False) -> DataFrame:
    """Distinct (sig, cls) of the signatures that several classes share, written.

    Signatures held by one class alone are dropped while they are grouped, in one pass over them; rows of hot signatures
    are known to be shared and don't take part in the grouping.
    """
    every = signatures(sets, threshold, enumerated)
    group = W.partitionBy("sig", "hot", F.when(F.col("hot"), F.col("cls")))
    met = every.select("sig", "cls", "hot", F.min("cls").over(group).alias("lo"), F.max("cls").over(group).alias("hi")).where("hot or lo < hi").select("sig", "cls")
    return tables.put(met.distinct())


def _possible(threshold: float) -> Column:
    ratio = (1 - threshold) / (1 + threshold)
    differing = "bit_count(a_p0 ^ b_p0) + bit_count(a_p1 ^ b_p1)"
    return F.expr(f"a_cls < b_cls and a_n >= {threshold} * b_n - 1e-9 and b_n >= {threshold} * a_n - 1e-9 and {differing} <= {ratio!r} * (a_n + b_n) + 1e-9")


def _side(name: str) -> list[Column]:
    return [F.col(c).alias(f"{name}_{c}") for c in ("cls", "n", "p0", "p1")]


def _meet(shared: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, of the members of each group of ``shared(sig, cls, n, p0, p1)`` that may be similar."""
    return shared.select("sig", *_side("a")).join(shared.select("sig", *_side("b")), "sig").where(_possible(threshold)).select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b"))


def _meet_in_blocks(shared: DataFrame, threshold: float) -> DataFrame:
    """The same for groups of any size: one of more than BLOCK members is cut into blocks, and each pair of blocks meets
    under a key of its own, so the work of a group is spread over tasks."""
    blocks = shared.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    cut = shared.join(blocks, "sig").withColumn("own", F.pmod(F.xxhash64("cls"), "blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    left = cut.select("sig", F.col("own").alias("i"), every.alias("j"), *_side("a"))
    right = cut.select("sig", every.alias("i"), F.col("own").alias("j"), *_side("b"))
    return left.join(right, ["sig", "i", "j"]).where(_possible(threshold)).select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b"))


def candidate_pairs(sets: DataFrame, threshold: float, tables: SharedTables) -> DataFrame:
    """Distinct (a, b), a < b, of classes that share a signature and whose sizes and parity bits allow the similarity.

    Groups of CROWD and more classes give way to the enumerated signatures of their members.
    """
    shared, sketched = met_signatures(sets, threshold, tables), sketches(sets)
    crowds = tables.put(shared.groupBy("sig").agg(F.count("*").alias("members")).where(F.col("members") >= CROWD).select("sig"))
    if crowds.isEmpty():
        return _meet(shared.join(sketched, "cls"), threshold).distinct()
    cool = _meet(shared.join(crowds, "sig", "left_anti").join(sketched, "cls"), threshold)
    crowded = tables.put(shared.join(crowds, "sig", "left_semi").select("cls").distinct())
    thin = met_signatures(sets.join(crowded, "cls", "left_semi"), threshold, tables, enumerated=True)
    return cool.unionByName(_meet_in_blocks(thin.join(sketched, "cls"), threshold)).distinct()


def similar_classes(sets: DataFrame, threshold: float, tables: SharedTables) -> DataFrame:
    """(a, b, similarity) of the distinct sets whose Jaccard similarity is the threshold or more."""
    pairs = candidate_pairs(sets, threshold, tables)
    one = classes(sets)
    a = one.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sh").alias("sa"))
    b = one.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sh").alias("sb"))
    both = pairs.join(a, "a").join(b, "b")
    common = both.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("m"))
    return common.select("a", "b", (F.col("m") / (F.col("na") + F.col("nb") - F.col("m"))).alias("similarity")).where(F.col("similarity") >= threshold)


def near_duplicates(records: DataFrame, id_col: str, text: str, k: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, links) of records whose word-run sets are similar.

    ``members(id, cls)`` names the class of every record that has runs, equal sets being one class; ``links(a, b,
    similarity)`` are the pairs of classes at or above the threshold. Together they hold every pair of records without
    expanding copies. Defined cases: texts that are null or shorter than k words belong to no class; a record given
    twice counts once, and one given with two texts belongs to both classes; ties at the threshold are links; empty
    tables give empty results; further columns are ignored.
    """
    narrow = records.select(id_col, text)
    tables = SharedTables(records.sparkSession, "neardup")
    sets = distinct_classes(tables.put(word_sets(narrow, id_col, text, k, common_words(narrow, text))), tables)  # read several times below
    members = sets.select("id", "cls").distinct()
    return members, similar_classes(sets, threshold, tables)


def expand_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of different records of one class or of linked classes."""
    left, right = members.select(F.col("id").alias("x"), F.col("cls").alias("a")), members.select(F.col("id").alias("y"), F.col("cls").alias("b"))
    same = left.join(right, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    linked = links.select("a", "b").join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return same.unionByName(linked).distinct().select(F.col("x").alias("a"), F.col("y").alias("b"))
