"""Evaluation texts leaking into training text, by Wu-Manber search over words.

The patterns are all runs of ``n`` consecutive words of the evaluation items, so they have one length. A block of the
last words of the search window is looked up in the shift table: a block that ends in no pattern moves the window on by
nearly its whole length, and only a block that ends a pattern opens the bucket of the patterns that end with it, whose
words are then compared directly.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a shift-table block.
BLOCK = 3
#: Evaluation text searched for in one pass over the corpus, in characters; more text takes more passes.
PASS_CHARS = 4_000_000

_RUNS = re.compile(r"[^\W_]+")
#: Numerals that are no decimal digits, such as fractions and superscripts; they separate words like punctuation.
_NUMERALS = re.compile("[²³¹¼-¾௰-௲༪-༳፩-፼ᛮ-ᛰ៰-៹⁰-₉⅐-↋①-⒛⓪-⓿❶-➓⳽〇〡-〩〸-〺㆒-㆕㈠-㈩㉈-㉏㉑-㉟㊀-㊉㊱-㊿]")


def words(text: str) -> list[str]:
    """The longest runs of Unicode letters and digits, lower-cased."""
    if not text.isascii():
        text = _NUMERALS.sub(" ", text)
        if "İ" in text:  # its lower case holds a mark that would split the run
            return [w.lower() for w in _RUNS.findall(text)]
    return _RUNS.findall(text.lower())


class WordSearch:
    """Wu-Manber tables of the n-word runs of a set of items."""

    def __init__(self, items: Iterable[tuple[int, str]], n: int, block: int = BLOCK):
        self.n, self.block = n, min(block, n)
        self.far = n - self.block + 1
        self.shift: dict[str, int] = {}
        self.bucket: dict[str, dict[str, tuple[int, ...]]] = {}
        for item, text in items:
            w = words(text)
            blocks = [" ".join(w[i : i + self.block]) for i in range(len(w) - self.block + 1)]
            for start in range(len(w) - n + 1):
                for end in range(self.far):
                    b, move = blocks[start + end], self.far - 1 - end
                    if move < self.shift.get(b, self.far):
                        self.shift[b] = move
                held = self.bucket.setdefault(blocks[start + self.far - 1], {})
                run = " ".join(w[start : start + n])
                if item not in held.get(run, ()):
                    held[run] = (*held.get(run, ()), item)

    def find(self, text: str) -> set[int]:
        """The items that share a run of n words with the text."""
        w = words(text)
        n, block, far, shift, bucket, found = self.n, self.block, self.far, self.shift, self.bucket, set()
        at, end = n, len(w)
        while at <= end:
            tail = " ".join(w[at - block : at])
            move = shift.get(tail, far)
            if not move:
                items = bucket[tail].get(" ".join(w[at - n : at]))
                if items:
                    found.update(items)
                move = 1
            at += move
        return found


def leaks(docs: DataFrame, items: DataFrame, n: int = 13, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc_id, item_id) of every document and item that share a run of ``n`` or more consecutive words.

    The items are a stated query set: their text is read to the driver in blocks of at most PASS_CHARS characters (an
    item longer than that is a block of its own), and each block is searched for in one pass over all documents, which
    are neither shuffled nor cut. Defined cases: texts that are null or shorter than n words match nothing; a document
    or item given twice counts once; an id that is null gives rows with null; empty tables give no rows; further columns
    are ignored.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct()
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}"
    kinds = (_arrow(docs, doc_id), _arrow(items, item_id))
    out, block, size = None, [], 0

    def search(rows: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(WordSearch(rows, n))

        def run(batches):
            tables = shared.value
            for batch in batches:
                ids, hits = batch.column(0).to_pylist(), ([], [])
                for i, t in zip(ids, batch.column(1).to_pylist()):
                    if t is not None:
                        for item in tables.find(t):
                            hits[0].append(i)
                            hits[1].append(item)
                yield pa.RecordBatch.from_arrays([pa.array(hits[0], kinds[0]), pa.array(hits[1], kinds[1])], names=["doc_id", "item_id"])

        return docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(run, schema)

    for row in wanted.toLocalIterator():
        if block and size + len(row["t"]) > PASS_CHARS:
            part = search(block)
            out, block, size = part if out is None else out.unionByName(part), [], 0
        block.append((row["i"], row["t"]))
        size += len(row["t"])
    part = search(block)
    return (part if out is None else out.unionByName(part)).distinct()


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
