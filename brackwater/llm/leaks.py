"""Evaluation passages inside corpus documents: Wu-Manber search over words.

The patterns are all windows of 13 consecutive words of the test items.  A
block is two neighbouring words.  The shift table tells for a block at the end
of the current window how far the window may move without missing a pattern;
unknown blocks move it by twelve words, so most of a text is never compared.
Where the shift is 0, the bucket of the block (the last words of a pattern)
names the candidates and a direct comparison of all words confirms them.

The items are a small held-out set.  They go to the tasks in blocks of bounded
size; each block scans the corpus once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 13
#: Characters of item text that one block of patterns may hold.
BLOCK_CHARS = 8_000_000


def words_column(text: F.Column) -> F.Column:
    """Runs of letters and digits in lower case, parted by single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


class Patterns:
    """Shift table and suffix buckets of all windows of ``n`` words."""

    def __init__(self, items: list[tuple[int, list[str]]], n: int = WORDS) -> None:
        self.n = n
        self.default = n - 1
        self.shift: dict[tuple[str, str], int] = {}
        self.buckets: dict[tuple[str, str], dict[tuple[str, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
        for item_id, words in items:
            for start in range(len(words) - n + 1):
                window = tuple(words[start : start + n])
                self.buckets[window[-2:]][window].add(item_id)
                for j in range(n - 1):
                    block = window[j : j + 2]
                    self.shift[block] = min(self.shift.get(block, self.default), n - 2 - j)
        self.buckets = {k: dict(v) for k, v in self.buckets.items()}

    def search(self, words: list[str]) -> set[int]:
        """Items of which a window occurs in ``words``."""
        found: set[int] = set()
        shift, default, n = self.shift, self.default, self.n
        at, last = n - 1, len(words)
        while at < last:
            block = (words[at - 1], words[at])
            step = shift.get(block, default)
            if step:
                at += step
                continue
            hit = self.buckets[block].get(tuple(words[at - n + 1 : at + 1]))
            if hit:
                found |= hit
            at += 1
        return found


def _blocks(items: list[tuple[int, str]], limit: int) -> Iterator[list[tuple[int, str]]]:
    block: list[tuple[int, str]] = []
    size = 0
    for item in items:
        if block and size + len(item[1]) > limit:
            yield block
            block, size = [], 0
        block.append(item)
        size += len(item[1])
    yield block


def find_leaks(docs: DataFrame, items: DataFrame, n: int = WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, doc_id): the document holds at least ``n`` consecutive words of the item.

    Words are runs of letters and digits in lower case; everything else is
    ignored.  Items with fewer than ``n`` words, and null or empty texts, match
    nothing.  Repeated rows count once; other columns are ignored; empty tables
    give an empty result.  Several items with the same passage are all reported.
    """
    # The stated test set, read once; its size decides the number of blocks.
    held = sorted({(r.item_id, r.words) for r in items.select("item_id", words_column(F.col("text")).alias("words")).collect() if r.words})
    prepared = docs.select("doc_id", words_column(F.col("text")).alias("words"))
    shape = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64())])
    result = None
    for block in _blocks(held, block_chars):
        texts = docs.sparkSession.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], texts=texts) -> Iterator[pa.RecordBatch]:
            patterns = Patterns([(i, t.split(" ")) for i, t in texts.value], n)
            for batch in batches:
                pairs = [
                    (item, doc)
                    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    if text
                    for item in patterns.search(text.split(" "))
                ]
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in range(2)], schema=shape)

        part = prepared.mapInArrow(scan, "item_id bigint, doc_id bigint")
        result = part if result is None else result.unionByName(part)
    return result.distinct()


def p9_found(spark, sf_dir: str) -> DataFrame:
    from brackwater.runtime import table

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


P9_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM eval_items),
dg AS (SELECT doc_id, array_to_string(w[k:k+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
ig AS (SELECT item_id, array_to_string(w[k:k+12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 13))
SELECT DISTINCT item_id, doc_id FROM ig JOIN dg USING (g)
"""
