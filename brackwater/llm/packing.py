"""Filling containers of fixed capacity with texts measured in tokens.

Sizes are whole numbers up to the capacity, so all items together are a
histogram with at most ``capacity`` entries, however many there are.  The exact
packing is worked out on that histogram: items above one third of the capacity
are matched greedily, at most two to a container (the largest with the largest
partner that still fits); the smaller ones, in falling size, go into the
smallest gap that holds them.  One step handles a whole run of equal items and
equal gaps, so the work depends on the capacity and not on the corpus.  The plan
is a table of ranges; every item finds its container by its rank among the items
of its size.  Ranks are counted in hashed blocks, so a common size is no hot
spot.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brackwater.runtime import durable, table

#: Default vocabulary: byte-level BPE ranks of a public multilingual tokenizer.
VOCABULARY = os.environ.get("BRACKWATER_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: how the byte-level tokenizers split text before merging.
PRETOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows that one block of a size class should hold while ranks are counted.
RANK_BLOCK_ROWS = 250_000


class TokenCounter:
    """Counts byte-level BPE tokens; a piece's count is kept for reuse up to a bound."""

    def __init__(self, path: str) -> None:
        import regex
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("own", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})
        self.find = regex.compile(PRETOKENS).findall
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> int:
        known, total = self.known, 0
        for piece in self.find(text):
            n = known.get(piece)
            if n is None:
                n = len(self.encoding.encode_ordinary(piece)) if len(piece) > 1 or not piece.isascii() else 1
                if len(known) > 1_000_000:
                    known.clear()
                if len(piece) <= 40:
                    known[piece] = n
            total += n
        return total


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every document once; null text has 0 tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or TokenCounter(vocabulary)
            sizes = [counter(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(count, "doc_id bigint, n_tokens bigint").groupBy("doc_id").agg(
        F.max("n_tokens").alias("n_tokens")
    )


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Ranges (size, first_rank, last_rank, first_bin, per_bin) of the packing of a histogram of sizes.

    The item of rank r (from 0) in a range lies in bin
    ``first_bin + (r - first_rank) // per_bin``.  Sizes are from 1 to capacity.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    used: dict[int, int] = defaultdict(int)
    plan: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first bin, number)
    order: list[int] = []
    bins = 0

    def place(size: int, first_bin: int, n: int, per_bin: int = 1) -> None:
        plan.append((size, used[size], used[size] + n - 1, first_bin, per_bin))
        used[size] += n
        left[size] -= n

    def opened(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if not gaps[gap]:
                bisect.insort(order, gap)
            gaps[gap].append((first, n))

    large = sorted(s for s in left if 3 * s > capacity)
    for size in reversed(large):
        while left[size]:
            at = bisect.bisect_right(large, min(capacity - size, size)) - 1
            while at >= 0 and left[large[at]] == (1 if large[at] == size and left[size] == 1 else 0):
                at -= 1
            partner = large[at] if at >= 0 else None
            if partner is None:
                n = left[size]
                place(size, bins, n)
                opened(capacity - size, bins, n)
            elif partner == size:
                n = left[size] // 2
                place(size, bins, 2 * n, 2)
                opened(capacity - 2 * size, bins, n)
            else:
                n = min(left[size], left[partner])
                place(size, bins, n)
                place(partner, bins, n)
                opened(capacity - size - partner, bins, n)
            bins += n
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect.bisect_left(order, size)
            if at < len(order):
                gap = order[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    order.pop(at)
                take = min(n, left[size])
                place(size, first, take)
                if take < n:
                    opened(gap, first + take, n - take)
                opened(gap - size, first, take)
            else:
                per = capacity // size
                full, rest = divmod(left[size], per)
                if full:
                    place(size, bins, full * per, per)
                    opened(capacity - per * size, bins, full)
                    bins += full
                if rest:
                    place(size, bins, rest, rest)
                    opened(capacity - rest * size, bins, 1)
                    bins += 1
    return plan


#: Ranges of a plan that are broadcast; a longer plan is joined by limit and size.
BROADCAST_RANGES = 1_000_000


def _placed(ranked: DataFrame, plan: DataFrame, length: int) -> DataFrame:
    """Each ranked piece with its range ``x`` of the plan: one joined row for each piece.

    The ranges of a size are one sorted array, in which a piece takes the last
    range that begins at or before its rank.
    """
    sizes = plan.groupBy("limit_id", "size").agg(F.array_sort(F.collect_list(F.struct("lo", "bin", "per"))).alias("ranges"))
    met = ranked.join(F.broadcast(sizes) if length <= BROADCAST_RANGES else sizes, ["limit_id", "size"])
    begun = F.filter("ranges", lambda r: r["lo"] <= F.col("rank"))
    return met.select("limit_id", "doc_id", "piece_no", "size", "rank", F.element_at(begun, -1).alias("x"))


def pack(docs: DataFrame, limits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(limit_id, doc_id, piece_no, n_tokens, bin_id): every document in containers of every capacity.

    A document is cut only when it alone exceeds the capacity: into full pieces
    and a rest (pieces are numbered from 1).  Documents without tokens get bin 0
    and take no room.  Bins are numbered from 1 within a limit.  A repeated
    doc_id is packed once; null capacities and capacities below 1 are ignored;
    empty tables give an empty result.
    """
    spark = docs.sparkSession
    sizes = durable(token_counts(docs, vocabulary))
    # The stated container sizes: one row for each limit.
    held = sorted({(r[0], r[1]) for r in limits.select("limit_id", "capacity_tokens").collect() if r[0] is not None and r[1] and r[1] > 0})
    shape = "limit_id int, doc_id bigint, piece_no bigint, n_tokens bigint, bin_id bigint"
    if not held:
        return spark.createDataFrame([], shape)
    choices = F.explode(F.array(*(F.struct(F.lit(i).alias("limit_id"), F.lit(c).alias("capacity")) for i, c in held)))
    pieces = (
        sizes.select("doc_id", "n_tokens", choices.alias("c"))
        .select("doc_id", "n_tokens", "c.*")
        .select("limit_id", "capacity", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int")))).alias("piece_no"))
        .select("limit_id", "doc_id", "piece_no", F.least(F.col("capacity").cast("bigint"), F.col("n_tokens") - (F.col("piece_no") - 1) * F.col("capacity")).alias("size"))
    )
    blocks = max(1, sizes.count() // RANK_BLOCK_ROWS)
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    # At most (number of limits) x capacity x blocks rows; the histogram summed over blocks is bounded by the capacities.
    classes = durable(pieces.filter("size > 0").groupBy("limit_id", "size", "block").agg(F.count("*").alias("n")))
    counts: dict[int, dict[int, int]] = defaultdict(dict)
    for r in classes.groupBy("limit_id", "size").agg(F.sum("n").alias("n")).collect():
        counts[r.limit_id][r["size"]] = r.n
    ranges = [(i, *row) for i, c in held for row in plan_bins(counts.get(i, {}), c)]
    plan = spark.createDataFrame(ranges, "limit_id int, size bigint, lo bigint, hi bigint, bin bigint, per bigint")
    before = Window.partitionBy("limit_id", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = classes.select("limit_id", "size", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("limit_id", "size", "block").orderBy("doc_id", "piece_no")
    ranked = (
        pieces.filter("size > 0").withColumn("at", F.row_number().over(inside) - 1)
        .join(offsets, ["limit_id", "size", "block"])
        .select("limit_id", "size", "doc_id", "piece_no", (F.col("at") + F.col("offset")).alias("rank"))
    )
    placed = _placed(ranked, plan, len(ranges))
    found = placed.select(
        "limit_id", "doc_id", F.col("piece_no").cast("bigint").alias("piece_no"), F.col("size").alias("n_tokens"),
        (F.col("x.bin") + F.floor((F.col("rank") - F.col("x.lo")) / F.col("x.per")) + 1).cast("bigint").alias("bin_id"),
    )
    empty = pieces.filter("size <= 0").select("limit_id", "doc_id", F.col("piece_no").cast("bigint"), F.lit(0).cast("bigint").alias("n_tokens"), F.lit(0).cast("bigint").alias("bin_id"))
    return found.unionByName(empty)


def p8_packed(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"))


def p8_fill(spark, sf_dir: str) -> DataFrame:
    limits = table(spark, sf_dir, "pack_limits")
    packed = pack(table(spark, sf_dir, "documents"), limits)
    return (
        packed.filter("bin_id > 0").groupBy("limit_id").agg(F.sum("n_tokens").alias("tokens"), F.max("bin_id").alias("bins"))
        .join(F.broadcast(limits), "limit_id")
        .select("limit_id", "tokens", "bins", (F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))).alias("fill"))
    )
