import os
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brackwater.llm.packing import VOCABULARY, TokenCounter, pack, plan_bins


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.lists(st.integers(1, 60), max_size=80))
def test_plan_places_every_item_once_within_capacity(capacity, sizes):
    counts = Counter(s for s in sizes if s <= capacity)
    bins, large, seen = defaultdict(int), Counter(), defaultdict(set)
    for size, lo, hi, first, per in plan_bins(counts, capacity):
        for r in range(lo, hi + 1):
            assert r not in seen[size]
            seen[size].add(r)
            b = first + (r - lo) // per
            bins[b] += size
            large[b] += 3 * size > capacity
    assert {s: len(x) for s, x in seen.items()} == dict(counts)
    assert all(x <= capacity for x in bins.values()) and all(n <= 2 for n in large.values())
    assert sorted(bins) == list(range(len(bins)))
    total = sum(s * n for s, n in counts.items())
    if total:
        assert len(bins) <= 2 * -(-total // capacity)


def test_huge_counts_cost_no_more():
    plan = plan_bins({s: 10**9 + s for s in range(1, 513)}, 512)
    assert len(plan) < 20_000


needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


@needs_vocabulary
def test_counts_equal_the_tokenizer():
    counter = TokenCounter(VOCABULARY)
    for text in ("", "It's a test.\n\n  Größe 42,5 — żółć!", "a" * 5000, "\t\r\n  x", "naïve café’s " * 50):
        assert counter(text) == len(counter.encoding.encode_ordinary(text)), text[:20]


@needs_vocabulary
def test_documents(spark):
    docs = [(i, "word " * n, 9) for i, n in enumerate((1, 5, 40, 7, 7, 7, 300))] + [(90, None, 9), (91, "", 9), (6, "word " * 300, 9)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, n_tokens int")
    limits = spark.createDataFrame([(1, 32), (2, 512), (3, None), (4, 0)], "limit_id int, capacity_tokens int")
    rows = pack(df, limits).collect()
    fill = defaultdict(int)
    for r in rows:
        fill[r.limit_id, r.bin_id] += r.n_tokens
    assert all(n <= {1: 32, 2: 512}[limit] for (limit, _), n in fill.items())
    whole = Counter()
    for r in rows:
        whole[r.limit_id, r.doc_id] += r.n_tokens
    assert {d: n for (limit, d), n in whole.items() if limit == 1} == {d: n for (limit, d), n in whole.items() if limit == 2}
    assert all(r.bin_id == 0 for r in rows if r.doc_id in (90, 91)) and len({r.doc_id for r in rows}) == 9
    assert pack(df.limit(0), limits).count() == 0 and pack(df, limits.limit(0)).count() == 0
