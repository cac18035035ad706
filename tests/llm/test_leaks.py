import random
import re

from brackwater.llm.leaks import Patterns, find_leaks


def _brute(docs, items, n=13):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    return {(i, d) for i, t in items for d, x in docs if grams(words(t)) & grams(words(x))}


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["the", "of", "Lot", "É", "x1", "42", "rappel", "a"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(5, 40)))) for i in range(30)] + [(99, None), (98, ""), (5, "the of Lot")]
    docs = []
    for d in range(120):
        w = rng.choices(vocabulary, k=60)
        source = items[rng.randrange(30)][1].split()
        at = rng.randrange(0, max(1, len(source) - 5))
        w[20:20] = source[at : at + rng.randrange(8, 20)]
        docs.append((d, rng.choice([" ", "\n", " - ", "_"]).join(w).upper()))
    docs += [(500, None), (501, ""), docs[3], (502, "zz " * 30_000 + items[0][1])]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame([(*x, "q") for x in items], "item_id bigint, text string, doc_id string")
    want = _brute(docs, items)
    assert {tuple(r) for r in find_leaks(d, i).collect()} == want and want
    assert {tuple(r) for r in find_leaks(d, i, block_chars=300).collect()} == want
    assert find_leaks(d.limit(0), i).count() == 0 and find_leaks(d, i.limit(0)).count() == 0


def test_most_of_a_text_is_skipped():
    p = Patterns([(1, [f"w{k}" for k in range(20)])])
    looked = 0

    class Counting(list):
        def __getitem__(self, k):
            nonlocal looked
            looked += 1
            return super().__getitem__(k)

    assert p.search(Counting(f"z{k}" for k in range(12_000))) == set() and looked < 2_100
