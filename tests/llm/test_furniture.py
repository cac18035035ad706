import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from brackwater.llm.furniture import band_buckets, letters_of, near_repeated_lines, p2_cleaned, repeated_lines, without_lines, without_names


def _records(spark, rows, markup=False):
    df = spark.createDataFrame(rows, "tbl string, site string, rec_id string, text string, records int")
    return df.withColumn("letters", letters_of(F.col("text"), markup))


def _brute(rows):
    texts = {(t, s or "", r): x for t, s, r, x, _ in rows}
    total, seen = defaultdict(int), defaultdict(set)
    key = lambda x: "".join(c for c in x.lower() if c.isalpha())
    for (t, s, r), x in texts.items():
        total[t, s] += 1
        for line in (x or "").split("\n"):
            if len(key(line)) >= 10:
                seen[t, s, key(line)].add(r)
    out = set()
    for (t, s, r), x in texts.items():
        for n, line in enumerate((x or "").split("\n"), 1):
            df = len(seen.get((t, s, key(line)), ()))
            if df >= 3 and df >= 0.05 * total[t, s]:
                out.add((t, r, n))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliet".split()
    rows = []
    for site, n in (("big", 120), ("small", 4), (None, 5)):
        for i in range(n):
            lines = [" ".join(rng.choices(words, k=6)) for _ in range(3)]
            if i % 7 == 0:
                lines.insert(1, rng.choice(["Sign up for OUR newsletter, today!", "sign UP for our  newsletter today 2024", "Signupforournewslettertoday"]))
            if site != "big":
                lines.append("All rights reserved everywhere")
            rows.append(("documents", site, f"{site}{i}", "\n".join(lines), 1))
    rows += [("documents", "big", "null", None, 1), ("documents", "big", "blank", "", 1), ("documents", "big", "long", "x" * 200_000 + "\n\n", 1), rows[0]]
    for numbers in (2_000_000, 0):
        got = {(r.tbl, r.rec_id, r.line_no) for r in repeated_lines(_records(spark, rows), numbers).collect()}
        assert got == _brute(rows) and got


def test_markup_and_removal(spark):
    rows = [("us_recall", "", f"r{i}", f"<b>Never&nbsp;miss a warning</b>\nown text number {'abcdefgh'[i]} here\n", 1) for i in range(4)]
    records = _records(spark, rows, markup=True)
    found = repeated_lines(records)
    assert {(r.rec_id, r.line_no) for r in found.collect()} == {(f"r{i}", 1) for i in range(4)}
    back = without_lines(records.select("rec_id", "text"), found, "rec_id", "text")
    assert {r.text for r in back.collect()} == {f"own text number {'abcdefgh'[i]} here\n" for i in range(4)}


def test_clusters_decide_on_a_byline_with_changing_names(spark):
    names = ["Ann Obst", "Bert Quelle", "Carla Mühl", "Dora Stein", "Emil Vogt", "Franz Uhl"]
    own = ["apples were cold in march", "biscuits broke in the van again", "cheese came late that day", "the dairy closed its doors", "eggs rolled over the yard", "figs grew along the wall"]
    rows = [("documents", "s", f"r{i}", f"{own[i]}\nStory told by {n} for the evening desk of our regional paper", 1) for i, n in enumerate(names)]
    records = _records(spark, rows)
    assert repeated_lines(records).count() == 0
    found = near_repeated_lines(records.withColumn("letters", letters_of(without_names(F.col("text")))))
    got = {(r.rec_id, r.line_no, r.cluster) for r in found.collect()}
    assert {g[:2] for g in got} == {(f"r{i}", 2) for i in range(6)} and len({g[2] for g in got}) == 1
    back = without_lines(records.select("rec_id", "text"), found, "rec_id", "text")
    assert {r.text for r in back.collect()} == set(own)


def test_near_lines_share_buckets():
    base = "partagezcetarticleavecvosprochesetsuivezlejournalchaquejourpournerienmanquer"
    b = band_buckets([base, base[:-3] + "xyz", "completelydifferentlettersinthislinewithoutanyoverlap"])
    assert (b[0] == b[1]).any() and not (b[0] == b[2]).any() and b.dtype == np.uint64


def test_empty(spark):
    assert repeated_lines(_records(spark, [])).count() == 0


def test_cleaned_gives_back_all_three_tables(spark, tmp_path):
    line = "Never miss a warning again"
    own = ["own text about apples", "own text about biscuits", "own text about cheese"]
    # The same ids stand in all tables, each with its repeated line in another place; one row is delivered twice.
    tables = {
        "candidates": ([("https://a.test/x", str(i), f"{line}\n{x}") for i, x in enumerate(own)] + [("https://a.test/x", "0", f"{line}\n{own[0]}")], "canonical_url string, candidate_id string, description string"),
        "us_recall": ([(str(i), f"{x}\n<b>{line}</b>") for i, x in enumerate(own)] + [("empty", None)], "field_recall_number string, field_press_release string"),
        "documents": ([(i, "s", f"{x}\n\n{line}") for i, x in enumerate(own)], "doc_id bigint, source string, text string"),
    }
    for name, (rows, shape) in tables.items():
        spark.createDataFrame(rows, shape).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = sorted((r.tbl, r.rec_id, r.text) for r in p2_cleaned(spark, str(tmp_path)).collect() if r.rec_id != "empty")
    assert got == sorted((t, str(i), x + ("\n" if t == "documents" else "")) for t in tables for i, x in enumerate(own))
    assert p2_cleaned(spark, str(tmp_path)).filter("rec_id = 'empty' AND text IS NULL").count() == 1
