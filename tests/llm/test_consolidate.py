import random

from pyspark.sql import functions as F

from brackwater.llm.consolidate import connected_groups, grid_parts, linked_record_groups


def _brute(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return {x: root(x) for x in parent}


def _check(spark, pairs, cell):
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {r.v: r.group_id for r in connected_groups(df, cell).collect()}
    assert got == _brute(pairs)


def test_long_chain_over_many_cells(spark):
    names = [f"n{i:05d}" for i in range(600)]
    random.Random(1).shuffle(names)
    _check(spark, list(zip(names, names[1:])), 40)


def test_random_graph_hub_nulls_repeats(spark):
    rng = random.Random(2)
    pairs = [(f"x{rng.randrange(150)}", f"x{rng.randrange(150)}") for _ in range(90)]
    pairs += [("hub", f"leaf{i}") for i in range(120)] + [("a", None), (None, "b"), ("s", "s"), ("x1", "x2"), ("x2", "x1")]
    _check(spark, pairs, 30)


def test_empty(spark):
    assert connected_groups(spark.createDataFrame([], "a string, b string, v string, group_id string")).count() == 0


def test_records_untidy_and_unknown_ids(spark):
    incidents = spark.createDataFrame([("i1", ["A1 ", None, "zz"]), ("i2", None), ("i3", ["i3"])], "incident_id string, linked_official_alert_ids array<string>")
    alerts = spark.createDataFrame([("a1", 1), ("a2", 1)], "alert_id string, v int")
    matches = spark.createDataFrame([(" I2", "I1\n", None), ("i3", "a2", True), ("i3", "nope", False)], "incident_id string, matched_id string, requires_review boolean")
    got = {tuple(r) for r in linked_record_groups(matches, incidents, alerts).collect()}
    assert got == {("i1", "a1"), ("i2", "a1"), ("a1", "a1")}


def test_parts_stay_under_their_bound_with_a_hub(spark):
    links = spark.createDataFrame([(f"v{i}", "hub") for i in range(3000)] + [(f"w{i}", f"w{i // 2}") for i in range(1, 500)], "v string, p string")
    sizes = [r["count"] for r in grid_parts(links, 100).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3499 and max(sizes) <= 200 and len(sizes) > 35
    small = grid_parts(links.limit(50), 400_000)
    assert small.rdd.getNumPartitions() > 1


def test_hub_with_hot_parent(spark):
    pairs = [("a0", f"leaf{i:04d}") for i in range(400)] + [(f"leaf{i:04d}", f"tail{i:04d}") for i in range(0, 400, 3)] + [("A", "a0")]
    _check(spark, pairs, 25)
