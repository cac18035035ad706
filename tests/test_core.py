import uuid

import pytest
from pyspark.sql import functions as F

from brackwater.functions import ids, scoring, text, urls
from brackwater.operators import linkage, searches, semantic, upsert
from brackwater.streaming.candidates import hourly_counts, read_store, upsert_batches


def _one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).collect()[0].y


@pytest.mark.parametrize("value,expression,want", [
    ("HTTPS://Hof.test:443//a/?utm_medium=m&b=%C3%A9&A=1#x", urls.canonical, "https://hof.test/a?A=1&b=%C3%A9"),
    ("http://Hof.Test/A//b/?UTM_x=1&k=&j=a%20b#x", urls.scraper, "http://Hof.Test/A//b/?k=&j=a+b"),
    ("/a/a/a", urls.collapsed_segments, "/a"),
    ("/x/y/z/x/y/z/w/w/", urls.collapsed_segments, "/x/y/z/w/"),
    ("http://10.0.0.1/x", urls.strict, None),
    ("https://müsli.test/a/../b/./c/?utm_id=1&Z=2&a=3", urls.strict, "https://xn--msli-0ra.test/b/c?a=3&Z=2"),
    ("ftp://hof.test/x", urls.strict, None),
    ("Hof & Gärten Ünïcode", text.folded, "hof and garten unicode"),
    ("&lt;b&gt;x&lt;/b&gt; &eacute;t&eacute;&nbsp;!", text.strip_markup, "x été !"),
    (" – A  title: ", text.header, "A title"),
    ("[1, 2]", text.header, ""),
    ("Great-Britain (North)", text.place, "great britain north"),
    ("<p>a &amp; b</p>\n c", text.strip_markup, "a & b c"),
    ("One. Two! Three?", text.sentence_count, 3),
    ("en_US", text.language_code, "en"),
    ("Various Products", text.specific_product, False),
    ("Oat biscuits, 200 g", text.specific_product, True),
    ("x" * 5000, text.truncated, "x" * 3999 + "…"),
])
def test_functions(spark, value, expression, want):
    assert _one(spark, value, expression) == want


def test_uuid5_equals_python(spark):
    for name in ("", "abc", "żółć", "x" * 500):
        assert _one(spark, name, lambda c: ids.uuid5(c, uuid.NAMESPACE_URL)) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_confidence_trail(spark):
    df = spark.createDataFrame([("major_news", 4, True), ("blog", 1, False), (None, 1, False)], "kind string, n int, yes boolean")
    score, reasons = scoring.confidence(F.col("kind"), F.col("n"), F.col("yes"), F.col("yes"), F.col("yes"))
    rows = df.select(score.alias("s"), reasons.alias("r")).collect()
    assert [r.s for r in rows] == [99, 20, 40] and rows[0].r[0] == "source kind major_news: base 75" and rows[0].r[-1].endswith("bounded to 99")


def test_official_and_penalties(spark):
    yes, no = F.lit(True), F.lit(False)
    score, reasons = scoring.confidence(F.lit("blog"), F.lit(1), no, no, no, yes, yes, yes)
    sure, why = scoring.confidence(F.lit("blog"), F.lit(1), no, no, no, official=yes)
    row = spark.range(1).select(score.alias("s"), reasons.alias("r"), sure.alias("t"), why.alias("w")).first()
    assert (row.s, row.t) == (5, 100) and row.r[1:] == ["trusted-domain override: +5", "stale reporting: -10", "vague reporting: -10"] and len(row.w) == 1


def test_upsert_keeps_id_and_is_idempotent(spark):
    shape = "url string, id string, v string"
    store = spark.createDataFrame([("u1", "s1", "a"), ("u2", "s2", None)], shape)
    batch = spark.createDataFrame([("u1", "n1", "b"), ("u1", "n2", "c"), ("u2", "n3", None), ("u3", "n4", "x")], shape)
    got = {tuple(r) for r in upsert.upsert(store, batch, "url", "id", ["v"]).collect()}
    assert got == {("update", "s1", "u1"), ("skip", "s2", "u2"), ("insert", "n4", "u3")}
    once = upsert.last_per_key(batch, ["url"], ["id"])
    assert sorted(map(tuple, upsert.last_per_key(once, ["url"], ["id"]).collect())) == sorted(map(tuple, once.collect()))


def test_observations_fold_in_order(spark):
    shape = "candidate_id string, n int, attempt_count int, decision string, processing_status string, content_hash string, linked_incident_id string, query_ids array<string>"
    rows = [
        ("a", 1, 0, "borderline", "discovered", None, "", ["q1"]), ("a", 2, 0, "reject", "accepted", None, "i1", ["q2", "q1"]), ("a", 2, 0, "reject", "accepted", None, "i1", ["q2", "q1"]),
        # More attempts: an update, so the weaker decision counts and the state follows.
        ("b", 1, 0, "accept", "retryable", None, None, None), ("b", 2, 1, "reject", "accepted", "h", None, ["q"]),
        # A retryable state waits for an update; a terminal one stays, and so does the stronger decision.
        ("c", 1, 0, "reject", "retryable", None, None, None), ("c", 2, 0, "accept", "discovered", None, None, None),
        ("d", 1, 0, "accept", "converted", "x", None, None), ("d", 2, 3, "reject", "discovered", "y", None, None),
    ]
    df = spark.createDataFrame(rows, shape).withColumn("last_seen_at", F.timestamp_seconds("n")).withColumn("first_seen_at", F.timestamp_seconds("n"))
    got = {r.candidate_id: (r.decision, r.processing_status, r.attempt_count, r.content_hash, r.linked_incident_id, r.query_ids) for r in upsert.merge_observations(df).collect()}
    assert got == {
        "a": ("borderline", "accepted", 0, None, "i1", ["q1", "q2"]), "b": ("reject", "accepted", 1, "h", None, ["q"]),
        "c": ("accept", "retryable", 0, None, None, None), "d": ("accept", "converted", 3, "x", None, None),
    }


def test_linkage(spark):
    keys = spark.createDataFrame([("a", "k"), ("b", "k"), ("c", "k"), ("d", "j"), ("a", "j"), ("e", None), ("f", "")], "id string, key string")
    assert {tuple(r) for r in linkage.smallest_partner(keys).collect()} == {("a", "b"), ("b", "a"), ("c", "a"), ("d", "a")}
    t = spark.createDataFrame([("x", ["oat", "brand"]), ("y", ["oat", "brand", "bar"]), ("z", ["oat"])], "a string, tokens array<string>")
    got = {tuple(r) for r in linkage.contains_tokens(t, t.withColumnRenamed("a", "b")).filter("a <> b").collect()}
    assert got == {("x", "y"), ("z", "x"), ("z", "y")}
    hosts = spark.createDataFrame([("www.gov.uk",), ("a.food.gov.uk",), ("notgov.uk",)], "host string")
    domains = spark.createDataFrame([("gov.uk",), ("food.gov.uk",)], "domain string")
    assert {tuple(r) for r in linkage.longest_suffix(hosts, domains).collect()} == {("www.gov.uk", "gov.uk"), ("a.food.gov.uk", "food.gov.uk")}


def test_catalogue_and_rotation(spark):
    c = searches.catalogue(spark)
    rows = c.orderBy("pos").collect()
    assert len(rows) == 81 and [r.country for r in rows[:3]] == ["GB", "FR", "DE"] and [r.pos for r in rows] == list(range(81))
    first = searches.rotated(c, 1, 5).orderBy("slot").first()
    assert first.text == rows[5].text


def test_nearest_in_blocks(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0, float(i % 3)]) for i in range(40)], "vec_id bigint, embedding array<float>")
    q = df.filter("vec_id % 10 = 0")
    a = {tuple(r) for r in semantic.nearest(q, df, 3).collect()}
    assert a == {tuple(r) for r in semantic.nearest(q, df, 3, block=2).collect()} and len(a) == 12
    assert all(x[0] != x[1] for x in a)
    assert semantic.nearest(q.limit(0), df, 3).count() == 0


def test_streams_equal_batch(spark, tmp_path):
    src = spark.range(0, 600).select((F.timestamp_seconds(F.col("id") * 60)).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"), (F.col("id") % 5).cast("string").alias("k"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = hourly_counts(stream).writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(90)
    want = src.groupBy(F.window("ts", "1 hour"), "event_type").count().count()
    assert spark.table("hourly").count() == want
    told = []
    q = stream.writeStream.foreachBatch(upsert_batches(str(tmp_path / "out"), ["k"], ["ts"], told.append)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert read_store(spark, str(tmp_path / "out"), "ts timestamp, event_type string, k string").count() == 5 and told == [5]


def test_store_keeps_the_last_row_over_batches_and_replays(spark, tmp_path):
    shape, path = "k string, n int", str(tmp_path / "store")
    write = upsert_batches(path, ["k"], ["n"], parts=4)
    first, second = [("a", 1), ("b", 5), ("c", 1)], [("a", 3), ("b", 2), ("d", 1), ("a", 2)]
    got = lambda: sorted(tuple(r) for r in read_store(spark, path, shape).collect())
    assert got() == []
    write(spark.createDataFrame(first, shape), 0)
    write(spark.createDataFrame(second, shape), 1)
    want = [("a", 3), ("b", 5), ("c", 1), ("d", 1)]
    assert got() == want
    write(spark.createDataFrame(second, shape), 1)
    write(spark.createDataFrame([], shape), 2)
    assert got() == want


def test_late_rows_are_left_out(spark, tmp_path):
    shape = "ts timestamp, event_type string"
    for n, rows in enumerate(([("2024-01-01 10:10:00", "a")], [("2024-01-01 15:00:00", "a")], [("2024-01-01 15:10:00", "a")], [("2024-01-01 10:20:00", "a"), ("2024-01-01 15:30:00", "a")])):
        spark.createDataFrame(rows, "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = hourly_counts(stream).writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    # The row of 10:20 arrives after the watermark has passed its hour.
    assert [(str(r["window"].start), r.n) for r in spark.table("late").collect()] == [("2024-01-01 10:00:00", 1)]
