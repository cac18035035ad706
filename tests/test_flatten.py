import json

from brackwater.operators import flatten


def _rows(spark, payloads):
    df = spark.createDataFrame([(f"r{i}", p, 1) for i, p in enumerate(payloads)], "notation string, payload string, child int")
    return {tuple(r) for r in flatten.flat_keys(flatten.uk_rows(df)).collect()}


def test_shapes_and_places(spark):
    item = {
        "problem": [{"riskStatement": "a", "allergen": [{"label": "x"}, None, {}, {"label": "y"}]}, {}, None],
        "relatedMedia": json.dumps([{"title": "t"}]),
        "productDetails": {"productName": "p", "batchDescription": {"batchCode": "b"}},
    }
    assert _rows(spark, [json.dumps(item)]) == {
        ("r0", "problem", -1, 0), ("r0", "allergen", 0, 0), ("r0", "allergen", 0, 3),
        ("r0", "related_media", -1, 0), ("r0", "product", -1, 0), ("r0", "batch", 0, 0),
    }


def test_broken_empty_and_null_payloads(spark):
    assert _rows(spark, ["{broken", "", None, "[]", "3", '{"problem":null}', '{"problem":"text"}', "[" * 50_000]) == set()


def test_aliases_keep_their_evidence(spark):
    rows = [("i", [("u", [None, "a", "b"]), (None, [])]), ("i", [("u", [None, "a", "b"]), (None, [])]), ("j", None)]
    df = spark.createDataFrame(rows, "incident_id string, evidence array<struct<url string, redirected_url_aliases array<string>>>")
    tagged = flatten.incident_rows(df)
    assert {tuple(r) for r in flatten.flat_keys(tagged).collect()} == {
        ("i", "evidence", -1, 0), ("i", "evidence", -1, 1), ("i", "alias", 0, 1), ("i", "alias", 0, 2),
    }
    assert flatten.typed_table(tagged, "alias").select("parent_key", "value").collect()[0].parent_key == "i/evidence/0"


def test_written_by_tag(spark, tmp_path):
    df = spark.createDataFrame([("r", json.dumps({"problem": {"riskStatement": "a"}}))], "notation string, payload string")
    flatten.write_tables(flatten.uk_rows(df), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).filter("child = 'problem'").count() == 1
