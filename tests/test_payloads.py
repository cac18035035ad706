import json

from brackwater.operators import payloads


def test_leaves_and_shapes():
    value = {"a": [{"b": "x"}, " ", 3, {"c": {"d": "y"}}], "e": None}
    assert list(payloads.leaves_of(value)) == [("a[0].b", "x"), ("a[3].c.d", "y")]
    assert payloads.shape_of(value) == payloads.shape_of({"e": 7, "a": [{"b": "z"}, 1, 2, {"c": {"d": 0}}]}) != payloads.shape_of({"a": []})


def test_tolerant_object():
    assert payloads.tolerant_object('Sure {not json} here: {"a": {"b": "}"}} bye') == {"a": {"b": "}"}}
    assert payloads.tolerant_object("[1]") is None and payloads.tolerant_object(None) is None and payloads.tolerant_object("{" * 500) is None


def test_best_leaves(spark):
    items = [
        ("r1", json.dumps({"description": "long words", "product_name": "Oat bar", "link": "https://a.test/1", "source_url": "https://a.test/2"})),
        ("r2", json.dumps({"headings": ["First", "Second"], "visible_text": "body"})), ("r3", "{broken"), ("r4", None), ("r5", "{}"), ("r2", json.dumps({"headings": ["First", "Second"], "visible_text": "body"})),
    ]
    leaves = payloads.text_leaves(spark.createDataFrame(items, "id string, body string, value string".replace(", value string", "")), "id", "body")
    assert {(r.rec_id, r.value) for r in payloads.best_address(leaves).collect()} == {("r1", "https://a.test/2")}
    assert {(r.rec_id, r.value, r.score) for r in payloads.best_name(leaves).collect()} == {("r1", "Oat bar", 190), ("r2", "First", 300)}
