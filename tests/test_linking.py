import pytest

from brackwater.functions import urls
from brackwater.plans.linking import QUERIES

EVIDENCE = "array<struct<url string, title string, content_hash string, redirected_url_aliases array<string>>>"
INCIDENT = f"incident_id string, primary_source_url string, evidence {EVIDENCE}"


def _written(spark, tmp_path, **tables):
    for name, (rows, shape) in tables.items():
        spark.createDataFrame(rows, shape).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("value,want", [
    ("HTTPS://Example.test:443/a//b/?utm_source=x&b=2&a=1#top", "https://example.test/a/b?a=1&b=2"),
    ("https://example.test", "https://example.test/"),
    ("http://user@example.test:8080/x?q=a%20b&empty", "http://example.test:8080/x?empty=&q=a+b"),
    (" no address ", "no address"),
    ("https://example.test:port/", "https://example.test:port/"),
    (None, ""),
])
def test_canonical_address(value, want):
    assert urls.canonical_text(value) == want


def test_classes_use_all_addresses_titles_and_hashes(spark, tmp_path):
    rows = [
        ("a", "https://s.test/one", [("https://s.test/x", "Miller & Café", " AB ", None)]),
        ("b", None, [("https://other.test/", "MILLER and cafe", "ab", ["https://S.test:443/one/?ref=f", None])]),
        ("c", "https://s.test/two", [("https://s.test//one#top", "", "", [])]),
        ("c", "https://s.test/two", [("https://s.test//one#top", "", "", [])]),
        ("d", "not an address", None),
        ("e", "neither", [(None, None, None, None)]),
    ]
    d = _written(spark, tmp_path, incidents=(rows, INCIDENT))
    got = lambda name: {(r.id, r.class_id, r.links) for r in QUERIES[name](spark, d).collect()}
    assert got("jn02_url_classes") == {("a", "a", 2), ("b", "a", 2), ("c", "a", 2)}
    assert got("jn03_hash_classes") == got("jn04_title_classes") == {("a", "a", 1), ("b", "a", 1)}


def test_entity_links_follow_all_legs(spark, tmp_path):
    rows = [
        # product and hazard; the company differs
        ("a1", "Oat Bar", "One Ltd", "foreign body", "2024-01-05"), ("a2", "Oat bar mini", "Two Ltd", "foreign body", "12.01.2024"), ("a3", "Oat Bar", None, "foreign body", "2024-01-13T23:30:00-05:00"),
        # company and hazard; a single company word alone is not enough
        ("b1", "Milk", "Big & Farm", "Microbial", "2024-03-01"), ("b2", "Cream", "Big and Farm Ltd", "microbial", "2024-03-08"), ("b3", "Cheese", "Big", "microbial", "2024-03-01"),
        # a single company word beside a matching product; missing dates
        ("c1", "Rye loaf", "Miller", "", None), ("c2", "Rye loaf", "Miller & Partners", "spoilage", "2020-01-01"), ("c3", "Rye loaf", None, "spoilage", None),
        # hazard alone, blank names
        ("d1", "", None, "spoilage", "2020-01-01"), ("d2", "?", "", "spoilage", "2020-01-01"),
    ]
    d = _written(spark, tmp_path, incidents=(rows, "incident_id string, product_name string, company_name string, hazard_type string, publication_date string"))
    got = {tuple(r) for r in QUERIES["jn05_entity_links"](spark, d).collect()}
    assert got == {
        ("a1", "a2", "product,hazard", 1), ("a2", "a1", "product,hazard", 2), ("a3", "a2", "product,hazard", 1),
        ("b1", "b2", "company,hazard", 1), ("b2", "b1", "company,hazard", 1),
        ("c1", "c2", "product,company", 1), ("c2", "c1", "product,company", 1),
    }


def test_official_link_takes_address_first_then_name_date_and_hazard(spark, tmp_path):
    shape = f"incident_id string, product_name string, hazard_type string, publication_date string, primary_source_url string, evidence {EVIDENCE}, company_name string"
    rows = [
        ("u", "Oat bar", "allergen", "2024-01-05", "https://s.test/z/?ref=x", None, None), ("n", "OAT  Bar", None, "2024-01-12", "https://s.test/q", None, None),
        ("far", "Oat bar", "allergen", "2024-01-13", "https://s.test/w", None, None), ("other", "Oat bar", "spoilage", "2024-01-05", "https://s.test/v", None, None), ("none", "Oat bar", "allergen", None, "https://s.test/t", None, None),
    ]
    alerts = [("1", "https://s.test/1", "Oat bar", "allergen", "2024-01-05"), ("2", "https://S.test:443/z", "Rye", "spoilage", None)]
    d = _written(spark, tmp_path, incidents=(rows, shape))
    a = spark.createDataFrame(alerts, "alert_id string, source_url string, product_name string, hazard_type string, recall_date string")
    a.selectExpr("*", "current_timestamp() AS received_at").withColumn("recall_date", a.recall_date.cast("date")).write.parquet(d + "/alerts.parquet")
    got = {tuple(r) for r in QUERIES["jn08_official_link"](spark, d).collect()}
    assert got == {("u", "2", "exact_url", ""), ("n", "1", "entity_date", "product,date")}
