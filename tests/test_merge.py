import datetime as dt

from brackwater.plans.incidents import QUERIES

E = "array<struct<url string, title string, publication_date date, source_kind string, content_hash string, domain string, publisher string, redirected_url_aliases array<string>>>"
TEXTS = (
    "product_name", "company_name", "product_category", "hazard_type", "incident_reason", "summary", "consumer_guidance", "country", "publication_date",
    "primary_source_domain", "primary_publisher", "original_language", "analyst_notes", "source_kind", "verification_status", "cluster_fingerprint",
)
SCHEMA = "incident_id string, " + ", ".join(f"{t} string" for t in TEXTS) + f", first_discovered_at timestamp, last_discovered_at timestamp, extraction_completeness double, evidence {E}, affected_regions array<string>, linked_official_alert_ids array<string>, processing_errors array<string>"


def _row(i, day, evidence=(), regions=None, **kw):
    at = dt.datetime(2025, 1, day)
    texts = [kw.get(t, "f" if t == "cluster_fingerprint" else "pending" if t == "verification_status" else "blog" if t == "source_kind" else None) for t in TEXTS]
    return (i, *texts, at, at + dt.timedelta(days=30), kw.get("share", 0.5), [(u, title, None, "major_news", None, domain, None, None) for u, title, domain in evidence], regions, None, None)


def _merged(spark, tmp_path, rows, name="st03_merged_incidents"):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "incidents.parquet"))
    return {r.key: r for r in QUERIES[name](spark, str(tmp_path)).collect()}


def test_fields_follow_their_rules(spark, tmp_path):
    rows = [
        _row("b", 2, product_name="Oat bar", country="UK", summary="later", evidence=[("https://a.test/1", "", "a.test"), ("https://b.test/2", "B", None)]),
        _row("a", 1, product_name="Oat bar mini", country="United Kingdom", summary="first", consumer_guidance="keep", evidence=[("https://A.test/1 ", "A", "a.test"), (None, "x", "y")]),
        _row("c", 3, product_name=" ", summary="", publication_date="2025-01-03"),
        _row("t1", 1, cluster_fingerprint="T", verification_status="dismissed"), _row("t2", 2, cluster_fingerprint=" t ", verification_status="superseded"),
        _row("one", 1, cluster_fingerprint="one", verification_status="corroborated", evidence=None or ()), _row("n", 1, cluster_fingerprint=None), _row("b", 2, product_name="Oat bar", country="UK", summary="later", evidence=[("https://a.test/1", "", "a.test"), ("https://b.test/2", "B", None)]),
    ]
    got = _merged(spark, tmp_path, rows)
    f = got["f"]
    assert (f.incident_id, f.records, f.status, f.independent, f.pages) == ("a", 3, "corroborated", 2, 2)
    assert (f.product_name, f.country, f.publication_date) == ("Oat bar mini", "United Kingdom", "2025-01-03")
    assert got["t"].status == "dismissed" and got["one"].status == "corroborated" and set(got) == {"f", "t", "one"}


def test_united_arrays_keep_first_order(spark, tmp_path):
    rows = [_row("b", 2, regions=["x", "z", None, "y"]), _row("a", 1, regions=["y", "x"]), _row("c", 3, regions=[])]
    assert _merged(spark, tmp_path, rows, "se01_united_affected_regions")["f"]["items"] == "y|x|z"
