from brackwater.plans.details import QUERIES


def test_document_has_all_lines_and_log_has_all_runs(spark, tmp_path):
    fields = ("product_name", "company_name", "hazard_type", "country", "incident_reason", "summary")
    spark.createDataFrame([("i", "p", "c", "h", "fr", " ", "s")], "incident_id string, " + ", ".join(f"{f} string" for f in fields)).write.parquet(str(tmp_path / "incidents.parquet"))
    spark.range(250).selectExpr("id AS event_id", "id % 2 AS user_id", "'view' AS event_type", "timestamp_seconds(id) AS ts").write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["tx16_full_document"](spark, str(tmp_path)).first()
    assert got.document == "Product: p\nCompany: c\nHazard: h\nCountry: fr\nSummary: s"
    log = QUERIES["sc10_run_log_all"](spark, str(tmp_path))
    assert log.count() == 250 and {(r.user_id, r.event_id) for r in log.filter("newest = 1").collect()} == {(0, 248), (1, 249)}
