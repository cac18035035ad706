import datetime as dt

from brackwater.llm.survivor import _key, field_values, learn_precedence, surviving_records, survivors

SCHEMA = (
    "incident_id string, cluster_fingerprint string, trust_tier string, extraction_completeness double, last_discovered_at timestamp, "
    "verification_status string, product_name string, company_name string, hazard_type string, country string, consumer_guidance string, "
    "evidence array<struct<url string>>, value string"
)
T = dt.datetime(2025, 1, 1)


def _row(i, f="F", tier="low", share=0.5, at=T, status="pending", product="p", company="c", ev=(), **kw):
    return (i, f, tier, share, at, status, product, company, kw.get("hazard"), "X", None, [(u,) for u in ev], "extra")


def _pick(spark, rows):
    return {(r.cluster_fingerprint, r.field_name): r.incident_id for r in survivors(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_rank_and_usable_values(spark):
    rows = [
        _row("a", tier=" Official", product="n/a", ev=("u", " u ", "")),
        _row("b", tier="HIGH", share=60.0, company=" "),
        _row("c", tier="high", share=0.59, company=None),
        _row("d", f=" f ", tier=None, share=None, hazard="chem", ev=("u", "w")),
        _row("a", tier=" Official", product="n/a", ev=("u", " u ", "")),
        _row("e", f=None), _row("g", f=" "), _row("single", f="other"), _row(None),
    ]
    assert _pick(spark, rows) == {
        ("f", "product_name"): "b", ("f", "company_name"): "a", ("f", "hazard_type"): "d", ("f", "country"): "a", ("f", "evidence"): "d",
    }


def _day(k):
    return T + dt.timedelta(days=k)


def test_missing_times_follow_the_order_of_their_group(spark):
    # Three groups show acme, then acme ltd, then acme group; one shows the reverse of the first step.
    rows = [_row(f"t{i}{k}", f=f"g{i}", at=_day(k), company=c) for i in range(3) for k, c in enumerate(("Acme", "Acme Ltd", "Acme Group"))]
    rows += [_row("r0", f="rev", at=_day(0), company="acme ltd"), _row("r1", f="rev", at=_day(1), company="ACME")]
    rows += [_row("m1", f="m", at=None, company="Acme"), _row("m2", f="m", at=None, company="Acme  group"), _row("m3", f="m", at=None, company="Acme Ltd")]
    # A timed value that an untimed one succeeds; an untimed one that a timed one succeeds; strangers: the timed one stays.
    rows += [_row("u1", f="u", at=_day(9), company="Acme"), _row("u2", f="u", at=None, company="Acme Ltd")]
    rows += [_row("w1", f="w", at=None, company="Acme"), _row("w2", f="w", at=_day(1), company="Acme Ltd")]
    rows += [_row("x1", f="x", at=None, company="other"), _row("x2", f="x", at=_day(1), company="Acme Ltd"), _row("x3", f="x", at=_day(3), company="third")]
    rows += [_row("z2", f="z", at=None), _row("z1", f="z", at=None), rows[-1]]
    df = spark.createDataFrame(rows, SCHEMA)
    learned = {(r.before, r.after) for r in learn_precedence(field_values(_key(df), ("company_name",))).collect()}
    assert learned == {("acme", "acme ltd"), ("acme ltd", "acme group"), ("acme ltd", "third")}
    got = {f: _pick(spark, rows)[(f, "company_name")] for f in ("m", "u", "w", "x", "z", "rev")}
    assert got == {"m": "m2", "u": "u2", "w": "w2", "x": "x3", "z": "z1", "rev": "r1"}
    plain = {(r.cluster_fingerprint, r.field_name): r.incident_id for r in survivors(df, learn=False).collect()}
    assert plain[("m", "company_name")] == "m1" and plain[("u", "company_name")] == "u1"


def test_circles_fall_back_to_ids(spark):
    rows = []
    for i, (a, b) in enumerate((("p", "q"), ("q", "r"), ("r", "p"))):
        rows += [_row(f"c{i}a", f=f"g{i}", at=_day(0), company=a), _row(f"c{i}b", f=f"g{i}", at=_day(1), company=b)]
    rows += [_row(f"k{c}", f="circle", at=None, company=c) for c in "rqp"]
    assert _pick(spark, rows)[("circle", "company_name")] == "kp"


def test_one_record_for_each_group(spark):
    rows = [_row("a", tier="high", company=None, ev=("u1",)), _row("b", product="n/a", company="b co", ev=("u2", "u3")), _row("s", f="single")]
    got = surviving_records(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.cluster_fingerprint, r.product_name, r.company_name, r.hazard_type, [e.url for e in r.evidence]) for r in got] == [("f", "p", "b co", None, ["u2", "u3"])]
    assert got[0].sources == {"product_name": "a", "company_name": "b", "country": "a", "evidence": "b"}


def test_empty(spark):
    assert survivors(spark.createDataFrame([], SCHEMA)).count() == 0
