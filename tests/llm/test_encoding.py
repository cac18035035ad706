import hashlib

from brackwater.llm.encoding import CHAINS, garble, restore, restore_documents, ungarble

CLEAN = "Der Käse wird zurückgerufen, “sofort” — żółć déjà à l’été.\nNÃO há informação às lojas"


def test_chains_round_trip():
    for chain in CHAINS:
        g = garble(CLEAN, chain)
        assert g != CLEAN and ungarble(g, chain) == CLEAN


def _found(spark, docs):
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, restored string")
    return {r.doc_id: r.text_md5 for r in restore_documents(df).collect()}


def test_whole_texts_lines_and_losses(spark):
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    docs, want = [(1, CLEAN), (2, None), (3, ""), (4, "plain ascii"), (5, "« Oui », “No” … ÀÉ")], {}
    for n, chain in enumerate(CHAINS[:6] + CHAINS[8:9], 10):
        docs.append((n, garble(CLEAN, chain)))
        want[n] = md5(CLEAN)
        mixed = "Clean line: déjà vu\n" + garble("Zurück à l’été", chain) + "\nend"
        docs.append((n + 100, mixed))
        want[n + 100] = md5("Clean line: déjà vu\nZurück à l’été\nend")
    docs += [(300, "caf�"), (301, garble("il est déjà ouvert", ("cp1252",)).replace(" ", " ")), (302, ("é " * 60_000) + "\n" + garble("été", ("cp1252",)))]
    want |= {300: "", 301: md5("il est déjà ouvert"), 302: md5(("é " * 60_000) + "\nété")}
    docs += [(303, "déjà été l’été"), docs[6]]
    assert _found(spark, docs) == want


def test_empty(spark):
    assert _found(spark, []) == {}


def test_only_matches_restore():
    line = garble("il est déjà là", ("cp1252",))
    assert restore(line, {}) is None and restore("caf�", {}) == ""
    assert restore(line, {garble("déjà", ("cp1252",)): [("déjà", 0)]}) == "il est déjà là"
    # A clean word whose letters happen to be bytes of another encoding stays.
    assert restore("jusqu’à\nfin", {}) is None


def test_equal_forms_name_all_their_chains():
    # The word looks alike under two chains, the line does so under one only.
    line = garble("été “ici”", ("latin-1",))
    assert restore(line, {garble("été", ("cp1252",)): [("été", 0)]}) == "été “ici”"
