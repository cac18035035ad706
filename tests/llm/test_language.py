import pytest
from pyspark.sql import functions as F

from brackwater.llm.language import LANGUAGES, fit, identify, label_language, script_of

TEXTS = {
    "en": ["The company is calling back all jars because of raised levels", "Shoppers who bought the product should check the lid before opening it", "No illness has been linked to this batch so far said the firm", "We are sorry for the worry this has caused a manager told traders"],
    "fr": ["La société rappelle tous les pots après avoir constaté un taux élevé", "Les clients qui ont acheté ce produit sont priés de vérifier le numéro", "Aucun malade n a été signalé jusqu à présent précise la société", "Nous regrettons cette situation a déclaré un responsable aux commerçants"],
    "de": ["Die Firma ruft alle Gläser zurück weil erhöhte Werte gefunden wurden", "Wer das Produkt gekauft hat soll vor dem Öffnen die Nummer prüfen", "Bisher ist niemand erkrankt teilt das Unternehmen mit das viele Läden beliefert", "Wir bedauern die Unruhe sehr sagte eine Sprecherin vor den Händlern"],
    "es": ["La empresa retira todos los frascos tras hallar un nivel elevado", "Quienes hayan comprado el producto deben revisar el código de la tapa", "Hasta ahora no hay personas enfermas indicó la empresa que abastece las tiendas", "Lamentamos mucho lo ocurrido dijo una portavoz a los comerciantes"],
    "it": ["L azienda ritira tutti i vasetti perché è stato trovato un livello elevato", "Chi ha comprato il prodotto deve controllare il codice sul coperchio", "Finora non risultano persone malate ha comunicato l azienda che rifornisce i negozi", "Ci dispiace molto per l accaduto ha detto una portavoce ai commercianti"],
    "nl": ["Het bedrijf haalt alle potten terug vanwege een verhoogd gehalte", "Wie het product heeft gekocht moet eerst de code op het deksel bekijken", "Er zijn nog geen zieken gemeld zegt het bedrijf dat de winkels bevoorraadt", "Wij vinden dit erg vervelend zei een woordvoerder tegen de winkeliers"],
    "pl": ["Firma wycofuje wszystkie słoiki ponieważ wykryto podwyższony poziom", "Kto kupił ten produkt powinien przed otwarciem sprawdzić numer na wieczku", "Do tej pory nikt nie zachorował podaje firma która zaopatruje sklepy", "Bardzo nam przykro z tego powodu powiedziała rzeczniczka sprzedawcom"],
    "pt": ["A empresa retira todos os frascos depois de encontrar um nível elevado", "Quem comprou o produto deve verificar o código na tampa antes de abrir", "Até agora não há pessoas doentes informou a empresa que abastece as lojas", "Lamentamos muito a situação disse uma porta voz aos comerciantes"],
}


@pytest.fixture(scope="module")
def model():
    lines, labels = [], []
    for k in range(6):
        for i, lang in enumerate(LANGUAGES):
            for j, t in enumerate(TEXTS[lang]):
                lines.append(f" {t.lower()} ")
                labels.append((i + 1) % 8 if (k, j) == (0, 0) else i)  # some labels are wrong
    return fit(lines, labels)


def test_held_out_lines(model):
    mixed = [(lang, f" {a.lower()[:40]} {b.lower()[10:50]} ") for lang, t in TEXTS.items() for a, b in zip(t, t[1:])]
    guess = model.probabilities([x for _, x in mixed]).argmax(axis=1)
    right = sum(LANGUAGES[g] == lang for g, (lang, _) in zip(guess, mixed))
    assert right >= 0.95 * len(mixed)
    assert 0 < model.temperature <= 5


def test_labels(spark):
    rows = ["en-GB", "EN", " eng ", "English", "pt_BR", "português", "Deutsch", "und", "", "xx", None, "sv", "Spanish"]
    got = [r.c for r in spark.createDataFrame([(x,) for x in rows], "l string").select(label_language(F.col("l")).alias("c")).collect()]
    assert got == ["en", "en", "en", "en", "pt", "pt", "de", None, None, None, None, None, "es"]


def test_records_and_foreign_lines(spark, model):
    en, fr = "\n".join(TEXTS["en"]), TEXTS["fr"][1]
    rows = [("documents", "1", "en", f"{en}\n{fr}"), ("documents", "2", None, en.upper()), ("documents", "3", "en", None), ("documents", "4", "en", ""),
            ("incidents", "5", "fr", f"{en}\n{fr}"), ("documents", "6", "en", "12 34\n\n!!"), ("documents", "7", "en", (en + "\n") * 400)]
    df = spark.createDataFrame(rows, "tbl string, rec_id string, declared string, text string").withColumn("script", script_of(F.col("text"))).withColumn("lang", F.lit("clash"))
    got = {(r.rec_id, r.line_no, r.lang) for r in identify(df, model, ("documents",)).collect()}
    assert got == {("1", 0, "en"), ("1", 5, "fr"), ("2", 0, "en"), ("5", 0, "en"), ("7", 0, "en")}
    assert all(0 <= r.confidence <= 1 for r in identify(df, model, ()).collect())
    assert identify(df.limit(0), model, ()).count() == 0
