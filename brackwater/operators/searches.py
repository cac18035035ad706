"""The catalogue of web-search queries: country x language x intent, interleaved and rotated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Code, name, aliases, language and domains of each country.
COUNTRIES = (
    ("GB", "United Kingdom", ("UK", "Great Britain", "England", "Scotland", "Wales", "Northern Ireland", "Royaume-Uni", "Vereinigtes Königreich"), "en", ("food.gov.uk",)),
    ("FR", "France", ("France", "Frankreich"), "fr", ("gouv.fr",)),
    ("DE", "Germany", ("Deutschland", "Allemagne"), "de", ("bund.de", "lebensmittelwarnung.de")),
)
#: Recall terms, then further intents, of each language.
TERMS = {
    "en": (
        ("food recall", "product withdrawal", "food safety alert", "product recall"),
        ("foodborne outbreak", "food poisoning", "food contamination", "contaminated food", "food safety investigation"),
    ),
    "fr": (
        ("rappel de produit", "alerte alimentaire", "retrait de produit", "rappel produit", "rappel"),
        ("éclosion d'origine alimentaire", "intoxication alimentaire", "contamination alimentaire", "contaminé", "enquête de sécurité alimentaire"),
    ),
    "de": (
        ("lebensmittelwarnung", "produktrückruf", "rückrufaktion", "rückruf"),
        ("lebensmittelbedingter ausbruch", "lebensmittelvergiftung", "verunreinigung", "kontaminiert", "lebensmitteluntersuchung"),
    ),
}


def catalogue(spark: SparkSession) -> DataFrame:
    """(pos, country, language, domain, text): every distinct query, round-robin over the countries."""
    dims = spark.createDataFrame(
        [(i, c, n, [n, *a], g, list(ds), list(TERMS[g][0]), list(TERMS[g][1])) for i, (c, n, a, g, ds) in enumerate(COUNTRIES)],
        "c_pos int, country string, name string, names array<string>, language string, domains array<string>, recall array<string>, more array<string>",
    )
    by_name = dims.select("*", F.posexplode("names").alias("p1", "who")).select("*", F.posexplode("recall").alias("p2", "term"))
    by_name = by_name.select("c_pos", "country", "language", F.lit(None).cast("string").alias("domain"), F.concat_ws(" ", "term", "who").alias("text"), F.struct(F.lit(0).alias("g"), "p1", "p2").alias("o"))
    by_more = dims.select("*", F.posexplode("more").alias("p1", "term")).select("c_pos", "country", "language", F.lit(None).cast("string").alias("domain"), F.concat_ws(" ", "term", "name").alias("text"), F.struct(F.lit(1).alias("g"), "p1", F.lit(0).alias("p2")).alias("o"))
    by_site = dims.select("*", F.posexplode("domains").alias("p1", "site")).select("*", F.posexplode(F.slice("recall", 1, 2)).alias("p2", "term"))
    by_site = by_site.select("c_pos", "country", "language", F.col("site").alias("domain"), F.concat("term", F.lit(" site:"), "site").alias("text"), F.struct(F.lit(2).alias("g"), "p1", "p2").alias("o"))
    all_rows = by_name.unionByName(by_more).unionByName(by_site)
    once = all_rows.groupBy("c_pos", "country", "language", "domain", "text").agg(F.min("o").alias("o"))
    turn = once.withColumn("turn", F.row_number().over(Window.partitionBy("country").orderBy("o")))
    # The catalogue is configuration: some dozens of rows.
    return turn.select((F.row_number().over(Window.orderBy("turn", "c_pos")) - 1).alias("pos"), "country", "language", "domain", "text")


def rotated(queries: DataFrame, rotation: int, budget: int) -> DataFrame:
    """The ``budget`` queries of one run: a cyclic slice that moves on with each rotation."""
    total = queries.select(F.count("*").alias("total"))
    at = F.pmod(F.col("pos") - F.lit(rotation) * F.least(F.lit(budget), F.col("total")), F.col("total"))
    return queries.crossJoin(F.broadcast(total)).withColumn("slot", at).filter(F.col("slot") < budget).select("slot", "country", "text")
