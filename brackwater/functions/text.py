"""Text functions on columns."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Markers of page furniture in a sentence.
BOILERPLATE = ("cookie", "privacy policy", "terms and conditions", "accessibility", "newsletter", "all rights reserved")
#: Names that stand for no single product.
VAGUE_PRODUCTS = (
    "various products", "multiple products", "food products", "recalled products", "product recalls",
    "recall alerts", "food recalls", "all products",
)


def collapse(c: Column) -> Column:
    """White space runs become one space; outer white space goes."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


@F.pandas_udf(StringType())
def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else html.unescape(t))


def strip_markup(c: Column) -> Column:
    """Entities become characters, then tags go and white space is collapsed; texts without ``&`` stay in the JVM."""
    plain = F.when(F.contains(c, F.lit("&")), _unescaped(F.when(F.contains(c, F.lit("&")), c))).otherwise(c)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"<[^>]+>", " "), r"(?U)\s+", " "))


def split_list(c: Column) -> Column:
    """Items of a list written with | or ¤; blanks dropped."""
    return F.filter(F.transform(F.split(F.translate(c, "¤", "|"), r"\|"), F.trim), lambda x: x != "")


def without_boilerplate(c: Column) -> Column:
    """Tags go, then the sentences that hold a furniture marker."""
    parts = F.split(collapse(F.regexp_replace(c, r"<[^>]+>", " ")), r"\. ")
    keep = F.filter(parts, lambda x: ~F.lower(x).rlike("|".join(BOILERPLATE)))
    return F.array_join(keep, ". ")


def truncated(c: Column, most: int = 4000) -> Column:
    """At most ``most`` characters, the last an ellipsis when cut."""
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))).otherwise(c)


def sentence_count(c: Column) -> Column:
    """Sentences that end in . ! or ? before white space."""
    return F.size(F.filter(F.split(F.trim(c), r"(?<=[.!?])\s+"), lambda x: x != ""))


def specific_product(c: Column) -> Column:
    """A concrete product name, cleaned as a heading: not blank, vague or a list."""
    c = header(c)
    tidy = F.lower(c)
    marks = F.length(c) - F.length(F.translate(c, ",;|", ""))
    ands = F.size(F.split(tidy, " and ")) - 1
    return F.coalesce((tidy != "") & ~tidy.isin(*VAGUE_PRODUCTS) & (marks < 4) & (ands < 4), F.lit(False))


def header(c: Column, most: int = 160) -> Column:
    """A heading: white space collapsed, outer dashes, bars, colons and quotes trimmed; blank if longer than ``most`` or JSON."""
    tidy = F.regexp_replace(collapse(c), "^[-–—|:;\"'\\s]+|[-–—|:;\"'\\s]+$", "")
    return F.when((F.length(tidy) > most) | tidy.rlike(r"^[{\[]"), "").otherwise(tidy)


def place(c: Column) -> Column:
    """A place in lower case without accents, everything but ASCII letters and digits as single spaces."""
    return F.trim(F.regexp_replace(folded(F.replace(c, F.lit("&"), F.lit(" "))), "[^a-z0-9]+", " "))


def bounded_score(c: Column) -> Column:
    """A score rounded half up and kept within 0 and 100."""
    return F.least(F.greatest(F.floor(c + 0.5), F.lit(0)), F.lit(100)).cast("int")


def confidence_label(c: Column) -> Column:
    return F.when(c >= 85, "very high").when(c >= 70, "high").when(c >= 50, "medium").otherwise("low")


def language_code(c: Column) -> Column:
    """Primary two-letter subtag of a language tag; blank if there is none."""
    return F.regexp_extract(F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit("-")), "^[a-z]{2}(?=-|$)", 0)


@F.pandas_udf(StringType())
def folded(s: pd.Series) -> pd.Series:
    """NFKD without combining marks, & as and, case folded, words joined by single spaces."""
    word = regex.compile(r"\w+")

    def one(t):
        if t is None:
            return ""
        t = unicodedata.normalize("NFKD", t.replace("&", " and "))
        return " ".join(word.findall("".join(c for c in t if not unicodedata.combining(c)).casefold()))

    return s.map(one)
