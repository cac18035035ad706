"""Date functions on columns; a civil date is never moved through a time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_date(c: Column) -> Column:
    """The leading ISO date of a text; null if there is none or it is not real."""
    lead = F.regexp_extract(F.trim(c), r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.try_to_timestamp(F.when(lead != "", lead), F.lit("yyyy-MM-dd")).cast("date")


def dotted_date(c: Column) -> Column:
    """Day.month.year; null if it is not real."""
    lead = F.regexp_extract(F.trim(c), r"^(\d{2}\.\d{2}\.\d{4})$", 1)
    return F.try_to_timestamp(F.when(lead != "", lead), F.lit("dd.MM.yyyy")).cast("date")


def plausible(c: Column, reference: str) -> Column:
    """From 1900 to the reference day."""
    return c.between(F.lit("1900-01-01").cast("date"), F.lit(reference).cast("date"))


def numeric_readings(c: Column) -> Column:
    """All real dates that a slashed date can mean: day first, then month first, each once."""
    lead = F.regexp_extract(F.trim(c), r"^(\d{2}/\d{2}/\d{4})", 1)
    read = lambda p: F.try_to_timestamp(F.when(lead != "", lead), F.lit(p)).cast("date")
    return F.array_distinct(F.array_compact(F.array(read("dd/MM/yyyy"), read("MM/dd/yyyy"))))


#: Month names by which written dates are read (English, French, German), and their numbers.
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6, "july": 7, "jul": 7,
    "august": 8, "aug": 8, "september": 9, "sept": 9, "sep": 9, "october": 10, "oct": 10, "november": 11, "nov": 11, "december": 12, "dec": 12,
    "janvier": 1, "janv": 1, "février": 2, "févr": 2, "fevrier": 2, "fevr": 2, "mars": 3, "avril": 4, "avr": 4, "mai": 5, "juin": 6, "juillet": 7, "juil": 7,
    "août": 8, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12, "déc": 12, "decembre": 12,
    "januar": 1, "februar": 2, "märz": 3, "mär": 3, "maerz": 3, "juni": 6, "juli": 7, "oktober": 10, "okt": 10, "dezember": 12, "dez": 12,
}
#: Words before a date that make it another one than that of publication.
EXCLUDING = (
    "last modified", "best before", "use by", "mindesthaltbar", "mhd", "prev :", "prev:", "previous :", "previous:",
    "next :", "next:", "last 24 hours",
)
#: Fixed value: characters before a date in which such a word counts.
CONTEXT = 80
#: Trust in where a date was found.
SOURCE_RANK = {"structured": 0, "selector": 1, "generic": 2}

NUMERIC = r"\b(\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4})\b"
ISO = r"\b(\d{4}-\d{2}-\d{2})\b"
NAMED = r"(?i)\b(\d{1,2}\s+(?:" + "|".join(sorted(MONTHS, key=lambda m: (-len(m), m))) + r")\.?\s+\d{4})\b"


def real_date(year: Column, month: Column, day: Column) -> Column:
    """The calendar date of three numbers as text; null if there is no such day."""
    return F.try_to_timestamp(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")


def numeric_dates(token: Column) -> Column:
    """All real dates of a numeric token: day first, month first, and for two-digit years the year first."""
    parts = F.split(token, "[/.-]")
    a, b, c = (F.get(parts, F.lit(i)) for i in range(3))
    year = F.when(F.length(c) == 2, F.concat(F.lit("20"), c)).when(F.length(c) == 4, c)
    led = F.when((F.length(a) == 2) & (F.length(c) == 2), real_date(F.concat(F.lit("20"), a), b, c))
    return F.array_distinct(F.array_compact(F.array(real_date(year, b, a), real_date(year, a, b), led)))


def named_date(token: Column) -> Column:
    """The date of day, month name and year."""
    months = F.create_map(*(F.lit(str(x)) for kv in MONTHS.items() for x in kv))
    parts = F.split(F.trim(token), r"\s+")
    return real_date(F.get(parts, F.lit(2)), F.try_element_at(months, F.regexp_replace(F.lower(F.get(parts, F.lit(1))), r"\.", "")), F.get(parts, F.lit(0)))


def _free(text: Column, token: Column, markers: tuple[str, ...]) -> Column:
    """No marker stands in the characters before the token's first occurrence."""
    low = F.lower(text)
    at = F.call_function("locate", F.lower(token), low)
    start = F.greatest(F.lit(1), at - CONTEXT)
    context = F.substring(low, start, at - start + F.length(token))
    return ~F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(context, m))


def text_dates(text: Column, reference: Column, markers: tuple[str, ...] = ()) -> Column:
    """The plausible dates written in a text, each once: numeric ones, then named months, then ISO, in order of appearance."""
    found = lambda p: F.array_distinct(F.regexp_extract_all(text, F.lit(p), 1))
    kept = (lambda a: F.filter(a, lambda x: _free(text, x, markers))) if markers else (lambda a: a)
    numeric = F.flatten(F.transform(kept(found(NUMERIC)), numeric_dates))
    named = F.transform(kept(found(NAMED)), named_date)
    iso = F.transform(kept(found(ISO)), safe_date)
    both = F.array_distinct(F.array_compact(F.concat(numeric, named, iso)))
    return F.filter(both, lambda x: x.between(F.lit("1900-01-01").cast("date"), reference))


def structured_dates(value: Column, reference: Column) -> Column:
    """Dates of one attribute: an ISO start wins, a dotted one is day first, other numeric ones give all readings, else the text is searched."""
    tidy = F.trim(value)
    iso = tidy.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$")
    whole = tidy.rlike(r"^\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}$")
    parts = F.split(tidy, r"\.")
    dotted = real_date(F.when(F.length(F.get(parts, F.lit(2))) == 2, F.concat(F.lit("20"), F.get(parts, F.lit(2)))).otherwise(F.get(parts, F.lit(2))), F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))
    plausible_only = lambda a: F.filter(F.array_compact(a), lambda x: x.between(F.lit("1900-01-01").cast("date"), reference))
    read = F.when(iso, F.array(safe_date(tidy))).when(whole & F.contains(tidy, F.lit(".")), F.array(dotted)).when(whole, numeric_dates(tidy))
    return F.coalesce(plausible_only(read), text_dates(tidy, reference))


def best_date(found: Column, reference: Column, lookback: int | None = None) -> Column:
    """The first of the (source, day) structs by trust, then order, not after ``reference`` and within ``lookback`` days."""
    ranks = F.create_map(*(F.lit(x) for kv in SOURCE_RANK.items() for x in kv))
    kept = F.filter(found, lambda x: (x["day"] <= reference) & ((F.datediff(reference, x["day"]) <= lookback) if lookback is not None else F.lit(True)))
    numbered = F.transform(kept, lambda x, i: F.struct(F.coalesce(F.try_element_at(ranks, x["source"]), F.lit(2)).alias("rank"), i.alias("i"), x["day"].alias("day"), x["source"].alias("source")))
    return F.get(F.array_sort(numbered), F.lit(0))


def complete_match(token: Column) -> Column:
    """A whole date and no fragment: numeric, ISO, a month name with a year, or three numbers."""
    tidy = F.trim(token)
    runs_on = tidy.rlike(r"\d{4}\s+[A-Za-zÀ-ÿ]")
    whole = tidy.rlike(r"^(\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}|\d{4}-\d{2}-\d{2})$")
    named = tidy.rlike(r"[A-Za-zÀ-ÿ]{3,}") & tidy.rlike(r"\d{4}")
    return F.coalesce((tidy != "") & ~runs_on & (whole | named | (F.size(F.regexp_extract_all(tidy, F.lit(r"(\d+)"), 1)) >= 3)), F.lit(False))


def tolerant_date(c: Column) -> Column:
    """The civil day of an ISO date or instant, else of the first ten characters."""
    return safe_date(F.when(F.trim(c).rlike(r"^\d{8}($|T)"), F.regexp_replace(F.trim(c), r"^(\d{4})(\d{2})(\d{2}).*$", "$1-$2-$3")).otherwise(c))


def seconds_to(clock_hour: int, now: Column, zone: str) -> Column:
    """Seconds from an instant to the next full ``clock_hour`` in a zone."""
    local = F.from_utc_timestamp(now, zone)
    today = F.date_trunc("day", local) + F.expr(f"INTERVAL {clock_hour} HOURS")
    after = F.when(today > local, today).otherwise(today + F.expr("INTERVAL 1 DAY"))
    return F.unix_seconds(F.to_utc_timestamp(after, zone)) - F.unix_seconds(now)
