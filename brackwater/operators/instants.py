"""Mixed timestamp formats and zones normalised to one UTC instant.

All accepted formats live in ONE regular-expression alternation with named
groups.  A single ``regexp_replace`` pass extracts every component at once into
a delimited record; the components are range-checked against the calendar and
assembled into an instant by integer day arithmetic.  Everything stays in JVM
expressions inside whole-stage codegen: no UDF, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Month names and abbreviations (accents folded) by language.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9,
    "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "janvier": 1, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6,
    "juillet": 7, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12,
    "janv": 1, "fevr": 2, "avr": 4, "juil": 7,
    "januar": 1, "februar": 2, "marz": 3, "juni": 6, "juli": 7, "oktober": 10, "dezember": 12,
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6,
    "julio": 7, "agosto": 8, "septiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
    "gennaio": 1, "febbraio": 2, "aprile": 4, "maggio": 5, "giugno": 6,
    "luglio": 7, "settembre": 9, "ottobre": 10, "dicembre": 12,
    "januari": 1, "februari": 2, "maart": 3, "mei": 5, "augustus": 8,
    "janeiro": 1, "fevereiro": 2, "marco": 3, "maio": 5, "junho": 6,
    "julho": 7, "setembro": 9, "outubro": 10, "novembro": 11, "dezembro": 12,
    "stycznia": 1, "lutego": 2, "marca": 3, "kwietnia": 4, "maja": 5, "czerwca": 6,
    "lipca": 7, "sierpnia": 8, "wrzesnia": 9, "pazdziernika": 10, "listopada": 11, "grudnia": 12,
}

#: Minutes east of UTC of zone abbreviations.
ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60,
    "CEST": 120, "EET": 120, "EEST": 180, "EST": -300, "EDT": -240, "CST": -360,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

_ZONE = r"Z|[A-Z]{2,4}|[+-]\d{2}:?\d{2}|[+-]\d{2}"
_HALF = r"[AaPp]\.?[Mm]\.?"


def _clock(n: int) -> str:
    return (
        rf"(?<h{n}>\d{{1,2}})[:h](?<i{n}>\d{{2}})(?::(?<s{n}>\d{{2}})(?:[.,]\d+)?)?"
        rf"\s*(?<p{n}>{_HALF})?\s*(?<z{n}>{_ZONE})?"
    )


#: Year first; compact; epoch; two numbers before the year; day then month name; month name then day.
PATTERN = (
    r"^\s*(?:"
    rf"(?<y1>\d{{4}})([-/.])(?<m1>\d{{1,2}})\2(?<d1>\d{{1,2}})(?:[T\s]\s*{_clock(1)})?"
    r"|(?<y2>\d{4})(?<m2>\d{2})(?<d2>\d{2})"
    rf"(?:T(?<h2>\d{{2}})(?<i2>\d{{2}})(?:(?<s2>\d{{2}})(?:[.,]\d+)?)?(?<z2>{_ZONE})?)?"
    r"|(?<e3>\d{10}|\d{13})"
    rf"|(?<a4>\d{{1,2}})(?<k4>[-/.])(?<b4>\d{{1,2}})\k<k4>(?<y4>\d{{4}}|\d{{2}})(?:,?[T\s]\s*{_clock(4)})?"
    r"|(?:\p{L}{2,10}\.?,?\s+)?(?<d5>\d{1,2})(?:er|st|nd|rd|th|\.|º)?\s+(?:de\s+)?(?<n5>\p{L}{3,12})\.?,?\s+(?:de\s+)?(?<y5>\d{4})"
    rf"(?:,?\s+(?:(?:à|at|um|om|alle|o)\s+)?{_clock(5)})?"
    r"|(?:\p{L}{2,10}\.?,\s+)?(?<n6>\p{L}{3,12})\.?\s+(?<d6>\d{1,2})(?:st|nd|rd|th)?,?\s+(?<y6>\d{4})"
    rf"(?:,?\s+(?:at\s+)?{_clock(6)})?"
    r")\s*$"
)

_MARK, _CUT = "\u0001", "\u0002"
#: Order of the components in the record that the single pass writes.
_FIELDS = ("y", "m", "d", "n", "a", "b", "w", "h", "i", "s", "p", "z", "e")
_REPLACEMENT = _MARK + _CUT.join(
    (
        "${y1}${y2}${y5}${y6}", "${m1}${m2}", "${d1}${d2}${d5}${d6}", "${n5}${n6}", "${a4}", "${b4}", "${y4}",
        "${h1}${h2}${h4}${h5}${h6}", "${i1}${i2}${i4}${i5}${i6}", "${s1}${s2}${s4}${s5}${s6}",
        "${p1}${p4}${p5}${p6}", "${z1}${z2}${z4}${z5}${z6}", "${e3}",
    )
)
_FOLD_FROM, _FOLD_TO = "àáâãäåçèéêëìíîïñòóôõöùúûüýśźżłńćęą", "aaaaaaceeeeiiiinooooouuuuyszzlncea"


def _int(c: Column) -> Column:
    return F.when(c != "", c.cast("int"))


def _lookup(table: dict[str, int], key: Column) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), key)


def with_epoch_seconds(
    df: DataFrame, value_col: str, out_col: str, zone: str, month_first: bool = False
) -> DataFrame:
    """``df`` with the UTC epoch seconds of a written time, null when it names no real date.

    ``zone`` holds for values without a zone.  A date alone is the start of the
    local day; missing seconds are 0 and fractions are cut; an ambiguous local
    time is its first occurrence and a skipped one takes the offset before the
    change.  Numeric dates are day first (``month_first`` reverses that) unless
    the year leads; two-digit years are 20yy; 10 or 13 digits are an epoch in
    seconds or milliseconds.  Null, empty, unknown text, an unknown zone name
    and impossible calendar values give null.

    The stages are separate projections so that each component is computed once
    and the whole chain stays in generated code.
    """
    own = [F.col(f"`{c}`") for c in df.columns]
    cut = df.select(*own, F.split(F.regexp_replace(F.col(value_col), PATTERN, _REPLACEMENT), _CUT).alias("_r"))
    named = cut.select(*own, *(F.get("_r", F.lit(i)).alias(f"_{k}") for i, k in enumerate(_FIELDS)))
    marked = F.startswith("_y", F.lit(_MARK))
    year, first, second, short = _int(F.substring("_y", 2, 99)), _int(F.col("_a")), _int(F.col("_b")), _int(F.col("_w"))
    clock, half = _int(F.col("_h")), F.lower(F.substring("_p", 1, 1))
    dated = named.select(
        *own,
        F.when(marked, F.coalesce(year, F.when(short < 100, short + 2000).otherwise(short))).alias("_y"),
        F.coalesce(
            _int(F.col("_m")),
            _lookup(MONTHS, F.translate(F.lower("_n"), _FOLD_FROM, _FOLD_TO)),
            first if month_first else second,
        ).alias("_m"),
        F.coalesce(_int(F.col("_d")), second if month_first else first).alias("_d"),
        F.when(F.col("_h") == "", 0)
        .when(half == "", clock)
        .when((clock < 1) | (clock > 12), F.lit(None))
        .when(half == "a", clock % 12)
        .otherwise(clock % 12 + 12)
        .alias("_h"),
        F.coalesce(_int(F.col("_i")), F.lit(0)).alias("_i"),
        F.coalesce(_int(F.col("_s")), F.lit(0)).alias("_s"),
        F.regexp_replace("_z", ":", "").alias("_z"),
        F.when(marked & (F.col("_e") != ""), F.col("_e").cast("long")).alias("_e"),
    )
    y, m, d, h, i, s = (F.col(f"_{k}") for k in "ymdhis")
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    longest = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    real = m.between(1, 12) & (d >= 1) & (d <= longest) & (y >= 1) & (h < 24) & (i < 60) & (s < 60)
    whole = lambda c, by: F.floor(c / by)
    days = (
        F.col("_n") * 365 + whole(F.col("_n"), 4) - whole(F.col("_n"), 100) + whole(F.col("_n"), 400)
        + whole(153 * ((m + 9) % 12) + 2, 5) + d - 1 - 719468
    )
    checked = dated.select(*own, "_y", "_m", "_d", "_h", "_i", "_s", "_z", "_e", (y - F.when(m <= 2, 1).otherwise(0)).alias("_n"))
    local = checked.select(*own, F.when(real, days * 86400 + h * 3600 + i * 60 + s).alias("_l"), "_z", "_e")
    z = F.col("_z")
    minutes = F.substring(z, 2, 2).cast("int") * 60 + F.when(F.length(z) == 5, F.substring(z, 4, 2).cast("int")).otherwise(0)
    offset = (
        F.when(F.startswith(z, F.lit("-")), F.when(minutes <= 1080, -minutes))
        .when(F.startswith(z, F.lit("+")), F.when(minutes <= 1080, minutes))
        .otherwise(_lookup(ZONES, z))
    )
    placed = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds("_l"), zone))
    epoch = F.when(F.col("_e") >= 10**12, F.floor(F.col("_e") / 1000)).otherwise(F.col("_e"))
    return local.select(
        *own,
        F.when(F.col("_e").isNotNull(), epoch).when(z == "", placed).otherwise(F.col("_l") - offset * 60).alias(out_col),
    )


def utc_text(seconds: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` of epoch seconds, whatever the session's zone is."""
    day = F.floor(seconds / 86400)
    left = seconds - day * 86400
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    return F.concat(
        F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"),
        two(left / 3600), F.lit(":"), two(left % 3600 / 60), F.lit(":"), two(left % 60), F.lit("Z"),
    )


def normalise_instants(
    df: DataFrame, id_col: str, value_col: str, zone: str, month_first: bool = False
) -> DataFrame:
    """One row (rec_id, utc_seconds, utc_text) for each distinct pair of key and real instant.

    Redelivered rows collapse to one.  Rows whose value names no real date give
    nothing; a null key stays a null ``rec_id``; other columns are ignored; an
    empty table gives an empty result.
    """
    values = df.select(F.col(id_col).alias("rec_id"), F.col(value_col).alias("written"))
    return (
        with_epoch_seconds(values, "written", "utc_seconds", zone, month_first)
        # The partition's number is not deterministic, which keeps the filter from being pushed
        # down through the staged projections and every stage from being expanded into it.
        .select("rec_id", "utc_seconds", F.spark_partition_id().alias("_at"))
        .filter(F.col("utc_seconds").isNotNull() & (F.col("_at") >= 0))
        .select("rec_id", "utc_seconds")
        .distinct()
        .select("rec_id", "utc_seconds", utc_text(F.col("utc_seconds")).alias("utc_text"))
    )


#: table, key, column, zone of values without one, month first
FEEDS = (
    ("france_recall", "numero_fiche", "date_publication", "Europe/Paris", False),
    ("uk_recall", "notation", "created", "Europe/London", False),
    ("us_recall", "field_recall_number", "field_last_modified_date", "America/New_York", True),
    ("incidents", "incident_id", "publication_date", "UTC", False),
)
