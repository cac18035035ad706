"""Lines that one site repeats across its documents, found by hashing and removed.

Numbers, dates in digits, punctuation and the site's own name are masked.  Each
line then gets minhash bands over runs of eight letters; within a site, lines
that share a band bucket form a near-duplicate cluster.  Buckets in which enough
records of the site take part are frequent; their lines are the candidates.

Two rules decide on a candidate.  ``repeated_lines`` confirms by an exact count of
its letters (two lines with the same letters have the same bands, so every
repeated line is a candidate).  ``near_repeated_lines`` lets the clusters decide:
personal and place names are masked as well, and a line goes if at least two of
its bands lie in frequent buckets; a byline with changing names is one cluster.

Cost: one pass over the texts gives a few fixed-size numbers for each line;
everything after it works on those.  All counts are partial aggregates.  A site
has few frequent buckets (each takes a twentieth of its records), so they are
brought to its records as one array; where that table is not small enough to be
broadcast, a site's records are salted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brackwater.runtime import stored, table

LEAST_LETTERS = 10
LEAST_RECORDS = 3
LEAST_SHARE = 0.05
RUN = 8
BANDS, ROWS = 4, 3
#: Bands of a line that must lie in frequent buckets for the clusters to decide.
NEAR_BANDS = 2
#: The frequent buckets or lines of all sites are broadcast up to this many numbers (8 bytes each); beyond it sites are salted.
BROADCAST_NUMBERS = 2_000_000
SALTS = 16

_SEEDS = np.random.default_rng(20240501).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def letters_of(text: Column, markup: bool = False) -> Column:
    """Only the letters of each line, in lower case; with ``markup`` tags and entities go first."""
    if markup:
        text = F.regexp_replace(F.regexp_replace(text, r"<[^>\n]*>", ""), r"&(?:#\d+|#[xX][0-9a-fA-F]+|\w+);", "")
    return F.regexp_replace(F.lower(text), r"[^\p{L}\n]+", "")


#: A capitalised word that does not begin a line or sentence.
NAME = r"(?<=[\p{L}\p{N},;’'\])&-] )\p{Lu}[\p{L}’'-]*\p{Ll}[\p{L}’'-]*"


def without_names(text: Column) -> Column:
    """``text`` without the capitalised words inside its sentences."""
    return F.regexp_replace(text, NAME, "")


def band_buckets(lines: list[str]) -> np.ndarray:
    """Minhash buckets (len(lines) x BANDS, uint64) of lines of at least RUN letters each."""
    codes = np.frombuffer("\n".join(lines).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    count = len(codes) - RUN + 1
    rolled = np.zeros(count, dtype=np.uint64)
    for k in range(RUN):
        rolled *= _BASE
        rolled += codes[k : k + count]
    rolled ^= rolled >> np.uint64(29)
    lengths = np.fromiter((len(x) for x in lines), dtype=np.int64, count=len(lines))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    # Pairs of borders: every second slice is the runs inside one line.
    borders = np.empty(2 * len(lines), dtype=np.int64)
    borders[0::2] = starts
    borders[1::2] = starts + lengths - RUN + 1
    borders = borders[:-1] if borders[-1] >= count else borders
    out = np.zeros((len(lines), BANDS), dtype=np.uint64)
    for j, seed in enumerate(_SEEDS):
        least = np.minimum.reduceat(rolled * seed, borders)[0::2]
        band = out[:, j // ROWS]
        band ^= least
        band *= _MIX
        band ^= band >> np.uint64(31)
    out += np.arange(1, BANDS + 1, dtype=np.uint64) * _BASE
    return out


def _flush(rows: list[tuple[str, str, str, list[str], str]]) -> pa.RecordBatch:
    exact: list[list[int]] = []
    masked: list[str] = []
    for _, _, _, lines, name in rows:
        exact.append([xxhash.xxh3_64_intdigest(x) - 2**63 if len(x) >= LEAST_LETTERS else 0 for x in lines])
        for x in lines:
            if len(x) >= LEAST_LETTERS:
                short = x.replace(name, "") if name and name in x else x
                masked.append(short if len(short) >= RUN else x)
    flat = band_buckets(masked).astype(np.int64) if masked else np.zeros((0, BANDS), np.int64)
    keys, offsets = [], [0]
    for row in exact:
        keys.extend(row)
        offsets.append(len(keys))
    held = np.array(keys, dtype=np.int64)
    columns = []
    for band in range(BANDS):
        spread = np.zeros(len(held), dtype=np.int64)
        spread[held != 0] = flat[:, band]
        columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(spread)))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
        + [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(held)), *columns],
        names=["tbl", "site", "rec_id", "keys", *(f"b{i}" for i in range(BANDS))],
    )


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, size = [], 0
        for tbl, site, rec_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            name = "".join(c for c in (site or "").lower().rpartition(".")[0] or (site or "").lower() if c.isalpha())
            rows.append((tbl, site, rec_id, (text or "").split("\n"), name if len(name) > 3 else ""))
            size += len(text or "")
            if size > 400_000:
                yield _flush(rows)
                rows, size = [], 0
        yield _flush(rows)


def signatures(records: DataFrame) -> DataFrame:
    """One row for each record (tbl, rec_id): its line keys and band buckets, 0 for lines that do not count."""
    shape = "tbl string, site string, rec_id string, keys array<bigint>, " + ", ".join(f"b{i} array<bigint>" for i in range(BANDS))
    return records.select("tbl", "site", "rec_id", "letters").mapInArrow(_signatures, shape).dropDuplicates(["tbl", "rec_id"])


def _at_sites(records: DataFrame, numbers: DataFrame, broadcast_numbers: int) -> DataFrame:
    """``records`` with the array ``held`` of their site's ``numbers`` (tbl, site, number); sites without any fall away."""
    where = ["tbl", "site"]
    sites = stored(numbers.groupBy(*where).agg(F.collect_set("number").alias("held")), "sites")
    total = sites.agg(F.sum(F.size("held"))).first()[0] or 0
    if total <= broadcast_numbers:
        return records.join(F.broadcast(sites), where)
    salted = sites.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return records.withColumn("salt", F.pmod(F.xxhash64("rec_id"), F.lit(SALTS)).cast("int")).join(salted, [*where, "salt"]).drop("salt")


def _frequent(counted: DataFrame, least: DataFrame) -> DataFrame:
    """(tbl, site, number) of the numbers that enough records of their site hold; ``counted`` has one row for each record."""
    where = ["tbl", "site"]
    return (
        counted.groupBy(*where, "number").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_RECORDS)
        .join(least, where).filter(F.col("n") >= F.col("least")).select(*where, "number")
    )


def _candidates(records: DataFrame, bands: int, broadcast_numbers: int) -> tuple[DataFrame, DataFrame]:
    """(tbl, site, rec_id, line_no, key, cluster) of the lines of which at least ``bands`` bands lie in frequent buckets; each site's threshold."""
    # A null-safe copy of the site keeps records without one together.
    signed = stored(signatures(records).withColumn("site", F.coalesce("site", F.lit(""))), "signatures")
    least = signed.groupBy("tbl", "site").agg(F.greatest(F.lit(LEAST_RECORDS), F.ceil(F.count("*") * LEAST_SHARE - 1e-9)).alias("least"))
    own = F.array_remove(F.array_distinct(F.flatten(F.array(*(F.col(f"b{i}") for i in range(BANDS))))), 0)
    frequent = _frequent(signed.select("tbl", "site", F.explode(own).alias("number")), least)
    met = _at_sites(signed, frequent, broadcast_numbers).withColumn("met", F.array_intersect(own, "held")).filter(F.size("met") > 0)
    lines = met.select("tbl", "site", "rec_id", "met", F.posexplode(F.arrays_zip("keys", *(f"b{i}" for i in range(BANDS)))).alias("pos", "x")).filter("x.keys <> 0")
    inside = [F.array_contains("met", F.col(f"x.b{i}")) for i in range(BANDS)]
    kept = lines.filter(reduce(or_, inside) if bands == 1 else reduce(add, (c.cast("int") for c in inside)) >= bands)
    bucket = F.array_min(F.array_compact(F.array(*(F.when(c, F.col(f"x.b{i}")) for i, c in enumerate(inside)))))
    return kept.select("tbl", "site", "rec_id", (F.col("pos") + 1).alias("line_no"), F.col("x.keys").alias("key"), bucket.alias("cluster")), least


def repeated_lines(records: DataFrame, broadcast_numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """(tbl, site, rec_id, line_no) of every repeated line.

    ``records`` has tbl, site, rec_id and letters (see :func:`letters_of`).  A
    line counts from ten letters; it is repeated if at least three records and
    five per cent of all records of its site hold a line with the same letters.
    Records with null or empty text count in their site's total; a null site is
    a site of its own; redelivered keys count once; an empty table gives an
    empty result.
    """
    where = ["tbl", "site", "key"]
    found, least = _candidates(records, 1, broadcast_numbers)
    candidates = stored(found.drop("cluster"), "candidates")
    held = candidates.select("tbl", "site", "rec_id", F.col("key").alias("number")).distinct()
    confirmed = stored(_frequent(held, least).withColumnRenamed("number", "key"), "confirmed")
    if confirmed.count() <= broadcast_numbers:
        met = candidates.join(F.broadcast(confirmed), where, "left_semi")
    else:
        salted = confirmed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = candidates.withColumn("salt", F.pmod(F.xxhash64("rec_id"), F.lit(SALTS)).cast("int")).join(salted, [*where, "salt"], "left_semi")
    return met.select("tbl", "site", "rec_id", "line_no")


def near_repeated_lines(records: DataFrame, broadcast_numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """(tbl, site, rec_id, line_no, cluster) of every line in near-duplicate clusters of high document frequency.

    As :func:`repeated_lines`, but the clusters decide, with the same threshold;
    ``letters`` should be made from text :func:`without_names`.
    """
    found, _ = _candidates(records, NEAR_BANDS, broadcast_numbers)
    return found.select("tbl", "site", "rec_id", "line_no", "cluster")


def site_records(spark, sf_dir: str, names: bool = True) -> DataFrame:
    """All texts of the three tables with their site, as letters (without ``names`` if asked) and as delivered."""
    read = letters_of if names else lambda text, markup=False: letters_of(without_names(text), markup)
    candidates = table(spark, sf_dir, "candidates").select(
        F.lit("candidates").alias("tbl"), F.lower(F.try_parse_url("canonical_url", F.lit("HOST"))).alias("site"),
        F.col("candidate_id").alias("rec_id"), read(F.col("description")).alias("letters"),
        F.col("description").alias("text"),
    )
    us = table(spark, sf_dir, "us_recall").select(
        F.lit("us_recall").alias("tbl"), F.lit("").alias("site"), F.col("field_recall_number").alias("rec_id"),
        read(F.col("field_press_release"), markup=True).alias("letters"),
        F.col("field_press_release").alias("text"),
    )
    documents = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("tbl"), F.col("source").alias("site"), F.col("doc_id").cast("string").alias("rec_id"),
        read(F.col("text")).alias("letters"), "text",
    )
    return candidates.unionByName(us).unionByName(documents)


def without_lines(texts: DataFrame, repeated: DataFrame, id_col: str, text_col: str, tbl_col: str | None = None) -> DataFrame:
    """Every row of ``texts`` given back without its repeated lines (rows without any stay as they are).

    ``tbl_col`` is needed where ``texts`` holds several tables, since one id may stand in two of them.
    """
    keys = {"_rec": ("rec_id", F.col(id_col).cast("string"))} | ({"_tbl": ("tbl", F.col(tbl_col))} if tbl_col else {})
    numbers = repeated.groupBy(*(F.col(c).alias(k) for k, (c, _) in keys.items())).agg(F.collect_set("line_no").alias("_drop"))
    joined = texts.join(numbers, [own == F.col(k) for k, (_, own) in keys.items()], "left")
    kept = F.array_join(
        F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains("_drop", (i + 1).cast("int"))), "\n"
    )
    return joined.withColumn(text_col, F.when(F.col("_drop").isNull(), F.col(text_col)).otherwise(kept)).drop(*keys, "_drop")


def p2_found(spark, sf_dir: str) -> DataFrame:
    return repeated_lines(site_records(spark, sf_dir)).select("tbl", "rec_id", "line_no")


def p2_cleaned(spark, sf_dir: str) -> DataFrame:
    """Every record of the three tables once, (tbl, rec_id, text), without its repeated lines."""
    records = site_records(spark, sf_dir)
    texts = records.select("tbl", "rec_id", "text").dropDuplicates(["tbl", "rec_id"])
    return without_lines(texts, repeated_lines(records), "rec_id", "text", "tbl")


def p2_near_lines(spark, sf_dir: str) -> DataFrame:
    """Lines that lie in frequent clusters once names are masked; a superset of templates, not of TESTDATA's cases."""
    return near_repeated_lines(site_records(spark, sf_dir, names=False)).select("tbl", "rec_id", "line_no", "cluster")


P2_SQL = r"""
WITH r AS (
  SELECT DISTINCT 'candidates' AS tbl, lower(regexp_extract(canonical_url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS site, candidate_id AS rec_id, description AS text FROM candidates
  UNION SELECT 'us_recall', '', field_recall_number, regexp_replace(regexp_replace(field_press_release, '<[^>\n]*>', '', 'g'), '&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z0-9]+);', '', 'g') FROM us_recall
  UNION SELECT 'documents', coalesce(source, ''), doc_id::varchar, text FROM documents),
n AS (SELECT tbl, site, count(DISTINCT rec_id) AS total FROM r GROUP BY ALL),
l AS (SELECT tbl, site, rec_id, k AS line_no, regexp_replace(lower(ls[k]), '[^\p{L}]', '', 'g') AS key
  FROM (SELECT tbl, site, rec_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT *, string_split(text, chr(10)) AS ls FROM r WHERE text IS NOT NULL))),
f AS (SELECT tbl, site, key, count(DISTINCT rec_id) AS records FROM l WHERE length(key) >= 10 GROUP BY ALL)
SELECT l.tbl, l.rec_id, l.line_no::int AS line_no FROM l JOIN f ON f.tbl = l.tbl AND f.site = l.site AND f.key = l.key JOIN n ON n.tbl = l.tbl AND n.site = l.site
WHERE f.records >= 3 AND f.records >= 0.05 * n.total
"""

P2_CLEANED_SQL = f"""
WITH found AS ({P2_SQL}), n AS (SELECT tbl, rec_id, list(line_no) AS gone FROM found GROUP BY ALL),
t AS (SELECT DISTINCT 'candidates' AS tbl, candidate_id AS rec_id, description AS text FROM candidates
  UNION SELECT 'us_recall', field_recall_number, field_press_release FROM us_recall
  UNION SELECT 'documents', doc_id::varchar, text FROM documents)
SELECT t.tbl, t.rec_id, CASE WHEN gone IS NULL THEN text
  ELSE coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x, k: NOT list_contains(gone, k::int)), chr(10)), '') END AS text
FROM t LEFT JOIN n ON n.tbl = t.tbl AND n.rec_id = t.rec_id
"""
