"""Language of records and of single lines, with a calibrated confidence.

A sparse multinomial logistic regression on TF-IDF weights of hashed character
n-grams is trained with follow-the-regularised-leader and elastic-net penalties
on a bounded sample of labelled documents, then calibrated by a temperature on
held-out lines.  Wrong labels in the sample are handled by a second round
without the lines that the first round's model contradicts.  The trained model
is a small dense table; it scores all lines of all texts in vectorised passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brackwater.runtime import table

LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pl", "pt")
#: Codes and names by which a label can name a language.
LABELS = {
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "en": ("en", "eng", "english"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "pl": ("pl", "pol", "polish", "polski"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
}
ORDERS = (2, 3, 4)
BITS = 16
#: Labelled documents taken for training from each language (those with the smallest hash of their id).
TRAIN_DOCUMENTS = 150
#: A line's language is told from this many letters and spaces on, and counts as foreign from this confidence on.
LEAST_CHARS = 12
FOREIGN_CONFIDENCE = 0.8

_KEYS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def label_language(label: Column) -> Column:
    """Two-letter code of the language a label names (code, regional form or name); null if none."""
    tidy = F.lower(F.trim(label))
    primary = F.regexp_extract(tidy, r"^([^-_\s(]+)", 1)
    result = F.lit(None).cast("string")
    for code, names in LABELS.items():
        result = F.when(primary.isin(*names), F.lit(code)).otherwise(result)
    return result


def script_of(text: Column) -> Column:
    """Letters in lower case; everything else but line ends becomes single spaces."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\n]+", " ")


def _features(lines: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram order: hashed features of all positions and the border pairs of the lines."""
    codes = np.frombuffer("\n".join(lines).encode("utf-32-le"), dtype=np.uint32)
    lengths = np.fromiter((len(x) for x in lines), dtype=np.int64, count=len(lines))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    for order in ORDERS:
        count = len(codes) - order + 1
        mixed = np.full(count, order, dtype=np.uint32)
        for k in range(order):
            mixed = (mixed ^ codes[k : k + count]) * _KEYS[k]
            mixed ^= mixed >> np.uint32(15)
        borders = np.empty(2 * len(lines), dtype=np.int64)
        borders[0::2] = starts
        borders[1::2] = starts + lengths - order + 1
        yield (mixed >> np.uint32(32 - BITS)).astype(np.int64), borders[:-1] if borders[-1] >= count else borders


@dataclass
class Model:
    """Weights already multiplied by idf, squared idf for the norms, and the temperature."""

    weights: np.ndarray
    squares: np.ndarray
    temperature: float = 1.0

    def scores(self, lines: list[str]) -> np.ndarray:
        total = np.zeros((len(lines), len(LANGUAGES)), dtype=np.float32)
        norm = np.zeros(len(lines), dtype=np.float32)
        for features, borders in _features(lines):
            total += np.add.reduceat(self.weights[features], borders, axis=0)[0::2]
            norm += np.add.reduceat(self.squares[features], borders)[0::2]
        return total / np.sqrt(np.maximum(norm, 1e-6))[:, None]

    def probabilities(self, lines: list[str]) -> np.ndarray:
        s = self.scores(lines) / self.temperature
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _ftrl(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, passes: int, seed: int) -> np.ndarray:
    """Multinomial FTRL-proximal with L1 and L2 penalties; samples are (features, values)."""
    alpha, beta, l1, l2 = 0.6, 1.0, 0.02, 0.0005
    z = np.zeros((1 << BITS, len(LANGUAGES)))
    n = np.zeros_like(z)
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(samples)):
            at, x = samples[i]
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + root) / alpha + l2), 0.0)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            g = x[:, None] * p
            squared = ni + g * g
            z[at] = zi + g - (np.sqrt(squared) - root) / alpha * w
            n[at] = squared
    return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)


def fit(lines: list[str], labels: list[int], seed: int = 7) -> Model:
    """Train, clean the labels once, train again and calibrate on every tenth line."""
    per_line: list[list[np.ndarray]] = [[] for _ in lines]
    for features, _ in _features(lines):
        at = 0
        for held, text in zip(per_line, lines):
            held.append(features[at : max(at, at + len(text) - 3)])
            at += len(text) + 1
    counted = [np.unique(np.concatenate(p), return_counts=True) for p in per_line]
    seen = np.zeros(1 << BITS)
    for at, _ in counted:
        seen[at] += 1
    idf = np.log((1 + len(lines)) / (1 + seen)) + 1.0
    samples = []
    for at, n in counted:
        x = n * idf[at]
        samples.append((at, x / max(np.sqrt((n * idf[at] ** 2).sum()), 1e-6)))
    wanted = np.asarray(labels)
    held_out = np.arange(len(lines)) % 10 == 9
    rows = np.flatnonzero(~held_out)
    model = None
    for passes in (1, 2):
        weights = _ftrl([samples[i] for i in rows], wanted[rows], passes, seed)
        model = Model((weights * idf[:, None]).astype(np.float32), (idf**2).astype(np.float32))
        sure = model.probabilities(lines)
        guess = sure.argmax(axis=1)
        rows = np.flatnonzero(~held_out & ~((guess != wanted) & (sure.max(axis=1) > 0.6)))
    test = np.flatnonzero(held_out & ((guess == wanted) | (sure.max(axis=1) <= 0.6)))
    if len(test):
        s = model.scores([lines[i] for i in test])
        loss = []
        grid = np.geomspace(0.05, 5.0, 60)
        for t in grid:
            e = s / t - (s / t).max(axis=1, keepdims=True)
            loss.append(-(e[np.arange(len(test)), wanted[test]] - np.log(np.exp(e).sum(axis=1))).mean())
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def training_lines(documents: DataFrame, per_language: int = TRAIN_DOCUMENTS) -> tuple[list[str], list[int]]:
    """Lines of the labelled sample: at most ``per_language`` documents for each language, whole.

    The documents are chosen by id and label alone; only their texts are read.
    """
    named = documents.select("doc_id", label_language(F.col("lang")).alias("lang"), (F.length("text") > 0).alias("held")).filter("lang IS NOT NULL AND held")
    order = Window.partitionBy("lang").orderBy("place", "doc_id")
    ranked = named.select("lang", "doc_id", F.xxhash64("doc_id").alias("place")).distinct()
    chosen = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_language).select("lang", "doc_id")
    # At most ``per_language`` documents for each of the eight languages.
    texts = documents.join(F.broadcast(chosen.withColumnRenamed("lang", "told")), "doc_id").select("told", script_of(F.col("text")).alias("script")).distinct()
    lines, labels = [], []
    for row in sorted((r for r in texts.collect() if r.script), key=lambda r: (r.told, r.script)):
        for line in row.script.split("\n"):
            line = f" {line.strip()} "
            if len(line) >= LEAST_CHARS:
                lines.append(line)
                labels.append(LANGUAGES.index(row.told))
    return lines, labels


_OUT = "tbl string, rec_id string, line_no int, lang string, confidence double, declared string"


def identify(records: DataFrame, model: Model, lines_wanted: tuple[str, ...]) -> DataFrame:
    """Language of each record (line_no 0) and of each line in another language than most of its text.

    ``records`` has tbl, rec_id, declared (a language code or null) and script
    (see :func:`script_of`).  Texts without a line of at least LEAST_CHARS
    characters give no row; lines are numbered from 1; foreign lines are given
    for the tables in ``lines_wanted``.  A redelivered record gives equal rows
    again.
    """
    shared = records.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            out: list[tuple] = []
            todo: list[tuple] = []
            size = 0
            for tbl, rec_id, declared, script in zip(*columns):
                held = [(i, f" {x} ") for i, x in enumerate((y.strip() for y in (script or "").split("\n")), 1) if len(x) + 2 >= LEAST_CHARS]
                if held:
                    todo.append((tbl, rec_id, declared, held))
                    size += len(script)
                if size > 300_000:
                    out += _judged(model, todo, lines_wanted)
                    todo, size = [], 0
            if todo:
                out += _judged(model, todo, lines_wanted)
            types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(types)],
                names=["tbl", "rec_id", "line_no", "lang", "confidence", "declared"],
            )

    return records.select("tbl", "rec_id", "declared", "script").mapInArrow(scan, _OUT)


def _judged(model: Model, todo: list[tuple], lines_wanted: tuple[str, ...]) -> list[tuple]:
    lines = [x for _, _, _, held in todo for _, x in held]
    sure = model.probabilities(lines)
    lengths = np.fromiter((len(x) for x in lines), dtype=np.float64, count=len(lines))
    firsts = np.concatenate(([0], np.cumsum([len(h) for _, _, _, h in todo])[:-1]))
    whole = np.add.reduceat(sure * lengths[:, None], firsts, axis=0)
    whole /= whole.sum(axis=1, keepdims=True)
    main = whole.argmax(axis=1)
    guess, best = sure.argmax(axis=1), sure.max(axis=1)
    out = []
    for k, (tbl, rec_id, declared, held) in enumerate(todo):
        out.append((tbl, rec_id, 0, LANGUAGES[main[k]], float(whole[k, main[k]]), declared))
        if tbl in lines_wanted:
            for j, (number, _) in enumerate(held, firsts[k]):
                if guess[j] != main[k] and best[j] >= FOREIGN_CONFIDENCE:
                    out.append((tbl, rec_id, number, LANGUAGES[guess[j]], float(best[j]), declared))
    return out


def language_records(spark, sf_dir: str) -> DataFrame:
    """The texts and labels of the three tables."""
    parts = (("documents", "doc_id", "lang", "text"), ("candidates", "candidate_id", "language", "description"), ("incidents", "incident_id", "original_language", "summary"))
    found = None
    for name, key, label, text in parts:
        part = table(spark, sf_dir, name).select(
            F.lit(name).alias("tbl"), F.col(key).cast("string").alias("rec_id"), label_language(F.col(label)).alias("declared"), script_of(F.col(text)).alias("script")
        )
        found = part if found is None else found.unionByName(part)
    return found


def p7_languages(spark, sf_dir: str) -> DataFrame:
    """Every record and foreign line with language and confidence."""
    model = fit(*training_lines(table(spark, sf_dir, "documents")))
    found = identify(language_records(spark, sf_dir), model, ("documents", "candidates"))
    return found.dropDuplicates(["tbl", "rec_id", "line_no"])


def p7_found(spark, sf_dir: str) -> DataFrame:
    model = fit(*training_lines(table(spark, sf_dir, "documents")))
    found = identify(language_records(spark, sf_dir), model, ("documents", "candidates"))
    wrong = (F.col("line_no") > 0) | F.col("declared").isNull() | (F.col("declared") != F.col("lang"))
    return found.filter(wrong).select("tbl", "rec_id", "line_no", "lang").distinct()
