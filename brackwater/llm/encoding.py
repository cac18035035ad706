"""Restoring text that was decoded with the wrong character encoding.

1. Every distinct corpus word with a non-ASCII letter is taken once.  A word
   that no chain can have produced is clean.
2. All garbled forms of the clean words under all encoding chains make a table
   (form, original, chain).
3. The tokens of suspicious documents are hash-joined with the table.  The
   matched tokens decide the chain of their line; the line is turned back with
   it and accepted only if garbling the result gives the line again.  In a line
   that is not garbled as a whole the verified tokens are substituted one by one.

Only a match restores: a line whose tokens are all missing in the table (a name
that occurs nowhere else) takes the chain that the matches of its document
name, and a document without any match is left as it is.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chains of wrong decodings, tried in this order; a name twice is text garbled twice.
CHAINS: tuple[tuple[str, ...], ...] = (
    ("cp1252",), ("latin-1",), ("cp1250",), ("mac_roman",), ("cp850",), ("cp437",), ("iso8859-15",), ("iso8859-2",),
    ("cp1252", "cp1252"), ("latin-1", "latin-1"),
)
#: Chains whose garbled text shows byte A0 as a no-break space, which later handling may have turned into a space.
SPACED = tuple(c for c in CHAINS if not {"mac_roman", "cp850", "cp437"} & set(c))
LOST = "�"


def _lenient(encoding: str) -> str:
    """The 256 characters of an encoding; bytes it leaves undefined stand for themselves."""
    return "".join(bytes([b]).decode(encoding, errors="ignore") or chr(b) for b in range(256))


_FORWARD = {e: _lenient(e) for chain in CHAINS for e in chain}
_BACKWARD = {e: {ord(c): b for b, c in enumerate(t)} for e, t in _FORWARD.items()}


def garble(text: str, chain: tuple[str, ...]) -> str:
    """What ``text`` looks like after its UTF-8 bytes were read with each encoding in turn."""
    for encoding in chain:
        text = codecs.charmap_decode(text.encode("utf-8"), "strict", _FORWARD[encoding])[0]
    return text


def ungarble(text: str, chain: tuple[str, ...]) -> str | None:
    """The original of ``text`` under ``chain``; None if it cannot have come from it."""
    try:
        for encoding in reversed(chain):
            before = codecs.charmap_encode(text, "strict", _BACKWARD[encoding])[0].decode("utf-8")
            if before == text:
                return None
            text = before
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None
    return text


#: The bytes C2 and C3 as single-byte encodings show them, before a space.
_OPEN = re.compile("([\u00c2\u00c3\u0102]) ")


def reopened(line: str) -> str:
    """``line`` with a no-break space again where a plain space stands for byte A0."""
    return _OPEN.sub("\\1\u00a0", line)


def _plain(text: str) -> bool:
    return not any(unicodedata.category(c) in ("Co", "Cn", "Cs", "Cc") and c not in "\t\r" for c in text)


def _turned_back(line: str, chain: tuple[str, ...], spaced: bool) -> str | None:
    """The verified original of a line: garbling it gives the line again.

    ``spaced`` also tries no-break spaces where a plain space follows a lead byte.
    """
    before = ungarble(line, chain)
    if before is not None and _plain(before) and garble(before, chain) == line:
        return before
    if spaced and chain in SPACED and (again := reopened(line)) != line:
        before = ungarble(again, chain)
        if before is not None and _plain(before) and garble(before, chain).replace("\u00a0", " ") == line.replace("\u00a0", " "):
            return before
    return None


def _class(chars: set[str]) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(chars)) + "]"


#: Quick JVM test, a superset of every garbled text: two neighbours beyond ASCII, a lead byte before a space, or a lost character.
QUICK_PATTERN = r"[^\x00-\x7F]{2}|[\u00c2\u00c3\u0102] |\ufffd"
#: A lead byte and a continuation byte of UTF-8 as any encoding shows them (or a plain space for byte A0), or a lost character.
SUSPICIOUS = re.compile(
    _class({c for t in _FORWARD.values() for c in t[0xC2:0xF5]})
    + _class({c for t in _FORWARD.values() for c in t[0x80:0xC0]})
    + "|[\u00c2\u00c3\u0102] |"
    + LOST
)


_ASCII_CUT = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def tokens_of(text: str) -> set[str]:
    """Runs of ASCII letters and non-ASCII characters that hold at least one of the latter.

    Garbling changes no ASCII character and makes none, so a token and its
    garbled form have the same borders.
    """
    return {w.decode("utf-8") for w in set(text.encode("utf-8", "replace").translate(_ASCII_CUT).split()) if not w.isascii()}


def _distinct_tokens(docs: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and not text.isascii():
                    seen |= tokens_of(text)
            if len(seen) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], names=["token"])
                seen = set()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], names=["token"])

    return docs.select("text").mapInArrow(cut, "token string").distinct()


def _origins(token: str) -> bool:
    return any(ungarble(token, (e,)) is not None for e in _FORWARD)


@functools.lru_cache(maxsize=300_000)
def suspicious_token(token: str) -> bool:
    """At least one encoding turns the token back, or would if byte A0 followed it."""
    return _origins(token) or (token[-1] in "\u00c2\u00c3\u0102" and _origins(token + "\u00a0"))


def garbled_forms(tokens: DataFrame) -> DataFrame:
    """(form, original, chain) of every clean word under every chain."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, int]] = []
            for token in batch.column(0).to_pylist():
                if LOST not in token and not _origins(token):
                    seen = set()
                    for n, chain in enumerate(CHAINS):
                        form = garble(token, chain)
                        forms = [form] + [w for w in (tokens_of(form.replace("\u00a0", " ")) if chain in SPACED and "\u00a0" in form else ())]
                        for form in forms:
                            if (form, len(chain)) not in seen:
                                seen.add((form, len(chain)))
                                out.append((form, token, n))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))],
                names=["form", "original", "chain"],
            )

    return tokens.mapInArrow(make, "form string, original string, chain int")


def suspicious_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens that at least one encoding turns back, or that miss only byte A0 at their end."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [t for t in batch.column(0).to_pylist() if suspicious_token(t)]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["form"])

    return tokens.mapInArrow(keep, "form string")


@functools.lru_cache(maxsize=300_000)
def _chains_of(token: str, original: str, chain: int) -> tuple[int, ...]:
    """All chains that turn ``original`` into ``token``; the table names only the first of each length."""
    alike = (n for n, c in enumerate(CHAINS) if len(c) == len(CHAINS[chain]) and garble(original, c) == token)
    return tuple(dict.fromkeys((chain, *alike)))


def _restore_line(line: str, known: dict[str, list[tuple[str, int]]], usual: list[int]) -> str:
    tokens = tokens_of(line)
    if not any(map(suspicious_token, tokens)):
        return line
    votes = Counter(m for t in tokens for original, n in known.get(t, ()) for m in _chains_of(t, original, n))
    order = [n for n, _ in sorted(votes.items(), key=lambda v: (-v[1], v[0]))] + usual
    for n in dict.fromkeys(order):
        before = _turned_back(line, CHAINS[n], True)
        if before is not None:
            deeper = _turned_back(before, CHAINS[n], False) if n not in votes and len(CHAINS[n]) == 1 else None
            return before if deeper is None else deeper
    for token in sorted(tokens & known.keys(), key=len, reverse=True):
        line = line.replace(token, known[token][0][0])
    return line


def restore(text: str, known: dict[str, list[tuple[str, int]]]) -> str | None:
    """The original of a garbled text, "" if characters were lost, None if nothing is garbled."""
    if LOST in text:
        return ""
    found = Counter(m for form, pairs in known.items() for original, n in pairs for m in _chains_of(form, original, n))
    usual = [n for n, _ in sorted(found.items(), key=lambda v: (-v[1], v[0]))]
    restored = "\n".join(x if x.isascii() or not SUSPICIOUS.search(x) else _restore_line(x, known, usual) for x in text.split("\n"))
    return None if restored == text else restored


def _suspects(docs: DataFrame) -> DataFrame:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            held = [
                i for i, t in enumerate(texts)
                if LOST in t or any(any(map(suspicious_token, tokens_of(x))) for x in t.split("\n") if SUSPICIOUS.search(x))
            ]
            yield batch.take(pa.array(held, pa.int32()))

    return docs.select("doc_id", "text").mapInArrow(keep, "doc_id bigint, text string")


def restore_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, restored, text_md5) of every document that holds garbled characters.

    ``restored`` is the original text, or "" where characters were lost (the
    replacement character stands in the text).  Null and empty texts, and texts
    without garbled characters, give no row; a repeated doc_id counts once; other columns are ignored; an empty table gives an
    empty result.
    """
    docs = docs.select("doc_id", "text")
    suspects = _suspects(docs.filter(F.col("text").rlike(QUICK_PATTERN))).dropDuplicates(["doc_id"])
    tokens = _distinct_tokens(docs)
    matched = (
        garbled_forms(tokens)
        .join(suspicious_tokens(_distinct_tokens(suspects)), "form")
        .groupBy("form")
        .agg(F.array_sort(F.collect_set(F.struct("chain", "original"))).alias("origins"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, forms = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for token in filter(suspicious_token, tokens_of(text)):
                    ids.append(doc_id)
                    forms.append(token)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(forms, pa.string())], names=["doc_id", "form"])

    known = (
        suspects.mapInArrow(cut, "doc_id bigint, form string")
        .join(matched, "form")
        .groupBy("doc_id")
        .agg(F.collect_set(F.struct("form", "origins")).alias("known"))
    )

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, sums = [], [], []
            for doc_id, text, pairs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                table = {p["form"]: [(o["original"], o["chain"]) for o in p["origins"]] for p in pairs or ()}
                found = restore(text, table)
                if found is not None:
                    ids.append(doc_id)
                    texts.append(found)
                    sums.append(hashlib.md5(found.encode("utf-8")).hexdigest() if found else "")
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(sums, pa.string())],
                names=["doc_id", "restored", "text_md5"],
            )

    return suspects.join(known, "doc_id", "left").select("doc_id", "text", "known").mapInArrow(
        mend, "doc_id bigint, restored string, text_md5 string"
    )


def p10_found(spark, sf_dir: str) -> DataFrame:
    from brackwater.runtime import table

    return restore_documents(table(spark, sf_dir, "documents")).select("doc_id", "text_md5")
