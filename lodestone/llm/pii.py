"""Personal data in whole texts: spans proposed by patterns, confirmed by checksums, weighed by context.

Four base kinds are kept whenever their rule holds: email, ip (parts at most 255), card (13 to 19
digits, Luhn) and phone (9 to 15 digits after a plus). The other kinds are kept when pattern,
checksum and nearby words together reach `THRESHOLD`, and no base span overlaps them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import table

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "local_phone")
THRESHOLD = 0.5
#: Code points on either side of a span in which context words count.
CONTEXT = 40

#: Score of a kind by itself, and the words that raise it when they stand nearby.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.7, "ssn": 0.3, "local_phone": 0.2}
WORDS = {
    "email": ("email", "mail", "e-mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
}
#: Words that lower a score: numbers so called are not personal.
AGAINST = ("version", "isbn", "order", "serial", "sku")
_NEAR = {k: re.compile(r"\b(?:%s)\b" % "|".join(map(re.escape, v)), re.I) for k, v in WORDS.items()}
_AGAINST = re.compile(r"\b(?:%s)\b" % "|".join(AGAINST), re.I)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match can't begin within a run of digits without beginning at its start, so the look-behind only saves time.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
# Runs under 13 digits fail anyway.
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")

RESULT = "kinds array<string>, starts array<int>, ends array<int>, scores array<double>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain: every @ has at most one, which starts where its local run does."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start; positions are code points, the end exclusive."""
    if not text:
        return []
    found = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(y := x.lstrip("0")) < 4 and int(y or 0) <= 255 for x in m.groups())]
        found += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
        taken = merged(x[1:] for x in found)
        for kind, pattern, valid in (("iban", _IBAN, mod97), ("ssn", _SSN, None), ("local_phone", _LOCAL_PHONE, None)):
            for m in pattern.finditer(text):
                a, b = m.span()
                if (valid is None or valid(m[0])) and not overlaps(taken, a, b) and score(text, kind, a, b) >= THRESHOLD:
                    found.append((kind, a, b))
    return [(kind, a, b, score(text, kind, a, b)) for kind, a, b in found]


def merged(found: Iterable[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover, in order."""
    starts, ends = [], []
    for a, b in sorted(found):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def overlaps(taken: tuple[list[int], list[int]], a: int, b: int) -> bool:
    i = bisect_left(taken[0], b)
    return i > 0 and taken[1][i - 1] > a


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
    return round(min(1.0, max(0.0, SCORES[kind] + 0.3 * bool(_NEAR[kind].search(near)) - 0.3 * bool(_AGAINST.search(near)))), 2)


def find_pii(text: Column) -> Column:
    """Arrays of the spans' kinds, starts, ends and scores; empty for null and empty text."""

    @arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            all_spans = [spans(t.as_py()) for t in texts]
            parts = [pa.array([[s[i] for s in row] for row in all_spans], pa.list_(kind)) for i, kind in enumerate((pa.string(), pa.int32(), pa.int32(), pa.float64()))]
            yield pa.StructArray.from_arrays(parts, ["kinds", "starts", "ends", "scores"])

    return run(text)


def mask(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; spans that overlap are replaced as one."""
    if not text or not (found := sorted((a, b, k) for k, a, b, _ in spans(text))):
        return text
    out, done = [], 0
    for a, b, kind in found:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def mask_pii(text: Column) -> Column:
    """Null and empty texts stay as they are."""

    @arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([mask(t.as_py()) for t in texts], pa.string())

    return run(text)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", find_pii(F.col("text")).alias("p")).select("doc_id", "p.*")
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    listed = F.transform(F.sequence(F.lit(0), F.size("kinds") - 1), lambda i: F.concat_ws(":", F.get("kinds", i), F.get("starts", i).cast("string"), F.get("ends", i).cast("string")))
    listed = F.when(F.size("kinds") > 0, listed).otherwise(F.array().cast("array<string>"))
    rows = docs.withColumn("listed", listed)
    base = F.array_join(F.filter("listed", lambda s: F.split(s, ":")[0].isin(*BASE)), ",")
    return rows.select("doc_id", *map(count, BASE), F.sha2(base, 256).alias("base_sha256"), F.array_join("listed", ",").alias("spans"), F.array_join(F.transform("scores", lambda x: x.cast("string")), ",").alias("scores"))
