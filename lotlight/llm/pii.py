"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Offsets are code points, ends exclusive. The four base kinds follow fixed
patterns and all stay. The added kinds stay from `min_score` on, and words near a
span, its own text not counted, decide on most: an opaque token is a secret only
where a word such as "password" stands near, a bare number an account or a passport
only near such a word, and an account number with a right checksum (iban) goes
where a word speaks against it and none for it.
Every pattern runs in time linear in the text: no run of digits or letters is
entered twice.

Defined results: a null text counts as empty and has no spans; a very long text is
read whole, in one task; of spans that start together the kind listed first comes
first; equal rows get equal results; an empty table gives an empty one; other
columns pass through unless named like the added one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "secret", "number")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match that fails at the start of a run of digits fails at each later start in it.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{8,}+")
KEY_ID = re.compile(r"AKIA[0-9A-Z]{16}")
NUMBER = re.compile(r"(?<![0-9A-Za-z+./-])[0-9](?:-?[0-9]){5,17}+(?![0-9A-Za-z/]|-[0-9])")
# Lengths of an IBAN by country, fixed by its registry.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}

# Words near a span that speak for it or against it.
FOR = {
    "email": ("mail", "e-mail", "contact", "write", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "payment", "carte", "karte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "secret": ("key", "apikey", "api_key", "secret", "password", "passwd", "pwd", "token", "login", "credential", "bearer", "passwort", "contraseña"),
    "number": ("account", "passport", "ssn", "social security", "licence", "license number", "konto", "kontonummer", "ausweis", "compte", "passeport", "cuenta", "pasaporte"),
}
AGAINST = {
    "email": ("noreply", "no-reply"),
    "ip": ("version", "release", "section"),
    "card": ("order", "isbn", "tracking", "serial"),
    "phone": ("version", "order"),
    "iban": ("isbn", "serial", "example"),
    "secret": ("placeholder", "dummy", "checksum", "sha256", "commit", "example"),
    "number": ("order", "isbn", "tracking", "serial", "version", "example"),
}
WORDS = {side: {k: re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, w))})(?!\w)", re.I) for k, w in words.items()} for side, words in (("for", FOR), ("against", AGAINST))}


@dataclass(frozen=True)
class PiiParams:
    proposed: float = 0.3
    confirmed: float = 0.4
    context: float = 0.2
    against: float = 0.3
    #: Code points before a span, and half as many after it, in which words count.
    reach: int = 40
    min_score: float = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "").upper()
    if IBAN_LENGTHS.get(s[:2], len(s)) != len(s) or not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """By their @, which neither the local part nor the domain can hold."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def proposals(text: str, p: PiiParams = PiiParams()) -> Iterator[tuple[str, int, int, bool]]:
    """Kind, start, end, and whether a checksum or form has confirmed it; base kinds only if confirmed."""
    for a, b in _emails(text):
        yield "email", a, b, True
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            yield "ip", m.start(), m.end(), True
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end(), True
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end(), True
    for m in IBAN.finditer(text):
        if mod97(m[0]):
            yield "iban", m.start(), m.end(), True
    # Without a word that speaks for them these can't reach the score, and most texts have none.
    alone = p.proposed >= p.min_score
    if alone or "AKIA" in text or WORDS["for"]["secret"].search(text):
        for m in TOKEN.finditer(text):
            yield "secret", m.start(), m.end(), bool(KEY_ID.fullmatch(m[0]))
    if alone or WORDS["for"]["number"].search(text):
        for m in NUMBER.finditer(text):
            yield "number", m.start(), m.end(), False


def _said(words: re.Pattern, text: str, lo: int, hi: int) -> bool:
    """Whether one of the words stands between two places of a text, as a whole word of that text."""
    return any(m.end() < hi or hi == len(text) or not (text[hi].isalnum() or text[hi] == "_") for m in words.finditer(text, lo, hi))


def score(text: str, kind: str, a: int, b: int, confirmed: bool, p: PiiParams = PiiParams()) -> float:
    """Of a span, from its checksum and the words around it."""
    around = (max(0, a - p.reach), a), (b, min(len(text), b + p.reach // 2))
    says = lambda side: any(_said(WORDS[side][kind], text, *x) for x in around)
    value = p.proposed + p.confirmed * confirmed + p.context * says("for") - p.against * says("against")
    return round(min(1.0, max(0.0, value)), 3)


def find_spans(text: str, p: PiiParams = PiiParams()) -> list[tuple[str, int, int, float]]:
    """Kind, start, end, score, in order. A bare number inside another span is none."""
    out: list[tuple[str, int, int, float]] = []
    for kind, a, b, confirmed in proposals(text, p):
        value = score(text, kind, a, b, confirmed, p)
        if kind in BASE_KINDS or value >= p.min_score and not (kind == "number" and any(x < b and a < y for _, x, y, _ in out)):
            out.append((kind, a, b, value))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def masked(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """`text` with each span, or run of overlapping spans, replaced by its first kind in angle brackets."""
    out, done, k = [], 0, 0
    while k < len(spans):
        kind, start, end, _ = spans[k]
        while k + 1 < len(spans) and spans[k + 1][1] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [text[done:start], f"<{kind.upper()}>"]
        done, k = end, k + 1
    return "".join([*out, text[done:]])


def find_pii(docs: DataFrame, p: PiiParams = PiiParams()) -> DataFrame:
    """`docs` with `pii`, the spans of `text` with kinds and scores."""
    df = docs.drop("pii")
    schema = T.StructType([*df.schema.fields, T.StructField("pii", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ("kind", "start", "end", "score")
        for b in batches:
            spans = [[dict(zip(keys, s)) for s in find_spans(x.as_py() or "", p)] for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, kind)], [*b.schema.names, "pii"])

    return df.mapInArrow(run, schema)


def mask_pii(docs: DataFrame, p: PiiParams = PiiParams()) -> DataFrame:
    """`docs` with the personal data in `text` replaced; null texts stay null."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = (x.as_py() for x in b.column(at))
            clean = pa.array([t if t is None else masked(t, find_spans(t, p)) for t in texts], b.column(at).type)
            yield pa.RecordBatch.from_arrays([clean if k == at else c for k, c in enumerate(b.columns)], b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def with_digests(found: DataFrame) -> DataFrame:
    """The counts and digests of `find_pii`'s spans, and the spans' scores in their order."""
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda kind: F.filter("pii", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("pii")).alias("spans"), F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))
