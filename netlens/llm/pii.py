"""Personal data in texts: patterns propose, checksums confirm, context scores.

Kinds ``email``, ``ip``, ``card`` (16-19 digits, Luhn) and ``phone`` (leading +)
are reported whenever the pattern and its check hold.  The kinds below are
weaker patterns, reported only if their score reaches ``MIN_SCORE``:

* ``iban``        country code, two check digits, mod-97 equal to 1
* ``short_card``  13-15 digits, Luhn, issuer prefix; needs a context word
* ``ssn``         ddd-dd-dddd outside the never-issued ranges; needs a context word

A span's score is its kind's base value, raised when a context word of the kind
stands within ``CONTEXT`` characters on either side.  Offsets are code points,
end exclusive.  Null and empty texts have no spans; long texts are scanned
whole, in time linear in their length (every pattern starts at the beginning of
its run, so no run is scanned twice).  Work is per document: no shuffle.
"""
from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import slices

KINDS = ("email", "ip", "card", "phone", "iban", "short_card", "ssn")
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7,
              "iban": 0.9, "short_card": 0.45, "ssn": 0.4}
CONTEXT_BONUS = 0.3
MIN_SCORE = 0.6
CONTEXT = 48
CONTEXT_WORDS = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "short_card": ("card", "amex", "credit", "karte", "carte", "tarjeta"),
    "ssn": ("ssn", "social security", "social-security"),
}

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
#: card issuers with 13-15 digits
ISSUER = re.compile(r"3[47]|4|30[0-5]|3[68]")
HAS_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str):
    """Local part @ domain, leftmost and non-overlapping, one look per @ sign."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            # no match through this @: the local part of the next one starts after it
            free, at = max(free, at + 1), text.find("@", at + 1)


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def candidates(text: str):
    """(kind, start, end) of every span that passes its check."""
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b
    if not HAS_DIGIT.search(text):
        return
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
               for p in m.group().split(".")):
            yield "ip", m.start(), m.end()
    for m in DIGITS.finditer(text):
        if m.end() - m.start() < 13:
            continue
        d = only_digits(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
        elif 13 <= len(d) <= 15 and ISSUER.match(d) and luhn(d):
            yield "short_card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(only_digits(m.group())) <= 15:
                yield "phone", m.start(), m.end()
    for m in IBAN.finditer(text):
        s = m.group().replace(" ", "")
        if 15 <= len(s) <= 34 and mod97(s):
            yield "iban", m.start(), m.end()
    for m in SSN.finditer(text):
        a, g, n = m.groups()
        if a not in ("000", "666") and a[0] != "9" and g != "00" and n != "0000":
            yield "ssn", m.start(), m.end()


_CONTEXT_RE = {k: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, v)) + r")(?!\w)", re.I)
               for k, v in CONTEXT_WORDS.items()}
_ALWAYS = frozenset(KINDS[:4])


def find_spans(text: str) -> list[dict]:
    """Spans by kind (in KINDS order), then start."""
    out = []
    for kind, a, b in candidates(text):
        # a blank beside the span keeps words cut by the context's edge from matching
        near = text[max(0, a - CONTEXT):a] + " " + text[b:b + CONTEXT]
        score = BASE_SCORE[kind] + CONTEXT_BONUS * bool(_CONTEXT_RE[kind].search(near))
        if kind in _ALWAYS or score >= MIN_SCORE:
            out.append({"kind": kind, "start": a, "end": b, "score": min(1.0, score)})
    out.sort(key=lambda s: (KINDS.index(s["kind"]), s["start"]))
    return out


def redact(text: str, spans: list[dict]) -> str:
    """The text with every span replaced by [KIND]; overlapping spans become one."""
    parts, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            parts += [text[at:s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join(parts) + text[at:]


SPAN_TYPE = "array<struct<kind:string,start:int,end:int,score:double>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()),
                                   ("end", pa.int32()), ("score", pa.float64())]))


def detect(df: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(key, spans[, text redacted]) for every row."""
    src = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    schema = f"key {kind}, spans {SPAN_TYPE}" + ", text string" * with_text

    def run(batches):
        for b in slices(batches):
            texts = b["text"].to_pylist()
            spans = [find_spans(t) if t else [] for t in texts]
            cols, names = [b["key"], pa.array(spans, _ARROW_SPANS)], ["key", "spans"]
            if with_text:
                cols.append(pa.array([t and redact(t, s) for t, s in zip(texts, spans)], pa.string()))
                names.append("text")
            yield pa.record_batch(cols, names=names)

    return src.mapInArrow(run, schema).withColumnsRenamed({"key": key, "text": text})


def redact_column(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows with every span in the text replaced; other columns as they were."""
    place = df.columns.index(text)

    def run(batches):
        for b in slices(batches):
            texts = [t and redact(t, find_spans(t)) for t in b.column(place).to_pylist()]
            yield b.set_column(place, text, pa.array(texts, pa.string()))

    return df.mapInArrow(run, df.schema)


def digest_columns(df: DataFrame) -> DataFrame:
    """Counts and joined spans of (doc_id, spans) rows."""
    shown = lambda kinds: F.array_join(F.transform(
        F.filter("spans", lambda s: s["kind"].isin(*kinds)),
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return df.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:4]],
                     F.sha2(shown(KINDS[:4]), 256).alias("base_sha256"),
                     shown(KINDS).alias("spans"))
