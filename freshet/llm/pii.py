"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

``find(docs)`` gives every row of ``docs`` as (id, spans), ``spans`` being an array of
(kind, start, end, score) with code point offsets, the end exclusive, ordered by kind as in
``KINDS`` and then by start.  ``redact(docs)`` replaces the spans in the text.

========  ==========================================  =======================  ==============
kind      proposed by                                 confirmed by             base score
========  ==========================================  =======================  ==============
email     local part, @, two or more labels           -                        0.9
ip        four dotted numbers                         parts at most 255        0.7
card      digits with single spaces or hyphens        13 to 19 digits, Luhn    0.8
phone     + and digits with the usual marks           9 to 15 digits           0.6
iban      country, two digits, groups                 length, mod 97           0.9
national  ddd-dd-dddd                                 ranges in use            0.3
========  ==========================================  =======================  ==============

A word of the kind's context list within ``CONTEXT`` characters before the span adds 0.35.
The first four kinds are always kept; the other two from a score of 0.5 on, so that a national
number counts only beside a word that names it.

NULL and empty texts have no spans.  Repeated rows come out repeated, a NULL id stays.  The
patterns run in time linear in the text: no run of characters is tried from more than one start.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, map_texts, only, small_batches

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "iban", "national"]
CONTEXT = 40
KEEP_FROM = 0.5
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.6, "iban": 0.9, "national": 0.3}
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"

# fixed values: words that name the kinds
CONTEXT_WORDS = {
    "email": "email e-mail mail contact correo courriel",
    "ip": "ip host server address login",
    "card": "card credit visa mastercard amex payment karte carte tarjeta",
    "phone": "phone call tel telephone mobile fax telefon",
    "iban": "iban account bank konto compte cuenta",
    "national": "ssn social security",
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_WORDS = {k: re.compile(rf"(?<![^\W_])(?:{'|'.join(map(re.escape, v.split()))})(?![^\W_])", re.I)
          for k, v in CONTEXT_WORDS.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    """From every @ with a domain behind it, the local part is what leads up to it."""
    done = 0
    if "@" not in text:
        return
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def _proposed(text: str):
    for start, end in _emails(text):
        yield "email", start, end
    for m in _IP.finditer(text):
        # more than three significant digits exceed 255 without being turned into a number
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                yield "card", m.start(), m.end()
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        bare = m[0].replace(" ", "")
        if 15 <= len(bare) <= 34 and mod97(bare):
            yield "iban", m.start(), m.end()
    for m in _NATIONAL.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield "national", m.start(), m.end()


def spans(text: str | None) -> list[dict]:
    """Spans of one text, by kind and start."""
    out = []
    for kind, start, end in _proposed(text or ""):
        score = SCORES[kind]
        if _WORDS[kind].search(text[max(0, start - CONTEXT):start]):
            score = min(1.0, score + 0.35)
        if kind in BASE_KINDS or score >= KEEP_FROM:
            out.append({"kind": kind, "start": start, "end": end, "score": round(score, 2)})
    return out


def redacted(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets.

    Spans that overlap are replaced together, from the first start to the last end, by the kind of the one
    that starts first (the longest of these).
    """
    if not text:
        return text
    found = sorted(spans(text), key=lambda s: (s["start"], -s["end"]))
    parts, at = [], 0
    for s in found:
        if s["start"] >= at:
            parts += [text[at:s["start"]], f"<{s['kind'].upper()}>"]
        at = max(at, s["end"])
    return "".join([*parts, text[at:]])


def find(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return map_texts(rows, lambda ids, texts: [ids, [spans(t) for t in texts]],
                     f"doc_id {kind}, spans {SPANS}", ()).withColumnRenamed("doc_id", id_column)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the text redacted; all other columns as they are."""
    at = docs.columns.index(text)
    small_batches(docs.sparkSession)

    def run(batches):
        only()
        for b in batches:
            clean = pa.array([redacted(t) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(
                [clean if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: digest columns of every document's spans."""
    found = find(documents(spark, sf_dir))

    def joined(which):
        return F.concat_ws(",", F.transform(which, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    base = F.filter("spans", lambda s: s["kind"].isin(BASE_KINDS))
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))
