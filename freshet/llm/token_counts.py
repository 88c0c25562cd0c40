"""Token counts of sections: whole documents are encoded once, token spans meet section spans.

A byte-level tokenizer loses nothing, so the running sum of its tokens' byte lengths gives every
token's span in the text, as bytes and from there as code points (a token holding part of a character
covers that character).  The spans of the sections are sorted and do not overlap; two binary
searches per token find the sections its first and its last code point lie in.

A token whose span touches more than one section goes by ``rule``:

    "first"   to the section of its first code point (to the first it touches, if that is in none)
    "most"    to the section with most of its code points, the earlier one of equals

A token that touches no section is counted as outside.  Sections and outside add up
to the document's tokens.

Defined results: a NULL or empty text has no tokens; sections of a text that end beyond it are cut
to it, empty and NULL spans count nothing.  Repeated rows and NULL ids stay.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, map_texts
from .pieces import encoder

RULES = ("first", "most")
OUT = "array<struct<section:int,start:long,end:long,n_tokens:long>>"


def token_spans(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First code point and end (exclusive) of tokens of the given byte lengths."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    if text.isascii():
        return starts, ends
    raw = np.frombuffer(text.encode(), np.uint8)
    point = np.cumsum((raw & 0xC0) != 0x80) - 1  # of every byte
    return point[starts], point[ends - 1] + 1


def line_sections(text: str) -> list[tuple[int, int]]:
    """Spans of the lines, each with its line feed."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, at + len(line) + 1))
        at += len(line) + 1
    out[-1] = (out[-1][0], len(text))
    return [s for s in out if s[1] > s[0]]


def allocate(starts: np.ndarray, ends: np.ndarray, sections: list[tuple[int, int]],
             rule: str) -> np.ndarray:
    """Tokens of every section; the sections ascend and do not overlap."""
    if not sections or not len(starts):
        return np.zeros(len(sections), np.int64)
    low = np.array([s for s, _ in sections])
    high = np.array([e for _, e in sections])
    if (low[1:] < high[:-1]).any() or (high < low).any():
        raise ValueError("sections must ascend and not overlap")
    a = np.searchsorted(high, starts, "right")  # first section that ends behind the token's start
    b = np.searchsorted(low, ends, "left") - 1  # last section that starts before its end
    goes = np.where(a <= b, a, -1)
    if rule == "most":
        for t in np.flatnonzero(b > a):
            over = np.minimum(high[a[t]:b[t] + 1], ends[t]) - np.maximum(low[a[t]:b[t] + 1], starts[t])
            goes[t] = a[t] + int(np.argmax(over))
    return np.bincount(goes[goes >= 0], minlength=len(sections))


def attribute(docs: DataFrame, tokenizer: str, *, sections: str | None = None, rule: str = "most",
              id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, doc_tokens, outside_tokens, sections) with an array of (section, start, end, n_tokens).

    sections   a column array<struct<start,end>> of code point spans; None takes the lines
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"),
                       *([F.col(sections).alias("sections")] if sections else []))
    table: dict[str, np.ndarray] = {}

    def fn(ids, texts, given=None):
        tokens = encoder(tokenizer)
        if not table:
            table["bytes"] = tokens.byte_lengths()
        totals, outside, out = [], [], []
        for i, (body, own) in enumerate(zip(texts, tokens.encode(texts))):
            body = body or ""
            starts, ends = token_spans(body, table["bytes"][own]) if len(own) else (own, own)
            if given is None:
                spans = line_sections(body)
            else:
                spans = [(s["start"], min(s["end"], len(body))) for s in given[i] or []
                         if s and None not in (s["start"], s["end"]) and s["start"] < min(s["end"], len(body))]
            counts = allocate(starts, ends, spans, rule)
            totals.append(len(own))
            outside.append(len(own) - int(counts.sum()))
            out.append([{"section": k, "start": a, "end": b, "n_tokens": int(c)}
                        for k, ((a, b), c) in enumerate(zip(spans, counts))])
        return [ids, totals, outside, out]

    kind = dict(rows.dtypes)["doc_id"]
    return map_texts(rows, fn, f"doc_id {kind}, doc_tokens long, outside_tokens long, sections {OUT}",
                     ("pieces",)) \
        .withColumnRenamed("doc_id", id_column)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: tokens of every line of every document; a document without text has one row."""
    found = attribute(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "doc_tokens", "outside_tokens", F.explode_outer("sections").alias("s")) \
        .select("doc_id", "doc_tokens", "outside_tokens", "s.section",
                F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"), "s.n_tokens")
