"""Spans against the plain patterns, and digests against a second computation."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from freshet.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def digits(s):
    return re.sub(r"[^0-9]", "", s)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


KEEP = {
    "email": lambda s: True,
    "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
    "card": lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s)),
    "phone": lambda s: 9 <= len(digits(s)) <= 15,
}


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if KEEP[k](m[0])]


def base(text):
    return [(s["kind"], s["start"], s["end"]) for s in pii.spans(text) if s["kind"] in pii.BASE_KINDS]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("a0125.@-+ ()é"), max_size=60))
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert base(text) == plain(text)


@pytest.mark.parametrize("text", [
    "mail a.b+c@x-y.example.com. now", "a@b@c.d e@f.g.h@i.j", "1.2.3.4.5.6.7.8 999.1.1.1 0255.0.0.1 00000000001.1.1.1",
    "4111 1111 1111 1111 and 4111111111111112", "4111-1111-1111-1111-", "+1 (212) 555-0100 +12345678 +1((((", "", "é😀 a@b.c"])
def test_cases(text):
    assert base(text) == plain(text)


def test_added_kinds_and_scores():
    found = pii.spans("bank account GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33")
    assert [(s["kind"], s["start"], s["score"]) for s in found if s["kind"] == "iban"] == [("iban", 13, 1.0)]
    assert not [s for s in pii.spans("code 123-45-6789") if s["kind"] == "national"]
    assert [s["score"] for s in pii.spans("SSN: 123-45-6789") if s["kind"] == "national"] == [0.65]
    alone, named = pii.spans("x 10.0.0.1")[0], pii.spans("server 10.0.0.1")[0]
    assert alone["score"] == 0.7 and named["score"] == 1.0


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "+" + "1" * 200_000, "a.a" * 60_000 + "@",
                                  "1." * 100_000, "A" * 200_000, "@a" * 100_000, "GB82" * 50_000])
def test_long_runs_take_linear_time(text):
    import time

    start = time.process_time()
    pii.spans(text)
    assert time.process_time() - start < 5


def test_query_columns(spark, tmp_path, make, odd):
    rows = odd + [(50, "a@b.cd, 10.1.1.1 é 4111 1111 1111 1111, +1 (212) 555-0100")]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    want = sorted(repr((i, *[sum(k == x for x, _, _ in plain(t or "")) for k in PLAIN],
                        hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain(t or "")).encode()).hexdigest()))
                  for i, t in rows)
    assert sorted(repr(tuple(r)[:6]) for r in got) == want


def test_redaction(make):
    rows = [(1, "write to a@b.cd now"), (2, None), (3, ""), (4, "ip 10.0.0.1 ip 10.0.0.1")]
    out = {r["doc_id"]: r["text"] for r in pii.redact(make(rows)).collect()}
    assert out == {1: "write to <EMAIL> now", 2: None, 3: "", 4: "ip <IP> ip <IP>"}
    assert pii.redact(make([])).count() == 0


@pytest.mark.parametrize("text,want", [
    ("10.0.0.0 4111 1111 1111 1111", "<IP>"), ("+1 415 555 1234.bob@x.org", "<PHONE>"),
    ("see 10.0.0.0 4111 1111 1111 1111, a@b.cd", "see <IP>, <EMAIL>")])
def test_overlapping_spans_go_whole(text, want):
    assert pii.redacted(text) == want
