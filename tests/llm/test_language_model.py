"""Scores against a plain dictionary model; probabilities sum to one."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from freshet.llm import language_model as lm
from pyspark.sql import functions as F


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [None]


def held(key):
    return zlib.crc32(str("null" if key is None else key).encode()) % 7 == 2


def brute(rows):
    train = [tokens(t) for k, t in rows if not held(k)]
    uni = Counter(w for d in train for w in d)
    bi = Counter(p for d in train for p in zip(["^", *d], d))
    n, v = sum(uni.values()), len(uni)
    count = lambda h: len(train) if h == "^" else uni[h]
    out = []
    for key, text in rows:
        own = tokens(text)
        p = [(uni[w] + 1) / (n + v + 1) for w in own]
        base = sum(map(math.log10, p))
        total = sum(math.log10((bi[h, w] + lm.STRENGTH * q) / (count(h) + lm.STRENGTH))
                    for h, w, q in zip(["^", *own], own, p))
        out.append((key, held(key), len(own), sum(uni[w] > 0 for w in own), n, base, total))
    return out


@pytest.mark.parametrize("block,entries", [(500_000, 3_000_000), (300, 900)])
def test_scores(make, odd, texts, monkeypatch, block, entries):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", block)
    monkeypatch.setattr(lm, "CELL_ENTRIES", entries)
    rows = odd + texts[:80] + [(500 + i, "the same line again and again") for i in range(30)]
    got = lm.score(make(rows).repartition(5), F.pmod(lm.crc_of_id("doc_id"), F.lit(7)) == 2).collect()
    key = lambda r: repr((r[0], r[2], r[3], round(r[5], 6)))
    got, want = sorted(map(tuple, got), key=key), sorted(brute(rows), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert np.allclose(g[5:], w[5:], rtol=1e-9)


def test_nothing_to_learn_from(make):
    assert lm.score(make([]), F.lit(True)).count() == 0
    row = lm.score(make([(1, "a b")]), F.lit(True)).first()
    assert tuple(row)[1:] == (True, 3, 0, 0, 0.0, 0.0)


def test_a_history_gives_one():
    """P(. | h) over the known tokens and one unknown."""
    uni, docs = np.array([3, 2, 2, 0]), 2  # the last word is unknown; word 2 is the end
    pairs, bi = np.array([0, 1, 1 * 5 + 2, 4 * 5, 4 * 5 + 3]), np.array([1, 2, 2, 2, 0])
    a = lm.Automaton(uni, pairs, bi, 7, 3, docs)
    for history in (0, 1, 4):
        state = 1 if history == 4 else history + 2
        p = [10 ** (a.arcs[state * 4 + w] if state * 4 + w in a.arcs else a.fail[state] + a.root[w]) for w in range(4)]
        assert math.isclose(sum(p), 1)


def test_better_than_the_base_on_held_out_rows(make, texts):
    rows = [(i, t) for i, (_, t) in enumerate(texts * 2)]  # copies in both folds
    got = lm.score(make(rows), F.pmod(lm.crc_of_id("doc_id"), F.lit(7)) == 2).where("held_out") \
        .agg(F.sum("base_score"), F.sum("score")).first()
    assert got[1] > got[0]
