"""Estimates against exact similarity, edited texts against a plain loop, near duplicates against all pairs."""

import hashlib

import numpy as np
import pytest
from test_jaccard import brute, near_copies, own_set

from freshet.llm import fingerprints as fp


def likeness(a, b):
    x, y = own_set(a, 5), own_set(b, 5)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_estimate():
    base = near_copies(40, 200, 7, edits=12)
    errors = [fp.likeness(fp.signature(a), fp.signature(b)) - likeness(a, b) for a, b in zip(base, base[1:])]
    assert np.std(errors) < 0.06 and abs(np.mean(errors)) < 0.03
    assert fp.likeness(fp.signature(None), fp.signature("")) == 1
    assert fp.likeness(fp.signature(""), fp.signature("a b c")) == 0


@pytest.mark.parametrize("size,parts", [(8 << 20, 1), (4000, 9)])
def test_edited_texts(make, odd, texts, monkeypatch, size, parts):
    monkeypatch.setattr(fp, "PART_BYTES", size)
    rows = [(i if i is None or i > 20 else i - 7, t) for i, t in odd] + [(1000 + i, t) for i, t in texts[:50]]
    got = fp.with_edited(make(rows).repartition(parts)).collect()
    placed = sorted([(i, t or "") for i, t in rows if i is not None], key=lambda r: (-r[0], r[1]))
    want = []
    for (key, own), (_, after) in zip(placed, placed[1:] + placed[:1]):
        m = len(own) // 3
        changed = own[:len(own) - m] + after[:m]
        sigs = [fp.signature(x) for x in (own, changed, after)]
        want.append((key, len(own), hashlib.sha256(changed.encode()).hexdigest(), fp.written(sigs[0]),
                     fp.written(sigs[1]), fp.likeness(sigs[0], sigs[1]), fp.likeness(sigs[0], sigs[2])))
    want += [(None, len(t or ""), None, fp.written(fp.signature(t)), None, None, None) for i, t in rows if i is None]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_one_document_and_none(make):
    row = fp.with_edited(make([(5, "abcdef")])).collect()
    assert len(row) == 1 and row[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    assert fp.with_edited(make([])).count() == 0
    assert fp.with_edited(make([(None, "a")])).first()["n_chars"] == 1


def test_near_duplicates(make, odd, texts):
    rows = [r for r in odd if len(r[1] or "") < 9000] + [(100 + i, t) for i, t in texts[:60]] \
        + [(1000 + i, t) for i, t in enumerate(near_copies(40, 90, 3))]
    got = sorted(((r["doc_id"], r["n_shingles"], r["n_links"], r["component_id"])
                  for r in fp.near_duplicates(make(rows)).collect()), key=repr)
    assert got == brute(rows, 5, 80, 100)
