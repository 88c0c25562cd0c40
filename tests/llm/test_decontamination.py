"""Hits against a plain edit distance; recall of the embedding at the edits allowed."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from freshet.llm import decontamination as dc


def infix_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=25))
def test_nearest_is_exact(item, text):
    d, a, b = dc.nearest(item, text)
    assert d == infix_distance(item, text) == distance(item, text[a:b])


def prose(r, n):
    return [" ".join("".join(r.choice(["an", "re", "th", "ou", "en", "st"]) for _ in range(r.randrange(1, 5)))
                     for _ in range(40)) for _ in range(n)]


def changed(r, text, share):
    out = list(text)
    for _ in range(int(share * len(text))):
        i = r.randrange(len(out))
        kind = r.randrange(3)
        if kind == 0:
            out[i] = r.choice("xyz")
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, r.choice("xyz"))
    return "".join(out)


def test_embedding_keeps_what_is_near():
    """Recall of the samples on windows changed by nearly all edits allowed; few of the others pass."""
    r = random.Random(5)
    items = prose(r, 30)
    m = dc.Matcher(list(enumerate(items)))
    near = [(dc._codes(changed(r, items[i % 30], 0.18)[:len(items[i % 30])]), i % 30) for i in range(600)]
    far = [(dc._codes(t[:len(items[i % 30])]), i % 30) for i, t in enumerate(prose(r, 600))]
    assert m.candidates(near).mean() > 0.96
    assert m.candidates(far).mean() < 0.7  # of six syllables only, all prose is half alike


@pytest.mark.parametrize("limit", [4 << 20, 300])
def test_documents(spark, make, odd, monkeypatch, limit):
    monkeypatch.setattr(dc, "BLOCK_BYTES", limit)
    r = random.Random(9)
    items, other = prose(r, 12), prose(r, 40)
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "..."), (None, items[0]), (93, items[3])],
                                  "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as start_char")
    rows, held = [], {}
    for i, t in enumerate(other):
        if i % 4 == 0:
            k = i // 4
            passage = [items[k], items[k].upper(), items[k].replace(" ", ",  "), changed(r, items[k], 0.05)][k % 4]
            held[100 + i] = k
            t = t[:300] + " " + passage + " " + t[300:]
        rows.append((100 + i, t))
    rows += odd + [(100, rows[0][1]), (None, items[1])]
    hits = dc.find(make(rows), bench).collect()
    got = {}
    for h in hits:
        got.setdefault(h["doc_id"], set()).add(h["item_id"])
    assert got == {**{d: {k, 93} if k == 3 else {k} for d, k in held.items()}, None: {1}}
    assert len([h for h in hits if h["doc_id"] == 100]) == 2
    norm = lambda s: " ".join(w.lower() for w in dc._WORD.findall(s))
    texts = dict(reversed(rows))
    for h in (h for h in hits if h["doc_id"] is not None):
        item = items[3 if h["item_id"] == 93 else h["item_id"]]
        stretch = norm(texts[h["doc_id"]][h["start_char"]:h["end_char"]])
        assert infix_distance(item, stretch) <= dc.SHARE * len(item) and abs(len(stretch) - len(item)) < 0.3 * len(item)
    kept = dc.clean(make(rows), bench)
    assert kept.columns == make(rows).columns
    assert sorted((repr(x["doc_id"]), repr(x["text"])) for x in kept.collect()) == \
        sorted((repr(d), repr(t)) for d, t in rows if d not in got or d is None and t != items[1])


def test_nothing(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.find(make([(1, "a b c")]), none).count() == 0
    assert dc.clean(make([(1, "a b c")]), none).count() == 1
    assert dc.find(make([]), spark.createDataFrame([(1, "a b")], none.schema)).count() == 0


def test_short_items_and_edges(spark, make):
    bench = spark.createDataFrame([(1, "alpha"), (2, "beta gamma")], "item_id long, text string")
    got = dc.find(make([(1, "alpha"), (2, "x beta gamma"), (3, "beta"), (4, "gamma beta alpha")]), bench).collect()
    assert sorted((h["doc_id"], h["item_id"]) for h in got) == [(1, 1), (2, 2), (4, 1)]


def every_third(text):
    """One letter changed in every third word: no run of three words stands unchanged."""
    return " ".join("#".join([w[:1], w[2:]]).replace("#", "q") if k % 3 == 1 and len(w) > 1 else w
                    for k, w in enumerate(text.split(" ")))


@pytest.mark.parametrize("share", [0.1, 0.2, None])
def test_recall_from_the_text_on(share):
    """Through find(): items edited up to the share allowed, whatever words the edits fall on."""
    r = random.Random(17)
    items, other = prose(r, 60), prose(r, 60)
    m = dc.Matcher(list(enumerate(items)))
    edited = [every_third(t) if share is None else changed(r, t, share) for t in items]
    found = m.find([f"{a[:150]} {t} {a[150:]}" for a, t in zip(other, edited)])
    assert np.mean([k in [h[0] for h in own] for k, own in enumerate(found)]) >= (0.98 if share == 0.2 else 1)


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", min_size=1, max_size=60), st.integers(0, 10**6), st.integers(1, 3))
def test_no_item_within_the_share_goes_without_a_window(item, seed, copies):
    r = random.Random(seed)
    m = dc.Matcher([(0, item)])
    if not m.items:
        return
    own = m.items[0][1]
    text = " ".join("".join(r.choice("abc ") for _ in range(30)) + changed(r, own, 0.2) for _ in range(copies))
    body = dc._text(dc._body(text))
    near = infix_distance(own, body) <= int(dc.SHARE * len(own))
    assert not near or m._windows({0: dc._codes(body)})


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aB _-. 7éÉİΣσß日😀\n"), max_size=30))
def test_bodies_are_the_words_in_lower_case(text):
    assert dc._text(dc._body(text)) == " ".join(w.lower() for w in dc._WORD.findall(text))


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(dc, "CHUNK", 300)
    r = random.Random(3)
    items, other = prose(r, 5), prose(r, 40)
    text = " ".join(t + (" " + changed(r, items[k // 8], 0.15) if k % 8 == 0 else "") for k, t in enumerate(other))
    assert [h[0] for h in dc.Matcher(list(enumerate(items))).find(["x", text])[1]] == [0, 1, 2, 3, 4]


def test_items_without_an_id_and_with_textual_ids(spark, make):
    first, second, third = prose(random.Random(8), 3)
    bench = spark.createDataFrame([(None, first), (None, second), ("c-3", third)], "item_id string, text string")
    docs = make([(1, first), (2, "x " + second), (3, third), (4, f"{first} {second}"), (5, "nothing")])
    assert [r["doc_id"] for r in dc.clean(docs, bench).collect()] == [5]
    got = sorted(((h["doc_id"], h["item_id"]) for h in dc.find(docs, bench, null_ids=True).collect()), key=repr)
    assert got == [(1, None), (2, None), (3, "c-3"), (4, None), (4, None)]


def test_pieces_met_are_those_within_one_edit():
    """Neither pieces that share a hash with the text nor pieces two edits away are met; all others are."""
    r = random.Random(4)
    item, text = ("".join(r.choice("ab") for _ in range(n)) for n in (80, 400))
    text = text[:150] + item + text[150:] + item[:7]
    pieces = dc._Pieces(dc.PIECE, True, [(0, item, 16)])
    want = set()
    for k in range(len(item) // 8):
        piece = item[8 * k:8 * k + 8]
        for at in range(len(text)):
            own = text[at:at + 8]
            longer, shorter = text[at:at + 9], text[at:at + 7]
            if own == piece:
                want.add((k, at, 2))
            elif len(own) == 8 and sum(a != b for a, b in zip(own, piece)) == 1 \
                    or any(piece[:i] + piece[i + 1:] == shorter for i in range(8)) \
                    or len(longer) == 9 and any(longer[:i] + longer[i + 1:] == piece for i in range(8)):
                want.add((k, at, 1))
    begin, piece, often = pieces._met(dc._codes(text))
    assert set(zip(piece.tolist(), (begin - pieces.reach + pieces.before[piece]).tolist(), often.tolist())) == want
    assert len(piece) == len(want)
