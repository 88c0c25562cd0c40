"""The prefix-tree join against all pairs."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from freshet.llm import jaccard
from freshet.llm._common import mix, runs


def own_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def own_set(text, width):
    w = own_words(text)
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width, num, den):
    sets = [own_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    count = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None \
                    and den * len(a & b) >= num * len(a | b):
                count[i] += 1
                count[j] += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return sorted(((key, len(sets[i]), count[i], least.get(root(i)) if key is not None else None)
                   for i, (key, _) in enumerate(rows)), key=repr)


def near_copies(n, size, seed, edits=3):
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(size)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(r.randrange(edits + 1)):
            own[r.randrange(size)] = f"x{r.randrange(10**6)}"
        if r.random() < 0.3:
            own = own[:size - r.randrange(size // 8 + 1)]
        out.append(" ".join(own))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), min_size=1, max_size=12),
       st.sampled_from([(9, 10), (4, 5), (1, 2), (1, 1)]))
def test_trie_finds_every_link(sets, limit):
    num, den = limit
    found = {i: sorted(j) for i, j in jaccard.links(
        [np.array(sorted(s), np.uint64) for s in sets], num, num + den)}
    want = {i: [j for j, b in enumerate(sets) if j != i and den * len(a & b) >= num * len(a | b)]
            for i, a in enumerate(sets)}
    assert found == want


@pytest.mark.parametrize("block", [600, 5])
@pytest.mark.parametrize("width,threshold,num,den", [(3, "0.9", 90, 100), (5, 0.8, 80, 100)])
def test_components(make, odd, texts, monkeypatch, block, width, threshold, num, den):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    hot = near_copies(60, 120, 1) + near_copies(25, 40, 2) + near_copies(12, 6, 3)
    rows = odd + texts[:110] + [(1000 + i, t) for i, t in enumerate(hot)] + [(2000 + i, hot[0]) for i in range(15)]
    rows = [r for r in rows if len(r[1] or "") < 60_000]
    out = jaccard.cluster(make(rows).repartition(7), width=width, threshold=threshold).collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["n_links"], r["component_id"]) for r in out), key=repr)
    assert got == brute(rows, width, num, den)


def test_no_documents(make):
    assert jaccard.cluster(make([]), width=3, threshold=0.9).count() == 0


def test_nothing_links(make):
    out = jaccard.cluster(make([(1, "a b c d"), (2, "e f g"), (3, None)]), width=3, threshold=0.9).collect()
    assert {(r["doc_id"], r["component_id"], r["n_links"]) for r in out} == {(1, 1, 0), (2, 2, 0), (3, 3, 0)}


def hashed(sets):
    """Sets of small numbers as sets of 64-bit hashes."""
    return [np.sort(mix(np.array(sorted(s), np.uint64))) for s in sets]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 300), min_size=1, max_size=300), min_size=1, max_size=12), st.integers(0, 3),
       st.sampled_from([(9, 10), (4, 5), (1, 2), (1, 1)]))
def test_sketches_part_no_link(sets, near, limit):
    num, den = limit
    sets += [set(sorted(s)[near:]) or s for s in sets]
    sets.sort(key=len)
    own = hashed(sets)
    root = jaccard.sift(np.array([len(s) for s in sets]), [jaccard.sketch(s, num, num + den) for s in own], num, num + den)
    for i, a in enumerate(sets):
        assert all(root[i] == root[j] for j, b in enumerate(sets) if den * len(a & b) >= num * len(a | b))


@pytest.mark.parametrize("num,den", [(9, 10), (4, 5)])
def test_sketches_part_the_unlike(num, den):
    r = random.Random(5)
    sets = sorted((set(r.sample(range(10**6), r.choice([60, 250, 300, 1000, 1100]))) for _ in range(120)), key=len)
    root = jaccard.sift(np.array([len(s) for s in sets]), [jaccard.sketch(s, num, num + den) for s in hashed(sets)], num, num + den)
    assert root.tolist() == list(range(120))


def test_shared_counters_of_shingles_leave_the_order_to_the_words():
    hashes = mix(np.arange(1, 41, dtype=np.uint64))
    rarity = np.full((2, 1 << jaccard.SLOT_BITS), 300, np.uint32)
    rarity[1][jaccard._slots(hashes[20:21])] = 1
    first = jaccard._rarest_first(hashes, 3, rarity)
    assert set(first[:3]) == set(runs(hashes, 3)[18:21]) and len(first) == 38


def test_texts_that_share_a_run_by_chance_are_not_sent(make, monkeypatch):
    """Each text shares its rarest runs with the next one, and is unlike it otherwise."""
    r, sent, blocks = random.Random(6), [], jaccard._blocks
    lines = [" ".join(f"rare{i}x{k}" for k in range(8)) for i in range(81)]
    common = [" ".join(f"w{i}x{k}" for k in range(8)) for i in range(40)]
    rows = [(i, " ".join([lines[i], *r.sample(common, 12), lines[i + 1]])) for i in range(80)]
    rows += [(1000 + i, t) for i, t in enumerate(near_copies(3, 120, 7, edits=1))]
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    monkeypatch.setattr(jaccard, "_blocks", lambda *a: sent.append(blocks(*a)) or sent[-1])
    out = jaccard.cluster(make(rows), width=3, threshold="0.8").collect()
    assert sorted(((x["doc_id"], x["n_shingles"], x["n_links"], x["component_id"]) for x in out), key=repr) == brute(rows, 3, 80, 100)
    assert sent[-1].count() <= 3
