import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from freshet.llm import sharding


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1000), min_size=4, max_size=4), min_size=1, max_size=30))
def test_places_give_the_loads(vectors):
    loads, places = sharding.difference(np.array(vectors, np.int64))
    again = np.zeros(4, np.int64)
    for v, p in zip(vectors, places):
        assert sorted(p) == [0, 1, 2, 3]
        for part, place in enumerate(p):
            again[place] += v[part]
    assert again.tolist() == loads.tolist() == sorted(loads)


def test_differencing_beats_greedy_on_the_textbook_case():
    v = np.zeros((5, 2), np.int64)
    v[:, 0] = [8, 7, 6, 5, 4]
    assert np.ptp(sharding.difference(v)[0]) == 2  # the method's known answer


@pytest.mark.parametrize("bucket,fan,slots", [(20_000, 512, 50_000), (7, 3, 20)])
def test_shards(make, odd, texts, monkeypatch, bucket, fan, slots):
    monkeypatch.setattr(sharding, "BUCKET_GROUPS", bucket)
    monkeypatch.setattr(sharding, "FAN_IN", fan)
    monkeypatch.setattr(sharding, "SLOT_ROWS", slots)
    rows = [r for r in odd if len(r[1] or "") < 10_000] + texts + [(900, "hot text " * 30)] * 40
    out = sharding.assign(make(rows), 16).collect()
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=repr) == want
    shards, group, loads = defaultdict(list), defaultdict(set), defaultdict(int)
    for r in out:
        shards[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
        group[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    nothing = zlib.crc32(b"")
    assert all(len(s) == 1 for (c, _), s in group.items() if c != nothing)
    total = sum(loads.values())
    assert max(loads.values()) - min(loads.values()) < 0.02 * total


def test_no_documents(make):
    assert sharding.assign(make([]), 4).count() == 0
