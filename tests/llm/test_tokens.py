"""Encoding, the id store, packing and token counts against the library on whole texts."""

import uuid
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from freshet.llm import packing, pieces, token_counts, token_store
from freshet.session import shared_dir

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


def whole(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def libraries():
    return {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab Z.,'!\n\t é́İΣς1日<|>"), max_size=40), max_size=4))
def test_pieces_encode_as_the_whole_text(texts):
    for path in (BYTE, WORD):
        tk = Tokenizer.from_file(path) if path not in _CACHE else _CACHE[path]
        _CACHE[path] = tk
        found = pieces.encoder(path).encode(texts)
        assert [f.tolist() for f in found] == [tk.encode(t, add_special_tokens=False).ids for t in texts]


_CACHE: dict = {}


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_on_texts_and_small_memory(path, odd, texts, libraries, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 300)
    own = pieces.PieceEncoder(path)
    rows = [t for _, t in odd + texts]
    for i in range(0, len(rows), 7):
        for text, ids in zip(rows[i:i + 7], own.encode(rows[i:i + 7])):
            assert ids.tolist() == libraries[path].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("keys", [[], [5], list(range(1000)), [-3, 2**62, -2**63, 7]])
def test_perfect_hash_is_minimal(keys):
    keys = np.array(keys, np.int64)
    levels, ranks, slots = token_store.build(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    prints = np.zeros(len(keys), np.uint32)
    prints[slots] = token_store.fingerprint(keys)
    assert token_store.look_up(keys, levels, ranks, prints).tolist() == slots.tolist()
    absent = np.arange(10**9, 10**9 + 500)
    assert (token_store.look_up(absent, levels, ranks, prints) == -1).mean() > 0.99


def test_store_round_trip(spark, make, odd, monkeypatch):
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    token_store.write(make(odd), path, BYTE, 2, shard_ids=5000)
    store = token_store.open_store(spark, path)
    rows = sorted((r for r in odd), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for key, text in rows:
        ids = whole(BYTE, text) + [2]
        want.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_store.listing(store).collect()
    key = lambda r: (r[1],)
    assert sorted(map(tuple, got), key=key) == want
    keys = spark.createDataFrame([(k,) for k in (1, 3, 9, 77, None)], "doc_id long")
    found = {r["key"]: r["ids"] for r in token_store.get(store, keys).collect()}
    texts = {k: t for k, t in reversed(odd)}
    assert found == {k: whole(BYTE, texts[k]) + [2] for k in (1, 3, 9)}


def test_store_of_nothing(spark, make):
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    token_store.write(make([]), path, BYTE, 2)
    assert token_store.listing(token_store.open_store(spark, path)).count() == 0


def _check_packing(rows, out, size=2048):
    """Every document in order and whole, sequences gapless, no padding."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    left = defaultdict(list)
    for key, text in rows:
        left[key].append(whole(WORD, text) + [1])
    for key, pieces_ in docs.items():
        ids = sorted(zlib.crc32(b"".join([np.frombuffer(p["ids"], "<u4").tobytes()])) for p in pieces_)
        assert ids == sorted(p["ids_crc32"] for p in pieces_)
        total = sum(p["length"] for p in pieces_)
        assert total == sum(map(len, left[key]))
        if len(left[key]) == 1:
            joined = b"".join(p["ids"] for p in sorted(pieces_, key=lambda p: p["start"]))
            assert np.frombuffer(joined, "<u4").tolist() == left[key][0]
            assert {p["doc_tokens"] for p in pieces_} == {len(left[key][0])}
    assert set(docs) == set(left)
    for parts in sequences.values():
        parts.sort(key=lambda p: p["offset"])
        at = 0
        for p in parts:
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= size and at & (at - 1) == 0
    lengths = [sum(p["length"] for p in s) for s in sequences.values()]
    assert len([x for x in lengths if x < size]) <= size.bit_length()


@pytest.mark.parametrize("parts", [1, 5, 70])
def test_packing(make, odd, texts, parts):
    rows = odd + texts[:60]
    out = packing.pack(make(rows).repartition(parts), WORD, 1, keep_ids=True).collect()
    _check_packing(rows, out)


def test_packing_of_nothing(make):
    assert packing.pack(make([]), WORD, 1).count() == 0


def test_best_fit_cuts_only_where_nothing_fits():
    p = packing.Packer(10, 0, windows=2)
    for doc, n in enumerate([6, 8, 3, 2, 5]):
        p.add(doc, np.arange(n), 0, n)
    # 3 does not fit beside 8 but beside 6; 2 completes 8; 5 opens the emptied window
    assert [(d, s, len(i), q, o) for d, s, i, _, q, o in p.done] == [(1, 0, 8, 0, 0), (3, 0, 2, 0, 8)]
    p.add(5, np.arange(6), 0, 6)  # 9 and 5 are open: the fullest is filled with one id of it
    assert [(d, s, len(i)) for d, s, i, *_ in p.done[2:5]] == [(0, 0, 6), (2, 0, 3), (5, 0, 1)]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_against_offsets(make, odd, texts, libraries, rule):
    rows = [(i, t) for i, (_, t) in enumerate(odd[:4] + odd[5:6] + odd[7:12] + texts[:25])]
    got = {r["doc_id"]: r for r in token_counts.attribute(make(rows), BYTE, rule=rule).collect()}
    assert len(got) == len(rows)
    for key, text in rows:
        spans = libraries[BYTE].encode(text or "", add_special_tokens=False).offsets
        sections = token_counts.line_sections(text or "")
        want = [0] * len(sections)
        for a, b in spans:
            over = [min(b, e) - max(a, s) for s, e in sections]
            touched = [k for k, o in enumerate(over) if o > 0]
            want[touched[0] if rule == "first" else max(touched, key=lambda k: (over[k], -k))] += 1
        assert [s["n_tokens"] for s in got[key]["sections"]] == want
        assert got[key]["doc_tokens"] == len(spans) == sum(want) and got[key]["outside_tokens"] == 0


def test_token_counts_of_given_sections(spark):
    df = spark.createDataFrame(
        [(1, "hello world again", [(0, 7), (7, 99), (None, 2)]), (2, "abc", []), (3, None, [(0, 4)]), (4, "abc", None)],
        "doc_id long, text string, own array<struct<start:int,end:int>>")
    got = {r["doc_id"]: r for r in token_counts.attribute(df, BYTE, sections="own", rule="first").collect()}
    assert [s["n_tokens"] for s in got[1]["sections"]] == [2, 1]  # " world" starts in the first
    most = {r["doc_id"]: r for r in token_counts.attribute(df, BYTE, sections="own", rule="most").collect()}
    assert [s["n_tokens"] for s in most[1]["sections"]] == [1, 2]
    assert got[2]["outside_tokens"] == got[2]["doc_tokens"] > 0 and got[3]["doc_tokens"] == 0
    assert got[4]["sections"] == []
    with pytest.raises(ValueError):
        token_counts.attribute(df, BYTE, rule="last")


def test_every_document_of_a_key_is_got(spark, make):
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    rows = [(None, "none"), (4, "before"), (5, "one"), (5, "two"), (5, "three"), (6, "after")]
    token_store.write(make(rows), path, BYTE, 2)
    keys = spark.createDataFrame([(5,), (6,), (7,)], "doc_id long")
    got = token_store.get(token_store.open_store(spark, path), keys).collect()
    assert sorted(map(tuple, got)) == sorted((k, whole(BYTE, t) + [2]) for k, t in rows if k in (5, 6))
