"""Removed words against all windows compared, and against its SQL."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from freshet.llm import substring_dedup as sd

SMALL = "/root/testdata/sf0.001"


def brute(rows, window=sd.WINDOW):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = Counter(tuple(w[p:p + window]) for _, w in docs for p in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = {j for p in range(len(w) - window + 1) if seen[tuple(w[p:p + window])] > 1 for j in range(p, p + window)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "n_words", "n_removed", "kept").collect())


@pytest.fixture(scope="module")
def planted():
    """Shared passages of several lengths, overlapping repeats, copies, near copies, a frequent passage."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(500)}"
    passages = [[word() for _ in range(n)] for n in (34, 35, 36, 60, 200)]
    rows = []
    for i in range(80):
        words = [word() for _ in range(rng.randrange(120))]
        for p in rng.sample(passages, rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = p
        rows.append((i, " ".join(words)))
    rows += [(100, "a b " * 40), (101, "a " * 36), (102, "b " * 35), (103, rows[5][1]), (104, rows[5][1] + " end"),
             (105, "\n\t".join(rows[6][1].split())), (106, rows[6][1].upper())]
    return rows


@pytest.mark.parametrize("window,gram,group", [(35, 8, 4096), (35, 8, 3), (35, 8, 1), (9, 3, 5), (35, 35, 4096), (5, 5, 2)])
def test_against_brute_force(make, odd, planted, window, gram, group):
    rows = odd + planted
    assert got(sd.dedup(make(rows), window=window, gram=gram, group=group)) == brute(rows, window)


def test_few_records_at_once(make, planted):
    assert got(sd.dedup(make(planted), at_once=7)) == brute(planted)


def test_empty_table_and_bad_run(make):
    assert sd.dedup(make([])).collect() == []
    with pytest.raises(ValueError):
        sd.dedup(make([]), window=4, gram=5)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_every_suffix_has_one_prefix_within_its_window(words):
    words = [w.encode() for w in words]
    run, at, first, last = sd.prefixes(words, 9, 3)
    owner = {}
    for a, lo, hi in zip(at, first, last):
        for p in range(lo, hi + 1):
            assert p not in owner and p <= a <= p + 9 - 3
            owner[p] = a - p
    assert sorted(owner) == list(range(max(0, len(words) - 8)))
    by_content = {}
    for p, off in owner.items():  # equal windows route alike
        assert by_content.setdefault(tuple(words[p:p + 9]), off) == off


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 2)] * 3), min_size=1, max_size=30))
def test_deep_nodes_are_the_repeated_rows(rows):
    seen = Counter(rows)
    assert sd.deep(np.array(rows, np.uint32)).tolist() == [seen[r] > 1 for r in rows]


def test_query_columns_and_sql(spark):
    found = sd.query(spark, SMALL)
    assert sorted(found.dtypes) == [("doc_id", "bigint"), ("kept_sha256", "string"), ("n_removed", "bigint"), ("n_words", "bigint")]
    cols = "doc_id, n_words, n_removed, kept_sha256"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    rows = db.execute(f"SELECT {cols} FROM ({sd.SQL})").fetchall()
    have = [tuple(r) for r in found.select(*cols.split(", ")).collect()]
    assert sorted(have) == sorted(rows) and sum(r[2] for r in have) > 0
    text = dict(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    clean = next(r for r in have if r[2] == 0)
    assert clean[3] == hashlib.sha256(" ".join(text[clean[0]].split()).encode()).hexdigest()
