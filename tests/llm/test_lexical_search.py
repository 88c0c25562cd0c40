"""Ranked search against a plain count over all documents, and against its SQL."""

import math
import re

import duckdb
import pytest

from freshet.llm import lexical_search as ls

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(ls.TERM, (text or "").translate(LOWER))


def brute(docs, items, top=ls.TOP):
    """Repr of (item, rank, doc, score); every row of docs counts for itself."""
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n_docs, n_all = len(held), sum(len(t) for _, t in held)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    df = {}
    for _, t in held:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, want in wanted.items():
        scores = []
        for i, t in held:
            m = 100 - 50 + 50 * len(t) * n_docs // n_all
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    * (1_000_000_000 * t.count(w) // (1000 * t.count(w) + 20 * m)) for w in want if w in t)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:top])]
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_guard_keeps_terms():
    text = "A-b É! \x7f_x9 ÀB日本  "
    assert [t.decode() for t in ls.guarded(text).split()] == terms(text) == ["a", "b", "É", "x9", "Àb日本"]


@pytest.mark.parametrize("top,block_bytes", [(50, 1 << 20), (2, 20)])
def test_against_brute_force(spark, make, odd, texts, top, block_bytes):
    docs = odd + texts[:60] + [(90, "one"), (91, "one"), (92, "ONE two one")]
    items = [(1, "One TWO, three"), (2, None), (3, ""), (4, "..."), (5, "absent"), (1, "end"), (None, "word1 é élan"),
             (6, texts[0][1]), (7, texts[3][1][:200]), (6, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as score", "3 as rank")
    assert got(ls.search(make(docs), bench, top=top, block_bytes=block_bytes)) == brute(docs, items, top)


def test_empty_tables(spark, make):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ls.search(make([]), some).count() == 0
    assert ls.search(make([(1, "a")]), none).count() == 0
    assert ls.search(make([(1, None), (2, "...")]), some).count() == 0


def test_query_columns_and_sql(spark):
    found = ls.query(spark, SMALL)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    rows = db.execute(f"SELECT item_id, rank, doc_id, score FROM ({ls.SQL})").fetchall()
    assert got(found) == sorted(map(repr, rows)) and rows


def test_small_steps_give_the_same(spark, monkeypatch):
    want = got(ls.query(spark, SMALL))
    monkeypatch.setattr(ls, "CELLS", 64)
    assert got(ls.query(spark, SMALL)) == want
