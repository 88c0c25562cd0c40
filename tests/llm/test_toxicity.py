"""The risk estimator against its definition, and what is learned on held-out rows."""

import zlib

import numpy as np
import pytest

from freshet.llm import toxicity as tx


def risk(z, toxic, prior):
    loss = lambda s: np.logaddexp(0, s)
    p, u = z[toxic], z[~toxic]
    return prior * loss(-p).mean(), loss(u).mean() - prior * loss(p).mean()


@pytest.mark.parametrize("shift", [0.0, -4.0])
def test_gradient_is_that_of_the_risk_or_undoes_the_fit(shift):
    r = np.random.default_rng(3)
    z, toxic, prior = r.normal(size=30), np.arange(30) < 8, 0.4
    z[~toxic] += shift
    z[toxic] += -shift  # over-fitted: U's negative part falls below what P explains
    positive, rest = risk(z, toxic, prior)
    assert (rest < 0) == (shift < 0)
    want = np.empty(30)
    for i in range(30):
        step = np.zeros(30)
        step[i] = 1e-6
        a, b = risk(z + step, toxic, prior), risk(z - step, toxic, prior)
        value = (lambda x: x[0] + x[1]) if rest >= 0 else (lambda x: -x[1])
        want[i] = (value(a) - value(b)) / 2e-6
    assert np.allclose(tx.risk_gradient(z, toxic, prior), want, atol=1e-6)


def sample(n, seed):
    r = np.random.default_rng(seed)
    plain = [f"word{i}" for i in range(300)]
    out = []
    for i in range(n):
        own = list(r.choice(plain, r.integers(5, 200)))
        toxic = r.random() < 0.15
        if toxic:
            own.insert(int(r.integers(len(own))), ["vilest", "vilely", "Nasty,", "nasty"][r.integers(4)])
        out.append((i, " ".join(own), int(toxic)))
    return out


def test_learning_from_positives_and_unlabelled():
    rows, new = sample(1500, 1), sample(600, 2)
    p = [t for _, t, y in rows[:750] if y]
    u = [t for _, t, _ in rows[750:]]
    model = tx.train(p + u, np.arange(len(p) + len(u)) < len(p), 0.15)
    found = tx.logits(model, [t for _, t, _ in new]) >= 0
    toxic = np.array([y for *_, y in new], bool)
    assert found[toxic].mean() > 0.95 and found[~toxic].mean() < 0.05
    # a word never seen, but with a toxic start, and a long clean text
    toxic, *clean = tx.logits(model, ["word1 vileblob word2", "word1", " ".join(f"unseen{i}" for i in range(900)), ""])
    assert toxic > 0 > max(clean)


def test_query_on_a_table(spark, tmp_path, make, odd):
    rows = [(i, t) for i, t, _ in sample(500, 4)] + [(i and 10_000 + i, t) for i, t in odd]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, y) for i, _, y in sample(500, 4) if i % 2] + [(1, 1, None), (None, 1, 1), (99_999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = tx.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        text = "null" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(text.encode()) % 5 == 0)
    truth = {i: y for i, _, y in sample(500, 4)}
    out = [(truth[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([a == b for a, b in out]) > 0.9
    # labels of held-out rows change nothing
    spark.createDataFrame([(i, q, (1 - t if t is not None and zlib.crc32(str(i).encode()) % 5 == 0 else t))
                           for i, q, t in labels], "doc_id long, quality int, toxic int") \
        .write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    again = tx.query(spark, str(tmp_path)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["score"])
    assert sorted(again, key=key) == sorted(got, key=key)


def test_nothing_labelled_and_nothing_there(spark, make):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = make([(1, "a b"), (2, None)])
    assert tx.classifier(docs, none) is None
    assert {(r["score"], r["predicted"]) for r in tx.score(docs, None).collect()} == {(0.0, 0)}
    assert tx.keep_clean(docs, None).count() == 2
    assert tx.score(make([]), None).count() == 0
