"""Each stage against a plain version of it on its own input, then the run as a whole."""

import random

import corpus_pipeline as cp
import pytest
from test_jaccard import brute, near_copies
from test_tokens import _check_packing

from freshet.llm import decontamination, jaccard, pii, toxicity
from freshet.llm._common import documents


@pytest.fixture(scope="module")
def folder(spark, make, odd, tmp_path_factory):
    """Small tables with every case: copies, an item, personal data, and what the other tests call odd."""
    path = str(tmp_path_factory.mktemp("tables"))
    base = documents(spark, "/root/testdata/sf0.001")
    more = near_copies(25, 60, 4)
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    item = bench.first()["text"]
    extra = [(3000 + i, t) for i, t in enumerate(more)] + [(3100, more[0]), (3101, f"clean words {item} and more"),
                                                         (3102, "write to me@example.org or call +1 (212) 555-0100")]
    rows = [r for r in odd if len(r[1] or "") < 9000] + extra
    base.unionByName(make(rows).select(base.columns)).write.parquet(f"{path}/documents.parquet")
    bench.write.parquet(f"{path}/benchmark.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=repr)


def test_stages(spark, folder):
    docs = documents(spark, folder).selectExpr("*", "1 as _id", "2 as _again", "3 as mark", "4 as score")
    labels = spark.read.parquet(f"{folder}/labels.parquet")

    clean = cp.drop_toxic(spark, docs, folder)
    model = toxicity.fitted(docs, labels)
    assert clean.columns == docs.columns
    assert pairs(clean) == [p for p in pairs(docs) if toxicity.logits(model, [p[1]])[0] < 0]
    assert 0 < docs.count() - clean.count() < 60

    single = cp.drop_near_duplicates(spark, docs, folder)
    assert single.columns == docs.columns
    rows = pairs(docs)
    plain = brute(rows, 5, 80, 100)
    groups = {c for _, n, _, c in plain if n and c is not None}
    free = [p for p in rows if p[0] is None or not (p[1] or "").split()]
    kept = pairs(single)
    assert len(kept) == len(groups) + len(free)
    assert {k for k, t in kept if k is not None and (t or "").split()} == groups

    left = cp.drop_contaminated(spark, docs, folder)
    m = decontamination.Matcher([tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
    assert pairs(left) == [p for p, h in zip(rows, m.find([t for _, t in rows])) if not h]
    assert 3101 not in {k for k, _ in pairs(left)}

    hidden = cp.redact_personal_data(spark, docs, folder)
    assert hidden.columns == docs.columns and hidden.dtypes == docs.dtypes
    assert pairs(hidden) == sorted(((k, pii.redacted(t)) for k, t in rows), key=repr)
    assert hidden.where("text is not null and n_chars <> length(text)").count() == 0


def test_run(spark, folder):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    docs = documents(spark, folder)
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    _check_packing(rows, cp.run(spark, folder).collect())


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_texts_that_share_a_run_by_chance_are_not_sent(spark, make, monkeypatch):
    """Each text shares a line with the next one, and is unlike it otherwise."""
    r, sent, blocks = random.Random(8), [], jaccard._blocks
    lines = [" ".join(f"rare{i}x{k}" for k in range(8)) for i in range(81)]
    common = [" ".join(f"w{i}x{k}" for k in range(8)) for i in range(40)]
    rows = [(i, " ".join([lines[i], *r.sample(common, 12), lines[i + 1]])) for i in range(80)]
    rows += [(1000 + i, t) for i, t in enumerate(near_copies(3, 120, 7, edits=1))]
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    monkeypatch.setattr(jaccard, "_blocks", lambda *a: sent.append(blocks(*a)) or sent[-1])
    single = cp.drop_near_duplicates(spark, make(rows), "")
    assert sorted(x["doc_id"] for x in single.collect()) == sorted({c for *_, c in brute(rows, 5, 80, 100)})
    assert sent[-1].count() <= 3
