from __future__ import annotations

import numpy as np
from conftest import rows
from llm_cases import documents, empty, fold, odd_documents, with_clashing

from shortfall.llm import quality_gam
from shortfall.llm.queries import op4_quality_gam


def area(labels, scores):
    """Share of pairs of a good and a bad row that are in order."""
    good, bad = scores[labels == 1], scores[labels == 0]
    return ((good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()).item()


def test_tables_learn_a_curve():
    x = np.random.default_rng(0).uniform(-1, 1, (4000, 3))
    y = (np.abs(x[:, 0]) > 0.5).astype(float)  # not monotonic, two features mean nothing
    model = quality_gam.boost(x, y)
    assert area(y, model.score(x)) > 0.99
    spread = [np.ptp(t) for t in model.tables]
    assert spread[0] > 5 * max(spread[1:])


def test_pairs_learn_what_no_single_feature_shows():
    x = np.random.default_rng(1).uniform(-1, 1, (4000, 4))
    y = (x[:, 1] * x[:, 3] > 0).astype(float)
    model = quality_gam.boost(x, y)
    assert (1, 3) in model.pairs
    assert area(y, model.score(x)) > 0.95


def test_score_is_a_sum_of_table_entries():
    x = np.random.default_rng(2).uniform(0, 1, (500, 3))
    model = quality_gam.boost(x, (x[:, 0] + x[:, 1] > 1).astype(float))
    for row, found in zip(x[:20], model.score(x[:20]), strict=True):
        total = model.start + sum(t[(e <= v).sum()] for t, e, v in zip(model.tables, model.edges, row, strict=True))
        for (i, j), t in model.pairs.items():
            total += t[(model.pair_edges[i] <= row[i]).sum(), (model.pair_edges[j] <= row[j]).sum()]
        assert abs(found - 1 / (1 + np.exp(-total))) < 1e-12


def test_odd_rows_and_labels(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 1), (None, 1), (6, None), (9, 1), (11, 0)], "doc_id bigint, label int")
    model = quality_gam.fit(with_clashing(docs), labels)
    found = quality_gam.score(with_clashing(docs), model).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    assert quality_gam.fit(docs, labels.limit(0)).score(np.zeros((2, len(quality_gam.FEATURES)))).tolist() == [0.5, 0.5]
    assert rows(quality_gam.score(empty(spark), model)) == []
    assert quality_gam.fit(empty(spark), labels).tables == []


def test_training_rows_are_bounded(spark):
    docs = documents(spark, [f"text {i}" for i in range(200)])
    labels = spark.range(200).selectExpr("id as doc_id", "cast(id % 2 as int) as label")
    seen = []
    original = quality_gam.boost
    try:
        quality_gam.boost = lambda x, y: seen.append(len(y)) or original(x, y)
        quality_gam.fit(docs, labels, train_rows=50)
    finally:
        quality_gam.boost = original
    assert seen == [50]


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = op4_quality_gam(spark, folder).join(labels, "doc_id").where("quality is not null").collect()
    held = [r for r in found if r["held_out"]]
    assert all(fold(r["doc_id"], 5) == 0 for r in held) and len(held) > 50
    y, s = (np.array([r[c] for r in held], float) for c in ("quality", "score"))
    assert area(y, s) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in found)


def test_rows_of_one_id_are_one_training_row(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_gam, "boost", lambda features, labels: seen.append((features, labels)))
    texts = [f"text number {i % 7} of some words" for i in range(2000)] + ["another one", "a third"]
    docs = documents(spark, texts, ids=[5] * 2000 + [6, 7])
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, 1), (5, 1)], "doc_id bigint, label int")
    quality_gam.fit(docs, labels)
    features, found = seen[0]
    assert features.shape[0] == 3 and found.tolist() == [1.0, 0.0, 1.0]
