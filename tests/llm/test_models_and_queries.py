"""Held-out accuracy of the classifiers, recall of the neighbour search, and the registered queries on the small tables."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from agro_jobs.llm import nn_descent, quality_pu, toxic_segments
from agro_jobs.llm.common import table
from agro_jobs.llm.queries import QUERIES
from tests.llm.test_text_operators import brute_leaks, brute_substrings, docs

SIZE = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize(("name", "label", "least"), [("op4_quality_pu", "quality", 0.95), ("op6_toxic_segments", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    got = QUERIES[name](spark, SIZE).select("doc_id", "held_out", "score", "predicted").toPandas()
    assert got["score"].between(0, 1).all()
    both = got.merge(table(spark, SIZE, "labels").toPandas(), on="doc_id")
    held = both[both["held_out"]]
    assert auc(held[label].to_numpy(), held["score"].to_numpy()) >= least


def test_classifiers_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = docs(spark, [(1, "a b", "s"), (None, None, None)])
    assert quality_pu.score(d, quality_pu.fit(d, none)).count() == 2
    assert toxic_segments.score(d, *toxic_segments.fit(d, none)).where("score = 0").count() == 2
    assert quality_pu.keep_good(d, {"constant": 0.9}).columns == d.columns


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2600, 8))
    x[500:520] = x[500]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(3000, None), (3001, [0.0] * 8), (3002, [1.0, None] + [0.0] * 6), (3003, [float("nan")] * 8), (None, [1.0] * 8)]
    got = nn_descent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 2600, 50):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        want = np.lexsort((np.arange(2600), -s))[:5]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert list(mine["rank"]) == [1, 2, 3, 4, 5]
        hits += len(set(want) & set(mine["vec_id"]))
        assert np.allclose(mine["score"], (u @ u[q])[mine["vec_id"]], atol=1e-12)
    assert hits / (5 * 52) >= 0.9
    assert got[got["query_id"] == 500].sort_values("rank")["vec_id"].tolist() == [501, 502, 503, 504, 505]


def test_neighbours_whatever_size_and_length(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e199]), (2, [1e-200, 1e-200]), (50, [1.0, 1.0, 0.0]), (51, [1.0, 0.9, 0.0]), (52, [0.0, 1.0, 5.0]), (53, [2.0]), (100, [3.0]), (54, [-1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, node string, rank int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nn_descent.nearest(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {(0, 1): 1, (0, 2): 2, (50, 1): 51, (50, 2): 52, (100, 1): 53, (100, 2): 54}
    for (q, r), (v, s) in got.items():
        x, y = (np.array(dict(rows)[i]) / np.abs(dict(rows)[i]).max() for i in (q, v))
        assert abs(s - x @ y / np.sqrt((x @ x) * (y @ y))) < 1e-15, (q, r)


def test_neighbours_of_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.1]), (50, [1.0, 0.0])]
    got = [tuple(r)[:3] for r in nn_descent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50), (0, 2, 1), (0, 3, 1), (50, 1, 0), (50, 2, 1), (50, 3, 1)]
    assert nn_descent.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_queries_against_brute_force(spark, data):
    rows = [(r.doc_id, r.text, None) for r in table(spark, data, "documents").collect()]
    items = [tuple(r) for r in table(spark, data, "benchmark").select("item_id", "text").collect()]
    assert sorted([tuple(r) for r in QUERIES["op5_substring_dedup"](spark, data).collect()], key=str) == brute_substrings(rows, 35)
    assert sorted([tuple(r) for r in QUERIES["op8_winnowing"](spark, data).collect()], key=str) == brute_leaks(rows, items)


def test_pipeline(spark, data):
    d = table(spark, data, "documents")
    total = d.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = corpus_pipeline.materialize(stage(spark, d, data), f"test-{name}")
        assert d.columns == table(spark, data, "documents").columns
        if name in ("quality", "near", "leaks"):
            assert 0 < d.count() <= total
            total = d.count()
        if name == "leaks":
            left = [(r.doc_id, r.text, None) for r in d.collect()]
            items = [tuple(r) for r in table(spark, data, "benchmark").select("item_id", "text").collect()]
            assert not any(r[5] for r in brute_leaks(left, items))
    assert corpus_pipeline.STAGES[-1][1](spark, d, data).count() == d.count()


def test_pipeline_of_odd_rows(spark, data):
    """Nulls in any column, empty and repeated rows, one id for many texts, columns with clashing names, and no rows at all."""
    passage = next(r.text for r in table(spark, data, "benchmark").collect() if len((r.text or "").split()) > 20)
    good = [r.text for r in table(spark, data, "documents").limit(30).collect()]
    rows = [(i, t, "a" if i % 2 else None) for i, t in enumerate(good)] + [(None, t, "b") for t in good[:5]] + [(None, None, None), (3, "", "a"), (3, "", "a"), (4, "word " * 50_000, "c"), (5, passage, "b"), (5, passage, "b")]
    odd = docs(spark, rows).withColumnRenamed("row", "at")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, data)
        if name != "shard":
            assert got.columns == odd.columns
        kept = got.collect()
        assert stage(spark, odd.limit(0), data).count() == 0
        if name == "shard":
            assert len(kept) == len(rows)
        if name == "near":
            texts = [r.text or "" for r in kept]
            assert len(texts) == len(set(texts))
        if name == "leaks":
            assert not any(r.text == passage for r in kept)
            assert len(kept) >= len(rows) - 6
        if name == "mix":
            budget = 1.5 * sum(len((t or "").split()) for _, t, _ in rows)
            assert abs(sum(len((r.text or "").split()) for r in kept) - budget) <= 50_000
