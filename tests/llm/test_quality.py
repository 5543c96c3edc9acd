from __future__ import annotations

import zlib

import numpy as np
import plain
from pyspark.sql import functions as F

from tidewell.llm import quality as q


def test_lasso_weighs_the_rule_that_matters():
    r = np.random.default_rng(1)
    x = r.random((1500, len(q.STATISTICS)))
    y = ((x[:, 2] > 0.4) & (x[:, 5] <= 0.7)).astype(float)
    model = q.fit(x, y)
    assert 0 < len(model.rules) < 120
    assert ((model.score(x) >= 0.5) == (y == 1)).mean() > 0.97
    order = r.permutation(len(y))
    assert q.fit(x[order], y[order]) == model


def test_column_is_the_model(spark):
    r = np.random.default_rng(2)
    x = r.random((300, len(q.STATISTICS)))
    model = q.fit(x, (x[:, 0] + x[:, 1] > 1).astype(float))
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], ", ".join(f"s{k} double" for k in range(x.shape[1])))
    got = [v[0] for v in df.select(model.column(lambda k: df[f"s{k}"])).collect()]
    assert np.allclose(got, model.score(x))


def test_edges(spark):
    assert q.statistics(None) == q.statistics("") == q.statistics(" \n") == (0.0,) * len(q.STATISTICS)
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (2, "some words here", 9), (None, "x", 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = q.scores(docs, q.train(docs, labels)).collect()
    assert len(rows) == 4 and {r.score for r in rows} == {0.5} and {r.predicted for r in rows} == {1}
    assert q.accepted(docs, q.RuleModel((), (), 0.0)).columns == docs.columns
    assert q.scores(docs.limit(0), q.RuleModel((), (), 0.0)).count() == 0
    one = spark.createDataFrame([(2, 1), (3, None), (77, 0)], "doc_id long, quality int")
    assert 0 < q.train(docs, one).score(np.zeros((1, len(q.STATISTICS))))[0] < 1


def test_held_out_accuracy(spark, sf_dir):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in q.op8_quality_rules(spark, sf).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all((r.score >= 0.3) == bool(r.predicted) for r in rows.values())
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert np.mean([rows[r.doc_id].predicted == r.quality for r in labels]) > 0.97
    assert np.mean([rows[r.doc_id].predicted for r in labels if r.quality == 1]) > 0.99


def test_repeated_ids_and_clashing_columns_give_one_model(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    odd = docs.unionByName(docs).withColumn("_y", F.lit("x")).withColumn("_id", F.lit(1)).withColumn("_s0", F.lit(2.0))
    one = q.train(odd.repartition(3), labels, rows=30)
    assert one == q.train(odd.repartition(7, "lang"), labels, rows=30) and one.rules
    assert q.accepted(odd, one).columns == odd.columns
    tie = spark.createDataFrame([(k, "same text here", k % 2) for k in range(40)], "doc_id long, text string, quality int")
    flat = q.scores(tie, q.train(tie, tie.select("doc_id", "quality")))
    assert flat.select("score").distinct().count() == 1 and flat.count() == 40


def test_query_as_a_plain_loop(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = q.train(docs, labels)
    got = {r.doc_id: r for r in q.op8_quality_rules(spark, sf_dir).collect()}
    for d in docs.collect():
        want = plain.quality(model, d.text)
        r = got.pop(d.doc_id)
        assert abs(r.score - want) < 1e-9 and r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3)
    assert not got
