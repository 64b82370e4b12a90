import zlib

import numpy as np

from lingora.llm import pu_quality
from tests.llm.util import ODD, docs_frame

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_of_the_query(spark):
    out = pu_quality.op1_pu_quality(spark, SF).cache()
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9


def test_prior_and_non_negative_risk_on_a_known_mixture():
    rng = np.random.default_rng(1)
    good = lambda n: np.abs(rng.normal(4, 1, (n, 4)))
    bad = lambda n: np.abs(rng.normal(1, 0.5, (n, 4)))
    unlabelled = np.concatenate([good(1400), bad(600)])
    rng.shuffle(unlabelled)
    prior = pu_quality.class_prior(good(2000), unlabelled)
    assert abs(prior - 0.7) < 0.08
    net = pu_quality.fit(good(2000), unlabelled, prior)
    assert (net.score(good(500)) > 0.5).mean() > 0.97 and (net.score(bad(500)) < 0.3).mean() > 0.97


def test_odd_tables(spark):
    docs = docs_frame(spark, [*ODD, (1, "a"), (1, "a")]).selectExpr("*", "0.1 as score", "1 as y")
    labels = spark.createDataFrame([(900, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert pu_quality.train(docs, labels) is None
    rows = pu_quality.score(docs, None).collect()
    assert len(rows) == len(ODD) + 2 and all(r.score == 0.5 and r.held_out is not None for r in rows)
    assert pu_quality.score(docs.where("false"), None).count() == 0
    good = spark.createDataFrame([(d, 1) for d, _ in ODD if d], "doc_id long, quality int")
    net, prior = pu_quality.train(docs, good)
    assert all(0 <= r.score <= 1 for r in pu_quality.score(docs, net).collect())
