"""Statistics of texts, and of all texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from volmesh.llm import quality, rules, textstats


def test_bare_words_of_any_symbols():
    at = textstats.SHARES.index("bare_words")
    for text, share in (("### *** ==== ...", 1), ("### *** ==== ... -", 1), ("a ### b é", 0.25), ("  a-b 1| ", 0), ("--", 1), ("one", 0)):
        assert textstats.statistics(text)[1][at] == pytest.approx(share), text


def test_moments_and_samples_of_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, len(textstats.SHARES))).astype(np.float32)
    stats = spark.createDataFrame([(None if i % 2 else i, i, v.tolist()) for i, v in enumerate(x)], f"doc_id long, {quality.TEXT_KEY} long, shares array<float>")
    null = quality.sampled(stats, 300).where("doc_id IS NULL").count()
    assert 100 < null < 200
    centre, spread = quality.moments(stats)
    assert np.allclose(centre, x.mean(axis=0), atol=1e-6) and np.allclose(spread, x.std(axis=0), atol=1e-6)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 900, 2)], "doc_id long, quality int, toxic int")
    net = quality.train(stats, labels, most_unlabelled=50)
    whole = quality.moments(stats.where(~quality.held_out(F.col("doc_id"))))
    assert np.allclose(net.centre, whole[0]) and np.allclose(net.scale, whole[1])
    seen = []
    monkeypatch.setattr(rules, "MOST_GROWN", 5)
    monkeypatch.setattr(rules, "grow", lambda good, spread: seen.append(spread) or rules.Forest(*[np.zeros(0, int)] * 5, 1.0, 1))
    docs = spark.createDataFrame([(i, "word " * i + "," * (i % 7)) for i in range(40)], "doc_id long, text string")
    rules.judge(docs, labels)
    assert np.allclose(seen[0], np.array([textstats.statistics("word " * i + "," * (i % 7))[1] for i in range(40)]).std(axis=0), atol=1e-4)


def test_the_threshold_is_that_of_all_labelled_rows(spark):
    rng = np.random.default_rng(3)
    for many, some in ((21_000, 300), (5, 4), (1, 1)):
        good, bad = np.round(rng.beta(3, 6, many), 4), np.round(rng.beta(5, 5, some), 4)
        rows = [(1, v) for v in good.tolist()] + [(0, v) for v in bad.tolist()]
        least = np.quantile(good, rules.KEEP_GOOD)
        tries = np.unique(np.r_[least, bad[bad > least], good[good > least]])
        want = tries[np.argmax([(bad > t).mean() - 3 * (good > t).mean() for t in tries])]
        assert rules.threshold(spark.createDataFrame(rows, "label int, score double")) == want
    assert rules.threshold(spark.createDataFrame([(1, 0.5)], "label int, score double")) == np.inf
